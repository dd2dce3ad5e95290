"""Whole texts as arrays: code points, words and their hashes, many texts at a time."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at a time; a longer text is taken in parts that end at white space.
BLOCK = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_SPACE = re.compile(r"\s")


def fold(text: str) -> str:
    """Lower case, one character for each: offsets stay those of the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def blocks(texts: Sequence[str | None], cut: re.Pattern = _SPACE, size: int | None = None) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Parts of the texts, some `size` characters in all (by default BLOCK); the row and the offset of each. Nulls count as empty.

    A text longer than that is parted where `cut` matches.
    """
    size = size or BLOCK
    parts: list[str] = []
    rows: list[int] = []
    offsets: list[int] = []
    held = 0
    for row, text in enumerate(texts):
        text, start = text or "", 0
        while True:
            end = start + size
            if end < len(text):
                found = cut.search(text, end)
                end = found.end() if found else len(text)
            part = text[start:end]
            if parts and held + len(part) > size:
                yield parts, np.array(rows), np.array(offsets)
                parts, rows, offsets, held = [], [], [], 0
            parts.append(part)
            rows.append(row)
            offsets.append(start)
            held += len(part)
            start = end
            if start >= len(text):
                break
    if parts:
        yield parts, np.array(rows), np.array(offsets)


def batches(sizes: Sequence[int], rows: int = 1000, chars: int = 200_000) -> Iterator[tuple[int, int]]:
    """Slices (start, end) of texts of these sizes, of a bounded number of texts and, but for single long ones, of characters."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == rows or held + n > chars):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(texts: pa.Array, rows: int = 1000, chars: int = 200_000) -> Iterator[tuple[int, int, list[str | None]]]:
    """`batches` of an array of texts, of which only one slice at a time is held as Python strings; then memory is given back."""
    for start, end in batches(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), rows, chars):
        yield start, end, texts[start:end].to_pylist()
    give_back()


@lru_cache
def _trim():
    """The C library's malloc_trim, if it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


def give_back() -> None:
    """Give free memory back to the system. A Python worker lives on from stage to stage; else it keeps what the largest
    batch of each took, beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@lru_cache
def _kinds() -> np.ndarray:
    """For each code point of the basic plane: 1 letter, 2 other alphanumeric, 0 else."""
    return np.array([1 if chr(c).isalpha() else 2 if chr(c).isalnum() else 0 for c in range(0x10000)], dtype=np.uint8)


def kinds(codes: np.ndarray) -> np.ndarray:
    low = codes < 0x10000
    if low.all():
        return _kinds()[codes]
    out = np.zeros(len(codes), dtype=np.uint8)
    out[low] = _kinds()[codes[low]]
    high, inverse = np.unique(codes[~low], return_inverse=True)
    out[~low] = np.array([1 if chr(c).isalpha() else 2 if chr(c).isalnum() else 0 for c in high.tolist()], dtype=np.uint8)[inverse]
    return out


def codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the parts, each followed by a line end, and where each part starts."""
    joined = "\n".join(parts) + "\n"
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of unsigned 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(n, base, dtype=np.uint64)
        factors[0] = 1
        found.append(np.cumprod(factors, dtype=np.uint64))
    return found[0], found[1]


def span_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points that depends on nothing else."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = 1 << max(12, int(len(points)).bit_length())
    power, inverse = _powers(size)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[: len(points)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def words(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits) of the parts, in order, and the part that each is of."""
    points, at = codes(parts)
    inside = np.concatenate([[0], (kinds(points) > 0).astype(np.int8)])
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return span_hashes(points, starts, ends), np.searchsorted(at, starts, side="right") - 1


def shingles(hashes: np.ndarray, of: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of `size` words within a document, and the document; a shorter document is one shingle."""
    if not len(hashes):
        return hashes, of
    first = np.flatnonzero(np.diff(of, prepend=-1))
    counts = np.diff(np.append(first, len(of)))
    total = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(size):
        part = mix(hashes + np.uint64(k + 1))
        total[: max(0, len(total) - k)] += part[k:]
    keep = np.repeat(counts, counts) - (np.arange(len(of)) - np.repeat(first, counts)) >= size
    out, owner = mix(total[keep]), of[keep]
    short = counts < size
    if short.any():
        whole = [mix(np.uint64(n) + sum(mix(hashes[f + k : f + k + 1] + np.uint64(k + 1)) for k in range(n))) for f, n in zip(first[short], counts[short].tolist(), strict=True)]
        out = np.concatenate([out, *whole])
        owner = np.concatenate([owner, of[first[short]]])
        order = np.argsort(owner, kind="stable")
        out, owner = out[order], owner[order]
    return out, owner
