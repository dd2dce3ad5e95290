"""Token ids of whole texts, word by word, with a bounded cache.

The tokenizer splits at white space and never looks across it, so the ids of a text are those of its parts
between blanks and line ends, in order. Most parts repeat: those of many texts are numbered together, each
different one is looked up once, and only those not met lately are encoded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.text import blocks

#: Words held: those met of late, and as many met before them. The words of one block may go beyond it.
CACHE_WORDS = 200_000
#: Characters whose words are numbered together.
BLOCK = 1_000_000
_BLANK = re.compile("[ \n]")
#: Letters that composing leaves as they are and that have one lower case each, and marks that may follow; not the apostrophe.
_LETTERS = "".join(chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180), *range(0x410, 0x450)) if chr(c) not in "×÷İ")
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")
#: How a tokenizer must fold and part texts for words to be parted here: lower case, and letters apart from marks.
_FOLDS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _laid(flat: np.ndarray, sizes: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbered runs, of which `flat` is made and which have these sizes, one after another; and the size of each."""
    counts = sizes[runs]
    shift = (np.cumsum(sizes) - sizes)[runs] - np.cumsum(counts) + counts
    return flat[np.repeat(shift, counts) + np.arange(counts.sum())], counts


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids; exact for tokenizers that split at white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Which ids end a word: with them, the ids of many words encoded at once are told apart.
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        spec = json.loads(self.tokenizer.to_str())
        folds, parts = ((spec[k] or {}).get(n, []) for k, n in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        #: Whether words are parted; else each is encoded as it is.
        self.folds = folds == _FOLDS and [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["pattern"] == {"Regex": _PARTS}
        # The same model for words in lower case, which need no folding and no parting.
        self.folded = Tokenizer(self.tokenizer.model)
        self.folded.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _encode(self, words: Sequence[str]) -> None:
        """Encode parts of texts one by one."""
        for word, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.cache[word] = np.array(e.ids, dtype="<u4").tobytes()

    def _encode_letters(self, words: Sequence[str], tokenizer) -> None:
        """Encode words of letters alone, many at once."""
        for start in range(0, len(words), 2000):
            part = words[start : start + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):  # a tokenizer that does not mark word ends
                self._encode(part)
                continue
            held = ids.tobytes()
            self.cache.update(zip(part, [held[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of some words as `_parted` leaves them."""
        if len(self.cache) > CACHE_WORDS // 2:
            self.older, self.cache = self.cache, {"": b""}
        cache, older = self.cache, self.older
        folded, letters, plain = [], [], []
        for word in words:
            if word not in cache:
                if (ids := older.get(word)) is not None:
                    cache[word] = ids
                elif self.folds and word.isalpha():
                    (letters if word.strip(_LETTERS) else folded).append(word)
                else:
                    plain.append(word)
        self._encode(plain)
        self._encode_letters(letters, self.tokenizer)
        self._encode_letters(folded, self.folded)
        return list(map(cache.__getitem__, words))

    def _parted(self, words: pa.Array) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
        """The letters of each word, in lower case, and the marks after them; any other word whole, and no marks."""
        marks = pc.utf8_ltrim(words, characters=_LETTERS)
        simple = pc.and_(pc.equal(pc.utf8_rtrim(marks, characters=_MARKS), ""), self.folds)
        body = pc.utf8_lower(pc.utf8_rtrim(words, characters=_MARKS))
        return pc.if_else(simple, body, words).dictionary_encode(), pc.if_else(simple, marks, "").dictionary_encode()

    def _ids(self, parts: list[str]) -> tuple[bytes, list[int]]:
        """The ids of all the parts, one after another, and at which byte those of each part end."""
        split = pc.split_pattern(pc.replace_substring(pa.array(parts, pa.large_string()), "\n", " "), " ")
        coded = split.values.dictionary_encode()
        body, marks = self._parted(coded.dictionary)
        known = self._known([w for half in (body, marks) for w in half.dictionary.to_numpy(zero_copy_only=False).tolist()])
        halves = np.stack([body.indices.to_numpy(), marks.indices.to_numpy() + len(body.dictionary)], axis=1).ravel()
        ids, counts = _laid(np.frombuffer(b"".join(known), dtype="<u4"), np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4, halves)
        ids, counts = _laid(ids, counts.reshape(-1, 2).sum(axis=1), coded.indices.to_numpy())
        ends = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(counts)])
        return ids.tobytes(), (4 * ends[split.offsets.to_numpy()[1:]]).tolist()

    def many(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        found: list[list[bytes]] = [[] for _ in texts]
        for parts, rows, _ in blocks(texts, _BLANK, BLOCK):
            ids, ends = self._ids(parts)
            for row, start, end in zip(rows.tolist(), [0, *ends[:-1]], ends, strict=True):
                found[row].append(ids[start:end])
        return [b"".join(f) for f in found]

    def __call__(self, text: str | None) -> bytes:
        return self.many([text])[0]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The encoder of a Python worker, which keeps its cache from task to task."""
    return WordEncoder(path)
