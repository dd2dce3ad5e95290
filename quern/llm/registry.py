"""Queries of the training-data operators and the pipeline, by name."""

from __future__ import annotations

import importlib

#: Query name and the module of this subpackage that has it.
QUERIES = {
    "op1_best_fit_packing": "packing",
    "op2_prob_minhash": "near_dedup",
    "op3_jump_sharding": "sharding",
    "op4_language_bitmask": "language",
    "op5_factorisation_machine": "quality",
    "op6_soft_mixing": "mixing",
    "op7_warc_revisits": "warc",
    "op8_line_dedup": "substring",
    "op9_ball_tree_topk": "ball_tree",
    "op10_multiprobe_lsh": "lsh",
}


def queries() -> dict:
    import corpus_pipeline

    found = {name: getattr(importlib.import_module(f"quern.llm.{module}"), name) for name, module in QUERIES.items()}
    return found | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    from quern.llm import ball_tree, warc

    return {"op7_warc_revisits": warc.ORACLE_SQL, "op9_ball_tree_topk": ball_tree.ORACLE_SQL}
