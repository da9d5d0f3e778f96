"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from loupe.llm import (ann, bpe, decontaminate, exact_dedup, language_id, lm_score, merkle, mixing, near_dedup, periodic,
                       substring_dedup, toxicity, warc)

QUERIES = {f.__name__: f for f in (
    ann.op1_cross_polytope, lm_score.op2_stupid_backoff, mixing.op3_mixing, substring_dedup.op4_suffix_dedup, bpe.op5_bpe,
    warc.op6_warc, toxicity.op7_toxicity, near_dedup.op8_near_dedup, language_id.op9_language_id, exact_dedup.op10_exact_dedup,
    merkle.op11_merkle, periodic.op12_periodic_runs, decontaminate.op13_decontamination)}
SQL = {**lm_score.SQL, **mixing.SQL, **warc.SQL, **exact_dedup.SQL, **merkle.SQL, **decontaminate.SQL}
