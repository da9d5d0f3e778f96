"""A training-corpus pipeline of the operators in ``loupe.llm``.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from loupe.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from loupe.llm import common as C


def language(spark, docs, sf_dir):
    """Drops documents that are null or without a letter; all others have a language, if there are labels to learn any from."""
    texts = language_id.learn(docs)
    if not texts:
        return docs.where(language_id.has_letter("text"))
    known = language_id.identify(docs, texts, out="__language")
    return known.where(known["__language"]["lang"] != language_id.UND).select(*docs.columns)


def exact(spark, docs, sf_dir):
    """Keeps, of equal texts, the document with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    """Keeps one document of each near-duplicate class."""
    return near_dedup.drop_near(docs)


def mixture(spark, docs, sf_dir):
    """Takes sources to their target weights; a repeated epoch repeats documents."""
    return mixing.mix(docs)


def encode(spark, docs, sf_dir):
    """Token ids of each document, and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, want=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("bpe", encode)]

#: SQL has no suffix automata, weighted sampling or BPE: tests/llm holds run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder before the next."""
    folder = f"{C.scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
