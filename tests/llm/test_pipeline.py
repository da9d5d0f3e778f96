"""The whole pipeline against a version of each stage that looks at everything."""

import hashlib
from array import array
from collections import Counter

import duckdb
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline as P
from loupe.llm import bpe, mixing

from .test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    # language: what has a letter stays
    docs = docs[[t is not None and any(c.isalpha() for c in t) for t in docs["text"]]]
    # exact copies: the largest id stays
    docs = docs.sort_values("doc_id").drop_duplicates("text", keep="last").reset_index(drop=True)
    # near copies: all pairs; the smallest id of each class stays
    docs = docs.iloc[[min(g, key=lambda i: docs["doc_id"][i]) for g in brute(list(enumerate(docs["text"])))]]
    # mixing: by its SQL
    con = duckdb.connect()
    con.register("documents", docs)
    copies = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, copies FROM ({mixing.SQL['op3_mixing']})").fetchall()}
    # BPE: by the library
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    want = Counter()
    for i, t in zip(docs["doc_id"], docs["text"]):
        ids = lib.encode(t, add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want[i, len(ids), tuple(ids), sha(array("I", ids).tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())] += copies[i]
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in P.run(spark, SF).collect())
    assert got == +want and sum(got.values()) > 30
