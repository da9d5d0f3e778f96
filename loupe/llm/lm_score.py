"""Stupid-backoff language-model scores, from n-gram counts of a whole corpus.

Counts of words, word pairs and word triples are taken over all texts of the corpus,
by default the scored documents themselves. A word scores ``count(triple) /
count(its first pair)`` if the triple occurs, else ``0.4 * count(pair) / count(its
first word)`` if the pair does, else ``0.4**2 * count(word) / words`` (one factor
less per word of context missing at a text's start; a word that never occurs counts
as one). A document's score is the mean natural logarithm over its words.

The count tables are partitioned by ranges of an n-gram's 56-bit hash. Groups of
documents send the distinct n-grams they hold with their local counts to those
partitions (so a frequent word is one entry per group) and get the totals back;
scores are summed per document within its group. The exchange stands for a join of
the exploded n-grams with the counts, one row each: three rows a word are far over
the disk that one may use (figures in the README), so a group's n-grams for one
partition travel as one row of packed keys.

Words are those of ``common.word_hashes``. Texts that are null or without a word
have 0 words and a null score. Rows may repeat ids; each row gives one row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loupe.llm import common as C

BACKOFF = 0.4
KEY_BYTES = 7
_ASKS = "g int, r int, keys binary, counts binary"
_TOTALS = "g int, r int, totals binary"


def _grams(tab: pa.Table):
    """(doc ids, rows' word bounds, keys of words, of pairs, of triples, which pairs and triples lie in one row)."""
    tab = tab.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    h, row = C.word_hashes(*C.string_buffers(tab["text"]))
    bounds = np.searchsorted(row, np.arange(len(tab) + 1))
    cut = np.uint64(64 - 8 * KEY_BYTES)
    one = C.mix(h + np.uint64(1)) >> cut
    raw2 = C.mix(h[:-1] * C.M1 + h[1:] + np.uint64(2))
    raw3 = C.mix(raw2[:-1] * C.M1 + h[2:] + np.uint64(3))
    return tab["doc_id"], bounds, one, raw2 >> cut, raw3 >> cut, row[:-1] == row[1:], row[:-2] == row[2:]


def _ranges(keys: np.ndarray, n_ranges: int):
    return C.asks(keys >> np.uint64(8 * KEY_BYTES - 48), n_ranges)


def _asker(n_ranges: int, corpus: bool, queries: bool):
    """Rows for the partitions of the counts; groups that are no queries are numbered below 0 and get no answer."""
    def ask(tab: pa.Table) -> pa.Table:
        _, _, one, two, three, in2, in3 = _grams(tab)
        keys, counts = np.unique(np.concatenate([one, two[in2], three[in3]]), return_counts=True)
        g, parts = tab["g"][0].as_py(), _ranges(keys, n_ranges)
        counts = counts if corpus else np.zeros(len(keys), np.int64)
        return pa.table({"g": pa.array([g if queries else -1 - g] * len(parts), pa.int32()), "r": pa.array([p[0] for p in parts], pa.int32()),
                         "keys": pa.array([C.pack(keys[i:j], KEY_BYTES) for _, i, j in parts], pa.binary()),
                         "counts": pa.array([C.numbers(counts[i:j]) for _, i, j in parts], pa.binary())})
    return ask


def _total(tab: pa.Table) -> pa.Table:
    """Sums of all counts of a partition, for each query group that asked."""
    keys = [C.unpack(b.as_py(), KEY_BYTES) for b in tab["keys"]]
    counts = [C.from_numbers(b.as_py(), len(k)) for b, k in zip(tab["counts"], keys)]
    uniq, inv = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(uniq), np.int64)
    np.add.at(sums, inv, np.concatenate(counts))
    ends = np.cumsum([len(k) for k in keys]).tolist()
    rows = [(g, r, C.numbers(sums[inv[e - len(k):e]])) for g, r, k, e in zip(tab["g"].to_pylist(), tab["r"].to_pylist(), keys, ends) if g >= 0]
    return pa.table({"g": pa.array([x[0] for x in rows], pa.int32()), "r": pa.array([x[1] for x in rows], pa.int32()),
                     "totals": pa.array([x[2] for x in rows], pa.binary())})


def _scores(n_ranges: int, words: int):
    def score(tab: pa.Table, replies: pa.Table) -> pa.Table:
        ids, bounds, one, two, three, in2, in3 = _grams(tab)
        keys, inv = np.unique(np.concatenate([one, two[in2], three[in3]]), return_inverse=True)
        found, total = dict(zip(replies["r"].to_pylist(), replies["totals"].to_pylist())), np.zeros(len(keys), np.int64)
        for r, i, j in _ranges(keys, n_ranges):
            total[i:j] = C.from_numbers(found[r], j - i)
        total = total[inv]
        n = len(one)
        c1, c2, c3 = total[:n], np.zeros(n, np.int64), np.zeros(n, np.int64)
        at2, at3 = np.flatnonzero(in2) + 1, np.flatnonzero(in3) + 2  # places with one and with two words before them
        c2[at2], c3[at3] = total[n:n + len(at2)], total[n + len(at2):]
        out = np.log(np.maximum(c1, 1) / max(words, 1))
        context = np.zeros(n, np.int64)
        context[at2], context[at3] = 1, 2
        use2, use3 = np.flatnonzero(c2 > 0), np.flatnonzero(c3 > 0)
        out[use2] = np.log(c2[use2] / c1[use2 - 1])
        out[use3] = np.log(c3[use3] / c2[use3 - 1])
        order = np.zeros(n, np.int64)
        order[use2], order[use3] = 1, 2
        out += (context - order) * np.log(BACKOFF)
        size = np.diff(bounds)
        sums = np.bincount(np.repeat(np.arange(len(size)), size), out, len(size)) if n else np.zeros(len(size))
        return pa.table({"doc_id": ids, "n_words": pa.array(size, pa.int64()),
                         "log_score": pa.array([round(float(s) / m, 6) if m else None for s, m in zip(sums, size.tolist())], pa.float64())})
    return score


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def score(docs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", group_bytes: int = 8_000_000, range_keys: int = 400_000) -> DataFrame:
    """``(doc_id, n_words, log_score)`` per row of ``docs``, under counts of ``corpus`` (``docs`` itself, if not given).

    ``group_bytes`` and ``range_keys`` bound what a task holds at once; the
    numbers of groups and of partitions of the counts follow the input.
    """
    C.prepare(docs.sparkSession)
    rows, model = _texts(docs, id_col, text_col), _texts(docs if corpus is None else corpus, id_col, text_col)
    ids = rows.schema["doc_id"].dataType.simpleString()
    size = model.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()
    n_bytes, words = int(size[0] or 0), int(size[1] or 0)
    n_ranges = C.n_parts(3 * words, range_keys)
    groups = lambda df, n: C.grouped(df, C.n_parts(n, group_bytes), "doc_id", "text").groupBy("g")
    if corpus is None:
        by_g = groups(rows, n_bytes)
        asks = by_g.applyInArrow(_asker(n_ranges, True, True), _ASKS)
    else:
        by_g = groups(rows, C.total_bytes(rows))
        asks = by_g.applyInArrow(_asker(n_ranges, False, True), _ASKS).unionByName(groups(model, n_bytes).applyInArrow(_asker(n_ranges, True, False), _ASKS))
    totals = asks.groupBy("r").applyInArrow(_total, _TOTALS)
    return by_g.cogroup(totals.groupBy("g")).applyInArrow(_scores(n_ranges, words), f"doc_id {ids}, n_words long, log_score double")


def op2_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of all whole texts of ``documents`` under counts of all of them."""
    return score(C.table(spark, sf_dir, "documents"))


SQL = {"op2_stupid_backoff": f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{C.WORD_SQL}') AS w FROM documents),
t AS (SELECT r, i, w[i] AS w3, w[i - 1] AS w2, w[i - 2] AS w1
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT w3, count(*) AS n FROM t GROUP BY ALL),
c2 AS (SELECT w2, w3, count(*) AS n FROM t WHERE i >= 2 GROUP BY ALL),
c3 AS (SELECT w1, w2, w3, count(*) AS n FROM t WHERE i >= 3 GROUP BY ALL),
s AS (SELECT t.r, CASE WHEN c3.n IS NOT NULL THEN ln(c3.n / ctx.n)
    WHEN c2.n IS NOT NULL THEN ln(c2.n / p.n) + CASE WHEN t.i >= 3 THEN ln({BACKOFF}) ELSE 0 END
    ELSE ln(c1.n / (SELECT count(*) FROM t)) + least(t.i - 1, 2) * ln({BACKOFF}) END AS s
  FROM t JOIN c1 ON t.w3 = c1.w3
  LEFT JOIN c1 p ON t.i >= 2 AND t.w2 = p.w3
  LEFT JOIN c2 ON t.i >= 2 AND t.w2 = c2.w2 AND t.w3 = c2.w3
  LEFT JOIN c2 ctx ON t.i >= 3 AND t.w1 = ctx.w2 AND t.w2 = ctx.w3
  LEFT JOIN c3 ON t.i >= 3 AND t.w1 = c3.w1 AND t.w2 = c3.w2 AND t.w3 = c3.w3)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, round(x.s, 6) AS log_score
FROM d LEFT JOIN (SELECT r, avg(s) AS s FROM s GROUP BY r) x ON d.r = x.r"""}
