"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built of a bounded sample of its
labelled text. A text is parsed, left to right, into the longest phrases that
occur in that sample; ``phrases * log2(sample length) / text length`` estimates
the cross entropy, and the language with the fewest normalised phrases wins.

All documents of a batch are parsed side by side, one character per step, over
dense transition tables, so whole texts of any length cost a few array
operations per character.

The sample is bounded by parameters: per language the labelled rows with the
smallest hash of the id (then of the text), ``docs_per_language`` at most, of
``MIN_CHARS..MAX_CHARS`` characters, until ``chars_per_language`` are reached.
A language with fewer such rows also learns from its shorter rows, as many as
make up those characters, and then from the starts of its longer ones.
Characters are lower-cased, and every character of the samples has a code of its
own. Transitions of the most frequent ones are a dense table, at most
``DENSE_CODES`` wide and ``DENSE_CELLS`` in all; those of the others are sorted
keys, as one script can have thousands of characters.

A text that is null or has no letter is ``und`` with score 0; so is every text
when there is nothing to learn from. Ties go to the first language in sorted
order. Rows without an id are not learned from and not held out.
"""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loupe.llm import common as C

UND = "und"
MIN_CHARS, MAX_CHARS = 200, 20_000
DENSE_CODES, DENSE_CELLS = 200, 1 << 26
FOLDS, HELD_OUT = 3, 1


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))


def fold(id_col: str, folds: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def samples(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", docs_per_language: int = 24,
            chars_per_language: int = 30_000) -> dict[str, str]:
    """A bounded sample of labelled texts per language, from all rows with a letter."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        F.col("l").isNotNull() & F.col("i").isNotNull() & F.col("t").rlike(r"\p{L}"))
    n = F.length("t")
    rows = rows.withColumn("tier", F.when(n < MIN_CHARS, 1).when(n > MAX_CHARS, 2).otherwise(0)).withColumn("h", F.xxhash64("t"))
    counts = rows.groupBy("l").agg(F.count_if(F.col("tier") == 0).alias("mid"), F.count_if(F.col("tier") == 1).alias("short"), F.sum(F.when(F.col("tier") == 1, n)).alias("chars")).collect()
    # ids first: the texts of the chosen rows only are fetched
    ids = rows.select("i", "l", "tier", "h")
    top = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", "h")
    chosen = [ids.where("tier = 0").withColumn("n", F.row_number().over(top)).where(F.col("n") <= docs_per_language)]
    scarce = [r for r in counts if r["mid"] < docs_per_language]
    if scarce:
        # twice the rows that reach the characters on average; a language's mean length tells how many
        want = {r["l"]: docs_per_language + (2 * math.ceil(chars_per_language * r["short"] / r["chars"]) if r["short"] else 0) for r in scarce}
        within = Window.partitionBy("l", "tier").orderBy(F.xxhash64("i"), "i", "h")
        some = ids.where(F.col("l").isin(list(want)) & (F.col("tier") > 0)).withColumn("n", F.row_number().over(within)).where(F.col("n") <= max(want.values()))
        most = docs.sparkSession.createDataFrame(list(want.items()), "l string, most long")
        chosen.append(some.join(F.broadcast(most), "l").where((F.col("tier") == 1) & (F.col("n") <= F.col("most")) | (F.col("n") <= docs_per_language)).select(ids.columns + ["n"]))
    # an id may be repeated: the text's hash tells its rows apart, and equal rows are fetched as often as they are chosen
    chosen = functools.reduce(DataFrame.unionByName, chosen).groupBy("i", "l", "tier", "h").agg(F.count(F.lit(1)).alias("times"))
    part = F.when(F.col("tier") == 2, F.substring(F.regexp_replace("t", r"^\P{L}+", ""), 1, chars_per_language)).otherwise(F.col("t"))
    got: dict[str, list[str]] = {}
    fetched = rows.join(F.broadcast(chosen), ["i", "l", "tier", "h"]).dropDuplicates(["i", "l", "tier", "h"])
    for r in fetched.select("i", "l", "tier", "times", part.alias("t")).orderBy("l", "tier", "i", "t").collect():
        have = got.setdefault(r["l"], [])
        for _ in range(r["times"]):
            if sum(map(len, have)) < chars_per_language:
                have.append(r["t"])
    return {k: "\n".join(v) for k, v in sorted(got.items())}


def _automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a code sequence; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Counts cross-parsing phrases of texts against every language at once."""

    def __init__(self, texts: dict[str, str]):
        self.langs = list(texts)
        lower = [t.lower() for t in texts.values()]
        chars = [c for c, _ in sorted(Counter("".join(lower)).items(), key=lambda x: (-x[1], x[0]))]
        self.n_codes = len(chars) + 1
        self.code = np.zeros(0x110000, np.min_scalar_type(len(chars)))
        self.code[[ord(c) for c in chars]] = np.arange(1, self.n_codes)
        autos = [_automaton(self.encode(t)) for t in lower]
        states = sum(map(len, autos))
        self.size = size = min(self.n_codes, DENSE_CODES + 1, max(1, DENSE_CELLS // max(states, 1)))
        self.roots = (np.cumsum([0] + [len(a) for a in autos])[:-1]).tolist()
        table = np.empty((states, size), np.int32)
        # of characters beyond the dense table: where a phrase begun by one leads, and (state, code) -> state in order
        self.first = np.zeros((len(autos), self.n_codes), np.int32)
        keys, to = [], []
        for n, (auto, base) in enumerate(zip(autos, self.roots)):
            self.first[n] = base
            for c, s in auto[0].items():
                self.first[n, c] = s + base
            table[base:base + len(auto)] = ~self.first[n, :size]  # no transition: a phrase ends, the next begins here
            for s, moves in enumerate(auto, base):
                for c, t in moves.items():
                    if c < size:
                        table[s, c] = t + base
                    else:
                        keys.append(s * self.n_codes + c)
                        to.append(t + base)
        self.table = table.reshape(-1)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.to = np.array(keys, np.int64)[order], np.array(to, np.int32)[order]
        self.bits = np.array([np.log2(max(2, len(t))) for t in lower])

    def _rare(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Transitions of (languages x texts) states by codes beyond the dense table."""
        key = state.astype(np.int64) * self.n_codes + codes
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], ~self.first[:, codes])

    def encode(self, text: str) -> np.ndarray:
        return self.code[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(languages x texts) phrase counts, and text lengths."""
        codes = [self.encode(t) for t in texts]
        lens = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-lens, kind="stable")
        flat = np.concatenate([codes[i] for i in order]) if len(codes) else np.empty(0, self.code.dtype)
        ends = np.cumsum(lens[order])
        begin = ends - lens[order]
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(texts), 1)
        count = np.zeros(state.shape, np.int32)
        alive, t, down = len(texts), 0, lens[order]
        while alive and t < (down[0] if len(down) else 0):
            while down[alive - 1] <= t:
                alive -= 1
            now = flat[begin[:alive] + t]
            if self.n_codes > self.size and (now >= self.size).any():
                rare = np.flatnonzero(now >= self.size)
                v = self.table[state[:, :alive] * self.size + np.where(now < self.size, now, 0)]
                v[:, rare] = self._rare(state[:, rare], now[rare].astype(np.int64))
            else:
                v = self.table[state[:, :alive] * self.size + now]
            ended = v >> 31
            count[:, :alive] -= ended
            state[:, :alive] = v ^ ended
            t += 1
        out = np.empty_like(count)
        out[:, order] = count + 1
        return out, lens

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not texts:
            return [], np.empty(0)
        count, lens = self.phrases(texts)
        cost = count * self.bits[:, None] / np.maximum(lens, 1)
        best = cost.argmin(0)
        share = np.exp2(-(cost - cost.min(0)) * np.minimum(lens, 64))
        return [self.langs[i] for i in best], 1 / share.sum(0)


_PARSER: dict[str, Parser] = {}


def _parser(texts: dict[str, str]) -> Parser:
    key = repr(texts)
    if key not in _PARSER:  # one for each Python worker
        _PARSER.clear()
        _PARSER[key] = Parser(texts)
    return _PARSER[key]


def _predictor(texts: dict[str, str], batch_chars: int):
    def predict(text: pd.Series, letters: pd.Series) -> pd.DataFrame:
        lang, score = np.full(len(text), UND, object), np.zeros(len(text))
        todo = np.flatnonzero(letters.fillna(False).to_numpy(bool)) if texts else []
        values = text.to_numpy()
        part: list[int] = []
        size = 0
        for n, i in enumerate(todo):
            part.append(i)
            size += len(values[i])
            if size >= batch_chars or n == len(todo) - 1:
                lang[part], score[part] = _parser(texts).predict([values[j] for j in part])
                part, size = [], 0
        return pd.DataFrame({"lang": lang, "score": score})
    return F.pandas_udf(predict, "lang string, score double")


def identify(docs: DataFrame, texts: dict[str, str], text_col: str = "text", out: str = "language",
             batch_chars: int = 8_000_000) -> DataFrame:
    """Adds ``out``: struct (lang, score). ``texts`` as from ``samples``."""
    C.prepare(docs.sparkSession)
    return docs.withColumn(out, _predictor(texts, batch_chars)(F.col(text_col).cast("string"), has_letter(text_col)))


def learn(docs: DataFrame, **bounds) -> dict[str, str]:
    """Samples of the rows that are not held out (crc32 of the id modulo 3 is not 1)."""
    return samples(docs.where(fold("doc_id", FOLDS) != HELD_OUT), **bounds)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every whole text of ``documents``."""
    docs = C.table(spark, sf_dir, "documents")
    texts = learn(docs)
    return identify(docs.select("doc_id", "text"), texts).select(
        "doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
