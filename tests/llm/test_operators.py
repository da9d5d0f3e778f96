"""The operators against SQL, libraries, brute force and held-out accuracy on small tables."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from loupe.llm import ann, bpe, common as C, exact_dedup, language_id, lm_score, mixing, queries, toxicity, warc

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(1, "a b c"), (1, "a b c"), (1, "other"), (2, None), (3, ""), (None, "a b c"), (None, None), (4, "É x " * 3000), (5, "É x " * 3000)]
DDL = "doc_id long, text string"


def odd(spark, rows=ODD):
    """Nulls, repeats, a long text, and extra columns whose names the operators use."""
    return spark.createDataFrame(rows, DDL).selectExpr("*", "'en' AS lang", "CAST(NULL AS STRING) AS source", "1L AS n_chars",
                                                       "1 AS g", "2 AS h", "3 AS n", "4 AS tokens", "5 AS copies", "6 AS score", "7 AS unit", "8 AS row")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(cols)
    r6 = lambda v: round(v, 6) if isinstance(v, float) else v
    assert sorted((tuple(map(r6, r)) for r in got.select(*cols).collect()), key=str) == sorted((tuple(map(r6, r)) for r in want.fetchall()), key=str)


def test_bpe_same_as_library(spark):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.vocabulary_path())
    lib.no_truncation()
    lib.no_padding()
    texts = [r["text"] for r in C.table(spark, SF, "documents").collect()] + [
        "<|endoftext|> a<|startoftext|>B", "ΑΣ ΟΔΟΣ.", "İ ǅ", "it's 've'LL 12\t\n x", "", None, "é Å", "\x1c a\x85b​c", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), DDL).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    for r in bpe.round_trip(df).collect():
        ids = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_bpe_same_as_library_for_all_code_points():
    from tokenizers import Tokenizer
    lib, own = Tokenizer.from_file(bpe.vocabulary_path()), bpe.load(bpe.vocabulary_path())
    points = [c for c in (*range(0x34000), *range(0xE0000, 0xE0200), *range(0x34000, 0x110000, 977)) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"a{chr(c)}b 1{chr(c)}" for c in points[i:i + 256]) for i in range(0, len(points), 256)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text) == want.ids


def test_language_on_held_out(spark):
    docs = C.table(spark, MORE, "documents").select("doc_id", "lang")
    out = language_id.op9_language_id(spark, MORE).join(docs, "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(out) > 200 and sum(r["lang_pred"] == r["lang"] for r in out) >= 0.97 * len(out)


def test_language_learns_from_texts_of_any_length(spark):
    rows = [(i, "kurz und gut", "de") for i in range(40)] + [(100, "1 " * 40_000 + "tres largo y bueno " * 2000, "es")] + [
        (200 + i, "some words of a usual length " * 20, "en") for i in range(3)] + [(300, "12 !", "xx"), (301, None, "en")]
    got = language_id.samples(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert list(got) == ["de", "en", "es"] and got["de"].count("kurz") == 40 and got["en"].count("\n") == 2
    assert got["es"].startswith("tres largo") and len(got["es"]) == 30_000


def test_language_stage_keeps_all_letters(spark):
    import corpus_pipeline as P
    rows = [(1, "kurz", "de"), (2, "mot", "fr"), (3, "12 !", "de"), (4, None, "fr"), (5, "", None)]
    for lang in ("lang", "CAST(NULL AS STRING) AS lang"):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("doc_id", "text", lang)
        assert sorted(r["doc_id"] for r in P.STAGES[0][1](spark, df, SF).collect()) == [1, 2]


def test_language_phrases_by_hand(spark):
    p = language_id.Parser({"a": "abab", "b": "bbc"})
    count, lens = p.phrases(["abab", "bbcab", ""])
    # against "bbc", an unknown a ends a phrase each time: a, ba, b
    assert count[:, 0].tolist() == [1, 3] and lens.tolist() == [4, 5, 0]
    got = language_id.identify(odd(spark, ODD + [(9, "123 ...")]), {"en": "some words of a sample"}).collect()
    assert len(got) == len(ODD) + 1 and {r["language"]["lang"] for r in got if r["text"] in (None, "", "123 ...")} == {"und"}
    assert {r["language"]["lang"] for r in language_id.identify(odd(spark), {}).collect()} == {"und"}


def test_toxicity_on_held_out(spark):
    # sf0.1: sf0.01 has under 40 toxic training rows, too few to learn ten insults from
    big = "/root/testdata/sf0.1"
    labels = C.table(spark, big, "labels").select("doc_id", "toxic")
    out = toxicity.op7_toxicity(spark, big).join(labels, "doc_id").where("held_out").collect()
    hit = [r["predicted"] for r in out if r["toxic"] == 1]
    clean = [r["predicted"] for r in out if r["toxic"] == 0]
    assert sum(hit) >= 0.6 * len(hit) and sum(clean) <= 0.1 * len(clean)
    one = toxicity.train(spark.createDataFrame([(1, "x", 0)], "doc_id long, text string, y int"))
    assert all(r["toxicity"] < 0.01 for r in toxicity.score(odd(spark), one).collect())


def test_neighbours_and_recall(spark):
    df = C.table(spark, SF, "embeddings")
    rows = df.select("vec_id", "embedding").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    hit = total = 0
    got = {}
    for r in ann.op1_cross_polytope(spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == set(ids[ids % 20 == 0].tolist())
    for q, near in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        best = set(ids[np.lexsort((ids, -s))][:20].tolist())
        hit, total = hit + len(best & {v for v, _ in near.values()}), total + 20
        assert sorted(near) == list(range(1, len(near) + 1))
        assert all(abs(sc - s[ids == v][0]) < 1e-12 for v, sc in near.values())
    assert hit >= 0.9 * total


def test_neighbours_odd_rows(spark):
    from pyspark.sql import functions as F
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [1.0, None]), (1, [2.0, 0.0]), (3, [2.0, 0.0]),
            (2, [2.0, 0.0]), (5, [2.0, 0.0]), (100, [1e-3, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS q", "3 AS vec")
    out = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, k=3, cell=2).collect()))
    assert [r[:3] for r in out] == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (100, 1, 1), (100, 2, 2), (100, 3, 3)]
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_language_of_large_scripts(monkeypatch):
    rng = np.random.default_rng(2)
    chinese, korean = (["".join(map(chr, rng.integers(lo, lo + 3000, 60))) for _ in range(40)] for lo in (0x4E00, 0xAC00))
    more = ["".join(map(chr, rng.permutation(np.arange(0x4E00, 0x4E00 + 3000))[:60])) for _ in range(40)]
    texts = {"en": "some words of a sample, and more of them " * 100, "ko": "\n".join(korean), "zh": "\n".join(chinese), "zz": "\n".join(more)}
    p = language_id.Parser(texts)
    assert p.n_codes > language_id.DENSE_CODES + 1
    count, _ = p.phrases([chinese[7], korean[3], more[5]])
    assert count[[2, 1, 3], [0, 1, 2]].tolist() == [1, 1, 1]  # a part of the sample is one phrase
    assert p.predict([chinese[7], korean[3], more[5], "and more words"])[0] == ["zh", "ko", "zz", "en"]
    monkeypatch.setattr(language_id, "DENSE_CODES", 10_000)
    monkeypatch.setattr(language_id, "DENSE_CELLS", 1 << 40)
    mixed = [chinese[7][:20] + korean[3] + "more" + more[2][9:]]
    assert language_id.Parser(texts).phrases(mixed)[0].tolist() == p.phrases(mixed)[0].tolist()


def recall(spark, x, queries, ids=None):
    from pyspark.sql import functions as F
    ids = np.arange(len(x)) if ids is None else ids
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("vec_id").isin([int(ids[q]) for q in queries])).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for own in {ids[q] for q in queries}:
        best = {}
        for q in queries:
            if ids[q] == own:
                for i, s in zip(ids, x @ x[q]):
                    best[i] = max(s, best.get(i, -np.inf))
        del best[own]
        want = set(sorted(best, key=lambda i: (-best[i], i))[:20])
        hit, total = hit + len(want & got.get(own, set())), total + len(want)
    return hit / total


def test_recall_of_unlike_norms_small_tables_and_outliers(spark):
    rng = np.random.default_rng(4)
    unit = lambda n: (lambda v: v / np.linalg.norm(v, axis=1, keepdims=True))(rng.standard_normal((n, 64)))
    assert recall(spark, unit(15), range(15)) == 1
    assert recall(spark, unit(41), range(41)) >= 0.95
    assert recall(spark, unit(4000) * rng.lognormal(0, 1, (4000, 1)), range(0, 4000, 100)) >= 0.95
    hot = np.repeat(unit(1), 3000, 0) + 0.01 * unit(3000)
    assert recall(spark, np.concatenate([unit(10), hot]), range(10)) >= 0.95


def test_repeated_rows_leave_neighbours_their_place(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((60, 64))
    copies = np.repeat(x[:1] * 1.5, 100, 0)
    unlike = x[:1] * 1.4 + 1e-3 * rng.standard_normal((100, 64))
    ids = np.concatenate([np.arange(60), np.full(100, 100), np.full(100, 101)])
    assert recall(spark, np.concatenate([x, copies, unlike]), [0, 1], ids) == 1


def test_archives(spark, tmp_path):
    rows = [(3, "u3", "x" * 100), (1, "u1", "x" * 100), (2, "u\r\n2", "x" * 99), (4, None, "x" * 99), (5, "u5", None), (6, "u6", "é" * 5000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest", "3 AS g")
    warc.write(df, f"file://{tmp_path}", archive_bytes=5000)
    got = {r["page_id"]: r for r in warc.read(spark, f"file://{tmp_path}").collect()}
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {
        1: ("response", None), 2: ("response", None), 3: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert bytes(got[6]["payload"]).decode() == "é" * 5000 and got[3]["payload"] is None and got[3]["payload_bytes"] == 100
    assert got[3]["payload_digest"] == got[1]["payload_digest"]


def test_odd_rows(spark):
    df, none = odd(spark), odd(spark).limit(0)
    copies = exact_dedup.find_copies(df).collect()
    assert len(copies) == len(ODD) and sum(r["kept"] for r in copies) == 4
    assert exact_dedup.drop_copies(df).columns == df.columns and exact_dedup.drop_copies(df).count() == 4
    assert exact_dedup.find_copies(none).collect() == []
    assert sorted(r["n_words"] for r in lm_score.score(df).collect()) == [0, 0, 0, 1, 3, 3, 3, 6000, 6000]
    assert lm_score.score(none).collect() == []
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixing.mix(none).collect() == []


def test_language_fetches_a_bounded_sample_of_a_repeated_id(spark):
    rows = [(7, f"some words of text number {i} " * 10, "en") for i in range(500)] + [(8, "mots du texte " * 20, "fr")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.samples(df, docs_per_language=5)
    assert got["en"].count("\n") == 4 and got["fr"].count("\n") == 2


@pytest.mark.parametrize("seed", range(5))
def test_language_phrases_by_definition(seed):
    rng = np.random.default_rng(seed)
    word = lambda n, of: "".join(rng.choice(list(of), n))
    samples = {"a": word(60, "abc"), "b": word(80, "bcd"), "c": "e"}
    texts = [word(int(rng.integers(0, 50)), "abcdef") for _ in range(30)]
    count, lens = language_id.Parser(samples).phrases(texts)
    for n, sample in enumerate(samples.values()):
        for k, text in enumerate(texts):
            phrases, phrase = 1, ""
            for c in text:
                if phrase + c in sample:
                    phrase += c
                else:
                    phrases, phrase = phrases + 1, c if c in sample else ""
            assert count[n, k] == phrases and lens[k] == len(text)


def test_scores_under_another_corpus(spark):
    from collections import Counter
    model = ["a b c a b d", "b c a", None, "c"]
    texts = ["a b c", "a b x", "b d a", "x y", "", None, "d"]
    n = [Counter(tuple(w[i:i + k]) for w in ((t or "").split() for t in model) for i in range(len(w) - k + 1)) for k in (1, 2, 3)]

    def log_score(text):
        w, out = text.split(), []
        for i, x in enumerate(w):
            two, three = tuple(w[max(0, i - 1):i + 1]), tuple(w[max(0, i - 2):i + 1])
            if i >= 2 and n[2][three]:
                out.append(np.log(n[2][three] / n[1][three[:2]]))
            elif i >= 1 and n[1][two]:
                out.append(np.log(n[1][two] / n[0][two[:1]]) + (i >= 2) * np.log(0.4))
            else:
                out.append(np.log(max(1, n[0][(x,)]) / sum(n[0].values())) + min(i, 2) * np.log(0.4))
        return round(float(np.mean(out)), 6) if out else None

    table = lambda t: spark.createDataFrame(list(enumerate(t)), DDL)
    for bounds in ({}, {"group_bytes": 8, "range_keys": 3}):
        got = {r["doc_id"]: r["log_score"] for r in lm_score.score(table(texts), table(model), **bounds).collect()}
        assert got == pytest.approx({i: log_score(t or "") for i, t in enumerate(texts)})


def test_mix_takes_equal_rows_one_by_one(spark):
    df = spark.createDataFrame([(1, "x y z")] * 4, DDL).selectExpr("*", "'en' AS lang", "'src1' AS source", "3L AS n_chars")
    for share, want in ((0.25, 1), (0.5, 2), (0.8, 3), (1.0, 4)):
        out = mixing.select(df, mixing.tree(), {}, share, 1, 17).collect()
        assert len(out) == 4 and sum(r["copies"] for r in out) == want
    out = mixing.select(df, mixing.tree(), {}, 0.25, 1, 17, carry=True)
    assert sorted(r["copies"] for r in out.collect()) == [0, 0, 0, 1] and out.select("row.*").columns == df.columns


def test_mix_leaves_out_weight_zero(spark):
    rows = [(i, "a b c", lang, src, 5) for i, (lang, src) in enumerate([("en", "src1"), ("en", "src2"), ("de", "src1"), ("fr", "src3")] * 5)] + [
        (50, "", "en", "src1", 0), (51, "", "fr", "src3", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = {"language": {"fr": 0}, "source": {"src2": 0}}
    out = {r["doc_id"]: r for r in mixing.select(df, mixing.tree(), weights, 0.5, 3, 17).collect()}
    taken = {i for i, r in out.items() if r["copies"]}
    assert len(out) == len(rows) and all(rows[i][2] != "fr" and rows[i][3] != "src2" for i in taken if i < 50) and 51 not in taken
    # 60 tokens, half of them wanted; the four left-out groups give none, so the others give 30
    assert sum(r["copies"] * r["tokens"] for r in out.values()) == 30


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    assert bpe.round_trip(none).collect() == [] and language_id.identify(none, {"en": "words"}).collect() == []
    assert toxicity.score(none, toxicity.train(spark.createDataFrame([(1, "x", 0)], "doc_id long, text string, y int"))).collect() == []
    import corpus_pipeline as P
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        docs = C.keep(stage(spark, docs, SF))
        assert docs.count() == 0


def test_budgets_make_up_shortage_among_siblings(spark):
    leaves = spark.createDataFrame([("=a", "=x", 10), ("=a", "=y", 1000), ("=b", "=z", 1000)], "p0 string, p1 string, tokens long")
    got = {r["p1"]: r["budget"] for r in mixing.budgets(leaves, {"l0": {"a": 3}}, 400, 1, ("l0", "l1"), ["p0", "p1"]).collect()}
    assert got == {"=x": 10, "=y": 290, "=z": 100}


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    docs = C.table(spark, SF, "documents")
    sizes = []
    for name, stage in P.STAGES[:4]:
        out = C.keep(stage(spark, docs, SF))
        assert out.columns == docs.columns
        sizes.append((docs, out))
        docs = out
    texts = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}
    all_texts, known, exact, near = texts(sizes[0][0]), texts(sizes[0][1]), texts(sizes[1][1]), texts(sizes[2][1])
    assert set(known) == {k for k, t in all_texts.items() if t and any(c.isalpha() for c in t)}
    assert set(exact) == {max(k for k, t in known.items() if t == u) for u in set(known.values())}
    assert set(near) <= set(exact) and len(near) > 0.5 * len(exact)
    last = P.STAGES[4][1](spark, docs, SF)
    assert last.count() == docs.count() and "ids" in last.columns


def test_kept_tables_go_when_the_program_ends(tmp_path):
    import os
    import subprocess
    import sys
    code = ("import sys; sys.path.insert(0, sys.argv[2])\n"
            "from loupe.session import get_session\nfrom loupe.llm import common as C\nimport os\n"
            "spark = get_session('local[1]', 1)\nspark.sparkContext.setCheckpointDir(sys.argv[1])\n"
            "assert C.keep(C.keep(spark.range(3))).count() == 3\n"
            "print('during', sum(f.startswith('kept-') for _, d, _ in os.walk(sys.argv[1]) for f in d))\n")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path), root], capture_output=True, text=True, timeout=200)
    assert "during 1" in out.stdout
    assert not [d for _, ds, _ in os.walk(tmp_path) for d in ds if d.startswith("kept-")]
