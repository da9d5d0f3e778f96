"""Python-worker steps and language flags."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from loupe.functions.porter import stem as porter_stem
from loupe.operators import align, embed, language, stem, terms
from loupe.operators.stem import stem_vocabulary, with_stems

# Examples from the published Porter paper and its standard vocabulary.
PORTER = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "caress": "caress", "cats": "cat",
    "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop",
    "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail",
    "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "rational": "ration", "valenci": "valenc", "hesitanci": "hesit", "digitizer": "digit",
    "conformabli": "conform", "radicalli": "radic", "differentli": "differ", "vileli": "vile",
    "analogousli": "analog", "vietnamization": "vietnam", "predication": "predic", "operator": "oper",
    "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "callousness": "callous",
    "formaliti": "formal", "sensitiviti": "sensit", "sensibiliti": "sensibl", "triplicate": "triplic",
    "formative": "form", "formalize": "formal", "electriciti": "electr", "electrical": "electr",
    "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow",
    "inference": "infer", "airliner": "airlin", "gyroscopic": "gyroscop", "adjustable": "adjust",
    "defensible": "defens", "irritant": "irrit", "replacement": "replac", "adjustment": "adjust",
    "dependent": "depend", "adoption": "adopt", "homologou": "homolog", "communism": "commun",
    "activate": "activ", "angulariti": "angular", "homologous": "homolog", "effective": "effect",
    "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "machine": "machin", "washing": "wash", "great": "great",
}


def test_porter_examples():
    bad = {w: (porter_stem(w), s) for w, s in PORTER.items() if porter_stem(w) != s}
    assert bad == {}


def test_stem_vocabulary_and_ngrams(spark):
    df = spark.createDataFrame([(0, "great washing machine")], "review_id bigint, text string")
    vocab = {r.term: r.stem for r in stem_vocabulary(terms.review_tokens(df)).collect()}
    assert vocab == {"great": "great", "washing": "wash", "machine": "machin"}
    bi = {r.term: r.stem for r in with_stems(terms.review_ngrams(df, 2)).collect()}
    assert bi == {"great washing": "great wash", "washing machine": "wash machin"}


def test_ngram_stems_in_the_row(spark):
    df = spark.createDataFrame([(0, "great washing machine washing", 1), (1, "", 2), (2, None, 3), (3, "machines", 4)], "review_id bigint, text string, label int")
    got = sorted((r.review_id, r.idx, r.term, r.label, r.stem) for r in stem.review_ngram_stems(df, 2, carry=("label",)).collect())
    assert got == [(0, 0, "great washing", 1, "great wash"), (0, 1, "washing machine", 1, "wash machin"), (0, 2, "machine washing", 1, "machin wash")]
    one = stem.review_ngram_stems(df, 1).collect()
    assert sorted((r.term, r.stem) for r in one) == [("great", "great"), ("machine", "machin"), ("machines", "machin"), ("washing", "wash"), ("washing", "wash")]


def test_close_matches_fixture():
    assert align._matches_for_review(["great"], ["super", "great", "nice"], 3, 0.6) == [[1]]
    assert align._matches_for_review(["great"], ["great", "great", "great"], 3, 0.6) == [[2, 1, 0]]


def test_fast_matches_equal_definition():
    rng = np.random.default_rng(0)
    alphabet = list("abcdeéz")
    for _ in range(30):
        words = ["".join(rng.choice(alphabet, rng.integers(1, 7))) for _ in range(rng.integers(0, 25))]
        toks = ["[CLS]"] + ["".join(rng.choice(alphabet, rng.integers(1, 6))) for _ in range(8)] + ["[SEP]"]
        slow = []
        for t in toks:
            best = sorted(((SequenceMatcher(None, w, t).ratio(), i) for i, w in enumerate(words)), reverse=True)
            slow.append([] if t in ("[CLS]", "[SEP]") else [i for r, i in best if r >= 0.6][:3])
        assert align._matches_for_review(toks, words, 3, 0.6) == slow


def test_adjusted_argmin_fixture(spark):
    df = spark.createDataFrame([(5, [2, 5], 20, 10), (13, [10, 14], 100, 80), (13, [2, 5], 100, 80)],
                               "i int, m array<int>, nb int, ns int")
    got = [r[0] for r in df.select(align.adjusted_argmin(F.col("i"), F.col("m"), F.col("nb"), F.col("ns"))).collect()]
    assert got == [0, 0, 1]


def test_token_pos_table_fixture(spark):
    reviews = spark.createDataFrame([(0, "great machine"), (1, "love it")], "review_id bigint, text string")
    tagged = spark.createDataFrame(
        [(0, 0, "great", "ADJ"), (0, 1, "machine", "NOUN"), (1, 0, "love", "VERB"), (1, 1, "it", "PRON")],
        "review_id bigint, idx int, term string, pos string")
    out = align.token_pos_table(reviews, tagged).orderBy("review_id", "idx").collect()
    assert [(r.review_id, r.token, r.pos) for r in out] == [
        (0, "[CLS]", None), (0, "great", "ADJ"), (0, "machine", "NOUN"), (0, "[SEP]", None),
        (1, "[CLS]", None), (1, "love", "VERB"), (1, "it", "PRON"), (1, "[SEP]", None)]
    trunc = align.token_pos_table(reviews, tagged, max_length=3).where("review_id = 0").collect()
    assert [r.token for r in trunc] == ["[CLS]", "great", "[SEP]"]


def test_token_pos_table_long_review(spark):
    text = " ".join(f"w{i % 50} great" for i in range(3000))
    df = spark.createDataFrame([(0, text)], "review_id bigint, text string")
    out = align.token_pos_table(df)
    assert out.count() == 6002 and out.where("pos is null").count() >= 2


def test_pooling(spark):
    rows = [(0, 0, [1.0, 2.0]), (0, 1, [3.0, 0.0]), (1, 0, [5.0, 5.0])]
    v = spark.createDataFrame(rows, "review_id bigint, idx int, embedding array<double>")
    get = lambda mode: {r.review_id: list(r.embedding) for r in embed.pool(v, mode).collect()}
    assert get("mean") == {0: [2.0, 1.0], 1: [5.0, 5.0]}
    assert get("cls") == {0: [1.0, 2.0], 1: [5.0, 5.0]}
    assert get("max") == {0: [3.0, 2.0], 1: [5.0, 5.0]}
    m = get("mean_sqrt_len")
    assert np.allclose(m[0], [4 / np.sqrt(2), 2 / np.sqrt(2)])
    with pytest.raises(ValueError):
        embed.check_token_output("max")


def test_sentence_encoder_batches(spark):
    """E1 with a caller's sentence encoder: texts in, vectors out, loaded once for each worker."""
    def make():
        return lambda texts: np.array([[len(str(t)), str(t).count("a")] for t in texts], dtype=np.float32)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "a b", "c", ""])], "review_id bigint, text string")
    out = {r.review_id: list(r.embedding) for r in embed.embed_reviews(df, make, 2, 2).collect()}
    assert out == {0: [3, 1], 1: [3, 1], 2: [1, 0], 3: [0, 0]}


ODD_REVIEWS = [(0, "great machine"), (1, "love it, really"), (2, ""), (3, None), (4, "w " * 300 + "end"), (4, "again"), (None, "no key")]


def _by_definition(text, dim, max_length=None):
    """Tokens and their vectors, one by one."""
    import hashlib
    import re
    toks = re.findall(r"[^\W_]+|[^\w\s]|_", (text or "").lower())
    toks = ["[CLS]", *(toks if max_length is None else toks[:max_length - 2]), "[SEP]"]
    word = lambda t: np.array([b for k in range(-(-dim // 16)) for b in hashlib.md5(f"{t}#{k}".encode()).digest()][:dim], float) / embed.hashed_scale(dim) - 127.5 / embed.hashed_scale(dim)
    vec = [(word(t) + (word(toks[i + 1]) if i + 1 < len(toks) else 0)) / 2 for i, t in enumerate(toks)]
    return toks, np.array(vec)


@pytest.mark.parametrize("batch_size,cells", [(1, 1 << 16), (3, 1 << 16), (16, 100)])
def test_token_embeddings_whatever_the_batches(spark, monkeypatch, batch_size, cells):
    monkeypatch.setattr(embed, "BATCH_CELLS", cells)
    df = spark.createDataFrame(ODD_REVIEWS, "review_id bigint, text string").selectExpr("*", "1 AS idx", "2 AS tokens", "3 AS embedding")
    got = embed.token_embeddings(df, embed.hashed_token_encoder(20), batch_size)
    assert got.columns == ["review_id", "idx", "token", "embedding"]
    rows = {}
    for r in got.collect():
        rows.setdefault((r.review_id, r.idx, r.token), []).append(list(r.embedding))
    want = {}
    for key, text in ODD_REVIEWS:
        for i, (t, v) in enumerate(zip(*_by_definition(text, 20))):
            want.setdefault((key, i, t), []).append(v.tolist())
    assert rows.keys() == want.keys()
    assert all(np.allclose(sorted(rows[k]), sorted(want[k]), atol=1e-12) for k in want)
    assert embed.token_embeddings(df.limit(0), embed.hashed_token_encoder(20)).collect() == []


def test_tokens_of_embeddings_and_tags_are_the_same(spark):
    df = spark.createDataFrame(ODD_REVIEWS[:3] + ODD_REVIEWS[4:5], "review_id bigint, text string")
    vec = embed.token_embeddings(df, embed.hashed_token_encoder(8), max_length=6)
    tags = align.token_pos_table(df, max_length=6)
    both = vec.join(tags, ["review_id", "idx", "token"])
    assert both.count() == vec.count() == tags.count() == 4 + 6 + 2 + 6


@pytest.mark.parametrize("mode", embed.POOLING_MODES)
def test_pooling_in_the_worker_equals_pooling_the_token_table(spark, mode):
    df = spark.createDataFrame(ODD_REVIEWS[:5], "review_id bigint, text string")
    enc = embed.hashed_token_encoder(8)
    whole = {r.review_id: np.array(r.embedding) for r in embed.sentence_embeddings(df, enc, mode, batch_size=2).collect()}
    parts = {r.review_id: np.array(r.embedding) for r in embed.pool(embed.token_embeddings(df, enc), mode).collect()}
    assert set(whole) == set(parts) == {0, 1, 2, 3, 4}
    for key, text in ODD_REVIEWS[:5]:
        v = _by_definition(text, 8)[1]
        want = {"cls": v[0], "mean": v.mean(0), "max": v.max(0), "mean_sqrt_len": v.sum(0) / np.sqrt(len(v))}[mode]
        assert np.allclose(whole[key], want, atol=1e-6) and np.allclose(parts[key], want, atol=1e-6)


def test_exact_positions(spark):
    df = spark.createDataFrame([(0, "A b, a b a a"), (1, None)], "review_id bigint, text string")
    got = {(r.idx, r.token): r.word_idx for r in align.exact_positions(df).collect()}
    # the three latest words "a" stand at 2, 4 and 5; tokens count the comma
    assert got == {(0, "a"): 2, (1, "b"): 1, (2, ","): None, (3, "a"): 2, (4, "b"): 3, (5, "a"): 4, (6, "a"): 5}


def test_language_flags(spark):
    docs = spark.createDataFrame(
        [(0, "how are you today my friend", "en"), (1, "you are very kind", "en"),
         (2, "wie geht es dir heute", "de"), (3, "die deutsche sprache ist schön", "de"),
         (4, "how is the deutsche sprache", "en")],
        "review_id bigint, text string, lang string")
    tok = terms.review_tokens(docs, carry=("lang",))
    model, stats = language.train(tok, docs.select("review_id", "lang"))
    probe = spark.createDataFrame([(10, "how are you"), (11, "deutsche sprache ist"), (12, "zzz"), (13, "")],
                                  "review_id bigint, text string")
    out = {r.review_id: r.is_english for r in
           language.score(terms.review_tokens(probe).select("review_id", "term"), probe, model, stats).collect()}
    assert out == {10: 1, 11: 0, 12: 2, 13: 2}


def test_close_matches_are_difflibs_for_odd_and_long_strings():
    rng = random.Random(3)
    for letters, longest in (("ab", 9), ("abcdefgh", 12), ("aàé漢𝄞b", 5), ("abcdefghijklmnopqrstuvwxyz", 6), ("abc", 80), ("ab", 230)):
        for _ in range(6):
            words = ["".join(rng.choices(letters, k=rng.randint(1, longest))) for _ in range(rng.randint(0, 25))]
            tokens = ["[CLS]"] + [rng.choice(words) if words and rng.random() < 0.4 else "".join(rng.choices(letters, k=rng.randint(1, longest)))
                                  for _ in range(15)] + ["[SEP]"]
            want = []
            for t in tokens:
                scores = [(SequenceMatcher(None, w, t).ratio(), i) for i, w in enumerate(words)] if t not in ("[CLS]", "[SEP]") else []
                want.append([i for _, i in sorted((x for x in scores if x[0] >= 0.5), reverse=True)[:3]])
            assert align._matches_for_review(tokens, words, 3, 0.5) == want


def test_close_matches_of_a_long_review_compare_few_pairs_one_by_one(monkeypatch):
    """2,000 different words: the pairs are bounded and matched in arrays, none alone in difflib."""
    rng = random.Random(4)
    words = list({"".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(2000)})
    monkeypatch.setattr(align, "SequenceMatcher", None)
    found = align._matches_for_review(words, words, 3, 0.6)
    assert all(m[0] == i for i, m in enumerate(found))


def test_close_matches_bound_pairs_before_difflibs_blocks(monkeypatch):
    """Most pairs with enough letters in common share too few in order: only a token's few best words are matched in blocks."""
    rng = random.Random(5)
    words = ["".join(rng.choices("aeinorst", k=rng.randint(4, 9))) for _ in range(500)]
    matched, seen = align._matched, []
    monkeypatch.setattr(align, "_matched", lambda M: seen.append(len(M)) or matched(M))
    found = align._matches_for_review(words, words, 3, 0.6)
    assert sum(seen) < 12 * len(set(words))
    for t, m in zip(words[:40], found):
        scores = sorted(((SequenceMatcher(None, w, t).ratio(), i) for i, w in enumerate(words)), reverse=True)
        assert m == [i for r, i in scores if r >= 0.6][:3]


@pytest.mark.parametrize("cells", [1, 200, 10**6])
def test_close_matches_of_reviews_taken_together(monkeypatch, cells):
    rng = random.Random(6)
    text = lambda letters, k: ["".join(rng.choices(letters, k=rng.randint(1, 8))) for _ in range(k)]
    reviews = [(["[CLS]", *text(letters, 9), *w[:3], "[SEP]"], w) for letters in ("abc", "漢字仮名交", "aé.") for k in (0, 1, 30) for w in [text(letters, k)]]
    reviews += [([], ["a"]), (["a" * 70, "ab"], ["a" * 69, "", "ab", "ab"])]
    monkeypatch.setattr(align, "CELLS", cells)
    want = [[[] if t in ("[CLS]", "[SEP]") else [i for r, i in sorted(((SequenceMatcher(None, w, t).ratio(), i) for i, w in enumerate(ws)), reverse=True) if r >= 0.6][:3]
             for t in ts] for ts, ws in reviews]
    assert list(align._matches(reviews, 3, 0.6)) == want


def test_pooling_is_hash_aggregation_and_refuses_other_lengths(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [3.0, -2.0]), (2, 0, None)], "review_id long, idx int, embedding array<double>")
    for mode, want in (("cls", [1.0, 2.0]), ("mean", [2.0, 0.0]), ("max", [3.0, 2.0]), ("mean_sqrt_len", [4.0 / 2 ** 0.5, 0.0])):
        out = embed.pool(v, mode)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
        assert {r.review_id: r.embedding for r in out.collect()} == {1: pytest.approx(want), 2: None}
    longer = v.union(spark.createDataFrame([(1, 2, [1.0, 2.0, 3.0])], v.schema))
    with pytest.raises(Exception, match="components"):
        embed.pool(longer, "mean", dim=2).collect()


def test_positions_within_a_row_and_of_shared_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["a", "b", "ç", ",", "d!", "ee"]) for _ in range(rng.randrange(60)))
    rows = [(i, text()) for i in range(40)] + [(None, text()), (None, "a a")]
    schema = "review_id bigint, text string"
    alone = spark.createDataFrame(rows, schema)
    out = align.exact_positions(alone)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, align._shared_positions(alone, 3, None).collect()))
    both = spark.createDataFrame(rows + rows[:5] + [(6, "a b a b")], schema)
    assert Counter(map(tuple, align.exact_positions(both).collect())) == Counter(map(tuple, align._shared_positions(both, 3, None).collect()))


def test_language_words_are_summed_where_they_are_read(spark):
    """Words are neither sorted nor shuffled one by one: the model is broadcast, sums are plain aggregates."""
    rows = [(i, w, lang) for i in range(30) for w, lang in (("how are you", "en"), ("wie geht es", "de"))]
    docs = spark.createDataFrame(rows, "review_id bigint, text string, lang string")
    tok = terms.review_tokens(docs, carry=("lang",))
    model, stats = language.train(tok, docs)
    out = language.score(tok.select("review_id", "term"), docs, model, stats)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "aggregate_metrics" not in plan and "SortAggregate" not in plan.split("Initial Plan")[0] and "BroadcastHashJoin" in plan
    # both languages' words meet under one id, so the doubled priors decide: the first of equal scores
    assert {r.lang_pred for r in out.collect()} == {"de"}
