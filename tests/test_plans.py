"""Plan properties the design relies on, checked on the physical plans."""

import pytest

import __spark_entry__ as ent
from loupe.plans import text_queries, vector_queries

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(text_queries.QUERIES) | set(vector_queries.QUERIES)))
def test_no_cartesian_products(spark, name):
    plan = _plan(ent.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["top_ngrams_by_label", "sample_reviews", "central_indices",
                                  "label_crosstab_topk"])
def test_topk_is_partial_before_the_shuffle(spark, name):
    df = ent.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_label_filter_reaches_the_scan(spark):
    plan = _plan(text_queries.top_ngrams_one_label(spark, SF))
    assert "EqualTo(quality,1)" in plan


def test_scans_read_only_needed_columns(spark):
    plan = _plan(text_queries.top_ngrams_by_label(spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "n_chars" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_text_is_corrected_above_the_label_join(spark):
    plan = text_queries.top_ngrams_by_label(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan[plan.index("Join Inner"):]


def test_em_selection_fits_all_covariance_types(spark, monkeypatch):
    from types import SimpleNamespace

    from loupe.plans import model_queries
    fitted = SimpleNamespace(bic=lambda: 1.0)
    monkeypatch.setattr(model_queries.selection.mixture, "gaussian_mixture", lambda *a, **k: (fitted, None))
    rows = model_queries.em_selection(spark, "/root/testdata/sf0.001").collect()
    assert {(r["cov_type"], r["k"]) for r in rows} == {(c, k) for c in ("spherical", "tied", "diag", "full") for k in (8, 10)}
