import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomtime.llm import percentiles

PROBS = (0.0, 0.01, 0.25, 0.5, 0.9, 1.0)
NAMES = ("a", "b", "c", "d", "e", "f")


def check(spark, pdf, parts):
    runs = percentiles.value_runs(spark.createDataFrame(pdf, "id string, value double"), "id", "value")
    out = percentiles.percentiles_of_runs(runs, PROBS, NAMES, parts).toPandas()
    clean = pdf.dropna(subset=["value"])
    assert len(out) == clean.id.nunique(dropna=False)
    for _, r in out.iterrows():
        v = clean[clean.id.isna() if r["by"] is None or r["by"] != r["by"] else clean.id == r["by"]].value
        assert r["n"] == len(v)
        np.testing.assert_allclose([r[n] for n in NAMES], np.quantile(v, PROBS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_hot_group_over_many_partitions(spark, parts):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.where(rng.random(6000) < 0.4, "hot", rng.integers(0, 40, 6000).astype(str)), "value": rng.normal(size=6000).round(2)})
    pdf.loc[rng.integers(0, 6000, 300), "value"] = np.nan
    pdf.loc[rng.integers(0, 6000, 500), "value"] = 7.0
    pdf.loc[rng.integers(0, 6000, 50), "id"] = None
    check(spark, pdf, parts)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["x", "y", None]), st.one_of(st.none(), st.floats(-1e6, 1e6))), min_size=1, max_size=40), st.integers(1, 9))
def test_any_rows(spark, rows, parts):
    check(spark, pd.DataFrame(rows, columns=["id", "value"]).astype({"value": float}).assign(id=lambda d: d.id.astype(object).where(d.id.notna(), None)), parts)


def test_parts_put_together(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"id": rng.choice(["p", "q"], 500), "value": rng.integers(0, 30, 500).astype(float)})
    df = spark.createDataFrame(pdf)
    pieces = [percentiles.value_runs(df.where(f"value % 3 = {k}"), "id", "value") for k in range(3)]
    merged = percentiles.percentiles_of_runs(percentiles.merge_runs(*pieces), PROBS, NAMES).orderBy("by").toPandas()
    whole = percentiles.percentiles(df, "id", "value", PROBS, NAMES).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(merged.rename(columns={"by": "id"}), whole)


def test_edges(spark):
    empty = spark.createDataFrame([], "id string, value double, n int, by string, lo0 double")
    assert percentiles.percentiles(empty, "id", "value", [0.5]).count() == 0
    odd = spark.createDataFrame([("a", float("inf"), 1), ("a", 1.0, 1), ("b", float("nan"), 1), ("c", None, 1), ("d", -0.0, 1), ("d", 0.0, 1)], "id string, value double, n int")
    out = {r["id"]: r for r in percentiles.percentiles(odd, "id", "value", [0.0, 1.0], ["lo", "hi"]).collect()}
    assert set(out) == {"a", "d"} and out["a"]["hi"] == float("inf") and out["a"]["lo"] == 1.0 and out["d"]["n"] == 2
    with pytest.raises(ValueError):
        percentiles.percentiles(odd, "id", "value", [1.5])
