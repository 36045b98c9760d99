"""Missing values, regular grids, implausible readings and trailing totals: brute force, held-out values and edge cases."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtime.operators import gridfill, missing, spikes, trailing
from loomtime.operators.ranges import running_total

T0 = pd.Timestamp("2023-01-01")


# ---- missing values


def daily_rows(rng, groups=12, n=150):
    rows = []
    for g in range(groups):
        base, kind = rng.uniform(50, 500), ["red", "green", "blue"][g % 3]
        x = base + base / 8 * np.sin(np.arange(n) / 9 + g) + rng.normal(0, base / 100, n)
        rows += [(g * n + i, f"g{g}", T0 + pd.Timedelta(days=i), float(x[i]), kind) for i in range(n)]
    return pd.DataFrame(rows, columns=["row_no", "id", "date", "value", "category"])


def test_fill_recovers_held_out(spark):
    rng = np.random.default_rng(0)
    truth = daily_rows(rng)
    given = truth.copy()
    lost_v, lost_c = rng.random(len(truth)) < 0.08, rng.random(len(truth)) < 0.08
    given.loc[lost_v, "value"] = rng.choice([np.nan, -999.0, 99999.0], lost_v.sum())
    given.loc[lost_c, "category"] = rng.choice(np.array([None, "", "  ", "n/a", "?", "UNKNOWN"], object), lost_c.sum())
    out = missing.fill_missing(spark.createDataFrame(given)).toPandas().sort_values("row_no").reset_index(drop=True)
    assert list(out.value_filled) == list(lost_v) and list(out.category_filled) == list(lost_c)
    assert out.value.notna().all() and out.category.notna().all()
    assert (out.category == truth.category).mean() > 0.995
    error = np.abs(out.value - truth.value)[lost_v] / truth.value[lost_v]
    assert np.median(error) < 0.03
    np.testing.assert_allclose(out.value[~lost_v], truth.value[~lost_v])


def test_fill_edges(spark):
    schema = "row_no bigint, id string, date timestamp, value double, category string, mean double, v string, row int"
    rows = [(1, None, None, None, None, 1.0, "x", 1), (2, "a", dt.datetime(2023, 1, 1), 5.0, "k", 1.0, "x", 1), (2, "a", dt.datetime(2023, 1, 1), 5.0, "k", 1.0, "x", 1),
            (3, "a", None, float("nan"), "-", 1.0, "x", 1), (4, "b", dt.datetime(2023, 1, 2), None, "None", 1.0, "x", 1)]
    out = missing.fill_missing(spark.createDataFrame(rows, schema)).toPandas()
    assert len(out) == 5 and out.value.notna().all() and set(out.category) == {"k"}
    assert out.value_filled.sum() == 3 and out.category_filled.sum() == 3
    nothing = missing.fill_missing(spark.createDataFrame([(1, "a", dt.datetime(2023, 1, 1), None, None)], "row_no bigint, id string, date timestamp, value double, category string")).first()
    assert nothing["value"] is None and nothing["category"] is None and nothing["value_filled"] and nothing["category_filled"]
    assert missing.fill_missing(spark.createDataFrame([], schema)).count() == 0


def test_marker_inside_the_range_is_a_number(spark):
    rows = [(i, "a", dt.datetime(2023, 1, 1 + i), float(v), "k") for i, v in enumerate([-3, -1, 2, -999, 5])]
    out = missing.fill_missing(spark.createDataFrame(rows, "row_no bigint, id string, date timestamp, value double, category string")).orderBy("row_no").toPandas()
    assert list(out.value_filled) == [False, False, False, True, False] and out.value[1] == -1


def test_mixture_statistics_add_up():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4))
    x[rng.random(x.shape) < 0.2] = np.nan
    around, own = rng.integers(0, 3, 200), rng.integers(-1, 3, 200)
    m = missing.Mixture(4)
    whole = m.statistics(x, around, own)
    np.testing.assert_allclose(whole, m.statistics(x[:70], around[:70], own[:70]) + m.statistics(x[70:], around[70:], own[70:]), rtol=1e-9, atol=1e-9)
    assert whole[2:6].sum() == pytest.approx(200) and whole[-36:].sum() == pytest.approx(200)
    likelihood = [m.improve(m.statistics(x, around, own)) for _ in range(6)]
    assert likelihood[-1] > likelihood[0]


def test_any_number_of_categories(spark):
    rows = [(g * 20 + d, f"g{g:03d}", dt.datetime(2023, 1, 1 + d), float(g + d), None if d == 7 else f"kind {g:03d}" if d < 10 else f"other {g:03d}") for g in range(300) for d in range(20)]
    out = missing.fill_missing(spark.createDataFrame(rows, "row_no bigint, id string, date timestamp, value double, category string")).where("category_filled").toPandas()
    assert len(out) == 300 and (out.category == "kind " + out.id.str[1:]).all()


# ---- regular grids


def test_grid_against_pandas(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in ("a", "b", "c"):
        t = T0 + pd.to_timedelta(np.sort(rng.integers(0, 900 * 3600, 700)), "s")
        rows += [(s, x, float(v)) for x, v in zip(t, 10 + np.sin(np.arange(700) / 4))]
    pdf = pd.DataFrame(rows + rows[:40], columns=["id", "date", "value"])
    out = gridfill.regularize(spark.createDataFrame(pdf)).toPandas()
    distinct = pdf.drop_duplicates()
    hours = distinct.assign(h=distinct.date.dt.floor("h")).groupby(["id", "h"]).value.agg(["mean", "count"])
    seen = out[out.status == "observed"].set_index(["id", "hour_start"]).sort_index()
    np.testing.assert_allclose(seen.value, hours["mean"].sort_index(), rtol=1e-9)
    assert list(seen.n_readings) == list(hours["count"].sort_index())
    for s, g in out.groupby("id"):
        h = g.hour_start.sort_values()
        assert (h.diff().dropna() == pd.Timedelta(hours=1)).all() and h.iloc[0] == distinct[distinct.id == s].date.min().floor("h")
    assert (out[out.status == "filled"].n_readings == 0).all()


def test_grid_fill_beats_lines():
    rng = np.random.default_rng(3)
    t = np.arange(gridfill.BUCKET)
    truth = np.stack([20 + 5 * np.sin(2 * np.pi * (t + k) / 24) + rng.normal(0, 0.2, len(t)) for k in range(6)])
    known = np.ones(truth.shape, bool)
    for k in range(6):
        a = 100 + 7 * k
        known[k, a : a + 9] = False
    size = np.full(6, gridfill.BUCKET)
    got = gridfill.impute(np.where(known, truth, 0), known, size)
    lines = gridfill._interpolate(np.where(known, truth, 0), known, size)
    assert np.abs(got - truth)[~known].mean() < 0.5 and np.abs(got - truth)[~known].mean() < 0.4 * np.abs(lines - truth)[~known].mean()
    np.testing.assert_array_equal(got[known], truth[known])


def test_grid_fill_settles():
    rng = np.random.default_rng(13)
    width, lag = gridfill.BUCKET, gridfill.LAG
    t = np.arange(width)
    x = np.stack([20 + (3 + t / 100) * np.sin(2 * np.pi * (t + 3 * k) / 24) + rng.normal(0, 0.5, width) for k in range(6)])
    known = np.ones(x.shape, bool)
    for k in range(6):
        known[k, 90 : 130 + 5 * k] = False
    got, lost = gridfill.fill(np.where(known, x, 0), known, np.full(6, width))
    assert not lost.any()
    for y, k in zip(got, known):  # one more round, by a full decomposition, leaves the gaps where they are
        z = (y - y[k].mean()) / y[k].std()
        u, d, v = np.linalg.svd(np.lib.stride_tricks.sliding_window_view(z, lag), full_matrices=False)
        low = (u[:, : gridfill.RANK] * d[: gridfill.RANK]) @ v[: gridfill.RANK]
        smooth = np.array([np.diag(low[:, ::-1], lag - 1 - i).mean() for i in range(width)])
        assert np.abs(smooth - z)[~k].max() < 2 * gridfill.SETTLED


def test_grid_marks_what_does_not_settle(monkeypatch):
    rng = np.random.default_rng(14)
    x = 20 + 5 * np.sin(2 * np.pi * np.arange(gridfill.BUCKET) / 24) + rng.normal(0, 0.5, gridfill.BUCKET)
    known = np.ones((1, gridfill.BUCKET), bool)
    known[0, 100:140] = False
    monkeypatch.setattr(gridfill, "SAFETY", 1)
    got, lost = gridfill.fill(np.where(known, x, 0), known, np.array([gridfill.BUCKET]))
    assert lost.all()
    np.testing.assert_array_equal(got[~known], gridfill._first_guess(np.where(known, x, 0), known, np.array([gridfill.BUCKET]))[~known])


def test_grid_edges(spark):
    schema = "id string, date timestamp, value double, hour string, n int, status string"
    rows = [("a", dt.datetime(2023, 1, 1, 5, 30), 1.0, "", 1, ""), ("a", dt.datetime(2023, 1, 1, 9), 3.0, "", 1, ""), ("a", dt.datetime(2023, 1, 1, 11), float("nan"), "", 1, ""),
            ("a", dt.datetime(2023, 1, 1, 7), None, "", 1, ""), (None, dt.datetime(2023, 1, 1), 1.0, "", 1, ""), ("b", None, 1.0, "", 1, ""), ("c", dt.datetime(1969, 12, 31, 23, 59), 2.0, "", 1, "")]
    out = gridfill.regularize(spark.createDataFrame(rows, schema)).orderBy("id", "hour_start").collect()
    assert [(r["id"], r["hour_start"].hour, r["status"]) for r in out] == [("a", 5, "observed"), ("a", 6, "filled"), ("a", 7, "filled"), ("a", 8, "filled"), ("a", 9, "observed"), ("c", 23, "observed")]
    assert [r["value"] for r in out[:5]] == [1.0, 1.5, 2.0, 2.5, 3.0]
    assert gridfill.regularize(spark.createDataFrame([], schema)).count() == 0
    far = gridfill.regularize(spark.createDataFrame([("a", dt.datetime(2023, 1, 1), 1.0), ("a", dt.datetime(2023, 6, 1), 2.0)], "id string, date timestamp, value double")).groupBy("status").count().toPandas().set_index("status")["count"]
    assert far["observed"] == 2 and far["missing"] > 0 and far.sum() == 151 * 24 + 1


def test_short_and_sparse_buckets_are_imputed_too():
    rng = np.random.default_rng(3)
    width = gridfill.BUCKET + 2 * gridfill.HALO
    t = np.arange(width)
    x = np.stack([10 + 3 * np.sin(2 * np.pi * t / p) + rng.normal(0, 0.01, width) for p in (8, 6, 24, 24, 5)])
    size = np.array([30, 12, width, width, 3])
    known = (rng.random(x.shape) > 0.15) & (t < size[:, None])
    known[3] = False
    known[3, [5, 100, 300]] = True  # few known hours in a long bucket
    known[4, :3] = [True, False, True]
    got, lost = gridfill.fill(np.where(known, x, 0), known, size)
    for i, n in enumerate(size):
        assert np.isfinite(got[i, :n]).all() and not lost[i]
    assert np.abs(got - x)[0, :30].max() < 1 and np.abs(got - x)[2].max() < 0.2


def test_grid_is_the_same_under_any_cut(spark):
    rng = np.random.default_rng(8)
    n = 1500
    keep = rng.random(n) > 0.1
    keep[[0, -1]] = True
    keep[700:720] = False
    pdf = pd.DataFrame({"id": "hot", "date": T0 + pd.to_timedelta(np.arange(n) * 3600, "s"), "value": 20 + 4 * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, 0.3, n)})[keep]
    got = []
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(gridfill.regularize(spark.createDataFrame(pdf)).toPandas().sort_values("hour_start").reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    pd.testing.assert_frame_equal(got[0], got[1])
    assert len(got[0]) == n and set(got[0].status) == {"observed", "filled"}
    truth = 20 + 4 * np.sin(2 * np.pi * np.arange(n) / 24)
    assert np.abs(got[0].value - truth)[~keep].mean() < 0.5


# ---- implausible readings


def sensor(rng, name, unit, n, base, swing, noise):
    t = T0 + pd.to_timedelta(np.arange(n) * 3600 + rng.integers(0, 600, n), "s")
    v = base + swing * np.sin(2 * np.pi * np.arange(n) / 24) + rng.normal(0, noise, n)
    return pd.DataFrame({"id": name, "date": t, "value": v, "unit": unit})


def test_flags_planted_cases(spark):
    rng = np.random.default_rng(4)
    a, b, c = sensor(rng, "a", "kWh", 600, 200, 20, 1.0), sensor(rng, "b", "%", 400, 50, 2, 0.5), sensor(rng, "c", None, 300, 5, 1, 0.05)
    a.loc[[50, 51, 300], "value"] += [25, 25, -30]
    a.loc[400:411, "value"] = 207.5
    a.loc[500:, "value"] += 60  # lasts
    b.loc[100, "value"] = 130.0
    b.loc[200:206, "value"] = 50.0  # seven: too short
    pdf = pd.concat([a, b, c, a.iloc[[300]], b.iloc[[100]]], ignore_index=True)
    pdf["row_no"] = np.arange(len(pdf))
    out = spikes.flag_implausible(spark.createDataFrame(pdf)).toPandas().merge(pdf, on="row_no")
    want = {50, 51, 300, *range(400, 412), 600 + 100, len(pdf) - 2, len(pdf) - 1}
    assert set(out[out.impossible | out.stuck | out.spike].row_no) == want
    assert set(out[out.impossible].row_no) == {700, len(pdf) - 1}


def test_scatter_and_spikes_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(16)
    a = sensor(rng, "a", "kWh", 2400, 200, 20, 1.0)
    a["value"] += rng.normal(0, 1, len(a)) * np.where(np.arange(len(a)) < 1500, 0, 5)  # noisier later on
    a.loc[[70, 900, 1800, 2200], "value"] += [40, 45, 60, 50]
    a.loc[300:311, "value"] = 207.5
    pdf = pd.concat([a, sensor(rng, "b", "%", 400, 50, 2, 0.5)], ignore_index=True)
    pdf["row_no"] = np.arange(len(pdf))
    copies = pdf.loc[[900, 1800, 305, 1799]].assign(row_no=lambda d: d.row_no + 10_000)
    df = spark.createDataFrame(pd.concat([pdf, copies]))
    got = []
    for parts, most in (("1", None), ("48", None), ("400", None), ("3", 700), ("5", 300)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append(spikes.flag_implausible(df, most=most).toPandas().sort_values("row_no").reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    for other in got[1:]:  # to the last bit
        pd.testing.assert_frame_equal(got[0], other, check_exact=True)
    assert set(got[0][got[0].spike].row_no) == {70, 900, 1800, 2200, 10_900, 11_800} and got[0].stuck.sum() == 13


def test_stuck_runs_by_brute_force(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": rng.choice(["a", "b"], 800), "date": T0 + pd.to_timedelta(rng.permutation(800) * 60, "s"), "value": rng.integers(0, 2, 800).astype(float), "unit": "count"})
    pdf.loc[rng.integers(0, 800, 300), "value"] = 1.0
    pdf["row_no"] = np.arange(800)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = set(spikes.flag_implausible(spark.createDataFrame(pdf), stuck_run=5).where("stuck").toPandas().row_no)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = set()
    for _, g in pdf.sort_values("date").groupby("id"):
        v, rows = g.value.to_numpy(), g.row_no.to_numpy()
        for i in range(len(v)):
            lo = hi = i
            while lo and v[lo - 1] == v[i]:
                lo -= 1
            while hi + 1 < len(v) and v[hi + 1] == v[i]:
                hi += 1
            if hi - lo + 1 >= 5:
                want.add(rows[i])
    assert got == want


def test_partitions_change_nothing_clear(spark):
    rng = np.random.default_rng(6)
    pdf = sensor(rng, "hot", "volt", 3000, 230, 3, 0.5)
    at = rng.choice(np.arange(20, 2980), 25, replace=False)
    pdf.loc[at, "value"] += 15
    pdf["row_no"] = np.arange(3000)
    found = []
    for n in ("1", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(set(spikes.flag_implausible(spark.createDataFrame(pdf)).where("spike").toPandas().row_no))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == set(at)


def test_flags_edges(spark):
    schema = "row_no bigint, id string, date timestamp, value double, unit string, t int, v int, src string"
    rows = [(1, "a", dt.datetime(2023, 1, 1), float("inf"), "K", 1, 1, ""), (2, "a", dt.datetime(2023, 1, 2), None, "K", 1, 1, ""), (3, None, dt.datetime(2023, 1, 1), -5.0, "K", 1, 1, ""), (4, "a", None, -5.0, "K", 1, 1, ""),
            (5, "a", dt.datetime(2023, 1, 3), -5.0, None, 1, 1, ""), (6, "b", dt.datetime(2023, 1, 1), -500.0, "furlong", 1, 1, "")]
    out = {r["row_no"]: r for r in spikes.flag_implausible(spark.createDataFrame(rows, schema)).collect()}
    assert set(out) == {1, 5, 6} and out[5]["impossible"] and not out[6]["impossible"] and out[1]["spike"]
    assert spikes.flag_implausible(spark.createDataFrame([], schema)).count() == 0


# ---- trailing totals


def test_trailing_by_brute_force(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y", "z"], 400), "d": T0 + pd.to_timedelta(rng.integers(0, 400, 400), "D"), "v": rng.normal(size=400).round(2)})
    pdf.loc[::17, "v"] = np.nan
    out = trailing.trailing_totals(spark.createDataFrame(pdf), "k", "d", "v", (1, 7, 100)).toPandas()
    out["day"] = pd.to_datetime(out.day)
    for k, g in pdf.groupby("k"):
        o = out[out.k == k].set_index("day").sort_index()
        assert list(o.index) == list(pd.date_range(g.d.min(), g.d.max()))
        for day in o.index[::13]:
            assert o.lines[day] == (g.d == day).sum()
            for w in (1, 7, 100):
                s = g[(g.d <= day) & (g.d > day - pd.Timedelta(days=w))].v
                assert o[f"total_{w}"][day] == pytest.approx(s.sum(), abs=1e-9) and o[f"count_{w}"][day] == s.count()
                assert (np.isnan(o[f"average_{w}"][day]) and s.count() == 0) or o[f"average_{w}"][day] == pytest.approx(s.mean())


def test_trailing_edges(spark):
    schema = "k string, d timestamp, v double, day int, tile int, entity string"
    rows = [(None, dt.datetime(2023, 1, 1), 1.0, 1, 1, ""), ("a", None, 1.0, 1, 1, ""), ("a", dt.datetime(2023, 1, 1, 13), None, 1, 1, ""), ("a", dt.datetime(2023, 1, 3), 2.0, 1, 1, ""), ("a", dt.datetime(2023, 1, 3), 2.0, 1, 1, "")]
    out = trailing.trailing_totals(spark.createDataFrame(rows, schema), "k", "d", "v", [2]).orderBy("day").collect()
    assert [(r["lines"], r["total_2"], r["count_2"], r["average_2"]) for r in out] == [(1, 0.0, 0, None), (0, 0.0, 0, None), (2, 4.0, 2, 2.0)]
    assert trailing.trailing_totals(spark.createDataFrame([], schema), "k", "d", "v").count() == 0
    with pytest.raises(ValueError):
        trailing.trailing_totals(spark.createDataFrame(rows, schema), "k", "d", "v", [0])
    lines = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 6, "b"), (None, 1, 1, "c"), (None, 1, 1, "c")], "o int, l int, at int, x string")
    assert sorted(r["x"] for r in trailing.distinct_lines(lines, ("o", "l"), "at", ("x",)).collect()) == ["b", "c", "c"]


def test_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), F.lit(2.0).alias("v"))
    out = running_total(df, "k", "v", "t", 5).toPandas()
    assert (out.t == 2 * (out.k + 1)).all() and len(out) == 1000
