"""Retrain-driven halts, forward mutation, digests of stored runs, ablation over windows."""

import datetime as dt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import ablation as A
from barloom.operators import digests as D
from barloom.operators import halts as H
from barloom.operators import mutation as MU
from barloom.plans import QUERIES, evidence
from barloom.sources import bars as B


def test_overlapping_failures_count_once():
    s = H.RetrainHalts()
    seen = [s.record(False, d, a, b) for d, a, b in ((-1, 0, 10), (-1, 5, 15), (-1, 10, 20), (-1, 11, 21), (None, 22, 30))]
    assert seen == ["failure", "repeat", "repeat", "failure", "failure"] and s.edge_halted and s.failures == 3
    s.drawdown_halted = True
    assert s.record(False, 0.1) == "success" and not s.edge_halted and s.drawdown_halted and s.failures == 0
    assert s.record(True, float("nan")) == "failure" and not s.drawdown_halted  # without a sample nothing overlaps
    assert [s.record(False, 0.0), s.record(False, -1.0)] == ["failure", "failure"] and s.edge_halted


def test_halts_of_the_bars(spark, sf):
    rows = QUERIES["FLD-09-retrains"](spark, sf).collect()
    assert {r.outcome for r in rows} == {"success", "failure", "repeat"} and len({r.drawdown_halted for r in rows}) == 2


@pytest.fixture(scope="module")
def few(spark, sf):
    return B.bars_daily(spark, sf).where("instrument = 'A'")


def test_nothing_up_to_a_cut_moves(spark, few):
    rows = MU.forward_mutation(few, samples=2).collect()
    names = {r.feature for r in rows}
    assert len(names) >= 39 and {"return_1", "vpin", "fd_adaptive_z", "kalman_velocity", "state_2", "time_sin", "range_z"} <= names
    assert all(r.compared > 500 and r.changed == 0 for r in rows), [(r.feature, r.changed) for r in rows if r.changed]
    still = {r.feature for r in rows if r.moved == 0}
    assert still <= {"time_sin", "time_cos"}  # the mutation moved everything else behind the cut


def test_a_leak_is_found(spark, few):
    rows = {(r.cut, r.feature): r for r in MU.forward_mutation(few, MU.leaking, samples=3).collect()}
    assert all(r.changed == (1 if f == "leak" else 0) and r.moved > 0 for (_, f), r in rows.items()) and len(rows) == 6


def test_digests(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5, None), ("a", 1, 0.5, None), ("b", 2, -0.5, [1, 2])], "instrument string, n int, x double, v array<int>")
    one = D.run_digest({"t": df, "u": df.drop("instrument")})
    assert D.verdict(D.compare(one, D.run_digest({"u": df.orderBy(F.desc("n")).drop("instrument"), "t": df.repartition(3)}))).first().identical
    other = df.withColumn("x", F.when(F.col("n") == 2, 0.5).otherwise(F.col("x")))
    found = D.verdict(D.compare(one, D.run_digest({"t": other, "u": df.drop("instrument")}))).first()
    assert tuple(found) == (False, 1, "t", "b")
    less = D.compare(one, D.run_digest({"t": df.distinct(), "u": df.drop("instrument")})).where("not same").collect()  # a repeated row isn't nothing
    assert [(r.table, r.part, r.rows, r.other_rows) for r in less] == [("t", "a", 2, 1)]
    assert D.verdict(D.compare(one, D.run_digest({"t": df}))).first().differing == 1
    empty = D.run_digest({"t": df.limit(0)})
    assert D.verdict(D.compare(empty, empty)).first().identical


def test_stored_runs_are_the_same(spark, sf):
    rows = QUERIES["REP-01-runs"](spark, sf).collect()
    assert all(r.same and r.rows > 0 for r in rows) and {r.table for r in rows} == {"baselines", "cost", "timing", "regimes"}


# --- ablation
@pytest.fixture(scope="module")
def ablation(spark, sf):
    return evidence.ablation_tables(spark, sf)


def sql(text, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(text).fetchall()


def near(a, b):
    a, b = sorted(a, key=lambda r: r[:3]), sorted(b, key=lambda r: r[:3])
    return len(a) == len(b) and all(x[:3] == y[:3] and np.allclose(np.array(x[3:], float), np.array(y[3:], float), atol=1e-9) for x, y in zip(a, b, strict=True))


def test_matrix_and_verdicts_in_sql(spark, ablation):
    _, sims = ablation
    names = set(A.VARIANTS) | {f"full~{f}" for f in A.OPTIONAL}
    assert {r.variant for r in sims.select("variant").distinct().collect()} == names
    got = A.matrix(sims, draws=200)
    pairs = A.pairs(spark)
    want = sql("""with s as (select instrument, "window", variant, coalesce(avg(pnl) / nullif(stddev_pop(pnl), 0), 0) * sqrt(252) as s from sims where scenario = 'plain' group by all),
     d as (select x.instrument, family, kind, x.s - y.s as delta from s x join pairs using (variant) join s y on y.instrument = x.instrument and y."window" = x."window" and y.variant = reference)
     select instrument, family, kind, count(*), avg(delta), median(delta), avg((delta > 0)::int), coalesce(max(delta) filter (where delta > 0) / sum(delta) filter (where delta > 0), 0) from d group by all""", sims=sims, pairs=pairs)
    assert near(want, [tuple(r) for r in got.select("instrument", "family", "kind", "windows", "mean_delta", "median_delta", "positive", "dominance").collect()])
    rows = got.collect()
    assert len(rows) == 3 * len(A.OPTIONAL) * 2 and all(r.low <= r.mean_delta <= r.high for r in rows)
    judged = A.verdicts(got, sims).collect()
    assert len(judged) == 3 * len(A.OPTIONAL)
    for r in judged:
        gain = r.median_up and r.mostly_up and r.sabotage_hurts
        assert r.status == ("REJECTED" if not gain else "ACCEPTED" if r.survives_delay and r.survives_cost else "RESEARCH ONLY")


def test_every_verdict_is_reached(spark):
    table = spark.createDataFrame([("A", f, "marginal", 1.0, 0.9, 0.5, 0.2) for f in A.OPTIONAL], "instrument string, family string, kind string, median_delta double, positive double, low double, dominance double")
    good, late, bad = list(A.OPTIONAL)[:3]
    level = lambda v, s: 1.0 if v == "base" else 0.5 if v == f"base+{late}" and s == "delay_1" else 3.0 if v == f"full~{bad}" else 2.0 if v == "full" or v.startswith("base+") else 1.5
    sims = [("A", v, s, 0, k, level(v, s) * 1e-3 + (1e-3 if k % 2 else -1e-3), 0.0) for v in [*A.VARIANTS, *[f"full~{f}" for f in A.OPTIONAL]] for s in A.SCENARIOS for k in range(10)]
    got = {r.family: r.status for r in A.verdicts(table, spark.createDataFrame(sims, A.SIMULATED)).collect()}
    assert (got[good], got[late], got[bad]) == ("ACCEPTED", "RESEARCH ONLY", "REJECTED")


def test_regime_cells_in_sql(spark, ablation):
    rows, sims = ablation
    tags = evidence.regime_tags(rows)
    want = sql("""select a.instrument, a.variant[6:] as family, condition, count(*), coalesce(avg(a.pnl) / nullif(stddev_pop(a.pnl), 0), 0) * sqrt(252) as x, coalesce(avg(b.pnl) / nullif(stddev_pop(b.pnl), 0), 0) * sqrt(252) as y, x - y
     from sims a join sims b on a.instrument = b.instrument and a.bar = b.bar and a.scenario = 'plain' and b.scenario = 'plain' and b.variant = 'base' and a.variant like 'base+%'
     join tags t on t.instrument = a.instrument and t.bar = a.bar group by all having count(*) >= 20""", sims=sims, tags=tags)
    got = A.conditional(sims, tags).select("instrument", "family", "condition", "bars", "sharpe_with", "sharpe_base", "delta").collect()
    assert near(want, list(map(tuple, got))) and len(got) >= 3 * len(A.OPTIONAL) * 2


def test_bars_are_made_once(spark, sf):
    """The plan of a convolution over chunks reads stored bars; the deals behind them are read once, when they are stored."""
    plan = QUERIES["FRC-03"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in plan and plan.count("Aggregate") == 1


# --- orders and representations
def test_scores_of_all_orders(spark, sf):
    from barloom.operators import retraining as R
    from barloom.plans import research

    rows = B.stored(R.positioned(research.training_rows(spark, sf).where("instrument = 'A'")))
    parts = R.fold_parts(R.whole_window(rows)).where("part = 2")
    made = R.order_forecasts(rows, parts, evidence.ORDERS, 20, 20)
    got = {(r.window, r.bar): r.m for r in made.collect()}
    assert len({k for k, _ in got}) == 19
    one = R.order_forecasts(rows, parts, evidence.ORDERS[6:7], 20, 20)
    assert {r.d for r in one.collect()} == {evidence.ORDERS[6]} and one.count() * 19 == len(got)
    late = rows.where("ok").where(F.col("row") == parts.first().start).first().bar
    moved = rows.withColumn("y_norm", F.when(F.col("bar") >= late, -F.col("y_norm")).otherwise(F.col("y_norm")))  # labels of the validation rows
    assert {(r.window, r.bar): r.m for r in R.order_forecasts(moved, parts, evidence.ORDERS, 20, 20).collect()} == got
    scores = R.score_by_order(rows, [0.2, 0.5], 20, 20)
    assert sorted((r.window, r.fold, r.d) for r in scores.collect()) == [(k, f, d) for k, d in enumerate((0.2, 0.5)) for f in range(1, 6)]


def test_representation_by_fold_scores(spark):
    out = evidence.representation_tables(spark, "/root/testdata/sf0.01")
    want = sql("""select split_part(instrument, '@', 1) as base, "window", split_part(instrument, '@', 2) as candidate from choices where inputs = 'full'
     qualify row_number() over (partition by base, "window" order by mean_score desc, case candidate when 'time_15' then 0 when 'tick_1' then 1 else 2 end) = 1""", choices=out["choices"])
    got = out["selection"].select("base", "window", "candidate").collect()
    assert sorted(want) == sorted(map(tuple, got)) and len({r.candidate for r in got}) >= 2 and len(got) == 5 * 5
    # every window trains on bars that began before the reference's window does, and deals on those that began within it
    edges = sql("""select w.instrument, w."window", max(r."timestamp") filter (where r.row < w.last) < min(s.t) and min(r."timestamp") filter (where r.row >= w.oos_start and r.row < w.oos_end) >= min(s.t)
     from w join r on r.instrument = w.instrument and r.ok join (select split_part(w.instrument, '@', 1) as base, w."window", min(r."timestamp") as t from w join r on r.instrument = w.instrument and r.ok and r.row >= w.oos_start and r.row < w.oos_end and w.instrument like '%@time_15' group by 1, 2) s
      on s.base = split_part(w.instrument, '@', 1) and s."window" = w."window" group by 1, 2""", w=out["windows"], r=out["rows"].select("instrument", "row", "timestamp", "ok"))
    assert all(ok for *_, ok in edges) and len(edges) >= len(got)
    rows = out["results"].where("variant = 'full'").collect()
    chosen = {(r.base, r.window): r.candidate for r in got}
    count = {(r.instrument, r.window): r.oos_end - r.oos_start for r in out["windows"].collect()}
    for key, name in chosen.items():
        assert sum((r.instrument, r.window) == key for r in rows) == count[f"{key[0]}@{name}", key[1]]


# --- model versions
def test_a_backtest_swaps_its_models(spark, sf, tmp_path):
    """The version in force is the last one published before a bar; its forecast is that of the fitted model; stream and batch agree
    across the swaps."""
    from barloom.operators import engine as EN
    from barloom.operators import models as MO
    from barloom.operators import training as T
    from barloom.operators import versions as V
    from barloom.streaming import jobs

    bars, versions = evidence.versioned_bars(spark, sf)
    bars = B.stored(bars.where("instrument = 'A'"))
    known = V.forecast_as_of(bars, versions).toPandas().sort_values("timestamp").reset_index(drop=True)
    table = versions.where("instrument = 'A'").toPandas().sort_values("published")
    assert len(table) == 21 and known["version"].nunique() == 21
    want = [table["version"][table["published"] < t].iloc[-1] if (table["published"] < t).any() else None for t in known["timestamp"]]
    assert [None if v != v else int(v) for v in known["version"]] == want
    for r in table.itertuples():
        mine = known[known["version"] == r.version]
        pair, g = T.Pair.__new__(T.Pair), MO.Calibrator()
        pair.m = T.Ridge.__new__(T.Ridge)
        pair.m.mean, pair.m.scale, pair.m.w, pair.m.base, pair.w = (np.array(v, float) for v in (r.mean, r.scale, r.w, r.base, r.up))
        g.x, g.y, g.slope = np.array(r.gx, float), np.array(r.gy, float), None if len(r.gx) else r.slope
        e = g.predict(pair.predict(mine[V.INPUTS].to_numpy(float))[0]) * mine["sigma"].to_numpy() * T.HORIZON**0.5
        assert np.allclose(mine["er"], np.nan_to_num(e), atol=1e-12)
    batch = EN.run_engine(V.forecast_as_of(bars, versions)).toPandas().sort_values("timestamp").reset_index(drop=True)
    assert (batch["filled"] != 0).sum() > 10
    half = bars.select(F.percentile_approx(F.unix_seconds("timestamp"), F.lit(0.75), F.lit(10_000))).first()[0]
    for late in (False, True):
        bars.where((F.unix_seconds("timestamp") > half) == late).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = jobs.collect_stream(EN.stream_engine(V.forecast_as_of(stream, versions)), "versions_test", str(tmp_path / "c")).toPandas().sort_values("timestamp").reset_index(drop=True)
    assert len(streamed) == len(batch)
    for n in ("status", "target", "approved", "ordered", "filled", "units", "cash", "equity"):
        assert streamed[n].equals(batch[n]) or np.allclose(streamed[n].astype(float), batch[n].astype(float), equal_nan=True), n


def test_a_forecast_is_worked_out_once_for_a_bar(spark):
    """Versions keep the corners of their maps only, with the same values, and a bar's forecast isn't made anew for each point of a map."""
    from barloom.operators import models as MO
    from barloom.operators import training as T
    from barloom.operators import versions as V

    rng = np.random.default_rng(3)
    n, k = 4000, len(V.INPUTS)
    a = rng.normal(size=n)
    g = MO.Calibrator().fit(a, 0.1 * a + rng.normal(size=n))
    gx, gy = V.corners(g.x, g.y)
    assert len(gx) < 200 < len(g.x) == n
    at = np.r_[g.x, rng.normal(size=n), -9.0, 9.0]
    assert np.array_equal(np.interp(at, g.x, g.y), np.interp(at, gx, gy))
    assert [len(v) for v in V.corners(np.empty(0), np.empty(0))] == [0, 0] and V.corners(np.array([1.0]), np.array([2.0]))[0].tolist() == [1.0]

    w, up, day = rng.normal(size=k), rng.normal(size=k + 1), dt.datetime(2020, 1, 1)
    model = lambda v, s: ("A", v, day + dt.timedelta(days=10 * v), [0.0] * k, [1.0] * k, (s * w).tolist(), 0.0, up.tolist(), gx.tolist(), gy.tolist(), None)
    versions = spark.createDataFrame([model(0, 1.0), model(1, -1.0)], V.VERSIONS)
    x = rng.normal(size=(30, k))
    rows = [("A", day + dt.timedelta(days=i), 0.01, *map(float, x[i])) for i in range(30)]
    out = V.forecast_as_of(spark.createDataFrame(rows, "instrument string, timestamp timestamp, sigma double, " + ", ".join(f"`{c}` double" for c in V.INPUTS)), versions)
    got = out.orderBy("timestamp").toPandas()
    assert got["version"].isna()[0] and got["version"][1:].tolist() == [0] * 10 + [1] * 19
    m, p = (x @ w) * np.where(np.arange(30) < 11, 1, -1), 1 / (1 + np.exp(-(up[0] + x @ up[1:])))
    agreed = np.where(np.sign(m) == np.sign(p - 0.5), m * np.abs(2 * p - 1), 0.0)
    assert np.allclose(got["er"][1:], (g.predict(agreed) * 0.01 * T.HORIZON**0.5)[1:], atol=1e-12) and got["er"][0] == 0
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2
