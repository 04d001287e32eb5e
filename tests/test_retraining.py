"""Retrains with a grid, walks over windows, the locked holdout, and the gates that judge them."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import labels
from barloom.operators import retraining as R
from barloom.operators import training as T
from barloom.operators.boosting import Trees, boost
from barloom.plans import QUERIES, gates, research, runner
from barloom.sources import bars


# --- boosting
def plain_boost(x, y, others, least, rounds, p):
    """One model, tree by tree and node by node: exact cuts at the same bin edges."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, p.bins + 1)[1:-1])) for c in x.T]
    code = lambda z: np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, z.T, strict=True)])
    a, b = code(x), code(others)
    rng, out, far = np.random.default_rng(p.seed), np.full(len(x), y.mean()), np.full(len(others), y.mean())
    shrink = lambda g: np.sign(g) * max(abs(g) - p.l1, 0.0)
    for _ in range(rounds):
        rows = np.flatnonzero(rng.random(len(x)) < p.rows)
        columns = np.argsort(rng.random(x.shape[1]))[: int(np.ceil(x.shape[1] * p.columns))]
        left = y - out

        def grow(own, mine, theirs, depth):
            drawn = np.intersect1d(mine, rows)
            if depth < p.depth:
                best = (1e-12, None)
                for c in sorted(columns):
                    for cut in range(p.bins):
                        low = drawn[a[drawn, c] <= cut]
                        high = drawn[a[drawn, c] > cut]
                        if len(low) >= least and len(high) >= least:
                            gain = sum(shrink(left[k].sum()) ** 2 / (len(k) + p.l2) for k in (low, high)) - shrink(left[drawn].sum()) ** 2 / (len(drawn) + p.l2)
                            if gain > best[0] + 1e-9:
                                best = (gain, (c, cut))
                if best[1]:
                    c, cut = best[1]
                    for side in (False, True):
                        grow(own, mine[(a[mine, c] > cut) == side], theirs[(b[theirs, c] > cut) == side], depth + 1)
                    return
            value = p.rate * shrink(left[drawn].sum()) / (len(drawn) + p.l2)
            own[mine] += value
            far[theirs] += value

        grow(out, np.arange(len(x)), np.arange(len(others)), 0)
    return far


def test_boosting_equals_a_plain_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 4))
    y = np.sin(2 * x[:, 0]) + x[:, 1] * (x[:, 2] > 0) + 0.1 * rng.normal(size=150)
    p = Trees(bins=12, rate=0.2)
    got, uses, digests = boost(x[:100], y[:100], x[100:], [([0, 1, 2, 3], 8), ([0, 1, 2, 3], 20)], [3, 12], p)
    for m, least in enumerate((8, 20)):
        for rounds in (3, 12):
            assert np.allclose(got[m, rounds], plain_boost(x[:100], y[:100], x[100:], least, rounds, p))
    assert len(set(digests.values())) == 4 and uses[0, 12].sum() > uses[0, 3].sum() > 0
    again = boost(x[:100], y[:100], x[100:], [([0, 1, 2, 3], 20)], [12], p)
    assert again[2][0, 12] == digests[1, 12] and np.array_equal(again[0][0, 12], got[1, 12])  # fits don't depend on their neighbours
    few = boost(x[:100], y[:100], x[100:], [([0, 3], 8), ([1], 60)], [4], p)
    assert few[1][0, 4][[1, 2]].sum() == 0 and np.allclose(few[0][1, 4], y[:100].mean(), atol=0.2)


# --- tables
@pytest.fixture(scope="module")
def rows(spark, sf):
    return research.training_rows(spark, sf)


@pytest.fixture(scope="module")
def count(spark, rows):
    return {r.instrument: r.n for r in R.sizes(R.positioned(rows)).collect()}


@pytest.fixture(scope="module")
def retrain(spark, sf):
    return research.retrain_tables(spark, sf)


@pytest.fixture(scope="module")
def walk(spark, rows, tmp_path_factory):
    return R.walked(rows, folder=str(tmp_path_factory.mktemp("walk") / "w"))


def sql(text, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(text).fetchall()


def test_every_grid_point_of_every_fold(retrain, count):
    got = retrain["fold_scores"].collect()
    points = {(i, k, r, least) for i in count for k in R.INPUTS for r, least in R.GRID}
    assert len(got) == 5 * len(points) and {(r.instrument, r.inputs, r.rounds, r.least) for r in got} == points
    for i, n in count.items():
        inner = int(np.floor(n * 0.85)) - T.PURGE
        want = {fold: end - start for fold, _, start, end in labels.folds(inner)}
        for k, r, least in {p[1:] for p in points}:
            mine = {x.fold: x for x in got if (x.instrument, x.inputs, x.rounds, x.least) == (i, k, r, least)}
            assert {f: x.n for f, x in mine.items()} == want
            assert all(mine[f].calibration_rows + mine[f].n == mine[f + 1].calibration_rows for f in range(1, 5))
    assert retrain["reports"].count() == len(count) and all(r.n > 0 and r.folds == 5 for r in retrain["reports"].collect())


def test_choice_and_acceptance_in_sql(retrain):
    grid = ", ".join(f"({r}, {least}, {k})" for k, (r, least) in enumerate(R.GRID))
    want = sql(f"""select instrument, inputs, rounds, least from (select instrument, inputs, rounds, least, round(avg(score), 9) as s from scores group by all)
     join (values {grid}) g(rounds, least, k) using (rounds, least) qualify row_number() over (partition by instrument, inputs order by s desc, k) = 1""", scores=retrain["fold_scores"])
    assert sorted(want) == sorted(map(tuple, retrain["choices"].select("instrument", "inputs", "rounds", "least").collect()))
    want = sql("""with c as (select * from scores semi join choices using (instrument, inputs, rounds, least)),
     w as (select instrument, count_if(f > b) as wins from (select instrument, fold, max(score) filter (where inputs = 'full') as f, max(score) filter (where inputs = 'baseline') as b from c group by all) group by 1)
     select f.instrument, wins, f.score - b.score as delta, f.accuracy > 0.51 and f.corr > 0 and f.net > 0 and f.profit_factor > 1.05 and f.max_drawdown < 0.15 and wins >= 3 and f.score > b.score
     from held f join held b on f.instrument = b.instrument and f.inputs = 'full' and b.inputs = 'baseline' join w on w.instrument = f.instrument""",
               scores=retrain["fold_scores"], choices=retrain["choices"], held=retrain["windows"].sparkSession.read.parquet(retrain["reports"].inputFiles()[0].rsplit("/reports/", 1)[0] + "/holdout_results"))
    assert sorted(want) == sorted(map(tuple, retrain["reports"].select("instrument", "wins", "delta", "accepted").collect()))


def test_walk_covers_its_rows_and_carries_models(walk, count):
    trades = walk["carried"].collect()
    for i, n in count.items():
        mine = sorted((r for r in trades if r.instrument == i), key=lambda r: r.window)
        assert [r.window for r in mine] == list(range(R.WINDOWS)) and all(a.oos_end == b.oos_start for a, b in zip(mine, mine[1:], strict=False))
        assert (mine[0].oos_start, mine[-1].oos_end) == (int(n * R.FIRST), int(n * (1 - R.LOCKED))) and all(r.last == r.oos_start - T.PURGE for r in mine)
    want = sql("""select instrument, "window", last_value(case when d is not null then "window" end ignore nulls) over w, last_value(case when accepted then "window" end ignore nulls) over w
     from t window w as (partition by instrument order by "window" rows unbounded preceding)""", t=walk["carried"])
    assert sorted(want, key=repr) == sorted(map(tuple, walk["carried"].select("instrument", "window", "model", "deployed").collect()), key=repr)
    per = walk["results"].groupBy("instrument", "variant").count().collect()
    assert {(r.instrument, r.variant) for r in per} == {(i, v) for i in count for v in R.VARIANTS}
    assert all(r["count"] == int(count[r.instrument] * (1 - R.LOCKED)) - int(count[r.instrument] * R.FIRST) for r in per)
    assert walk["fold_forecasts"].select("instrument", "window", "part").distinct().count() == len(trades) * 6  # a task each
    table = R.walk_table(walk)
    assert table.count() == len(trades) and {"net_full", "window_sharpe_baseline", "sharpe_production", "deals_full"} <= set(table.columns)
    total = {r.instrument: r for r in R.summary(walk["results"]).where("variant = 'full'").collect()}
    for r in table.groupBy("instrument").agg(F.sum("net_full").alias("net"), F.first("sharpe_full").alias("s")).collect():
        assert r.net == pytest.approx(total[r.instrument].net, abs=1e-4) and r.s == pytest.approx(total[r.instrument].sharpe, abs=1e-5)


def test_walk_sees_no_later_bars(spark, rows, walk):
    """Bars behind a point are rewritten: nothing that was decided before it moves."""
    cut = walk["results"].where("instrument = 'A' and window = 2").agg(F.max("bar")).first()[0]
    placed = R.positioned(rows.where("instrument = 'A'"))
    later = F.col("bar") > cut + 2 + T.HORIZON
    moved = placed.withColumns({n: F.when(later, F.col(n) * 1.5).otherwise(F.col(n)) for n in ("y_norm", "open_next2", "return_1", "vol_50", "log_close")}).drop("bar", "ok", "row", "n")
    other = R.walked(moved, folder=bars.fresh_path(spark, "moved"))["results"].where("window <= 2")
    same = walk["results"].where("instrument = 'A' and window <= 2")
    names = ["variant", "bar", "e", "exposure"]
    assert other.select(names).exceptAll(same.select(names)).isEmpty() and other.count() == same.count()


def test_holdout_walk(spark, walk, count, tmp_path):
    log = str(tmp_path / "log")
    with pytest.raises(PermissionError):
        R.holdout_walk(walk, "CANDIDATE", log, "too early")
    assert not (tmp_path / "log").exists()
    made = R.holdout_walk(walk, "VALIDATED CANDIDATE", log, "development is done")
    assert spark.read.parquet(log).count() == 1
    for r in made["results"].groupBy("instrument", "variant").agg(F.min("bar").alias("a"), F.count("*").alias("n")).collect():
        end = walk["results"].where(F.col("instrument") == r.instrument).agg(F.max("bar")).first()[0]
        assert r.n == count[r.instrument] - int(count[r.instrument] * (1 - R.LOCKED)) and r.a > end
    # a first window without a model of its own trades the last one of development
    nothing = {**made, "reports": made["reports"].where("window > 21")}
    carried = R.deal({k: v for k, v in nothing.items() if k not in ("carried", "oos_forecasts", "results")}, bars.fresh_path(spark, "carried"), walk)
    first = carried["carried"].where("window = 21").collect()
    assert {r.model for r in first} == {R.WINDOWS - 1}
    assert carried["results"].where("window = 21 and variant = 'full' and e <> 0").count() > 0
    table = R.summary(made["results"]).where("variant = 'full'")
    values = research.gate_values({"holdout": R.summary(made["results"])})
    assert values["holdout_sharpe"] == pytest.approx(table.agg(F.min("sharpe")).first()[0]) and values["holdout_return"] is not None


def test_research_run_refuses_the_holdout(spark, sf, tmp_path):
    run = str(tmp_path / "run")
    paths = {r.stage: r.path for r in runner.run_research(spark, sf, "walkforward,timing,holdout,gates", run, "look").collect()}
    walked = spark.read.parquet(paths["walkforward"]).select("window", F.inline("instruments")).collect()
    assert len({(r.window, r.instrument) for r in walked}) == R.WINDOWS * 3
    refused = spark.read.parquet(paths["holdout"]).first()
    assert refused.level == "EXPERIMENTAL" and "locked" in refused.refused and not (tmp_path / "run" / "holdout_log").exists()
    judged = {r.gate: r for r in spark.read.parquet(paths["gates"]).collect()}
    assert judged["sharpe"].value == pytest.approx(min(r.sharpe_full for r in walked)) and judged["windows"].value <= R.WINDOWS
    timing = spark.read.parquet(paths["timing"]).where("scenario = 'delay_1'").collect()
    assert judged["delay_sharpe"].value == pytest.approx(min(r.sharpe for r in timing))
    assert judged["leaks"].value is None and judged["leaks"].passed is None and judged["holdout_return"].value is None


# --- gates from stage tables
def stage_tables(spark, upto):
    """Tables of the stages as they would be for an instrument that passes all gates up to a level."""
    window = [("A", w, 0.02, 3.0 + w % 3, 1.0, w, w, 50, 0.3, 2.0, 0.1, 1.5, 250, 0.3, 2.0) for w in range(21)]
    walk = spark.createDataFrame(window, "instrument string, window int, net_full double, window_sharpe_full double, window_sharpe_baseline double, model int, deployed int, oos_rows long, return_full double, sharpe_full double, drawdown_full double, pf_full double, deals_full long, return_production double, sharpe_production double")
    walk = walk.withColumns({"sharpe_baseline": F.lit(1.0)})
    out = {"walkforward": runner.nested(walk, "walkforward")} if upto >= 1 else {}
    if upto >= 2:
        trial = lambda *r: spark.createDataFrame(list(r), "instrument string, scenario string, sharpe double, total_return double, collapsed boolean")
        out |= {"cost": trial(("A", "realised_2.0", 1.0, 0.1, False)), "timing": trial(("A", "delay_1", 1.0, 0.1, False)), "perturbation": trial(("A", "p", 1.0, 0.1, False)),
                "execution_stress": trial(("A", "x1.0_d0", 1.0, 0.2, False), ("A", "x2.0_d0", 1.0, 0.1, False)), "d_perturbation_more": trial(("A", "0", 1.0, 0.1, False)),
                "bootstrap": runner.nested(spark.createDataFrame([("A", "sharpe", 0.5)], "instrument string, metric string, low double"), "bootstrap"),
                "leakage": spark.createDataFrame([(0,)], "changed long"),
                "sanity_more": trial(("A", "strategy", 2.0, 0.3, False), ("A", "shuffled_labels", 0.1, 0.0, False), ("A", "shuffled_features", 0.1, 0.0, False), ("A", "target_shift", 0.1, 0.0, False), ("A", "reversed", -2.0, -0.3, False),
                                     ("A", "zero_cost", 2.5, 0.4, False), ("A", "double_cost", 1.5, 0.2, False), *[("A", f"random_{k}", 0.1, 0.0, False) for k in range(20)])}
    if upto >= 3:
        out["holdout"] = spark.createDataFrame([("A", "full", 0.05, 0.8), ("A", "baseline", -1.0, -1.0)], "instrument string, variant string, total_return double, sharpe double")
    if upto >= 4:
        out["reproducibility"] = spark.createDataFrame([(0,)], "changed long")
    return out


@pytest.mark.parametrize("upto, level", list(enumerate(["EXPERIMENTAL", *[name for name, _ in gates.LADDER]])))
def test_every_level_is_reached_from_stage_tables(spark, upto, level):
    tables = stage_tables(spark, upto)
    assert {r["class"] for r in research.ladder_frame(spark, tables).collect()} == {level}
    if upto != 1:  # the short list asks for the same evidence
        assert {r["class"] for r in research.gates_frame(spark, tables).collect()} == {level}
    if upto == 4:
        worse = tables | {"holdout": tables["holdout"].withColumn("sharpe", F.lit(-0.1))}
        assert {r["class"] for r in research.ladder_frame(spark, worse).collect()} == {"VALIDATED CANDIDATE"}
        worse = tables | {"sanity_more": tables["sanity_more"].withColumn("sharpe", F.when(F.col("scenario") == "shuffled_labels", 1.9).otherwise(F.col("sharpe")))}
        assert {r["class"] for r in research.ladder_frame(spark, worse).collect()} == {r["class"] for r in research.gates_frame(spark, worse).collect()} == {"CANDIDATE"}


def test_one_list_of_thresholds():
    assert all(gates.THRESHOLDS[n] == (t, op) for n, _, t, op in gates.GATES + gates.FULL_GATES)


@pytest.mark.parametrize("key", ["MOD-01", "MOD-05", "MOD-06", "MOD-16", "LAB-07", "MOD-11"])
def test_models_of_each_instrument(spark, sf, count, key):
    got = QUERIES[key](spark, sf).collect()
    assert {r.instrument for r in got} == set(count)
    if key == "MOD-16":
        assert sum(r.splits for r in got) > 300
    if key == "MOD-11":
        assert all(len(r.model) == 16 and r.forecast is not None for r in got)


def test_fits_are_dealt_to_many_tasks(spark):
    """Parts have few bytes and much work: merged by their size they would wait for each other in one task."""
    from pyspark.sql import functions as F

    from barloom.operators import retraining as R
    from barloom.operators import training as T

    names = ["y_norm", *T.BASELINE, "log_close"]
    rows = spark.range(600).select(F.lit("A").alias("instrument"), F.col("id").alias("bar"), F.col("id").alias("row"), F.lit(True).alias("ok"), *[F.rand(1).alias(n) for n in names])
    parts = spark.range(40).select(F.lit("A").alias("instrument"), F.col("id").cast("int").alias("window"), F.lit(0).cast("long").alias("first"), F.lit(1).alias("part"), *[F.lit(k).cast("long").alias(n) for n, k in (("train_end", 300), ("start", 300), ("end", 400), ("d_end", 300))])
    dealt = R.task_bars(rows, parts, []).select("window", F.spark_partition_id().alias("task")).distinct().collect()
    assert len(dealt) == 40 and len({r.task for r in dealt}) > 20


def test_lags_of_a_unit_root_test_take_one_decomposition(monkeypatch):
    """Every number of lags by one decomposition, with the residuals of a fit of each; dependent columns are still fitted one by one."""
    import numpy as np

    from barloom.operators import fractional as FR

    fits, plain = [], FR._ols
    monkeypatch.setattr(FR, "_ols", lambda y, x: fits.append(1) or plain(y, x))
    rng = np.random.default_rng(3)
    FR.adf(rng.normal(size=500).cumsum())
    assert len(fits) == 1
    m, y = np.column_stack([np.ones(200), rng.normal(size=(200, 6))]), rng.normal(size=200)
    for x in (m, np.column_stack([m, m[:, 2]])):
        want = [float(r @ r) for r in (plain(y, x[:, :k])[1] for k in range(2, x.shape[1] + 1))]
        assert np.allclose(FR.nested_residuals(y, x, 2), want, rtol=1e-10)


def test_a_unit_root_test_of_long_series():
    """Where the approximation of the p-value ends: a long stationary series has no unit root, an explosive one has. Blocks of rows
    give the statistic of one fit over all."""
    import math

    from barloom.operators import fractional as FR

    rng = np.random.default_rng(4)
    noise = rng.normal(size=20_000)
    tau, p = FR.adf(noise)
    assert tau < -36 and p == 0.0 and FR.adf(np.exp(np.arange(300) * 0.02) + rng.normal(size=300) * 1e-3)[1] == 1.0
    dx = np.diff(noise)
    fits = []
    for lags in range(21):
        rows = np.arange(20, len(dx))
        m = np.column_stack([np.ones(len(rows)), noise[rows], *[dx[rows - j] for j in range(1, lags + 1)]])
        fits.append((len(rows) * math.log(FR._ols(dx[rows], m)[1].var()) + 2 * (2 + lags), lags))
    lags = min(fits)[1]
    rows = np.arange(lags, len(dx))
    m = np.column_stack([np.ones(len(rows)), noise[rows], *[dx[rows - j] for j in range(1, lags + 1)]])
    beta, left = FR._ols(dx[rows], m)
    assert tau == pytest.approx(beta[1] / math.sqrt(np.linalg.inv(m.T @ m)[1, 1] * (left @ left) / (len(rows) - m.shape[1])), rel=1e-9)
    assert R.order_at(noise) == FR.CANDIDATES[0]  # so the first order is taken, and not each one tried


def test_rows_of_long_series_in_chunks(spark, sf, rows):
    """Windows of chunks equal those of whole instruments, bit for bit; bars that begin at once keep their order, in any partitioning."""
    from barloom.operators import representation as RP
    from barloom.plans import evidence

    names = ["instrument", "timestamp", *T.COLUMNS]
    made = research.long_training_rows(bars.bars_daily(spark, sf), chunk=300).select(names)
    assert made.exceptAll(rows.select(names)).isEmpty() and made.count() == rows.count()
    tape = spark.range(900).select(F.lit("A").alias("instrument"), F.timestamp_seconds(F.floor(F.col("id") / 30) * 7).alias("timestamp"), (100 + F.col("id") % 17).cast("double").alias("price"),
                                   F.lit(1.0).alias("size"), F.col("id").alias("sequence_id"))
    cut = evidence.FO.event_bars(tape.repartition(7, F.rand(1)), "tick", 1).withColumnRenamed("start", "timestamp")
    cut = cut.withColumns({"_row": F.split_part("bar_id", F.lit("-"), F.lit(2)).cast("long"), **{n: F.col("close") for n in ("bid", "ask")}, **{n: F.lit(1.0) for n in ("bid_size", "ask_size")}})
    placed = RP.in_time(R.positioned(research.long_training_rows(RP.in_place(cut.repartition(5, F.rand(2))), (RP.BEGAN,), chunk=200)))
    got = placed.orderBy("bar").select("timestamp", "log_close").toPandas()
    assert np.array_equal(np.round(np.exp(got["log_close"])).astype(int), 100 + np.arange(900) % 17) and got["timestamp"].is_monotonic_increasing and got["timestamp"].nunique() == 30


def test_the_walk_has_no_long_frames(spark, monkeypatch):
    """A frame of 390 rows sorted anew for each row took most of the time of a long tape."""
    from barloom.operators import representation as RP
    from barloom.plans import evidence

    seen = {}
    monkeypatch.setattr(RP, "selection_walk", lambda rows, *a, **kw: seen.update(rows=rows))
    evidence.representation_tables(spark, "/root/testdata/sf0.001")
    plan = seen["rows"]._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "stddev_pop" not in plan and "lead(" in plan
