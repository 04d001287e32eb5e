"""Operators outside the training-data subpackage: hand-computed vectors, invariants, batch against stream."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.functions import windows as W
from barloom.operators import asof, features, folds, fractional, labels, models, stats, validate
from barloom.plans import config, gates
from barloom.plans.schema import build_schema
from barloom.sources import bars, calendar, synthetic
from barloom.streaming import jobs

T0 = dt.datetime(2024, 1, 2, 14, 30)


def frame(spark, **columns):
    names = list(columns)
    rows = [("A", T0 + dt.timedelta(minutes=30 * i), *v) for i, v in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, "instrument string, timestamp timestamp, " + ", ".join(f"{n} double" for n in names))


def values(df, column):
    return [r[0] for r in df.orderBy("timestamp").select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_calendar():
    assert calendar.easter(2026) == dt.date(2026, 4, 5) and dt.date(2027, 3, 26) in calendar.holidays(2027)
    assert dt.date(2026, 7, 3) in calendar.holidays(2026) and dt.date(2026, 7, 3) not in calendar.early_closes(2026)
    assert dt.date(2022, 12, 26) in calendar.holidays(2022)
    assert {dt.date(2025, 11, 28), dt.date(2025, 12, 24)} <= set(calendar.early_closes(2025)) and dt.date(2026, 11, 27) in calendar.early_closes(2026)


def test_next_trading_day(spark):
    assert calendar.days(spark, 2026, 2026).where("date = '2026-09-04'").first().next_trading_day == dt.date(2026, 9, 8)


def test_order_flow(spark):
    df = frame(spark, bid=[100.0, 100.0, 100.1, 100.1], ask=[100.2, 100.2, 100.2, 100.3], bid_size=[500.0, 700.0, 300.0, 300.0], ask_size=[400.0, 400.0, 600.0, 200.0])
    assert values(features.order_flow(df), "ofi_raw") == [None, 200, 100, 600]


def test_asof(spark):
    at = lambda *m: [T0 + dt.timedelta(minutes=x) for x in m]
    target = spark.createDataFrame([(1, t) for t in at(0, 30, 60, 90)], "k int, timestamp timestamp")
    source = spark.createDataFrame([(1, t, float(v)) for t, v in zip(at(-5, 29, 31, 200), (1, 2, 3, 4), strict=True)], "k int, timestamp timestamp, v double")
    assert values(asof.asof_join(target, source, ["k"], ["v"]), "v") == [1, 2, 3, 3]
    assert values(asof.asof_join(target, source, ["k"], ["v"], tolerance_seconds=60), "v") == [None, 2, None, None]


def test_kernels():
    assert fractional.kernel_length(0.25) == 500 and fractional.kernel_length(0.75) == 302 and fractional.kernel_length(0.0) == 10
    for k in (1, 5, 50):
        assert fractional.weights(0.4)[k] == pytest.approx(fractional.weight_closed_form(0.4, k))
    with pytest.raises(ValueError):
        fractional.weights(1.5)


def test_unit_roots():
    rng = np.random.default_rng(0)
    noise, walk = rng.normal(size=800), np.cumsum(rng.normal(size=800))
    assert fractional.adf(noise)[1] < 0.01 and fractional.adf(walk)[1] > 0.05
    assert fractional.kpss(noise)[1] > 0.05 and fractional.kpss(walk)[1] <= 0.011


def test_convolution_needs_full_window(spark):
    x = [float(i * i) for i in range(30)]
    got = values(frame(spark, x=x).withColumn("y", W.convolve("x", [1.0, -1.0, 0.5])), "y")
    assert got[:2] == [None, None] and got[2:] == pytest.approx([x[i] - x[i - 1] + 0.5 * x[i - 2] for i in range(2, 30)])


def test_index_correlation_with_gap(spark):
    x = [float(i) if i != 30 else None for i in range(120)]
    got = values(frame(spark, x=x).withColumn("y", W.corr_with_index("x", 50)), "y")
    assert all(v is None for v in got[49:80]) and got[80] is not None and got[-1] == pytest.approx(1)


def test_robust_z(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=60).tolist()
    got = values(frame(spark, x=x).withColumn("y", W.robust_z("x", 20)), "y")
    w = np.array(x[-20:])
    med = np.median(w)
    assert got[18] is None and got[-1] == pytest.approx((w[-1] - med) / (1.4826 * np.median(np.abs(w - med)) + 1e-12))


def test_scalars(spark):
    lit = F.lit
    assert one(spark, S.round_trip_cost(lit(0.01), lit(4e-4))) == pytest.approx(0.0016) and one(spark, S.round_trip_cost(lit(0.01), lit(None).cast("double"))) == pytest.approx(0.0013)
    assert [one(spark, S.direction_from_edge(lit(x), lit(0.001))) for x in (0.0031, -0.0031, 0.003, math.nan)] == [1, -1, 0, 0]
    assert [one(spark, S.volatility_multiplier(lit(0.01), lit(x))) for x in (0.02, 0.001, 0.1, math.nan)] == [0.5, 1.5, 0.25, 0.25]
    assert [one(spark, S.turnover_suppressed(lit(a), lit(b))) for a, b in ((0.5, 0.4), (0.56, 0.4), (-0.1, 0.4), (0.0, 0.1))] == [0.4, 0.56, -0.1, 0.0]
    assert [one(spark, S.combine(lit(m), lit(p))) for m, p in ((0.5, 0.8), (-0.5, 0.8), (0.5, 0.2), (0.0, 0.5))] == pytest.approx([0.3, 0, 0, 0])
    assert one(spark, S.stop_distance(lit(0.01))) == pytest.approx(0.08)


def test_folds_and_schedule():
    f = labels.folds(2000)
    assert f[0][1] == 795 and f[4][3] == 1800
    s = labels.schedule(10_000, 3_000, 250, holdout_fraction=0.15)
    assert len(s) == 22 and s[-1][3] == 8_500
    with pytest.raises(ValueError):
        labels.folds(20)


def sim_input(n=400, seed=3):
    rng = np.random.default_rng(seed)
    p = 100 * np.exp(np.cumsum(rng.normal(0, 0.003, n + 2)))
    return {"er": rng.normal(0, 0.01, n), "sigma": np.full(n, 0.003), "sigma_ref": np.full(n, 0.003), "cost": np.full(n, 4e-4), "cost_side": np.full(n, 2e-4), "log_close": np.log(p[:n]), "open_next": p[1 : n + 1],
            "open_next2": p[2 : n + 2], "adverse": np.zeros(n), "uncertainty": np.zeros(n), "stress_p": np.zeros(n), "session": np.arange(n) // 13.0, "window": np.arange(n) // 100.0}


def test_deals_add_up():
    for p in (folds.SimParams(), folds.scenario(rule="legacy"), folds.scenario(delay=1), folds.scenario(daily_loss=0.002, drawdown_halt=0.005)):
        rows, deals = folds.simulate(sim_input(), p)
        assert sum(t[5] for t in deals) == pytest.approx(rows["pnl"].sum(), abs=1e-12)
        assert rows["equity"][-1] == pytest.approx(np.prod(1 + rows["pnl"]))
    free, _ = folds.simulate(sim_input(), folds.scenario(cost_scale=0.0))
    paid, _ = folds.simulate(sim_input(), folds.scenario(cost_scale=3.0))
    assert free["pnl"].sum() > paid["pnl"].sum()


def test_cadence():
    a = sim_input(40)
    a["er"][:] = 0.05
    a["log_close"][:], a["open_next"][:], a["open_next2"][:] = math.log(100), 100.0, 100.0
    _, deals = folds.simulate(a, folds.SimParams())
    assert [t[0] for t in deals] == [0, 12, 24, 36]


def test_ledger():
    out = folds.ledger(np.array([100.0, -100.0]), np.array([101.0, 103.0]), commission=1.0)
    assert out["realised"][-1] == 200 and out["equity"][-1] - 100_000 == pytest.approx(198)
    flip = folds.ledger(np.array([100.0, -300.0]), np.array([100.0, 110.0]))
    assert flip["units"][-1] == -200 and flip["realised"][-1] == 1000


def test_orders_and_targets():
    assert folds.order_units(100_000, 200, 0, 0.5) == 250 and folds.order_units(100_000, 200, 250, -0.25) == -375 and folds.order_units(100_000, 200, 250, 0.5001) == 0
    assert folds.parse_target("dollar_250m") == ("dollar", 250e6) and folds.parse_target("volume_500k") == ("volume", 500e3)


def test_validator(spark):
    start = T0
    rows = [("A", i, start + dt.timedelta(minutes=30 * k), 100.0, 101.0, 99.0, 100.0, 10.0, 99.9, 100.1) for i, k in enumerate((0, 1, 1, 0, 2))]
    df = spark.createDataFrame(rows, "instrument string, file_order long, timestamp timestamp, open double, high double, low double, close double, volume double, bid double, ask double")
    got = [r.status for r in validate.validate(df, 1800).orderBy("file_order").collect()]
    assert [s != "reject" for s in got] == [True, True, False, False, True]


def test_calibration():
    assert models.pav(np.array([0.3, -0.1, 0.0]), np.ones(3)) == pytest.approx([0.2 / 3] * 3)
    m = models.Calibrator().fit(np.linspace(-1, 1, 100), np.linspace(-0.5, 0.5, 100))
    assert m.predict(np.array([0.0, math.nan, 2.0])).tolist() == pytest.approx([0, 0, 0.5])


def test_hidden_states():
    rng = np.random.default_rng(0)
    state = np.repeat([0, 1, 0, 1], 150)
    x = np.column_stack([rng.normal(0, 1 + 4 * state), np.abs(rng.normal(0, 1 + 4 * state)), np.log(1 + 4 * state) + rng.normal(0, 0.1, 600)])
    m = folds.GaussianHMM(2).fit(x)
    assert (m.filter(x).argmax(axis=1) == state).mean() > 0.95
    assert np.allclose(m.filter(x)[:300], m.filter(x[:300]))  # causal


def test_kalman_is_causal():
    y = np.cumsum(np.random.default_rng(0).normal(size=200))
    a, _ = folds.kalman(y, 1.0, 0.01, 1.0)
    b, _ = folds.kalman(y[:120], 1.0, 0.01, 1.0)
    assert np.allclose(a[:120], b, equal_nan=True)


def test_statistics(spark):
    assert stats.sign_test(np.array([1.0] * 10)) == pytest.approx(2 / 1024)
    assert stats.break_even([(1, 2.0), (2, 1.0), (3, -1.0)]) == 2.5
    x = np.random.default_rng(0).normal(0.001, 0.01, 300)
    a = stats.block_bootstrap(spark, x, n=50).orderBy("draw").collect()
    assert a == stats.block_bootstrap(spark, x, n=50).repartition(7).orderBy("draw").collect()


def test_schema_and_config():
    assert len(build_schema().names) == 39
    cfg = config.load(base={"a": {"b": 1}}, over=config.overrides(["a.c=2.5"]))
    assert cfg["a"]["b"] == 1 and cfg["a"]["c"] == 2.5
    with pytest.raises(TypeError):
        cfg["a"]["b"] = 2
    assert config.digest(cfg) == config.digest(config.load(base={"a": {"c": 2.5, "b": 1}}))


def test_gates():
    good = {n: (t - 1 if op.startswith("<") else t + 1) for n, _, t, op in gates.GATES}
    assert gates.evaluate(good)[1] == "PAPER ELIGIBLE" and gates.evaluate({**good, "leaks": None})[1] == "CANDIDATE" and gates.evaluate({})[1] == "EXPERIMENTAL"


def test_synthetic(spark):
    assert synthetic.market(50, seed=1) == synthetic.market(50, seed=1)
    spark.dataSource.register(synthetic.SyntheticMarket)
    df = spark.read.format("synthetic_market").option("paths", 2).option("bars", 30).load()
    assert df.count() == 60 and df.where("high < greatest(open, close) or low > least(open, close)").count() == 0


def test_stream_equals_batch(spark, sf, tmp_path):
    ticks = bars.deals(spark, sf)
    ticks.orderBy("timestamp").coalesce(1).write.option("maxRecordsPerFile", 200).parquet(str(tmp_path / "t"))
    got = jobs.collect_stream(jobs.stream_bars(jobs.tick_stream(spark, str(tmp_path / "t"))), "stream_test", str(tmp_path / "c"))
    want = bars.time_bars(ticks)
    last = ticks.agg(F.max(F.unix_seconds("timestamp"))).first()[0]
    want = want.where(F.unix_seconds("timestamp") + 900 <= last - 20).select(*got.columns)
    assert got.count() == want.count() > 50
    r = lambda d: d.select("instrument", "timestamp", "open", "close", F.round("volume", 6).alias("v"), "deal_count")
    assert r(got).exceptAll(r(want)).count() == 0


def long_tape(spark, path, n, per_time):
    """n deals of two instruments as an events table, so many of them at each time, a time every 40 s; not in the order of time."""
    at = F.floor(F.col("id") / per_time)
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + 40 * at).alias("ts"), (F.col("id") % 7).alias("user_id"),
        F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), (10.0 + F.col("id") % 13).alias("value"), F.format_string('{"k": %d}', F.col("id") % 90).alias("props"))
    rows.orderBy(F.xxhash64("event_id")).write.parquet(f"{path}/events.parquet")
    return str(path)


def runs_of(spark, query, folder):
    """What a streaming query returns, and its micro-batches."""
    from pathlib import Path

    from barloom.plans import QUERIES

    before = set(Path(bars.shared_dir(spark)).glob("ck-*"))
    got = QUERIES[query](spark, folder)
    made = set(Path(bars.shared_dir(spark)).glob("ck-*")) - before
    return got, sum(f.name.isdigit() for d in made for f in (d / "commits").iterdir())


def test_stream_bars_of_a_longer_tape_take_no_more_batches(spark, tmp_path):
    """A run over an arrival is one batch and one that closes what the watermark passed; equal times, also across files, lose nothing."""
    folder = long_tape(spark, tmp_path, 90_000, 3)
    got, batches = runs_of(spark, "REL-24", folder)
    assert 2 < batches <= 2 * 8
    ticks = bars.deals(spark, folder)
    last = ticks.agg(F.max(F.unix_seconds("timestamp"))).first()[0]
    want = bars.time_bars(ticks).where(F.unix_seconds("timestamp") + 900 <= last - 20)
    r = lambda d: d.select("instrument", F.col("timestamp").cast("timestamp_ntz").alias("t"), F.round("open", 4).alias("o"), F.round("close", 4).alias("c"), F.round("volume", 4).alias("v"), "deal_count")
    assert got.count() == want.count() > 2000 and r(got).exceptAll(r(want)).count() == 0


def test_stream_event_bars_of_a_longer_tape_take_no_more_batches(spark, tmp_path):
    """Bars and late deals are those of one pass over each instrument's whole tape, wherever it was cut into arrivals."""
    folder = long_tape(spark, tmp_path, 90_000, 3)
    got, batches = runs_of(spark, "SRC-15", folder)
    assert 2 < batches <= 2 * 8
    want = []
    for name, rows in bars.deals(spark, folder).toPandas().sort_values(["timestamp", "sequence_id"]).groupby("instrument"):
        last, start, volume, n, day = None, None, 0.0, 0, None
        for t, price, size in zip(rows["timestamp"], rows["price"], rows["size"]):
            if last is not None and t <= last:
                want.append((name, t, price, size, 1, "late"))
                continue
            if n and t.date() != day:
                want.append((name, start, close, volume, n, "partial"))
                volume, n = 0.0, 0
            start, day = (start, day) if n else (t, t.date())
            last, close, volume, n = t, price, volume + size, n + 1
            if volume >= 1000.0:
                want.append((name, start, close, volume, n, "bar"))
                volume, n = 0.0, 0
    rows = got.toPandas()
    assert {"bar", "late", "partial"} == set(rows["kind"])
    assert sorted(rows.itertuples(index=False, name=None)) == sorted(want)


def test_features_are_causal(spark, sf):
    b = bars.bars_daily(spark, sf)
    cut = F.lit(dt.datetime(1997, 1, 1)).cast("timestamp")
    f = lambda d: features.volume_features(features.return_features(features.with_returns(d))).where(F.col("timestamp") <= cut).select("instrument", "timestamp", "return_4", "volume_z")
    changed = b.withColumns({c: F.when(F.col("timestamp") > cut, F.col(c) * 2).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    assert f(b).exceptAll(f(changed)).count() == 0


def test_chunks_equal_whole_series(spark, sf):
    from barloom.operators.chunks import in_chunks

    base = features.with_returns(bars.bars_daily(spark, sf))
    f = lambda d: features.volume_features(features.return_features(d))
    cols = ["instrument", "timestamp", "return_16", "volume_z", "volume_change"]
    r = lambda d: d.select("instrument", "timestamp", *[F.round(c, 9).alias(c) for c in cols[2:]])
    whole, parts = r(f(base)), r(in_chunks(base, f, 60, 200))
    assert parts.count() == whole.count() and parts.exceptAll(whole).count() == 0


def falling(n=120, loss=0.005):
    """Long all the way while every bar loses a little; windows of ten bars, one session."""
    open_ = 100 * (1 - loss) ** np.arange(n + 2)
    a = {k: np.zeros(n) for k in folds.SIM_COLUMNS}
    return a | {"er": np.full(n, 1.0), "sigma": np.full(n, 0.5), "sigma_ref": np.full(n, 0.5), "log_close": np.log(open_[:n]), "open_next": open_[:n], "open_next2": open_[1 : n + 1], "session": np.zeros(n),
                "window": np.arange(n) // 10.0, "stress_p": np.zeros(n)}


def test_drawdown_adds_up_over_windows():
    """A loss spread over windows halts as it would in one; the next window lifts the halt, and only that moves the peak."""
    p = folds.scenario(drawdown_halt=0.10)
    spread, _ = folds.simulate(falling(), p)
    whole, _ = folds.simulate(falling() | {"window": np.zeros(120)}, p)
    first = int(np.argmax(spread["exposure"] == 0))
    assert first == int(np.argmax(whole["exposure"] == 0)) > 0 and 0.89 < whole["equity"][-1] < 0.901
    assert (whole["exposure"][first:] == 0).all()
    lifted = 10 * (first // 10 + 1)
    assert (spread["exposure"][first:lifted] == 0).all() and spread["exposure"][lifted] > 0
    again = lifted + int(np.argmax(spread["exposure"][lifted:] == 0))
    assert again - lifted >= first - 1  # a full new drawdown from where the halt ended


def test_last_position_ends_on_the_last_usable_row():
    for delay in (0, 2):
        _, closed = folds.simulate(falling(), folds.scenario(delay=delay, max_holding=10_000))
        assert closed[-1][1] == 120 - delay - 1 and closed[-1][-1] == "end"


def test_fixed_costs_replace_modelled_ones():
    a = sim_input()
    free, _ = folds.simulate(a, folds.scenario(cost_bps=0.0))
    dear, _ = folds.simulate(a, folds.scenario(cost_bps=50.0))
    assert free["cost_bar"].sum() == 0 and np.allclose(dear["cost_bar"], np.abs(np.diff(dear["exposure"], prepend=0.0)) * 0.0025)


def test_hidden_states_know_the_training_block_only(spark, sf):
    """What comes after the training block changes no fitted number and no earlier state."""
    from barloom.plans import QUERIES
    from barloom.plans import decisions as D

    got = QUERIES["FEA-16"](spark, sf).where("instrument = 'A'").orderBy("timestamp").toPandas()
    rows = features.hmm_observations(features.with_returns(bars.bars_daily(spark, sf))).where("instrument = 'A'").orderBy("timestamp").select(*D.OBS).toPandas().to_numpy(float)
    cut = int(len(rows) * D.TRAINING)
    m = folds.GaussianHMM().fit(rows[:cut])
    rows[cut:] += 1.0
    assert np.allclose(got[["p0", "p1", "p2"]].to_numpy()[:cut], m.filter(rows)[:cut], atol=1e-6)


def test_numbered_rows(spark, sf):
    from barloom.operators.chunks import numbered

    got = numbered(bars.bars_15m(spark, sf)).select("instrument", "timestamp", "_row").toPandas().sort_values(["instrument", "timestamp"])
    assert all(g["_row"].tolist() == list(range(len(g))) for _, g in got.groupby("instrument"))


def test_chunked_features_equal_whole_series(spark, sf):
    base = bars.bars_daily(spark, sf).withColumn("log_close", F.log("close"))
    whole, parts = (features.fractional_features(base, chunk).toPandas().sort_values(["instrument", "timestamp"]).reset_index(drop=True) for chunk in (50_000, 300))
    assert len(whole) == len(parts) and np.allclose(whole[features.FRACTIONAL_NAMES].to_numpy(float), parts[features.FRACTIONAL_NAMES].to_numpy(float), atol=1e-9, equal_nan=True)
    assert whole["fd_050_z"].notna().sum() > 1000


def test_bar_ends():
    """Against the builder that takes one event at a time."""
    rng = np.random.default_rng(5)
    for kind in ("volume", "dollar", "tick"):
        price, size = rng.random(700) + 1, rng.integers(1, 40, 700).astype(float)
        b = folds.BarBuilder(kind, 300.0)
        made = [x for k in range(700) for x in b.push(k, price[k], size[k], "s")] + [b.flush()]
        ends = np.cumsum([x[7] for x in made if x])
        assert folds.bar_ends({"volume": size, "dollar": price * size, "tick": np.ones(700)}[kind], 300.0).tolist() == ends.tolist()
    assert folds.bar_ends(np.ones(5), 5.0).tolist() == [5]


def test_gate_ladder():
    good = {n: {">": t + 1, ">=": t, "<": t - 0.01, "<=": t}[op] for n, _, t, op in gates.FULL_GATES}
    assert len(gates.FULL_GATES) == 21 and gates.evaluate(good, gates=gates.FULL_GATES)[1] == "PAPER ELIGIBLE"
    closed = {k: v for k, v in good.items() if not k.startswith("holdout")}
    rows, rung = gates.evaluate(closed, gates=gates.FULL_GATES)
    assert rung == "VALIDATED CANDIDATE" and sum(p is None for *_, p in rows) == 3
    assert gates.evaluate(good | {"collapsed": 1}, gates=gates.FULL_GATES)[1] == "CANDIDATE"
    assert gates.evaluate(good, synthetic=True, gates=gates.FULL_GATES)[1].startswith("EXPERIMENTAL")


def engine_rows(n=420, seed=7):
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, n)))
    open_ = np.r_[100.0, close[:-1]]
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=k) for k in range(n)]
    rows = [("A", at[k], open_[k], max(open_[k], close[k]) * 1.001, min(open_[k], close[k]) * 0.999, close[k], rng.normal(0, 0.01), 0.004, 0.004, 4e-4, 0.1, 2e-4, 0.002, float(k // 24)) for k in range(n)]
    bad = list(rows[300])
    bad[3] = bad[4] / 2  # high below low
    rows[300] = tuple(bad)
    return [(*r[:2], *map(float, r[2:])) for r in rows]


def test_engine(spark, tmp_path):
    """Accounting, warm-up, causality, a bar out of shape, and the stream's rows equal to the batch's."""
    from barloom.operators import engine

    schema = "instrument string, timestamp timestamp, " + ", ".join(f"{c} double" for c in engine.INPUTS)
    bars_ = spark.createDataFrame(engine_rows(), schema)
    got = engine.run_engine(bars_).toPandas().sort_values("timestamp").reset_index(drop=True)
    assert (got.status[:200] == "INITIALIZING").all() and got.status[300] == "REJECTED" and (got.ordered[:199] == 0).all() and (got.filled != 0).sum() > 20
    ok = got[got.status != "REJECTED"].reset_index(drop=True)
    paid = (ok.filled * ok.fill_price.fillna(0)).cumsum() + (ok.filled.abs() * ok.fill_price.fillna(0) * engine.COMMISSION).cumsum()
    assert np.allclose(ok.cash, engine.CAPITAL - paid) and np.allclose(ok.units, ok.filled.cumsum()) and np.allclose(ok.filled[1:], ok.ordered[:-1])
    part = engine.run_engine(bars_.where(F.col("timestamp") < dt.datetime(2024, 1, 14))).toPandas().sort_values("timestamp").reset_index(drop=True)
    assert part.equals(got[: len(part)])
    days = bars_.withColumn("d", F.dayofmonth("timestamp"))
    for lo, hi in ((1, 6), (7, 12), (13, 31)):
        days.where(F.col("d").between(lo, hi)).drop("d").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed = jobs.collect_stream(engine.stream_engine(stream), "engine_test", str(tmp_path / "c")).toPandas().sort_values("timestamp").reset_index(drop=True)
    assert len(streamed) == len(got) and (streamed.status == got.status).all() and np.allclose(streamed.equity, got.equity, equal_nan=True)


def test_engine_halts():
    """A fall of more than a tenth halts until the window ends; while halted only what flattens is ordered."""
    from barloom.operators import engine

    s, rows, price = engine.State(), [], 100.0
    for k in range(499):
        before, price = price, price * (0.99 if 200 < k < 230 else 1.0)
        bar = {"open": before, "high": max(before, price), "low": min(before, price), "close": price, "er": 0.05, "sigma": 0.05, "sigma_ref": 0.05, "cost": 4e-4, "stress_p": 0.0, "relative_spread": 0.0, "range_rel": 0.0, "day": k / 1.0}
        rows.append(engine.on_bar(s, float(k), bar))
    status = [r[0] for r in rows]
    first = status.index("HALTED")
    assert 200 < first < 230 and rows[first][2] == 0 and rows[first][4] <= 0 and rows[first + 1][7] == pytest.approx(0)
    assert set(status[first:249]) == {"HALTED"} and status[251] == "RUNNING" and rows[260][7] > 0


def scans_of(spark, table, run):
    """How often the jobs of run() read all columns of a table's files that they need: its scans in executed plans."""
    seen, read = [], bars.table

    def counted(s, sf_dir, name):
        if name != table:
            return read(s, sf_dir, name)
        mark = spark.sparkContext.accumulator(0)
        seen.append((mark, read(s, sf_dir, name).count()))
        schema = read(s, sf_dir, name).schema

        def passed(batches):
            for b in batches:
                mark.add(b.num_rows)
                yield b

        return read(s, sf_dir, name).mapInArrow(passed, schema)

    bars.table = counted
    try:
        out = run()
        out.collect()
    finally:
        bars.table = read
    return sum(m.value / n for m, n in seen)


@pytest.mark.parametrize("query", ["MOD-02", "API-01-engine"])
def test_bars_of_a_query_are_made_once(spark, sf, query):
    """Fits, branches and stages read stored bars: line items are read once, not once for each of them."""
    from barloom.plans import QUERIES

    assert scans_of(spark, "lineitem", lambda: QUERIES[query](spark, sf)) == 1


def test_a_fit_passes_over_stored_rows(spark, sf, monkeypatch):
    """The inputs and labels of MOD-02 are made once: neither the passes of the fit nor the forecasts work the windows out again."""
    from barloom.operators import models as MO
    from barloom.plans import QUERIES

    made, plans = MO.direction, []

    class Fit:
        def __init__(self, *given):
            self.pipeline = made(*given)

        def fit(self, train):
            plans.append(train._jdf.queryExecution().optimizedPlan().toString())
            return self.pipeline.fit(train)

    monkeypatch.setattr(MO, "direction", Fit)
    out = QUERIES["MOD-02"](spark, sf)
    plans.append(out._jdf.queryExecution().optimizedPlan().toString())
    assert len(plans) == 2 and not any("Window" in p for p in plans) and out.count() == 3


def test_bars_are_not_kept_between_queries(spark, sf):
    with bars.made_once():
        first = bars.bars_daily(spark, sf)
        assert first.inputFiles() == bars.bars_daily(spark, sf).inputFiles()
    with bars.made_once():
        assert bars.bars_daily(spark, sf).inputFiles() != first.inputFiles()
    assert bars.bars_daily(spark, sf).exceptAll(first).isEmpty() and first.exceptAll(bars.bars_daily(spark, sf)).isEmpty()
