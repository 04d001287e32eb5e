"""Queries do the whole job: every instrument, every row, every variant."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import training as T
from barloom.plans import QUERIES, research
from barloom.sources import bars


def series(spark, sf, name):
    return T.Series(research.training_rows(spark, sf).where(F.col("instrument") == name).toPandas())


@pytest.fixture(scope="module")
def names(spark, sf):
    return {r.instrument for r in bars.bars_daily(spark, sf).select("instrument").distinct().collect()}


def test_adverse_model_sees_no_later_rows(spark, sf):
    s = series(spark, sf, "A")
    rows = np.arange(len(s.bars))
    before = T.evaluate(s, rows, T.FULL)[0]
    cut = s.bars[int(len(rows) * 0.7)]
    s.a["r_fill"][cut:] += 1.0
    after = T.evaluate(s, rows, T.FULL)[0]
    assert [r["residual_std"] for r in before[:3]] == [r["residual_std"] for r in after[:3]] and before[4]["residual_std"] != after[4]["residual_std"]


@pytest.mark.parametrize("key", ["STA-01", "STA-02", "STA-03", "MOD-04", "MOD-18"])
def test_statistics_of_each_instrument(spark, sf, names, key):
    rows = QUERIES[key](spark, sf).groupBy("instrument").count().collect()
    assert {r.instrument for r in rows} == names and len({r["count"] for r in rows}) == 1


def test_draws_equal_those_of_one_series(spark, sf):
    from barloom.operators import stats
    from barloom.plans.decisions import prescribed

    rows = prescribed(spark, sf)
    pnl = rows.where("instrument = 'N'").orderBy("timestamp").toPandas()["pnl"].to_numpy()
    mine = stats.draws_by_key(rows, "pnl", "timestamp", stats.block_draw, stats.BLOCK, n=20).where("instrument = 'N'").drop("instrument").orderBy("draw").collect()
    assert np.allclose(np.array(mine, float), np.array(stats.block_bootstrap(spark, pnl, n=20).orderBy("draw").collect(), float))


def test_folds_and_windows_reach_the_last_row(spark, sf):
    from barloom.operators import labels

    df = bars.bars_daily(spark, sf)
    count = {r.instrument: r["count"] for r in df.groupBy("instrument").count().collect()}
    got = QUERIES["LAB-03-instruments"](spark, sf).collect()
    for name, n in count.items():
        want = {(k, p): v for k, t, a, b in labels.folds(n) for p, v in (("train", t), ("validation", b - a))}
        assert {(r.fold, r.part): r.n for r in got if r.instrument == name} == want
    assert QUERIES["JOI-04-instruments"](spark, sf).count() == sum(n - 300 for n in count.values())


def test_every_variant(spark, sf, names):
    got = {key: QUERIES[key](spark, sf).collect() for key in ("SAN-01-refits", "ABL-01", "ABL-03-inputs", "BAS-01-paths", "STR-02")}
    per = {key: {i: [r for r in rows if r.instrument == i] for i in names} for key, rows in got.items()}
    assert all({len(v) for v in per[key].values()} == {n} for key, n in {"SAN-01-refits": 27, "ABL-01": 2, "ABL-03-inputs": 33, "BAS-01-paths": 23, "STR-02": 25}.items())
    for rows in per["SAN-01-refits"].values():
        net = {r.scenario: r.net for r in rows}
        assert net["zero_cost"] >= net["strategy"] >= net["double_cost"] and len(set(net.values())) > 10
