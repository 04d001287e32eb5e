"""A research run: stages in a fixed order, a table for each, a summary, and a holdout that is opened on record only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.operators import retraining as R
from barloom.operators.metrics import ratio
from barloom.plans import gates as G
from barloom.plans.base import QUERIES, query, rolled, sql_of
from barloom.plans.metrics import PRE, pnl
from barloom.plans.research import gates_frame, ladder_frame, ladder_values, resolve_stages, training_rows
from barloom.sources.access import open_holdout
from barloom.sources.bars import fresh_path

#: the query that each stage stores
TABLES = {"walkforward": "RUN-01-windows", "baselines": "BAS-01", "cost": "STR-01", "execution_stress": "STR-02", "timing": "STR-03",
    "perturbation": "STR-04", "d_perturbation": "STR-05", "sanity": "SAN-01",
          "leakage": "SAN-03", "regimes": "AGG-07", "ablation": "ABL-01", "families": "ABL-03", "bootstrap": "STA-01",
              "reproducibility": "REP-02", "gates": "GAT-01"}


#: what a stage stores beside its table, at <stage>_more
MORE = {"baselines": "BAS-01-paths", "sanity": "SAN-01-refits", "families": "ABL-03-inputs", "d_perturbation": "STR-05-refits"}
#: stages whose table has a row for each value of a column and the instruments' rows inside it
NESTED = {"walkforward": "window", "bootstrap": "metric"}


def nested(df: DataFrame, stage: str) -> DataFrame:
    if by := NESTED.get(stage):
        df = df.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(*[c for c in df.columns if c != by]))).alias("instruments"))
    return df


def stage_table(spark: SparkSession, sf_dir: str, stage: str) -> DataFrame:
    """What a stage stores."""
    return nested(QUERIES[TABLES[stage]](spark, sf_dir), stage)


def run_research(spark: SparkSession, sf_dir: str, spec: str = "quick", run_dir: str | None = None, holdout_reason: str | None = None, forced: bool = False) -> DataFrame:
    """Runs the stages, writes <run_dir>/<stage> for each, and returns (n, stage, rows, path). The gates judge the tables written before.

    The walk leaves its own tables in <run_dir>/walk, and the holdout walk carries its last models on. With a reason the holdout is
    opened, but only after a development that is a VALIDATED CANDIDATE, or if forced: else the stage's table says why it was refused,
    and nothing is read nor logged."""
    run_dir, out, walk = run_dir or fresh_path(spark, "run"), [], None
    for n, stage in enumerate(resolve_stages(spec, open_holdout=bool(holdout_reason))):
        path = f"{run_dir}/{stage}"
        done = {s: spark.read.parquet(p) for _, s, _, p in out}
        more = {f"{s}_more": spark.read.parquet(f"{p}_more") for _, s, _, p in out if s in MORE}
        if stage == "walkforward":
            walk = R.walked(training_rows(spark, sf_dir), folder=f"{run_dir}/walk")
            nested(R.walk_table(walk), stage).write.parquet(path)
        elif stage == "holdout":
            open_stage(spark, done | more, walk, run_dir, holdout_reason, forced).write.parquet(path)
        elif stage == "gates":
            judged = {s: t for s, t in (done | more).items() if s != "holdout" or "refused" not in t.columns}
            rolled(gates_frame(spark, judged)).write.parquet(path)
            rolled(ladder_frame(spark, judged)).write.parquet(f"{path}_more")  # those of the full ladder
        else:
            stage_table(spark, sf_dir, stage).write.parquet(path)
        if stage in MORE:
            QUERIES[MORE[stage]](spark, sf_dir).write.parquet(f"{path}_more")
        out.append((n, stage, spark.read.parquet(path).count(), path))
    return spark.createDataFrame(out, "n int, stage string, rows long, path string")


def open_stage(spark: SparkSession, tables: dict[str, DataFrame], walk: dict[str, DataFrame] | None, run_dir: str, why: str, forced: bool) -> DataFrame:
    """Results of the locked bars by instrument and variant, or one row (level, refused) if development isn't good enough."""
    level = G.evaluate(ladder_values(tables), gates=G.FULL_GATES)[1]
    if walk is None:
        return spark.createDataFrame([(level, "no walk over development bars")], "level string, refused string")
    try:
        made = R.holdout_walk(walk, level, f"{run_dir}/holdout_log", why, folder=f"{run_dir}/holdout_walk", forced=forced)
    except PermissionError as e:
        return spark.createDataFrame([(level, str(e))], "level string, refused string")
    return R.summary(made["results"])


def _summary(spark, sf_dir, spec):
    return run_research(spark, sf_dir, spec).select("n", "stage", "rows")


@query("RUN-08",
    "select * from (values (0, 'walkforward', 21::bigint), (1, 'bootstrap', 4::bigint), (2, 'reproducibility', 1::bigint), (3, 'gates', 15::bigint)) t(n, stage, \"rows\")")
def run_08(spark, sf_dir):
    return _summary(spark, sf_dir, "walkforward,bootstrap,reproducibility,gates")


@query("RUN-11",
    "select * from (values (0, 'baselines', 3::bigint), (1, 'timing', 9::bigint), (2, 'sanity', 12::bigint), (3, 'leakage', 1::bigint)) t(n, stage, \"rows\")")
def run_11(spark, sf_dir):
    return _summary(spark, sf_dir, "baselines,timing,sanity,leakage")


@query("RUN-04", "select 2::bigint as entries, 'second look' as last_reason")
def run_04(spark, sf_dir):
    log = fresh_path(spark, "holdout")
    open_holdout(spark, log, "a", "first look")
    out = open_holdout(spark, log, "b", "second look")
    return out.agg(F.count("*").alias("entries"), F.max_by("why", "at").alias("last_reason"))


@query("RUN-04-holdout")
def run_04_holdout(spark, sf_dir):
    """The holdout stage after a walk alone: refused, since the other stages of development are missing."""
    paths = {r.stage: r.path for r in run_research(spark, sf_dir, "walkforward,holdout", holdout_reason="a look after a walk alone").collect()}  # a row a stage
    return spark.read.parquet(paths["holdout"])


@query("RUN-10",
    sql_of("""select instrument, w as "window", 'm' || w::bigint as candidate, last_value(case when s > 0 then 'm' || w::bigint end ignore nulls) over (partition by instrument order by w rows unbounded preceding) as deployed
 from (select instrument, w, avg(pnl) / nullif(stddev_pop(pnl), 0) as s from p group by 1, 2)""", "", PRE))
def run_10(spark, sf_dir):
    """Which model is deployed after each report: one that is rejected (here: no positive Sharpe ratio in its window) leaves the one before."""
    name = F.concat(F.lit("m"), F.col("w").cast("string"))
    s = pnl(spark, sf_dir).groupBy("instrument", "w").agg(ratio(F.avg("pnl"), F.stddev_pop("pnl")).alias("s"))
    deployed = F.last(F.when(F.col("s") > 0, name), True).over(Window.partitionBy("instrument").orderBy("w"))
    return s.select("instrument", F.col("w").alias("window"), name.alias("candidate"), deployed.alias("deployed"))


@query("ORD-05")
def ord_05(spark, sf_dir):
    """Hidden states in the order of their volatility: the ids that a fit gives are already sorted."""
    return QUERIES["FEA-18"](spark, sf_dir).orderBy("instrument", "state")


@query("API-02")
def api_02(spark, sf_dir):
    """Training: each instrument's retrain, beside the stationarity of the order that it chose."""
    tests = QUERIES["FRC-08"](spark, sf_dir).select("instrument", "d", "p_adf", "p_kpss", "n_obs")
    return QUERIES["MOD-11"](spark, sf_dir).join(tests, ["instrument", "d"], "left")


@query("API-03", "select true as identical, 0::bigint as differing")
def api_03(spark, sf_dir):
    """Two runs of the same stages, compared table by table."""
    runs = [{r.stage: r.path for r in run_research(spark, sf_dir, "walkforward,gates").collect()} for _ in range(2)]  # a row a stage
    differing = sum(not spark.read.parquet(runs[0][s]).exceptAll(spark.read.parquet(runs[1][s])).isEmpty() for s in runs[0])
    return spark.createDataFrame([(differing == 0, differing)], "identical boolean, differing long")
