"""Bar validation: structural and sequence predicates, and the three-way fold over the last storable bar."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.scalars import finite
from barloom.sources.bars import KEY, TIME

TOLERANCE, MAX_JUMP, RECOVERY = 1e-12, 0.10, 13


def _reasons(pairs: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for c, r in pairs]))


def structural_reasons(instrument: str | None = None) -> Column:
    """Why a bar can't be stored, from its own columns."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    prices = [o, h, lo, c]
    missing = ~finite(o) | ~finite(h) | ~finite(lo) | ~finite(c) | ~finite(v)
    positive = F.least(*prices) <= 0
    shape = (h < F.greatest(o, c, lo) - TOLERANCE) | (lo > F.least(o, c, h) + TOLERANCE)
    pairs = [(missing, "non-finite"), (positive, "non-positive price"), (shape, "inconsistent prices"), (v < 0, "negative volume"),
        (F.col("ask") < F.col("bid"), "crossed quote")]
    if instrument is not None:
        pairs.insert(0, (F.col(KEY) != instrument, "instrument"))
    return _reasons(pairs)


def sequence_columns(bars: DataFrame, order: str, bar_seconds: int, max_jump: float = MAX_JUMP) -> DataFrame:
    """reject and halt reasons against the bar before in file order (exact where rejected bars don't follow each other)."""
    w = Window.partitionBy(KEY).orderBy(order)
    prev, prev_close = F.lag(TIME).over(w), F.lag("close").over(w)
    gap = F.unix_seconds(TIME) - F.unix_seconds(prev)
    reject = _reasons([(F.col(TIME) == prev, "duplicate"), (F.col(TIME) < prev, "backward")])
    halt = _reasons([(gap > bar_seconds, "missing bar"), (F.abs(F.log(F.try_divide(F.col("close"), prev_close))) > max_jump, "jump")])
    return bars.withColumns({"reject": reject, "halt": halt})


CHECKED = "instrument string, file_order long, status string, reason string, halted boolean"


def validate(bars: DataFrame, bar_seconds: int, max_jump: float = MAX_JUMP, recovery: int = RECOVERY) -> DataFrame:
    """status ok, halt (stored) or reject of each bar in file order; halted lasts until `recovery` clean bars in a row.

    The previous bar is the last storable one, so rejects chain: a fold in file order within each instrument."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("file_order")
        last_t, last_c, halted, clean, out = None, None, False, 0, []
        for t, c, n, bad in zip(pdf["t"], pdf["close"], pdf["file_order"], pdf["bad"], strict=True):
            status, reason = "ok", ""
            if bad:
                status, reason = "reject", bad
            elif last_t is not None and t <= last_t:
                status, reason = "reject", "duplicate" if t == last_t else "backward"
            elif last_t is not None and t - last_t > bar_seconds:
                status, reason = "halt", "missing bar"
            elif last_t is not None and abs(c / last_c - 1) >= 0 and abs(_log(c / last_c)) > max_jump:
                status, reason = "halt", "jump"
            if status != "reject":
                last_t, last_c = t, c
            if status == "ok":
                clean += 1
                halted = halted and clean < recovery
            else:
                halted, clean = True, 0
            out.append((pdf[KEY].iloc[0], n, status, reason, halted))
        return pd.DataFrame(out, columns=["instrument", "file_order", "status", "reason", "halted"])

    rows = bars.withColumn("bad", F.array_join(structural_reasons(), ",")).select(KEY, "file_order", F.unix_seconds(TIME).alias("t"),
        "close", "bad")
    return rows.groupBy(KEY).applyInPandas(fold, CHECKED)


def _log(x: float) -> float:
    import math

    return math.log(x) if x > 0 else math.inf


def stale(last_close_seconds: Column, session_open_seconds: Column, now_seconds: Column, bar_seconds: int, stale_bars: int = 2) -> Column:
    return now_seconds - F.greatest(last_close_seconds, session_open_seconds) > (stale_bars + 1) * bar_seconds
