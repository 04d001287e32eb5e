"""Halts that retrains drive: failures of the fractional edge on samples of their own, and drawdown halts that an accepted model lifts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from barloom.sources.bars import KEY

#: fixed value: failures in a row that halt
TO_HALT = 3


@dataclass
class RetrainHalts:
    """State over the retrains of one instrument.

    A failure is a difference to the baseline that isn't above 0. It counts only if its sample begins behind the sample of the last
    counted failure: newest rows overlap from one retrain to the next, and one bad stretch would else count again and again. One
    success clears the failures and the halt."""

    to_halt: int = TO_HALT
    failures: int = 0
    last_end: float | None = None
    edge_halted: bool = False
    drawdown_halted: bool = False

    def record(self, accepted: bool, delta: float | None, start: float | None = None, end: float | None = None) -> str:
        """What the retrain did: success, failure or repeat. An accepted model lifts a drawdown halt."""
        if accepted:
            self.drawdown_halted = False
        if delta is not None and math.isfinite(delta) and delta > 0:
            self.failures, self.last_end, self.edge_halted = 0, None, False
            return "success"
        if start is not None and self.last_end is not None and start <= self.last_end:
            return "repeat"
        self.failures, self.last_end = self.failures + 1, end
        self.edge_halted |= self.failures >= self.to_halt
        return "failure"


HALTS = f"{KEY} string, retrain long, outcome string, failures int, edge_halted boolean, drawdown_halted boolean"


def retrain_halts(retrains: DataFrame, to_halt: int = TO_HALT) -> DataFrame:
    """HALTS after each retrain (instrument, retrain, accepted, delta, start, end, drawn): one ordered pass over an instrument's
    retrains. drawn: the equity has fallen far enough since the retrain before to arm the drawdown halt."""
    names = [x.split()[0] for x in HALTS.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state, out = RetrainHalts(to_halt), []
        for r in pdf.sort_values("retrain").itertuples():
            state.drawdown_halted |= bool(r.drawn)
            out.append((r.instrument, r.retrain, state.record(bool(r.accepted), r.delta, r.start, r.end), state.failures, state.edge_halted, state.drawdown_halted))
        return pd.DataFrame(out, columns=names)

    return retrains.select(KEY, "retrain", "accepted", "delta", "start", "end", "drawn").groupBy(KEY).applyInPandas(run, HALTS)
