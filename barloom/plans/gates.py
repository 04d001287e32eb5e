"""Acceptance gates: tri-state results in groups, and the ladder of classifications they open."""

from __future__ import annotations

# The threshold of each gate and how a value must lie to it. Yes-or-no gates are 1 or 0.
THRESHOLDS = {
    "windows": (20, ">="), "deals": (200, ">="), "net_return": (0.0, ">"), "sharpe": (1.0, ">"), "max_drawdown": (0.25, "<"),
    "profit_factor": (1.2, ">"), "positive_windows": (0.55, ">"), "production_return": (0.0, ">"), "production_sharpe": (0.0, ">"),
    "deployed": (0.5, ">="), "delta_sharpe": (0.0, ">"), "dominance": (0.5, "<="), "median_delta": (0.0, ">"),
    "positive_deltas": (0.5, ">"), "cost_break_even": (1.5, ">="), "delay_sharpe": (0.0, ">"), "profitable_at_2x": (1, ">="),
    "viable_at_plus_1": (1, ">="), "collapsed": (0, "<="), "bootstrap_low": (0.0, ">"), "p_bonferroni": (0.05, "<="),
    "destroyed_sharpe": (1.0, "<="), "sanity_failed": (0, "<="), "leaks": (0, "<="), "holdout_opened": (1, ">="),
    "holdout_return": (0.0, ">"), "holdout_sharpe": (0.0, ">"), "identical": (1, ">="),
}


def _gates(groups: dict[str, str]) -> list[tuple]:
    """(gate, group, threshold, direction) of the gates named for each group."""
    return [(name, group, *THRESHOLDS[name]) for group, names in groups.items() for name in names.split()]


#: what can be judged without a cost curve by realised fills, and the full ladder
GATES = _gates({"walk_forward": "windows net_return sharpe max_drawdown", "ablation": "delta_sharpe dominance", "stress": "cost_break_even delay_sharpe",
                "bootstrap": "bootstrap_low p_bonferroni", "sanity": "destroyed_sharpe", "leakage": "leaks", "holdout": "holdout_return holdout_sharpe", "reproducibility": "identical"})
FULL_GATES = _gates({"walk_forward": "windows deals sharpe max_drawdown profit_factor positive_windows production_return production_sharpe deployed",
                     "ablation": "median_delta positive_deltas", "stress": "profitable_at_2x viable_at_plus_1 collapsed", "bootstrap": "bootstrap_low", "sanity": "sanity_failed",
                     "leakage": "leaks", "holdout": "holdout_opened holdout_return holdout_sharpe", "reproducibility": "identical"})
LADDER = [("CANDIDATE", {"walk_forward"}), ("VALIDATED CANDIDATE", {"ablation", "stress", "bootstrap", "sanity", "leakage"}),
    ("HOLDOUT PASSED", {"holdout"}), ("PAPER ELIGIBLE", {"reproducibility"})]
_TEST = {">=": lambda v, t: v >= t, ">": lambda v, t: v > t, "<=": lambda v, t: v <= t, "<": lambda v, t: v < t}


def evaluate(values: dict, synthetic: bool = False, gates: list[tuple] = GATES) -> tuple[list[tuple], str]:
    """(gate, group, value, threshold, passed or None) of all gates, and the class: a rung needs every gate of its groups."""
    rows = [(n, g, values.get(n), float(t), None if values.get(n) is None else bool(_TEST[op](values[n], t))) for n, g, t, op in gates]
    if synthetic:
        return rows, "EXPERIMENTAL (SYNTHETIC)"
    rung = "EXPERIMENTAL"
    for name, groups in LADDER:
        if not all(passed for _, g, _, _, passed in rows if g in groups):
            break
        rung = name
    return rows, rung
