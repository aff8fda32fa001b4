"""Weights of agreement between records, fitted without labels.

Candidate pairs are compared field by field into small levels. Pairs are a mixture of
matches and others; expectation maximization over the counts of all patterns of levels
gives how often each level occurs among either, and the logarithm of their ratio is
the weight of the level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs that the starting shares count as, so that few data move them little.
PSEUDO = 30.0
SETTLED = 1e-5
MOST_STEPS = 5000


@dataclass(frozen=True)
class Field:
    """A compared field: shares of its levels among matches and among other pairs, to start from."""

    name: str
    matching: tuple[float, ...]
    other: tuple[float, ...]


@dataclass(frozen=True)
class Weights:
    prior: float
    levels: dict[str, tuple[float, ...]]

    def log_odds(self) -> Column:
        return F.lit(self.prior) + self.of(list(self.levels))

    def of(self, names: Sequence[str]) -> Column:
        """Sum of the weights of these fields' levels; an unknown (null) level weighs nothing."""
        def one(name: str) -> Column:
            table = F.array(*[F.lit(float(w)) for w in self.levels[name]])
            return F.coalesce(F.get(table, F.col(name)), F.lit(0.0))

        return reduce(lambda a, b: a + b, map(one, names), F.lit(0.0))


def fit(pairs: DataFrame, fields: Sequence[Field], matching: float = 0.1) -> Weights:
    """Weights from ``pairs`` with a column of levels (0 to n - 1, or null) for each field.

    ``matching`` is the share of matches to start from. A column ``n``, if there is one, tells how many pairs a row stands for. All pairs are counted, in Spark; what reaches the driver is one row per pattern of
    levels, of which there are at most the product of the levels.
    """
    names = [f.name for f in fields]
    rows = pairs.groupBy(*names).agg((F.sum("n") if "n" in pairs.columns else F.count("*")).alias("n")).collect()
    levels = np.array([[-1 if r[c] is None else r[c] for c in names] for r in rows], int).reshape(len(rows), len(names))
    n = np.array([r["n"] for r in rows], float)
    start = [(np.array(f.matching) / sum(f.matching), np.array(f.other) / sum(f.other)) for f in fields]
    m, u, share = [s[0] for s in start], [s[1] for s in start], matching
    for _ in range(MOST_STEPS):
        odds = np.full(len(rows), np.log(share / (1 - share)))
        for i in range(len(fields)):
            known = levels[:, i] >= 0
            odds[known] += np.log(m[i] / u[i])[levels[known, i]]
        match = n / (1 + np.exp(-np.clip(odds, -60, 60)))
        new_m, new_u = [], []
        for i, (m0, u0) in enumerate(start):
            known = levels[:, i] >= 0
            count = lambda w: np.bincount(levels[known, i], w[known], minlength=len(m0))  # noqa: B023, E731
            yes, no = count(match) + PSEUDO * m0, count(n - match) + PSEUDO * u0
            new_m.append(yes / yes.sum())
            new_u.append(no / no.sum())
        share = (match.sum() + matching * PSEUDO) / (n.sum() + PSEUDO)
        moved = max(np.abs(a - b).max() for a, b in zip(m + u, new_m + new_u))
        m, u = new_m, new_u
        if moved < SETTLED:
            break
    else:
        raise RuntimeError(f"weights still move by {moved} after {MOST_STEPS} steps")
    return Weights(float(np.log(share / (1 - share))), {f.name: tuple(np.log(a / b).tolist()) for f, a, b in zip(fields, m, u)})
