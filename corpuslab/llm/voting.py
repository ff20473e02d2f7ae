"""Labelling rules that vote good (1), bad (-1) or abstain (0), weighed by expectation-maximisation.

Only pattern counts are gathered: with r rules at most 3**r rows, whatever the size of the
data. Each round is one aggregation of that table; the driver sees one row of sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslab.session import materialize

VOTES = (-1, 0, 1)
ROUNDS = 25
SETTLED = 1e-4
PSEUDO_ROWS = 2.0


@dataclass(frozen=True)
class Reliability:
    """Prior of the good class and, per rule, the chance of each vote in the bad and good class."""

    prior: float
    chances: tuple[tuple[tuple[float, float], ...], ...]  # [rule][vote] -> (bad, good)

    def log_odds(self, votes: Sequence[Column]) -> Column:
        """Log odds of good against bad, given the votes of a row."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for vote, rule in zip(votes, self.chances):
            bad, _, good = (math.log(g / b) for b, g in rule)
            odds = odds + F.when(vote < 0, bad).when(vote > 0, good).otherwise(
                math.log(rule[1][1] / rule[1][0]))
        return odds

    def posterior(self, votes: Sequence[Column]) -> Column:
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-self.log_odds(votes)))

    def accuracy(self, rule: int) -> float:
        """Chance that the rule is right when it votes."""
        (low_b, low_g), _, (high_b, high_g) = self.chances[rule]
        right = self.prior * high_g + (1 - self.prior) * low_b
        return right / (right + self.prior * low_g + (1 - self.prior) * high_b)


def pattern_counts(votes: DataFrame, names: Sequence[str], weight: str | None = None) -> DataFrame:
    """Rows (or the sum of ``weight``) per combination of votes."""
    rows = F.count("*") if weight is None else F.sum(weight)
    return votes.groupBy(*names).agg(rows.cast("double").alias("_rows"))


def fit_reliability(votes: DataFrame, names: Sequence[str], prior: float = 0.8,
                    weight: str | None = None) -> Reliability:
    """Estimate class prior and rule accuracies from agreement alone.

    Starts from the number of bad votes, which rules of this kind cast seldom and with
    cause; a rule that often contradicts the others ends with little weight. ``PSEUDO_ROWS`` rows per class that agree with the rule keep all
    chances above zero, and give an empty table defined values.
    """
    patterns = materialize(pattern_counts(votes, names, weight), "vote-patterns")
    columns = [F.col(n) for n in names]
    bad_votes = sum((F.when(c < 0, 1).otherwise(0) for c in columns), F.lit(0))
    good = F.when(bad_votes == 0, 0.95).when(bad_votes == 1, 0.4).otherwise(0.05)
    before = None
    for _ in range(ROUNDS):
        sums = [F.sum(F.col("_rows")).alias("n"), F.sum(F.col("_rows") * good).alias("g")]
        for j, c in enumerate(columns):
            for v in VOTES:
                hit = F.when(c == v, F.col("_rows")).otherwise(0.0)
                sums += [F.sum(hit).alias(f"n{j}_{v}"), F.sum(hit * good).alias(f"g{j}_{v}")]
        row = {k: x or 0.0 for k, x in patterns.agg(*sums).first().asDict().items()}
        now = _estimate(row, len(columns), prior)
        if before and max(abs(a - b) for a, b in zip(_flat(now), _flat(before))) < SETTLED:
            return now
        before, good = now, now.posterior(columns)
    return before


def _estimate(row: dict, rules: int, prior: float) -> Reliability:
    n, g = row["n"], row["g"]
    share = (g + PSEUDO_ROWS * prior) / (n + PSEUDO_ROWS)
    chances = []
    for j in range(rules):
        per_vote = []
        for v in VOTES:
            agree_bad, agree_good = (0.6, 0.2, 0.2)[v + 1], (0.2, 0.2, 0.6)[v + 1]
            n_v, g_v = row[f"n{j}_{v}"], row[f"g{j}_{v}"]
            per_vote.append((
                (max(n_v - g_v, 0.0) + PSEUDO_ROWS * agree_bad) / (max(n - g, 0.0) + PSEUDO_ROWS),
                (g_v + PSEUDO_ROWS * agree_good) / (g + PSEUDO_ROWS),
            ))
        chances.append(tuple(per_vote))
    return Reliability(share, tuple(chances))


def _flat(model: Reliability) -> list[float]:
    return [model.prior, *(x for rule in model.chances for pair in rule for x in pair)]
