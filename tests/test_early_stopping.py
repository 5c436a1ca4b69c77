"""Early stopping with losses that are given: what it finds and how many rounds it fits."""

from __future__ import annotations

import pytest

from underwright.operators import tuning


def doubling(losses, first, limit, patience):
    """What the lengths 1, 2, 4 ... times ``first`` find."""
    rounds = first
    while True:
        best, stopped = tuning.patience_stop(losses[:rounds], patience)
        if stopped or rounds >= limit:
            return best, rounds
        rounds = min(limit, rounds * 2)


@pytest.mark.parametrize("limit", [50, 100, 700, 2000])
@pytest.mark.parametrize("best", [0, 60, 69, 70, 99, 130, 169, 171, 369, 371, 500, 770, 1000, 1590, 1968, 1969, 1999])
def test_early_stopping_finds_what_doubling_finds(monkeypatch, best, limit):
    losses, fitted = [abs(i - best) + 1.0 for i in range(2000)], []

    class Boosts:
        def __init__(self, rounds, *args, **kwargs):
            self.rounds = rounds

        def fit(self, train):
            fitted.append(self.rounds)
            return self

        def evaluateEachIteration(self, validation):  # noqa: N802
            return losses[: self.rounds]

        def transform(self, df):
            return self.rounds

    class Row:
        def __init__(self, rounds):
            self.rounds = rounds

        def first(self):
            return {"roc_auc": self.rounds}

    monkeypatch.setattr(tuning, "boosted", Boosts)
    monkeypatch.setattr(tuning, "positive_scores", lambda rounds: rounds)
    monkeypatch.setattr(tuning, "evaluate_at_optimum", Row)
    found = tuning.early_stopping(None, None, limit)
    at, rounds = doubling(losses, min(100, limit), limit, tuning.PATIENCE)
    assert (found["best_iteration"], found["rounds_fitted"]) == (at, rounds)
    assert found["val_auc"] == at + 1 and found["max_iterations"] == limit
    if limit == 2000:
        assert sum(fitted) <= 2500 + (at + 1 < 2000) * (at + 1)
