"""A label model: votes of noisy labellers on a two-class question, reliabilities by expectation-maximisation.

It works on counts of vote patterns, of which there are at most 3 ** labellers, so the corpus is counted in Spark and
only the patterns come here. A vote is '+' (case), '-' (no case) or '0' (abstains).
"""

from __future__ import annotations

import numpy as np

_AT = {"-": -1, "0": 0, "+": 1}


def posteriors(counts: dict[str, int], prior: float = 0.1, rounds: int = 50, trust: float = 4.0, most_cases: float = 0.6) -> dict[str, float]:
    """Probability of a case for each vote pattern.

    Reliabilities start from votes that are right more often than not and are held there by pseudo-counts in
    proportion to the data (trust as odds), so the classes cannot change places. An abstaining labeller says nothing
    about the class. most_cases bounds the share of cases.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    votes = np.array([[_AT[v] for v in p] for p in patterns])
    yes, no = (votes > 0).astype(float), (votes < 0).astype(float)
    n = np.array([counts[p] for p in patterns], dtype=float)
    post = 1 / (1 + np.exp(-2.0 * (votes.sum(axis=1) - 0.5)))
    share = prior
    for _ in range(rounds):
        said = {}  # for each class the probability that a labeller which votes says "case"
        for c, w in ((1, post * n), (0, (1 - post) * n)):
            pseudo = max(4.0, 0.05 * w.sum()) / (1 + trust)
            y, o = w @ yes + pseudo * (trust if c else 1.0), w @ no + pseudo * (1.0 if c else trust)
            said[c] = y / (y + o)
        share = min(most_cases, max(1e-4, float((post * n).sum() + 1) / (n.sum() + 2 / max(prior, 1e-6))))
        log = np.log(share) - np.log1p(-share) + yes @ (np.log(said[1]) - np.log(said[0])) + no @ (np.log1p(-said[1]) - np.log1p(-said[0]))
        new = 1 / (1 + np.exp(-np.clip(log, -50, 50)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return dict(zip(patterns, post.tolist()))


def best_cutoff(cases: list[tuple[float, int, bool]], least: float = 0.3, most: float = 0.9) -> float:
    """The cutoff in the given range with the best F1 over known cases (posterior, how many, is a case)."""
    true = sum(n for _, n, y in cases if y)
    best, cut = -1.0, 0.5
    for t in sorted(np.linspace(least, most, 25), key=lambda t: abs(t - 0.5)):
        hit = sum(n for p, n, y in cases if y and p >= t)
        said = sum(n for p, n, _ in cases if p >= t)
        f1 = 2 * hit / max(said + true, 1)
        if f1 > best + 1e-9:
            best, cut = f1, float(t)
    return cut
