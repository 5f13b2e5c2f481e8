"""Search over column subsets: bandit, annealing, archive. Control on the driver; rows are only touched by the scorers."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

Subset = tuple[str, ...]
Score = Callable[[list[Subset]], list[float]]


class Archive:
    """Best score per subset, at most ``most`` of them."""

    def __init__(self, most: int = 30):
        self.most, self.best = most, {}

    def add(self, subset: Subset, score: float) -> None:
        s = tuple(sorted(subset))
        self.best[s] = max(score, self.best.get(s, -math.inf))
        if len(self.best) > self.most:
            del self.best[min(self.best, key=lambda k: (self.best[k], k))]

    def top(self, k: int) -> list[tuple[Subset, float]]:
        return sorted(self.best.items(), key=lambda x: (-x[1], x[0]))[:k]


def neighbours(subset: Subset, every: list[str], mode: str = "swap", least: int = 1, most: int | None = None) -> list[Subset]:
    """Subsets that differ by a swap; in mode ``full`` by an added or dropped column too, within the sizes."""
    inside, outside = list(subset), [c for c in every if c not in subset]
    found = {tuple(sorted([*(x for x in inside if x != a), b])) for a in inside for b in outside}
    if mode == "full":
        if most is None or len(inside) < most:
            found |= {tuple(sorted([*inside, b])) for b in outside}
        if len(inside) > least:
            found |= {tuple(sorted(x for x in inside if x != a)) for a in inside}
    return sorted(found)


class Memo:
    """Scores of subsets, each asked for once; the rest of a list goes to the scorer as one batch."""

    def __init__(self, score: Score, archive: Archive | None = None):
        self.score, self.known, self.archive, self.hits = score, {}, archive, 0

    def __call__(self, subsets: list[Subset]) -> list[float]:
        keys = [tuple(sorted(s)) for s in subsets]
        new = sorted({k for k in keys if k not in self.known})
        self.hits += len(keys) - len(new)
        for k, v in zip(new, self.score(new) if new else [], strict=True):
            self.known[k] = v
            if self.archive:
                self.archive.add(k, v)
        return [self.known[k] for k in keys]


def bandit(columns: list[str], reward: Score, rounds: int, k: int, red: dict, threshold: float = 0.9, beta: float = 1.5, warm: float = 0.2, seed: int = 42) -> tuple[Subset, dict]:
    """Draws subsets; a column weighs exp(-beta * share of draws it was bad in, that is below the mean of its draws) after a warm-up, and is left out where it
    is redundant to what is drawn already."""
    rng, memo = random.Random(seed), Memo(reward)
    bad, total, sums = dict.fromkeys(columns, 0), dict.fromkeys(columns, 0), dict.fromkeys(columns, 0.0)
    best: tuple[float, Subset] = (-math.inf, ())
    for t in range(rounds):
        pool, draft = list(columns), []
        while pool and len(draft) < min(k, len(columns)):
            weights = [1.0 if t < warm * rounds or not total[c] else math.exp(-beta * bad[c] / total[c]) for c in pool]
            c = rng.choices(pool, weights)[0]
            pool.remove(c)
            if all(red.get((min(c, x), max(c, x)), 0.0) <= threshold for x in draft):
                draft.append(c)
        subset = tuple(sorted(draft))
        score = memo([subset])[0]
        for c in subset:
            total[c] += 1
            sums[c] += score
            bad[c] += score < sums[c] / total[c]
        best = max(best, (score, subset))
    return best[1], {c: {"bad": bad[c], "tot": total[c]} for c in columns}


def anneal(start: Subset, columns: list[str], score: Score, iters: int = 50, hot: float = 1.0, cold: float = 1e-3, alpha: float = 0.95, mode: str = "swap", least: int = 1, most: int | None = None, rate: float | None = None, archive: Archive | None = None, seed: int = 42) -> tuple[Subset, float, dict]:
    """Annealing over subsets. Each step asks for a random neighbour, or for the best of a sample, scored as one batch."""
    rng, memo = random.Random(seed), Memo(score, archive)
    now, value = tuple(sorted(start)), memo([start])[0]
    best, t, steps = (value, now), hot, 0
    for steps in range(1, iters + 1):  # noqa: B007
        near = [s for s in neighbours(now, columns, mode, least, most) if least <= len(s) <= (most or len(columns))]
        if not near:
            break
        tried = [rng.choice(near)] if rate is None and t > 0.1 else rng.sample(near, max(1, int(len(near) * (rate or 0.3))))
        got = memo(tried)
        pick = max(range(len(tried)), key=lambda i: got[i])
        if got[pick] >= value or rng.random() < math.exp((got[pick] - value) / t):
            now, value = tried[pick], got[pick]
        best = max(best, (value, now))
        t = max(cold, alpha * t)
        if t <= cold:
            break
    return best[1], best[0], {"iters": steps, "cache_hits": memo.hits, "cache_size": len(memo.known)}
