"""Document quality without labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer on the posteriors."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh

DIM, SAMPLE, EPOCHS, SEED = 1 << 12, 6000, 60, 3
SYMBOL, RUN = re.compile(r"[^\w\s]"), re.compile(r"(.)\1+", re.S)
#: Fixed list: frequent function words of English, French, German and Spanish.
STOP = frozenset("the of and to in a is that it for was on with be as by at this are from de la le les des et un une que est pour dans sur der die das und den von zu im mit sich ein eine auf nicht el los las en y del se por con para su no".split())
LABELLERS = ("symbols", "capitals", "separators", "one_word", "repeats", "function_words", "sentences")


class Kinds(dict):
    """Code point -> the kind of character it is, for str.translate; others than letters and digits stay."""

    def __missing__(self, c: int) -> str:
        s = chr(c)
        got = self[c] = "X" if s.isupper() else "x" if s.isalpha() else "0" if s.isdigit() else s
        return got


class Words(dict):
    """Word -> 32 * hashed shape + flags (symbols at the end, all capitals, no letter, end of a clause, function word).

    Words and shapes are remembered, but for very long ones, so that both memories are bounded; all are taken whole.
    """

    most, longest = 200_000, 64

    def __init__(self):
        super().__init__()
        self.kinds, self.shapes = Kinds(), {}

    def shape(self, raw: str) -> int:
        letters = raw.count("x") + raw.count("X")
        flags = (len(raw) > 1 and SYMBOL.match(raw[-1]) is not None and SYMBOL.match(raw[-2]) is not None, letters > 1 and "x" not in raw, letters == 0, raw[-1] in ".,;:?!" and (len(raw) < 2 or raw[-2] not in ".,;:?!"))
        short = RUN.sub(r"\1\1", raw)
        return 32 * (zlib.crc32(short.encode("utf-8", "surrogatepass")) % (DIM - 8)) + sum(f << k for k, f in enumerate(flags))

    def __missing__(self, w: str) -> int:
        raw = w.translate(self.kinds)
        got = self.shapes.get(raw)
        if got is None:
            got = self.shape(raw)
            if len(raw) <= self.longest:
                if len(self.shapes) >= self.most:
                    self.shapes.clear()
                self.shapes[raw] = got
        if w.rstrip(".,;:!?").lower() in STOP:
            got += 16
        if len(w) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[w] = got
        return got


def describe(text: str, words: Words) -> tuple[str, dict[int, float]]:
    """The labellers' votes (good 2, none 1, bad 0, as a string of digits) and the hashed features."""
    w = text.split()
    n = len(w)
    if not n:
        return "1" * len(LABELLERS), {}
    codes, counts = np.unique(np.fromiter(map(words.__getitem__, w), np.int64, n), return_counts=True)
    symbols, capitals, separators, ends, stops = (float(counts[(codes >> k & 1) == 1].sum()) / n for k in range(5))
    h = np.fromiter(map(hash, w), np.int64, n).view("u8")
    ordered = np.sort(h)
    top = float(np.diff(np.concatenate([[0], np.nonzero(ordered[1:] != ordered[:-1])[0] + 1, [n]])).max()) / n
    runs = float((h[1:] == h[:-1]).sum()) / n
    triples = 1.0
    if n > 4:
        t = np.sort((h[:-2] * np.uint64(3) + h[1:-1]) * np.uint64(5) + h[2:])
        triples = float(1 + (t[1:] != t[:-1]).sum()) / (n - 2)
    vote = lambda bad, good: "0" if bad else "2" if good else "1"
    long = n >= 8
    votes = (
        vote(symbols > 0.25, symbols < 0.02),
        vote(capitals > 0.4, capitals < 0.1),
        vote(separators > 0.2, separators < 0.02),
        vote(long and (top > 0.3 or runs > 0.2), top < 0.15),
        vote(long and triples < 0.5, n > 20 and triples > 0.8),
        vote(long and stops < 0.02, stops > 0.1),
        vote(n > 20 and ends < 0.005, ends > 0.02),
    )
    shapes, first = np.unique(codes >> 5, return_index=True)
    sums = np.add.reduceat(counts, first)
    out = dict(zip(shapes.tolist(), (np.log1p(sums) / np.log1p(n)).tolist(), strict=True))
    out |= {DIM - 8: symbols, DIM - 7: capitals, DIM - 6: separators, DIM - 5: top if long else 0.0, DIM - 4: runs, DIM - 3: 1 - triples, DIM - 2: stops, DIM - 1: ends}
    return "".join(votes), out


def fit_labellers(patterns: dict[str, int], rounds: int = 200, prior: float = 0.7) -> tuple[dict[str, float], np.ndarray]:
    """EM over vote patterns with their counts: P(good) per pattern, and per labeller P(vote | class) as (labeller, class, vote).

    Labellers are taken as independent given the class; the start is the share of good votes, so that class 1 is good.
    """
    votes = np.array([[int(c) for c in p] for p in patterns])
    weight = np.array(list(patterns.values()), float)
    bad, good = (votes == 0).sum(axis=1), (votes == 2).sum(axis=1)
    p = (good + 2 * prior) / (good + 3 * bad + 2)
    for _ in range(rounds):
        share = float((weight * p).sum() / weight.sum())
        share = min(max(share, 1e-6), 1 - 1e-6)
        table = np.stack([np.stack([np.stack([((votes[:, k] == v) * weight * q).sum() + 1.0 for v in range(3)]) / ((weight * q).sum() + 3.0) for q in (1 - p, p)]) for k in range(votes.shape[1])])
        logs = np.log([1 - share, share]) + sum(np.log(table[k][:, votes[:, k]]).T for k in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return dict(zip(patterns, p.tolist(), strict=True)), table


def fit_scorer(rows: list[tuple[list[int], list[float], float]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the intercept) of a logistic scorer on posterior labels; a vote that is sure weighs more."""
    weights = np.zeros(DIM + 1)
    if not rows:
        weights[DIM] = 1.0
        return weights
    x = np.zeros((len(rows), DIM + 1), "f4")
    x[:, DIM] = 1
    for k, (i, v, _) in enumerate(rows):
        x[k, i] = v
    y = np.array([r[2] for r in rows])
    sure = np.abs(2 * y - 1)
    balance = np.where(y > 0.5, 1.0, min(5.0, max(1.0, (y > 0.5).sum() / max(1, (y <= 0.5).sum())) ** 0.5))
    used = np.nonzero((x != 0).any(axis=0))[0]
    x, w, g2 = x[:, used], np.zeros(len(used)), np.full(len(used), 1e-8)
    for _ in range(epochs * 5):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ ((p - y) * sure * balance) / len(rows) + 1e-5 * w
        g2 += g * g
        w -= 0.3 * g / np.sqrt(g2)
    weights[used] = w
    return weights


def described(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a struct column of each text's votes, features, and place in the order of sampling; written, so that texts are read once."""

    @F.pandas_udf("votes string, i array<int>, v array<float>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = Words()
        for batch in texts:
            got = [describe(t, words) for t in batch]
            yield pd.DataFrame({"votes": [v for v, _ in got], "i": [list(f) for _, f in got], "v": [[float(x) for x in f.values()] for _, f in got]})

    text = F.coalesce("text", F.lit(""))
    return docs.withColumn(name, F.struct(of(text).alias("d"), F.xxhash64(text, F.col("doc_id").cast("long")).alias("h")))


def fit(table: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], np.ndarray] | None:
    """Posterior per vote pattern, and the scorer's weights, from described documents (votes, i, v, h); None without rows."""
    patterns = {r["votes"]: r["n"] for r in table.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not patterns:
        return None
    patterns = dict(sorted(patterns.items()))
    posterior, _ = fit_labellers(patterns)
    # A bound on the hash leaves some more than the sample, so that few rows are sorted.
    share = min(1.0, 1.2 * sample / sum(patterns.values()))
    chosen = table if share >= 1 else table.where(F.col("h") < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))))
    rows = chosen.orderBy("h", "votes").limit(sample).collect()
    return posterior, fit_scorer([(r["i"], r["v"], posterior[r["votes"]]) for r in rows])


def grade(weights: np.ndarray):
    """A UDF of features (i, v): the scorer's probability per text; 0 without features."""

    @F.pandas_udf("double")
    def of(i: pd.Series, v: pd.Series) -> pd.Series:
        z = np.array([float(weights[a] @ b) + weights[DIM] if len(a) else -np.inf for a, b in zip(i, v, strict=True)])
        return pd.Series(np.where(np.isneginf(z), 0.0, 1 / (1 + np.exp(-np.clip(z, -500, 500)))), dtype="float64")

    return of


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): votes, posterior of the label model, score of the scorer, and accepted.

    Every text is read once, whole, whatever its length; its votes and features are written. Votes of all documents are
    counted per pattern (at most 3 ** labellers of them, so bounded); EM over these counts estimates each labeller's
    accuracy. The scorer is trained on the posteriors of at most ``sample`` documents, those with the smallest hash of text
    and id, and then scores every document. Null, empty and blank texts have no votes; they get the posterior of that
    pattern, score 0 and are not accepted. Equal texts are judged equally; rows of one or of null id are judged each; no
    rows give no rows; other columns are not looked at.
    """
    table = cut(described(docs.select(F.col("doc_id").cast("long"), "text"), "_").select("doc_id", "_.d.*", "_.h"), "described")
    model = fit(table, sample)
    if model is None:
        return table.select("doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    posterior, weights = model
    p = F.create_map(*[F.lit(x) for pair in posterior.items() for x in pair])
    return table.select("doc_id", "votes", F.element_at(p, F.col("votes")).alias("posterior"), grade(weights)("i", "v").alias("score")).withColumn("accepted", F.col("score") >= threshold)


def accept(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that :func:`classify` accepts; each row is judged by its own text, whatever its id."""
    name = fresh("_mosaique_d", docs.columns)
    table = cut(described(docs, name), "described")
    model = fit(table.select(f"{name}.d.*", f"{name}.h"), sample)
    if model is None:
        return docs
    return table.where(grade(model[1])(f"{name}.d.i", f"{name}.d.v") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
