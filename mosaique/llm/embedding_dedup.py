"""Near-duplicate embeddings by collision counts over one-dimensional projections, verified in double precision."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop

PROJECTIONS, SPREAD, RECALL, BLOCK, SEED = 16, 2.0, 0.9999, 8192, 7
#: Counters that a task holds at once, a byte each.
COUNTERS = 4 << 20


def plan(threshold: float, projections: int = PROJECTIONS, spread: float = SPREAD, recall: float = RECALL) -> tuple[float, int]:
    """Half-width of the window and the least count of collisions.

    Unit vectors of cosine ``threshold`` are sqrt(2 - 2 cosine) apart; a Gaussian projection of their difference has that
    deviation. The window takes ``spread`` deviations; the count is the largest that such a pair reaches with probability
    ``recall`` or more. Closer pairs reach it more often.
    """
    width = spread * math.sqrt(max(0.0, 2 - 2 * threshold))
    p = math.erf(spread / math.sqrt(2))
    tail, need = 0.0, projections
    for count in range(projections, -1, -1):
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        need = count
        if tail >= recall:
            break
    return width, need


@cache
def directions(dim: int, projections: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    """(dim, projections) Gaussian directions."""
    return np.random.default_rng(seed).standard_normal((dim, projections))


@cache
def lead(dim: int) -> np.ndarray:
    """The unit direction along which vectors are dealt to blocks."""
    r = directions(dim, 1, SEED + 1)[:, 0]
    return r / np.linalg.norm(r)


def unit(v) -> np.ndarray | None:
    """The vector over its norm, in doubles; None if it is null, empty or zero, or holds what is null or not finite. A large
    or tiny vector is scaled first, so that its square stays finite."""
    if v is None or not len(v):
        return None
    x = np.array([math.nan if c is None else c for c in v], "<f8")
    top = np.abs(x).max()
    if not (0 < top < math.inf):
        return None
    x = x / top
    return x / math.sqrt(float(x @ x))


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index per node 0..n-1 under the links a-b: minima pass over links, then pointers are halved."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        np.minimum.at(low, label[a], low[a])
        np.minimum.at(low, label[b], low[b])
        while True:
            jumped = low[low]
            if (jumped == low).all():
                break
            low = jumped
        if (low == label).all():
            return label
        label = low


def similar_pairs(x: np.ndarray, y: np.ndarray, threshold: float, r: np.ndarray, width: float, need: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of ``x`` and ``y`` (of i < j if ``same``) that collide in ``need`` windows and verify.

    ``y`` is sorted along every projection. The window of a row of ``x`` is then a slice of each order, of which every
    member's counter goes up by one; only pairs that reach the count have their cosine taken. What lies in few windows costs
    as many steps, and what lies in none costs nothing.
    """
    px, py = x @ r, y @ r
    order = np.argsort(py, axis=0, kind="stable")
    lo, hi = np.empty(px.shape, np.int64), np.empty(px.shape, np.int64)
    for k in range(r.shape[1]):
        line = py[order[:, k], k]
        lo[:, k], hi[:, k] = np.searchsorted(line, px[:, k] - width), np.searchsorted(line, px[:, k] + width, "right")
    orders = [np.ascontiguousarray(order[:, k]) for k in range(r.shape[1])]
    found_i, found_j = [], []
    step = max(1, COUNTERS // max(1, len(y)))
    for at in range(0, len(x), step):
        counts = np.zeros((min(step, len(x) - at), len(y)), np.uint8)
        for q, (a, b) in enumerate(zip(lo[at : at + step].tolist(), hi[at : at + step].tolist(), strict=True)):
            row = counts[q]
            for line, first, end in zip(orders, a, b, strict=True):
                row[line[first:end]] += 1
        i, j = np.nonzero(counts >= need)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), 65536):
            a, b = i[s : s + 65536], j[s : s + 65536]
            ok = np.einsum("ij,ij->i", x[a], y[b]) >= threshold
            found_i.append(a[ok])
            found_j.append(b[ok])
    return np.concatenate([*found_i, np.empty(0, int)]), np.concatenate([*found_j, np.empty(0, int)])


def link_embeddings(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK, projections: int = PROJECTIONS, recall: float = RECALL) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): n_links, component_id and kept, over links of cosine >= ``threshold``.

    Only vectors of one label, and none null, zero or with null or non-finite components, are compared; others are alone.
    Vectors of other lengths are compared among themselves. Equal vectors of a label are one class with a count; classes
    are dealt to blocks by a range over label and a lead projection, and each pair of blocks whose lead projections come
    near enough is one task's work of bounded size, however many rows a label has: within it every projection is sorted
    and collisions in windows are counted. Tasks return counts and a spanning forest per pair of blocks, never the links.
    The work grows with the square of a label's classes: a window that near pairs hardly miss holds a fifth of all others.
    A row of null vec_id has its n_links and its component, which is the smallest id that is not null. Repeated ids are
    rows of their own; very long vectors are read whole. No rows give no rows; other columns are not looked at.
    """
    width, need = plan(threshold, projections, recall=recall)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for v, label in zip(batch["embedding"], batch["label"], strict=True):
                u = None if label is None else unit(v)
                if u is None:
                    out.append((None, None, None, None))
                    continue
                name = hashlib.blake2b(f"{len(label)} {label} ".encode() + (np.asarray(v, "<f8") + 0.0).tobytes(), digest_size=16).digest()
                out.append((name, len(u), u.tobytes(), float(u @ lead(len(u)))))
            yield pd.DataFrame({"vec_id": batch["vec_id"].astype("Int64"), "label": batch["label"]}).join(pd.DataFrame(out, columns=["class", "dim", "v", "p"], index=batch.index).astype({"dim": "Int32"}))

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = cut(rows.mapInPandas(measure, "vec_id long, label string, class binary, dim int, v binary, p double"), "vectors")
    good = rows.where("class is not null")
    total = good.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = good.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"), *[F.first(c).alias(c) for c in ("label", "dim", "v", "p")])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        base, number, room, last, rank = TaskContext.get().partitionId() << 40, -1, 0, None, 0
        for batch in batches:
            out = np.empty(len(batch), "i8")
            for at, key in enumerate(zip(batch["label"], batch["dim"], strict=True)):
                if key != last or not room:
                    number, room, last = number + 1, block, key
                room -= 1
                out[at] = base + number
            yield batch.assign(block=out, id=base + rank + np.arange(len(batch)))
            rank += len(batch)

    parts = max(1, -(-total // (4 * block)))
    ranged = classes.repartitionByRange(parts, "label", "dim", "p", "class").sortWithinPartitions("label", "dim", "p", "class")
    dealt = cut(ranged.select("class", "n", "first", "label", "dim", "v", "p").mapInPandas(deal, "class binary, n long, first long, label string, dim int, v binary, p double, block long, id long"), "blocks")
    spans = cut(dealt.groupBy("label", "dim", "block").agg(F.min("p").alias("lo"), F.max("p").alias("hi")), "spans")
    # A projection to a unit vector moves no further than the vectors are apart: blocks beyond that share no link.
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    other = spans.select("label", "dim", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi")])
    pairs = spans.join(other, ["label", "dim"]).where((F.col("block") <= F.col("block2")) & (F.col("lo2") <= F.col("hi") + reach) & (F.col("lo") <= F.col("hi2") + reach))
    pairs = cut(pairs.select("block", "block2"), "pairs")
    sides = pairs.select(F.col("block").alias("b"), "block", "block2").union(pairs.where("block != block2").select(F.col("block2").alias("b"), "block", "block2"))
    work = dealt.select("id", "n", "dim", "v", F.col("block").alias("b")).join(sides, "b")

    def compare(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        a, b = key
        dim = int(group["dim"].iloc[0])
        group = group.sort_values(["b", "id"], kind="stable")
        ids, n = group["id"].to_numpy(), group["n"].to_numpy()
        vs = np.frombuffer(b"".join(group["v"]), "<f8").reshape(-1, dim)
        half = int((group["b"] == a).sum())
        i, j = similar_pairs(vs[:half], vs if a == b else vs[half:], threshold, directions(dim, projections), width, need, a == b)
        if a != b:
            j = j + half
        links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
        root = forest(i, j, len(ids))
        some = links > 0
        return pd.DataFrame({"id": ids[some], "links": links[some].astype("i8"), "root": ids[root[some]]})

    found = cut(work.groupBy("block", "block2").applyInPandas(compare, "id long, links long, root long"), "links")
    linked = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("id != root").select("id", "root").distinct()).withColumnsRenamed({"node": "id", "component": "root"})
    named = dealt.select("class", "id", "first", "n").join(components, "id", "left").join(linked, "id", "left")
    named = cut(named.select("class", "first", "n", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "named")
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    told = cut(named.join(lowest, "root").select("class", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "told")
    for t in (dealt, spans, pairs, found, named):
        drop(t)
    out = good.join(told, "class").select("vec_id", "n_links", "component_id").union(rows.where("class is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"))
