"""SimHash near-duplicates: fingerprints, and links of few differing bits by one-wildcard variants of two halves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop, fresh

SEED, WORDS, BITS = 42, 3, 64
#: Fingerprints that one task takes of a quarter at most, and about how many it holds; runs up to PAIRWISE are compared at once.
LARGEST, CHUNK, PAIRWISE = 1 << 18, 1 << 18, 256


def shingle_hashes(text: str, n: int = WORDS) -> np.ndarray:
    """XXH64 of every ``n``-word shingle, repeats included; words are split at ASCII white space, A-Z lower-cased."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, "u8")
    h = xxhash.xxh64_intdigest
    if len(words) < n:
        return np.array([h(b" ".join(words), SEED)], "u8")
    whole = b" ".join(words)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: len(words) - n]]]
    return np.array([h(whole[a:b], SEED) for a, b in zip(starts, ends[n - 1 :], strict=True)], "u8")


def fingerprint(hashes: np.ndarray) -> int:
    """Bit set where over half of the hashes have it; zero without hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 8192):
        ones += np.unpackbits(hashes[at : at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits in a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.fromiter((fingerprint(shingle_hashes(t or "", shingle)) for t in batch["text"]), "u8", len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fps.view("i8")})

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fp long")


def keep_one(docs: DataFrame, shingle: int = WORDS, most: int = 3) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each group of :func:`simhash_groups`.

    Of a group the row of the smallest id stays, one without an id only if the group has none; ties go by the row's content.
    Rows are told apart by two hashes of all their columns, not by id: a row of null or repeated id stays or goes for its
    own text. Rows alike in every column are one row's copies, of which one stays.
    """

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.fromiter((fingerprint(shingle_hashes(t, shingle)) for t in batch), "u8", len(batch)).view("i8"))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    keys = [fresh("_mosaique_a", docs.columns), fresh("_mosaique_b", docs.columns)]
    seen = [x for c in columns for x in (c.isNull(), c)]
    row = [F.xxhash64(*seen).alias(keys[0]), F.xxhash64(F.lit(1), *seen).alias(keys[1])]
    each = cut(docs.select("doc_id", *row, fp(F.coalesce("text", F.lit(""))).alias("_fp")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", *keys)).alias("first")
    distinct = cut(each.groupBy(F.col("_fp").alias("fp")).agg(first), "distinct")
    labels = link_fingerprints(distinct.select("fp"), most)
    kept = distinct.join(labels, "fp").groupBy("label").agg(F.min("first").alias("first"))
    kept = cut(kept.select(*[f"first.{k}" for k in keys]), "kept")
    drop(distinct)
    drop(each)
    return docs.select(*columns, *row).join(kept, keys, "left_semi").dropDuplicates(keys).select(*columns)


def mask_tree() -> list[list[tuple[int, list[int]]]]:
    """Per level the masks, each as its bits and the numbers of its masks on the next level.

    Two fingerprints of at most three differing bits share the bits of some mask of every level, below one that they share
    on the level above: of two halves one has at most one differing bit, so one of its quarters has none (level 0) and the
    other one is equal but for one wild bit (level 1, the signatures). Of the other half's four bytes one has none (level
    2), and of its other 24 bits one half has at most one (level 3). Beyond that at most 2 ** 14 fingerprints can be equal.
    """
    span = lambda at, n: ((1 << n) - 1) << at
    quarters, signatures, bytes_, last = [], [], [], []
    for q in range(4):
        quarters.append((span(16 * q, 16), list(range(len(signatures), len(signatures) + 16))))
        for bit in range(16):
            variant = span(32 * (q // 2), 32) ^ 1 << 16 * (q ^ 1) + bit
            signatures.append((variant, list(range(len(bytes_), len(bytes_) + 4))))
            other = [32 * (1 - q // 2) + k for k in range(32)]
            for y in range(4):
                rest = other[: 8 * y] + other[8 * y + 8 :]
                known = variant | span(other[8 * y], 8)
                bytes_.append((known, list(range(len(last), len(last) + 24))))
                last += [(known | sum(1 << k for k in part if k != wild), []) for part in (rest[:12], rest[12:]) for wild in part]
    return [quarters, signatures, bytes_, last]


TREE = mask_tree()


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; ``label`` holds each element's least member and is changed in place."""
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def link_within(fps: np.ndarray, label: np.ndarray, some: np.ndarray, level: int, mask: int, most: int) -> None:
    """Merges in ``label`` all of ``fps[some]`` that share the mask's bits and a signature, and differ in at most ``most`` bits.

    Under each mask of the next level the fingerprints are sorted by what they share. A run's members are linked to its
    first; only runs that then still hold several sets have their pairs compared, long ones mask by mask of the level below.
    """
    near = lambda i, j: np.bitwise_count(fps[i] ^ fps[j]) <= most
    for below in TREE[level][mask][1] or [None]:
        bits = np.uint64(TREE[level + 1][below][0] if below is not None else TREE[level][mask][0])
        key = fps[some] & bits
        order = np.argsort(key, kind="stable")
        at, key = some[order], key[order]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        run = np.cumsum(first) - 1
        hub = at[np.nonzero(first)[0]][run]
        ok = near(at, hub) & (at != hub)
        merge(label, at[ok], hub[ok])
        ends = np.append(np.nonzero(first)[0], len(at))
        sizes, labels = np.diff(ends), label[at]
        mixed = np.minimum.reduceat(labels, ends[:-1]) != np.maximum.reduceat(labels, ends[:-1])
        long = mixed & (sizes > PAIRWISE) if below is not None else np.zeros(len(sizes), bool)
        if long.any():
            link_within(fps, label, at[long[run]], level + 1, below, most)
        keep = (mixed & ~long)[run]
        at, run = at[keep], run[keep]
        step = 1
        while step < len(at):
            same = np.nonzero(run[step:] == run[:-step])[0]
            if not len(same):
                break
            i, j = at[same], at[same + step]
            ok = (label[i] != label[j]) & near(i, j)
            merge(label, i[ok], j[ok])
            step += 1


def link_groups(path: np.ndarray, fps: np.ndarray, level: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fingerprint, least one of its set) that connect what is near within the groups of one level."""
    names, index = np.unique(fps, return_inverse=True)
    label = np.arange(len(names))
    for mask in np.unique(path):
        link_within(names, label, index[path == mask], level, int(mask), most)
    some = np.nonzero(label != np.arange(len(names)))[0]
    return names[some], names[label[some]]


def link_fingerprints(fps: DataFrame, most: int = 3, largest: int = LARGEST) -> DataFrame:
    """(fp, label): connected components of distinct fingerprints, linked at ``most`` (at most 3) or fewer differing bits.

    Three bits over two halves leave one half with at most one, so the two share a variant of it with that bit wild; the
    quarter beside it is then intact. So each fingerprint is sent to its four quarters, not to its 64 variants; these are
    made, sorted and compared where a quarter's fingerprints meet. Tasks return a spanning forest of what they link,
    never pairs. A quarter (or, in turn, a variant or a longer part, see :func:`mask_tree`) of over ``largest``
    fingerprints is not gathered: its members are sent on by each of the longer parts that near ones among them share,
    of which the last are bounded by their free bits. No link is lost at any size.
    """
    if most > 3:
        raise ValueError("two halves and one wildcard find at most 3 differing bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    shared = [F.struct(F.lit(n).alias("path"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k")) for n, (m, _) in enumerate(TREE[0])]
    rows = fps.select(F.explode(F.array(*shared)).alias("e"), "fp").select("e.path", "e.k", "fp")
    found, written = None, []
    for level in range(len(TREE)):
        hot = None
        if level + 1 < len(TREE):
            hot = cut(rows.groupBy("path", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest).select("path", "k"), "hot")
            written.append(hot)
        more = hot is not None and not hot.isEmpty()
        here = rows.join(hot, ["path", "k"], "left_anti") if more else rows

        def resolve(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            def linked(part: pd.DataFrame) -> pd.DataFrame:
                a, b = link_groups(part["path"].to_numpy(), part["fp"].to_numpy().view("u8"), level, most)
                return pd.DataFrame({"fp": a.view("i8"), "low": b.view("i8")})

            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += len(batch)
                if size >= CHUNK:
                    every = pd.concat(held)
                    path, k = every["path"].to_numpy(), every["k"].to_numpy()
                    # The last group can go on in the next batch.
                    done = int(np.nonzero((path != path[-1]) | (k != k[-1]))[0].max(initial=-1)) + 1
                    if done:
                        yield linked(every.iloc[:done])
                    held, size = [every.iloc[done:]], len(every) - done
            if size:
                yield linked(pd.concat(held))

        links = here.repartition("path", "k").sortWithinPartitions("path", "k").mapInPandas(resolve, "fp long, low long")
        found = links if found is None else found.union(links)
        if not more:
            break

        def refine(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for mask, part in batch.groupby("path"):
                    fp = part["fp"].to_numpy()
                    for below in TREE[level][mask][1]:
                        yield pd.DataFrame({"path": below, "k": fp & np.int64(signed(TREE[level + 1][below][0])), "fp": fp})

        rows = rows.join(hot, ["path", "k"], "left_semi").select("path", "fp").mapInPandas(refine, "path int, k long, fp long")
    edges = cut(found.distinct(), "links")
    for t in written:
        drop(t)
    labels = connected_components(edges).withColumnsRenamed({"node": "fp", "component": "label"})
    drop(edges)
    return fps.join(labels, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"))


def simhash_groups(docs: DataFrame, shingle: int = WORDS, most: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint, and the smallest doc_id reachable over links, itself included.

    Null texts and such without words have fingerprint zero, linked like any other. Texts of fewer words than a shingle
    are one shingle. Equal fingerprints meet in one aggregate before any comparison, so copies cost nothing further. A row
    of null id counts in its group, whose component is the smallest id that is not null (null if there is none). Repeated
    rows are kept; no rows give no rows; other columns are not looked at.
    """
    each = cut(fingerprints(docs, shingle), "fingerprints")
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    labels = link_fingerprints(distinct.select("fp"), most)
    named = cut(distinct.join(labels, "fp"), "classes")
    drop(distinct)
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    classes = cut(named.join(lowest, "label").select("fp", "component_id"), "classes")
    drop(named)
    out = each.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
