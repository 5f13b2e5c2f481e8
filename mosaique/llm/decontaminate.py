"""Benchmark passages in documents: CGK embedding of windows, bit-sampling LSH, exact edit verification."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, SAMPLED, TABLES, MOST_TABLES, SPAN = 96, 9, 8, 64, 1
RATE, RECALL, SEED = 0.15, 0.95, 11
BLOCK_CHARS = 4 << 20
LEAST_SAME, GRAM = 0.4, 5
SHORT = 24
RUN, NEAR, HEAD = 16, 6, 16


@cache
def folds() -> np.ndarray:
    """Code point -> that of its lower case, if this is one code point; white space -> a blank. Beyond lie no cased letters."""
    out = np.arange(0x1F000, dtype="<u4")
    for c in map(chr, out.tolist()):
        if c.isspace():
            out[ord(c)] = 32
        elif len(low := c.lower()) == 1:
            out[ord(c)] = ord(low)
    out[0] = 1  # zeros stand between texts
    return out


def points(text: str) -> np.ndarray:
    """The code points that are compared: letters in lower case, all white space as blanks."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    table = folds()
    return table[a] if not len(a) or a.max() < len(table) else np.where(a < len(table), table[np.minimum(a, len(table) - 1)], a)


def bytes_of(p: np.ndarray) -> np.ndarray:
    """One byte per code point, for walks and keys; 0 never occurs, and none but a blank becomes 32. Code points over 255
    share bytes, so that only :func:`points` tell whether two texts are alike."""
    high = (p * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(191)
    return np.where(p < 256, np.maximum(p, 1), high + 64).astype(np.uint8)


def symbols(text: str) -> np.ndarray:
    return bytes_of(points(text))


def anchors(s: np.ndarray, span: int = SPAN) -> np.ndarray:
    """Word starts that are the minimum, by a hash of the next eight symbols, among some ``span`` word starts in a row.

    The choice depends on near text only, so that a copied passage has the same anchors inside, wherever it lies. A span of
    1 takes every word start: edits then cost no anchors, and fewer hash tables reach the recall than with sparse anchors.
    """
    blank = s == 32
    starts = ~blank & np.concatenate([[True], blank[:-1] | (s[:-1] == 0)]) & (s != 0)
    inside = unspaced(s)
    at = np.nonzero(starts)[0]
    if len(at) <= span or span == 1:
        starts[inside] = True
        return np.nonzero(starts)[0] if len(inside) else at
    padded = np.concatenate([s, np.zeros(8, np.uint8)])
    h = np.zeros(len(at), "u8")
    for k in range(8):
        h = (h ^ padded[at + k]) * np.uint64(0x100000001B3)
    h ^= h >> np.uint64(29)
    low = np.lib.stride_tricks.sliding_window_view(h, span).min(axis=1)
    chosen = np.zeros(len(at), bool)
    for k in range(span):
        chosen[k : k + len(low)] |= h[k : k + len(low)] == low
    return np.union1d(at[chosen], inside) if len(inside) else at[chosen]


def unspaced(s: np.ndarray) -> np.ndarray:
    """Places in runs of ``RUN`` symbols and more without a blank that are the minimum, by a hash of two symbols, among ``NEAR`` in a row.

    Scripts that put no blanks between words get their windows there; like word starts, they depend on near text only.
    """
    stops = np.concatenate([[-1], np.nonzero((s == 32) | (s == 0))[0], [len(s)]])
    long = np.nonzero(np.diff(stops) > RUN)[0]
    out = [np.empty(0, np.int64)]
    for a, b in zip(stops[long] + 1, stops[long + 1], strict=True):
        r = s[a:b].astype("u4")
        h = ((r[:-1] << np.uint32(8) | r[1:]) + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        low = np.lib.stride_tricks.sliding_window_view(h, NEAR).min(axis=1)
        chosen = np.zeros(len(h), bool)
        for k in range(NEAR):
            chosen[k : k + len(low)] |= h[k : k + len(low)] == low
        out.append(a + np.nonzero(chosen)[0])
    return np.concatenate(out)


def eights(s: np.ndarray) -> np.ndarray:
    """The eight symbols from every place on as one number."""
    return np.ndarray((max(0, len(s) - 7),), "<u8", np.ascontiguousarray(s).data, strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    return h * np.uint64(0x9E3779B97F4A7C15)


class Embedding:
    """CGK random walk: at step j the symbol is put out, and the place moves on if a random bit of (j, symbol) says so.

    Strings of few edits walk apart and meet again, so that their outputs differ in few places. Each of the hash tables
    samples some of these places.
    """

    def __init__(self, steps: int, tables: int, sampled: int = SAMPLED, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.steps = steps
        self.moves = rng.integers(0, 2, (STEPS, 256), np.uint8)[:steps]
        self.places = [np.sort(np.random.default_rng([seed, t]).choice(steps, sampled, replace=False)) for t in range(tables)]

    def walk(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(steps, windows) symbols; ``s`` is padded with zeros beyond every text."""
        at = at.astype(np.int64)
        out = np.empty((self.steps, len(at)), np.uint8)
        for j in range(self.steps):
            c = s[at]
            out[j] = c
            at = at + self.moves[j][c]
        return out

    def keys(self, out: np.ndarray, table: int) -> np.ndarray:
        h = np.full(out.shape[1], table + 1, "u8")
        for p in self.places[table]:
            h = (h ^ out[p]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        return h


def grams(s: np.ndarray) -> np.ndarray:
    """14 bits of a hash of the ``GRAM`` symbols from every place on."""
    p = np.concatenate([s, np.zeros(GRAM - 1, np.uint8)]).astype("u4")
    h = np.zeros(len(s), "u4")
    for k in range(GRAM):
        h = (h ^ p[k : k + len(s)]) * np.uint32(0x9E3779B1)
    return (h >> np.uint32(18)).astype("u2")


def nearest(pattern: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to a part of ``text``, and where the first such part ends (bit-parallel)."""
    m = len(pattern)
    peq: dict[int, int] = defaultdict(int)
    for i, c in enumerate(pattern.tolist()):
        peq[c] |= 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = mask, 0, m, m, 0
    for j, c in enumerate(text.tolist()):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & mask
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        pv, mv = mh | ~(xv | ph) & mask, ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


def class_of(s: np.ndarray) -> int:
    """Steps of the walk for an item: its class of length; 0 for an item that is only sought verbatim."""
    if len(s) < SHORT or len(anchors(s)) < 2 and len(s) < 2 * SHORT:
        return 0
    return STEPS if len(s) >= 120 else STEPS // 2 if len(s) >= 40 else STEPS // 4


class Matcher:
    """Index of items by class of length; long items are walked further. Every item is sought verbatim too, short ones only so.

    Keys and grams are of bytes; distances, and what is verbatim, are of code points."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, tables: dict[int, int] | None = None):
        self.rate, self.items = rate, []
        self.verbatim: list[int] = []
        by_class: dict[int, list[int]] = defaultdict(list)
        self.points: list[np.ndarray] = []
        for item, text in items:
            p = points(text)
            s = bytes_of(p)
            n = len(self.items)
            self.items.append((item, s))
            self.points.append(p)
            if steps := class_of(s):
                by_class[steps].append(n)
            elif len(s):
                self.verbatim.append(n)
        # Classes of no table are sought exactly: of allowed + 1 pieces of an item one is left whole by the edits.
        exact = [n for steps in list(by_class) if (tables or {}).get(steps) == 0 for n in by_class.pop(steps)]
        piece = [(n, len(s) * j // (k + 1)) for n in exact for s in (self.items[n][1],) for k in (int(rate * len(s)),) for j in range(k + 1)]
        if any(len(self.items[n][1]) < GRAM * (int(rate * len(self.items[n][1])) + 1) for n in exact):
            raise ValueError(f"pieces of under {GRAM} symbols at this rate")
        codes = np.array([int.from_bytes(self.items[n][1][o : o + GRAM].tobytes(), "little") for n, o in piece], "u8")
        order = np.argsort(codes, kind="stable")
        self.codes, self.piece = codes[order], np.array(piece, np.int64).reshape(-1, 2)[order]
        self.some_code = np.zeros(1 << 20, bool)
        self.some_code[mix(codes) >> np.uint64(44)] = True
        self.tables: dict[int, np.ndarray] = {}
        headed = [n for n, (_, s) in enumerate(self.items) if len(s) >= HEAD]
        starts = [eights(self.items[n][1][:HEAD])[[0, 8]] for n in headed]
        first = np.array([x[0] for x in starts], "u8")
        both = mix(first) ^ np.array([x[1] for x in starts], "u8")
        order = np.argsort(both, kind="stable")
        self.heads, self.headed = both[order], np.array(headed, np.int64)[order]
        self.some_head = np.zeros(1 << 20, bool)
        self.some_head[mix(first) >> np.uint64(44)] = True
        self.classes = []
        for steps, members in sorted(by_class.items()):
            e = Embedding(steps, (tables or {}).get(steps, TABLES))
            own, where, outs = [], [], []
            for n in members:
                s = self.items[n][1]
                at = anchors(s)
                # A window should end within the item; a walk moves on every other step.
                fit = at[at + steps // 2 + 4 <= len(s)]
                at = fit if len(fit) else at[:1]
                outs.append(e.walk(np.concatenate([s, np.zeros(STEPS, np.uint8)]), at))
                own += [n] * len(at)
                where += at.tolist()
            outs = np.concatenate(outs, axis=1)
            keys = []
            for t in range(len(e.places)):
                k = e.keys(outs, t)
                order = np.argsort(k, kind="stable")
                some = np.zeros(1 << 16, bool)
                some[k & np.uint64(0xFFFF)] = True
                keys.append((k[order], order, some))
            self.classes.append((e, np.array(own), np.array(where), outs, keys))

    def may_hold(self, n: int, text_grams: np.ndarray, start: int, a: int, b: int, allowed: int) -> bool:
        """Whether the part a..b of a text can hold item ``n`` from about ``start`` on.

        An edit spoils at most GRAM of the item's grams and moves the others by one place, so that those of each quarter of
        the item are still found near it; no item within ``allowed`` edits is missed.
        """
        item = self.items[n][1]
        bounds = [len(item) * k // 4 for k in range(5)]
        tables = self.tables.get(n)
        if tables is None:
            if len(self.tables) >= 512:
                self.tables.clear()
            tables = self.tables[n] = np.zeros((4, 1 << 14), bool)
            own = grams(item)[: 1 - GRAM]
            for k in range(4):
                tables[k][own[bounds[k] : bounds[k + 1]]] = True
        there = sum(int(np.count_nonzero(tables[k][text_grams[max(a, start + bounds[k] - allowed - 1) : max(a, min(b, start + bounds[k + 1] + allowed + 1))]])) for k in range(4))
        return there >= len(item) + 1 - GRAM - GRAM * allowed

    def candidates(self, s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (item, place of the item's start in ``s``) that share a key and agree in over a third of the steps."""
        found = []
        if not len(at) or not self.classes:
            return np.empty((0, 2), np.int64)
        most = max(e.steps for e, *_ in self.classes)
        walked = Embedding(most, 0).walk(s, at)
        for e, own, where, outs, keys in self.classes:
            for t, (known, order, some) in enumerate(keys):
                k = e.keys(walked, t)
                hit = np.nonzero(some[k & np.uint64(0xFFFF)])[0]
                k = k[hit]
                lo = np.searchsorted(known, k)
                equal = known[np.minimum(lo, len(known) - 1)] == k
                hit, lo, k = hit[equal], lo[equal], k[equal]
                if not len(hit):
                    continue
                n = np.searchsorted(known, k, "right") - lo
                w = np.repeat(hit, n)
                first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                x = order[first + np.arange(n.sum())]
                same = (walked[: e.steps, w] == outs[:, x]).mean(axis=0)
                good = same > LEAST_SAME
                found.append(np.stack([own[x[good]], at[w[good]] - where[x[good]]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)

    def exactly(self, whole: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(text number, item, first and end of a part) for every part in which an item without tables can lie."""
        c = eights(whole) & np.uint64((1 << 8 * GRAM) - 1)
        hit = np.nonzero(self.some_code[mix(c) >> np.uint64(44)])[0]
        lo, hi = np.searchsorted(self.codes, c[hit]), np.searchsorted(self.codes, c[hit], "right")
        starts: dict[tuple[int, int], set[int]] = defaultdict(set)
        for p, x, y in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            d = int(np.searchsorted(begins, p, "right")) - 1
            for n, offset in self.piece[x:y].tolist():
                starts[d, n].add(p - offset)
        whole_grams = grams(whole)
        for (d, n), found in starts.items():
            m = len(self.items[n][1])
            allowed = int(self.rate * m)
            first, last = int(begins[d]), int(begins[d + 1] if d + 1 < len(begins) else len(whole)) - STEPS
            part = None
            for start in sorted(found):
                a, b = max(first, start - allowed - 1), min(last, start + m + allowed + 1)
                if b - a < m - allowed or not self.may_hold(n, whole_grams, start, a, b, allowed):
                    continue
                if part and a <= part[1]:
                    part = part[0], b
                else:
                    if part:
                        yield d, n, *part
                    part = a, b
            if part:
                yield d, n, *part

    def search(self, texts: list[str]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text number, item, start, end, distance): per text and item the nearest part, if within the rate."""
        parts, begins, at = [], [], 0
        gap = np.zeros(STEPS, "<u4")
        for t in texts:
            p = points(t)
            begins.append(at)
            parts += [p, gap]
            at += len(p) + STEPS
        if not parts:
            return
        exact_points, begins = np.concatenate(parts), np.array(begins)
        whole = bytes_of(exact_points)
        whole[exact_points == 0] = 0
        chosen, whole_grams = anchors(whole), grams(whole)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()

        def verify(d: int, n: int, a: int, b: int) -> None:
            item, lo = self.points[n], begins[d]
            distance, end = nearest(item, exact_points[a:b])
            if distance <= int(self.rate * len(item)) and ((d, n) not in best or distance < best[d, n][0]):
                back = nearest(item[::-1], exact_points[a : a + end][::-1])[1]
                best[d, n] = (distance, a + end - back - lo, a + end - lo)

        for step in range(0, len(chosen), 1 << 16):
            for n, start in self.candidates(whole, chosen[step : step + (1 << 16)]).tolist():
                item = self.items[n][1]
                doc = int(np.searchsorted(begins, max(start, 0) if start >= 0 else 0, "right")) - 1
                # A start before the text's own belongs to the text that its anchor lies in.
                for d in {doc, min(doc + 1, len(begins) - 1)}:
                    lo, hi = begins[d], (begins[d + 1] if d + 1 < len(begins) else len(whole)) - STEPS
                    allowed = int(self.rate * len(item))
                    a, b = max(lo, start - allowed - 1), min(hi, start + len(item) + allowed + 1)
                    # Starts near each other are one: the part has room for them.
                    if b - a < len(item) - allowed or not tried.isdisjoint((d, n, (start + k) >> 2) for k in (-2, 0, 2)):
                        continue
                    tried.add((d, n, start >> 2))
                    if self.may_hold(n, whole_grams, start, max(lo, a - 4), min(hi, b + 4), allowed):
                        verify(d, n, max(lo, a - 4), min(hi, b + 4))
        for d, n, a, b in self.exactly(whole, begins) if len(self.codes) else ():
            verify(d, n, a, b)
        exact: dict[tuple[int, int], int] = {}
        everything = whole.tobytes() if self.verbatim else b""
        for n in self.verbatim:
            item = self.items[n][1].tobytes()
            if len(item) >= HEAD:
                continue
            k = everything.find(item)
            while k >= 0:
                d = int(np.searchsorted(begins, k, "right")) - 1
                if (d, n) not in exact and stands_alone(exact_points, k, self.points[n]):
                    exact[d, n] = k - int(begins[d])
                k = everything.find(item, k + 1)
        h, hit = eights(whole), np.empty(0, np.int64)
        if len(self.heads):
            hit = np.nonzero(self.some_head[mix(h[:-8]) >> np.uint64(44)])[0]
        both = mix(h[hit]) ^ h[hit + 8]
        lo, hi = np.searchsorted(self.heads, both), np.searchsorted(self.heads, both, "right")
        for k, x, y in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            d = int(np.searchsorted(begins, k, "right")) - 1
            for n in self.headed[x:y].tolist():
                item = self.points[n]
                # Texts end in zeros, which no item holds.
                if (d, n) not in exact and (stands_alone(exact_points, k, item) if len(item) < SHORT else np.array_equal(exact_points[k : k + len(item)], item)):
                    exact[d, n] = k - begins[d]
        for (d, n), k in exact.items():
            if (d, n) not in best or best[d, n][0]:
                best[d, n] = (0, k, k + len(self.items[n][1]))
        for (d, n), (distance, start, end) in sorted(best.items()):
            yield d, n, int(start), int(end), distance


def stands_alone(text: np.ndarray, k: int, item: np.ndarray) -> bool:
    """Whether the item stands at place ``k``, and is no part of a longer word (in scripts that part words by blanks)."""
    end = k + len(item)
    if not np.array_equal(text[k:end], item):
        return False
    of_word = lambda i: 0 <= i < len(text) and text[i] < 0x2E80 and chr(text[i]).isalnum()
    return not (of_word(k - 1) and of_word(k) or of_word(end - 1) and of_word(end))


def mutate(s: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = s.tolist()
    for _ in range(edits):
        k, kind = int(rng.integers(0, len(out))), int(rng.integers(0, 3))
        if kind == 0:
            out[k] = int(rng.integers(97, 123))
        elif kind == 1:
            out.insert(k, int(rng.integers(97, 123)))
        elif len(out) > 1:
            del out[k]
    return np.array(out, s.dtype)


def calibrate(items: list[tuple[int, str]], rate: float = RATE, recall: float = RECALL, sample: int = 256, copies: int = 4) -> dict[int, int]:
    """Hash tables per class of length, doubled until copies with ``rate`` edits per symbol are found at ``recall``.

    At most ``sample`` items of each class, and of a class that has any at least one, are edited ``copies`` times (more where they are few), between
    words of other items (without blanks where the item has none), with a fixed seed. A class that ``MOST_TABLES`` do not
    bring to the recall gets 0 tables: it is sought exactly.
    """
    by_class: dict[int, list[tuple[int, str]]] = defaultdict(list)
    for k in np.random.default_rng(SEED).permutation(len(items)):
        steps = class_of(symbols(items[k][1]))
        if steps and len(by_class[steps]) < sample:
            by_class[steps].append(items[k])
    tables = dict.fromkeys((STEPS // 4, STEPS // 2, STEPS), TABLES)
    for steps, chosen in by_class.items():
        trials = max(copies, -(-64 // len(chosen)))
        while True:
            matcher = Matcher(chosen, tables=tables)
            rng = np.random.default_rng(SEED + steps)
            found = 0
            for n, (_, s) in enumerate(matcher.items):
                other = matcher.items[(n + 1) % len(matcher.items)][1]
                for _ in range(trials):
                    gap = [] if len(unspaced(s)) else [32]
                    text = np.concatenate([other[::-1], gap, mutate(s, int(rate * len(s)), rng), gap, other[::-1], np.zeros(STEPS, np.uint8)]).astype(np.uint8)
                    found += n in matcher.candidates(text, anchors(text))[:, 0]
            if found >= recall * trials * len(chosen):
                break
            tables[steps] = 2 * tables[steps] if tables[steps] < MOST_TABLES else 0
            if not tables[steps]:
                break
    return tables


def blocks_of(items: DataFrame) -> Iterator[tuple[list[tuple[int, str]], dict[int, int]]]:
    """The items that are not empty with their hash tables, in blocks of at most about ``BLOCK_CHARS`` characters; one block at least."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null and text != ''")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // BLOCK_CHARS))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        known = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is not None, x)) if size else []
        yield known, calibrate(known) if known else {}


def find_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per document and benchmark item of which it holds a passage: span, edit distance and similarity.

    ``docs`` (doc_id, text), ``items`` (item_id, text). A passage is a part of a whole text within ``rate`` edits per code
    point of the whole item (letter case and kind of white space aside, in all scripts), of which the nearest is reported.
    Windows begin at anchors inside the texts, at every word and inside long runs without blanks; walks are as long as a
    class of items' length allows, at most ``STEPS`` steps: over a whole long item, edits drive two walks apart for good.
    Hash tables are added until items edited at this very rate are found with a recall of 0.95, and a class of length that
    ``MOST_TABLES`` do not bring there is sought exactly. Items lie in every task, in blocks of at most ``BLOCK_CHARS`` characters;
    a larger benchmark is gone through block by block. Nothing is shuffled. Null and empty texts and items match nothing;
    every item is sought verbatim, whatever its length or script, those of under 24 symbols only so, and as whole words; equal items are reported each; rows of one id, or of null id, are
    reported each; no rows give no rows; other columns are not looked at.
    """
    schema = "doc_id long, item_id long, start long, end long, distance int, similarity double"
    out = None
    for known, tables in blocks_of(items):

        def run(batches: Iterator[pd.DataFrame], known=known, tables=tables) -> Iterator[pd.DataFrame]:
            matcher = Matcher(known, rate, tables)
            for batch in batches:
                rows, texts, ids, held = [], [], [], 0

                def look(texts=texts, ids=ids, rows=rows) -> None:
                    for d, n, start, end, distance in matcher.search(texts):
                        item, s = matcher.items[n]
                        rows.append((ids[d], item, start, end, distance, 1 - distance / len(s)))
                    texts.clear()
                    ids.clear()

                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    if text:
                        texts.append(text)
                        ids.append(None if pd.isna(doc) else int(doc))
                        held += len(text)
                        if held > 1 << 20:
                            look()
                            held = 0
                look()
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "distance", "similarity"]).astype({"doc_id": "Int64", "item_id": "Int64"})

        found = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, schema)
        out = found if out is None else out.union(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose own text :func:`find_leaks` finds no item, whatever their ids."""

    def free_of(known: list[tuple[int, str]], tables: dict[int, int]):
        @F.pandas_udf("boolean")
        def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            matcher = Matcher(known, rate, tables)
            for batch in texts:
                good, first, held = np.ones(len(batch), bool), 0, 0
                for k, text in enumerate(batch):
                    held += len(text)
                    if held > 1 << 20 or k + 1 == len(batch):
                        for d, *_ in matcher.search(batch.iloc[first : k + 1].tolist()):
                            good[first + d] = False
                        first, held = k + 1, 0
                yield pd.Series(good)

        return clean

    for known, tables in blocks_of(items):
        if known:
            docs = docs.where(free_of(known, tables)(F.coalesce("text", F.lit(""))))
    return docs
