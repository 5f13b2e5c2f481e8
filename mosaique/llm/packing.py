"""Tokenises documents and packs them into sequences of bounded length by bounded-space best fit."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_TOKENS, OPEN_BINS, AHEAD, END_ID = 2048, 512, 256, 0
#: Letters beyond this are left to the file's own library: there two Unicode versions could class a character otherwise.
PLAIN = re.compile("[ɐ-\U0010ffff]")
PIECES = "doc_id long, piece int, start long, length long, tokens binary, sequence_id long, offset long"


class Bins:
    """Open bins by free space: a bitset says which free spaces occur, so best fit is the lowest set bit at or above the need."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.mask, self.count, self.made = size, most, 0, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(size + 1)]

    def _put(self, free: int, bin_: list) -> None:
        self.by_free[free].append(bin_)
        self.mask |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        bin_ = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        self.count -= 1
        return bin_

    def add(self, need: int, item) -> list | None:
        """Places an item; returns a bin that this closes: a full one, or the fullest when too many are open."""
        above = self.mask >> need
        if above:
            free = need + (above & -above).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_, self.made = self.size, [self.made], self.made + 1
        bin_.append((item, self.size - free))
        if free == need:
            return bin_
        self._put(free - need, bin_)
        if self.count > self.most:
            return self._take((self.mask & -self.mask).bit_length() - 1)
        return None

    def rest(self) -> Iterator[list]:
        while self.count:
            yield self._take((self.mask & -self.mask).bit_length() - 1)


def encoder(path: str, ranks_path: str | None = None):
    """texts -> list of uint32 arrays. ``path`` is a tokenizers file. Where the same vocabulary lies beside it as ranks, those
    give the same ids several times faster for texts of Latin letters; the file itself does the others."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    ids_of = lambda texts: [np.array(x.ids, "<u4") for x in slow.encode_batch_fast(texts, add_special_tokens=False)]
    if ranks_path is None:
        return ids_of
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [fast.encode_to_numpy(t, disallowed_special=()).astype("<u4") if not PLAIN.search(t) else ids_of([t])[0] for t in texts]


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, ahead: int = AHEAD, repack: bool = True) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their tokens (unsigned 32-bit, little-endian) and place in a sequence.

    A document is its ids, then id 0. One of over ``max_tokens`` is cut into full pieces, of which the first takes the rest
    and may be shorter. Each partition packs on its own, in one pass and without a shuffle: at most ``open_bins`` bins are
    open, keyed by free space in a bitset; a piece goes to the fullest bin that takes it, and when too many are open the
    fullest closes. Two things make it not purely online, and save sequences: of every ``ahead`` documents (1: of none) the
    longer pieces go first, and with ``repack`` the pieces of the bins left open at a partition's end, ``open_bins`` at most,
    are packed anew, longest first. A lost task is simply repeated over its own input split. Memory: open bins and one batch.
    Null and empty texts are one token (id 0); repeated and null ids are packed like any other; no rows give no rows;
    other columns are not looked at.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, bins, base = encoder(tokenizer, ranks), Bins(max_tokens, open_bins), TaskContext.get().partitionId() << 36
        out: list[tuple] = []
        size = 0

        def close(bin_: list) -> None:
            nonlocal size
            for (doc, piece, start, ids), offset in bin_[1:]:
                out.append((doc, piece, start, len(ids), ids.tobytes(), base + bin_[0], offset))
                size += len(ids)

        def flush() -> pd.DataFrame:
            nonlocal size
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "tokens", "sequence_id", "offset"]).astype({"doc_id": "Int64"})
            out.clear()
            size = 0
            return frame

        for batch in batches:
            texts, ids = batch["text"].fillna("").tolist(), batch["doc_id"].tolist()
            for at in range(0, len(texts), ahead):
                items = []
                for doc, tokens in zip(ids[at : at + ahead], encode(texts[at : at + ahead]), strict=True):
                    tokens = np.append(tokens, np.array([END_ID], "<u4"))
                    first = len(tokens) % max_tokens or max_tokens
                    cuts = [0, *range(first, len(tokens) + 1, max_tokens)]
                    items += [(None if pd.isna(doc) else int(doc), k, a, tokens[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                for item in sorted(items, key=lambda x: -len(x[3])):
                    if closed := bins.add(len(item[3]), item):
                        close(closed)
                if size > 1 << 20:
                    yield flush()
        if repack:
            left = sorted((x[0] for b in bins.rest() for x in b[1:]), key=lambda x: -len(x[3]))
            bins, made = Bins(max_tokens, 2 * len(left)), bins.made
            bins.made = made
            for item in left:
                if closed := bins.add(len(item[3]), item):
                    close(closed)
        for bin_ in bins.rest():
            close(bin_)
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInPandas(run, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("tokens").alias("ids_crc32"), "sequence_id", "offset")
