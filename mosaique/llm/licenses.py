"""Licence scans: winnowed fingerprints of templates pick candidates, banded alignment of words reports what matches."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 6, 0.8
#: Words of text without a hit within one passage at most, and words beyond its first and last hit that are aligned.
GAP = 64
#: Templates of at most so many words must have their deciding words in full; the share of hits that longer ones need.
NOTICE, SEEDS = 200, 0.05
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
MAX_TEMPLATE_WORDS = 1 << 20

#: Fixed texts: names of licences as works give them, by SPDX identifier. ``{v}`` stands for versions, given beside it.
NAMES = {
    "Apache-{v}": ("1.0 1.1 2.0", ["Apache License, Version {v}", "Apache License {v}", "Apache {v} License"]),
    "Apache": ("", ["Apache License"]),
    "MIT": ("", ["MIT License", "MIT/X11 License", "Expat License"]),
    "BSD": ("", ["BSD License"]),
    "BSD-{v}-Clause": ("2 3 4", ["BSD {v}-Clause License", "{v}-Clause BSD License"]),
    "GPL-{v}": ("1.0 2.0 3.0", ["GNU General Public License, version {v}", "GNU General Public License v{v}", "GNU GPL, version {v}", "GNU GPL v{v}", "GPL, version {v}", "GPL v{v}", "GPLv{v}"]),
    "GPL": ("", ["GNU General Public License", "GNU GPL"]),
    "LGPL-{v}": ("2.0 2.1 3.0", ["GNU Lesser General Public License, version {v}", "GNU Library General Public License, version {v}", "GNU Lesser General Public License v{v}", "GNU LGPL, version {v}", "LGPL, version {v}", "Lesser GPL, version {v}", "LGPLv{v}"]),
    "LGPL": ("", ["GNU Lesser General Public License"]),
    "AGPL-{v}": ("3.0", ["GNU Affero General Public License, version {v}", "GNU Affero General Public License v{v}", "GNU AGPL, version {v}", "AGPLv{v}"]),
    "GFDL-{v}": ("1.1 1.2 1.3", ["GNU Free Documentation License, version {v}"]),
    "MPL-{v}": ("1.0 1.1 2.0", ["Mozilla Public License, version {v}", "Mozilla Public License, v. {v}", "Mozilla Public License {v}"]),
    "EPL-{v}": ("1.0 2.0", ["Eclipse Public License, version {v}", "Eclipse Public License v{v}", "Eclipse Public License {v}"]),
    "ISC": ("", ["ISC License"]),
    "Zlib": ("", ["zlib License"]),
    "BSL-1.0": ("", ["Boost Software License, Version 1.0"]),
    "Unlicense": ("", ["Unlicense"]),
    "CC0-{v}": ("1.0", ["CC0 {v}", "CC0 {v} Universal"]),
}
#: Fixed texts: the six Creative Commons licences, short and in full.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0".split()
#: Fixed texts: how works name their licence, and notices by which they apply one.
SAYINGS = ["Licensed under", "Licensed under the", "Released under", "Released under the", "This work is licensed under", "This work is licensed under the", "Distributed under the terms of the"]
GRANTS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "All-rights-reserved": ["All rights reserved"],
}
GNU_GRANT = "This {work} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation{mark2} either version {v} of the License, or (at your option) any later version."
#: Fixed list: words that tell licences apart wherever they stand; others do so only after a certain word, as versions do.
TELLING = frozenset("apache mit x11 bsd isc zlib unlicense cc cc0 nc nd sa attribution sharealike noncommercial noderivatives noderivs mozilla mpl eclipse epl gpl lgpl agpl gfdl expat boost clause".split())
AFTER = {"by": {"cc"}, "lesser": {"gnu"}, "library": {"gnu"}, "affero": {"gnu"}, "documentation": {"free"}, "general": {"gnu", "lesser", "library", "affero"}}
VERSIONED = frozenset("version v license licence apache gpl lgpl agpl mpl epl gfdl cc0 by nc nd sa bsd attribution sharealike noncommercial noderivatives".split())


def licence_templates() -> dict[str, list[str]]:
    """Licence -> names and notices of works under it, and its whole text where ``license_texts`` holds it."""
    out: dict[str, list[str]] = defaultdict(list)
    named = [(spdx.replace("{v}", v), name.replace("{v}", v)) for spdx, (versions, names) in NAMES.items() for v in versions.split() or [""] for name in names]
    for v in COMMONS_VERSIONS:
        for short, full in COMMONS.items():
            named += [(f"CC-{short}-{v}", f"CC {short} {v}"), (f"CC-{short}-{v}", f"Creative Commons {full} {v}"), (f"CC-{short}-{v}", f"a Creative Commons {full} {v} International License")]
    for spdx, name in named:
        out[spdx] += [f"{saying} {name}" for saying in SAYINGS]
        tag = f"SPDX-License-Identifier: {spdx}"
        if tag not in out[spdx]:
            out[spdx].append(tag)
    for spdx, kind, work, versions in (("GPL", "", "program", "2 3"), ("LGPL", "Lesser ", "library", "2.1 3"), ("LGPL", "Library ", "library", "2"), ("AGPL", "Affero ", "program", "3")):
        for v in versions.split():
            out[f"{spdx}-{v if '.' in v else v + '.0'}"] += [GNU_GRANT.format(work=w, mark=":", mark2=",", kind=kind, v=v) for w in dict.fromkeys((work, "program"))]
    for spdx, notices in GRANTS.items():
        out[spdx] += notices
    for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        out[file.stem.split("+")[0]].append(file.read_text(encoding="utf-8"))
    return dict(out)


TEMPLATES = licence_templates()


def words_of(text: str) -> tuple[list[str], list[int], list[int]]:
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def spellings(word: str) -> list[str]:
    """Other ways to write a version: 2, 2.0, v2 and v2.0 are one, and so are gplv2 and gplv2.0."""
    m = re.fullmatch(r"([al]?gplv|v?)([0-9]+(?:\.[0-9]+)*?)(?:\.0)?", word)
    return [f"{v}{m[2]}{end}" for v in ((m[1],) if "gpl" in m[1] else ("", "v")) for end in ("", ".0")] if m else []


def decides(words: list[str]) -> np.ndarray:
    """Which of the words tell licences or their versions apart."""
    before = ["", *words[:-1]]
    return np.array([w in TELLING or re.fullmatch(r"[al]?gplv[0-9.]+", w) is not None or p in AFTER.get(w, ()) or re.fullmatch(r"v?[0-9]+(?:\.[0-9]+)*", w) is not None and p in VERSIONED for p, w in zip(before, words, strict=True)], bool)


def winnow(hashes: list[int], window: int) -> list[int]:
    """Positions of the rightmost minimum of every window."""
    if not hashes:
        return []
    if len(hashes) <= window:
        return [min(range(len(hashes)), key=lambda k: (hashes[k], -k))]
    return sorted({min(range(a, a + window), key=lambda k: (hashes[k], -k)) for a in range(len(hashes) - window + 1)})


class Index:
    """Templates as word ids, and an inverted index from winnowed grams of word ids to (template, position).

    A notice is indexed by its grams with a deciding word, where it has any: no other can be all of a match.
    """

    def __init__(self, templates: dict[str, list[str]], gram: int = GRAM, window: int = WINDOW):
        self.gram, self.ids, self.names, self.words = gram, {}, [], []
        self.decides: list[np.ndarray] = []
        self.at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        number = 0
        for name in sorted(templates):
            for text in templates[name]:
                words = words_of(text)[0]
                if len(words) < gram:
                    raise ValueError(f"a template of {name} has under {gram} words: {text!r}")
                for w in words:
                    if w not in self.ids:
                        number += 1
                        for same in spellings(w) or [w]:
                            self.ids[same] = number
                self.names.append(name)
                self.words.append(np.array([self.ids[w] for w in words]))
                self.decides.append(decides(words))
        if sum(map(len, self.words)) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of over {MAX_TEMPLATE_WORDS} words do not fit every task; scan with parts of them in turn")
        self.base = number + 1
        self.seeds = []
        for t, words in enumerate(self.words):
            keys = self.keys(words)
            mixed = [(int(k) * 0x9E3779B97F4A7C15) & ((1 << 64) - 1) for k in keys]
            chosen = winnow(mixed, window)
            if len(words) <= NOTICE and self.decides[t].any():
                telling = np.lib.stride_tricks.sliding_window_view(self.decides[t], gram).any(axis=1)
                chosen = np.nonzero(telling)[0].tolist()
            self.seeds.append(len(chosen))
            for k in chosen:
                self.at[int(keys[k])].append((t, k))
        self.known = np.array(sorted(self.at), "u8")
        self.some = np.zeros(1 << 20, bool)
        self.some[self.known * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)] = True

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where a key is an indexed one; a table of bits leaves few to be looked up."""
        at = np.nonzero(keys)[0]
        at = at[self.some[keys[at] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)]]
        return at[self.known[np.minimum(np.searchsorted(self.known, keys[at]), len(self.known) - 1)] == keys[at]]

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """One number per gram, below base ** gram; zero where a word is in no template."""
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.empty(0, "u8")
        out, good = np.zeros(n, "u8"), np.ones(n, bool)
        for k in range(self.gram):
            part = ids[k : k + n]
            out = out * np.uint64(self.base) + part.astype("u8")
            good &= part > 0
        return np.where(good, out, 0)


def align(a: list[int], b: list[int], band: int, free: bool = False) -> list[tuple[int, int]]:
    """Pairs (index in ``a``, index in ``b``) of equal words on the best path, at most ``band`` off the diagonals between its ends.

    A match scores 2, a changed or skipped word -1. Both are used up, or with ``free`` any part from their beginnings on.
    """
    n, m = len(a), len(b)
    low, high = min(0, m - n) - band, max(0, m - n) + band
    worst = -(1 << 30)
    above, steps = {0: 0}, []
    best, at = 0, (0, 0)
    for i in range(n + 1):
        row, step = {}, {}
        for j in range(max(0, i + low), min(m, i + high) + 1):
            if i == 0 and j == 0:
                row[j] = 0
                continue
            value, kind = worst, 0
            if i and j and (d := above.get(j - 1, worst)) > worst:
                value, kind = d + (2 if a[i - 1] == b[j - 1] else -1), 1
            if i and above.get(j, worst) - 1 > value:
                value, kind = above[j] - 1, 2
            if j and row.get(j - 1, worst) - 1 > value:
                value, kind = row[j - 1] - 1, 3
            row[j], step[j] = value, kind
            if value > best:
                best, at = value, (i, j)
        steps.append(step)
        above = row
    i, j = at if free else (n, m)
    pairs = []
    while i or j:
        kind = steps[i].get(j, 0)
        if kind == 1:
            i, j = i - 1, j - 1
            if a[i] == b[j]:
                pairs.append((i, j))
        elif kind == 2:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def chains(hits: list[tuple[int, int]], band: int) -> Iterator[list[tuple[int, int]]]:
    """Runs of hits (place in the text, place in the template) that go on in both, at most ``GAP`` words and ``band`` diagonals apart.

    A hit that left the run's diagonal goes again when the run is met on its old diagonal.
    """
    going: list[list[tuple[int, int]]] = []
    for p, q in hits:
        for c in [c for c in going if p - c[-1][0] > GAP]:
            going.remove(c)
            yield c
        fits = [c for c in going if c[-1][0] < p and c[-1][1] < q and abs((p - q) - (c[-1][0] - c[-1][1])) <= band]
        back = next((c for c in going if len(c) > 1 and c[-2][0] < p and p - q == c[-2][0] - c[-2][1] != c[-1][0] - c[-1][1]), None)
        if back is not None and not any(p - q == c[-1][0] - c[-1][1] for c in fits):
            back[-1] = (p, q)
        elif fits:
            min(fits, key=lambda c: (abs((p - q) - (c[-1][0] - c[-1][1])), -c[-1][0])).append((p, q))
        else:
            going.append([(p, q)])
    yield from going


def matched(template: np.ndarray, ids: np.ndarray, chain: list[tuple[int, int]], gram: int, band: int) -> np.ndarray:
    """Per word of the template the place in the text that it matches, -1 for none: hits are taken as they are, what lies
    between them is aligned, and so are the words before the first and after the last one."""
    out = np.full(len(template), -1)
    first_p, first_q = chain[0]
    a, b = template[max(0, first_q - GAP) : first_q][::-1], ids[max(0, first_p - min(first_q, GAP) - band) : first_p][::-1]
    for i, j in align(a.tolist(), b.tolist(), band, free=True):
        out[first_q - 1 - i] = first_p - 1 - j
    end_p, end_q = first_p, first_q
    for p, q in chain:
        # Hits that overlap the last one go on where it ends, if that is on one diagonal.
        over = max(0, end_p - p, end_q - q)
        if over and (end_p - p != end_q - q or over >= gram):
            continue
        p, q, size = p + over, q + over, gram - over
        x, y = template[end_q:q], ids[end_p:p]
        if len(x) == len(y) and (x == y).all():
            out[end_q:q] = np.arange(end_p, p)
        else:
            for i, j in align(x.tolist(), y.tolist(), band):
                out[end_q + i] = end_p + j
        out[q : q + size] = np.arange(p, p + size)
        end_p, end_q = p + size, q + size
    a = template[end_q : end_q + GAP]
    for i, j in align(a.tolist(), ids[end_p : end_p + len(a) + band].tolist(), band, free=True):
        out[end_q + i] = end_p + j
    return out


def near_all(wanted: np.ndarray, ids: np.ndarray, chain: list[tuple[int, int]], reach: int) -> bool:
    """Whether a notice's deciding words occur at all about a chain: spares most alignments."""
    return set(wanted.tolist()) <= set(ids[max(0, chain[0][0] - reach) : chain[-1][0] + reach + GRAM].tolist())


def tells(place: np.ndarray, decides_here: np.ndarray, text_decides: np.ndarray) -> bool:
    """Whether a notice's deciding words are all there, with no other such word within the passage, and with no word put in
    between them or left out, where they are few and so make up a name."""
    want = np.nonzero(decides_here)[0]
    if (place[want] < 0).any():
        return False
    span = np.nonzero(text_decides[place[place >= 0][0] : place[place >= 0][-1] + 1])[0] + place[place >= 0][0]
    if not np.isin(span, place).all():
        return False
    if len(place) > 40 or not len(want):
        return True
    return int(place[want[-1]] - place[want[0]]) == int(want[-1] - want[0])


def scan(text: str, index: Index, band: int = BAND, coverage: float = COVERAGE) -> list[tuple]:
    """(licence, coverage, start, end, template words, matched words) per passage, non-overlapping, best coverage first at a place."""
    get = index.ids.get
    ids = np.array([get(w, 0) for w in WORD.findall(text.lower())] if text.isascii() else [get(w.lower(), 0) for w in WORD.findall(text)])
    keys = index.keys(ids)
    places = index.places(keys)
    if not len(places):
        return []
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for p in places.tolist():
        for t, q in index.at[int(keys[p])]:
            hits[t].append((p, q))
    text_decides, found = None, []
    for t, some in hits.items():
        template = index.words[t]
        if len(some) < SEEDS * index.seeds[t]:
            continue
        for chain in chains(some, band):
            if len(chain) < SEEDS * index.seeds[t]:
                continue
            if len(template) <= NOTICE and not near_all(template[index.decides[t]], ids, chain, len(template) + band):
                continue
            place = matched(template, ids, chain, index.gram, band)
            known = place[place >= 0]
            if len(known) < coverage * len(template):
                continue
            if len(template) <= NOTICE:
                text_decides = decides(words_of(text)[0]) if text_decides is None else text_decides
                if not tells(place, index.decides[t], text_decides):
                    continue
            found.append((len(known), len(known) / len(template), int(known[0]), int(known[-1]) + 1, t))
    if not found:
        return []
    _, starts, ends = words_of(text)
    found.sort(key=lambda x: (-x[0], -x[1], x[2], x[4]))
    out, taken = [], []
    for n, share, first, end, t in found:
        if all(end <= a or first >= b for a, b in taken):
            taken.append((first, end))
            out.append((index.names[t], share, starts[first], ends[end - 1], len(index.words[t]), n))
    return sorted(out, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, band: int = BAND, coverage: float = COVERAGE) -> DataFrame:
    """One row per licence passage of ``docs`` (doc_id, text): licence, coverage of the template, character span, words.

    A single pass over whole texts, of any length, without a shuffle; the templates' index travels with the task and is
    bounded. Grams with a word of no template are never looked up, so that ordinary text costs a dictionary look-up per
    word. Of a notice (up to ``NOTICE`` words) the words that name the licence and its version must all be there, and no
    other such word between them; a whole text is told by its coverage. Templates have at least ``GRAM`` words. Passages
    of a document do not overlap; of two at one place that with more matched words stays, then that of higher coverage. Null
    and empty texts have no passages; rows of one id, null ones too, are reported each; no rows give no rows; other columns
    are not looked at.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(templates)
        for batch in batches:
            rows = [(doc, *r) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) if text for r in scan(text, index, band, coverage)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "coverage", "start", "end", "template_words", "matched_words"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, license string, coverage double, start long, end long, template_words int, matched_words int")
