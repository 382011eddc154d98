"""License scan by conditional compression.

Every word of every text is looked at. Of any k + 1 words of a template of which k may differ, a match keeps at least
one, so each template has k + 1 anchors, words that are rare in prose; an automaton looks for all anchors in one pass,
and texts without any are settled. Around an anchor, the template can only stand where m + k words hold m - k of its m
own; where that holds for some template is a candidate block, and no match lies outside of one. A block is compressed by
zstandard alone and with each such template as raw dictionary, and the templates are ranked by how much smaller it gets.

Matches are taken best first: a smaller share of differences, then a larger reduction of the block. The words that a
window lacks bound a template's differences from below, so templates are confirmed in the order of bound and reduction,
by the exact differences in wording: the least number of words to insert, drop or replace so that the template stands
there. Once the matches taken leave a template no room for its least number of words, all that it could have there
would overlap a better match, and it is not confirmed: the winner of the ranking mostly stands alone. Nothing is
capped; the result is that of confirming all.

Names of licenses count after a word of granting ("released under ..."), after a label with a colon ("license: MIT"),
in SPDX tags, and in the heads of full license texts; a name that prose mentions is no match.

Edge cases: null text is empty; documents without a match have no license and null figures; n_blocks counts the
candidate blocks; of equal licenses the earlier one is the document's; repeated rows are rows; an empty table gives
no rows; other columns are ignored. A long text is read word by word; its codes take two bytes a word.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Public license notices, by identifier. Fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: Names of licenses in short notices and tags. Fixed values.
NAMES = {
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache License v2.0", "Apache 2.0", "Apache-2.0"),
    "MIT": ("MIT License", "MIT licence"),
    "ISC": ("ISC License",),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause"),
    "GPL-2.0": ("GPL v2", "GPLv2", "GPL-2.0", "GNU GPL v2", "GNU General Public License v2.0", "GNU General Public License, version 2"),
    "GPL-3.0": ("GPL v3", "GPLv3", "GPL-3.0", "GNU GPL v3", "GNU General Public License v3.0", "GNU General Public License, version 3"),
    "LGPL-3.0": ("LGPL v3", "LGPLv3", "LGPL-3.0", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"),
    "MPL-2.0": ("MPL 2.0", "MPL-2.0", "Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
    "CC-BY-4.0": ("CC BY 4.0", "CC-BY 4.0", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "CC-BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "CC-BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0"),
    "Unlicense": ("Unlicense",),
}
#: Heads of full license texts. Fixed values.
HEADS = {
    "Apache-2.0": "Apache License Version 2.0, January 2004",
    "MIT": "MIT License Copyright (c)",
    "ISC": "ISC License Copyright (c)",
    "BSD-3-Clause": "BSD 3-Clause License Copyright (c)",
    "GPL-2.0": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "LGPL-3.0": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "MPL-2.0": "Mozilla Public License Version 2.0 1. Definitions",
    "CC-BY-4.0": "Attribution 4.0 International",
    "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0 International",
    "CC-BY-NC-4.0": "Attribution-NonCommercial 4.0 International",
    "CC0-1.0": "CC0 1.0 Universal",
}
#: Wordings of short notices, and labels that a colon follows. Fixed values.
GRANTS = ("licensed", "licenced", "released", "distributed", "available", "published", "provided")
WORDINGS = ("{} under {}", "{} under the {}", "{} under the terms of the {}")
LABELS = ("License", "Licence", "Lizenz", "Licencia")
#: Words that prose is full of, the last choice as anchors. Fixed values.
ORDINARY = frozenset("1 2 3 29 a and any as at available by c cc copies for general in international is mit notice of on or other person provided published public subject that the this to under use version with work works you".split())
#: The share of a template's words that may differ.
MOST_DIFFERENT = 0.15

_PLAIN = [(k, t) for k, v in TEMPLATES.items() for t in v] + list(HEADS.items())
_PLAIN += [(k, w.format(g, n)) for k, v in NAMES.items() for n in v for w in WORDINGS for g in GRANTS]
_PLAIN += [(k, f"SPDX-License-Identifier: {k}{x}") for k in NAMES for x in ("", "-only", "-or-later")]
_ALL = _PLAIN + [(k, f"{x}: {n}") for k, v in NAMES.items() for n in dict.fromkeys((*v, k)) for x in LABELS]
_NAMES, _TEXTS = [k for k, _ in _ALL], [t for _, t in _ALL]
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
_RESULT = "doc_id long, n_blocks long, license string, licenses array<string>, reduction double, differences long, template_words long"


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


_WORDS = [words(t) for t in _TEXTS]
#: Of the templates that words alone decide; labelled names must stand word by word, with a colon after the label.
_TEMPLATE_WORDS = _WORDS[: len(_PLAIN)]


_CODES = {w: i for i, w in enumerate(dict.fromkeys(w for t in _WORDS for w in t))}
_OTHER = len(_CODES)
_OWN = [np.array([_CODES[w] for w in t]) for t in _WORDS]
_MOST = [int(MOST_DIFFERENT * len(t) + 1e-9) if i < len(_PLAIN) else 0 for i, t in enumerate(_WORDS)]


def _anchors() -> tuple[dict[int, list[tuple[int, int]]], dict[int, list[int]]]:
    """By code of an anchor: (place in the template, words) of the templates that must stand word by word, and the
    numbers of the others."""
    templates = np.bincount(np.concatenate([np.unique(o) for o in _OWN]))
    exact, near = {}, {}
    for i, (t, own, most) in enumerate(zip(_WORDS, _OWN, _MOST)):
        for j in sorted(range(len(t)), key=lambda j: (t[j] in ORDINARY, len(t[j]) < 4, templates[own[j]], -len(t[j]), j))[: most + 1]:
            if most:
                near.setdefault(int(own[j]), set()).add(i)
            else:
                exact.setdefault(int(own[j]), set()).add((j, len(t)))
    return {c: sorted(x) for c, x in exact.items()}, {c: sorted(x) for c, x in near.items()}


_EXACT, _NEAR = _anchors()
#: Templates that must stand word by word, by their words.
_AS_IS: dict[tuple[int, ...], list[int]] = {}
for _i, _own in enumerate(_OWN):
    if not _MOST[_i]:
        _AS_IS.setdefault(tuple(_own.tolist()), []).append(_i)
_ANCHOR = np.zeros(_OTHER + 1, bool)
_ANCHOR[[*_EXACT, *_NEAR]] = True


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for w, c in _CODES.items():
        if _ANCHOR[c]:
            out.add_word(w, len(w))
    out.make_automaton()
    return out


def has_anchor(text: str) -> bool:
    """Whether an anchor stands in the text as a word, or as the first or last part of one."""
    low = text.lower()
    for end, size in _automaton().iter(low):
        if not (low[end - size : end - size + 1] if end >= size else "").isalnum() and not low[end + 1 : end + 2].isalnum():
            return True
    return False


def coded(text: str) -> np.ndarray:
    """The words of a text, as numbers of template words."""
    get = _CODES.get
    found = _WORD.findall(text) if len(text) < 1 << 20 else (m.group() for m in _WORD.finditer(text))
    return np.fromiter((get(w, _OTHER) for w in map(str.lower, found)), np.int16)


def _changes(own: np.ndarray, codes: np.ndarray, anchored: bool = False) -> np.ndarray:
    """By number of words read: least changes so that the template ends there, from any start or from the first word."""
    column = np.arange(len(own) + 1)
    step, out = column, [len(own)]
    for i, code in enumerate(codes.tolist(), 1):
        now = np.concatenate([[i if anchored else 0], np.minimum(column[:-1] + (own != code), column[1:] + 1)])
        # A dropped template word costs one more than the place before it.
        column = np.minimum.accumulate(now - step) + step
        out.append(int(column[-1]))
    return np.array(out)


def differences(template: list[str], block: list[str]) -> int:
    """Least number of words changed so that the template stands somewhere in the block."""
    codes = {w: i for i, w in enumerate(dict.fromkeys(template))}
    return int(_changes(np.array([codes[w] for w in template]), np.array([codes.get(w, -1) for w in block], int)).min())


def _windows(codes: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first word, the one after the last, template, least number of differences) of the ranges of words outside of
    which no template can match: with m words and k changes allowed, a match is at most m + k words long, and has an
    anchor and at least m - k of the template's words."""
    near: dict[int, list[int]] = {}
    for j in np.flatnonzero(_ANCHOR[codes]).tolist():
        for place, m in _EXACT.get(c := int(codes[j]), ()):
            if (a := j - place) >= 0 and a + m <= len(codes):
                for i in _AS_IS.get(tuple(codes[a : a + m].tolist()), ()):
                    yield a, a + m, i, 0
        for i in _NEAR.get(c, ()):
            near.setdefault(i, []).append(j)
    for i, places in near.items():
        m, k = len(_OWN[i]), _MOST[i]
        at = np.array(places)
        cut = np.flatnonzero(np.diff(at) >= 2 * (m + k)) + 1
        for group in np.split(at, cut):
            low, high = max(0, int(group[0]) - m - k + 1), min(len(codes), int(group[-1]) + m + k)
            counts = np.zeros(high - low + 1, np.int32)
            np.cumsum(np.isin(codes[low:high], _OWN[i]), out=counts[1:])
            width = min(m + k, high - low)
            held = counts[width:] - counts[: len(counts) - width]
            fits = np.flatnonzero(held >= m - k)
            for run in np.split(fits, np.flatnonzero(np.diff(fits) > width) + 1) if len(fits) else ():
                yield low + int(run[0]), low + int(run[-1]) + width, i, max(0, m - int(held[run].max()))


def candidates(codes: np.ndarray) -> list[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """Blocks of words (first, the one after the last) in which templates may match, each with its windows:
    (first, the one after the last, template, least number of differences)."""
    out: list[tuple[int, int, list]] = []
    for window in sorted(set(_windows(codes))):
        if out and window[0] < out[-1][1]:
            out[-1] = (out[-1][0], max(window[1], out[-1][1]), [*out[-1][2], window])
        else:
            out.append((window[0], window[1], [window]))
    return out


def _room(taken: np.ndarray, size: int) -> bool:
    """Whether so many neighbours are free."""
    ends = np.flatnonzero(np.concatenate([[True], taken, [True]]))
    return bool((np.diff(ends) > size).any())


def _start(i: int, end: int, n: int, codes: np.ndarray) -> int:
    """The last word from which template i ends at ``end`` with n changes."""
    back = codes[max(0, end - len(_OWN[i]) - n) : end][::-1]
    return end - int(np.flatnonzero(_changes(_OWN[i][::-1], back, True) == n)[0])


class Scanner:
    def __init__(self):
        self.alone = zstandard.ZstdCompressor(level=3, write_content_size=False)
        #: Compressors keep their working memory.
        self.given = functools.lru_cache(64)(self._given)
        #: Templates confirmed by exact differences, for tests and tuning.
        self.confirmed = 0

    def _given(self, i: int) -> zstandard.ZstdCompressor:
        words_ = zstandard.ZstdCompressionDict(_TEXTS[i].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=words_)

    def reductions(self, templates, part: str) -> dict[int, float]:
        """By template, the share of its size that a part loses by it."""
        data = part.encode("utf-8", "replace")
        size = len(self.alone.compress(data))
        return {i: 1 - len(self.given(i).compress(data)) / size for i in templates}

    def matches(self, text: str) -> list[tuple[str, float, int, int, int, int]]:
        """License, size reduction, differences and words of the template, and place in the text (first word and
        the one after the last) of every match that overlaps no better one, the best first."""
        return self.found(text)[1]

    def found(self, text: str) -> tuple[int, list[tuple[str, float, int, int, int, int]]]:
        """Number of candidate blocks, and matches."""
        if not has_anchor(text):
            return 0, []
        codes = coded(text)
        blocks = candidates(codes)
        if not blocks:
            return 0, []
        at = [m.span() for m in _WORD.finditer(text)]
        # Best first: what is not confirmed comes before what is equal to its bound.
        heap = []
        for first, last, windows in blocks:
            smaller = self.reductions({i for _, _, i, _ in windows}, text[at[first][0] : at[last - 1][1]])
            heap += [(least / len(_OWN[i]), -smaller[i], False, i, a, b, least) for a, b, i, least in windows]
        heapq.heapify(heap)
        taken = np.zeros(len(codes), bool)
        out = []
        while heap:
            _, worse, exact, i, a, b, n = heapq.heappop(heap)
            own, most = _OWN[i], _MOST[i]
            if exact:
                if not taken[a:b].any():
                    taken[a:b] = True
                    out.append((_NAMES[i], self.reductions([i], text[at[a][0] : at[b - 1][1]])[i], n, len(own), a, b))
            elif _room(taken[a:b], len(own) - most):
                self.confirmed += 1
                if i >= len(_PLAIN) and not any(c in text[at[a][1] : at[a + 1][0]] for c in ":="):
                    continue
                if not most:
                    heapq.heappush(heap, (0.0, worse, True, i, a, b, 0))
                    continue
                by_end = _changes(own, codes[a:b])
                for e in np.flatnonzero(by_end <= most).tolist():
                    n = int(by_end[e])
                    heapq.heappush(heap, (n / len(own), worse, True, i, _start(i, a + e, n, codes), a + e, n))
        return len(blocks), out

    def scanned(self, texts: list[str]) -> list[tuple]:
        """Number of blocks, license, all licenses, reduction, differences and template words of each text."""
        out = []
        for t in texts:
            n, found = self.found(t or "")
            best = found[0] if found else (None,) * 4
            out.append((n, best[0], sorted({m[0] for m in found}), *best[1:4]))
        return out


_scanner: list[Scanner] = []
#: Text bytes that a worker handles at a time.
CHUNK = 2 << 20


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_blocks, license (of the best match), licenses, reduction, differences, template_words of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _scanner:
            _scanner.append(Scanner())
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.int64(), pa.int64()]
        names = ["doc_id", "n_blocks", "license", "licenses", "reduction", "differences", "template_words"]
        for batch in batches:
            for part in bpe.chunks(batch, "text", CHUNK):
                out = _scanner[0].scanned(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, _RESULT)


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
