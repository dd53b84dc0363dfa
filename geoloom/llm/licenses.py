"""Licence scans by a positional index of rare words.

The index posts each licence word with the templates that hold it and its places there. A
file's licence words of highest IDF (over all files) are looked up first: for each template
the rarest word of its mandatory key phrase. Their postings propose alignments, one for each
place in the file; the postings of the key phrase's other words must stand at the same
relative position, and then all postings of the template are intersected so. An alignment
counts if its key phrase is complete and enough of all its words agree. As the key phrase
must be complete, its rarest word misses no alignment, and the work follows the places of
rare words, not the number of templates. Files are read twice, for frequencies and for
matches, and never shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._env import ship, widened


@dataclass(frozen=True)
class Template:
    """A licence text or notice, and the phrase in it that must be complete.

    label: its lower-case SPDX identifier, or the name of a family of licences.
    """

    label: str
    text: str
    key: str

    @property
    def words(self) -> list[str]:
        return re.findall(r"[a-z0-9]+", self.text.lower())


#: Phrases whose every place counts, and their labels.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license"),
    Template("apache", "apache license", "apache license"),
    Template("cc-by", "cc by", "cc by"),
    Template("mit", "mit license", "mit license"),
)

TEMPLATES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses license 2 0"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    Template("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", "cc by nd 4 0"),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc0-1.0", "to the extent possible under law the author has waived all copyright cc0 1 0 universal", "cc0 1 0 universal"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
)


# The texts of short licences as their authors published them.
_AS_IS = (
    'the software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, '
    "fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, "
    "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the '
    "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
    "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
    "included in all copies or substantial portions of the Software. " + _AS_IS
)
_ISC_WARRANTY = (
    'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. '
    "In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
    "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
)
_BSD_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution. "
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific "
    "prior written permission. "
)
_BSD_WARRANTY = (
    'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of '
    "merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, "
    "special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business "
    "interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of "
    "the use of this software, even if advised of the possibility of such damage."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
    "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
    "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented "
    "as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
    "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
TEXTS = (
    Template("mit", _MIT, "without limitation the rights to use copy modify merge publish distribute sublicense"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY, "provided that the above copyright notice and this permission notice appear in all copies"),
    Template("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY, "with or without fee is hereby granted the software is provided as is"),
    Template("bsd-2-clause", _BSD_2 + _BSD_WARRANTY, "provided with the distribution this software is provided by"),
    Template("bsd-3-clause", _BSD_2 + _BSD_3 + _BSD_WARRANTY, "may be used to endorse or promote products derived from this software"),
    Template("zlib", _ZLIB, "must not be misrepresented you must not claim that you wrote the original software"),
    Template("unlicense", _UNLICENSE, "free and unencumbered software released into the public domain"),
)
TEMPLATES += TEXTS


class Index:
    """Postings of templates over numbered words; number 0 is any other word."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        texts = [t.words for t in templates]
        self.words = sorted({w for x in texts for w in x})
        self.number = {w: i + 1 for i, w in enumerate(self.words)}
        data = np.frombuffer("".join(self.words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.words])
        h = W.runs_hash(data, ends - np.diff(ends, prepend=0), ends)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[h >> np.uint64(48)] = True
        self.flat = np.array([self.number[w] for x in texts for w in x])
        self.size = np.array([len(x) for x in texts])
        self.first = np.cumsum(self.size) - self.size
        self.key, self.key_size = [], np.array([len(t.key.split()) for t in templates])
        for t, x in zip(templates, texts, strict=True):
            key = t.key.split()
            self.key.append(next(i for i in range(len(x)) if x[i : i + len(key)] == key))
        self.key = np.array(self.key)

    def numbers(self, w: W.Words) -> np.ndarray:
        h = w.hashes()
        out = np.zeros(len(h), np.int32)
        near = np.flatnonzero(self.sieve[h >> np.uint64(48)])
        at = np.minimum(np.searchsorted(self.hashes, h[near]), len(self.hashes) - 1)
        hit = self.hashes[at] == h[near]
        out[near[hit]] = self.order[at[hit]] + 1
        return out

    def anchors(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Postings of the rarest word of each key phrase: by number, offsets into templates and places."""
        at = np.array([k + int(idf[self.flat[f + k : f + k + n] - 1].argmax()) for f, k, n in zip(self.first, self.key, self.key_size, strict=True)])
        word = self.flat[self.first + at]
        order = np.argsort(word, kind="stable")
        return np.searchsorted(word[order], np.arange(len(self.words) + 2)), order, at[order]

    def _agree(self, numbers, lo, hi, start, template, begin, size):
        """For each alignment, how many of the `size` words of its template from `begin` on stand at their places."""
        end = np.cumsum(size)
        step = np.arange(int(size.sum())) - np.repeat(end - size, size) + np.repeat(begin, size)
        where = np.repeat(start, size) + step
        inside = (where >= np.repeat(lo, size)) & (where < np.repeat(hi, size))
        same = inside & (numbers[np.clip(where, 0, len(numbers) - 1)] == self.flat[np.repeat(self.first[template], size) + step])
        return np.add.reduceat(same, end - size, dtype=np.int64)

    def matches(self, numbers: np.ndarray, w: W.Words, anchors, coverage: float):
        """(template, row, first word of the alignment in it, share of its words that agree)."""
        bounds, of, place = anchors
        at = np.flatnonzero(np.diff(bounds)[numbers] > 0) if len(numbers) else np.zeros(0, np.int64)
        many = np.diff(bounds)[numbers[at]]
        posting = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[numbers[at]], many)
        template, start = of[posting], np.repeat(at, many) - place[posting]
        row = np.repeat(np.searchsorted(w.first, at, side="right") - 1, many)
        lo, hi = w.first[row], w.first[row + 1]
        for begin, size, least in ((self.key, self.key_size, 1.0), (np.zeros_like(self.size), self.size, coverage)):
            if not len(start):
                break
            share = self._agree(numbers, lo, hi, start, template, begin[template], size[template]) / size[template]
            ok = share >= least
            template, start, row, lo, hi, share = (x[ok] for x in (template, start, row, lo, hi, share))
        return template, row, start - lo, share if len(start) else np.zeros(0)


def _frequencies(index: Index):
    def run(batches):
        total, docs = np.zeros(len(index.words) + 1, np.int64), 0
        for b in batches:
            for at, end, data, rows in W.chunks(b.column(0)):
                w = W.split(data, rows, "alnum", lower=True)
                num = index.numbers(w)
                some = np.flatnonzero(num)
                pairs = np.unique(w.row_of()[some] * (len(index.words) + 1) + num[some])
                total += np.bincount(pairs % (len(index.words) + 1), minlength=len(total))
                docs += end - at
        total[0] = docs
        yield pa.RecordBatch.from_pydict({"word": np.arange(len(total)), "n": total})

    return run


_OUT = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "spans": "array<struct<label:string,first:long,end:long,share:double>>"}


def _scan(index: Index, base: int, anchors, text: int, names: list[str], coverage: float):
    def run(batches):
        for b in batches:
            for at, end, data, rows in W.chunks(b.column(text)):
                w = W.split(data, rows, "alnum", lower=True)
                n = end - at
                n_base, score = np.zeros(n, np.int64), np.zeros(n)
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                labels: dict[int, set] = {}
                base_labels: dict[int, set] = {}
                spans: dict[int, list] = {}
                template, row, start, share = index.matches(index.numbers(w), w, anchors, coverage)
                known = template < base  # base phrases are their own key phrases: all of their words agree
                np.add.at(n_base, row[known], 1)
                np.minimum.at(first, row[known], start[known])
                np.maximum.at(last, row[known], start[known])
                np.maximum.at(score, row, share)
                for t, r, s, x in zip(template.tolist(), row.tolist(), start.tolist(), share.tolist(), strict=True):
                    label = index.templates[t].label
                    labels.setdefault(r, set()).add(label)
                    if t < base:
                        base_labels.setdefault(r, set()).add(label)
                    spans.setdefault(r, []).append({"label": label, "first": max(s, 0), "end": min(s + int(index.size[t]), int(w.counts[r])), "share": x})
                some = n_base > 0
                join = lambda of: pa.array([",".join(sorted(of.get(r, ()))) for r in range(n)], pa.string())
                kind = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
                out = [
                    pa.array(w.counts.astype(np.int64)), pa.array(n_base), pa.array(first, mask=~some), pa.array(last, mask=~some), join(base_labels), join(labels), pa.array(score),
                    pa.array([sorted(spans.get(r, []), key=lambda s: (s["first"], s["end"], s["label"])) for r in range(n)], kind),
                ]
                yield pa.RecordBatch.from_arrays([*b.slice(at, n).columns[: len(names)], *out], [*names, *_OUT])

    return run


def scan(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    n_base: places of base phrases; first_word, last_word: their smallest and largest start;
    labels: of base phrases and of templates aligned with `coverage` of their words or more;
    score: the largest share of a phrase or template that agrees (0 without any); spans:
    all that was found. Words are runs of letters, digits and non-ASCII characters, A-Z
    lower-cased; a null or empty text has none and matches nothing. Repeated rows and null
    ids get the results of their texts, an empty table gives an empty one; a long text takes
    some tens of bytes a word. Columns of these names are replaced, all others pass unchanged.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*_OUT)
    names = docs.columns
    index = Index(BASE + templates)
    seen = docs.select("text").mapInArrow(_frequencies(index), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = dict(seen.collect())  # a row for each word of the templates
    idf = np.array([np.log((1 + n.get(0, 0)) / (1 + n.get(i + 1, 0))) for i in range(len(index.words))])
    return docs.mapInArrow(_scan(index, len(BASE), index.anchors(idf), names.index("text"), names, coverage), widened(docs, **_OUT))
