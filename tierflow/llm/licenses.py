"""Licence scan by a positional index of rare words.

Every template (the words of a licence text, notice or naming line) is indexed by its rarest words, as
word -> (template, position): the words of highest IDF that carry SIGNATURE of the template's whole IDF,
so an alignment of the share `cover` must have some of them. A first pass over all documents counts in
how many each licence word occurs, which gives the IDF. The second pass reads every whole text again:

1. Each of the file's words that is in the index (its highest-IDF licence words) draws its postings; a
   posting votes with the word's IDF for a template at a relative position, file position minus template
   position. Nothing else makes candidates.
2. Votes of a template at neighbouring relative positions (within `band`) are chained. Where they reach
   what an alignment of the share `cover` can't miss, the template is aligned there: the heaviest common
   subsequence by IDF within the band, so inserted, changed and lost words cost only themselves.
3. It is accepted if the aligned words carry the share `cover` of the template's IDF and all its mandatory
   key phrases stand word for word inside the alignment's stretch of the file.

Templates that share most of their words (a licence in two versions, with two or three clauses) are told
apart by their key phrases. Base phrases go through the same index with a threshold of all words, looked
up by the phrase's own rarest word, so that every place is found.

Both passes are maps over the input; only the counts of the fixed licence vocabulary (some hundreds of
numbers) reach the driver. Defined results: null text is empty (no words, no labels, score 0);
repeated rows give repeated rows; a null doc_id stays null; an empty table gives no rows; extra
columns are ignored; very long texts are read whole, with work in proportion to their rare licence words.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import pieces


# Phrases that name a licence wherever their words stand together.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Fixed values: (label, template words, key phrases that must stand inside the alignment). Words only: lower case, no marks.
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THIRD = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
_GPL = "is free software you can redistribute it and or modify it under the terms of the {0} as published by the free software foundation either version {1} of the license or at your option any later version"
_GPL_NO_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {0} for more details"
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["free of charge", "substantial portions of the software"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["free of charge", "associated documentation files"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the terms of the mit license", ["mit license"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["apache license", "as is basis"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    *((f"{name}-{v}", " ".join(["this program", _GPL.format(text, n), "this program", _GPL_NO_WARRANTY.format(text)]), [text, f"version {n}"]) for name, text, v, n in (("gpl", "gnu general public license", "2", "2"), ("gpl", "gnu general public license", "3", "3"), ("agpl", "gnu affero general public license", "3", "3"))),
    *((f"{name}-{v}", f"{what} {_GPL.format(text, n)}", [text, f"version {n}"]) for name, what, text, v, n in (("gpl", "this program", "gnu general public license", "2", "2"), ("gpl", "this program", "gnu general public license", "3", "3"), ("lgpl", "this library", "gnu lesser general public license", "2.1", "2 1"), ("lgpl", "this library", "gnu lesser general public license", "3", "3"), ("agpl", "this program", "gnu affero general public license", "3", "3"))),
    *((f"{name}-{v}", f"this work is licensed under the {text} version {n}", [f"{text} version {n}"]) for name, text, v, n in (("gpl", "gnu general public license", "3", "3"), ("gpl", "gnu general public license", "2", "2"), ("lgpl", "gnu lesser general public license", "3", "3"), ("lgpl", "gnu lesser general public license", "2.1", "2 1"), ("agpl", "gnu affero general public license", "3", "3"))),
    ("bsd-3", f"{_BSD} {_BSD_THIRD} {_AS_IS}", ["source and binary forms", "endorse or promote products"]),
    ("bsd-2", f"{_BSD} {_AS_IS}", ["source and binary forms", "provided with the distribution this software is provided"]),
    ("bsd-3", "released under the bsd 3 clause license", ["bsd 3 clause"]),
    ("bsd-2", "released under the bsd 2 clause license", ["bsd 2 clause"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee", "notice appear in all copies"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["alter it and redistribute it freely"]),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ["person or organization", "accompanying documentation"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ["eclipse public license 2 0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["unencumbered software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ["cc0 with this work"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ["attribution noderivatives"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial 4 0"]),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["attribution noncommercial sharealike"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
]

#: The share of a template's IDF that its indexed words carry; an alignment of `cover` then has SIGNATURE - (1 - cover) of it.
SIGNATURE = 0.5

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

#: Bytes to word characters: A-Z lower-cased; letters, digits and all bytes over 127 kept; others to spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Index:
    """The positional index of rare words; idf gives each licence word's rarity."""

    def __init__(self, templates=None, phrases=None):
        self.vocab: dict[bytes, int] = {}
        self.templates = [(label, self.ids(t), [self.ids(k) for k in keys]) for label, t, keys in (templates or TEMPLATES)]
        self.phrases = [(label, self.ids(p)) for p, label in (phrases or BASE_PHRASES).items()]
        self.weigh(1, np.zeros(len(self.vocab)))

    def ids(self, text: str) -> np.ndarray:
        return np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)], dtype=np.int32)

    def weigh(self, n_docs: int, df: np.ndarray) -> None:
        """Set the IDF and index each template's rarest words (of equal ones the earlier in the vocabulary)."""
        self.idf = np.log((n_docs + 1) / (df + 1)) + 1e-3
        self.total = np.array([self.idf[ids].sum() for _, ids, _ in self.templates])
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, (_, ids, _) in enumerate(self.templates):
            mass = 0.0
            for w in sorted(set(ids.tolist()), key=lambda w: (-self.idf[w], w)):
                if mass >= SIGNATURE * self.total[t] - 1e-9:
                    break
                at = np.flatnonzero(ids == w)
                mass += self.idf[w] * len(at)
                postings.setdefault(w, []).extend((t, q) for q in at.tolist())
        self.rare = np.zeros(len(self.vocab) + 1, dtype=bool)  # the last is that of other words
        self.rare[list(postings)] = True
        self.postings = {w: tuple(np.array(x, dtype=np.int64) for x in zip(*found)) for w, found in postings.items()}

    def look_up(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, words, [-1] * len(words)), dtype=np.int32, count=len(words))

    @staticmethod
    def stands(seq: np.ndarray, part: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the starts `at`, those where `part` stands in `seq` word for word."""
        at = at[(at >= 0) & (at + len(part) <= len(seq))]
        return at[(seq[at[:, None] + np.arange(len(part))] == part).all(axis=1)] if len(at) else at

    def base(self, seq: np.ndarray) -> list[tuple[int, str]]:
        found = []
        for label, part in self.phrases:
            q = int(np.argmax(self.idf[part]))
            found += [(p, label) for p in self.stands(seq, part, np.flatnonzero(seq == part[q]) - q).tolist()]
        return found

    def candidates(self, seq: np.ndarray, cover: float, band: int) -> list[tuple[int, int]]:
        """(template, relative position) where the votes of a band reach what an alignment must have."""
        places = np.flatnonzero(self.rare[seq])
        if not len(places):
            return []
        drawn = []
        for w in np.unique(seq[places]).tolist():
            at, (t, q) = places[seq[places] == w], self.postings[w]
            drawn.append((np.repeat(t[None, :], len(at), axis=0).ravel(), (at[:, None] - q[None, :]).ravel(), np.full(len(at) * len(t), self.idf[w])))
        t, d, v = (np.concatenate(x) for x in zip(*drawn))
        order = np.lexsort((d, t))
        t, d, v = t[order], d[order], v[order]
        key = t * (len(seq) + 4096) * 4 + d  # templates apart by more than any band
        upto, votes = np.searchsorted(key, key + band, side="right"), np.concatenate([[0.0], np.cumsum(v)])
        sums = votes[upto] - votes[: len(v)]  # of the band that begins at each vote
        needed = (SIGNATURE - (1 - cover)) * self.total[t] - 1e-9
        found, last = [], None
        for k in np.flatnonzero(sums >= needed).tolist():
            # bands that begin within one that was taken are covered by its alignment, as wide again
            if last is None or key[k] > last + band:
                found.append((int(t[k]), int(d[k])))
                last = key[k]
        return found

    def align(self, seq: np.ndarray, t: int, d: int, band: int) -> tuple[float, int, int]:
        """The share of the template's IDF in the heaviest common subsequence near d, and its stretch of the file."""
        ids = self.templates[t][1]
        offsets = np.arange(-band, 2 * band + 1)
        best = np.zeros(len(offsets))
        for q, w in enumerate(ids.tolist()):
            at = q + d + offsets
            ok = (at >= 0) & (at < len(seq))
            hit = np.zeros(len(offsets))
            hit[ok] = np.where(seq[at[ok]] == w, self.idf[w], 0.0)
            lost = np.append(best[1:], 0.0)  # the template's word has no place in the file
            # matched here, or passed over; further words of the file may be passed over too
            best = np.maximum.accumulate(np.maximum(best + hit, lost))
        return float(best.max() / self.total[t]), max(0, d - band), d + len(ids) + 2 * band

    def match(self, seq: np.ndarray, cover: float, band: int) -> dict[str, float]:
        """Labels of accepted templates with their best coverage."""
        out: dict[str, float] = {}
        for t, d in self.candidates(seq, cover, band):
            label, _, keys = self.templates[t]
            if out.get(label, 0.0) >= 1.0:
                continue
            share, lo, hi = self.align(seq, t, d, band)
            part = seq[lo:hi]
            if share >= cover - 1e-9 and all(len(self.stands(part, k, np.flatnonzero(part == k[0]))) for k in keys):
                out[label] = max(out.get(label, 0.0), min(share, 1.0))
        return out


def document_counts(docs: DataFrame, index: Index) -> tuple[int, np.ndarray]:
    """Documents, and of them those with each licence word: over all rows, one row a task and word."""
    vocab, size = index.vocab, len(index.vocab)

    def count(batches):
        n, df = 0, np.zeros(size, dtype=np.int64)
        for b in pieces(batches):
            for text in b.column(0):
                n += 1
                df[[vocab[w] for w in set(words_of(text.as_py())) if w in vocab]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, size), pa.int32()), pa.array([n, *df.tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return n.get(-1, 0), np.array([n.get(w, 0) for w in range(size)])


def scan(docs: DataFrame, *, cover: float = 0.85, band: int = 8) -> DataFrame:
    """One row as in SCHEMA for each row of docs(doc_id, text)."""
    index = Index()
    index.weigh(*document_counts(docs, index))

    def one(text: str | None) -> tuple:
        seq = index.look_up(words_of(text))
        base = index.base(seq)
        match = index.match(seq, cover, band)
        at = [p for p, _ in base]
        labels = {x for _, x in base}
        return (len(seq), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | match.keys())), 1.0 if at else max(match.values(), default=0.0))

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.float64()]

    def run(batches):
        for b in pieces(batches):
            rows = [one(t.as_py()) for t in b.column(1)]
            cols = [b.column(0), *(zip(*rows) if rows else [()] * 7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(cols, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
