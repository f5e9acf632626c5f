"""Operator 6: licence scan over a positional index of rare words.

Every template is a short run of licence words. Over all documents it is counted
how many hold each licence word; a template is filed under its rarest ones (of
highest inverse document frequency) with their places in the run. In a file,
each rare word that occurs votes for the starts it implies; a start that all
rare words of a template agree on is a candidate, and the template's mandatory
key phrases are then verified there word for word. Other words of a template may
differ and lower the score.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costgrain.llm.common import batch_of, small, table, text_bytes

#: Rare words under which a template is filed.
RARE = 2

# Phrases whose every place counts, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Further templates, as licences and their notices have them: a run of words, the key phrases that have to stand
# in it at their places, the label. A licence has several runs, each of which tells it apart.
TEMPLATES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "obtaining a copy of this software"], "mit"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["this permission notice shall be included", "copies or substantial portions of the software"], "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"], "mit"),
    ("mit license", ["mit license"], "mit"),
    ("released under the terms of the mit license", ["the mit license"], "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "you may not use this file except in compliance"], "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["unless required by applicable law or agreed to in writing", "distributed on an as is basis"], "apache-2"),
    ("licensed under the apache license version 2 0", ["apache license version 2 0"], "apache-2"),
    ("gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["gnu general public license as published by", "either version 3 of the license"], "gpl-3"),
    ("gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["gnu general public license as published by", "either version 2 of the license"], "gpl-2"),
    ("gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license", "published by the free software foundation"], "lgpl"),
    ("gnu affero general public license as published by the free software foundation", ["gnu affero general public license", "published by the free software foundation"], "agpl"),
    ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"], "gpl-3"),
    ("licensed under the gnu general public license version 2", ["gnu general public license version 2"], "gpl-2"),
    ("licensed under the gnu lesser general public license", ["gnu lesser general public license"], "lgpl"),
    ("licensed under the gnu affero general public license", ["gnu affero general public license"], "agpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", ["source code form is subject to the terms", "mozilla public license v 2 0"], "mpl"),
    ("licensed under the mozilla public license version 2", ["mozilla public license"], "mpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "provided that the following conditions are met"], "bsd"),
    ("nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["nor the names of its contributors", "endorse or promote products derived from"], "bsd-3"),
    ("licensed under the bsd 3 clause license", ["bsd 3 clause"], "bsd-3"),
    ("licensed under the bsd 2 clause license", ["bsd 2 clause"], "bsd-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee is hereby granted"], "isc"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", ["without any express or implied warranty", "in no event will the authors be held liable"], "zlib"),
    ("boost software license version 1 0", ["boost software license", "version 1 0"], "bsl-1"),
    ("this is free and unencumbered software released into the public domain", ["free and unencumbered software", "released into the public domain"], "unlicense"),
    ("this work is licensed under cc by sa 4 0", ["cc by sa"], "cc-by-sa"),
    ("this work is licensed under cc by 4 0", ["cc by 4 0"], "cc-by"),
    ("creative commons attribution sharealike 4 0 international", ["commons attribution sharealike", "4 0 international"], "cc-by-sa"),
    ("creative commons attribution 4 0 international", ["commons attribution 4 0", "international"], "cc-by"),
    ("creative commons attribution noncommercial", ["commons attribution noncommercial"], "cc-by-nc"),
    ("released into the public domain", ["the public domain"], "public-domain"),
    ("all rights reserved", ["all rights reserved"], "all-rights-reserved"),
]
# Licence identifiers as files declare them, and their labels.
IDENTIFIERS = {
    "MIT": "mit", "Apache-2.0": "apache-2", "BSD-2-Clause": "bsd-2", "BSD-3-Clause": "bsd-3", "GPL-2.0": "gpl-2", "GPL-3.0": "gpl-3", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl", "AGPL-3.0": "agpl", "MPL-2.0": "mpl", "ISC": "isc",
    "Zlib": "zlib", "BSL-1.0": "bsl-1", "Unlicense": "unlicense", "CC0-1.0": "public-domain", "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc",
}
DECLARED = "spdx license identifier"

#: a-z for A-Z, and a blank for what is no digit, letter or byte of a wide character.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text in which licence phrases are sought."""
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Template:
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]  # place in the run and words of each key phrase
    label: str
    base: bool


def templates() -> list[Template]:
    def place(run: list[bytes], key: list[bytes]) -> int:
        return next(k for k in range(len(run)) if run[k : k + len(key)] == key)

    out = [Template(p.encode().split(), [(0, p.encode().split())], label, True) for p, label in BASE.items()]
    declared = [(f"{DECLARED} {w}", [DECLARED, w], label) for name, label in IDENTIFIERS.items() for w in [b" ".join(words_of(name.encode())).decode()]]
    for run, keys, label in [*TEMPLATES, *declared]:
        words = run.encode().split()
        out.append(Template(words, [(place(words, k.encode().split()), k.encode().split()) for k in keys], label, False))
    return out


def document_frequencies(docs: DataFrame) -> dict[bytes, int]:
    """How many texts hold each licence word; each task adds up its own."""
    wanted = frozenset(w for t in templates() for w in t.words)
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for b in small(batches):
            for text in text_bytes(b.column(0)):
                seen.update(wanted.intersection(words_of(text)))
        yield batch_of(schema, list(seen.keys()), list(seen.values()))

    rows = docs.select(F.col("text").cast("string")).mapInArrow(scan, "word binary, n long").groupBy("word").agg(F.sum("n")).collect()
    return {bytes(w): n for w, n in rows}


class Index:
    """Templates filed under their rarest words."""

    def __init__(self, frequency: dict[bytes, int]):
        self.templates = templates()
        self.needed: list[int] = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for k, t in enumerate(self.templates):
            # Rare words are taken from the key phrases: other words may differ.
            inside = [p + i for p, key in t.keys for i in range(len(key))]
            rare = sorted({t.words[i] for i in inside}, key=lambda w: (frequency.get(w, 0), w))[:RARE]
            places = [i for i in inside if t.words[i] in rare]
            self.needed.append(len(places))
            for i in places:
                self.postings.setdefault(t.words[i], []).append((k, i))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, share of its words) wherever a template is verified."""
        votes: Counter = Counter()
        for i, w in enumerate(words):
            if w in self.postings:
                votes.update((k, i - at) for k, at in self.postings[w])
        out = []
        for (k, start), n in votes.items():
            t = self.templates[k]
            if n < self.needed[k] or not all(start + at >= 0 and words[start + at : start + at + len(key)] == key for at, key in t.keys):
                continue
            same = sum(start + i >= 0 and words[start + i : start + i + 1] == [w] for i, w in enumerate(t.words))
            out.append((k, start, same / len(t.words)))
        return out


_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(docs: DataFrame) -> DataFrame:
    """Licence labels of every document; needs doc_id and text.

    n_words, n_base (places of base phrases), first_word and last_word (their
    least and greatest start, else null), base_labels, labels (with those of the
    other templates) and score: the largest share of a verified template's words
    that stands in the text, 0 for none. Null texts are empty. Repeated rows and
    null ids are kept; other columns are ignored; an empty table gives none. Texts are scanned whole, one at a time;
    words that are equally rare go in the order of their bytes.
    """
    index = Index(document_frequencies(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])

    def one(text: bytes) -> tuple:
        words = words_of(text)
        found = index.scan(words)
        base = [(start, index.templates[k].label) for k, start, _ in found if index.templates[k].base]
        joined = lambda labels: ",".join(sorted(set(labels)))
        starts = [s for s, _ in base]
        return len(words), len(base), min(starts, default=None), max(starts, default=None), joined(x for _, x in base), joined(index.templates[k].label for k, _, _ in found), max((s for _, _, s in found), default=0.0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            rows = [one(t) for t in text_bytes(b.column(1))]
            yield batch_of(schema, b.column(0), *(list(c) for c in (zip(*rows, strict=True) if rows else [()] * 7)))

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _RESULT)


def op6(spark, sf_dir: str) -> DataFrame:
    """The digest of the operator over all documents."""
    return scan_licences(table(spark, sf_dir, "documents"))
