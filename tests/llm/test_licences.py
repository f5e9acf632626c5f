import re

import pytest

from costgrain.llm import licences


def places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), sorted((k, label) for p, label in licences.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())


TEXTS = [
    "Released under the MIT License.", "UNDER-the:mit license under the mit licence under the MIT license", "Licensed under the Apache License, Version 2.0.", "cc by nc cc by nc-sa CC BY-NC 4.0",
    "This work is licensed under the GNU General Public License, version 3.", "apache license version", "", None, "mit " * 5000, "All rights reserved. ümit under thé mit license", "cc\x00by\x01nc", "the mit license under the mit license",
]


def test_base_places(spark):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS)], "doc_id long, text string, labels string")
    for r in licences.scan_licences(df).collect():
        n, found = places(TEXTS[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found))
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(("text", "label"), [("licensed under the GNU General Public License version 3", "gpl-3"), ("All rights reserved", "all-rights-reserved"), ("under the bsd 3-clause license", "bsd-3")])
def test_other_templates(text, label):
    index = licences.Index({b"the": 10**6, b"under": 10**5, b"license": 10**4})
    found = index.scan(licences.words_of(text.encode()))
    assert label in {index.templates[k].label for k, _, _ in found}


def test_any_index_finds_all_base_places(docs, rows):
    """Which words are rarest may not change what is found."""
    for frequency in ({}, {b"mit": 10**6, b"license": 3}, {w: k for k, w in enumerate(sorted({w for t in licences.templates() for w in t.words}))}):
        index = licences.Index(frequency)
        for t in TEXTS:
            found = [(s, index.templates[k].label) for k, s, _ in index.scan(licences.words_of((t or "").encode())) if index.templates[k].base]
            assert sorted(found) == places(t)[1]
    assert licences.scan_licences(docs).count() == len(rows)


def test_no_documents(empty):
    assert licences.scan_licences(empty).count() == 0


def plain_scan(text):
    """Labels and score by trying every template at every word."""
    words, found = licences.words_of((text or "").encode()), []
    for t in licences.templates():
        for start in range(-max((at for at, _ in t.keys), default=0), len(words)):
            if all(start + at >= 0 and words[start + at : start + at + len(key)] == key for at, key in t.keys):
                same = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t.words))
                found.append((t.label, t.base, start, same / len(t.words)))
    base = [f for f in found if f[1]]
    starts = [f[2] for f in base]
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({f[0] for f in base})), ",".join(sorted({f[0] for f in found})), max((f[3] for f in found), default=0.0)


REAL = [
    "MIT License\n\nCopyright (c) 2020 Jo Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "# SPDX-License-Identifier: GPL-3.0-or-later", "// SPDX-License-Identifier: (MIT OR Apache-2.0)", "SPDX-License-Identifier: Apache-2.0",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Neither the name of Acme Inc. nor the names of its contributors may be used to endorse or promote products derived from this software",
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "nothing of the kind, by any license of mine",
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance", "under the MIT license and CC BY-NC, under the mit license", "", None,
]


def test_licence_texts_and_identifiers_are_labelled(spark):
    docs = spark.createDataFrame(list(enumerate(REAL)), "doc_id long, text string")
    labels = {r.doc_id: r.labels for r in licences.scan_licences(docs).collect()}
    assert [labels[k] for k in (0, 1, 3, 4, 5, 6, 7, 8)] == ["mit", "gpl-3", "apache-2", "bsd,bsd-3", "gpl-3", "mpl", "isc", ""]


def test_all_columns_are_those_of_a_plain_scan(spark):
    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()][:300]
    texts = REAL + prose + [f"{a} x {b}" for a in REAL[:6] for b in REAL[5:11]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(map(tuple, licences.scan_licences(docs).collect()))
    for k, row in enumerate(got):
        want = plain_scan(texts[k])
        assert row[1:7] == want[:6] and abs(row[7] - want[6]) < 1e-9, (k, row, want)
