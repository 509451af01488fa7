"""Base places against a word-by-word search, gates against all rules, suppression, odd rows."""

import random
import re

import pytest

from yearweave.llm import license_scan as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    words = WORD.findall(fold(text))
    starts, labels = [], set()
    for phrase, label in L.BASE:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    ends = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), *ends, ",".join(sorted(labels))


@pytest.fixture(scope="module")
def scanner():
    return L.Scanner()


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rnd = random.Random(1)
    parts = ["cc", "by", "CC-BY", "General Public", "License", "all rights", "reserved", "é", "ALL", "gnu"]
    parts += ["lgpl v3", "\x7f", "_", "Ünder", "cc by cc by", "nc", "4.0", "the", "MIT", "under"]
    out = [
        "".join(rnd.choice(parts) + rnd.choice([" ", "-", "  ", ".", ""]) for _ in range(rnd.randint(0, 12)))
        for _ in range(1500)
    ]
    return out + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ["", None]


def test_base_places(texts, scanner):
    for text in texts:
        found = L.judge((text or "").encode(), scanner)
        assert found[:5] == base(text)
        assert set(filter(None, found[4].split(","))) <= set(filter(None, found[5].split(",")))
        assert 0 <= found[6] <= 1 and (found[6] > 0) == bool(found[5])


def test_gates_hide_no_rule(texts, scanner):
    notices = [f"{form.split('{')[0]} X" for form, _, _ in L.FORMS]
    for text in texts[:700] + notices:
        words = " " + " ".join(WORD.findall(fold(text))) + " "
        every = [
            (m.start(), m.end(), r.priority, i)
            for i, r in enumerate(scanner.rules)
            for m in r.pattern.finditer(words)
        ]
        assert sorted(every) == sorted(scanner.detections(words))
        assert not every or any(c in words for c in L.CORE)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("MIT License", "mit"),
        ("SPDX-License-Identifier: Apache-2.0", "apache-2.0"),
        ("licensed under the Apache License, Version 2.0", "apache-2.0"),
        ("Licensed under the GNU Lesser General Public License v2.1.", "gpl,lgpl-2.1"),
        ("see the BSD 3-Clause License for details", "bsd-3-clause"),
        ("CC BY-NC 4.0", "cc-by,cc-by-nc"),
        ("MIT License. Apache License 2.0", "apache-2.0,mit"),
        ("transmit licenses permit", ""),
        ("a smitten license", ""),
    ],
)
def test_labels(scanner, text, labels):
    assert L.judge(text.encode(), scanner)[5] == labels


def test_contained_detections_go():
    outer, inner, apart = (0, 20, 1, 3), (5, 10, 4, 9), (19, 30, 4, 1)
    assert sorted(L.survivors([inner, apart, outer])) == [outer, apart]
    assert L.survivors([(0, 5, 2, 7), (0, 5, 2, 4)]) == [(0, 5, 2, 4)]  # a tie: the earlier rule
    assert len(L.survivors([(0, 20, 4, 1), (5, 10, 1, 2)])) == 2  # a more telling one inside stays


def test_suppression_is_that_of_all_pairs():
    rnd = random.Random(4)
    for _ in range(300):
        found = []
        for _ in range(rnd.randint(0, 40)):
            start = rnd.randrange(30)
            found.append((start, start + rnd.randint(1, 12), rnd.randrange(3), rnd.randrange(5)))
        best = sorted(found, key=lambda d: (d[2], d[0] - d[1], d[3], d[0]))
        stays = [
            one for i, one in enumerate(best) if not any(a <= one[0] and one[1] <= b for a, b, _, _ in best[:i])
        ]
        assert L.survivors(found) == stays


def test_many_notices_in_one_text_take_linear_time():
    found = [(20 * i, 20 * i + 19, i % 3, 1) for i in range(200_000)]
    assert len(L.survivors(found)) == len(found)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    rows = L.licenses(odd_docs).collect()
    assert sorted((str(r.doc_id), r.n_words) for r in rows) == sorted(
        (str(r[0]), len(WORD.findall(fold(r[1])))) for r in odd_rows
    )
    assert all(r.labels == "" and r.score == 0 and r.first_word is None for r in rows)
    assert L.licenses(no_docs).collect() == []


def test_the_registered_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = L.op9_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(tuple(r)[1:6] == base(docs[r.doc_id]) for r in rows)


def test_detections_have_spans(spark):
    text = "Über all: licensed under the MIT License. CC-BY, cc by"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = L.licenses(df).first()
    words = WORD.findall(fold(text))
    spans = [(d.label, " ".join(words[d.start : d.end]), d.base) for d in row.detections]
    assert spans == [
        ("mit", "licensed under the mit license", False),
        ("cc-by", "cc by", True),
        ("cc-by", "cc by", True),
    ]
    assert "detections" not in L._FOUND


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: MIT", "mit"),
        ("SPDX-License-Identifier: ISC", "isc"),
        ("SPDX-License-Identifier: Zlib", "zlib"),
        ("SPDX-License-Identifier: BSL-1.0", "bsl-1.0"),
        ("SPDX-License-Identifier: PostgreSQL", "postgresql"),
        ("SPDX-License-Identifier: Artistic-2.0", "artistic-2.0"),
        ("SPDX-License-Identifier: OFL-1.1", "ofl-1.1"),
        ("SPDX-License-Identifier: MS-PL", "ms-pl"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("SPDX-License-Identifier: Apache-2.0 OR MIT", "apache-2.0,mit"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Redistribution and use in source and binary forms, with or without modification", "bsd"),
        ("This program is free software: you can redistribute it and/or modify it", "gpl"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("https://www.mozilla.org/MPL/2.0/", "mpl-2.0"),
        ("permission to redistribute is free of charge", ""),
    ],
)
def test_signatures_without_a_license_name(scanner, text, labels):
    assert L.judge(text.encode(), scanner)[5] == labels


def test_every_signature_is_gated_by_its_own_words(scanner):
    assert len(scanner.rules) == len({(r.label, r.pattern.pattern) for r in scanner.rules}) == 531
    signatures = len(L.NAMES) + len(L.SPDX) + len(L.VARIANTS) + len(L.BODIES)
    assert signatures == 248
    for _, pattern, *_, gate in (*L.VARIANTS, *L.BODIES):
        assert gate in re.sub(r"licen\[sc\]e", "license", pattern)
