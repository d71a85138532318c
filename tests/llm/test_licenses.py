import random
import re

from terrane.llm import licenses as L

from .conftest import nasty_rows, prose
from .test_decontaminate import words


def brute(text):
    w = words(text)
    t = " " + " ".join(w) + " "
    base = [(label, i) for phrase, label in L.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for i, p, label, keyword, pattern, score in L.rules():
        if keyword in t:
            for m in re.finditer(pattern, t):
                first = t[: m.start()].count(" ") - 1
                found.append((i, p, label, first, first + m[0].count(" "), score))
    better = lambda b, d: b[1] > d[1] or b[1] == d[1] and (b[4] - b[3] > d[4] - d[3] or b[4] - b[3] == d[4] - d[3] and b[0] < d[0])
    kept = [d for d in found if not any(b[0] != d[0] and b[3] <= d[3] and d[4] <= b[4] and better(b, d) for b in found)]
    score = max([0.5 if base else 0.0, *(d[5] for d in kept)])
    return len(w), sorted(base), sorted((d[2], d[3], d[4], d[5]) for d in kept), sorted({b[0] for b in base} | {d[2] for d in kept}), score


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); see http://www.apache.org/licenses/LICENSE-2.0", "GNU General Public License v3 or the MIT License", "cc by cc by CC-BY-SA 4.0", "the gnu general public license",
    "SPDX-License-Identifier: BSD-3-Clause", "This program is free software under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2", "mit", "mit license mit license", "all rights reserved",
]


def test_matches_brute_force(spark):
    r = random.Random(8)
    rows = [(i, t) for i, t, _ in nasty_rows()] + [(50 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, prose(r, 20) + " " + r.choice(TEXTS) + ". " + prose(r, 30) + "\n" + r.choice(TEXTS)) for i in range(40)]
    got = L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    shape = lambda r: (r.doc_id, r.n_words, sorted((b.label, b["first"]) for b in r.base), sorted((d.label, d["first"], d["last"], d.score) for d in r.detections), r.labels, r.score)
    assert sorted(map(shape, got), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_rules_and_suppression(spark):
    got = L.scan_licenses(spark.createDataFrame([(1, TEXTS[0]), (2, TEXTS[4]), (3, "mit license")], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in got}
    assert "apache-2.0" in by[1].labels and "apache" in by[1].labels and by[1].score == 0.95
    assert by[2].labels == ["bsd-3-clause"] and by[2].score == 1.0
    assert by[3].labels == ["mit"] and [b["first"] for b in by[3].base] == [0]


def test_edges(spark, nasty):
    got = L.scan_licenses(nasty).collect()
    assert len(got) == nasty.count() and all(r.score == 0 and r.labels == [] for r in got)
    assert L.scan_licenses(nasty.limit(0)).count() == 0


def test_keywords_lose_no_match(spark, monkeypatch):
    """The brute force runs all rules on every text here."""
    named = {
        "released under the GNU GPL v3": "gpl-3.0", "GNU GPL v2": "gpl-2.0", "the GNU GPL": "gpl", "AGPL v3": "agpl-3.0", "available under the LGPL v3": "lgpl-3.0", "LGPL v2.1": "lgpl-2.1",
        "licensed under the GPL v3": "gpl-3.0", "AGPLv3": "agpl-3.0", "GPL-2.0-only": "gpl-2.0", "GPLv2": "gpl-2.0", "LGPL": "lgpl", "MPL 2.0 licensed": "mpl-2.0", "under the GPL": "gpl",
        "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "Redistribution and use in source and binary forms, with or without": "bsd",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl", "This is free and unencumbered software released into the public domain.": "unlicense",
        "Creative Commons Zero": "cc0", "MPL v2": "mpl-2.0", "see otm.illinois.edu/uiuc_openSource": "ncsa", "CC BY-NC-ND 4.0": "cc-by-nc-nd",
    }
    rows = list(enumerate([*named, *TEXTS]))
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    every = [(i, p, label, "", pattern, score) for i, p, label, _, pattern, score in L.rules()]
    monkeypatch.setattr(L, "rules", lambda: every)
    for i, t in rows:
        n_words, _, found, _, score = brute(t)
        assert (got[i].n_words, sorted((d.label, d["first"], d["last"], d.score) for d in got[i].detections), got[i].score) == (n_words, found, score)
        assert t not in named or named[t] in got[i].labels


def samples(pattern, r, n):
    """Random strings that match."""
    from re import _parser

    def make(part):
        out = ""
        for op, arg in part:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                ranges = [(a, a) if str(o) == "LITERAL" else a for o, a in arg if str(o) != "NEGATE"]
                out += "x" if str(arg[0][0]) == "NEGATE" else chr(r.randint(*r.choice(ranges)))
            elif kind == "BRANCH":
                out += make(r.choice(arg[1]))
            elif kind == "SUBPATTERN":
                out += make(arg[3])
            elif kind == "MAX_REPEAT":
                out += "".join(make(arg[2]) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 2))))
            elif kind == "NOT_LITERAL":
                out += "x"
            else:
                assert kind == "ASSERT", kind
        return out

    return [make(_parser.parse(pattern)) for _ in range(n)]


def test_keywords_are_in_every_match():
    r = random.Random(3)
    for _, _, _, keyword, pattern, _ in L.rules():
        for x in samples(pattern, r, 25):
            assert re.fullmatch(pattern, " " + x + " ") or re.search(pattern, " " + x + " ")
            assert keyword in x, (keyword, x)


def test_many_detections_take_proportional_time(spark):
    import time

    t = "MIT license, Apache License 2.0; licensed under the GPL v3. " * 5000
    docs = spark.createDataFrame([(1, t)], "doc_id long, text string")
    began = time.time()
    got = L.scan_licenses(docs).first()
    assert len(got.detections) == 15000 and time.time() - began < 30
    small = brute(t[: len(t) // 100])
    assert sorted((d.label, d["first"], d["last"], d.score) for d in got.detections)[:3] and {d[0] for d in small[2]} == {d.label for d in got.detections}
    assert [(d.label, d["first"], d["last"], d.score) for d in sorted(got.detections, key=lambda d: d["first"]) if d["last"] < small[0]] == sorted(small[2], key=lambda d: d[1])


def test_query_digests(spark, tmp_path):
    from terrane.llm.queries import QUERIES

    rows = [(i, t, "s") for i, t in enumerate([*TEXTS, None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op7_licenses"](spark, str(tmp_path)).collect()}
    for i, t, _ in rows:
        n_words, base, _, labels, score = brute(t)
        at = [b[1] for b in base]
        want = (n_words, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({b[0] for b in base})), ",".join(labels), score)
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels, got[i].labels, got[i].score) == want
