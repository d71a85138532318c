"""License scans by ordered signature rules.

Texts are reduced to lower-case words joined by single blanks, on which every rule is a regular
expression. A keyword prefilter decides which rules run at all: a text without any keyword costs one
containment test a keyword. Rules are ordered by priority; a detection whose interval lies within
that of a better one (higher priority, or equal priority and longer, or an earlier rule over the
same words) is suppressed. All of it is one projection: no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.llm.text import lower_ascii, split_words

#: Base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Label | keyword that any match contains (or several: each alternative of the name contains one) | name | identifier | address. Written on words without punctuation.
SIGNATURES = """
agpl-3.0 | affero, agpl | gnu affero general public license(?: version| v)? ?3(?: 0)?|agpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl(?: 3 0)?
agpl | affero, agpl | gnu affero general public licen[cs]e|agpl | agpl | gnu org licenses agpl
gpl-3.0 | general public, gpl | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?3(?: 0)?|(?:gnu )?gpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
gpl-2.0 | general public, gpl | gnu general public license(?: as published by the free software foundation)?(?: either)? (?:version|v) ?2(?: 0)?|(?:gnu )?gpl ?v?(?:ersion )?2(?: 0)?(?: only| or later)? | gpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?gpl 2 0
gpl | general public, gpl | gnu general public licen[cs]e|(?:gnu )?gpl | gpl | gnu org licenses gpl
lgpl-3.0 | lesser general, lgpl | gnu lesser general public license (?:version|v) ?3(?: 0)?|(?:gnu )?lgpl ?v?(?:ersion )?3(?: 0)?(?: only| or later)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
lgpl-2.1 | lesser general, lgpl | gnu lesser general public license (?:version|v) ?2 1|(?:gnu )?lgpl ?v?(?:ersion )?2 1(?: only| or later)? | lgpl 2 1(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-2.0 | library general, lgpl | gnu library general public license(?: version 2)?|lgpl ?v?(?:ersion )?2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu org licenses (?:old licenses )?lgpl 2 0
lgpl | lesser general, lgpl | gnu lesser general public licen[cs]e|(?:gnu )?lgpl | lgpl | gnu org licenses lgpl
gfdl | documentation license | gnu free documentation license(?: version 1 [123])? | gfdl 1 [123](?: only| or later)? | gnu org licenses fdl
apache-2.0 | apache | apache license (?:version|v) ?2(?: 0)?|apache 2 0 licen[cs]e | apache 2 0 | apache org licenses license 2 0
apache-1.1 | apache | apache software license (?:version|v) ?1 1 | apache 1 1 | apache org licenses license 1 1
apache-1.0 | apache | apache (?:software )?license (?:version|v) ?1 0 | apache 1 0 | apache org licenses license 1 0
apache | apache | apache (?:software )?licen[cs]e | apache | apache org licenses
mit | mit | (?:the )?mit licen[cs]e|mit style licen[cs]e | mit | opensource org licenses mit
mit-0 | mit no | mit no attribution(?: license)? | mit 0 | opensource org licenses mit 0
x11 | x11 | (?:mit )?x11 licen[cs]e | x11 | xfree86 org legal licenses
isc | isc | isc licen[cs]e | isc | opensource org licenses isc
bsd-4-clause | bsd | bsd 4 clause(?: original)?(?: license)?|original bsd license | bsd 4 clause | spdx org licenses bsd 4 clause
bsd-3-clause | bsd | bsd 3 clause(?: new| revised)?(?: license)?|(?:new|revised|modified) bsd license | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-2-clause | bsd | bsd 2 clause(?: simplified)?(?: license)?|(?:simplified|freebsd) bsd license | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-0 | bsd | (?:zero clause|0 clause) bsd(?: license)?|bsd zero clause | 0bsd | opensource org licenses 0bsd
bsd | bsd | bsd (?:style )?licen[cs]e | bsd | opensource org licenses bsd
cc-by-nc-nd | commons, cc by | creative commons attribution non ?commercial no ?deriv(?:s|atives)?(?: works)?(?: [1-4] [05])?(?: international| unported)?|cc by nc nd(?: [1-4] [05])? | cc by nc nd [1-4] [05] | creativecommons org licenses by nc nd
cc-by-nc-sa | commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?(?: international| unported)? | cc by nc sa [1-4] [05] | creativecommons org licenses by nc sa
cc-by-nc | commons | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported)? | cc by nc [1-4] [05] | creativecommons org licenses by nc
cc-by-nd | commons | creative commons attribution no ?deriv(?:s|atives)?(?: [1-4] [05])?(?: international| unported)? | cc by nd [1-4] [05] | creativecommons org licenses by nd
cc-by-sa | commons | creative commons attribution share ?alike(?: [1-4] [05])?(?: international| unported)? | cc by sa [1-4] [05] | creativecommons org licenses by sa
cc-by | commons | creative commons attribution(?: [1-4] [05])?(?: international| unported)?(?: license)? | cc by [1-4] [05] | creativecommons org licenses by
cc0 | creative commons, cc0 | cc0(?: 1 0)?(?: universal)?|creative commons (?:zero|cc0)(?: v?1 0)? | cc0 1 0 | creativecommons org publicdomain zero
cc-by-nc-nd | cc by | cc by nc nd | cc by nc nd | by nc nd deed
cc-by-nc-sa | cc by | cc by nc sa | cc by nc sa | by nc sa deed
cc-by-nc | cc by | cc by nc | cc by nc | by nc deed
cc-by-sa | cc by | cc by sa | cc by sa | by sa deed
cc-by-nd | cc by | cc by nd | cc by nd | by nd deed
mpl-2.0 | mozilla, mpl | mozilla public license (?:version|v) ?2(?: 0)?|mpl ?v?(?:ersion )?2(?: 0)?(?: licen[cs]ed?)? | mpl 2 0 | mozilla org mpl 2 0
mpl-1.1 | mozilla, mpl | mozilla public license (?:version|v) ?1 1|mpl ?v?(?:ersion )?1 1 | mpl 1 1 | mozilla org mpl mpl 1 1
mpl | mozilla | mozilla public licen[cs]e | mpl | mozilla org mpl
epl-2.0 | eclipse | eclipse public license (?:version |v ?)?2(?: 0)? | epl 2 0 | eclipse org legal epl 2 0
epl-1.0 | eclipse | eclipse public license (?:version |v ?)?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
eupl | european union | european union public licen[cs]e(?: v?1 [12])? | eupl 1 [12] | joinup ec europa eu software page eupl
cddl | development and distribution | common development and distribution license(?: version)?(?: 1 [01])? | cddl 1 [01] | opensource org licenses cddl
cpl | common public | common public license(?: version)?(?: 1 0)? | cpl 1 0 | opensource org licenses cpl
artistic-2.0 | artistic | artistic license (?:version |v )?2(?: 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
artistic-1.0 | artistic | (?:perl )?artistic license(?: 1 0)? | artistic 1 0 | opensource org licenses artistic license 1 0
boost | boost | boost software license(?: version)?(?: 1 0)? | bsl 1 0 | boost org license 1 0
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib | opensource org licenses zlib
libpng | libpng | libpng license(?: version 2)? | libpng(?: 2 0)? | libpng org pub png src libpng license
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | what the fuck | do what the fuck you want to public license | wtfpl | wtfpl net
ms-pl | microsoft | microsoft public license | ms pl | opensource org licenses ms pl
ms-rl | microsoft | microsoft reciprocal license | ms rl | opensource org licenses ms rl
ofl | open font | sil open font license(?: version)?(?: 1 1)? | ofl 1 1 | scripts sil org ofl
odbl | open database | open (?:data commons open )?database licen[cs]e(?: v?1 0)? | odbl 1 0 | opendatacommons org licenses odbl
pddl | public domain dedication | public domain dedication and licen[cs]e | pddl 1 0 | opendatacommons org licenses pddl
odc-by | open data commons | open data commons attribution licen[cs]e | odc by 1 0 | opendatacommons org licenses by
python-2.0 | python software | python software foundation license(?: version 2)? | (?:psf|python) 2 0 | docs python org license
postgresql | postgresql | postgresql licen[cs]e | postgresql | opensource org licenses postgresql
php-3.01 | php license | php license(?: version 3 01?)? | php 3 01? | php net license
ruby | ruby license | ruby license | ruby | ruby lang org en about license
openssl | openssl | openssl license | openssl | openssl org source license
ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? license | ncsa | otm illinois edu uiuc opensource
afl-3.0 | academic free | academic free license(?: version| v)?(?: 3 0)? | afl 3 0 | opensource org licenses afl 3 0
osl-3.0 | open software | open software license(?: version| v)?(?: 3 0)? | osl 3 0 | opensource org licenses osl 3 0
upl | universal permissive | universal permissive license(?: version| v)?(?: 1 0)? | upl 1 0 | opensource org licenses upl
vim | vim license | vim license | vim | vimhelp org uganda
sspl | server side public | server side public license(?: version| v)?(?: 1)? | sspl 1 0 | mongodb com licensing server side public license
bsl-1.1 | business source | business source license(?: version)?(?: 1 1)? | busl 1 1 | mariadb com bsl11
elastic-2.0 | elastic license | elastic license(?: version)?(?: 2 0)? | elastic 2 0 | elastic co licensing elastic license
public-domain | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain|this (?:work|text) is in the public domain | public domain | creativecommons org publicdomain mark
all-rights-reserved | rights reserved | (?:copyright [0-9]{4}(?: by)? (?:[^ ]+ ){0,4})?all rights reserved | all rights reserved | all rights reserved worldwide
"""
#: Label | keyword | passage of the license's own text.
BODIES = """
mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
boost | permission is hereby granted | permission is hereby granted free of charge to any person or organization obtaining a copy
bsd | redistribution and use | redistribution and use in source and binary forms(?: with or without modification)?
bsd-3-clause | endorse or promote | may be used to endorse or promote products derived from this software
isc | permission to use copy modify | permission to use copy modify and or distribute this software for any purpose
gpl | is free software you can | is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | is free software you can | is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl | is free software you can | is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl | verbatim copies of this license | everyone is permitted to copy and distribute verbatim copies of this license document
apache-2.0 | required by applicable law | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
mpl-2.0 | source code form is subject | this source code form is subject to the terms of the mozilla public license v 2 0
epl-2.0 | the accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
zlib | provided as is without | this software is provided as is without any express or implied warranty
unlicense | unencumbered software | this is free and unencumbered software released into the public domain
ofl | font software is licensed | this font software is licensed under the sil open font license
cc0 | waived all copyright | has waived all copyright and related or neighboring rights to this work
"""
GRANT = r"(?:licensed|released|distributed|available|published|provided|redistributed) under (?:the |an? )?(?:terms (?:and conditions )?of )?(?:the )?(?:conditions of the )?"
IDENTIFIER = r"spdx license identifier "
#: (priority, confidence) of a rule by its kind.
KINDS = {"identifier": (4, 1.0), "grant": (3, 0.95), "body": (2, 0.9), "address": (2, 0.9), "name": (1, 0.8)}
BASE_SCORE = 0.5


def _by_keyword(keywords: str, alternatives: str) -> list[tuple[str, str]]:
    """(keyword, alternatives) for each keyword: those alternatives that contain it."""
    names = keywords.split(", ")
    if len(names) == 1:
        return [(keywords, alternatives)]
    parts, depth = [""], 0
    for c in alternatives:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return [(k, "|".join(p for p in parts if k == next(x for x in names if x in p))) for k in names]


def rules() -> list[tuple[int, int, str, str, str, float]]:
    """(order, priority, label, keyword, pattern, confidence) of each rule, best first."""
    made = []
    for line in filter(None, (x.strip() for x in SIGNATURES.splitlines())):
        label, keywords, alternatives, identifier, address = (x.strip() for x in line.split(" | "))
        named = _by_keyword(keywords, alternatives)
        for kind, keep, pattern in (
            ("identifier", "spdx license", IDENTIFIER + f"(?:{identifier})"), *(("grant", k, GRANT + f"(?:{a})") for k, a in named),
            ("address", address.split("(")[0].strip(), address), *(("name", k, f"(?:{a})") for k, a in named),
        ):
            made.append((*KINDS[kind], label, keep, f"(?<= )(?:{pattern})(?= )"))
    for line in filter(None, (x.strip() for x in BODIES.splitlines())):
        label, keyword, pattern = (x.strip() for x in line.split(" | "))
        made.append((*KINDS["body"], label, keyword, f"(?<= )(?:{pattern})(?= )"))
    made.sort(key=lambda r: -r[0])
    return [(i, p, label, keyword, pattern, score) for i, (p, score, label, keyword, pattern) in enumerate(made)]


def _rules_literal(found: list) -> Column:
    text = lambda s: F.lit(s)
    return F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), text(label).alias("label"), text(k).alias("k"), text(r).alias("re"), F.lit(s).alias("score"))
        for i, p, label, k, r, s in found
    ])


#: Sums and maxima before a place go by parts of so many, so that their cost stays in proportion to the detections.
PART = 128


def _sums_before(values: str) -> str:
    """SQL for the sum of what stands before each of the (integer) values."""
    add = "(a, z) -> a + z"
    parts = f"transform(sequence(0, (size(v) - 1) div {PART}), c -> aggregate(slice(v, c * {PART} + 1, {PART}), 0, {add}))"
    before = f"transform(s, (z, c) -> aggregate(slice(s, 1, c), 0, {add}))"
    own = f"transform(v, (z, k) -> b[cast(k div {PART} as int)] + aggregate(slice(v, cast(k div {PART} as int) * {PART} + 1, k % {PART}), 0, {add}))"
    return f"transform(array({values}), v -> transform(array({parts}), s -> transform(array({before}), b -> {own})[0])[0])[0]"


def _unsuppressed(found: str) -> str:
    """SQL for those of the detections that lie in no better one.

    They are ordered by first word, then the longest, the highest priority and the earliest rule first: what
    contains a detection and is at least its equal then stands before it, so a detection goes if one of its
    priority or a higher one before it ends where it does or later. ``end`` and ``p`` are negative.
    """
    levels = sorted({p for p, _ in KINDS.values()})
    farthest = lambda some: ", ".join(f"array_min(transform(filter({some}, y -> y.p <= -{p}), y -> y.end)) as e{p}" for p in levels)
    parts = f"transform(sequence(0, (size(f) - 1) div {PART}), c -> slice(f, c * {PART} + 1, {PART}))"
    before = "transform(m, (z, c) -> struct(" + ", ".join(f"array_min(transform(slice(m, 1, c), y -> y.e{p})) as e{p}" for p in levels) + "))"
    end = "case " + " ".join(f"when d.p = -{p} then b[c].e{p}" for p in levels) + " end"
    own = f"flatten(transform(q, (part, c) -> filter(part, (d, k) -> not coalesce({end} <= d.end, false) and not exists(slice(part, 1, k), y -> y.p <= d.p and y.end <= d.end))))"
    some = f"transform(array({parts}), q -> transform(array(transform(q, z -> struct({farthest('z')}))), m -> transform(array({before}), b -> {own})[0])[0])[0]"
    return f"transform(array({found}), f -> if(size(f) > 0, {some}, f))[0]"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id_col, n_words, base (phrase label and first word of each place), detections
    (label, first and last word, score; suppressed ones left out), base_labels and labels (sorted
    arrays), score (the best detection's confidence, at least BASE_SCORE with a base phrase, else 0).

    A null or empty text gives no words, detections or labels and a score of 0. Repeated rows are
    returned each; other columns are left out, so none can clash. An empty table gives no rows.
    """
    found = rules()
    keywords = sorted({r[3] for r in found})
    words = docs.select(F.col(id_col).alias("_id"), split_words(lower_ascii(F.col(text_col))).alias("w"))
    flat = words.withColumn("t", F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")))
    gate = flat.withColumn("keys", F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("t"), k)))
    base = []
    for phrase, label in PHRASES:
        parts = phrase.split(" ")
        same = " and ".join(f"w[i+{j}] = '{x}'" for j, x in enumerate(parts))
        base.append(
            f"if(contains(t, ' {phrase} '), transform(filter(sequence(0, size(w)-{len(parts)}), i -> {same}), i -> struct('{label}' as label, i as first, i + {len(parts) - 1} as last)),"
            " cast(array() as array<struct<label:string,first:int,last:int>>))"
        )
    based = gate.withColumn("base", F.expr(f"concat({', '.join(base)})"))
    active = based.withColumn("rules", F.when(F.size("keys") > 0, F.filter(_rules_literal(found), lambda r: F.array_contains(F.col("keys"), r["k"]))))
    cut = active.withColumn("cut", F.expr(
        "filter(transform(rules, r -> struct(r as r, split(t, r.re, -1) as gaps, regexp_extract_all(t, r.re, 0) as hits)), x -> size(x.hits) > 0)"
    ))
    # First word of each hit: blanks before it, less the one that leads the text. Ends come likewise.
    blanks = lambda x: f"(length({x}) - length(replace({x}, ' ', '')))"
    spans = cut.select("_id", "w", "base", F.expr(
        f"transform(cut, x -> struct(x.r as r, transform(x.hits, h -> {blanks('h')}) as own, transform(slice(x.gaps, 1, size(x.hits)), g -> {blanks('g')}) as gaps))"
    ).alias("cut"))
    placed = spans.select("_id", "w", "base", F.expr(
        f"flatten(transform(transform(cut, x -> struct(x.r as r, x.own as own, x.gaps as gaps, {_sums_before('zip_with(x.own, x.gaps, (h, g) -> h + g)')} as upto)),"
        " x -> transform(x.own, (h, k) -> struct(x.upto[k] + x.gaps[k] - 1 as first, -(x.upto[k] + x.gaps[k] + h - 1) as end, -x.r.p as p, x.r.i as i, x.r.label as label, cast(x.r.score as double) as score))))"
    ).alias("found"))
    kept = placed.select("_id", "w", "base", F.expr(_unsuppressed("sort_array(found)")).alias("found"))
    labels = "array_sort(array_distinct(transform({}, x -> x.label)))"
    return kept.select(
        F.col("_id").alias(id_col), F.size("w").cast("long").alias("n_words"), "base",
        F.expr("coalesce(transform(found, d -> struct(d.label as label, d.first as first, -d.end as last, d.score as score)), cast(array() as array<struct<label:string,first:int,last:int,score:double>>))").alias("detections"),
        F.expr(labels.format("base")).alias("base_labels"),
        F.expr("array_sort(array_distinct(concat(transform(base, x -> x.label), coalesce(transform(found, x -> x.label), cast(array() as array<string>)))))").alias("labels"),
        F.expr(f"greatest(if(size(base) > 0, {BASE_SCORE}D, 0D), coalesce(array_max(transform(found, x -> x.score)), 0D))").alias("score"),
    )
