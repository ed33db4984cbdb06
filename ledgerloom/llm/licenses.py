"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over the one- and two-word grams of a
paragraph names its licence family. It learns from variants of licence
templates (words left out, other sentences around them, made-up names in place
of the family's) and of sentences that only sound like them; a temperature and
the least probability of a family are calibrated on variants held back, and
what falls short is of the unknown class. A named family counts when one of
its templates is found again in the paragraph, word pair by word pair.

Paragraphs are parted by blank lines. Their lines are joined, so that a wrapped
notice is read whole, and parted into sentences; lines are judged by themselves
too, so that a list of licences keeps all of them. What is longer than
``WINDOW`` words is judged in windows that overlap by half, so every stretch
of up to half a window lies in one.

Fitting is Spark ML on some thousand fixed rows; scanning is column functions,
joins and grouping alone. A template that asks for r of its n pairs can't be
confirmed where none of its n - r + 1 rarest stands, so texts without any of
those, nor words that announce a licence, are done with after one look: nothing
that could be confirmed is skipped.
Each distinct piece is judged once, however often it stands. The weights are a
table of fixed size, which the templates bound.

Null and empty texts have no paragraphs. Repeated rows are judged alike. Empty
input gives empty output. Whole texts are read. Only the id and the text are
used, so further columns may have any name. Of families that are equally
likely, the last by name is taken.
"""

from __future__ import annotations

import functools
import math
import random
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import keep

#: How the families announce themselves, in notices and in short mentions.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "MIT License", "MIT-licensed", "License: MIT", "Lizenz: MIT", "licensed under MIT"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "SPDX-License-Identifier: Apache-2.0", "Apache License", "Apache 2.0", "Apache-licensed", "Apache-2.0", "http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU General Public License", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0", "GPLv3", "GPL v3", "GNU GPL", "GPL version 3"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0", "GPLv2", "GPL v2", "GPL version 2"),
    "LGPL": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU Lesser General Public License", "LGPL-2.1-only", "LGPL-3.0-only", "LGPLv3", "GNU LGPL"),
    "AGPL-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU Affero General Public License", "AGPL-3.0-only", "AGPLv3", "GNU AGPL"),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "BSD 3-Clause", "BSD 2-Clause", "BSD-3-Clause", "BSD-2-Clause", "BSD License", "BSD-licensed"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License", "MPL-2.0", "MPL 2.0"),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "Boost Software License", "BSL-1.0"),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution", "CC BY", "CC-BY-4.0"),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Commons Attribution-ShareAlike", "CC BY-SA", "CC-BY-SA-4.0"),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Commons Attribution-NonCommercial", "CC BY-NC", "CC-BY-NC-4.0"),
    "CC-BY-NC-SA": ("Commons Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA", "CC-BY-NC-SA-4.0"),
    "CC-BY-ND": ("Commons Attribution-NoDerivatives", "CC BY-ND", "CC-BY-ND-4.0"),
    "public-domain": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain.", "CC0 1.0", "CC0-1.0", "The Unlicense", "Unlicense"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "ISC License", "License: ISC"),
    "WTFPL": ("WTFPL", "WTFPL license"),
    "proprietary": ("All rights reserved.", "No part of this publication may be reproduced without permission"),
}
#: Sentences with words of licences that are none.
OTHERS = (
    "", "She renewed her driver's license last week.", "The license plate of the car was missing.", "You need a fishing license to do this.", "A copy of the letter was released to the public.",
    "The general public was not amused.", "Everybody has the right to work.", "The version of the story that was published", "All seats were reserved in advance.", "He was licensed to practise medicine.",
    "The apache helicopter landed under fire.", "MIT researchers released a study", "permission to land was granted", "the terms of the contract were met", "modification of the source is subject to review", "copyright law is a broad field", "This is free of charge for any person", "bsd and gnu are old names",
    "It is one of the oldest in the town and has been so for years.", "We went to see them and they were not at home.", "See the file for details.", "Copyright 2020 the authors.", "The commons were open to all and the attribution was disputed.",
    "The software and the files are in the other folder.", "A foundation was laid in the first year.", "Mozilla and boost are words that people say.", "The domain of the function is the public record.",
    "MIT license plate frames for sale", "The MIT license plate was on the car.", "License plate frames with the Apache sign", "A GPL is a gallon per lap here.", "ISC is a club of sailors.",
)
#: Words that tell one licence from the next; with made-up names in their place a template is unknown.
NAMES = r"(?i)\b(mit|apache|gnu|[al]?gplv?\d?|bsd|mozilla|mpl|boost|bsl|creative|commons|cc0?|affero|lesser|isc|wtfpl|unlicense)\b"
MADE_UP = ("Zebra", "Example", "Foo", "Harbour", "Acme", "Orchid")
UNKNOWN = "unknown"
#: What says that a licence follows, whichever it is; a piece with one is judged even if it is like no template.
CUES = ("spdx-license-identifier", "licensed under", "license version", "lizenz")
#: The least probability at which a piece names a family beside another one.
SECOND = 0.2
#: Words of a piece; share of a template's pairs that must be found (all of up to four).
WINDOW, CONFIRM = 72, 0.6
#: Rows with the same piece are dealt out over so many keys, as a third of all may have it.
SALTS = 32
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Words too common to tell anything.
COMMON = frozenset("a an and any are as by for in is it may no not of on or part that the this to under use with work you".split())


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("licence"), F.lit("license")), F.lit(WORD), F.lit(0))


def _pairs(w: Column) -> Column:
    """Neighbouring words, for at least two of them."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))


def grams(w: Column) -> Column:
    """The distinct one- and two-word grams of an array of words."""
    return F.array_distinct(F.concat(w, F.when(F.size(w) > 1, _pairs(w)).otherwise(F.array().cast("array<string>"))))


def parts_of(template: str) -> list[str]:
    """What a template is compared by: its distinct word pairs, or its only word."""
    w = re.findall(WORD, template.lower().replace("licence", "license"))
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])}) if len(w) > 1 else w


def needed(n: int, confirm: float = CONFIRM) -> int:
    return max(math.ceil(confirm * n), min(n, 4))


def rarest(template: str, confirm: float = CONFIRM) -> list[str]:
    """The parts of which one must stand wherever the template is confirmed: those with the fewest common words, then the longest."""
    parts = sorted(parts_of(template), key=lambda p: (sum(w in COMMON for w in p.split()), -len(p), p))
    return parts[: len(parts) - needed(len(parts), confirm) + 1]


def gate(confirm: float = CONFIRM) -> str:
    """A pattern for words joined by single blanks, found wherever any template can be confirmed."""
    parts = sorted({*CUES, *(p for ts in TEMPLATES.values() for t in ts for p in rarest(t, confirm))})
    return f"(?:^| )(?:{'|'.join(p.replace('.', '[.]') for p in parts)})(?: |$)"


def _variants() -> list[tuple[str, str, int]]:
    """(family, text, held back) of every template: as it is, among other sentences, with words left out; and of what is unknown."""
    draw, out = random.Random(7), []
    other = lambda: draw.choice(OTHERS[1:])
    for family, texts in TEMPLATES.items():
        for text in texts:
            parts = text.split()
            forms = [text, text.upper(), f"Note: {text}", f"{text} or later", f"Code is {text}", f"Distributed under the {text}", f"of the and {text} in on is", f"{other()} {text}", f"{text} {other()}", f"{other()} {text} {other()} {other()}"]
            for _ in range(6 if len(parts) > 6 else 0):
                some = [p for p in parts if draw.random() > 0.12 or re.search(NAMES, p)]
                forms.append(" ".join(some) if draw.random() < 0.5 else f"{other()} {' '.join(some)} {other()}")
            out += [(family, form, i % 4 == 3) for i, form in enumerate(forms)]
    strange = [re.sub(NAMES, lambda _: draw.choice(MADE_UP), t) for ts in TEMPLATES.values() for t in ts if re.search(NAMES, t) and len(t.split()) > 2]
    strange += ["Licensed under the terms of the license", "Released under a license", "under the license, version 2.0", "This work is licensed under", "a general license, version 4.0", "SPDX-License-Identifier: NONE-1.0", "Released under the Example License."]
    plain = [*OTHERS, *strange, *[f"{other()} {s}" for s in strange], *[f"{other()} {other()}" for _ in range(120)], *[f"{other()} {other()} {other()} {other()}" for _ in range(60)]]
    out += [(UNKNOWN, t, i % 4 == 3) for i, t in enumerate(plain)]
    return [(f, t, int(h)) for f, t, h in out]


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of constants as SQL."""
    text = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else repr(v)
    names = ", ".join(c.split()[0] for c in schema.split(", "))
    casts = ", ".join(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in schema.split(", "))
    return spark.sql(f"select {casts} from values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)} as t({names})")


def chances(found: list[str], weights: dict[str, list[tuple[int, float]]], shift: list[float], heat: float) -> list[float]:
    """The families' probabilities for the grams of one piece, by a plain loop."""
    z = list(shift)
    for g in found:
        for i, w in weights.get(g, ()):
            z[i] += w
    e = [math.exp((v - max(z)) / heat) for v in z]
    return [v / sum(e) for v in e]


@functools.lru_cache(maxsize=1)
def fitted(spark: SparkSession) -> tuple[list[tuple], list[float], list[str], float, float, float]:
    """(gram, family, weight) rows, intercepts, families, temperature, least probability, share of held-back variants named rightly; the same for every corpus."""
    families = [UNKNOWN, *sorted(TEMPLATES)]
    rows = _variants()
    data = _values(spark, [(families.index(f), t, h) for f, t, h in rows], "label double, text string, held int").coalesce(1)
    data = data.withColumn("grams", grams(words(F.col("text")))).cache()
    counter = CountVectorizer(inputCol="grams", outputCol="x", binary=True, minDF=1.0).fit(data)
    model = LogisticRegression(featuresCol="x", family="multinomial", regParam=0.001, maxIter=80).fit(counter.transform(data.filter("held = 0")))
    table, shift = model.coefficientMatrix.toArray(), [float(s) for s in model.interceptVector.toArray()]
    weights = [(g, i, float(table[i, j])) for j, g in enumerate(counter.vocabulary) for i in range(len(families)) if abs(table[i, j]) > 1e-9]
    known = {}
    for g, i, w in weights:
        known.setdefault(g, []).append((i, w))
    held = [(int(r.label), r.grams) for r in data.filter("held = 1").select("label", "grams").collect()]
    data.unpersist()
    heat = min((0.05 * 1.2**k for k in range(24)), key=lambda t: -sum(math.log(max(chances(g, known, shift, t)[label], 1e-12)) for label, g in held))
    judged = [(label, chances(g, known, shift, heat)) for label, g in held]
    # The least probability lets at most one in a hundred of the held-back unknown through.
    loose = sorted((max(p[1:]) for label, p in judged if label == 0), reverse=True)
    least = max(0.5, min(0.9, loose[len(loose) // 100] + 1e-6))
    right = sum((p.index(max(p)) if max(p) == max(p[1:]) and max(p) >= least else 0) == label for label, p in judged) / len(judged)
    return weights, shift, families, heat, least, right


def pieces(text: Column) -> Column:
    """The distinct pieces of a paragraph, as words joined by single blanks: its sentences and its lines, long ones in windows."""
    sentences = F.split(F.regexp_replace(text, r"\s*\n\s*", " "), r"[.!?;]\s+")
    each = F.transform(F.concat(sentences, F.split(text, "\n")), words)
    windows = F.flatten(F.transform(each, lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil((F.size(w) - WINDOW) / (WINDOW // 2)), F.lit(0)).cast("int")), lambda k: F.slice(w, k * (WINDOW // 2) + 1, WINDOW))))
    return F.array_distinct(F.transform(windows, lambda w: F.array_join(w, " ")))


def judged(texts: DataFrame, confirm: float = CONFIRM) -> DataFrame:
    """piece, family, chance, match for each distinct row of ``texts`` (piece: words joined by blanks), a row for each family named; family unknown, with the largest chance of any, if none is."""
    spark = texts.sparkSession
    weights, shift, families, heat, least, _ = fitted(spark)
    # A row a gram, its weights in one text: a literal for each would fill the driver when it parses them.
    of = {}
    for g, i, w in weights:
        of.setdefault(g, [0.0] * len(families))[i] = w
    table = _values(spark, [(g, " ".join(map(repr, w))) for g, w in of.items()], "gram string, texts string").select("gram", F.split("texts", " ").cast("array<double>").alias("weights"))
    known = _values(spark, [(f, f"{f}/{i}", needed(len(parts_of(t)), confirm), len(parts_of(t)), p) for f, ts in TEMPLATES.items() for i, t in enumerate(ts) for p in parts_of(t)], "family string, template string, needed int, size int, gram string")
    some = keep(texts.select("piece").distinct().withColumn("key", F.monotonically_increasing_id()))
    exploded = some.select("key", F.explode(grams(F.split("piece", " "))).alias("gram"))
    by_class = [F.sum(F.get("weights", F.lit(i))).alias(f"z{i}") for i in range(len(families))]
    scores = exploded.join(F.broadcast(table), "gram").groupBy("key").agg(*by_class)
    z = F.array(*[F.struct(((F.coalesce(f"z{i}", F.lit(0.0)) + s) / heat).alias("z"), F.lit(f).alias("family")) for i, (s, f) in enumerate(zip(shift, families))])
    best = some.select("key").join(scores, "key", "left").select("key", z.alias("zs")).withColumn("top", F.array_max("zs"))
    odds = F.transform("zs", lambda x: F.exp(x["z"] - F.col("top.z")))
    best = best.withColumn("odds", odds).withColumn("whole", F.aggregate("odds", F.lit(0.0), lambda a, x: a + x))
    best = best.select("key", (1.0 / F.col("whole")).alias("most"), F.map_from_arrays(F.transform("zs", lambda x: x["family"]), F.transform("odds", lambda o: o / F.col("whole"))).alias("chances"))
    found = exploded.join(F.broadcast(known), "gram").groupBy("key", "family", "template").agg(F.count("*").alias("n"), F.max("needed").alias("needed"), F.max("size").alias("size"))
    found = found.filter("n >= needed").groupBy("key", "family").agg(F.max(F.col("n") / F.col("size")).alias("match"))
    likely = found.join(best, "key").withColumn("chance", F.col("chances")[F.col("family")]).filter(F.col("chance") >= SECOND)
    sure = likely.groupBy("key").agg(F.sum("chance").alias("all"), F.collect_list(F.struct("family", "chance", "match")).alias("named")).filter(F.col("all") >= least)
    none = F.array(F.struct(F.lit(UNKNOWN).alias("family"), F.col("most").alias("chance"), F.lit(0.0).alias("match")))
    out = some.join(best.select("key", "most"), "key").join(sure.select("key", "named"), "key", "left")
    return out.select("piece", F.explode(F.coalesce("named", none)).alias("x")).select("piece", "x.family", "x.chance", "x.match")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirm: float = CONFIRM) -> DataFrame:
    """doc_id, n_paragraphs, n_licences, n_unknown, licences for each row: paragraphs that name a family, those that only sound like one, the families."""
    text, pattern = F.coalesce(F.col(text_col), F.lit("")), gate(confirm)
    paragraphs = F.filter(F.transform(F.split(text, r"\n(?:[\x20\t\r]*\n)+"), lambda p: F.trim(p)), lambda p: p.rlike(r"\S"))
    seems = F.array_join(words(text), " ").rlike(pattern)
    found = F.filter(F.transform("all", lambda p: F.filter(pieces(p), lambda x: x.rlike(pattern))), lambda x: F.size(x) > 0)
    rows = docs.select(F.col(id_col).alias("doc_id"), paragraphs.alias("all"), seems.alias("seems")).withColumn("some", F.when(F.col("seems"), found))
    rows = keep(rows.select("doc_id", F.size("all").cast("long").alias("n_paragraphs"), "some", F.monotonically_increasing_id().alias("row")))
    each = rows.filter(F.size("some") > 0).select("row", F.posexplode("some").alias("place", "of")).select("row", "place", F.explode("of").alias("piece"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    named = judged(each.select("piece"), confirm).select("piece", "family", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    of = each.join(named, ["piece", "salt"]).groupBy("row", "place").agg(F.array_remove(F.collect_set("family"), UNKNOWN).alias("families"))
    of = of.groupBy("row").agg(F.count_if(F.size("families") > 0).alias("n_licences"), F.count_if(F.size("families") == 0).alias("n_unknown"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("licences"))
    out = rows.join(of, "row", "left")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_licences", F.lit(0)).alias("n_licences"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.coalesce("licences", F.lit("")).alias("licences"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    from ledgerloom.llm.common import table

    return scan(table(spark, sf_dir, "documents"))
