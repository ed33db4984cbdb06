"""Families, the unknown class, wrapped notices, scores and the gate against plain loops, odd input."""

import re

import pytest

from ledgerloom.llm import licenses as lic

MENTIONS = {
    "Distributed under the MIT licence": "MIT", "Code is MIT-licensed": "MIT", "License: Apache 2.0": "Apache-2.0", "licensed GPL v3": "GPL-3.0", "Mozilla Public License 2.0": "MPL-2.0",
    "Boost Software License": "BSL-1.0", "GPLv3 or later": "GPL-3.0", "Available under Creative Commons Attribution 4.0": "CC-BY", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "proprietary",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
}
WRAPPED = {
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without restriction",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except in compliance\nwith the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy of the MPL was not distributed",
    "LGPL": "under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation",
}
PLAIN = [t for t in lic.OTHERS if t] + ["her license was lost", "Licensed under the Zebra License, Version 7.0", "MIT researchers lost a license plate", "the gnu and the general met the public"]


def _words(text):
    return re.findall(lic.WORD, text.lower().replace("licence", "license"))


def _grams(w):
    return set(w) | {f"{a} {b}" for a, b in zip(w, w[1:])}


@pytest.fixture(scope="module")
def named(spark):
    texts = [*MENTIONS, *PLAIN, *[t for ts in lic.TEMPLATES.values() for t in ts]]
    return {x.piece: x for x in lic.judged(spark.createDataFrame([(" ".join(_words(t)),) for t in texts], "piece string")).collect()}


def test_mentions_and_templates_are_named(named):
    at = lambda t: named[" ".join(_words(t))].family
    assert {t: at(t) for t in MENTIONS} == MENTIONS
    right = [at(t) == f for f, ts in lic.TEMPLATES.items() for t in ts]
    assert sum(right) >= 0.95 * len(right)
    assert {at(t) for t in PLAIN} == {lic.UNKNOWN}


def test_scores_by_plain_loops(spark, named):
    weights, shift, families, heat, least, right = lic.fitted(spark)
    known = {}
    for g, i, w in weights:
        known.setdefault(g, []).append((i, w))
    for piece, x in named.items():
        have = _grams(piece.split())
        p = lic.chances(sorted(have), known, shift, heat)
        fits = {f: p[i] for i, f in enumerate(families) if p[i] >= lic.SECOND and any(len(have & set(lic.parts_of(t))) >= lic.needed(len(lic.parts_of(t))) for t in lic.TEMPLATES.get(f, ()))}
        fits = fits if sum(fits.values()) >= least else {}
        assert x.family in (fits or {lic.UNKNOWN}) and abs(x.chance - fits.get(x.family, max(p))) < 1e-9
    assert right > 0.9 and 0.5 <= least <= 0.9


PROBES = {
    "GNU GENERAL PUBLIC LICENSE Version 2, June 1991": "GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "Dual licensed under MIT or Apache 2.0": "Apache-2.0,MIT", "MIT license plate frames for sale": "",
    "SPDX-License-Identifier: EUPL-1.2": "unknown", "ISC License": "ISC", "WTFPL": "WTFPL", "The Unlicense": "public-domain", "See http://www.apache.org/licenses/LICENSE-2.0": "Apache-2.0", "Lizenz: MIT": "MIT", "Licensed under the Harbour Terms of 1999": "unknown",
    "Available under the GNU General Public License": "GPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation": "AGPL-3.0", "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA",
}


def test_probes_that_no_template_made(spark):
    out = lic.scan(spark.createDataFrame([(t, t) for t in PROBES], "doc_id string, text string")).collect()
    assert {x.doc_id: x.licences or ("unknown" if x.n_unknown else "") for x in out} == {t: f for t, f in PROBES.items() if t != "MIT license plate frames for sale"} | {"MIT license plate frames for sale": "unknown"}


def test_the_gate_loses_nothing():
    for ts in lic.TEMPLATES.values():
        for t in ts:
            parts, first = lic.parts_of(t), set(lic.rarest(t))
            # With none of the rarest, fewer than needed are left.
            assert first <= set(parts) and len(set(parts) - first) < lic.needed(len(parts))
            assert all(re.search(lic.gate(), f"so {p} it") for p in first)


@pytest.mark.parametrize("around", ["{}", "Some words before.\nAnd a line\n{}\nand words after", "intro\n\n{}\n\nend", "word " * 500 + "{}" + " word" * 500])
def test_wrapped_notices(spark, around):
    rows = [(i, around.format(t), f) for i, (f, t) in enumerate(WRAPPED.items())]
    got = {x.doc_id: x.licences for x in lic.scan(spark.createDataFrame(rows, "doc_id long, text string, family string")).collect()}
    assert got == {i: f for i, _, f in rows}


def test_rows_of_documents(spark):
    texts = ["Released under the MIT License.\nReleased under the MIT License.\n\nhello", None, "", "\n \n", "my license\nAll rights reserved.", "word " * 60000 + "\nLicensed under the Apache License, Version 2.0.", "a\n\nLicensed under MIT\nApache License 2.0\nGPLv3\n\nAffero and the GNU General Public License as a Zebra"]
    rows = [(t, i, 7) for i, t in enumerate(texts)] + [(texts[0], 0, 7), (texts[0], None, 7)]
    out = lic.scan(spark.createDataFrame(rows, "text string, doc_id long, piece int")).collect()
    assert len(out) == len(rows)
    got = {(x.doc_id, x.n_paragraphs, x.n_licences, x.licences) for x in out}
    assert got - {x for x in got if x[0] == 6} == {(0, 2, 1, "MIT"), (1, 0, 0, ""), (2, 0, 0, ""), (3, 0, 0, ""), (4, 1, 1, "proprietary"), (5, 1, 1, "Apache-2.0"), (None, 2, 1, "MIT")}
    assert next(set(x.licences.split(",")) >= {"Apache-2.0", "GPL-3.0", "MIT"} for x in out if x.doc_id == 6)


def test_unknown_is_used(spark):
    texts = ["This work is licensed under the Zebra General Public License, version 3, by the lake.", "permission is hereby granted to leave"]
    out = lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all(x.n_licences == 0 for x in out) and sum(x.n_unknown for x in out) >= 1


def test_empty_table(spark):
    assert lic.scan(spark.createDataFrame([], "text string, doc_id long")).count() == 0
