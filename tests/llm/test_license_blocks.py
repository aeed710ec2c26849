"""License templates over stretches of words against brute force, and canonical headers however their lines break."""

import random
import re
import textwrap

import pytest

from urlsift.llm import license_setjoin as lic

HEADERS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
           "above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
           "You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
           "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
            "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
            "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
              "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_labels(text, templates, percent):
    """(label, share) of all windows, stretch by stretch."""
    sets = [(label, set(t.split())) for label, t in templates]
    words, step, found = plain_words(text), max(lic.stretch(len(s)) for _, s in sets), set()
    for at in range(0, len(words), step):
        window, held = words[at:at + 2 * step], {}
        for k, (_, own) in enumerate(sets):
            span = lic.stretch(len(own))
            best = max(len(own & set(window[i:i + span])) for i in range(max(len(window) - span, 0) + 1))
            if 100 * best >= percent * len(own):
                held[k] = best / len(own)
        found |= {(sets[k][0], share) for k, share in held.items() if not any(sets[k][1] < sets[o][1] for o in held)}
    return found


def _texts():
    rng = random.Random(4)
    filler = "river stone cloud the a under license public software copy mit this of is to for".split()
    out = [None, "", " \n", "mit", "released under the MIT licence", "Released under the MIT License.",
           "it was released last year, well under budget, by people who hold the view that a license is what mit needs " * 3]
    for width in (30, 60, 72, 80, 10_000):
        for mark in ("", "# ", " * ", "// "):
            out += ["\n".join(mark + x for x in textwrap.wrap(t, width)) for t in HEADERS.values()]
    for _ in range(150):
        words = rng.choices(filler, k=rng.randrange(120))
        for _ in range(rng.randrange(3)):
            notice = [w for w in rng.choice(lic.TEMPLATES)[1].split() if rng.random() < 0.95]
            for k in range(rng.randrange(4)):
                notice.insert(rng.randrange(len(notice) + 1), rng.choice(filler))
            at = rng.randrange(len(words) + 1)
            words[at:at] = notice
        out.append(rng.choice([" ", "\n", ", "]).join(words))
    return out + ["mit license the " * 4000 + HEADERS["bsd"]]


@pytest.mark.parametrize("percent", [90, 70])
def test_matches_equal_brute_force(spark, percent):
    texts = dict(enumerate(_texts()))
    docs = spark.createDataFrame([(k, t, "row") for k, t in texts.items()], "doc_id long, text string, row string").repartition(4)
    got = {r.doc_id: r for r in lic.scan_licenses(docs, percent=percent).collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        want, words = plain_labels(text, lic.TEMPLATES, percent), plain_words(text)
        assert {(m.label, m.share) for m in got[k].matches} == want, text
        base = {x for x in got[k].base_labels.split(",") if x}
        assert got[k].labels == ",".join(sorted(base | {label for label, _ in want}))
        assert got[k].score == (1.0 if base else max([s for _, s in want], default=0.0))
        for m in got[k].matches:
            assert any(m.share == len(set(t.split()) & set(words[m.start:m.start + m.words])) / len(set(t.split()))
                       for label, t in lic.TEMPLATES if label == m.label)


def test_headers_are_found_however_lines_break(spark):
    rows = [(label, "\n".join(mark + x for x in textwrap.wrap(t, width))) for label, t in HEADERS.items()
            for width in (40, 60, 72, 80) for mark in ("", "# ", " * ")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    for r in lic.scan_licenses(docs).collect():
        assert r.doc_id in r.labels.split(","), (r.doc_id, r.labels)
        assert r.doc_id not in ("agpl", "lgpl") or r.labels == r.doc_id
    far = "it was released last year, well under budget, by people who hold the view that a license is what mit needs"
    assert lic.scan_licenses(spark.createDataFrame([(1, far)], "doc_id long, text string")).first().labels == ""
