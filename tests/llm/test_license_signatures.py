"""Hand-written license signatures on notices as they are printed, and suppression against all pairs."""

import random

import pytest

from vigil.llm import license_scan
from vigil.llm.license_signatures import SIGNATURES

NOTICES = {
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
 * Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without
 restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
 the above copyright notice and this permission notice appear in all copies.""",
    "bsd-3-clause": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
 derived from this software without specific prior written permission.""",
    "bsd-4-clause": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
 as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "gpl-3.0": """it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the
 License, or (at your option) any later version.""",
    "gpl": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "lgpl-2.1": """it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either
 version 2.1 of the License""",
    "agpl-3.0": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "fdl-1.3": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "cddl-1.0": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "artistic": "you can redistribute it and/or modify it under the same terms as Perl itself.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-sa-4.0": "See https://creativecommons.org/licenses/by-sa/4.0/ for the terms.",
    "zlib": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "bsl-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "openssl": 'This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit.',
    "ofl-1.1": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "json": "The Software shall be used for Good, not Evil.",
    "proprietary": "You may not copy, modify, reverse engineer, decompile, or disassemble the Software.",
    "elastic-2.0": "You may not provide the software to third parties as a hosted or managed service",
}


def labels_of(spark, texts):
    rows = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    return [set(r.labels.split(",")) - {""} for r in rows]


def test_notices(spark):
    got = labels_of(spark, ["Some file.\n\n" + t + "\n\nint main()" for t in NOTICES.values()])
    for label, found in zip(NOTICES, got, strict=True):
        assert label in found, (label, found)
    plain = ["She gave the origin of the story.", "A lesser man, a library; the public domain of kings", "no part of this was easy", "patent leather and a claim", ""]
    assert labels_of(spark, plain) == [set()] * 5


@pytest.mark.parametrize("number", range(len(SIGNATURES)))
def test_every_match_holds_the_keyword(number):
    """The gate never hides a match: the keyword stands in every way the pattern can be spelled out."""
    from re import _parser as parser

    def ways(tokens):
        out = [""]
        for op, value in tokens:
            name = str(op)
            if name == "LITERAL":
                more = [chr(value)]
            elif name == "IN":
                more = ["1"]
            elif name == "BRANCH":
                more = [w for branch in value[1] for w in ways(branch)]
            elif name == "SUBPATTERN":
                more = ways(value[-1])
            else:
                assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
                low, high, inner = value
                some = ways(inner)
                more = ([""] if low == 0 else []) + [w * max(low, 1) for w in some]
            out = [a + b for a in out for b in more]
            assert len(out) < 5000
        return out

    label, keyword, pattern = SIGNATURES[number]
    texts = ways(parser.parse(pattern))
    assert all(keyword in t for t in texts), (label, keyword)
    gates, _ = license_scan._compiled()
    for t in texts[:3]:
        assert any(d[3] == label or d[2] - d[1] >= len(t) for d in license_scan.detect(t, gates)), (label, t)


@pytest.mark.parametrize("seed", range(20))
def test_suppression_against_all_pairs(seed):
    rng = random.Random(seed)
    found = []
    for _ in range(rng.randint(0, 60)):
        a = rng.randrange(40)
        found.append((rng.randint(1, 5), a, a + rng.randint(1, 15), rng.choice("abc")))
    kept = []
    for d in sorted(set(found), key=lambda d: (d[0], d[1] - d[2], d[1], d[3])):
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    assert license_scan.resolve(found) == sorted(kept, key=lambda d: d[1:])


def test_long_text_of_many_notices(spark):
    """Thousands of notices in one text: places stay right."""
    text = "\n".join(f"file {i}. " + NOTICES["zlib"] for i in range(3000))
    row = license_scan.scan_licenses(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    one = len("file 0 the origin of this software must not be misrepresented you must not claim that you wrote the original software".split())
    assert [d.first_word for d in row.detections] == [2 + i * one for i in range(3000)] and {d.label for d in row.detections} == {"zlib"}
