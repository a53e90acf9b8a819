import re
from itertools import product

import numpy as np
import pytest
from tessera.llm import licenses as L


def all_rules(text):
    return [(m.start(), m.end(), i) for i, r in enumerate(L.rules()) for m in r.regex.finditer(text)]


def settled(found):
    """Each detection against each other."""
    every = L.rules()
    rank = lambda x: (-every[x[2]].priority, x[0] - x[1], x[0], x[2])
    return sorted(x for x in found if not any(rank(y) < rank(x) and y[0] <= x[0] and y[1] >= x[1] for y in found if y != x))


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); see http://www.apache.org/licenses/LICENSE-2.0",
    "SPDX-License-Identifier: MIT\nPermission is hereby granted, free of charge, to any person obtaining a copy",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3",
    "Creative Commons Attribution-ShareAlike 4.0, CC BY-NC 3.0 and https://creativecommons.org/licenses/by/4.0/",
    "the MIT License and the BSD 3-Clause... 3-clause BSD; Mozilla Public License 2.0; GPLv2+; lgpl-2.1",
    "Copyright (c) 2019-2024 by ünïcode people. All rights reserved. İstanbul mit license",
    "no licence here, permit, smit license",
    "",
]


def test_there_are_hundreds_of_rules():
    assert len(L.rules()) > 300 and len({r.name for r in L.rules()}) == len(L.rules())


@pytest.mark.parametrize("text", TEXTS)
def test_gates_lose_nothing(text):
    assert L.detect(text) == settled(all_rules(text))


def spelled(tree):
    """Texts of a parsed pattern: each alternative, each optional part with and without; all combinations where they are few."""
    parts = []
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                own = [chr(arg)]
            case "IN":
                own = [{"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "0"}.get(str(x), ".") if str(kind) == "CATEGORY" else chr(x) for kind, x in arg]
            case "MAX_REPEAT":
                own = [x * max(n, 0) for n in {arg[0], max(arg[0], 1)} for x in spelled(arg[2])]
            case "SUBPATTERN":
                own = spelled(arg[-1])
            case "BRANCH":
                own = [x for branch in arg[1] for x in spelled(branch)]
            case _:
                assert str(op) in ("ASSERT", "ASSERT_NOT"), op
                own = [""]
        parts.append(list(dict.fromkeys(own)))
    if np.prod([float(len(x)) for x in parts]) <= 24:
        return ["".join(x) for x in product(*parts)]
    return ["".join(x if k == i else y[0] for k, y in enumerate(parts)) for i, own in enumerate(parts) for x in own]


def test_every_alternative_of_every_rule_passes_a_gate():
    for r in L.rules():
        texts = [t for t in dict.fromkeys(spelled(re._parser.parse(r.pattern))) if r.regex.search(t)]
        assert texts, r.name
        for text in texts:
            assert any(all(x in text.lower() for x in g) for g in r.gates), (r.name, text)


ALTERNATIVES = [
    "(c) 2020 Foo",
    "Copyright 2020 Foo",
    "Creative Commons Zero 1.0",
    "CC0 universal",
    "Do What The Fuck You Want To Public License",
    "WTFPL",
    "Free Public License 1.0.0",
    "zero-clause BSD",
    "see //opensource.org/licenses/MIT there",
]


@pytest.mark.parametrize("text", ALTERNATIVES)
def test_gates_of_single_alternatives(spark, text):
    want = settled(all_rules(text))
    assert want and L.detect(text) == want
    rows = L.detections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((r["start"], r["end"], r["rule"]) for r in rows) == sorted((s, e, L.rules()[r].name) for s, e, r in want)


def test_joined_texts_as_brute_force():
    for a, b in product(TEXTS, TEXTS):
        text = a + " " + b
        assert L.detect(text) == settled(all_rules(text))


def test_known_licences():
    name = lambda t: {L.rules()[r].license for *_, r in L.detect(t)}
    assert "Apache-2.0" in name(TEXTS[0]) and "MIT" in name(TEXTS[1]) and {"GPL-3.0", "GPL"} & name(TEXTS[2])
    assert {"CC-BY-SA-4.0", "CC-BY-NC-3.0", "CC-BY-4.0"} <= name(TEXTS[3])
    assert {"MIT", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "LGPL-2.1"} <= name(TEXTS[4])
    assert not name(TEXTS[6]) and not name("")
    tag = L.detect("SPDX-License-Identifier: Apache-2.0")
    assert len(tag) == 1 and L.rules()[tag[0][2]].priority == L.TAG


def test_settling_of_random_intervals():
    rng = np.random.default_rng(2)
    for _ in range(200):
        found = list({(int(s), int(s + n), int(r)) for s, n, r in zip(rng.integers(0, 12, 9), rng.integers(1, 9, 9), rng.integers(0, len(L.rules()), 9))})
        assert L.settle(found) == settled(found)


def test_rows(spark, messy):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])] + [(None, TEXTS[0]), (0, TEXTS[0]), (99, "x " * 200_000 + TEXTS[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["start"], r["end"], r["rule"]) for r in L.detections(df).collect()), key=repr)
    want = sorted(((d, s, e, L.rules()[r].name) for d, t in rows for s, e, r in settled(all_rules(t or ""))), key=repr)
    assert got == want
    assert L.detections(messy).count() == 0
    assert L.detections(df.limit(0)).count() == 0
