import random

import pytest

from tarnlake.llm.license_texts import NOTICES, templates
from tarnlake.llm.licenses import findings, scan, words


def names(text):
    return [(f[2], not f[4]) for f in findings(text)]


def test_every_wording_is_its_own():
    for name, text in templates():
        got = findings("Some prose first.\n" + text + "\nAnd some prose after it all.")
        assert [(f[2], f[4]) for f in got if f[2] != "Proprietary"] == [(name, ())] or name == "Proprietary", (name, got)


def test_rights_reserved():
    line = "All rights reserved."
    for text in NOTICES["Proprietary"]:
        assert names("Some prose first.\n" + text + "\nAnd some prose after it all.") == [("Proprietary", True)]
    (only,) = findings("Some prose first.\n" + line + "\nAnd some prose after it all.")
    assert only[:2] == (18, 18 + len(line))
    assert names("Copyright 2020 A. Holder. All rights reserved.") == [("Proprietary", True)]


def test_wordings_that_compress_worse_than_others():
    assert [f[2] for f in findings("This software is licensed under the terms of the MIT License.")] == ["MIT"]
    assert names("This program is free software; it is released under the MIT License.") == [("MIT", True)]
    assert names("All the licensed doctors have rights and seats that are reserved.") == []


def wrap(text, every=9):
    own = text.split()
    return "\n".join(" ".join(own[i : i + every]) for i in range(0, len(own), every))


def test_notices_side_by_side():
    mit, bsd, apache = NOTICES["MIT"][2], NOTICES["BSD-2-Clause"][0], NOTICES["Apache-2.0"][0]
    assert names(wrap(mit) + "\n\n" + wrap(bsd)) == [("MIT", True), ("BSD-2-Clause", True)]
    text = f"{apache}\n{wrap(mit)}"
    assert [(text[f[0] : f[1]], *f[2::2]) for f in findings(text)] == [(apache, "Apache-2.0", ()), (wrap(mit), "MIT", ())]
    assert names(f"{apache}\nLicensed under CC BY 4.0.\n{wrap(mit)}") == [("Apache-2.0", True), ("CC-BY-4.0", True), ("MIT", True)]
    assert [f[2::2] for f in findings(f"{apache}\n" + wrap(mit.replace("free of charge", "free of any charge")))] == [("Apache-2.0", ()), ("MIT", (" -> any",))]
    # two in a line, and the same one twice
    text = "Released under the MIT License. Licensed under CC BY 4.0."
    assert [(text[f[0] : f[1]], f[2]) for f in findings(text)] == [("Released under the MIT License.", "MIT"), ("Licensed under CC BY 4.0.", "CC-BY-4.0")]
    assert names("Released under the MIT License.\n" * 3) == [("MIT", True)] * 3
    # a line that a wrapped notice starts with is part of it
    assert names(wrap(NOTICES["Apache-2.0"][1])) == names(wrap(NOTICES["Apache-2.0"][1], 7)) == [("Apache-2.0", True)]
    assert names("Licensed under the GNU General Public License, version\n3.") == [("GPL-3.0", True)]


@pytest.mark.parametrize("text", [None, "", "no sign here", "the permission slip and the warranty of a car were lost", "a licensed doctor under the old bridge", "x" * 200_000])
def test_clean_texts(text):
    assert names(text) == []


def test_differences_spans_and_versions():
    text = "Préface.\nReleased under the MIT License.\nProse goes on here.\nThis work is licensed under the GNU General Public License, version 2.\n" + "filler. " * 100 + "Licensed under CC BY-NC 4.0. More filler follows."
    got = findings(text)
    assert [(f[2], not f[4]) for f in got] == [("MIT", True), ("GPL-2.0", True), ("CC-BY-NC-4.0", True)]
    assert [text[f[0] : f[1]] for f in got][0] == "Released under the MIT License."
    changed = NOTICES["MIT"][2].replace("free of charge", "free of any charge")
    lines = changed.replace(", ", ",\n")
    (only,) = findings("Start\n" + lines)
    assert only[2] == "MIT" and only[4] == (" -> any",)


def test_frame(spark):
    rows = [(1, "Released under the MIT License.", "x"), (1, "Released under the MIT License.", "x"), (2, None, "x"), (3, "", "x"), (None, "Licensed under the Apache License, Version 2.0.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = scan(df).collect()
    assert sorted((r.doc_id or 0, r.license, r.exact, r.end - r.start) for r in got) == [(0, "Apache-2.0", True, 47), (1, "MIT", True, 31), (1, "MIT", True, 31)]
    assert scan(df.limit(0)).count() == 0


def exact_by_brute_force(text):
    """Every place of every wording, word by word; longer ones first, none inside another."""
    own = words(text)
    taken, out = set(), []
    for name, wording in sorted(templates(), key=lambda t: -len(words(t[1]))):
        want = words(wording)
        for i in range(len(own) - len(want) + 1):
            if all(w[0] == "<" or w == x for w, x in zip(want, own[i : i + len(want)], strict=True)) and not taken & set(range(i, i + len(want))):
                taken |= set(range(i, i + len(want)))
                out.append((i, name))
    return [name for _, name in sorted(out)]


def test_against_brute_force():
    rng = random.Random(12)
    prose = ["the river went by the old mill and nobody spoke of it again", "a green house stood at the end of the long road", "she counted seven birds before the rain came down"]
    plain = [(n, t) for n, t in templates() if "<" not in t and len(words(t)) > 4]
    found = 0
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += [rng.choice(prose) + "." for _ in range(rng.randint(1, 4))]
            text = rng.choice(plain)[1]
            parts.append(wrap(text, rng.choice([6, 9, 14])) if len(words(text)) > 20 and rng.random() < 0.6 else text)
        parts.append(rng.choice(prose))
        text = "\n\n".join(parts)
        want = exact_by_brute_force(text)
        assert [f[2] for f in findings(text)] == want, text
        found += len(want)
    assert found > 150
