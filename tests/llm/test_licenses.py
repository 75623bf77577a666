import random
import re

import pytest

from millrace.llm import licenses as L


@pytest.fixture(scope="module")
def model(spark):
    return L.train(spark)


def families(spark, model, lines):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    return {r.doc_id: r.family for r in L.scan_paragraphs(df, model).collect()}


def plain_words(text):
    """The words of a text, split anew."""
    if re.search("[a-zà-öø-ÿ]", text) or re.fullmatch(r"\W*(THE\W+)?MIT(\W+LICEN[CS]E)?\W*", text):
        text = re.sub(r"(?<![^\W_])(?<!\.)MIT(?![^\W_])", ".MIT", text)
    return [x for x in re.split(r"[^\w.]+|_+|\.(?=\s|$)", text.lower()) if x]


def plain_grams(w):
    """Words and pairs of neighbouring ones."""
    w = plain_words(w) if isinstance(w, str) else w
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def brute(model, text):
    """(line, family) of each line by scoring every one of them, without any choice of lines."""
    templates = [(t["f"], set(t["g"])) for t in model.templates]
    out = []
    for i, line in enumerate((text or "").split("\n")):
        g = plain_grams(line)
        p = model.probabilities(list(g))
        best = L.CLASSES[max(range(len(p)), key=p.__getitem__)]
        if best == "ordinary" or max(p) < L.LEAST:
            continue
        fits = any(f == best and len(g & t) >= L.CONFIRM * len(t) for f, t in templates)
        out.append((i, best if fits and max(p) >= L.SURE else "unknown"))
    return out


def brute_blocks(model, text):
    """(first line, last line, family) of templates wrapped over lines: windows about the needed words, one by one."""
    templates = [(t["f"], set(t["g"]), t["w"], set(L.needed_words(t))) for t in model.templates]
    share = lambda g, t: len(g & t) / len(t)
    lines, out, at = (text or "").split("\n"), [], 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].strip():
            end += 1
        told = [(w, k) for k in range(at, end) for w in plain_words(lines[k])]
        best = {}
        for i, (word, _) in enumerate(told):
            for f, g, w, needed in templates:
                for o in [o for o, x in enumerate(w) if x == word and word in needed]:
                    slack = len(w) // L.SLACK
                    first = max(0, i - o - slack)
                    held = told[first : max(first, i - o + len(w) + slack)]
                    ks = [k for x, k in held if x in w]
                    fit = share(plain_grams([x for x, _ in held]), g)
                    if fit >= L.CONFIRM and max(ks) > min(ks):
                        best[f] = max(best.get(f, ()), (fit, len(g), -first, min(ks), max(ks), tuple(x for x, _ in held)))
        for f, (*_, low, high, held) in best.items():
            if any(f == t[0] and share(plain_grams(lines[k]), t[1]) >= L.CONFIRM for k in range(low, high + 1) for t in templates):
                continue
            p = model.probabilities(list(plain_grams(list(held))))
            if L.CLASSES[max(range(len(p)), key=p.__getitem__)] == f and max(p) >= L.SURE:
                out.append((low, high, f))
        at = end + 1
    return out


UNSEEN = {
    "licensed under the APACHE license, version 2.0": "Apache-2.0", "This work is Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "The code is released under the MIT license.": "MIT", "(c) 2020 Someone Else. All rights reserved.": "proprietary",
    "This work is licensed under the GNU General Public License, version 3.": "GPL", "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under the Quux Public License, version 9.": "unknown",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND': "MIT", "This work is in the public domain.": "public-domain",
    "CC BY-SA 4.0": "CC-BY-SA", "GPL-2.0-only": "GPL", "Copyright (c) 2020 Foo": "proprietary", "Available under CC BY 4.0.": "CC-BY",
}


def test_notices_are_classified(spark, model):
    got = families(spark, model, list(UNSEEN))
    assert {t: got.get(i) for i, t in enumerate(UNSEEN)} == UNSEEN
    probes = {
        "public domain": "public-domain", "GPL": "GPL", "Licence: MIT": "MIT", "Code licensed MIT": "MIT", "MIT": "MIT", "WTFPL": "unknown",
        "CC-BY-NC-ND 4.0": "CC-BY-NC-ND", "The Apache helicopter landed": None, "He studied at MIT for a year": None, "mit der Bahn": None,
        "KOMM!! MIT!! MIR!!": None, "THE MIT LICENSE": "MIT",
    }
    got = families(spark, model, list(probes))
    assert {t: got.get(i) for i, t in enumerate(probes)} == probes
    assert families(spark, model, ["Dual GPLv3 / Apache-2.0"])[0] in ("GPL", "Apache-2.0", "unknown")


def test_templates_confirm_their_family(spark, model):
    want = {t: f for f, ts in L.TEMPLATES.items() for t in ts}
    got = families(spark, model, list(want))
    wrong = {t: got.get(i) for i, t in enumerate(want) if got.get(i) != want[t]}
    assert set(wrong.values()) <= {"unknown"} and len(wrong) <= 4, wrong
    # Training sentences are others than the templates, but for identifiers of one word.
    assert all(" " not in t for t in set(want) & {t for _, t in L.training_sentences()})


def test_ordinary_lines_stay(spark, model):
    lines = ["Her fishing license was lost on the road.", "plain words", "", None, "Permission to enter was not given.", "The general manager of the public pool was kind.",
             "We drove through the Apache country in version two of the car.", "He copied the notice and sold the software.", "Er ging mit ihr nach Hause.", "Only one of them came."]
    assert families(spark, model, lines) == {}


def test_every_line_against_brute_force(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    notes = spark.createDataFrame([(10**6 + i, f"x y\n{t}\nz {t}") for i, t in enumerate([*UNSEEN, *L.PLAIN])], "doc_id long, text string")
    both = docs.union(notes)
    rows = L.scan_paragraphs(both, model).where("not contains(paragraph, '\n')").collect()
    want = sorted((r.doc_id, i, f) for r in both.collect() for i, f in brute(model, r.text))
    assert sorted((r.doc_id, r.line, r.family) for r in rows) == want and len(want) > 40
    # Of the documents' own lines only notices are found.
    assert all(re.search("licen[cs]e|rights reserved|public domain|CC BY", r.paragraph, re.I) for r in rows if r.doc_id < 10**6)


def wrap(text, width):
    out, line = [], ""
    for w in text.split(" "):
        line = f"{line} {w}".strip()
        if len(line) >= width:
            out, line = [*out, line], ""
    return "\n".join([*out, line]) if line else "\n".join(out)


def test_every_block_against_brute_force(spark, model):
    """Templates wrapped at several widths, amid other text, with words put in, twice in a block, and far from a template."""
    rng = random.Random(3)
    whole = [t for ts in L.TEMPLATES.values() for t in ts if len(t) > 25]
    docs = []
    for i, t in enumerate(whole):
        w = wrap(t, rng.choice([12, 20, 35]))
        docs.append(f"pad words\n{w}\nmore words\n\nend")
        docs.append(f"The first line of a text by its author\n{w.replace(' the ', ' the very ')}\n{wrap(whole[i - 1], 18)}\n \nAll rights\nreserved. {w}")
    docs += ["This work is in some public\n" + "place far away, said the man, who was\n" * 40 + "in the domain of the king", "x\n\ny", "license\nlicense\nunder the", None, ""]
    docs += [docs[0], docs[1]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.line + r.paragraph.count("\n"), r.family) for r in L.scan_paragraphs(df, model).where("contains(paragraph, '\n')").collect())
    want = sorted((i, *b) for i, t in enumerate(docs) for b in brute_blocks(model, t))
    assert got == want and len(want) > 40
    assert not any(d == len(whole) * 2 for d, *_ in got)


#: Notices whose wording is in no training row and no template, and ordinary sentences: held wholly apart.
APART = [
    ("You can use this under the Apache License version 2.0", "Apache-2.0"), ("License :: OSI Approved :: MIT License", "MIT"), ("Our texts are CC BY 4.0 licensed", "CC-BY"),
    ("Content is available under CC BY-SA 4.0 unless noted", "CC-BY-SA"), ("Images: CC BY-NC 4.0", "CC-BY-NC"), ("Dedicated to the public domain", "public-domain"),
    ("Covered by the GNU General Public License", "GPL"), ("Source is GPLv3", "GPL"), ("GNU Lesser General Public License applies", "LGPL"), ("Mozilla Public License governs the code", "MPL"),
    ("BSD-3-Clause applies to all parts", "BSD"), ("Marked with CC0 1.0", "CC0"), ("Copyright (c) 2011 Some Company. All rights reserved.", "proprietary"), ("Given out under the Blorb Community License", "unknown"),
    ("Licensed under the Weaver Source License 3", "unknown"), ("The weather was fine all week", "ordinary"), ("We sold the house by the river", "ordinary"), ("A public road leads to the general store", "ordinary"),
    ("His right hand was in his pocket", "ordinary"), ("The version of the story that she knew was longer", "ordinary"), ("They gave notice to the owner of the library", "ordinary"), ("Form follows function", "ordinary"),
    ("The cc and the copy were lost", "ordinary"), ("All the software in the institute is old", "ordinary"),
]


def test_held_out_precision_recall_and_calibration(spark, model):
    got = families(spark, model, [t for t, _ in APART])
    found = [(f, got.get(i, "ordinary")) for i, (_, f) in enumerate(APART)]
    licences = [(f, g) for f, g in found if f != "ordinary"]
    assert sum(f == g for f, g in licences) >= 0.8 * len(licences)
    named = [(f, g) for f, g in found if g not in ("ordinary", "unknown")]
    assert sum(f == g for f, g in named) >= 0.9 * len(named)
    assert sum(g != "ordinary" for f, g in found if f == "ordinary") <= 1
    # The mean of what the model gives its choice is near the share that is right, and the temperature lies within those tried.
    best = [(max(p), L.CLASSES[p.index(max(p))] == f) for t, f in APART for p in [model.probabilities(list(plain_grams(t)))]]
    assert abs(sum(p for p, _ in best) / len(best) - sum(r for _, r in best) / len(best)) < 0.15
    assert L.TEMPERATURES[0] < model.temperature < L.TEMPERATURES[-1]
    # No group of rows is trained on and held out.
    groups = {}
    for f, _, group, _ in L.training_rows():
        groups.setdefault(f, []).append(group)
    assert all(len(set(g)) >= L.FOLDS or f in ("CC-BY-NC", "CC0") or len(set(g)) > 1 for f, g in groups.items())


def test_documents_of_old_mistakes(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id in (4244, 6640)")
    assert {r.family for r in L.scan_paragraphs(docs, model).collect()} == {"GPL"}


def test_plan_is_native_and_odd_rows(spark, model, odd_docs, no_docs):
    from contextlib import redirect_stdout
    from io import StringIO

    out = StringIO()
    with redirect_stdout(out):
        L.scan_paragraphs(odd_docs, model).explain()
    assert not any(x in out.getvalue() for x in ("Python", "Pandas", "Arrow"))
    assert L.scan_paragraphs(odd_docs, model).collect() == [] and L.scan_paragraphs(no_docs, model).collect() == []
    long = "pad words here. " * 20_000 + "\nAll rights reserved.\n\nReleased under the MIT License."
    df = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (None, "All rights reserved.", "b")], "doc_id long, text string, family string")
    rows = sorted(((r.doc_id or 0, r.line, r.family) for r in L.scan_paragraphs(df, model).collect()))
    assert rows == [(0, 0, "proprietary"), (1, 1, "proprietary"), (1, 1, "proprietary"), (1, 3, "MIT"), (1, 3, "MIT")]


def test_wrapped_templates(spark, model):
    pad = "pad words here. " * 50
    mit = ["Permission is hereby granted, free of charge, to any person", "obtaining a copy of this software and associated", "documentation files"]
    short = ["Released under the", "MIT License."]
    text = "\n".join([pad, "", pad, *mit, pad, " ", *short, "", "All rights reserved.", pad])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = {(r.line, r.family) for r in L.scan_paragraphs(df, model).collect() if r.family != "unknown"}
    assert (12 - 1, "proprietary") in found or (11, "proprietary") in found
    assert any(f == "MIT" and n in (2, 3, 4) for n, f in found) and any(f == "MIT" and n >= 8 for n, f in found)
