import hashlib
import random

import pytest
import regex

from millrace.llm.fill_in_middle import CODE_POINT, Markers, Rule, fill_in_middle, op13_fill_in_middle, rearrange, restore


def plain(doc_id, text):
    """The contract in plain steps over a list of characters."""
    chars, text = list(text or ""), text or ""
    n = len(chars)
    hexed = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[8 * i : 8 * i + 8], 16) for i in range(4)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, digest(text), digest(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(chars[:low]), "".join(chars[low:high]), "".join(chars[high:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return n, form, low, high - low, digest(out), digest(text)


FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def held(df, docs):
    got = sorted((tuple([r.doc_id, *(r[f] for f in FIELDS)]) for r in df.collect()), key=repr)
    want = sorted(((r.doc_id, *plain(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert got == want


def test_query(spark, sf):
    held(op13_fill_in_middle(spark, sf), spark.read.parquet(f"{sf}/documents.parquet"))


def test_odd_rows(odd_docs, no_docs):
    held(fill_in_middle(odd_docs), odd_docs)
    assert fill_in_middle(no_docs).collect() == []


def test_markers_line_ends_and_clashing_columns(spark):
    texts = ["a<P>b", "<M>", "<S", "<" * 50, "<P<S<M" * 9, "\r\n\n\x00 x", "é😀" * 5, None, "", "z" * 300_000]
    rows = [(i, t, "old", "old", i) for i, t in enumerate(texts * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Form string, made string, `own column 0` long")
    got = fill_in_middle(docs)
    assert got.columns == ["doc_id", "text", "made", "own column 0", "n", "form", "prefix_chars", "middle_chars", "output", *FIELDS[-2:]]
    held(got, docs)
    for r in got.collect():
        assert restore(r.output, r.form) == (r.text or "") and r.made == "old" and r["own column 0"] == r.doc_id


def test_other_units_and_markers():
    marks = Markers("⟨prefix⟩", "⟨suffix⟩", "⟨middle⟩")
    rng = random.Random(5)
    for unit in (CODE_POINT, r"\s*\S+", r"[^\n]*\n", r"\X", "never"):
        pattern, forms = regex.compile(unit), set()
        for i in range(300):
            text = "".join(rng.choice("ab \n é́⟨⟩") for _ in range(rng.randrange(40)))
            n, form, prefix, middle, out = rearrange(text, i, pattern, marks, Rule(seed="s", rearranged=95, suffix_first=50))
            ends = [m.end() for m in pattern.finditer(text)]
            assert n == len(ends) and restore(out, form, marks) == text
            if form != "plain":
                assert {prefix, prefix + middle} <= {0, *ends}
            forms.add(form)
        assert forms == {"plain", "psm", "spm"}
    with pytest.raises(ValueError, match="no output"):
        restore("text", "psm")


@pytest.mark.parametrize("marks", [("a", "a", "b"), ("", "a", "b"), ("ab", "bc", "x"), ("aXa", "b", "c"), ("abc", "b", "x")])
def test_markers_that_could_overlap_are_refused(marks):
    with pytest.raises(ValueError, match="marker"):
        Markers(*marks)
