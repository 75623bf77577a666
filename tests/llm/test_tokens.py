import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from millrace.llm import byte_bpe as B
from millrace.llm import token_store as S

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")


def random_texts(n=300):
    rng = random.Random(4)
    kinds = "aeB zéÀß ,.'’-!?\n\t\r\x1c\x85\u00a0\u2003019²½ œ你好😀\u0301İΣ"
    out = []
    for _ in range(n):
        some = rng.choices(kinds, k=rng.randrange(1, 12))
        out.append("".join(rng.choices([*some, "it's ", "the ", " word", "..."], k=rng.randrange(0, 60))))
    return out


def plain_bpe(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] == 1 << 40:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_byte_bpe_against_plain_merging():
    import regex

    e = B.load_encoding(RANKS, P.PATTERN)
    for t in random_texts(120):
        want = [i for m in regex.findall(P.PATTERN, t) for i in plain_bpe(m.encode(), e._mergeable_ranks)]
        assert B.encode_text(e, t).tolist() == want


@pytest.mark.parametrize("most", [1, 7, 50])
def test_cuts_are_safe(most, monkeypatch):
    monkeypatch.setattr(B, "PIECE", most)
    e = B.load_encoding(RANKS, P.PATTERN)
    for t in random_texts():
        cut = B.pieces(t, most)
        assert "".join(cut) == t
        assert B.encode_text(e, t).tolist() == e.encode_ordinary(t)


def test_byte_bpe_odd_rows(odd_docs, no_docs):
    e = B.load_encoding(RANKS, P.PATTERN)
    docs = odd_docs.collect()
    rows = B.digests(B.round_trip(odd_docs)).collect()
    want = []
    for d in docs:
        ids = np.array(e.encode_ordinary(d.text or ""), "<u4")
        text = (d.text or "").encode()
        want.append((d.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert B.round_trip(no_docs).collect() == []


def test_match_encoder_equals_the_library(odd_docs):
    t = Tokenizer.from_file(WORDS)
    texts = [r.text for r in odd_docs.collect()] + random_texts()
    want = [np.array(x.ids, "<u2").tobytes() for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    assert S.MatchEncoder(WORDS).encode(texts) == want
    latin = [chr(i) for i in range(256)] + [f"a{chr(i)}b {chr(i)}" for i in range(256)] + [f"{chr(i)}{chr(i)}." for i in range(256)]
    want = [np.array(x.ids, "<u2").tobytes() for x in t.encode_batch(latin, add_special_tokens=False)]
    assert S.MatchEncoder(WORDS).encode(latin) == want


def expected(docs, end=1):
    t = Tokenizer.from_file(WORDS)
    out, start = [], 0
    ids = {}
    rows = []
    for d in docs:
        i = t.encode(d.text or "", add_special_tokens=False).ids + [end]
        rows.append((d.doc_id is not None, d.doc_id or 0, len(i), i, d.doc_id))
    tie = lambda r: r[:3]  # noqa: E731 - of one doc_id and length there is one text here
    for r in sorted(rows, key=tie):
        out.append((r[4], start, r[2], zlib.crc32(np.array(r[3], "<u4").tobytes())))
        start += r[2]
    return out


@pytest.mark.parametrize("share", [50, S.RANGE])
def test_token_store(spark, odd_docs, tmp_path, share):
    path = str(tmp_path / "t")
    S.write_tokens(odd_docs, path, WORDS, share=share)
    got = S.checksums(S.read_tokens(spark, path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(odd_docs.collect())))
    meta = pq.ParquetFile(max(tmp_path.glob("t/*.parquet"), key=lambda f: f.stat().st_size)).metadata.row_group(0)
    by = {meta.column(i).path_in_schema: meta.column(i) for i in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in str(by["local_start"].encodings)
    assert any("DICTIONARY" in x for x in by["ids.list.element"].encodings)
    assert all(c.has_offset_index for c in by.values())


def test_no_tokens(spark, no_docs, tmp_path):
    S.write_tokens(no_docs, str(tmp_path / "t"), WORDS)
    assert S.checksums(S.read_tokens(spark, str(tmp_path / "t"))).collect() == []


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = S.op10_token_store(spark, sf).orderBy("doc_id").collect()
    assert list(map(tuple, rows)) == expected(docs)
    assert B.op5_byte_bpe(spark, sf).count() == len(docs)


def test_a_hot_id_lies_in_several_ranges(spark, tmp_path):
    """Repeated rows, many nulls and one id that most rows bear: starts are gapless and ranges even."""
    text = "the quick brown fox " * 20
    rows = [(7, text)] * 300 + [(None, text + "x")] * 150 + [(i, f"w{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    S.write_tokens(df, str(tmp_path / "t"), WORDS, share=4000)
    got = S.read_tokens(spark, str(tmp_path / "t")).select("doc_id", "start", "n_tokens").collect()
    got = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert len(got) == 500 and all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    ids = [r[2] for r in got]
    assert ids[:150] == [None] * 150 and ids[150:] == sorted(ids[150:])
    sizes = [r[0] for r in spark.read.parquet(str(tmp_path / "t")).groupBy("range").count().select("count").collect()]
    assert len(sizes) > 10 and max(sizes) < 100


def test_another_tokenizer_file_goes_through_the_library(spark, tmp_path):
    import json

    with open(WORDS, encoding="utf-8") as f:
        told = json.load(f)
    assert S.known_steps(WORDS)
    texts = ["It's 12 Ünder  ÄB's", "a\nb\tC.. x", "<|endoftext|> q"]
    for change in ({"normalizer": {"type": "NFC"}}, {"truncation": {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}},
                   {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        path = str(tmp_path / "other.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump({**told, **change}, f)
        assert not S.known_steps(path)
        e, t = S.MatchEncoder(path), Tokenizer.from_file(path)
        assert e.whole and e.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u2").tobytes() for x in texts]


def test_added_tokens_as_in_the_unmodified_library(spark, odd_docs, tmp_path):
    t = Tokenizer.from_file(WORDS)
    ids = lambda x: t.encode(x or "", add_special_tokens=False).ids
    marked = ["a <|endoftext|> b", "a<|endoftext|>b", "<|startoftext|>", "é <|startoftext|>\n<|endoftext|> 你 b", "<|ENDOFTEXT|>",
              "<|endof text|>", "<|endoftext|"]
    texts = [*marked, *[r.text for r in odd_docs.collect()], *random_texts()]
    assert S.MatchEncoder(WORDS).encode(texts) == [np.array(ids(x), "<u2").tobytes() for x in texts]
    assert 49407 in ids(marked[0])
    docs = spark.createDataFrame(list(enumerate(marked)), "doc_id long, text string")
    S.write_tokens(docs, str(tmp_path / "t"), WORDS)
    rows = S.read_tokens(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [r.ids for r in rows] == [[*ids(x), 1] for x in marked]
    assert [r.start for r in rows] == [sum(len(ids(x)) + 1 for x in marked[:i]) for i in range(len(marked))]
