import hashlib

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import encode_text, load_encoding, public_files


@pytest.fixture(scope="module", autouse=True)
def key(spark):
    spark.conf.set("spark.millrace.pii.key", "tests")
    yield
    spark.conf.unset("spark.millrace.pii.key")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name == "tokens":
            break
        assert out.columns == docs.columns
        rows = {r.doc_id: r.text for r in out.collect()}
        assert set(rows) <= set(kept) and (len(rows) < len(kept) or name == "pii")
        assert name == "pii" or all(rows[d] == kept[d] for d in rows)
        docs, kept = spark.createDataFrame(out.collect(), out.schema), rows
    e = load_encoding(*public_files())
    got = out.collect()
    assert {r.doc_id for r in got} == set(kept)
    assert all(r.ids == encode_text(e, kept[r.doc_id]).tobytes() for r in got)
    assert sorted(r.doc_id for r in P.run(spark, sf).collect()) == sorted(kept)


#: Names that operators give to outputs, or gave to temporary columns.
CLASHING = [
    "n_words", "spans", "item_ids", "n_hit", "contaminated", "_spans", "_items", "_both", "keep", "p_quality", "P_TOXIC", "_page", "_new",
    "pii_spans", "_key", "key", "_k", "_id", "class_id", "class_size", "first", "node", "bands", "total", "n", "least", "body", "c0", "c1",
    "who", "asked", "found", "ids", "n_tokens", "decoded", "own column 0", "own column 1", "canonical_0",
]


def test_columns_of_any_name_come_through(spark, odd_docs, no_docs, sf):
    """Each stage gives back rows as they were: the values of every column, not only its name."""
    # The fixture's n_chars is null throughout; a row's digest marks it in each added column.
    own = [c for c in CLASHING if c.lower() not in {x.lower() for x in odd_docs.columns}]
    mark = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("-"))))
    wide = odd_docs.select("*", *[F.concat(F.lit(f"{c} "), mark).alias(c) for c in own])
    before = {str(tuple(r)) for r in wide.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns, name
        rows = [str(tuple(r)) for r in out.collect()]
        assert set(rows) <= before and rows, name
        none = stage(spark, wide.limit(0), sf)
        assert none.columns == wide.columns and none.count() == 0, name
    assert P.tokens(spark, wide, sf).count() == odd_docs.count() and P.tokens(spark, no_docs, sf).count() == 0


def test_tokens_are_decoded_again(spark, odd_docs):
    rows = P.tokens(spark, odd_docs, "").collect()
    texts = sorted(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs.collect())
    assert sorted(r.decoded_sha256 for r in rows) == texts
