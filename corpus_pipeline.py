"""Corpus pipeline: quality, near duplicates, decontamination, pseudonyms, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and reads it again for the next. All but the last return the columns of ``documents``. Null and
empty texts pass through every stage (the quality stage judges them as empty pages); an empty table stays
empty; columns that ``documents`` has besides are kept up to the last stage, whatever their names. Rows
repeated in full pass alike, but that one of each class of near duplicates stays. Whole texts are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.byte_bpe import round_trip
from millrace.llm.common import with_outputs
from millrace.llm.decontamination import find_contamination, verdicts
from millrace.llm.near_duplicates import drop_near_duplicates
from millrace.llm.pseudonyms import private_key, replace_private
from millrace.llm.quality import judge
from millrace.session import materialize


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged, own = with_outputs(docs, ["doc_id", "text", "lang", "source", "n_chars"], lambda d: judge(d, labels))
    return judged.where("keep").select(*own)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: the one of least id."""
    return drop_near_duplicates(docs)


def decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies inside benchmark windows go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found, own = with_outputs(docs, ["text"], lambda d: verdicts(find_contamination(d, benchmark)))
    return found.where("not contaminated").select(*own)


def pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms of the same length, so n_chars stays right."""
    done, own = with_outputs(docs, ["text"], lambda d: replace_private(d, private_key(spark)))
    return done.select(*own)


def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit) of every whole text, with lang and source.

    The ids are decoded again: decoded_sha256 is the digest of the bytes that they give.
    """
    done = round_trip(docs.select("doc_id", "lang", "source", "text"))
    return done.select(
        "doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("tokens", tokens),
]

#: A trained classifier, sampled sketches and a tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
