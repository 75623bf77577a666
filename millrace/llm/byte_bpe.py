"""Byte-level BPE by the tiktoken library with a local rank file."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import per_text

#: Longer texts are encoded piece by piece, each of about this many characters.
PIECE = 1 << 16
#: A cut before a space that follows anything but white space: no match of the pattern spans it, and no
#: look-ahead before it depends on what follows.
_SAFE = regex.compile(r"(?<=\S)(?= )")


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank); kept per worker process."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE) -> list[str]:
    """Cuts of ``text`` at safe boundaries; one piece where there is none."""
    out, start = [], 0
    while len(text) - start > most:
        cut = _SAFE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


def encode_text(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers; null is an empty text."""
    text = text or ""
    if len(text) <= PIECE:
        return np.array(encoding.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(encoding.encode_ordinary(p), "<u4") for p in pieces(text)])


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Append ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit) of each whole text.

    Null and empty texts have no ids. Whole texts are encoded, however long, piece by piece. Repeated rows
    each get their ids, an empty table gives no rows; rows don't depend on each other, so there are no ties.
    Input columns named like an output (in any case) are replaced by it, all others stay.
    """

    def make(texts):
        e = load_encoding(path, pattern)
        ids = [encode_text(e, t) for t in texts]
        return [[len(x) for x in ids], [x.tobytes() for x in ids]]

    return per_text(docs, text, "n_tokens long, ids binary", make)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Append ``decoded``: the raw bytes of each row's ids, which need not be valid UTF-8. Null ids give none."""

    def make(rows):
        e = load_encoding(path, pattern)
        return [[e.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in rows]]

    return per_text(encoded, ids, "decoded binary", make)


def public_files() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs))


def round_trip(docs: DataFrame, rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encode and decode again: ``docs`` without its text, with n_tokens, ids and decoded."""
    path, own = public_files()
    args = (rank_file or path, pattern or own)
    return decode_documents(encode_documents(docs, *args).drop("text"), *args)


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
