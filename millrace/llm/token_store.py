"""Token ids in Parquet list columns, in ascending document order, with selective reads.

Documents are encoded once and their ids, two or four bytes each, are written; by these sizes they are dealt
in ranges of doc_id of equal shares, each range one sorted file. Ids are dictionary encoded, counters delta
encoded (format version 2); row groups and pages are small and carry page indexes, so a reader of a few
documents or of the metadata columns touches only their pages.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import slices, small_join
from millrace.session import discard, materialize, shared_dir

#: Bytes of packed ids in one range; bytes of a row group and of a page.
RANGE, ROW_GROUP, PAGE = 32 << 20, 16 << 20, 256 << 10
#: Distinct matches kept encoded in each worker.
CACHE = 1 << 19


#: The steps before the model that the cache of matches knows, as a tokenizer file states them.
KNOWN_STEPS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"},
    ]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "post_processor": None, "truncation": None, "padding": None,
}


def known_steps(path: str) -> bool:
    """Whether a tokenizer file has just these steps and a model that depends on its piece alone."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model = told.get("model") or {}
    return all(told.get(k) == v for k, v in KNOWN_STEPS.items()) and model.get("type") == "BPE" and not model.get("dropout")


#: In Latin-1 without control characters, normal form, lower-casing and white space are plain; there this
#: pattern finds the matches of those steps (contractions, letters, single digits, other runs).
_PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0xA1, 0x100)])
_MATCH = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
    "|[!-/:-@\\[-`{-~\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7]+"
)


def is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


class MatchEncoder:
    """The tokenizers library behind a cache of matches.

    The cache is used only for a file that states KNOWN_STEPS: they drop white space, so a text's ids are
    those of its matches in turn. In texts of Latin-1 each new match goes to the library's model once; other
    texts go through the whole library, cut at spaces and line feeds, in a batch. A text that holds one of
    the file's added tokens goes there uncut. Any other file, an added token that matches normalized text,
    or ``whole`` sends every whole text through the library as it is loaded. Ids are packed in little-endian
    integers of ``width`` bytes: two where the vocabulary allows, else four.
    """

    def __init__(self, path: str, whole: bool = False):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model, as_bytes = self.tokenizer.model, ByteLevel(add_prefix_space=False, use_regex=False)
        #: What the library writes for the bytes of each character beyond ASCII.
        self.bytes_of = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0xA1, 0x100)}
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile("|".join(re.escape(t.content) for t in added) or "(?!)")
        self.whole = whole or not known_steps(path) or any(t.normalized for t in added)
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def pack(self, ids: list[int]) -> bytes:
        packed = array("H" if self.width == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [self.pack(e.ids) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bytes:
        found = _MATCH.findall(text.lower())
        known = self.known
        try:
            return b"".join([known[m] for m in found])
        except KeyError:
            for m in set(found).difference(known):
                as_bytes = m if m.isascii() else m.translate(self.bytes_of)
                known[m] = self.pack([t.id for t in self.model.tokenize(as_bytes)])
            return b"".join([known[m] for m in found])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids; null has none."""
        if self.whole:
            return self._raw([t or "" for t in texts])
        if len(self.known) > CACHE:
            self.known.clear()
        if len(self.chunks) > CACHE:
            self.chunks = {"": b""}
        held = [i for i, t in enumerate(texts) if t and self.added.search(t)]
        uncut = dict(zip(held, self._raw([texts[i] for i in held]), strict=True))
        odd = {i: t.replace("\n", " ").split(" ") for i, t in enumerate(texts) if t and i not in uncut and not is_plain(t)}
        new = list(set(chain.from_iterable(odd.values())) - self.chunks.keys())
        self.chunks.update(zip(new, self._raw(new), strict=True))
        return [
            uncut[i] if i in uncut
            else b"".join([self.chunks[c] for c in odd[i]]) if i in odd else self._plain(t) if t else b""
            for i, t in enumerate(texts)
        ]


@lru_cache(maxsize=2)
def load_encoder(path: str) -> MatchEncoder:
    return MatchEncoder(path)


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
    share: int = RANGE,
) -> None:
    """Encode every whole text, append ``end_id`` and write ids in ascending order of doc_id at ``path``.

    Columns: range int, doc_id, local_start long (ids before it in its range), n_tokens long, ids
    array<int>. Null and empty texts have the end id alone; a text, however long, is one row. Null doc_ids
    come first; rows of one doc_id are ordered by their number of ids, then by a hash of them, and may lie
    in several ranges. An empty table gives an empty store. Other columns of ``docs`` are not stored. A range
    holds about ``share`` bytes of ids.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = materialize(texts.mapInArrow(_pack(tokenizer, end_id), "doc_id long, width int, raw binary"), "packed", **{"parquet.enable.dictionary": "false"})
    total = packed.agg(F.sum(F.octet_length("raw"))).head()[0] or 0
    keys = [F.asc_nulls_first("doc_id"), F.octet_length("raw").asc(), F.asc("tie"), F.asc("at")]
    # Bounds are drawn by Spark from a sample of bounded size; ``at`` parts repeated rows of one id.
    keyed = packed.withColumns({"tie": F.xxhash64("raw"), "at": F.monotonically_increasing_id()})
    dealt = keyed.repartitionByRange(max(1, -(-total // share)), *keys).sortWithinPartitions(*keys)
    (
        dealt.select("doc_id", "width", "raw")
        .mapInArrow(_unpack, "range int, doc_id long, local_start long, n_tokens long, ids array<int>")
        .write.option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.page.write-checksum.enabled", "true")
        .option("compression", "zstd")
        .parquet(path)
    )
    discard(packed)


def _pack(tokenizer: str, end_id: int):
    """Each row's packed ids and their width."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load_encoder(tokenizer)
        end = encoder.pack([end_id])
        for b in slices(batches, "text", 2 << 20):
            raw = [x + end for x in encoder.encode(b.column("text").to_pylist())]
            width = pa.array(np.full(len(raw), encoder.width, np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), width, pa.array(raw, pa.binary())], ["doc_id", "width", "raw"])

    return run


def _unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of ids with their start in the range, which is the task's partition of the ordered rows."""
    at, start = TaskContext.get().partitionId(), 0
    for whole in batches:
        for a in range(0, whole.num_rows, 512):
            b = whole.slice(a, 512)
            width, raw = (b.column(c).to_pylist() for c in ("width", "raw"))
            n = np.array([len(x) // w for x, w in zip(raw, width, strict=True)], np.int64)
            first = start + np.cumsum(n) - n
            start += int(n.sum())
            flat = [np.frombuffer(x, f"<u{w}").astype(np.int32) for x, w in zip(raw, width, strict=True)]
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), at, np.int32)), b.column("doc_id"), pa.array(first), pa.array(n), lists],
                ["range", "doc_id", "local_start", "n_tokens", "ids"],
            )


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids; columns not used aren't read."""
    rows = spark.read.schema(
        "range int, doc_id long, local_start long, n_tokens long, ids array<int>"
    ).parquet(path)
    totals = rows.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    # One row for each range of RANGE bytes: their running sum is a window over that short table.
    firsts = totals.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("first"))
    firsts = materialize(firsts, "ranges")
    return small_join(rows, firsts, firsts.count(), "range").select(
        "doc_id", (F.col("first") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def checksums(df: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``, over little-endian unsigned 32-bit integers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            flat, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            ends = ends - (ends[0] if len(ends) else 0)
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, written in order and read back: their places and checksums."""
    import public_tokenizers as P

    path = f"{shared_dir(spark)}/millrace/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, P.path("word_bpe_49k.json"))
    return checksums(read_tokens(spark, path))
