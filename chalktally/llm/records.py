"""Token ids as length-delimited binary records, with an offset index beside.

A data folder holds shards in ascending order of document id. A shard is a row
of records, each of them

    8 bytes  length of the payload, little-endian
    4 bytes  masked CRC-32 of those 8 bytes
    payload  1 byte width of an id (2 or 4), 1 byte 1 if there is a document id,
             8 bytes document id, then the ids, little-endian
    4 bytes  masked CRC-32 of the payload
    1 byte   line feed

so that a reader can walk from record to record, or jump to one by its offset,
and knows if it is damaged. Spark's own writer commits the shards, on whatever
store the path names, and a task that is run again replaces what it had written.
"""

from __future__ import annotations

import codecs
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from chalktally.llm import shared
from chalktally.llm.words import SMALL_PIECE_BYTES, pieces, words

SHARD_CHARS = 20_000_000
#: Pieces of words whose ids a worker remembers before it forgets those that it
#: hasn't met for as many others, and the characters such a piece has at most.
REMEMBERED = 200_000
REMEMBERED_CHARS = 100
_HEAD = struct.Struct("<QI")
_START = struct.Struct("<BBq")
# Letters that normalization leaves alone but for their case, then signs: two
# pieces for this tokenizer. Anything else goes through it whole.
_LETTERS, _SIGNS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[!#$%&*+,./:;=?@|-]*"
_PLAIN = f"^(?P<letters>{_LETTERS})(?P<signs>{_SIGNS})$"
_PIECE = re.compile(f"{_LETTERS}|{_SIGNS}")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def _spelling() -> str:
    """The character that stands for a byte of a piece in the model's tokens, by
    byte. The line feed stays itself: no piece has it, so it parts them."""
    level = ByteLevel(add_prefix_space=False, use_regex=False)
    table = ["\ufffe"] * 256
    for letter in map(chr, range(256)):
        for byte, spelled in zip(letter.encode(), level.pre_tokenize_str(letter)[0][0], strict=True):
            table[byte] = spelled
    table[ord("\n")] = "\n"
    return "".join(table)


class Encoder:
    """Ids of texts. The tokenizer drops white space and never joins what is on
    both sides of it, so every distinct word is encoded once and looked up. Ids
    are kept as the bytes that a record has of them."""

    def __init__(self, path: str, end: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end], self.kind).tobytes()
        self.spelling = _spelling()
        # Pieces met since the last time that as many were, and those met before.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encoded(self, new: list[str]) -> list[bytes]:
        plain = [_PIECE.fullmatch(p) is not None for p in new]
        joined = "\n".join(compress(new, plain)).encode()
        spelled = iter(codecs.charmap_decode(joined, "strict", self.spelling)[0].split("\n"))
        every, ends = [], []
        for piece, is_plain in zip(new, plain, strict=True):
            if is_plain:
                every += [t.id for t in self.model.tokenize(next(spelled))]
            else:
                every += self.tokenizer.encode(piece, add_special_tokens=False).ids
            ends.append(len(every) * self.width)
        ids = np.array(every, self.kind).tobytes()
        return [ids[a:b] for a, b in pairwise([0, *ends])]

    def _looked_up(self, distinct: list[str]) -> list[bytes]:
        found = list(map(self.known.get, distinct))
        met = [i for i, ids in enumerate(found) if ids is None]
        for i in met:
            found[i] = self.older.get(distinct[i])
        new = [i for i in met if found[i] is None]
        for i, ids in zip(new, self._encoded([distinct[i] for i in new]), strict=True):
            found[i] = ids
        kept = {
            distinct[i]: found[i] for i in met[:REMEMBERED] if len(distinct[i]) <= REMEMBERED_CHARS
        }
        if len(self.known) + len(kept) > REMEMBERED:
            self.known, self.older = {}, self.known
        self.known |= kept
        return found

    def _each(self, parts: pa.StringArray) -> pa.LargeBinaryArray:
        """The ids of each part of a word."""
        coded = parts.dictionary_encode()
        ids = self._looked_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        return pa.array(ids, pa.large_binary()).take(coded.indices)

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text, the end id last."""
        codes, starts, dictionary = words(texts)
        parts = pc.extract_regex(dictionary, _PLAIN)
        letters = pc.utf8_lower(pc.struct_field(parts, "letters"))
        each = pc.binary_join_element_wise(
            self._each(pc.coalesce(letters, dictionary)),
            self._each(pc.coalesce(pc.struct_field(parts, "signs"), "")),
            pa.scalar(b"", pa.large_binary()),
        )
        each = pa.concat_arrays([each, pa.array([self.end], pa.large_binary())])
        taken = each.take(pa.array(np.insert(codes, starts[1:], len(dictionary))))
        _, offsets, data = taken.buffers()
        bounds = np.frombuffer(offsets, np.int64)[starts + np.arange(len(starts))] // self.width
        ids = np.frombuffer(data, self.kind, bounds[-1])
        return [ids[a:b] for a, b in pairwise(bounds.tolist())]


def frame(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    ids = ids.astype(f"<u{width}", copy=False)
    payload = _START.pack(width, doc_id is not None, doc_id or 0) + ids.tobytes()
    length = len(payload).to_bytes(8, "little")
    return b"".join(
        (
            length,
            masked_crc(length).to_bytes(4, "little"),
            payload,
            masked_crc(payload).to_bytes(4, "little"),
            b"\n",
        )
    )


def record_at(data: memoryview, offset: int) -> tuple[int | None, np.ndarray, int]:
    """(document id, ids as uint32, offset of the next record)."""
    length, check = _HEAD.unpack_from(data, offset)
    if masked_crc(data[offset : offset + 8]) != check:
        raise ValueError(f"damaged length at {offset}")
    start = offset + _HEAD.size
    payload = data[start : start + length]
    if masked_crc(payload) != int.from_bytes(data[start + length : start + length + 4], "little"):
        raise ValueError(f"damaged record at {offset}")
    width, has_id, doc_id = _START.unpack_from(payload)
    ids = np.frombuffer(payload, f"<u{width}", offset=_START.size).astype("<u4")
    return doc_id if has_id else None, ids, start + length + 5


def _frames(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, end)
        for batch in pieces(batches, size=SMALL_PIECE_BYTES):
            made = [
                # The line feed is the one that the writer puts after a row.
                frame(i, ids, encoder.width)[:-1]
                for i, ids in zip(
                    batch["doc_id"].to_pylist(), encoder.texts(batch["text"]), strict=True
                )
            ]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["frame"])

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end: int) -> None:
    """Encode (doc_id, text) and write the shards and then their index.

    Rows are dealt out by ranges of doc_id, as many as the text is long, so a
    shard has a bounded size unless a single document is larger. Rows with the
    same id follow one another in the order of their text; a row without id comes
    first. A null text is empty: its record has the end id alone.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    (
        rows.repartitionByRange(1 + chars // SHARD_CHARS, "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_frames(tokenizer, end), "frame binary")
        .select(F.col("frame").cast("string"))
        .write.option("lineSep", "\n")
        .text(f"{folder}/data")
    )
    _scan(docs.sparkSession, folder).write.parquet(f"{folder}/index")


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(f"{folder}/data")
        .select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("shard"), "content")
    )


_INDEX = "shard int, offset long, doc_id long, n_tokens long, before long, ids_crc32 long"


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, read from the shards: where it is, how many ids the
    shard has before it, and the checksum of its ids as 32-bit integers."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch["shard"].to_pylist(), batch["content"], strict=True):
                data, offset, before, rows = memoryview(content.as_buffer()), 0, 0, []
                while offset < len(data):
                    doc_id, ids, following = record_at(data, offset)
                    rows.append((shard, offset, doc_id, len(ids), before, zlib.crc32(ids.tobytes())))
                    before, offset = before + len(ids), following
                yield _batch(rows, _INDEX)

    return _shards(spark, folder).mapInArrow(walk, _INDEX)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)],
        [n for n, _ in fields],
    )


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index with ``start``: the ids of all records before this one. What
    whole shards add is a sum over a table with a row per shard."""
    index = spark.read.parquet(f"{folder}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return index.join(bases, "shard").withColumn("start", F.col("_base") + F.col("before")).drop(
        "_base", "before"
    )


def read_at(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """(shard, offset, doc_id, ids) of the records that ``wanted`` (shard, offset)
    names, such as a shuffled part of the index, by jumping to their offsets."""
    schema = "shard int, offset long, doc_id long, ids array<long>"

    def jump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content, offsets in zip(
                batch["shard"].to_pylist(), batch["content"], batch["offsets"].to_pylist(), strict=True
            ):
                data = memoryview(content.as_buffer())
                found = [(o, *record_at(data, o)) for o in offsets]
                yield _batch([(shard, o, i, ids.tolist()) for o, i, ids, _ in found], schema)

    per_shard = wanted.groupBy("shard").agg(F.collect_list("offset").alias("offsets"))
    return _shards(spark, folder).join(per_shard, "shard").mapInArrow(jump, schema)


def encoded(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write the documents to a new folder in the shared one and read back, per
    record: doc_id, start, n_tokens, ids_crc32, shard, offset. An empty table
    gives an empty result."""
    spark = docs.sparkSession
    folder = shared.new_folder(spark, "records")
    write_records(docs, folder, tokenizer, end)
    return read_index(spark, folder).select(
        "doc_id", "start", "n_tokens", "ids_crc32", "shard", "offset"
    )
