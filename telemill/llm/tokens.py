"""Token ids of a corpus in binary files: records of Simple-8b words, in ascending order of doc_id.

A file is a row of records parted by eight bytes 0xFF, which coded words cannot hold, so Spark's readers split files at
any record and any program can map them. A record holds whole documents, SEGMENT ids or one longer document:

    magic, ids of the file before it, ids, documents, of these without an id (they come first), words of the doc_ids,
    words of the lengths; then the doc_ids (differences, zigzag), the lengths, the word offset of each block of BLOCK
    ids, and the words of the ids

each as a little-endian unsigned 64-bit integer. A folder has the files below ``data`` and a table ``index`` of the
number of ids before each file, so a document's place among all ids is known without reading what lies before it.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemill.llm.shared import BROADCAST_IDS, ship
from telemill.llm.simple8b import pack, unpack
from telemill.plans.storage import scratch_path

#: Ids in a record and in a block; text bytes of a file.
SEGMENT, BLOCK, FILE_BYTES = 1 << 18, 1 << 10, 256 << 20
#: Bytes of words and their ids that a Python worker remembers: so many of recent ones, and as many of older ones.
MEMO = 80 << 20
#: Bytes of a remembered word besides its own and its ids, about; longer words are not remembered.
_EACH, _LONGEST = 130, 256
#: Words that the tokenizer gets in one string.
_TOGETHER = 50
_MAGIC = int.from_bytes(b"S8B1", "little")
_HEADER = 7
_SEPARATOR = "ÿ" * 8


class Encoder:
    """A tokenizer of the tokenizers library that gets each different word ``[^\\x20\\x09-\\x0D]+`` once, and remembers their ids.

    For tokenizers whose tokens neither reach over white space nor depend on it, as those of pre-tokenizers that drop it.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _tokenized(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each word: words are joined by spaces, and a token belongs to the word that it starts in."""
        groups = [words[k : k + _TOGETHER] for k in range(0, len(words), _TOGETHER)]
        for group, found in zip(groups, self.tokenizer.encode_batch(list(map(" ".join, groups)), add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.type)
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(ids))
            size = np.fromiter(map(len, group), np.int64, len(group)) + 1
            cut = (np.searchsorted(starts, np.cumsum(size) - size) * self.type.itemsize).tolist()
            raw = ids.tobytes()
            yield from map(raw.__getitem__, map(slice, cut, [*cut[1:], len(raw)]))

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of different words, as unsigned integers of self.type."""
        if self.held > MEMO:
            self.old, self.new, self.held = self.new, {}, 0
        found = list(map(self.new.get, words))
        missing = [k for k, ids in enumerate(found) if ids is None]
        for k in missing:
            found[k] = self.old.get(words[k])
        unknown = [k for k in missing if found[k] is None]
        for k, ids in zip(unknown, self._tokenized([words[k] for k in unknown]), strict=True):
            found[k] = ids
        for k in missing:
            word, ids = words[k], found[k]
            if len(word) <= _LONGEST:
                self.new[word] = ids
                self.held += len(word) + len(ids) + _EACH
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each begins; one more than texts)."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        found = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        raw = np.frombuffer(b"".join(found), self.type)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        word = coded.indices.to_numpy()
        end, last = np.cumsum(size), np.cumsum(size[word])
        # a word's ids lie as far from their place as its first one does
        shift = (end - size)[word] - (last - size[word])
        ids = raw[np.repeat(shift, size[word]) + np.arange(last[-1] if len(last) else 0)]
        return ids, np.concatenate([[0], last])[split.offsets.to_numpy() - split.offsets[0].as_py()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(content: str) -> Encoder:
    """The encoder of a tokenizer file, kept in the worker between tasks."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def to_record(start: int, doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """A record of whole documents; those without an id come first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    step = np.diff(known, prepend=0)
    ids_of, _ = pack(((step << 1) ^ (step >> 63)).view(np.uint64), len(known) or 1)
    sizes, _ = pack(np.array(lengths, np.uint64), len(lengths) or 1)
    words, offsets = pack(ids, BLOCK)
    head = np.array([_MAGIC, start, len(ids), len(doc_ids), len(doc_ids) - len(known), len(ids_of), len(sizes)], np.uint64)
    return np.concatenate([head, ids_of, sizes, offsets.astype(np.uint64), words]).astype("<u8").tobytes()


def from_record(record: bytes) -> tuple[int, list[int | None], np.ndarray, np.ndarray]:
    """(ids of the file before it, doc_ids, lengths, ids) of a record."""
    words = np.frombuffer(record, "<u8").astype(np.uint64)
    magic, start, n, docs, unknown, a, b = words[:_HEADER].astype(np.int64).tolist()
    if magic != _MAGIC:
        raise ValueError("not a record of token ids")
    known = docs - unknown
    zero = np.zeros(1, np.int64)
    step = unpack(words[_HEADER : _HEADER + a], zero, known, known or 1).view(np.int64)
    step = (step >> 1 & 0x7FFFFFFFFFFFFFFF) ^ -(step & 1)
    lengths = unpack(words[_HEADER + a : _HEADER + a + b], zero, docs, docs or 1).astype(np.int64)
    rest, blocks = words[_HEADER + a + b :], -(-n // BLOCK)
    return start, [None] * unknown + np.cumsum(step).tolist(), lengths, unpack(rest[blocks:], rest[:blocks].astype(np.int64), n, BLOCK)


def _record_batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Encode every text of (doc_id, text) without special tokens and write the ids below ``path``.

    Null and empty texts have no ids but ``end``, which is appended to each document if given. Rows without a doc_id come
    first, rows that share one are ordered by a hash of their text; they lie in as many files as others do. A text whose
    characters look like a special token counts as the library counts it. The tokenizer file is read by the driver and
    broadcast (a few MB). Rows are dealt in ranges of doc_id, about ``file_bytes`` of text a file, and sorted in
    their task by Spark; a task holds the texts of an Arrow batch and one record at a time.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(-(-size // file_bytes), min(-(-size // (1 << 20)), spark.sparkContext.defaultParallelism), 1)
    last = np.array([] if end is None else [end], np.uint64)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, start = encoder(content.value), 0
        doc_ids, lengths, ids, held = [], [], [], 0

        def record():
            nonlocal start
            out = to_record(start, doc_ids, lengths, np.concatenate(ids))
            start += held
            return _record_batch(record=pa.array([out], pa.binary()))

        for batch in batches:
            every, at = own.encode(batch.column(1))
            for doc_id, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                found = np.concatenate([every[a:b].astype(np.uint64), last])
                if held and held + len(found) > SEGMENT:
                    yield record()
                    doc_ids, lengths, ids, held = [], [], [], 0
                doc_ids.append(doc_id)
                lengths.append(len(found))
                ids.append(found)
                held += len(found)
        if doc_ids:
            yield record()

    order = ["doc_id", "tie", "row"]
    dealt = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(files, *order).sortWithinPartitions(*order)
    coded = dealt.select("doc_id", "text").mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    coded.write.option("lineSep", _SEPARATOR).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", 0).text(f"{path}/data")
    _write_index(spark, path)


def _records(spark: SparkSession, path: str, *columns: Column) -> DataFrame:
    """``file`` (number) and columns of the records' bytes ``value``."""
    raw = spark.read.option("lineSep", _SEPARATOR).option("encoding", "ISO-8859-1").text(f"{path}/data")
    file = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long").alias("file")
    return raw.select(file, F.col("value").cast("binary").alias("value")).select("file", *columns)


def _write_index(spark: SparkSession, path: str) -> None:
    """The table of (file, ids, before): one row a file, from the headers of its records."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8").reshape(-1, 3)
            yield _record_batch(file=batch.column(0), ids=pa.array(head[:, 2].astype(np.int64)))

    heads = _records(spark, path, F.substring("value", 1, 24).alias("head")).mapInArrow(sizes, "file long, ids long")
    total = heads.groupBy("file").agg(F.sum("ids").alias("ids"))
    # a window over one row a file
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total.withColumn("before", before).coalesce(1).write.parquet(f"{path}/index")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a folder that write_tokens() wrote: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit integers).

    A task decodes one record at a time, all its blocks at once.
    """
    ship(spark)
    index = spark.read.schema("file long, ids long, before long").parquet(f"{path}/index")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, record in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start, doc_ids, lengths, ids = from_record(record.as_buffer())
                end = np.cumsum(lengths)
                raw = ids.astype("<u4").tobytes()
                cut = [raw[4 * a : 4 * b] for a, b in zip((end - lengths).tolist(), end.tolist(), strict=True)]
                yield _record_batch(file=pa.array([file] * len(cut), pa.int64()), doc_id=pa.array(doc_ids, pa.int64()), start=pa.array(start + end - lengths), n_tokens=pa.array(lengths), ids=pa.array(cut, pa.binary()))

    rows = _records(spark, path, F.col("value")).mapInArrow(documents, "file long, doc_id long, start long, n_tokens long, ids binary")
    index = F.broadcast(index) if index.count() <= BROADCAST_IDS else index
    return rows.join(index.select("file", "before"), "file").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_files(docs: DataFrame, tokenizer_path: str, end: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the ids of (doc_id, text) in the shared folder and read them back: see write_tokens() and read_tokens(). An empty table gives an empty result."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, end, file_bytes)
    return read_tokens(docs.sparkSession, path)
