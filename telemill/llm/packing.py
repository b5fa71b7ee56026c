"""Best-fit packing of documents into training sequences under conflicts.

Documents are dealt to shards by hash; in a shard pieces are placed from the longest on. Bins are ordered by residual
(a bitmap of residuals with a list of bins each); the successor of a piece's length is the tightest bin, and the search
goes on to the next successor until the bin's source and duplicate-cluster bitmaps have no bit in common with the piece.
What comes out are the pieces with their part of the text, each with its place in its sequence; sequences() puts them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm import minhash
from telemill.llm.shared import ship, told_apart
from telemill.plans.storage import store

#: Words of a sequence, pieces of a shard on average.
CAPACITY, SHARD = 2048, 2000


class Bins:
    """Open bins in order of their residuals."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.at = capacity, 0, {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, length: int, source: int, cluster: int) -> int:
        """Number of the bin that takes a piece: the tightest without a conflict, or a new one. source, cluster: bitmaps."""
        rest = self.open >> length
        low = length
        while rest:
            step = (rest & -rest).bit_length() - 1
            low, rest = low + step, rest >> step
            held = self.at[low]
            for k, number in enumerate(held):
                if not (self.sources[number] & source or self.clusters[number] & cluster):
                    held.pop(k)
                    if not held:
                        self.open &= ~(1 << low)
                    self.sources[number] |= source
                    self.clusters[number] |= cluster
                    self._put(number, low - length)
                    return number
            low, rest = low + 1, rest >> 1
        self.sources.append(source)
        self.clusters.append(cluster)
        self._put(len(self.sources) - 1, self.capacity - length)
        return len(self.sources) - 1

    def _put(self, number: int, residual: int) -> None:
        if residual:
            self.at.setdefault(residual, []).append(number)
            self.open |= 1 << residual


def _pack(capacity: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "item", "piece"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        source, cluster = (pd.factorize(rows[c])[0] for c in ("source", "cluster"))
        bins = Bins(capacity)
        # a code of -1 is a null, which conflicts with nothing
        number = [bins.place(n, 1 << s if s >= 0 else 0, 1 << c if c >= 0 else 0) for n, s, c in zip(rows["length"].tolist(), source.tolist(), cluster.tolist(), strict=True)]
        rows["bin"] = rows["shard"].astype("int64") * (1 << 32) + pd.Series(number, dtype="int64")
        rows["place"] = rows.groupby("bin")["length"].cumsum() - rows["length"]
        return rows[["bin", "place", "item", "doc_id", "piece", "start", "length"]]

    return pack


def best_fit(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pack items (item: a number of its own, doc_id, length, source, cluster) into bins of ``capacity``.

    An item longer than the capacity is cut into pieces, all but the last of full size. No bin holds two pieces of one
    source or one cluster; null sources and clusters conflict with nothing. Returns a row per piece: bin, place (words
    before it in the bin), item, doc_id, piece (from 0), start (in the document) and length. Items of null or no length
    have no piece; an empty table gives an empty result. Packing is best fit within shards of about ``shard`` items by
    a hash of item and piece, whose number grows with the table; so bins depend on the size of the table, and at most one bin a source
    and shard is wasted.
    """
    ship(items.sparkSession)
    shards = max(1, -(-items.count() // shard))
    full = F.ceil(F.col("length") / capacity).cast("int")
    piece = items.filter(F.col("length") > 0).select("item", "doc_id", "length", "source", "cluster", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"))
    start = F.col("piece") * F.lit(capacity)
    piece = piece.select(
        F.pmod(F.xxhash64("item", "piece"), F.lit(shards)).cast("long").alias("shard"),
        F.col("item").cast("long"),
        F.col("doc_id").cast("long"),
        "piece",
        start.cast("long").alias("start"),
        F.least(F.lit(capacity), F.col("length") - start).cast("long").alias("length"),
        F.col("source").cast("string").alias("source"),
        F.col("cluster").cast("long").alias("cluster"),
    )
    return piece.groupBy("shard").applyInPandas(_pack(capacity), "bin long, place long, item long, doc_id long, piece int, start long, length long")


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def first_bytes(text: bytes) -> np.ndarray:
    """Where each word of a text begins."""
    space = _SPACE[np.frombuffer(text, np.uint8)]
    return np.flatnonzero(~space & np.concatenate([[True], space[:-1]])) if len(text) else np.zeros(0, np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text, pieces): a row for each piece with its part of the text, from its first word to the next piece's."""
    for batch in batches:
        out = {k: [] for k in ("bin", "place", "doc_id", "piece", "start", "length", "text")}
        for text, pieces in zip(batch.column(0), batch.column(1), strict=True):
            text = (text.as_py() or "").encode()
            at = np.append(first_bytes(text), len(text))
            for piece in pieces.as_py():
                for k, v in piece.items():
                    out[k].append(v)
                start, end = piece["start"], piece["start"] + piece["length"]
                out["text"].append(text[at[start] if start else 0 : at[end]].decode())
        yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in _PIECE], [n for n, _ in _PIECE])


_PIECE = [("bin", pa.int64()), ("place", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("text", pa.string())]


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents (doc_id, text, source) by words ``[^\\x20\\x09-\\x0D]+``; a class of near duplicates is a cluster.

    Returns a row per piece: those of best_fit() without item, and text, the part of the document from the piece's first
    word to the next piece's, white space and all: the pieces of a document in order are its text, byte for byte.
    A document without words has no piece.
    Classes are those of minhash.near_duplicates(), so texts that are equal but for the case of A-Z and for white space are a
    cluster too. Rows whose doc_id is null or repeated are told apart by numbers, compared and packed
    like others. The pieces of one document go to its text in one row.
    """
    rows = told_apart(docs, "doc_id", "text", F.col("source").cast("string")).withColumnRenamed("own_id", "doc_id")
    found = minhash.row_classes(rows.select("row", "doc_id", "text")).select("row", F.col("n_words").alias("length"), F.col("component").alias("cluster"))
    items = found.join(rows.select("row", "doc_id", "source"), "row").withColumnRenamed("row", "item")
    packed = store(best_fit(store(items, "items"), capacity), "packed")
    pieces = packed.groupBy("item").agg(F.collect_list(F.struct("bin", "place", "doc_id", "piece", "start", "length")).alias("pieces"))
    placed = rows.select(F.col("row").alias("item"), "text").join(pieces, "item").select("text", "pieces")
    return placed.mapInArrow(_cut, "bin long, place long, doc_id long, piece int, start long, length long, text string")


def sequences(pieces: DataFrame) -> DataFrame:
    """A row per bin of pieces (from pack_documents): bin, length, text (pieces joined by a space), and doc_ids of its pieces in order; a bin is at most ``capacity`` words."""
    held = pieces.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id", "text"))).alias("held"), F.sum("length").alias("length"))
    return held.select("bin", "length", F.array_join("held.text", " ").alias("text"), F.col("held.doc_id").alias("doc_ids"))
