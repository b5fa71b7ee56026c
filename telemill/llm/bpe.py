"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue has one bucket for each merge rank, holding the positions (nodes of a linked list of parts) of pairs that
merge at that rank. A two-level bitmap marks the buckets that are not empty, and find-first-set on its words gives the
lowest rank in constant time. Entries are never removed from the middle: a popped position whose pair has changed
since is stale and skipped. A sequence of n bytes thus takes O(n log n) steps, however long it is.

One queue serves many pre-tokens: those that a worker does not remember are laid end to end, up to LAID bytes or one
longer pre-token, and no pair crosses a border. Merges of different pre-tokens do not touch each other, so the order by
rank holds in each, and a bucket is popped as a whole, from left to right, as long as no lower rank turns up.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import ship

#: Bytes of pre-tokens and their ids that a Python worker remembers: so many of recent ones, and as many of older ones.
MEMO = 96 << 20
#: Bytes of a remembered pre-token besides its own and its ids, about; pre-tokens of more bytes are not remembered.
_EACH, _LONGEST = 200, 256
#: Bytes of pre-tokens that are merged together, and characters of texts that are encoded together; a longer one is alone.
LAID, TOGETHER = 1 << 17, 1 << 19
_LEAF = 8


def parse_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a base64 token and its rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merge(pieces: list[bytes], ranks: dict[bytes, int], pairs: np.ndarray) -> list[bytes]:
    """Ids of each pre-token as little-endian unsigned 32-bit integers: the pair of lowest rank merges first, the leftmost of equals.

    pairs: rank of each two bytes (first * 256 + second), -1 for none.
    """
    data, get = b"".join(pieces), ranks.get
    raw, n = np.frombuffer(data, np.uint8).astype(np.int64), len(data)
    last = np.cumsum([len(p) for p in pieces]) - 1  # of each pre-token
    first = np.full(n, -1, np.int64)
    first[:-1] = pairs[raw[:-1] * 256 + raw[1:]]
    first[last] = -1
    border = np.zeros(n + 1, np.uint8)
    border[last + 1] = border[0] = 1
    border = border.tobytes()
    rank_at = first.tolist()  # of the pair that starts at a part
    end = list(range(1, n + 1))  # part i is data[i:end[i]]; end[i] is also the next part
    before = list(range(-1, n))
    order = np.argsort(first, kind="stable")
    order = order[np.searchsorted(first[order], 0) :]
    at = np.flatnonzero(np.diff(first[order], prepend=-1))
    buckets = dict(zip(first[order[at]].tolist(), (x.tolist() for x in np.split(order, at[1:])), strict=True)) if len(at) else {}
    leaves: dict[int, int] = {}
    for rank in buckets:
        leaves[rank >> _LEAF] = leaves.get(rank >> _LEAF, 0) | 1 << (rank & 255)
    root = sum(1 << word for word in leaves)
    while root:
        word = (root & -root).bit_length() - 1
        leaf = leaves[word]
        rank = word << _LEAF | (leaf & -leaf).bit_length() - 1
        bucket = buckets.pop(rank)
        leaves[word] = leaf = leaf & (leaf - 1)
        if not leaf:
            root &= root - 1
        bucket.sort()
        for place, i in enumerate(bucket):
            if rank_at[i] != rank:
                continue  # stale
            j = end[i]
            k = end[j]
            end[i], rank_at[j] = k, -1
            if k < n:
                before[k] = i
            lower = False
            # the pairs that begin and end with the new part
            near = (i, before[i]) if not border[i] else (i,)
            for k in near:
                j = end[k]
                if border[j]:
                    rank_at[k] = -1
                    continue
                rank_at[k] = new = get(data[k : end[j]], -1)
                if new in buckets:
                    buckets[new].append(k)
                elif new >= 0:
                    buckets[new] = [k]
                    word = new >> _LEAF
                    leaves[word] = leaves.get(word, 0) | 1 << (new & 255)
                    root |= 1 << word
                    lower |= new < rank
            if lower and place + 1 < len(bucket):  # the rest waits
                buckets[rank] = bucket[place + 1 :]
                word = rank >> _LEAF
                leaves[word] |= 1 << (rank & 255)
                root |= 1 << word
                break
    ids, ends, i = [], [], 0
    while i < n:
        j = end[i]
        ids.append(ranks[data[i:j]])
        i = j
        if border[i]:
            ends.append(len(ids))
    out = np.array(ids, "<u4")
    return [out[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]


class Codec:
    """Encoder and decoder of one vocabulary and pattern; remembers the ids of pre-tokens by two generations of MEMO bytes."""

    def __init__(self, content: bytes, pattern: str):
        import regex

        self.ranks = parse_ranks(content)
        self.table = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.table[rank] = token
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] * 256 + token[1]] = rank
        self.find = regex.compile(pattern).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: those remembered before, a vocabulary's own tokens, and the rest through the queue."""
        found, open_, size = {}, [], 0
        for p in pieces:
            ids = self.old.get(p)
            if ids is None:
                raw = p.encode()
                if raw in self.ranks:
                    ids = self.ranks[raw].to_bytes(4, "little")
                else:
                    if size and size + len(raw) > LAID:
                        found |= self._merged(open_)
                        open_, size = [], 0
                    open_.append((p, raw))
                    size += len(raw)
                    continue
            found[p] = ids
        return found | self._merged(open_)

    def _merged(self, pieces: list[tuple[str, bytes]]) -> dict[str, bytes]:
        return dict(zip([p for p, _ in pieces], merge([raw for _, raw in pieces], self.ranks, self.pairs), strict=True)) if pieces else {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, texts of about TOGETHER characters at once."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= TOGETHER):
                size += len(texts[b])
                b += 1
            split = list(map(self.find, texts[a:b]))
            learnt = self._learn(set().union(*split).difference(self.new))
            for p, ids in learnt.items():
                if len(p) <= _LONGEST:
                    self.new[p] = ids
                    self.held += len(p) + len(ids) + _EACH
            long = {p: ids for p, ids in learnt.items() if len(p) > _LONGEST}
            get = (self.new | long if long else self.new).__getitem__
            for pieces in split:
                yield b"".join(map(get, pieces))
            if self.held > MEMO:
                self.old, self.new, self.held = self.new, {}, 0
            a = b

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(content: bytes, pattern: str) -> Codec:
    """The codec of a vocabulary file and a pattern, kept in the worker between tasks."""
    key = (hashlib.sha256(content).hexdigest(), pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(content, pattern)
    return _CODECS[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of docs and ``ids``, the tokens of ``text`` (array<int>).

    Each match of ``pattern`` is merged separately; no special tokens. Null and empty texts give no ids. The vocabulary
    (under 1 MB, read by the driver) is broadcast. Repeated rows and texts of any length are allowed; a text is in
    memory once, its ids four bytes each. A column of docs that is called ``ids`` is replaced.
    """
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    @F.pandas_udf("array<int>")
    def ids(texts):
        own = texts.fillna("")
        return pd.Series([np.frombuffer(x, "<i4") for x in codec(content.value, pattern).encode(own.tolist())], own.index, object)

    return docs.withColumn("ids", ids(F.col(text)))


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """All columns of tokens and ``bytes``, what the ids stand for (which need not be valid UTF-8); null ids give none."""
    ship(tokens.sparkSession)
    content = tokens.sparkSession.sparkContext.broadcast(_read(ranks_path))

    @F.pandas_udf("binary")
    def back(column):
        of = codec(content.value, pattern).decode
        return column.map(lambda x: b"" if x is None else of(np.asarray(x, "<u4").tobytes()))

    return tokens.withColumn("bytes", back(F.col(ids)))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode and decode every text of (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256.

    One pass without a shuffle; beside an Arrow batch of texts, pre-tokens of about TOGETHER characters and the ids and
    decoded bytes of one document at a time are in memory; neither is moved.
    Null and empty texts have no tokens. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(_read(ranks_path))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(content.value, pattern)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in own.encode([x or "" for x in batch.column(1).to_pylist()]):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
