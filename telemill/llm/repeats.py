"""Removal of word passages that repeat anywhere in a corpus, by repeated-phrase automata.

1. Each window of WINDOW words is anchored at the smallest hash of its PHRASE-word phrases, so equal windows have equal
   anchors, and one phrase in about fourteen is an anchor. Anchors are counted over distinct documents; a document of
   which there is an exact copy repeats as a whole and is only kept as evidence for others.
2. Every document with a recurring anchor gives the stretch of words around it; no other words can be in a repeated
   window. Windows are counted by anchor and hash, 128 bits together (partial counts first). One occurrence of each
   window that is there twice or more gives its words: the confirmed passages.
3. Passages and stretches meet in shards by anchor; an anchor with many occurrences is dealt over several shards, and
   its passages go to each of them. A shard compiles the windows of its passages into one Aho-Corasick automaton over
   words and streams all its stretches through it. What the automaton matches, word by word, is removed; neither hashes
   nor places of windows are known there, but for those of the one occurrence that the words were taken from.

Every step is linear in the words of the corpus and no step gathers the occurrences of one passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import blocks, mix, only_ids, runs, ship, strings, told_apart, words
from telemill.plans.storage import scope, store

WINDOW = 35
PHRASE = 8
#: Stretches of one anchor that go to one shard, and stretches in a shard.
HOT, SHARD = 500, 4_000

_EMPTY = hashlib.sha256(b"").hexdigest()


def anchors(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all windows of documents whose first words are ``at``: (hash, document, first and last window start), in order."""
    p = runs(h, PHRASE)
    width = WINDOW - PHRASE + 1
    n = len(h) - WINDOW + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    arg, span = np.arange(len(p)), 1
    while span < width:  # the leftmost smallest of ``span`` phrases, then of twice as many
        step = min(span, width - span)
        left, right = arg[:-step], arg[step:]
        arg, span = np.where(p[left] <= p[right], left, right), span + step
    doc = np.searchsorted(at, np.arange(n), "right") - 1
    start = np.flatnonzero(np.arange(n) + WINDOW <= at[doc + 1])
    arg, doc = arg[start], doc[start]
    new = np.ones(len(start), bool)
    new[1:] = (arg[1:] != arg[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(start)]]) - 1 if len(first) else first
    return p[arg[first]], doc[first], start[first], start[last]


def _offsets_array(values: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32()), pa.array(values.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for i, j in blocks(offsets):
            part, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            _, _, h, at = words(part, own, lower=False)
            place = mix(np.arange(1, len(h) + 1, dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64))  # from 1: mix(0) is 0
            digest = []
            for salt in (0x1F3D, 0x77A9):
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)) * place, dtype=np.uint64)])
                digest.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            hashed, doc, _, _ = anchors(h, at)
            raw = part.tobytes()
            shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(own[:-1], own[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(np.diff(at)), *map(pa.array, digest), pa.array(shas), _offsets_array(hashed, doc, j - i)], ["doc_id", "n_words", "d1", "d2", "sha", "anchors"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, anchors: recurring ones, counts): the words of the windows of each such anchor, and hashes of these windows."""
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for i, j in blocks(offsets):
            part = data[offsets[i] : offsets[j]]
            word, after, h, at = words(part, offsets[i : j + 1] - offsets[i], lower=False)
            hashed, doc, lo, hi = anchors(h, at)
            window, raw = runs(h, WINDOW).view(np.int64), part.tobytes()
            begin = np.searchsorted(doc, np.arange(j - i + 1))
            pick, count = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for k in range(j - i):
                known, times = (batch.column(c)[i + k].values.to_numpy(zero_copy_only=False) for c in (2, 3))
                order = np.argsort(known)
                own = hashed[begin[k] : begin[k + 1]].view(np.int64)
                at_known = np.minimum(np.searchsorted(known[order], own), len(known) - 1)
                found = np.flatnonzero(known[order][at_known] == own)
                pick.append(begin[k] + found)
                count.append(times[order][at_known[found]])
            pick, count = np.concatenate(pick), np.concatenate(count)
            whose, lo, hi = doc[pick], lo[pick], hi[pick]
            texts = [raw[a:b] for a, b in zip(word[lo].tolist(), after[hi + WINDOW - 1].tolist(), strict=True)]
            bounds = pa.array(np.concatenate([[0], np.cumsum(hi - lo + 1)]), pa.int32())
            every = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo + 1)[:-1]]), hi - lo + 1) + np.arange(int((hi - lo + 1).sum())) if len(lo) else lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed[pick].view(np.int64)), pa.array(count, pa.int64()), batch.column(0)[i:j].take(pa.array(whose)), pa.array(lo - at[whose]), pa.array(texts, pa.binary()), pa.ListArray.from_arrays(bounds, pa.array(window[every]))],
                ["anchor", "m", "doc_id", "start", "words", "windows"],
            )


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (anchor, m, words, at: numbers of windows): the words of each run of these windows."""
    for batch in batches:
        anchor, m, out = [], [], []
        for k, (text, at) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
            own, at = text.as_py().split(), np.unique(at.values.to_numpy())
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                anchor.append(k)
                m.append(k)
                out.append(b" ".join(own[run[0] : run[-1] + WINDOW]))
        take = pa.array(anchor, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out, pa.binary())], ["anchor", "m", "passage"])


def _locate(stretches: pa.Table, passages: pa.Table) -> pa.Table:
    """Spans (doc_id, start, end) of stretches that the automaton of the passages' windows matches."""
    import ahocorasick

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    if not stretches.num_rows or not passages.num_rows:
        return schema.empty_table()
    number: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
    for passage in set(passages.column("passage").to_pylist()):
        own = tuple([number.setdefault(w, len(number) + 1) for w in passage.split()])
        for a in range(len(own) - WINDOW + 1):
            automaton.add_word(own[a : a + WINDOW])
    automaton.make_automaton()
    rows, starts, ends = [], [], []
    get = number.get
    for k, text in enumerate(stretches.column("words")):
        low = high = -1
        for end, _ in automaton.iter(tuple([get(w, 0) for w in text.as_py().split()])):
            if end - WINDOW + 1 > high:  # a new span; matches of one length come from left to right
                if high > 0:
                    rows.append(k), starts.append(low), ends.append(high)
                low = end - WINDOW + 1
            high = end + 1
        if high > 0:
            rows.append(k), starts.append(low), ends.append(high)
    rows = np.array(rows, np.int64)
    docs, offset = (stretches.column(c).to_numpy()[rows] for c in ("doc_id", "start"))
    return pa.table({"doc_id": docs, "start": offset + np.array(starts, np.int64), "end": offset + np.array(ends, np.int64)}, schema)


def covered(spans: list[dict], n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    step = np.zeros(n + 1, np.int32)
    for s in spans:
        step[s["start"]] += 1
        step[s["end"]] -= 1
    return np.cumsum(step[:n]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone, kept = [], []
        for text, spans in zip(batch.column(1), batch.column(2), strict=True):
            tokens = (text.as_py() or "").encode().split()
            cut = covered(spans.as_py(), len(tokens))
            gone.append(int(cut.sum()))
            kept.append(b" ".join([w for w, c in zip(tokens, cut.tolist(), strict=True) if not c]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_removed", "kept"])


def repeated_spans(docs: DataFrame, sketch: DataFrame, copied: DataFrame) -> DataFrame:
    """(doc_id, spans) of documents, not counting those with copies, that have a span to remove; a span is (start, end) in words."""
    with scope(docs.sparkSession) as keep:
        with scope(docs.sparkSession) as outlives:
            reps = copied.select(F.col("rep").alias("doc_id"))
            rows = sketch.select("doc_id", "anchors").join(reps, "doc_id", "left_semi").select("doc_id", F.explode("anchors").alias("anchor"))
            rows = store(rows.groupBy("doc_id", "anchor").agg(F.count("*").alias("own")), "anchors")  # once for each document that has it
            # a table, so that the join is of two plain scans and a very common anchor can be split
            recurring = store(rows.groupBy("anchor").agg(F.sum("own").alias("m")).filter("m > 1"), "recurring")
            marks = rows.join(recurring, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("m").alias("counts"))
            marks = outlives(store(marks, "marks"))
        ids = marks.select("doc_id")
        texts = only_ids(docs.select("doc_id", "text"), "doc_id", ids, ids.count())
        stretches = texts.join(marks, "doc_id").select("doc_id", "text", "anchors", "counts").mapInArrow(_stretches, "anchor long, m long, doc_id long, start long, words binary, windows array<long>")
        stretches = store(stretches.withColumn("key", F.monotonically_increasing_id()), "stretches")
        # a stretch has at most WINDOW - PHRASE + 1 windows, so a window is named by 32 * key + its number
        counted = stretches.select("anchor", "key", F.posexplode("windows").alias("at", "window"))
        counted = counted.groupBy("anchor", "window").agg(F.count("*").alias("times"), F.min(F.col("key") * 32 + F.col("at")).alias("one")).filter("times > 1")
        ones = counted.groupBy(F.shiftright("one", 5).alias("key")).agg(F.collect_list((F.col("one") % 32).cast("int")).alias("at"))
        chosen = stretches.select("anchor", "m", "key", "words").join(ones, "key")
        passages = store(chosen.select("anchor", "m", "words", "at").mapInArrow(_passages, "anchor long, m long, passage binary"), "passages")
        shards = max(1, -(-stretches.count() // SHARD))
        salts = F.ceil(F.col("m") / F.lit(HOT)).cast("int")
        shard = F.pmod(F.xxhash64("anchor", "salt"), F.lit(shards)).alias("shard")
        left = stretches.withColumn("salt", F.pmod(F.xxhash64("key"), salts).cast("int")).select("doc_id", "start", "words", shard)
        right = passages.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("passage", shard)
        found = left.groupBy("shard").cogroup(right.groupBy("shard")).applyInArrow(_locate, "doc_id long, start long, end long")
        return keep(store(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans"))


def _sketched(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    ship(docs.sparkSession)
    sketch = docs.mapInArrow(_sketch, "doc_id long, n_words long, d1 long, d2 long, sha string, anchors array<long>")
    sketch = store(sketch, "words")
    classes = sketch.filter(F.col("n_words") >= WINDOW).groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    return sketch, store(classes, "classes")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """Words of every document that no repeated window covers.

    docs has (doc_id, text); other columns are ignored. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. A word goes when
    a window of 35 words over it occurs anywhere else, in the same document too, as the input stands. Returns one row
    per document: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), kept (those words;
    null where nothing was removed). Null, empty and shorter texts lose nothing; rows with equal texts lose all of
    them; an empty table gives an empty result. Rows that share a doc_id or have none are told apart by numbers and
    treated like others.
    """
    rows = told_apart(docs, "doc_id", "text")
    docs = rows.select(F.col("row").alias("doc_id"), "text")
    sketch, classes = _sketched(docs)
    spans = repeated_spans(docs, sketch, classes)
    ids = spans.select("doc_id")
    texts = only_ids(docs, "doc_id", ids, ids.count())
    cut = texts.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_removed long, kept string")
    copies = classes.filter("copies > 1").select("d1", "d2", "n_words", F.lit(True).alias("copied"))
    out = sketch.select("doc_id", "n_words", "d1", "d2", "sha").join(copies, ["d1", "d2", "n_words"], "left").join(cut, "doc_id", "left")
    own = F.col("doc_id")
    if hasattr(rows, "stored_at"):  # numbered
        out, own = out.join(rows.select(F.col("row").alias("doc_id"), "own_id"), "doc_id"), F.col("own_id")
    whole = F.col("copied").isNotNull()
    return out.select(
        own.alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_EMPTY)).when(F.col("kept").isNotNull(), F.sha2(F.col("kept").cast("binary"), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )
