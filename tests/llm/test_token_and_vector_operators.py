"""Token files, centroids and fill-in-the-middle against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from conftest import SF
from llm.conftest import ODD

# --- Simple-8b and op11 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [1, 7, 128, 1024, 100_000])
def test_words_give_values_back(block):
    from telemill.llm.simple8b import ESCAPED_FROM, pack, unpack

    rng = np.random.default_rng(block)
    for n in (0, 1, 2, 119, 120, 121, 1024, 1025, 5000):
        for values in (
            rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 16, n).astype(np.uint64), np.zeros(n, np.uint64), (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) - np.uint64(1),
            np.where(rng.random(n) < 0.01, np.uint64((1 << 64) - 1), np.uint64(1)), np.full(n, ESCAPED_FROM, np.uint64), np.full(n, ESCAPED_FROM - 1, np.uint64),
        ):
            words, offsets = pack(values, block)
            assert (unpack(words, offsets, n, block) == values).all()
            assert not len(words) or ((words >> np.uint64(56)) != 255).all()  # so no eight bytes 0xFF in a row
            for b in range(len(offsets)):  # any block alone
                own = words[offsets[b] : offsets[b + 1] if b + 1 < len(offsets) else None]
                assert (unpack(own, np.zeros(1, np.int64), len(values[b * block : (b + 1) * block]), block) == values[b * block : (b + 1) * block]).all()


def test_a_word_takes_as_many_values_as_fit():
    from telemill.llm.simple8b import BITS, COUNTS, pack

    for bits, count in zip(BITS, COUNTS, strict=True):
        values = np.full(3 * count, (1 << bits) - 1 if bits < 60 else 1 << 59, np.uint64)
        words, _ = pack(values, 1024)
        assert len(words) == 3 and (words >> np.uint64(60) == BITS.index(bits) + 1).all()
    assert len(pack(np.full(5, (1 << 64) - 1, np.uint64), 1024)[0]) == 10


def test_records_give_documents_back():
    from telemill.llm.tokens import from_record, to_record

    ids = np.arange(3000, dtype=np.uint64)
    for doc_ids in ([None, None, -(1 << 63), -5, 0, (1 << 63) - 1], [7], [None], [3, 3, 3]):
        lengths = [0] * (len(doc_ids) - 1) + [3000]
        start, got, sizes, back = from_record(to_record(12345, doc_ids, lengths, ids))
        assert (start, got, sizes.tolist()) == (12345, doc_ids, lengths) and (back == ids).all()


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


STRANGE = [
    "it's John's we'll x", "Σίσυφος ΟΔΥΣΣΕΥΣ İstanbul ǅ", "é ́alone a≠b", "각 한글 日本語 テスト", "<|endoftext|> a<|startoftext|>b", "\x1c\x1d\x85 \x00\x01", "don''t '' 's 'S x'Ll",
    "a" * 3000 + " " + "é" * 500, "\U0001f600\U0001f469‍\U0001f52c!!!???", " \t\r\n\v\f lead and trail \n",
]


def test_encoder_is_the_library(library, monkeypatch):
    from telemill.llm import tokens

    path, tokenizer = library
    rng = random.Random(3)
    alphabet = "abcXYZ019 '.,-\n\t éÉßΣς́̈한글日本  😀"
    texts = [x or "" for x in ODD] + STRANGE + ["".join(rng.choices(alphabet, k=rng.randrange(200))) for _ in range(400)]
    import pyarrow as pa

    monkeypatch.setattr(tokens, "MEMO", 2000)  # words are forgotten and learnt again
    with open(path, encoding="utf-8") as f:
        own = tokens.Encoder(f.read())
    true = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for some in (1, 7, len(texts)):
        for k in range(0, len(texts), some):
            ids, at = own.encode(pa.array(["dropped", *texts[k : k + some]])[1:])
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == true[k : k + some]


def expected_files(rows, tokenizer, end):
    """rows (doc_id, text) in file order: start, number, crc."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, *end], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_files_of_the_table(spark, library):
    from telemill.llm.queries import op11_tokens

    path, tokenizer = library
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in op11_tokens(spark, SF).collect())
    assert got == expected_files(sorted((r.doc_id, r.text) for r in docs), tokenizer, [2])


def test_token_files_of_odd_rows(spark, documents, library, monkeypatch):
    from pyspark.sql import functions as F

    from telemill.llm import tokens
    from telemill.llm.tokens import token_files

    path, tokenizer = library
    docs = documents([*ODD, *STRANGE])
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 5 == 1, None).when(F.col("doc_id") % 5 == 2, 77).otherwise(-F.col("doc_id"))).repartition(3)
    hashed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary"))).collect()
    rows = [(r.doc_id, r.text) for r in sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h))]
    key = lambda r: (r[0] is not None, *r[1:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # files are read in parts
    try:
        for end in ([2], []):
            found = token_files(docs, path, end=end[0] if end else None, file_bytes=30_000).select("doc_id", "start", "n_tokens", F.crc32("ids"))
            assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(expected_files(rows, tokenizer, end), key=key)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert token_files(documents([]), path, end=2).count() == 0
    assert tokens.SEGMENT > 0


# --- op12 ------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, k, rounds, seed, components, scale):
    """rows (vec_id, vector): (vec_id, cluster, distance, cluster_inertia, inertia, digest) of exact k-means in Python integers."""
    from fractions import Fraction

    kept = [(v, [math.floor(Fraction(x) * scale) for x in e]) for v, e in rows if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [e for _, e in order[:k]]
    near = lambda e: min((sum((a - b) ** 2 for a, b in zip(e, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(e)[1] for _, e in kept]
        for j in set(of):
            own = [e for (_, e), c in zip(kept, of, strict=True) if c == j]
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [(v, *near(e)[::-1]) for v, e in kept]
    fit = lambda x: x if x < 1 << 63 else None
    inertia = {j: sum(d for _, c, d in found if c == j) for _, j, _ in found}
    known = lambda ds: fit(sum(ds)) if all(d < 1 << 63 for d in ds) else None
    each = {j: known([d for _, c, d in found if c == j]) for j in inertia}
    total = known([d for _, _, d in found]) if found else None
    return [(v, c, fit(d), each[c], total, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for v, c, d in found]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, cluster string, distance string"


def test_centroids_of_the_table(spark):
    from telemill.llm.queries import op12_centroids

    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert ordered(op12_centroids(spark, SF).collect()) == ordered(brute_clusters(rows, 16, 3, 1, 64, 64))


@pytest.mark.parametrize("large", [False, True])
def test_centroids_with_ties_and_odd_vectors(spark, large):
    from telemill.llm.centroids import cluster

    rng = random.Random(5)
    rows = [(k % 150 if k % 7 else None, [rng.randrange(-3, 4) / 2 for _ in range(3)]) for k in range(300)]  # few values, so many ties
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 0.0]), (904, [math.nan, 0.0, 0.0]), (905, [math.inf, 0.0, 0.0]), (906, [0.0, -0.0, 5e-324])]
    if large:
        rows += [(950, [1e308, -1e308, 1.7e308]), (951, [3e38, 0.0, 1.0]), (952, [2.0**40, 1.0, -1.0])]
    frame = spark.createDataFrame([(v, e, 1, "c", "d") for v, e in rows], VECTORS).repartition(5)
    for k in (1, 5, 40):
        assert ordered(cluster(frame, k, 2, 9, components=3, scale=4).collect()) == ordered(brute_clusters(rows, k, 2, 9, 3, 4))


def test_fewer_vectors_than_centroids(spark):
    from telemill.llm.centroids import cluster

    for rows in ([], [(1, None)], [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (2, [0.25, 1.0])]):
        got = cluster(spark.createDataFrame([(v, e, 1, "c", "d") for v, e in rows], VECTORS), 4, 2, 1, components=2).collect()
        assert ordered(got) == ordered(brute_clusters(rows, 4, 2, 1, 2, 64))


def test_tree_finds_the_nearest():
    from telemill.llm.centroids import Index, digits, of_digits

    rng = np.random.default_rng(0)
    for k in (1, 2, 4, 5, 6, 17, 60, 300):
        for components in (1, 2, 6):
            index = Index([tuple(x) for x in rng.integers(-4, 4, (k, components)).tolist()])
            vectors = rng.integers(-6, 6, (60, components))
            numbers, distances = index.nearest(vectors)
            assert [index.nearest_of(v) for v in vectors.tolist()] == list(zip(numbers.tolist(), distances.tolist(), strict=True))
    values = [0, -1, 1 << 55, -(1 << 55), (1 << 300) + 7, -(1 << 300)]
    assert of_digits(digits(values), len(values)) == values
    short, wide = digits([5, -3]), digits([1 << 80, -(1 << 70)])
    assert of_digits([a + b for a, b in zip(short + [0] * (len(wide) - len(short)), wide, strict=True)], 2) == [(1 << 80) + 5, -(1 << 70) - 3]


# --- op13 ------------------------------------------------------------------------------------------------------------


def brute_infill(doc_id, text, seed, rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    spm = h4 % 100 < spm_rate
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return doc_id, len(units), "spm" if spm else "psm", len(prefix), len(middle), out


LINES = ["a\nb\nc\nd", "a\n\n\n", "\n", "<P", "<<P", "x<S>y", "<M>", "<\n<S\n>", "a\r\nb\x0b c\n", "😀é\n" * 50, "<P>", "S>P>M>", "line\n" * 20_000]


@pytest.mark.parametrize("rate,spm_rate", [(100, 50), (60, 100), (0, 50), (100, 0)])
def test_infill_of_odd_texts(spark, documents, rate, spm_rate):
    from pyspark.sql import functions as F

    from telemill.llm.infill import fill_in_middle, restored

    docs = documents([*ODD, *LINES]).withColumn("form", F.lit("clash")).withColumn("doc_id", F.when(F.col("doc_id") % 6 == 1, None).otherwise(F.col("doc_id")))
    found = fill_in_middle(docs, 7, rate, spm_rate)
    assert set(found.columns) == set(docs.columns) | {"n", "prefix_chars", "middle_chars", "output"}
    got = found.withColumn("back", restored()).collect()
    assert ordered((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == ordered(brute_infill(r.doc_id, r.text, 7, rate, spm_rate) for r in docs.collect())
    assert all(r.back == (r.text or "") for r in got)
    assert fill_in_middle(documents([]), 7).count() == 0


def test_infill_of_the_table(spark):
    from telemill.llm.queries import op13_infill

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    true = [(*(x := brute_infill(r.doc_id, r.text, 7, 100, 50))[:5], sha(x[5]), sha(r.text or "")) for r in docs]
    assert ordered(op13_infill(spark, SF).collect()) == ordered(true)


def test_marks_and_units_that_do_not_work(spark, documents):
    from telemill.llm.infill import check_marks, fill_in_middle, transformed

    for marks in (("", "<S>", "<M>"), ("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("<P>", "<<P>", "<M>")):
        with pytest.raises(ValueError):
            check_marks(marks)
    import regex

    with pytest.raises(ValueError):
        transformed("a1", [0, 0, 0, 0], regex.compile("([a-z])*"), 100, 50, ("<P>", "<S>", "<M>"))
    words = fill_in_middle(documents(["a b  c"]), 3, unit=r"\S+\s*|\s+").collect()[0]
    assert words.n == 3


@pytest.mark.parametrize("name", ["op12_centroids", "op13_infill"])
def test_query_equals_sql(spark, duck, name):
    from compare import duck_rows, spark_rows
    from telemill.llm import queries

    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck, queries.oracle_sql()[name], columns)
