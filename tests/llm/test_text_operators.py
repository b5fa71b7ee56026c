"""Text operators against brute force, on odd texts and on the small tables."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF
from llm.conftest import ODD

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def small():
    t = pq.read_table(f"{SF}/documents.parquet")
    return t["doc_id"].to_pylist(), t["text"].to_pylist()


# --- op1 -------------------------------------------------------------------------------------------------------------


def tiktoken_encoder():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(spark, documents):
    from telemill.llm import bpe

    path, pattern, enc = tiktoken_encoder()
    texts = [*ODD, *small()[1], "aaaaaaaaaaaaaaaaaaaaaaaa" * 50, "<|endoftext|> it's we'll  \t\n x"]
    got = {r.doc_id: r for r in bpe.token_digests(documents(texts), path, pattern).collect()}
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[k].n_tokens, got[k].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_bpe_round_trip_and_empty(spark, documents):
    from telemill.llm import bpe

    path, pattern, enc = tiktoken_encoder()
    rows = bpe.decode(bpe.encode(documents(ODD), path, pattern), path, pattern).collect()
    assert all(bytes(r["bytes"]).decode() == (r.text or "") and list(r.ids) == enc.encode_ordinary(r.text or "") for r in rows)
    assert bpe.token_digests(documents([]), path, pattern).count() == 0


@pytest.mark.parametrize("memo, laid, together", [(1, 1, 1), (2000, 40, 300), (96 << 20, 1 << 17, 1 << 19)])
def test_bpe_queue_over_many_pre_tokens(monkeypatch, memo, laid, together):
    """Whatever is remembered and merged together, ids are the library's; long pre-tokens too."""
    from telemill.llm import bpe

    path, pattern, enc = tiktoken_encoder()
    for name, value in (("MEMO", memo), ("LAID", laid), ("TOGETHER", together)):
        monkeypatch.setattr(bpe, name, value)
    rng = random.Random(3)
    codec = bpe.Codec(open(path, "rb").read(), pattern)
    texts = [w for w in ["alpha", "beta", "gamma", "delta", "alpha", "", "epsilon", "beta"] * 3]
    texts += ["".join(rng.choice("theinrasoldu") for _ in range(3000)), "ab" * 500 + "a", "\n \n" * 50]
    texts += ["".join(rng.choice("abcde'é ñ\U0001f600\n\t0123.,!") for _ in range(rng.randrange(400))) for _ in range(40)]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
        assert got == [enc.encode_ordinary(t) for t in texts]
    assert codec.held <= max(memo, 100_000)


# --- op2 -------------------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(int(c) for c in reversed(d))) % 10 == 0


def private_values(rng):
    card = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    card += next(str(c) for c in range(10) if luhn(card + str(c)))
    return {
        "card": card, "phone": f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(10000):04d}", "ip": ".".join(str(rng.randrange(256)) for _ in range(4)),
        "mail": f"u{rng.randrange(10**6)}.x@mail.example.com", "ssn": f"{rng.randrange(1, 665):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}", "date": f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}",
    }


FORMS = {"card": r"4\d{15}", "phone": r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", "ip": r"\d{1,3}(\.\d{1,3}){3}", "mail": r"u\d+\.x@mail\.example\.com|[a-z]\d+\.[a-z]@mail\.example\.com", "ssn": r"\d{3}-\d\d-\d{4}", "date": r"\d{4}-\d\d-\d\d"}


def test_pseudonyms_keep_format_and_links(spark, documents):
    from telemill.llm.pii import pseudonymise

    rng = random.Random(3)
    values = [private_values(rng) for _ in range(60)]
    flat = [(kind, v) for x in values for kind, v in x.items()]
    docs = documents([f"before {v} after. Again: {v}, end" for _, v in flat])
    found = defaultdict(dict)
    for r in pseudonymise(docs, "k").orderBy("doc_id").collect():
        kind, v = flat[r.doc_id]
        a, b = re.fullmatch(r"before (.*) after\. Again: (.*), end", r.text).groups()
        assert a == b and re.fullmatch(FORMS[kind], a) and r.n_private in (0, 2) and (kind != "card" or luhn(a))
        assert found[kind].setdefault(v, a) == a
    for kind, pairs in found.items():
        assert len(set(pairs.values())) == len(pairs) and sum(a != b for a, b in pairs.items()) >= 0.98 * len(pairs)  # a permutation


def test_pseudonyms_leave_the_rest(spark, documents):
    from telemill.llm.pii import pseudonymise

    clean = ["card 4111111111111112", "version 1.2.3", "999.1.1.1", "1999-13-40", "000-12-3456", "a @ b", "tel 12345", *ODD]
    rows = pseudonymise(documents(clean), "k").orderBy("doc_id").collect()
    assert [r.text for r in rows] == clean and all(r.n_private == 0 and r._found == "f" for r in rows)
    same = pseudonymise(documents(["2024-02-29 29.02.2024"]), "k").first().text.split()
    y, m, d = same[0].split("-")
    assert same[1] == f"{d}.{m}.{y}"
    assert pseudonymise(documents(["4111111111111111"]), "k").first().text != pseudonymise(documents(["4111111111111111"]), "other").first().text
    assert pseudonymise(documents([]), "k").count() == 0


def test_feistel_is_a_permutation(spark):
    from telemill.llm.pii import permute

    df = spark.range(35).select(permute(F.floor(F.col("id") / 7), F.col("id") % 7, F.lit(5), F.lit(7), "k", "t").alias("p"))
    assert len({(r.p.a, r.p.b) for r in df.collect()}) == 35


# --- op3 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("texts", [[], ["a b"], ODD, small()[1]], ids=["empty", "one", "odd", "table"])
def test_fingerprints(spark, documents, texts):
    from telemill.llm.merkle import fingerprints

    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    docs = documents(texts).repartition(5, F.xxhash64("doc_id"))
    got = {r.doc_id: r for r in fingerprints(docs).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        t, n = t or "", texts[(k + 1) % len(texts)] or ""
        h = len(t) // 2
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest())
        assert 0 <= got[k].near_next <= 1 and 0 <= got[k].near_edited <= 1
    marks = defaultdict(set)
    for k, t in enumerate(texts):
        marks[t or ""].add(got[k].fingerprint)
    assert all(len(v) == 1 for v in marks.values()) and len({m for v in marks.values() for m in v}) == len(marks)


def test_edits_are_located(spark):
    from telemill.llm.merkle import changed_sections, fingerprint, likeness

    paragraphs = [f"Paragraph {k} has a few words, and a clause. It ends." for k in range(60)]
    other = paragraphs[:30] + ["Changed here."] + paragraphs[31:]
    df = spark.createDataFrame([("\n".join(paragraphs), "\n".join(other))], "a string, b string").select(fingerprint(F.col("a")).alias("a"), fingerprint(F.col("b")).alias("b"))
    r = df.select(changed_sections(F.col("a"), F.col("b")).alias("c"), changed_sections(F.col("a"), F.col("a")).alias("none"), likeness(F.col("a"), F.col("b")).alias("l")).first()
    assert 1 <= len(r.c) <= 2 and r.none == [] and 0.9 < r.l < 1


def test_fingerprints_are_trees(spark):
    """Every node's digest is over its children's; leaves of many unrelated texts do not meet."""
    from telemill.llm.merkle import fingerprint, likeness

    rng = random.Random(5)
    a, b = ("\n".join(" ".join(f"{k}{rng.randrange(10**9)}." for _ in range(20)) for _ in range(600)) for k in "ab")
    r = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint(F.col("a")).alias("a"), likeness(fingerprint(F.col("a")), fingerprint(F.col("b"))).alias("l")).first()
    found = []
    for s in r.a.split(":")[1].split("|"):
        digest, inner = s.split("=")
        paragraphs = [p.split(" ") for p in inner.split(";")]
        assert all(len(p[0]) == 16 and len(p) == 21 and all(len(x) == 10 for x in p[1:]) for p in paragraphs)
        # rows: a node's digest and what it is taken over
        found.append((digest, ";".join(p[0] for p in paragraphs)))
        found += [(p[0], "".join(f" {x}" for x in p[1:])) for p in paragraphs]
    wrong = spark.createDataFrame(found, "d string, x string").filter("d <> lpad(lower(hex(xxhash64(x))), 16, '0')")
    assert wrong.count() == 0 and len(found) > 700 and r.l == 0


def test_next_of_many_rows_without_an_id(spark):
    """A third of the rows has no id and a third one id: both are spread over ranges, and all rows make one ring."""
    from telemill.llm.merkle import with_next

    rows = [(k if k % 3 == 0 else (7 if k % 3 == 1 else None), f"text {k}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = with_next(docs).collect()
    after = {r.text: r.next_text for r in got}
    ids = dict((t, i) for i, t in rows)
    assert len(got) == 300 and len(set(after.values())) == 300
    walk, seen = "text 0", []
    for _ in range(300):
        seen.append(ids[walk])
        walk = after[walk]
    assert walk == "text 0" and seen == sorted(seen, key=lambda i: (i is None, i or 0))


# --- op4 -------------------------------------------------------------------------------------------------------------


def brute_near(ids, texts):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = WORD.findall((t or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    where, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        near = Counter(j for x in s for j in where[x])
        for j, n in near.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(i)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_copies(rng, groups=4, each=40, words=120):
    """Groups of near copies with more and less edits, all with a common passage."""
    common = [f"c{k}" for k in range(30)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(each):
            copy = base[:]
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(common + copy if rng.random() < 0.5 else copy))
    return out


@pytest.mark.parametrize("texts", [[], ODD, small()[1], near_copies(random.Random(2))], ids=["empty", "odd", "table", "copies"])
def test_near_duplicates(spark, documents, texts):
    from telemill.llm.minhash import near_duplicates

    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(documents(texts)).collect()}
    assert got == brute_near(range(len(texts)), texts)


def test_near_duplicates_in_blocks(spark, documents, monkeypatch):
    """Small limits send every large node through all levels and blocks."""
    from telemill.llm import minhash

    texts = near_copies(random.Random(4), groups=2, each=60)
    for name, value in (("SMALL", 3), ("MEDIUM", 10), ("LEVELS", 3), ("BLOCK", (8, 2000))):
        monkeypatch.setattr(minhash, name, value)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(texts)).collect()}
    assert got == brute_near(range(len(texts)), texts)


# --- op6 -------------------------------------------------------------------------------------------------------------


def test_lines_equal_the_oracle(spark, duck):
    from compare import duck_rows, spark_rows
    from telemill.llm import queries

    df = queries.queries()["op6_lines"](spark, SF)
    columns = sorted(df.columns)
    assert spark_rows(df, columns) == duck_rows(duck, queries.oracle_sql()["op6_lines"], columns)


def test_boilerplate_lines(spark, documents):
    from telemill.llm.lines import drop_boilerplate

    texts = [f"menu\nstory {k}\n menu \n\n" for k in range(20)] + [f"rare\nstory {k}" for k in range(20)] + [None, ""]
    rows = drop_boilerplate(documents(texts, source=lambda k: "a" if k < 20 else ("b" if k < 40 else None)), ratio=0.5).orderBy("doc_id").collect()
    assert rows[0].text == "story 0\n\n" and (rows[0].n_lines, rows[0].n_dropped) == (5, 2)
    assert rows[20].text == "story 0" and rows[40].text is None and rows[40].n_lines == 0 and rows[41].text == ""
    assert len(rows) == 42 and drop_boilerplate(documents([])).count() == 0


# --- op9 -------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, window=35):
    w = [WORD.findall((t or "").encode()) for t in texts]
    count = Counter(tuple(x[i : i + window]) for x in w for i in range(len(x) - window + 1))
    out = []
    for x in w:
        cut = [False] * len(x)
        for i in range(len(x) - window + 1):
            if count[tuple(x[i : i + window])] > 1:
                cut[i : i + window] = [True] * window
        out.append((len(x), sum(cut), hashlib.sha256(b" ".join(a for a, c in zip(x, cut, strict=True) if not c)).hexdigest()))
    return out


def with_passages(rng):
    passage = [f"p{k}" for k in range(70)]
    texts = []
    for k in range(60):
        own = [f"d{k}w{rng.randrange(10**6)}" for _ in range(rng.randrange(80))]
        a = rng.randrange(40)
        texts.append(" ".join(own[:40] + passage[a : a + rng.randrange(30, 71)] + own[40:]))
    return [*texts, "loop me " * 60, "x " * 34, "x " * 35, "x " * 36, texts[0], texts[0].replace("d0w", "D0w", 1)]


@pytest.mark.parametrize("texts", [[], ODD, small()[1], with_passages(random.Random(6))], ids=["empty", "odd", "table", "passages"])
def test_repeats(spark, documents, texts):
    from telemill.llm.repeats import drop_repeats

    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeats(documents(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts)


def test_repeats_with_hot_anchors(spark, documents, monkeypatch):
    from telemill.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 3)
    monkeypatch.setattr(repeats, "SHARD", 10)
    texts = with_passages(random.Random(8))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in repeats.drop_repeats(documents(texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts)


# --- ids that are null or repeated -----------------------------------------------------------------------------------


def test_rows_without_an_id(spark):
    """Null and repeated doc_ids beside others: op3 puts nulls last, op4 and op9 treat their rows like others."""
    from telemill.llm.merkle import fingerprints
    from telemill.llm.minhash import near_duplicates
    from telemill.llm.repeats import drop_repeats

    rng = random.Random(31)
    a, b, c = ([f"w{rng.randrange(10**6)}" for _ in range(90)] for _ in range(3))
    texts = [" ".join(x) for x in (a, [*a[:-1], "changed"], b, [*b[:-1], "changed"], c)]
    ids = [None, 4, 4, None, 9]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    marks = fingerprints(docs).collect()
    assert sorted(r.doc_id or 0 for r in marks) == [0, 0, 4, 4, 9]
    half = {i: len(t) // 2 for i, t in enumerate(texts)}
    after = {hashlib.sha256((texts[4][: len(texts[4]) - half[4]] + texts[k][: half[4]]).encode()).hexdigest() for k in (0, 3)}
    assert next(r.edited_sha256 for r in marks if r.doc_id == 9) in after  # the next of the last id is one of the nulls
    near = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert near == [(0, 4, False), (0, 4, False), (4, 4, True), (4, 4, True), (9, 9, True)]
    assert fingerprints(docs.filter("doc_id IS NULL")).count() == 2
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in drop_repeats(docs).collect())
    assert got == Counter((i, *w) for i, w in zip(ids, brute_repeats(texts), strict=True))


def test_dates_keep_their_form(spark):
    """A date written without leading zeros comes out without them; the same day has one pseudonym in any form."""
    from telemill.llm.pii import pseudonymise

    texts = ["2020-04-03", "3/4/2020", "03/04/2020", "3.04.2020", "12/4/2020", "12/04/2020", "4/23/2020", "31/02/2020"]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    iso, bare, full, mixed, bare_12, full_12, month_first, none = (r.text for r in rows)
    year, month, day = iso.split("-")
    assert full == f"{day}/{month}/{year}" and bare == f"{int(day)}/{int(month)}/{year}" and mixed == f"{int(day)}.{month}.{year}"
    assert [int(x) for x in bare_12.split("/")] == [int(x) for x in full_12.split("/")] and re.fullmatch(r"[1-9]\d?/[1-9]\d?/\d{4}", bare_12)
    assert re.fullmatch(r"[1-9]\d?/[1-9]\d?/\d{4}", month_first) and none == "31/02/2020"


def test_month_first_dates_are_read_in_one_way(spark):
    """A day written with the month first has the pseudonym of its other forms, and no other day has it."""
    from telemill.llm.pii import pseudonymise

    days = [(d, m, y) for y in (1800, 1900, 1999, 2199) for m in range(1, 13) for d in (13, 20, 28)]
    texts = [f"{m:02d}/{d:02d}/{y} {d:02d}/{m:02d}/{y} {y}-{m:02d}-{d:02d}" for d, m, y in days]
    rows = pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").orderBy("doc_id").collect()
    for r in rows:
        month_first, day_first, iso = r.text.split()
        y, m, d = iso.split("-")
        assert (month_first, day_first) == (f"{m}/{d}/{y}", f"{d}/{m}/{y}") and int(d) > 12 and 1800 <= int(y) < 2200
    assert len({r.text for r in rows}) == len(days)


@pytest.mark.parametrize("ranges", [1, 7, 844])
def test_edges_of_many_ranges(spark, ranges):
    """Ranges of tables with many partitions are found like those of few, and hold about as many rows each."""
    from telemill.llm.merkle import _edges

    found = _edges(spark.range(10 * ranges).withColumnRenamed("id", "doc_id"), ranges).first()
    edges = [x for group in found.groups for x in group]
    assert edges[0] == 0 and len(edges) == found.n_edges == ranges and found.none == 0
    assert all(abs(x - 10 * k) <= 10 for k, x in enumerate(edges))
