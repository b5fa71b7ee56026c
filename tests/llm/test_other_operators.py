"""Classifier, packing, vectors, archives and pipeline."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF
from llm.conftest import ODD

# --- op7 -------------------------------------------------------------------------------------------------------------


def prose(rng, n, bad=()):
    words = [rng.choice(["alpha", "bravo", "charlie", "delta", "echo", "golf", "hotel"]) for _ in range(n)]
    for b in bad:
        words.insert(rng.randrange(len(words)), b)
    return " ".join(words)


def test_toxicity_on_held_out_rows(spark, documents):
    from telemill.llm.toxicity import toxicity

    rng = random.Random(1)
    toxic = [k % 4 == 0 for k in range(400)]
    texts = [prose(rng, 60, [rng.choice(["horrid", "vilest", "nasty"])] if t else []) for t in toxic]
    docs = documents([*texts, *ODD])
    labels = spark.createDataFrame([(k, int(t)) for k, t in enumerate(toxic)] + [(0, None), (10**6, 1)], "doc_id long, toxic int")
    rows = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    assert len(rows) == 400 + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows.values())
    import zlib

    assert all(rows[k].held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k in rows)
    assert all(rows[k].predicted == int(toxic[k]) for k in range(400))
    assert not any(rows[400 + k].predicted for k in range(len(ODD)))


@pytest.mark.parametrize("label", [None, 0, 1])
def test_toxicity_without_two_classes(spark, documents, label):
    from telemill.llm.toxicity import fit, score, without_toxic

    labels = spark.createDataFrame([] if label is None else [(0, label), (1, label)], "doc_id long, toxic int")
    model = fit(documents(["a b", "c d"]), labels)
    assert score(documents(ODD), model).count() == len(ODD) and without_toxic(documents(ODD), model).columns == documents(ODD).columns
    assert score(documents([]), model).count() == 0


def test_ratios_and_cut_against_brute_force():
    from telemill.llm.toxicity import PRIOR, best_cut, log_ratios

    rng = np.random.default_rng(4)
    toxic, other = rng.integers(0, 40, 50), rng.integers(0, 90, 50)
    got = log_ratios(toxic, other, 40, 90)
    for t, o, r in zip(toxic, other, got, strict=True):
        a, b = PRIOR * 40 / 130, PRIOR * 90 / 130
        assert abs(r - (np.log((t + a) / (40 + a)) - np.log((o + b) / (90 + b)))) < 1e-12
    assert (got > 0).any() and (got < 0).any() and abs(log_ratios(np.array([0]), np.array([0]), 40, 90)[0]) < 1e-12
    for _ in range(50):
        z, y = rng.integers(0, 12, 30) / 2, rng.integers(0, 2, 30)
        y[0] = 1
        f1 = lambda cut: 2 * y[z >= cut].sum() / ((z >= cut).sum() + y.sum())  # noqa: E731, B023
        assert abs(f1(best_cut(z, y)) - max(f1(c) for c in set(z.tolist()))) < 1e-12


def test_toxicity_of_the_table(spark):
    """Held-out rows of the table: the labels hold some noise, so neither figure can reach 1."""
    from telemill.llm.queries import op7_toxicity

    sf = SF.replace("0.001", "0.1")
    rows = op7_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("predicted", "toxic").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit >= 0.75 * sum(r.toxic for r in rows) and hit >= 0.75 * sum(r.predicted for r in rows)


def test_minimum_is_found():
    from telemill.llm.toxicity import minimum

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 6)), np.where(rng.random(80) < 0.5, 1.0, -1.0)
    x[:, -1] = 1

    def f(w):
        m = y * (x @ w)
        return np.logaddexp(0, -m).sum() + w @ w / 2, -(y / (1 + np.exp(m))) @ x + w

    w = minimum(f, np.zeros(6), 40)
    assert np.abs(f(w)[1]).max() < 1e-2 and all(f(w)[0] <= f(w + d)[0] + 1e-6 for d in rng.normal(size=(50, 6)) * 0.1)


def test_ngrams_in_pieces(monkeypatch):
    from telemill.llm import toxicity

    text = "".join(random.Random(2).choice("abcdé \U0001f600") for _ in range(500))
    whole = Counter(int(x) for part in toxicity.ngrams(text) for x in part)
    monkeypatch.setattr(toxicity, "_PIECE", 17)
    assert Counter(int(x) for part in toxicity.ngrams(text) for x in part) == whole


# --- op5 -------------------------------------------------------------------------------------------------------------


def brute_pack(items, capacity):
    """Number of each item's bin: the tightest without a conflict, by looking at all of them, the first to reach that residual."""
    bins, out = [], []
    for at, (n, s, c) in enumerate(items):
        fit = [b for b in bins if b["rest"] >= n and s not in b["s"] and c not in b["c"]]
        b = min(fit, key=lambda b: (b["rest"], b["at"])) if fit else None
        if b is None:
            b = {"k": len(bins), "rest": capacity, "s": set(), "c": set()}
            bins.append(b)
        b["rest"] -= n
        b["at"] = at
        b["s"] |= {s} - {None}
        b["c"] |= {c} - {None}
        out.append(b["k"])
    return out


def test_packing_against_brute_force(spark):
    """The operator's bins in one shard and the query's over a table, by a search through all bins."""
    from telemill.llm.packing import best_fit, pack_documents

    rng = random.Random(17)
    items = [(k, k // 2, rng.randrange(1, 150), rng.choice(["a", "b", "c", "d", None]), rng.choice([1, 2, 3, 4, 5, None])) for k in range(200)]
    rows = best_fit(spark.createDataFrame(items, "item long, doc_id long, length long, source string, cluster long"), 64, 10**6).collect()
    pieces = sorted(((min(64, n - 64 * p), i, k, p, s, c) for k, i, n, s, c in items for p in range(-(-n // 64))), key=lambda x: (-x[0], x[1], x[2], x[3]))
    want = brute_pack([(n, s, c) for n, _, _, _, s, c in pieces], 64)
    assert {(r.item, r.piece): r.bin for r in rows} == {(k, p): b for (_, _, k, p, _, _), b in zip(pieces, want, strict=True)}

    # near copies in place of their classes, which other tests hold against brute force
    texts = [" ".join(f"t{g}w{k}" for k in range(40 + 7 * (g % 9))) + (" end" if c else "") for g in range(40) for c in range(1 + g % 3)]
    source = [rng.choice(["a", "b", "c", None]) for _ in texts]
    docs = spark.createDataFrame([(k, t, "en", s, len(t)) for k, (t, s) in enumerate(zip(texts, source, strict=True))], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = {r.doc_id: r for r in pack_documents(docs, 256).collect()}
    order = sorted(range(len(texts)), key=lambda k: (-len(texts[k].split()), k))
    want = brute_pack([(len(texts[k].split()), source[k], texts[k].split()[0]) for k in order], 256)
    assert [got[k].bin for k in order] == want and all(got[k].text == t for k, t in enumerate(texts))


def test_bins_are_the_tightest_compatible():
    from telemill.llm.packing import Bins

    rng = random.Random(7)
    for _ in range(30):
        items = sorted(((rng.randrange(1, 60), rng.randrange(12), rng.randrange(40)) for _ in range(80)), reverse=True)
        bins, held = Bins(64), defaultdict(list)
        rests = []
        for n, s, c in items:
            before = {k: 64 - sum(x[0] for x in v) for k, v in held.items()}
            fits = [r for k, r in before.items() if r >= n and s not in {x[1] for x in held[k]} and c not in {x[2] for x in held[k]}]
            k = bins.place(n, 1 << s, 1 << c)
            assert (k in before and before[k] == min(fits)) if fits else k not in before
            held[k].append((n, s, c))
            rests.append(k)
        assert sum(len(v) for v in held.values()) == 80


def test_packing_keeps_every_word(spark, documents):
    from telemill.llm.packing import best_fit, pack_documents, sequences

    texts = [*ODD, *pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()]
    texts += ["\n\n def f(x):\n\t return  x\r\n" * 100 + "\v", "\u00a0\u2003 " * 300]
    rows = pack_documents(documents(texts, source=lambda k: f"s{k % 9}" if k % 10 else None), capacity=256).collect()
    words = Counter()
    for r in rows:
        words[r.doc_id] += r.length
        assert r.text.encode().split() == texts[r.doc_id].encode().split()[r.start : r.start + r.length]
    whole = defaultdict(str)
    for r in sorted(rows, key=lambda r: r.piece):
        whole[r.doc_id] += r.text
    assert whole == {k: t for k, t in enumerate(texts) if (t or "").encode().split()}  # byte for byte
    assert dict(words) == {k: len((t or "").encode().split()) for k, t in enumerate(texts) if (t or "").encode().split()}
    bins = defaultdict(list)
    for r in rows:
        bins[r.bin].append(r)
    for held in bins.values():
        assert sum(r.length for r in held) <= 256
        sources = [r.doc_id % 9 for r in held if r.doc_id % 10]
        assert len(sources) == len(set(sources)) and len({texts[r.doc_id].lower() for r in held}) == len(held)
        spans = sorted((r.place, r.place + r.length) for r in held)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    whole = {r.bin: r for r in sequences(spark.createDataFrame(rows)).collect()}
    assert all(whole[k].text == " ".join(r.text for r in sorted(held, key=lambda r: r.place)) and whole[k].length == len(whole[k].text.encode().split()) for k, held in bins.items())
    assert best_fit(spark.createDataFrame([], "item long, doc_id long, length long, source string, cluster long")).count() == 0


def test_near_copies_share_no_sequence(spark, documents):
    """Copies with a word changed, of other sources or of none, and copies in another case."""
    from telemill.llm.packing import pack_documents

    rng = random.Random(21)
    texts = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(60)]
        texts += [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in (3, 20, 40)] + [" ".join(base).upper()]
    for source in (lambda k: f"s{k}", lambda k: None):
        rows = pack_documents(documents(texts, source=source), capacity=512).collect()
        bins = defaultdict(list)
        for r in rows:
            bins[r.bin].append(r.doc_id // 4)
        assert sum(r.length for r in rows) == 60 * len(texts) and all(len(v) == len(set(v)) for v in bins.values())
        assert len(bins) < len(texts)  # other texts do


# --- op8 -------------------------------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, n_links string, copies string"


def brute_links(rows, limit=0.93):
    unit = {}
    for i, v, label, *_ in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and np.linalg.norm(v):
            unit[i] = (np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)), label)
    parent, links = {r[0]: r[0] for r in rows}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(unit)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= limit:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {r[0]: (links[r[0]], find(r[0])) for r in rows}


def planted(seed, n=250):
    rng = np.random.default_rng(seed)
    rows, centre = [], [rng.normal(size=16) for _ in range(12)]
    for k in range(n):
        v = centre[k % 12] + rng.normal(size=16) * 0.08 if k % 3 else rng.normal(size=16)
        rows.append((k, [float(np.float32(x)) for x in v], k % 2, "a", "b"))
    rows += [(n + k, rows[1][1], 1, "a", "b") for k in range(5)]  # copies
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 16, [nan] + [1.0] * 15, [inf] + [1.0] * 15, [None] + [1.0] * 15]
    return rows + [(n + 10 + k, v, 0, "a", "b") for k, v in enumerate(bad)] + [(n + 30, rows[1][1], None, "a", "b")]


@pytest.mark.parametrize(("block", "each", "leaders"), [(1000, 40, 1024), (20, 40, 1024), (1000, 4, 4)])
def test_near_vectors(spark, monkeypatch, block, each, leaders):
    """Shards in one task, in blocks, and dealt again as a label asks for more leaders than it gets at once."""
    from telemill.llm import embeddings

    levels, level = set(), embeddings._level
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "PER_LEADER", each)
    monkeypatch.setattr(embeddings, "_level", lambda rows, sizes, k, *more: levels.add(k) or level(rows, sizes, k, *more))
    rows = planted(3)
    vectors = spark.createDataFrame(rows, VECTORS)
    found = embeddings.near_vectors(vectors, leaders=leaders)
    assert (max(levels) > 0) == (leaders == 4)
    got = {r.vec_id: r for r in found.collect()}
    want = brute_links(rows)
    assert set(got) == set(want) and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.97 * len(want) and all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert embeddings.audit(vectors, found, every=5).first().recall >= 0.95


def test_links_of_large_groups_are_symmetric_and_found(spark):
    """Some 6,000 vectors in groups with pairs on both sides of the threshold: each link counts at both ends, few are missed."""
    from telemill.llm import embeddings

    rng = np.random.default_rng(11)
    centre = rng.normal(size=(60, 32))
    units = centre[np.arange(6000) % 60] + rng.normal(size=(6000, 32)) * 0.27
    units = units.astype(np.float32).astype(np.float64)
    units /= np.linalg.norm(units, axis=1)[:, None]
    near = units @ units.T >= 0.93
    np.fill_diagonal(near, False)
    near &= (np.arange(6000) % 2)[:, None] == np.arange(6000) % 2
    assert near.sum() > 100_000 and ((units @ units.T)[near] < 0.94).mean() > 0.2
    vectors = spark.createDataFrame([(k, v.tolist(), k % 2, "", "") for k, v in enumerate(units)], VECTORS.replace("float", "double"))
    found = embeddings.near_vectors(vectors)
    links = {r.vec_id: r.n_links for r in found.collect()}
    total = sum(links.values())
    assert total % 2 == 0 and all(links[k] <= n for k, n in enumerate(near.sum(1))) and total >= 0.999 * near.sum()
    assert embeddings.audit(vectors, found).first().recall >= 0.999


def test_vectors_with_odd_ids_and_lengths(spark):
    """Repeated and null ids are rows like others; vectors of other lengths link with nothing else."""
    from telemill.llm.embeddings import near_vectors

    rng = np.random.default_rng(9)
    a, b, c = (rng.normal(size=8).tolist() for _ in range(3))
    near = lambda v: (np.array(v) + 0.01).tolist()
    rows = [(1, a), (1, b), (2, near(b)), (0, near(a)), (None, c), (None, near(c)), (5, a[:5]), (6, [*a[:5]]), (7, b)]
    vectors = spark.createDataFrame([(i, v, 1, "", "") for i, v in rows], VECTORS)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(vectors).collect())
    got_null = sorted(k[3] for k in got.elements() if k[0] is None)
    assert got_null == [False, True] and all(k[1] == 1 and k[2] is None for k in got if k[0] is None)
    assert Counter(k for k in got.elements() if k[0] is not None) == Counter([(1, 1, 0, False), (0, 1, 0, True), (1, 2, 1, True), (2, 2, 1, False), (7, 2, 1, False), (5, 1, 5, True), (6, 1, 5, False)])


def test_no_vectors(spark):
    from telemill.llm.embeddings import near_vectors

    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    one = near_vectors(spark.createDataFrame([(1, [1.0, 2.0], 0, "", ""), (2, None, 0, "", "")], VECTORS)).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in one] == [(0, 1, True), (0, 2, True)]


def test_robust_prune():
    from telemill.llm.embeddings import DEGREE, robust_prune

    x = np.random.default_rng(1).normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lists = robust_prune(x @ x.T)
    assert lists.shape == (60, DEGREE) and all(k not in row for k, row in enumerate(lists.tolist()))
    assert (lists[:, 0] == np.argmax(x @ x.T - 3 * np.eye(60), 1)).all()  # the nearest is always kept


# --- op10 ------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, digest string, chunk string"


def brute_pages(rows, least=1000):
    data = {r[0]: (r[2] or "").encode() for r in rows}
    best = {}
    for i, b in data.items():
        if len(b) >= least:
            best[b] = max(best.get(b, i), i)
    return {i: (len(b), hashlib.sha1(b).hexdigest(), "revisit" if best.get(b, i) != i else "response", best[b] if best.get(b, i) != i else None) for i, b in data.items()}


@pytest.mark.parametrize("size", [7, 64, 256 << 10])
def test_archives(spark, size):
    from telemill.llm import warc

    long = "é\U0001f600x\r\n" * 400
    htmls = [None, "", "a", "\r\n\r\nWARC/1.1\r\n\r\nWARC/1.1\r\n", "WARC/1.1\r\n", "\n", "\r", long, long, "b" * 999, "b" * 999, "c" * 1000, "c" * 1000, "c" * 1000, "tail\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
    rows = [(k, f"http://h/{k}\r\nX: y" if k % 2 else None, h, "d", "c") for k, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = warc.scratch_path(spark, "warc")
    chunks = warc.chunk_table(pages, size)
    held = defaultdict(bytes)
    for r in chunks.orderBy("record_id", "chunk").collect():
        held[r.record_id] += bytes(r.bytes)
        assert len(r.bytes) <= max(size, 4) and r.digest == hashlib.sha1(held[r.record_id]).hexdigest() and r.done == len(held[r.record_id])
    assert {k: v for k, v in held.items()} == {k: (h or "").encode() for k, h in enumerate(htmls)}
    warc.write_archive(chunks, warc.revisits(chunks.drop("bytes")), path)
    got = warc.payloads(warc.read_archive(spark, path)).collect()
    assert {r.record_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute_pages(rows) and len(got) == len(rows) and all(r.verified for r in got)


def test_archive_of_the_table(spark):
    from telemill.llm import queries

    rows = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    got = queries.queries()["op10_warc"](spark, SF).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == brute_pages(rows) and all(r.verified for r in got)


def test_archive_of_repeated_and_null_ids(spark):
    """Repeated segmented rows are read back each by itself; a shared page_id costs no payload; null ids are records."""
    from telemill.llm.warc import CHUNK, archive_pages

    big, other = "abcdefg\n" * (CHUNK // 4), "z" * (3 * CHUNK)
    same, alone = "s" * 2000, "t" * 2000
    rows = [(5, big), (5, big), (5, other), (1, same), (1, alone), (2, same), (2, same), (None, other), (None, same), (None, "n"), (None, None)]
    pages = spark.createDataFrame([(i, "http://h", h, "d", "c") for i, h in rows], PAGES).repartition(3)
    got = archive_pages(pages).collect()
    refers = {(1, same): 2, (None, same): 2, (None, other): 5}
    want = Counter((i, len(h or ""), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if (i, h) in refers else "response", refers.get((i, h))) for i, h in rows)
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want and all(r.verified for r in got)


def test_empty_archive(spark):
    from telemill.llm.warc import archive_pages

    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline as p
    from telemill.plans.storage import store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES:
        if name == "packing":
            texts = {r.doc_id: r.text for r in docs.collect()}
        docs = store(stage(spark, docs, SF), name)
        counts.append(docs.count())
        if name != "packing":
            assert tuple(docs.columns) == p.COLUMNS
    assert counts[0] > counts[1] >= counts[2] > counts[3] == counts[4]
    assert {r.doc_id for r in docs.collect()} == {k for k, t in texts.items() if t.split()}
    assert docs.agg(F.sum("length")).first()[0] == sum(len(t.encode().split()) for t in texts.values())


def test_pipeline_without_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_near_dedup_stage_keeps_unique_rows(spark):
    """A repeated doc_id and null ids cost no text; of near copies with such ids one row stays."""
    import corpus_pipeline as p

    rng = random.Random(12)
    a, b, c, d, e = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(5))
    near = lambda x: " ".join([*x[:-1], "changed"])
    a, b, c, d, e = (" ".join(x) for x in (a, b, c, d, e))
    rows = [(1, a), (1, b), (2, near(a.split())), (0, near(b.split())), (None, c), (None, near(c.split())), (None, d), (7, near(d.split())), (3, e), (3, e), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = Counter((r.doc_id, r.text) for r in p.drop_near_duplicates(spark, docs, SF).collect())
    c_kept = next(t for i, t in got if i is None and t in (c, near(c.split())))
    assert got == Counter([(1, a), (0, near(b.split())), (None, c_kept), (7, near(d.split())), (3, e), (None, None), (None, "")])
