"""Pseudonyms and the whole pipeline against plain Python."""

import math
import random

import pyarrow.parquet as pq

from conftest import SF
from llm import brute


def test_every_kind_of_value(spark):
    """Values of all kinds, valid or not, in texts with other things around them."""
    from telemill.llm.pii import pseudonymise

    rng = random.Random(8)
    n = lambda a, b: rng.randrange(a, b)
    values = []
    for _ in range(60):
        sign, pad = rng.choice("-/"), rng.choice(["02d", "d"])
        card = "".join(str(n(0, 10)) for _ in range(rng.choice([12, 14, 15, 18])))
        card += next(c for c in "0123456789" if brute._luhn(card + c) == 0) if rng.random() < 0.7 else "7"
        values += [
            f"{n(1700, 2300):04d}{sign}{n(0, 14):02d}{sign}{n(0, 33):02d}", f"{n(0, 33):{pad}}.{n(0, 14):{pad}}.{n(1700, 2300)}", f"{n(1, 14):{pad}}/{n(1, 33):{pad}}/{n(1900, 2100)}",
            ".".join(str(n(0, 260)) for _ in range(4)), f"{n(0, 1000):03d}-{n(0, 100):02d}-{n(0, 10000):04d}", f"({n(200, 1000)}) {n(200, 1000)}-{n(0, 10000):04d}", f"+1 {n(200, 1000)}.{n(200, 1000)}.{n(0, 10000):04d}",
            f"+{n(20, 999)} {n(100, 10000)} {n(1000, 10000)}", f"+44 {n(1, 100)}", card, f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:16]}", "".join(rng.choices("abcXYZ019._%+-", k=n(1, 20))) + "@mail.example.org", "a@b", "x" * 70 + "@example.org",
        ]
    rng.shuffle(values)
    texts = [" ".join(values[k : k + 7]) + rng.choice(["", ".", "\né tail", " 12", "\t@"]) for k in range(0, len(values), 7)] + values + [None, "", "no data", "5551234567"]
    rows = [(k % 50 if k % 9 else None, t) for k, t in enumerate(texts)]  # repeated and null ids
    got = pseudonymise(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string"), "key").collect()
    want = {k: (None, 0) if t is None else brute.pseudonymised(t, "key") for k, (_, t) in enumerate(rows)}
    assert {r.k: (r.text, r.n_private) for r in got} == want
    assert sum(n for _, n in want.values()) > len(values)


def test_pipeline_against_plain_python(spark, monkeypatch):
    """All stages over all documents, each on what the one before has left; only the fitted weights are shared."""
    import corpus_pipeline as p
    from telemill.llm import packing, toxicity
    from telemill.llm.queries import PSEUDONYM_KEY
    from telemill.plans.storage import store

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet").filter(~toxicity.held_out()))
    monkeypatch.setattr(toxicity, "fit", lambda *a: model)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    limit = math.log(toxicity.THRESHOLD / (1 - toxicity.THRESHOLD))
    scores = {i: brute.logit(t, model) for i, t, _ in rows}
    assert min(abs(z - limit) for z in scores.values()) > 1e-6
    stages = dict(p.STAGES)

    def stage(name):
        nonlocal docs
        docs = store(stages[name](spark, docs, SF), name)
        assert tuple(docs.columns) == p.COLUMNS
        found = docs.collect()
        assert all(r.n_chars == len(r.text) for r in found)
        return sorted((r.doc_id, r.text, r.source) for r in found)

    rows = [r for r in rows if scores[r[0]] < limit]
    assert stage("toxicity") == sorted(rows) and len(rows) < len(scores)
    rows = brute.without_boilerplate(rows)
    assert stage("line_dedup") == sorted(rows)
    kept = brute.near_classes(rows)
    rows = [r for r in rows if kept[r[0]] == r[0]]
    assert stage("near_dedup") == sorted(rows) and len(rows) < len(kept)
    rows = [(i, brute.pseudonymised(t, PSEUDONYM_KEY)[0], s) for i, t, s in rows]
    assert stage("pii") == sorted(rows)
    got = stages["packing"](spark, docs, SF).collect()
    assert sorted((r.doc_id, r.piece, r.bin, r.place, r.length, r.text) for r in got) == sorted(brute.packed(rows, packing.CAPACITY))
