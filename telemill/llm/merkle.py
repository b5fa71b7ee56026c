"""Document fingerprints: Merkle trees over clauses, paragraphs and sections, made of built-in functions only.

A paragraph is a line; its leaves are its clauses (up to a word that ends with ``. ! ? ; , :``), at most four words each. A section is a run of
paragraphs that ends where a paragraph's digest says so, so an insertion moves no later border. Leaves have digests of 40
bits, paragraphs and sections of 64 bits over the digests of their children, the root one over those of the sections and
one over the text. Equal roots mean equal texts; comparisons leave out the sections that both trees have, then the
paragraphs, and only look at leaves of what differs. The fingerprint is written as ``root:section|section|...``, a section
as ``digest=paragraph;paragraph;...`` and a paragraph as its digest and those of its leaves with a space before each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.plans.storage import store

#: Ranges of neighbouring documents for each shuffle partition.
RANGES = 4

#: A leaf: up to four words, the last of which alone may end a clause.
LEAF = r"(?:\S*[^\s.!?;,:]\s+){0,3}\S+"


#: Hex digits of a leaf's digest and of one of a paragraph or section.
LEAF_DIGITS, NODE_DIGITS = 10, 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _digest(value: Column, digits: int) -> Column:
    return F.substring(F.lpad(F.lower(F.hex(F.xxhash64(value))), 16, "0"), 17 - digits, digits)


def fingerprint(text: Column) -> Column:
    """Fingerprint of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    leaf = lambda c: F.concat(F.lit(" "), _digest(c, LEAF_DIGITS))
    below = F.transform(F.split(text, "\n"), lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), leaf), ""))
    paragraphs = F.transform(below, lambda p: F.concat(_digest(p, NODE_DIGITS), p))
    border = lambda p: F.when(F.substring(p, NODE_DIGITS, 1) <= "3", "|").otherwise(";")
    body = F.rtrim(F.array_join(F.transform(paragraphs, lambda p: F.concat(p, border(p))), ""), F.lit("|;"))
    # of a section's paragraphs only the digests go into its own
    tree = F.transform(F.split(body, r"\|"), lambda s: F.concat(_digest(F.regexp_replace(s, " [^;]*", ""), NODE_DIGITS), F.lit("="), s))
    top = lambda t: F.sha2(F.array_join(F.transform(t, lambda s: F.substring(s, 1, NODE_DIGITS)), ""), 256)
    return _let(tree, lambda t: F.concat(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), F.substring(top(t), 1, 16), F.lit(":"), F.array_join(t, "|")))


def root(mark: Column) -> Column:
    return F.substring_index(mark, ":", 1)


def sections(mark: Column) -> Column:
    return F.split(F.substring_index(mark, ":", -1), r"\|")


def _below(nodes: Column, between: str) -> Column:
    """Distinct children of nodes."""
    inner = F.transform(nodes, lambda s: F.substring(s, NODE_DIGITS + 2, 1 << 30))
    return F.array_remove(F.array_distinct(F.split(F.array_join(inner, between), between)), "")


def _leaf_count(nodes: Column) -> Column:
    return _let(F.array_join(nodes, ""), lambda x: F.octet_length(x) - F.octet_length(F.translate(x, " ", "")))


def _apart(a: Column, b: Column, more: Callable[[Column], Column]) -> Column:
    """more() of the nodes of arrays a and b that only one has (a, b) and the leaves of those that both have (same)."""
    parts = F.struct(F.array_except(a, b).alias("a"), F.array_except(b, a).alias("b"), _leaf_count(F.array_intersect(a, b)).alias("same"))
    return _let(parts, more)


def changed_sections(old: Column, new: Column) -> Column:
    """Numbers (from 0) of sections of ``new`` whose digest ``old`` does not have: where an edit is. None for equal roots."""
    digests = lambda mark: F.transform(sections(mark), lambda s: F.substring(s, 1, NODE_DIGITS))
    numbered = F.transform(digests(new), lambda s, k: F.struct(s.alias("s"), k.alias("k")))
    found = _let(F.array_except(digests(new), digests(old)), lambda d: F.transform(F.filter(numbered, lambda x: F.array_contains(d, x.s)), lambda x: x.k))
    return F.when(root(old) == root(new), F.array().cast("array<int>")).otherwise(found)


def likeness(a: Column, b: Column) -> Column:
    """Share of leaves that two fingerprints have in common (Dice): 1 for equal roots, below 1 for others.

    Leaves of a section or paragraph that both have are in common without a look at them; below what differs, distinct
    leaves are compared. Texts without a leaf differ in white space only.
    """

    def in_leaves(s: Column, p: Column) -> Column:
        def dice(x: Column) -> Column:
            same = s.same + p.same
            shared, both = same + F.size(F.array_intersect(x.a, x.b)), 2 * same + F.size(x.a) + F.size(x.b)
            return F.when(both == 0, F.lit(0.999999)).otherwise(F.least(2.0 * shared / F.greatest(both, F.lit(1)), F.lit(0.999999)))

        return _let(F.struct(_below(p.a, " ").alias("a"), _below(p.b, " ").alias("b")), dice)

    def in_paragraphs(s: Column) -> Column:
        return _apart(_below(s.a, ";"), _below(s.b, ";"), lambda p: in_leaves(s, p))

    differing = _apart(F.array_distinct(sections(a)), F.array_distinct(sections(b)), in_paragraphs)
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(differing)


def _edges(docs: DataFrame, ranges: int) -> DataFrame:
    """One row: ``groups``, the first doc_ids of ranges of about equal count in groups of ``wide``, and ``none``, ranges for rows without an id.

    A doc_id that holds several ranges' share of the rows is there as often. The table is written; nothing is collected.
    """
    # percentile_approx takes nothing but constants, and one text of all shares is a single literal of the plan
    share = F.split(F.lit(",".join(str(k / ranges) for k in range(ranges))), ",").cast("array<double>")
    found = docs.agg(F.percentile_approx("doc_id", share, F.lit(max(10_000, 10 * ranges))).alias("at"), F.min("doc_id").alias("low"), F.count_if(F.col("doc_id").isNull()).alias("n"), F.count("*").alias("all"))
    edges = F.when(F.col("low").isNull(), F.array().cast("array<bigint>")).otherwise(F.array_sort(F.concat(F.array("low"), F.slice(F.col("at").cast("array<bigint>"), 2, ranges))))
    none = F.ceil(F.col("n") * F.lit(ranges) / F.greatest("all", F.lit(1))).cast("int")
    found = found.select(edges.alias("edges"), none.alias("none")).withColumn("wide", F.greatest(F.ceil(F.sqrt(F.size("edges"))), F.lit(1)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("edges") - 1) / F.col("wide")).cast("int")), lambda k: F.slice("edges", k * F.col("wide") + 1, F.col("wide")))
    return store(found.select(F.when(F.size("edges") > 0, cut).otherwise(F.array().cast("array<array<bigint>>")).alias("groups"), F.size("edges").alias("n_edges"), "wide", "none"), "edges")


def _bucket() -> Column:
    """Number of a row's range. Rows of an id that several ranges begin with, or of none, are dealt to these by ``tie``."""

    def upto(last: Column) -> Column:
        """How many edges are below (or at, with last) doc_id: by whole groups first."""
        below = lambda x: F.when(last, x <= F.col("doc_id")).otherwise(x < F.col("doc_id"))
        coarse = F.size(F.filter("groups", lambda g: below(F.element_at(g, 1))))
        inside = F.when(coarse > 0, F.size(F.filter(F.try_element_at("groups", F.greatest(coarse, F.lit(1))), below))).otherwise(0)
        return F.when(coarse > 0, (coarse - 1) * F.col("wide")).otherwise(0) + inside

    part = lambda n: F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * n).cast("int"), n - 1)
    of = F.struct(upto(F.lit(False)).alias("low"), upto(F.lit(True)).alias("high"))
    known = _let(of, lambda x: F.when(x.high - x.low > 1, x.low + part(x.high - x.low)).otherwise(x.high - 1))
    return F.when(F.col("doc_id").isNull(), F.col("n_edges") + part(F.greatest("none", F.lit(1)))).otherwise(known).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with fingerprint, next_text and next_mark: text and fingerprint of the next doc_id; after the last comes the first.

    Documents are dealt to ranges of doc_id, once; the first document of a range is also sent to the range before as a
    guest, so each range is a window by itself. Rows that share a doc_id follow each other in the order of their hashes
    and are spread over ranges by them where they are many; so are rows whose doc_id is null, which come last.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = F.broadcast(_edges(docs, RANGES * partitions))  # one row, of RANGES numbers for each partition
    here = docs.withColumn("tie", F.xxhash64("text")).join(edges, how="cross").withColumn("bucket", _bucket()).select("doc_id", "text", "tie", "bucket")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    first = here.groupBy("bucket").agg(F.min(key).alias("first"))  # a row for each range and task, without texts
    ahead = Window.partitionBy(F.lit(0)).orderBy("bucket")  # over the list of ranges
    before = F.coalesce(F.lag("bucket").over(ahead), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    first = store(first.withColumn("home", before), "first").withColumnRenamed("bucket", "own")
    same = (F.col("bucket") == F.col("own")) & F.col("first").eqNullSafe(key)
    guests = here.join(F.broadcast(first), same).groupBy("home").agg(F.first("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("tie"), F.col("home").alias("bucket"), F.lit(1).alias("guest"))
    dealt = here.withColumn("guest", F.lit(0)).unionByName(guests).repartition("bucket").withColumn("fingerprint", fingerprint(F.col("text")))
    ahead = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "tie")
    found = dealt.select("doc_id", "text", "guest", "fingerprint", F.lead("text").over(ahead).alias("next_text"), F.lead("fingerprint").over(ahead).alias("next_mark"))
    return found.filter("guest = 0").drop("guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of each document and of an edited copy, with likenesses.

    docs has (doc_id, text); other columns are ignored, a null text is empty. The edited text has its last floor(n/2)
    code points replaced by the first as many (or all) of the next document, by ascending doc_id (after the last: the
    first; rows whose doc_id is null come after the last, in the order of their hashes). Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next (likeness
    to the edited text and to the next document). A table of one document is its own next; an empty table gives an
    empty result; repeated rows follow each other.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    found = with_next(rows).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", edited).drop("text", "next_text")
    found = found.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).cast("double").alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_mark")).cast("double").alias("near_next"),
    )
