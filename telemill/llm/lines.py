"""Removal of boilerplate lines by their frequency relative to their site.

A line is boilerplate on a host when the share of the host's pages that contain it exceeds a ratio. Since each such line
is on more than that share of the pages, a host has at most (mean distinct lines of its pages) / ratio of them: the
list of a host is short, whatever its number of pages, and is joined to the pages by host without moving lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.llm.shared import BROADCAST_IDS
from telemill.plans.storage import store

#: Share of a host's pages above which a line is dropped, and pages that it must at least be on.
RATIO, LEAST_PAGES = 0.05, 5


def _key(line: Column) -> Column:
    """128 bits of a line without the spaces around it."""
    return F.unhex(F.substring(F.sha2(F.trim(line).cast("binary"), 256), 1, 32))


def boilerplate(pages: DataFrame, ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """(host, lines: keys of its boilerplate lines) of pages (host, text)."""
    total = pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least)
    lines = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _key))
    count = pages.select("host", F.explode(lines).alias("line")).groupBy("host", "line").agg(F.count("*").alias("on")).filter(F.col("on") >= least)
    common = count.join(total, "host").filter(F.col("on") > F.col("pages") * F.lit(ratio))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(docs: DataFrame, host: str | Column = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST_PAGES) -> DataFrame:
    """All rows and columns of docs without the boilerplate lines of ``text``, and n_lines, n_dropped.

    Lines end with a line feed and are compared without the spaces around them; a line goes when it is on at least
    ``least`` pages and on more than ``ratio`` of the pages of its host, each page counting once. Blank lines always
    stay. A null host is a host of its own; null texts stay null (0 lines), empty ones empty. Repeated rows are pages of
    their own. Columns called n_lines and n_dropped are replaced. An empty table gives an empty result.
    """
    host = F.col(host) if isinstance(host, str) else host
    rows = docs.withColumn("__tm_host", F.concat(F.lit("="), host.cast("string"))).withColumn("__tm_host", F.coalesce("__tm_host", F.lit("")))
    found = store(boilerplate(rows.select(F.col("__tm_host").alias("host"), F.col(text).alias("text")), ratio, least), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0)).alias("n")).first()["n"]
    found = found.select(F.col("host").alias("__tm_host"), F.col("lines").alias("__tm_common"))
    rows = rows.join(F.broadcast(found) if size <= BROADCAST_IDS // 4 else found, "__tm_host", "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains("__tm_common", _key(x)))
    rows = rows.withColumn("__tm_kept", F.when(F.col("__tm_common").isNotNull() & F.col(text).isNotNull(), kept))
    count = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines))
    out = rows.withColumn("n_lines", count).withColumn("n_dropped", F.when(F.col("__tm_kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("__tm_kept")))
    out = out.withColumn(text, F.when(F.col("n_dropped") > 0, F.array_join("__tm_kept", "\n")).otherwise(F.col(text)))
    return out.drop("__tm_host", "__tm_common", "__tm_kept")


#: The same in DuckDB, over documents by source.
ORACLE = f"""
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents
), total AS (
    SELECT source, count(*) AS pages FROM documents GROUP BY source
), common AS (
    SELECT source, trim(line) AS line, count(DISTINCT doc_id) AS n FROM lines WHERE trim(line) <> '' GROUP BY source, trim(line)
), gone AS (
    SELECT source, line FROM common JOIN total USING (source) WHERE n >= {LEAST_PAGES} AND n > pages * {RATIO}::DOUBLE
), kept AS (
    SELECT doc_id, string_agg(CASE WHEN g.line IS NULL THEN l.line END, chr(10) ORDER BY k) AS text, count(*) AS n_lines, count(g.line) AS n_dropped
    FROM lines l LEFT JOIN gone g ON l.source = g.source AND trim(l.line) = g.line GROUP BY doc_id
)
SELECT doc_id, coalesce(kept.text, '') AS text, CAST(n_lines AS INTEGER) AS n_lines, CAST(n_dropped AS INTEGER) AS n_dropped FROM kept
"""
