"""Upserts as aggregates over old and new rows, for storage without a MERGE statement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEQ = "_seq"


def _newest(name: str, keep: Column | None = None) -> Column:
    """Value of the latest row, or of the latest that ``keep`` allows."""
    at = F.struct(SEQ, F.xxhash64(name))
    return F.max_by(F.col(name), at if keep is None else F.when(keep, at))


def _oldest(name: str) -> Column:
    return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.struct(SEQ, F.xxhash64(name))))


def _union(name: str) -> Column:
    """Sorted union; each task keeps the distinct arrays only, so a key with very many rows stays small."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(name, F.array().cast("array<string>"))))))


RULES = {
    "min": lambda n: F.min(n),
    "max": lambda n: F.max(n),
    "sum": lambda n: F.sum(n),
    "union": _union,
    "new": _newest,
    "new_not_null": lambda n: _newest(n, F.col(n).isNotNull()),
    "new_not_empty": lambda n: _newest(n, F.size(n) > 0),
    "new_not_blank": lambda n: F.coalesce(_newest(n, F.col(n) != ""), F.max(n)),
    "new_known": lambda n: F.coalesce(_newest(n, F.col(n) != "unknown"), F.max(n)),
    "old": _oldest,
}

#: Keys and column rules of each table.
TABLES: dict[str, tuple[Sequence[str], Mapping[str, str]]] = {
    "iocs": (("ioc_type", "ioc_value"), {"first_seen": "min", "last_seen": "max", "occurrence_count": "sum", "source_honeypots": "union"}),
    "credentials": (("username", "password"), {"first_seen": "min", "last_seen": "max", "attempt_count": "sum", "success_count": "sum"}),
    "devices": (
        ("source", "ip", "port", "snapshot_week"),
        {"snapshot_date": "max", "device_type": "new_known", "query_ids": "union", "query_category": "old", "cpe": "new_not_empty", "cve_ids": "new_not_empty", "tags": "new", "raw_data": "new", "vulns": "new", "ssl_cert": "new"}
        | {c: "new_not_null" for c in ("transport", "protocol", "product", "version", "country_code", "asn", "org", "isp", "http_title", "http_server", "raw_banner")},
    ),
    "feeds": (("source", "ioc_value"), {"ioc_type": "new", "ip": "new_not_null", "port": "new_not_null", "malware_family": "new_not_blank", "confidence": "max", "first_seen": "min", "last_seen": "new", "snapshot_date": "new"}),
    "nodes": (("node_value",), {"node_type": "old", "first_seen": "min", "last_seen": "max", "cluster_id": "new_not_null", "metadata": "new"}),
    "edges": (("source_node_id", "target_node_id", "edge_type"), {"weight": "new", "first_seen": "min", "last_seen": "new", "evidence": "new"}),
    "campaigns": (("cluster_id",), {"name": "old", "first_seen": "old", "last_seen": "max", "primary_protocol": "old", "event_count": "new", "source_ip_count": "new", "primary_creds": "new", "malware_hashes": "new", "metadata": "new"}),
    "query_runs": (("source", "snapshot_week", "query_id"), {"results_total": "new", "results_fetched": "new", "executed_at": "max", "error": "new"}),
}


def merge_rules(table: str, columns: Sequence[str] | None = None) -> dict:
    """Arguments of merge_as_aggregate for a known table, of the given columns only if there are any."""
    keys, cols = TABLES[table]
    return {"keys": list(keys), "columns": {c: r for c, r in cols.items() if columns is None or c in columns}}


def merge_as_aggregate(rows: DataFrame, keys: list[str], columns: Mapping[str, str], old: DataFrame | None = None, seq: str | None = None) -> DataFrame:
    """One row per key of old and new rows, each column by its rule.

    ``seq`` is the column that orders rows from old to new; without it, the rows of ``old`` are older than the others.
    A null in a key is a value like any other, so a rerun adds no rows. Rules of one side only are idempotent; sums are
    not, so a batch that the ledger lists must be left out (see unseen_batches). Ties within a sequence number go to
    the larger hash, so results do not depend on the order of rows.
    """
    new = rows.withColumn(SEQ, (F.lit(1) if seq is None else F.col(seq)).cast("long"))
    if old is not None:
        new = old.withColumn(SEQ, (F.lit(0) if seq is None else F.col(seq)).cast("long")).unionByName(new, allowMissingColumns=True)
    return new.groupBy(*keys).agg(*[RULES[r](c).alias(c) for c, r in columns.items()])


def unseen_batches(batch: DataFrame, ledger: DataFrame, key: str = "batch_id") -> DataFrame:
    """Rows of batches that the ledger does not list."""
    return batch.join(ledger.select(key), key, "left_anti")
