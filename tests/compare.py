"""Rows of a query and of its oracle, comparable whatever their order."""

import datetime
import decimal
from collections import Counter


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def spark_rows(df, columns):
    return Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())


def duck_rows(con, sql, columns):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    return Counter(tuple(plain(r[k]) for k in at) for r in result.fetchall())
