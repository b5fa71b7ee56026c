"""Rules over the events of a key in order of event time, as streams with state and event-time timers.

Events wait in the state of their key until the watermark is past them, so they meet the rule in order however they
arrived, and the result is that of a batch over the sorted events. What is held of a key is what its rule keeps (a few numbers) and the
events of one delay. It ends by a timer when the rule says that nothing can follow.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType, _parse_datatype_string


class Rule(NamedTuple):
    """What to do with the events of a key, each a list of longs: microseconds, then values.

    event(kept, event) gives (kept, rows): what is kept next (longs, or None), and rows of longs that come out. expires(kept) is the time, in
    microseconds, at which kept ends if no event before it comes, and ended(kept) the rows that come out then.
    """

    event: Callable[[list[int] | None, list[int]], tuple[list[int] | None, list[tuple]]]
    expires: Callable[[list[int]], int]
    ended: Callable[[list[int]], list[tuple]]


def through(rule: Rule, kept: list[int] | None, waiting: list[list[int]], mark: int) -> tuple[list[int] | None, list[list[int]], list[tuple]]:
    """(kept, events still waiting, rows) after all waiting events up to ``mark``, in order."""
    out, waiting = [], sorted(waiting)
    k = 0
    while k < len(waiting) and waiting[k][0] <= mark:
        event = waiting[k]
        if kept is not None and event[0] >= rule.expires(kept):
            out += rule.ended(kept)
            kept = None
        kept, rows = rule.event(kept, event)
        out += rows
        k += 1
    if kept is not None and rule.expires(kept) <= mark:
        out += rule.ended(kept)
        kept = None
    return kept, waiting[k:], out


def in_order(events: DataFrame, keys: Sequence[str], values: Sequence[str], rule: Rule, result: Sequence[str], delay: str, buckets: int = 1024) -> DataFrame:
    """Rows (keys, result) that the rule gives for the events of each key, when the watermark (``delay`` behind event_time) is past them.

    keys are strings or numbers; values are cast to longs (0 for null), and break ties of event_time in their order. Columns of
    result are longs. Events that come later than the delay are dropped, as by every operator with a watermark.

    Keys are dealt to buckets by their hash and those of a bucket share a call and a row of state, as a call costs far more than the events of most keys.
    A checkpoint belongs to one number of buckets. A task holds the waiting events of one bucket at a time, so more of them need less memory.
    """
    key = F.struct(*keys)
    kind = events.select(key.alias("k")).schema["k"].dataType
    columns = [f"_{k}" for k in range(len(values) + 1)]
    longs = [F.unix_micros("event_time"), *[F.coalesce(F.col(v).cast("long"), F.lit(0)) for v in values]]
    rows = events.withWatermark("event_time", delay).select("event_time", F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), F.to_json(key).alias("_key"), *[v.alias(c) for c, v in zip(columns, longs)])

    def step(bucket: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {}
        if not state.hasTimedOut:
            for part in parts:
                for k, event in zip(part["_key"].tolist(), part[columns].to_numpy("int64").tolist()):
                    held.setdefault(k, (None, []))[1].append(event)
        mark, left, found, due = state.getCurrentWatermarkMs(), {}, [], []
        for k, (kept, waiting) in held.items():
            kept, waiting, out = through(rule, kept, waiting, mark * 1000)
            found += [(k, *row) for row in out]
            if kept is not None or waiting:
                left[k] = kept, waiting
                due += [*([rule.expires(kept)] if kept is not None else []), *(w[0] for w in waiting[:1])]
        if left:
            state.update((json.dumps(left, separators=(",", ":")),))
            state.setTimeoutTimestamp(max(min(due) // 1000, mark + 1))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["_key", *result])

    out = ", ".join(["_key string", *[f"{r} long" for r in result]])
    found = rows.groupBy("_bucket").applyInPandasWithState(step, _struct(out), _struct("held string"), "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(F.from_json("_key", kind).alias("_k"), *result).select("_k.*", *result)


def _struct(text: str) -> StructType:
    return _parse_datatype_string(text)


CLOSED, TIMED_OUT = 1, 0


def session_rule(idle: int) -> Rule:
    """Sessions (start, end, events, ending) of events (time, closes, ...): a session ends with an event that closes it, or when ``idle`` microseconds pass without one."""

    def event(kept, e):
        start, _, n = kept or (e[0], e[0], 0)
        return (None, [(start, e[0], n + 1, CLOSED)]) if e[1] else ([start, e[0], n + 1], [])

    return Rule(event, lambda kept: kept[1] + idle, lambda kept: [(*kept, TIMED_OUT)])


def burst_rule(length: int) -> Rule:
    """First events (time, number) of bursts of events (time, number): those within ``length`` microseconds of the last one kept are dropped."""
    return Rule(lambda kept, e: ([e[0]], [(e[0], e[1])]) if kept is None else (kept, []), lambda kept: kept[0] + length, lambda kept: [])


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # so workers need not have this module
