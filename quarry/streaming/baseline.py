"""Confirmed snapshots of a day as a stream: each confirmation against the one before it, kept for a limited time."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "day date, at timestamp, kind string, entity string, field string, before string, after string"
STATE = "at timestamp, rows string"
#: Days for which a confirmed snapshot is kept.
KEPT_DAYS = 60


def confirmations(rows: DataFrame) -> DataFrame:
    """(day, at, rows): rows (day, at, entity, fields) of a confirmed day as one snapshot, of which fields is a map.

    For a stream, send a snapshot of a day as one row; this is for tables, and for foreachBatch.
    """
    entries = F.map_from_entries(F.collect_list(F.struct("entity", "fields")))
    return rows.groupBy("day", "at").agg(F.to_json(entries).alias("rows"))


def changes(before: dict, after: dict) -> Iterator[tuple[str, str, str | None, str | None, str | None]]:
    """(kind, entity, field, before, after) of two snapshots, each entity -> fields."""
    for entity in sorted(before.keys() | after.keys()):
        old, new = before.get(entity), after.get(entity)
        if old is None or new is None:
            yield ("created" if old is None else "deleted"), entity, None, None, None
            continue
        for field in sorted(old.keys() | new.keys()):
            if old.get(field) != new.get(field):
                yield "updated", entity, field, old.get(field), new.get(field)


def confirmed_changes(snapshots: DataFrame, kept_days: int = KEPT_DAYS, late: str = "1 day") -> DataFrame:
    """Events (EVENT) of confirmations (day, at, rows): rows is a JSON object of entities and their fields.

    A day's first confirmation emits one event, confirmed; a later one emits what differs from the one before it. The
    snapshot of a day is forgotten once the watermark is kept_days past its confirmation, so a confirmation after that
    is a first one again. Confirmations of one batch are taken in the order of at; one that is older than the kept
    snapshot is emitted as stale and changes nothing.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.getOption
        out = []
        for at, rows in sorted(((r.at, r.rows or "{}") for b in batches for r in b.itertuples(index=False)), key=lambda x: x[0]):
            moment = pd.Timestamp(at)
            if kept is None:
                out.append((key[0], moment, "confirmed", None, None, None, None))
            elif moment < pd.Timestamp(kept[0]):
                out.append((key[0], moment, "stale", None, None, None, None))
                continue
            else:
                out += [(key[0], moment, *c) for c in changes(json.loads(kept[1]), json.loads(rows))]
            kept = (moment.to_pydatetime(), rows)
        state.update(kept)
        state.setTimeoutTimestamp(int(pd.Timestamp(kept[0]).timestamp() * 1000) + kept_days * 86_400_000)
        yield pd.DataFrame(out, columns=[x.split()[0] for x in EVENT.split(", ")])

    marked = snapshots.withWatermark("at", late).select("day", "at", "rows")
    return marked.groupBy("day").applyInPandasWithState(run, EVENT, STATE, "append", "EventTimeTimeout")
