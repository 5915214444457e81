"""Operation logs: state from events, filters, keyset pages, summaries."""

from __future__ import annotations

import re
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import TesseraError
from tessera.functions.canon import iso_utc

FILTERS = ("type", "status", "knowledge_base_id", "document_id", "request_id")
TYPES, STATUSES = ("ingestion", "query"), ("running", "succeeded", "failed", "cancelled")
PERIOD_HOURS = (1, 24, 168, 720)
_ID = re.compile(r"[1-9][0-9]{0,18}")
_TIME = re.compile(r"\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})")


def is_log_id(value: str) -> bool:
    return bool(_ID.fullmatch(value)) and int(value) <= 2**63 - 1


def parse_filters(given: dict[str, str]) -> dict[str, Any]:
    """Filters as a request gives them: known names only, limit 1 to 100 (default 20), times with a zone,
    from before to, a cursor that is a log id."""
    if unknown := set(given) - {*FILTERS, "from", "to", "cursor", "limit"}:
        raise TesseraError("INVALID_INPUT", f"unknown filter {min(unknown)}")
    out: dict[str, Any] = {k: given[k] for k in FILTERS if k in given}
    for name, allowed in (("type", TYPES), ("status", STATUSES)):
        if name in out and out[name] not in allowed:
            raise TesseraError("INVALID_INPUT", name)
    limit = given.get("limit", "20")
    if not limit.isascii() or not limit.isdigit() or not 1 <= int(limit) <= 100:
        raise TesseraError("INVALID_INPUT", "limit")
    out["limit"] = int(limit)
    for name in ("from", "to"):
        if name in given:
            if not _TIME.fullmatch(given[name]):
                raise TesseraError("INVALID_INPUT", name)
            try:
                out[name] = datetime.fromisoformat(given[name])
            except ValueError as e:
                raise TesseraError("INVALID_INPUT", name) from e
    if "from" in out and "to" in out and out["from"] >= out["to"]:
        raise TesseraError("INVALID_INPUT", "from is before to")
    if "cursor" in given:
        if not is_log_id(given["cursor"]):
            raise TesseraError("INVALID_INPUT", "cursor")
        out["cursor"] = int(given["cursor"])
    return out


def current_state(events: DataFrame) -> DataFrame:
    """One row per operation from its events (id, seq, status, at, ...): fields of the first event, state of
    the first that ends it; what comes later is ignored. An append-only log makes updates this way."""
    running = F.col("status") == "running"
    first = F.min_by(F.struct("type", "knowledge_base_id", "document_id", F.col("at").alias("started_at")), F.when(running, F.col("seq")))
    end = F.min_by(F.struct("status", "at"), F.when(~running, F.col("seq")))
    folded = events.groupBy("id").agg(first.alias("f"), end.alias("e"))
    return folded.select("id", "f.*", F.coalesce("e.status", F.lit("running")).alias("status"), F.col("e.at").alias("finished_at"), duration_ms(F.col("f.started_at"), F.col("e.at")).alias("duration_ms"))


def duration_ms(start: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000).cast("bigint")


def filtered(logs: DataFrame, filters: dict[str, Any], time: str = "started_at") -> DataFrame:
    """Conjunction of equalities, of from (inclusive) and to (exclusive), of id below the cursor. Each is a
    plain comparison, so the scan gets them all."""
    for name in FILTERS:
        if name in filters:
            logs = logs.where(F.col(name) == filters[name])
    if "from" in filters:
        logs = logs.where(F.col(time) >= filters["from"])
    if "to" in filters:
        logs = logs.where(F.col(time) < filters["to"])
    return logs.where(F.col("id") < filters["cursor"]) if "cursor" in filters else logs


def page(logs: DataFrame, filters: dict[str, Any], time: str = "started_at") -> DataFrame:
    """A page, newest id first, and one row more if there are further ones; ids order as numbers."""
    return filtered(logs, filters, time).orderBy(F.desc("id")).limit(filters.get("limit", 20) + 1)


def page_result(rows: list[Any], limit: int) -> dict[str, Any]:
    """Items, ids as text, and the cursor of the next page if there is one."""
    items = [r.asDict() | {"id": str(r["id"])} for r in rows[:limit]]
    return {"items": items, "nextCursor": items[-1]["id"] if len(rows) > limit else None}


def projected(logs: DataFrame) -> DataFrame:
    """Ids as text and times as ISO text in UTC, as a service shows them."""
    return logs.withColumns({"id": F.col("id").cast("string")} | {c: iso_utc(F.col(c)) for c in ("started_at", "finished_at") if c in logs.columns})


def scopes(logs: DataFrame) -> DataFrame:
    """Distinct knowledge bases and documents; a document may be null and then comes last."""
    return logs.where("knowledge_base_id IS NOT NULL").select("knowledge_base_id", "document_id").distinct().orderBy("knowledge_base_id", F.asc_nulls_last("document_id"))


def usage_total(value: Column) -> Column:
    """A sum that is null as soon as one part isn't known, or there is none."""
    return F.when((F.count(value) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.sum(value))


def latest_checkpoints(checkpoints: DataFrame, *keys: str) -> DataFrame:
    """The value last written under each key."""
    return checkpoints.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def with_prefix(rows: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    """Rows whose key begins so, every character of the prefix standing for itself; the scan gets the filter."""
    return rows.where(F.col(column).startswith(prefix))


def progress(events: DataFrame, *keys: str) -> DataFrame:
    """Completed events so far, event by event."""
    from pyspark.sql import Window

    return events.withColumn("completed", F.count("*").over(Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def within_period(logs: DataFrame, hours: int, time: str = "started_at") -> DataFrame:
    if hours not in PERIOD_HOURS:
        raise TesseraError("INVALID_INPUT", "period")
    return logs.where(F.col(time) >= F.current_timestamp() - F.make_interval(hours=F.lit(hours)))
