"""Ingestion jobs: an immutable input, stages that are kept and taken over on a retry, events, a flag to stop."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import TesseraError
from tessera.functions.canon import content_hash
from tessera.sources import files

STAGES = ("normalize", "sections", "chunks", "enrichment", "graph", "indexing", "embedding", "storage")
VERSION = 1


class Job:
    """States: running, interrupted (running without anyone at work on it), failed, succeeded."""

    def __init__(self, spark: SparkSession, root: str, job_id: str | None = None, given: Any = None):
        self.spark, self.id = spark, (job_id or str(uuid.uuid4())).lower()
        uuid.UUID(self.id)
        self.folder = f"{root.rstrip('/')}/{self.id}"
        self.attempt = uuid.uuid4().hex
        known = files.read(spark, f"{self.folder}/input.json")
        if known is None:
            if given is None:
                raise TesseraError("NOT_FOUND", "no such job")
            files.create(spark, f"{self.folder}/input.json", json.dumps({"fingerprint": content_hash([VERSION, given]), "input": given}, ensure_ascii=False))
        elif given is not None and json.loads(known)["fingerprint"] != content_hash([VERSION, given]):
            raise TesseraError("CONFLICT", "the job has another input")
        self.input = json.loads(files.read(spark, f"{self.folder}/input.json"))["input"]

    def event(self, **fields: Any) -> None:
        files.put(self.spark, f"{self.folder}/events/{time.time_ns():020d}.json", json.dumps(fields))

    def events(self) -> list[dict[str, Any]]:
        return [json.loads(files.read(self.spark, f"{self.folder}/events/{n}")) for n in files.names(self.spark, f"{self.folder}/events")]

    def state(self, active: bool = False) -> dict[str, Any]:
        if (text := files.read(self.spark, f"{self.folder}/end.json")) is not None:
            return json.loads(text)
        return {"status": "running" if active else "interrupted"}

    def cancel(self) -> None:
        files.put(self.spark, f"{self.folder}/cancel", "1")

    def check(self) -> None:
        if files.read(self.spark, f"{self.folder}/cancel") is not None:
            raise TesseraError("ABORTED", "the job was cancelled")

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows: those kept by an earlier attempt, else made and kept now."""
        if name not in STAGES:
            raise TesseraError("INVALID_OPTIONS", name)
        self.check()
        began, path = time.time(), f"{self.folder}/stages/{name}"
        reused = files.read(self.spark, f"{path}/_SUCCESS") is not None
        if not reused:
            make().write.mode("overwrite").parquet(path)
        out = self.spark.read.parquet(path)
        self.event(stage=name, status="succeeded", reused=reused, durationMs=round(1000 * (time.time() - began)))
        return out

    def restart(self) -> None:
        for name in ("end.json", "cancel"):
            files.remove(self.spark, f"{self.folder}/{name}")

    def finish(self, **result: Any) -> dict[str, Any]:
        files.put(self.spark, f"{self.folder}/end.json", json.dumps(result))
        return result

    def ndjson(self) -> str:
        """The job's course as lines of JSON: start, stages, and result or error."""
        end = self.state()
        closing = [{"type": "result", **end}] if end["status"] == "succeeded" else [{"type": "error", **end}] if end["status"] == "failed" else []
        return "".join(json.dumps(x) + "\n" for x in ({"type": "start", "id": self.id}, *({"type": "stage", **e} for e in self.events()), *closing))


def read_ndjson(text: str) -> dict[str, Any]:
    """The result at the end of a job's lines; an error if the lines stop before one."""
    for line in reversed([x for x in text.split("\n") if x.strip()]):
        value = json.loads(line)
        if value["type"] == "result":
            return value
        if value["type"] == "error":
            raise TesseraError(value.get("code", "INVALID_RESPONSE"), "the job failed")
    raise TesseraError("INVALID_RESPONSE", "the stream was interrupted")
