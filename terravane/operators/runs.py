"""Run records, layer runs and phases (S16, Q09, Q10, GA1, GA3, R04, R05).

Run records are rows of one Parquet table, written when a run starts and again when it ends; the last row of a run_id
holds. Hooks run after a success and never fail the run.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.operators import governance, ranking
from terravane.sources import tables

RUN = "run_id string, source string, resolution int, status string, started_at timestamp, finished_at timestamp, row_count long, rejected long, duration_s double, notes string"
FIELDS = [f.split()[0] for f in RUN.split(", ")]


@dataclass
class RunLog:
    """The table of run records at ``path``."""

    spark: SparkSession
    path: str
    hooks: list[Callable[[dict], None]] = field(default_factory=list)

    def write(self, record: dict) -> None:
        row = tuple(record.get(k) for k in FIELDS)
        tables.append_rows(self.spark.createDataFrame([row], RUN).withColumn("written_at", F.lit(dt.datetime.now(dt.timezone.utc))), self.path)

    def table(self) -> DataFrame:
        """The last record of each run."""
        if not tables.exists(self.spark, self.path):
            return self.spark.createDataFrame([], RUN)
        return ranking.latest(self.spark.read.parquet(self.path), "run_id", "written_at", "status").select(*FIELDS)

    @contextmanager
    def run(self, source: str, resolution: int | None = None):
        """running, then success or failed with counts, notes and duration; an error is raised again."""
        record = {"run_id": str(uuid.uuid4()), "source": source, "resolution": resolution, "status": "running", "started_at": dt.datetime.now(dt.timezone.utc), "row_count": 0, "rejected": 0, "notes": ""}
        self.write(record)
        try:
            yield record
            record["status"] = "success"
        except BaseException as x:
            record["status"], record["notes"] = "failed", str(x)[:1000]
            raise
        finally:
            record["finished_at"] = dt.datetime.now(dt.timezone.utc)
            record["duration_s"] = (record["finished_at"] - record["started_at"]).total_seconds()
            self.write(record)
        for hook in self.hooks:
            try:
                hook(record)
            except Exception as x:  # noqa: BLE001  a hook must not fail the run
                record["notes"] = f"hook: {x}"[:1000]
                self.write(record)


@dataclass(frozen=True)
class Layer:
    """Where a layer's rows come from, how they are parsed and what they must be; ``target`` is its table."""

    name: str
    fetch: Callable[[SparkSession], DataFrame]
    parse: Callable[[DataFrame], DataFrame]
    contract: governance.Contract
    target: str


def run_layer(log: RunLog, layer: Layer, letters: str, fresh: bool = False, ttl_hours: float = 24, resolution: int | None = None, now: dt.datetime | None = None) -> int:
    """Skip guard, fetch, parse, contract, dead letters, truncate and load, run record; the rows loaded, 0 if skipped."""
    now = now or dt.datetime.now()
    if governance.should_skip(log.table(), layer.name, resolution, now, ttl_hours, fresh):
        return 0
    with log.run(layer.name, resolution) as record:
        clean, rejects = governance.split(layer.parse(layer.fetch(log.spark)), layer.contract, record["run_id"], layer.name)
        record["rejected"] = tables.append_letters(rejects, letters)
        record["row_count"] = tables.truncate_and_load(clean, layer.target)
    return record["row_count"]


def run_all(jobs: dict[str, Callable[[], int]]) -> dict[str, int]:
    """Run every job in order; failures are gathered and raised as one error when all have had their turn."""
    done, failed = {}, {}
    for name, job in jobs.items():
        try:
            done[name] = job()
        except Exception as x:  # noqa: BLE001  the others still run
            failed[name] = x
    if failed:
        raise RuntimeError("failed: " + "; ".join(f"{k}: {x}" for k, x in failed.items()))
    return done


#: A phase and those it waits for.
PHASES = {"power": (), "cells": ("power",), "scoring": ("cells",), "stakeholder": ("cells",), "lineage": ()}


def run_phases(jobs: dict[str, Callable[[], int]], phases: dict[str, tuple[str, ...]] | None = None, only: list[str] | None = None) -> dict[str, int | str]:
    """Each phase after those it waits for: its rows, or "failed: ..."; a failed phase still releases those that wait."""
    phases = PHASES if phases is None else phases
    left, out = [p for p in phases if only is None or p in only], {}
    unknown = set(only or ()) - set(phases)
    if unknown:
        raise ValueError(f"unknown phases: {sorted(unknown)}")
    while left:
        ready = [p for p in left if not any(d in left for d in phases[p])]
        if not ready:
            raise ValueError(f"phases wait for one another: {left}")
        for p in ready:
            try:
                out[p] = jobs[p]()
            except Exception as x:  # noqa: BLE001  reported, and the phases that wait are released
                out[p] = f"failed: {x}"
            left.remove(p)
    return out


def run_checks(checks: list[DataFrame], path: str) -> tuple[DataFrame, dict, int]:
    """(all checks, their summary, exit code): run, persist and summarise; the code is 1 if an error failed."""
    found = checks[0]
    for c in checks[1:]:
        found = found.unionByName(c)
    spark = found.sparkSession
    batch = uuid.uuid4().hex
    tables.append_rows(found.withColumn("batch", F.lit(batch)).withColumn("checked_at", F.current_timestamp()), path)
    kept = spark.read.parquet(path).filter(F.col("batch") == batch).select(*found.columns)
    summary = governance.summarise(kept).first().asDict()
    return kept, summary, int(summary["errors"] > 0)


def health(spark: SparkSession, frames: dict[str, DataFrame]) -> dict[str, int | str]:
    """Rows of each frame, or what reading it says."""
    out: dict[str, int | str] = {}
    for name, df in frames.items():
        try:
            out[name] = df.count()
        except Exception as x:  # noqa: BLE001  the report is the result
            out[name] = f"{type(x).__name__}"
    return out


class Cached:
    """Frames kept in memory for ``ttl`` seconds by name; an older one is made again."""

    def __init__(self, ttl: float = 300, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self.held = ttl, clock, {}

    def get(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        now = self.clock()
        at, df = self.held.get(name, (None, None))
        if at is None or now - at > self.ttl:
            if df is not None:
                df.unpersist()
            df = make().cache()
            self.held[name] = (now, df)
        return df
