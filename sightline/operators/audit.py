"""Versioned snapshots with undo, and an audit table of operations."""

from __future__ import annotations

import datetime as dt
import json
import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.plans.storage import create_new, exists

MAX_SNAPSHOTS = 10
UNDO = "Undo"
SAVE, RETIRE, RECORD, CLEAR = "save", "undo", "record", "clear"

#: Tries at one number of the log before the next is taken: its writer has died.
TRIES = 8

ENTRY = (
    "seq int, at timestamp, operation string, columns array<string>, rows_changed bigint, rows_before bigint, "
    "rows_after bigint, cols_before int, cols_after int, details string"
)
EVENT = f"{ENTRY}, action string, version int, place string"


class AuditTrail:
    """History of one table, kept under a folder that every executor can reach.

    A log of numbered files is the only state: saved versions, undone versions, recorded operations. A number
    is taken by creating its file, which only one writer can, so trails of several sessions on one folder see and
    continue each other's work; whoever finds a number taken reads the log again first. Snapshots are Parquet
    folders that are written before the log names them. The last ten that were not undone are live. The
    log is small (a line for each operation) and is replayed on the driver; snapshots never pass it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _log(self) -> DataFrame:
        path = f"{self.folder}/log"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).json(path)

    def _history(self) -> DataFrame:
        """The log since it was last cleared."""
        log = self._log()
        start = log.agg(F.coalesce(F.max(F.when(F.col("action") == CLEAR, F.col("seq"))), F.lit(0)).alias("_from"))
        return log.join(F.broadcast(start), F.col("seq") > F.col("_from")).drop("_from")

    def _state(self) -> tuple[int, dict[int, str], dict[int, str]]:
        """The last number, the live versions with their places, oldest first, and what became of every version."""
        last, live, fate = 0, {}, {}
        for e in sorted(self._log().select("seq", "action", "version", "place").collect(), key=lambda e: e["seq"]):
            last = e["seq"]
            if e["action"] == CLEAR:
                live, fate = {}, {}
            elif e["action"] == SAVE:
                live[e["seq"]], fate[e["seq"]] = e["place"], SAVE
                if len(live) > MAX_SNAPSHOTS:
                    oldest = next(iter(live))
                    del live[oldest]
                    fate[oldest] = "expire"
            elif e["action"] == RETIRE:
                live.pop(e["version"], None)
                fate[e["version"]] = RETIRE
        return last, live, fate

    def _publish(self, make: Callable[[dict[int, str]], dict | None]) -> dict | None:
        """Add the event that ``make`` builds from the live versions, under the next free number."""
        tried, times = 0, 0
        while True:
            last, live, _ = self._state()
            number = last + 1
            if number <= tried and times >= TRIES:
                number = tried + 1
            event = make(live)
            if event is None:
                return None
            event = {"seq": number, "at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="microseconds"), **event}
            if create_new(self.spark, f"{self.folder}/log/{number:012d}.json", json.dumps(event) + "\n"):
                return event
            tried, times = number, times + 1 if number == tried else 1
            time.sleep(0.01 * times)

    def save_snapshot(self, df: DataFrame) -> int:
        """Keep a copy and return its version; beyond ten the oldest stops being live."""
        place = f"snapshot-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{place}")
        return self._publish(lambda _: {"action": SAVE, "place": place})["seq"]

    def can_undo(self) -> bool:
        return bool(self._state()[1])

    def undo(self) -> DataFrame | None:
        """The newest live snapshot, which is retired, or None. Two writers never get the same one."""

        def newest(live: dict[int, str]) -> dict | None:
            if not live:
                return None
            version = max(live)
            restored = self.spark.read.parquet(f"{self.folder}/{live[version]}")
            entry = operation(UNDO, (), 0, restored.count(), 0, len(restored.columns), "Reverted to previous snapshot", 0)
            return {"action": RETIRE, "version": version, "place": live[version], **entry}

        event = self._publish(newest)
        return None if event is None else self.spark.read.parquet(f"{self.folder}/{event['place']}")

    def record(
        self,
        name: str,
        columns: Sequence[str] = (),
        rows_before: int = 0,
        rows_after: int = 0,
        cols_before: int = 0,
        cols_after: int = 0,
        details: str = "",
        changed: int | None = None,
    ) -> None:
        entry = operation(name, columns, rows_before, rows_after, cols_before, cols_after, details, changed)
        self._publish(lambda _: {"action": RECORD, **entry})

    def clear(self) -> None:
        """Forget the history: the log goes on, but nothing before this point counts."""
        self._publish(lambda _: {"action": CLEAR})

    def export_log(self) -> DataFrame:
        names = [field.split()[0] for field in ENTRY.split(", ")]
        return self._history().where(F.col("operation").isNotNull()).select(*names).orderBy("seq")

    def versions(self) -> DataFrame:
        """(version, action): what became of each snapshot: save (live), undo or expire."""
        return self.spark.createDataFrame(list(self._state()[2].items()), "version int, action string")

    def summary(self) -> DataFrame:
        return summarise_log(self.export_log())


def operation(
    name: str,
    columns: Sequence[str],
    rows_before: int,
    rows_after: int,
    cols_before: int,
    cols_after: int,
    details: str,
    changed: int | None,
) -> dict:
    moved = abs(rows_before - rows_after) if changed is None else changed
    return {
        "operation": name, "columns": list(columns), "rows_changed": moved, "rows_before": rows_before,
        "rows_after": rows_after, "cols_before": cols_before, "cols_after": cols_after, "details": details,
    }


def summarise_log(log: DataFrame) -> DataFrame:
    """total_operations, total_rows_affected, operations, first_operation, last_operation"""
    done = F.filter(F.array_sort(F.collect_list(F.struct("seq", "operation"))), lambda e: e["operation"] != UNDO)
    return log.agg(
        F.count(F.when(F.col("operation") != UNDO, 1)).alias("total_operations"),
        F.coalesce(F.sum("rows_changed"), F.lit(0)).alias("total_rows_affected"),
        F.array_join(F.transform(done, lambda e: e["operation"]), ", ").alias("operations"),
        F.min_by("at", "seq").alias("first_operation"),
        F.max_by("at", "seq").alias("last_operation"),
    )
