"""A table written in batches that become visible by a manifest.

A batch's rows are written aside. What is seen is what the last manifest lists as committed: a manifest is a small table of all batches and their
states, and each change writes the next one whole. So a batch appears at once or not at all, a writer that dies leaves a pending batch that
recover() takes back, and of two writers of one manifest the second fails and can try again. Purging merges old committed batches into one, so
manifests stay short.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ENTRY = "batch_id string, state string, path string, files array<string>, message string, created_at double, changed_at double"
PENDING, COMMITTED, FAILED, ROLLED_BACK = "pending", "committed", "failed", "rolled_back"


class Journal:
    """base: a folder that all executors share; schema: of the table's rows."""

    def __init__(self, spark: SparkSession, base: str, schema: StructType, clock=time.time):
        self.spark, self.base, self.schema, self.clock = spark, base.rstrip("/"), schema, clock

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last whole manifest; 0 without any."""
        folder = self._path(f"{self.base}/manifest")
        files = self._files(folder)
        if not files.exists(folder):
            return 0
        return max((int(s.getPath().getName()) for s in files.listStatus(folder) if files.exists(self._path(f"{s.getPath()}/_SUCCESS"))), default=0)

    def entries(self) -> list[dict]:
        """A row for each batch: as many as there are batches since the last purge."""
        at = self.version()
        return [r.asDict() for r in self.spark.read.schema(ENTRY).parquet(f"{self.base}/manifest/{at}").orderBy("created_at", "batch_id").collect()] if at else []

    def _write(self, before: int, entries: list[dict]) -> None:
        """The next manifest; fails if another has written it."""
        rows = [tuple(e[c.split()[0]] for c in ENTRY.split(", ")) for e in entries]
        self.spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("errorifexists").parquet(f"{self.base}/manifest/{before + 1}")

    def _change(self, batch_id: str, allowed: Sequence[str], **what) -> dict:
        at, entries = self.version(), self.entries()
        entry = next((e for e in entries if e["batch_id"] == batch_id), None)
        if entry is None:
            raise ValueError(f"no batch {batch_id}")
        if entry["state"] not in allowed:
            raise ValueError(f"batch {batch_id} is {entry['state']}")
        entry |= what | {"changed_at": self.clock()}
        self._write(at, entries)
        return entry

    def _delete(self, path: str) -> None:
        folder = self._path(path)
        self._files(folder).delete(folder, True)

    def begin(self, batch_id: str, rows: DataFrame, files: Sequence[str] = ()) -> None:
        """Writes a batch aside; it is pending, and seen by no reader."""
        at, entries = self.version(), self.entries()
        if any(e["batch_id"] == batch_id for e in entries):
            raise ValueError(f"batch {batch_id} is there already")
        path, now = f"{self.base}/rows/{uuid.uuid4().hex}", self.clock()
        self._write(at, [*entries, {"batch_id": batch_id, "state": PENDING, "path": path, "files": list(files), "message": None, "created_at": now, "changed_at": now}])
        rows.select(self.schema.fieldNames()).write.parquet(path)

    def commit(self, batch_id: str) -> None:
        """Makes a batch visible, if it was written whole."""
        entry = next((e for e in self.entries() if e["batch_id"] == batch_id), None)
        if entry and not self._files(self._path(entry["path"])).exists(self._path(f"{entry['path']}/_SUCCESS")):
            raise ValueError(f"batch {batch_id} isn't written whole")
        self._change(batch_id, (PENDING,), state=COMMITTED)

    def fail(self, batch_id: str, message: str) -> None:
        self._change(batch_id, (PENDING,), state=FAILED, message=message)

    def rollback(self, batch_id: str) -> list[str]:
        """Takes a batch back, a committed one too, and returns its files; its rows are deleted once no manifest lists them."""
        entry = self._change(batch_id, (PENDING, FAILED, COMMITTED), state=ROLLED_BACK)
        self._delete(entry["path"])
        return entry["files"]

    def pending(self) -> list[str]:
        return [e["batch_id"] for e in self.entries() if e["state"] == PENDING]

    def recover(self) -> list[str]:
        """Rolls back what a writer left pending; the ids of these batches."""
        left = self.pending()
        for batch_id in left:
            self.rollback(batch_id)
        return left

    def purge(self, max_age: float = 86400.0) -> int:
        """Forgets batches older than max_age seconds that aren't pending, and returns their number. Committed rows stay, in one batch."""
        at, entries, now = self.version(), self.entries(), self.clock()
        old = [e for e in entries if e["state"] != PENDING and e["created_at"] < now - max_age]
        if not old:
            return 0
        kept = [e for e in entries if e not in old]
        rows = [e["path"] for e in old if e["state"] == COMMITTED]
        if rows:
            path = f"{self.base}/rows/{uuid.uuid4().hex}"
            self.spark.read.schema(self.schema).parquet(*rows).write.parquet(path)
            kept.append({"batch_id": f"merged-{uuid.uuid4().hex}", "state": COMMITTED, "path": path, "files": sorted({f for e in old if e["state"] == COMMITTED for f in e["files"]}), "message": None, "created_at": now, "changed_at": now})
        self._write(at, kept)
        for e in old:
            self._delete(e["path"])
        return len(old)

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        paths = [e["path"] for e in self.entries() if e["state"] == COMMITTED]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
