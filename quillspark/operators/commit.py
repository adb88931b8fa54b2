"""One commit for several tables: staged files that a single manifest makes visible."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(Exception):
    """Another commit came first: run again from what the tables now hold."""


class Tables:
    """Parquet tables under one folder of any Hadoop file system.

    A commit writes its files into folders of their own and then puts manifest n + 1 in place by a rename that never
    replaces. Until then no reader sees anything of it; what a broken attempt staged is never referred to. A slot is committed
    once, whatever attempt does it: later attempts change nothing.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def manifest(self) -> dict:
        """number, tables (name to schema and folders) and slots of the newest commit."""
        folder = self._path("_manifests")
        fs = folder.getFileSystem(self.conf)
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        if not numbers:
            return {"number": 0, "tables": {}, "slots": {}}
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.root}/_manifests/{numbers[-1]:012d}.json").collect()))

    def read(self, name: str, schema: str | StructType | None = None, at: dict | None = None) -> DataFrame:
        """A table as of a manifest (the newest without one); without any commit of it an empty one of the schema."""
        known = (at or self.manifest())["tables"].get(name)
        if known is None:
            if schema is None:
                raise KeyError(name)
            return self.spark.createDataFrame([], schema)
        typed = StructType.fromJson(known["schema"])
        return self.spark.read.schema(typed).parquet(*(f"{self.root}/{p}" for p in known["folders"])) if known["folders"] else self.spark.createDataFrame([], typed)

    def commit(self, slot: str, attempt: int, appended: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None, base: dict | None = None) -> bool:
        """Whether the slot was committed now; False where it was before. Frames may read the tables that they replace.

        base: the manifest that the frames were computed from; if another commit has come since, this one is a Conflict.
        """
        base = base or self.manifest()
        if slot in base["slots"]:
            return False
        if self.manifest()["number"] != base["number"]:
            raise Conflict(base["number"] + 1)
        tables = dict(base["tables"])
        for name, df in [*appended.items(), *(replaced or {}).items()]:
            folder = f"{name}/{slot.replace(':', '')}-{attempt}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"{self.root}/{folder}")
            before = tables.get(name, {"folders": []})["folders"] if name in appended else []
            tables[name] = {"schema": json.loads(df.schema.json()), "folders": [*before, folder]}
        self._publish({"number": base["number"] + 1, "tables": tables, "slots": base["slots"] | {slot: attempt}})
        return True

    def _publish(self, manifest: dict) -> None:
        target, staged = self._path(f"_manifests/{manifest['number']:012d}.json"), self._path(f"_manifests/.{uuid.uuid4().hex}")
        out = staged.getFileSystem(self.conf).create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), self.conf) if staged.toUri().getScheme() else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        keep = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(staged, target, keep)
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(manifest["number"]) from e
            raise
