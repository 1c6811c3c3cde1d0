"""Stored tables that change at once or not at all.

Data goes into a folder of its own below ``<root>/<name>/data``; a numbered manifest, written last, says which folders make
the table.  Readers take the newest whole manifest, so a job that dies anywhere leaves the table as it was, and a reader that
has begun keeps its files.  A table may be split into parts by a column; replacing or upserting rows writes the parts
that these rows fall into and takes over the folders of the others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.rel import upsert

#: The part of rows whose column is null, as Spark names its folder.
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


class Changed(RuntimeError):
    """Another writer put down the manifest that this one was about to write."""


class Tables:
    """Tables below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, path: str) -> list[str]:
        at = self._path(path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _get(self, path: str) -> dict | None:
        stream = self._fs.open(self._path(path))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:  # its writer died within it
            return None

    def _numbers(self, name: str) -> list[int]:
        return [int(n[:-5]) for n in self._names(f"{self.root}/{name}/manifest") if n.endswith(".json")]

    def manifest(self, name: str) -> dict | None:
        """The newest whole manifest: number, schema, parts (part -> folder) and note; None where there is no table."""
        for number in sorted(self._numbers(name), reverse=True):
            if (found := self._get(f"{self.root}/{name}/manifest/{number:010d}.json")) is not None:
                return found | {"number": number}
        return None

    def part(self, value: str | None) -> str:
        """The part of rows with a value, as Spark names its folder."""
        return NULL_PART if value is None else self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)

    def exists(self, name: str) -> bool:
        return self.manifest(name) is not None

    def names(self) -> list[str]:
        return [n for n in self._names(self.root) if self.exists(n)]

    def read(self, name: str, parts: Sequence[str] | None = None) -> DataFrame:
        """The table, or some parts of it; a table that was never written raises LookupError."""
        m = self.manifest(name)
        if m is None:
            raise LookupError(f"no table {name} below {self.root}")
        schema = T.StructType.fromJson(m["schema"])
        folders = [f"{self.root}/{name}/data/{at}" for p, at in sorted(m["parts"].items()) if parts is None or p in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _stage(self, name: str, df: DataFrame, by: str | None) -> dict[str, str]:
        """Write rows that no manifest names yet; the folder of each part."""
        version = uuid.uuid4().hex
        at = f"{self.root}/{name}/data/{version}"
        if by is None:
            df.write.parquet(at)
            return {"": version}
        df.withColumn("_part", F.col(by).cast("string")).repartition("_part", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.partitionBy("_part").parquet(at)
        return {n[len("_part=") :]: f"{version}/{n}" for n in self._names(at) if n.startswith("_part=")}

    def _commit(self, name: str, schema: T.StructType, parts: dict[str, str], note: dict, seen: int | None) -> None:
        number = (seen or 0) + 1
        stale = [n for n in self._numbers(name) if n >= number]
        if stale and any(self._get(f"{self.root}/{name}/manifest/{n:010d}.json") is not None for n in stale):
            raise Changed(f"{name} was changed while it was written")
        number = max([number - 1, *stale]) + 1  # over what a dead writer left
        text = json.dumps({"schema": json.loads(schema.json()), "parts": parts, "note": note})
        try:
            stream = self._fs.create(self._path(f"{self.root}/{name}/manifest/{number:010d}.json"), False)
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Changed(f"{name} was changed while it was written") from None
            raise
        stream.write(bytearray(text, "utf-8"))
        stream.close()

    def write(self, name: str, df: DataFrame, by: str | None = None, note: dict | None = None) -> None:
        """Replace the whole table."""
        now = self.manifest(name)
        self._commit(name, df.schema, self._stage(name, df, by), note or {}, now and now["number"])

    def replace_parts(self, name: str, df: DataFrame, by: str, note: dict | None = None, drop: Sequence[str] = ()) -> list[str]:
        """Replace the parts that ``df`` has rows of, remove those of the values ``drop``, keep the others; the parts replaced."""
        now, drop = self.manifest(name), {self.part(v) for v in drop}
        new = self._stage(name, df, by)
        held = {p: at for p, at in (now["parts"] if now else {}).items() if p not in drop}
        self._commit(name, df.schema, held | new, (now or {}).get("note", {}) | (note or {}), now and now["number"])
        return sorted(new)

    def upsert(self, name: str, df: DataFrame, keys: Sequence[str], by: str, overwrite: bool = True) -> list[str]:
        """Insert rows, a row of the table with the same keys (nulls equal) giving way; only parts that ``df`` falls into are
        read and written.  A key must not move from part to part.  The parts written."""
        now = self.manifest(name)
        if now is None:
            return self.replace_parts(name, df, by)
        staged = self._stage(name, df, by)
        fresh = self.spark.read.schema(df.schema).parquet(*[f"{self.root}/{name}/data/{at}" for at in staged.values()]) if staged else df.limit(0)
        merged = upsert(self.read(name, list(staged)), fresh, keys, overwrite)
        new = self._stage(name, merged, by)
        self._commit(name, df.schema, now["parts"] | new, now["note"], now["number"])
        for folder in {at.split("/")[0] for at in staged.values()}:
            self._fs.delete(self._path(f"{self.root}/{name}/data/{folder}"), True)
        return sorted(new)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def expire(self, name: str, keep: int = 1) -> int:
        """Delete all but the newest ``keep`` manifests and the folders that none of the rest names; folders deleted.

        For times without writers and old readers: data of a job that is under way has no manifest yet.
        """
        numbers = sorted(self._numbers(name))
        for n in numbers[: max(0, len(numbers) - keep)]:
            self._fs.delete(self._path(f"{self.root}/{name}/manifest/{n:010d}.json"), False)
        held = [self._get(f"{self.root}/{name}/manifest/{n:010d}.json") or {"parts": {}} for n in self._numbers(name)]
        used = {at for m in held for at in m["parts"].values()}
        gone = 0
        for version in self._names(f"{self.root}/{name}/data"):
            inside = [f"{version}/{n}" for n in self._names(f"{self.root}/{name}/data/{version}") if n.startswith("_part=")]
            for at in inside or [version]:
                if at not in used:
                    self._fs.delete(self._path(f"{self.root}/{name}/data/{at}"), True)
                    gone += 1
            if inside and not any(at in used for at in inside):
                self._fs.delete(self._path(f"{self.root}/{name}/data/{version}"), True)
        return gone
