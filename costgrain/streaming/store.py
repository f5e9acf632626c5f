"""Tables in folders that become visible together.

A writer puts new files in folders of their own and then commits: one small file, a
manifest, names the folders of every table. It appears under its number by a rename
that only one writer can win, so readers see all of a commit or nothing of it, and a run that
dies leaves only folders that nobody names.

A table may be dealt to buckets by the first digits of a hash. Readers then name
the buckets they need and open no others, and a writer replaces whole buckets and
leaves the rest as they are. The manifest has an entry for each bucket's folders.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifests that are kept: a reader may be a few commits behind.
KEPT = 8


def bucket_of(value: Column, digits: int) -> Column:
    """The bucket of a value: the first hex digits of its hash; null is a value like any other."""
    return F.substring(F.sha2(F.coalesce(value.cast("string"), F.lit("\0")), 256), 1, digits)


class Store:
    """Tables below ``folder``, which driver and executors reach; one writer commits at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _names(self, name: str) -> list[str]:
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._files.listStatus(path)) if self._files.exists(path) else []

    def snapshot(self) -> dict:
        """The last manifest: version, the folders of each bucket of each table, and notes."""
        done = [n for n in self._names("_commits") if n.endswith(".json")]
        if not done:
            return {"version": 0, "tables": {}, "notes": {}}
        stream = self._files.open(self._path(f"_commits/{done[-1]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, schema: str, buckets: list[str] | None = None, at: dict | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets only, as the last manifest (or ``at``) has it."""
        table = (at or self.snapshot())["tables"].get(name, {})
        wanted = sorted(table) if buckets is None else sorted(set(buckets) & set(table))
        paths = [f"{self.folder}/{p}" + (f"/bucket={b}" if b else "") for b in wanted for p in table[b]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, name: str, rows: DataFrame, by: Column | None = None, sort: list[str] = ()) -> dict[str, list[str]]:
        """Write rows to a folder that no manifest names yet, dealt by the bucket ``by``; what ``commit`` takes."""
        path = f"{name}/{uuid.uuid4().hex}"
        if by is None:
            rows.write.parquet(f"{self.folder}/{path}")
            return {"": [path]}
        dealt = rows.withColumn("bucket", by)
        # Salted by row, so that a bucket with most rows is several tasks' work and several files.
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(8))
        dealt.repartition("bucket", salt).sortWithinPartitions("bucket", *sort).write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
        return {n.removeprefix("bucket="): [path] for n in self._names(path) if n.startswith("bucket=")}

    def commit(self, before: dict, add: dict[str, dict] | None = None, replace: dict[str, tuple[list[str], dict]] | None = None, notes: dict | None = None) -> dict:
        """Make folders visible on top of the manifest ``before``; an error if another one came since.

        ``add`` gives buckets more folders; ``replace`` names for a table (buckets that go, what comes for them).
        """
        tables = {n: {b: list(p) for b, p in t.items()} for n, t in before["tables"].items()}
        for name, (gone, new) in (replace or {}).items():
            tables[name] = {b: p for b, p in tables.get(name, {}).items() if b not in set(gone)}
            add = (add or {}) | {name: new}
        for name, new in (add or {}).items():
            for b, paths in new.items():
                tables.setdefault(name, {}).setdefault(b, []).extend(paths)
        after = {"version": before["version"] + 1, "tables": tables, "notes": before["notes"] | (notes or {})}
        temporary, final = self._path(f"_commits/.{uuid.uuid4().hex}"), self._path(f"_commits/{after['version']:012d}.json")
        stream = self._files.create(temporary)
        try:
            stream.write(bytearray(json.dumps(after).encode()))
        finally:
            stream.close()
        if self._files.exists(final) or not self._files.rename(temporary, final):
            self._files.delete(temporary, False)
            raise RuntimeError(f"another writer has committed version {after['version']}")
        for old in [n for n in self._names("_commits") if n.endswith(".json")][:-KEPT]:
            self._files.delete(self._path(f"_commits/{old}"), False)
        return after

    def clean(self) -> int:
        """Remove folders that no kept manifest names, what replaced buckets and runs that died have left; only
        while nobody writes. Returns how many went."""
        named = set()
        for n in self._names("_commits"):
            if n.endswith(".json"):
                stream = self._files.open(self._path(f"_commits/{n}"))
                kept = json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                stream.close()
                named |= {p for t in kept["tables"].values() for paths in t.values() for p in paths}
        gone = 0
        for name in self._names(""):
            for part in self._names(name) if not name.startswith("_") else []:
                if f"{name}/{part}" not in named:
                    self._files.delete(self._path(f"{name}/{part}"), True)
                    gone += 1
        return gone
