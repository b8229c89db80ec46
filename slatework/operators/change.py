"""Keyed change: diffs, upserts, conditional updates and cascades over plain Parquet tables.

Tables are never overwritten in place: ``TableStore`` writes a new version and moves a pointer.
"""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def diff(current: DataFrame, indexed: DataFrame, key: str, *hashes: str) -> DataFrame:
    """key, status (unchanged, changed, new, deleted): one full outer join on the key."""
    c = current.select(F.col(key), F.struct(*hashes).alias("now"))
    i = indexed.select(F.col(key), F.struct(*hashes).alias("then"))
    status = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now").eqNullSafe(F.col("then")), "unchanged").otherwise("changed")
    return c.join(i, key, "full_outer").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], preserve: list[str] = (), version: str | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` by key; ``preserve`` columns keep the old value where there is a row.

    Of several new rows with a key the one with the largest ``version`` (else the largest row) counts. Columns that
    ``new`` lacks keep the old value.
    """
    first = [F.col(version).alias("__version")] if version else []
    latest = new.groupBy(*keys).agg(F.max(F.struct(*first, *[c for c in new.columns if c not in keys])).alias("n"))
    o = old.select(*keys, F.struct(*[c for c in old.columns if c not in keys]).alias("o"))
    joined = o.join(latest, keys, "full_outer")

    def value(c: str) -> Column:
        if c not in new.columns:
            return F.col(f"o.{c}")
        both = F.when(F.col("o").isNotNull(), F.col(f"o.{c}")) if c in preserve else F.when(F.col("n").isNull(), F.col(f"o.{c}"))
        return both.otherwise(F.col(f"n.{c}"))

    return joined.select(*[F.col(c) if c in keys else value(c).alias(c) for c in old.columns])


def update_where(table: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Set columns of the rows that meet the condition; null conditions leave a row as it is."""
    met = F.coalesce(condition, F.lit(False))
    return table.select(*[F.when(met, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """The rows that do not meet the condition."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def cascade(parent: DataFrame, key: str, doomed: DataFrame, children: list[tuple[str, DataFrame, str, str]]) -> dict[str, DataFrame]:
    """Delete ``doomed`` (column key) from the parent and down a chain of (name, table, foreign key, own key)."""
    out = {"parent": parent.join(doomed.select(key), key, "left_anti")}
    above = doomed.select(F.col(key).alias("__gone"))
    for name, table, foreign, own in children:
        out[name] = table.join(above, table[foreign] == above["__gone"], "left_anti")
        above = table.join(above, table[foreign] == above["__gone"], "left_semi").select(F.col(own).alias("__gone"))
    return out


class TableStore:
    """Versioned Parquet tables below one folder: a write is a new version, an append a folder beside it, readers take the latest.

    A folder counts once Spark has committed it, so a job that dies while writing leaves the former version in force. A
    table may be kept in parts (one per codebase), each with versions of its own: changing one part touches no other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _folders(self, name: str) -> list[str]:
        fs, path = self._fs()
        root = path(f"{self.path}/{name}")
        return [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []

    def _committed(self, name: str) -> dict[int, list[str]]:
        """Folders of each version: the write, then its appends in order."""
        fs, path = self._fs()
        found: dict[int, list[tuple[int, str]]] = {}
        for f in self._folders(name):
            m = re.fullmatch(r"v(\d+)(?:-(\d+))?", f)
            if m and fs.exists(path(f"{self.path}/{name}/{f}/_SUCCESS")):
                found.setdefault(int(m[1]), []).append((int(m[2] or 0), f"{self.path}/{name}/{f}"))
        return {v: [f for _, f in sorted(some)] for v, some in sorted(found.items()) if min(some)[0] == 0}

    def versions(self, name: str) -> list[int]:
        """Committed versions of a table, ascending."""
        return list(self._committed(name))

    def exists(self, name: str) -> bool:
        """Whether any version was committed, of the table or of a part."""
        return bool(self.versions(name)) or bool(self.parts(name))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """The latest version, or one of the past."""
        known = self._committed(name)
        return self.spark.read.parquet(*known[max(known) if version is None else version])

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        """Commit a new version and return it."""
        version = max(self._numbers(name), default=0) + 1
        out = df.write.partitionBy(partition_by) if partition_by else df.write
        out.parquet(f"{self.path}/{name}/v{version}")
        return self.read(name, version)

    def _numbers(self, name: str) -> list[int]:
        """Versions begun, committed or not."""
        return [int(m[1]) for m in (re.match(r"v(\d+)", f) for f in self._folders(name)) if m]

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to the latest version without reading or copying it, and return the table; nothing is compared."""
        known = self._committed(name)
        if not known:
            return self.write(name, df)
        version = max(known)
        taken = [int(m[1]) for m in (re.fullmatch(rf"v{version}-(\d+)", f) for f in self._folders(name)) if m]
        df.write.parquet(f"{self.path}/{name}/v{version}-{max(taken, default=0) + 1}")
        return self.read(name)

    def upsert(self, name: str, new: DataFrame, keys: list[str], **options) -> DataFrame:
        """Keyed upsert as a new version; the first one is what is given."""
        return self.write(name, upsert(self.read(name), new, keys, **options) if self.exists(name) else new)

    @staticmethod
    def part(name: str, of: str) -> str:
        """The name of a table's part."""
        return f"{name}/part-{quote(of, safe='')}"

    def parts(self, name: str) -> list[str]:
        """Names of a table's parts with a committed version."""
        return [f"{name}/{f}" for f in sorted(self._folders(name)) if f.startswith("part-") and self.versions(f"{name}/{f}")]

    def read_parts(self, name: str, of: str | None = None) -> DataFrame | None:
        """All parts together, or the one of a codebase: only its files are listed. None where there is none."""
        names = self.parts(name) if of is None else [n for n in [self.part(name, of)] if self.versions(n)]
        out = None
        for n in names:
            out = self.read(n) if out is None else out.unionByName(self.read(n), allowMissingColumns=True)
        return out

    def sweep(self, name: str, keep: int = 2) -> int:
        """Delete all but the latest ``keep`` versions, which running readers may still use; how many went."""
        fs, path = self._fs()
        known = self._committed(name)
        old = list(known)[:-keep] if keep else list(known)
        for version in old:
            for folder in known[version]:
                fs.delete(path(folder), True)
        return len(old)
