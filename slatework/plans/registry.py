"""The registry of indexed codebases over a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slatework import schema
from slatework.functions.ids import stable_id
from slatework.functions.text import short_commit
from slatework.operators import change, joins


class Registry:
    """Register, list, enable, record sync state. Every write is a new version of one small table."""

    def __init__(self, store: change.TableStore, name: str = "codebases"):
        self.store, self.name = store, name
        if not store.exists(name):
            store.write(name, store.spark.createDataFrame([], schema.CODEBASES))

    def table(self) -> DataFrame:
        """All rows."""
        return self.store.read(self.name)

    def list(self) -> DataFrame:
        """Rows for people: newest first, short commit, first line of the error."""
        error = F.substring(F.substring_index(F.coalesce("last_sync_error", F.lit("")), "\n", 1), 1, 40)
        return joins.newest_first(self.table(), "created_at", "name").select(
            "name", F.when(F.col("enabled"), "yes").otherwise("no").alias("enabled"), "language", short_commit(F.col("last_indexed_commit")).alias("last_commit"),
            F.coalesce("github_repo", F.lit("-")).alias("github_repo"), error.alias("sync_error"),
        )

    def get(self, name: str) -> DataFrame:
        """The row of a name, or none."""
        return self.table().where(F.col("name") == name)

    def enabled(self) -> DataFrame:
        """Enabled rows by name."""
        return self.table().where("enabled").orderBy("name")

    def register(self, rows: DataFrame, enabled: bool = True) -> DataFrame:
        """Upsert by name; enabled, commit and creation time of rows that exist stay as they are. Every row needs a github_repo."""
        if "github_repo" not in rows.columns or not rows.where(F.coalesce(F.trim("github_repo"), F.lit("")) == "").isEmpty():
            raise ValueError("every codebase needs a github_repo")
        now = F.current_timestamp()
        filled = {"enabled": F.lit(enabled), "main_branch_name": F.lit("main"), "language": F.lit("mixed"), "description": F.lit("")}
        for c, v in filled.items():
            rows = rows.withColumn(c, F.coalesce(F.col(c), v) if c in rows.columns else v)
        rows = rows.withColumn("id", stable_id("name")).withColumn("created_at", now).withColumn("updated_at", now)
        rows = schema.with_columns(rows, schema.CODEBASES)
        preserve = ["enabled", "last_indexed_commit", "created_at", "last_sync_error", "last_sync_error_at"]
        return self.store.upsert(self.name, rows, ["name"], preserve=preserve)

    def discover(self, repos: DataFrame, dry_run: bool = False) -> DataFrame:
        """discovered, new, existing; new ones are registered as disabled, existing ones are left alone."""
        fresh = joins.absent(repos, self.table(), "name")
        counts = repos.agg(F.count("*").alias("discovered")).crossJoin(fresh.agg(F.count("*").alias("new")))
        summary = self.store.spark.createDataFrame(counts.select("discovered", "new", (F.col("discovered") - F.col("new")).alias("existing")).collect(), "discovered long, new long, existing long")
        if not dry_run:
            self.register(fresh.withColumnRenamed("default_branch", "main_branch_name"), enabled=False)
        return summary

    def seed(self, names: list[str]) -> DataFrame:
        """Enable the named codebases that exist; name, found of all of them."""
        wanted = self.store.spark.createDataFrame([(n,) for n in names], "name string")
        found = joins.present(wanted, self.table(), "name")
        self._update(F.col("name").isin(names), enabled=F.lit(True))
        return found

    def _update(self, condition, **values) -> int:
        table = self.table()
        met = table.where(F.coalesce(condition, F.lit(False))).count()
        if met:
            self.store.write(self.name, change.update_where(table, condition, **values, updated_at=F.current_timestamp()))
        return met

    def set_enabled(self, name: str, enabled: bool) -> bool:
        """Whether there was such a row."""
        return bool(self._update(F.col("name") == name, enabled=F.lit(enabled)))

    def set_commit(self, name: str, commit: str) -> bool:
        """Record an indexed commit and clear the error."""
        null = F.lit(None)
        return bool(self._update(F.col("name") == name, last_indexed_commit=F.lit(commit), last_sync_error=null.cast("string"), last_sync_error_at=null.cast("timestamp")))

    def set_path(self, name: str, path: str) -> bool:
        """Record where the working copy is."""
        return bool(self._update(F.col("name") == name, path=F.lit(path)))

    def record_error(self, name: str, message: str) -> bool:
        """Record a failed sync."""
        return bool(self._update(F.col("name") == name, last_sync_error=F.lit(message), last_sync_error_at=F.current_timestamp()))

    def clear_error(self, name: str) -> bool:
        """Clear the error if there is one."""
        null = F.lit(None)
        return bool(self._update((F.col("name") == name) & F.col("last_sync_error").isNotNull(), last_sync_error=null.cast("string"), last_sync_error_at=null.cast("timestamp")))

    def record_sync(self, outcomes: DataFrame) -> DataFrame:
        """Paths, commits and errors of a pass (name, path, commit, error) in one write; nulls leave paths and commits as they are."""
        table, now = self.table(), F.current_timestamp()
        joined = table.join(outcomes.select("name", F.struct("path", "commit", "error").alias("__s")), "name", "left")
        seen, failed = F.col("__s").isNotNull(), F.col("__s.error")
        values = {
            "path": F.coalesce(F.col("__s.path"), F.col("path")), "last_indexed_commit": F.coalesce(F.col("__s.commit"), F.col("last_indexed_commit")),
            "last_sync_error": F.when(seen, failed).otherwise(F.col("last_sync_error")),
            "last_sync_error_at": F.when(~seen, F.col("last_sync_error_at")).when(failed.isNotNull(), now), "updated_at": F.when(seen, now).otherwise(F.col("updated_at")),
        }
        return self.store.write(self.name, joined.select(*[values.get(c, F.col(c)).alias(c) for c in table.columns]))

    def delete(self, name: str) -> bool:
        """Whether a row was removed; indexed data stay."""
        table = self.table()
        met = not table.where(F.col("name") == name).isEmpty()
        if met:
            self.store.write(self.name, change.delete_where(table, F.col("name") == name))
        return met
