"""Incremental index builds: content-hash diff, extraction of what changed, versioned writes, polling and file streams."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework import schema
from slatework.functions.ids import stable_id
from slatework.functions.text import is_blank
from slatework.operators import change, extract, graph, joins
from slatework.operators.inverted_index import InvertedIndex
from slatework.operators.vector_store import VectorStore
from slatework.plans.api import Engine
from slatework.scratch import materialize
from slatework.sources import embedding, files, repos


def memo_key(engine: Engine) -> str:
    """What besides the content decides a file's rows: extraction rules and embedding model."""
    return f"{extract.VERSION}/{engine.provider.key}"


def snapshot(spark: SparkSession, root: str, codebase: str, memo: str, exclude: tuple[str, ...] = files.EXCLUDED) -> DataFrame:
    """The decoded files of a tree with their hashes."""
    rows = files.decode(files.scan(spark, root, exclude=exclude))
    return rows.withColumn("codebase_name", F.lit(codebase)).withColumn("memo", F.lit(memo))


def index_rows(changed: DataFrame, codebase: str, provider: embedding.Provider | embedding.ExpressionProvider, vectors: VectorStore) -> DataFrame:
    """Corpus rows of some files: extract, drop blanks, embed what has no vector yet, stable ids. Rows that could not be embedded have embed_error."""
    found = extract.extract(changed).where(~is_blank(F.col("content")))
    found = vectors.embed(found, provider)
    ids = stable_id(F.lit(codebase), "file_path", "start_line", "name", "content")
    return found.select(F.lit(codebase).alias("codebase_name"), ids.alias("id"), *[c for c in found.columns])


def build(engine: Engine, codebase: str, root: str, full: bool = False, dry_run: bool = False, exclude: tuple[str, ...] = files.EXCLUDED) -> DataFrame:
    """Bring a codebase's rows up to date; status, files. Only new and changed files are read by the extractor.

    A file is unchanged if its content hash and the memo key are. Without any change nothing is written. Else the
    codebase's own parts of the tables get a new version: the rows of unchanged files, and those of new and changed ones. The
    file table follows last, so a build that dies is repeated. Files with rows that could not be embedded stay out of it and are
    tried again by the next build; ``failures`` has their errors, and status ``failed`` counts them.
    """
    spark, store = engine.spark, engine.store
    now = snapshot(spark, root, codebase, memo_key(engine), exclude)
    light = materialize(schema.with_columns(now, schema.FILES), "build-files")  # all files are read once, changed ones once more
    known = store.read_parts("files", codebase)
    if known is None or full:
        known = spark.createDataFrame([], schema.FILES)
    status = materialize(change.diff(light, known, "relative_path", "content_hash", "memo"), "build-status")
    summary = status.groupBy("status").agg(F.count("*").alias("files"))
    old = store.read_parts("corpus", codebase)
    if dry_run or (old is not None and status.where("status != 'unchanged'").isEmpty()):
        return summary
    fresh = index_rows(now.join(status.where("status IN ('new', 'changed')"), "relative_path", "left_semi"), codebase, engine.provider, engine.vectors)
    fresh = materialize(fresh, "build-rows")
    failures = materialize(fresh.where("embed_error IS NOT NULL").groupBy(F.col("file_path").alias("relative_path")).agg(F.min("embed_error").alias("error"), F.count("*").alias("rows")), "build-failures")
    rows = fresh.where("embed_error IS NULL").drop("embed_error")
    if old is not None:
        kept = status.where("status = 'unchanged'").select(F.col("relative_path").alias("file_path"))
        rows = old.join(kept, "file_path", "left_semi").unionByName(rows, allowMissingColumns=True)
    part = lambda name: store.part(name, codebase)
    code = store.write(part("corpus"), schema.with_columns(rows, schema.CORPUS))
    old_index = None if full else engine.index(codebase)
    if old_index is None or old_index.analyser != engine.config.analysis:
        InvertedIndex.build(code, engine.index_path(codebase), "id", "content", "file_path", analyser=engine.config.analysis)
    else:  # a file's snippets are in one shard, so its shard is what changes
        old_index.refresh(code, status.where("status != 'unchanged'").select(F.col("relative_path").alias("file_path")), "id", "content", "file_path")
    schema.assert_unique(store.write(part("nodes"), schema.with_columns(graph.nodes(code), schema.NODES)), "id")
    store.write(part("edges"), schema.with_columns(graph.edges(code), schema.EDGES))
    store.write(part("failures"), schema.with_columns(failures.withColumn("codebase_name", F.lit(codebase)), schema.FAILURES))
    store.write(part("files"), light.join(failures, "relative_path", "left_anti").select(light.columns))
    for name in ("corpus", "nodes", "edges", "failures", "files"):
        store.sweep(part(name))
    failed = failures.agg(F.count("*").alias("files")).where("files > 0").select(F.lit("failed").alias("status"), "files")
    return summary.unionByName(failed)


Sync = Callable[[str, str, str], tuple[str, str]]
OUTCOME = "name string, commit string, path string, error string"


def sync_outcomes(rows: DataFrame, sync: Sync, at_once: int = 4) -> DataFrame:
    """OUTCOME of syncing the working copies of registry rows, some at once; a failure is an error, not an exception."""

    def attempt(row) -> tuple:
        try:
            return (row.name, *sync(row.github_repo, row.name, row.main_branch_name), None)
        except repos.SyncError as e:
            return (row.name, None, None, str(e))

    asked = rows.select("github_repo", "name", "main_branch_name").collect()  # a row per codebase
    with ThreadPoolExecutor(at_once) as pool:
        return rows.sparkSession.createDataFrame(list(pool.map(attempt, asked)), OUTCOME)


def poll(engine: Engine, sync: Sync, dry_run: bool = False, build_one: Callable[[str, str], bool] | None = None) -> dict[str, int]:
    """One pass over the enabled codebases; checked, reindexed, skipped, failed.

    What is to be done follows from the sync outcomes joined to the registry, and the registry is written once, at the end:
    commits of what was built, errors of what was not synced. So a failed build is tried again by the next pass, and
    one failure stops nothing. A dry run counts what would be done and writes nothing.
    """
    rows = engine.registry.enabled()
    outcomes = sync_outcomes(rows, sync)
    action = F.when(F.col("error").isNotNull(), "failed").when(F.col("commit").eqNullSafe(F.col("last_indexed_commit")), "skipped").otherwise("reindexed")
    plan = rows.select("name", "last_indexed_commit").join(outcomes, "name").withColumn("action", action)
    if not dry_run:
        due = plan.where("action = 'reindexed'").select("name", "path").collect()
        run = build_one or (lambda name, path: build(engine, name, path) is not None)
        built = []
        for r in due:
            try:
                built.append((r.name, bool(run(r.name, r.path)), None))
            except Exception as e:  # one codebase's failure is its own: it is recorded, and tried again by the next pass
                built.append((r.name, False, f"{type(e).__name__}: {e}"[:500]))
        plan = plan.join(engine.spark.createDataFrame(built, "name string, built boolean, build_error string"), "name", "left")
        plan = plan.withColumn("action", F.when(~F.coalesce("built", F.lit(True)), "failed").otherwise(F.col("action")))
        plan = plan.withColumn("error", F.coalesce("error", "build_error"))
        plan = materialize(plan, "poll")
        engine.registry.record_sync(plan.select("name", "path", "error", F.when(F.col("action") == "reindexed", F.col("commit")).alias("commit")))
    return joins.run_counters(plan, **{a: F.col("action") == a for a in ("reindexed", "skipped", "failed")}).first().asDict()


def keep_polling(engine: Engine, sync: Sync, seconds: float, passes: int | None = None, sleep: Callable[[float], None] = time.sleep, **options) -> Iterator[dict[str, int]]:
    """A pass every ``seconds`` (from one's end to the next one's begin), without end or ``passes`` times; yields the counts."""
    done = 0
    while passes is None or done < passes:
        if done:
            sleep(seconds)
        yield poll(engine, sync, **options)
        done += 1


def live(engine: Engine, codebase: str, root: str, checkpoint: str, suffix: str = "", once: bool = True, seconds: int = 60):
    """Live mode: a started query that brings a codebase up to date whenever files have come in below ``root``."""

    def update(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            build(engine, codebase, root)

    return stream_files(engine.spark, root, suffix, update, checkpoint, once, seconds)


def stream_files(spark: SparkSession, root: str, suffix: str, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, seconds: int = 60):
    """Live mode: new files of a folder as micro-batches for ``each(batch, number)``; started query.

    ``once`` takes what is there and ends, else a batch every ``seconds``. The checkpoint remembers the files.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(root)
    out = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{seconds} seconds")).start()
