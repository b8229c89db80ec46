"""Corpus statistics, token economics, latency reports and result-set comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatework.scratch import materialize


def to_tokens(chars: Column) -> Column:
    """Four characters a token, rounded down."""
    return F.floor(chars / 4).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def corpus_statistics(parents: DataFrame, files: DataFrame, snippets: DataFrame, parent: str, file: str, name: str, file_size: str, content_size: Column) -> DataFrame:
    """Per parent: files, file_bytes, snippets, snippet_chars. Children are summed before the joins, so nothing fans out."""
    per_file = snippets.groupBy(file).agg(F.count("*").alias("s"), F.sum(content_size).alias("c"))
    per_parent = files.join(per_file, file, "left").groupBy(parent).agg(
        F.count("*").alias("files"), F.sum(file_size).alias("file_bytes"), F.sum("s").alias("snippets"), F.sum("c").alias("snippet_chars")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return parents.select(parent, name).join(per_parent, parent, "left").select(name, zero("files"), zero("file_bytes"), zero("snippets"), zero("snippet_chars"))


def corpus_statistics_fanout(parents: DataFrame, files: DataFrame, snippets: DataFrame, parent: str, file: str, name: str, file_size: str, content_size: Column) -> DataFrame:
    """The same by one chain of left joins, in which a file's size counts once per snippet: kept for comparison."""
    sized = snippets.select(file, content_size.alias("__c"), F.lit(1).alias("__one"))
    chain = parents.select(parent, name).join(files, parent, "left").join(sized, file, "left")
    return chain.groupBy(name).agg(
        F.countDistinct(file).alias("files"), F.coalesce(F.sum(file_size), F.lit(0)).alias("file_bytes"), F.count("__one").alias("snippets"), F.coalesce(F.sum("__c"), F.lit(0)).alias("snippet_chars")
    )


def average_size(rows: DataFrame, group: str, size: Column, positive: bool = False) -> DataFrame:
    """group, mean, n: the mean size of snippets or files; sizes of 0 and below are left out if only ``positive`` ones count."""
    counted = F.when(size > 0, size) if positive else size
    return rows.groupBy(group).agg(F.coalesce(F.avg(counted), F.lit(0.0)).alias("mean"), F.count(counted).alias("n"))


def weighted_averages(rows: DataFrame, weight: str, **values: str) -> DataFrame:
    """One row: the mean of each column weighted by a count, and the sum of counts."""
    total = F.sum(weight)
    return rows.agg(*[ratio(F.sum(F.col(c) * F.col(weight)), total).alias(name) for name, c in values.items()], total.alias(weight))


def index_statistics(files: DataFrame, snippets: DataFrame, embeddings: DataFrame, group: str, key: str) -> DataFrame:
    """group, files, snippets, embeddings; children are counted per file before the joins, so nothing fans out."""
    count = lambda df, name: df.groupBy(key).agg(F.count("*").alias(name))
    rows = files.select(group, key).distinct().join(count(snippets, "snippets"), key, "left").join(count(embeddings, "embeddings"), key, "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return rows.groupBy(group).agg(F.count("*").alias("files"), total("snippets"), total("embeddings"))


def nearest_rank_by_count(rows: DataFrame, group: str, value: str, percents: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place floor(n * p / 100) + 1 of the sorted values, the last one at most; null for none.

    Counts per distinct value are sorted by range, summed within their partition, and added to the sums of the partitions
    before, so no task holds the values of a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    held = materialize(counts.orderBy(group, value).withColumn("part", F.spark_partition_id()), "value-counts")
    sums = held.groupBy(group, "part").agg(F.sum("n").alias("m"))  # a row per group and partition that has it
    whole = Window.partitionBy(group)
    before = F.sum("m").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col(group).alias("__g"), F.col("part").alias("__p"), F.coalesce(before, F.lit(0)).alias("base"), F.sum("m").over(whole).alias("total"))
    running = F.sum("n").over(Window.partitionBy(group, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    joined = held.withColumn("upto", running).join(sums, F.col(group).eqNullSafe(F.col("__g")) & (F.col("part") == F.col("__p")))
    place = lambda p: F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1) + 1
    return joined.groupBy(group).agg(*[F.min(F.when(F.col("base") + F.col("upto") >= place(p), F.col(value))).alias(name) for name, p in percents.items()])


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets, 0 if both are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def load_report(results: DataFrame, wall_seconds: float, total: str = "total_ms", search: str = "search_ms", embed: str = "embed_ms", ok: str = "success", found: str = "result_count") -> DataFrame:
    """One row: counts, throughput, error rate, nearest-rank percentiles and means of the successful calls."""
    counts = results.agg(
        F.count("*").alias("total_queries"), F.count_if(F.col(ok)).alias("successful"), F.count_if(~F.col(ok)).alias("failed"),
        (F.count_if(F.col(ok)) / F.lit(float(wall_seconds))).alias("throughput_qps"),
        (F.count_if(~F.col(ok)) / F.greatest(F.count("*"), F.lit(1))).alias("error_rate"),
        F.avg(F.when(F.col(ok), F.col(embed))).alias("embed_avg_ms"), F.avg(F.when(F.col(ok), F.col(found))).alias("avg_results_per_query"),
    )
    good = results.where(F.col(ok)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("what"), F.col(c).cast("double").alias("ms")) for n, c in (("total", total), ("search", search))])).alias("x")).select("x.*")
    ranks = nearest_rank_by_count(good, "what", "ms", {f"p{p}": p for p in (50, 95, 99)})
    ranks = ranks.groupBy().agg(*[F.max(F.when(F.col("what") == n, F.col(f"p{p}"))).alias(f"{n}_p{p}_ms") for n in ("total", "search") for p in (50, 95, 99)])
    return counts.crossJoin(ranks)  # one row each


def within_targets(report: DataFrame, search_p95: float = 500.0, total_p95: float = 5000.0, error_rate: float = 0.05) -> DataFrame:
    """The report's pass marks."""
    return report.select(
        (F.col("search_p95_ms") < search_p95).alias("search_ok"), (F.col("total_p95_ms") < total_p95).alias("total_ok"), (F.col("error_rate") < error_rate).alias("errors_ok")
    )


def count_parity(current: DataFrame, former: DataFrame, low: float = 0.8, high: float = 1.5) -> DataFrame:
    """current_rows, former_rows, ratio, ok of two tables."""
    both = current.agg(F.count("*").alias("current_rows")).crossJoin(former.agg(F.count("*").alias("former_rows")))
    share = ratio(F.col("current_rows"), F.col("former_rows"))
    return both.select("current_rows", "former_rows", F.round(share, 6).alias("ratio"), share.between(low, high).alias("ok"))


def sensitivity_grid(base: DataFrame, engineers: list[int], queries_per_day: list[int], days: int, prices: dict[str, float] | None = None) -> DataFrame:
    """Tokens saved a year for every row of ``base`` (saved_tokens a query), team size and query rate; with ``prices`` (dollars a million tokens) a row per model with its annual_cost."""
    values = lambda some: F.explode(F.array(*[F.lit(x).cast("long") for x in some]))
    kept = [c for c in base.columns if c != "saved_tokens"]
    grid = base.select("*", values(engineers).alias("engineers")).select("*", values(queries_per_day).alias("queries_per_day"))
    grid = grid.withColumn("annual_tokens", F.col("engineers") * F.col("queries_per_day") * days * F.col("saved_tokens")).drop("saved_tokens")
    if prices is None:
        return grid
    models = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.lit(float(p)).alias("price")) for m, p in prices.items()]))
    grid = grid.select("*", models.alias("m"))
    return grid.select(*kept, "engineers", "queries_per_day", "annual_tokens", "m.model", (F.col("annual_tokens") / 1e6 * F.col("m.price")).alias("annual_cost"))
