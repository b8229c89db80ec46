"""Queries: joins, statistics, token economics, load reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.functions import text as T
from slatework.operators import analytics, joins
from slatework.plans.registered import Catalogue
from slatework.session import table

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_acctbal > 0")
def tenant_filtered_join(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = joins.with_parents(c.where("c_acctbal > 0"), n, {"c_nationkey": "n_nationkey"}, "n_name", "n_regionkey")
    joined = joins.with_parents(joined, r.where("r_name = 'ASIA'"), {"n_regionkey": "r_regionkey"}, "r_name")
    return joined.select("c_custkey", "c_name", "n_name", "r_name")


@add("SELECT d.source, d.lang, count(*) AS n, count(DISTINCT e.label) AS labels FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE coalesce(l.quality, 1) = 1 GROUP BY ALL")
def embedding_snippet_file_join(spark, sf_dir):
    e, d, q = (table(spark, sf_dir, t) for t in ("embeddings", "documents", "labels"))
    joined = joins.with_parents(e.select(F.col("vec_id").alias("doc_id"), "label"), d, {"doc_id": "doc_id"}, "source", "lang").join(q.select("doc_id", "quality"), "doc_id", "left")
    return joined.where(F.coalesce("quality", F.lit(1)) == 1).groupBy("source", "lang").agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels"))


_MONEY = "CAST(round({} * 100) AS BIGINT)"


@add(f"""WITH items AS (SELECT l_orderkey, count(*) AS s, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY 1),
per AS (SELECT o_custkey, count(*) AS files, CAST(sum({_MONEY.format("o_totalprice")}) AS BIGINT) AS b, CAST(sum(s) AS BIGINT) AS s, CAST(sum(c) AS BIGINT) AS c FROM orders LEFT JOIN items ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_name, coalesce(files, 0) AS files, coalesce(b, 0) AS file_bytes, coalesce(s, 0) AS snippets, coalesce(c, 0) AS snippet_chars FROM customer LEFT JOIN per ON c_custkey = o_custkey""")
def left_join_chain_stats(spark, sf_dir):
    """Statistics of parents over two levels of children, each file counted once."""
    return analytics.corpus_statistics(*_chain(spark, sf_dir))


def _chain(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("parent"), "c_name")
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("file"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"))
    snippets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_quantity").cast("long").alias("chars"))
    return parents, files, snippets, "parent", "file", "c_name", "bytes", F.col("chars")


@add(f"""SELECT c_name, count(DISTINCT o_orderkey) AS files, CAST(coalesce(sum({_MONEY.format("o_totalprice")}), 0) AS BIGINT) AS file_bytes, count(l_orderkey) AS snippets, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS snippet_chars
FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY c_name""")
def left_join_chain_stats_ref_fanout(spark, sf_dir):
    """The same with the fan-out of one join chain."""
    return analytics.corpus_statistics_fanout(*_chain(spark, sf_dir))


@add("SELECT source, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY source")
def avg_content_size(spark, sf_dir):
    return analytics.average_size(table(spark, sf_dir, "documents"), "source", F.length("text")).select("source", F.round("mean", 4).alias("mean_chars"))


@add("SELECT c_mktsegment, round(avg(c_acctbal) FILTER (c_acctbal > 0), 4) AS mean_positive, count(*) FILTER (c_acctbal > 0) AS n_positive FROM customer GROUP BY 1")
def avg_positive_size(spark, sf_dir):
    rows = analytics.average_size(table(spark, sf_dir, "customer"), "c_mktsegment", F.col("c_acctbal"), positive=True)
    return rows.select("c_mktsegment", F.round("mean", 4).alias("mean_positive"), F.col("n").alias("n_positive"))


_PER_SOURCE = "per AS (SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(least(n_chars, 1000)) AS BIGINT) AS snippet_chars FROM documents GROUP BY source)"


@add(f"WITH {_PER_SOURCE} SELECT source, chars // 4 AS file_tokens, snippet_chars // 4 AS snippet_tokens, round(coalesce((chars // 4) / nullif(snippet_chars // 4, 0), 0), 6) AS compression FROM per")
def compression_ratio(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.sum(F.least("n_chars", F.lit(1000))).alias("snippet_chars"))
    a, b = analytics.to_tokens(F.col("chars")), analytics.to_tokens(F.col("snippet_chars"))
    return rows.select("source", a.alias("file_tokens"), b.alias("snippet_tokens"), F.round(analytics.ratio(a, b), 6).alias("compression"))


@add(f"WITH {_PER_SOURCE} SELECT round(sum((chars / files) * files) / sum(files), 4) AS weighted_file, round(sum(CAST(snippet_chars AS DOUBLE)) / sum(files), 4) AS weighted_snippet, CAST(sum(files) AS BIGINT) AS files FROM per")
def weighted_avg(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.avg("n_chars").alias("f"), F.avg(F.least("n_chars", F.lit(1000))).alias("s"))
    found = analytics.weighted_averages(rows, "files", weighted_file="f", weighted_snippet="s")
    return found.select(F.round("weighted_file", 4).alias("weighted_file"), F.round("weighted_snippet", 4).alias("weighted_snippet"), "files")


def _saved(spark, sf_dir):
    """What a query of a codebase saves: its mean text in tokens of four characters, once for each of 25 documents not read."""
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.sum(F.length("text")) * 25 / (F.count("*") * 4)).cast("long").alias("saved_tokens"))


_SAVED = "(SELECT source, CAST(trunc(sum(length(text)) * 25 / (count(*) * 4)) AS BIGINT) AS saved FROM documents GROUP BY source)"


@add(f"SELECT source, e AS engineers, q AS queries_per_day, e * q * 250 * saved AS annual_tokens FROM {_SAVED}, (SELECT unnest([50::BIGINT, 100, 200]) AS e), (SELECT unnest([5::BIGINT, 10, 20]) AS q)")
def sensitivity_grid(spark, sf_dir):
    return analytics.sensitivity_grid(_saved(spark, sf_dir), [50, 100, 200], [5, 10, 20], 250)


@add(f"SELECT source, e AS engineers, q AS queries_per_day, e * q * 250 * saved AS annual_tokens, model, round(e * q * 250 * saved / 1e6 * price, 4) AS annual_cost FROM {_SAVED}, (SELECT unnest([50::BIGINT, 100]) AS e), (SELECT unnest([5::BIGINT, 10]) AS q), (VALUES ('small', 0.25), ('large', 3.0)) AS m(model, price)")
def sensitivity_costs(spark, sf_dir):
    """The grid with the cost a year of each model."""
    rows = analytics.sensitivity_grid(_saved(spark, sf_dir), [50, 100], [5, 10], 250, {"small": 0.25, "large": 3.0})
    return rows.withColumn("annual_cost", F.round("annual_cost", 4))


@add("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at FROM events")
def iso_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.iso_time(F.col("ts")).alias("at"))


@add("SELECT o_orderkey, CASE WHEN o_totalprice >= 1000 THEN format('${:,}', CAST(round(o_totalprice) AS BIGINT)) ELSE printf('$%.2f', o_totalprice) END AS label FROM orders")
def dollar_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.dollars(F.col("o_totalprice")).alias("label"))


@add("SELECT p_partkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', round(n / 1e6, 1)) WHEN n >= 1000 THEN printf('%.1fK', round(n / 1e3, 1)) ELSE CAST(n AS VARCHAR) END AS label FROM (SELECT p_partkey, p_partkey * p_partkey + p_size AS n FROM part)")
def token_labels(spark, sf_dir):
    n = (F.col("p_partkey") * F.col("p_partkey") + F.col("p_size")).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", T.human_count(n).alias("label"))


@add("""SELECT d.source, count(DISTINCT d.doc_id) AS files, count(l.doc_id) AS snippets, count(e.vec_id) AS embeddings FROM documents d
LEFT JOIN labels l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON d.doc_id = e.vec_id GROUP BY d.source""")
def index_statistics(spark, sf_dir):
    embeddings = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return analytics.index_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), embeddings, "source", "doc_id")


@add("SELECT r_name, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS all_names, coalesce(string_agg(DISTINCT n_name, ',' ORDER BY n_name) FILTER (contains(lower(n_name), '_1')), '') AS matched FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")
def collect_distinct_lists(spark, sf_dir):
    """Names below each parent, all and matched."""
    r, n = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    rows = r.join(n, r.r_regionkey == n.n_regionkey, "left").groupBy("r_name").agg(F.array_sort(F.collect_set("n_name")).alias("names"))
    hit = F.filter("names", lambda x: F.lower(x).contains("_1"))
    return rows.select("r_name", F.array_join("names", ",").alias("all_names"), F.array_join(hit, ",").alias("matched"))


_RANK = "sorted[least(CAST(floor(len(sorted) * {p} / 100) AS BIGINT), len(sorted) - 1) + 1]"


@add(f"SELECT event_type, {_RANK.format(p=50)} AS p50, {_RANK.format(p=95)} AS p95, {_RANK.format(p=99)} AS p99 FROM (SELECT event_type, list(value ORDER BY value) AS sorted FROM events GROUP BY 1)")
def latency_percentiles_nearest_rank(spark, sf_dir):
    """Nearest-rank percentiles without holding a group's values in one place."""
    return analytics.nearest_rank_by_count(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 50, "p95": 95, "p99": 99})


@add(f"""WITH good AS (SELECT list(value ORDER BY value) AS sorted FROM events WHERE event_type <> 'error')
SELECT count(*) AS total_queries, count(*) FILTER (event_type <> 'error') AS successful, count(*) FILTER (event_type = 'error') AS failed,
round(count(*) FILTER (event_type <> 'error') / 30.0, 6) AS throughput_qps, round(count(*) FILTER (event_type = 'error') / greatest(count(*), 1), 6) AS error_rate,
round(avg(value) FILTER (event_type <> 'error'), 6) AS embed_avg_ms, (SELECT {_RANK.format(p=95)} FROM good) AS total_p95_ms FROM events""")
def throughput_error_rate(spark, sf_dir):
    ok = F.col("event_type") != "error"
    results = table(spark, sf_dir, "events").select(F.col("value").alias("total_ms"), F.col("value").alias("search_ms"), F.col("value").alias("embed_ms"), ok.alias("success"), F.lit(1).alias("result_count"))
    r = analytics.load_report(results, 30.0)
    return r.select("total_queries", "successful", "failed", *[F.round(c, 6).alias(c) for c in ("throughput_qps", "error_rate", "embed_avg_ms")], "total_p95_ms")


@add("SELECT count(*) AS current_rows, (SELECT count(*) FROM embeddings) AS former_rows, round(count(*) / (SELECT count(*) FROM embeddings), 6) AS ratio, count(*) / (SELECT count(*) FROM embeddings) BETWEEN 0.8 AND 1.5 AS ok FROM documents")
def count_parity(spark, sf_dir):
    return analytics.count_parity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"))


@add("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events")
def json_props(spark, sf_dir):
    k = joins.json_fields("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even"))


@add("SELECT DISTINCT source, lang FROM documents")
def distinct_file_scan(spark, sf_dir):
    """Files with their language, without a query per file."""
    return table(spark, sf_dir, "documents").select("source", "lang").distinct()


@add("SELECT source, count(*) AS snippets, min(doc_id) AS first_id, max(n_chars) AS largest FROM documents GROUP BY source")
def grouped_file_snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("snippets"), F.min("doc_id").alias("first_id"), F.max("n_chars").alias("largest"))


@add("SELECT doc_id, lang FROM documents WHERE regexp_matches(coalesce(text, ''), '\\S')".replace("\\\\", "\\"))
def blank_content_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~T.is_blank(F.col("text"))).select("doc_id", "lang")


@add("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def registry_order(spark, sf_dir):
    """Newest first, with a tie-break."""
    return joins.newest_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").limit(100)


@add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, sf_dir):
    """Extension: tumbling windows."""
    w = F.window("ts", "1 hour")
    return table(spark, sf_dir, "events").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


@add("""SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def events_session(spark, sf_dir):
    """Extension: sessions that end after half an hour without an event."""
    s = F.session_window("ts", "30 minutes")
    return table(spark, sf_dir, "events").groupBy("user_id", s).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


@add("SELECT 'nation' AS \"table\", count(*) AS rows, 3 AS columns FROM nation UNION ALL SELECT 'part', count(*), 6 FROM part")
def table_statistics(spark, sf_dir):
    from slatework.sources.files import table_statistics as stats

    return stats(spark, {t: table(spark, sf_dir, t) for t in ("nation", "part")})
