"""Queries: diffs, upserts, deletes, registry state, polling."""

from __future__ import annotations

from pyspark.sql import functions as F

from slatework.operators import change, joins
from slatework.plans.registered import Catalogue
from slatework.session import table
from slatework.sources import repos

CATALOGUE = Catalogue()
add = CATALOGUE.add


@add("""WITH now AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 11 <> 0),
before AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(n.k, b.k) AS o_orderkey, CASE WHEN b.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'deleted' WHEN n.h = b.h THEN 'unchanged' ELSE 'changed' END AS status FROM now n FULL JOIN before b ON n.k = b.k""")
def change_diff_full_outer(spark, sf_dir):
    """Two snapshots of files by hash."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("h"))
    now = orders.where("o_orderkey % 11 != 0").withColumn("h", F.when(F.col("o_orderkey") % 7 == 0, F.concat("h", F.lit("!"))).otherwise(F.col("h")))
    return change.diff(now, orders.where("o_orderkey % 5 != 0"), "o_orderkey", "h")


@add("""WITH now AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_orderstatus || '!' ELSE o_orderstatus END AS h FROM orders WHERE o_orderkey % 11 <> 0),
before AS (SELECT o_orderkey AS k, o_orderstatus AS h FROM orders WHERE o_orderkey % 5 <> 0)
SELECT CASE WHEN b.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'deleted' WHEN n.h = b.h THEN 'unchanged' ELSE 'changed' END AS status, count(*) AS files FROM now n FULL JOIN before b ON n.k = b.k GROUP BY 1""")
def change_summary(spark, sf_dir):
    return change_diff_full_outer(spark, sf_dir).groupBy("status").agg(F.count("*").alias("files"))


@add("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join_new(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.absent(c, urgent, "c_custkey")


@add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join_existing(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.present(c, large, "c_custkey").where("found").drop("found")


@add("""WITH old AS (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS score, s_suppkey % 2 = 0 AS enabled FROM supplier WHERE s_suppkey % 3 <> 0),
new AS (SELECT s_suppkey AS id, upper(s_name) AS name, round(s_acctbal * 2, 2) AS score, false AS enabled FROM supplier WHERE s_suppkey % 2 = 0)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.name, o.name) AS name, coalesce(n.score, o.score) AS score, CASE WHEN o.id IS NOT NULL THEN o.enabled ELSE n.enabled END AS enabled FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert_preserve_flags(spark, sf_dir):
    """Existing rows keep their enabled flag."""
    s = table(spark, sf_dir, "supplier")
    old = s.where("s_suppkey % 3 != 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), (F.col("s_suppkey") % 2 == 0).alias("enabled"))
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name"), F.round(F.col("s_acctbal") * 2, 2).alias("score"), F.lit(False).alias("enabled"))
    return change.upsert(old, new, ["id"], preserve=["enabled"])


@add("""WITH v AS (SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS status FROM orders)
SELECT id, max(version) AS version, arg_max(status, version) AS status FROM v GROUP BY id""")
def upsert_last_write_wins(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return change.upsert(rows.limit(0), rows, ["id"], version="version")


@add("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT (SELECT count(*) FROM customer WHERE c_nationkey <> 3) AS codebases, (SELECT count(*) FROM o) AS files,
(SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))) AS snippets""")
def cascade_delete(spark, sf_dir):
    """Delete parents, and children down two levels."""
    c, o, l = (table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))  # noqa: E741
    left = change.cascade(c, "c_custkey", c.where("c_nationkey = 3"), [("files", o, "o_custkey", "o_orderkey"), ("snippets", l, "l_orderkey", "l_linenumber")])
    counts = [left[k].agg(F.count("*").alias(n)) for k, n in (("parent", "codebases"), ("files", "files"), ("snippets", "snippets"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


@add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'done' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def conditional_state_update(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    met = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return change.update_where(rows, met, o_orderstatus=F.lit("done"), o_totalprice=F.lit(0.0))


@add("SELECT count(*) AS checked, count(*) FILTER (event_type = 'purchase') AS reindexed, count(*) FILTER (event_type IN ('view', 'click')) AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events")
def poll_summary(spark, sf_dir):
    kind = F.col("event_type")
    return joins.run_counters(table(spark, sf_dir, "events"), reindexed=kind == "purchase", skipped=kind.isin("view", "click"), failed=kind == "error")


@add("SELECT s_name AS name, 'org/' || s_name AS github_repo, CASE WHEN s_suppkey % 3 = 0 THEN 'main' ELSE 'trunk' END AS default_branch, '' AS description, CASE WHEN s_suppkey % 4 = 0 THEN 'mixed' ELSE 'python' END AS language FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0")
def repo_listing(spark, sf_dir):
    """Listing rows to registry rows: archived ones and forks go, defaults are filled in."""
    k = F.col("s_suppkey")
    raw = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.concat(F.lit("org/"), "s_name").alias("full_name"), F.when(k % 3 != 0, "trunk").alias("default_branch"), F.lit(None).cast("string").alias("description"),
        F.when(k % 4 != 0, "Python").alias("language"), (k % 5 == 0).alias("archived"), F.when(k % 7 == 0, True).alias("fork"),
    )
    return repos.active_repos(raw)


@add("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def set_intersect(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").intersect(o.where("o_orderstatus = 'O'").select("k"))


@add("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").subtract(o.where("o_orderstatus = 'P'").select("k"))


@add("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()
