"""Queries: keyword, vector and hybrid search, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.functions import ids, vectors
from slatework.functions import text as T
from slatework.operators import analytics, fusion, keyword, symbols, vector_search
from slatework.operators.inverted_index import InvertedIndex
from slatework.operators.quantised import QuantisedIndex
from slatework.plans import retrieve
from slatework.plans.registered import Catalogue
from slatework.scratch import scratch_path
from slatework.session import table

CATALOGUE = Catalogue()
add = CATALOGUE.add

WORDS = ["thing", "erat", "with", "anon"]
DEPTH, TOP = 20, 10
TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
SIM = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"
TERMS = "(SELECT unnest(['thing', 'erat', 'with', 'anon']) AS w)"

BM25 = rf"""toks AS (SELECT doc_id, {TOKENS} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean_len FROM toks),
tf AS (SELECT doc_id, w, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS len FROM toks, {TERMS}),
df AS (SELECT w, count(*) AS df FROM tf WHERE tf > 0 GROUP BY w),
bm AS (
  SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))) AS raw
  FROM tf JOIN df USING (w), stats WHERE tf > 0 GROUP BY doc_id
)"""
KEYWORD_LIST = f"kw AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(raw, 10) DESC, doc_id) AS rank FROM (SELECT doc_id, raw, round(raw, 4) AS score FROM bm ORDER BY round(raw, 10) DESC, doc_id LIMIT {DEPTH}))"
NEAR = f"(SELECT *, round(raw, 4) AS similarity FROM (SELECT vec_id, label, {SIM} AS raw FROM embeddings))"
VECTOR_LIST = f"vec AS (SELECT vec_id AS doc_id, similarity, row_number() OVER (ORDER BY round(raw, 10) DESC, vec_id) AS rank FROM {NEAR} WHERE raw >= 0 ORDER BY rank LIMIT {DEPTH})"


def fused_sql(vector_weight: float = 1.0, keyword_weight: float = 1.0, extra: str = "") -> str:
    """RRF over the lists vec and kw (and ``extra``)."""
    return f"""SELECT doc_id, round(raw, 6) AS rrf_score, sources FROM (
  SELECT doc_id, sum(part) AS raw, min(ord * 1000 + rank) AS place, string_agg(src, '+' ORDER BY src) AS sources FROM (
    SELECT doc_id, 0 AS ord, 'vector' AS src, rank, {vector_weight} / (60 + rank) AS part FROM vec
    UNION ALL SELECT doc_id, 1, 'keyword', rank, {keyword_weight} / (60 + rank) FROM kw {extra}) GROUP BY doc_id)
ORDER BY raw DESC, place LIMIT {TOP}"""


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector as a query."""
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def _vector_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieve.vector_branch(corpus, query_vector(spark, sf_dir), DEPTH, "doc_id")


def _keyword_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fusion.ranked(keyword.bm25_top_k(docs, WORDS, DEPTH, digits=None), "doc_id", "score")


@add(f"SELECT vec_id, similarity FROM {NEAR} WHERE raw >= 0 ORDER BY round(raw, 10) DESC, vec_id LIMIT 20")
def vector_topk_cosine(spark, sf_dir):
    return vector_search.top_k(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 20).select("vec_id", "similarity")


@add(f"SELECT vec_id, round({SIM}, 4) AS similarity FROM embeddings WHERE {SIM} >= 0.15")
def vector_threshold(spark, sf_dir):
    found = vector_search.similarities(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 0.15)
    return found.select("vec_id", F.round("similarity", 4).alias("similarity"))


@add(f"SELECT label, vec_id, similarity, rank FROM (SELECT label, vec_id, similarity, row_number() OVER (PARTITION BY label ORDER BY round(raw, 10) DESC, vec_id) AS rank FROM {NEAR}) WHERE rank <= 3")
def vector_topk_per_label(spark, sf_dir):
    found = vector_search.top_k_per_group(table(spark, sf_dir, "embeddings"), query_vector(spark, sf_dir), 3, "label")
    return found.select("label", "vec_id", "similarity", F.col("rank").cast("long").alias("rank"))


@add("""SELECT query_id, vec_id, similarity, rank FROM (
SELECT query_id, vec_id, round(raw, 4) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 10) DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS raw
FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= 5""")
def vector_batch_topk(spark, sf_dir):
    """Every hundredth vector as a query against all rows."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")  # the stated query set, in blocks
    return vector_search.batch_top_k(rows, asked, 5).select("query_id", "vec_id", "similarity", F.col("rank").cast("long").alias("rank"))


@add("SELECT count(*) AS n_rows, count(DISTINCT vec_id) AS n_ids, round(min(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS least_norm, round(sum(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1))), 3) AS total_distance FROM embeddings")
def vector_measures(spark, sf_dir):
    """Inner product and distance over the whole store."""
    q = vectors.literal(query_vector(spark, sf_dir, 1))
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").agg(
        F.count("*").alias("n_rows"), F.countDistinct("vec_id").alias("n_ids"), F.round(F.min(vectors.dot(e, e)), 4).alias("least_norm"), F.round(F.sum(vectors.euclidean(e, q)), 3).alias("total_distance")
    )


@add(f"WITH {BM25} SELECT doc_id, round(raw, 4) AS score FROM bm ORDER BY round(raw, 10) DESC, doc_id LIMIT 20")
def keyword_topk_bm25(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword.bm25_top_k(docs, WORDS, 20)


@add(rf"""WITH {BM25.replace("FROM documents", "FROM documents WHERE source = 'src1'", 1)} SELECT doc_id, round(raw, 4) AS score FROM bm ORDER BY round(raw, 10) DESC, doc_id LIMIT 20""")
def keyword_topk_bm25_tenant(spark, sf_dir):
    """Statistics of the tenant only."""
    docs = table(spark, sf_dir, "documents").where("source = 'src1'").select("doc_id", "text")
    return keyword.bm25_top_k(docs, WORDS, 20)


_FIELD = r"""toks{f} AS (SELECT p_partkey, regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+') AS t FROM part), st{f} AS (SELECT count(*) AS n, avg(len(t)) AS mean_len FROM toks{f}),
tf{f} AS (SELECT p_partkey, w, len(list_filter(t, lambda x: x = w)) AS tf, len(t) AS len FROM toks{f}, (SELECT unnest(['ring', 'small', 'rod']) AS w)), df{f} AS (SELECT w, count(*) AS df FROM tf{f} WHERE tf > 0 GROUP BY w),
bm{f} AS (SELECT p_partkey, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))) AS raw FROM tf{f} JOIN df{f} USING (w), st{f} WHERE tf > 0 GROUP BY p_partkey)"""


@add(f"WITH {_FIELD.format(f=0, c='p_name')}, {_FIELD.format(f=1, c='p_type')} SELECT p_partkey, round(sum(raw), 4) AS score FROM (SELECT * FROM bm0 UNION ALL SELECT * FROM bm1) GROUP BY p_partkey ORDER BY round(sum(raw), 10) DESC, p_partkey LIMIT 20")
def keyword_name_or_content(spark, sf_dir):
    """Any term in either of two fields."""
    return keyword.bm25_top_k(table(spark, sf_dir, "part"), ["ring", "small", "rod"], 20, "p_partkey", ("p_name", "p_type"))


@add(rf"SELECT doc_id FROM documents WHERE len(list_filter(['thing', 'erat', 'with', 'anon'], lambda w: NOT list_contains({TOKENS}, w))) = 0")
def keyword_all_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(keyword.all_terms(F.col("text"), WORDS)).select("doc_id")


@add(rf"SELECT doc_id FROM documents WHERE list_has_any({TOKENS}, ['thing', 'erat', 'with', 'anon'])")
def keyword_any_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(keyword.any_term(F.col("text"), WORDS)).select("doc_id")


@add(rf"""WITH toks AS (SELECT item_id, {TOKENS} AS t FROM benchmark),
q AS (SELECT DISTINCT item_id, unnest(t) AS w FROM toks),
docs AS (SELECT doc_id, {TOKENS} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS mean_len FROM docs),
post AS (SELECT doc_id, w, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, unnest(t) AS w, len(t) AS len FROM docs) GROUP BY doc_id, w),
df AS (SELECT w, count(*) AS df FROM post GROUP BY w),
scored AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))) AS raw
  FROM q JOIN post USING (w) JOIN df USING (w), stats GROUP BY item_id, doc_id)
SELECT item_id, doc_id, round(raw, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(raw, 10) DESC, doc_id) AS rank FROM scored) WHERE rank <= 3""")
def keyword_batch_bm25(spark, sf_dir):
    """A batch of queries (all words of every benchmark item) over the inverted index."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.query_terms(F.col("text"))).alias("term"))
    found = keyword.batch_bm25(docs, asked, 3, "doc_id", "item_id")
    return found.select("item_id", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


@add(rf"""WITH pos AS (SELECT doc_id, w, p FROM (SELECT doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) WHERE w IN ('thing', 'with'))
SELECT doc_id, round(raw, 4) AS score FROM (SELECT a.doc_id, 1 - product(1 - sqrt(0.01 * CASE WHEN abs(a.p - b.p) > 100 THEN 1e-30 ELSE 1 / (1.005 + 0.05 * exp(abs(a.p - b.p) / 1.5 - 2)) END)) AS raw
FROM pos a JOIN pos b ON a.doc_id = b.doc_id AND a.w = 'with' AND b.w = 'thing' GROUP BY a.doc_id) ORDER BY round(raw, 10) DESC, doc_id LIMIT 20""")
def ts_rank_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword.top_k(keyword.ts_rank(docs, ["thing", "with"]), 20, "doc_id").select("doc_id", "score")


@add(rf"""SELECT doc_id, round(list_sum(list_transform(range(1, n + 1), lambda j: 0.1 / (j * j))) / 1.64493406685, 4) AS score
FROM (SELECT doc_id, len(list_filter({TOKENS}, lambda x: x = 'thing')) AS n FROM documents) WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 20""")
def ts_rank_single_term(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return keyword.top_k(keyword.ts_rank(docs, ["thing"]), 20, "doc_id").select("doc_id", "score")


@add(f"WITH {BM25}, {KEYWORD_LIST}, {VECTOR_LIST} {fused_sql()}")
def rrf_hybrid_topk(spark, sf_dir):
    """The flagship: vector and keyword candidates of one plan, fused."""
    lists = {"vector": _vector_list(spark, sf_dir).select("doc_id", "rank"), "keyword": _keyword_list(spark, sf_dir).select("doc_id", "rank")}
    return fusion.fuse(lists, "doc_id", limit=TOP)


_INDEXES: dict[tuple[str, str, str], InvertedIndex] = {}


def stored_index(spark: SparkSession, sf_dir: str, analyser: str = "simple") -> InvertedIndex:
    """The inverted index of all documents, made when a session first asks for it."""
    at = (spark.sparkContext.applicationId, sf_dir, analyser)
    if at not in _INDEXES:
        _INDEXES[at] = InvertedIndex.build(table(spark, sf_dir, "documents"), scratch_path(spark, "inverted-index"), analyser=analyser)
    return _INDEXES[at]


@add(f"WITH {BM25} SELECT doc_id, round(raw, 4) AS score FROM bm ORDER BY round(raw, 10) DESC, doc_id LIMIT 20")
def index_topk_bm25(spark, sf_dir):
    """Any term, from the asked terms' blocks of the stored index."""
    return stored_index(spark, sf_dir).top_k(WORDS, 20)


@add(CATALOGUE.oracles["ts_rank_topk"])
def index_topk_all_terms(spark, sf_dir):
    """All terms by text rank, from the stored index."""
    return stored_index(spark, sf_dir).top_k_all(["thing", "with"], 20)


@add()
def index_english_statistics(spark, sf_dir):
    """term, df, cf of the stems of all documents, without stop words."""
    return stored_index(spark, sf_dir, "english").statistics()


@add(f"WITH {BM25}, {KEYWORD_LIST}, {VECTOR_LIST} {fused_sql()}")
def index_hybrid_topk(spark, sf_dir):
    """Hybrid retrieval whose keyword branch reads the stored index."""
    near = fusion.ranked(stored_index(spark, sf_dir).top_k(WORDS, DEPTH, digits=None), "doc_id", "score")
    return fusion.fuse({"vector": _vector_list(spark, sf_dir).select("doc_id", "rank"), "keyword": near.select("doc_id", "rank")}, "doc_id", limit=TOP)


@add(rf"SELECT term, doc_id, count(*) AS tf, any_value(n) AS len FROM (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY ALL")
def index_postings(spark, sf_dir):
    """All postings that the stored index has."""
    rows = stored_index(spark, sf_dir).postings()
    return rows.select("term", F.col("key").alias("doc_id"), F.col("tf").cast("long").alias("tf"), F.col("len").cast("long").alias("len"))


@add(f"WITH {BM25}, {KEYWORD_LIST}, {VECTOR_LIST} {fused_sql(0.3, 0.7)}")
def rrf_weighted(spark, sf_dir):
    lists = {"vector": _vector_list(spark, sf_dir).select("doc_id", "rank"), "keyword": _keyword_list(spark, sf_dir).select("doc_id", "rank")}
    return fusion.fuse(lists, "doc_id", weights={"vector": 0.3, "keyword": 0.7}, limit=TOP)


@add(f"WITH {BM25}, {KEYWORD_LIST}, {VECTOR_LIST}, lng AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT {DEPTH})) "
     + fused_sql(extra="UNION ALL SELECT doc_id, 2, 'length', rank, 1.0 / (60 + rank) FROM lng"))
def rrf_three_sources(spark, sf_dir):
    longest = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(DEPTH)
    lists = {
        "vector": _vector_list(spark, sf_dir).select("doc_id", "rank"), "keyword": _keyword_list(spark, sf_dir).select("doc_id", "rank"), "length": fusion.ranked(longest, "doc_id", "n_chars").select("doc_id", "rank")
    }
    return fusion.fuse(lists, "doc_id", limit=TOP)


@add(f"WITH {VECTOR_LIST} SELECT doc_id, round(1.0 / (60 + rank), 6) AS rrf_score, similarity FROM vec ORDER BY rank LIMIT {TOP}")
def hybrid_fallback_vector_only(spark, sf_dir):
    """The keyword branch finds nothing, so the vector order stands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    none = fusion.ranked(keyword.top_k(keyword.ts_rank(docs, ["qqqq", "zzzz"]), DEPTH, "doc_id").select("doc_id", "score"), "doc_id", "score")
    fused = fusion.fuse({"vector": _vector_list(spark, sf_dir).select("doc_id", "rank", "similarity"), "keyword": none.select("doc_id", "rank")}, "doc_id", limit=TOP)
    return fused.select("doc_id", "rrf_score", "similarity")


@add(rf"""WITH docs AS (SELECT d.doc_id, lang, text, embedding FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id),
q AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY round(raw, 10) DESC, doc_id) AS rank, doc_id FROM (SELECT lang, doc_id, {SIM} AS raw FROM docs)),
l AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS rank, doc_id FROM docs)
SELECT lang, doc_id, place, round(raw, 6) AS rrf_score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY raw DESC, place_key) AS place FROM (
SELECT lang, doc_id, sum(1.0 / (60 + rank)) AS raw, min(ord * 1000000 + rank) AS place_key FROM (SELECT *, 0 AS ord FROM q WHERE rank <= 20 UNION ALL SELECT *, 1 FROM l WHERE rank <= 20) GROUP BY lang, doc_id)) WHERE place <= 3""")
def rrf_batch_per_language(spark, sf_dir):
    """Fusion of many queries at once: a language is a query."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id")
    near = vector_search.similarities(docs, query_vector(spark, sf_dir), None).select("lang", "doc_id", "similarity")
    near = fusion.ranked(near, "doc_id", "similarity", "lang").where("rank <= 20").select("lang", "doc_id", "rank")
    long = docs.select("lang", "doc_id", F.length("text").alias("chars"))
    long = fusion.ranked(long, "doc_id", "chars", "lang").where("rank <= 20").select("lang", "doc_id", "rank")
    fused = fusion.fuse({"near": near, "long": long}, "doc_id", limit=3, query="lang")
    return fused.select("lang", "doc_id", F.col("place").cast("long").alias("place"), "rrf_score")


@add(r"SELECT item_id, trim(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g')) AS cleaned, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))), ' ') AS terms FROM benchmark")
def query_sanitise(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", T.sanitise(text).alias("cleaned"), F.array_join(F.array_sort(T.query_terms(text)), " ").alias("terms"))


_CAMEL = "regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"


@add(rf"""SELECT p_partkey, ident || chr(10) || lower(regexp_replace({_CAMEL.format("replace(ident, '_', ' ')")}, '[ .]+', ' ', 'g')) AS tokens
FROM (SELECT p_partkey, replace(p_name, ' ', '_') || '.getHTTPBrand' || CAST(p_size AS VARCHAR) AS ident FROM part)""")
def identifier_tokens(spark, sf_dir):
    """Compound identifiers with their parts below."""
    ident = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".getHTTPBrand"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", T.with_identifier_parts(ident).alias("tokens"))


@add(r"SELECT doc_id, len(t) AS n_terms, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, " + TOKENS + " AS t FROM documents)")
def doc_term_stats(spark, sf_dir):
    t = T.terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_terms"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@add(rf"SELECT w AS term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS}) AS w FROM documents) GROUP BY ALL) GROUP BY w")
def document_frequency(spark, sf_dir):
    return keyword.term_statistics(table(spark, sf_dir, "documents"))


@add(rf"SELECT doc_id, term, tf, doc_len FROM (SELECT doc_id, w AS term, count(*) AS tf, any_value(n) AS doc_len FROM (SELECT doc_id, unnest(t) AS w, len(t) AS n FROM (SELECT doc_id, {TOKENS} AS t FROM documents)) GROUP BY doc_id, w)")
def postings(spark, sf_dir):
    """The inverted index of all documents."""
    rows = keyword.postings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "term", "tf", F.col("doc_len").cast("long").alias("doc_len"))


@add("""SELECT p_partkey, p_name, match_type, match_priority FROM (SELECT p_partkey, p_name,
CASE WHEN contains(lower(p_type), 'ring') THEN 'file' WHEN contains(lower(p_name), 'ring') AND p_brand = 'Brand#1' THEN 'function' WHEN contains(lower(p_name), 'ring') AND p_brand = 'Brand#2' THEN 'class' ELSE 'content' END AS match_type,
CASE WHEN contains(lower(p_type), 'ring') THEN 1 WHEN contains(lower(p_name), 'ring') THEN 2 ELSE 3 END AS match_priority
FROM part WHERE contains(lower(p_type), 'ring') OR contains(lower(p_name), 'ring')) ORDER BY match_priority, p_name, p_partkey LIMIT 50""")
def symbol_search(spark, sf_dir):
    kind = F.when(F.col("p_brand") == "Brand#1", "function").when(F.col("p_brand") == "Brand#2", "class").otherwise("import")
    rows = table(spark, sf_dir, "part").withColumn("kind", kind)
    return symbols.search(rows, "Ring", 50, "p_type", "p_name", "kind", "p_partkey").select("p_partkey", "p_name", "match_type", "match_priority")


@add("SELECT c_custkey, c_name FROM (SELECT c_custkey, replace(c_name, '#', '_') AS c_name FROM customer) WHERE contains(lower(c_name), 'customer_0000001') ORDER BY c_name, c_custkey LIMIT 30")
def symbol_search_literal_underscore(spark, sf_dir):
    """An underscore is an underscore, not a wildcard."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("#"), F.lit("_")).alias("c_name"), F.lit("").alias("p"), F.lit("x").alias("k"))
    return symbols.search(rows, "customer_0000001", 30, "p", "c_name", "k", "c_custkey").select("c_custkey", "c_name")


@add("SELECT doc_id, replace(substr(text, 1, 150), chr(10), chr(10) || '    ') || CASE WHEN length(text) > 150 THEN '...' ELSE '' END AS preview FROM documents")
def snippet_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@add("SELECT doc_id, sha256(text) AS hash, substr(sha256(text), 1, 16) AS short FROM documents")
def content_sha256(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("hash"), ids.short_hash(F.col("text")).alias("short"))


@add("""SELECT item_id, array_to_string(list_transform(range(0, 128), lambda i: CASE WHEN (CAST('0x' || substr(md5(text), CAST(32 - i // 4 AS BIGINT), 1) AS INTEGER) >> CAST(i % 4 AS INTEGER)) % 2 = 1 THEN '1' ELSE '0' END), '') AS bits,
768 AS dimension, -320.0 AS tail FROM benchmark""")
def mock_embedding(spark, sf_dir):
    """The stand-in model: the first 128 signs, the size and the sum of the constant tail."""
    e = vectors.mock_embedding(F.col("text"))
    bits = F.array_join(F.transform(F.slice(e, 1, 128), lambda x: F.when(x > 0, "1").otherwise("0")), "")
    tail = F.aggregate(F.slice(e, 129, 640), F.lit(0.0), lambda s, x: s + x.cast("double"))
    return table(spark, sf_dir, "benchmark").select("item_id", bits.alias("bits"), F.size(e).alias("dimension"), tail.alias("tail"))


@add("SELECT doc_id, length(substr(text, 1, 4000)) AS chars, sha256(substr(text, 1, 4000)) AS hash FROM documents")
def truncate_for_embedding(spark, sf_dir):
    cut = T.truncate(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(cut).cast("long").alias("chars"), ids.content_hash(cut).alias("hash"))


@add("SELECT s_suppkey, substr(sha256(s_name), 1, 8) AS short_commit, substr(split_part(s_name, chr(10), 1), 1, 40) AS first_line, rpad(s_name, 22, ' ') AS padded FROM supplier")
def registry_columns(spark, sf_dir):
    """Short commits, first lines and padding of the registry listing."""
    name = F.col("s_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.short_commit(ids.content_hash(name)).alias("short_commit"), T.first_line(name, 40).alias("first_line"), F.rpad(name, 22, " ").alias("padded"))


@add("""SELECT page_id, CASE WHEN regexp_extract(path, '(\\.[^./]+)$', 1) = '.py' THEN 'python' WHEN regexp_extract(path, '(\\.[^./]+)$', 1) = '.rb' THEN 'ruby' WHEN regexp_extract(path, '(\\.[^./]+)$', 1) = '.h' THEN 'c' END AS language,
'mod' || CAST(page_id AS VARCHAR) AS stem FROM (SELECT page_id, 'src/a.b/mod' || CAST(page_id AS VARCHAR) || CASE page_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rb' WHEN 2 THEN '.h' ELSE '.txt' END AS path FROM pages)""".replace("\\\\", "\\"))
def path_language(spark, sf_dir):
    suffix = F.element_at(F.array(*[F.lit(s) for s in (".py", ".rb", ".h", ".txt")]), (F.col("page_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("src/a.b/mod"), F.col("page_id").cast("string"), suffix)
    return table(spark, sf_dir, "pages").select("page_id", T.language_of(path).alias("language"), T.stem_of(path).alias("stem"))


@add("""WITH top AS (SELECT vec_id FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 10) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10),
other AS (SELECT vec_id FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 10) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10)
SELECT (SELECT count(*) FROM top SEMI JOIN other USING (vec_id)) AS common, (SELECT count(*) FROM (SELECT * FROM top UNION SELECT * FROM other)) AS together,
round((SELECT count(*) FROM top SEMI JOIN other USING (vec_id)) / (SELECT count(*) FROM (SELECT * FROM top UNION SELECT * FROM other)), 6) AS jaccard""")
def topk_jaccard(spark, sf_dir):
    """Overlap of two result lists."""
    rows = table(spark, sf_dir, "embeddings")
    a, b = (vector_search.top_k(rows, query_vector(spark, sf_dir, i), 10, threshold=None).agg(F.collect_set("vec_id").alias(n)) for i, n in ((0, "a"), (1, "b")))
    both = a.crossJoin(b)
    sizes = [F.size(f("a", "b")).cast("long") for f in (F.array_intersect, F.array_union)]
    return both.select(sizes[0].alias("common"), sizes[1].alias("together"), F.round(analytics.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@add()
def ivf_recall(spark, sf_dir):
    """An inverted-file index over all vectors: recall of probing 7 of 8 cells against the exact search, over every id divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    index = vector_search.InvertedFile.build(rows, scratch_path(spark, "ivf"), cells=8)
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    exact = vector_search.batch_top_k(rows, asked, 10).select("query_id", "vec_id")
    probed = index.batch_top_k(asked, 10, probes=7).select("query_id", "vec_id")
    return exact.join(probed.withColumn("found", F.lit(True)), ["query_id", "vec_id"], "left").agg(F.count("*").alias("wanted"), F.count("found").alias("found"))


@add()
def quantised_recall(spark, sf_dir):
    """Quantised vectors, every id divisible by 100 against all rows: true neighbours among the k best, and the share of the vectors' bytes that was compared."""
    rows = table(spark, sf_dir, "embeddings")
    index = QuantisedIndex.build(rows, scratch_path(spark, "quantised"))
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    exact = vector_search.batch_top_k(rows, asked, 10).select("query_id", "vec_id")
    found = index.batch_top_k(asked, 10, candidates=20).select("query_id", "vec_id")
    return exact.join(found.withColumn("found", F.lit(True)), ["query_id", "vec_id"], "left").agg(F.count("*").alias("wanted"), F.count("found").alias("found"), F.lit(round(index.share_read(20), 4)).alias("share_read"))
