"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slatework.llm import decontaminate, extraction, fertility, licences, linededup, manifest, mixing, quotes, simhash, tokenbin, toxicity, warc
from slatework.llm.text import ascii_lower, count_words, read

#: Vocabulary files of public tokenisers; the path is a parameter of every operator that uses one.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def op1_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with the message it answers, its thread and its text without quotes."""
    rows = quotes.conversations(read(spark, sf_dir, "conversations"))
    links = ["n_quoted", "n_linked", "to_conv", "to_turn", "root_conv", "root_turn", "depth", "place"]
    return rows.select("row.conv_id", "row.turn", "row.role", *links, F.length("body").cast("long").alias("body_chars"), F.sha2("body", 256).alias("body_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes by SimHash."""
    rows = simhash.classes(read(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.select(F.col("key").alias("doc_id"), text.alias("fingerprint"), F.col("component").alias("component_id"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back."""
    rows = warc.resolve(warc.write(read(spark, sf_dir, "pages")))
    number = lambda c: F.when(~F.col(c).startswith("null"), F.col(c)).cast("long").alias(c)
    rows = rows.select(number("page"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to"))
    return rows.withColumnRenamed("page", "page_id")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op5_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    rows = fertility.score(read(spark, sf_dir, "documents"), PIECE_VOCABULARY, keep=("doc_id",))
    base = ["row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return rows.select(*base, F.round("chars_per_token", 6).alias("chars_per_token"), F.round("byte_share", 6).alias("byte_share"), F.round("entropy", 6).alias("entropy"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; a fifth of the ids is held out of training."""
    docs = read(spark, sf_dir, "documents")
    held = lambda c: F.crc32(c.cast("string")) % 5 == 0
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(~held(F.col("doc_id"))))
    rows = toxicity.score(docs, model)
    score = F.round("score", 6)
    return rows.select(
        F.col("key").alias("doc_id"), F.coalesce(held(F.col("key")), F.lit(False)).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted")
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies that the mix takes of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", count_words(F.col("text")).alias("words"))
    rows = mixing.mix(docs, F.col("words"))
    return rows.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses to earlier similar lines."""
    docs = read(spark, sf_dir, "documents")
    gone = linededup.removals(docs)
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    sizes = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"))
    rows = sizes.join(gone, sizes["doc_id"].eqNullSafe(gone["key"]) & (sizes["h"] == gone["th"]), "left")
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), F.sha2(F.array_join(removed.cast("array<string>"), ","), 256).alias("removed_sha256"))


def op9_tokenbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    tokens = tokenbin.write(read(spark, sf_dir, "documents"), WORD_VOCABULARY)
    return tokenbin.digest(tokens).withColumnRenamed("key", "doc_id")


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that every document declares."""
    rows = licences.scan(read(spark, sf_dir, "documents"))
    known = F.filter("licences", lambda x: x["family"] != "unknown")
    families = F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"])))
    lines = F.array_sort(F.array_distinct(F.transform(known, lambda x: x["line"]))).cast("array<string>")
    return rows.select(
        F.col("key").alias("doc_id"), F.array_join(families, ",").alias("families"), F.array_join(lines, ",").alias("lines"),
        F.size(known).cast("long").alias("n_found"), (F.size("licences") - F.size(known)).cast("long").alias("n_unknown"),
    )


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.train(pages)).withColumnRenamed("page", "page_id")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and root of every document, and what a third of them, tampered with, would give."""
    docs = read(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    tree = manifest.build(docs, manifest.row_digest(*fields, F.col("text")), "lang", "doc_id", manifest.row_digest(*fields, changed))
    rows = manifest.prove(tree)
    return rows.select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified")
    )


QUERIES = {
    "op1_quotes": op1_quotes,
    "op2_simhash": op2_simhash,
    "op3_warc": op3_warc,
    "op4_decontaminate": op4_decontaminate,
    "op5_fertility": op5_fertility,
    "op6_toxicity": op6_toxicity,
    "op7_mixing": op7_mixing,
    "op8_linededup": op8_linededup,
    "op9_tokenbin": op9_tokenbin,
    "op10_licences": op10_licences,
    "op11_extraction": op11_extraction,
    "op12_manifest": op12_manifest,
}
ORACLES: dict[str, str] = {
    "op1_quotes": r"""
WITH RECURSIVE lines AS (
  SELECT conv_id AS conv, turn, hash(text) AS th, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line
  FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL)
), parsed AS (
  SELECT conv, turn, th, line, length(regexp_replace(regexp_extract(raw, '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level, regexp_replace(raw, '^((?:[ \t]*>)+)[ \t]?', '') AS bare
  FROM lines
), marked AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY conv, turn, th ORDER BY line) THEN 1 ELSE 0 END AS begins FROM parsed
), numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY conv, turn, th ORDER BY line) AS passage FROM marked
), runs AS (
  SELECT conv, turn, th, passage, level, string_agg(bare, chr(10) ORDER BY line) AS content FROM numbered GROUP BY ALL
), parts AS (
  SELECT conv, turn, th, passage, level, 0 AS grain, 0 AS part, content FROM runs
  UNION ALL
  SELECT conv, turn, th, passage, level, 1, generate_subscripts(regexp_split_to_array(content, '\n[\x09-\x0D ]*\n'), 1), unnest(regexp_split_to_array(content, '\n[\x09-\x0D ]*\n')) FROM runs
  UNION ALL
  SELECT conv, turn, th, passage, level, 2, generate_subscripts(string_split(content, chr(10)), 1), unnest(string_split(content, chr(10))) FROM runs
), units AS (
  SELECT conv, turn, th, passage, level, grain, trim(regexp_replace(lower(regexp_replace(content, '^((?:[ \t]*>)+)[ \t]?', '')), '[\x09-\x0D ]+', ' ', 'g')) AS content FROM parts
), own AS (SELECT conv, turn, content FROM units WHERE level = 0 AND content <> '' AND turn IS NOT NULL),
near_by AS (SELECT conv, content, min(turn) AS to_turn FROM own GROUP BY ALL),
far_off AS (SELECT conv, content, to_turn, row_number() OVER (PARTITION BY content ORDER BY conv NULLS LAST) AS place FROM near_by),
found AS (
  SELECT q.*, len(string_split(q.content, ' ')) AS words, CASE WHEN n.to_turn IS NOT NULL THEN q.conv WHEN f1.conv IS DISTINCT FROM q.conv THEN f1.conv ELSE f2.conv END AS to_conv,
    CASE WHEN n.to_turn IS NOT NULL THEN n.to_turn WHEN f1.conv IS DISTINCT FROM q.conv THEN f1.to_turn ELSE f2.to_turn END AS to_turn
  FROM units q
  LEFT JOIN near_by n ON q.conv = n.conv AND q.content = n.content AND n.to_turn < q.turn
  LEFT JOIN far_off f1 ON q.content = f1.content AND f1.place = 1
  LEFT JOIN far_off f2 ON q.content = f2.content AND f2.place = 2
  WHERE q.level > 0 AND q.content <> ''
), sums AS (
  SELECT conv, turn, th, passage, level, grain, to_conv, to_turn, sum(words) AS words FROM found GROUP BY ALL
), links AS (
  SELECT conv, turn, th, passage, level, CASE WHEN to_turn IS NOT NULL THEN words END AS words, to_conv, to_turn FROM (
    SELECT *, row_number() OVER (PARTITION BY conv, turn, th, passage, level ORDER BY to_turn IS NULL, grain, words DESC, to_conv IS DISTINCT FROM conv, to_turn DESC, to_conv NULLS LAST) AS r FROM sums
  ) WHERE r = 1
), votes AS (
  SELECT conv, turn, to_conv, to_turn, sum(words) AS words FROM links WHERE level = 1 AND to_conv IS NOT NULL GROUP BY ALL
), best AS (
  SELECT conv, turn, to_conv, to_turn, row_number() OVER (PARTITION BY conv, turn ORDER BY words DESC, to_turn DESC, to_conv) AS r FROM votes
), counts AS (
  SELECT conv, turn, count(*) AS n_quoted, count(to_turn) AS n_linked FROM links GROUP BY ALL
), ids AS (SELECT DISTINCT conv_id AS conv, turn FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
parents AS (
  SELECT i.conv, i.turn, coalesce(s.n_quoted, 0) AS n_quoted, coalesce(s.n_linked, 0) AS n_linked,
    CASE WHEN b.to_turn IS NOT NULL THEN b.to_conv WHEN p.turn IS NOT NULL THEN i.conv END AS to_conv,
    CASE WHEN b.to_turn IS NOT NULL THEN b.to_turn WHEN p.turn IS NOT NULL THEN i.turn - 1 END AS to_turn
  FROM ids i LEFT JOIN counts s USING (conv, turn) LEFT JOIN best b ON i.conv = b.conv AND i.turn = b.turn AND b.r = 1
  LEFT JOIN ids p ON p.conv = i.conv AND p.turn = i.turn - 1
), walk AS (
  SELECT conv, turn, conv AS root_conv, turn AS root_turn, 0 AS depth, [{'c': conv, 't': turn}] AS path FROM parents WHERE to_turn IS NULL
  UNION ALL
  SELECT p.conv, p.turn, t.root_conv, t.root_turn, t.depth + 1, list_append(t.path, {'c': p.conv, 't': p.turn}) FROM parents p JOIN walk t ON p.to_conv = t.conv AND p.to_turn = t.turn
), tree AS (
  SELECT *, row_number() OVER (PARTITION BY root_conv, root_turn ORDER BY path) - 1 AS place FROM walk
)
SELECT m.conv_id, m.turn, m.role, CAST(coalesce(p.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(p.n_linked, 0) AS BIGINT) AS n_linked,
  p.to_conv, p.to_turn, coalesce(t.root_conv, p.conv) AS root_conv, coalesce(t.root_turn, p.turn) AS root_turn,
  CAST(CASE WHEN p.conv IS NOT NULL THEN coalesce(t.depth, 0) END AS BIGINT) AS depth, CAST(CASE WHEN p.conv IS NOT NULL THEN coalesce(t.place, 0) END AS BIGINT) AS place,
  length(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10))) AS body_chars,
  sha256(array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: NOT regexp_matches(x, '^[ \t]*>')), chr(10))) AS body_sha256
FROM conversations m LEFT JOIN parents p ON m.conv_id = p.conv AND m.turn = p.turn LEFT JOIN tree t ON m.conv_id = t.conv AND m.turn = t.turn
""",
    "op3_warc": """
WITH raw AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
hashed AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex FROM raw),
first AS (SELECT hex, payload_bytes, min(page_id) AS first_id FROM hashed GROUP BY ALL),
coded AS (SELECT hex, array_to_string(list_transform(range(0, 32), lambda i:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (CAST('0x' || substr(hex, CAST(1 + (i // 4) * 5 AS BIGINT), 5) AS INTEGER) // CAST(pow(32, 3 - i % 4) AS INTEGER)) % 32]), '') AS digest FROM (SELECT DISTINCT hex FROM hashed))
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN first USING (hex, payload_bytes) JOIN coded USING (hex)
""",
    "op4_decontaminate": r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), grams AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), doc_grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc_words CROSS JOIN (SELECT DISTINCT k FROM grams))
), hits AS (SELECT DISTINCT doc_id, k, i, item_id FROM doc_grams JOIN grams USING (k, gram)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN places p USING (doc_id) LEFT JOIN items i USING (doc_id)
""",
    "op12_manifest": r"""
WITH RECURSIVE crc_steps AS (
  SELECT n, n AS c, 0 AS k FROM range(0, 256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE k = 8),
marked AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a // 256, t[1 + xor(a, b) % 256])), 4294967295) % 3 = 0 AS tampered FROM documents, crc_table
), fields AS (
  SELECT doc_id, lang, tampered, text, concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END,
    CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END, CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head FROM marked
), digests AS (
  SELECT doc_id, lang, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END) END)) AS claim FROM fields
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
    count(*) OVER (PARTITION BY lang) AS total FROM digests
), lower_nodes AS (
  SELECT tree, 0 AS level, idx, leaf AS h, total AS width FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), max((width + 7) // 8) FROM lower_nodes WHERE width > 1 GROUP BY tree, level, idx // 8
), upper_nodes AS (
  SELECT 0 AS level, tree AS idx, h, (SELECT count(*) FROM lower_nodes WHERE width = 1) AS width FROM lower_nodes WHERE width = 1
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), max((width + 7) // 8) FROM upper_nodes WHERE width > 1 GROUP BY level, idx // 8
), runs AS (
  SELECT tree, level, idx // 8 AS up, list(h ORDER BY idx) AS hs FROM lower_nodes WHERE width > 1 GROUP BY ALL
  UNION ALL
  SELECT -1, level, idx // 8, list(h ORDER BY idx) FROM upper_nodes WHERE width > 1 GROUP BY ALL
), heights AS (SELECT tree, max(level) AS height FROM lower_nodes GROUP BY 1),
nodes_above AS (
  SELECT doc_id, leaf, claim, l.tree, CASE WHEN height = 0 THEN -1 ELSE l.tree END AS at_tree, 0 AS level, CASE WHEN height = 0 THEN l.tree ELSE idx END AS idx, height,
    CAST([] AS VARCHAR[]) AS siblings, claim AS folded, l.idx AS place FROM leaves l JOIN heights USING (tree)
  UNION ALL
  SELECT doc_id, leaf, claim, n.tree, CASE WHEN at_tree = -1 OR n.level + 1 = height THEN -1 ELSE at_tree END,
    CASE WHEN at_tree <> -1 AND n.level + 1 = height THEN 0 ELSE n.level + 1 END, CASE WHEN at_tree <> -1 AND n.level + 1 = height THEN n.tree ELSE idx // 8 END, height,
    list_concat(siblings, list_concat(hs[1 : idx % 8], hs[idx % 8 + 2 :])),
    sha256(concat(array_to_string(hs[1 : idx % 8], ''), folded, array_to_string(hs[idx % 8 + 2 :], ''))), place
  FROM nodes_above n JOIN runs r ON r.tree = n.at_tree AND r.level = n.level AND r.up = n.idx // 8
), ends AS (
  SELECT *, row_number() OVER (PARTITION BY tree, place ORDER BY len(siblings) DESC, at_tree, level DESC) AS r FROM nodes_above
)
SELECT doc_id, leaf, (SELECT h FROM lower_nodes s WHERE s.tree = e.tree AND s.width = 1) AS subroot, (SELECT h FROM upper_nodes WHERE width = 1) AS root,
  sha256(array_to_string(siblings, '')) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM upper_nodes WHERE width = 1) AS verified
FROM ends e WHERE r = 1
""",
}
