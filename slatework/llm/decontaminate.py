"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, in DataFrame operations only.

Words are lower-cased runs of letters, digits and non-ASCII characters. The benchmark's windows of
``width`` words (a shorter item is one window) are hashed and broadcast; every token window of
every document is looked up, hits are verified word by word, and hit words are merged to spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slatework.llm.text import NON_ALNUM, ascii_lower, split_words
from slatework.scratch import materialize, scratch_path

#: Benchmark windows broadcast at once (about 200 bytes each). A larger benchmark is looked up in blocks of this many, one after the other.
BLOCK = 200_000
#: Most rows of a window that many items have.
CHUNKS = 64
#: Document words to a code: position times this, plus the window's words.
CODE = 16


def normalised_words(text: Column) -> Column:
    """The words that windows are made of; null has none."""
    return split_words(ascii_lower(text), NON_ALNUM)


def windows_of(benchmark: DataFrame, width: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of a benchmark: gram (words), len, hash, chunk, items (ids of the items that have it).

    A window of many items has up to CHUNKS rows, a share of its items in each. Items without words have no window; null ids are left out of items, their windows still count as hits.
    """
    if not 0 < width < CODE:
        raise ValueError(f"a window has 1 to {CODE - 1} words")
    rows = benchmark.select(F.col(item).cast("string").alias("item"), normalised_words(F.col(text)).alias("w"))
    rows = rows.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(width)))
    rows = rows.select("item", "w", "len", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    grams = rows.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("gram"))
    chunk = F.coalesce(F.pmod(F.xxhash64("item"), F.lit(CHUNKS)), F.lit(0)).alias("chunk")
    grams = grams.groupBy("gram", "len", chunk).agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grams.select("gram", "len", F.xxhash64("gram").alias("hash"), "chunk", "items")


def _scan(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """A row per document (code 0) and per hit: key, th, n, code, items."""
    n = F.size("w")
    codes = F.array(F.lit(0))
    for length in lengths:
        some = F.sequence(F.lit(CODE + length), (n - length + 1) * CODE + length, F.lit(CODE))
        codes = F.concat(codes, F.when(n >= length, some).otherwise(F.array().cast("array<int>")))
    rows = docs.select("key", "th", "w", n.alias("n"), F.explode(codes).alias("code"))
    if not lengths:
        return rows.select("key", "th", "n", "code", F.lit(None).cast("array<string>").alias("items"))
    gram = F.when(F.col("code") > 0, F.slice("w", F.shiftright("code", 4), F.col("code").bitwiseAND(CODE - 1)))
    rows = rows.select("key", "th", "n", "code", gram.alias("g"), F.xxhash64(gram).alias("h"))
    found = rows.join(F.broadcast(windows), (rows.h == windows.hash) & (rows.g == windows.gram), "left")
    return found.where((F.col("code") == 0) | F.col("items").isNotNull()).select("key", "th", "n", "code", "items")


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document row: key, th (hash of the text), n_words, spans, n_hit, items.

    spans: hit words as (first, last) positions from 0, merged and ascending. Rows with null or empty
    text have no words and no hits. Equal (key, text) rows give equal results, one row each; equal keys
    with other texts stay apart. Extra columns are ignored. A benchmark without words hits nothing.
    The benchmark's windows are broadcast in blocks of about ``block`` rows and item ids. If there are several, texts are cut into words once and
    blocks follow one another, each a job of its own that leaves its hits, so that no task or driver ever holds two.
    """
    # At most width distinct lengths and one count come to the driver.
    windows = materialize(windows_of(benchmark, width), "windows")
    sizes = {r["len"]: r["n"] for r in windows.groupBy("len").agg(F.sum(F.size("items") + 1).alias("n")).collect()}
    blocks = max(1, -(-sum(sizes.values()) // block))
    words = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), normalised_words(F.col(text)).alias("w"))
    if blocks == 1:
        rows = _scan(words, windows, sorted(sizes))
    else:
        words = materialize(words, "words")
        path = scratch_path(docs.sparkSession, "block-hits")
        for b in range(blocks):
            part = windows.where(F.pmod(F.xxhash64("hash", "chunk"), F.lit(blocks)) == b)
            found = _scan(words, part, sorted(sizes)).where(F.col("code") > 0)
            found.write.mode("append").parquet(path)
        rows = _scan(words, windows, []).unionByName(docs.sparkSession.read.schema(found.schema).parquet(path))
    grouped = rows.groupBy("key", "th").agg(
        F.max("n").cast("long").alias("n_words"),
        F.sum((F.col("code") == 0).cast("int")).cast("int").alias("repeats"),
        F.array_sort(F.collect_set(F.when(F.col("code") > 0, F.col("code")))).alias("codes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    first = lambda c: F.shiftright(c, 4) - 1
    covered = F.transform("codes", lambda c: F.sequence(first(c), first(c) + c.bitwiseAND(CODE - 1) - 1))
    grouped = grouped.withColumn("hit", F.array_sort(F.array_distinct(F.flatten(covered))))
    starts = F.filter("hit", lambda p, i: F.coalesce(F.get("hit", i - 1) < p - 1, F.lit(True)))
    ends = F.filter("hit", lambda p, i: F.coalesce(F.get("hit", i + 1) > p + 1, F.lit(True)))
    spans = F.arrays_zip(starts.alias("first"), ends.alias("last"))
    merged = grouped.select("key", "th", "n_words", spans.alias("spans"), F.size("hit").cast("long").alias("n_hit"), "items", "repeats")
    copies = F.explode(F.sequence(F.lit(1), "repeats")).alias("copy")
    return merged.select("key", "th", "n_words", "spans", "n_hit", "items", copies).drop("copy")


def remove_documents(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without any hit, all their columns as they were; null and empty texts stay."""
    found = hits(docs, benchmark, width, key, text).where("n_hit > 0").select(F.col("key").alias("__hit_key"), F.col("th").alias("__hit_th")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = held["row"][key].eqNullSafe(found["__hit_key"]) & (F.xxhash64(held["row"][text]) == found["__hit_th"])
    return held.join(found, same, "left_anti").select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, width: int = 10, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All documents, with every hit word and the separators after it cut from the text; other texts stay as they were."""
    found = hits(docs, benchmark, width, key, text).where("n_hit > 0").select("key", "th", "spans").dropDuplicates(["key", "th"])
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    on = held["row"][key].eqNullSafe(found["key"]) & (F.xxhash64(held["row"][text]) == found["th"])
    joined = held.join(found, on, "left")
    whole = held["row"][text]
    # Pieces are a word and what follows it; what stands before the first word is kept in front.
    # The text keeps its case: capitals are word characters here.
    separator = NON_ALNUM[1:-2].replace("\\x3A-\\x60", "\\x3A-\\x40\\x5B-\\x60")
    lead = F.regexp_extract(whole, f"^[{separator}]*", 0)
    pieces = F.regexp_extract_all(whole, F.lit(f"[^{separator}]+[{separator}]*"), F.lit(0))
    hit = F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))
    kept = F.filter(pieces, lambda _, i: ~F.array_contains(hit, i))
    cut = F.when(F.col("spans").isNotNull(), F.concat(lead, F.concat_ws("", kept))).otherwise(whole)
    return joined.select(*[cut.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
