"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read by memory mapping.

A dataset is a folder of parts in ascending key order. Part p has

* ``<p>-<attempt>.bin``: the token ids of its documents, end ids included, little-endian, uint16 where
  the vocabulary allows it, else uint32;
* ``<p>-<attempt>.idx``: uint64 offsets in tokens, one more than the documents, from 0;
* ``<p>-<attempt>.key``: the documents' keys as an Arrow stream (any type, nulls included).

and the manifest, a Parquet table with a row per part. The manifest names the attempt whose files
count, so files of lost or repeated tasks are never read. A part's base is the prefix sum of the token
counts of the parts before it; nothing is renumbered when a part is written again.
"""

from __future__ import annotations

import json
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slatework.llm.text import arrow_batches, input_bytes
from slatework.scratch import materialize, scratch_path

#: Words kept with their ids in a worker; about 110 MB when full.
CACHE = 400_000
#: Bytes of input a part, and of tokens that are read at once where files cannot be mapped.
PART_BYTES, READ_BYTES = 64 << 20, 4 << 20
#: Most tasks that read parts back.
MOST_TASKS = 20_000
_TOKENIZERS: dict[str, "Encoder"] = {}


def _byte_table() -> dict[int, int]:
    """How byte-level vocabularies write bytes that have no visible character."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in visible)}


_BYTES = _byte_table()


class _Words(dict):
    """Ids of a white-space chunk as bytes. Plain words go to the model at once, others through the whole tokeniser."""

    def __init__(self, tokenizer, kind: np.dtype):
        super().__init__()
        self.tokenizer, self.model, self.code = tokenizer, tokenizer.model, "H" if kind.itemsize == 2 else "I"

    @staticmethod
    def plain(word: str) -> bool:
        """Whether a word is one run of letters to the tokeniser too, in either case."""
        return word.isalpha() and (word.isascii() or ("Σ" not in word and unicodedata.is_normalized("NFC", word) and word.lower().isalpha()))

    def __missing__(self, word: str) -> bytes:
        if self.plain(word):
            low = word.lower()
            if low != word:
                ids = self[low]
            else:
                mapped = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTES)
                ids = array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()
        elif word[-1] in ",.!?" and self.plain(word[:-1]):
            ids = self[word[:-1]] + self[word[-1]]
        else:
            ids = array(self.code, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) < CACHE:
            self[word] = ids
        return ids


def _by_word(path: str) -> bool:
    """Whether white space ends every word and is dropped, and words are lower-cased letters, in this tokenizers file.

    The driver asks this once: the parsed file is larger than all that a worker keeps.
    """
    with open(path) as f:
        spec = json.load(f)
    steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
    splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    pattern = splits[0].get("pattern", {}).get("Regex", "") if splits else ""
    model = spec["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    letters = pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and splits[0].get("behavior") == "Removed" and splits[0].get("invert")
    byte = len(splits) == 2 and splits[1]["type"] == "ByteLevel" and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
    return steps == ["NFC", "Replace", "Lowercase"] and bool(letters) and byte and plain and spec["post_processor"] is None


class Encoder:
    """A tokenizers file; where its rules allow it, distinct words are encoded once a worker."""

    def __init__(self, path: str, by_word: bool):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.type = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.words = _Words(self.tokenizer, self.type) if by_word else None
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        """The ids of the whole text, as the tokeniser gives them."""
        # Python splits at \x1c-\x1f too, the tokeniser does not take them as space; special tokens cut words anywhere.
        odd = self.words is None or any(c in text for c in "\x1c\x1d\x1e\x1f") or any(c in text for c in self.special)
        if odd:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


def encoder(path: str, by_word: bool) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path, by_word)
    return _TOKENIZERS[path]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class TokenSet:
    """A written dataset: folder, manifest (part, file, n_docs, n_tokens, base) and the keys' type."""

    path: str
    manifest: DataFrame
    key_type: str


def write(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 2,
    path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> TokenSet:
    """Encode every whole text, append ``end_id``, write the parts in ascending key order.

    A null or empty text is the end id alone. Null keys come first. Rows with equal keys are ordered by
    their text's hash, then text, and stay separate documents; they may be in several parts, but for rows that are wholly equal.
    Other columns are ignored. An empty table gives no parts. The number of parts follows the bytes of the input.
    ``path`` must be a folder that all executors and the driver reach (default: the shared scratch folder).
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    by_word = _by_word(vocabulary)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("th"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), min(-(-input_bytes(docs) // PART_BYTES), MOST_TASKS))
    rows = rows.repartitionByRange(tasks, "key", "th").sortWithinPartitions("key", "th", "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, coder = TaskContext.get().partitionId(), encoder(vocabulary, by_word)
        end = np.array([end_id], coder.type).tobytes()
        fs, base = _open(path)
        stem, sinks, offsets = f"{part:06d}-{uuid.uuid4().hex}", None, [0]
        for batch in batches:
            if not batch.num_rows:
                continue
            if sinks is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{stem}.bin")
                keys = fs.open_output_stream(f"{base}/{stem}.key")
                sinks = out, keys, pa.ipc.new_stream(keys, pa.schema([("key", batch.schema.field(0).type)]))
            for t in batch.column(1):
                ids = coder.encode(t.as_py() or "") + end
                sinks[0].write(ids)
                offsets.append(offsets[-1] + len(ids) // coder.type.itemsize)
            sinks[2].write_batch(pa.RecordBatch.from_arrays([batch.column(0)], ["key"]))
        if sinks:
            sinks[2].close()
            for s in sinks[:2]:
                s.close()
            with fs.open_output_stream(f"{base}/{stem}.idx") as idx:
                idx.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([stem]), pa.array([coder.type.itemsize], pa.int32()), pa.array([len(offsets) - 1], pa.int64()), pa.array([offsets[-1]], pa.int64())],
                ["part", "stem", "width", "n_docs", "n_tokens"],
            )

    parts = rows.mapInArrow(run, "part int, stem string, width int, n_docs long, n_tokens long")
    with arrow_batches(spark, 512):
        # A row per part: in a few files, not one each.
        parts = materialize(parts.repartition(-(-tasks // 4096), "part"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    manifest = parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    manifest.write.parquet(f"{path}/manifest")
    kind = docs.schema[key].dataType.simpleString()
    return TokenSet(path, spark.read.schema(manifest.schema).parquet(f"{path}/manifest"), kind)


def load(spark: SparkSession, path: str, key_type: str = "bigint") -> TokenSet:
    """A dataset written earlier."""
    return TokenSet(path, spark.read.parquet(f"{path}/manifest"), key_type)


def _token_ranges(path: str, width: int, offsets: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """The ids of each document of a part, by reads of about ``at_once`` bytes, or of one longer document."""
    fs, name = _open(path)
    kind, first = np.dtype(f"<u{width}"), 0
    with fs.open_input_file(name) as f:
        while first + 1 < len(offsets):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + np.uint64(at_once // width), "right")) - 1)
            start, end = int(offsets[first]), int(offsets[last])
            held = np.frombuffer(f.read_at((end - start) * width, start * width), kind)
            for i in range(first, last):
                yield held[int(offsets[i]) - start : int(offsets[i + 1]) - start]
            first = last


def documents(path: str, stem: str, width: int, mapped: bool | None = None, at_once: int = READ_BYTES) -> Iterator[tuple[object, int, np.ndarray]]:
    """(key, offset, ids) of each document of a part; local files are memory-mapped (``mapped``), of others ranges are read."""
    fs, base = _open(path)
    mapped = isinstance(fs, pafs.LocalFileSystem) if mapped is None else mapped
    if mapped:
        tokens, offsets = np.memmap(f"{base}/{stem}.bin", f"<u{width}", "r"), np.memmap(f"{base}/{stem}.idx", "<u8", "r")
        found = (tokens[int(x) : int(y)] for x, y in zip(offsets, offsets[1:]))
    else:
        with fs.open_input_file(f"{base}/{stem}.idx") as f:
            offsets = np.frombuffer(f.read(), "<u8")
        found = _token_ranges(f"{path}/{stem}.bin", width, offsets, at_once)
    with fs.open_input_stream(f"{base}/{stem}.key") as f:
        keys = (k.as_py() for batch in pa.ipc.open_stream(f) for k in batch.column(0))
        for k, first, ids in zip(keys, offsets, found):
            yield k, int(first), ids


def digest(tokens: TokenSet) -> DataFrame:
    """Read the files back: per document key, start (ids before it in the dataset), n_tokens, ids_crc32.

    The checksum is over the ids as little-endian uint32, whatever the width of the files.
    """
    path = tokens.path
    # A row per part; the number of tasks is given, else so few bytes would be joined to one task.
    rows = tokens.manifest.select("stem", "width", "base")
    rows = rows.repartition(min(max(1, tokens.manifest.count()), MOST_TASKS), "stem")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                out: list[list] = [[], [], [], []]

                def flush():
                    return pa.RecordBatch.from_arrays([pa.array(out[0], kind), *(pa.array(x, pa.int64()) for x in out[1:])], ["key", "start", "n_tokens", "ids_crc32"])

                for k, first, ids in documents(path, r["stem"], r["width"]):
                    for x, v in zip(out, (k, r["base"] + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))):
                        x.append(v)
                    if len(out[0]) == 8192:
                        yield flush()
                        out = [[], [], [], []]
                yield flush()

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_type(_parse_datatype_string(tokens.key_type))
    return rows.mapInArrow(run, f"key {tokens.key_type}, start long, n_tokens long, ids_crc32 long")
