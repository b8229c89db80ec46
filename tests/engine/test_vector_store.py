"""Builds embed a text once: only the changed snippet of a file, and equal ones of two codebases together."""

import hashlib
import os
from glob import glob

from pyspark.sql import functions as F

from slatework.functions import vectors
from slatework.plans.api import Engine
from slatework.streaming import incremental


class Counting:
    key = "counting"

    def __init__(self, folder):
        self.folder = str(folder)

    def embed_batch(self, texts):
        with open(f"{self.folder}/{os.urandom(8).hex()}", "w") as f:
            f.write("\x1e".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def take(self):
        found = [t for f in glob(f"{self.folder}/*") for t in open(f).read().split("\x1e")]
        for f in glob(f"{self.folder}/*"):
            os.remove(f)
        return found


def test_builds_share_vectors(spark, tmp_path):
    (tmp_path / "asked").mkdir()
    functions = [f"def f{i}(a):\n    return a + {i}\n" for i in range(100)]
    for tree in ("one", "two"):
        (tmp_path / tree).mkdir()
        (tmp_path / tree / "many.py").write_text("\n\n".join(functions))
    provider = Counting(tmp_path / "asked")
    engine = Engine(spark, str(tmp_path / "store"), provider=provider)
    engine.registry.register(spark.createDataFrame([("one", "o/1"), ("two", "o/2")], "name string, github_repo string"))
    incremental.build(engine, "one", str(tmp_path / "one"))
    first = provider.take()
    assert len(first) == len(set(first)) >= 100
    incremental.build(engine, "two", str(tmp_path / "two"))
    assert provider.take() == []
    functions[41] = "def f41(a):\n    return a - 41\n"
    (tmp_path / "one" / "many.py").write_text("\n\n".join(functions))
    incremental.build(engine, "one", str(tmp_path / "one"))
    asked = provider.take()
    assert [t for t in asked if len(t) < 100] == ["def f41(a):\n    return a - 41"] and len(asked) <= 2
    rows = engine.corpus("one").where("name = 'f41'").collect()
    assert len(rows) == 1 and rows[0].embedding == [float(len(rows[0].content)), 1.0]


def test_the_stand_in_hashes_a_text_once(spark):
    """The text is outside of what is evaluated for every component."""
    rows = spark.createDataFrame([("a",), (None,), ("",)], "text string")
    got = [r.v for r in rows.select(vectors.mock_embedding(F.col("text"), 130).alias("v")).collect()]
    number = int(hashlib.md5(b"a").hexdigest(), 16)
    assert got[0] == [(number >> i & 1) - 0.5 for i in range(128)] + [-0.5] * 2 and len(got[2]) == 130
    plan = rows.select(vectors.mock_embedding(F.col("text"), 16).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1 and plan.index("md5") < plan.index("lambdafunction")
