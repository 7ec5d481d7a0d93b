"""What an inverted index costs: nothing that grows with the square of a text."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.sources import keyword_index
from palimpsest.sources.keyword_index import KeywordIndex

#: Buffers outlive the test, and so does what they were taken from.
POOLS = []


@pytest.mark.parametrize("words", [2_000, 8_000])
def test_block_is_linear_in_a_text(spark, monkeypatch, words):
    monkeypatch.setattr(keyword_index, "TaskContext", type("Context", (), {"get": staticmethod(lambda: type("Task", (), {"partitionId": staticmethod(lambda: 0)}))}))
    schema = KeywordIndex(spark, "/nowhere")._schema("postings", {"id": "bigint", "keep": ["user_id"]}).removesuffix(", bucket int")
    tokens = [f"word{i}" for i in range(words)]
    docs = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["u"]), pa.array([tokens])], ["id", "user_id", "tokens"])
    POOLS.append(pool := pa.proxy_memory_pool(pa.default_memory_pool()))
    before = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        (block,) = keyword_index._inverted(256, ["user_id"], to_arrow_schema(StructType.fromDDL(schema)))(iter([docs]))
    finally:
        pa.set_memory_pool(before)
    assert block["term"].to_pylist() == sorted(tokens)
    assert [(p["id"], p["user_id"], p["length"], tokens[p["positions"][0]]) for (p,) in block["postings"].to_pylist()] == [(1, "u", words, t) for t in sorted(tokens)]
    assert pool.max_memory() < 500 * words  # bytes


def test_long_text_is_found(spark, tmp_path):
    rng = np.random.default_rng(1)
    long = " ".join(f"w{i}" for i in rng.permutation(30_000)) + " needle w5"
    docs = spark.createDataFrame([(1, long), (2, "needle"), (3, "w5 w6"), (4, None), (5, "")], "id long, content string")
    found = KeywordIndex.create(spark, str(tmp_path / "index"), docs).top_k("w5", 5).collect()
    assert [r["id"] for r in found] == [3, 1]
