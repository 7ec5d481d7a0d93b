"""The vector index against a scan of all rows."""

import pytest
from pyspark.sql import functions as F

from palimpsest.errors import DimensionMismatch
from palimpsest.operators.knn import nearest, nearest_for_each
from palimpsest.sources.vector_index import VectorIndex, recall


@pytest.fixture(scope="module")
def vectors(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    return rows.cache()


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    return VectorIndex.create(spark, f"file://{tmp_path_factory.mktemp('index')}/v", vectors, keep=["label"])


def pairs(df):
    return [(r["id"], round(r["score"], 5)) for r in df.collect()]


@pytest.mark.parametrize("metric", ["l1", "l2", "l2_squared"])
def test_exact_search_is_the_scan(spark, vectors, index, metric):
    q = vectors.where("id = 3").first()["vector"]
    assert pairs(index.search(q, 10, metric, 2, exact=True)) == pairs(nearest(vectors, q, 10, metric))
    assert index.cells_read <= index.cells
    where = F.col("label") == "3"
    assert pairs(index.search(q, 5, metric, 1, exact=True, scope={"label": "3"})) == pairs(nearest(vectors, q, 5, metric, where=where))


def test_a_near_question_reads_few_cells(spark, tmp_path):
    rows = spark.range(2000).select("id", F.array(*((F.col("id") % 20 * 100 + (F.col("id") * 7 % (k + 3))).cast("float") for k in range(4))).alias("vector"))
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", rows, cells=20)
    q = [500.0, 501.0, 500.0, 502.0]
    assert pairs(index.search(q, 10, probes=1, exact=True)) == pairs(nearest(rows, q, 10))
    assert index.cells_read < index.cells / 2
    index.search(q, 10)
    assert index.cells_read < index.cells / 2
    plan = index._live(index._state(), [1, 2], {})._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_recall_of_a_batch(spark, vectors, index):
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    truth = nearest_for_each(vectors, asked, 10)
    exact = index.search_each(asked, 10, probes=2, exact=True)
    key = lambda df: sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())
    assert key(exact) == key(truth)
    some = recall(index.search_each(asked, 10), truth)
    assert some.agg(F.avg("recall")).first()[0] >= 0.9


def test_recall_of_more_rows(spark):
    """Two thousand vectors, and a question for each id divisible by 50; and vectors with clusters, which need few cells."""
    from palimpsest import queries

    assert queries.ann_recall(spark, "/root/testdata/sf0.1").agg(F.avg("recall")).first()[0] >= 0.9


def test_updates(spark, vectors, tmp_path):
    index = VectorIndex.create(spark, f"file://{tmp_path}/v", vectors, keep=["label"], cells=9)
    far = spark.createDataFrame([(9001, [9.0] * 64, "x"), (9002, [-3.0] * 64, "x")], "id long, vector array<float>, label string") if len(vectors.first()["vector"]) == 64 else vectors.limit(2).select((F.col("id") + 9001).alias("id"), F.transform("vector", lambda x: (x * 9 + 3).cast("float")).alias("vector"), "label")
    moved = vectors.where("id < 40").select("id", F.transform("vector", lambda x: (x + 0.5).cast("float")).alias("vector"), "label")
    index.update(far.unionByName(moved), moved)
    index.update(gone=vectors.where("id BETWEEN 40 AND 50"))
    now = vectors.where("id > 50").unionByName(far).unionByName(moved)
    q = moved.where("id = 7").first()["vector"]
    assert pairs(index.search(q, 20, probes=1, exact=True)) == pairs(nearest(now, q, 20))
    with pytest.raises(DimensionMismatch):
        index.update(spark.createDataFrame([(1, [1.0], "x")], "id long, vector array<float>, label string"))
    with pytest.raises(DimensionMismatch):
        index.search([1.0], 3)
    none = VectorIndex.create(spark, f"file://{tmp_path}/none", vectors.limit(0))
    assert none.search([1.0] * 8, 3, exact=True).count() == 0


@pytest.mark.parametrize("metric", ["l1", "l2", "l2_squared"])
def test_blocks_give_what_the_folds_give(spark, monkeypatch, metric):
    """Vectors of unequal length, nulls, ties, strings as ids, over several blocks of rows and of questions."""
    from pyspark.sql import Window

    from palimpsest.functions.vector import METRICS
    from palimpsest.operators import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 40)
    monkeypatch.setattr(knn, "BLOCK_ASKED", 7)
    monkeypatch.setattr(knn, "TILE_ROWS", 16)
    vector = F.transform(F.sequence(F.lit(0), (F.col("n") % 3 + 2).cast("int")), lambda i: ((F.col("n") * 37 + i * 11) % 23 / 7).cast("float"))
    rows = spark.range(150).toDF("n").select(F.concat(F.lit("r"), F.col("n").cast("string")).alias("id"), F.when(F.col("n") != 20, vector).alias("vector"))
    asked = spark.range(0, 150, 8).toDF("n").select(F.struct("n").alias("query_id"), F.when(F.col("n") != 40, vector).alias("query_vector"))
    scored = rows.crossJoin(asked).select("query_id", "id", METRICS[metric](F.col("vector"), F.col("query_vector")).alias("score"))
    want = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where("rank <= 6")
    key = lambda df: sorted((r["query_id"]["n"], r["rank"], r["id"], r["score"]) for r in df.collect())
    found = nearest_for_each(rows, asked, 6, metric)
    assert key(found) == key(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan  # no row for each pair


def test_a_batch_passes_over_the_rows_once(spark, vectors, index):
    asked = vectors.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    plan = index.search_each(asked, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "Union" not in plan  # neither questions beside all centroids, nor a scan for each block of them
