"""A stored index of vectors: cells around k-means centroids as partitions, so that a search opens the cells near its question only.

With ``exact`` a search goes on to every cell that could still hold a nearer vector: by the triangle inequality none of a cell's is
nearer than its centroid less the cell's radius. Without, it stops after ``probes`` cells, as many as were found to hold
nearly all true neighbours when the index was made, and ``recall`` says what that costs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..errors import DimensionMismatch, Validation
from ..functions.vector import METRICS, l1, l2, literal
from ..operators.knn import block_rows, in_blocks, nearest_for_each
from ..session import shared_path
from .commits import Commits

#: Rows that centroids are fitted on, at most; cells, at most (their centroids go to every task).
SAMPLE, MAX_CELLS = 50_000, 4096
#: Rows that are asked about to find how many cells a search needs.
CHECKED = 100
#: Distances are single-precision sums; a bound gives way by this share of what it is made of.
SLACK = 1e-5


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.commits = spark, Commits(spark, path)
        #: Cells of the index, and those that the last single search read.
        self.cells, self.cells_read = 0, 0

    # Writing

    @classmethod
    def create(cls, spark: SparkSession, path: str, rows: DataFrame, keep: Sequence[str] = (), cells: int | None = None, sample: int = SAMPLE, iterations: int = 10, seed: int = 7, source: int = 0, recall_of: float = 0.95, metric: str = "l1") -> VectorIndex:
        """An index of all ``rows`` (id, vector, and string columns to ``keep`` for filters).

        Centroids are fitted on the ``sample`` rows whose ids have the smallest hashes; every row is then dealt to the
        nearest one. By default there are as many cells as the square root of the rows, MAX_CELLS at most. Rows without a vector aren't found. ``source`` is the version of a store that the rows are. How many cells a search
        reads unless it is told is measured: for CHECKED rows as questions, all rows are scanned for the ten nearest by ``metric``, and the
        cells are as many as hold the share ``recall_of`` of these. Vectors without clusters need most cells.
        """
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self = cls(spark, path)
        have = rows.where(F.col("vector").isNotNull())
        n, least, most = have.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if n and least != most:
            raise DimensionMismatch(least, most)
        cells = min(MAX_CELLS, cells or max(1, round(n**0.5)))
        centroids: list[list[float]] = []
        if n:
            some = have.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
            model = KMeans(k=cells, maxIter=iterations, seed=seed).fit(some.repartition(max(1, min(sample, n) // 5000)).cache() if n > 5000 else some.coalesce(1).cache())
            centroids = [[float(x) for x in c] for c in model.clusterCenters()]
        spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cell int, centroid array<float>").coalesce(1).write.parquet(f"{self.commits.path}/centroids")
        meta = {"keep": list(keep), "id": rows.schema["id"].dataType.simpleString(), "dimension": most or 0}
        self._commit({"meta": meta, "parts": {}, "radii": {}}, have, None, source)
        if n:
            state = self._state()
            state["meta"]["probes"] = self._needed(state, recall_of, metric)
            self.commits.write(self.commits.latest() + 1, state)
        return self

    def _needed(self, state: dict, share: float, metric: str) -> int:
        """In how many of the nearest cells that ``share`` of true neighbours lie."""
        rows = self._live(state, None, {})
        asked = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CHECKED).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
        asked = self.spark.createDataFrame(asked.collect(), asked.schema)  # CHECKED rows
        true = nearest_for_each(rows, asked, 11, metric).where(F.col("id") != F.col("query_id")).join(rows.select("id", "cell"), "id")
        apart = (l1 if metric == "l1" else l2)(F.col("query_vector"), F.col("centroid"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(apart, "cell"))
        cells = asked.crossJoin(F.broadcast(self._centroids())).select("query_id", "cell", place.alias("place"))
        return int(true.join(cells, ["query_id", "cell"]).agg(F.coalesce(F.percentile("place", share), F.lit(1))).first()[0] + 0.999)

    @property
    def source(self) -> int:
        """The version of the store that the index stands for."""
        return self._state()["source"]

    def _state(self) -> dict:
        return self.commits.read(self.commits.latest())

    def _centroids(self) -> DataFrame:
        return self.spark.read.schema("cell int, centroid array<float>").parquet(f"{self.commits.path}/centroids")

    def _schema(self, kind: str, meta: dict) -> str:
        kept = "".join(f", {c} string" for c in meta["keep"])
        return {"rows": f"id {meta['id']}, vector array<float>{kept}, cell int", "deaths": f"id {meta['id']}"}[kind]

    def _dealt(self, rows: DataFrame, meta: dict) -> DataFrame:
        """``rows`` with the cell of the nearest centroid, the first on ties."""
        centres = np.array([r["centroid"] for r in self._centroids().orderBy("cell").collect()], np.float64)  # MAX_CELLS at most
        square = (centres**2).sum(1)

        @F.pandas_udf("int")
        def cell(vectors: pd.Series) -> pd.Series:
            out = []
            for at in range(0, len(vectors), 1024):
                x = np.stack(vectors.iloc[at : at + 1024].to_numpy()).astype(np.float64)
                out.append((square - 2 * x @ centres.T).argmin(1))
            return pd.Series(np.concatenate(out) if out else [], dtype="int32")

        return rows.select("id", "vector", *meta["keep"], cell("vector").alias("cell"))

    def _commit(self, state: dict, new: DataFrame | None, gone: DataFrame | None, source: int) -> None:
        version, meta = self.commits.latest() + 1, state["meta"]
        parts = {k: dict(v) for k, v in state["parts"].items()}
        radii = dict(state["radii"])
        if new is not None and meta["dimension"]:
            files = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            dealt = self._dealt(new, meta).repartitionByRange(files, "cell", "id").sortWithinPartitions("cell", "id")  # a large cell is many files
            name = self.commits.put(dealt, "rows", ("cell",))
            parts.setdefault("rows", {})[name] = version
            written = self.commits.get("rows", {name: version}, self._schema("rows", meta)).join(F.broadcast(self._centroids()), "cell")
            for r in written.groupBy("cell").agg(F.max(l1(F.col("vector"), F.col("centroid"))).alias("l1"), F.max(l2(F.col("vector"), F.col("centroid"))).alias("l2")).collect():  # a row for each cell
                old = radii.get(str(r["cell"]), [0.0, 0.0])
                radii[str(r["cell"])] = [max(old[0], r["l1"]), max(old[1], r["l2"])]
        if gone is not None:
            parts.setdefault("deaths", {})[self.commits.put(gone.select("id"), "deaths")] = version
        self.commits.write(version, {"meta": meta, "parts": parts, "radii": radii, "source": source})

    def update(self, new: DataFrame | None = None, gone: DataFrame | None = None, source: int | None = None) -> None:
        """Adds the rows ``new`` (id, vector, kept columns) and takes away the ids ``gone``; a changed row is in both. Centroids stay as they were fitted."""
        state = self._state()
        if new is not None:
            new = new.where(F.col("vector").isNotNull())
            wrong = new.where(F.size("vector") != state["meta"]["dimension"]).select(F.size("vector")).first()
            if wrong is not None:
                raise DimensionMismatch(state["meta"]["dimension"], wrong[0])
        self._commit(state, new, gone, state["source"] if source is None else source)

    # Reading

    def _live(self, state: dict, cells: Sequence[int] | None, scope: dict[str, str]) -> DataFrame:
        rows = self.commits.get("rows", state["parts"].get("rows", {}), self._schema("rows", state["meta"]))
        if cells is not None:
            rows = rows.where(F.col("cell").isin(*cells)) if cells else rows.limit(0)
        for k, v in scope.items():
            rows = rows.where(F.col(k) == v)
        if state["parts"].get("deaths"):
            gone = self.commits.get("deaths", state["parts"]["deaths"], self._schema("deaths", state["meta"])).groupBy("id").agg(F.max("_v").alias("_until")).withColumnRenamed("id", "_gone")
            rows = rows.join(gone, (F.col("id") == F.col("_gone")) & (F.col("_v") < F.col("_until")), "left_anti")
        return rows.drop("_v")

    @staticmethod
    def _first(state: dict, exact: bool) -> int:
        """The cells that a search begins with: a few, if it goes on to all that are needed."""
        return 4 if exact else state["meta"].get("probes", 1)

    @staticmethod
    def _check(metric: str) -> None:
        if metric not in METRICS:
            raise Validation(f"no metric {metric}")

    def search(self, query: Sequence[float], k: int, metric: str = "l1", probes: int | None = None, exact: bool = False, scope: dict[str, str] | None = None, threshold: float | None = None) -> DataFrame:
        """id, the kept columns and score of the ``k`` nearest vectors of a ``scope`` in the ``probes`` nearest cells, by default as many as ``create`` measured, or with ``exact`` of all; ties go by id."""
        self._check(metric)
        state, scope = self._state(), scope or {}
        probes = self._first(state, exact) if probes is None else probes
        if state["meta"]["dimension"] and len(query) != state["meta"]["dimension"]:
            raise DimensionMismatch(state["meta"]["dimension"], len(query))
        q, which = np.array(query, np.float64), 0 if metric == "l1" else 1
        far = []
        for r in self._centroids().collect():
            if (radius := state["radii"].get(str(r["cell"]))) is not None:
                d = np.abs(q - r["centroid"])
                d = d.sum() if metric == "l1" else np.sqrt((d**2).sum())
                far.append((d, r["cell"], max(0.0, d - radius[which] - SLACK * (d + radius[which] + np.abs(q).sum()))))
        far.sort()
        first, rest = [c for _, c, _ in far[:probes]], far[probes:]
        score = METRICS[metric](F.col("vector"), literal(query))

        def of(cells: Sequence[int]) -> DataFrame:
            found = self._live(state, cells, scope).select("id", *state["meta"]["keep"], score.alias("score"))
            if threshold is not None:
                found = found.where(F.col("score") <= F.lit(float(threshold)).cast("float"))
            return found.orderBy("score", "id").limit(k)

        self.cells, self.cells_read = len(far), len(first)
        if not exact or not rest:
            return of(first)
        near = of(first).collect()  # k rows
        limit = near[-1]["score"] if len(near) == k else (threshold if threshold is not None else float("inf"))
        limit = limit**0.5 if metric == "l2_squared" else limit
        more = [c for _, c, low in rest if low <= limit]
        self.cells_read += len(more)
        kept = of(first)
        held = self.spark.createDataFrame([tuple(r) for r in near], kept.schema)
        return held.unionByName(of(more)).orderBy("score", "id").limit(k) if more else held

    def search_each(self, queries: DataFrame, k: int, metric: str = "l1", probes: int | None = None, exact: bool = False, scope: dict[str, str] | None = None) -> DataFrame:
        """query_id, id, score, rank: what ``search`` finds for each of a stated set of ``queries`` (query_id, query_vector).

        Cells are put together to blocks of bounded size, larger ones fall into several; a question goes once to each block
        that has one of its cells, and k rows for each question and block move on.
        """
        self._check(metric)
        state, scope = self._state(), scope or {}
        probes = self._first(state, exact) if probes is None else probes
        live = self._live(state, None, scope)
        places, blocks = self._blocks({r["cell"]: r["count"] for r in live.groupBy("cell").count().collect()}, block_rows(state["meta"]["dimension"]))  # a row for each cell
        place = self.spark.createDataFrame(places, "cell int, first int, parts int")
        rows = live.join(F.broadcast(place), "cell").select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"), "id", F.col("vector").alias("v"), "cell")
        n_asked = queries.count()
        radii = {int(c): float(r[0 if metric == "l1" else 1]) for c, r in state["radii"].items()}
        centres = [(r["cell"], r["centroid"], radii[r["cell"]]) for r in self._centroids().orderBy("cell").collect() if r["cell"] in radii]  # MAX_CELLS at most
        asked = queries.select("query_id", "query_vector")
        schema = StructType([StructField("block", IntegerType()), *asked.schema.fields, StructField("cells", ArrayType(IntegerType()))])

        def scan(some: DataFrame, start: int, stop: int | None) -> DataFrame:
            """The k best of each question in its cells from place ``start`` to ``stop``, of those that can hold a vector within its ``limit``."""
            return in_blocks(rows, some.mapInArrow(_opened(centres, places, metric, start, stop, to_arrow_schema(schema)), schema), blocks, n_asked, k, metric)

        none = F.lit(None).cast("double").alias("limit")
        found = scan(asked.select("*", none), 0, probes)
        if not exact:
            return found
        found.write.parquet(path := shared_path(self.spark, "near"))  # read twice
        found = self.spark.read.schema(found.schema).parquet(path)
        worst = F.max("score").cast("double")
        kth = found.groupBy("query_id").agg(F.when(F.count("score") >= k, F.sqrt(worst) if metric == "l2_squared" else worst).alias("limit"))
        both = found.drop("rank").unionByName(scan(asked.join(kth, "query_id", "left"), probes, None).drop("rank"))
        return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)

    @staticmethod
    def _blocks(sizes: dict[int, int], most: int) -> tuple[list[tuple[int, int, int]], int]:
        """cell, first block, number of blocks, so that a block has about ``most`` rows; and the number of blocks."""
        places, block, room = [], 0, most
        for cell, n in sorted(sizes.items()):
            if n > most:
                block, room = block + (room < most), most
                places.append((cell, block, parts := -(-n // most)))
                block += parts
                continue
            if n > room:
                block, room = block + 1, most
            places.append((cell, block, 1))
            room -= n
        return places, block + 1


def _opened(centres: list[tuple[int, list[float], float]], places: list[tuple[int, int, int]], metric: str, start: int, stop: int | None, out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Questions (query_id, query_vector, limit), once for each block that has one of their cells, with these cells."""
    numbers, radius = np.array([c for c, _, _ in centres], np.int32), np.array([r for _, _, r in centres])
    middle = np.array([m for _, m, _ in centres], np.float64)
    blocks = {c: range(first, first + parts) for c, first, parts in places}

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                some, which, block, cells = batch.slice(at, 256), [], [], []
                for i, (q, limit) in enumerate(zip(some["query_vector"].to_pylist(), some["limit"].to_pylist(), strict=True)):
                    if q is None or not len(numbers):
                        continue
                    q = np.array(q, np.float64)
                    d = np.abs(middle - q).sum(1) if metric == "l1" else np.sqrt(((middle - q) ** 2).sum(1))
                    order = np.lexsort((numbers, d))[start:stop]
                    if limit is not None:
                        low = d - radius - SLACK * (d + radius + np.abs(q).sum())
                        order = order[low[order] <= limit]
                    here: dict[int, list[int]] = {}
                    for c in numbers[order].tolist():
                        for b in blocks.get(c, ()):
                            here.setdefault(b, []).append(c)
                    which += [i] * len(here)
                    block += here.keys()
                    cells += here.values()
                took = some.take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), took["query_id"], took["query_vector"], pa.array(cells, out.field("cells").type)], schema=out)

    return opened


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """query_id, n, hits, recall of ``found`` against the rows of ``truth`` (query_id, id)."""
    hit = truth.select("query_id", "id").join(found.select("query_id", "id").distinct().withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg(F.count("*").alias("n"), F.count("_hit").alias("hits")).withColumn("recall", F.col("hits") / F.col("n"))
