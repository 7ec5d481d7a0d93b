"""Exact nearest neighbours by scan. Scores are distances: lower is better, ties go by id."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import METRICS, literal


def window_size(top_k: int) -> int:
    """How many candidates are fetched before the filters that the store doesn't know."""
    return max(20 * top_k, 500)


def nearest(rows: DataFrame, query: Sequence[float], k: int, metric: str = "l1", threshold: float | None = None, where: Column | None = None, vector: str = "vector", id_: str = "id") -> DataFrame:
    """``rows`` with ``score``: the k nearest to ``query`` among those that ``where`` holds for, at most ``threshold`` away. One bounded heap per partition, no shuffle of rows."""
    found = rows if where is None else rows.where(where)
    found = found.withColumn("score", METRICS[metric](F.col(vector), literal(query)))
    if threshold is not None:
        found = found.where(F.col("score") <= F.lit(float(threshold)).cast("float"))
    return found.drop(vector).orderBy("score", id_).limit(k)


#: Bytes of vectors of a block of rows, and rows of a block; questions of a block, and results of one that a task holds. Blocks of rows meet blocks of questions.
BLOCK_BYTES, BLOCK_ROWS, BLOCK_ASKED, BLOCK_RESULTS = 8 << 20, 1 << 18, 1 << 12, 1 << 20
#: Questions and rows that are compared together.
TILE_ASKED, TILE_ROWS = 8, 4096


def block_rows(dimension: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (4 * max(1, dimension))))


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as rows, shorter ones filled with 0; how long each is; which are null or hold a null."""
    a = vectors.combine_chunks()
    size, none = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False), pc.is_null(a).to_numpy(zero_copy_only=False)
    flat = a.flatten()
    if flat.null_count:
        none[np.repeat(np.arange(len(a)), size)[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = True
        flat = pc.fill_null(flat, 0.0)
    width, values = int(size.max(initial=0)), flat.to_numpy(zero_copy_only=False)
    if (size == width).all():
        return values.reshape(len(a), width), size, none
    out = np.zeros((len(a), width), values.dtype)
    out[np.arange(width) < size[:, None]] = values
    return out, size, none


def _distances(columns: np.ndarray, size: np.ndarray, asked: np.ndarray, metric: str) -> np.ndarray:
    """The folds of ``functions.vector``, in order and single precision, of questions of one length (question, place) and ``columns`` (place, row), in tiles that stay in a core's cache."""
    out, ragged = np.zeros((len(asked), columns.shape[1]), np.float32), bool((size < len(columns)).any())
    for at in range(0, columns.shape[1], TILE_ROWS):
        tile, short = columns[:, at : at + TILE_ROWS], size[at : at + TILE_ROWS]
        total = np.zeros((len(asked), tile.shape[1]), np.float32)
        term = np.empty(total.shape, np.result_type(columns, asked))
        for i in range(min(len(columns), asked.shape[1])):
            np.subtract(tile[i], asked[:, i, None], out=term)
            np.abs(term, out=term) if metric == "l1" else np.multiply(term, term, out=term)
            if ragged:
                term[:, short <= i] = 0
            np.add(total, term, out=total, casting="same_kind")
        out[:, at : at + TILE_ROWS] = total
    return np.sqrt(out.astype(np.float64)).astype(np.float32) if metric == "l2" else out


def _least(s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least, in order; the first of equal ones first, NaN last."""
    at = np.arange(len(s))
    if len(s) > k:
        kth = np.partition(s, k - 1)[k - 1]
        at = np.flatnonzero(s <= kth) if kth == kth else at
    return at[np.argsort(s[at], kind="stable")][:k]


def _meeting(k: int, metric: str, out: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of rows and one of questions, the k nearest rows of each question, of those in its ``cells`` if it has such."""

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return out.empty_table()
        rows = rows.take(pc.sort_indices(rows["id"], sort_keys=[("", "ascending")], null_placement="at_start"))
        matrix, size, none = _matrix(rows["v"])
        columns = np.ascontiguousarray(matrix.T)
        questions, lengths, void = _matrix(asked["query_vector"])
        cells = rows["cell"].to_numpy() if "cell" in rows.column_names else None
        who, which, scores = [], [], []

        def rows_of(i: int) -> np.ndarray | None:
            """The rows in the cells of a question, None for all."""
            if cells is None:
                return None
            mine, open_ = asked["cells"][i].values.to_numpy(), np.zeros(cells.max() + 1, bool)
            open_[mine[mine < len(open_)]] = True
            some = np.flatnonzero(open_[cells])
            return None if len(some) == len(cells) else some

        def take(i: int, s: np.ndarray, some: np.ndarray | None) -> None:
            s[none if some is None else none[some]] = -np.inf  # nulls stand first, as they sort
            if void[i]:
                s[:] = -np.inf
            best = _least(s, k)
            who.append(np.full(len(best), i))
            which.append(best if some is None else some[best])
            scores.append(s[best])

        together: list[tuple[int, np.ndarray | None]] = []

        def answer() -> None:
            if together:
                for (i, some), s in zip(together, _distances(columns, size, questions[[i for i, _ in together], : lengths[together[0][0]]], metric), strict=True):
                    take(i, s if some is None else s[some], some)
                together.clear()

        for i in range(len(questions)):
            some = rows_of(i)
            if some is not None and len(some) < len(cells) // 2:
                take(i, _distances(columns[:, some], size[some], questions[i : i + 1, : lengths[i]], metric)[0], some)
                continue
            if together and (len(together) == TILE_ASKED or lengths[together[0][0]] != lengths[i]):
                answer()
            together.append((i, some))
        answer()
        score = np.concatenate(scores)
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(np.concatenate(who))), rows["id"].take(pa.array(np.concatenate(which))), pa.array(score, mask=score == -np.inf)], names=out.names).cast(out)

    return meet


def in_blocks(rows: DataFrame, asked: DataFrame, blocks: int, n_asked: int, k: int, metric: str) -> DataFrame:
    """query_id, id, score, rank of the k nearest of ``rows`` (block, id, v, and cell or none) for each of ``asked`` (block, query_id, query_vector, and cells or none).

    The rows of each of ``blocks`` blocks meet the questions that stand for it, about ``n_asked``, BLOCK_ASKED at a time, in a task that
    holds no more than both; it gives k rows for each question.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    turns = max(1, -(-n_asked // max(1, min(BLOCK_ASKED, BLOCK_RESULTS // k))))
    of = lambda turn: (F.col("block") * turns + turn).alias("_meet")
    left = rows.select(F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("_turn"), "*").select(of(F.col("_turn")), *rows.columns).drop("block") if turns > 1 else rows.withColumnRenamed("block", "_meet")
    right = asked.select(of(F.pmod(F.xxhash64("query_id"), F.lit(turns)).cast("int")), *asked.columns).drop("block")
    parts = blocks * turns
    shape = asked.select("query_id").limit(0).crossJoin(rows.select("id").limit(0)).select("query_id", "id", F.lit(0).cast("float").alias("score")).schema
    for field in shape.fields:
        field.nullable = True
    meet = _meeting(k, metric, to_arrow_schema(shape))
    found = left.repartition(parts, "_meet").groupBy("_meet").cogroup(right.repartition(parts, "_meet").groupBy("_meet")).applyInArrow(lambda l, r: meet(l, r), shape)
    by_query = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def nearest_for_each(rows: DataFrame, queries: DataFrame, k: int, metric: str = "l1", vector: str = "vector", id_: str = "id") -> DataFrame:
    """query_id, id, score, rank: the k nearest rows for each of a stated set of ``queries`` (query_id, query_vector).

    Every row is compared with every question, which grows with the product of both; blocks of rows meet blocks of questions in tasks of
    bounded memory, and k rows for each question and block move on.
    """
    asked = queries.select("query_id", "query_vector")
    n_asked, dimension = asked.agg(F.count("*"), F.coalesce(F.max(F.size("query_vector")), F.lit(1))).first()
    blocks = max(1, -(-rows.count() // block_rows(dimension)))
    own = rows.select(F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("block"), F.col(id_).alias("id"), F.col(vector).alias("v"))
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*")
    return in_blocks(own, everywhere, blocks, n_asked, k, metric)
