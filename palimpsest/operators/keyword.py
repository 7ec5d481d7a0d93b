"""BM25 over token arrays. Scores are negative: lower is better, as everywhere here."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_list
from .knn import _least

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query's words, in order; an empty query has none and finds nothing."""
    import regex

    return list(dict.fromkeys(t for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", query.lower()) if t))


def bm25_idf(df: Column, n: Column) -> Column:
    raw = F.ln((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(LEAST_IDF))


def bm25_weight(tf: Column, df: Column, n: Column, length: Column, average: Column) -> Column:
    return bm25_idf(df, n) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


#: Weight of a word in a cover. Fixed value.
COVER_WEIGHT = 0.1


def cover_density(entries: Column, n_terms: int) -> Column:
    """Cover-density rank of a document from where the query's terms stand: array<struct<pos, term>>, ascending, terms numbered from 0.

    A cover is a run of words that holds every term and no shorter such run. It counts COVER_WEIGHT over one more than the words in
    it that aren't the query's, and the rank is the sum. A single sweep keeps the last place of each term: the least of these
    starts the shortest run that ends here, and it is a new cover when it starts later than the one before.
    """
    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(-1), n_terms).alias("last"), F.lit(-1).alias("low"), F.lit(0.0).alias("rank"))

    def step(s: Column, e: Column) -> Column:
        last = F.transform(s["last"], lambda x, t: F.when(t == e["term"], s["i"]).otherwise(x))
        low = F.array_min(last)
        noise = (e["pos"] - F.get(entries, low)["pos"]) - (s["i"] - low)
        gain = F.when(low > s["low"], F.lit(COVER_WEIGHT) / (1 + noise)).otherwise(F.lit(0.0))
        return F.struct((s["i"] + 1).alias("i"), last.alias("last"), F.greatest(s["low"], low).alias("low"), (s["rank"] + gain).alias("rank"))

    return F.aggregate(entries, start, step, lambda s: s["rank"])


def search_covers(docs: DataFrame, query: str, content: str = "content") -> DataFrame:
    """``docs`` that hold every term of ``query`` with their negative cover-density rank in ``keyword_score``, by a scan. Words are tokens: neither stemmed nor left out as too common."""
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("keyword_score", F.lit(None).cast("double")).limit(0)
    place = lambda x: F.array_position(F.array(*map(F.lit, terms)), x).cast("int") - 1
    tokens = token_list(F.coalesce(F.col(content), F.lit("")))
    entries = F.filter(F.transform(tokens, lambda x, i: F.struct(i.alias("pos"), place(x).alias("term"))), lambda e: e["term"] >= 0)
    held = docs.withColumn("_entries", entries).where(F.size(F.array_distinct(F.transform("_entries", lambda e: e["term"]))) == len(terms))
    return held.withColumn("keyword_score", -cover_density(F.col("_entries"), len(terms))).drop("_entries")


def _is(term: str) -> Callable[[Column], Column]:
    return lambda x: x == term


def search(docs: DataFrame, query: str, content: str = "content", require_all: bool = False) -> DataFrame:
    """``docs`` that hold any term of ``query`` (all with ``require_all``) with their BM25 in ``keyword_score``.

    The few terms are counted in each row, so no token leaves it: one aggregate of a row gives the corpus
    statistics, and a second scan the scores. Statistics are of all of ``docs``; filters belong after.
    """
    terms = query_terms(query)
    if not terms:
        return docs.withColumn("keyword_score", F.lit(None).cast("double")).limit(0)
    tokens = docs.withColumn("_tokens", token_list(F.coalesce(F.col(content), F.lit(""))))
    held = tokens.withColumn("_length", F.size("_tokens")).withColumn("_held", F.filter("_tokens", lambda x: x.isin(*terms))).drop("_tokens")  # one pass, whatever the number of terms
    counted = held.withColumn("_tf", F.array(*(F.size(F.filter("_held", _is(t))) for t in terms))).drop("_held")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_average"), F.array(*(F.count_if(F.col("_tf")[i] > 0) for i in range(len(terms)))).alias("_df"))
    hits = reduce(and_ if require_all else or_, (F.col("_tf")[i] > 0 for i in range(len(terms))))
    scored = counted.where(hits).crossJoin(F.broadcast(stats))  # one row
    total = sum((bm25_weight(F.col("_tf")[i], F.col("_df")[i], F.col("_n"), F.col("_length"), F.col("_average")) for i in range(len(terms))), F.lit(0.0))
    return scored.withColumn("keyword_score", -total).drop("_length", "_tf", "_n", "_average", "_df")


def token_table(docs: DataFrame, id_: str = "id", content: str = "content") -> DataFrame:
    """id, term, tf, length: an inverted index to be stored by term, for batches of queries."""
    rows = docs.select(F.col(id_).alias("id"), token_list(F.coalesce(F.col(content), F.lit(""))).alias("tokens"))
    return rows.select("id", F.size("tokens").alias("length"), F.explode("tokens").alias("term")).groupBy("id", "term", "length").agg(F.count("*").alias("tf"))


def token_lists(docs: DataFrame, id_: str = "id", content: str = "content") -> DataFrame:
    """id, length, terms, tfs: what ``search_each`` takes of texts as they are; tfs is null where each term stands for itself."""
    rows = docs.select(F.col(id_).alias("id"), token_list(F.coalesce(F.col(content), F.lit(""))).alias("terms"))
    return rows.select("id", F.size("terms").alias("length"), "terms", F.lit(None).cast("array<long>").alias("tfs"))


#: Words of a block of documents, which a task holds.
BLOCK_TOKENS = 1 << 21


def _scoring(k: int | None, average: float, out: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of a block of documents and all questions, the k best hits of each question, all without k, and none worse than its ``floor``."""

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if not rows.num_rows or not asked.num_rows:
            return out.empty_table()
        rows = rows.take(pc.sort_indices(rows["id"], sort_keys=[("", "ascending")], null_placement="at_start"))
        n, lists, counts, asks = rows.num_rows, rows["terms"].combine_chunks(), rows["tfs"].combine_chunks(), asked["terms"].combine_chunks()
        words = asks.flatten().unique()
        code_of = lambda x: pc.fill_null(pc.index_in(x, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        given = pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False)
        tf = np.ones(int(sizes.sum()))
        tf[np.repeat(given > 0, sizes)] = counts.flatten().to_numpy(zero_copy_only=False)
        code, doc = code_of(lists.flatten()), np.repeat(np.arange(n), sizes)
        key, at = np.unique((code * n + doc)[code >= 0], return_inverse=True)
        tf, doc = np.bincount(at, tf[code >= 0], len(key)), key % n
        first = np.searchsorted(key, np.arange(len(words) + 1) * n)
        norm = tf + K1 * (1 - B + B * rows["length"].to_numpy()[doc] / average)
        terms, idf = code_of(asks.flatten()), asked["idfs"].combine_chunks().flatten().to_numpy()
        ends = np.cumsum(pc.list_value_length(asks).to_numpy(zero_copy_only=False))
        floors = pc.fill_null(asked["floor"], np.inf).to_numpy()
        who, which, scores = [], [], []
        for i, end in enumerate(ends):
            score = np.zeros(n)
            for j in range(ends[i - 1] if i else 0, end):
                own = slice(first[terms[j]], first[terms[j] + 1])
                score[doc[own]] -= idf[j] * tf[own] * (K1 + 1) / norm[own]  # a document once
            hits = np.flatnonzero((score < 0) & (score <= floors[i]))
            best = hits if k is None else hits[_least(score[hits], k)]
            who.append(np.full(len(best), i))
            which.append(best)
            scores.append(score[best])
        return pa.Table.from_arrays([asked["query_id"].take(pa.array(np.concatenate(who))), rows["id"].take(pa.array(np.concatenate(which))), pa.array(np.concatenate(scores))], names=out.names).cast(out)

    return meet


def search_each(index: DataFrame, queries: DataFrame, n_docs: int, average_length: float, k: int | None = None, within: DataFrame | None = None) -> DataFrame:
    """query_id, id, keyword_score of a batch of ``queries`` (query_id, term) over a token table or token lists, the ``k`` best of each, all without ``k``; statistics are of all of ``index``, hits only those of ``within`` (id).

    Blocks of documents meet all questions in tasks that add up scores where the documents lie, so no row is made for a posting and
    a question. With many blocks each first gives its share of 2 k scores; the k-th of these is a floor that none of the k best is
    beyond, so what moves after that is about k rows for each question, whatever the number of blocks. Comparisons grow with the product of both.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if "term" in index.columns:
        listed = index.groupBy("id", "length").agg(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"))).alias("p"))
        index = listed.select("id", "length", F.col("p.term").alias("terms"), F.col("p.tf").alias("tfs"))
    wanted = queries.select("query_id", "term").distinct()
    held = index.select(F.explode(F.array_distinct("terms")).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    weights = held.groupBy("term").agg(bm25_idf(F.count("*"), F.lit(n_docs)).alias("idf"))
    asked = wanted.join(weights, "term").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term", "idf"))).alias("t"))
    asked = asked.select("query_id", F.col("t.term").alias("terms"), F.col("t.idf").alias("idfs"))
    blocks = max(1, int(-(-n_docs * average_length // BLOCK_TOKENS)))
    rows = index if within is None else index.join(within.select("id"), "id", "left_semi")
    rows = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), "id", "length", "terms", "tfs").repartition(blocks, "block").groupBy("block")
    shape = asked.select("query_id").limit(0).crossJoin(index.select("id").limit(0)).select("query_id", "id", F.lit(0.0).alias("keyword_score")).schema
    for field in shape.fields:
        field.nullable = True

    def best(asked: DataFrame, most: int | None) -> DataFrame:
        everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "*")
        meet = _scoring(most, average_length, to_arrow_schema(shape))
        return rows.cogroup(everywhere.repartition(blocks, "block").groupBy("block")).applyInArrow(lambda l, r: meet(l, r), shape)

    open_ = asked.withColumn("floor", F.lit(None).cast("double"))
    if k is None or blocks <= 2:
        return best(open_, k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("keyword_score"))
    floors = best(open_, -(-2 * k // blocks)).select("query_id", F.col("keyword_score").alias("floor"), place.alias("place")).where(F.col("place") == k).select("query_id", "floor")
    return best(asked.join(floors, "query_id", "left"), k)
