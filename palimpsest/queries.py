"""The registered queries of the memory engine and the DuckDB SQL that says the same.

Documents, conversations, events and orders stand in for memories, messages, payloads and expiry dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters, text
from .functions.embed import embed_text, hash_embedding
from .functions.vector import METRICS
from .operators import entities, keyword, lifecycle, ranking
from .operators.knn import nearest, nearest_for_each, window_size
from .schema import SCOPE_KEYS, promote
from .session import shared_path
from .sources.keyword_index import KeywordIndex
from .sources.log_store import LogStore
from .sources.vector_index import VectorIndex, recall
from .streaming import ingest
from .streaming.rate_limit import limited

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Nearest neighbours


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _vector_of(spark: SparkSession, sf_dir: str, i: int) -> list[float]:
    return _vectors(spark, sf_dir).where(F.col("id") == i).first()["vector"]


_PAIR = "list_transform(list_zip(e.embedding, q.embedding), lambda x: {})"
_DISTANCE = {
    "l1": f"list_reduce({_PAIR.format('abs(x[1] - x[2])::FLOAT')}, lambda a, b: (a + b)::FLOAT, 0::FLOAT)",
    "l2_squared": f"list_reduce({_PAIR.format('((x[1] - x[2]) * (x[1] - x[2]))::FLOAT')}, lambda a, b: (a + b)::FLOAT, 0::FLOAT)",
}
_DISTANCE["l2"] = f"sqrt({_DISTANCE['l2_squared']}::DOUBLE)::FLOAT"
_ONE = "embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _score(c: str = "score"):
    return F.round(F.col(c).cast("double"), 4).alias("score")


for _m in METRICS:

    @_register(f"knn_{_m}_topk", f"SELECT vec_id AS id, round(({_DISTANCE[_m]})::DOUBLE, 4) AS score FROM {_ONE} ORDER BY {_DISTANCE[_m]}, vec_id LIMIT 10")
    def _knn(spark: SparkSession, sf_dir: str, m: str = _m) -> DataFrame:
        return nearest(_vectors(spark, sf_dir), _vector_of(spark, sf_dir, 0), 10, m).select("id", _score())


@_register("knn_threshold", f"SELECT vec_id AS id, round(({_DISTANCE['l1']})::DOUBLE, 4) AS score FROM {_ONE} WHERE {_DISTANCE['l1']} <= 8 ORDER BY {_DISTANCE['l1']}, vec_id LIMIT 100")
def knn_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_vectors(spark, sf_dir), _vector_of(spark, sf_dir, 0), 100, threshold=8.0).select("id", _score())


@_register("knn_scope_filter", f"SELECT vec_id AS id, round(({_DISTANCE['l1']})::DOUBLE, 4) AS score FROM {_ONE} WHERE label = 3 ORDER BY {_DISTANCE['l1']}, vec_id LIMIT 10")
def knn_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_vectors(spark, sf_dir), _vector_of(spark, sf_dir, 0), 10, where=F.col("label") == 3).select("id", _score())


@_register(
    "knn_batch_topk",
    f"SELECT query_id, id, score, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, round(({_DISTANCE['l1']})::DOUBLE, 4) AS score,"
    f" row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DISTANCE['l1']}, e.vec_id)::INTEGER AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE rank <= 10",
)
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return nearest_for_each(rows, asked, 10).select("query_id", "id", _score(), "rank")


@_register("candidate_window_postfilter", f"SELECT id, score FROM (SELECT vec_id AS id, label, round(({_DISTANCE['l1']})::DOUBLE, 4) AS score FROM {_ONE} ORDER BY {_DISTANCE['l1']}, vec_id LIMIT 500) WHERE label <> 3 ORDER BY score, id LIMIT 10")
def candidate_window_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(_vectors(spark, sf_dir), _vector_of(spark, sf_dir, 0), window_size(10)).where(F.col("label") != 3)
    return found.orderBy("score", "id").limit(10).select("id", _score())


# The filter language

_RX = r"^[+-]?([0-9]+\.?[0-9]*([eE][+-]?[0-9]+)?|\.[0-9]+([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
_PAYLOAD = {
    "lang": "lang",
    "source": "source",
    "content": "text",
    "n_chars": "CAST(n_chars AS STRING)",
    "priority": "CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN CAST(doc_id % 20 AS STRING) ELSE 'unspecified' END",
}


def _num(v: str, op: str, n: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({v}, '{_RX}') THEN NOT isnan(try_cast({v} AS DOUBLE)) AND try_cast({v} AS DOUBLE) {op} {n} ELSE {v} {op} '{n}' END, false)"


FILTER_CASES: dict[str, tuple[dict, str]] = {
    "filter_eq": ({"lang": "en"}, "coalesce(lang = 'en', false)"),
    "filter_ne": ({"priority": {"ne": 10}}, f"priority IS NOT NULL AND NOT {_num('priority', '=', '10')}"),
    "filter_in": ({"lang": {"in": ["de", "fr"]}}, "coalesce(lang IN ('de', 'fr'), false)"),
    "filter_nin": ({"priority": {"nin": [1, 2, "unspecified"]}}, "priority IS NOT NULL AND priority NOT IN ('1', '2', 'unspecified')"),
    "filter_gt": ({"priority": {"gt": 5}}, _num("priority", ">", "5")),
    "filter_gte": ({"n_chars": {"gte": 1500}}, _num("n_chars", ">=", "1500")),
    "filter_lt": ({"priority": {"lt": 5}}, _num("priority", "<", "5")),
    "filter_lte": ({"n_chars": {"lte": 500}}, _num("n_chars", "<=", "500")),
    "filter_contains": ({"source": {"contains": "c1"}}, "coalesce(contains(source, 'c1'), false)"),
    "filter_icontains": ({"content": {"icontains": "LICENSED"}}, "coalesce(contains(lower(content), 'licensed'), false)"),
    "filter_wildcard": ({"priority": "*"}, "true"),
    "filter_missing_key_not": ({"NOT": [{"priority": {"eq": 10}}]}, f"NOT {_num('priority', '=', '10')}"),
    "filter_and_or_not": (
        {"AND": [{"OR": [{"lang": "en"}, {"lang": "de"}]}, {"NOT": [{"priority": {"lt": 5}}]}]},
        f"coalesce(lang IN ('en', 'de'), false) AND NOT {_num('priority', '<', '5')}",
    ),
    "filter_numeric_lexical_fallback": ({"priority": {"gt": 5}, "n_chars": {"lt": 3000}}, f"{_num('priority', '>', '5')} AND {_num('n_chars', '<', '3000')}"),
}


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.create_map(*(x for k, v in _PAYLOAD.items() for x in (F.lit(k), F.expr(v))))
    return _t(spark, sf_dir, "documents").select("doc_id", F.map_filter(made, lambda _, v: v.isNotNull()).alias("payload"))


_PAYLOAD_SQL = ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS {k}" for k, v in _PAYLOAD.items() if k not in ("lang", "source"))
for _name, (_spec, _where) in FILTER_CASES.items():

    @_register(_name, f"SELECT doc_id FROM (SELECT doc_id, lang, source, {_PAYLOAD_SQL} FROM (SELECT doc_id, lang, source, text, n_chars AS n_chars_ FROM documents)) WHERE {_where}".replace("CAST(n_chars AS", "CAST(n_chars_ AS"))
    def _filtered(spark: SparkSession, sf_dir: str, spec: dict = _spec) -> DataFrame:
        return _payloads(spark, sf_dir).where(filters.compile_filter(filters.parse(spec), lambda k: F.col("payload")[k])).select("doc_id")


# Lists, lookups, counts, expiry

TODAY = "1995-06-15"
for _name, _all in (("expiry_live", False), ("expiry_show_expired", True)):

    @_register(_name, "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS expiration_date FROM orders" + ("" if _all else f" WHERE NOT coalesce(strftime(o_orderdate, '%Y-%m-%d') < '{TODAY}', false)"))
    def _live(spark: SparkSession, sf_dir: str, everything: bool = _all) -> DataFrame:
        rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("expiration_date"))
        return rows if everything else rows.where(filters.is_live(TODAY, F.col("expiration_date")))


def _memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories; ids sort as their numbers do."""
    d = _t(spark, sf_dir, "documents")
    payload = F.create_map(F.lit("user_id"), F.col("source"), F.lit("agent_id"), F.col("lang"), F.lit("content"), F.col("text"))
    ids = F.concat(F.lit("rec-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return d.select(ids.alias("id"), payload.alias("payload"), F.col("source").alias("user_id"), F.col("lang").alias("agent_id"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("expiration_date"), F.col("text").alias("content"), F.col("doc_id").alias("seq"))


_ID = "'rec-' || lpad(doc_id::VARCHAR, 12, '0')"


@_register("list_ids_page", f"SELECT {_ID} AS id FROM documents WHERE source = 'src1' ORDER BY 1 LIMIT 20 OFFSET 10")
def list_ids_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.list_memories(_memories(spark, sf_dir), {"user_id": "src1"}, TODAY, 10, 20).select("id")


@_register("history_page", "SELECT id, seq, event FROM (SELECT user_id::VARCHAR AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_type AS event FROM events) WHERE id = '7' ORDER BY seq LIMIT 20 OFFSET 2")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    log = _t(spark, sf_dir, "events").where("user_id = 7").select(F.col("user_id").cast("string").alias("id"), seq.cast("long").alias("seq"), F.col("event_type").alias("event"))
    return lifecycle.history(lifecycle.Tables(None, log, None), "7", 2, 20)


@_register("records_and_entries", f"SELECT {_ID} AS id, source AS user_id, md5(text) AS hash, 'added' AS event FROM documents")
def records_and_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients are shown of memories and of their history."""
    rows = _memories(spark, sf_dir)
    log = rows.select("id", F.lit(0).cast("long").alias("seq"), F.lit("Added").alias("event"), "content")
    shown = lifecycle.as_records(rows).join(lifecycle.as_entries(log), "id")
    return shown.select("id", F.col("payload")["user_id"].alias("user_id"), F.md5(F.col("payload")["content"]).alias("hash"), "event")


@_register("list_entities_counts", "SELECT 'user_id' AS entity_type, source AS entity_id, count(*) AS memory_count FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'agent_id', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang")
def list_entities_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.list_entities(_memories(spark, sf_dir))


@_register("get_by_id", f"SELECT {_ID} AS id, text AS content FROM documents WHERE doc_id = 5")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.get(_memories(spark, sf_dir), "rec-000000000005").select("id", "content")


@_register("point_lookup_pushdown", "SELECT doc_id, lang FROM documents WHERE doc_id = 5")
def point_lookup_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").where("doc_id = 5").select("doc_id", "lang")


# Text

QUERY = "licensed under the general public license, the and of to"
_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@_register("tokens_overlap", f"SELECT doc_id, len(list_distinct({_TOKENS.format('text')}))::BIGINT AS n_tokens, round(1 - len(list_intersect(list_distinct({_TOKENS.format('text')}), list_distinct({_TOKENS.format(chr(39) + QUERY + chr(39))})))::DOUBLE / len(list_distinct({_TOKENS.format(chr(39) + QUERY + chr(39))})), 5) AS distance FROM documents")
def tokens_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(text.token_set(F.col("text"))).cast("long").alias("n_tokens"), F.round(ranking.lexical_distance(F.lit(QUERY), F.col("text")).cast("double"), 5).alias("distance"))


@_register("entities_double_quoted", """SELECT doc_id, array_to_string(list_filter(list_transform(regexp_extract_all(text, '"([^"]*)"', 1), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: strlen(x) > 2), '|') AS spans FROM documents WHERE contains(text, '"')""")
def entities_double_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").where(F.col("text").contains('"')).select("doc_id", F.array_join(text.double_quoted(F.col("text")), "|").alias("spans"))


_MARKED_SQL = (
    r"list_transform(string_split_regex(text, '\s+'), lambda raw: CASE WHEN regexp_full_match(raw, '[^\p{L}\p{N}]*\p{Lu}\p{L}*[^\p{L}\p{N}]*')"
    r" THEN regexp_replace(raw, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') || CASE WHEN regexp_matches(raw, '[.!?]$') THEN chr(1) ELSE '' END ELSE chr(1) END)"
)
_PROPER = f"list_filter(list_transform(string_split(array_to_string({_MARKED_SQL}, ' '), chr(1)), lambda x: trim(x)), lambda x: contains(x, ' '))"


@_register("entities_proper", f"SELECT doc_id, array_to_string({_PROPER}, '|') AS spans FROM documents")
def entities_proper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.proper_spans(F.col("text")), "|").alias("spans"))


@_register("entities_single_quoted")
def entities_single_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.single_quoted(F.col("text")).alias("spans"))


@_register("entity_links")
def entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.summary(entities.links(_memories(spark, sf_dir)))


def _proper_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.links(_memories(spark, sf_dir)).where("entity_type = 'proper'")


_LINKS_SQL = f"SELECT DISTINCT {_ID} AS id, source AS user_id, lang AS agent_id, doc_id, unnest({_PROPER}) AS entity_text FROM documents"


@_register("entity_links_proper", f"SELECT user_id, agent_id, entity_text, count(*) AS n_memories, arg_min(id, doc_id) AS first_id FROM ({_LINKS_SQL}) GROUP BY ALL")
def entity_links_proper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entities.summary(_proper_links(spark, sf_dir)).select("user_id", "agent_id", "entity_text", "n_memories", "first_id")


@_register("entity_upsert", f"SELECT user_id, agent_id, entity_text, count(*) AS n_memories, md5(string_agg(id, ',' ORDER BY doc_id % 2, doc_id)) AS ids_hash FROM ({_LINKS_SQL}) GROUP BY user_id, agent_id, entity_text")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities in two batches, documents of even ids and then all: each with its memories in the order of first mention."""
    found = _proper_links(spark, sf_dir)
    none = lambda schema: spark.createDataFrame([], schema)
    one, first = entities.upsert(none(entities.ENTITIES), none(entities.MEMBERS), found.where("seq % 2 = 0"), 0)
    two, second = entities.upsert(one, first, found, 1)
    lists = entities.linked_lists(first.unionByName(second), 1 << 30).join(one.unionByName(two), "entity_id")
    return lists.select("user_id", "agent_id", "entity_text", F.size("ids").cast("long").alias("n_memories"), F.md5(F.array_join("ids", ",")).alias("ids_hash"))


_BYTES = "list_transform(regexp_extract_all(hex({}), '..'), lambda h, i: ('0x' || h)::BIGINT * 8 + (i - 1) % 8)"
_FACTOR = f"list_reduce({_BYTES}, lambda a, x: a * (x // 8 + 1) % 1000003, 1::BIGINT)"
_TERM = f"list_reduce({_BYTES}, lambda a, x: (a * (x // 8 + 1) + x % 8 + 1) % 1000003, 0::BIGINT)"


def _hash_sql(x: str) -> str:
    return f"list_transform(range(8), lambda d: ((d * {_FACTOR.format(x)} + {_TERM.format(x)}) % 1000003)::FLOAT)"


ASKED = "Old Town"
_AV = "[" + ", ".join(f"{int(x)}" for x in embed_text(ASKED)) + "]"
_NEAR_ASKED = f"list_reduce(list_transform(list_zip({_hash_sql('entity_text')}, {_AV}), lambda x: abs(x[1] - x[2])::FLOAT), lambda a, b: (a + b)::FLOAT, 0::FLOAT)"


@_register(
    "entity_boost",
    f"WITH l AS ({_LINKS_SQL}), near AS (SELECT entity_text FROM (SELECT DISTINCT entity_text FROM l) ORDER BY {_NEAR_ASKED}, entity_text LIMIT 5) "
    f"SELECT {_ID} AS id, CASE WHEN {_ID} IN (SELECT id FROM l WHERE entity_text IN (SELECT entity_text FROM near)) THEN round(doc_id * 0.85, 2) ELSE doc_id END::DOUBLE AS score FROM documents",
)
def entity_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _memories(spark, sf_dir).select("id", F.col("seq").cast("float").alias("score"))
    boosted = ranking.boost(scored, entities.boosted_ids(_proper_links(spark, sf_dir), [("proper", ASKED)]))
    return boosted.select("id", F.round(F.col("score").cast("double"), 2).alias("score"))


@_register("hash_embed", f"SELECT conv_id, turn, array_to_string(list_transform({_hash_sql('text')}, lambda v: v::BIGINT::VARCHAR), ' ') AS vector FROM conversations WHERE text <> ''")
def hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.array_join(F.transform(hash_embedding(F.col("text")), lambda x: x.cast("long").cast("string")), " ").alias("vector"))


_LAST = "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id"
_FACTS = r"list_transform(list_filter(list_transform(string_split_regex(body, '[.!?]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), lambda x: x || '.')"
_MARKED = "list_transform(list_filter(string_split_regex(text, '\\r?\\n'), lambda x: contains(x, ': ')), lambda x: substr(x, strpos(x, ': ') + 2))"


@_register("facts_from_conversations", f"SELECT conv_id, (i - 1)::INTEGER AS pos, facts[i] AS fact FROM (SELECT conv_id, facts, unnest(range(1, len(facts) + 1)) AS i FROM (SELECT conv_id, {_FACTS} AS facts FROM (SELECT conv_id, CASE WHEN len({_MARKED}) > 0 THEN array_to_string({_MARKED}, ' ') ELSE text END AS body FROM ({_LAST}))))")
def facts_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.facts_of(_t(spark, sf_dir, "conversations"))


@_register("procedural_summary", "SELECT conv_id, 'Conversation:' || chr(10) || string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def procedural_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.procedures(_t(spark, sf_dir, "conversations"))


@_register("score_parse", r"SELECT event_id, least(1, greatest(0, coalesce(try_cast(nullif(regexp_extract(s, '-?[0-9]+\.[0-9]+'), '') AS DOUBLE), try_cast(nullif(regexp_extract(s, '-?[0-9]+'), '') AS DOUBLE), 0.5)))::DOUBLE AS score FROM (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'none' WHEN event_id % 4 = 1 THEN 'Score: ' || (event_id % 3)::VARCHAR ELSE 'The score is 0.' || (event_id % 100)::VARCHAR || ' of 1.0' END AS s FROM events)")
def score_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE WHEN event_id % 4 = 0 THEN 'none' WHEN event_id % 4 = 1 THEN 'Score: ' || CAST(event_id % 3 AS STRING) ELSE 'The score is 0.' || CAST(event_id % 100 AS STRING) || ' of 1.0' END")
    return _t(spark, sf_dir, "events").select("event_id", text.score_in(said).alias("score"))


# Keywords, fusion, rerank


def _bm25_sql(table: str, key: str, query: str) -> str:
    """CTEs up to kw (id, keyword_score, tokens) over every row of a table with a column text."""
    terms = keyword.query_terms(query)
    tf = ", ".join(f"len(list_filter(tokens, lambda x: x = '{t}')) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    weight = " + ".join(f"CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * length / average))" for i in range(len(terms)))
    any_ = " OR ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"tok AS (SELECT *, {key} AS id, {_TOKENS.format('text')} AS tokens FROM {table}), cnt AS (SELECT *, len(tokens) AS length, {tf} FROM tok), st AS (SELECT count(*) AS n, avg(length) AS average, {df} FROM cnt), kw AS (SELECT cnt.*, -({weight}) AS keyword_score FROM cnt, st WHERE {any_})"


TERMS = "licensed under public thathe"


@_register("bm25_topk", f"WITH {_bm25_sql('documents', 'doc_id', TERMS)} SELECT id, round(keyword_score, 5) AS keyword_score FROM kw ORDER BY kw.keyword_score, id LIMIT 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return keyword.search(docs, TERMS).orderBy("keyword_score", "id").limit(20).select("id", F.round("keyword_score", 5).alias("keyword_score"))


@_register("keyword_all_terms", f"WITH {_bm25_sql('documents', 'doc_id', 'licensed under')} SELECT id, round(keyword_score, 5) AS keyword_score FROM kw WHERE tf0 > 0 AND tf1 > 0 ORDER BY kw.keyword_score, id LIMIT 20")
def keyword_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return keyword.search(docs, "licensed under", require_all=True).orderBy("keyword_score", "id").limit(20).select("id", F.round("keyword_score", 5).alias("keyword_score"))


@_register("bm25_scope_after_score", f"WITH {_bm25_sql('documents', 'doc_id', TERMS)} SELECT id, round(keyword_score, 5) AS keyword_score FROM kw WHERE source = 'src1' ORDER BY kw.keyword_score, id LIMIT 20")
def bm25_scope_after_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "source")
    return keyword.search(docs, TERMS).where("source = 'src1'").orderBy("keyword_score", "id").limit(20).select("id", F.round("keyword_score", 5).alias("keyword_score"))


# Stored indexes and the store


def _contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("user_id"))


_TOP_SQL = "SELECT id, round(keyword_score, 5) AS keyword_score FROM kw {}ORDER BY kw.keyword_score, id LIMIT 20"


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("id", F.round("keyword_score", 5).alias("keyword_score"))


@_register("keyword_index_topk", f"WITH {_bm25_sql('documents', 'doc_id', TERMS)} " + _TOP_SQL.format("WHERE source = 'src1' "))
def keyword_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inverted index of all documents and a search of it within a scope."""
    return _rounded(KeywordIndex.create(spark, shared_path(spark, "keywords"), _contents(spark, sf_dir), ["user_id"]).top_k(TERMS, 20, {"user_id": "src1"}))


_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'licensed ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0)"


@_register("keyword_index_updated", f"WITH {_bm25_sql(_CHANGED, 'doc_id', TERMS)} " + _TOP_SQL.format(""))
def keyword_index_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after a seventh of the documents is gone and a fifth of the others is changed."""
    docs = _contents(spark, sf_dir).drop("user_id")
    index = KeywordIndex.create(spark, shared_path(spark, "keywords"), docs)
    changed = docs.where("id % 5 = 0 AND id % 7 <> 0")
    index.update(changed.withColumn("content", F.concat(F.lit("licensed "), F.coalesce("content", F.lit("")))), docs.where("id % 7 = 0").unionByName(changed))
    return _rounded(index.top_k(TERMS, 20))


def _covers_sql(query: str) -> str:
    """keyword_score of every document that holds all terms: entries are where they stand, and a cover is new where its start is later than the one before's."""
    terms = keyword.query_terms(query)
    last = [f"max(CASE WHEN word = '{t}' THEN i END) OVER w" for t in terms]
    return (
        f"e AS (SELECT doc_id, word, pos, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT doc_id, unnest(tokens) AS word, unnest(range(len(tokens))) AS pos FROM (SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents)) WHERE word IN ({', '.join(repr(t) for t in terms)})),"
        f" l AS (SELECT *, CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in last)} THEN least({', '.join(last)}) END AS low FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),"
        " c AS (SELECT *, lag(low) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l),"
        " kw AS (SELECT c.doc_id AS id, -sum(0.1::DOUBLE / (1 + (c.pos - s.pos) - (c.i - c.low))) AS keyword_score FROM c JOIN e s ON s.doc_id = c.doc_id AND s.i = c.low WHERE c.before IS NULL OR c.low > c.before GROUP BY c.doc_id)"
    )


COVERED = "licensed the under"
_COVER_SQL = f"WITH {_covers_sql(COVERED)} SELECT id, round(keyword_score, 6) AS keyword_score FROM kw"


@_register("cover_density", _COVER_SQL)
def cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cover-density rank of every document with all terms, by a scan."""
    return keyword.search_covers(_contents(spark, sf_dir), COVERED).select("id", F.round("keyword_score", 6).alias("keyword_score"))


@_register("cover_density_indexed", _COVER_SQL + " ORDER BY round(kw.keyword_score, 9), id LIMIT 20")
def cover_density_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best by the positions in an inverted index."""
    found = KeywordIndex.create(spark, shared_path(spark, "keywords"), _contents(spark, sf_dir).drop("user_id")).cover_density(COVERED, 1 << 30)
    return found.orderBy(F.round("keyword_score", 9), "id").limit(20).select("id", F.round("keyword_score", 6).alias("keyword_score"))


@_register("ann_exact_topk", SQL["knn_l1_topk"])
def ann_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector index, and an exact search that reads the cells which can hold a neighbour."""
    rows = _vectors(spark, sf_dir)
    return VectorIndex.create(spark, shared_path(spark, "vectors"), rows).search(_vector_of(spark, sf_dir, 0), 10, exact=True).select("id", _score())


@_register("ann_exact_batch", SQL["knn_batch_topk"])
def ann_exact_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every id divisible by 50."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return VectorIndex.create(spark, shared_path(spark, "vectors"), rows).search_each(asked, 10, exact=True).select("query_id", "id", _score(), "rank")


@_register("ann_recall")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the true ten nearest a search of as many cells as the index found to be needed finds, for every id divisible by 50."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where(F.col("id") % 50 == 0).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return recall(VectorIndex.create(spark, shared_path(spark, "vectors"), rows).search_each(asked, 10), nearest_for_each(rows, asked, 10))


@_register("store_merge_on_read", f"SELECT {_ID} AS id, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE 'old' END AS state, md5(CASE WHEN doc_id % 5 = 0 THEN 'Changed: ' || coalesce(text, '') ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0")
def store_merge_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories in three commits: all, a fifth of them changed, a seventh dropped."""
    store, rows = LogStore(spark, shared_path(spark, "store")), _memories(spark, sf_dir)
    put = lambda state, df: promote(df.select("id", F.lit(None).cast("array<float>").alias("vector"), F.map_concat(F.map_filter("payload", lambda k, _: ~k.isin("state", "content")), F.create_map(F.lit("state"), F.lit(state), F.lit("content"), F.col("content"))).alias("payload")))
    store.append(lifecycle.Change(put=put("old", rows)), 0)
    store.append(lifecycle.Change(put=put("new", rows.where("seq % 5 = 0").withColumn("content", F.concat(F.lit("Changed: "), F.coalesce("content", F.lit("")))))), 1)
    store.append(lifecycle.Change(drop=rows.where("seq % 7 = 0").select("id")), 2)
    return store.load().memories.select("id", F.col("payload")["state"].alias("state"), F.md5("content").alias("hash"))


_CONV_ID = "(conv_id * 1000 + turn)"
HYBRID = "the and thathe onand"
_QV = "[" + ", ".join(f"{int(x)}" for x in embed_text(HYBRID)) + "]"
_SEM = f"list_reduce(list_transform(list_zip({_hash_sql('text')}, {_QV}), lambda x: abs(x[1] - x[2])::FLOAT), lambda a, b: (a + b)::FLOAT, 0::FLOAT)"
_HYBRID_SQL = f"""WITH {_bm25_sql('conversations', _CONV_ID, HYBRID)},
sem AS (SELECT {_CONV_ID} AS id, {_SEM} AS s FROM conversations WHERE text <> '' ORDER BY 2, 1 LIMIT 500),
kwl AS (SELECT id, keyword_score::FLOAT AS k FROM kw ORDER BY keyword_score, id LIMIT 500),
b AS (SELECT (SELECT min(s) FROM sem) AS s0, (SELECT max(s) FROM sem) AS s1, (SELECT min(k) FROM kwl) AS k0, (SELECT max(k) FROM kwl) AS k1),
f AS (SELECT sem.id, s, k, (CASE WHEN s1 > s0 THEN (s - s0)::DOUBLE / (s1 - s0) ELSE 0 END + CASE WHEN k IS NULL THEN 1 WHEN k1 > k0 THEN (k - k0)::DOUBLE / (k1 - k0) ELSE 0 END) / 2 AS score FROM sem LEFT JOIN kwl ON sem.id = kwl.id, b)
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content"))


def _hybrid(spark: SparkSession, sf_dir: str, query: str, explain: bool) -> DataFrame:
    rows = _turns(spark, sf_dir)
    near = nearest(rows.where("content <> ''").withColumn("vector", hash_embedding(F.col("content"))), embed_text(HYBRID), window_size(10))
    hits = keyword.search(rows, query).orderBy("keyword_score", "id").limit(window_size(10)).select("id", "keyword_score")
    return ranking.fuse(ranking.details(near, explain), hits)


@_register("hybrid_fusion", _HYBRID_SQL + "SELECT id, round(score, 4) AS score FROM f ORDER BY f.score, id LIMIT 10")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, HYBRID, False).orderBy("score", "id").limit(10).select("id", _score())


@_register("hybrid_explain", _HYBRID_SQL + "SELECT id, round(s::DOUBLE, 1) AS semantic_score, round(k::DOUBLE, 4) + 0.0 AS bm25_score, round(score, 4) AS final_score FROM f")
def hybrid_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("score_details")
    return _hybrid(spark, sf_dir, HYBRID, True).select("id", F.round(d["semantic_score"].cast("double"), 1).alias("semantic_score"), F.round(d["bm25_score"].cast("double"), 4).alias("bm25_score"), F.round(d["final_score"].cast("double"), 4).alias("final_score"))


@_register("hybrid_empty_keyword", f"SELECT {_CONV_ID} AS id, round(({_SEM})::DOUBLE, 1) AS score FROM conversations WHERE text <> '' ORDER BY {_SEM}, 1 LIMIT 10")
def hybrid_empty_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, "zzzznosuchword", False).orderBy("score", "id").limit(10).select("id", F.round(F.col("score").cast("double"), 1).alias("score"))


_QT = f"list_distinct({_TOKENS.format(chr(39) + HYBRID + chr(39))})"


@_register(
    "rerank_overlap",
    f"WITH sem AS (SELECT {_CONV_ID} AS id, text, {_SEM} AS s FROM conversations WHERE text <> '' ORDER BY 3, 1 LIMIT 50), b AS (SELECT min(s) AS s0, max(s) AS s1 FROM sem) "
    f"SELECT id, round((CASE WHEN s1 > s0 THEN (s - s0)::DOUBLE / (s1 - s0) ELSE 0 END + 1 - len(list_intersect({_QT}, list_distinct({_TOKENS.format('text')})))::DOUBLE / len({_QT})) / 2, 4) AS score FROM sem, b",
)
def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = nearest(_turns(spark, sf_dir).where("content <> ''").withColumn("vector", hash_embedding(F.col("content"))), embed_text(HYBRID), 50)
    return ranking.overlap_reranker(near, HYBRID).select("id", _score())


# Changes

_IN = "SELECT source AS user_id, text AS content, doc_id AS seq FROM documents WHERE lang = 'en'"
_OLD = "SELECT source AS user_id, text AS content FROM documents WHERE lang <> 'en'"


@_register("add_dedup", f"WITH i AS ({_IN}), o AS ({_OLD}), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, content ORDER BY seq) AS n FROM i) SELECT seq, user_id FROM r WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.user_id = r.user_id AND o.content = r.content)")
def add_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("source").alias("user_id"), F.col("text").alias("content"), F.col("doc_id").alias("seq"), "lang")
    return lifecycle.new_facts(d.where("lang = 'en'").drop("lang"), d.where("lang <> 'en'"), ["user_id"]).select("seq", "user_id")


@_register("add_dedup_within_batch", "SELECT min(doc_id) AS seq FROM documents GROUP BY text")
def add_dedup_within_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select(F.col("text").alias("content"), F.col("doc_id").alias("seq"))
    return lifecycle.new_facts(d, d.limit(0), []).select("seq")


def _tables(spark: SparkSession, sf_dir: str) -> lifecycle.Tables:
    rows = _memories(spark, sf_dir)
    history = rows.select("id", F.lit(0).cast("long").alias("seq"), F.lit("Added").alias("event"), "content")
    none = spark.createDataFrame([], ", ".join(f"{k} string" for k in (*SCOPE_KEYS, "entity_type", "entity_text", "id")) + ", seq bigint")
    return lifecycle.Tables(rows.withColumn("vector", F.lit(None).cast("array<float>")), history, none)


@_register("update_merge_metadata", f"SELECT {_ID} AS id, source AS user_id, CASE WHEN doc_id = 5 THEN 'high' END AS priority, CASE WHEN doc_id = 5 THEN 'Changed.' ELSE text END AS content FROM documents")
def update_merge_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.update(_tables(spark, sf_dir), "rec-000000000005", "Changed.", {"priority": "high"}).memories
    return rows.select("id", "user_id", F.col("payload")["priority"].alias("priority"), "content")


@_register("update_embeds_anew", "SELECT " + ", ".join(f"{int(x)}::BIGINT AS v{i}" for i, x in enumerate(embed_text("Changed."))))
def update_embeds_anew(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.update(_tables(spark, sf_dir), "rec-000000000005", "Changed.").memories.where("id = 'rec-000000000005'")
    return rows.select(*(F.col("vector")[i].cast("long").alias(f"v{i}") for i in range(8)))


@_register("delete_with_history", f"SELECT {_ID} AS id, 0::BIGINT AS seq, 'Added' AS event FROM documents UNION ALL SELECT {_ID}, 1, 'Deleted' FROM documents WHERE doc_id = 5")
def delete_with_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.delete(_tables(spark, sf_dir), "rec-000000000005").history.select("id", "seq", "event")


@_register("reset_scope_filter", f"SELECT {_ID} AS id FROM documents WHERE NOT (coalesce(source = 'src1', false) AND coalesce(lang = 'en', false))")
def reset_scope_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.reset(_tables(spark, sf_dir), {"user_id": "src1"}, {"agent_id": "en"})[0].memories.select("id")


@_register("reset_counts", "SELECT count(*) AS n FROM documents WHERE source = 'src1' AND lang = 'en'")
def reset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(lifecycle.reset(_tables(spark, sf_dir), {"user_id": "src1"}, {"agent_id": "en"})[1]).cast("long").alias("n"))


@_register("count_memories", "SELECT count(*) AS n, least(count(*), 25) AS as_listed FROM documents WHERE source = 'src1'")
def count_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scope = _memories(spark, sf_dir), {"user_id": "src1"}
    return spark.range(1).select(F.lit(lifecycle.count_memories(rows, scope, TODAY)).cast("long").alias("n"), F.lit(lifecycle.count_memories(rows, scope, TODAY, 25)).cast("long").alias("as_listed"))


@_register("fetch_in_order", f"SELECT (row_number() OVER (ORDER BY doc_id DESC) - 1)::BIGINT AS pos, {_ID} AS id, text AS content FROM documents WHERE doc_id % 50 = 0")
def fetch_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir)
    ids = ranking.numbered(rows.where("seq % 50 = 0").select("id"), F.desc("id"))
    unknown = spark.range(1).select(F.lit("rec-unknown").alias("id"), F.lit(-1).cast("long").alias("pos"))
    return lifecycle.fetch(rows, ids.unionByName(unknown)).select("pos", "id", "content")


@_register("upsert_records", "SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE label::VARCHAR END AS label, round(CASE WHEN vec_id % 3 = 0 THEN embedding[1] + 1 ELSE embedding[1] END::DOUBLE, 4) AS first FROM embeddings")
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "vector", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("payload"))
    more = rows.where("id % 3 = 0").select("id", F.transform("vector", lambda x: (x + 1).cast("float")).alias("vector"), F.create_map(F.lit("label"), F.lit("new")).alias("payload"))
    kept = lifecycle.upsert(promote(rows), more, len(_vector_of(spark, sf_dir, 0)))
    return kept.select(F.col("id").cast("long").alias("id"), F.col("payload")["label"].alias("label"), F.round(F.col("vector")[0].cast("double"), 4).alias("first"))


@_register("add_raw_messages", "SELECT text AS content, arg_min(role, conv_id * 1000000 + turn) AS role, min(conv_id * 1000000 + turn) AS seq FROM conversations WHERE trim(text) <> '' GROUP BY text")
def add_raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.engine import Engine

    engine = Engine(spark)
    new = engine.add(_t(spark, sf_dir, "conversations"), {"user_id": "u"}, infer=False)
    return new.join(engine.tables.history.select("id", "seq"), "id").select("content", F.col("payload")["role"].alias("role"), "seq")


@_register("add_procedural", "SELECT 'Conversation:' || chr(10) || string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS content, 0 AS n_links FROM conversations GROUP BY conv_id")
def add_procedural(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.engine import Engine

    engine, scope = Engine(spark), {"agent_id": "a", "memory_type": "procedural_memory"}
    return engine.add(_t(spark, sf_dir, "conversations"), scope).select("content", F.lit(engine.tables.links.count()).cast("int").alias("n_links"))


# Small functions


@_register("fact_lines", r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS facts FROM documents")
def fact_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.array_join(text.facts_of_lines(F.col("text")), "|").alias("facts"))


@_register("first_chars", "SELECT doc_id, md5(substr(text, 1, 4000)) AS hash FROM documents")
def first_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(text.first_chars(F.col("text"))).alias("hash"))


@_register("content_checks", r"SELECT doc_id, text IS NULL OR regexp_replace(text, '^\s+|\s+$', '', 'g') = '' OR strlen(text) > 1500 AS faulty FROM documents")
def content_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", text.faulty(F.col("text"), 1500).alias("faulty"))


@_register("metadata_bytes", "SELECT doc_id, strlen('user_id' || source || 'agent_id' || lang || 'content' || text) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
def metadata_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _memories(spark, sf_dir).where("user_id IS NOT NULL AND agent_id IS NOT NULL AND content IS NOT NULL")
    return rows.select(F.col("seq").alias("doc_id"), lifecycle.metadata_bytes(F.col("payload")).alias("n"))


@_register("roles", "SELECT conv_id, turn, role IN ('system', 'user', 'assistant') AS known, upper(role) IN ('system', 'user', 'assistant') AS known_upper FROM conversations")
def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_role(F.col("role")).alias("known"), text.is_role(F.upper("role")).alias("known_upper"))


@_register("date_shapes", "SELECT o_orderkey, regexp_full_match(CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%d.%m.%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AS is_date FROM orders")
def date_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return _t(spark, sf_dir, "orders").select("o_orderkey", text.is_date_shaped(day).alias("is_date"))


@_register("auth_kinds", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bearer' WHEN 1 THEN 'api_key' WHEN 2 THEN 'none' ELSE 'bearer' END AS kind FROM events")
def auth_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.expr("CASE event_id % 4 WHEN 0 THEN map('Authorization', 'Bearer x') WHEN 1 THEN map('X-API-Key', 'k', 'authorization', 'Basic y') WHEN 2 THEN map('Accept', '*') ELSE map('x-api-key', 'k', 'AUTHORIZATION', 'Bearer z') END")
    return _t(spark, sf_dir, "events").select("event_id", text.auth_kind(headers).alias("kind"))


@_register("project_ids", "SELECT c_custkey, CASE WHEN c_custkey % 3 < 2 THEN 'owner' || c_custkey || '-' || 'repo' || c_custkey END AS project FROM customer")
def project_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    remote = F.expr("CASE c_custkey % 3 WHEN 0 THEN concat('git@host:owner', c_custkey, '/repo', c_custkey, '.git') WHEN 1 THEN concat('https://host/owner', c_custkey, '/repo', c_custkey) ELSE 'nothing' END")
    return _t(spark, sf_dir, "customer").select("c_custkey", text.project_id(remote).alias("project"))


@_register("state_keys", "SELECT c_custkey, substr(sha256(c_name || chr(0) || c_mktsegment), 1, 16) AS state FROM customer")
def state_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", text.state_key(F.col("c_name"), F.col("c_mktsegment")).alias("state"))


@_register("parts_text", r"SELECT conv_id, turn, regexp_replace(' ' || text || chr(10) || role, '^\s+|\s+$', '', 'g') AS said FROM conversations")
def parts_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda kind, x: F.struct(F.lit(kind).alias("type"), x.alias("text"))
    parts = F.array(part("text", F.concat(F.lit(" "), F.col("text"))), part("image", F.lit("x")), part("text", F.col("role")))
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", text.text_of_parts(parts).alias("said"))


@_register("sigmoid_scores", "SELECT event_id, round((1 / (1 + exp(-(value / 100))))::FLOAT::DOUBLE, 5) AS score FROM events")
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", F.round(ranking.sigmoid(F.col("value") / 100).cast("double"), 5).alias("score"))


# Logs and streams


@_register("request_log_last_n", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 1000")
def request_log_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.last_requests(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id")


@_register("session_gate", "WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END)::BIGINT AS n_sessions, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) >= 5 AS due FROM l GROUP BY user_id")
def session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.session_gate(_t(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


_BUCKET = (5.0, 1 / 90)


@_register(
    "rate_limit",
    f"""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, n, us, {_BUCKET[0]}::DOUBLE AS had FROM o WHERE n = 1
      UNION ALL SELECT o.user_id, o.event_id, o.n, o.us, least({_BUCKET[0]}::DOUBLE, CASE WHEN b.had >= 1 THEN b.had - 1 ELSE b.had END + (o.us - b.us)::DOUBLE / 1e6::DOUBLE * {_BUCKET[1]}::DOUBLE) FROM b JOIN o ON o.user_id = b.user_id AND o.n = b.n + 1)
SELECT user_id, event_id, had >= 1 AS allowed, round(CASE WHEN had >= 1 THEN had - 1 ELSE had END, 6) AS tokens FROM b""",
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a request of its user, by buckets of five that refill in 90 seconds a token."""
    events = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return limited(events, capacity=_BUCKET[0], refill=_BUCKET[1]).select("user_id", "event_id", "allowed", F.round("tokens", 6).alias("tokens"))


@_register("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.windowed_counts(_t(spark, sf_dir, "events"))


@_register(
    "consolidation_due",
    "WITH l AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events), g AS (SELECT user_id, sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END)::BIGINT AS n_sessions FROM l GROUP BY user_id), "
    "m AS (SELECT user_id, count(*) AS n_memories, min(ts) AS last_at FROM events WHERE event_id % 2 = 0 GROUP BY user_id) "
    "SELECT g.user_id, n_sessions, coalesce(n_memories, 0) AS n_memories, n_sessions >= 5 AND coalesce(n_memories, 0) >= 34 AND (last_at IS NULL OR epoch(TIMESTAMP '2024-01-20 00:00:00') - floor(epoch(last_at)) >= 86400) AS due FROM g LEFT JOIN m USING (user_id)",
)
def consolidation_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    half = events.where("event_id % 2 = 0")
    gates = ingest.session_gate(events, "user_id", "event_type", "event_id")
    return ingest.consolidation_due(gates, half, half.groupBy("user_id").agg(F.min("ts").alias("at")), "2024-01-20 00:00:00", "user_id", least=34)


@_register("dates_of_seconds", "SELECT event_id, strftime(epoch_ms(epoch_ms(ts)), '%Y-%m-%d') AS day FROM events")
def dates_of_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", text.date_of(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("day"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search over documents as memories: window, keywords, entities, rerank."""
    from .plans.engine import Engine

    rows = _memories(spark, sf_dir).where("content <> ''").withColumn("vector", hash_embedding(F.col("content")))
    tables = lifecycle.Tables(rows, None, entities.links(rows))
    return Engine(spark, tables=tables).search(ASKED_FOR, 10, {"agent_id": "en"}, TODAY, rerank=True, explain=True)


QUERIES["search"] = flagship

ASKED_FOR = "licensed under the general public license"
_ASKED_VECTOR = "[" + ", ".join(f"{int(x)}" for x in embed_text(ASKED_FOR)) + "]"
_ASKED_FAR = f"list_reduce(list_transform(list_zip({_hash_sql('text')}, {_ASKED_VECTOR}), lambda x: abs(x[1] - x[2])::FLOAT), lambda a, b: (a + b)::FLOAT, 0::FLOAT)"
_ASKED_TOKENS = f"list_distinct({_TOKENS.format(chr(39) + ASKED_FOR + chr(39))})"


@_register(
    "search_scores",
    f"""WITH {_bm25_sql("(SELECT * FROM documents WHERE text <> '')", "doc_id", ASKED_FOR)},
sem AS (SELECT doc_id AS id, text, {_ASKED_FAR} AS s FROM documents WHERE lang = 'en' AND text <> '' ORDER BY 3, 1 LIMIT 500),
kwl AS (SELECT id, keyword_score::FLOAT AS k FROM kw WHERE lang = 'en' ORDER BY keyword_score, id LIMIT 500),
b AS (SELECT (SELECT min(s) FROM sem) AS s0, (SELECT max(s) FROM sem) AS s1, (SELECT min(k) FROM kwl) AS k0, (SELECT max(k) FROM kwl) AS k1),
f AS (SELECT sem.id, text, s, (CASE WHEN s1 > s0 THEN (s - s0)::DOUBLE / (s1 - s0) ELSE 0 END + CASE WHEN k IS NULL THEN 1 WHEN k1 > k0 THEN (k - k0)::DOUBLE / (k1 - k0) ELSE 0 END) / 2 AS score FROM sem LEFT JOIN kwl ON sem.id = kwl.id, b),
top AS (SELECT * FROM f ORDER BY score, s, id LIMIT 10), t AS (SELECT min(score) AS t0, max(score) AS t1 FROM top)
SELECT {_ID.replace("doc_id", "id")} AS id, round((CASE WHEN t1 > t0 THEN (score - t0) / (t1 - t0) ELSE 0 END + 1 - len(list_intersect({_ASKED_TOKENS}, list_distinct({_TOKENS.format('text')})))::DOUBLE / len({_ASKED_TOKENS})) / 2, 4) AS score FROM top, t""",
)
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and scores of the flagship search."""
    return flagship(spark, sf_dir).select("id", _score())


@_register("search_batch")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for the first 60 characters of the first turn of every conversation whose id is divisible by 50, over all turns as memories."""
    from .plans.engine import Engine

    c = _t(spark, sf_dir, "conversations").where("text <> ''")
    payload = F.create_map(F.lit("user_id"), F.lit("u"), F.lit("agent_id"), F.col("role"), F.lit("content"), F.col("text"))
    rows = promote(c.select(F.concat_ws("-", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("id"), hash_embedding(F.col("text")).alias("vector"), payload.alias("payload")))
    linked = entities.links(rows.withColumn("seq", F.lit(0).cast("long")))
    asked = c.where("turn = 0 AND conv_id % 50 = 0").select(F.col("conv_id").alias("query_id"), F.substring("text", 1, 60).alias("query"))
    found = Engine(spark, tables=lifecycle.Tables(rows, None, linked)).search_each(asked, 5, {"user_id": "u"}, TODAY)
    return found.select("query_id", "rank", "id", "score")
