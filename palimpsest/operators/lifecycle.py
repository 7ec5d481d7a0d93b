"""Changes to memories as pure functions of DataFrames: add, update, delete, reset, list, history, counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DimensionMismatch, NotFound, Validation
from ..functions import filters
from ..functions.embed import Embedding
from ..functions.text import faulty, rendered, sentence_facts
from ..schema import SCOPE_KEYS, key, promote
from .entities import links


@dataclass
class Tables:
    """The state of a store. Every change returns new tables and leaves these as they are."""

    memories: DataFrame
    history: DataFrame
    links: DataFrame


@dataclass
class Change:
    """What a change adds to a store: rows to put in place of those of their id, ids to drop, entries, links, entities whose links go; and the scope it was worked out on, if it took all of it into account."""

    put: DataFrame | None = None
    drop: DataFrame | None = None
    history: DataFrame | None = None
    links: DataFrame | None = None
    unlink: DataFrame | None = None
    scope: dict[str, str] | None = None


def value_of(df: DataFrame):
    return lambda name: key(name, df.columns)


def need_scope(scope: dict[str, str]) -> None:
    if not any(k in scope for k in SCOPE_KEYS):
        raise Validation("a scope names a user, an agent or a run")


def facts_of(conversations: DataFrame, infer: bool = True, extract: Callable[[Column], Column] = sentence_facts) -> DataFrame:
    """conv_id, pos, fact: what ``extract``, by default the sentences, gives for each conversation's last message; without ``infer`` every message as it is, and its role."""
    if not infer:
        return conversations.select("conv_id", F.col("turn").alias("pos"), F.col("text").alias("fact"), "role").where(~faulty(F.col("fact")))
    last = conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    return last.select("conv_id", F.posexplode(extract(F.coalesce("text", F.lit("")))).alias("pos", "fact"))


def described(messages: DataFrame, describe: Callable[[Column], Column]) -> DataFrame:
    """``messages`` with a column ``images`` (array<binary>) whose text is replaced, where there are any, by what a provider says of them."""
    return messages.withColumn("text", F.when(F.size("images") > 0, describe(F.col("images"))).otherwise(F.col("text"))).drop("images")


def procedures(conversations: DataFrame, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """conv_id, summary: what a provider makes of all messages of a conversation, given as one text; without one, that text."""
    turns = F.collect_list(F.struct("turn", "role", "text"))  # of one conversation
    whole = conversations.groupBy("conv_id").agg(rendered(turns).alias("summary"))
    return whole if summarise is None else whole.select("conv_id", summarise(F.col("summary")).alias("summary"))


def new_facts(incoming: DataFrame, existing: DataFrame, scope: list[str]) -> DataFrame:
    """``incoming`` (scope..., content, seq): the first of each content in a scope, unless ``existing`` has it there. An existing row may have more keys."""
    rest = [F.min_by(c, "seq").alias(c) for c in incoming.columns if c not in (*scope, "content", "seq")]
    first = incoming.groupBy(*scope, "content").agg(*rest, F.min("seq").alias("seq"))  # repeats meet before the shuffle
    return first.join(existing.select(*scope, "content").distinct(), [*scope, "content"], "left_anti")


def metadata_bytes(payload: Column) -> Column:
    """UTF-8 bytes of all keys and values of a map."""
    return F.aggregate(F.map_entries(payload), F.lit(0).cast("long"), lambda n, e: n + F.octet_length(e["key"]) + F.octet_length(e["value"]))


def add(tables: Tables, facts: DataFrame, scope: dict[str, str], metadata: dict[str, str] | None = None, max_bytes: int | None = None, max_metadata_bytes: int | None = None, embedding: Embedding | None = None, plain: bool = False) -> Tables:
    """``added``, without the new rows."""
    return added(tables, facts, scope, metadata, max_bytes, max_metadata_bytes, embedding, plain)[0]


def added(tables: Tables, facts: DataFrame, scope: dict[str, str], metadata: dict[str, str] | None = None, max_bytes: int | None = None, max_metadata_bytes: int | None = None, embedding: Embedding | None = None, plain: bool = False) -> tuple[Tables, DataFrame]:
    """``tables`` with what ``addition`` says, and the new rows."""
    change = addition(tables, facts, scope, metadata, max_bytes, max_metadata_bytes, embedding, plain)
    linked = tables.links if change.links is None else tables.links.unionByName(change.links)
    return Tables(tables.memories.unionByName(change.put), tables.history.unionByName(change.history), linked), change.put


def addition(tables: Tables, facts: DataFrame, scope: dict[str, str], metadata: dict[str, str] | None = None, max_bytes: int | None = None, max_metadata_bytes: int | None = None, embedding: Embedding | None = None, plain: bool = False) -> Change:
    """``facts`` (seq, content, role if they have one) under a scope: those it doesn't have become memories with history and entity links.

    A ``content`` in the scope stands for the text in the payload only. A ``plain`` fact is stored whether or not it is
    known, and has no links. An id is fixed by scope, content, place and how much has happened in the store so far, so that no
    memory ever gets an id that another has or had.
    """
    need_scope(scope)
    payload = {**scope, **(metadata or {})}
    if max_metadata_bytes is not None and sum(len(k.encode()) + len(v.encode()) for k, v in payload.items()) > max_metadata_bytes:
        raise Validation("the metadata is too long")
    if facts.where(faulty(F.col("content"), max_bytes)).limit(1).count():
        raise Validation("a content is empty or too long")
    keys = [k for k in scope if k != "content"]
    known = tables.memories.where(filters.in_scope({k: scope[k] for k in keys}, value_of(tables.memories))).select("content")
    fresh = facts if plain else new_facts(facts, known, [])
    entries = [F.lit(x) for kv in payload.items() for x in kv] + ([] if "content" in payload else [F.lit("content"), F.col("content")])
    made = F.create_map(*entries)
    if "role" in facts.columns and "role" not in payload:
        made = F.when(F.col("role").isNull(), made).otherwise(F.map_concat(made, F.create_map(F.lit("role"), F.col("role"))))
    happened = getattr(tables, "events", None)
    scope_id = "\0".join(f"{k}={scope[k]}" for k in sorted(scope)) + f"\0{tables.history.count() if happened is None else happened}"
    id_ = F.concat(F.lit("rec-"), F.substring(F.sha2(F.concat(F.lit(scope_id), F.lit("\0"), F.col("seq").cast("string"), F.lit("\0"), F.col("content")), 256), 1, 24))
    records = fresh.select(id_.alias("id"), (embedding or Embedding()).of_column(F.col("content")).alias("vector"), made.alias("payload"), F.col("content").alias("_fact"), "seq")
    log = records.select("id", F.col("seq").cast("bigint"), F.lit("Added").alias("event"), F.col("_fact").alias("content"))
    own = records.select(*(F.lit(scope.get(k)).cast("string").alias(k) for k in SCOPE_KEYS), "id", F.col("seq").cast("bigint"), F.col("_fact").alias("content"))
    return Change(put=promote(records), history=log, links=None if plain else links(own), scope=None if plain else {k: scope[k] for k in keys})


def upsert(memories: DataFrame, records: DataFrame, dimension: int) -> DataFrame:
    """``memories`` with ``records`` (id, vector, payload): one of a known id replaces it. Every vector has ``dimension`` numbers, else nothing is stored; of records that share an id the last by payload is."""
    wrong = records.where(F.coalesce(F.size("vector"), F.lit(-1)) != dimension).select(F.size("vector").alias("n")).first()
    if wrong is not None:
        raise DimensionMismatch(dimension, wrong["n"])
    one = records.groupBy("id").agg(F.max_by(F.struct("vector", "payload"), F.coalesce(F.to_json("payload"), F.lit(""))).alias("r")).select("id", "r.vector", "r.payload")
    return memories.join(one.select("id"), "id", "left_anti").unionByName(promote(one))


def fetch(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """pos and the memory of each of ``ids`` (pos, id), in the order of pos; unknown ids are left out."""
    return ids.join(memories, "id").orderBy("pos")


def count_memories(memories: DataFrame, scope: dict[str, str] | None, today: str, most: int | None = None) -> int:
    """How many live memories a scope has; with ``most``, as a client counts that lists so many at most."""
    return list_memories(memories, scope, today, limit=most).count()


def merged(payload: Column, changes: dict[str, str]) -> Column:
    """``payload`` with the keys of ``changes`` added or replaced; none can be taken away."""
    rest = F.map_filter(payload, lambda k, _: ~k.isin(*changes))
    return F.map_concat(rest, F.create_map(*(F.lit(x) for kv in changes.items() for x in kv)))


def _wanted(tables: Tables, id_: str, content: str | None, metadata: dict[str, str] | None) -> dict[str, str]:
    if set(metadata or {}) & set(SCOPE_KEYS):
        raise Validation("the scope of a memory can't change")
    if not tables.memories.where(F.col("id") == id_).limit(1).count():
        raise NotFound(id_)
    return dict(metadata or {}) | ({"content": content} if content is not None else {})


def updating(tables: Tables, id_: str, content: str | None = None, metadata: dict[str, str] | None = None, embedding: Embedding | None = None) -> Change:
    """``update`` as the one row that changes."""
    changes = _wanted(tables, id_, content, metadata)
    if not changes:
        return Change()
    vector = F.col("vector") if content is None else (embedding or Embedding()).of_column(F.lit(content))
    return Change(put=promote(tables.memories.where(F.col("id") == id_).select("id", vector.alias("vector"), merged(F.col("payload"), changes).alias("payload"))))


def update(tables: Tables, id_: str, content: str | None = None, metadata: dict[str, str] | None = None, embedding: Embedding | None = None) -> Tables:
    """One memory with new content, embedded anew, or merged metadata. Scope keys can't change; history and links stay."""
    changes = _wanted(tables, id_, content, metadata)
    if not changes:
        return tables
    hit = F.col("id") == id_
    rows = tables.memories.select("id", F.when(hit & F.lit(content is not None), (embedding or Embedding()).of_column(F.lit(content or ""))).otherwise(F.col("vector")).alias("vector"), F.when(hit, merged(F.col("payload"), changes)).otherwise(F.col("payload")).alias("payload"))
    return Tables(promote(rows), tables.history, tables.links)


def _entries(tables: Tables, gone: DataFrame) -> DataFrame:
    last = tables.history.groupBy("id").agg(F.max("seq").alias("seq"))
    return gone.where(F.col("content").isNotNull()).join(last, "id", "left").select("id", (F.coalesce("seq", F.lit(-1)) + 1).alias("seq"), F.lit("Deleted").alias("event"), "content")


def _without(tables: Tables, doomed: Column) -> tuple[Tables, DataFrame]:
    gone = tables.memories.where(doomed).select("id", "content")
    return Tables(tables.memories.where(~doomed), tables.history.unionByName(_entries(tables, gone)), tables.links), gone


def deletion(tables: Tables, id_: str) -> Change:
    """``delete`` as the rows it adds."""
    gone = tables.memories.where(F.col("id") == id_).select("id", "content")
    return Change(drop=gone.select("id"), history=_entries(tables, gone))


def delete(tables: Tables, id_: str) -> Tables:
    """Without one memory; an unknown id changes nothing. Links to it stay: its id can't be in a result."""
    return _without(tables, F.col("id") == id_)[0]


def _matching(df: DataFrame, scope: dict[str, str], spec: dict | None) -> Column:
    of = value_of(df)
    return filters.in_scope(scope, of) & (filters.compile_filter(filters.parse(spec), of) if spec is not None else F.lit(True))


def reset(tables: Tables, scope: dict[str, str] | None = None, spec: dict | None = None) -> tuple[Tables, int]:
    """Without the memories of a scope that a filter holds for, expired ones too, and without the scope's entity rows, all if neither is given; and how many rows went."""
    kept, gone = _without(tables, _matching(tables.memories, scope or {}, spec))
    doomed = _doomed_entities(scope, spec)
    entity_rows = tables.links.where(doomed).select(*SCOPE_KEYS, "entity_type", "entity_text").distinct()
    return Tables(kept.memories, kept.history, tables.links.where(~doomed)), gone.count() + entity_rows.count()


def resetting(tables: Tables, scope: dict[str, str] | None = None, spec: dict | None = None) -> Change:
    """``reset`` as the rows it adds."""
    gone = tables.memories.where(_matching(tables.memories, scope or {}, spec)).select("id", "content")
    entity_rows = tables.links.where(_doomed_entities(scope, spec)).select(*SCOPE_KEYS, "entity_type", "entity_text").distinct()
    return Change(drop=gone.select("id"), history=_entries(tables, gone), unlink=entity_rows, scope=dict(scope or {}))


def _doomed_entities(scope: dict[str, str] | None, spec: dict | None) -> Column:
    entity_key = F.map_from_arrays(F.array(*(F.lit(k) for k in (*SCOPE_KEYS, "entity_type", "entity_text"))), F.array(*(F.col(k) for k in (*SCOPE_KEYS, "entity_type", "entity_text"))))
    of = lambda name: entity_key[name]
    return filters.in_scope(scope or {}, of) & (filters.compile_filter(filters.parse(spec), of) if spec is not None else F.lit(True))


def list_memories(memories: DataFrame, scope: dict[str, str] | None, today: str, offset: int = 0, limit: int | None = None, show_expired: bool = False, spec: dict | None = None) -> DataFrame:
    """A page of memories by id, after all filters. ``scope`` None lists all scopes."""
    if scope is not None:
        need_scope(scope)
    rows = memories.where(_matching(memories, scope or {}, spec))
    if not show_expired:
        rows = rows.where(filters.is_live(today, value_of(memories)("expiration_date")))
    rows = rows.orderBy("id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def history(tables: Tables, id_: str, offset: int = 0, limit: int = 100) -> DataFrame:
    """A page of what happened to an id, which outlives it."""
    return tables.history.where(F.col("id") == id_).orderBy("seq").offset(offset).limit(limit)


def get(memories: DataFrame, id_: str) -> DataFrame:
    return memories.where(F.col("id") == id_).limit(1)


def list_entities(memories: DataFrame) -> DataFrame:
    """entity_type, entity_id, memory_count of the scope keys, expired memories included."""
    each = memories.select(F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), F.col(k).alias("entity_id")) for k in SCOPE_KEYS))).alias("e")).where("e.entity_id IS NOT NULL")
    return each.groupBy("e.entity_type", "e.entity_id").agg(F.count("*").alias("memory_count")).orderBy("entity_type", "entity_id")


def as_records(memories: DataFrame) -> DataFrame:
    """id and payload, as clients are shown memories: without vectors and columns that the payload has."""
    return memories.select("id", "payload")


def as_entries(history_rows: DataFrame) -> DataFrame:
    """id, seq, event in lower case, content, as clients are shown a history."""
    return history_rows.select("id", "seq", F.lower("event").alias("event"), "content")
