"""The search pipeline and an engine that holds tables, providers and their settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Config, Provider, Validation
from ..functions import filters, providers
from ..functions.embed import Embedding
from ..functions.text import entities, facts_of_lines, sentence_facts
from ..operators import keyword, lifecycle, ranking
from ..operators.entities import boosted_ids, entity_id
from ..operators.knn import nearest, window_size
from ..operators.lifecycle import Tables, value_of
from . import batch
from ..schema import ENTITY_LINKS, HISTORY, MEMORIES, SCOPE_KEYS
from ..session import shared_path
from ..sources.keyword_index import KeywordIndex
from ..sources.log_store import LogStore
from ..sources.vector_index import VectorIndex


@dataclass(frozen=True)
class Settings:
    """What a deployment fixes; ``validate`` before use."""

    collection: str = "memories"
    dimension: int = 8
    metric: str = "l1"
    model: str = "local"
    temperature: float = 0.0
    max_top_k: int | None = 1000
    max_content_bytes: int | None = None
    max_metadata_bytes: int | None = None

    def validate(self) -> Settings:
        if not self.collection.strip() or not self.model.strip():
            raise Config("the collection and the model need names")
        if self.dimension < 1 or not 0 <= self.temperature <= 2:
            raise Config("the dimension is at least 1 and the temperature from 0 to 2")
        return self


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    tables: Tables | None = None
    embedding: Embedding = field(default_factory=Embedding)
    #: A provider's facts of a message, its summary of a conversation, its words for images; Columns of Columns.
    extract: Callable[[Column], Column] = sentence_facts
    summarise: Callable[[Column], Column] | None = None
    describe: Callable[[Column], Column] | None = None
    reranker: ranking.Reranker | None = ranking.overlap_reranker
    #: Where changes are kept; without it they are in ``tables`` alone.
    store: LogStore | None = None
    #: What answers searches instead of scans, made by ``index``.
    keywords: KeywordIndex | None = None
    vectors: VectorIndex | None = None

    def __post_init__(self):
        self.settings.validate()
        if self.settings.dimension != self.embedding.dimension:
            raise Config("the settings and the embedding differ in dimension")
        if self.store is not None:
            self.tables = self.store.load()
        if self.tables is None:
            empty = lambda schema: self.spark.createDataFrame([], schema)
            self.tables = Tables(empty(MEMORIES), empty(HISTORY), empty(ENTITY_LINKS))

    def search(self, query: str, top_k: int, scope: dict[str, str], today: str, threshold: float | None = None, show_expired: bool = False, spec: dict | None = None, rerank: bool = False, explain: bool = False, prefilter: bool = False, entity_slots: bool = False) -> DataFrame:
        """id, score, payload, score_details of the best ``top_k``, best first; where scores tie, the order before fusion, boost and rerank stands, and at last that of ids.

        The nearest max(20 * top_k, 500) of the scope come first and are filtered after, so a match beyond them
        isn't found; ``prefilter`` filters before instead, which finds it but is another result. With ``entity_slots`` the scope's entities
        take places of that window by their own embeddings, as in a store that keeps both in one table, and go before the rest is ranked.
        """
        if rerank and self.reranker is None:
            raise Validation("no reranker is set")
        if top_k < 1 or (self.settings.max_top_k is not None and top_k > self.settings.max_top_k):
            raise Validation("top_k is out of range")
        lifecycle.need_scope(scope)
        if threshold is not None and threshold < 0:
            raise Validation("a distance isn't negative")
        memories = self.tables.memories
        of = value_of(memories)
        scoped = filters.in_scope(scope, of)
        wanted = filters.compile_filter(filters.parse(spec), of) if spec is not None else F.lit(True)
        if not show_expired:
            wanted = wanted & filters.is_live(today, of("expiration_date"))
        window, vector = window_size(top_k), self.embedding.of_text(query)
        indexed = self.keywords is not None and self.vectors is not None and set(scope) <= set(SCOPE_KEYS)
        if indexed:
            self.refresh()
        if entity_slots:
            near = self._beside_entities(memories.where(scoped & wanted if prefilter else scoped), vector, window, scope, threshold)
        elif indexed and not prefilter:
            ids = self.vectors.search(vector, window, self.settings.metric, exact=True, scope=scope, threshold=threshold).select("id", "score")
            near = memories.drop("vector").join(F.broadcast(ids), "id")  # a window of ids
        else:
            near = nearest(memories, vector, window, self.settings.metric, threshold, scoped & wanted if prefilter else scoped)
        found = ranking.details(near if prefilter else near.where(wanted), explain).withColumn("_semantic", F.col("score"))
        if indexed:
            hits = self.keywords.top_k(query, window, scope)
        else:
            hits = keyword.search(memories.select("id", "content", *[c for c in memories.columns if c in scope and c != "content"], "payload"), query)
            hits = hits.where(filters.in_scope(scope, value_of(hits))).orderBy("keyword_score", "id").limit(window)
        hits = hits.select("id", "keyword_score")
        hits = self.spark.createDataFrame(hits.collect(), hits.schema)  # a window of ids and scores, which is read more than once
        found = ranking.fuse(found, hits).withColumn("_fused", F.col("score"))
        asked = self.spark.range(1).select(entities(F.lit(query)).alias("e")).first()["e"]
        if asked:
            scope_links = self.tables.links.where(filters.in_scope({k: v for k, v in scope.items() if k in self.tables.links.columns}, F.col))
            found = ranking.boost(found, boosted_ids(scope_links, [(e["type"], e["text"]) for e in asked]))
        ties = ("_fused", "_semantic", "id")
        best = found.orderBy("score", *ties).limit(top_k)
        if rerank:
            best = self.reranker(best.withColumn("_before", F.col("score")), query).orderBy("score", "_before", *ties)
        return best.select("id", "score", "payload", "score_details")

    def _beside_entities(self, memories: DataFrame, vector: list[float], window: int, scope: dict[str, str], threshold: float | None) -> DataFrame:
        """The memories among the ``window`` nearest of memories and entities of a scope."""
        named = self.tables.links.where(filters.in_scope({k: v for k, v in scope.items() if k in self.tables.links.columns}, F.col)).select(*SCOPE_KEYS, "entity_type", "entity_text").distinct()
        slots = named.select(entity_id().alias("id"), self.embedding.of_column(F.col("entity_text")).alias("vector"), F.lit(True).alias("_slot"))
        every = memories.withColumn("_slot", F.lit(False)).unionByName(slots, allowMissingColumns=True)
        return nearest(every, vector, window, self.settings.metric, threshold).where(~F.col("_slot")).drop("_slot")

    def search_each(self, queries: DataFrame, top_k: int, scope: dict[str, str], today: str, spec: dict | None = None, show_expired: bool = False, index: DataFrame | None = None) -> DataFrame:
        """query_id, rank, id, score, payload of a batch of ``queries`` (query_id, query)."""
        if top_k < 1 or (self.settings.max_top_k is not None and top_k > self.settings.max_top_k):
            raise Validation("top_k is out of range")
        return batch.search_each(self.tables, queries, top_k, scope, today, spec, show_expired, self.settings.metric, self.embedding, index)

    def add(self, conversations: DataFrame, scope: dict[str, str], infer: bool = True, metadata: dict[str, str] | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
        """The rows that a batch of messages (conv_id, turn, role, text) adds under a scope. With a store, a ``batch`` (stream, number) that is in already adds none."""
        if "images" in conversations.columns:
            if self.describe is None:
                raise Provider("no provider describes images")
            conversations = lifecycle.described(conversations, self.describe)
        plain = scope.get("memory_type") == "procedural_memory" and "agent_id" in scope
        seq = lambda pos: (F.col("conv_id") * 1_000_000 + pos).alias("seq")
        if plain:  # one summary a conversation, neither compared with what is known nor linked
            facts = lifecycle.procedures(conversations, self.summarise).select(seq(F.lit(0)), F.col("summary").alias("content"))
        else:
            found = lifecycle.facts_of(conversations, infer, self.extract)
            facts = found.select(seq(F.col("pos")), F.col("fact").alias("content"), *([] if infer else ["role"]))
        if self.store is not None:  # written once: a provider isn't asked again for each table that a change has
            facts.write.parquet(path := shared_path(self.spark, "facts"))
            facts = self.spark.read.schema(facts.schema).parquet(path)
        args = (self.tables, facts, scope, metadata, self.settings.max_content_bytes, self.settings.max_metadata_bytes, self.embedding, plain)
        if self.store is None:
            self.tables, new = lifecycle.added(*args)
            return new
        version = self._keep(lifecycle.addition(*args), batch)
        return self.tables.memories.limit(0) if version is None else self.store.own(version)

    def _keep(self, change: lifecycle.Change, batch: tuple[str, int] | None = None) -> int | None:
        version = self.store.append(change, self.tables.version, batch)
        self.tables = self.store.load()
        return version

    def update(self, id_: str, content: str | None = None, metadata: dict[str, str] | None = None) -> None:
        if self.store is None:
            self.tables = lifecycle.update(self.tables, id_, content, metadata, self.embedding)
        elif (change := lifecycle.updating(self.tables, id_, content, metadata, self.embedding)).put is not None:
            self._keep(change)

    def delete(self, id_: str) -> None:
        if self.store is None:
            self.tables = lifecycle.delete(self.tables, id_)
        else:
            self._keep(lifecycle.deletion(self.tables, id_))

    def reset(self, scope: dict[str, str] | None = None, spec: dict | None = None) -> int:
        """How many rows went."""
        if self.store is None:
            self.tables, n = lifecycle.reset(self.tables, scope, spec)
            return n
        n = lifecycle.reset(self.tables, scope, spec)[1]
        self._keep(lifecycle.resetting(self.tables, scope, spec))
        return n

    @classmethod
    def over_server(cls, spark: SparkSession, url: str | None, settings: Settings, folder: str | None = None) -> Engine:
        """An engine whose embeddings and facts come from the server at ``url``, by the settings' model, dimension and temperature; its memories are kept below ``folder`` in the settings' collection."""
        settings.validate()
        say = lambda instruction: providers.column_of(providers.chatter(url, settings.model, instruction, settings.temperature))
        facts, summary = say(providers.FACTS), say(providers.SUMMARY)
        return cls(
            spark,
            settings,
            embedding=providers.embedding_of(providers.embedder(url, settings.model), settings.dimension),
            extract=lambda text: facts_of_lines(facts(text)),
            summarise=summary,
            store=LogStore(spark, f"{folder.rstrip('/')}/{settings.collection}") if folder else None,
        )

    def index(self, path: str) -> None:
        """Makes both indexes of the store's memories in a folder; searches use them from now on, and bring them up to date first."""
        if self.store is None:
            raise Config("an index goes by a store's versions")
        now = self.tables = self.store.load()
        self.keywords = KeywordIndex.create(self.spark, f"{path.rstrip('/')}/keywords", now.memories.select("id", "content", *SCOPE_KEYS), SCOPE_KEYS, source=now.version)
        self.vectors = VectorIndex.create(self.spark, f"{path.rstrip('/')}/vectors", now.memories.select("id", "vector", *SCOPE_KEYS), SCOPE_KEYS, source=now.version)

    def refresh(self) -> None:
        """Brings the indexes up to the tables by what has changed since; the price is that of the changes."""
        for index in (self.keywords, self.vectors):
            since = index.source
            if since == self.tables.version:
                continue
            ids = self.store.touched(since, self.tables.version)
            if ids is None:
                raise Config("the store was replaced: make new indexes")
            then = self.store.load(since).memories.join(ids, "id", "left_semi")
            index.update(self.tables.memories.join(ids, "id", "left_semi"), then, self.tables.version)

    def health_check(self) -> bool:
        """The providers and the tables answer, in this order."""
        self.spark.range(1).select(self.extract(F.lit("A probe."))).collect()
        self.embedding.of_text("probe")
        self.tables.memories.limit(1).count()
        return True
