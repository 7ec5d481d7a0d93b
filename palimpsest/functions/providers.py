"""Models behind an HTTP address, asked from tasks: each different text once, in batches, with time-outs, retries and a cache of answers."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Conflict, DimensionMismatch, Provider
from ..sources.commits import Commits
from .embed import Embedding
from .text import score_in

#: Where a local server listens, and how long it may take for an embedding and for a text. Fixed values.
DEFAULT_URL, DEFAULT_PORT, EMBED_SECONDS, CHAT_SECONDS = "http://localhost:11434", 11434, 60, 120

Ask = Callable[[Sequence[str]], list]


def base_url(raw: str | None) -> str:
    """An address with its scheme, and with the usual port where neither is named."""
    bare = (raw or "").strip().rstrip("/")
    if not bare:
        return DEFAULT_URL
    if bare.startswith(("http://", "https://")):
        return bare
    return f"http://{bare}" if ":" in bare else f"http://{bare}:{DEFAULT_PORT}"


def post(url: str, body: dict, seconds: float) -> dict:
    """The JSON that a server answers with; anything else is a Provider error."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=seconds) as answer:
            return json.loads(answer.read())
    except urllib.error.HTTPError as e:
        raise Provider(f"HTTP {e.code} from {url}") from e
    except (OSError, ValueError) as e:
        raise Provider(f"{type(e).__name__} from {url}: {e}") from e


def embedder(url: str | None, model: str, seconds: float = EMBED_SECONDS) -> Ask:
    """Embeddings of a batch of texts by one call; by one for each text from a server that doesn't know batches."""
    at = base_url(url)

    def ask(texts: Sequence[str]) -> list[list[float]]:
        if not all(texts):
            raise Provider("an empty text has no embedding")
        try:
            found = post(f"{at}/api/embed", {"model": model, "input": list(texts)}, seconds).get("embeddings")
        except Provider as e:
            if "HTTP 404" not in str(e):
                raise
            found = [post(f"{at}/api/embeddings", {"model": model, "prompt": x}, seconds).get("embedding") for x in texts]
        if not isinstance(found, list) or not all(isinstance(x, list) for x in found):
            raise Provider("the answer has no embeddings")
        return [[float(v) for v in x] for x in found]

    return ask


def chatter(url: str | None, model: str, instruction: str = "", temperature: float | None = None, seconds: float = CHAT_SECONDS) -> Ask:
    """What a model says to each text, after an ``instruction`` to the system."""
    at = base_url(url)

    def ask(texts: Sequence[str]) -> list[str]:
        out = []
        for text in texts:
            messages = [{"role": "system", "content": instruction}] * bool(instruction) + [{"role": "user", "content": text}]
            body = {"model": model, "messages": messages, "stream": False} | ({} if temperature is None else {"options": {"temperature": temperature}})
            said = (post(f"{at}/api/chat", body, seconds).get("message") or {}).get("content")
            if not isinstance(said, str):
                raise Provider("the answer has no content")
            out.append(said)
        return out

    return ask


@dataclass(frozen=True)
class Policy:
    """Texts of one call, calls of one batch before its texts are asked one by one, the first pause between them in seconds, tasks that ask at a time."""

    batch: int = 32
    attempts: int = 3
    pause: float = 0.5
    tasks: int = 8


def _patiently(ask: Ask, texts: Sequence[str], policy: Policy) -> tuple[list | None, str | None]:
    said = None
    for n in range(policy.attempts):
        if n:
            time.sleep(policy.pause * 2 ** (n - 1))
        try:
            answers = ask(texts)
            if len(answers) == len(texts):
                return answers, None
            said = f"{len(texts)} texts, {len(answers)} answers"
        except Exception as e:  # whatever a provider raises fails this call only
            said = f"{type(e).__name__}: {e}"
    return None, said


def ask_each(texts: DataFrame, ask: Ask, kind: str, policy: Policy = Policy()) -> DataFrame:
    """hash, answer (of the SQL type ``kind``), error of each different text of ``texts`` (hash, text).

    A batch that keeps failing is asked text by text, and a text that does has a null answer and its error; the others keep theirs. Spark asks again
    for what is lost with an executor, so write the result once and read it, as ``Cache`` does.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), policy.batch):
                some = rows.iloc[at : at + policy.batch]
                answers, error = _patiently(ask, some["text"].tolist(), policy)
                if answers is not None:
                    found = [(a, None) for a in answers]
                elif len(some) == 1:
                    found = [(None, error)]
                else:
                    found = []
                    for text in some["text"]:
                        one, error = _patiently(ask, [text], policy)
                        found.append((one[0] if one else None, error))
                yield pd.DataFrame({"hash": some["hash"].tolist(), "answer": pd.Series([a for a, _ in found], dtype="object"), "error": pd.Series([e for _, e in found], dtype="object")})

    return texts.repartition(policy.tasks, "hash").mapInPandas(run, f"hash string, answer {kind}, error string")


#: What a model is asked to make of a conversation.
FACTS = "List the facts that the text states about people and their world, one on each line, and nothing else."
SUMMARY = "Summarise what was done in this conversation, step by step."


def column_of(ask: Ask, kind: str = "string", policy: Policy = Policy()) -> Callable[[Column], Column]:
    """A provider as a Column of a Column: each different text of a batch of rows is asked once; null stays null, and a call that keeps failing fails the job."""

    @F.pandas_udf(kind)
    def answers(texts: pd.Series) -> pd.Series:
        different, known = [t for t in dict.fromkeys(texts) if t is not None], {}
        for at in range(0, len(different), policy.batch):
            some = different[at : at + policy.batch]
            found, error = _patiently(ask, some, policy)
            if found is None:
                raise Provider(error)
            known |= zip(some, found, strict=True)
        return pd.Series([known.get(t) for t in texts], dtype="object")

    return answers


def embedding_of(ask: Ask, dimension: int, policy: Policy = Policy()) -> Embedding:
    """A provider as the embedding of an engine, for records and queries alike."""

    def of_text(text: str) -> list[float]:
        found = ask([text])[0]
        if len(found) != dimension:
            raise DimensionMismatch(dimension, len(found))
        return found

    return Embedding(of_text, column_of(ask, "array<float>", policy), dimension)


class Cache:
    """Answers of one provider and model, kept by the hash of the text in a folder that executors share."""

    def __init__(self, spark: SparkSession, path: str, ask: Ask, kind: str, policy: Policy = Policy()):
        self.spark, self.commits, self.ask, self.kind, self.policy = spark, Commits(spark, path), ask, kind, policy

    def known(self) -> DataFrame:
        """hash and answer."""
        parts = self.commits.read(self.commits.latest()).get("parts", {})
        return self.commits.get("answers", parts, f"hash string, answer {self.kind}, error string").where("answer IS NOT NULL").groupBy("hash").agg(F.first("answer").alias("answer"))

    def fill(self, texts: DataFrame) -> DataFrame:
        """Asks for each different text of ``texts`` (text) that has no answer yet, once, and keeps what comes; hash, answer, error of these."""
        hashed = texts.where("text IS NOT NULL").select(F.sha2("text", 256).alias("hash"), "text")
        missing = hashed.groupBy("hash").agg(F.first("text").alias("text")).join(self.known().select("hash"), "hash", "left_anti")
        name = self.commits.put(ask_each(missing, self.ask, self.kind, self.policy), "answers")
        while True:
            latest = self.commits.latest()
            try:
                self.commits.write(latest + 1, {"parts": self.commits.read(latest).get("parts", {}) | {name: latest + 1}})
                break
            except Conflict:  # answers of others don't disagree with these
                continue
        return self.commits.get("answers", {name: 0}, f"hash string, answer {self.kind}, error string").drop("_v")

    def answered(self, rows: DataFrame, column: str, answer: str = "answer") -> DataFrame:
        """``rows`` with the answer to a text column, null where its text is null or its provider failed; repeated texts are asked about once."""
        self.fill(rows.select(F.col(column).alias("text")))
        found = self.known().select(F.col("hash").alias("_hash"), F.col("answer").alias("_answer"))
        joined = rows.withColumn("_key", F.sha2(F.col(column), 256)).join(found, F.col("_key") == F.col("_hash"), "left")
        return joined.select(*rows.columns, F.col("_answer").alias(answer))


def facts_by(cache: Cache, facts_of: Callable[[Column], Column]) -> Callable[[DataFrame], DataFrame]:
    """conv_id, pos, fact of messages (conv_id, text) by a language model: what ``facts_of`` reads from its answer; a failed one has none."""
    return lambda messages: cache.answered(messages.select("conv_id", "text"), "text").select("conv_id", F.posexplode(facts_of(F.coalesce("answer", F.lit("")))).alias("pos", "fact"))


def relevance_reranker(cache: Cache, prompt: str = "Query: {query}\nDocument: {content}\nRelevance from 0 to 1:") -> Callable[[DataFrame, str], DataFrame]:
    """A reranker by the number in a language model's answer about query and content; without an answer the relevance is 0.5."""
    before, after = prompt.split("{content}")

    def rerank(results: DataFrame, query: str) -> DataFrame:
        asked = results.withColumn("_asked", F.concat(F.lit(before.replace("{query}", query)), F.coalesce("content", F.lit("")), F.lit(after.replace("{query}", query))))
        said = cache.answered(asked, "_asked", "_said")
        return said.withColumn("score", (1 - score_in(F.coalesce("_said", F.lit("")))).cast("float")).drop("_asked", "_said")

    return rerank
