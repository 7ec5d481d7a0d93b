"""Quality classifier: random-indexing word vectors, pooled for each document, under a two-layer network in numpy.

A word has three codes: its hash, its ending and its shape. Every code has a sparse ternary index vector,
fixed by a seed; a word's context vector is the sum of the index vectors around it in the training
texts. A document is pooled to the mean, the spread and the mean step from word to word of its vectors.
The network's logits are divided by a temperature fitted on training documents that it hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

DIM, NONZERO, WORD_CODES, END_CODES, SHAPE_CODES = 32, 4, 1 << 15, 1 << 11, 256
#: Bound of the labelled sample that is fitted on, of each class: those of smallest hash of the id.
SAMPLE_PER_CLASS = 6000
HIDDEN, EPOCHS, SEED = 24, 400, 7
#: Bytes of text pooled at a time; its word vectors take about 25 times as much.
POOL_BYTES = 1 << 19


def _codes(texts: list[bytes]):
    """Words and, for each, its three codes."""
    import numpy as np

    from ._tokens import U, Words, mix, span_hash

    words = Words(texts, lower=False)
    raw, start, end = words.raw, words.start, words.end
    kinds = np.zeros(256, np.int64)
    for code, chars in enumerate((range(48, 58), range(65, 91), range(97, 123), range(128, 256)), 1):
        kinds[list(chars)] = code
    counts = []
    for code in (0, 1, 2):  # marks, digits, capitals
        total = np.concatenate(([0], np.cumsum(kinds[raw] == code)))
        counts.append(total[end] - total[start])
    size = end - start
    part = lambda n: np.where(n == 0, 0, np.where(2 * n <= size, 1, np.where(n < size, 2, 3)))
    shape = ((part(counts[0]) * 4 + part(counts[1])) * 4 + part(counts[2])) * 4 + np.minimum(size // 4, 3)
    ending = span_hash(raw, np.maximum(start, end - 2), end)
    word = (mix(words.hash) % U(WORD_CODES)).astype(np.int64)
    return words, word, WORD_CODES + (ending % U(END_CODES)).astype(np.int64), WORD_CODES + END_CODES + shape


def index_vectors():
    """The fixed sparse ternary vectors of all codes."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    n = WORD_CODES + END_CODES + SHAPE_CODES
    out = np.zeros((n, DIM), np.float32)
    for _ in range(NONZERO):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice(np.array([-1, 1], np.float32), n)
    return out


def context_sums(texts: list[bytes], index, window: int = 2):
    """For each word code the sum of the index vectors around it: whole numbers, so that their sum has no order."""
    import numpy as np

    sums = np.zeros((WORD_CODES, DIM), np.int64)
    for block in _blocks(texts):
        words, word, ending, shape = _codes(block)
        around = index[word] + index[ending] + index[shape]
        near = np.zeros_like(around)
        for k in range(1, window + 1):
            same = words.doc[k:] == words.doc[:-k]
            near[k:] += around[:-k] * same[:, None]
            near[:-k] += around[k:] * same[:, None]
        order = np.argsort(word, kind="stable")
        if len(order):
            new = np.flatnonzero(np.concatenate(([True], np.diff(word[order]) > 0)))
            sums[word[order][new]] += np.add.reduceat(near[order], new, axis=0, dtype=np.int64)
    return sums


def context_vectors(sums, index):
    """``index`` with each word's own vector replaced by its normalised sum of neighbours plus half of its own."""
    import numpy as np

    out = index.copy()
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    out[:WORD_CODES] = 0.5 * index[:WORD_CODES] + sums / np.maximum(norm, 1e-9)
    return out


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > POOL_BYTES:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def pooled(texts: list[bytes], vectors):
    """Features of each text: mean, spread, mean step, and the logarithm of its number of words; zeros for none."""
    import numpy as np

    words, word, ending, shape = _codes(texts)
    out = np.zeros((len(texts), 3 * DIM + 1), np.float32)
    n = np.diff(words.first)
    some = np.flatnonzero(n)
    if len(some):
        v = vectors[word] + vectors[ending] + vectors[shape]
        step = np.zeros_like(v)
        step[1:] = np.abs(v[1:] - v[:-1])
        step[words.first[:-1][some]] = 0
        total = lambda x: np.add.reduceat(x, words.first[:-1][some], axis=0) / n[some, None]
        mean = total(v)
        out[some, :DIM] = mean
        out[some, DIM : 2 * DIM] = np.sqrt(np.maximum(total(v * v) - mean * mean, 0))
        out[some, 2 * DIM : 3 * DIM] = total(step)
        out[some, -1] = np.log1p(n[some])
    return out


@dataclass
class Model:
    vectors: object
    center: object
    scale: object
    layers: list
    temperature: float

    def score(self, texts: list[bytes]):
        import numpy as np

        out = np.concatenate([self.logits(pooled(b, self.vectors)) for b in _blocks(texts)]) if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(out / self.temperature, -30, 30)))

    def logits(self, features):
        import numpy as np

        (w1, b1), (w2, b2) = self.layers
        return (np.tanh((features - self.center) / self.scale @ w1 + b1) @ w2 + b2)[:, 0].astype(np.float64)


def fit(vectors, x, labels, calibrate) -> Model:
    """A model on the pooled features ``x``; texts that ``calibrate`` marks only set the temperature. With one class only, scores lean to it."""
    import numpy as np

    y, held = np.asarray(labels, np.float64), np.asarray(calibrate, bool)
    train = ~held
    rng = np.random.default_rng(SEED)
    layers = [[rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN)], [rng.normal(0, HIDDEN**-0.5, (HIDDEN, 1)), np.zeros(1)]]
    if not train.any():
        return Model(vectors, np.zeros(x.shape[1], np.float32), np.ones(x.shape[1], np.float32), layers, 1.0)
    model = Model(vectors, x[train].mean(0), x[train].std(0) + 1e-3, layers, 1.0)
    z, t = ((x[train] - model.center) / model.scale).astype(np.float64), y[train][:, None]
    weight = np.where(t == 1, 0.5 / max(t.mean(), 1e-9), 0.5 / max(1 - t.mean(), 1e-9)) if 0 < t.mean() < 1 else np.ones_like(t)
    moments = [[[np.zeros_like(p), np.zeros_like(p)] for p in layer] for layer in layers]
    for step in range(1, EPOCHS + 1):
        (w1, b1), (w2, b2) = layers
        h = np.tanh(z @ w1 + b1)
        d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - t) * weight / len(z)
        dh = d @ w2.T * (1 - h * h)
        for layer, m, grads in zip(layers, moments, ((z.T @ dh + 1e-4 * w1, dh.sum(0)), (h.T @ d + 1e-4 * w2, d.sum(0))), strict=True):
            for i, g in enumerate(grads):
                m[i][0] = 0.9 * m[i][0] + 0.1 * g
                m[i][1] = 0.999 * m[i][1] + 0.001 * g * g
                layer[i] = layer[i] - 0.02 * (m[i][0] / (1 - 0.9**step)) / (np.sqrt(m[i][1] / (1 - 0.999**step)) + 1e-8)
    model.layers = layers
    if held.any():
        logits, target = model.logits(x[held]), y[held]
        loss = lambda s: np.mean(np.logaddexp(0, logits / s) - target * logits / s)
        model.temperature = float(min(np.geomspace(0.5, 20, 60), key=loss))
    return model


def train(docs: DataFrame, labels: DataFrame, test: tuple[int, int] = (5, 0)) -> Model:
    """A model fitted on at most SAMPLE_PER_CLASS labelled documents of each class; ids with crc32 of ``test`` are left out, the next remainder calibrates.

    An id that is labelled both ways isn't used; of rows that repeat an id, the text of smallest hash is. Null ids, null
    labels and ids without a document are left out; null texts count as empty; without any labels every score is
    about one half. Other columns of both tables, whatever their names, are ignored. Texts are read whole and stay on the executors: the driver gets the sums of the context vectors (8 MB) and 97 numbers for each text.
    """
    import numpy as np

    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    fold = C.crc32_text(F.col("doc_id")) % test[0]
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where((F.col("quality") == F.col("most")) & (fold != test[1])).drop("most")
    sample = [usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for q in (0, 1)]
    chosen = sample[0].unionByName(sample[1])
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    first = texts.groupBy("doc_id", "quality").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = scratch.keep(first.withColumn("held", fold == (test[1] + 1) % test[0]), "labelled")

    def summed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ._tokens import as_bytes

        index, total = index_vectors(), np.zeros((WORD_CODES, DIM), np.int64)
        for b in C.text_blocks(batches):
            total += context_sums(as_bytes(b["text"]), index)
        used = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(total[used, i]) for i in range(DIM))], ["code", *(f"s{i}" for i in range(DIM))])

    parts = rows.where("NOT held").select("text").mapInArrow(summed, "code long, " + ", ".join(f"s{i} long" for i in range(DIM)))
    found = parts.groupBy("code").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(DIM))).toArrow()
    sums = np.zeros((WORD_CODES, DIM), np.int64)
    sums[found["code"].to_numpy()] = np.stack([found[f"s{i}"].to_numpy() for i in range(DIM)], axis=1)
    vectors = context_vectors(sums, index_vectors())
    shared = spark.sparkContext.broadcast(vectors)

    def features(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ._tokens import as_bytes

        for b in C.text_blocks(batches, POOL_BYTES):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["quality"].cast(pa.int64()), b["held"], pa.array(list(pooled(as_bytes(b["text"]), shared.value)), pa.list_(pa.float32()))], ["doc_id", "quality", "held", "x"])

    kind = dict(rows.dtypes)["doc_id"]
    table = rows.mapInArrow(features, f"doc_id {kind}, quality long, held boolean, x array<float>").toArrow().sort_by("doc_id")
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, 3 * DIM + 1)  # as lists of Python's numbers they take ten times as much
    scratch.drop()
    return fit(vectors, x, table["quality"].to_numpy(), table["held"].to_numpy(zero_copy_only=False))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` with ``score``, 0 to 1; a null text counts as empty and gets the score of a text without words. A column ``score`` of ``docs`` is replaced.

    Rows are independent: those that repeat each other score alike, an empty table gives an empty one, and a long text is read whole, one
    block of memory at a time or by itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from ._tokens import as_bytes

        for b in C.text_blocks(batches):
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(shared.value.score(as_bytes(b["text"])))], [*kept, "score"])

    types = dict(docs.dtypes)
    return docs.select(*kept).mapInArrow(scored, ", ".join([f"`{c}` {types[c]}" for c in kept] + ["score double"]))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a model that never sees the fold whose crc32 of the id is divisible by 5."""
    C.shared_dir(spark)
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (C.crc32_text(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
