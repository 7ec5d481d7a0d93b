"""Sampled segmentations of a SentencePiece vocabulary, and their lossless decoding.

Where two neighbouring characters are together in no piece, none reaches over the place between them; so
the lattice of a text falls into those of the units between such places. The lattices of a block's
different units are filtered forward together, giving each place the probabilities of the pieces that can
end there; each occurrence of a unit is then sampled backward from its end, all of a block at once. The
random numbers come from a hash of the row's key, the unit's number and the step, so a row gets the
same pieces in any partition and any run. A character that no piece holds alone can go by its UTF-8
bytes, which have pieces of their own; so every text decodes to itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Text of a block, and characters of the units whose lattices are filtered together.
ENCODE_BYTES, LATTICE_CHARS = 2 << 20, 1 << 18
_FILTER_BITS, _PAIR_BITS = 20, 22


def _codes(text: str):
    """Code points."""
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _prefix(codes):
    import numpy as np

    from ._tokens import U, _power_tables

    up, _ = _power_tables(len(codes) + 1)
    return np.concatenate((np.zeros(1, U), np.cumsum((codes.astype(U) + U(1)) * up[: len(codes)], dtype=U)))


def _window_hashes(codes, size: int, prefix):
    """64 bits of every run of ``size`` characters, wherever it stands."""
    from ._tokens import U, _power_tables, mix

    n = len(codes) - size + 1
    _, down = _power_tables(len(codes) + 1)
    return mix((prefix[size:] - prefix[:n]) * down[:n] + U(size))


def _slot(hashes, bits: int):
    from ._tokens import U

    return (hashes >> U(64 - bits)).astype("int64")


def _pair_slots(codes):
    from ._tokens import U, mix

    return _slot(mix((codes[:-1].astype(U) << U(32)) | codes[1:].astype(U)), _PAIR_BITS)


class Pieces:
    """The vocabulary of a model: a piece's probability falls with its rank as 1 / (rank + 10) to the power ``sharpness``.

    Merge ranks stand in for the scores of a unigram model, which the published vocabularies of this kind don't have.
    """

    def __init__(self, path: str = MODEL, sharpness: float = 0.5, data: bytes | None = None):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(**({"model_file": path} if data is None else {"model_proto": data}))
        self.raw: list[bytes] = []
        self.byte: dict[int, int] = {}
        texts, ids = [], []
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            elif model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            else:
                texts.append(piece.replace("▁", " "))
                ids.append(i)
                self.raw.append(texts[-1].encode())
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no piece for each byte")
        #: How an id is packed: in two bytes, or in four where the vocabulary needs them; low byte first.
        self.packing = "<u2" if len(self.raw) <= 1 << 16 else "<u4"
        self.longest = max(map(len, texts))
        self.fallback = -2 * sharpness * np.log(len(self.raw) + 10.0)
        codes = [_codes(t) for t in texts]
        keys = np.array([_window_hashes(c, len(c), _prefix(c))[0] for c in codes], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(ids)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.logp = -sharpness * np.log(self.ids + 10.0)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[_slot(self.keys, _FILTER_BITS)] = True
        self.pairs = np.zeros(1 << _PAIR_BITS, bool)
        for c in codes:
            self.pairs[_pair_slots(c)] = True

    def _lattices(self, codes, lengths):
        """Of units one after the other: (rank of each character's node, first edge of each rank, edges' rank plus cumulative probability, characters, pieces)."""
        import numpy as np

        n = len(codes)
        place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        prefix, found = _prefix(codes), []
        single = np.zeros(n, bool)
        for size in range(1, min(self.longest, int(lengths.max())) + 1):
            h = _window_hashes(codes, size, prefix)
            first = np.flatnonzero((place[size - 1 :] >= size - 1) & self.seen[_slot(h, _FILTER_BITS)])
            at = np.minimum(np.searchsorted(self.keys, h[first]), len(self.keys) - 1)
            hit = self.keys[at] == h[first]
            end, at = first[hit] + size - 1, at[hit]
            if size == 1:
                single[end] = True
            found.append((end, np.full(len(end), size), self.ids[at], self.logp[at]))
        alone = np.flatnonzero(~single)
        found.append((alone, np.ones(len(alone), np.int64), len(self.raw) + codes[alone].astype(np.int64), np.full(len(alone), self.fallback)))
        end, size, piece, logp = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((end, place[end]))
        end, size, piece, logp = end[order], size[order], piece[order], logp[order]
        new = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        rank = np.empty(n, np.int64)
        rank[end[new]] = np.arange(n)
        starts = np.append(new, len(end))
        level = np.concatenate(([0], np.cumsum(np.bincount(place))))  # ranks by place
        alpha, upto = np.zeros(n), np.empty(len(end))
        for p in range(len(level) - 1):
            nodes = slice(level[p], level[p + 1])
            lo, hi = starts[level[p]], starts[level[p + 1]]
            groups, counts = starts[nodes] - lo, np.diff(starts[level[p] : level[p + 1] + 1])
            before = np.where(size[lo:hi] == p + 1, 0.0, alpha[end[lo:hi] - size[lo:hi]])
            w = logp[lo:hi] + before
            top = np.maximum.reduceat(w, groups)
            w = np.exp(w - np.repeat(top, counts))
            total = np.add.reduceat(w, groups)
            alpha[end[lo + groups]] = top + np.log(total)
            run = np.cumsum(w)
            run -= np.repeat(run[groups] - w[groups], counts)
            upto[lo:hi] = np.repeat(np.arange(level[p], level[p + 1]), counts) + np.minimum(run / np.repeat(total, counts), 1.0)
        return rank, starts, upto, size, piece

    def sample(self, texts: list[str], keys):
        """(pieces of all texts one after the other, where each text's begin and the last's end)."""
        import numpy as np

        from ._tokens import U, mix, span_hash

        codes = _codes("".join(texts))
        text_at = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        cut = np.ones(len(codes) + 1, bool)
        if len(codes) > 1:
            cut[1:-1] = ~self.pairs[_pair_slots(codes)]
        cut[text_at] = True
        bound = np.flatnonzero(cut)
        begin, length = bound[:-1], np.diff(bound)
        if not len(codes):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        text_units = np.searchsorted(begin, text_at)
        text_units[-1] = len(begin)
        sizes = np.diff(text_units)
        _, example, unit = np.unique(span_hash(codes, begin, begin + length), return_index=True, return_inverse=True)

        # Lattices of the different units, some at a time; ranks and edges of one chunk follow those of the last.
        own, parts = length[example], []
        chunk = np.cumsum(own) // LATTICE_CHARS
        last, rank0, edge0, char0 = np.empty(len(own), np.int64), 0, 0, 0
        for c in np.unique(chunk):
            us = np.flatnonzero(chunk == c)
            n = own[us]
            chars = np.repeat(begin[example[us]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rank, starts, upto, back, piece = self._lattices(codes[chars], n)
            last[us] = char0 + np.cumsum(n) - 1
            parts.append((rank + rank0, starts[:-1] + edge0, upto + rank0, back, piece))
            rank0, edge0, char0 = rank0 + len(rank), edge0 + len(upto), char0 + len(rank)
        rank, starts, upto, back, piece = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends_of = np.append(starts[1:], edge0)

        ordinal = np.arange(len(unit)) - np.repeat(text_units[:-1], sizes)
        seed = mix(np.repeat(mix(keys), sizes) + ordinal.astype(U) * U(0xD1B54A32D192ED03))
        at, left, row = last[unit], length.copy(), np.arange(len(unit))
        steps, taken, step = np.zeros(len(unit), np.int64), [], 0
        while len(row):
            u = (mix(seed[row] + U(step)) >> U(11)).astype(np.float64) * 2.0**-53
            node = rank[at[row]]
            edge = ends_of[node] - 1  # the longest piece, as a rule the likeliest
            other = np.flatnonzero((edge > starts[node]) & (node + u < upto[edge - 1]))
            edge[other] = np.searchsorted(upto, node[other] + u[other], "right")
            taken.append((row, piece[edge]))
            at[row] -= back[edge]
            left[row] -= back[edge]
            steps[row] += 1
            row = row[left[row] > 0]
            step += 1
        ends = np.cumsum(steps)
        out = np.empty(int(ends[-1]), np.int64)
        for k, (rows, ids) in enumerate(taken):
            out[ends[rows] - 1 - k] = ids
        places = np.concatenate(([0], ends))[text_units]
        extra = np.flatnonzero(out >= len(self.raw))
        if len(extra):  # characters by their bytes
            spelled = [[self.byte[b] for b in chr(c - len(self.raw)).encode()] for c in out[extra].tolist()]
            width = np.ones(len(out), np.int64)
            width[extra] = list(map(len, spelled))
            place = np.concatenate(([0], np.cumsum(width)))
            whole = np.repeat(out, width)
            for i, ids in zip(place[extra].tolist(), spelled, strict=True):
                whole[i : i + len(ids)] = ids
            out, places = whole, place[places]
        return out, places

    def decode(self, ids) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


_loaded: dict[tuple, Pieces] = {}


def pieces_of(data: bytes, sharpness: float) -> Pieces:
    """The worker's copy of a vocabulary, given as the bytes of its model file."""
    import hashlib

    key = hashlib.sha256(data).digest(), sharpness
    if key not in _loaded:
        _loaded[key] = Pieces("", sharpness, data)
    return _loaded[key]


def _sent(spark: SparkSession, path: str):
    """The model file, read on the driver, for the workers: a vocabulary of some hundred KB."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, seed: int = 0, path: str = MODEL, sharpness: float = 0.5, keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """``keep`` and the sampled pieces of each row of ``docs`` (doc_id, text): n_pieces, pieces (ids, two bytes each, low first, or four if the vocabulary has more than 65,536), lossless (the packed ids decode to the text).

    The row's key is its doc_id, a null one counting as -1, and ``seed``: rows that repeat id and text get
    the same pieces. A null or empty text has none, an empty table gives no rows, a text of any length is one row, and a
    column of ``keep`` that is named as a result is left out. With ``digest``, pieces are given by pieces_crc32 and the
    SHA-256 of the decoded text instead. Nothing is shuffled.
    """
    types, model = dict(docs.dtypes), _sent(docs.sparkSession, path)
    keep = tuple(c for c in keep if c not in ("n_pieces", "lossless", "pieces", "pieces_crc32", "decoded_sha256"))
    tail = "pieces_crc32 long, decoded_sha256 string" if digest else "pieces binary"

    def encoded(batches: Iterator) -> Iterator:
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        from ._tokens import U

        table = pieces_of(model.value, sharpness)
        for b in C.text_blocks(batches, ENCODE_BYTES):
            texts = [t or "" for t in b["text"].to_pylist()]
            keys = np.array([-1 if i is None else i for i in b["_key"].to_pylist()], np.int64).view(U) * U(0x9E3779B97F4A7C15) + U(seed)
            ids, starts = table.sample(texts, keys)
            packed, w = ids.astype(table.packing).tobytes(), int(table.packing[-1])
            own = [packed[w * i : w * j] for i, j in zip(starts[:-1], starts[1:], strict=True)]
            decoded = [table.decode(np.frombuffer(x, table.packing).tolist()) for x in own]
            same = [d == t.encode() for d, t in zip(decoded, texts, strict=True)]
            out = [pa.array(np.diff(starts)), pa.array(same)]
            out += [pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())] if digest else [pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), *out], [*keep, "n_pieces", "lossless", *(x.split()[0] for x in tail.split(", "))])

    source = docs.select(*keep, F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("_key")) if "text" not in keep else docs.withColumn("_key", F.col("doc_id").cast("long"))
    return source.mapInArrow(encoded, ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_pieces long, lossless boolean", tail]))


def decode(pieces: DataFrame, path: str = MODEL, sharpness: float = 0.5) -> DataFrame:
    """doc_id, text of rows (doc_id, pieces) as ``encode`` gives them; null pieces give a null text."""

    model = _sent(pieces.sparkSession, path)

    def decoded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        table = pieces_of(model.value, sharpness)
        for b in batches:
            texts = [None if x is None else table.decode(np.frombuffer(x, table.packing).tolist()).decode() for x in b["pieces"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return pieces.select("doc_id", "pieces").mapInArrow(decoded, f"doc_id {dict(pieces.dtypes)['doc_id']}, text string")


def op9_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every whole document, as digests, and whether they decode to its text."""
    C.shared_dir(spark)
    return encode(C.table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
