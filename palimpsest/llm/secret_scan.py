"""Secret scans: candidates by shape, then a random forest that removes false positives.

A candidate is a run of key characters with a digit, or with a known key prefix; or any value that a key word
and = or : stand before, to its closing quote or else the next space. The forest sees its
length, its character transitions, how much of it dictionary words cover, the path it stands in and the words
beside it. It is trained on labelled findings; ``findings`` writes a set by rule, and a table of real ones
can take its place.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

MARK = "[SECRET]"
#: Code points of a candidate by its shape, and of a value after a key word.
SHORTEST, SHORTEST_VALUE = 10, 4
#: Code points right beside a candidate that are kept for what stands against it; the neighbouring words are looked at whole.
CONTEXT = 200
#: Words that stand before keys, words that stand before other long codes, words of samples. Fixed values.
KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "auth", "bearer", "credential", "credentials", "private")
CODE_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "digest", "uuid", "id", "isbn", "order", "ticket", "build", "version", "phone", "card", "revision", "etag")
SAMPLE_WORDS = ("example", "sample", "dummy", "placeholder", "changeme", "test", "fake", "your", "xxxx", "demo")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-")
DICTIONARY = (
    "about after again all also and any are ask back be because before between but by call can case change code come company could country data day did do down each end even every example file find first for form from "
    "get give good great group had hand has have head help here high home house how if image in index into it item just keep know large last learn left letter level life light line list long look made make man many may "
    "mean might more most mother move much must my name need never new next night no not note now number of off old on one only open or order other our out over own page part people place plan plant play point port post "
    "press report run said same sample say see sentence set she should show side small so some sound state still stop story study such table take tell test than that the them then there these they thing think this "
    "time title to too tree try turn two under up us use user value very view want was water way we well were what when where which while who why will with word work world would write year you your"
).split()
#: Words of passphrases, and plain words and names of types that stand after key words. Fixed values.
PASS_WORDS = "apple arrow banjo barrel bishop bottle candle canyon copper cobalt dragon eagle falcon feather garden ginger hammer harbor island ivory jacket jungle kitten lantern lemon magnet marble meadow nickel ocean orange parrot pepper pirate pocket purple quartz rabbit ribbon river rocket saddle salmon silver spider sunset thunder tiger timber turtle velvet violet walnut whisper winter yellow zebra".split()
PLAIN_WORDS = "required optional authentication authorization identifier unavailable undefined description information application international confidential importantly everything understanding string|null unspecified deprecated configuration expiration_date case-sensitive Optional[str] process.env credentials_provider username/password encryption documentation permissions environment".split()
SHORT_WORDS = "true false null none string user users name type value values basic bearer digest public private primary foreign index hash enabled disabled required optional default text bytes object array number int64 utf8 login admin guest client server session cookie header".split()
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % SHORTEST)
_PREFIX = re.compile("|".join(map(re.escape, PREFIXES)))
_WORD = re.compile(r"[A-Za-z_]+[0-9]*")
_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: A key word, = or :, and a value: in quotes, or up to a space or quote.
_ASSIGNED = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z0-9])(?=[A-Z]))(?i:%s)[\"'`\]]{0,2}[ \t]*[=:]+[ \t]*" % "|".join(sorted(KEY_WORDS, key=len, reverse=True))
    + r"""(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|["'`]?([^\s"'`]+))"""
)
_PATHS = re.compile(r"(?i)(^|[/_.\-])(tests?|examples?|samples?|docs?|fixtures?)([/_.\-]|$)|\.(md|rst|html?|lock|svg)\b")
_LONG_WORDS = frozenset(w for w in DICTIONARY if len(w) > 2)
_PAIRS = frozenset(w[i : i + 2] for w in DICTIONARY for i in range(len(w) - 1))
FEATURES = ("length", "transitions", "word_pairs", "digits", "capitals", "distinct", "hex", "coverage", "path", "key_word", "code_word", "sample_word", "assigned", "prefix", "symbols", "spaces", "quoted", "slashes")


class _Around:
    """The words of a text as neighbours: each is looked at once, however many candidates stand beside or in it."""

    def __init__(self, text: str):
        self.text, self.spans, self.known = text, [m.span() for m in _SPLIT.finditer(text)], {}
        self.starts = [a for a, _ in self.spans]

    def _word(self, i: int) -> tuple[list[int], list[set[str]], float]:
        """Ends and parts of a word's terms, and where its first sample word ends."""
        if i not in self.known:
            word = self.text[slice(*self.spans[i])]
            found = list(_WORD.finditer(word))
            parts = [{p for w in [_CAMEL.sub("_", m[0]).lower()] for p in (w, *w.split("_"))} for m in found]
            low = word.lower()
            self.known[i] = [m.end() for m in found], parts, min((at + len(w) for w in SAMPLE_WORDS if (at := low.find(w)) >= 0), default=math.inf)
        return self.known[i]

    def flags(self, start: int, end: int) -> tuple[float, float, float]:
        """Whether key, code and sample words stand before: in the last three terms of its word before it and of each of three words before that. A sample word may follow, too."""
        i = bisect_right(self.starts, start) - 1
        inside = i >= 0 and self.spans[i][1] > start
        terms, sample = [], False
        if inside:
            ends, parts, first = self._word(i)
            k = bisect_right(ends, start - self.starts[i])
            terms += parts[max(0, k - 3) : k]
            sample = first <= start - self.starts[i]
        here = i if inside else i + 1
        for j in range(max(0, here - 3), here):
            _, parts, first = self._word(j)
            terms += parts[-3:]
            sample = sample or first < math.inf
        after = bisect_left(self.starts, end)
        sample = sample or (after < len(self.starts) and self._word(after)[2] < math.inf)
        near = set().union(*terms)
        return float(not near.isdisjoint(KEY_WORDS)), float(not near.isdisjoint(CODE_WORDS)), float(sample)


def features(value: str, before: str, after: str, path: str, flags: tuple[float, float, float] | None = None) -> list[float]:
    """Of a candidate, the words before it with what stands right before, the word after, its path, and what ``_Around`` says of it, if that saw more words than these."""
    n = len(value)
    kind = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    low = value.lower()
    letters = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    covered, i = 0, 0
    while i < n:
        size = next((k for k in range(min(10, n - i), 2, -1) if low[i : i + k] in _LONG_WORDS), 0)
        covered += size
        i += size or 1
    if flags is None:
        flags = _Around(f"{before}{value} {after}").flags(len(before), len(before) + n)
    key_word, code_word, sample_word = flags
    return [
        float(n),
        sum(a != b for a, b in zip(kind, kind[1:], strict=False)) / max(n - 1, 1),
        sum(p in _PAIRS for p in letters) / max(len(letters), 1) if letters else 0.0,
        kind.count("d") / n,
        kind.count("u") / n,
        len(set(value)) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        covered / n,
        float(bool(_PATHS.search(path))),
        key_word,
        code_word,
        float(sample_word or any(w in low for w in SAMPLE_WORDS)),
        float(before.rstrip(" \t\"'`").endswith(("=", ":"))),
        float(bool(_PREFIX.match(value))),
        sum(not c.isalnum() and not c.isspace() for c in value) / n,
        sum(c.isspace() for c in value) / n,
        float(before.endswith(('"', "'", "`"))),
        value.count("/") / n,
    ]


def findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings by rule: (candidate, words before, word after, path, 1 for a secret)."""
    import random

    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    text = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ung", "tion", "ment", "que")) for _ in range(r.randint(1, 4)))
    hexed = lambda lo, hi: text("0123456789abcdef", lo, hi)
    mixed = lambda lo, hi: text(letters + letters.upper() + "0123456789", lo, hi)
    out = []
    for i in range(n):
        path = r.choice(("src0", "web", "src12", "config/app.ini", "notes"))
        before, after = f"{word()} {word()}", word()
        if i % 2:
            value = r.choice((lambda: hexed(16, 64), lambda: mixed(16, 48), lambda: "AKIA" + text(letters.upper() + "234567890", 16, 16), lambda: "ghp_" + mixed(36, 36), lambda: "sk-" + mixed(24, 48), lambda: hexed(12, 24)))()
            if not _PREFIX.match(value) or r.random() < 0.5:
                before += f" {r.choice(KEY_WORDS)}{r.choice(('=', ' = ', ': ', ' = ' + chr(34), '=' + chr(39)))}"
            out.append((value, before, after, path, 1))
            continue
        kind = r.randrange(8)
        if kind == 0:
            value = text("0123456789", 10, 19)
        elif kind == 1:
            value, before = hexed(32, 64), f"{before} {r.choice(CODE_WORDS)}{r.choice((' ', ': ', '='))}"
        elif kind == 2:
            value = "".join(word() for _ in range(5)) + text("0123456789", 1, 3)
        elif kind == 3:
            value = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"
        elif kind == 4:
            value, before = r.choice(("changeme", "example", "yourkey", "sample", "xxxxxxxx")) + r.choice(("", "-", "_")) + text("0123456789", 3, 8), f"{before} {r.choice(KEY_WORDS)}="
        elif kind == 5:
            value = "/".join(word() for _ in range(3)) + "/" + hexed(6, 10)
        elif kind == 6:
            value, path = r.choice((hexed(16, 40), mixed(16, 40))), r.choice(("tests/data.md", "docs/sample.html", "examples/a.rst", "package.lock"))
            before += f" {r.choice(SAMPLE_WORDS)} {r.choice(KEY_WORDS)}: "
        else:
            value = f"{r.randint(200, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}"
        out.append((value, before, after, path, 0))
    return out + _assigned(n // 2, seed + 1) + _base64(n // 5, seed + 2)


def _base64(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings: base64 secrets, with slashes and plus signs, and others, of which half stand in test and docs paths."""
    import random
    import string

    r = random.Random(seed)
    alphabet = string.ascii_letters + string.digits
    out = []
    for i in range(n):
        size = r.choice((24, 32, 40, 44, 64, 88))
        if i % 3:
            value = "".join(r.choice(alphabet + "+/") for _ in range(size)) + r.choice(("", "", "=", "=="))
        else:
            value = "".join(r.choice(r.choice(("0123456789abcdef", alphabet))) for _ in range(size))
        path = r.choice(("src0", "web", "config/app.ini", "notes")) if r.random() < 0.5 else r.choice(("tests/data.md", "docs/index.html", "examples/a.rst", "test", "docs"))
        before = f"{r.choice(DICTIONARY)} {r.choice(KEY_WORDS)}{r.choice(('=', ' = ', ': ', ' = ' + chr(34), '=' + chr(39)))}"
        out.append((value, before, r.choice(DICTIONARY), path, 1))
    return out


def _assigned(n: int, seed: int) -> list[tuple[str, str, str, str, int]]:
    """Labelled values after a key word: passwords and passphrases, and plain words, sentences, code and samples."""
    import random

    r = random.Random(seed)
    letters, symbols = "abcdefghijklmnopqrstuvwxyz", "!@#$%^&*?.~+-_"
    text = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    rare = lambda: r.choice(PASS_WORDS) if r.random() < 0.5 else text(letters, 4, 8)
    plain = lambda: r.choice(DICTIONARY)
    out = []
    for i in range(n):
        key = r.choice(KEY_WORDS)
        key = r.choice((key, key, key.upper(), f"db_{key}", f"user{key.capitalize()}"))
        before, quote = f"{plain()} {plain()} {key}{r.choice(('=', ' = ', ': ', ':'))}", r.choice(('"', "'", '"', ""))
        if i % 2:
            kind = r.randrange(7)
            if kind >= 5:  # short ones: a word and digits, or anything
                value = rare() + text("0123456789", 1, 4) if kind == 5 else text(letters + letters.upper() + "0123456789" + symbols, 6, 9)
            elif kind == 0:
                value = "".join(rare() for _ in range(r.randint(3, 5)))
            elif kind == 1:
                value, quote = r.choice((" ", "-", ".")).join(rare() for _ in range(r.randint(4, 6))), quote or '"'
            elif kind == 2:
                value = text(letters + letters.upper(), 12, 40)
            elif kind == 3:
                value = text(letters + letters.upper() + "0123456789" + symbols, 10, 24)
            else:
                word = "".join(r.choice((c, c, c.upper(), {"a": "@", "o": "0", "i": "1", "s": "$", "e": "3"}.get(c, c))) for c in rare() + rare())
                value = (word + r.choice(symbols) + text(letters + "0123456789" + symbols, 3, 8))[:24]
        else:
            kind = r.randrange(8)
            if kind >= 6:  # short words of types, settings and prose, and small numbers
                value = r.choice((r.choice(SHORT_WORDS), plain(), plain().capitalize(), str(r.randint(1000, 99999)), f"{plain()}_{plain()}"))
                quote = r.choice(("", "", quote))
            elif kind == 0:
                value, quote = r.choice(PLAIN_WORDS), r.choice(("", "", quote))
            elif kind == 1:
                value, quote = " ".join(plain() for _ in range(r.randint(3, 12))).capitalize() + r.choice(("", ".")), quote or '"'
            elif kind == 2:
                value, quote = r.choice((f"{plain()}.{plain()}({plain()})", f"get_{plain()}_{plain()}()", f"os.environ[{plain().upper()}]", f"${{{plain().upper()}_{plain().upper()}}}", f"self.{plain()}_{plain()}", f"{{{{{plain()}.{plain()}}}}}")), r.choice(("", "", quote))
            elif kind == 3:
                value = r.choice(SAMPLE_WORDS) + r.choice(("_", "-", "")) + r.choice((key.lower(), plain())) + r.choice(("", "_here", "-here"))
            elif kind == 4:
                value = f"<{plain()}_{plain()}>" if r.random() < 0.5 else "*" * r.randint(10, 16)
            else:
                value = r.choice(("https://", "http://", "/")) + "/".join(plain() for _ in range(r.randint(2, 5)))
                if r.random() < 0.6:  # the secret in it is a candidate of its own
                    value += f"?{r.choice(KEY_WORDS)}={text('0123456789abcdef' if r.random() < 0.5 else letters + letters.upper() + '0123456789', 16, 48)}"
        if len(value) >= SHORTEST_VALUE:
            out.append((value, before + quote, plain(), r.choice(("src0", "web", "src12", "config/app.ini", "notes")), i % 2))
    return out


@dataclass
class Forest:
    """Binary decision trees over numbers; ``score`` is their mean."""

    trees: list

    def score(self, x):
        import numpy as np

        total = np.zeros(len(x))
        for feature, cut, left, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                node[inner] = left[at] + (x[inner, feature[at]] > cut[at])
            total += value[node]
        return total / max(len(self.trees), 1)


def grow(x, y, n_trees: int = 30, depth: int = 8, least: int = 4, seed: int = 5) -> Forest:
    """A forest of trees on bootstrap samples, each split by the best Gini gain among a random part of the features."""
    import numpy as np

    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    rng = np.random.default_rng(seed)
    some = max(1, int(np.ceil(np.sqrt(x.shape[1])))) + 1

    def best(rows):
        found = (1e-12, -1, 0.0)
        p = y[rows].mean()
        for f in rng.choice(x.shape[1], some, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.flatnonzero(v[1:] > v[:-1])
            k = k[(k + 1 >= least) & (len(rows) - k - 1 >= least)]
            if len(k):
                n, m = k + 1.0, len(rows) - k - 1.0
                a, b = ones[k] / n, (ones[-1] - ones[k]) / m
                gain = p * (1 - p) - (n * a * (1 - a) + m * b * (1 - b)) / len(rows)
                i = int(np.argmax(gain))
                if gain[i] > found[0]:
                    found = (gain[i], int(f), (v[k[i]] + v[k[i] + 1]) / 2)
        return found

    trees = []
    for _ in range(n_trees):
        feature, cut, left, value = [-1], [0.0], [0], [0.0]
        todo = [(0, rng.integers(0, len(x), len(x)), 0)]
        while todo:
            node, rows, level = todo.pop()
            value[node] = float(y[rows].mean())
            gain, f, at = best(rows) if level < depth and 0 < value[node] < 1 else (0, -1, 0.0)
            if f >= 0:
                feature[node], cut[node], left[node] = f, at, len(feature)
                for column, fresh in ((feature, -1), (cut, 0.0), (left, 0), (value, 0.0)):
                    column += [fresh, fresh]
                goes = x[rows, f] > at
                todo += [(left[node], rows[~goes], level + 1), (left[node] + 1, rows[goes], level + 1)]
        trees.append(tuple(np.array(c) for c in (feature, cut, left, value)))
    return Forest(trees)


def train(labelled: list[tuple[str, str, str, str, int]] | None = None) -> Forest:
    rows = findings() if labelled is None else labelled
    return grow([features(*r[:4]) for r in rows], [r[4] for r in rows])


def _candidates(texts: list[bytes]):
    """For each text its candidates as (start, end, value, what stands before, word after, flags of whole neighbouring words), in code points."""
    import numpy as np

    from ._tokens import Words

    words = Words(texts, lower=False)
    digits = np.concatenate(([0], np.cumsum((words.raw >= 48) & (words.raw <= 57))))
    has_digit = digits[words.end] > digits[words.start]
    prefixed = np.zeros(len(words), bool)
    points = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))  # code points before each byte
    text = words.raw.tobytes()
    for prefix in PREFIXES:
        at = text.find(p := prefix.encode())
        while at >= 0:
            prefixed[np.searchsorted(words.start, at, "right") - 1] = True
            at = text.find(p, at + 1)
    out: list[list] = [[] for _ in texts]
    around: dict[int, _Around] = {}

    def beside(d: int) -> _Around:
        if d not in around:
            around[d] = _Around(texts[d].decode())
        return around[d]

    for i in np.flatnonzero((has_digit | prefixed) & (words.end - words.start >= SHORTEST)).tolist():
        d = int(words.doc[i])
        start, end = int(words.start[i]), int(words.end[i])
        word = text[start:end].decode()
        base = None
        for m in _CANDIDATE.finditer(word):
            value = m[0]
            if not any(c.isdigit() for c in value) and not _PREFIX.match(value):
                continue
            if base is None:
                base = int(points[start] - points[int(words.text_start[d])])
                first = max(int(words.first[d]), i - 3)
                lead = text[int(words.start[first]) : start].decode()[-CONTEXT:]
                after = text[int(words.start[i + 1]) : int(words.end[i + 1])].decode()[:CONTEXT] if i + 1 < words.first[d + 1] else ""
            out[d].append((base + m.start(), base + m.end(), value, (lead + word[max(0, m.start() - CONTEXT) : m.start()])[-CONTEXT:], after, beside(d).flags(base + m.start(), base + m.end())))
    for d, (own, raw) in enumerate(zip(out, texts, strict=True)):
        if b"=" in raw or b":" in raw:
            known = {c[:2] for c in own}
            own += [(*c, beside(d).flags(*c[:2])) for c in _values(raw.decode()) if c[:2] not in known]
            own.sort(key=lambda c: c[:2])
    return out


def _values(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    """The values after a key word and = or :, as candidates."""
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(m.lastindex)
        value = m[m.lastindex]
        if m.lastindex == 4:
            value = value.rstrip(",;")
            end = start + len(value)
        if len(value) < SHORTEST_VALUE:
            continue
        lead, rest = text[max(0, start - CONTEXT) : start], text[end : end + 2 * CONTEXT]
        words, later = lead.split(), rest.split()
        near = " ".join(words[-3 if lead[-1:].isspace() else -4 :])
        own = 0 if rest[:1].isspace() else 1
        yield start, end, value, near, later[own][:CONTEXT] if len(later) > own else ""


def _apart(spans: list[dict]) -> list[dict]:
    """Spans in order of their start, those that overlap as one with the higher score."""
    out: list[dict] = []
    for s in spans:
        if out and s["start"] < out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(s["end"], out[-1]["end"]), "score": max(s["score"], out[-1]["score"])}
        else:
            out.append(s)
    return out


def scan(docs: DataFrame, forest: Forest, path: str = "source", threshold: float = 0.5, redact: bool = False) -> DataFrame:
    """The rows of ``docs`` with n_candidates and secrets, spans (start, end, score) in code points of the text.

    With ``redact``, instead, the columns of ``docs`` with every secret replaced by MARK, and n_chars, if there, counted
    anew where that was so. Null texts stay null and have no candidates; columns named like the new ones are replaced.
    Rows are independent, so repeated ones are judged alike, and an empty table gives an empty one. Texts and their words are read
    whole, in blocks; a text's time grows with its length, however long its words are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    new = [] if redact else ["n_candidates", "secrets"]
    kept = [c for c in docs.columns if c not in new]
    types = dict(docs.dtypes)
    source = docs.select(*kept, F.coalesce(F.col(path).cast("string"), F.lit("")).alias("_path") if path in docs.columns else F.lit("").alias("_path"))

    def found(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from ._tokens import as_bytes

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for b in C.text_blocks(batches):
            paths = b["_path"].to_pylist()
            candidates = _candidates(as_bytes(b["text"]))
            rows = [features(c[2], c[3], c[4], p, c[5]) for own, p in zip(candidates, paths, strict=True) for c in own]
            scores = iter(shared.value.score(np.array(rows)).tolist() if rows else [])
            spans = [_apart([s for c in own if (s := {"start": c[0], "end": c[1], "score": next(scores)})["score"] >= threshold]) for own in candidates]
            columns = {c: b[c] for c in kept}
            if redact and any(spans):
                texts = b["text"].to_pylist()
                for i, own in enumerate(spans):
                    for s in reversed(own):
                        texts[i] = texts[i][: s["start"]] + MARK + texts[i][s["end"] :]
                columns["text"] = pa.array(texts, b.schema.field("text").type)
                if "n_chars" in columns:
                    counts = columns["n_chars"].to_pylist()
                    columns["n_chars"] = pa.array([len(texts[i]) if own else counts[i] for i, own in enumerate(spans)], b.schema.field("n_chars").type)
            if not redact:
                columns |= {"n_candidates": pa.array(list(map(len, candidates)), pa.int64()), "secrets": pa.array(spans, span)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = [f"`{c}` {types[c]}" for c in kept] + ([] if redact else ["n_candidates long", "secrets array<struct<start: int, end: int, score: double>>"])
    return source.mapInArrow(found, ", ".join(schema))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and confirmed secrets of every whole document."""
    C.shared_dir(spark)
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return scan(docs, train()).select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), "secrets")
