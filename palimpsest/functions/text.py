"""Text functions as Column expressions: tokens, named spans, facts of a conversation, scores in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates tokens, what surrounds a word, a capitalised word, white space of any script at the ends. Fixed values.
TOKEN_BREAK = r"[^\p{IsAlphabetic}\p{N}]+"
WORD_EDGE = r"^[^\p{IsAlphabetic}\p{N}]+|[^\p{IsAlphabetic}\p{N}]+$"
CAPITALISED_RAW = r"^[^\p{IsAlphabetic}\p{N}]*\p{IsUppercase}\p{IsAlphabetic}*[^\p{IsAlphabetic}\p{N}]*$"
ENDS = r"(?U)^\s+|\s+$"
SINGLE_QUOTED = r"(?U)(?:^|(?<=[\s(\[{,;]))'([^']*)'(?=\z|[\s.,;:!?)\]])"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, ENDS, "")


def token_list(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def token_set(text: Column) -> Column:
    return F.array_distinct(token_list(text))


def proper_spans(text: Column) -> Column:
    """Runs of two or more capitalised words; a word that ends a sentence ends its run. Linear in the text: what ends a run is marked, and the marked words are joined and cut at the marks."""
    mark = F.lit("\x01")

    def marked(raw: Column) -> Column:
        word = F.regexp_replace(raw, WORD_EDGE, "")
        return F.when(~raw.rlike(CAPITALISED_RAW), mark).when(raw.rlike("[.!?]$"), F.concat(word, mark)).otherwise(word)

    # A mark that the text has is no letter and ends a run, as any other sign does.
    runs = F.split(F.array_join(F.transform(F.split(F.replace(text, mark, F.lit("\x02")), r"(?U)\s+"), marked), " "), "\x01")
    return F.filter(F.transform(runs, lambda x: F.trim(x)), lambda x: x.contains(" "))


def _quoted(spans: Column) -> Column:
    return F.filter(F.transform(spans, trimmed), lambda x: F.octet_length(x) > 2)


def double_quoted(text: Column) -> Column:
    """Trimmed texts of over two bytes between double quotes, taken in pairs from the left."""
    return _quoted(F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)))


def single_quoted(text: Column) -> Column:
    """The same between single quotes that open after and close before a break, which apostrophes don't."""
    return _quoted(F.regexp_extract_all(text, F.lit(SINGLE_QUOTED), F.lit(1)))


def entities(text: Column) -> Column:
    """array<struct<type, text>>: proper spans, then double and single quotations, repeats kept."""
    typed = lambda spans, kind: F.transform(spans, lambda x: F.struct(F.lit(kind).alias("type"), x.alias("text")))
    return F.concat(typed(proper_spans(text), "proper"), typed(double_quoted(text), "quoted"), typed(single_quoted(text), "quoted"))


def facts_of_lines(text: Column) -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), trimmed), lambda x: x != "")


def rendered(turns: Column) -> Column:
    """A conversation, array<struct<turn, role, text>>, as text with a line for each turn in order."""
    lines = F.transform(F.array_sort(turns), lambda t: F.concat(F.initcap(t["role"]), F.lit(": "), t["text"]))
    return F.concat(F.lit("Conversation:\n"), F.array_join(lines, "\n"))


def sentence_facts(message: Column) -> Column:
    """The local extractor: what follows the first ": " of each line that has it, or all if none has, by sentences, each ended by a dot."""
    lines = F.split(message, r"\r?\n")
    marked = F.transform(F.filter(lines, lambda x: x.contains(": ")), lambda x: F.substring(x, F.instr(x, ": ") + 2, F.length(x)))
    body = F.when(F.size(marked) > 0, F.array_join(marked, " ")).otherwise(message)
    return F.transform(F.filter(F.transform(F.split(body, "[.!?]"), trimmed), lambda x: x != ""), lambda x: F.concat(x, F.lit(".")))


def score_in(text: Column) -> Column:
    """The first decimal number, else the first whole one, else 0.5, held to 0..1."""
    found = lambda rx: F.nullif(F.regexp_extract(text, rx, 0), F.lit("")).try_cast("double")
    score = F.coalesce(found(r"-?[0-9]+\.[0-9]+"), found("-?[0-9]+"), F.lit(0.5))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def first_chars(text: Column, n: int = 4000) -> Column:
    return F.substring(text, 1, n)


def date_of(seconds: Column) -> Column:
    """YYYY-MM-DD of seconds since 1970, in UTC whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")


def is_date_shaped(text: Column) -> Column:
    return text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


def is_role(text: Column) -> Column:
    return text.isin("system", "user", "assistant")


def auth_kind(headers: Column) -> Column:
    """Of a map of header names to values: bearer before api_key before none; names in any case."""
    names = F.transform(F.map_keys(headers), F.lower)
    bearer = F.exists(F.map_entries(headers), lambda e: (F.lower(e["key"]) == "authorization") & e["value"].startswith("Bearer "))
    return F.when(bearer, "bearer").when(F.array_contains(names, "x-api-key"), "api_key").otherwise("none")


def project_id(remote: Column) -> Column:
    """owner-name of a Git remote, null if it has neither form."""
    found = F.regexp_extract(remote, r"[:/]([^:/\s]+)/([^/\s]+?)(?:\.git)?/?$", 0)
    parts = [F.regexp_extract(remote, r"[:/]([^:/\s]+)/([^/\s]+?)(?:\.git)?/?$", i) for i in (1, 2)]
    return F.when(found != "", F.concat_ws("-", *parts))


def faulty(content: Column, max_bytes: int | None = None) -> Column:
    """Whether a content can't be stored: none, blank in any script, or longer than ``max_bytes``."""
    blank = content.isNull() | (trimmed(content) == "")
    return blank if max_bytes is None else blank | (F.octet_length(content) > max_bytes)


def state_key(user: Column, agent: Column) -> Column:
    return F.substring(F.sha2(F.concat(user, F.lit("\0"), agent), 256), 1, 16)


def text_of_parts(parts: Column) -> Column:
    """The text parts of array<struct<type, text>>, by lines, trimmed."""
    return trimmed(F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n"))
