"""Text expressions: sentences, tokens, strict JSON objects in free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of the sentence and token rules. (?U) gives \\s and \\d
# their Unicode meaning.
LINE_BREAKS = r"[\n\r]+"
LEAD = r"(?U)^[\s*\->•\d\.\)]+\s*"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
TOKEN = r"[a-z0-9_]+(?:'[a-z]+)?"
FENCE = r"```(?:json)?\s*([\s\S]*?)\s*```"
TRAILING_COMMA = r",\s*([\]}])"
BULLET = r"^[- •*0123456789.)]+"
PARAGRAPH_BREAK = r"\n\n+"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences and list items of a text, bullets and numbering removed."""
    lines = F.transform(
        F.split(text, LINE_BREAKS), lambda line: strip(F.regexp_replace(strip(line), LEAD, ""))
    )
    parts = F.flatten(F.transform(lines, lambda line: F.split(line, SENTENCE_END)))
    kept = F.filter(F.transform(parts, strip), lambda part: part != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def tokens(sentence: Column) -> Column:
    """Lower-case word tokens, contractions kept whole."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(TOKEN), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Paragraphs between blank lines, blank ones dropped."""
    return F.filter(F.split(text, PARAGRAPH_BREAK), lambda p: strip(p) != "")


def bullet_lines(text: Column) -> Column:
    """Non-blank lines with leading bullets or numbers removed."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda line: strip(line) != "")
    return F.transform(lines, lambda line: strip(F.regexp_replace(line, BULLET, "")))


def _valid_object(candidate: Column) -> Column:
    """`candidate` if it is one complete JSON object, else null.

    The parser stops after the first value, so the candidate is embedded before
    a sentinel: anything after the object breaks the document or hides it.
    """
    document = F.try_parse_json(F.concat(F.lit('{"value":'), candidate, F.lit(',"sentinel":0}')))
    whole = F.try_variant_get(document, "$.sentinel", "int") == 0
    kind = F.schema_of_variant(F.try_variant_get(document, "$.value", "variant"))
    return F.when(candidate.rlike(r"^\s*\{") & whole & kind.startswith("OBJECT"), candidate)


def json_object(candidate: Column) -> Column:
    """A JSON object text, if need be after removing trailing commas."""
    repaired = F.regexp_replace(candidate, TRAILING_COMMA, "$1")
    return F.coalesce(_valid_object(candidate), _valid_object(repaired))


def fenced_object(text: Column) -> Column:
    """The first code block that holds a JSON object."""
    blocks = F.regexp_extract_all(text, F.lit(FENCE), F.lit(1))
    objects = F.array_compact(F.transform(blocks, lambda block: json_object(strip(block))))
    return F.try_element_at(objects, F.lit(1))


def bracketed_object(text: Column) -> Column:
    """The object between the first `{` and the last `}`."""
    start = F.instr(text, "{")
    stop = F.length(text) - F.instr(F.reverse(text), "}") + 1
    inside = F.substring(text, start, stop - start + 1)
    has_both = (start > 0) & text.contains("}") & (stop > start)
    return F.when(has_both, json_object(inside))
