"""Jobs over a table of written analyses: raw_responses(run_id, pipeline, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.columns import beside
from plumbline.functions.text import (
    bracketed_object,
    bullet_lines,
    fenced_object,
    json_object,
    paragraphs,
    strip,
)

# Error texts of the extraction.
EMPTY_ERROR = "LLM returned an empty response."
PARSE_ERROR = "LLM response was not valid JSON; raw text returned as narrative."

# Names a field may have, in order of preference.
WRAPPED_KEYS = ("narrative", "summary", "overview", "risks", "key_risks", "recommendations", "actions")
NARRATIVE_KEYS = (
    "summary",
    "overview",
    "description",
    "synthesis",
    "analysis",
    "report",
    "dataset_summary",
    "key_findings",
    "findings",
)
RISK_KEYS = ("risks", "top_risks", "risk_factors", "issues", "key_risk", "identified_risks")
RISK_WORDS = ("missing", "outlier", "imbalance", "duplicate", "skew", "risk", "issue")
RECOMMENDATION_KEYS = (
    "recommendation",
    "recommended_actions",
    "actions",
    "suggestions",
    "next_steps",
    "action_items",
    "preprocessing",
    "preprocessing_steps",
    "steps",
    "plan",
)
CONFIDENCE_KEYS = ("confidence_score", "certainty", "score")
MAX_FINDINGS = 5


def extract_json(raw: DataFrame, text: str = "text") -> DataFrame:
    """Adds strategy, json and parse_error to each row.

    The first strategy that yields an object wins: the whole text, a fenced
    block, the span from the first `{` to the last `}`.
    """
    trimmed = strip(F.col(text))
    found = raw.withColumns(
        {
            "__text": F.coalesce(trimmed, F.lit("")),
        }
    ).withColumn("__whole", json_object(F.col("__text")))
    # A later strategy is tried on the rows that the earlier ones leave.
    missing = F.col("__whole").isNull()
    found = found.withColumn("__fence", F.when(missing & F.col("__text").contains("```"), fenced_object(F.col("__text"))))
    missing = missing & F.col("__fence").isNull()
    found = found.withColumn("__span", F.when(missing, bracketed_object(F.col("__text"))))
    strategy = (
        F.when(F.col("__text") == "", "empty")
        .when(F.col("__whole").isNotNull(), "whole")
        .when(F.col("__fence").isNotNull(), "fence")
        .when(F.col("__span").isNotNull(), "span")
        .otherwise("none")
    )
    error = F.when(F.col("strategy") == "empty", EMPTY_ERROR).when(F.col("strategy") == "none", PARSE_ERROR)
    return (
        found.withColumn("strategy", strategy)
        .withColumn("json", F.coalesce("__whole", "__fence", "__span"))
        .withColumn("parse_error", error)
        .withColumn("raw_narrative", F.when(F.col("json").isNull(), F.col("__text")))
        .drop("__text", "__whole", "__fence", "__span")
    )


# -- key normalisation -------------------------------------------------------

_MAP = "map<string,variant>"
_NO_TEXT = "array<string>"


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _is_text(value: Column) -> Column:
    return _kind(value) == "STRING"


def _is_list(value: Column) -> Column:
    return _kind(value).startswith("ARRAY")


def _is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT")


def _texts(key: str) -> Column:
    """A JSON list as an array of strings; null for anything else.

    Items that are not text are written as the source writes them (1.0 stays
    1.0), but for True, False and None.
    """
    value = _get(key)
    items = F.try_variant_get(F.when(_is_list(value), value), "$", "array<variant>")
    path = F.concat(F.col("__path"), F.lit(f".{key}"))
    raw = F.from_json(F.call_function("get_json_object", F.col("json"), path), "array<string>")

    def written(item: Column, text: Column) -> Column:
        kind = _kind(item)
        return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(item.cast("string"))).otherwise(
            F.coalesce(text, item.cast("string"), F.lit("None"))
        )

    return F.zip_with(items, F.when(F.size(raw) == F.size(items), raw).otherwise(F.transform(items, lambda i: i.cast("string"))), written)


def _text(value: Column) -> Column:
    """A JSON string that is not blank; null for anything else."""
    text = F.when(_is_text(value), F.try_variant_get(value, "$", "string"))
    return F.when(strip(text) != "", text)


def _get(key: str) -> Column:
    return F.try_element_at(F.col("__data"), F.lit(key))


def _has(key: str) -> Column:
    return F.map_contains_key(F.col("__data"), key)


def _filled(texts: Column) -> Column:
    """`texts` when it has elements."""
    return F.when(F.size(texts) > 0, texts)


def _narrative() -> Column:
    tries = [_text(_get("narrative"))]
    for key in NARRATIVE_KEYS:
        tries.append(_text(_get(key)))
        tries.append(F.array_join(_filled(_texts(key)), "\n\n"))
    strings = F.filter(F.map_values(F.col("__data")), _is_text)
    sized = F.transform(
        strings,
        lambda v: F.struct(F.length(v.cast("string")).alias("size"), v.cast("string").alias("text")),
    )
    longest = F.array_max(sized)
    tries.append(F.when(longest["size"] > 0, longest["text"]))
    return F.coalesce(*tries)


def _listed(name: str, aliases: tuple[str, ...]) -> Column:
    """The named list, else what the first alias that is present holds."""
    choice = None
    for key in aliases:
        value = F.coalesce(
            _texts(key),
            bullet_lines(F.when(_is_text(_get(key)), F.try_variant_get(_get(key), "$", "string"))),
        )
        choice = F.when(_has(key), value) if choice is None else choice.when(_has(key), value)
    return F.coalesce(_filled(_texts(name)), choice)


def _lone(text: Column) -> Column:
    """A list of one text; null without it."""
    return F.when(text.isNotNull(), F.array(text))


def _risk_findings() -> Column:
    findings = _texts("key_findings")
    worded = F.filter(
        findings, lambda f: F.lower(f).rlike("|".join(RISK_WORDS))
    )
    return F.slice(worded, 1, MAX_FINDINGS)


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _share(value: Column) -> Column:
    return F.when(value > 1, value / 100).otherwise(value)


def _confidence() -> Column:
    own = _get("confidence")
    tries = [_share(_number(_get(key))) for key in CONFIDENCE_KEYS]
    quality = F.when(_is_object(_get("quality")), F.try_variant_get(_get("quality"), "$.score", "double"))
    tries.append(F.round(_share(quality), 4))
    # A confidence that is there but no number hides every other one.
    return F.when(own.isNotNull() & (_kind(own) != "VOID"), _number(own)).otherwise(F.coalesce(*tries))


def normalise_keys(extracted: DataFrame) -> DataFrame:
    """Adds narrative, key_risks, recommendations and confidence from `json`.

    A single outer object is unwrapped first. Rows without an object keep their
    text as the narrative.
    """
    outer = F.try_variant_get(F.try_parse_json("json"), "$", _MAP)
    only = F.try_element_at(F.map_values(F.col("__outer")), F.lit(1))
    inner = F.try_variant_get(F.when(_is_object(only), only), "$", _MAP)
    wrapped = (F.size("__outer") == 1) & F.arrays_overlap(
        F.map_keys("__inner"), F.array(*[F.lit(k) for k in WRAPPED_KEYS])
    )
    none = F.array().cast(_NO_TEXT)
    return (
        extracted.withColumn("__outer", outer)
        .withColumn("__inner", inner)
        .withColumn("__data", F.when(wrapped, F.col("__inner")).otherwise(F.col("__outer")))
        .withColumn("__path", F.when(wrapped, F.concat(F.lit("$['"), F.map_keys("__outer")[0], F.lit("']"))).otherwise("$"))
        .withColumns(
            {
                "narrative": F.coalesce(_narrative(), F.col("raw_narrative")),
                "key_risks": F.coalesce(
                    _filled(_listed("key_risks", RISK_KEYS)), _filled(_risk_findings()), _lone(_text(_get("key_risks"))), none
                ),
                "recommendations": F.coalesce(_listed("recommendations", RECOMMENDATION_KEYS), none),
                "confidence": _confidence(),
            }
        )
        .drop("__outer", "__inner", "__data", "__path")
    )


def complete(normalised: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fills answers that lack a narrative or recommendations from `fallback`.

    `fallback` has one row per dataset with the four fields; both sides join on
    `dataset_hash` when they have it. Parts that are present are kept.
    """
    keyed = "dataset_hash" in normalised.columns and "dataset_hash" in fallback.columns
    spare = fallback.select(
        *(["dataset_hash"] if keyed else []),
        *[F.col(c).alias(f"__{c}") for c in ("narrative", "key_risks", "recommendations", "confidence")],
    )
    joined = normalised.join(F.broadcast(spare), "dataset_hash", "left") if keyed else beside(normalised, spare)
    has_text = F.coalesce(strip(F.col("narrative")) != "", F.lit(False))
    has_advice = F.coalesce(F.size("recommendations") > 0, F.lit(False))
    has_risks = F.coalesce(F.size("key_risks") > 0, F.lit(False))
    short = ~(has_text & has_advice)
    return joined.withColumn("fallback_used", short).withColumns(
        {
            "narrative": F.when(short & ~has_text, F.col("__narrative")).otherwise(F.col("narrative")),
            "recommendations": F.when(short & ~has_advice, F.col("__recommendations")).otherwise(F.col("recommendations")),
            "key_risks": F.when(short & ~has_risks, F.col("__key_risks")).otherwise(F.col("key_risks")),
            "confidence": F.when(short, F.coalesce("confidence", "__confidence")).otherwise(F.col("confidence")),
        }
    ).drop("__narrative", "__key_risks", "__recommendations", "__confidence")


def roll_up_runs(log: DataFrame) -> DataFrame:
    """run_id, llm_call_count, per_node_time, node_outputs.

    `log` has one row per step: run_id, step, node, seconds, output, calls. A
    node that reports again overwrites its earlier entry; steps are combined per
    node before anything is gathered per run.
    """
    nodes = log.groupBy("run_id", "node").agg(
        F.sum("calls").alias("calls"),
        F.max_by("seconds", "step").alias("seconds"),
        F.max_by("output", "step").alias("output"),
    )

    def gathered(value: str) -> Column:
        entries = F.array_sort(F.collect_list(F.struct(F.col("node"), F.col(value))))
        return F.map_from_entries(entries)

    return nodes.groupBy("run_id").agg(
        F.sum("calls").alias("llm_call_count"),
        gathered("seconds").alias("per_node_time"),
        gathered("output").alias("node_outputs"),
    )


def narrative_paragraphs(responses: DataFrame, text: str = "narrative") -> DataFrame:
    """One row per paragraph of each narrative: keys, paragraph_no, paragraph."""
    keys = [c for c in ("run_id", "pipeline") if c in responses.columns]
    return responses.select(*keys, F.posexplode(paragraphs(F.col(text))).alias("paragraph_no", "paragraph"))
