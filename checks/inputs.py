"""Inputs derived from the given tables, in SQL both engines understand.

The given tables have no missing values and no duplicates, so these views add
them by rule. `{name}` is replaced by the view it builds on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

EVENTS_DIRTY = """
WITH d AS (
  SELECT event_id, event_id % 100 AS slot, user_id,
         CASE WHEN event_id % 100 >= 70 THEN NULL ELSE value END AS value,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type
  FROM events)
SELECT * FROM d UNION ALL SELECT * FROM d WHERE event_id % 50 = 0
"""

ORDERS_MIXED = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
       CASE WHEN o_orderkey % 20 = 0 THEN 1 ELSE 0 END AS is_promo,
       'web' AS channel, 1 AS one, CAST(NULL AS DOUBLE) AS nothing,
       CAST(5.0 AS DOUBLE) AS const_num,
       CASE WHEN o_orderkey % 10 = 0 THEN 'x/y' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS date_text,
       CASE WHEN o_orderkey % 10 < 3 THEN 'x/y' ELSE substr(CAST(o_orderdate AS STRING), 1, 10) END AS date_noisy,
       concat('ID', CAST(o_orderkey AS STRING)) AS order_code,
       o_totalprice * 2 + o_custkey AS price_twice,
       CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE 'part' END AS status_name,
       CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS is_large
FROM orders
"""

DOC_LABELS = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

# Dates with the month's name, one row in nine no date; and names that are none.
ORDER_DATES = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 9 = 0 THEN 'in mar-velous shape'
            ELSE concat(substr(d, 9, 2), '-', substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(substr(d, 6, 2) AS INT) * 3 - 2, 3), '-', substr(d, 1, 4)) END AS dashed,
       concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(substr(d, 6, 2) AS INT) * 3 - 2, 3), ' ', substr(d, 9, 2), ', ', substr(d, 1, 4), ' 10:30') AS timed,
       concat('Mar-', CAST(o_orderkey % 50 AS STRING)) AS wing
FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS STRING), 1, 10) AS d FROM orders) x
"""

# Documents with a gap in each feature kind and labels missing for some rows.
DOC_GAPS = """
SELECT doc_id,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang,
       source,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE n_chars END AS n_chars,
       length(text) % 7 AS leftover
FROM documents
"""

_ESCAPED = "replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), chr(34), concat(chr(92), chr(34))), chr(10), concat(chr(92), 'n'))"
_BODY = (
    "concat('\"narrative\": \"', esc, '\", \"key_risks\": [\"', risk, '\"], \"recommendations\": [\"', "
    "advice, '\", \"Encode the categorical columns.\"], \"confidence\": 0.82')"
)
_ALIASED = (
    "concat('\"summary\": \"', esc, '\", \"risks\": \"- ', risk, nl, '2. second risk\", \"actions\": [\"', "
    "advice, '\"], \"confidence_score\": 88')"
)

# One written answer per conversation turn and pipeline, in every shape the
# extraction has to handle. The turn's own text is the narrative.
RAW_RESPONSES = f"""
WITH base AS (
  SELECT conv_id * 100 + turn AS run_id, role, turn, text, {_ESCAPED} AS esc, concat(chr(92), 'n') AS nl, chr(10) AS br,
         length(text) AS size
  FROM conversations),
sided AS (
  SELECT *, 'single_agent' AS pipeline, (size + turn) % 12 AS shape FROM base
  UNION ALL
  SELECT *, 'multi_agent' AS pipeline, (size * 7 + turn + 5) % 12 AS shape FROM base),
worded AS (
  SELECT *,
         CASE WHEN size % 3 = 0 THEN 'Impute missing values with the median.'
              WHEN size % 3 = 1 THEN 'Do not drop the missing rows. Cap the outliers of value instead.'
              ELSE 'Avoid removing outliers, and never fill null values.' END AS advice,
         CASE WHEN size % 2 = 0 THEN 'Missing data in value' ELSE 'Class imbalance' END AS risk
  FROM sided),
bodied AS (SELECT *, {_BODY} AS body, {_ALIASED} AS other FROM worded)
SELECT run_id, pipeline, role, turn, size, shape, advice, risk, text AS said,
       CASE shape
         WHEN 0 THEN concat('{{', body, '}}')
         WHEN 1 THEN concat('```json', br, '{{', body, '}}', br, '```')
         WHEN 2 THEN concat('Here is my analysis:', br, '```', br, '{{', body, '}}', br, '```', br, 'Done.')
         WHEN 3 THEN concat('Result: {{', body, '}} as asked.')
         WHEN 4 THEN concat('{{', body, ',}}')
         WHEN 5 THEN '   '
         WHEN 6 THEN text
         WHEN 7 THEN concat('{{', other, '}}')
         WHEN 8 THEN concat('{{"analysis": {{', body, '}}}}')
         WHEN 9 THEN concat('{{', body, '}} {{"extra": 1}}')
         WHEN 10 THEN concat('[{{', other, '}}]')
         ELSE concat('{{"title": "', risk, '", "key_findings": ["', risk, '", "fine"], "quality": {{"score": 91}}}}')
       END AS text
FROM bodied
"""

# Half of x has no partner and lies far away from the half that has one.
FAR_APART = """
SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_quantity + 1e9 ELSE l_quantity END AS x,
       CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN l_extendedprice END AS y
FROM lineitem
"""

INFINITE = """
SELECT CASE WHEN l_orderkey = 1 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS x,
       l_extendedprice AS y, l_quantity AS z
FROM lineitem
"""

VIEWS = {
    "far_apart": FAR_APART,
    "infinite": INFINITE,
    "events_dirty": EVENTS_DIRTY,
    "orders_mixed": ORDERS_MIXED,
    "doc_labels": DOC_LABELS,
    "order_dates": ORDER_DATES,
    "doc_gaps": DOC_GAPS,
    "raw_responses": RAW_RESPONSES,
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a derived view of the tables under `sf_dir`."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if _mentions(VIEWS[name], t)}
    text = VIEWS[name].replace("{", "{{").replace("}", "}}")
    for table in parts:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
    return spark.sql(text, **parts)


def _mentions(sql: str, table: str) -> bool:
    return f"FROM {table}" in sql or f"JOIN {table}" in sql
