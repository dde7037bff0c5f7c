"""DuckDB SQL for the registered queries.

Written from the definitions of the statistics, independently of the operators.
The pieces below build common table expressions per input: `facts` (one row per
column), `stats`, `fences`, `pairs` and what follows from them.
"""

from __future__ import annotations

from itertools import combinations, product

from checks.inputs import VIEWS
from plumbline.operators.evaluation import METRICS, NEGATORS, RUBRIC
from plumbline.operators.missingness import NOTE_COMPLETE, NOTE_MAR, NOTE_MCAR, WARNING_MAR
from plumbline.operators.responses import (
    CONFIDENCE_KEYS,
    EMPTY_ERROR,
    NARRATIVE_KEYS,
    PARSE_ERROR,
    RECOMMENDATION_KEYS,
    RISK_KEYS,
    RISK_WORDS,
    WRAPPED_KEYS,
)
from plumbline.operators.summary import MODELS

ORACLES: dict[str, str] = {}

# Column name, Spark type and family (number, text, time) of each input.
COLUMNS: dict[str, list[tuple[str, str, str]]] = {
    "lineitem": [
        ("l_orderkey", "bigint", "number"), ("l_partkey", "bigint", "number"), ("l_suppkey", "bigint", "number"),
        ("l_linenumber", "int", "number"), ("l_quantity", "double", "number"), ("l_extendedprice", "double", "number"),
        ("l_discount", "double", "number"), ("l_tax", "double", "number"), ("l_returnflag", "string", "text"),
        ("l_linestatus", "string", "text"), ("l_shipdate", "timestamp_ntz", "time"),
    ],
    "orders": [
        ("o_orderkey", "bigint", "number"), ("o_custkey", "bigint", "number"), ("o_orderstatus", "string", "text"),
        ("o_totalprice", "double", "number"), ("o_orderdate", "timestamp_ntz", "time"), ("o_orderpriority", "string", "text"),
    ],
    "part": [
        ("p_partkey", "bigint", "number"), ("p_name", "string", "text"), ("p_brand", "string", "text"),
        ("p_type", "string", "text"), ("p_size", "int", "number"), ("p_retailprice", "double", "number"),
    ],
    "customer": [
        ("c_custkey", "bigint", "number"), ("c_name", "string", "text"), ("c_nationkey", "int", "number"),
        ("c_acctbal", "double", "number"), ("c_mktsegment", "string", "text"),
    ],
    "events": [
        ("event_id", "bigint", "number"), ("ts", "timestamp_ntz", "time"), ("user_id", "bigint", "number"),
        ("event_type", "string", "text"), ("value", "double", "number"), ("props", "string", "text"),
    ],
    "documents": [
        ("doc_id", "bigint", "number"), ("text", "string", "text"), ("lang", "string", "text"),
        ("source", "string", "text"), ("n_chars", "bigint", "number"),
    ],
    "embeddings": [("vec_id", "bigint", "number"), ("embedding", "array<float>", "text"), ("label", "int", "number")],
    "events_dirty": [
        ("event_id", "bigint", "number"), ("slot", "bigint", "number"), ("user_id", "bigint", "number"),
        ("value", "double", "number"), ("event_type", "string", "text"),
    ],
    "orders_mixed": [
        ("o_orderkey", "bigint", "number"), ("o_custkey", "bigint", "number"), ("o_orderstatus", "string", "text"),
        ("o_totalprice", "double", "number"), ("o_orderdate", "timestamp_ntz", "time"), ("o_orderpriority", "string", "text"),
        ("is_promo", "int", "number"), ("channel", "string", "text"), ("one", "int", "number"), ("nothing", "double", "number"),
        ("const_num", "double", "number"), ("date_text", "string", "text"), ("date_noisy", "string", "text"),
        ("order_code", "string", "text"), ("price_twice", "double", "number"), ("status_name", "string", "text"),
        ("is_large", "int", "number"),
    ],
    "doc_labels": [
        ("doc_id", "bigint", "number"), ("lang", "string", "text"), ("source", "string", "text"),
        ("n_chars", "bigint", "number"), ("quality", "int", "number"), ("toxic", "int", "number"),
    ],
    "doc_gaps": [
        ("doc_id", "bigint", "number"), ("lang", "string", "text"), ("source", "string", "text"),
        ("n_chars", "bigint", "number"), ("leftover", "int", "number"),
    ],
}


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def src(table: str) -> str:
    """The input as a CTE named t."""
    return f"t AS MATERIALIZED ({VIEWS.get(table, f'SELECT * FROM {table}')})"


def numbers(table: str) -> list[tuple[int, str]]:
    return [(i, c) for i, (c, _, fam) in enumerate(COLUMNS[table]) if fam == "number"]


def texts(table: str) -> list[tuple[int, str]]:
    return [(i, c) for i, (c, _, fam) in enumerate(COLUMNS[table]) if fam == "text"]


def pct(part: str, whole: str) -> str:
    return f"coalesce(round(100.0::DOUBLE * ({part}) / nullif({whole}, 0), 2), 0.0)"


def facts(table: str) -> str:
    """CTE facts: the column-level counts, type and mode."""
    rows = []
    for i, (c, kind, fam) in enumerate(COLUMNS[table]):
        value = f"CAST({c} AS VARCHAR)" if kind.startswith("array") else c
        other = f"count(*) FILTER (WHERE {c} NOT IN (0, 1))" if fam == "number" else "NULL::BIGINT"
        mode = (
            f"(SELECT {value} FROM t WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
            if fam == "text"
            else "NULL::VARCHAR"
        )
        top = f"(SELECT max(k) FROM (SELECT count(*) AS k FROM t WHERE {c} IS NOT NULL GROUP BY {value}))"
        rows.append(
            f"SELECT {i}::INT AS ordinal, {q(c)} AS column_name, {q(kind)} AS dtype, {q(fam)} AS family, count(*) AS n_rows, "
            f"count({c}) AS n, {other} AS n_other, count(DISTINCT {value}) AS unique_count, {top} AS top_cnt, {mode} AS mode FROM t"
        )
    return (
        "raw_facts AS (" + " UNION ALL ".join(rows) + "), "
        "facts AS (SELECT *, n_rows - n AS missing_count, "
        + pct("n_rows - n", "n_rows")
        + " AS missing_percentage, CASE WHEN n = 0 THEN 'unknown' WHEN family = 'number' AND n_other = 0 THEN 'binary' "
        "WHEN family = 'number' THEN 'numeric' WHEN family = 'time' THEN 'datetime' ELSE 'categorical' END AS column_type FROM raw_facts)"
    )


def stats(table: str) -> str:
    """CTE stats: unrounded measures of numeric columns (needs facts)."""
    rows = []
    for i, c in numbers(table):
        x = f"{c}::DOUBLE"
        rows.append(
            f"SELECT {i}::INT AS ordinal, count({c}) AS n, avg({x}) AS mean, quantile_cont({x}, 0.5) AS median, "
            f"CASE WHEN count({c}) > 1 THEN stddev_samp({x}) ELSE 0.0 END AS std, min({x}) AS min, max({x}) AS max, "
            f"quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3, "
            f"CASE WHEN count({c}) <= 2 OR min({c}) = max({c}) THEN 0.0 ELSE skewness({x}) END AS skewness, "
            f"CASE WHEN count({c}) <= 3 OR min({c}) = max({c}) THEN 0.0 ELSE kurtosis({x}) END AS kurtosis FROM t"
        )
    return (
        "stats AS (SELECT f.column_name, s.* FROM (" + " UNION ALL ".join(rows) + ") s "
        "JOIN facts f USING (ordinal) WHERE f.column_type = 'numeric')"
    )


def fences(table: str, z: float = 3.0) -> str:
    """CTE fences: IQR and z-score counts (needs stats)."""
    rows = []
    for i, c in numbers(table):
        rows.append(
            f"SELECT {i}::INT AS ordinal, count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS iqr_count, "
            f"count(*) FILTER (WHERE std > 0 AND abs({c} - mean) / std > {z}) AS z_count "
            f"FROM t, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, mean, std FROM stats WHERE ordinal = {i})"
        )
    return (
        "fences AS (SELECT s.ordinal, s.column_name, s.n, k.iqr_count, "
        + pct("k.iqr_count", "s.n")
        + " AS iqr_pct, round(s.q1 - 1.5 * (s.q3 - s.q1), 4) AS lower_bound, round(s.q3 + 1.5 * (s.q3 - s.q1), 4) AS upper_bound, "
        "k.z_count, " + pct("k.z_count", "s.n") + f" AS z_pct, {z}::DOUBLE AS threshold FROM stats s JOIN ("
        + " UNION ALL ".join(rows)
        + ") k USING (ordinal) WHERE s.n >= 4)"
    )


def _kind_is(i: int, kind: str) -> str:
    return f"(SELECT column_type FROM facts WHERE ordinal = {i}) = {q(kind)}"


def pearson(table: str) -> str:
    """CTE pearson: r for each pair of numeric columns (needs facts)."""
    rows = [
        f"SELECT {i}::INT AS ord_a, {j}::INT AS ord_b, {q(a)} AS column_a, {q(b)} AS column_b, "
        f"count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r0, "
        f"min({a}) FILTER (WHERE {b} IS NOT NULL) = max({a}) FILTER (WHERE {b} IS NOT NULL) "
        f"OR min({b}) FILTER (WHERE {a} IS NOT NULL) = max({b}) FILTER (WHERE {a} IS NOT NULL) AS flat FROM t"
        for (i, a), (j, b) in combinations(numbers(table), 2)
    ]
    return (
        "pearson AS (SELECT ord_a, ord_b, column_a, column_b, n, CASE WHEN flat OR isnan(r0) THEN NULL ELSE r0 END AS r FROM ("
        + " UNION ALL ".join(rows)
        + ") WHERE ord_a IN (SELECT ordinal FROM facts WHERE column_type = 'numeric') "
        "AND ord_b IN (SELECT ordinal FROM facts WHERE column_type = 'numeric'))"
    )


def cramer(table: str) -> str:
    """CTE cramer: V from observed cells against expected counts (needs facts)."""
    ctes, rows = [], []
    for (i, a), (j, b) in combinations(texts(table), 2):
        p = f"c{i}_{j}"
        ctes.append(f"{p} AS (SELECT {a} AS a, {b} AS b, count(*) AS k FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2)")
        rows.append(
            f"SELECT {i}::INT AS ord_a, {j}::INT AS ord_b, {q(a)} AS column_a, {q(b)} AS column_b, any_value(n)::BIGINT AS n, "
            f"any_value(least(r, c)) AS m, sum((k - e) * (k - e) / e) + any_value(n) - sum(e) AS chi2 FROM "
            f"(SELECT k, na * nb / n::DOUBLE AS e, n, r, c FROM {p} JOIN (SELECT a, sum(k) AS na FROM {p} GROUP BY 1) USING (a) "
            f"JOIN (SELECT b, sum(k) AS nb FROM {p} GROUP BY 1) USING (b), "
            f"(SELECT sum(k) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM {p}))"
        )
    body = " UNION ALL ".join(rows) if rows else (
        "SELECT NULL::INT AS ord_a, NULL::INT AS ord_b, NULL::VARCHAR AS column_a, NULL::VARCHAR AS column_b, NULL::BIGINT AS n, 0 AS m, 0.0 AS chi2"
    )
    return ", ".join(
        ctes
        + [
            f"cramer AS (SELECT ord_a, ord_b, column_a, column_b, n, round(sqrt(greatest(chi2, 0) / (n * (m - 1))), 4) AS value FROM ({body}) WHERE m > 1)"
        ]
    )


def biserial(table: str) -> str:
    """CTE biserial: binary x numeric (needs facts)."""
    rows = [
        f"SELECT {i}::INT AS ord_a, {j}::INT AS ord_b, {q(a)} AS binary_column, {q(b)} AS numeric_column, "
        f"count(*) AS n, CASE WHEN count(DISTINCT {a}) = 2 AND count(*) >= 4 AND min({b}) < max({b}) THEN corr({a}, {b}) END AS r "
        f"FROM t WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for (i, a), (j, b) in product(numbers(table), repeat=2)
        if i != j
    ]
    return (
        "biserial AS (SELECT ord_a, ord_b, binary_column, numeric_column, n, round(r, 4) AS value FROM ("
        + " UNION ALL ".join(rows)
        + ") WHERE r IS NOT NULL AND ord_a IN (SELECT ordinal FROM facts WHERE column_type = 'binary') "
        "AND ord_b IN (SELECT ordinal FROM facts WHERE column_type = 'numeric'))"
    )


def assoc(threshold: float = 0.8) -> str:
    """CTE assoc: flagged pairs of all methods."""
    return (
        "assoc AS (SELECT 0::INT AS method_rank, ord_a, ord_b, column_a, column_b, round(r, 4) AS correlation, 'pearson' AS method "
        f"FROM pearson WHERE abs(r) >= {threshold} "
        f"UNION ALL SELECT 1, ord_a, ord_b, column_a, column_b, value, 'cramers_v' FROM cramer WHERE value >= {threshold} "
        "UNION ALL SELECT 2, ord_a, ord_b, binary_column, numeric_column, value, 'point_biserial' "
        f"FROM biserial WHERE abs(value) >= {threshold})"
    )


def duplicates(table: str) -> str:
    return f"dups AS (SELECT (SELECT count(*) FROM t) AS n_rows, (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS duplicate_rows)"


def spearman(table: str) -> str:
    """CTE spearman: flag of a column with gaps against each number column."""
    rows = []
    for i, (c, _, _) in enumerate(COLUMNS[table]):
        for j, x in numbers(table):
            if i == j:
                continue
            rows.append(
                f"SELECT {i}::INT AS ordinal, {j}::INT AS x, count(*) AS n, corr(m, rk) AS r0 FROM (SELECT CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END AS m, "
                f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS rk FROM t WHERE {x} IS NOT NULL)"
            )
    return (
        "spearman AS (SELECT ordinal, x, n, CASE WHEN n >= 10 AND NOT isnan(r0) THEN r0 END AS r FROM ("
        + " UNION ALL ".join(rows)
        + ") WHERE ordinal IN (SELECT ordinal FROM facts WHERE missing_count > 0) AND n > 0)"
    )


def missing(table: str, threshold: float = 0.2) -> str:
    """CTE missing: the missingness table (needs spearman)."""

    def filled(note: str) -> str:
        return "printf(" + q(note) + ", column_name, printf('%.4f', best))"

    return (
        "missing AS (SELECT ordinal, column_name, missing_count, missing_percentage, indicator, "
        "CASE WHEN indicator LIKE 'likely%' THEN round(best, 4) END AS max_spearman_correlation, "
        f"CASE indicator WHEN 'complete' THEN {q(NOTE_COMPLETE)} WHEN 'likely_mar' THEN {filled(NOTE_MAR)} ELSE {filled(NOTE_MCAR)} END AS note, "
        f"CASE WHEN indicator = 'likely_mar' THEN printf({q(WARNING_MAR)}, column_name) END AS warning FROM ("
        f"SELECT f.*, coalesce(b.best, 0.0) AS best, CASE WHEN missing_count = 0 THEN 'complete' WHEN coalesce(b.best, 0) >= {threshold} "
        "THEN 'likely_mar' ELSE 'likely_mcar' END AS indicator FROM facts f LEFT JOIN "
        "(SELECT ordinal, max(abs(r)) AS best FROM spearman GROUP BY 1) b USING (ordinal)))"
    )


def ctes(table: str, *parts: str) -> str:
    return "WITH " + ", ".join([src(table), facts(table), *parts]) + " "


# -- sources -----------------------------------------------------------------

ORACLES["csv_source"] = (
    "SELECT count(*) AS n_rows, sum(o_orderkey)::BIGINT AS sum_key, round(sum(o_totalprice), 2) AS sum_price, "
    "count(DISTINCT o_orderdate::DATE) AS dates, "
    "'o_orderkey:numeric,o_custkey:numeric,o_orderstatus:categorical,o_totalprice:numeric,o_orderdate:categorical,o_orderpriority:categorical' AS kinds FROM orders"
)
ORACLES["csv_missing_tokens"] = (
    f"WITH {src('events_dirty')} SELECT count(event_id) AS event_ids, count(value) AS vals, count(event_type) AS types FROM t"
)
ORACLES["source_checks"] = """
SELECT * FROM (VALUES ('orders.csv', 'all', (SELECT count(*) FROM orders) > 0, NULL),
 ('orders.txt', 'suffix', false, 'Only CSV files are supported.'),
 ('header.csv', 'rows', false, 'Dataset contains no rows.'),
 ('empty.csv', 'size', false, 'Uploaded CSV is empty.'),
 ('', 'name', false, 'No file provided.')) v(file, failed_check, ok, message)
"""
ORACLES["source_checks_malformed"] = (
    "SELECT 'parse' AS failed_check, false AS ok, printf('Unable to read CSV. %d rows have more fields than the header.', count(*)) AS message "
    "FROM orders WHERE o_orderkey % 1000 = 7"
)
def _cell(column: str, family: str) -> str:
    text = f"strftime({column}, {q('%Y-%m-%d %H:%M:%S.%f')})" if family == "time" else f"CAST({column} AS VARCHAR)"
    return f"coalesce(length({text}) || ':' || {text}, '-')"


ORACLES["table_fingerprint"] = (
    f"WITH h AS (SELECT sha256({' || '.join(_cell(c, family) for c, _, family in COLUMNS['orders'])}) AS d FROM orders), "
    "s AS (SELECT count(*) AS n, sum(('0x' || substr(d, 1, 15))::BIGINT::HUGEINT) AS total FROM h) "
    "SELECT n AS rows, total::VARCHAR AS row_sum, substr(sha256(n::VARCHAR || ':' || total::VARCHAR), 1, 8) AS dataset_hash FROM s"
)
ORACLES["result_sink"] = (
    f"WITH {src('events_dirty')} SELECT '1.0' AS schema_version, '20260101T000000Z' AS timestamp, 'eda_only' AS pipeline, "
    "'event_type' AS target, count(*) AS n_rows FROM t"
)

_ROW = "(length(doc_id::VARCHAR) || ':' || doc_id || coalesce(length(lang) || ':' || lang, '-') || length(source) || ':' || source || coalesce(length(n_chars::VARCHAR) || ':' || n_chars, '-') || length(leftover::VARCHAR) || ':' || leftover)"
ORACLES["table_fingerprint_gaps"] = (
    f"WITH {src('doc_gaps')}, h AS (SELECT sha256({_ROW}) AS d FROM t), "
    "s AS (SELECT count(*) AS n, sum(('0x' || substr(d, 1, 15))::BIGINT::HUGEINT) AS total FROM h) "
    "SELECT n AS rows, total::VARCHAR AS row_sum, substr(sha256(n::VARCHAR || ':' || total::VARCHAR), 1, 8) AS dataset_hash FROM s"
)
# -- profile -----------------------------------------------------------------

ORACLES["column_types"] = ctes("orders_mixed") + "SELECT ordinal, column_name, dtype, column_type FROM facts"
ORACLES["table_shape"] = (
    f"WITH {src('events_dirty')}, {duplicates('events_dirty')} SELECT n_rows AS rows, 5::INT AS columns, duplicate_rows FROM dups"
)
ORACLES["duplicate_rows"] = (
    f"WITH {src('events_dirty')}, {duplicates('events_dirty')} SELECT n_rows AS rows, duplicate_rows, {pct('duplicate_rows', 'n_rows')} AS percentage FROM dups"
)
ORACLES["duplicate_documents"] = (
    "WITH t AS (SELECT text, lang, source FROM documents), "
    + duplicates("documents")
    + f" SELECT n_rows AS rows, duplicate_rows, {pct('duplicate_rows', 'n_rows')} AS percentage FROM dups"
)
_PROFILE = (
    "SELECT ordinal, column_name, dtype, column_type, n_rows, missing_count, missing_percentage, unique_count, "
    "unique_count + (missing_count > 0)::BIGINT AS unique_count_with_null, unique_count <= 1 AS is_constant, top_cnt, "
    "CASE WHEN column_type = 'categorical' THEN mode END AS most_frequent, CASE WHEN column_type = 'categorical' THEN top_cnt END AS frequency FROM facts"
)
for _name, _table in (
    ("column_profile", "orders_mixed"),
    ("column_profile_events", "events_dirty"),
    ("column_profile_lineitem", "lineitem"),
    ("column_profile_documents", "documents"),
):
    ORACLES[_name] = ctes(_table) + _PROFILE
for _name, _table in (("mode_frequency", "part"), ("mode_long_text", "documents")):
    ORACLES[_name] = ctes(_table) + (
        "SELECT ordinal, column_name, mode AS most_frequent, top_cnt AS frequency FROM facts WHERE column_type = 'categorical'"
    )
_DATE_FORMATS = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M', '%Y/%m/%d', '%m/%d/%Y', '%m/%d/%Y %H:%M:%S', '%d-%m-%Y']"


_NAMED_FORMATS = "['%d-%b-%Y', '%b %d, %Y %H:%M']"
ORACLES["date_names"] = f"WITH {src('order_dates')} " + " UNION ALL ".join(
    f"SELECT {i}::INT AS ordinal, count(try_strptime({c}, {_NAMED_FORMATS})) / count(*)::DOUBLE AS date_share FROM t"
    for i, c in ((1, "dashed"), (2, "timed"), (3, "wing"))
)


def _warnings(table: str) -> str:
    dates = " UNION ALL ".join(
        f"SELECT {i}::INT AS ordinal, bool_or(regexp_matches({c}, '[-/:]')) AS gate, count(try_strptime({c}, {_DATE_FORMATS})) / count(*)::DOUBLE AS share FROM t"
        for i, c in texts(table)
    )
    rules = [
        (1, "missing", "missing_count > 0", "column_name || ' contains ' || missing_count || ' missing value(s).'"),
        (2, "constant", "unique_count <= 1", "column_name || ' is a constant column.'"),
        (3, "high_cardinality", "column_type = 'categorical' AND unique_count > n_rows * 0.8", "column_name || ' has very high cardinality.'"),
        (4, "identifier", "column_type = 'categorical' AND unique_count = n_rows", "column_name || ' may be an identifier column.'"),
        (5, "datetime", "column_type = 'categorical' AND gate AND share >= 0.8", "column_name || ' may contain datetime values.'"),
        (6, "imbalanced", "column_type = 'binary' AND unique_count = 2 AND top_cnt / n > 0.9", "column_name || ' is highly imbalanced.'"),
    ]
    parts = [
        f"SELECT {rank}::INT AS section_rank, ordinal AS ord, {q(code)} AS code, column_name, {text} AS message FROM facts LEFT JOIN dates USING (ordinal) WHERE {test}"
        for rank, code, test, text in rules
    ]
    parts.append(
        "SELECT 0, -1, 'duplicates', NULL, 'Dataset contains ' || duplicate_rows || ' duplicate row(s).' FROM dups WHERE duplicate_rows > 0"
    )
    return ctes(table, f"dates AS ({dates})", duplicates(table)) + " UNION ALL ".join(parts)


ORACLES["profile_warnings"] = _warnings("orders_mixed")
ORACLES["profile_warnings_customer"] = _warnings("customer")
ORACLES["nested_profile"] = ctes("embeddings") + "SELECT column_name, column_type, missing_count, unique_count FROM facts"

# -- numeric -----------------------------------------------------------------

_MEASURES = ("mean", "median", "std", "min", "max", "q1", "q3", "skewness", "kurtosis")
_ROUNDED = ", ".join(f"round({m}, 4) AS {m}" for m in _MEASURES)
for _name, _table in (
    ("numeric_stats", "lineitem"),
    ("numeric_stats_orders", "orders_mixed"),
    ("numeric_stats_dirty", "events_dirty"),
):
    ORACLES[_name] = ctes(_table, stats(_table)) + f"SELECT ordinal, column_name, n, {_ROUNDED} FROM stats"
_MARKS = ("min", "q1", "median", "q3", "max", "mean")
ORACLES["box_plot"] = ctes("lineitem", stats("lineitem")) + (
    f"SELECT ordinal, column_name, {', '.join(f'round({m}, 4) AS {m}' for m in _MARKS)}, "
    + ", ".join(
        f"round((round({m}, 4) - round(min, 4)) / (CASE WHEN max = min THEN 1.0 ELSE round(max, 4) - round(min, 4) END) * 100, 4) AS {m}_position"
        for m in _MARKS
    )
    + " FROM stats"
)


def _histogram(table: str) -> str:
    counts = " UNION ALL ".join(
        f"SELECT {i}::INT AS ordinal, least(floor(({c} - lo) / (hi - lo) * 20)::INT + 1, 20) AS bin, count(*) AS cnt FROM t, "
        f"(SELECT min AS lo, max AS hi FROM stats WHERE ordinal = {i} AND min < max) WHERE {c} IS NOT NULL GROUP BY 2"
        for i, c in numbers(table)
    )
    return ctes(table, stats(table), f"counts AS ({counts})") + (
        "SELECT s.ordinal, s.column_name, b.bin::INT AS bin, round(start, 4) AS bin_start, round(start + width, 4) AS bin_end, "
        "coalesce(c.cnt, 0) AS cnt, abs(start + width / 2 - s.mean) < width / 2 AS is_mean, abs(start + width / 2 - s.median) < width / 2 AS is_median "
        "FROM (SELECT s.*, (max - min) / 20 AS width FROM stats s WHERE min < max) s, range(1, 21) b(bin) "
        ", LATERAL (SELECT s.min + (b.bin - 1) * s.width AS start) LEFT JOIN counts c ON c.ordinal = s.ordinal AND c.bin = b.bin"
    )


ORACLES["histogram"] = _histogram("orders")
ORACLES["histogram_dirty"] = _histogram("events_dirty")

# -- association -------------------------------------------------------------


def _matrix(table: str) -> str:
    return ctes(table, stats(table), pearson(table)) + (
        "SELECT ord_a, ord_b, column_a, column_b, n, round(r, 4) AS value FROM pearson "
        "UNION ALL SELECT ord_b, ord_a, column_b, column_a, n, round(r, 4) FROM pearson "
        "UNION ALL SELECT ordinal, ordinal, column_name, column_name, n, CASE WHEN min < max THEN 1.0::DOUBLE END FROM stats"
    )


ORACLES["pearson_matrix"] = _matrix("lineitem")
ORACLES["pearson_matrix_gaps"] = _matrix("events_dirty")
ORACLES["pearson_wide"] = ctes("lineitem", pearson("lineitem")) + "SELECT column_a, column_b, n, round(r, 4) AS value FROM pearson"
# Shared rows far from each column's mean; r is the one of the shared rows.
_FAR = (
    "SELECT 'x' AS column_a, 'y' AS column_b, count(*) AS n, round(corr(x, y), 4) AS value FROM (SELECT l_quantity + 1e9 AS x, "
    "CASE WHEN l_linenumber = 1 THEN l_extendedprice END AS y FROM lineitem WHERE l_orderkey % 3 = 0) WHERE y IS NOT NULL"
)
ORACLES["pearson_gaps_far"] = _FAR
ORACLES["pearson_gaps_far_wide"] = _FAR
_INFINITE = (
    "SELECT * FROM (VALUES ('x', 'y', NULL::DOUBLE), ('x', 'z', NULL::DOUBLE)) UNION ALL "
    "SELECT 'y', 'z', round(corr(l_extendedprice, l_quantity), 4) FROM lineitem"
)
ORACLES["pearson_infinite"] = f"SELECT col0 AS column_a, col1 AS column_b, col2 AS value FROM ({_INFINITE}) AS v(col0, col1, col2)"
ORACLES["pearson_infinite_wide"] = ORACLES["pearson_infinite"]
_NUMERIC_MIXED = ("o_orderkey", "o_custkey", "o_totalprice", "const_num", "price_twice")
ORACLES["correlation_view"] = (
    "WITH m AS (" + _matrix("orders_mixed") + ") SELECT column_a, "
    + ", ".join(f"max(value) FILTER (WHERE column_b = {q(c)}) AS {c}" for c in _NUMERIC_MIXED)
    + " FROM m GROUP BY column_a"
)
ORACLES["correlation_bands"] = ctes("orders_mixed", pearson("orders_mixed")) + (
    "SELECT column_a, column_b, round(r, 4) AS value, CASE WHEN r IS NULL THEN 'undefined' WHEN abs(round(r, 4)) >= 0.7 THEN 'strong' "
    "WHEN abs(round(r, 4)) >= 0.4 THEN 'moderate' WHEN abs(round(r, 4)) >= 0.2 THEN 'weak' ELSE 'negligible' END AS band FROM pearson"
)
for _name, _table in (("cramers_v", "lineitem"), ("cramers_v_part", "part"), ("cramers_v_gaps", "doc_gaps")):
    ORACLES[_name] = ctes(_table, cramer(_table)) + "SELECT * FROM cramer"
for _name, _table in (("point_biserial", "doc_labels"), ("point_biserial_orders", "orders_mixed")):
    ORACLES[_name] = ctes(_table, biserial(_table)) + "SELECT * FROM biserial"
ORACLES["associated_pairs"] = (
    ctes("orders_mixed", pearson("orders_mixed"), cramer("orders_mixed"), biserial("orders_mixed"), assoc()) + "SELECT * FROM assoc"
)
ORACLES["associated_pairs_low"] = (
    ctes("doc_labels", pearson("doc_labels"), cramer("doc_labels"), biserial("doc_labels"), assoc(0.05)) + "SELECT * FROM assoc"
)

# -- outliers ----------------------------------------------------------------

_IQR = "SELECT ordinal, column_name, n, iqr_count, iqr_pct, lower_bound, upper_bound FROM fences"
for _name, _table in (("outliers_iqr", "events_dirty"), ("outliers_iqr_lineitem", "lineitem")):
    ORACLES[_name] = ctes(_table, stats(_table), fences(_table)) + _IQR
_Z = "SELECT ordinal, column_name, n, z_count, z_pct, threshold FROM fences"
ORACLES["outliers_zscore"] = ctes("events_dirty", stats("events_dirty"), fences("events_dirty")) + _Z
ORACLES["outliers_zscore_tight"] = ctes("orders", stats("orders"), fences("orders", 1.5)) + _Z
ORACLES["outlier_summary_rules"] = ctes("events_dirty", stats("events_dirty"), fences("events_dirty")) + (
    "SELECT ordinal, column_name, n, iqr_count, z_count, true AS is_median, true AS in_range, true AS has_two_votes, true AS holds_common FROM fences"
)
ORACLES["outlier_rows"] = ctes("events_dirty", stats("events_dirty")) + (
    "SELECT event_id, value, true AS value_iqr_outlier, abs(value - mean) / std > 3 AS value_z_outlier FROM t, "
    "(SELECT * FROM stats WHERE column_name = 'value') WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)"
)

# -- missingness -------------------------------------------------------------

ORACLES["missing_columns"] = ctes("events_dirty", spearman("events_dirty"), missing("events_dirty")) + "SELECT * FROM missing"
ORACLES["missing_columns_docs"] = ctes("doc_gaps", spearman("doc_gaps"), missing("doc_gaps")) + "SELECT * FROM missing"
ORACLES["indicator_correlations"] = ctes("events_dirty", spearman("events_dirty")) + (
    "SELECT ordinal, x, n, round(r, 6) AS r FROM spearman"
)
_MISSING_SUMMARY = (
    "SELECT sum(missing_count)::BIGINT AS total_missing_cells, (any_value(n_rows) * count(*))::BIGINT AS total_cells, "
    + pct("sum(missing_count)", "any_value(n_rows) * count(*)")
    + " AS overall_missing_percentage, count(*) FILTER (WHERE missing_count > 0) AS columns_with_missing, "
    "coalesce(string_agg(column_name, ' | ' ORDER BY ordinal) FILTER (WHERE indicator = 'likely_mar'), '') AS likely_mar_columns, "
    "coalesce(string_agg(column_name, ' | ' ORDER BY ordinal) FILTER (WHERE indicator = 'likely_mcar'), '') AS likely_mcar_columns, "
    "count(*) FILTER (WHERE indicator = 'complete') AS complete_columns FROM missing JOIN (SELECT ordinal, n_rows FROM facts) USING (ordinal)"
)
ORACLES["missing_summary"] = ctes("events_dirty", spearman("events_dirty"), missing("events_dirty")) + _MISSING_SUMMARY

# -- target ------------------------------------------------------------------


def _classes(table: str, column: str) -> str:
    return (
        f"WITH {src(table)}, k AS (SELECT CAST({column} AS VARCHAR) AS label, count(*) AS count FROM t WHERE {column} IS NOT NULL GROUP BY 1) "
        f"SELECT label, count, {pct('count', '(SELECT sum(count) FROM k)')} AS percentage, (SELECT count(*) FROM k) AS num_classes FROM k"
    )


ORACLES["class_distribution"] = _classes("events_dirty", "event_type")
ORACLES["class_distribution_labels"] = _classes("doc_labels", "quality")
_NO_STATS = ", ".join(f"NULL::DOUBLE AS {m}" for m in ("mean", "median", "std", "min", "max", "skewness"))
ORACLES["target_numeric"] = ctes("orders", stats("orders")) + (
    "SELECT column_name, 'numeric' AS column_type, round(mean, 4) AS mean, round(median, 4) AS median, round(std, 4) AS std, round(min, 4) AS min, "
    "round(max, 4) AS max, round(skewness, 4) AS skewness, NULL::BIGINT AS num_classes, NULL::VARCHAR AS warning, NULL::VARCHAR AS error "
    "FROM stats WHERE column_name = 'o_totalprice'"
)
ORACLES["target_imbalance"] = (
    f"WITH {src('doc_labels')}, k AS (SELECT quality, count(*) AS c FROM t WHERE quality IS NOT NULL GROUP BY 1) "
    f"SELECT 'quality' AS column_name, 'binary' AS column_type, {_NO_STATS}, count(*) AS num_classes, "
    "CASE WHEN max(c) / sum(c) > 0.9 THEN 'Target variable is highly imbalanced.' WHEN max(c) / sum(c) > 0.75 THEN "
    "'Target variable shows moderate class imbalance.' END AS warning, NULL::VARCHAR AS error FROM k"
)
for _name, _target, _kind, _error in (
    ("target_unsupported", "o_orderdate", "'datetime'", "Target column type ''datetime'' is not supported for target analysis."),
    ("target_absent", "no_such_column", "NULL::VARCHAR", "Target column ''no_such_column'' not found in dataset."),
):
    ORACLES[_name] = (
        f"SELECT '{_target}' AS column_name, {_kind} AS column_type, {_NO_STATS}, NULL::BIGINT AS num_classes, NULL::VARCHAR AS warning, '{_error}' AS error "
        "FROM (SELECT count(*) FROM orders)"
    )
_TWO = "The target contains two distinct classes, indicating a binary classification problem."
_FEW = "The numeric target contains a small number of distinct values relative to the dataset size and may represent class labels."
_REG = "The target is numeric with sufficient continuous variation, indicating a regression problem."
_TASKS = f"""
tasks AS (SELECT ordinal, column_name AS target,
 CASE WHEN n = 0 THEN NULL WHEN unique_count = 2 THEN 'binary' ELSE column_type END AS target_type,
 CASE WHEN n > 0 THEN unique_count END AS unique_classes, CASE WHEN n > 0 THEN missing_count END AS missing_count,
 CASE WHEN n > 0 THEN missing_percentage END AS missing_percentage, kind,
 CASE kind WHEN 'two' THEN 'classification' WHEN 'many' THEN 'classification' WHEN 'few' THEN 'classification' WHEN 'reg' THEN 'regression' END AS task,
 CASE kind WHEN 'two' THEN 'binary_classification' WHEN 'many' THEN 'multiclass_classification' WHEN 'few' THEN 'multiclass_classification' WHEN 'reg' THEN 'regression' END AS task_type,
 CASE kind WHEN 'two' THEN 0.98::DOUBLE WHEN 'many' THEN 0.95 WHEN 'few' THEN 0.75 WHEN 'reg' THEN 0.95 ELSE 0.0 END AS confidence,
 CASE kind WHEN 'two' THEN {q(_TWO)} WHEN 'many' THEN 'The categorical target contains ' || unique_count || ' classes, indicating multiclass classification.'
   WHEN 'few' THEN {q(_FEW)} WHEN 'reg' THEN {q(_REG)} WHEN 'none' THEN 'Target column contains no non-missing values.'
   ELSE 'Target type ''' || column_type || ''' is not supported for automatic ML task detection.' END AS reason,
 CASE kind WHEN 'none' THEN 'invalid_target' WHEN 'other' THEN 'unsupported' ELSE 'detected' END AS status
 FROM (SELECT *, CASE WHEN n = 0 THEN 'none' WHEN unique_count = 2 OR column_type = 'binary' THEN 'two' WHEN column_type = 'categorical' THEN 'many'
   WHEN column_type = 'numeric' AND unique_count <= 10 AND unique_count / n <= 0.5 THEN 'few' WHEN column_type = 'numeric' THEN 'reg' ELSE 'other' END AS kind FROM facts))
"""
_TASK_COLUMNS = "SELECT target, target_type, unique_classes, missing_count, missing_percentage, task, task_type, confidence, reason, status FROM tasks"
ORACLES["task_detection"] = ctes("orders_mixed", _TASKS) + _TASK_COLUMNS
ORACLES["task_detection_embeddings"] = ctes("embeddings", _TASKS) + _TASK_COLUMNS + " WHERE target = 'label'"

# -- quality -----------------------------------------------------------------


def table_facts(table: str) -> list[str]:
    """CTEs up to tf, the one-row facts of the table."""
    return [
        stats(table),
        fences(table),
        pearson(table),
        cramer(table),
        biserial(table),
        assoc(),
        duplicates(table),
        "tf AS (SELECT d.n_rows AS rows, (SELECT count(*) FROM facts) AS columns, d.duplicate_rows, "
        "(SELECT sum(missing_count) FROM facts)::BIGINT AS missing_cells, (SELECT count(*) FROM facts WHERE missing_count > 0) AS missing_columns, "
        "(SELECT count(*) FROM facts WHERE unique_count + (missing_count > 0)::INT <= 1) AS constant_columns, "
        "(SELECT count(*) FROM facts WHERE column_type = 'numeric') AS numeric_columns, "
        "(SELECT count(*) FROM facts WHERE column_type IN ('categorical', 'binary')) AS class_columns, "
        "(SELECT count(*) FROM fences) AS checked_columns, coalesce((SELECT avg(iqr_pct) FROM fences), 0.0) AS outlier_rate, "
        "(SELECT count(*) FROM fences WHERE iqr_count > 0) AS outlier_columns, coalesce((SELECT sum(iqr_count) FROM fences), 0)::BIGINT AS outlier_cells, "
        "(SELECT count(*) FROM assoc) AS pairs, 100.0::DOUBLE * (SELECT sum(missing_count) FROM facts) / (d.n_rows * (SELECT count(*) FROM facts)) AS missing_rate, "
        "100.0::DOUBLE * d.duplicate_rows / d.n_rows AS duplicate_rate FROM dups d)",
        "pen AS (SELECT *, least(missing_rate, 30) AS p1, least(duplicate_rate, 15) AS p2, least(outlier_rate, 15) AS p3, "
        "least(pairs * 5.0::DOUBLE, 10) AS p4, CASE WHEN constant_columns > 0 THEN 10.0::DOUBLE ELSE 0.0 END AS p5 FROM tf)",
        "score AS (SELECT *, round(greatest(0, least(100, 100 - (p1 + p2 + p3 + p4 + p5))), 2) AS score FROM pen)",
        "graded AS (SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair' WHEN score >= 40 THEN 'Poor' ELSE 'Critical' END AS grade FROM score)",
        "notes AS ("
        + " UNION ALL ".join(
            f"SELECT {q(kind)} AS kind, {i} AS rule, {text} AS message FROM graded WHERE {test}" for kind, i, test, text in _NOTES
        )
        + ")",
        # Fallback rows when a list is empty.
        "listed AS (SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY rule) - 1)::INT AS ord, message FROM (SELECT * FROM notes "
        "UNION ALL SELECT 'strength', 0, 'Dataset contains usable structural information.' WHERE NOT EXISTS (FROM notes WHERE kind = 'strength') "
        "UNION ALL SELECT 'recommendation', 0, 'Dataset quality is good. Continue with exploratory analysis and preprocessing as required.' "
        "WHERE NOT EXISTS (FROM notes WHERE kind = 'recommendation')))",
    ]


_NOTES = [
    ("strength", 1, "missing_cells = 0", q("No missing values detected.")),
    ("strength", 2, "duplicate_rows = 0", q("No duplicate rows detected.")),
    ("strength", 3, "checked_columns > 0 AND outlier_rate = 0", q("No statistical outliers detected.")),
    ("strength", 4, "pairs = 0", q("No highly correlated feature pairs detected.")),
    ("strength", 5, "constant_columns = 0", q("No constant columns detected.")),
    ("issue", 1, "missing_cells > 0", "printf('Missing values detected (%.2f%% of cells).', missing_rate)"),
    ("issue", 2, "duplicate_rows > 0", "printf('Duplicate rows detected (%.2f%% of rows).', duplicate_rate)"),
    ("issue", 3, "outlier_rate > 0", "printf('Outliers detected across numeric columns (average rate: %.2f%%).', outlier_rate)"),
    ("issue", 4, "pairs > 0", "pairs || ' highly correlated feature pair(s) detected.'"),
    ("issue", 5, "constant_columns > 0", "constant_columns || ' constant column(s) detected.'"),
    ("recommendation", 1, "missing_cells > 0", q("Review missing values and choose an appropriate imputation strategy.")),
    ("recommendation", 2, "duplicate_rows > 0", q("Review duplicate rows before model training.")),
    ("recommendation", 3, "outlier_rate > 0", q("Investigate detected outliers before deciding whether to remove or transform them.")),
    ("recommendation", 4, "pairs > 0", q("Review highly correlated features for potential multicollinearity.")),
    ("recommendation", 5, "constant_columns > 0", q("Consider removing constant columns because they provide no predictive variation.")),
]


def scored(table: str, *more: str) -> str:
    return ctes(table, *table_facts(table), *more)


def _texts_of(kind: str) -> str:
    return f"coalesce((SELECT string_agg(message, ' | ' ORDER BY ord) FROM listed WHERE kind = {q(kind)}), '')"


_STATUS = (
    "CASE grade WHEN 'Excellent' THEN '🟢 Excellent Quality' WHEN 'Good' THEN '🟢 Good Quality' WHEN 'Fair' THEN '🟡 Fair Quality' "
    "WHEN 'Poor' THEN '🟠 Poor Quality' ELSE '🔴 Critical Quality' END"
)
for _name, _table in (("quality_score", "events_dirty"), ("quality_score_mixed", "orders_mixed")):
    ORACLES[_name] = scored(_table) + (
        f"SELECT score, grade, {_STATUS} AS status, round(p1, 4) AS missing_penalty, round(p2, 4) AS duplicate_penalty, round(p3, 4) AS outlier_penalty, "
        f"round(p4, 4) AS association_penalty, round(p5, 4) AS constant_penalty, {_texts_of('strength')} AS strengths, {_texts_of('issue')} AS issues, "
        f"{_texts_of('recommendation')} AS recommendations FROM graded"
    )
ORACLES["quality_notes"] = scored("events_dirty") + "SELECT * FROM listed"
_CONSTANT_NAMES = "(SELECT string_agg(column_name, ', ' ORDER BY ordinal) FROM facts WHERE unique_count <= 1)"
ORACLES["quality_issues"] = scored("orders_mixed") + (
    "SELECT ord, CASE WHEN contains(lower(message), 'critical') THEN 'critical' WHEN contains(lower(message), 'duplicate') OR contains(lower(message), 'outlier') "
    "THEN 'warning' ELSE 'info' END AS severity, 'Data Quality Issue' AS title, message FROM listed WHERE kind = 'issue' "
    f"UNION ALL SELECT 1000, 'warning', 'Constant Columns', (SELECT count(*) FROM facts WHERE unique_count <= 1) || ' column(s) have no variation: ' || {_CONSTANT_NAMES} || '.' "
    "FROM tf WHERE EXISTS (FROM facts WHERE unique_count <= 1) "
    "UNION ALL SELECT 1001, 'warning', 'Duplicate Records', printf('%d duplicate row(s) detected (%.1f%% of dataset).', duplicate_rows, duplicate_rate) FROM tf WHERE duplicate_rows > 0"
)
ORACLES["strength_list"] = scored("events_dirty") + (
    "SELECT (row_number() OVER (ORDER BY place) - 1)::INT AS ord, message FROM (SELECT ord AS place, message FROM listed WHERE kind = 'strength' "
    "UNION ALL SELECT 100, (SELECT count(*) FROM facts WHERE missing_count = 0) || ' column(s) have complete data with no missing values.' FROM tf "
    "WHERE EXISTS (FROM facts WHERE missing_count = 0) "
    "UNION ALL SELECT 101, 'No duplicate records found — dataset is unique.' FROM tf WHERE duplicate_rows = 0 "
    "UNION ALL SELECT 102, 'No extreme outliers detected across numeric features.' FROM tf WHERE outlier_columns = 0) QUALIFY row_number() OVER (ORDER BY place) <= 8"
)
ORACLES["constant_columns"] = ctes("orders_mixed") + "SELECT ordinal, column_name FROM facts WHERE unique_count <= 1"
ORACLES["ml_readiness"] = scored("events_dirty") + (
    "SELECT round((a + b + c + d + e) / 5)::INT AS overall, round(a, 4) AS data_quality, round(b, 4) AS feature_completeness, c AS class_balance, "
    "d AS feature_diversity, round(e, 4) AS outlier_risk, concat_ws(' | ', CASE WHEN m > 0 THEN printf('Handle missing values (%.1f%% overall missing).', m) END, "
    "CASE WHEN outlier_columns > 0 THEN 'Review outliers in ' || outlier_columns || ' numeric feature(s).' END, "
    "CASE WHEN pairs > 0 THEN 'Address ' || pairs || ' highly correlated feature pair(s).' END, 'Standardize numerical features before training.', "
    "CASE WHEN class_columns > 0 THEN 'Encode ' || class_columns || ' categorical variable(s).' END) AS recommendations FROM ("
    "SELECT *, greatest(0, least(100, score)) AS a, greatest(0, least(100, 100 - 2 * m)) AS b, 75.0::DOUBLE AS c, "
    "greatest(0, least(100, CASE WHEN columns > 5 THEN 80 ELSE columns * 16 END + CASE WHEN pairs = 0 THEN 20 ELSE 0 END))::DOUBLE AS d, "
    "greatest(0, least(100, 100 - outlier_columns / greatest(numeric_columns, 1) * 100)) AS e FROM (SELECT *, round(missing_rate, 2) AS m FROM graded))"
)
ORACLES["score_bands"] = (
    "SELECT CASE WHEN p_size * 2 >= 90 THEN 'Excellent' WHEN p_size * 2 >= 75 THEN 'Good' WHEN p_size * 2 >= 60 THEN 'Fair' WHEN p_size * 2 >= 40 THEN 'Poor' "
    "ELSE 'Critical' END AS band, count(*) AS parts FROM part GROUP BY 1"
)

# -- summaries ---------------------------------------------------------------


def features(target: str | None) -> str:
    """CTE features: the feature summary (needs stats, fences, pearson)."""
    goal = q(target) if target else "NULL"
    corr = (
        f"CASE WHEN f.column_name = {goal} THEN 1.0 ELSE (SELECT round(r, 4) FROM pearson p WHERE (p.column_a = f.column_name AND p.column_b = {goal}) "
        f"OR (p.column_b = f.column_name AND p.column_a = {goal})) END"
        if target
        else "NULL::DOUBLE"
    )
    return (
        "features AS (SELECT f.ordinal, f.column_name, f.column_type, f.missing_count, f.missing_percentage, f.unique_count, f.unique_count <= 1 AS is_constant, "
        + ", ".join(f"round(s.{m}, 4) AS {m}" for m in _MEASURES)
        + f", coalesce(o.iqr_count, 0) AS outlier_count, coalesce(o.iqr_pct, 0.0) AS outlier_percentage, {corr} AS target_correlation "
        "FROM facts f LEFT JOIN stats s USING (ordinal) LEFT JOIN fences o USING (ordinal))"
    )


for _name, _table, _target in (("feature_summary", "events_dirty", "value"), ("feature_summary_docs", "doc_labels", "n_chars")):
    ORACLES[_name] = ctes(_table, stats(_table), fences(_table), pearson(_table), features(_target)) + "SELECT * FROM features"
INSIGHTS = (
    "insights AS (SELECT 0 AS section_rank, 0::BIGINT AS ord, 'Dataset contains ' || rows || ' rows and ' || columns || ' columns.' AS message FROM graded "
    "UNION ALL SELECT 1, 0, CASE WHEN missing_cells = 0 THEN 'No missing values were detected.' ELSE missing_columns || ' column(s) contain missing values (' || missing_cells || ' cells affected).' END FROM graded "
    "UNION ALL SELECT 2, 0, CASE WHEN duplicate_rows = 0 THEN 'No duplicate rows were detected.' ELSE duplicate_rows || ' duplicate row(s) were detected.' END FROM graded "
    "UNION ALL SELECT 3, row_number() OVER (ORDER BY method_rank, ord_a, ord_b), printf('%s and %s have a very strong %s correlation (%.4f).', column_a, column_b, CASE WHEN correlation > 0 THEN 'positive' ELSE 'negative' END, correlation) FROM assoc "
    "UNION ALL SELECT 3, 0, 'No highly correlated feature pairs were detected.' FROM graded WHERE pairs = 0 "
    "UNION ALL SELECT 4, ordinal, iqr_count || ' statistical outlier(s) were detected in ' || column_name || '.' FROM fences WHERE iqr_count > 0 "
    "UNION ALL SELECT 4, 0, 'No statistical outliers were detected.' FROM graded WHERE outlier_columns = 0 "
    "UNION ALL SELECT 5, 0, 'A total of ' || outlier_cells || ' statistical outlier(s) were detected across the dataset.' FROM graded WHERE outlier_columns > 1 "
    "UNION ALL SELECT 6, 0, 'Dataset quality score is ' || score::VARCHAR || '/100 (' || grade || ').' FROM graded)"
)
for _name, _table in (("insights", "events_dirty"), ("insights_mixed", "orders_mixed")):
    ORACLES[_name] = scored(_table, INSIGHTS) + "SELECT section_rank::INT AS section_rank, message FROM insights"
ORACLES["insight_severity"] = scored("events_dirty", INSIGHTS) + (
    "SELECT message, CASE WHEN regexp_matches(lower(message), 'missing|outlier|duplicate|imbalanced') THEN 'warning' "
    "WHEN regexp_matches(lower(message), 'no |score is|contains') THEN 'success' ELSE 'info' END AS severity FROM insights"
)


def advice(target: str) -> str:
    """CTE advice: preprocessing recommendations (needs features, assoc)."""
    t = q(target)
    rules = [
        (0, "missing_count > 0", "missing_values", "high", "imputation", "column_name || ' contains ' || missing_count || ' missing value(s). Consider an appropriate imputation strategy before model training.'"),
        (1, f"column_name <> {t} AND column_type IN ('categorical', 'binary')", "categorical_encoding", "medium", "encoding", "column_name || ' is a categorical feature and should be encoded before model training.'"),
        (2, f"outlier_count > 0 AND column_name = {t}", "target_outliers", "medium", "investigate", "column_name || ' contains ' || outlier_count || ' statistical outlier(s). Investigate these observations before deciding whether any treatment is appropriate.'"),
        (3, f"outlier_count > 0 AND column_name <> {t}", "feature_outliers", "medium", "investigate_or_transform", "column_name || ' contains ' || outlier_count || ' statistical outlier(s). Investigate whether they should be retained, transformed, or handled.'"),
        (4, "is_constant", "constant_feature", "high", "remove", "column_name || ' contains a constant value and provides no useful variation for machine learning.'"),
    ]
    parts = [
        f"SELECT 0 AS part, ordinal * 5 + {i} AS place, column_name, NULL::VARCHAR AS columns, {q(kind)} AS type, {q(priority)} AS priority, {q(action)} AS action, {text} AS message, NULL::DOUBLE AS correlation FROM features WHERE {test}"
        for i, test, kind, priority, action, text in rules
    ]
    hit = f"(column_a = {t} OR column_b = {t})"
    parts.append(
        f"SELECT 1, row_number() OVER (ORDER BY method_rank, ord_a, ord_b), NULL, column_a || ' | ' || column_b, CASE WHEN {hit} THEN 'target_correlation' ELSE 'multicollinearity' END, 'medium', "
        f"CASE WHEN {hit} THEN 'investigate' ELSE 'investigate_feature_redundancy' END, column_a || ' and ' || column_b || ' have a very strong correlation (' || correlation::VARCHAR || '). ' || "
        f"CASE WHEN {hit} THEN 'Review this relationship for potential target leakage or redundancy.' ELSE 'Consider reviewing them for multicollinearity or redundant information.' END, correlation FROM assoc"
    )
    return "advice AS (SELECT row_number() OVER (ORDER BY part, place)::INT AS ord, * EXCLUDE (part, place) FROM (" + " UNION ALL ".join(parts) + "))"


ORACLES["preprocessing"] = scored("events_dirty", features("value"), advice("value")) + "SELECT * FROM advice"
ORACLES["preprocessing_mixed"] = scored("orders_mixed", features("o_totalprice"), advice("o_totalprice")) + "SELECT * FROM advice"
ORACLES["preprocessing_status"] = scored("events_dirty", features("value"), advice("value")) + (
    "SELECT 'available' AS status, (SELECT count(*) FROM advice) AS recommendation_count, CASE WHEN missing_cells = 0 THEN 'No missing values require imputation.' "
    "ELSE missing_cells || ' missing value(s) require investigation and appropriate imputation.' END AS dataset_status FROM tf"
)
ORACLES["recommendations_by_priority"] = scored("events_dirty", features("value"), advice("value")) + (
    "SELECT priority, count(*) AS count, string_agg(message, ' | ' ORDER BY ord) AS messages FROM advice GROUP BY 1"
)
_MODELS = "models(task_type, ord, model, reason) AS (VALUES " + ", ".join(f"({q(a)}, {b}, {q(c)}, {q(d)})" for a, b, c, d in MODELS) + ")"
ORACLES["recommended_models"] = ctes("events_dirty", _TASKS, _MODELS) + (
    "SELECT target, task_type, ord, model, models.reason FROM tasks JOIN models USING (task_type) WHERE target = 'event_type'"
)
_REASONING = (
    "concat_ws(' | ', 'Detected ML task: ' || k.task_type || '.', 'Dataset contains ' || rows || ' rows and ' || (columns - 1) || ' input features.', "
    "num || ' numeric feature(s) detected.', cls || ' categorical feature(s) detected.', 'Data quality score is ' || score::VARCHAR || '/100 (' || grade || ').', "
    "CASE WHEN outlier_columns > 0 THEN 'Outliers were detected in: ' || (SELECT string_agg(column_name, ', ' ORDER BY ordinal) FROM fences WHERE iqr_count > 0) || '.' END)"
)
_STEPS = (
    "concat_ws(' | ', CASE WHEN num > 0 THEN 'Numeric features can be used directly by tree-based models.' END, "
    "CASE WHEN cls > 0 THEN 'Categorical features should be encoded before model training.' END, "
    "CASE WHEN outlier_columns > 0 THEN 'Review detected outliers before model training.' END)"
)
ORACLES["model_recommendation"] = scored("events_dirty", _TASKS, _MODELS) + (
    "SELECT 'available' AS status, k.task, k.task_type, k.target, (SELECT string_agg(model, ' | ' ORDER BY ord) FROM models m WHERE m.task_type = k.task_type) AS models, "
    f"{_STEPS} AS preprocessing, {_REASONING} AS reasoning FROM graded, (SELECT * FROM tasks WHERE target = 'event_type') k, "
    "(SELECT count(*) FILTER (WHERE column_type = 'numeric') AS num, count(*) FILTER (WHERE column_type IN ('categorical', 'binary')) AS cls FROM facts WHERE column_name <> 'event_type')"
)
ORACLES["report"] = scored("events_dirty", _TASKS, _MODELS, INSIGHTS, features("event_type"), advice("event_type")) + (
    f"SELECT rows, columns::INT AS columns, duplicate_rows, score, grade, {_STATUS} AS status, k.target, k.task, k.task_type, k.confidence, "
    "(SELECT string_agg(message, ' | ' ORDER BY section_rank, ord) FROM insights) AS key_findings, "
    "(SELECT string_agg(model, ' | ' ORDER BY ord) FROM models m WHERE m.task_type = k.task_type) AS recommended_models, "
    "(SELECT string_agg(message, ' | ' ORDER BY ord) FROM advice) AS preprocessing FROM graded, (SELECT * FROM tasks WHERE target = 'event_type') k"
)
ORACLES["own_narrative"] = scored("events_dirty", _TASKS) + (
    "SELECT 'The dataset contains ' || format('{:,}', rows) || ' observations across ' || columns || ' features, identified for a ' || k.task || ' task with target variable ''' || k.target || "
    "'''. The automated data quality assessment assigned an overall score of ' || score::VARCHAR || '/100 (Grade ' || grade || '). Deterministic profiling identified key data health "
    "characteristics across missingness patterns, numeric skewness, and feature relationships required for machine learning readiness.' AS narrative, "
    "(SELECT string_agg(m, ' | ' ORDER BY part, ordinal) FROM (SELECT * FROM (SELECT 0 AS part, ordinal, printf('Missing values detected in ''%s'' (%.1f%% missing).', column_name, missing_percentage) AS m "
    "FROM facts WHERE missing_count > 0 UNION ALL SELECT 1, ordinal, printf('Statistical outliers flagged in ''%s'' (%d instances).', column_name, iqr_count) FROM fences WHERE iqr_count > 0) "
    "ORDER BY part, ordinal LIMIT 5)) AS key_risks, "
    "concat_ws(' | ', CASE WHEN missing_cells > 0 THEN 'Apply imputation strategy (e.g. median or iterative imputation) for columns with missing values.' END, "
    "CASE WHEN pairs > 0 THEN 'Address multicollinearity by applying dimensionality reduction (PCA) or dropping redundant collinear features.' END, "
    "'Encode categorical features using one-hot or target encoding before model training.', 'Scale and standardize numeric features using robust scaling to mitigate outlier influence.') AS recommendations, "
    "round(score / 100, 2) AS confidence FROM graded, (SELECT * FROM tasks WHERE target = 'event_type') k"
)
# -- importance --------------------------------------------------------------


def codes(table: str, i: int, c: str) -> str:
    """CTE d<i>: label and code of a text column."""
    return f"d{i} AS (SELECT CAST({c} AS VARCHAR) AS label, row_number() OVER (ORDER BY CAST({c} AS VARCHAR)) - 1 AS code FROM t WHERE {c} IS NOT NULL GROUP BY 1)"


for _name, _table in (("label_codes", "doc_gaps"), ("label_codes_parts", "part")):
    ORACLES[_name] = f"WITH {src(_table)}, " + ", ".join(codes(_table, i, c) for i, c in texts(_table)) + " " + " UNION ALL ".join(
        f"SELECT {i}::INT AS ordinal, label, code FROM d{i}" for i, _ in texts(_table)
    )
ORACLES["median_imputation"] = (
    f"WITH {src('doc_gaps')} SELECT "
    + ", ".join(f"coalesce({c}::DOUBLE, (SELECT median({c}) FROM t)) AS {c}" for _, c in numbers("doc_gaps"))
    + " FROM t"
)
_TARGET_CLASSES = (
    "SELECT label, count(*) AS count, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT coalesce(event_type, '__missing__') AS label FROM t) GROUP BY 1"
)
ORACLES["target_classes"] = f"WITH {src('events_dirty')} " + _TARGET_CLASSES


def encoded(table: str, target: str, y: str) -> str:
    """CTE e: features as doubles x0.., and y; label columns coded, gaps filled."""
    labels = [(i, c) for i, c in texts(table) if c != target]
    binary = {"doc_labels": ("quality", "toxic")}.get(table, ())
    cols = []
    for i, (c, _, fam) in enumerate(COLUMNS[table]):
        if c == target:
            continue
        if fam == "text":
            cols.append(f"coalesce((SELECT code FROM d{i} WHERE label = t.{c}), -1)::DOUBLE AS x{i}")
        elif c in binary:
            cols.append(f"coalesce({c}, -1)::DOUBLE AS x{i}")
        else:
            cols.append(f"coalesce({c}::DOUBLE, (SELECT median({c}) FROM t)) AS x{i}")
    return ", ".join([codes(table, i, c) for i, c in labels] + [f"e AS MATERIALIZED (SELECT {', '.join(cols)}, {y} AS y FROM t)"])


ORACLES["encoded_features"] = (
    f"WITH {src('doc_gaps')}, {encoded('doc_gaps', 'leftover', 'leftover::BIGINT')} SELECT x0, x1 AS code1, x2 AS code2, x3, y FROM e"
)
_DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def _binned(x: str) -> str:
    """Value when at most ten are distinct, else its decile."""
    distinct = f"(SELECT count(DISTINCT {x}) FROM e)"
    edges = f"(SELECT quantile_cont({x}, {_DECILES}) FROM e)"
    return f"CASE WHEN {distinct} <= 10 THEN {x} ELSE len(list_filter({edges}, lambda edge: edge < {x}))::DOUBLE END"


def mutual(table: str, target: str, y: str, regression: bool = False) -> str:
    names = [(i, c, family) for i, (c, _, family) in enumerate(COLUMNS[table]) if c != target]
    goal = _binned("y") if regression else "y"
    parts = [
        f"SELECT {i}::INT AS ordinal, {q(c)} AS feature, {f'x{i}::DOUBLE' if family == 'text' else _binned(f'x{i}')} AS x, {goal} AS y FROM e"
        for i, c, family in names
    ]
    return (
        f"WITH {src(table)}, {encoded(table, target, y)}, b AS (" + " UNION ALL ".join(parts) + "), "
        "k AS (SELECT ordinal, feature, x, y, count(*)::DOUBLE AS c FROM b GROUP BY ALL), "
        "m AS (SELECT ordinal, feature, greatest(sum(c / n * ln(c * n / (cx * cy))), 0) AS mi FROM (SELECT *, sum(c) OVER (PARTITION BY ordinal, x) AS cx, "
        "sum(c) OVER (PARTITION BY ordinal, y) AS cy, sum(c) OVER (PARTITION BY ordinal) AS n FROM k) GROUP BY ALL), "
        "r AS (SELECT ordinal, feature, round(mi, 6) AS score, round(coalesce(mi / nullif((SELECT sum(mi) FROM m), 0), 0), 6) AS normalized_score FROM m) "
        "SELECT 'mutual_information' AS method, feature, score, normalized_score, row_number() OVER (ORDER BY score DESC, ordinal)::INT AS rank FROM r"
    )


ORACLES["mutual_information"] = mutual("doc_gaps", "leftover", "leftover")
ORACLES["mutual_information_regression"] = mutual("doc_gaps", "n_chars", "coalesce(n_chars::DOUBLE, (SELECT median(n_chars) FROM t))", True)
ORACLES["mutual_information_labels"] = mutual("doc_labels", "quality", "quality")
ORACLES["mutual_information_many_labels"] = mutual("doc_labels", "toxic", "toxic")
ORACLES["importance_status"] = (
    f"WITH {src('doc_labels')} SELECT CASE WHEN count(*) < 5 THEN 'insufficient_data' ELSE 'available' END AS status, 'classification' AS task_type, "
    "'quality' AS target, 5::INT AS feature_count, NULL::VARCHAR AS error FROM t"
)

# -- exploration -------------------------------------------------------------

for _name, _table, _column in (("top_categories", "events", "event_type"), ("top_categories_sources", "documents", "source")):
    ORACLES[_name] = (
        f"SELECT {_column} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {_column})::INT AS rank FROM {_table} "
        f"WHERE {_column} IS NOT NULL GROUP BY 1 ORDER BY 3 LIMIT 15"
    )
ORACLES["top_long_texts"] = (
    "SELECT md5(text) AS digest, count FROM (SELECT text, count(*) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)"
)
ORACLES["feature_table"] = ctes("lineitem", stats("lineitem")) + (
    "SELECT row_number() OVER (ORDER BY round(mean, 4) DESC, ordinal)::INT AS place, column_name, round(mean, 4) AS mean, round(skewness, 4) AS skewness FROM stats"
)
ORACLES["top_missing"] = ctes("events_dirty") + (
    "SELECT column_name, missing_count AS count, missing_percentage AS percentage FROM facts WHERE missing_count > 0 ORDER BY missing_count DESC, ordinal LIMIT 15"
)
ORACLES["top_outliers"] = ctes("events_dirty", stats("events_dirty"), fences("events_dirty")) + (
    "SELECT column_name, iqr_count AS count, iqr_pct AS percentage, sum(iqr_count) OVER ()::BIGINT AS total_shown FROM "
    "(SELECT * FROM fences WHERE iqr_count > 0 ORDER BY iqr_count DESC, ordinal LIMIT 15)"
)
ORACLES["schema_overview"] = ctes("events_dirty") + (
    "SELECT column_name, dtype, column_type, missing_count, missing_percentage, unique_count, CASE WHEN missing_percentage = 0 THEN 'good' "
    "WHEN missing_percentage < 10 THEN 'warning' ELSE 'critical' END AS quality, row_number() OVER (ORDER BY missing_count DESC, ordinal)::INT AS place "
    "FROM facts WHERE contains(lower(column_name), 'e')"
)
ORACLES["schema_totals"] = ctes("orders_mixed") + (
    "SELECT count(*) FILTER (WHERE column_type = 'numeric') AS numeric_columns, count(*) FILTER (WHERE column_type IN ('categorical', 'binary')) AS categorical_columns, "
    "sum(missing_count)::BIGINT AS total_missing FROM facts"
)


# -- evidence ----------------------------------------------------------------


def _evidence(top: int, pairs: int, cramers: int, task: str) -> str:
    return (
        "SELECT section, ord::INT AS ord, item, detail FROM ("
        "SELECT 'dataset' AS section, 1 AS ord, 'table' AS item, printf('{\"rows\":%d,\"columns\":%d,\"duplicate_rows\":%d,\"score\":%s,\"grade\":\"%s\"}', rows, columns, duplicate_rows, score::VARCHAR, grade) AS detail FROM graded "
        f"UNION ALL {task} "
        "UNION ALL SELECT 'missing', ordinal, column_name, printf('{\"missing_count\":%d,\"missing_percentage\":%s,\"indicator\":\"%s\"}', missing_count, missing_percentage::VARCHAR, indicator) FROM missing WHERE missing_count > 0 "
        "UNION ALL SELECT 'outliers', ordinal, column_name, printf('{\"iqr_count\":%d,\"iqr_pct\":%s,\"lower_bound\":%s,\"upper_bound\":%s}', iqr_count, iqr_pct::VARCHAR, lower_bound::VARCHAR, upper_bound::VARCHAR) FROM fences WHERE iqr_count > 0 "
        "UNION ALL SELECT 'missing_overall', 1, '', printf('{\"overall_missing_pct\":%s}', round(missing_rate, 2)::VARCHAR) FROM tf "
        f"UNION ALL SELECT * FROM (SELECT 'pairs', row_number() OVER (ORDER BY method_rank, ord_a, ord_b) AS o, column_a || ' ~ ' || column_b, NULL FROM assoc) WHERE o <= {pairs} "
        f"UNION ALL SELECT * FROM (SELECT 'cramers_v', row_number() OVER (ORDER BY ord_a, ord_b) AS o, column_a || ' ~ ' || column_b, NULL FROM cramer) WHERE o <= {cramers} "
        "UNION ALL SELECT 'numeric', ordinal, column_name, NULL FROM stats "
        f"UNION ALL SELECT * FROM (SELECT 'insights', row_number() OVER (ORDER BY section_rank, ord) AS o, '', message FROM insights) WHERE o <= {top}"
    )


ORACLES["evidence_specialists"] = scored("orders_mixed", spearman("orders_mixed"), missing("orders_mixed"), INSIGHTS) + (
    _evidence(10, 8, 10, "SELECT 'ml_task', 1, '', '{\"confidence\":0.0}' FROM tf") + ")"
)
_MI_EVENTS = mutual("events_dirty", "event_type", "coalesce(event_type, '__missing__')").replace("WITH ", "", 1)
_MI_HEAD, _MI_TAIL = _MI_EVENTS.rsplit(" SELECT 'mutual_information'", 1)
ORACLES["evidence"] = scored(
    "events_dirty",
    spearman("events_dirty"),
    missing("events_dirty"),
    INSIGHTS,
    _TASKS,
    _MI_HEAD[len(src("events_dirty")) + 2 :],
    "mi AS (SELECT 'mutual_information'" + _MI_TAIL + ")",
) + (
    _evidence(5, 5, 5, "SELECT 'ml_task', 1, target, printf('{\"task\":\"%s\",\"confidence\":%s}', task, confidence::VARCHAR) FROM tasks WHERE target = 'event_type'")
    + " UNION ALL SELECT method, rank, feature, NULL FROM mi WHERE rank <= 5)"
)

# -- responses ---------------------------------------------------------------


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _object(c: str) -> str:
    """`c` if it is a JSON object, if need be without trailing commas."""
    fixed = f"regexp_replace({c}, ',\\s*([\\]}}])', '\\1', 'g')"

    def valid(x: str) -> str:
        return f"CASE WHEN json_valid({x}) THEN json_type({x}) END = 'OBJECT'"

    # DuckDB's parser lets trailing commas pass, so their absence is asked for.
    strict = f"NOT regexp_matches({c}, ',\\s*[\\]}}]')"
    return f"CASE WHEN {strict} AND {valid(c)} THEN {c} WHEN {valid(fixed)} THEN {fixed} END"


_SPAN = "substr(s, strpos(s, '{'), length(s) - strpos(reverse(s), '}') - strpos(s, '{') + 2)"
EXTRACTED = (
    f"t AS MATERIALIZED ({VIEWS['raw_responses']}), s AS (SELECT *, {_strip('text')} AS s FROM t), "
    f"c AS MATERIALIZED (SELECT *, {_object('s')} AS whole, list_filter(list_transform(regexp_extract_all(s, '```(?:json)?\\s*([\\s\\S]*?)\\s*```', 1), lambda b: {_object('b')}), lambda b: b IS NOT NULL)[1] AS fence, "
    f"CASE WHEN strpos(s, '{{') > 0 AND length(s) - strpos(reverse(s), '}}') + 1 > strpos(s, '{{') AND contains(s, '}}') THEN {_object(_SPAN)} END AS span FROM s), "
    "x AS MATERIALIZED (SELECT *, CASE WHEN s = '' THEN 'empty' WHEN whole IS NOT NULL THEN 'whole' WHEN fence IS NOT NULL THEN 'fence' WHEN span IS NOT NULL THEN 'span' ELSE 'none' END AS strategy, "
    "coalesce(whole, fence, span) AS json FROM c)"
)
ORACLES["json_extraction"] = f"WITH {EXTRACTED} " + (
    f"SELECT run_id, pipeline, strategy, md5(json) AS json_digest, CASE strategy WHEN 'empty' THEN {q(EMPTY_ERROR)} WHEN 'none' THEN {q(PARSE_ERROR)} END AS parse_error FROM x"
)


def _type(k: str, kind: str) -> str:
    return f"json_type(d, '$.{k}') = '{kind}'"


def _string(k: str) -> str:
    text = f"json_extract_string(d, '$.{k}')"
    return f"CASE WHEN {_type(k, 'VARCHAR')} AND {_strip(text)} <> '' THEN {text} END"


def _list(k: str) -> str:
    return f"CASE WHEN {_type(k, 'ARRAY')} THEN json_extract_string(d, '$.{k}[*]') END"


def _full(x: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN {x} END"


_BULLETS = q("^[- •*0123456789.)]+")


def _lines(k: str) -> str:
    text = f"CASE WHEN {_type(k, 'VARCHAR')} THEN json_extract_string(d, '$.{k}') END"
    kept = f"list_filter(regexp_split_to_array({text}, '\\r\\n|\\n|\\r'), lambda l: {_strip('l')} <> '')"
    bare = _strip(f"regexp_replace(l, {_BULLETS}, '')")
    return f"list_transform({kept}, lambda l: {bare})"


def _aliased(name: str, keys: tuple[str, ...]) -> str:
    whens = " ".join(f"WHEN json_type(d, '$.{k}') IS NOT NULL THEN coalesce({_list(k)}, {_lines(k)})" for k in keys)
    return f"coalesce({_full(_list(name))}, CASE {whens} END)"


_NARRATIVE = ", ".join(
    [_string("narrative")]
    + [x for k in NARRATIVE_KEYS for x in (_string(k), f"array_to_string({_full(_list(k))}, chr(10) || chr(10))")]
)
_LONGEST = (
    "list_sort(list_transform(list_filter(json_keys(d), lambda k: json_type(d, '$.\"' || k || '\"') = 'VARCHAR'), "
    "lambda k: {'n': length(json_extract_string(d, '$.\"' || k || '\"')), 'v': json_extract_string(d, '$.\"' || k || '\"')}), 'DESC')[1].v"
)
_FINDINGS = f"list_filter({_list('key_findings')}, lambda f: regexp_matches(lower(f), {q('|'.join(RISK_WORDS))}))[1:5]"


def _as_share(x: str) -> str:
    return f"CASE WHEN {x} > 1 THEN {x} / 100 ELSE {x} END"


def _num(k: str) -> str:
    return f"TRY_CAST(json_extract_string(d, '$.{k}') AS DOUBLE)"


_CONFIDENCE = ", ".join(
    [_num("confidence")] + [_as_share(_num(k)) for k in CONFIDENCE_KEYS] + [f"round({_as_share(_num('quality.score'))}, 4)"]
)
_ONLY = "json_extract(json, '$.\"' || json_keys(json)[1] || '\"')"
NORMALISED = EXTRACTED + (
    f", u AS (SELECT *, CASE WHEN len(json_keys(json)) = 1 AND json_type({_ONLY}) = 'OBJECT' AND len(list_intersect(json_keys({_ONLY}), "
    f"[{', '.join(q(k) for k in WRAPPED_KEYS)}])) > 0 THEN {_ONLY} ELSE json END AS d FROM x), "
    f"nk AS (SELECT *, coalesce({_NARRATIVE}, {_LONGEST}, CASE WHEN json IS NULL THEN s END) AS narrative, "
    f"coalesce({_full(_aliased('key_risks', RISK_KEYS))}, {_full(_FINDINGS)}, []) AS key_risks, "
    f"coalesce({_aliased('recommendations', RECOMMENDATION_KEYS)}, []) AS recommendations, coalesce({_CONFIDENCE}) AS confidence FROM u)"
)
ORACLES["key_normalisation"] = f"WITH {NORMALISED} " + (
    "SELECT run_id, pipeline, md5(narrative) AS narrative_digest, coalesce(array_to_string(key_risks, ' | '), '') AS key_risks, coalesce(array_to_string(recommendations, ' | '), '') AS recommendations, confidence FROM nk"
)
ORACLES["completion_guard"] = f"WITH {NORMALISED}, f AS (SELECT *, NOT (coalesce({_strip('narrative')}, '') <> '' AND len(recommendations) > 0) AS fallback_used FROM nk) " + (
    "SELECT shape, fallback_used, CASE WHEN json IS NULL AND NOT fallback_used THEN 'error' ELSE 'success' END AS status, count(*) AS answers, "
    "count(*) FILTER (WHERE fallback_used OR narrative <> '') AS narratives, count(*) AS advised, count(*) FILTER (WHERE fallback_used OR confidence IS NOT NULL) AS confident FROM f GROUP BY ALL"
)
ORACLES["run_log_rollup"] = (
    "SELECT conv_id AS run_id, count(*) AS llm_call_count, max_by(length(text) / 100.0, turn) FILTER (WHERE role = 'user')::DOUBLE AS user_seconds, "
    "max_by(length(text) / 100.0, turn) FILTER (WHERE role = 'assistant')::DOUBLE AS assistant_seconds, md5(max_by(text, turn) FILTER (WHERE role = 'assistant')) AS assistant_output "
    "FROM conversations GROUP BY 1"
)
ORACLES["narrative_paragraphs"] = (
    "SELECT doc_id AS run_id, (i - 1)::INT AS paragraph_no, md5(p[i]) AS digest FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '') AS p FROM documents), "
    "LATERAL (SELECT unnest(range(1, len(p) + 1)) AS i)"
)

# -- evaluation --------------------------------------------------------------


_LEAD = q(r"^[\s*\->•\d\.\)]+\s*")


def _sentences(x: str) -> str:
    line = _strip(f"regexp_replace({_strip('l')}, {_LEAD}, '')")
    lines = f"list_transform(regexp_split_to_array({x}, '[\\n\\r]+'), lambda l: {line})"
    parts = f"flatten(list_transform({lines}, lambda l: string_split(regexp_replace(l, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10))))"
    return f"list_filter(list_transform({parts}, lambda p: {_strip('p')}), lambda p: p <> '')"


ANSWERS = f"""t AS MATERIALIZED ({VIEWS['raw_responses']}),
a AS (SELECT run_id, pipeline, size, shape, CASE WHEN shape <> 5 THEN said END AS narrative, CASE WHEN shape % 4 <> 3 THEN [risk] ELSE [] END AS key_risks,
 CASE WHEN shape % 5 <> 4 THEN [advice, '- Use one-hot for labels.'] END AS recommendations, CASE WHEN shape <> 6 THEN shape / 8.0::DOUBLE END AS confidence, size / 7.0::DOUBLE AS seconds FROM t),
l AS (SELECT run_id, pipeline, list_concat(coalesce(flatten(list_transform(recommendations, lambda r: {_sentences('r')})), []), coalesce({_sentences('narrative')}, [])) AS said FROM a),
w AS MATERIALIZED (SELECT run_id, pipeline, (i - 1)::INT AS sentence_no, said[i] AS sentence, regexp_extract_all(lower(said[i]), '[a-z0-9_]+(?:''[a-z]+)?') AS words
 FROM l, LATERAL (SELECT unnest(range(1, len(said) + 1)) AS i))"""
ORACLES["sentence_split"] = f"WITH {ANSWERS} SELECT run_id, pipeline, sentence_no, sentence FROM w"
ORACLES["sentence_tokens"] = f"WITH {ANSWERS} SELECT run_id, pipeline, sentence_no, coalesce(array_to_string(words, ' '), '') AS words FROM w"


def _array(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


RULES = "rubric(condition_id, description, actions, targets, keywords) AS (VALUES " + ", ".join(
    f"({q(c)}, {q(d)}, {_array(a)}, {_array(t)}, {_array(k)})" for c, d, a, t, k in RUBRIC
) + ")"
_NEG = "\\b(" + "|".join(NEGATORS) + ")\\b.{1,25}"
_HIT = f"""(len(words) > 0
 AND len(list_filter(targets, lambda g: CASE WHEN contains(g, ' ') OR contains(g, '-') THEN contains(lower(sentence), g)
   ELSE len(list_filter(words, lambda x: starts_with(x, g) OR starts_with(g, x) OR (length(g) >= 4 AND contains(x, g)))) > 0 END)) > 0
 AND (len(list_filter(actions, lambda b: (contains(b, ' ') OR contains(b, '-')) AND contains(lower(sentence), b)
   AND NOT regexp_matches(lower(sentence), {q(_NEG)} || '\\Q' || b || '\\E'))) > 0
  OR len(list_filter(range(1, len(words) + 1), lambda i: len(list_filter(actions, lambda b: starts_with(words[i], b) OR (length(b) >= 4 AND contains(words[i], b)))) > 0
   AND (i = 1 OR len(list_intersect(words[greatest(i - 4, 1):i - 1], {_array(NEGATORS)})) = 0))) > 0))"""
# A word under three letters that only begins a target names it weakly.
_STRONG = _HIT.replace("starts_with(g, x)", "(length(x) >= 3 AND starts_with(g, x))")
ORACLES["action_object_match"] = f"WITH {ANSWERS}, {RULES} " + (
    f"SELECT condition_id, count(*) AS sentences, count(*) FILTER (WHERE {_HIT}) AS matches FROM w, rubric GROUP BY 1"
)


def triggers(table: str, target: str, strict: bool = False) -> str:
    """CTE trig: the six conditions (needs the table facts, tasks)."""
    t = q(target)

    def listed(frame: str, test: str, order: str = "ordinal") -> str:
        return f"coalesce((SELECT list(column_name ORDER BY {order}) FROM {frame} WHERE {test}), [])"

    checked = listed("fences", "iqr_count > 0" if strict else "true")
    classes = listed("facts", "column_type IN ('categorical', 'binary', 'datetime')")
    pairs = "coalesce((SELECT list(DISTINCT c ORDER BY c) FROM (SELECT column_a AS c FROM assoc UNION ALL SELECT column_b FROM assoc)), [])"
    majority = f"(SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM t WHERE {target} IS NOT NULL GROUP BY {target}))"
    return (
        f"tk AS (SELECT task FROM tasks WHERE target = {t}), trig AS ("
        f"SELECT 'high_missingness' AS condition_id, (SELECT round(missing_rate, 2) > 20 FROM tf) AS triggered, {listed('facts', 'missing_count > 0')} AS extra "
        f"UNION ALL SELECT 'high_correlation', len({pairs}) > 0, {pairs} UNION ALL SELECT 'outliers_present', len({checked}) > 0, {checked} "
        f"UNION ALL SELECT 'categorical_features', len({classes}) > 0, {classes} "
        f"UNION ALL SELECT 'class_imbalance', (SELECT task FROM tk) = 'classification' AND {majority} > 0.75, [{t}] "
        f"UNION ALL SELECT 'regression_task', (SELECT task FROM tk) = 'regression', [{t}])"
    )


for _name, _table, _target, _strict in (
    ("rubric_triggers", "events_dirty", "event_type", False),
    ("rubric_triggers_strict", "orders_mixed", "o_totalprice", True),
):
    ORACLES[_name] = scored(_table, _TASKS, triggers(_table, _target, _strict)) + (
        "SELECT condition_id, triggered, coalesce(array_to_string(extra, ' | '), '') AS extra_targets FROM trig"
    )
CONDITIONS = (
    "cond AS MATERIALIZED (SELECT condition_id, description, actions, list_concat(targets, list_filter(list_transform(extra, lambda e: lower(trim(e))), "
    "lambda e: NOT list_contains(targets, e))) AS targets, keywords FROM rubric JOIN trig USING (condition_id) WHERE triggered)"
)
_EVENT_RULES = (*table_facts("events_dirty"), _TASKS, triggers("events_dirty", "event_type"), RULES, CONDITIONS)
ORACLES["triggered_conditions"] = ctes("events_dirty", *_EVENT_RULES) + (
    "SELECT condition_id, description, array_to_string(actions, ' | ') AS actions, array_to_string(targets, ' | ') AS targets, array_to_string(keywords, ' | ') AS keywords FROM cond"
)
# The evidence and the answers both start from a CTE named t; answers get their own.
_ANSWERS_2 = ANSWERS.replace("t AS MATERIALIZED", "raw AS MATERIALIZED", 1).replace("FROM t),", "FROM raw),", 1)
CHECKS = ctes("events_dirty", *_EVENT_RULES, _ANSWERS_2).rstrip() + (
    f", hits AS (SELECT run_id, pipeline, condition_id, NOT bool_or({_STRONG}) AS weak FROM w, cond WHERE {_HIT} GROUP BY 1, 2, 3), "
    "ck AS (SELECT a.run_id, a.pipeline, c.condition_id, c.keywords, h.condition_id IS NOT NULL AS recommendation_matched, coalesce(h.weak, false) AS weak_match FROM a CROSS JOIN cond c "
    "LEFT JOIN hits h ON h.run_id = a.run_id AND h.pipeline = a.pipeline AND h.condition_id = c.condition_id), "
    "acc AS (SELECT run_id, pipeline, count(*) FILTER (WHERE recommendation_matched) AS matched, count(*) AS triggered, "
    "round(count(*) FILTER (WHERE recommendation_matched) / count(*), 4) AS recommendation_accuracy FROM ck GROUP BY 1, 2), "
    "met AS (SELECT a.run_id, a.pipeline, 'success' AS status, round(((coalesce(regexp_replace(narrative, '^\\s+|\\s+$', '', 'g'), '') <> '')::INT + (len(key_risks) > 0)::INT + "
    "coalesce(len(recommendations) > 0, false)::INT + (confidence IS NOT NULL)::INT) / 4, 4) AS output_completeness, length(coalesce(narrative, ''))::INT AS narrative_length_chars, "
    "len(key_risks)::INT AS key_risk_count, coalesce(len(recommendations), 0)::INT AS recommendation_count, round(least(confidence, 1.0::DOUBLE), 4) AS c0, confidence, "
    "round(seconds, 3) AS execution_time_seconds, CASE WHEN a.pipeline = 'multi_agent' THEN 7 ELSE 1 END AS llm_call_count, recommendation_accuracy FROM a JOIN acc USING (run_id, pipeline)), "
    "m AS (SELECT * EXCLUDE (c0, confidence), CASE WHEN confidence IS NOT NULL THEN c0 END AS confidence_score FROM met) "
)
ORACLES["rubric_checks"] = CHECKS + "SELECT run_id, pipeline, condition_id, recommendation_matched, weak_match FROM ck"
ORACLES["rubric_accuracy"] = CHECKS + "SELECT * FROM acc"
ORACLES["keyword_coverage"] = CHECKS + (
    "SELECT run_id, pipeline, sum(CASE WHEN recommendation_matched THEN len(keywords) ELSE 0 END)::BIGINT AS matched, sum(len(keywords))::BIGINT AS total, "
    "round(100.0::DOUBLE * sum(CASE WHEN recommendation_matched THEN len(keywords) ELSE 0 END) / sum(len(keywords)), 4) AS pct FROM ck GROUP BY 1, 2"
)
ORACLES["response_metrics"] = CHECKS + "SELECT * FROM m"
_METRIC_NOTES = {
    "STRUCTURAL": "Share of the required fields that are filled.",
    "DESCRIPTIVE": "A size only; neither side is better for it.",
    "SELF-REPORTED": "Claimed by the model itself and not verified.",
    "EFFICIENCY": "The smaller value is better.",
    "CORRECTNESS": "Share of the triggered conditions that are answered; null where none is.",
}
_BETTER = {"higher": ">", "lower": "<"}
ORACLES["metric_comparison"] = CHECKS + " UNION ALL ".join(
    f"SELECT run_id, {i}::INT AS ord, {q(name)} AS metric, {q(category)} AS category, a AS m4_value, b AS m5_value, "
    + (
        f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN a = b THEN 'tie' WHEN a {_BETTER[direction]} b THEN 'm4' ELSE 'm5' END"
        if direction
        else "NULL::VARCHAR"
    )
    + f" AS better, {q(_METRIC_NOTES[category])} AS note FROM (SELECT run_id, max({name}) FILTER (WHERE pipeline = 'single_agent')::DOUBLE AS a, max({name}) FILTER (WHERE pipeline = 'multi_agent')::DOUBLE AS b FROM m GROUP BY 1)"
    for i, (name, category, direction) in enumerate(METRICS)
)
ORACLES["evaluation_sink"] = CHECKS + (
    "SELECT 'eval' || pipeline AS run_id, condition_id, count(*) AS responses, count(*) FILTER (WHERE recommendation_matched) AS matched FROM ck GROUP BY 1, 2"
)
ORACLES["comparison_report"] = CHECKS + (
    "SELECT run_id, condition_id, "
    + ", ".join(
        f"coalesce(max(CASE WHEN recommendation_matched THEN 'OK' ELSE 'NO' END) FILTER (WHERE pipeline = '{p}'), '-') AS {m}"
        for p, m in (("single_agent", "m4"), ("multi_agent", "m5"))
    )
    + " FROM ck GROUP BY 1, 2"
)

# -- the whole analysis ------------------------------------------------------

_SECTIONS = {
    "profile": "facts",
    "numeric_statistics": "stats",
    "cramers_v": "cramer",
    "point_biserial": "biserial",
    "associated_pairs": "assoc",
    "outliers": "fences",
    "missingness": "facts",
    "insights": "insights",
    "feature_summary": "facts",
    "preprocessing": "advice",
}
_ONE_ROW = ("missingness_summary", "quality_score", "ml_task", "ml_recommendation", "report", "importance_status", "target_analysis")
ORACLES["eda_sections"] = scored("doc_labels", INSIGHTS, features("quality"), advice("quality")) + " UNION ALL ".join(
    [f"SELECT {q(name)} AS section, count(*) AS rows FROM {cte}" for name, cte in _SECTIONS.items()]
    + [f"SELECT {q(name)}, 1 FROM tf" for name in _ONE_ROW]
    + [
        f"SELECT 'warnings', count(*) FROM ({_warnings('doc_labels')})",
        "SELECT 'pearson', (SELECT count(*) * count(*) FROM stats) FROM tf",
        "SELECT 'class_distribution', count(DISTINCT quality) FROM t",
        "SELECT 'feature_importance', 2 * (columns - 1) FROM tf",
    ]
)

for _name, _target in (("forest_importance_rules", "quality"), ("forest_importance_shallow", "n_chars")):
    _features = sorted(c for c, _, _ in COLUMNS["doc_labels"] if c != _target)
    ORACLES[_name] = (
        f"SELECT 'random_forest' AS method, {len(_features)}::BIGINT AS features, 1.0::DOUBLE AS total, {q(','.join(_features))} AS names, "
        f"{q(','.join(str(i + 1) for i in range(len(_features))))} AS ranks, true AS in_range"
    )
ORACLES["top_importance_rules"] = (
    "SELECT unnest(['random_forest', 'mutual_information']) AS method, 3::BIGINT AS features, 6::BIGINT AS ranks, true AS falling"
)

# The forest's own scores cannot be said in SQL; that they do not depend on how
# the table is split, and never flag more rows than there are, can.
ORACLES["isolation_forest_splits"] = (
    "SELECT unnest(['value', 'user_id']) AS column_name, 1::BIGINT AS distinct_answers, TRUE AS in_range"
)
