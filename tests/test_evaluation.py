import random
import re

import pytest
from conftest import keyed
from pyspark.sql import functions as F

from plumbline.operators import association, evaluation as ev
from plumbline.functions.rules import RuleAutomaton
from plumbline.functions.text import sentences, tokens
from plumbline.plans import experiment
from plumbline.sources import readers

RESPONSE = (
    "run_id int, pipeline string, status string, narrative string, key_risks array<string>, "
    "recommendations array<string>, confidence double, execution_time_seconds double, extra map<string,string>"
)


def split(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(sentences(F.col("t"))).first()[0]


def test_sentences(spark):
    text = "- First point\n* Second point\n1. Third point\nOne here. Two here!"
    assert split(spark, text) == ["First point", "Second point", "Third point", "One here.", "Two here!"]
    assert split(spark, "3 outliers remain • x") == ["outliers remain • x"]
    assert split(spark, "") == [] and split(spark, None) == []


def test_tokens(spark):
    frame = spark.createDataFrame([("Don't drop Age_2, e.g. 'quoted'",)], "t string")
    assert frame.select(tokens(F.col("t"))).first()[0] == ["don't", "drop", "age_2", "e", "g", "quoted"]


ACTIONS, TARGETS = ["drop", "remov", "impute", "one-hot"], ["missing", "null", "income", "random forest"]
CASES = [
    ("Drop the missing rows.", True),
    ("Do not drop missing rows.", False),
    ("Avoid removing null values.", False),
    ("Don't drop the missing rows, please impute income instead.", True),
    ("Don't drop missing rows, impute income instead.", False),
    ("The missing income column is short.", False),
    ("Drop something else entirely here.", False),
    ("", False),
    ("Use one-hot for income.", True),
    ("Never use one-hot for income.", False),
    ("We do not think that it is ever right to keep them, so drop missing rows.", True),
    ("Impute before the random forest.", True),
    ("Reimpute the nullable field.", True),
]


@pytest.mark.parametrize("sentence, expected", CASES)
def test_grammar(spark, sentence, expected):
    frame = spark.createDataFrame([(sentence,)], "s string").withColumn("w", tokens(F.col("s")))
    arrays = [F.array(*[F.lit(x) for x in xs]) for xs in (ACTIONS, TARGETS)]
    assert frame.select(ev.grammar_match(F.col("s"), F.col("w"), *arrays)).first()[0] is expected


def by_hand(sentence, actions, targets, window=4):
    """The grammar on one sentence, straight from its definition."""
    words = re.findall(r"[a-z0-9_]+(?:'[a-z]+)?", sentence.lower())
    low = sentence.lower()

    def near(word, stem):
        return word.startswith(stem) or (len(stem) >= 4 and stem in word)

    def phrase(stem):
        return " " in stem or "-" in stem

    aimed = any(t in low if phrase(t) else any(near(w, t) or t.startswith(w) for w in words) for t in targets)
    if not words or not aimed:
        return False
    for a in actions:
        if phrase(a) and a in low and not re.search(r"\b(" + "|".join(ev.NEGATORS) + r")\b.{1,25}" + re.escape(a), low):
            return True
    return any(
        any(near(w, a) for a in actions) and not set(words[max(0, i - window) : i]) & set(ev.NEGATORS)
        for i, w in enumerate(words)
    )


def test_grammar_against_brute_force(spark):
    bits = ["do not", "drop", "missing values", "and", "one-hot", "encode labels", "never", "cap", "the outlier", "without", "a"]
    texts = [" ".join(bits[(i * k + j) % len(bits)] for j in range(4 + i % 3)) for i in range(11) for k in (1, 2, 3, 5)]
    frame = spark.createDataFrame([(t,) for t in texts], "s string").withColumn("w", tokens(F.col("s")))
    hit = ev.grammar_match(F.col("s"), F.col("w"), F.col("actions"), F.col("targets"))
    rows = ev.with_rules(frame, ev.rubric(spark)).select("s", "actions", "targets", hit.alias("hit")).collect()
    assert [r["hit"] for r in rows] == [by_hand(r["s"], r["actions"], r["targets"]) for r in rows]
    assert {r["hit"] for r in rows} == {True, False}


@pytest.fixture(scope="module")
def evidence(make):
    rows = [(None if i % 3 == 0 else float(i), 2.0 * i + i % 2, "ab"[i % 2], "yes" if i < 2 else "no") for i in range(30)]
    return make(rows, "income double, spend double, kind string, churn string")


def test_triggers(evidence):
    found = keyed(ev.rubric_triggers(evidence, "churn"), "condition_id", "triggered", "extra_targets")
    assert found["class_imbalance"] == (True, ["churn"])
    assert found["regression_task"][0] is False
    assert found["high_correlation"] == (True, ["income", "spend"])
    assert found["outliers_present"][0] is True
    assert keyed(ev.rubric_triggers(evidence, "churn", True), "condition_id", "triggered")["outliers_present"] is False
    assert found["categorical_features"][1] == ["kind", "churn"]
    assert found["high_missingness"] == (False, ["income"])


def responses(spark, *rows):
    return spark.createDataFrame(list(rows), RESPONSE)


GOOD = ["Drop one of the correlated features.", "Cap the outliers in spend.", "Encode the kind column.", "Resample the minority class."]
BAD = ["Do not drop the correlated features.", "Never cap outliers.", "Avoid encoding kind.", "Do not resample the minority class."]


def test_accuracy(spark, evidence):
    table_ = responses(
        spark,
        (1, "single_agent", "success", "", [], GOOD, 0.8, 8.5, {}),
        (1, "multi_agent", "success", None, [], BAD, 0.9, 45.2, {"llm_call_count": "7"}),
        (2, "single_agent", "success", None, None, None, None, None, None),
    )
    checks = ev.rubric_checks(table_, ev.triggered_conditions(evidence, "churn"))
    found = {(r["run_id"], r["pipeline"]): r["recommendation_accuracy"] for r in ev.accuracy(checks).collect()}
    assert found == {(1, "single_agent"): 1.0, (1, "multi_agent"): 0.0, (2, "single_agent"): 0.0}
    report = keyed(ev.comparison_report(checks.where("run_id = 1")), "condition_id", "m4", "m5")
    assert set(report.values()) == {("OK", "NO")} and len(report) == 4
    only = keyed(ev.comparison_report(checks.where("run_id = 2")), "condition_id", "m4", "m5")
    assert set(only.values()) == {("NO", "-")}
    coverage = keyed(ev.keyword_coverage(checks.where("pipeline = 'single_agent'")), "run_id", "pct")
    assert coverage == {1: 100.0, 2: 0.0}


def test_keyword_fallback(spark):
    rules = spark.createDataFrame([("c", "d", [], [], ["impute"])], ev.RUBRIC_SCHEMA)
    table_ = responses(spark, (1, "m", "ok", "Do not IMPUTE.", [], [], None, 0.0, {}), (2, "m", "ok", "x", [], [], None, 0.0, {}))
    assert keyed(ev.rubric_checks(table_, rules), "run_id", "recommendation_matched") == {1: True, 2: False}


def test_metrics(spark):
    table_ = responses(
        spark,
        (1, "single_agent", "success", "Hello", ["a", "b", "c"], ["x", "y", "z"], 0.82, 8.51234, {}),
        (2, "single_agent", "error", None, [], [], None, None, None),
        (3, "multi_agent", "success", " ", ["a"], None, 1.7, 45.2, {"llm_call_count": "7"}),
        (4, "other", "success", "x", [], [], -1.0, 1.0, {"llm_call_count": "many"}),
    )
    found = keyed(
        ev.response_metrics(table_), "run_id", "output_completeness", "narrative_length_chars", "key_risk_count",
        "recommendation_count", "confidence_score", "execution_time_seconds", "llm_call_count",
    )
    assert found[1] == (1.0, 5, 3, 3, 0.82, 8.512, 1)
    assert found[2] == (0.0, 0, 0, 0, None, 0.0, 1)
    assert found[3] == (0.5, 1, 1, 0, 1.0, 45.2, 7)
    assert found[4] == (0.5, 1, 0, 0, 0.0, 1.0, 0)


def test_comparison(spark):
    table_ = responses(
        spark,
        (1, "single_agent", "success", "Hello", ["a"], ["x"], 0.5, 8.0, {}),
        (1, "multi_agent", "success", "Hi", ["a"], ["x"], 0.9, 40.0, {"llm_call_count": "7"}),
    )
    found = keyed(ev.metric_comparison(ev.response_metrics(table_)), "metric", "better", "m4_value", "m5_value")
    assert found["output_completeness"] == ("tie", 1.0, 1.0)
    assert found["execution_time_seconds"][0] == found["llm_call_count"][0] == "m4"
    assert found["confidence_score"] == (None, 0.5, 0.9)
    assert found["recommendation_accuracy"] == (None, None, None)


def test_experiment_keeps_datasets_apart(spark, evidence, make):
    other = make([(float(i), float(i * i)) for i in range(12)], "x double, y double")
    sets = [(evidence, "churn"), (other, "y")]
    raw = spark.createDataFrame(
        [(i, p, readers.dataset_hash(ds), "text", 1.0, {}) for i, (ds, _) in enumerate(sets) for p in (ev.SINGLE, ev.MULTI)],
        "run_id int, pipeline string, dataset_hash string, text string, execution_time_seconds double, extra map<string,string>",
    )
    done = experiment.run_experiment(raw, sets)
    asked = {(r["run_id"], r["condition_id"]) for r in done.checks.collect()}
    assert (0, "class_imbalance") in asked and (1, "regression_task") in asked
    assert (1, "class_imbalance") not in asked and (0, "regression_task") not in asked
    assert done.metrics.count() == 4 and done.comparison.count() == 16


def test_automaton_agrees_with_the_column_form(spark):
    """Random sentences of stems, negators and short words, both forms of the grammar side by side."""
    rng = random.Random(11)
    stems = [stem for row in ev.RUBRIC for part in (row[2], row[3]) for stem in part]
    words = stems + list(ev.NEGATORS) * 2 + ["a", "o", "mi", "the", "xfillx", "xcapx", "rows", "é", "one-hot", "-", "r2", "Use"]
    rows = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(800)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "i int, s string").withColumn("w", tokens(F.col("s")))
    hit = ev.grammar_match(F.col("s"), F.col("w"), F.col("actions"), F.col("targets"))
    plain = ev.with_rules(frame, ev.rubric(spark)).where(hit).select("i", "condition_id").collect()
    rules = [dict(zip(("condition_id", "description", "actions", "targets", "keywords"), row)) for row in ev.RUBRIC]
    automaton = RuleAutomaton(rules, ev.NEGATORS, ev.NEGATION_WINDOW)
    masks = [strong | weak for strong, weak in map(automaton._sentence, rows)]
    found = {(i, rule["condition_id"]) for i, mask in enumerate(masks) for k, rule in enumerate(rules) if mask >> k & 1}
    assert found == {tuple(row) for row in plain} and len(found) > 200


def test_weak_match(spark):
    rules = spark.createDataFrame([("c", "d", ["fill"], ["age"], ["impute"])], ev.RUBRIC_SCHEMA)
    said = ["Fill a gap.", "Fill ages.", "Fill ag. Fill age.", "Fill ag.", "A gap.", None]
    table_ = responses(spark, *[(i, "m", "ok", s, [], [None], None, 0.0, {}) for i, s in enumerate(said)])
    found = keyed(ev.rubric_checks(table_, rules), "run_id", "recommendation_matched", "weak_match")
    assert found == {0: (True, True), 1: (True, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (False, False)}


def test_one_run_id_on_two_datasets(spark):
    rules = spark.createDataFrame(
        [("x", "c1", "d", ["fill"], ["gap"], []), ("x", "c2", "d", ["cap"], ["tail"], []), ("y", "c1", "d", ["fill"], ["gap"], [])],
        "dataset_hash string, " + ev.RUBRIC_SCHEMA,
    )
    rows = [(1, p, "ok", "Fill the gap.", [], [], None, 0.0, {}, h) for p in ("single_agent", "multi_agent") for h in ("x", "y", "z")]
    table_ = spark.createDataFrame(rows, RESPONSE + ", dataset_hash string")
    checked = ev.checked_responses(table_, rules)
    metrics = ev.response_metrics(checked)
    assert keyed(metrics.where("pipeline = 'single_agent'"), "dataset_hash", "recommendation_accuracy") == {"x": 0.5, "y": 1.0}
    checks = ev.rubric_checks(table_, rules)
    assert sorted(r["matched"] for r in ev.accuracy(checks).collect()) == [1, 1, 1, 1]
    right = ev.metric_comparison(metrics).where("metric = 'recommendation_accuracy'")
    assert keyed(right, "dataset_hash", "m4_value", "better") == {"x": (0.5, "tie"), "y": (1.0, "tie")}
    report = ev.comparison_report(checks).select("dataset_hash", "condition_id", "m4").collect()
    assert {tuple(r) for r in report} == {("x", "c1", "OK"), ("x", "c2", "NO"), ("y", "c1", "OK")}


def test_responses_meet_the_rules_once(spark):
    said = spark.createDataFrame(
        [(1, "single_agent", ["Impute missing values."], "text")], "run_id int, pipeline string, recommendations array<string>, narrative string"
    )
    checks = ev.rubric_checks(said, ev.rubric(spark))
    assert checks._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert checks.where("recommendation_matched").count() >= 1


def test_sentences_meet_all_rules_at_once(spark):
    rng = random.Random(5)
    words = ["impute", "missing", "not", "drop", "rows", "one-hot", "encoding", "of", "the", "labels", "a", "never", "cap", "outliers", "linear regression", "use", "m"]
    texts = [(i, "single_agent", None, " ".join(rng.choices(words, k=rng.randint(1, 9))) + ".") for i in range(60)]
    said = ev.response_sentences(spark.createDataFrame(texts, "run_id int, pipeline string, recommendations array<string>, narrative string"))
    rules = ev.rubric(spark)
    hit = ev.grammar_match(F.col("sentence"), F.col("words"), F.col("actions"), F.col("targets"))
    plain = {(r["run_id"], r["condition_id"]): r["hit"] for r in ev.with_rules(said, rules).select("run_id", "condition_id", hit.alias("hit")).collect()}
    found = {(r["run_id"], r["condition_id"]): r["matched"] for r in ev.sentence_matches(said, rules).collect()}
    assert found == plain and 0 < sum(found.values()) < len(found)


def test_triggers_count_distinct_values_once(make, monkeypatch):
    """The counts the task needs also tell identifiers, so no scan looks for those."""

    def scan(*_):
        raise AssertionError("another scan")

    monkeypatch.setattr(association, "scan_columns", scan)
    ds = make([(f"id{i}", f"c{i % 3}", float(i % 5)) for i in range(40)], "id string, c string, x double")
    found = {r["condition_id"]: r["triggered"] for r in ev.rubric_triggers(ds, "x", True).collect()}
    assert found["high_correlation"] and found["categorical_features"] and not found["outliers_present"]
