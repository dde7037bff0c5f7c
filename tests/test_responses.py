import pytest
from conftest import keyed

from plumbline.operators import responses

GOOD = '{"narrative": "Fine.", "key_risks": ["r"], "recommendations": ["a"], "confidence": 0.8}'


@pytest.fixture
def extract(spark):
    def run(*texts):
        raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run_id int, text string")
        return responses.extract_json(raw).orderBy("run_id").collect()

    return run


@pytest.mark.parametrize(
    "text, strategy",
    [
        (GOOD, "whole"),
        (f"\n  {GOOD}\n", "whole"),
        (f"```json\n{GOOD}\n```", "fence"),
        (f"Here you go:\n```\n{GOOD}\n```\nBye", "fence"),
        (f"```\nnot json\n```\n```json\n{GOOD}\n```", "fence"),
        (f"Result: {GOOD} as asked", "span"),
        (GOOD.replace("0.8}", "0.8,}"), "whole"),
        (GOOD.replace('["r"]', '["r",]'), "whole"),
        ("", "empty"),
        ("   \n", "empty"),
        (None, "empty"),
        ("Just a sentence.", "none"),
        ("[1, 2]", "none"),
        ('"text"', "none"),
        (f"{GOOD} {{}}", "none"),
        (f"[{GOOD}]", "span"),
        ('{"a": 1}}', "none"),
        ("{'a': 1}", "none"),
    ],
)
def test_strategies(extract, text, strategy):
    row = extract(text)[0]
    assert row["strategy"] == strategy
    assert (row["json"] is not None) == (strategy in ("whole", "fence", "span"))
    assert (row["parse_error"] is not None) == (strategy in ("empty", "none"))


def test_text_without_json_becomes_the_narrative(extract):
    assert extract(" Just words. ")[0]["raw_narrative"] == "Just words."


@pytest.fixture
def normalise(spark):
    def run(text):
        raw = spark.createDataFrame([(1, "single_agent", text)], "run_id int, pipeline string, text string")
        return responses.normalise_keys(responses.extract_json(raw)).first()

    return run


def test_alias_keys(normalise):
    row = normalise('{"summary": "S", "risks": ["r1", 2], "actions": "- do a\\n2. do b\\n\\n", "confidence_score": 88}')
    assert (row["narrative"], row["key_risks"], row["recommendations"]) == ("S", ["r1", "2"], ["do a", "do b"])
    assert row["confidence"] == pytest.approx(0.88)


def test_single_outer_object_is_unwrapped(normalise):
    row = normalise('{"analysis": ' + GOOD + "}")
    assert (row["narrative"], row["confidence"]) == ("Fine.", 0.8)
    assert normalise('{"analysis": {"other": 1}}')["narrative"] is None


def test_first_present_alias_decides(normalise):
    assert normalise('{"narrative": "n", "recommendation": 5, "actions": ["x"]}')["recommendations"] == []
    assert normalise('{"narrative": "n", "recommendations": [], "plan": ["x"]}')["recommendations"] == ["x"]


def test_narrative_fallbacks(normalise):
    assert normalise('{"narrative": " ", "key_findings": ["one", "two"]}')["narrative"] == "one\n\ntwo"
    assert normalise('{"title": "short", "body": "the longest text"}')["narrative"] == "the longest text"


def test_risks_from_findings(normalise):
    row = normalise('{"key_findings": ["All good", "Missing data", "Strong skew"]}')
    assert row["key_risks"] == ["Missing data", "Strong skew"]


def test_confidence_from_quality(normalise):
    assert normalise('{"summary": "s", "quality": {"score": 91.08}}')["confidence"] == 0.9108


def test_completion(spark):
    fallback = spark.createDataFrame([("F", ["fr"], ["fa"], 0.5)], "narrative string, key_risks array<string>, recommendations array<string>, confidence double")
    texts = [GOOD, "plain words", '{"recommendations": ["only advice"]}', ""]
    raw = spark.createDataFrame([(i, "m", t) for i, t in enumerate(texts)], "run_id int, pipeline string, text string")
    done = responses.complete(responses.normalise_keys(responses.extract_json(raw)), fallback)
    found = keyed(done, "run_id", "fallback_used", "narrative", "key_risks", "recommendations", "confidence")
    assert found[0] == (False, "Fine.", ["r"], ["a"], 0.8)
    assert found[1] == (True, "plain words", ["fr"], ["fa"], 0.5)
    assert found[2] == (True, "F", ["fr"], ["only advice"], 0.5)
    assert found[3] == (True, "F", ["fr"], ["fa"], 0.5)


def test_roll_up_keeps_the_last_entry_of_a_node(spark):
    log = spark.createDataFrame(
        [(1, 0, "a", 1.0, "x", 1), (1, 1, "b", 2.0, "y", 1), (1, 2, "a", 3.0, "z", 1), (2, 0, "a", 4.0, "w", 2)],
        "run_id int, step int, node string, seconds double, output string, calls int",
    )
    found = keyed(responses.roll_up_runs(log), "run_id", "llm_call_count", "per_node_time", "node_outputs")
    assert found[1] == (3, {"a": 3.0, "b": 2.0}, {"a": "z", "b": "y"})
    assert found[2][0] == 2


def test_paragraphs(spark):
    frame = spark.createDataFrame([(1, "one\n\n\ntwo\nstill two\n\n  \n\nthree")], "run_id int, narrative string")
    assert [r["paragraph"] for r in responses.narrative_paragraphs(frame).collect()] == ["one", "two\nstill two", "three"]


def test_items_are_written_as_the_source_has_them(normalise):
    row = normalise('{"summary": "s", "risks": [true, 1.0, null, "1.0", 2, {"a": 1}, "true"], "actions": [1e3, false]}')
    assert row["key_risks"] == ["True", "1.0", "None", "1.0", "2", '{"a":1}', "true"]
    assert row["recommendations"] == ["1000.0", "False"]
    inner = normalise('{"it\'s": {"summary": "s", "actions": [1.50, "x"]}}')
    assert inner["recommendations"][1] == "x"


def test_a_confidence_in_words_hides_every_other(normalise):
    assert normalise('{"summary": "s", "confidence": "high", "score": 91}')["confidence"] is None
    assert normalise('{"summary": "s", "confidence": "0.7", "score": 91}')["confidence"] == 0.7
    assert normalise('{"summary": "s", "confidence": null, "score": 91}')["confidence"] == 0.91


def test_risks_as_plain_text_stay(normalise):
    assert normalise('{"narrative": "n", "key_risks": "Some gaps."}')["key_risks"] == ["Some gaps."]
    assert normalise('{"narrative": "n", "key_risks": "Some gaps.", "issues": ["x"]}')["key_risks"] == ["x"]


def test_responses_are_dealt_over_all_cores(spark):
    """A file of one split is parsed by more tasks than one, and all rows stay."""
    from plumbline.plans import experiment

    raw = spark.range(40).coalesce(1).selectExpr("id AS run_id", "'single_agent' AS pipeline", """concat('{"narrative": "n', id, '", "recommendations": ["r"]}') AS text""")
    fallback = spark.createDataFrame([("f", ["k"], ["r"], 0.5)], "narrative string, key_risks array<string>, recommendations array<string>, confidence double")
    done = experiment.parse_responses(raw, fallback)
    assert done.rdd.getNumPartitions() > 1
    assert sorted(r["narrative"] for r in done.select("narrative").collect()) == sorted(f"n{i}" for i in range(40))
