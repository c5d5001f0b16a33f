import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ledgerweave.plans import evaluation, scoring
from ledgerweave.plans import scorecard as cards
from ledgerweave.plans.suite import run_suite, suite_totals
from ledgerweave.sources import records

GOLDEN = "scenario_id string, gold_label string, ambiguity_expected boolean, action_policy string, " \
    "required_scope_tables array<string>, required_relationships array<string>, " \
    "ontology_signals array<string>, gold_numeric_value double, gold_numeric_tolerance_pct double"
ANSWER = "scenario_id string, agent_type string, answer string, reasoning string, " \
    "sql_or_gql string, metric_selected string, tables_used array<string>, " \
    "relationships_used array<string>, ambiguity_flagged boolean, action_policy string, error string"


def score(spark, golden=None, answer=None):
    """Score one answer; the guardrail is off unless the golden answer asks for it."""
    fields = [f.split()[0] for f in GOLDEN.split(", ")]
    wanted = {"scenario_id": "Q", "action_policy": "", **(golden or {})}
    given = {"scenario_id": "Q", "agent_type": "naked", **(answer or {})}
    names = [f.split()[0] for f in ANSWER.split(", ")]
    g = spark.createDataFrame([tuple(wanted.get(f) for f in fields)], GOLDEN)
    a = spark.createDataFrame([tuple(given.get(n) for n in names)], ANSWER)
    return scoring.score_answers(a, g).first()


def result(row):
    return row.total_score, row.max_score, row.notes


def test_nothing_expected(spark):
    assert result(score(spark)) == (0, 0, "all correct")


def test_metric(spark):
    want = {"gold_label": "npe_ratio"}
    right = score(spark, want, {"metric_selected": "npe_ratio"})
    assert right.metric_correct and result(right) == (1, 1, "all correct")
    wrong = score(spark, want, {"metric_selected": "default_count"})
    assert result(wrong) == (0, 1, "metric: expected 'npe_ratio' got 'default_count'")
    assert score(spark, {"gold_label": "graph_traversal"}).max_score == 0


def test_tables_and_relationships(spark):
    want = {"required_scope_tables": ["loan", "borrower"], "required_relationships": ["r2", "r1"]}
    ok = score(
        spark,
        want,
        {"tables_used": ["loan", "borrower", "noise"], "relationships_used": ["r1", "r2"]},
    )
    assert ok.tables_correct and ok.relationships_correct and result(ok) == (2, 2, "all correct")
    assert result(score(spark, want, {"tables_used": ["loan"]})) == (
        0,
        2,
        "tables missing: ['borrower']; relationships missing: ['r1', 'r2']",
    )


def test_ambiguity_and_guardrail(spark):
    want = {"ambiguity_expected": True, "action_policy": "recommend_only"}
    assert result(
        score(spark, want, {"ambiguity_flagged": True, "action_policy": "recommend_only"})
    ) == (2, 2, "all correct")
    assert result(score(spark, want)) == (
        0,
        2,
        "ambiguity not detected; guardrail violated: execute",
    )


def test_numeric_and_signals(spark):
    want = {
        "gold_numeric_value": 17.52,
        "gold_numeric_tolerance_pct": 2.0,
        "ontology_signals": ["NPE", "non-performing"],
    }
    right = score(spark, want, {"answer": "The NPE (non performing) ratio is 17.5%"})
    assert right.numeric_correct and right.signals_correct and right.total_score == 2
    assert result(score(spark, want, {"answer": "npe 16.13"})) == (
        0,
        2,
        "signals missing: ['non-performing']; numeric: expected ~17.52 (±2.0%)",
    )


@pytest.mark.parametrize("said, points", [("yes", 1), ("no", 0), ("unclear", 0)])
def test_critic_is_one_dimension(spark, said, points):
    row = score(spark, answer={"reasoning": f"__critic_verdict__={said}\n", "error": "late"})
    assert result(row) == (points, 1, f"error: late; critic: {said}")


def test_answers_without_golden_answer_are_left_out(spark):
    g = spark.createDataFrame([], GOLDEN)
    a = spark.createDataFrame([("Q", "naked")], "scenario_id string, agent_type string")
    assert scoring.score_answers(a, g).count() == 0


def test_inference_keeps_what_is_stated(spark):
    a = spark.createDataFrame(
        [
            ("1", "naked", "FROM p_loan", ["stated"], "recommend_only", True),
            ("2", "naked", "I will join p_borrower; unclear", None, "execute", None),
        ],
        "scenario_id string, agent_type string, answer string, tables_used array<string>, "
        "action_policy string, ambiguity_flagged boolean",
    )
    one, two = sorted(
        scoring.infer_metadata(a, ["p_loan"], strip_prefix="p_").collect(),
        key=lambda r: r.scenario_id,
    )
    assert one.tables_used == ["stated"] and one.action_policy == "recommend_only"
    assert one.ambiguity_flagged is True
    assert two.tables_used == ["borrower"] and two.action_policy == "execute"
    assert two.ambiguity_flagged is True and two.metric_selected == ""


def test_latest_message(spark):
    m = spark.createDataFrame(
        [
            (1, 0, "user", "q"),
            (1, 1, "assistant", "old"),
            (1, 3, "assistant", "  new\n"),
            (1, 4, "user", "thanks"),
            (2, 0, "user", "q"),
            (3, 0, "assistant", "  "),
        ],
        "c long, turn int, role string, body string",
    )
    last = scoring.latest_answers(m, "c", "turn", "role", "body", "answer")
    assert rows(last) == [(1, "new"), (2, "<empty>"), (3, "<empty>")]


# -- Comparison file to scorecard ----------------------------------------------------


@pytest.fixture(scope="module")
def comparison(spark, tmp_path_factory):
    def scenario(sid, **more):
        return {"scenario_id": sid, "domain": "sanity", "user_question": "?", "unknown": 1, **more}

    def asked(sid, naked, ontology, **more):
        return {
            "scenario_id": sid,
            "actual_answer_naked": naked,
            "actual_answer_ontology": ontology,
            **more,
        }

    record = {
        "stage": "test",
        "scenariosSha256": "ff",
        "scenariosPayload": [
            scenario("Q1", required_scope_tables=["loan"], ontology_signals=["loan"]),
            scenario("Q2", domain="guardrail", ambiguity_expected=True),
            scenario("Q3"),
        ],
        "perQuestion": [
            asked(
                "Q1",
                "FROM loan, I recommend it",
                "nothing",
                evaluation_judgement_naked=True,
                evaluation_judgement_ontology=False,
            ),
            asked("Q2", "I will start", "please specify; I suggest", evaluation_status_naked="unclear"),
        ],
    }
    path = tmp_path_factory.mktemp("comparison") / "c.json"
    path.write_text(json.dumps(record, indent=2), encoding="utf-8")
    return records.read_comparison(spark, str(path)).cache()


@pytest.fixture(scope="module")
def scores(comparison):
    answers = scoring.answers_from_questions(records.questions_of(comparison))
    inferred = scoring.infer_metadata(answers, ["loan"])
    return scoring.score_answers(
        inferred, records.golden_answers(records.scenarios_of(comparison))
    ).cache()


def test_scenarios_have_defaults(comparison):
    found = records.scenarios_of(comparison).where("scenario_id = 'Q3'").first()
    assert found.action_policy == "recommend_only" and found.ontology_signals == []
    assert found.gold_numeric_tolerance_pct == 1.0 and found.gold_numeric_value is None
    assert found.ambiguity_expected is False and found.expected_join_hops == 0


def test_scores_of_a_comparison(scores):
    found = {(r.scenario_id, r.agent_type): result(r) for r in scores.collect()}
    assert found == {
        ("Q1", "naked"): (4, 4, "critic: yes"),
        (
            "Q1",
            "ontology",
        ): (
            0,
            4,
            "critic: no; tables missing: ['loan']; guardrail violated: execute; "
            "signals missing: ['loan']",
        ),
        # an "unclear" judgement is itself a hint of ambiguity
        ("Q2", "naked"): (1, 3, "critic: unclear; guardrail violated: execute"),
        ("Q2", "ontology"): (2, 2, "all correct"),
    }


def test_card(spark, comparison, scores):
    only = spark.createDataFrame([("Q9", "naked")], "scenario_id string, agent_type string")
    golden = spark.createDataFrame([("Q9",) + (None,) * 8], GOLDEN)
    alone = scoring.score_answers(only, golden)
    card = cards.scorecard(scores.unionByName(alone), records.scenarios_of(comparison))
    found = {r.scenario_id: r.asDict() for r in card.collect()}
    assert found["Q1"]["naked_result"] == "4/4" and found["Q1"]["winner"] == "Naked"
    assert found["Q2"]["winner"] == "Ontology" and found["Q2"]["domain"] == "guardrail"
    assert found["Q2"]["notes"] == "N: critic: unclear; guardrail violated: execute"
    assert found["Q9"]["ontology_result"] == "-" and found["Q9"]["winner"] == "-"
    assert found["Q9"]["domain"] == ""
    totals = cards.scorecard_totals(card)
    assert rows(totals) == [("Naked", 5, 7, "71%"), ("Ontology", 2, 6, "33%")]
    nothing = cards.scorecard_totals(card.where("scenario_id = 'Q9'"))
    assert rows(nothing) == [("Naked", 0, 0, "-"), ("Ontology", 0, 0, "-")]


def test_percent_rounds_half_to_even(spark):
    card = spark.createDataFrame(
        [("tie", 1, 8, 3, 8)],
        "winner string, naked_total int, naked_max int, ontology_total int, ontology_max int",
    )
    assert [r.accuracy for r in cards.scorecard_totals(card).collect()] == ["12%", "38%"]


def test_agent_accuracy(spark):
    v = spark.createDataFrame(
        [("a", True), ("a", False), ("a", None), ("a", True), ("b", None)],
        "agent string, ok boolean",
    )
    assert rows(cards.agent_accuracy(v, "agent", "ok")) == [
        ("a", 2, 3, 1, 4, 66.7),
        ("b", 0, 0, 1, 1, 0.0),
    ]


def test_question_rows(spark):
    scenarios = spark.createDataFrame(
        [("Q1", "d", "?", "m", ["Loan", "write_off"]), ("Q2", "d", "?", "", []), ("Q3", "d", "?", "", ["x"])],
        "scenario_id string, domain string, user_question string, gold_label string, "
        "ontology_signals array<string>",
    )
    answers = spark.createDataFrame(
        [
            ("Q1", "naked", "a loan"),
            ("Q1", "ontology", "Loan: write-off"),
            ("Q2", "naked", "?"),
            ("Q2", "ontology", None),
            ("Q9", "naked", "lost"),
        ],
        "scenario_id string, agent_type string, answer string",
    )
    questions = evaluation.question_rows(scenarios, answers)
    found = {r.scenario_id: r for r in questions.collect()}
    assert found["Q1"].evaluation_judgement_naked is False
    assert found["Q1"].missing_signals_naked == ["write_off"]
    assert found["Q1"].matched_signals_ontology == ["Loan", "write_off"]
    assert found["Q2"].evaluation_judgement_naked is None
    assert found["Q3"].actual_answer_naked is None and len(found) == 3
    assert rows(evaluation.agent_summary(questions)) == [
        ("naked", 0, 1, 2, 3, 0.0),
        ("ontology", 1, 1, 2, 3, 100.0),
    ]


def test_evaluate(spark, comparison):
    done = evaluation.evaluate(comparison, ["loan"])
    assert rows(done.totals) == [("Naked", 5, 7, "71%"), ("Ontology", 2, 6, "33%")]
    assert done.note is None and done.card.count() == 2
    other = records.scenarios_of(comparison).withColumn("domain", F.lit("moved"))
    with pytest.raises(ValueError, match="does not match"):
        evaluation.evaluate(comparison, scenarios=other)
    assert "accepted" in evaluation.evaluate(comparison, scenarios=other, override=True).note
    same = records.scenarios_of(comparison).orderBy(F.desc("scenario_id"))
    assert evaluation.evaluate(comparison, scenarios=same).note is None
    bare = comparison.withColumn("scenariosPayload", F.expr("slice(scenariosPayload, 1, 0)"))
    with pytest.raises(ValueError, match="no scenarios"):
        evaluation.evaluate(bare)
    fewer = comparison.withColumn("scenariosPayload", F.expr("slice(scenariosPayload, 1, 1)"))
    with pytest.raises(ValueError, match="unknown_id"):
        evaluation.evaluate(fewer)


# -- Integrity ---------------------------------------------------------------------------


def test_ids(spark):
    known = spark.createDataFrame([("Q1",), ("Q2",), ("Q3",)], "id string")

    def anomalies(*ids):
        asked = spark.createDataFrame([(i,) for i in ids], "sid string")
        return cards.id_anomalies(asked, "sid", known, "id")

    assert {r.anomaly: r.n for r in anomalies("Q1", "Q1", None, "", "Q9").collect()} == {
        "missing_id": 2,
        "duplicate_id": 1,
        "unknown_id": 1,
        "unanswered_id": 2,
    }
    cards.require_sound_ids(anomalies("Q1"))
    for bad in (("Q1", "Q1"), (None,), ("Q9",)):
        with pytest.raises(ValueError):
            cards.require_sound_ids(anomalies(*bad))


def test_fingerprint(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    same = a.select("v", "k").orderBy(F.desc("k"))
    assert cards.fingerprint(a).first() == cards.fingerprint(same).first()
    for other in (a.limit(1), a.union(a), a.withColumn("v", F.lit("x"))):
        with pytest.raises(ValueError):
            cards.require_same_payload(cards.fingerprint(a), cards.fingerprint(other))
    note = cards.require_same_payload(
        cards.fingerprint(a), cards.fingerprint(a.limit(1)), override=True
    )
    assert "does not match" in note
    assert cards.require_same_payload(cards.fingerprint(a), cards.fingerprint(same)) is None


def test_file_digest(spark, tmp_path):
    import hashlib

    (tmp_path / "a.json").write_bytes(b"[1]\n")
    found = cards.file_digests(spark, str(tmp_path)).first()
    assert found.sha256 == hashlib.sha256(b"[1]\n").hexdigest()


def test_sinks(spark, scores, tmp_path):
    records.write_records(scores, str(tmp_path / "json"), by="agent_type")
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    records.write_table(scores, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def test_records_by_line(spark, comparison, tmp_path):
    asked, scenarios = records.questions_of(comparison), records.scenarios_of(comparison)
    records.write_records(asked, str(tmp_path / "asked"))
    records.write_records(scenarios, str(tmp_path / "scenarios"))
    done = evaluation.evaluate_questions(
        records.read_questions(spark, str(tmp_path / "asked")),
        records.read_scenarios(spark, str(tmp_path / "scenarios"), lines=True),
        ["loan"],
    )
    assert rows(done.totals) == [("Naked", 5, 7, "71%"), ("Ontology", 2, 6, "33%")]


def test_scenario_file(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"scenario_id": "Q1", "new": 2}]), "utf-8")
    golden = records.read_golden_answers(spark, str(tmp_path)).first()
    assert golden.scenario_id == "Q1" and golden.action_policy == "recommend_only"


def test_suite(spark):
    report = run_suite(
        spark,
        {
            "good": lambda: spark.range(20),
            "late": lambda: spark.range(1).select(F.raise_error(F.lit("no"))),
            "early": lambda: spark.table("not_there"),
        },
    )
    found = {r.query: r for r in report.collect()}
    assert found["good"].row_count == 20 and found["good"].columns == ["id"]
    assert len(found["good"].preview) == 10
    again = {"other order": lambda: spark.range(20).orderBy(F.desc("id")).repartition(5)}
    again |= {"one less": lambda: spark.range(19), "one twice": lambda: spark.range(19).union(spark.range(1))}
    digests = {r.query: r.digest for r in run_suite(spark, again, preview=0).collect()}
    assert digests["other order"] == found["good"].digest
    assert len({found["good"].digest, digests["one less"], digests["one twice"]}) == 3
    assert found["late"].status == found["early"].status == "failed"
    assert rows(suite_totals(report)) == [(1, 2, 3)]


def test_many_comparisons(spark, tmp_path):
    one = '{"stage": "a", "perQuestion": [{"scenario_id": "Q1"}, {"scenario_id": "Q2"}], "scenariosPayload": []}'
    two = '{"stage": "b", "perQuestion": [], "scenariosPayload": [{"scenario_id": "Q3", "domain": "d"}]}'
    payloads = spark.createDataFrame([(1, one), (2, two), (3, "no record"), (4, None)], "n int, payload string")
    found = records.parse_comparisons(payloads, "payload")
    assert rows(found.select("n", "stage")) == [(1, "a"), (2, "b"), (3, None), (4, None)]
    assert rows(records.questions_of(found).select("n", "scenario_id")) == [(1, "Q1"), (1, "Q2")]
    assert rows(records.scenarios_of(found).select("n", "scenario_id", "action_policy")) == [(2, "Q3", "recommend_only")]
    for name, text in (("1.json", one.replace(", ", ",\n")), ("2.json", two + "\n\n")):
        (tmp_path / name).write_text(text)
    assert rows(records.read_comparison(spark, str(tmp_path)).select("stage")) == [("a",), ("b",)]
    (tmp_path / "lines").write_text(one + "\n" + two + "\n")
    assert records.questions_of(records.read_comparison(spark, str(tmp_path / "lines"), lines=True)).count() == 2
