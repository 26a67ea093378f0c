from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.operators import reports as R
from plumbline.operators import scoring as S
from plumbline.operators import violations as V
from plumbline.operators.suggest import apply_suggestions

NOW = datetime(2024, 2, 1)


def as_of():
    return F.lit(NOW).cast("timestamp")


def results_of(spark, counts):
    rows, number = [], 0
    for rule, status, n, days in counts:
        for _ in range(n):
            number += 1
            rows.append((number, rule, status, NOW - timedelta(days=days)))
    return spark.createDataFrame(rows, "result_id long, rule_id long, status string, executed_at timestamp")


def feedback_of(spark, rows):
    return spark.createDataFrame(
        [(i, rule, kind, text, NOW - timedelta(days=days)) for i, (rule, kind, text, days) in enumerate(rows)],
        "id long, rule_id long, feedback_type string, edited_summary string, created_at timestamp")


def test_scores(spark):
    rules = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, True)], "rule_id long, is_enabled boolean")
    results = results_of(spark, [
        (1, "FAIL", 6, 1), (1, "PASS", 4, 1), (1, "FAIL", 50, 31), (2, "FAIL", 2, 1), (2, "PASS", 8, 1), (4, "ERROR", 9, 2)])
    feedback = feedback_of(spark, [
        (1, "reject", None, 1), (1, "accept", None, 1), (2, "reject", None, 40), (2, "accept", None, 1), (5, "reject", None, 1)])
    got = {r["rule_id"]: (r["quality_score"], r["is_noisy"], r["false_positive_rate"])
           for r in S.score_rules(rules, results, feedback, as_of()).collect()}
    assert got == {
        1: (75.0, True, 16.67), 2: (95.0, False, 0.0), 4: (100.0, False, 0.0), 5: (70.0, True, 100.0)}


def test_evidence_and_gate(spark):
    rules = spark.createDataFrame([(1, "a", "s1", 0.0), (2, "b", "s2", 9.0), (3, "c", "s3", None)],
                                  "rule_id long, rule_name string, sql_text string, false_positive_rate double")
    results = results_of(spark, [(1, "FAIL", 4, 1), (3, "FAIL", 5, 1)])
    feedback = feedback_of(spark, [(1, "reject", None, 9)] + [(1, "edit", f"e{i}", i) for i in range(1, 7)])
    rows = {r["rule_id"]: r for r in S.needs_review(S.improvement_evidence(rules, results, feedback, as_of())).collect()}
    assert rows[1]["human_corrections"] == "- e1\n- e2\n- e3\n- e4\n- e5" and rows[1]["rejections"] == 0
    assert rows[2]["human_corrections"] == "None recorded."
    assert rows[3]["sql_text"] == "s3"
    assert {k: r["review"] for k, r in rows.items()} == {1: "none", 2: "review", 3: "review"}


def test_evidence_works_the_rate_out_as_the_scores_do(spark):
    rules = spark.createDataFrame([(i, f"r{i}", f"s{i}", i % 4 != 3 if i % 5 else None) for i in range(40)],
                                  "rule_id long, rule_name string, sql_text string, is_enabled boolean")
    results = results_of(spark, [(i, ("FAIL", "PASS", "ERROR")[i % 3], 20 + i, i) for i in range(40)])
    kinds = ("reject", "edit", "annotate", "accept")
    feedback = feedback_of(spark, [(i % 13, kinds[(i * i + i // 13) % 4], ("", None, f"t{i}")[i % 3], i % 41) for i in range(400)])
    scores = S.score_rules(rules, results, feedback, as_of()).select("rule_id", "false_positive_rate")
    given = S.improvement_evidence(rules.join(scores, "rule_id", "left"), results, feedback, as_of())
    own = S.improvement_evidence(rules, results, feedback, as_of())
    assert own.columns == given.columns and sorted(map(tuple, own.collect()), key=repr) == sorted(map(tuple, given.collect()), key=repr)
    assert len({r["false_positive_rate"] for r in own.collect()}) > 3


def sorts_and_scans(spark, name):
    """Of a query's plan when no table is small enough to be sent to all tasks."""
    from plumbline.plans import load_all

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = load_all()[name].run(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    return plan.count(" Sort ["), plan.count("FileScan parquet")


def test_evidence_puts_feedback_in_order_once(spark):
    sorts, scans = sorts_and_scans(spark, "improvement_evidence")
    assert sorts <= 6 and scans <= 4  # rules, executions, first failures, feedback by rule and by time


def test_the_gate_sorts_no_more_than_the_evidence(spark):
    sorts, scans = sorts_and_scans(spark, "needs_review")
    assert sorts <= 7 and scans <= 4  # the counts alone are hashed, and put in order for the join


def test_evidence_and_gate_sort_each_input_once(spark):
    for name in ("improvement_evidence", "needs_review"):
        assert sorts_and_scans(spark, name) == (4, 4)  # rules, executions, first failures, feedback


def test_feedback_before_the_first_failure_is_no_evidence(spark):
    rules = spark.createDataFrame([(i, f"r{i}", f"s{i}", i % 4 != 3) for i in range(14)],
                                  "rule_id long, rule_name string, sql_text string, is_enabled boolean")
    # some rules never fail, one fails after all feedback, others before the trailing days, between or with a feedback row
    results = results_of(spark, [(i, "PASS", 2, 29) for i in range(14)] + [
        (i, ("FAIL", "ERROR")[i % 2], 1 + i, (0, 40, 5, 10, 12, 30, 3)[i % 7]) for i in range(13) if i % 5])
    kinds = ("reject", "edit", "annotate", "accept")
    given = [(i % 13 if i % 17 else None, kinds[(i * i + i // 13) % 4], ("", None, f"t{i}")[i % 3], 1 + i * i % 37) for i in range(400)]
    feedback = feedback_of(spark, given)
    failed = V.failures(results)
    linked = V.in_some_batch(failed, feedback, "created_at")
    known = sorted(map(tuple, S.improvement_evidence(rules, results, linked, as_of()).collect()))
    own = sorted(map(tuple, S.improvement_evidence(rules, results, feedback, as_of(), V.first_failures(failed)).collect()))
    assert own == known

    first = {r["rule_id"]: r["first_failure"] for r in V.first_failures(failed).collect()}
    fails = {r["rule_id"]: r["fails"] for r in S.execution_stats(results, as_of()).collect()}
    for rule, _, _, rate, _, failures, rejections, corrections in own:
        rows = sorted(((days, -i, kind, text) for i, (r, kind, text, days) in enumerate(given)
                       if r == rule and days < 30 and rule in first and NOW - timedelta(days=days) >= first[rule]))
        rejects = sum(kind == "reject" for _, _, kind, _ in rows)
        texts = [f"- {text}" for _, _, kind, text in rows[:5] if kind in ("edit", "annotate") and text]
        assert failures == fails[rule] and rejections == sum(kind == "reject" for _, _, kind, _ in rows[:5])
        assert corrections == ("\n".join(texts) or "None recorded.")
        assert rate == (None if rule % 4 == 3 else round(min(100.0, rejects / max(1, failures) * 100), 2))
    assert len({r[3] for r in own}) > 3 and len({r[6] for r in own}) > 2 and len({r[7] for r in own}) > 5


def test_override(spark):
    summaries = spark.createDataFrame(
        [(1, 1, "first", ["f"]), (2, 2, "second", ["g"])], "id long, rule_id long, summary string, suggested_fixes array<string>")
    feedback = spark.createDataFrame(
        [(1, 1, 1, "accept", None, '["h"]', "ann", NOW), (2, 1, 1, "annotate", None, None, "bob", NOW + timedelta(1)),
         (3, 2, 2, "reject", "x", None, "cat", NOW)],
        "id long, rule_id long, llm_summary_id long, feedback_type string, edited_summary string, edited_fixes string, user_id string, created_at timestamp")
    rows = {r["id"]: r for r in S.apply_human_override(summaries, feedback).collect()}
    assert rows[1]["summary"] == (
        "Human-validated interpretation:\nfirst\n\nOriginally AI-generated, corrected by: ann\nConfidence: High")
    assert rows[1]["suggested_fixes"] == ["h"] and rows[1]["confidence"] == "High (Human Validated)"
    assert rows[2]["summary"] == "second" and rows[2]["suggested_fixes"] == ["g"]


def test_approval(spark):
    generations = spark.sql(
        "SELECT * FROM VALUES (1L, 'a', false), (2L, 'b', true), (3L, 'c', false) t(id, generated_sql, approved)").selectExpr(
        "*", "'old' AS approved_by", "CAST(NULL AS STRING) AS reviewed_sql", "false AS edited_after_generation",
        "CAST(NULL AS TIMESTAMP) AS approval_timestamp")
    reviews = spark.createDataFrame([(1, "a2", "ann"), (2, "b2", "ann")], "id long, reviewed_sql string, approved_by string")
    got = {r["id"]: (r["approved"], r["approved_by"], r["edited_after_generation"]) for r in S.approve(generations, reviews).collect()}
    assert got == {1: (True, "ann", True), 2: (True, "old", False), 3: (False, "old", False)}


def test_apply_suggestions(spark):
    schema = "suggestion_id long, table_name string, suggested_rule_name string, suggested_sql string, expected_result_type string, expected_result_value decimal(38,10), applied boolean"
    suggestions = spark.createDataFrame([
        (1, "t", "n", "SELECT 1", "zero_violations", None, False), (2, "t", "n", "select  1;", "zero_violations", None, False),
        (3, "t", "n", "SELECT 2", "zero_violations", None, False), (4, "t", "n", "SELECT 3", "zero_violations", None, True)], schema)
    rules = spark.sql("SELECT 'select 2' AS sql_text, CAST(NULL AS LONG) AS database_connection_id, 'zero_violations' AS expected_result_type, CAST(NULL AS DECIMAL(38,10)) AS expected_result_value")
    new, moved = apply_suggestions(suggestions, rules, suggestions)
    assert [r["suggestion_id"] for r in new.collect()] == [1]
    assert {r["suggestion_id"]: r["applied"] for r in moved.collect()} == {1: True, 2: False, 3: False, 4: True}


def test_metrics_of_nothing(spark):
    batches = spark.createDataFrame([], "status string")
    summaries = spark.createDataFrame([], "parsing_failure boolean, token_usage int")
    row = R.system_metrics(batches, summaries, batches).first()
    assert tuple(row) == (0, 0, 0, 0, 0, 0.0, 0.0, 0.0, 0.0)


def test_feedback_with_its_summary(spark):
    summaries = spark.createDataFrame(
        [(1, 1, 1, "old", '["f"]', None, NOW), (2, 1, 1, "new", "broken", "high", NOW + timedelta(1))],
        "id long, rule_id long, batch_no long, summary string, suggested_fixes string, effective_confidence string, created_at timestamp")
    feedback = spark.createDataFrame(
        [(9, 1, 1, '["x"]'), (10, 1, 2, None)], "id long, rule_id long, batch_no long, edited_fixes string")
    linked = R.attach_feedback(feedback, summaries)
    rows = R.feedback_history(linked, summaries).collect()
    assert [(r["id"], r["llm_summary_id"], r["original_summary"], r["original_fixes"], r["edited_fixes_list"], r["confidence_level"])
            for r in rows] == [(9, 2, "new", [], ["x"], "high")]
