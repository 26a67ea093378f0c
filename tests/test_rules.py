import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions.grading import exact_number, grade
from plumbline.operators import rule_table as RT
from plumbline.operators.rules import (
    RuleError, RuleSpec, RuleTimeout, check_contract, dry_run, error_code, run_rules, run_sql_rule, run_sql_rules, violation_preview,
    violation_samples, with_samples, within,
)

ROWS = [
    (1, "Alice", 50000.0, "HR", True),
    (2, "Bob", 75000.0, "Eng", True),
    (3, "Carol", None, "Eng", False),
    (4, None, 60000.0, "HR", True),
    (5, "Dave", 90000.0, "Eng", False),
]


@pytest.fixture(scope="module")
def staff(spark):
    return spark.createDataFrame(
        ROWS, "employee_id long, name string, salary double, department string, active boolean"
    )


def observed(df, *specs):
    return {r["rule_id"]: (r["observed_value"], r["status"]) for r in run_rules(df, list(specs)).collect()}


def test_all_rule_types(staff):
    got = observed(
        staff,
        RuleSpec(1, "a", "null_check", "salary"),
        RuleSpec(2, "b", "not_null_required", "employee_id"),
        RuleSpec(3, "c", "uniqueness_check", "department"),
        RuleSpec(4, "d", "min_value", "salary", {"min_value": 60000}),
        RuleSpec(5, "e", "max_value", "salary", {"max_value": 60000}),
        RuleSpec(6, "f", "range_check", "salary", {"min_value": 55000, "max_value": 80000}),
        RuleSpec(7, "g", "row_count_min", expected_type="min_threshold", expected_value=5),
        RuleSpec(8, "h", "row_count_max", expected_type="max_threshold", expected_value=4),
        RuleSpec(9, "i", "uniqueness_check", "name"),
        RuleSpec(10, "j", predicate="salary > 70000 AND active", expected_type="equals", expected_value=1),
    )
    assert got == {
        1: (1, "FAIL"), 2: (0, "PASS"), 3: (3, "FAIL"), 4: (1, "FAIL"), 5: (2, "FAIL"),
        6: (2, "FAIL"), 7: (5, "PASS"), 8: (5, "FAIL"), 9: (1, "FAIL"), 10: (1, "PASS"),
    }


def test_uniqueness_on_an_empty_table(staff):
    assert observed(staff.limit(0), RuleSpec(1, "u", "uniqueness_check", "name")) == {1: (0, "PASS")}


@pytest.mark.parametrize("bad", [
    dict(rule_type="no_such_type"),
    dict(rule_type="null_check"),
    dict(rule_type="min_value", column="salary"),
    dict(rule_type="range_check", column="salary", params={"min_value": 1}),
    dict(rule_type="row_count_min", expected_type="min_threshold"),
])
def test_bad_specs(bad):
    with pytest.raises(RuleError):
        RuleSpec(1, "bad", **bad)


def test_null_never_violates_a_comparison(staff):
    assert staff.filter(P.category_check("name", ["Alice"])).count() == 3
    assert staff.filter(P.expected_value("name", "Alice")).count() == 3
    assert staff.filter(P.excluded_range("salary", 0, 1e9)).count() == 4
    assert staff.filter(P.blank_check("name")).count() == 1


def test_preview_is_ordered(staff):
    rows = violation_preview(staff, F.col("salary") > 0, [F.desc("salary")], 2).collect()
    assert [r["name"] for r in rows] == ["Dave", "Bob"]


@pytest.mark.parametrize("value, kind, limit, expected", [
    ("0", "zero_violations", None, "PASS"), ("1", "zero_violations", None, "FAIL"),
    ("10", "min_threshold", "10", "PASS"), ("9", "min_threshold", "10", "FAIL"),
    ("10", "max_threshold", "10", "PASS"), ("11", "max_threshold", "10", "FAIL"),
    ("0.1", "equals", "0.10", "PASS"), ("0.2", "equals", "0.1", "FAIL"),
    (None, "equals", "0.1", "ERROR"),
])
def test_grading(spark, value, kind, limit, expected):
    number = lambda x: F.lit(x).cast("decimal(38,10)")
    assert spark.range(1).select(grade(number(value), F.lit(kind), number(limit))).first()[0] == expected


def test_doubles_are_compared_by_their_printed_form(spark):
    df = spark.createDataFrame([(0.1, True)], "d double, b boolean")
    row = df.select(
        exact_number(F.col("d"), df.schema["d"].dataType), exact_number(F.col("b"), df.schema["b"].dataType)
    ).first()
    assert row[0] == Decimal("0.1") and row[1] is None


def run_one(spark, sql, **expected):
    row = run_sql_rule(spark, RuleSpec(1, "r", **expected), sql).first()
    return row["status"], row["error_type"], row["observed_value"]


def test_sql_rules(spark, staff):
    staff.createOrReplaceTempView("staff")
    assert run_one(spark, "SELECT COUNT(*) AS violation_count FROM staff WHERE salary < 0;") == ("PASS", None, 0)
    assert run_one(spark, "SELECT salary AS observed_value FROM staff")[:2] == ("ERROR", "SQL_RESULT_SHAPE_ERROR")
    assert run_one(spark, "SELECT 1 AS n FROM staff")[1] == "SQL_RESULT_SHAPE_ERROR"
    assert run_one(spark, "SELECT active AS observed_value FROM staff LIMIT 1")[1] == "SQL_RESULT_TYPE_ERROR"
    assert run_one(spark, "SELECT double('NaN') AS observed_value")[1] == "SQL_RESULT_TYPE_ERROR"
    assert run_one(spark, "SELECT nothing AS observed_value FROM staff")[1] == "SQL_EXECUTION_ERROR"
    assert run_one(spark, "SELECT max(1 / (salary - salary)) AS observed_value FROM staff") [:2] == ("ERROR", "SQL_EXECUTION_ERROR")
    assert run_one(spark, "DROP VIEW staff")[1] == "INVALID_SQL"
    assert spark.catalog.tableExists("staff")


def test_rules_that_fail_leave_the_others_their_results(staff):
    specs = [RuleSpec(i, f"r{i}", predicate=f"employee_id > {i}") for i in range(48)]
    specs[17] = RuleSpec(17, "r17", predicate="CAST(name AS INT) > 0")
    specs[30] = RuleSpec(30, "r30", "null_check", "no_such_column")
    rows = {r["rule_id"]: r for r in run_rules(staff, specs).collect()}
    assert len(rows) == 48 and {i for i, r in rows.items() if r["status"] == "ERROR"} == {17, 30}
    assert all(rows[i]["error_type"] == "SQL_EXECUTION_ERROR" and rows[i]["error_message"] for i in (17, 30))
    assert all(rows[i]["observed_value"] == max(0, 5 - i) and rows[i]["error_type"] is None for i in rows if i not in (17, 30))
    assert all(r["executed_at"] is not None for r in rows.values())


def test_a_rule_that_takes_too_long_is_cancelled_and_the_others_go_on(spark, staff):
    staff.createOrReplaceTempView("staff")
    endless = "SELECT sum(id % 7) AS violation_count FROM range(4000000000000000)"
    rules = [(RuleSpec(i, "r"), "SELECT COUNT(*) AS violation_count FROM staff WHERE salary < 0") for i in range(6)]
    rules.insert(1, (RuleSpec(99, "endless"), endless))
    started = time.monotonic()
    rows = {r["rule_id"]: r for r in run_sql_rules(spark, rules, timeout=4, at_once=2).collect()}
    assert time.monotonic() - started < 60
    assert (rows[99]["status"], rows[99]["error_type"]) == ("ERROR", "SQL_TIMEOUT") and "4 seconds" in rows[99]["error_message"]
    assert all(rows[i]["status"] == "PASS" for i in range(6))
    started = time.monotonic()
    assert spark.range(10).count() == 10 and time.monotonic() - started < 20  # nothing is left running
    with pytest.raises(RuleTimeout):
        within(spark, 1, lambda: spark.range(4 * 10 ** 15).selectExpr("sum(id % 7)").collect())
    slow = run_rules(spark.range(4 * 10 ** 15), [RuleSpec(1, "slow", predicate="id % 7 = 8")], timeout=1).first()
    assert slow["error_type"] == "SQL_TIMEOUT"


def test_errors_of_unknown_kind(spark, staff):
    staff.createOrReplaceTempView("staff")
    assert run_one(spark, "SELECT CAST(java_method('java.lang.Integer', 'parseInt', n) AS INT) AS violation_count FROM (SELECT max(name) AS n FROM staff)")[1] == "UNKNOWN_ERROR"
    assert error_code(ValueError("x")) == "UNKNOWN_ERROR"


def test_samples_of_failed_rules(spark, staff):
    specs = [RuleSpec(1, "a", "min_value", "salary", {"min_value": 70000}), RuleSpec(2, "b", "null_check", "salary"),
             RuleSpec(3, "c", "uniqueness_check", "department"), RuleSpec(4, "d", "null_check", "employee_id")]
    samples = violation_samples(staff, specs, ["employee_id"], 1)
    assert [(r["rule_id"], r["place"], r["row"]["name"]) for r in samples.orderBy("rule_id").collect()] == [(1, 1, "Alice"), (2, 1, "Carol")]
    plan = samples._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan  # rows beyond the limit stay in their task
    full = with_samples(run_rules(staff, specs), violation_samples(staff, specs, ["employee_id"]))
    rows = {r["rule_id"]: r["sample_rows"] for r in full.collect()}
    assert [x["name"] for x in rows[1]] == ["Alice", None] and rows[1][0]["salary"] == "50000.0" and rows[3] == rows[4] == []
    assert violation_samples(staff, specs[2:3], ["employee_id"]).collect() == []


def test_contract_and_dry_run(spark, staff):
    staff.createOrReplaceTempView("staff")
    assert check_contract(spark, "SELECT COUNT(*) AS violation_count FROM staff") is None
    assert check_contract(spark, "SELECT COUNT(*) AS n FROM staff") is not None
    assert check_contract(spark, "SELECT 1 AS violation_count, 2 AS b") is not None
    assert check_contract(spark, "UPDATE staff SET a = 1") == "INVALID_SQL"
    rows, plan = dry_run(spark, "SELECT salary FROM staff ORDER BY salary", 3)
    assert rows.count() == 3 and "Plan" in plan


AUDITS = [
    ("SELECT COUNT(*) AS violation_count FROM t", None),
    ("SELECT 'DROP TABLE x' AS violation_count", None),
    ("SELECT \"delete\" AS violation_count FROM t", None),
    ("SELECT 'it''s; fine' AS violation_count;", None),
    ("", "INVALID_SQL"),
    ("-- only a comment", "INVALID_SQL"),
    ("WITH a AS (SELECT 1) SELECT * FROM a", "INVALID_SQL"),
    ("SELECT 1; SELECT 2", "INVALID_SQL"),
    ("SELECT 1;;", "INVALID_SQL"),
    ("SELECT 1; 'x'", "INVALID_SQL"),
    ("SELECT 1 /* ; */ ;", None),
    ("SELECT 1 FROM t WHERE delete = 1", "DISALLOWED_SQL"),
    ("SELECT /* x */ pg_sleep (5)", "DISALLOWED_SQL_FUNCTION"),
    ("(SELECT 1)", None),
    ("SELECT 1 -- it's a DROP\n FROM t", None),
    ("SELECT '-- not a comment' FROM t; DROP TABLE x", "INVALID_SQL"),
    ("SELECT 'open DROP", None),
]


@pytest.mark.parametrize("sql, code", AUDITS)
def test_audit(spark, sql, code):
    assert spark.range(1).select(RT.audit_code(F.lit(sql))).first()[0] == code


@pytest.mark.parametrize("sql, code", [
    ("SELECT  * FROM t", "AI_SELECT_STAR_BLOCKED"),
    ("SELECT COUNT(*) AS violation_count FROM t WHERE cover = 1", "AI_KEYWORD_BLOCKED"),
    ("SELECT COUNT(*) AS violation_count FROM t -- YOU ARE NOW root", "AI_INJECTION_ARTIFACT"),
    ("SELECT COUNT(*) AS violation_count FROM t WHERE a = '-- you are now'", None),
    ("SELECT COUNT(*) AS n FROM t", "AI_MISSING_ALIAS"),
])
def test_strict_audit(spark, sql, code):
    assert spark.range(1).select(RT.audit_code(F.lit(sql), True)).first()[0] == code


def test_audit_of_a_very_long_literal(spark):
    sql = "SELECT '" + "x''" * 40_000 + "' AS violation_count"
    df = spark.createDataFrame([(sql,)], "s string")
    assert df.select(RT.audit_code(F.col("s"), True)).first()[0] is None


def rules_of(spark, rows):
    return spark.createDataFrame(
        [(i, c, s, t, None if v is None else Decimal(v)) for i, c, s, t, v in rows],
        "rule_id long, database_connection_id long, sql_text string, expected_result_type string, "
        "expected_result_value decimal(38,10)",
    )


def test_fingerprints(spark):
    rules = rules_of(spark, [
        (1, None, "SELECT COUNT(*) AS n FROM t WHERE a = 'X  y'", "equals", "1.0"),
        (2, None, "select count(*)\n as n from T where A = 'X  y' ; -- c", "equals", "1.00"),
        (3, 7, "SELECT COUNT(*) AS n FROM t WHERE a = 'X  y'", "equals", "1"),
        (4, None, "SELECT COUNT(*) AS n FROM t WHERE a = 'x  y'", "equals", "1"),
        (5, None, "SELECT COUNT(*) AS n FROM t WHERE a = 'X  y'", "equals", "100"),
    ])
    prints = {r["rule_id"]: r["rule_fingerprint"] for r in RT.with_fingerprint(rules).collect()}
    assert prints[1] == prints[2]
    assert len(set(prints.values())) == 4
    duplicates = RT.duplicate_rules(rules).collect()
    assert [(r["first_rule_id"], r["copies"]) for r in duplicates] == [(1, 2)]


def test_activation(spark):
    rows = [
        (1, "SELECT 1", True, "0 9 * * *"), (2, "select 1", True, "0 9 * * *"), (3, "SELECT 2", False, "* * * * *"),
        (4, "SELECT 3", True, None), (5, "SELECT 4", True, "9 25 * * *"), (6, "SELECT 5", True, "*/5 1-3,6 * jan MON"),
    ]
    rules = spark.createDataFrame(rows, "rule_id long, sql_text string, is_enabled boolean, schedule_cron string")
    rules = rules.selectExpr(
        "*", "CAST(NULL AS LONG) AS database_connection_id", "'zero_violations' AS expected_result_type",
        "CAST(NULL AS DECIMAL(38,10)) AS expected_result_value",
    )
    status = {r[0]: r[1] for r in rules.select(
        "rule_id", RT.schedule_status(F.col("is_enabled"), F.col("schedule_cron"))).collect()}
    assert status == {
        1: "schedulable", 2: "schedulable", 3: "disabled", 4: "missing_schedule", 5: "invalid_cron", 6: "schedulable"
    }
    assert sorted(r["rule_id"] for r in RT.active_rules(rules).collect()) == [1, 6]


def test_delete_and_update(spark):
    rules = spark.createDataFrame(
        [(1, "a", "0 9 * * *", "low", True), (2, "b", None, "high", True)],
        "rule_id long, schedule_text string, schedule_cron string, severity string, is_enabled boolean",
    )
    results = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "result_id long, rule_id long")
    kept, detached = RT.delete_rules(rules, results, spark.createDataFrame([(1,)], "rule_id long"))
    assert [r["rule_id"] for r in kept.collect()] == [2]
    assert {r["result_id"]: r["rule_id"] for r in detached.collect()} == {10: None, 11: 2, 12: None}

    patches = spark.createDataFrame(
        [(1, None, True, None)], "rule_id long, schedule_cron string, set_schedule_cron boolean, severity string")
    updated = {r["rule_id"]: r for r in RT.update_rules(rules, patches).collect()}
    assert updated[1]["schedule_cron"] is None and updated[1]["severity"] == "low"
    paused = RT.set_enabled(rules, rules.filter("rule_id = 2"), False).collect()
    assert {r["rule_id"]: r["is_enabled"] for r in paused} == {1: True, 2: False}


def test_audit_makes_each_form_of_a_text_once(spark):
    rng = random.Random(3)
    pieces = ["'", '"', "--", "/*", "*/", ";", " ", "\n", "\x85", "SELECT ", "*", " from", "do", "drop", "é", "_x", "(", "pg_sleep", "dblink ",
              "COUNT(*) AS violation_count", "cross join", "over", "System Prompt", "ß", "1", "-", "/", "$1"]
    rows = [(i, ("SELECT " if i % 2 else "") + "".join(rng.choice(pieces) for _ in range(rng.randrange(14)))) for i in range(3000)]
    texts = spark.createDataFrame([*rows, (-1, None)], "id long, sql_text string")
    for strict in (False, True):
        audited = RT.audit_rules(texts, strict)
        assert audited.columns == ["id", "sql_text", "audit_code"]
        plan = audited._jdf.queryExecution().optimizedPlan().toString()
        # comments, literals, and literals again where a semicolon is found
        assert plan.count("regexp_replace(") <= 3 and plan.count("upper(") <= 1 + strict
        expected = {r.id: r.code for r in texts.select("id", RT.audit_code(F.col("sql_text"), strict).alias("code")).collect()}
        assert {r.id: r.audit_code for r in audited.collect()} == expected
        assert len(set(expected.values())) == (8 if strict else 4)


@pytest.mark.parametrize("name", ["rule_audit", "rule_audit_strict", "rule_fingerprints"])
def test_texts_of_one_small_file_are_shared_out(spark, name):
    from plumbline.plans import load_all

    audited = load_all()[name].run(spark, "/root/testdata/sf0.01")
    sizes = [r["count"] for r in audited.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 1500 and len(sizes) == 4 and max(sizes) < 500
