"""Sources, predicates, rules and jobs over the rule table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import EXACT
from plumbline.functions.values import json_safe
from plumbline.operators import rule_table as RT
from plumbline.operators.profile import numeric_columns
from plumbline.operators import violations as V
from plumbline.operators.rules import (
    RuleSpec, check_contract, dry_run, graded, run_rules, run_sql_rules, violation_preview, violation_samples, with_samples,
)
from plumbline.plans.catalog import AS_OF, Lake, as_of, number, query, us, with_control
from plumbline.session import scratch_path, settle
from plumbline.sources import sinks, tables


def union_sql(branches) -> str:
    return "\nUNION ALL\n".join(branches)


def graded_columns(df):
    return df.select(
        "rule_id", "rule_name", "observed_key", number("observed_value"), "status",
        F.coalesce("error_type", F.lit("")).alias("error_type"),
    )


def rules_sql(rows: list[tuple], table: str) -> str:
    """One UNION branch per (id, name, key, aggregate, verdict)."""
    return "\nUNION ALL\n".join(
        f"SELECT CAST({number_} AS BIGINT) AS rule_id, '{name}' AS rule_name, '{key}' AS observed_key, "
        f"CAST({metric} AS DOUBLE) AS observed_value, "
        f"CASE WHEN {metric} {verdict} THEN 'PASS' ELSE 'FAIL' END AS status, '' AS error_type FROM {table}"
        for number_, name, key, metric, verdict in rows
    )


@query("rules_lineitem", rules_sql([
    (1, "discount present", "violation_count", "count(*) FILTER (WHERE d IS NULL)", "= 0"),
    (2, "discount required", "violation_count", "count(*) FILTER (WHERE d IS NULL)", "<= 100000000"),
    (3, "quantity floor", "violation_count", "count(*) FILTER (WHERE l_quantity < 1)", "= 0"),
    (4, "price ceiling", "violation_count", "count(*) FILTER (WHERE l_extendedprice > 90000)", "= 0"),
    (5, "tax range", "violation_count", "count(*) FILTER (WHERE l_tax < 0 OR l_tax > 0.07)", "= 0"),
    (6, "unique order key", "violation_count", "(count(*) - count(DISTINCT l_orderkey))", "= 0"),
    (7, "enough rows", "observed_value", "count(*)", ">= 1000"),
    (8, "not too many rows", "observed_value", "count(*)", "<= 1000"),
], "(SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS d FROM lineitem)"))
def rules_lineitem(lake: Lake):
    df = lake.table("lineitem").withColumn(
        "d", F.when(F.col("l_linenumber") == 7, None).otherwise(F.col("l_discount"))
    )
    return graded_columns(run_rules(df, [
        RuleSpec(1, "discount present", "null_check", "d"),
        RuleSpec(2, "discount required", "not_null_required", "d",
                 expected_type="max_threshold", expected_value=100000000),
        RuleSpec(3, "quantity floor", "min_value", "l_quantity", {"min_value": 1}),
        RuleSpec(4, "price ceiling", "max_value", "l_extendedprice", {"max_value": 90000}),
        RuleSpec(5, "tax range", "range_check", "l_tax", {"min_value": 0, "max_value": 0.07}),
        RuleSpec(6, "unique order key", "uniqueness_check", "l_orderkey"),
        RuleSpec(7, "enough rows", "row_count_min", expected_type="min_threshold", expected_value=1000),
        RuleSpec(8, "not too many rows", "row_count_max", expected_type="max_threshold", expected_value=1000),
    ]))


@query("rule_predicates", rules_sql([
    (1, "excluded range", "violation_count", "count(*) FILTER (WHERE o_totalprice BETWEEN 1000 AND 50000)", "= 0"),
    (2, "expected value", "violation_count", "count(*) FILTER (WHERE o_orderstatus <> 'F')", "= 0"),
    (3, "forbidden value", "violation_count", "count(*) FILTER (WHERE o_orderpriority = '1-URGENT')", "= 0"),
    (4, "below", "violation_count", "count(*) FILTER (WHERE p < 2000)", "= 0"),
    (5, "above", "violation_count", "count(*) FILTER (WHERE p > 400000)", "= 0"),
    (6, "at most", "violation_count", "count(*) FILTER (WHERE p <= 1500.5)", "= 0"),
    (7, "at least", "violation_count", "count(*) FILTER (WHERE p >= 499000)", "<= 5"),
    (8, "future date", "violation_count", "count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1998-08-02')", "= 0"),
    (9, "known status", "violation_count", "count(*) FILTER (WHERE s NOT IN ('F', 'O'))", "= 0"),
    (10, "blank status", "violation_count", "count(*) FILTER (WHERE s IS NULL OR trim(s) = '')", "= 0"),
    (11, "blank and dear", "violation_count",
     "count(*) FILTER (WHERE (s IS NULL OR trim(s) = '') AND p > 100000)", "= 0"),
    (12, "sql condition", "violation_count", "count(*) FILTER (WHERE o_custkey * 2 > o_orderkey)", "= 0"),
], """(SELECT *, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS p,
CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '2-HIGH' THEN '  ' ELSE o_orderstatus END AS s FROM orders)"""))
def rule_predicates(lake: Lake):
    from plumbline.functions.predicates import blank_check, threshold

    low = F.col("o_orderpriority") == "5-LOW"
    df = lake.table("orders").withColumn(
        "p", F.when(low, None).otherwise(F.col("o_totalprice"))
    ).withColumn(
        "s", F.when(low, None).when(F.col("o_orderpriority") == "2-HIGH", "  ").otherwise(F.col("o_orderstatus"))
    )

    def compare(number_, name, op, value, **more):
        return RuleSpec(number_, name, "threshold", "p", {"op": op, "value": value}, **more)

    return graded_columns(run_rules(df, [
        RuleSpec(1, "excluded range", "excluded_range", "o_totalprice", {"low": 1000, "high": 50000}),
        RuleSpec(2, "expected value", "expected_value", "o_orderstatus", {"value": "F"}),
        RuleSpec(3, "forbidden value", "forbidden_value", "o_orderpriority", {"value": "1-URGENT"}),
        compare(4, "below", "<", 2000),
        compare(5, "above", ">", 400000),
        compare(6, "at most", "<=", 1500.5),
        compare(7, "at least", ">=", 499000, expected_type="max_threshold", expected_value=5),
        RuleSpec(8, "future date", "predicate", predicate="o_orderdate > TIMESTAMP '1998-08-02'"),
        RuleSpec(9, "known status", "category_check", "s", {"values": ["F", "O"]}),
        RuleSpec(10, "blank status", "blank_check", "s"),
        RuleSpec(11, "blank and dear", predicate=blank_check("s") & threshold("p", ">", 100000)),
        RuleSpec(12, "sql condition", predicate="o_custkey * 2 > o_orderkey"),
    ]))


@query("future_dates", """
SELECT CAST(date_trunc('year', o_orderdate) AS DATE) AS order_year, count(*) AS violation_count
FROM orders WHERE o_orderdate > TIMESTAMP '1999-06-01' GROUP BY 1""")
def future_dates(lake: Lake):
    from plumbline.functions.predicates import future_date

    moment = F.lit("1999-06-01").cast("timestamp")
    late = lake.table("orders").filter(future_date("o_orderdate", moment))
    return late.groupBy(F.trunc("o_orderdate", "year").alias("order_year")).agg(
        F.count(F.lit(1)).alias("violation_count")
    )


@query("violation_preview", """
SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders
WHERE o_totalprice > 400000 AND o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 50""")
def preview(lake: Lake):
    df = tables.load_columns(
        lake.table("orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    )
    condition = (F.col("o_totalprice") > 400000) & (F.col("o_orderstatus") != "F")
    return violation_preview(df, condition, ["o_orderkey"])


@query("pruned_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-01-01'")
def pruned_scan(lake: Lake):
    df = tables.load(lake.spark, f"{lake.sf_dir}/lineitem.parquet")
    wide = tables.load_columns(df, ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate"])
    return wide.filter("l_shipdate >= TIMESTAMP '2001-01-01'").drop("l_shipdate")


_ALL_TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders",
    "pages", "part", "region", "supplier",
)
#: For each table the number column whose limits are probed.
_PROBED = {
    "benchmark": "item_id", "conversations": "conv_id", "customer": "c_acctbal", "documents": "doc_id", "embeddings": "vec_id",
    "events": "value", "labels": "doc_id", "lineitem": "l_quantity", "nation": "n_nationkey", "orders": "o_totalprice",
    "pages": "page_id", "part": "p_size", "region": "r_regionkey", "supplier": "s_acctbal",
}


@query("table_sizes", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS columns, count(*) AS row_count FROM {t}"
    for t in _ALL_TABLES))
def table_sizes(lake: Lake):
    return tables.table_sizes({t: lake.table(t) for t in _ALL_TABLES})


@query("table_probe", union_sql(
    f"SELECT '{t}' AS table_name, (SELECT count(*) FROM (DESCRIBE {t})) AS columns, count(*) AS row_count, "
    f"'{c}' AS column_name, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high FROM {t}"
    for t, c in _PROBED.items()))
def table_probe(lake: Lake):
    """Row counts and limits of all tables from the footers of their files."""
    return reduce(DataFrame.unionByName, [
        tables.footer_probe(lake.spark, f"{lake.sf_dir}/{t}.parquet", t, [c]) for t, c in _PROBED.items()])


@query("schema_catalog", union_sql(
    f"SELECT '{t}' AS table_name, column_name AS name, row_number() OVER () AS position, CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' "
    f"WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'FLOAT[]' THEN 'array<float>' ELSE 'timestamp' END AS type FROM (DESCRIBE {t})"
    for t in _ALL_TABLES))
def schema_catalog(lake: Lake):
    listed = tables.schema_catalog(lake.spark, {t: lake.table(t) for t in _ALL_TABLES})
    return listed.select("table_name", F.posexplode("columns").alias("i", "c")).select(
        "table_name", F.col("c")["name"].alias("name"), (F.col("i") + 1).cast("long").alias("position"),
        F.regexp_replace(F.col("c")["type"], "_ntz", "").alias("type"))


@query("numeric_scan", """
SELECT * FROM (
  SELECT 'c_custkey' AS column_name, count(c_custkey) AS n FROM customer UNION ALL
  SELECT 'c_nationkey', count(c_nationkey) FROM customer UNION ALL
  SELECT 'c_acctbal', count(c_acctbal) FROM customer)""")
def numeric_scan(lake: Lake):
    df = lake.table("customer")
    names = numeric_columns(df)
    counts = df.agg(*[F.count(c).alias(c) for c in names])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n")) for c in names])
    return counts.select(F.inline(rows))


@query("stored_results", with_control("test_results", """
SELECT CAST(executed_at AS DATE) AS exec_date, status, count(*) AS n, CAST(sum(observed_value) AS DOUBLE) AS total
FROM test_results WHERE executed_at >= TIMESTAMP '2024-01-10' GROUP BY 1, 2"""))
def stored_results(lake: Lake):
    """Append by day, then read back with folder pruning."""
    path = scratch_path(lake.spark, "results")
    sinks.append_results(lake.results().drop("sample_rows"), path)
    stored = lake.spark.read.parquet(path).filter(F.col("exec_date") >= "2024-01-10")
    return stored.groupBy("exec_date", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("observed_value").cast("double").alias("total")
    )


@query("json_safe_rows", with_control("test_results", """
SELECT result_id, status, strftime(executed_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(executed_at) % 1000000 = 0 THEN ''
         ELSE '.' || strftime(executed_at, '%f') END AS executed_at,
       CASE WHEN observed_value = floor(observed_value) THEN CAST(CAST(observed_value AS BIGINT) AS VARCHAR)
            ELSE CAST(CAST(observed_value AS DOUBLE) AS VARCHAR) END AS observed_value
FROM test_results"""))
def json_safe_rows(lake: Lake):
    rows = json_safe(lake.results().select("result_id", "status", "executed_at", "observed_value"))
    return rows.withColumn("executed_at", F.regexp_replace("executed_at", r"\+00:00$", ""))


@query("listed_results", with_control("test_results", """
SELECT result_id, rule_id, CAST(observed_value AS DOUBLE) AS observed_value FROM test_results
WHERE status = 'FAIL' ORDER BY executed_at DESC, result_id DESC LIMIT 100"""))
def listed_results(lake: Lake):
    rows = RT.list_rows(
        lake.results(), [F.desc("executed_at"), F.desc("result_id")], 100, status="FAIL", rule_id=None
    )
    return rows.select("result_id", "rule_id", number("observed_value"))


@query("rules_mentioning", with_control("rules", """
SELECT rule_id, rule_name FROM rules WHERE is_enabled AND sql_text ILIKE '%SALES.Customer%' ORDER BY rule_id LIMIT 3"""))
def rules_mentioning(lake: Lake):
    return RT.rules_mentioning(lake.rules(), "SALES.Customer").select("rule_id", "rule_name")


@query("sql_rules", """
SELECT CAST(1 AS BIGINT) AS rule_id, 'orders without lines' AS rule_name, 'violation_count' AS observed_key,
  CAST((SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) AS DOUBLE) AS observed_value,
  CASE WHEN (SELECT count(*) FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, '' AS error_type
UNION ALL SELECT 2, 'mean discount', 'observed_value', round((SELECT avg(l_discount) FROM lineitem), 6), 'PASS', ''
UNION ALL SELECT 3, 'late ships', 'violation_count', CAST((SELECT count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01') AS DOUBLE), CASE WHEN (SELECT count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01') = 0 THEN 'PASS' ELSE 'FAIL' END, ''
UNION ALL SELECT 4, 'two rows', NULL, NULL, 'ERROR', 'SQL_RESULT_SHAPE_ERROR'
UNION ALL SELECT 5, 'two columns', NULL, NULL, 'ERROR', 'SQL_RESULT_SHAPE_ERROR'
UNION ALL SELECT 6, 'text result', 'violation_count', NULL, 'ERROR', 'SQL_RESULT_TYPE_ERROR'
UNION ALL SELECT 7, 'missing table', NULL, NULL, 'ERROR', 'SQL_EXECUTION_ERROR'
UNION ALL SELECT 8, 'write attempt', NULL, NULL, 'ERROR', 'INVALID_SQL'
UNION ALL SELECT 9, 'hidden write', NULL, NULL, 'ERROR', 'DISALLOWED_SQL'
UNION ALL SELECT 10, 'null result', 'violation_count', NULL, 'ERROR', 'SQL_RESULT_TYPE_ERROR'
UNION ALL SELECT 11, 'divides by zero', NULL, NULL, 'ERROR', 'SQL_EXECUTION_ERROR'
UNION ALL SELECT 12, 'bad cast', NULL, NULL, 'ERROR', 'SQL_EXECUTION_ERROR'
UNION ALL SELECT 13, 'takes too long', NULL, NULL, 'ERROR', 'SQL_TIMEOUT'
UNION ALL SELECT 14, 'fails in foreign code', NULL, NULL, 'ERROR', 'UNKNOWN_ERROR'""")
def sql_rules(lake: Lake):
    for name in ("orders", "lineitem"):
        tables.as_view(lake.table(name), name)
    texts = [
        (RuleSpec(1, "orders without lines"),
         "SELECT COUNT(*) AS violation_count FROM orders o LEFT ANTI JOIN lineitem l ON l.l_orderkey = o.o_orderkey;"),
        (RuleSpec(2, "mean discount", expected_type="max_threshold", expected_value=1),
         "SELECT round(avg(l_discount), 6) AS observed_value FROM lineitem"),
        (RuleSpec(3, "late ships"),
         "SELECT COUNT(*) AS violation_count FROM lineitem WHERE l_shipdate > TIMESTAMP '2001-01-01' -- note"),
        (RuleSpec(4, "two rows"),
         "SELECT COUNT(*) AS violation_count FROM orders GROUP BY o_orderstatus"),
        (RuleSpec(5, "two columns"), "SELECT COUNT(*) AS violation_count, 1 AS x FROM orders"),
        (RuleSpec(6, "text result"), "SELECT max(o_orderstatus) AS violation_count FROM orders"),
        (RuleSpec(7, "missing table"), "SELECT COUNT(*) AS violation_count FROM no_such_table"),
        (RuleSpec(8, "write attempt"), "DROP TABLE orders"),
        (RuleSpec(9, "hidden write"), "SELECT COUNT(*) AS violation_count FROM orders WHERE DELETE = 1"),
        (RuleSpec(10, "null result"),
         "SELECT max(o_totalprice) AS violation_count FROM orders WHERE o_orderkey < 0"),
        (RuleSpec(11, "divides by zero"), "SELECT max(1 / (o_orderkey - o_orderkey)) AS violation_count FROM orders"),
        (RuleSpec(12, "bad cast"), "SELECT max(CAST(o_orderstatus AS INT)) AS violation_count FROM orders"),
        (RuleSpec(13, "takes too long", params={"timeout_s": 0.5}),
         "SELECT sum(o_orderkey + id % 7) AS violation_count FROM range(4000000000000000) LEFT JOIN orders ON o_orderkey = id"),
        (RuleSpec(14, "fails in foreign code"),
         "SELECT CAST(java_method('java.lang.Integer', 'parseInt', m) AS INT) AS violation_count FROM (SELECT max(o_orderstatus) AS m FROM orders)"),
    ]
    return graded_columns(run_sql_rules(lake.spark, texts))


_ISOLATED = [
    (1, "price present", "violation_count", "count(*) FILTER (WHERE o_totalprice IS NULL)", "= 0"),
    (2, "urgent and dear", "violation_count", "count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)", "= 0"),
    (5, "unique key", "violation_count", "(count(*) - count(DISTINCT o_orderkey))", "= 0"),
    (6, "enough rows", "observed_value", "count(*)", ">= 100"),
] + [(10 + k, f"customer {k}", "violation_count", f"count(*) FILTER (WHERE o_custkey % 43 = {k})", ">= 1") for k in range(43)]


@query("rules_isolated", rules_sql(_ISOLATED, "orders") + """
UNION ALL SELECT 3, 'bad cast', NULL, NULL, 'ERROR', 'SQL_EXECUTION_ERROR'
UNION ALL SELECT 4, 'no such column', NULL, NULL, 'ERROR', 'SQL_EXECUTION_ERROR'""")
def rules_isolated(lake: Lake):
    """Two rules that cannot be evaluated among 49 leave the other 47 their results."""
    return graded_columns(run_rules(lake.table("orders"), [
        RuleSpec(1, "price present", "null_check", "o_totalprice"),
        RuleSpec(2, "urgent and dear", predicate="o_orderpriority = '1-URGENT' AND o_totalprice > 300000"),
        RuleSpec(3, "bad cast", predicate="CAST(o_orderstatus AS INT) > 0"),
        RuleSpec(4, "no such column", "null_check", "o_nothing"),
        RuleSpec(5, "unique key", "uniqueness_check", "o_orderkey"),
        RuleSpec(6, "enough rows", "row_count_min", expected_type="min_threshold", expected_value=100),
        *(RuleSpec(10 + k, f"customer {k}", predicate=f"o_custkey % 43 = {k}", expected_type="min_threshold", expected_value=1)
          for k in range(43)),
    ]))


_SAMPLED = """
WITH hits AS (
  SELECT CAST(1 AS BIGINT) AS rule_id, * FROM orders WHERE o_totalprice < 0 OR o_totalprice > 300000
  UNION ALL SELECT 2, * FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
  UNION ALL SELECT 4, * FROM orders WHERE o_custkey % 11 = 3 AND o_orderpriority = '5-LOW'),
sampled AS (
  SELECT rule_id, CAST(row_number() OVER (PARTITION BY rule_id ORDER BY o_orderkey) AS INTEGER) AS place, o_orderkey, o_custkey, o_orderpriority
  FROM hits QUALIFY place <= 50)
"""


def _sampled_rules(lake: Lake):
    specs = [
        RuleSpec(1, "price range", "range_check", "o_totalprice", {"min_value": 0, "max_value": 300000}),
        RuleSpec(2, "known status", "category_check", "o_orderstatus", {"values": ["F", "O"]}),
        RuleSpec(3, "key present", "null_check", "o_orderkey"),
        RuleSpec(4, "low priority", predicate="o_custkey % 11 = 3 AND o_orderpriority = '5-LOW'"),
        RuleSpec(5, "few rows", "row_count_max", expected_type="max_threshold", expected_value=1),
    ]
    orders = lake.table("orders")
    results = settle(run_rules(orders, specs, executed_at=as_of()))
    failed = {r[0] for r in results.filter("status = 'FAIL'").select("rule_id").collect()}  # a number a rule
    shown = ["o_orderkey", "o_custkey", "o_orderpriority"]
    samples = violation_samples(orders, [s for s in specs if s.rule_id in failed], ["o_orderkey"])
    return results, samples.select("rule_id", "place", F.struct(*[F.col("row")[c].alias(c) for c in shown]).alias("row"))


@query("failed_rule_samples", _SAMPLED + "SELECT * FROM sampled")
def failed_rule_samples(lake: Lake):
    return _sampled_rules(lake)[1].select("rule_id", "place", "row.*")


@query("sampled_failures", _SAMPLED + """
, texts AS (
  SELECT rule_id, '[' || string_agg('{"o_custkey":"' || o_custkey || '","o_orderkey":"' || o_orderkey || '","o_orderpriority":"' || o_orderpriority || '"}', ',' ORDER BY place) || ']' AS shown,
         count(*) AS n FROM sampled GROUP BY rule_id
  UNION ALL SELECT 5, '', 0)
SELECT rule_id, 'FAIL' AS status, n AS samples, sha256(CAST(rule_id AS VARCHAR) || ':FAIL:' || shown) AS fingerprint, TRUE AS is_new,
       epoch_us(TIMESTAMP '2024-01-31 00:00:00') AS executed_at FROM texts""")
def sampled_failures(lake: Lake):
    """Results of a run as the violations they become: sample rows give the fingerprint, and dedup takes it."""
    results, samples = _sampled_rules(lake)
    failed = V.with_policy(V.failures(with_samples(results, samples)), lake.policies().limit(0)).withColumn("result_id", F.col("rule_id"))
    ready = failed.withColumn("fingerprint", V.fingerprint(F.col("rule_id"), F.col("status"), F.col("sample_rows")))
    return V.dedup(ready).select(
        "rule_id", "status", F.size("sample_rows").cast("long").alias("samples"), "fingerprint", "is_new", us("executed_at"))


@query("dry_run_rows", """
SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 3""")
def dry_run_rows(lake: Lake):
    tables.as_view(lake.table("orders"), "orders")
    rows, _ = dry_run(lake.spark, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1;", 3)
    return rows


_CONTRACTS = (
    ("SELECT COUNT(*) AS violation_count FROM orders WHERE o_orderkey > 5", "kept"),
    ("SELECT COUNT(*) AS n FROM orders", "name"),
    ("SELECT COUNT(*) AS violation_count, 1 AS more FROM orders", "columns"),
    ("SELECT COUNT(*) AS violation_count FROM no_such_table", "analysis"),
    ("DELETE FROM orders", "INVALID_SQL"),
    ("SELECT pg_sleep(1) AS violation_count", "DISALLOWED_SQL_FUNCTION"),
)


@query("rule_contracts", " UNION ALL ".join(
    f"SELECT '{sql}' AS sql_text, '{outcome}' AS outcome, (SELECT count(*) FROM orders) AS orders" for sql, outcome in _CONTRACTS))
def rule_contracts(lake: Lake):
    """What a rule's text breaks, found without running it."""
    tables.as_view(lake.table("orders"), "orders")

    def outcome(sql: str) -> str:
        found = check_contract(lake.spark, sql)
        if found is None:
            return "kept"
        kinds = {"SQL_EXECUTION_ERROR": "analysis", "Expected exactly one result column": "columns", "The column must be named": "name"}
        return next((kind for start, kind in kinds.items() if found.startswith(start)), found)

    told = lake.spark.createDataFrame([(sql, outcome(sql)) for sql, _ in _CONTRACTS], "sql_text string, outcome string")
    return told.withColumn("orders", F.lit(lake.table("orders").count()))


@query("graded_results", with_control("test_results rules", """
SELECT r.result_id, r.rule_id, u.expected_result_type AS expected_type,
  CASE WHEN r.observed_value IS NULL THEN 'ERROR'
       WHEN CASE u.expected_result_type WHEN 'zero_violations' THEN r.observed_value = 0
              WHEN 'min_threshold' THEN r.observed_value >= u.expected_result_value
              WHEN 'max_threshold' THEN r.observed_value <= u.expected_result_value
              ELSE r.observed_value = u.expected_result_value END THEN 'PASS' ELSE 'FAIL' END AS status,
  CASE WHEN r.observed_value IS NULL THEN 'SQL_RESULT_TYPE_ERROR' ELSE '' END AS error_type
FROM test_results r JOIN rules u USING (rule_id)"""))
def graded_results(lake: Lake):
    limits = lake.rules().select(
        "rule_id", F.col("expected_result_type").alias("expected_type"),
        F.col("expected_result_value").alias("expected_value"),
    )
    values = lake.results().select("result_id", "rule_id", F.col("observed_value").cast(EXACT))
    return graded(values.join(limits, "rule_id")).select(
        "result_id", "rule_id", "expected_type", "status",
        F.coalesce("error_type", F.lit("")).alias("error_type"),
    )


_Q = r"""''[^'']*(?:''|\z)|"[^"]*(?:"|\z)"""
_C = r"""--[^\r\n]*|/\*(?s:.*?)(?:\*/|\z)"""
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _audit_sql(source: str, key: str, text: str, strict: bool) -> str:
    stripped = _TRIM.format(rf"regexp_replace({text}, '({_Q})|{_C}', '\1', 'g')")
    body = _TRIM.format(r"regexp_replace(stripped, ';\z', '')")
    extra = rf"""
       WHEN regexp_matches(upper_masked, 'SELECT\s+\*\s+FROM') THEN 'AI_SELECT_STAR_BLOCKED'
       WHEN regexp_matches(upper_masked, '{"|".join(RT.STRICT_KEYWORDS)}') THEN 'AI_KEYWORD_BLOCKED'
       WHEN regexp_matches(remarks, '{"|".join(RT.COMMENT_ARTIFACTS)}') THEN 'AI_INJECTION_ARTIFACT'
       WHEN NOT contains(upper_masked, 'VIOLATION_COUNT') THEN 'AI_MISSING_ALIAS'""" if strict else ""
    return rf"""audited AS (
  SELECT {key}, stripped, regexp_replace(stripped, '{_Q}', '""', 'g') AS shown,
    regexp_replace({body}, '{_Q}', '  ', 'g') AS masked,
    upper(regexp_replace(stripped, '{_Q}', '  ', 'g')) AS upper_masked,
    lower(array_to_string(list_filter(regexp_extract_all({text}, '{_Q}|{_C}'), lambda x: starts_with(x, '--') OR starts_with(x, '/*')), ' ')) AS remarks
  FROM (SELECT *, {stripped} AS stripped FROM {source}))
SELECT {key}, CASE WHEN stripped = '' THEN 'INVALID_SQL' WHEN regexp_matches(shown, ';\s*\S') THEN 'INVALID_SQL'
       WHEN upper(regexp_extract(masked, '{_L}([A-Za-z_][A-Za-z0-9_]*){_R}', 1)) <> 'SELECT' THEN 'INVALID_SQL'
       WHEN regexp_matches(masked, '(?i){_L}(?:{"|".join(RT.FORBIDDEN_STATEMENTS)}){_R}') THEN 'DISALLOWED_SQL'
       WHEN regexp_matches(masked, '(?i){_L}(?:{"|".join(RT.FORBIDDEN_FUNCTIONS)})\s*\(') THEN 'DISALLOWED_SQL_FUNCTION'{extra}
       ELSE 'OK' END AS audit_code
FROM audited"""


@query("rule_audit", with_control("rules", "") .rstrip() + ", " + _audit_sql("rules", "rule_id", "sql_text", False))
def rule_audit(lake: Lake):
    return RT.audit_rules(lake.rules(dealt=True)).select(
        "rule_id", F.coalesce("audit_code", F.lit("OK")).alias("audit_code")
    )


@query("rule_audit_strict", with_control("rules", "").rstrip() + ", " + _audit_sql("rules", "rule_id", "sql_text", True))
def rule_audit_strict(lake: Lake):
    return RT.audit_rules(lake.rules(dealt=True), strict=True).select(
        "rule_id", F.coalesce("audit_code", F.lit("OK")).alias("audit_code")
    )


@query("text_audit", "WITH " + _audit_sql("(SELECT doc_id, 'SELECT ' || text AS sql_text FROM documents)", "doc_id", "sql_text", True))
def text_audit(lake: Lake):
    """The audit over whole documents as rule bodies: long texts with every kind of quote."""
    texts = lake.texts("documents").select("doc_id", F.concat(F.lit("SELECT "), "text").alias("sql_text"))
    return RT.audit_rules(texts, strict=True).select(
        "doc_id", F.coalesce("audit_code", F.lit("OK")).alias("audit_code")
    )


_FINGERPRINT = rf"""fp AS (
  SELECT *, sha256(CAST(to_json({{'database_connection_id': database_connection_id,
    'expected_result': {{'type': expected_result_type, 'value': CAST(expected_result_value AS VARCHAR)}},
    'sql': array_to_string(list_transform(regexp_extract_all(flat, '{_Q}|[^''"]+'),
       lambda x: CASE WHEN starts_with(x, '''') OR starts_with(x, '"') THEN x ELSE lower(x) END), '')}}) AS VARCHAR)) AS rule_fingerprint
  FROM (SELECT *, {_TRIM.format(r"regexp_replace(body, '\s+', ' ', 'g')")} AS flat
        FROM (SELECT *, {_TRIM.format(r"regexp_replace(stripped, ';\z', '')")} AS body
              FROM (SELECT *, {_TRIM.format(rf"regexp_replace(sql_text, '({_Q})|{_C}', '\1', 'g')")} AS stripped FROM rules))))"""


def fingerprint_sql(body: str) -> str:
    return with_control("rules", "").rstrip() + ", " + _FINGERPRINT + body


@query("rule_fingerprints", fingerprint_sql("SELECT rule_id, rule_fingerprint FROM fp"))
def rule_fingerprints(lake: Lake):
    return RT.with_fingerprint(lake.rules(dealt=True)).select("rule_id", "rule_fingerprint")


@query("rule_duplicates", fingerprint_sql("""
SELECT rule_fingerprint, min(rule_id) AS first_rule_id, count(*) AS copies FROM fp
GROUP BY rule_fingerprint HAVING count(*) > 1"""))
def rule_duplicates(lake: Lake):
    return RT.duplicate_rules(lake.rules(dealt=True))


_STATUS = """CASE WHEN NOT is_enabled THEN 'disabled' WHEN schedule_cron IS NULL OR trim(schedule_cron) = '' THEN 'missing_schedule'
  WHEN schedule_cron IN ('every day', '61 * * * *') THEN 'invalid_cron' ELSE 'schedulable' END"""


@query("schedule_status", with_control("rules", f"SELECT rule_id, {_STATUS} AS scheduler_status FROM rules"))
def schedule_status(lake: Lake):
    status = RT.schedule_status(F.col("is_enabled"), F.col("schedule_cron"))
    return lake.rules().select("rule_id", status.alias("scheduler_status"))


@query("active_rules", fingerprint_sql(f"""
SELECT min(rule_id) AS rule_id FROM fp WHERE {_STATUS} = 'schedulable' GROUP BY rule_fingerprint"""))
def active_rules(lake: Lake):
    return RT.active_rules(lake.rules(dealt=True)).select("rule_id")


@query("deleted_rules", with_control("rules test_results", """
SELECT 'rules' AS part, r.severity AS label, count(*) AS n FROM rules r WHERE r.severity <> 'low' GROUP BY 2
UNION ALL
SELECT 'results', CASE WHEN u.severity = 'low' THEN 'detached' ELSE 'kept' END, count(*)
FROM test_results t LEFT JOIN rules u USING (rule_id) GROUP BY 2"""))
def deleted_rules(lake: Lake):
    rules = lake.rules()
    kept, results = RT.delete_rules(rules, lake.results(), rules.filter(F.col("severity") == "low"))
    label = F.when(F.col("rule_id").isNull(), "detached").otherwise("kept")
    return kept.groupBy(F.lit("rules").alias("part"), F.col("severity").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    ).unionByName(
        results.groupBy(F.lit("results").alias("part"), label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )


@query("updated_rules", with_control("rules", f"""
SELECT rule_id, CASE WHEN database_connection_id IS NULL THEN NULL ELSE schedule_cron END AS schedule_cron,
       CASE WHEN database_connection_id IS NULL AND severity = 'low' THEN 'medium' ELSE severity END AS severity,
       is_enabled, CASE WHEN database_connection_id IS NULL THEN epoch_us(TIMESTAMP '{AS_OF}')
                        ELSE epoch_us(TIMESTAMP '2024-01-01') END AS updated_at
FROM rules"""))
def updated_rules(lake: Lake):
    rules = lake.rules()
    patches = rules.filter(F.col("database_connection_id").isNull()).select(
        "rule_id",
        F.lit(None).cast("string").alias("schedule_cron"),
        F.lit(True).alias("set_schedule_cron"),
        F.when(F.col("severity") == "low", "medium").alias("severity"),
    )
    return RT.update_rules(rules, patches, as_of()).select(
        "rule_id", "schedule_cron", "severity", "is_enabled", us("updated_at")
    )


@query("paused_rules", with_control("rules", """
SELECT table_name, count(*) FILTER (WHERE is_enabled AND severity <> 'critical') AS enabled, count(*) AS rules
FROM rules GROUP BY table_name"""))
def paused_rules(lake: Lake):
    rules = lake.rules()
    paused = RT.set_enabled(rules, rules.filter(F.col("severity") == "critical"), False, as_of())
    return paused.groupBy("table_name").agg(
        F.count_if("is_enabled").alias("enabled"), F.count(F.lit(1)).alias("rules")
    )
