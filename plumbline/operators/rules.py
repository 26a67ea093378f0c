"""Running and grading validation rules."""

from __future__ import annotations

import itertools
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions import predicates as P
from plumbline.functions.grading import EXACT, EXPECTATION_TYPES, error_type, exact_number, grade
from plumbline.operators.rule_table import audit_code, without_trailing_semicolon

OBSERVED_NAMES = ("violation_count", "observed_value")

# Seconds a rule's statement may take, and rows shown of a failed rule.
STATEMENT_TIMEOUT_S = 15.0
SAMPLE_ROWS = 50

_COLUMN_RULES = (
    "null_check", "not_null_required", "uniqueness_check", "min_value", "max_value", "range_check",
)
_TABLE_RULES = ("row_count_min", "row_count_max")
RULE_TYPES = _COLUMN_RULES + _TABLE_RULES

_MORE_PREDICATES = (
    "excluded_range", "expected_value", "forbidden_value", "threshold", "future_date",
    "category_check", "blank_check", "predicate",
)


class RuleError(ValueError):
    """A rule specification that cannot be compiled."""


@dataclass(frozen=True)
class RuleSpec:
    """One rule. *predicate* (a ``Column`` or SQL condition) selects the violating rows of a
    ``predicate`` rule; the other types take their values from *params*."""

    rule_id: int
    rule_name: str
    rule_type: str = "predicate"
    column: str | None = None
    params: dict[str, Any] = field(default_factory=dict)
    predicate: Column | str | None = None
    expected_type: str = "zero_violations"
    expected_value: Any = None
    severity: str = "medium"

    def __post_init__(self):
        if self.rule_type not in RULE_TYPES + _MORE_PREDICATES:
            raise RuleError(f"unsupported rule type: {self.rule_type}")
        if self.rule_type in _COLUMN_RULES and not self.column:
            raise RuleError(f"{self.rule_type} needs a column")
        if self.expected_type not in EXPECTATION_TYPES:
            raise RuleError(f"unsupported expectation: {self.expected_type}")
        if self.expected_type != "zero_violations" and self.expected_value is None:
            raise RuleError(f"{self.expected_type} needs a value")
        for name in _REQUIRED.get(self.rule_type, ()):
            if self.params.get(name) is None:
                raise RuleError(f"{self.rule_type} needs the parameter {name}")

    @property
    def observed_key(self) -> str:
        return "observed_value" if self.rule_type in _TABLE_RULES else "violation_count"

    def violates(self) -> Column:
        """Condition that holds for the violating rows."""
        given = self.params
        match self.rule_type:
            case "null_check" | "not_null_required":
                return P.null_check(self.column)
            case "min_value":
                return P.min_value(self.column, given["min_value"])
            case "max_value":
                return P.max_value(self.column, given["max_value"])
            case "range_check":
                return P.range_check(self.column, given["min_value"], given["max_value"])
            case "excluded_range":
                return P.excluded_range(self.column, given["low"], given["high"])
            case "expected_value":
                return P.expected_value(self.column, given["value"])
            case "forbidden_value":
                return P.forbidden_value(self.column, given["value"])
            case "threshold":
                return P.threshold(self.column, given["op"], given["value"])
            case "future_date":
                return P.future_date(self.column, given.get("as_of"))
            case "category_check":
                return P.category_check(self.column, given["values"])
            case "blank_check":
                return P.blank_check(self.column)
            case "predicate":
                if isinstance(self.predicate, str):
                    return F.expr(self.predicate)
                return self.predicate
        raise RuleError(f"{self.rule_type} has no row condition")


_REQUIRED = {
    "min_value": ("min_value",),
    "max_value": ("max_value",),
    "range_check": ("min_value", "max_value"),
    "excluded_range": ("low", "high"),
    "expected_value": ("value",),
    "forbidden_value": ("value",),
    "threshold": ("op", "value"),
    "category_check": ("values",),
}


def row_count() -> Column:
    return F.count(F.lit(1))


def uniqueness_check(column: str) -> Column:
    """Rows minus distinct values, so every NULL counts as a violation."""
    return F.count(F.lit(1)) - F.count_distinct(F.col(column))


def approx_uniqueness_check(column: str, rsd: float = 0.01) -> Column:
    """Opt-in estimate for tables where an exact distinct count is too dear."""
    return F.count(F.lit(1)) - F.approx_count_distinct(F.col(column), rsd)


def _spec_row(spec: RuleSpec, observed: Column) -> Column:
    limit = None if spec.expected_value is None else str(spec.expected_value)
    return F.struct(
        F.lit(spec.rule_id).cast("long").alias("rule_id"),
        F.lit(spec.rule_name).alias("rule_name"),
        F.lit(spec.severity).alias("severity"),
        F.lit(spec.observed_key).alias("observed_key"),
        observed.cast(EXACT).alias("observed_value"),
        F.lit(spec.expected_type).alias("expected_type"),
        F.lit(limit).cast(EXACT).alias("expected_value"),
    )


def observe_rules(df: DataFrame, specs: list[RuleSpec], approx: bool = False) -> DataFrame:
    """Observed value of each rule, one row per rule.

    All row conditions and counts are one aggregate over one scan. Exact distinct counts go into
    a second one: in the same aggregate they would multiply every row by the number of rules.
    """
    if not specs:
        raise RuleError("no rules given")
    plain = [s for s in specs if s.rule_type != "uniqueness_check" or approx]
    distinct = [s for s in specs if s.rule_type == "uniqueness_check" and not approx]
    parts = []
    if plain:
        metrics = []
        for index, spec in enumerate(plain):
            if spec.rule_type in _TABLE_RULES:
                metric = row_count()
            elif spec.rule_type == "uniqueness_check":
                metric = approx_uniqueness_check(spec.column)
            else:
                metric = F.count_if(spec.violates())
            metrics.append(metric.alias(f"m{index}"))
        rows = F.array(*[_spec_row(s, F.col(f"m{i}")) for i, s in enumerate(plain)])
        parts.append(df.agg(*metrics).select(F.inline(rows)))
    for spec in distinct:
        # count per value first: the distinct values spread over all tasks and a value held by
        # most rows is already merged before the shuffle
        counts = df.groupBy(F.col(spec.column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        excess = F.coalesce(F.sum("n"), F.lit(0)) - F.count("v")
        parts.append(counts.agg(excess.alias("m")).select(F.inline(F.array(_spec_row(spec, F.col("m"))))))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def graded(df: DataFrame) -> DataFrame:
    """Add status and error_type from observed_value, expected_type and expected_value."""
    value, kind, limit = F.col("observed_value"), F.col("expected_type"), F.col("expected_value")
    return df.withColumn("status", grade(value, kind, limit)).withColumn(
        "error_type", error_type(value, kind, limit)
    )


_tags = itertools.count()


class RuleTimeout(Exception):
    """The jobs of a rule were cancelled because its time was up."""


def within(spark: SparkSession, seconds: float | None, work: Callable[[], Any]) -> Any:
    """``work()``, whose Spark jobs are cancelled after *seconds*; then RuleTimeout. Jobs of other threads go on: those of
    this call carry a tag of their own."""
    if seconds is None:
        return work()
    context, tag, over, expired = spark.sparkContext, f"plumbline-rule-{next(_tags)}", threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            expired.set()
            while not over.wait(0.2):  # also the jobs that the work starts later
                context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        found = work()
    except Exception as error:
        if expired.is_set():
            raise RuleTimeout(f"cancelled after {seconds:g} seconds") from error
        raise
    finally:
        over.set()
        context.removeJobTag(tag)
        watcher.join()
    return found


def error_code(error: Exception) -> str:
    """The error type of a rule that could not be evaluated."""
    if isinstance(error, RuleTimeout):
        return "SQL_TIMEOUT"
    known = isinstance(error, PySparkException) and "PythonException" not in type(error).__name__
    return "SQL_EXECUTION_ERROR" if known else "UNKNOWN_ERROR"


_OUTCOME = (
    "rule_id long, rule_name string, severity string, observed_key string, observed_value decimal(38,10), "
    "expected_type string, expected_value decimal(38,10), error_type string, error_message string"
)


def _failed(spec: RuleSpec, error: Exception) -> tuple:
    limit = None if spec.expected_value is None else Decimal(str(spec.expected_value))
    return (spec.rule_id, spec.rule_name, spec.severity, None, None, spec.expected_type, limit, error_code(error), _short(error))


def _tested(df: DataFrame, specs: list[RuleSpec], approx: bool, timeout: float | None) -> list[tuple]:
    """Outcomes of *specs* from one scan; when that fails, of each half. So k specs that cannot be evaluated cost about
    2 k log n more scans, and all others are evaluated together."""
    try:
        rows = within(df.sparkSession, timeout, lambda: observe_rules(df, specs, approx).collect())  # a row a rule
    except Exception as error:
        if len(specs) == 1:
            return [_failed(specs[0], error)]
        half = len(specs) // 2
        return _tested(df, specs[:half], approx, timeout) + _tested(df, specs[half:], approx, timeout)
    return [(*row, None, None) for row in rows]


def _closed(spark: SparkSession, outcomes: list[tuple], executed_at: Column | None) -> DataFrame:
    """Outcomes with status, the error of those without a verdict, and the time of the run."""
    value, kind, limit = F.col("observed_value"), F.col("expected_type"), F.col("expected_value")
    without_verdict = F.when(error_type(value, kind, limit).isNotNull(), "the observed value is not a usable number")
    return spark.createDataFrame(outcomes, _OUTCOME).withColumns({
        "status": F.when(F.col("error_type").isNotNull(), "ERROR").otherwise(grade(value, kind, limit)),
        "error_message": F.coalesce("error_message", F.when(F.col("error_type").isNull(), without_verdict)),
        "error_type": F.coalesce("error_type", error_type(value, kind, limit)),
        "executed_at": F.current_timestamp() if executed_at is None else executed_at,
    })


def run_rules(
    df: DataFrame, specs: list[RuleSpec], approx: bool = False, timeout: float | None = None, executed_at: Column | None = None,
) -> DataFrame:
    """Result rows of all rules, one each, from one scan. A rule that cannot be evaluated (a missing column, a bad cast, more
    than *timeout* seconds) is an ERROR row with its code and message and leaves the others their results."""
    if not specs:
        raise RuleError("no rules given")
    return _closed(df.sparkSession, _tested(df, specs, approx, timeout), executed_at)


def violation_samples(df: DataFrame, specs: list[RuleSpec], order: list[str], n: int = SAMPLE_ROWS) -> DataFrame:
    """(rule_id, place, row): the first *n* violating rows of each rule in the order of the columns *order*, which should
    tell rows apart. Rules without a row condition (uniqueness, row counts) have none.

    One scan, filtered by all conditions together. Each task keeps its first *n* rows a rule before the shuffle, so what
    is moved does not grow with the violations.
    """
    shown = [s for s in specs if s.rule_type not in _TABLE_RULES and s.rule_type != "uniqueness_check"]
    schema = f"rule_id long, place int, row struct<{', '.join(f'`{f.name}`:{f.dataType.simpleString()}' for f in df.schema)}>"
    if not shown:
        return df.sparkSession.createDataFrame([], schema)
    conditions = [s.violates() for s in shown]
    hit = F.array_compact(F.array(*[F.when(c, F.lit(s.rule_id).cast("long")) for s, c in zip(shown, conditions)]))
    rows = df.filter(reduce(lambda a, b: a | b, conditions)).select(F.explode(hit).alias("rule_id"), F.struct("*").alias("row"))
    first = Window.partitionBy("rule_id").orderBy(*[F.col("row")[c] for c in order])
    return rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n).select("rule_id", "place", "row")


def with_samples(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Add ``sample_rows``, the rows of each FAIL result as maps of texts in their order; an empty list for the others."""
    names = samples.schema["row"].dataType.names
    texts = F.map_from_arrays(F.array(*[F.lit(c) for c in names]), F.array(*[F.col("row")[c].cast("string") for c in names]))
    lists = samples.groupBy("rule_id").agg(F.array_sort(F.collect_list(F.struct("place", F.to_json(texts).alias("row")))).alias("_rows"))
    as_map = lambda x: F.from_json(x["row"], "map<string,string>")
    rows = F.when(F.col("status") == "FAIL", F.transform("_rows", as_map))
    return results.join(lists, "rule_id", "left").withColumn(
        "sample_rows", F.coalesce(rows, F.array().cast("array<map<string,string>>"))).drop("_rows")


def violation_preview(df: DataFrame, condition: Column, order: list, n: int = 50) -> DataFrame:
    """The first *n* violating rows in a stated order (a top-k, never a full sort)."""
    return df.filter(condition).orderBy(*order).limit(n)


def _result_shape(found: DataFrame) -> tuple[str | None, Any, str | None]:
    """Name and type of the single output column, or the reason it breaks the contract."""
    fields = found.schema.fields
    if len(fields) != 1:
        return None, None, f"Expected exactly one result column, got {len(fields)}."
    name = fields[0].name
    if name not in OBSERVED_NAMES:
        return None, None, "The column must be named violation_count or observed_value."
    return name, fields[0].dataType, None


def check_contract(spark: SparkSession, sql: str) -> str | None:
    """Why a rule's SELECT breaks the output contract, or None. Beyond the audit only analysis; the rule does not run."""
    code, body = audited_texts(spark, [sql])[0]
    if code:
        return code
    try:
        return _result_shape(spark.sql(body))[2]
    except PySparkException as error:
        return f"SQL_EXECUTION_ERROR: {_short(error)}"


def _short(error: Exception) -> str:
    return (str(error).splitlines() or [type(error).__name__])[0][:300]


def audited_texts(spark: SparkSession, texts: list[str], strict: bool = False) -> list[tuple[str | None, str]]:
    """(finding or None, text without comments and trailing semicolon) of each rule text, from one job."""
    table = spark.createDataFrame(list(enumerate(texts)), "i int, sql_text string")
    found = table.select("i", audit_code(F.col("sql_text"), strict), without_trailing_semicolon(F.col("sql_text"))).collect()
    return [(code, body) for _, code, body in sorted(found)]


def _sql_outcome(spark: SparkSession, spec: RuleSpec, code: str | None, body: str, timeout: float | None) -> tuple:
    """One SQL rule's outcome, whatever goes wrong. At most two rows of its result are fetched."""
    limit = None if spec.expected_value is None else Decimal(str(spec.expected_value))
    head, tail = (spec.rule_id, spec.rule_name, spec.severity), (spec.expected_type, limit)
    if code:
        return (*head, None, None, *tail, code, "the text was not run")

    def run() -> tuple:
        found = spark.sql(body)
        name, kind, problem = _result_shape(found)
        if problem:
            return (*head, None, None, *tail, "SQL_RESULT_SHAPE_ERROR", problem)
        rows = found.limit(2).select(exact_number(F.col(f"`{name}`"), kind)).collect()
        if len(rows) != 1:
            return (*head, None, None, *tail, "SQL_RESULT_SHAPE_ERROR", "Expected exactly one result row.")
        return (*head, name, rows[0][0], *tail, None, None)

    try:
        return within(spark, spec.params.get("timeout_s", timeout), run)
    except Exception as error:
        return _failed(spec, error)


def run_sql_rules(
    spark: SparkSession, rules: list[tuple[RuleSpec, str]], timeout: float | None = STATEMENT_TIMEOUT_S, at_once: int = 4,
    executed_at: Column | None = None,
) -> DataFrame:
    """Run SQL rules over the session's views: one row each, in any case. A text that fails its audit is not run; a rule that
    fails, or takes more than *timeout* seconds (or its own parameter ``timeout_s``), is an ERROR row and ends no other. Texts are audited in one job; rules
    run *at_once* together, each with a job tag of its own by which its jobs are cancelled. One whose time was up beside others
    is run once more by itself."""
    if not rules:
        raise RuleError("no rules given")
    audited = audited_texts(spark, [sql for _, sql in rules])
    run = lambda at: _sql_outcome(spark, rules[at][0], *audited[at], timeout)
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        outcomes = list(pool.map(inheritable_thread_target(spark)(run), range(len(rules))))
    if at_once > 1 and len(rules) > 1:  # perhaps it only waited for a slower one beside it
        outcomes = [run(at) if x[-2] == "SQL_TIMEOUT" else x for at, x in enumerate(outcomes)]
    return _closed(spark, outcomes, executed_at)


def run_sql_rule(spark: SparkSession, spec: RuleSpec, sql: str, timeout: float | None = STATEMENT_TIMEOUT_S) -> DataFrame:
    return run_sql_rules(spark, [(spec, sql)], timeout)


def dry_run(spark: SparkSession, sql: str, n: int = 10) -> tuple[DataFrame, str]:
    """Up to *n* output rows and the costed plan; nothing is written."""
    code, body = audited_texts(spark, [sql])[0]
    if code:
        raise RuleError(code)
    plan = spark.sql(f"EXPLAIN COST {body}").first()[0]
    return spark.sql(body).limit(n), plan
