"""Profiles, suggestions, anomalies and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import anomaly as A
from plumbline.operators import drift as D
from plumbline.operators import profile as P
from plumbline.operators import sketches as SK
from plumbline.operators import suggest as S
from plumbline.operators.rule_table import list_rows
from plumbline.plans.catalog import AS_OF, Lake, number, query
from plumbline.session import settle

# The driver's tables hold no NULLs; these views plant some.
_LINES = "(SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END AS discount FROM lineitem)"
_ORDERS = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS price,
 CASE WHEN o_custkey % 50 = 7 THEN NULL ELSE o_orderpriority END AS priority FROM orders)"""


def lines(lake: Lake):
    return lake.table("lineitem").withColumn(
        "discount", F.when(F.col("l_linenumber") != 7, F.col("l_discount"))
    )


def orders(lake: Lake, *more):
    return lake.table("orders").select(
        *more, "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 50 != 7, F.col("o_orderpriority")).alias("priority"),
    )


def union(branches) -> str:
    return "\nUNION ALL\n".join(branches)


_LINE_COLUMNS = ("discount", "l_quantity", "l_shipdate", "l_returnflag")


@query("profile_nulls", union(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(*) AS row_count, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS null_pct FROM {_LINES}"
    for c in _LINE_COLUMNS))
def profile_nulls(lake: Lake):
    return P.null_summary(lines(lake), list(_LINE_COLUMNS))


_ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "price", "priority")


@query("profile_unique", union(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS unique_count, "
    f"round(count(DISTINCT {c}) * 100.0 / count(*), 4)::DOUBLE AS unique_pct, count(DISTINCT {c}) = count(*) AS is_unique FROM {_ORDERS}"
    for c in _ORDER_COLUMNS))
def profile_unique(lake: Lake):
    return P.uniqueness(orders(lake))


def _stats_sql(column: str, source: str) -> str:
    nearest = (
        "(SELECT v FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) - 1 AS r, count(*) OVER () AS n "
        "FROM {s} WHERE {c} IS NOT NULL) WHERE r = round((n - 1) * {q}))"
    )
    cut = lambda q: nearest.format(c=column, s=source, q=q)
    return (
        f"SELECT '{column}' AS column_name, count({column}) AS n, min({column})::DOUBLE AS min, max({column})::DOUBLE AS max, "
        f"round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std, median({column})::DOUBLE AS median, "
        f"{cut(0.25)}::DOUBLE AS p25, {cut(0.75)}::DOUBLE AS p75 FROM {source}"
    )


def _rounded(df):
    return df.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query("profile_stats", union(
    _stats_sql(c, _LINES) for c in ("discount", "l_quantity", "l_extendedprice", "l_linenumber", "l_partkey")))
def profile_stats(lake: Lake):
    return _rounded(P.numeric_stats(
        lines(lake), ["discount", "l_quantity", "l_extendedprice", "l_linenumber", "l_partkey"]
    ))


@query("profile_text_values", union(
    f"SELECT '{c}' AS column_name, md5(value) AS value_md5, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY n DESC, "
    f"sha256(value)) AS r FROM (SELECT {c} AS value, count(*) AS n FROM documents WHERE {c} IS NOT NULL GROUP BY 1)) WHERE r <= 10"
    for c in ("text", "lang")))
def profile_text_values(lake: Lake):
    """Whole texts and short values by one path, ties included."""
    top = P.top_values_long(lake.table("documents").select("text", "lang"), ["text", "lang"])
    return top.select("column_name", F.md5("value").alias("value_md5"), "n", "rank")


@query("profile_top_values", union(
    f"SELECT * FROM (SELECT '{c}' AS column_name, value, n, CAST(row_number() OVER (ORDER BY n DESC, sha256(value)) AS INTEGER) AS rank "
    f"FROM (SELECT {c} AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1)) WHERE rank <= 10"
    for c, t in (("lang", "documents"), ("source", "documents"))))
def profile_top_values(lake: Lake):
    return P.top_values_long(lake.table("documents").select("lang", "source"), ["lang", "source"])


def _profile_sql(order: int, column: str, label: str) -> str:
    numeric = label in ("integer", "float")
    head = (
        f"SELECT 'orders' AS table_name, {order} AS position, '{column}' AS column_name, '{label}' AS dtype, count(*) AS row_count, "
        f"count(*) FILTER (WHERE {column} IS NULL) AS null_count, "
        f"round(count(*) FILTER (WHERE {column} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS null_pct, "
        f"count(DISTINCT {column}) AS unique_count, count(DISTINCT {column}) = count(*) AS is_unique, "
    )
    if numeric:
        stats = _stats_sql(column, _ORDERS).split("AS n, ", 1)[1].removesuffix(f" FROM {_ORDERS}")
        body = stats + ", '' AS top_values"
    else:
        body = (
            ", ".join(f"NULL::DOUBLE AS {c}" for c in ("min", "max", "mean", "std", "median", "p25", "p75"))
            + f", (SELECT string_agg(v || '=' || k, ',' ORDER BY k DESC, sha256(CAST(v AS VARCHAR))) FROM (SELECT {column} AS v, count(*) AS k FROM {_ORDERS} "
            f"WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY k DESC, sha256(CAST(v AS VARCHAR)) LIMIT 10)) AS top_values"
        )
    return f"{head}{body} FROM {_ORDERS}"


@query("profile_orders", union(
    _profile_sql(i, c, label) for i, (c, label) in enumerate(
        zip(_ORDER_COLUMNS, ("integer", "integer", "string", "float", "string")))))
def profile_orders(lake: Lake):
    flat = F.array_join(F.transform(
        "top_values", lambda v: F.concat(v["value"], F.lit("="), v["count"].cast("string"))
    ), ",")
    return _rounded(P.profile(orders(lake), "orders")).select(
        "table_name", "position", "column_name", "dtype", "row_count", "null_count", "null_pct",
        "unique_count", "is_unique", "min", "max", "mean", "std", "median", "p25", "p75",
        F.coalesce(flat, F.lit("")).alias("top_values"),
    )


def _merged_sql(source: str) -> str:
    """What sketches give exactly, and TRUE for the estimates that are within their stated errors."""
    return union(
        f"SELECT {i} AS position, '{c}' AS column_name, '{label}' AS dtype, 5 AS column_count, count(*) AS row_count, "
        f"count(*) FILTER (WHERE {c} IS NULL) AS null_count, count(DISTINCT {c}) = count(*) AS is_unique, "
        + (f"min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, TRUE AS quartiles_within, "
           if label != "string" else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::BOOLEAN AS quartiles_within, ")
        + "TRUE AS distinct_within, "
        + (f"(SELECT string_agg(k, ',' ORDER BY k DESC) FROM (SELECT count(*) AS k FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY k DESC LIMIT 3))"
           if label == "string" else "''")
        + f" AS top_counts FROM {source}"
        for i, (c, label) in enumerate(zip(_ORDER_COLUMNS, ("integer", "integer", "string", "float", "string"))))


def _judged(df, estimated):
    """The estimates of a profile against the table: exact distinct counts, and the ranks of the quartiles."""
    exact = P.uniqueness(df).select("column_name", F.col("unique_count").alias("d"))
    numeric = P.numeric_columns(df)
    cuts = F.broadcast(estimated.select("column_name", "p25", "median", "p75"))  # a row a column
    value = F.col("value")
    ranks = P.numeric_long(df, numeric).join(cuts, "column_name").groupBy("column_name").agg(*[
        x.alias(f"{name}_{side}") for name in ("p25", "median", "p75")
        for side, x in (("low", F.avg((value < F.col(name)).cast("double"))), ("high", F.avg((value <= F.col(name)).cast("double"))))])
    near = F.lit(True)
    for name, q in (("p25", 0.25), ("median", 0.5), ("p75", 0.75)):
        near = near & (F.col(f"{name}_low") <= q + 0.01) & (F.col(f"{name}_high") >= q - 0.01)
    counts = F.array_join(F.transform(F.slice("top_values", 1, 3), lambda v: v["count"].cast("string")), ",")
    joined = estimated.join(F.broadcast(exact), "column_name").join(F.broadcast(ranks), "column_name", "left")
    return _rounded(joined).select(
        "position", "column_name", "dtype", "column_count", "row_count", "null_count", "is_unique", "min", "max", "mean", "std",
        near.alias("quartiles_within"), (F.abs(F.col("unique_count") - F.col("d")) <= 0.04 * F.col("d") + 1).alias("distinct_within"),
        F.coalesce(counts, F.lit("")).alias("top_counts"))


@query("profile_approx", _merged_sql(_ORDERS))
def profile_approx(lake: Lake):
    df = orders(lake)
    return _judged(df, settle(P.profile(df, "orders", approx=True), "approx"))


@query("profile_merged", _merged_sql(_ORDERS))
def profile_merged(lake: Lake):
    """Sketches of every year of orders, stored, then read back and merged."""
    df = orders(lake, F.year("o_orderdate").alias("order_year"))
    stored = settle(SK.sketch(df, ["order_year"]), "sketches")
    return _judged(df.drop("order_year"), settle(SK.profile_of_sketches(stored, "orders"), "merged"))


@query("latest_profile", union(
    f"SELECT '{c}' AS column_name, count(*) AS row_count, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4)::DOUBLE AS null_pct FROM {_ORDERS}"
    for c in _ORDER_COLUMNS))
def latest_profile(lake: Lake):
    """Two stored profiles of one table, the older one of the filled rows only; the newer wins."""
    df = orders(lake)
    when = lambda text: F.lit(text).cast("timestamp").alias("profiled_at")
    name = F.lit("orders").alias("table_name")
    older = P.null_summary(df.dropna()).select(name, "*", when("2024-01-01"))
    newer = P.null_summary(df).select(name, "*", when(AS_OF))
    return P.latest_profile(older.unionByName(newer), "orders").select(
        "column_name", "row_count", "null_pct"
    )


def _suggest_sql(tail: str) -> str:
    parts = union(
        f"SELECT {i} AS position, '{c}' AS column_name, '{label}' AS dtype, count(*) AS n, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4) AS null_pct, "
        f"count(DISTINCT {c}) AS d, count(DISTINCT {c}) * 100.0 / count(*) AS unique_pct, "
        f"{'min(' + c + ') <> max(' + c + ')' if label != 'string' else 'false'} AS spread FROM {_ORDERS}"
        for i, (c, label) in enumerate(zip(_ORDER_COLUMNS, ("integer", "integer", "string", "float", "string"))))
    return f"""WITH p AS ({parts}), s AS (
SELECT column_name, 'not_null' AS rule_kind, 'zero_violations' AS expected_result_type, NULL::DOUBLE AS expected_result_value, 0.95::DOUBLE AS confidence, column_name || ' must not contain nulls' AS suggested_rule_name FROM p WHERE null_pct = 0
UNION ALL SELECT column_name, 'null_tolerance', 'max_threshold', greatest(1, floor(null_pct / 100 * n * 1.1))::DOUBLE, 0.75, column_name || ' null count within acceptable limit' FROM p WHERE null_pct > 0 AND null_pct <= 5
UNION ALL SELECT column_name, 'unique', 'zero_violations', NULL, 0.9, column_name || ' must be unique (no duplicates)' FROM p WHERE round(unique_pct, 4) >= 98
UNION ALL SELECT column_name, 'range', 'zero_violations', NULL, 0.7, '' FROM p WHERE spread
UNION ALL SELECT column_name, 'category', 'zero_violations', NULL, 0.8, column_name || ' contains only known categories' FROM p WHERE dtype = 'string' AND d BETWEEN 2 AND 20)
{tail}"""


@query("suggested_rules", _suggest_sql("SELECT * FROM s"))
def suggested_rules(lake: Lake):
    suggestions = S.suggest_rules(P.profile(orders(lake), "orders", k=S.MAX_CATEGORIES))
    ranged = F.col("rule_kind") == "range"
    return suggestions.select(
        "column_name", "rule_kind", "expected_result_type", number("expected_result_value"), "confidence",
        F.when(ranged, "").otherwise(F.col("suggested_rule_name")).alias("suggested_rule_name"),
    )


@query("suggestion_sql", f"""
SELECT 'o_orderstatus' AS column_name, 'SELECT COUNT(*) AS violation_count FROM orders WHERE o_orderstatus NOT IN (' ||
  string_agg('''' || v || '''', ', ' ORDER BY k DESC, sha256(CAST(v AS VARCHAR))) || ')' AS suggested_sql
FROM (SELECT o_orderstatus AS v, count(*) AS k FROM orders GROUP BY 1)
UNION ALL SELECT 'o_orderkey', 'SELECT COUNT(*) AS violation_count FROM orders WHERE o_orderkey IS NULL'
UNION ALL SELECT 'o_orderkey', 'SELECT COUNT(*) - COUNT(DISTINCT o_orderkey) AS violation_count FROM orders'
UNION ALL SELECT 'o_orderstatus', 'SELECT COUNT(*) AS violation_count FROM orders WHERE o_orderstatus IS NULL'""")
def suggestion_sql(lake: Lake):
    df = lake.table("orders").select("o_orderkey", "o_orderstatus")
    suggestions = S.suggest_rules(P.profile(df, "orders", k=S.MAX_CATEGORIES))
    return suggestions.filter(F.col("rule_kind") != "range").select("column_name", "suggested_sql")


@query("suggested_ranges", union(
    f"SELECT '{c}' AS column_name, min({c})::DOUBLE AS low, max({c})::DOUBLE AS high, 'SELECT COUNT(*) AS violation_count FROM orders WHERE {c} < # OR {c} > #' AS shape FROM orders"
    for c in ("o_orderkey", "o_custkey", "o_totalprice")))
def suggested_ranges(lake: Lake):
    """The limits in the texts of range rules, as numbers, and the texts around them."""
    df = lake.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = S.suggest_rules(P.profile(df, "orders", k=S.MAX_CATEGORIES)).filter("rule_kind = 'range'")
    limit = lambda mark: F.regexp_extract("suggested_sql", rf"{mark} (-?[0-9.]+(?:E-?[0-9]+)?)", 1).cast("double")
    return found.select("column_name", limit("<").alias("low"), limit(">").alias("high"),
                        F.regexp_replace("suggested_sql", r"([<>]) -?[0-9.]+(?:E-?[0-9]+)?", "$1 #").alias("shape"))


@query("profile_notes", """
SELECT 'part' AS table_name, 'p_size' AS column_name, 0.0::DOUBLE AS null_pct, count(DISTINCT p_size) AS unique_count, NULL AS note FROM part
UNION ALL SELECT 'part', 'nothing', 100.0, 0, 'all_null'
UNION ALL SELECT 'part', 'no_text', 100.0, 0, 'all_null'""")
def profile_notes(lake: Lake):
    df = lake.table("part").select("p_size", F.lit(None).cast("double").alias("nothing"), F.lit(None).cast("string").alias("no_text"))
    return P.profile(df, "part").select("table_name", "column_name", "null_pct", "unique_count", "note")


@query("drift_one_value", """
SELECT 0 AS position, 'c_acctbal' AS column_name, 'mean_shift' AS stat_test, NULL::DOUBLE AS drift_score, FALSE AS is_drifted, 1::BIGINT AS ref_n, count(*) - 1 AS cur_n FROM customer""")
def drift_one_value(lake: Lake):
    """A side with a single number has no deviation: no score, and no drift."""
    customer = lake.table("customer").select("c_custkey", "c_acctbal")
    first = customer.agg(F.min("c_custkey").alias("k"))
    one = customer.join(F.broadcast(first), F.col("c_custkey") == F.col("k"))
    return D.drift(one, customer.join(F.broadcast(first), F.col("c_custkey") != F.col("k")), ["c_acctbal"]).select(
        "position", "column_name", "stat_test", "drift_score", "is_drifted", "ref_n", "cur_n")


@query("verified_suggestions", _suggest_sql(
    "SELECT rule_kind, count(*) AS rules, count(*) AS passed FROM s GROUP BY rule_kind"))
def verified_suggestions(lake: Lake):
    """Suggestions hold on the table they come from."""
    df = orders(lake)
    suggestions = S.suggest_rules(P.profile(df, "orders", k=S.MAX_CATEGORIES))
    kinds = suggestions.select(F.col("suggested_rule_name").alias("rule_name"), "rule_kind")
    return S.verify_suggestions(df, suggestions).join(kinds, "rule_name").groupBy("rule_kind").agg(
        F.count(F.lit(1)).alias("rules"), F.count_if(F.col("status") == "PASS").alias("passed")
    )


@query("ingested_suggestions", """
SELECT event_id, CASE event_type WHEN 'view' THEN '__dataset__' ELSE event_type END AS column_name,
       CASE WHEN user_id % 2 = 0 THEN 'rule ' || user_id ELSE 'Unnamed rule' END AS suggested_rule_name,
       'zero_violations' AS expected_result_type, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.25 END::DOUBLE AS confidence
FROM events WHERE event_type <> 'error'""")
def ingested_suggestions(lake: Lake):
    """Answer texts around a JSON array, one per event; 'error' events have no array at all."""
    name = F.when(F.col("event_type") == "view", "").otherwise(
        F.concat(F.lit('"column_name": "'), "event_type", F.lit('", '))
    )
    title = F.when(F.col("user_id") % 2 == 0, F.concat(
        F.lit('"suggested_rule_name": "rule '), F.col("user_id").cast("string"), F.lit('", ')
    )).otherwise("")
    confidence = F.when(F.col("event_id") % 3 == 0, "0").otherwise("0.25")
    answer = F.concat(
        F.lit("Here you are:\n```json\n["), F.lit("{"), name, title, F.lit('"confidence": '), confidence,
        F.lit('}, "no rule", 7]\n```\nBye'),
    )
    text = F.when(F.col("event_type") == "error", "Sorry, no rules.").otherwise(answer)
    answers = lake.table("events").select("event_id", text.alias("answer"))
    return S.ingest_suggestions(answers, "answer", ["event_id"]).select(
        "event_id", "column_name", "suggested_rule_name", "expected_result_type", "confidence"
    )


@query("applied_suggestions", """
WITH s AS (SELECT c_custkey AS suggestion_id, c_custkey % 5 = 0 AS applied,
  'SELECT COUNT(*) AS violation_count FROM customer WHERE c_acctbal < ' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ';' ELSE '' END AS sql_text,
  c_nationkey FROM customer),
fresh AS (SELECT min(suggestion_id) AS suggestion_id FROM s WHERE NOT applied AND c_nationkey >= 10 GROUP BY c_nationkey)
SELECT suggestion_id, applied OR suggestion_id IN (SELECT suggestion_id FROM fresh) AS applied FROM s""")
def applied_suggestions(lake: Lake):
    """Customers as suggestions; equal texts come up repeatedly, and some rules exist already."""
    customer = lake.table("customer")
    base = F.concat(
        F.lit("SELECT COUNT(*) AS violation_count FROM customer WHERE c_acctbal < "),
        F.col("c_nationkey").cast("string"),
    )
    suggestions = customer.select(
        F.col("c_custkey").alias("suggestion_id"), F.lit("customer").alias("table_name"),
        F.col("c_name").alias("suggested_rule_name"),
        F.concat(base, F.when(F.col("c_custkey") % 2 == 0, ";").otherwise("")).alias("suggested_sql"),
        F.lit("zero_violations").alias("expected_result_type"),
        F.lit(None).cast("decimal(38,10)").alias("expected_result_value"),
        (F.col("c_custkey") % 5 == 0).alias("applied"),
    )
    rules = customer.filter("c_nationkey < 10").select(
        F.lower(base).alias("sql_text"), F.lit(None).cast("long").alias("database_connection_id"),
        F.lit("zero_violations").alias("expected_result_type"),
        F.lit(None).cast("decimal(38,10)").alias("expected_result_value"),
    )
    _, moved = S.apply_suggestions(suggestions, rules, suggestions)
    return moved.select("suggestion_id", "applied")


@query("anomaly_zscore", """
SELECT e.event_id AS row_key, 'value' AS column_name, e.value, round(abs((e.value - s.m) / s.d), 6) AS score
FROM events e, (SELECT avg(value) AS m, stddev_pop(value) AS d FROM events) s WHERE abs((e.value - s.m) / s.d) > 3""")
def anomaly_zscore(lake: Lake):
    return A.anomalies(lake.table("events"), "event_id", "value", "zscore").withColumn(
        "score", F.round("score", 6)
    )


def _tail_sql(key: str, column: str, table: str, share: float) -> str:
    return (
        f"SELECT row_key, '{column}' AS column_name, value, score FROM (SELECT {key} AS row_key, {column}::DOUBLE AS value, "
        f"abs({column} - m)::DOUBLE AS score, row_number() OVER (ORDER BY abs({column} - m) DESC, {key}) AS r, n "
        f"FROM {table}, (SELECT median({column}) AS m, count({column}) AS n FROM {table}) WHERE {column} IS NOT NULL) "
        f"WHERE r <= greatest(1, round_even(n * {share}, 0))"
    )


@query("anomaly_tail", _tail_sql("event_id", "value", "events", 0.05))
def anomaly_tail(lake: Lake):
    return A.anomalies(lake.table("events"), "event_id", "value", "isolation_forest")


@query("anomaly_ties", _tail_sql("p_partkey", "p_size", "part", 0.1))
def anomaly_ties(lake: Lake):
    """Few distinct values, so that the cut falls into a large group of equal distances."""
    return A.anomalies(lake.table("part"), "p_partkey", "p_size", "lof", contamination=0.1)


def _summary_sql(column: str) -> str:
    tail = _tail_sql("o_orderkey", column, "orders", 0.05)
    return (
        f"SELECT '{column}' AS column_name, 'tail' AS method, count(*) AS anomaly_count, (SELECT count({column}) FROM orders) AS total_rows, "
        f"round(count(*) * 100.0 / (SELECT count({column}) FROM orders), 4)::DOUBLE AS anomaly_pct, "
        f"(SELECT string_agg(CAST(row_key AS VARCHAR), ',' ORDER BY row_key) FROM (SELECT row_key FROM ({tail}) ORDER BY row_key LIMIT 50)) AS sample_keys "
        f"FROM ({tail})"
    )


@query("anomaly_summaries", union(_summary_sql(c) for c in ("o_totalprice", "o_custkey")))
def anomaly_summaries(lake: Lake):
    found = A.anomalies_all(lake.table("orders"), "o_orderkey", ["o_totalprice", "o_custkey", "o_orderstatus", "x"])
    keys = F.array_join(F.transform("sample_keys", lambda k: k.cast("string")), ",")
    return found.select(
        "column_name", "method", "anomaly_count", "total_rows", "anomaly_pct", keys.alias("sample_keys")
    )


@query("anomaly_eligibility", """
SELECT 'l_quantity' AS column_name, count(l_quantity) AS n, 'OK' AS status FROM lineitem
UNION ALL SELECT 'few', CASE WHEN count(*) > 0 THEN 5 END, 'INSUFFICIENT_DATA' FROM lineitem
UNION ALL SELECT 'none', 0, 'EMPTY'""")
def anomaly_eligibility(lake: Lake):
    empty = F.lit(None).cast("double")
    lines_part = lake.table("lineitem").select("l_quantity", empty.alias("few"), empty.alias("none"))
    regions = lake.table("region").select(
        empty.alias("l_quantity"), F.col("r_regionkey").cast("double").alias("few"), empty.alias("none")
    )
    return A.eligibility(lines_part.unionByName(regions), ["l_quantity", "few", "none"])


def _drift_sql(position: int, column: str, ref: str, cur: str) -> str:
    return (
        f"SELECT {position} AS position, '{column}' AS column_name, 'mean_shift' AS stat_test, round(s, 6) AS drift_score, s > 1 AS is_drifted FROM "
        f"(SELECT abs(c.m - r.m) / CASE WHEN (r.d + c.d) / 2 = 0 THEN 1 ELSE (r.d + c.d) / 2 END AS s FROM "
        f"(SELECT avg({column}) AS m, stddev_samp({column}) AS d FROM {ref}) r, (SELECT avg({column}) AS m, stddev_samp({column}) AS d FROM {cur}) c)"
    )


_SPLIT = "o_orderdate < TIMESTAMP '1998-01-01'"
_REF, _CUR = f"(SELECT * FROM orders WHERE {_SPLIT})", f"(SELECT * FROM orders WHERE NOT {_SPLIT})"


def _drift_pair(lake: Lake):
    df = lake.table("orders")
    return df.filter(_SPLIT), df.filter(f"NOT {_SPLIT}")


@query("drift_orders", union(
    _drift_sql(i, c, _REF, _CUR) for i, c in enumerate(("o_totalprice", "o_custkey", "o_orderkey"))))
def drift_orders(lake: Lake):
    return D.drift(*_drift_pair(lake), ["o_totalprice", "o_custkey", "missing", "o_orderkey"]).select(
        "position", "column_name", "stat_test", "drift_score", "is_drifted"
    )


@query("drift_sketched", union(
    _drift_sql(i, c, _REF, _CUR) for i, c in enumerate(("o_orderkey", "o_custkey", "o_totalprice"))))
def drift_sketched(lake: Lake):
    """Drift between two spans of months from stored sketches alone."""
    months = lake.table("orders").select(F.trunc("o_orderdate", "month").alias("month"), "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    stored = settle(SK.sketch(months, ["month"]), "sketches")
    return SK.drift_of_sketches(stored.filter("month < '1998-01-01'"), stored.filter("month >= '1998-01-01'")).select(
        "position", "column_name", "stat_test", "drift_score", "is_drifted")


@query("drift_coerced", union([
    _drift_sql(0, "k", "(SELECT TRY_CAST(props->>'$.k' AS DOUBLE) AS k FROM events WHERE event_type = 'view')",
               "(SELECT TRY_CAST(props->>'$.k' AS DOUBLE) + 500 AS k FROM events WHERE event_type = 'error' AND event_id % 3 <> 0)"),
    _drift_sql(1, "big", "(SELECT CAST(value > 50 AS DOUBLE) AS big FROM events WHERE event_type = 'view')",
               "(SELECT CAST(value > 50 AS DOUBLE) AS big FROM events WHERE event_type = 'error')"),
    "SELECT 2, 'empty', 'mean_shift', 0.0, false",
]))
def drift_coerced(lake: Lake):
    """Text with unparseable entries, booleans, and a column without numbers on one side."""
    events = lake.table("events")
    k = F.get_json_object("props", "$.k")
    shifted = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise((k.cast("double") + 500).cast("string"))
    reference = events.filter("event_type = 'view'").select(
        k.alias("k"), (F.col("value") > 50).alias("big"), F.lit("none").alias("empty"))
    current = events.filter("event_type = 'error'").select(
        shifted.alias("k"), (F.col("value") > 50).alias("big"), F.lit("1").alias("empty"))
    return D.drift(reference, current, ["k", "big", "empty"]).select(
        "position", "column_name", "stat_test", "drift_score", "is_drifted"
    )


@query("dataset_drift", f"""
SELECT count(*) AS columns, count(*) FILTER (WHERE is_drifted) AS drifted,
       round(avg(CASE WHEN is_drifted THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS share_drifted,
       avg(CASE WHEN is_drifted THEN 1.0 ELSE 0.0 END) > 0.5 AS dataset_drift
FROM ({union(_drift_sql(i, c, "(SELECT o_totalprice, o_custkey, o_totalprice AS t2 FROM orders)", "(SELECT o_totalprice + 1000000 AS o_totalprice, o_custkey, o_totalprice * 9 AS t2 FROM orders)") for i, c in enumerate(("o_totalprice", "o_custkey", "t2")))})""")
def dataset_drift(lake: Lake):
    df = lake.table("orders")
    reference = df.select("o_totalprice", "o_custkey", F.col("o_totalprice").alias("t2"))
    current = df.select(
        (F.col("o_totalprice") + 1000000).alias("o_totalprice"), "o_custkey",
        (F.col("o_totalprice") * 9).alias("t2"),
    )
    return D.dataset_drift(D.drift(reference, current, ["o_totalprice", "o_custkey", "t2"]))


@query("listed_drift", f"""
SELECT column_name, drift_score FROM ({union(_drift_sql(i, c, _REF, _CUR) for i, c in enumerate(("o_totalprice", "o_custkey", "o_orderkey")))})
WHERE NOT is_drifted ORDER BY column_name LIMIT 20""")
def listed_drift(lake: Lake):
    stored = D.drift(*_drift_pair(lake), ["o_totalprice", "o_custkey", "o_orderkey"])
    return list_rows(stored, [F.col("column_name")], 20, is_drifted=False).select("column_name", "drift_score")
