"""Governed queries over the given tables: subjects, row filters, masks, and audit analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.operators import catalog, relational, risk
from wardstone.plans.policy import Subject, load_policies
from wardstone.plans.session import Governance

POLICIES = """
policies:
- name: names
  resources: [{table: customer, column: c_name}]
  dataMaskItems: [{groups: ['*'], udf: mask_name}, {groups: [audit], udf: mask_text}]
- name: segments
  resources: [{table: customer, column: c_mktsegment}]
  dataMaskItems: [{groups: ['*'], udf: mask_hash, arguments: [sha256]}]
- name: suppliers
  resources: [{table: supplier, column: s_name}]
  dataMaskItems: [{groups: ['*'], udf: mask_phone, arguments: [3, 4]}]
- name: priorities
  resources: [{table: orders, column: o_orderpriority}]
  dataMaskItems: [{groups: ['*'], udf: mask_text}]
- name: solvent
  resources: [{table: customer}]
  rowFilterItems: [{groups: ['*'], condition: 'c_acctbal >= 0'}]
- name: settled
  resources: [{table: orders}]
  rowFilterItems: [{groups: ['*'], condition: "o_orderstatus IN ('O', 'F')"}]
- name: regions
  resources: [{table: nation}]
  rowFilterItems: [{groups: ['*'], condition: 'n_regionkey <> 3'}]
"""
GOVERNED = ("customer", "orders", "supplier", "nation", "region", "lineitem")
ANALYST = Subject("ann", frozenset({"analysts"}))
AUDITOR = Subject("bo", frozenset({"audit"}))


def governance(spark: SparkSession, sf_dir: str) -> Governance:
    return Governance(spark, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in GOVERNED}, load_policies(POLICIES))


_C = "(SELECT * FROM customer WHERE c_acctbal >= 0)"
_O = "(SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F'))"
_N = "(SELECT * FROM nation WHERE n_regionkey <> 3)"


def _name(c: str) -> str:
    return f"CASE WHEN length({c}) <= 1 THEN repeat('*', length({c})) ELSE left({c}, 1) || repeat('*', length({c}) - 2) || right({c}, 1) END"


def _phone(c: str) -> str:
    return f"CASE WHEN length({c}) <= 7 THEN repeat('*', length({c})) ELSE left({c}, 3) || repeat('*', length({c}) - 7) || right({c}, 4) END"


#: name: (subject, SQL as users write it, DuckDB SQL with filters and masks written out).
SECURED: dict[str, tuple[Subject, str, str]] = {
    "g_mask_and_filter": (ANALYST, "SELECT c_custkey, c_name FROM customer", f"SELECT c_custkey, {_name('c_name')} AS c_name FROM {_C}"),
    "g_selector_specificity": (AUDITOR, "SELECT c_custkey, c_name FROM customer", f"SELECT c_custkey, '***' AS c_name FROM {_C}"),
    "g_hash": (ANALYST, "SELECT c_custkey, c_mktsegment FROM customer", f"SELECT c_custkey, sha256(c_mktsegment) AS c_mktsegment FROM {_C}"),
    "g_phone": (ANALYST, "SELECT s_suppkey, s_name FROM supplier", f"SELECT s_suppkey, {_phone('s_name')} AS s_name FROM supplier"),
    "g_join": (ANALYST, "SELECT o_orderkey, c_name, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey", f"SELECT o_orderkey, {_name('c_name')} AS c_name, '***' AS o_orderpriority FROM {_O} JOIN {_C} ON o_custkey = c_custkey"),
    "g_cte_shadow": (ANALYST, "WITH customer AS (SELECT c_custkey, c_name FROM customer) SELECT * FROM customer", f"SELECT c_custkey, {_name('c_name')} AS c_name FROM {_C}"),
    "g_self_join": (ANALYST, "SELECT a.c_custkey AS x, b.c_name AS y FROM customer a JOIN customer b ON a.c_custkey + 1 = b.c_custkey", f"SELECT a.c_custkey AS x, {_name('b.c_name')} AS y FROM {_C} a JOIN {_C} b ON a.c_custkey + 1 = b.c_custkey"),
    "g_expression": (ANALYST, "SELECT c_custkey, upper(c_name) || '-' || c_custkey AS tag FROM customer", f"SELECT c_custkey, {_name('tag')} AS tag FROM (SELECT c_custkey, upper(c_name) || '-' || c_custkey AS tag FROM {_C})"),
    "g_aggregate_is_masked": (ANALYST, "SELECT c_nationkey, count(c_name) AS n FROM customer GROUP BY c_nationkey", f"SELECT c_nationkey, {_name('n')} AS n FROM (SELECT c_nationkey, count(c_name)::VARCHAR AS n FROM {_C} GROUP BY 1)"),
    "g_window": (ANALYST, "SELECT c_custkey, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS r FROM customer", f"SELECT c_custkey, sha256(r) AS r FROM (SELECT c_custkey, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey))::VARCHAR AS r FROM {_C})"),
    "g_exists": (ANALYST, "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING')", f"SELECT n_name FROM {_N} WHERE EXISTS (SELECT 1 FROM {_C} WHERE c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING')"),
    "g_union": (ANALYST, "SELECT c_name AS v FROM customer UNION ALL SELECT n_name FROM nation", f"SELECT {_name('v')} AS v FROM (SELECT c_name AS v FROM {_C} UNION ALL SELECT n_name FROM {_N})"),
    "g_scalar_subquery": (ANALYST, "SELECT n_nationkey, (SELECT max(c_name) FROM customer WHERE c_nationkey = n_nationkey) AS m FROM nation", f"SELECT n_nationkey, {_name('m')} AS m FROM (SELECT n_nationkey, (SELECT max(c_name) FROM {_C} c WHERE c_nationkey = n_nationkey) AS m FROM {_N} n)"),
    "g_order_limit": (ANALYST, "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 15", f"SELECT c_custkey, {_name('c_name')} AS c_name FROM (SELECT * FROM {_C} ORDER BY c_acctbal DESC, c_custkey LIMIT 15)"),
    "g_rollup": (ANALYST, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment)", f"SELECT CASE WHEN c_mktsegment IS NOT NULL THEN sha256(c_mktsegment) END AS c_mktsegment, n FROM (SELECT c_mktsegment, count(*) AS n FROM {_C} GROUP BY ROLLUP (c_mktsegment))"),
}


def _secured(subject: Subject, sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: governance(spark, sf_dir).secure_sql(subject, sql)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", "ts", F.col("user_id").alias("user"), "event_type", F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("outcome"), F.floor("value").cast("long").alias("row_count"))


def e7_sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same user in the last 24 hours, up to and with each."""
    return risk.with_window_counts(_events(spark, sf_dir), "user", "ts", 86_400, n=F.lit(True)).select("event_id", "n")


def r9_failure_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures that bring the user's count in 24 hours to 2, 4, ...: the data are too thin for 60 seconds."""
    return risk.burst(_events(spark, sf_dir), F.col("outcome") == "FAILURE", 86_400, 2).select("event_id", F.col("burst_count").alias("n"))


def r10_off_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir).withColumns({"original_sql": F.lit(""), "masked": F.lit(True), "select_star": F.lit(False), "sensitive_columns": F.array().cast("array<struct<key:string,sensitivity:string>>")})
    return events.where(F.exists(risk.stateless_hits(), lambda h: h["rule"] == "OFF_HOURS_ACCESS")).select("event_id")


def r14_first_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.first_touch(_events(spark, sf_dir), "event_type")
    return found.select("event_type", "user", "event_id")


def r15_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    found = risk.baseline(events, risk.profiles(events), seconds=86_400, least=4, times=2.0, row_times=2.0)
    return found.select("event_id", "fast", "large", "odd_hour")


def e9_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = risk.profiles(_events(spark, sf_dir))
    return p.select("user", "events", "rate_per_hour", "samples", "median_rows", F.get("histogram", 0).alias("h0"), F.get("histogram", 12).alias("h12"))


def _typed_hits(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "HIGH").when(F.col("event_type") == "purchase", "MEDIUM").otherwise("LOW")
    return events.select("event_id", "ts", "user", F.col("event_type").alias("rule"), severity.alias("severity"))


def e12_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.alerts(_typed_hits(_events(spark, sf_dir)), cooldown=86_400)
    return found.select("rule", "user", F.col("alert_no").cast("long").alias("alert_no"), "event_count", "severity", F.get("event_ids", 0).alias("first_id"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    own = F.array_compact(F.array(F.when(F.col("outcome") == "FAILURE", F.struct(F.lit("FAILED").alias("rule"), F.lit("HIGH").alias("severity"))), F.when(F.col("row_count") >= 50, F.struct(F.lit("LARGE").alias("rule"), F.lit("MEDIUM").alias("severity")))))
    return risk.scored(events.withColumn("hits", own))


def e5_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("event_id", "score", "top_severity", "flagged")


def e14_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.by_severity(_scored(spark, sf_dir))


def e14_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.overview(_scored(spark, sf_dir))


def l8_top_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _events(spark, sf_dir).groupBy("user").agg(F.count("*").alias("n"))
    return relational.top(counted, 8, F.desc("n"), F.asc("user"))


def j7_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the user's latest error before or at it."""
    e = _events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user", "ts")
    right = e.where("event_type = 'error'").select("user", F.col("ts").alias("error_ts"), F.col("event_id").alias("error_id"))
    return relational.asof_join(left, right, "user", "ts", "error_ts", ["error_id"]).select("event_id", "error_id")


def k1_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(t, c) for t in GOVERNED for c in spark.read.parquet(f"{sf_dir}/{t}.parquet").columns]
    return catalog.classify_columns(spark.createDataFrame(rows, "table_name string, column_name string")).select("table_name", "column_name", "category", "level")


#: Texts of attacks, dealt to events by id, and the rules that each meets.
ATTACKS = (
    ("SELECT a FROM t WHERE id = 1 OR 1=1", "SQLI_TAUTOLOGY"),
    ("SELECT a FROM t WHERE n = '' OR 'a'='a'", "SQLI_TAUTOLOGY,SQLI_TAUTOLOGY"),
    ("SELECT a FROM t UNION ALL SELECT b FROM u", "SQLI_UNION"),
    ("SELECT 1; DROP TABLE t", "SQLI_STACKED"),
    ("SELECT a FROM t WHERE n = 'x' -- y", "SQLI_COMMENT,SQLI_COMMENT"),
    ("SELECT pg_sleep(5)", "SQLI_TIME_BASED"),
    ("SELECT table_name FROM information_schema.tables", "SQLI_META_PROBE"),
    ("SELECT 0xDEADBEEF01", "SQLI_OBFUSCATION"),
    ("SELECT phone, email FROM crm.customer", "MASK_BYPASS"),
    ("SELECT * FROM customer c JOIN orders o ON c.id = o.id", "MASK_BYPASS,SELECT_STAR_SENSITIVE"),
    ("SELECT id FROM orders", ""),
)
ASSETS = [("crm.public.customer.phone", "HIGH", True), ("crm.public.customer.email", "MEDIUM", True), ("crm.public.orders.note", "HIGH", False)]


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with the text of a query each, and what sensitive columns it touches."""
    text = F.get(F.array(*[F.lit(t) for t, _ in ATTACKS]), (F.col("event_id") % len(ATTACKS)).cast("int"))
    events = _events(spark, sf_dir).withColumns({"original_sql": text, "masked": F.col("event_id") % 2 == 0})
    return risk.with_features(events, spark.createDataFrame(ASSETS, "key string, sensitivity string, enabled boolean"))


def e_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the rules that look at one event, over all events."""
    found = risk.scored(_queries(spark, sf_dir).withColumn("hits", risk.stateless_hits(large=90)))
    return found.select("event_id", F.array_join(F.sort_array(F.transform("hits", lambda h: h["rule"])), ",").alias("rules"), "score", "top_severity")


def e_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _queries(spark, sf_dir)
    return found.select("event_id", "select_star", F.array_join("matched_tables", ",").alias("tables"), F.array_join(F.transform("sensitive_columns", lambda c: c["key"]), ",").alias("touched"))


def r8_sensitive_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that bring the user's count of queries on sensitive columns in 24 hours to 2, 4, ..."""
    return risk.burst(_queries(spark, sf_dir), risk.touches("MEDIUM"), 86_400, 2).select("event_id", F.col("burst_count").alias("n"))


def e16_asset_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.asset_access(_queries(spark, sf_dir))


def e17_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.search(_scored(spark, sf_dir), severity="high", rule="FAILED", keyword="7", minutes=60 * 24 * 20, now="2024-01-31 00:00:00").select("event_id")


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.alerts(_typed_hits(_events(spark, sf_dir)), cooldown=86_400)
    return found.withColumn("status", F.when(F.col("event_count") > 1, "OPEN").otherwise("ACK"))


def e18_alert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.alert_search(_alerts(spark, sf_dir), "open", "high", "error", "3").select("rule", "user", F.col("alert_no").cast("long").alias("alert_no"), "event_count")


def e18_alert_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = risk.alert_detail(_alerts(spark, sf_dir), _events(spark, sf_dir).drop("user"))
    return found.select("rule", F.col("alert_user").alias("user"), F.col("alert_no").cast("long").alias("alert_no"), "event_id", "event_type", "row_count")


def e14_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.alert_overview(_alerts(spark, sf_dir), "2024-01-10 00:00:00")


def k3_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.classification_overview(k1_classification(spark, sf_dir))


def e19_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.rule_hits(_scored(spark, sf_dir))


def e20_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.board(_events(spark, sf_dir), "2024-01-20 00:00:00", seconds=86_400 * 5, bursting=3)


def e21_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A custom rule over the last 5000 events, as the reading of a dry run has it."""
    found = risk.dry_run(_events(spark, sf_dir), [("outcome", "eq", "failure"), ("rowCount", "gt", "20")], 99_999)
    return found.select("tested", "hits", F.array_join("samples", ",").alias("samples"))


def e8_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return risk.recent(_events(spark, sf_dir), 1000, "ts").select("event_id")


_E = "(SELECT event_id, ts, user_id AS \"user\", event_type, CASE WHEN event_type = 'error' THEN 'FAILURE' ELSE 'SUCCESS' END AS outcome, floor(value)::BIGINT AS row_count FROM events)"
_DAY = "OVER (PARTITION BY \"user\" ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW)"
_PROFILE = f"""(SELECT "user", count(*) AS events, round(count(*) / greatest(1, ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / 3600000000.0)), 2) AS rate_per_hour, count(row_count) AS samples,
  floor(median(row_count))::BIGINT AS median_rows, count(*) FILTER (WHERE hour(ts) = 0) AS h0, count(*) FILTER (WHERE hour(ts) = 12) AS h12 FROM {_E} GROUP BY 1)"""
_SCORED = f"(SELECT *, least(100, CASE WHEN outcome = 'FAILURE' THEN 20 ELSE 0 END + CASE WHEN row_count >= 50 THEN 10 ELSE 0 END) AS score, CASE WHEN outcome = 'FAILURE' THEN 'HIGH' WHEN row_count >= 50 THEN 'MEDIUM' ELSE 'INFO' END AS top_severity FROM {_E})"
_RULES = "".join(f"WHEN regexp_matches(lower(column_name), '{'|'.join(r[0])}') THEN {{}}[{i + 1}] " for i, r in enumerate(catalog.NAME_RULES))


def _guess(pick: int) -> str:
    values = "[" + ", ".join(f"'{r[pick]}'" for r in catalog.NAME_RULES) + "]"
    return f"CASE {_RULES.format(*[values] * len(catalog.NAME_RULES))} END"


EVENT_SQL = {
    "e7_sliding_count": f"SELECT event_id, count(*) {_DAY} AS n FROM {_E}",
    "r9_failure_burst": f"SELECT event_id, n FROM (SELECT *, count(*) FILTER (WHERE outcome = 'FAILURE') {_DAY} AS n FROM {_E}) WHERE outcome = 'FAILURE' AND n >= 2 AND n % 2 = 0",
    "r10_off_hours": f"SELECT event_id FROM {_E} WHERE hour(ts) < 8 OR hour(ts) >= 19",
    "r14_first_touch": f'SELECT event_type, "user", event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, "user" ORDER BY ts, event_id) AS k FROM {_E}) WHERE k = 1',
    "r15_baseline": f"""WITH p AS {_PROFILE}, h AS (SELECT "user", hour(ts) AS hr, count(*) AS c FROM {_E} GROUP BY 1, 2),
        x AS (SELECT e.event_id, e.n >= 4 AND e.n * 3600.0 / 86400 >= 2 * p.rate_per_hour AS fast, coalesce(p.samples >= 10 AND e.row_count >= 2 * p.median_rows, FALSE) AS large, p.events >= 30 AND h.c <= 1 AS odd_hour, p.events
              FROM (SELECT *, count(*) {_DAY} AS n FROM {_E}) e JOIN p ON e."user" = p."user" JOIN h ON h."user" = e."user" AND h.hr = hour(e.ts))
        SELECT event_id, fast, large, odd_hour FROM x WHERE events >= 20 AND (fast OR large OR odd_hour)""",
    "e9_profiles": f"SELECT * FROM {_PROFILE}",
    "e12_alerts": f"""WITH h AS (SELECT event_id, ts, "user"::VARCHAR AS "user", event_type AS rule, CASE event_type WHEN 'error' THEN 'HIGH' WHEN 'purchase' THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM {_E}),
        g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY rule, "user" ORDER BY ts, event_id) <= INTERVAL 24 HOURS THEN 0 ELSE 1 END AS fresh FROM h WHERE severity <> 'LOW'),
        a AS (SELECT *, sum(fresh) OVER (PARTITION BY rule, "user" ORDER BY ts, event_id) AS alert_no FROM g)
        SELECT rule, "user", alert_no::BIGINT AS alert_no, count(*) AS event_count, min(severity) AS severity, arg_min(event_id, ts) AS first_id FROM a GROUP BY rule, "user", alert_no""",
    "e5_scores": f"SELECT event_id, score, top_severity, score > 0 AS flagged FROM {_SCORED}",
    "e14_by_severity": f"SELECT s AS top_severity, (SELECT count(*) FROM {_SCORED} x WHERE x.top_severity = s) AS n FROM (VALUES ('INFO'), ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) t(s)",
    "e14_overview": f"SELECT count(*) AS events, count(*) FILTER (WHERE score > 0) AS flagged, round(100.0 * count(*) FILTER (WHERE score > 0) / count(*), 1) AS hit_rate, round(avg(score), 1) AS avg_score FROM {_SCORED}",
    "l8_top_users": f'SELECT "user", count(*) AS n FROM {_E} GROUP BY 1 ORDER BY n DESC, "user" LIMIT 8',
    "j7_asof": f"SELECT l.event_id, r.event_id AS error_id FROM (SELECT * FROM {_E} WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM {_E} WHERE event_type = 'error') r ON l.\"user\" = r.\"user\" AND l.ts >= r.ts",
    "e_signatures": f"""WITH a(k, rules, score, top) AS (VALUES {{attacks}}),
        h AS (SELECT event_id, a.rules AS own, CASE WHEN contains(a.rules, 'MASK_BYPASS') AND event_id % 2 = 0 THEN replace(replace(a.rules, 'MASK_BYPASS,', ''), 'MASK_BYPASS', '') ELSE a.rules END AS rules, hour(ts) < 8 OR hour(ts) >= 19 AS off, row_count >= 90 AS large FROM {_E} e JOIN a ON a.k = e.event_id % {len(ATTACKS)}),
        l AS (SELECT event_id, list_sort(list_filter(list_concat(string_split(rules, ','), [CASE WHEN off THEN 'OFF_HOURS_ACCESS' ELSE '' END, CASE WHEN large THEN 'LARGE_RESULT' ELSE '' END]), lambda x: x <> '')) AS r FROM h),
        w AS (SELECT event_id, r, list_transform(r, lambda x: CASE WHEN x IN ('SQLI_TAUTOLOGY', 'SQLI_UNION', 'SQLI_STACKED', 'SQLI_TIME_BASED') THEN 40 WHEN x IN ('SQLI_COMMENT', 'SQLI_META_PROBE', 'SQLI_OBFUSCATION', 'MASK_BYPASS') THEN 20 ELSE 10 END) AS s FROM l)
        SELECT event_id, array_to_string(r, ',') AS rules, least(100, coalesce(list_sum(s), 0))::INT AS score, CASE coalesce(list_max(s), 0) WHEN 40 THEN 'CRITICAL' WHEN 20 THEN 'HIGH' WHEN 10 THEN 'MEDIUM' ELSE 'INFO' END AS top_severity FROM w""".replace("{attacks}", ", ".join(f"({i}, '{r}', 0, '')" for i, (_, r) in enumerate(ATTACKS))),
    "e_features": f"SELECT event_id, event_id % 11 = 9 AS select_star, CASE event_id % 11 WHEN 0 THEN 't' WHEN 1 THEN 't' WHEN 2 THEN 't,u' WHEN 4 THEN 't' WHEN 6 THEN 'information_schema.tables,tables' WHEN 8 THEN 'crm.customer,customer' WHEN 9 THEN 'customer,orders' WHEN 10 THEN 'orders' ELSE '' END AS tables, CASE WHEN event_id % 11 IN (8, 9) THEN 'crm.public.customer.email,crm.public.customer.phone' ELSE '' END AS touched FROM {_E}",
    "r8_sensitive_burst": f"SELECT event_id, n FROM (SELECT *, count(*) FILTER (WHERE event_id % 11 IN (8, 9)) {_DAY} AS n FROM {_E}) WHERE event_id % 11 IN (8, 9) AND n >= 2 AND n % 2 = 0",
    "e16_asset_access": f"""SELECT k AS key, count(*) AS accesses, count(DISTINCT "user") AS users FROM {_E}, (VALUES ('crm.public.customer.email'), ('crm.public.customer.phone')) t(k) WHERE event_id % 11 IN (8, 9) GROUP BY k""",
    "e17_search": f"""SELECT event_id FROM {_SCORED} WHERE outcome = 'FAILURE' AND contains("user"::VARCHAR, '7') AND ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 20 DAYS""",
    "e18_alert_search": f"""SELECT rule, "user", alert_no, event_count FROM ({{alerts}}) WHERE event_count > 1 AND severity = 'HIGH' AND rule = 'error' AND (contains("user", '3') OR contains(rule, '3'))""",
    "e18_alert_detail": f"""SELECT a.rule, a."user", a.alert_no::BIGINT AS alert_no, a.event_id, e.event_type, e.row_count FROM ({{members}}) a JOIN {_E} e ON e.event_id = a.event_id""",
    "e14_alerts": "SELECT count(*) FILTER (WHERE event_count > 1) AS open, count(*) FILTER (WHERE event_count = 1) AS ack, 0::BIGINT AS resolved FROM ({alerts})",
    "e19_rule_hits": f"SELECT 'FAILED' AS rule, count(*) AS hits, count(*) AS events FROM {_E} WHERE outcome = 'FAILURE' UNION ALL SELECT 'LARGE', count(*), count(*) FROM {_E} WHERE row_count >= 50",
    "e20_board": f"""SELECT "user", count(*) AS events, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00') AS recent, count(*) FILTER (WHERE ts > TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00') >= 3 AS bursting FROM {_E} WHERE "user" IS NOT NULL GROUP BY 1 ORDER BY events DESC, "user" LIMIT 20""",
    "e21_dry_run": f"WITH t AS (SELECT * FROM {_E} ORDER BY ts DESC, event_id DESC LIMIT 5000), h AS (SELECT event_id FROM t WHERE outcome = 'FAILURE' AND row_count > 20) SELECT (SELECT count(*) FROM t) AS tested, (SELECT count(*) FROM h) AS hits, (SELECT string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FROM (SELECT event_id FROM h ORDER BY event_id LIMIT 5)) AS samples",
    "e8_recent": f"SELECT event_id FROM {_E} ORDER BY ts DESC, event_id DESC LIMIT 1000",
    "k1_classification": f"SELECT * FROM (SELECT table_name, column_name, {_guess(1)} AS category, {_guess(2)} AS level FROM information_schema.columns WHERE table_name IN {GOVERNED}) WHERE category IS NOT NULL",
}

EVENT_SQL["e14_alerts"] = EVENT_SQL["e14_alerts"].format(alerts=EVENT_SQL["e12_alerts"])
EVENT_SQL["k3_overview"] = f"SELECT table_name, count(*) AS classified, count(*) FILTER (WHERE level = 'LOW') AS low, count(*) FILTER (WHERE level = 'MEDIUM') AS medium, count(*) FILTER (WHERE level = 'HIGH') AS high FROM ({EVENT_SQL['k1_classification']}) GROUP BY ROLLUP (table_name)"
EVENT_SQL["e18_alert_search"] = EVENT_SQL["e18_alert_search"].format(alerts=EVENT_SQL["e12_alerts"])
EVENT_SQL["e18_alert_detail"] = EVENT_SQL["e18_alert_detail"].format(members=EVENT_SQL["e12_alerts"].rpartition("SELECT rule")[0] + 'SELECT rule, "user", alert_no, event_id FROM a')

QUERIES = {k: _secured(v[0], v[1]) for k, v in SECURED.items()} | {
    f.__name__: f for f in (e7_sliding_count, r9_failure_burst, r10_off_hours, r14_first_touch, r15_baseline, e9_profiles, e12_alerts, e5_scores, e14_by_severity, e14_overview, l8_top_users, j7_asof, k1_classification, e_signatures, e_features, r8_sensitive_burst, e16_asset_access, e17_search, e18_alert_search, e18_alert_detail, e14_alerts, k3_overview, e19_rule_hits, e20_board, e21_dry_run, e8_recent)
}
SQL = {k: v[2] for k, v in SECURED.items()} | EVENT_SQL
