"""Risk analytics over audit events: features, rules, scores, profiles, alerts and dashboards.

Events have event_id, ts, user, outcome, event_type, original_sql, masked, row_count (see AUDIT_SCHEMA in
``wardstone.sources.audit``); each function names the columns that it reads. Times are session-zone UTC.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities in rising order with their weights.
WEIGHTS = {"INFO": 2, "LOW": 5, "MEDIUM": 10, "HIGH": 20, "CRITICAL": 40}

#: Signatures by rule, matched anywhere without regard to case; each match is a hit.
SIGNATURES = {
    "SQLI_TAUTOLOGY": (r"\bor\s+1\s*=\s*1\b", r"\bor\s+'([^']*)'\s*=\s*'\1'", r"\bor\s+(true|false)\b", r"(?<!['\w])'(\w)'\s*=\s*'\1'(?!\w)"),
    "SQLI_UNION": (r"\bunion\s+(all\s+)?select\b",),
    "SQLI_STACKED": (r";\s*(select|insert|update|delete|drop|alter|create|truncate|grant|revoke|copy|merge)\b",),
    "SQLI_COMMENT": (r"'\s*(--|#|/\*)", r"\bwhere\s+\S+\s*=\s*\S+\s*--", r"/\*.*\*/"),
    "SQLI_TIME_BASED": (r"\bpg_sleep\s*\(", r"\bsleep\s*\(", r"\bbenchmark\s*\(", r"waitfor\s+delay"),
    "SQLI_META_PROBE": (r"\binformation_schema\b", r"\bpg_catalog\b", r"\bpg_tables\b", r"\bmysql\s*\.\s*(user|schema|db)\b", r"\bsqlite_master\b"),
    "SQLI_OBFUSCATION": (r"0x[0-9a-fA-F]{8,}", r"\bchr?\s*\(\s*\d+\s*\)", r"'\s*\|\|\s*'"),
}
#: Severity of each rule.
SEVERITY = {
    "SQLI_TAUTOLOGY": "CRITICAL", "SQLI_UNION": "CRITICAL", "SQLI_STACKED": "CRITICAL", "SQLI_COMMENT": "HIGH", "SQLI_TIME_BASED": "CRITICAL", "SQLI_META_PROBE": "HIGH", "SQLI_OBFUSCATION": "HIGH",
    "SENSITIVE_BURST": "HIGH", "FAILURE_BURST": "HIGH", "OFF_HOURS_ACCESS": "MEDIUM", "LARGE_RESULT": "MEDIUM", "SELECT_STAR_SENSITIVE": "MEDIUM", "MASK_BYPASS": "HIGH", "NEW_SUBJECT_SENSITIVE": "LOW", "BEHAVIOR_BASELINE": "MEDIUM",
}

#: Fixed value: SELECT * as the rules see it.
SELECT_STAR = r"(?is)\bselect\s+(distinct\s+)?\*"


def table_names(text: Column) -> Column:
    """Names after FROM and JOIN in lower-case text, qualified ones in one piece, without quotes: the text is
    cut into words at blanks, commas and brackets, and the words that follow these two are taken."""
    joined = F.regexp_replace(F.translate(text, '"', ""), r"\s*\.\s*", ".")
    words = F.filter(F.split(joined, r"[\s,();]+"), lambda w: w != "")
    return F.filter(words, lambda w, i: F.get(words, i - 1).isin("from", "join") & F.lower(w).rlike("^[a-z_]"))


def weight(severity: Column) -> Column:
    """Weight of a severity's name; an unknown name counts as MEDIUM."""
    pairs = [F.when(F.upper(severity) == k, F.lit(v)) for k, v in WEIGHTS.items()]
    return F.coalesce(*pairs, F.lit(WEIGHTS["MEDIUM"]))


def rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(severity) == k, F.lit(i)) for i, k in enumerate(WEIGHTS)], F.lit(2))


def with_features(events: DataFrame, assets: DataFrame, sql: str = "original_sql") -> DataFrame:
    """select_star, matched_tables, and sensitive_columns (array of key and sensitivity).

    ``assets`` (key, sensitivity, enabled) is a declared dimension table; its tokens are matched as whole
    words, in one scan per event: words of the text are joined to the assets by table word.
    """
    text = F.lower(F.coalesce(F.col(sql), F.lit("")))
    refs = table_names(text)
    out = events.withColumn("select_star", F.coalesce(F.col(sql).rlike(SELECT_STAR), F.lit(False)))
    out = out.withColumn("matched_tables", F.array_distinct(F.concat(refs, F.transform(refs, lambda r: F.element_at(F.split(r, r"\."), -1)))))
    known = assets.where("enabled").select("key", "sensitivity", F.element_at(F.split(F.lower("key"), r"\."), -2).alias("_table"), F.element_at(F.split(F.lower("key"), r"\."), -1).alias("_column"))
    words = out.select("event_id", "select_star", F.array_distinct(F.split(text, r"[^\w$]+")).alias("_words"))
    touched = words.select("event_id", "select_star", "_words", F.explode("_words").alias("_table")).join(known, "_table")
    touched = touched.where(F.col("select_star") | F.array_contains("_words", F.col("_column")))
    touched = touched.groupBy("event_id").agg(F.sort_array(F.collect_set(F.struct("key", "sensitivity"))).alias("sensitive_columns"))
    empty = F.array().cast("array<struct<key:string,sensitivity:string>>")
    return out.join(touched, "event_id", "left").withColumn("sensitive_columns", F.coalesce("sensitive_columns", empty))


def touches(severity: str) -> Column:
    """An event touches a sensitive column of this sensitivity or more."""
    return F.exists("sensitive_columns", lambda c: rank(c["sensitivity"]) >= list(WEIGHTS).index(severity))


def with_window_counts(events: DataFrame, user: str, at: str, seconds: float, **conditions: Column) -> DataFrame:
    """``events`` with, for each condition, how many events of the user meet it in the ``seconds`` up to and
    with each event, by event time.

    Time is cut into stretches of eight windows, so one user's events, or those of all null users, do not
    gather in one task; events in the last window of a stretch also stand at the head of the next."""
    width = max(1, int(seconds * 1e6))
    t = F.unix_micros(F.col(at).cast("timestamp"))
    own = F.floor(t / (8 * width)).cast("long")
    late = t >= (own + 1) * (8 * width) - width
    cut = events.withColumns({f"_is_{n}": c for n, c in conditions.items()}).withColumns({"_t": t, "_own": own})
    cut = cut.withColumn("_stretch", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(user, "_stretch").orderBy("_t").rangeBetween(-width, 0)
    counted = cut.withColumns({n: F.count(F.when(F.col(f"_is_{n}"), 1)).over(w) for n in conditions})
    return counted.where(F.col("_stretch").eqNullSafe(F.col("_own"))).select(*events.columns, *conditions)


def burst(events: DataFrame, condition: Column, seconds: float, threshold: int, user: str = "user", at: str = "ts", name: str = "burst_count") -> DataFrame:
    """Events that bring the user's count of such events in the window to a multiple of the threshold."""
    counted = with_window_counts(events, user, at, seconds, **{name: condition})
    return counted.where(condition & F.col(user).isNotNull() & (F.col(name) >= threshold) & (F.col(name) % threshold == 0))


def first_touch(events: DataFrame, thing: str, user: str = "user", at: str = "ts", id_: str = "event_id") -> DataFrame:
    """The first event of each thing and user; pre-aggregated before the shuffle."""
    return events.groupBy(thing, user).agg(F.min(F.struct(F.col(at), F.col(id_))).alias("_first")).select(thing, user, F.col("_first")[at].alias(at), F.col("_first")[id_].alias(id_))


def profiles(events: DataFrame, user: str = "user", at: str = "ts", rows: str = "row_count") -> DataFrame:
    """Per user: events, rate per hour of the span (an hour at least), events by hour of day, row samples
    and their median (the floor of the mean of the middle two for even numbers).

    Equal row counts of a user are combined before the median is taken from cumulative counts; no list of a
    user's values is built."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    value = F.col(rows).cast("long").alias("_v")
    bins = [F.count_if(F.hour(at) == h).alias(f"h{h}") for h in range(24)]
    by_value = events.groupBy(user, value).agg(F.count("*").alias("_n"), F.min(t).alias("_a"), F.max(t).alias("_b"), *bins)
    have = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    own = Window.partitionBy(user)
    by_value = by_value.withColumns({"_up": F.sum(have).over(own.orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(have).over(own)})
    at_place = lambda k: F.min(F.when((F.col("_up") >= k) & F.col("_v").isNotNull(), F.col("_v")))
    low, high = at_place(F.floor((F.col("_all") + 1) / 2)), at_place(F.floor(F.col("_all") / 2) + 1)
    totals = [F.sum(f"h{h}").alias(f"h{h}") for h in range(24)]
    out = by_value.groupBy(user).agg(F.sum("_n").alias("events"), F.min("_a").alias("_a"), F.max("_b").alias("_b"), *totals, F.max("_all").alias("samples"), F.floor((low + high) / 2).alias("_median"))
    hours = F.greatest(F.lit(1), F.ceil((F.col("_b") - F.col("_a")) / 3_600_000_000))
    return out.select(user, "events", F.round(F.col("events") / hours, 2).alias("rate_per_hour"), F.array(*[f"h{h}" for h in range(24)]).alias("histogram"), "samples", F.col("_median").cast("long").alias("median_rows"))


def baseline(events: DataFrame, known: DataFrame, user: str = "user", at: str = "ts", rows: str = "row_count", seconds: float = 600, least: int = 8, times: float = 5, row_times: float = 5, cold: int = 20) -> DataFrame:
    """Events that differ from the user's profile: a burst, many rows, or an hour hardly seen."""
    joined = with_window_counts(events, user, at, seconds, _n=F.lit(True)).join(known, user)
    fast = (F.col("_n") >= least) & (F.col("_n") * 3600.0 / seconds >= times * F.col("rate_per_hour"))
    large = (F.col("samples") >= 10) & (F.col(rows) >= row_times * F.col("median_rows"))
    odd = (F.col("events") >= 30) & (F.get("histogram", F.hour(at)) <= 1)
    flags = [fast.alias("fast"), large.alias("large"), odd.alias("odd_hour")]
    out = joined.where(F.col("events") >= cold).select(*[F.col(c) for c in events.columns], *[F.coalesce(f, F.lit(False)).alias(n) for f, n in zip(flags, ("fast", "large", "odd_hour"), strict=True)])
    return out.where("fast or large or odd_hour")


def _hit(rule: str, condition: Column) -> Column:
    return F.when(condition, F.struct(F.lit(rule).alias("rule"), F.lit(SEVERITY[rule]).alias("severity")))


def stateless_hits(sql: str = "original_sql", at: str = "ts", rows: str = "row_count", day: tuple[int, int] = (8, 19), large: int = 1000) -> Column:
    """Hits of the rules that look at one event: signatures, off hours, large result, select star, mask bypass."""
    found = [_hit(rule, F.col(sql).rlike(f"(?i){s}")) for rule, own in SIGNATURES.items() for s in own]
    hour, (start, end) = F.hour(at), day
    off = (hour < start) | (hour >= end) if start < end else (hour >= end) & (hour < start)
    found += [
        _hit("OFF_HOURS_ACCESS", off),
        _hit("LARGE_RESULT", F.col(rows) >= large),
        _hit("SELECT_STAR_SENSITIVE", F.col("select_star") & (F.size("sensitive_columns") > 0)),
        _hit("MASK_BYPASS", touches("HIGH") & ~F.coalesce("masked", F.lit(False))),
    ]
    return F.array_compact(F.array(*found))


def evaluate(events: DataFrame, assets: DataFrame, burst_seconds: float = 60, sensitive: int = 10, failures: int = 5) -> DataFrame:
    """Events with features, hits of all fifteen built-in rules, score, top_severity and flagged."""
    out = with_features(events, assets)
    known = profiles(events)
    touched, failed = touches("MEDIUM"), F.col("outcome") == "FAILURE"
    out = with_window_counts(out, "user", "ts", burst_seconds, _s=touched, _f=failed)
    every = lambda n, k: (F.col(n) >= k) & (F.col(n) % k == 0) & F.col("user").isNotNull()
    odd = baseline(events, known).select("event_id", F.lit(True).alias("_odd"))
    high = out.where(touches("HIGH")).select("event_id", "user", "ts", F.explode(F.filter("sensitive_columns", lambda c: rank(c["sensitivity"]) >= 3)).alias("_c")).withColumn("_c", F.col("_c.key"))
    fresh = first_touch(high, "_c").select("event_id").distinct().withColumn("_new", F.lit(True))
    out = out.join(odd, "event_id", "left").join(fresh, "event_id", "left")
    state = F.array_compact(F.array(_hit("SENSITIVE_BURST", touched & every("_s", sensitive)), _hit("FAILURE_BURST", failed & every("_f", failures)), _hit("NEW_SUBJECT_SENSITIVE", F.col("_new")), _hit("BEHAVIOR_BASELINE", F.col("_odd"))))
    return scored(out.withColumn("hits", F.concat(stateless_hits(), state)).drop("_s", "_f", "_odd", "_new"))


def scored(events: DataFrame, hits: str = "hits") -> DataFrame:
    """score (sum of weights, 100 at most), top_severity (INFO without hits) and flagged."""
    score = F.least(F.lit(100), F.aggregate(hits, F.lit(0), lambda a, h: a + weight(h["severity"])))
    top = F.array_max(F.transform(hits, lambda h: rank(h["severity"])))
    worst = F.when(F.size(hits) > 0, F.element_at(F.array(*map(F.lit, WEIGHTS)), F.coalesce(top, F.lit(0)) + 1)).otherwise(F.lit("INFO"))
    return events.withColumns({"score": score, "top_severity": worst, "flagged": F.size(hits) > 0})


def alerts(hits: DataFrame, cooldown: float = 900, least: str = "MEDIUM", rule: str = "rule", user: str = "user", at: str = "ts", severity: str = "severity", id_: str = "event_id", keep: int = 50) -> DataFrame:
    """Hits folded into alerts: per rule and user a new one starts after a gap of more than ``cooldown``
    seconds. first_hit, last_hit, event_count, severity (the highest), event_ids (the first ``keep``).

    Rows are walked by day, and only a row for each day of a rule and user by rule and user, so that a user
    with a large share of all hits is not walked in one task."""
    own = hits.where(rank(F.col(severity)) >= list(WEIGHTS).index(least)).withColumn(user, F.coalesce(F.col(user).cast("string"), F.lit("(unknown)")))
    gap, t = int(cooldown * 1e6), F.unix_micros(F.col(at).cast("timestamp"))
    own = own.withColumns({"_t": t, "_day": F.floor(t / 86_400_000_000)})
    within = Window.partitionBy(rule, user, "_day").orderBy("_t", id_)
    own = own.withColumn("_new", F.coalesce((F.col("_t") - F.lag("_t").over(within) > gap).cast("int"), F.lit(0)))
    own = own.withColumn("_own_no", F.sum("_new").over(within))
    days = own.groupBy(rule, user, "_day").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.sum("_new").alias("_inner"))
    by_day = Window.partitionBy(rule, user).orderBy("_day")
    days = days.withColumn("_head", F.coalesce((F.col("_first") - F.lag("_last").over(by_day) > gap).cast("int"), F.lit(1)))
    days = days.withColumn("_start", F.sum(F.col("_inner") + F.col("_head")).over(by_day) - F.col("_inner"))
    own = own.join(days.select(rule, user, "_day", "_start"), [rule, user, "_day"]).withColumn("alert_no", F.col("_start") + F.col("_own_no"))
    each = own.withColumn("_k", F.row_number().over(Window.partitionBy(rule, user, "alert_no", "_day").orderBy("_t", id_)))
    first = F.collect_list(F.when(F.col("_k") <= keep, F.struct("_t", F.col(id_).alias("id"))))
    each = each.groupBy(rule, user, "alert_no", "_day").agg(F.min(at).alias("first_hit"), F.max(at).alias("last_hit"), F.count("*").alias("event_count"), F.max(rank(F.col(severity))).alias("_top"), first.alias("_ids"))
    return each.groupBy(rule, user, "alert_no").agg(
        F.min("first_hit").alias("first_hit"), F.max("last_hit").alias("last_hit"), F.sum("event_count").alias("event_count"), F.element_at(F.array(*map(F.lit, WEIGHTS)), F.max("_top") + 1).alias("severity"),
        F.transform(F.slice(F.sort_array(F.flatten(F.collect_list("_ids"))), 1, keep), lambda x: x["id"]).alias("event_ids"),
    )


STATES = {"OPEN": ("ACK", "RESOLVED"), "ACK": ("OPEN", "RESOLVED"), "RESOLVED": ("RESOLVED",)}


def move(state: str, to: str) -> str:
    """An alert's next state; anything may be resolved."""
    if to not in STATES[state]:
        raise ValueError(f"{state} to {to}")
    return to


def overview(events: DataFrame) -> DataFrame:
    """One row: events, flagged, hit_rate (percent), avg_score."""
    n, flagged = F.count("*"), F.count_if("flagged")
    return events.agg(n.alias("events"), flagged.alias("flagged"), F.round(F.when(n > 0, 100.0 * flagged / n).otherwise(0.0), 1).alias("hit_rate"), F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 1).alias("avg_score"))


def by_severity(events: DataFrame, column: str = "top_severity") -> DataFrame:
    """Counts by severity, zero rows included."""
    spine = events.sparkSession.createDataFrame([(s,) for s in WEIGHTS], f"{column} string")
    return spine.join(events.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def series(events: DataFrame, bucket: str, start: str, end: str, at: str = "ts", step: str = "interval 1 hour") -> DataFrame:
    """Counts by time bucket from start to end, zero buckets included."""
    counted = events.groupBy(F.date_trunc(bucket, at).alias("bucket")).agg(F.count("*").alias("n"))
    spine = events.sparkSession.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz '{start}', timestamp_ntz '{end}', {step})")).alias("bucket"))
    return spine.join(counted, spine["bucket"] == counted["bucket"].cast("timestamp_ntz"), "left").select(spine["bucket"], F.coalesce("n", F.lit(0)).alias("n"))


def _keyword(frame: DataFrame, word: str, *names: str) -> Column:
    return reduce(Column.__or__, [F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(word.lower())) for c in names if c in frame.columns], F.lit(False))


def search(events: DataFrame, user: str | None = None, event_type: str | None = None, outcome: str | None = None, severity: str | None = None, rule: str | None = None, keyword: str | None = None, minutes: int | None = None, now: str | None = None) -> DataFrame:
    """Events by part of the user, exact type, outcome, severity, rule, a keyword (in SQL, user, address, error
    or a rule's name) and the last minutes up to ``now``; newest first."""
    tests = [F.contains(F.lower("user"), F.lit(user.lower()))] if user else []
    tests += [F.lower(c) == v.lower() for c, v in (("event_type", event_type), ("outcome", outcome), ("top_severity", severity)) if v]
    tests += [F.exists("hits", lambda h: h["rule"] == rule)] if rule else []
    if keyword:
        named = F.exists("hits", lambda h: F.contains(F.lower(h["rule"]), F.lit(keyword.lower()))) if "hits" in events.columns else F.lit(False)
        tests.append(_keyword(events, keyword, "original_sql", "user", "source_ip", "error_code") | named)
    if minutes is not None:
        end = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        tests.append(F.unix_micros(F.col("ts").cast("timestamp")) >= F.unix_micros(end) - minutes * 60_000_000)
    return reduce(DataFrame.where, tests, events).orderBy(F.desc("ts"), F.desc("event_id"))


def alert_search(found: DataFrame, status: str | None = None, severity: str | None = None, rule: str | None = None, keyword: str | None = None) -> DataFrame:
    """Alerts by exact status, severity and rule and a keyword in rule or user; the last hit first."""
    tests = [F.lower(c) == v.lower() for c, v in (("status", status), ("severity", severity), ("rule", rule)) if v]
    tests += [_keyword(found, keyword, "rule", "user")] if keyword else []
    return reduce(DataFrame.where, tests, found).orderBy(F.desc("last_hit"), "rule", "user")


def alert_detail(found: DataFrame, events: DataFrame, id_: str = "event_id") -> DataFrame:
    """Each alert's events, as far as ``event_ids`` lists them: rule, user, alert_no and the event's columns."""
    ids = found.select("rule", F.col("user").alias("alert_user"), "alert_no", F.explode("event_ids").alias(id_))
    return ids.join(events, id_)


def rule_hits(events: DataFrame, hits: str = "hits") -> DataFrame:
    """Hits and events by rule."""
    each = events.select("event_id", F.explode(hits).alias("h")).groupBy(F.col("h.rule").alias("rule"), "event_id").agg(F.count("*").alias("n"))
    return each.groupBy("rule").agg(F.sum("n").alias("hits"), F.count("*").alias("events"))


def board(events: DataFrame, now: str, seconds: float = 600, bursting: int = 8, most: int = 20, user: str = "user", at: str = "ts") -> DataFrame:
    """The users with most events: events, how many in the last ``seconds`` up to ``now``, and whether these
    reach ``bursting``. Null users are left out; one pass, counted before the shuffle."""
    t, end = F.unix_micros(F.col(at).cast("timestamp")), F.unix_micros(F.lit(now).cast("timestamp"))
    recent = F.count_if((t > end - int(seconds * 1e6)) & (t <= end))
    counted = events.where(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("events"), recent.alias("recent"))
    return counted.withColumn("bursting", F.col("recent") >= bursting).orderBy(F.desc("events"), F.asc(user)).limit(most)


def recent(events: DataFrame, most: int, at: str = "arrived", id_: str = "event_id") -> DataFrame:
    """The last ``most`` events by arrival: what a rolling store of that size holds."""
    return events.orderBy(F.desc(at), F.desc(id_)).limit(most)


def dry_run(events: DataFrame, conditions: list[tuple[str, str, str]], limit: int = 1000, samples: int = 5, **window) -> DataFrame:
    """What a custom rule would hit among the last ``limit`` (10 to 5000) events, without any effect: one row
    with tested, hits and the first ``samples`` ids."""
    tested = recent(events, min(5000, max(10, limit)), "ts")
    found = custom(tested, conditions, **window).agg(F.count("*").alias("hits"), F.slice(F.sort_array(F.collect_list(F.col("event_id"))), 1, samples).alias("samples"))
    return tested.agg(F.count("*").alias("tested")).crossJoin(found)  # one row each


def alert_overview(found: DataFrame, since: str) -> DataFrame:
    """One row: alerts that are open, acknowledged, and resolved since a time."""
    resolved = (F.col("status") == "RESOLVED") & (F.col("last_hit") >= F.lit(since).cast("timestamp"))
    return found.agg(F.count_if(F.col("status") == "OPEN").alias("open"), F.count_if(F.col("status") == "ACK").alias("ack"), F.count_if(resolved).alias("resolved"))


class ProfileCache:
    """Profiles read anew once they are older than ``seconds`` (5 at the least); until then events are judged
    against those at hand, stale as they may be."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 300, clock: Callable[[], float] = time.monotonic):
        self.load, self.seconds, self.clock = load, max(5.0, seconds), clock
        self._at, self._held = 0.0, None

    def get(self) -> DataFrame:
        if self._held is None or self.clock() - self._at >= self.seconds:
            old, self._held, self._at = self._held, self.load().persist(), self.clock()
            if old is not None:
                old.unpersist()
        return self._held


#: Fields and operators of custom rules.
FIELDS = {"user": "user", "ip": "source_ip", "eventType": "event_type", "outcome": "outcome", "dialect": "dialect", "masked": "masked", "rowFiltered": "row_filtered", "sql": "original_sql", "errorCode": "error_code", "rowCount": "row_count", "hour": "hour", "instance": "instance", "table": "matched_tables", "column": "sensitive_columns"}
OPERATORS = ("eq", "neq", "contains", "not_contains", "regex", "in", "not_in", "gt", "lt", "startswith", "endswith")


def _text_test(c: Column, op: str, value: str) -> Column:
    own, want = F.lower(F.coalesce(c.cast("string"), F.lit(""))), value.lower()
    listed = [v.strip() for v in want.replace("，", ",").split(",")]
    return {
        "eq": (own == want) | (c.isNull() & F.lit(want in ("", "null"))), "neq": ~((own == want) | (c.isNull() & F.lit(want in ("", "null")))), "contains": F.contains(own, F.lit(want)), "not_contains": ~F.contains(own, F.lit(want)),
        "regex": c.isNotNull() & F.coalesce(c.cast("string"), F.lit("")).rlike(f"(?i){value}") if op == "regex" else F.lit(False), "in": own.isin(listed), "not_in": ~own.isin(listed),
        "gt": F.lit(False), "lt": F.lit(False), "startswith": own.startswith(want), "endswith": own.endswith(want),
    }[op]


def condition(field: str, op: str, value: str) -> Column:
    """One condition of a custom rule as a column."""
    if field not in FIELDS or op not in OPERATORS:
        raise ValueError(f"no field {field!r} or operator {op!r}")
    if field in ("rowCount", "hour"):
        own = F.hour("ts") if field == "hour" else F.coalesce(F.col("row_count"), F.lit(-1))
        if op in ("gt", "lt"):
            return own > float(value) if op == "gt" else own < float(value)
        return _text_test(F.hour("ts") if field == "hour" else F.col("row_count"), op, value)
    c = F.col(FIELDS[field])
    if field in ("masked", "rowFiltered"):
        same = F.coalesce(c, F.lit(False)) == F.lit(value.lower() == "true")
        return same if op == "eq" else ~same if op == "neq" else F.lit(False)
    if field in ("table", "column"):
        each = lambda x: _text_test(x["key"] if field == "column" else x, op.removeprefix("not_") if op != "neq" else "eq", value)
        return ~F.exists(c, each) if op.startswith("not_") or op == "neq" else F.exists(c, each)
    return _text_test(c, op, value)


def custom(events: DataFrame, conditions: list[tuple[str, str, str]], seconds: float | None = None, count: int = 1, by: str = "user") -> DataFrame:
    """Events that meet all conditions; with a window, those that bring their user's or address's count in
    it to a multiple of ``count``."""
    test = reduce(Column.__and__, [condition(*c) for c in conditions])
    if seconds is None:
        return events.where(test)
    return burst(events, F.coalesce(test, F.lit(False)), seconds, count, {"user": "user", "ip": "source_ip"}[by]).drop("burst_count")


def asset_access(events: DataFrame) -> DataFrame:
    """Accesses and distinct users per sensitive column."""
    return events.select("user", F.explode("sensitive_columns").alias("c")).groupBy(F.col("c.key").alias("key")).agg(F.count("*").alias("accesses"), F.count_distinct("user").alias("users"))
