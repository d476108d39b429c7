"""Live audit analytics by Structured Streaming, with the functions that batch uses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardstone.operators import risk
from wardstone.sources.audit import AUDIT_SCHEMA


def read(spark: SparkSession, path: str, schema: str = AUDIT_SCHEMA, files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


#: Most assets that go to all tasks in one array.
FEW_ASSETS = 10_000


def hits(events: DataFrame, assets: DataFrame, few: int = FEW_ASSETS, late: str = "10 minutes") -> DataFrame:
    """One row for each hit of the stateless rules. Assets are a static table, counted first: up to ``few`` stand
    beside each event in one array; more are joined to the words of the text by table, and the hits that an
    event then has for several tables are made one within the watermark."""
    text = F.lower(F.coalesce("original_sql", F.lit("")))
    found = events.withColumn("select_star", F.coalesce(F.col("original_sql").rlike(risk.SELECT_STAR), F.lit(False))).withColumn("_words", F.array_distinct(F.split(text, r"[^\w$]+")))
    parts = F.split(F.lower("key"), r"\.")
    known = assets.where("enabled").select(F.element_at(parts, -2).alias("_table"), F.struct(F.element_at(parts, -2).alias("table"), F.element_at(parts, -1).alias("column"), "key", "sensitivity").alias("_a"))
    sees = lambda a: F.array_contains("_words", a["table"]) & (F.col("select_star") | F.array_contains("_words", a["column"]))
    plain = lambda a: F.struct(a["key"].alias("key"), a["sensitivity"].alias("sensitivity"))
    columns = ("event_id", "ts", "user", "hit.rule", "hit.severity")
    if known.limit(few + 1).count() <= few:
        found = found.join(F.broadcast(known.groupBy().agg(F.collect_list("_a").alias("_assets"))), how="cross")  # one row
        return found.withColumn("sensitive_columns", F.transform(F.filter("_assets", sees), plain)).withColumn("hit", F.explode(risk.stateless_hits())).select(*columns)
    by_asset = F.col("hit.rule").isin("SELECT_STAR_SENSITIVE", "MASK_BYPASS")
    bare = found.withColumn("sensitive_columns", F.array().cast("array<struct<key:string,sensitivity:string>>")).withColumn("hit", F.explode(risk.stateless_hits())).where(~by_asset).select(*columns)
    touched = found.withColumn("_table", F.explode("_words")).join(known.groupBy("_table").agg(F.collect_list("_a").alias("_assets")), "_table")
    touched = touched.withColumn("sensitive_columns", F.transform(F.filter("_assets", sees), plain)).withColumn("hit", F.explode(risk.stateless_hits())).where(by_asset).select(*columns)
    if events.isStreaming:
        return bare.unionByName(touched.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id", "rule"]))
    return bare.unionByName(touched.dropDuplicates(["event_id", "rule"]))


def first_touches(events: DataFrame, thing: str, late: str = "1 day") -> DataFrame:
    """The first event of each thing and user within the watermark; state older than it is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([thing, "user"])


def windowed(events: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None, by: str = "user") -> DataFrame:
    """Counts by tumbling or sliding window; late events count until the watermark passes."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(window.alias("window"), by).agg(F.count("*").alias("n")).select("window.start", "window.end", by, "n")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", by: str = "user") -> DataFrame:
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n"))
    return found.select("w.start", "w.end", by, "n")


ALERTS = "rule string, user string, alert_no int, first_hit timestamp, last_hit timestamp, event_count long, severity string, event_ids array<string>"


def alerts(found: DataFrame, cooldown: float = 900, least: str = "MEDIUM", keep: int = 50, late: str = "10 minutes", keep_days: float = 30) -> DataFrame:
    """Folded alerts, each change as an update of its (rule, user, alert_no). A pair's state goes once the
    watermark is ``keep_days`` past its cooldown; its numbers then start anew, told apart by first_hit."""
    names = list(risk.WEIGHTS)
    state_schema = "alert_no int, first double, last double, n long, rank int, ids array<string>"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        no, first, last, n, top, ids = state.get if state.exists else (0, 0.0, float("-inf"), 0, 0, [])
        ids, out = list(ids), {}
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"]) if not state.hasTimedOut else pd.DataFrame()
        for r in rows.itertuples():
            at = r.ts.timestamp()
            if at - last > cooldown:
                no, first, n, top, ids = no + 1, at, 0, 0, []
            last, n, top = max(last, at), n + 1, max(top, names.index(r.severity))
            ids = ids + [r.event_id] if len(ids) < keep else ids
            out[no] = (key[0], key[1], no, pd.Timestamp(first, unit="s"), pd.Timestamp(last, unit="s"), n, names[top], ids)
        if state.hasTimedOut:
            state.remove()
            return
        state.update((no, first, last, n, top, ids))
        state.setTimeoutTimestamp(max(int((last + cooldown + keep_days * 86_400) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(list(out.values()), columns=["rule", "user", "alert_no", "first_hit", "last_hit", "event_count", "severity", "event_ids"])

    own = found.where(risk.rank(F.col("severity")) >= names.index(least)).withColumn("user", F.coalesce("user", F.lit("(unknown)"))).withWatermark("ts", late)
    return own.groupBy("rule", "user").applyInPandasWithState(fold, ALERTS, state_schema, "update", GroupStateTimeout.EventTimeTimeout)


def store(frame: DataFrame, path: str, checkpoint: str, notify=None, mode: str = "append"):
    """Write each batch to a table; ``notify`` gets its rows of HIGH and more, 64 at the most."""

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(path)
        if notify:
            notify(batch.where(risk.rank(F.col("severity")) >= 3).limit(64).collect())

    return frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()
