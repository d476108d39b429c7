"""Audit events: schema, JSON in and out, and the table sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_SCHEMA = (
    "event_id string, ts timestamp, event_type string, outcome string, service string, source_ip string, user string, auth_kind string, dialect string, "
    "statement_count int, masked boolean, row_filtered boolean, original_sql string, instance string, error_code string, row_count long"
)
_DOCUMENT = "eventType string, service string, outcome string, sourceIp string, actor struct<user:string,authKind:string>, dialect string, statementCount int, masked boolean, rowFiltered boolean, originalSql string, instance string, error struct<code:string,message:string>, detail struct<rowCount:long>, id string"


def _when(raw: Column) -> Column:
    """Epoch milliseconds as a number or text, or an ISO time; else now."""
    return F.coalesce(F.timestamp_millis(F.expr("try_cast(_at AS BIGINT)")), F.expr("try_to_timestamp(_at)"), F.current_timestamp())


def decode(documents: DataFrame, column: str = "value") -> DataFrame:
    """Audit events from JSON text; what does not parse becomes nulls, a missing time now."""
    out = documents.select(F.from_json(column, _DOCUMENT).alias("d"), F.coalesce(F.get_json_object(column, "$['@timestamp']"), F.get_json_object(column, "$.ts")).alias("_at"), F.col(column).alias("_raw"))
    d = F.col("d")
    return out.select(
        F.coalesce(d["id"], F.sha2("_raw", 256)).alias("event_id"), _when(F.col("_at")).alias("ts"), d["eventType"].alias("event_type"), d["outcome"].alias("outcome"), d["service"].alias("service"), d["sourceIp"].alias("source_ip"),
        d["actor"]["user"].alias("user"), d["actor"]["authKind"].alias("auth_kind"), d["dialect"].alias("dialect"), d["statementCount"].alias("statement_count"), d["masked"].alias("masked"), d["rowFiltered"].alias("row_filtered"),
        d["originalSql"].alias("original_sql"), d["instance"].alias("instance"), d["error"]["code"].alias("error_code"), d["detail"]["rowCount"].alias("row_count"),
    )


def encode(events: DataFrame, longest: int = 8192) -> DataFrame:
    """JSON documents; SQL is cut at ``longest`` characters and marked so."""
    cut = F.length("original_sql") > longest
    doc = F.struct(
        F.col("event_id").alias("id"), F.unix_millis("ts").alias("@timestamp"), F.col("event_type").alias("eventType"), "outcome", "service", F.col("source_ip").alias("sourceIp"), F.struct("user", F.col("auth_kind").alias("authKind")).alias("actor"),
        "dialect", F.col("statement_count").alias("statementCount"), "masked", F.col("row_filtered").alias("rowFiltered"), F.substring("original_sql", 1, longest).alias("originalSql"), F.when(cut, True).alias("sqlTruncated"), "instance",
        F.when(F.col("error_code").isNotNull(), F.struct(F.col("error_code").alias("code"))).alias("error"), F.struct(F.col("row_count").alias("rowCount")).alias("detail"),
    )
    return events.select(F.to_json(doc).alias("value"))


def append(events: DataFrame, path: str) -> None:
    """The audit table, by day."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)
