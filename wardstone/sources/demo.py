"""Made-up audit events, the same on every call: a quiet day and four stories that the risk rules tell."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import DataFrame, SparkSession

from wardstone.sources.audit import AUDIT_SCHEMA

START = dt.datetime(2024, 5, 6, 9)
STORIES = ("quiet", "brute force", "injection", "night export", "newcomer")


def _story(name: str, rng: random.Random) -> list[tuple[float, str, str, str, bool, int]]:
    """(seconds, user, outcome, SQL, masked, rows) of one story."""
    if name == "quiet":
        return [(rng.uniform(0, 30_000), rng.choice(("ann", "bo", "cy")), "SUCCESS", f"SELECT id FROM crm.orders WHERE id = {rng.randrange(900)}", True, rng.randrange(1, 40)) for _ in range(120)]
    if name == "brute force":
        return [(7_200 + 4 * k, "mallory", "FAILURE", "SELECT id FROM crm.orders", False, 0) for k in range(12)]
    if name == "injection":
        texts = ("SELECT id FROM crm.orders WHERE id = 1 OR 1=1", "SELECT id FROM t UNION SELECT secret FROM u", "SELECT 1; DROP TABLE t", "SELECT pg_sleep(9)", "SELECT table_name FROM information_schema.tables")
        return [(9_000 + 30 * k, "eve", "SUCCESS", t, True, 1) for k, t in enumerate(texts)]
    if name == "night export":
        return [(61_200 + 2 * k, "oscar", "SUCCESS", "SELECT phone, email FROM crm.customer", False, 5_000) for k in range(20)]
    return [(12_000, "newt", "SUCCESS", "SELECT phone FROM crm.customer", True, 3)]


def events(spark: SparkSession, stories: tuple[str, ...] = STORIES, seed: int = 42, start: dt.datetime = START) -> DataFrame:
    """Audit events of the stories in order of time."""
    rng, rows = random.Random(seed), []
    told = sorted(x for name in stories for x in _story(name, rng))
    for k, (s, user, outcome, sql, masked, n) in enumerate(told):
        rows.append((f"demo-{k:05}", start + dt.timedelta(seconds=s), "QUERY", outcome, "gateway", "10.0.0.7", user, "token", "postgresql", 1, masked, False, sql, "demo", None if outcome == "SUCCESS" else "QUERY_FAILED", n))
    return spark.createDataFrame(rows, AUDIT_SCHEMA)
