"""Masking functions as column expressions, and as SQL functions of a session. NULL gives NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n)


def mask_phone(v: Column, front: int = 3, back: int = 4) -> Column:
    n = F.length(v)
    return F.when(n <= front + back, _stars(n)).otherwise(F.concat(F.substring(v, 1, front), _stars(n - front - back), F.right(v, F.lit(back))))


def mask_email(v: Column) -> Column:
    at = F.instr(v, "@")
    return F.when(at == 0, _stars(F.length(v))).otherwise(F.concat(F.substring(v, 1, 1), F.lit("***"), F.substr(v, at)))


def mask_name(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 1, _stars(n)).otherwise(F.concat(F.substring(v, 1, 1), _stars(n - 2), F.right(v, F.lit(1))))


def mask_idcard(v: Column, keep: int = 4) -> Column:
    n = F.length(v)
    return F.when(n <= 6 + keep, _stars(n)).otherwise(F.concat(F.substring(v, 1, 6), _stars(n - 6 - keep), F.right(v, F.lit(keep))))


def mask_text(v: Column) -> Column:
    return F.when(v.isNotNull(), F.lit("***"))


def mask_hash(v: Column, algorithm: str = "sha256") -> Column:
    if algorithm not in ("sha256", "md5"):
        raise ValueError(f"no digest {algorithm!r}")
    return F.sha2(v, 256) if algorithm == "sha256" else F.md5(v)


def mask_custom(v: Column) -> Column:
    return F.concat(F.lit("***"), F.substring(F.md5(v), 1, 8))


MASKS: dict[str, Callable[..., Column]] = {f.__name__: f for f in (mask_phone, mask_email, mask_name, mask_idcard, mask_text, mask_hash, mask_custom)}

#: Bodies of the same functions for CREATE FUNCTION, with their further parameters.
SQL_BODIES: dict[str, tuple[str, str]] = {
    "mask_phone": (", f INT DEFAULT 3, b INT DEFAULT 4", "CASE WHEN length(v) <= f + b THEN repeat('*', length(v)) ELSE concat(left(v, f), repeat('*', length(v) - f - b), right(v, b)) END"),
    "mask_email": ("", "CASE WHEN instr(v, '@') = 0 THEN repeat('*', length(v)) ELSE concat(left(v, 1), '***', substr(v, instr(v, '@'))) END"),
    "mask_name": ("", "CASE WHEN length(v) <= 1 THEN repeat('*', length(v)) ELSE concat(left(v, 1), repeat('*', length(v) - 2), right(v, 1)) END"),
    "mask_idcard": (", k INT DEFAULT 4", "CASE WHEN length(v) <= 6 + k THEN repeat('*', length(v)) ELSE concat(left(v, 6), repeat('*', length(v) - 6 - k), right(v, k)) END"),
    "mask_text": ("", "CASE WHEN v IS NOT NULL THEN '***' END"),
    "mask_hash": (", a STRING DEFAULT 'sha256'", "CASE WHEN a = 'md5' THEN md5(v) ELSE sha2(v, 256) END"),
    "mask_custom": ("", "concat('***', left(md5(v), 8))"),
}


def deploy(session: SparkSession, names: list[str] | None = None) -> None:
    """Create the masks as temporary SQL functions of the session."""
    for name in names or SQL_BODIES:
        more, body = SQL_BODIES[name]
        session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v STRING{more}) RETURNS STRING RETURN {body}")
