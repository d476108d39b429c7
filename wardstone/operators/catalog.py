"""Control plane: classification, grants, function registry, audit search and the query gateway."""

from __future__ import annotations

import base64
import datetime
import decimal
import math
import re
import threading
import uuid
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.errors import Code, GovernanceError
from wardstone.operators.relational import capped, page
from wardstone.plans.script import classify, split
from wardstone.plans.session import Governance, Subject

#: Categories and levels.
CATEGORIES = ("IDENTITY", "PII", "CONTACT", "FINANCE", "LOCATION", "MEDICAL", "OTHER")
LEVELS = ("LOW", "MEDIUM", "HIGH")
#: Parts of column names, category and level; the first that is contained decides.
NAME_RULES = (
    (("phone", "mobile", "tel", "msisdn"), "CONTACT", "HIGH"),
    (("email", "mail"), "CONTACT", "MEDIUM"),
    (("id_card", "idcard", "identity", "ssn", "passport"), "IDENTITY", "HIGH"),
    (("name", "fullname", "first_name", "last_name", "nickname"), "PII", "MEDIUM"),
    (("birthday", "birth_date", "dob", "age"), "PII", "MEDIUM"),
    (("address", "addr", "city", "country", "zip", "postal"), "LOCATION", "LOW"),
    (("salary", "balance", "amount", "fund", "account_no", "card_no", "bank"), "FINANCE", "HIGH"),
    (("disease", "diagnosis", "medical", "health"), "MEDICAL", "HIGH"),
)


def _first(name: Column, pick: int) -> Column:
    found = [F.when(F.lower(name).rlike("|".join(map(re.escape, r[0]))), F.lit(r[pick])) for r in NAME_RULES]
    return F.coalesce(*found)


def classify_columns(columns: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(table_name, column_name, category, level, source) for columns whose name meets a rule and that
    have no classification yet; existing ones are never replaced."""
    out = columns.select("table_name", "column_name", _first(F.col("column_name"), 1).alias("category"), _first(F.col("column_name"), 2).alias("level"), F.lit("AUTO").alias("source")).where("category is not null")
    return out.join(existing, ["table_name", "column_name"], "left_anti") if existing is not None else out


def check_classification(category: str, level: str) -> tuple[str, str]:
    category, level = category.strip().upper(), level.strip().upper()
    if category not in CATEGORIES or level not in LEVELS:
        raise GovernanceError(Code.CONFIG_ERROR, f"no category {category!r} or level {level!r}")
    return category, level


def classification_overview(found: DataFrame) -> DataFrame:
    """Counts by table, and of all tables in a row with a null name."""
    return found.rollup("table_name").agg(F.count("*").alias("classified"), *[F.count_if(F.col("level") == v).alias(v.lower()) for v in LEVELS])


@dataclass(frozen=True, order=True)
class Grant:
    principal: str
    resource: str
    privilege: str
    depth: str = "table"

    def __post_init__(self):
        if len(self.resource.split(".")) != {"catalog": 1, "schema": 2, "table": 3, "column": 4}[self.depth]:
            raise GovernanceError(Code.CONFIG_ERROR, f"{self.resource!r} is no {self.depth}")


@dataclass
class Grants:
    """A set of grants: giving one twice, or taking away what is not there, changes nothing."""

    entries: set[Grant] = field(default_factory=set)

    def give(self, grant: Grant) -> None:
        self.entries.add(grant)

    def take(self, grant: Grant) -> None:
        self.entries.discard(grant)

    def matrix(self, spark: SparkSession) -> DataFrame:
        rows = spark.createDataFrame([(g.principal, g.resource, g.privilege) for g in sorted(self.entries)], "principal string, resource string, privilege string")
        return rows.groupBy("principal").agg(F.sort_array(F.collect_list(F.struct("resource", "privilege"))).alias("grants"))

    def preview(self, dialect: str) -> list[str]:
        """GRANT statements for an engine; comments for those without."""
        out = []
        for g in sorted(self.entries):
            if not all(re.fullmatch(r"\w+", x) for x in (g.principal, g.privilege, *g.resource.split("."))):
                raise GovernanceError(Code.CONFIG_ERROR, f"{g} has characters other than letters, digits and _")
            table = ".".join(g.resource.split(".")[1:3])
            if dialect == "postgresql":
                out.append(f'GRANT {g.privilege} ON {table} TO "g_{g.principal}"')
            elif dialect == "mysql":
                out.append(f"GRANT {g.privilege} ON {table} TO '{g.principal}'")
            else:
                out.append(f"-- {dialect}: GRANT {g.privilege} ON {table} TO {g.principal}")
        return out


@dataclass(frozen=True)
class Signature:
    name: str
    arguments: tuple[str, ...]


#: Families of scalar types.
FAMILIES = {"string": "text", "char": "text", "varchar": "text", "byte": "number", "short": "number", "int": "number", "bigint": "number", "float": "number", "double": "number", "decimal": "number", "boolean": "boolean"}


def check_signature(signature: Signature) -> Signature:
    """The signature, if its name is a plain identifier and it takes at least one argument, all of known types."""
    if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", signature.name) or not signature.arguments:
        raise GovernanceError(Code.CONFIG_ERROR, f"{signature.name!r} is no name, or takes no argument")
    if bad := [a for a in signature.arguments if a.split("(")[0].strip().lower() not in FAMILIES]:
        raise GovernanceError(Code.CONFIG_ERROR, f"{signature.name}: no types {bad}")
    return signature


def import_functions(registered: set[Signature], found: set[Signature]) -> tuple[set[Signature], dict[str, list[str]]]:
    """The registry with an engine's functions, and the names created, updated (other overloads than before)
    and skipped (nothing new, or a signature that does not check)."""
    report: dict[str, list[str]] = {"created": [], "updated": [], "skipped": []}
    out = set(registered)
    for name in sorted({s.name for s in found}):
        own = set()
        for s in found:
            if s.name == name:
                try:
                    own.add(check_signature(s))
                except GovernanceError:
                    continue
        old = {s for s in registered if s.name == name}
        report["skipped" if not own or own == old else "updated" if old else "created"].append(name)
        if own:
            out = (out - old) | own
    return out, report


def resolve(signatures: list[Signature], name: str, column_type: str, arguments: tuple[object, ...]) -> Signature:
    """The overload that fits: by number of arguments, then by family of each, then an exact first type."""
    kinds = [FAMILIES.get(column_type), *["boolean" if isinstance(a, bool) else "number" if isinstance(a, (int, float)) else "text" for a in arguments]]
    fits = [s for s in signatures if s.name == name and len(s.arguments) == len(kinds) and all(FAMILIES.get(t) == k for t, k in zip(s.arguments, kinds, strict=True))]
    fits.sort(key=lambda s: s.arguments[0] != column_type)
    if not fits:
        raise GovernanceError(Code.CONFIG_ERROR, f"no {name} for {column_type} and {arguments}")
    return fits[0]


def resync(registered: set[Signature], found: set[Signature]) -> dict[str, set]:
    """What a registry and an engine differ in."""
    by_name = lambda s: {x.name for x in s}
    changed = {s for s in found - registered if s.name in by_name(registered)}
    return {"added": {s for s in found - registered if s.name not in by_name(registered)}, "missing": {s for s in registered if s.name not in by_name(found)}, "changed": changed}


def session_functions(spark: SparkSession) -> set[str]:
    return {f.name for f in spark.catalog.listFunctions() if f.isTemporary}


def removal_blockers(governance: Governance, udf: str) -> list[str]:
    """Policies that would not resolve without the function."""
    return [p.name for p in governance.policies if any(i.udf == udf for i in p.items)]


def audit_search(audit: DataFrame, number: int = 0, size: int = 50, since: str | None = None, until: str | None = None, **equal: str) -> tuple[DataFrame, int]:
    """A page of audit events by equal fields and an inclusive time range, newest first, and the count."""
    for c, v in equal.items():
        audit = audit.where(F.col(c) == v)
    audit = audit.where(F.col("ts") >= F.lit(since).cast("timestamp")) if since else audit
    audit = audit.where(F.col("ts") <= F.lit(until).cast("timestamp")) if until else audit
    return page(audit, number, size, F.desc("ts"), F.desc("event_id")), audit.count()


def encode(value: object) -> object:
    """A value for JSON: NaN and infinities, times and other types as text, bytes as base64."""
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else str(value)
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (datetime.date, datetime.datetime, datetime.time)):
        return value.isoformat()
    return [encode(v) for v in value] if isinstance(value, (list, tuple)) else str(value)


@dataclass(frozen=True)
class Options:
    """Options of an instance. on_failure: what happens to a query that cannot be governed, REFUSE or, for
    instances without any policy, PASSTHROUGH."""

    submitter: str = "spark"
    on_failure: str = "REFUSE"
    at_once: int = 10
    seconds: float = 30
    hard: int = 10_000
    insert_overwrite: bool = True

    def __post_init__(self):
        if self.on_failure not in ("REFUSE", "PASSTHROUGH") or self.at_once < 1 or self.hard < 1:
            raise GovernanceError(Code.CONFIG_ERROR, f"{self}")


class Submitters:
    """Ways of running a planned query by name; a blank name is the first, an unknown one an error."""

    def __init__(self, **ways):
        self.ways = ways

    def get(self, name: str | None):
        if not (name or "").strip():
            return next(iter(self.ways.values()))
        if name not in self.ways:
            raise GovernanceError(Code.CONFIG_ERROR, f"no submitter {name!r}")
        return self.ways[name]


class Gateway:
    """Runs single SELECTs for subjects, so many at once and so long each; failures to plan are refused, but
    for PASSTHROUGH, which runs a SELECT whose lineage is unknown as it stands where no policy exists."""

    def __init__(self, governance: Governance, at_once: int = 10, seconds: float = 30, hard: int = 10_000, options: Options | None = None, submitters: Submitters | None = None):
        options = options or Options(at_once=at_once, seconds=seconds, hard=hard)
        self.governance, self.options, self.seconds, self.hard = governance, options, options.seconds, options.hard
        self.submit = (submitters or Submitters(spark=capped)).get(options.submitter)
        self._slots = threading.BoundedSemaphore(options.at_once)
        self._running: dict[str, threading.Event] = {}

    def running(self) -> list[str]:
        return sorted(self._running)

    def cancel(self, query: str) -> bool:
        """Stop a running query by its id; False if there is none."""
        if query not in self._running:
            return False
        self._running[query].set()
        self.governance.spark.sparkContext.cancelJobGroup(query)
        return True

    def _frame(self, subject: Subject, sql: str) -> tuple[DataFrame, list[str]]:
        try:
            plan = self.governance.plan(subject, sql)[0]
            return plan.frame, sorted(plan.masked)
        except GovernanceError as e:
            if self.options.on_failure != "PASSTHROUGH" or self.governance.policies or e.code is not Code.LINEAGE_UNKNOWN:
                raise
            return self.governance.session(subject).sql(sql), []

    def query(self, subject: Subject, sql: str, max_rows: int | None = None) -> dict[str, object]:
        statements = split(sql)
        if len(statements) != 1 or classify(statements[0])[0] != "SELECT":
            raise GovernanceError(Code.UNSUPPORTED_STATEMENT, "exactly one SELECT")
        if not self._slots.acquire(blocking=False):
            raise GovernanceError(Code.QUERY_FAILED, "too many queries at once")
        context, group = self.governance.spark.sparkContext, f"gateway-{uuid.uuid4().hex}"
        late, stopped = threading.Event(), threading.Event()

        def stop():
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(self.seconds, stop)
        self._running[group] = stopped
        try:
            frame, masked = self._frame(subject, statements[0])
            context.setJobGroup(group, "governed query", interruptOnCancel=True)
            timer.start()
            rows, more = self.submit(frame, max_rows, hard=self.hard)
            return {"id": group, "columns": frame.columns, "rows": [[encode(v) for v in r] for r in rows], "truncated": more, "masked": masked}
        except PySparkException as e:
            raise GovernanceError(Code.QUERY_TIMEOUT if late.is_set() else Code.QUERY_FAILED, "the query was cancelled" if stopped.is_set() else "the query did not finish") from e
        finally:
            timer.cancel()
            self._running.pop(group, None)
            context.setLocalProperty("spark.jobGroup.id", None)
            self._slots.release()
