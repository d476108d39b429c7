"""Governed sessions: rows are filtered where a table is read, result columns masked by lineage.

For each subject a new Spark session holds a view of each governed table, already filtered, under the table's
own name; Spark resolves every shape of query to it, and its filter reaches the scan. Masks are one outer
projection, so they run after the user's filters, joins and sorts."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.errors import Code, GovernanceError
from wardstone.functions.masks import MASKS, deploy
from wardstone.plans import lineage
from wardstone.plans.policy import ColumnKey, Item, Policy, PolicyIndex, Resource, Selector, Subject, validate
from wardstone.plans.script import bare, classify, limit_of, requalify, split

#: Expression classes that a row filter may use.
FILTER_NODES = {
    "UnresolvedAttribute", "AttributeReference", "Literal", "And", "Or", "Not", "EqualTo", "EqualNullSafe", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual",
    "Add", "Subtract", "Multiply", "Divide", "Remainder", "UnaryMinus", "UnaryPositive", "IsNull", "IsNotNull", "In", "Alias", "UnresolvedAlias",
}


@dataclass
class StatementPlan:
    """One planned statement; nothing has run."""

    ordinal: int
    sql: str
    kind: str
    frame: DataFrame
    masked: dict[str, str]
    filtered: list[str]
    origins: list[tuple[str, lineage.Origin]]
    target: dict[str, str | None] = field(default_factory=dict)
    inherited: dict[int, list[Policy]] = field(default_factory=dict)


def check_condition(spark: SparkSession, condition: str) -> None:
    """Only comparisons, arithmetic, IN lists and logic over own columns and literals."""
    try:
        parsed = lineage.json.loads(spark._jsparkSession.sessionState().sqlParser().parseExpression(condition).toJSON())
    except Exception as e:
        raise GovernanceError(Code.CONFIG_ERROR, f"row filter {condition!r} does not parse") from e
    kinds = [n["class"].rpartition(".")[2] for n in parsed]
    negated_in = any(a == "Not" and b == "In" for a, b in zip(kinds, kinds[1:], strict=False))
    if bad := [k for k in kinds if k not in FILTER_NODES] + ["NOT IN"] * negated_in:
        raise GovernanceError(Code.CONFIG_ERROR, f"row filter {condition!r} uses {', '.join(sorted(set(bad)))}")


#: Subjects whose sessions are kept.
SESSIONS = 64


class Governance:
    """Governed tables, their policies, and a session for each subject.

    A table's name has one to three parts; missing ones are ``catalog`` and ``schema``. SQL may name it
    by as many parts as tell it apart."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], policies: list[Policy], catalog: str = "spark_catalog", schema: str = "default"):
        self.spark, self.catalog, self.schema = spark, catalog, schema
        self.tables: dict[tuple[str, str, str], DataFrame] = {}
        for name, df in tables.items():
            if (full := self.full_name(name)) in self.tables:
                raise GovernanceError(Code.CONFIG_ERROR, f"{'.'.join(full)} is declared twice")
            self.tables[full] = df
        self.policies, self.version = list(policies), 0
        self._sessions: dict[tuple, SparkSession] = {}
        self._check()

    def full_name(self, name: str, like: tuple[str, str] | None = None) -> tuple[str, str, str]:
        """Three parts of a name; missing ones are those of ``like``, else the defaults."""
        parts = [bare(x) for x in name.split(".")]
        if not 1 <= len(parts) <= 3:
            raise GovernanceError(Code.VALIDATION_ERROR, f"{name} has {len(parts)} parts")
        return (*(like or (self.catalog, self.schema))[: 3 - len(parts)], *parts)

    def key(self, table: str, column: str) -> ColumnKey:
        return ColumnKey(*self.full_name(table), column.lower())

    @property
    def columns(self) -> list[ColumnKey]:
        return [ColumnKey(*t, c.lower()) for t, df in self.tables.items() for c in df.columns]

    def _check(self) -> None:
        validate(self.policies, self.columns)
        for p in self.policies:
            for i in p.items if p.kind == "filter" else ():
                check_condition(self.spark, i.condition)
                for table, df in self.tables.items():
                    if any(r.covers(*table) for r in p.resources):
                        try:
                            df.filter(i.condition)
                        except AnalysisException as e:
                            raise GovernanceError(Code.CONFIG_ERROR, f"{p.name}: {i.condition!r} does not fit {'.'.join(table)}: {str(e).splitlines()[0]}") from e
        self.index = PolicyIndex(self.policies)

    def set_policies(self, policies: list[Policy]) -> None:
        old = self.policies
        self.policies = list(policies)
        try:
            self._check()
        except GovernanceError:
            self.policies = old
            raise
        self.version += 1

    def block(self, user: str, *tables: str) -> None:
        """No rows of the tables for the user, until unblocked."""
        added = []
        for table in tables:
            full = self.full_name(table)
            name = f"block.{user}.{'.'.join(full)}"
            if all(p.name != name for p in self.policies):
                added.append(Policy(name, (Resource(*full),), (Item(Selector(users=(user,)), condition="1 = 0"),), "filter", priority=10_000))
        if added:
            self.set_policies([*self.policies, *added])

    def unblock(self, user: str, *tables: str) -> None:
        gone = {f"block.{user}.{'.'.join(self.full_name(t))}" for t in tables}
        self.set_policies([p for p in self.policies if p.name not in gone])

    def _views(self) -> tuple[dict[tuple[str, ...], str], dict[str, tuple[str, str, str]], frozenset[str]]:
        """Views by qualified name, tables by view, and bare names of several tables."""
        by_name, tables, bare_names = {}, {}, Counter(t[2] for t in self.tables)
        pairs = Counter(t[1:] for t in self.tables)
        for full in self.tables:
            view = "__".join(("governed", *full))
            by_name[full] = view
            if pairs[full[1:]] == 1:
                by_name[full[1:]] = view
            tables[view] = full
            if bare_names[full[2]] == 1:
                tables[full[2]] = full
        return by_name, tables, frozenset(n for n, k in bare_names.items() if k > 1)

    def session(self, subject: Subject) -> SparkSession:
        """The subject's session, kept while tables and policies stay the same; of SESSIONS, the oldest goes."""
        at = (subject, self.version)
        if at not in self._sessions:
            own = self.spark.newSession()
            own.conf.set("spark.sql.runSQLOnFiles", "false")
            deploy(own)
            seen = {}
            for full, df in self.tables.items():
                seen[full] = df
                for c in self.index.filters(subject, full):
                    seen[full] = seen[full].filter(c)
            for view, full in self._views()[1].items():
                _view(own, seen[full], view)
            kept = [(k, v) for k, v in self._sessions.items() if k[1] == self.version][1 - SESSIONS :]
            self._sessions = dict(kept) | {at: own}
        return self._sessions[at]

    def invalidate(self) -> None:
        self.version += 1
        self._sessions.clear()

    def plan(self, subject: Subject, script: str, registered: bool = True, args: list | dict | None = None) -> list[StatementPlan]:
        """Plans of all statements of a script; the first that fails refuses the whole. ``args`` are values
        for ? or :name."""
        plans = []
        for n, sql in enumerate(split(script), 1):
            try:
                plans.append(self._plan(subject, n, sql, registered, args))
            except GovernanceError as e:
                raise GovernanceError(e.code, f"statement {n}: {e}") from e
        return plans

    def secure_sql(self, subject: Subject, sql: str, args: list | dict | None = None) -> DataFrame:
        """The masked, filtered result of one SELECT; lazy."""
        plans = self.plan(subject, sql, args=args)
        if len(plans) != 1 or plans[0].kind != "SELECT":
            raise GovernanceError(Code.UNSUPPORTED_STATEMENT, "exactly one SELECT")
        return plans[0].frame

    def run(self, subject: Subject, script: str) -> list[DataFrame | None]:
        """Plan all, then run the writes in order; SELECTs come back as frames."""
        return [p.frame if p.kind == "SELECT" else self._write(p) for p in self.plan(subject, script)]

    def _analyse(self, session: SparkSession, text: str, args: list | dict | None) -> DataFrame:
        """The analyzed query. Whatever would write or run something is refused: as parsed, before Spark
        analyses it, and as analyzed, before anything runs."""
        state, jvm = session._jsparkSession.sessionState(), session._jvm
        try:
            plan = state.sqlParser().parsePlan(text)
        except Exception as e:
            raise GovernanceError(Code.PARSE_ERROR, str(e).splitlines()[0]) from e
        _refuse_writes(jvm, plan)
        try:
            if args:
                return session.sql(text, args)
            plan = state.executePlan(plan, jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()).analyzed()
            _refuse_writes(jvm, plan)
            return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan), session)
        except AnalysisException as e:
            raise GovernanceError(Code.VALIDATION_ERROR, str(e).splitlines()[0]) from e

    def _plan(self, subject: Subject, ordinal: int, sql: str, registered: bool, args: list | dict | None = None) -> StatementPlan:
        kind, parts = classify(sql)
        by_name, tables, ambiguous = self._views()
        text = requalify(limit_of(parts["source"] if parts else sql), by_name, ambiguous)
        df = self._analyse(self.session(subject), text, args)
        origins = lineage.of(df, tables)
        names = [n for n, _ in origins]
        if parts and (given := _names(parts)):
            if len(given) != len(names) or len({c.lower() for c in given}) < len(given):
                raise GovernanceError(Code.VALIDATION_ERROR, f"{len(given)} target columns for {len(names)} values, or one twice")
        inherited = self._inherited(subject, origins, parts, registered) if parts else {}
        masks: dict[int, Item] = {}
        for i, (name, origin) in enumerate(origins):
            if not origin.known:
                raise GovernanceError(Code.LINEAGE_UNKNOWN, f"column {name!r}")
            decided = [d for c in sorted(origin.columns) if (d := self.index.mask(subject, c))]
            if decided and i not in inherited:
                masks[i] = decided[0][1]
        if masks and len({n.lower() for n in names}) < len(names):
            raise GovernanceError(Code.REWRITE_ERROR, "two columns of one name in a masked result")
        frame = df
        if masks:
            frame = df.select(*[_masked(n, masks[i].udf, masks[i].arguments) if i in masks else _masked(n) for i, n in enumerate(names)])
        filtered = [t[2] for v, t in tables.items() if self.index.filters(subject, t) and re.search(rf"(?i)(?<!\w){re.escape(v)}(?!\w)", text)]
        return StatementPlan(ordinal, sql, kind, frame, {names[i]: m.udf for i, m in masks.items()}, list(dict.fromkeys(filtered)), origins, parts, inherited)

    def _target(self, parts: dict, origins) -> tuple[str, str, str]:
        """The table written to; missing parts are those of the first column's origin."""
        first = next((min(o.columns) for _, o in origins if o.columns), None)
        return self.full_name(parts["target"] or parts["ctas"], first[:2] if first else None)

    def _inherited(self, subject: Subject, origins, parts: dict, registered: bool) -> dict[int, list[Policy]]:
        """Outputs that are copied clean, and the policies that go with them: all that cover the source, so
        that no subject sees more of the copy than of the source. Nothing is written or registered here."""
        out: dict[int, list[Policy]] = {}
        full = self._target(parts, origins)
        for i, ((name, origin), target) in enumerate(zip(origins, _names(parts) or [n for n, _ in origins], strict=False)):
            marked = [c for c in sorted(origin.columns) if self.index.inherits(c)]
            if not marked:
                continue
            if not origin.copy or len(origin.columns) != 1:
                raise GovernanceError(Code.LINEAGE_UNKNOWN, f"{name!r} is made from {marked[0].column!r}, whose policy goes only with plain copies")
            if not registered:
                raise GovernanceError(Code.UNSUPPORTED_STATEMENT, f"{name!r} would take a policy along; this way in registers none")
            column = ColumnKey(*full, target.lower())
            source, own = self.index.covering(marked[0]), self.index.covering(column)
            want = [replace(p, name=f"auto.inherit.{'.'.join(column)}.{p.name}", resources=(Resource(*column, True),)) for p in source]
            alike = sorted(repr((p.priority, p.items)) for p in own) == sorted(repr((p.priority, p.items)) for p in source)
            if not any(p.items for p in source) or (own or full in self.tables) and not alike:
                raise GovernanceError(Code.CONFIG_ERROR, f"{'.'.join(column)} does not have the policies of its source {'.'.join(marked[0])}")
            want = want if not own else []
            out[i] = want
        return out

    def _write(self, plan: StatementPlan) -> None:
        """Register the policies that go along, then write; if the write fails they are taken back."""
        full = self._target(plan.target, plan.origins)
        given, session = _names(plan.target), plan.frame.sparkSession
        table = ".".join(f"`{x}`" for x in full)
        frame = plan.frame.toDF(*given) if given else plan.frame
        there = full in self.tables or session.catalog.tableExists(table)
        if plan.kind == "CTAS" and there:
            if plan.target["exists"]:
                return
            raise GovernanceError(Code.VALIDATION_ERROR, f"table {'.'.join(full)} exists")
        if plan.kind != "CTAS" and not session.catalog.tableExists(table):
            raise GovernanceError(Code.VALIDATION_ERROR, f"no table {'.'.join(full)}")
        added = [p for own in plan.inherited.values() for p in own]
        before = (self.policies, dict(self.tables))
        self.tables.setdefault(full, frame.limit(0))
        try:
            self.set_policies([*self.policies, *added])
            if plan.kind == "CTAS":
                frame.write.saveAsTable(table)
            else:
                if given:
                    own = {c.lower(): c for c in given}
                    frame = frame.select(*[F.col(f"`{own[c.lower()]}`").alias(c) if c.lower() in own else F.lit(None).alias(c) for c in session.table(table).columns])
                    if missing := set(own) - {c.lower() for c in frame.columns}:
                        raise GovernanceError(Code.VALIDATION_ERROR, f"{'.'.join(full)} has no {sorted(missing)}")
                frame.write.insertInto(table, overwrite=plan.target["how"].lower() == "overwrite")
        except Exception:
            self.policies, self.tables = before
            self._check()
            self.invalidate()
            raise
        self.spark.catalog.refreshTable(table)  # the write went through another session
        self.tables[full] = self.spark.table(table)
        self.invalidate()


@lru_cache(maxsize=4096)
def _masked(name: str, udf: str | None = None, arguments: tuple = ()) -> Column:
    """A result column under its own name, masked or as it is; columns are not tied to a plan or session."""
    own = F.col("`" + name.replace("`", "``") + "`")
    return (MASKS[udf](own.cast("string"), *arguments) if udf else own).alias(name)


@lru_cache(maxsize=4)
def _commands(jvm) -> list:
    return [jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{c}") for c in ("Command", "ParsedStatement", "InsertIntoDir")]


def _refuse_writes(jvm, plan) -> None:
    """Commands can stand only at the top, below WITH, or in a multiple insert."""
    bad, todo = _commands(jvm), [plan]
    while todo:
        node = todo.pop()
        if any(c.isInstance(node) for c in bad):
            raise GovernanceError(Code.UNSUPPORTED_STATEMENT, f"{node.nodeName()} in a query")
        if node.nodeName() in ("UnresolvedWith", "WithCTE", "Union"):
            below = node.children()
            todo += [below.apply(i) for i in range(below.size())]


def _names(parts: dict[str, str | None]) -> list[str]:
    """Target columns that a write names."""
    given = parts.get("columns") or parts.get("names")
    return [c.strip(" `\n\t") for c in given.split(",")] if given else []


def _view(session: SparkSession, df: DataFrame, name: str) -> None:
    """Register ``df``'s logical plan as a view of another session."""
    plan = df._jdf.queryExecution().analyzed()
    jdf = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, plan)
    DataFrame(jdf, session).createOrReplaceTempView(name)
