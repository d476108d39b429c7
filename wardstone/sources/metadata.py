"""Declared metadata: types of five dialects, YAML in and out, and collection from catalogs."""

from __future__ import annotations

import re

import yaml
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardstone.errors import Code, GovernanceError
from wardstone.plans.policy import parse_yaml

#: Type names by dialect. Parameters are read apart.
_COMMON = {"boolean": T.BooleanType(), "smallint": T.ShortType(), "bigint": T.LongType(), "date": T.DateType(), "integer": T.IntegerType(), "int": T.IntegerType(), "double": T.DoubleType(), "varchar": T.StringType(), "timestamp": T.TimestampNTZType()}
TYPES: dict[str, dict[str, T.DataType]] = {
    "postgresql": _COMMON | {"bool": T.BooleanType(), "int2": T.ShortType(), "int4": T.IntegerType(), "int8": T.LongType(), "real": T.FloatType(), "float4": T.FloatType(), "double precision": T.DoubleType(), "float8": T.DoubleType(), "float": T.DoubleType(), "text": T.StringType(), "timestamptz": T.TimestampType(), "timestamp with time zone": T.TimestampType(), "time": T.StringType(), "timetz": T.StringType()},
    "mysql": _COMMON | {"bool": T.BooleanType(), "tinyint": T.ByteType(), "mediumint": T.IntegerType(), "float": T.FloatType(), "text": T.StringType(), "tinytext": T.StringType(), "mediumtext": T.StringType(), "longtext": T.StringType(), "binary": T.BinaryType(), "varbinary": T.BinaryType(), "datetime": T.TimestampNTZType(), "timestamp": T.TimestampType(), "time": T.StringType()},
    "trino": _COMMON | {"tinyint": T.ByteType(), "real": T.FloatType(), "varbinary": T.BinaryType(), "time": T.StringType(), "timestamp with time zone": T.TimestampType()},
    "hive": _COMMON | {"tinyint": T.ByteType(), "float": T.FloatType(), "string": T.StringType(), "binary": T.BinaryType()},
}
TYPES["sparksql"] = TYPES["hive"]


def resolve_type(declared: str, dialect: str) -> T.DataType:
    """The Spark type of a declaration, or CONFIG_ERROR."""
    text = " ".join(declared.lower().split())
    m = re.fullmatch(r"([a-z][a-z0-9 ]*?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?(\s+with(?:out)? time zone)?", text)
    if not m or dialect not in TYPES:
        raise GovernanceError(Code.CONFIG_ERROR, f"type {declared!r} of {dialect!r}")
    name, p, s = m[1] + (m[4] or "").replace(" without time zone", ""), m[2], m[3]
    if name in ("decimal", "numeric", "dec"):
        if dialect in ("hive", "sparksql") and (p is None or s is None):
            raise GovernanceError(Code.CONFIG_ERROR, f"{declared!r}: precision and scale are both needed")
        if p and int(p) > 38:
            raise GovernanceError(Code.CONFIG_ERROR, f"{declared!r}: precision over 38")
        return T.DecimalType(int(p or 38), int(s or 0))
    if name in ("char", "character"):
        return T.CharType(int(p or 1))
    if name == "varchar" and p:
        return T.VarcharType(int(p))
    if name not in TYPES[dialect]:
        raise GovernanceError(Code.CONFIG_ERROR, f"type {declared!r} of {dialect!r}")
    return TYPES[dialect][name]


def degrade(declared: str, dialect: str) -> tuple[T.DataType, bool]:
    """The type, or text with True where a collected type is outside the vocabulary."""
    try:
        return resolve_type(declared.lower().removesuffix(" unsigned"), dialect), declared.lower().endswith("unsigned")
    except GovernanceError:
        return T.StringType(), True


def load_metadata(text: str, dialect: str = "sparksql") -> dict[tuple[str, str, str], T.StructType]:
    """Tables by lower-case (catalog, schema, name); repeated tables or columns are errors."""
    out: dict[tuple[str, str, str], T.StructType] = {}
    for i, raw in enumerate(parse_yaml(text).get("tables") or []):
        key = tuple(str(raw.get(k, "")).lower() for k in ("catalog", "schema", "name"))
        if key in out or not raw.get("columns"):
            raise GovernanceError(Code.CONFIG_ERROR, f"tables[{i}]: {'.'.join(key)} occurs twice or has no columns")
        names = [c["name"].lower() for c in raw["columns"]]
        if len(set(names)) < len(names):
            raise GovernanceError(Code.CONFIG_ERROR, f"tables[{i}].columns: a name occurs twice")
        out[key] = T.StructType([T.StructField(c["name"].lower(), resolve_type(c["type"], dialect), True, {"declared": c["type"]}) for c in raw["columns"]])
    return out


def dump_metadata(tables: dict[tuple[str, str, str], T.StructType]) -> str:
    out = [{"catalog": k[0], "schema": k[1], "name": k[2], "columns": [{"name": f.name, "type": (f.metadata or {}).get("declared", f.dataType.simpleString())} for f in s]} for k, s in sorted(tables.items())]
    return yaml.safe_dump({"tables": out, "policies": {}}, sort_keys=False)


def import_structure(text: str, dialect: str = "sparksql") -> dict[tuple[str, str, str], T.StructType]:
    """Structure alone: row filters in it are refused."""
    if any("rowFilter" in t for t in parse_yaml(text).get("tables") or []):
        raise GovernanceError(Code.CONFIG_ERROR, "rowFilter in a structure")
    return load_metadata(text, dialect)


def collect(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """(table_name, table_kind, column_name, data_type, ordinal) of the session's catalog."""
    rows = []
    for t in spark.catalog.listTables(schema):
        kind = {"VIEW": "view", "TEMPORARY": "view", "MATERIALIZED_VIEW": "materialized_view"}.get(t.tableType, "table")
        rows += [(t.name, kind, c.name, c.dataType, i) for i, c in enumerate(spark.catalog.listColumns(t.name if t.isTemporary else f"{t.namespace[-1]}.{t.name}"))]
    return spark.createDataFrame(rows, "table_name string, table_kind string, column_name string, data_type string, ordinal int")


#: Schemas that belong to an engine.
SYSTEM_SCHEMAS = {"postgresql": ("information_schema", "pg_catalog", "pg_toast"), "mysql": ("information_schema", "mysql", "performance_schema", "sys"), "trino": ("information_schema",)}
#: Kinds as engines name them.
KINDS = {"BASE TABLE": "table", "FOREIGN": "table", "FOREIGN TABLE": "table", "LOCAL TEMPORARY": "table", "VIEW": "view", "SYSTEM VIEW": "view", "MATERIALIZED VIEW": "materialized_view"}


def catalog_query(dialect: str, views: bool = True) -> str:
    """Columns of all user tables, and of views if asked for, from the engine's information schema. PostgreSQL
    lists materialized views apart."""
    if dialect not in SYSTEM_SCHEMAS:
        raise GovernanceError(Code.CONFIG_ERROR, f"{dialect} is not collected; import its structure")
    shown = {"postgresql": "data_type", "mysql": "column_type", "trino": "data_type"}[dialect]
    system = ", ".join(f"'{x}'" for x in SYSTEM_SCHEMAS[dialect])
    kinds = "" if views else " AND tab.table_type NOT LIKE '%VIEW'"
    query = (
        f"SELECT tab.table_schema, tab.table_name, tab.table_type AS table_kind, col.column_name, col.{shown} AS data_type, col.ordinal_position AS ordinal "
        "FROM information_schema.tables tab INNER JOIN information_schema.columns col ON col.table_schema = tab.table_schema AND col.table_name = tab.table_name "
        f"WHERE tab.table_schema NOT IN ({system}){kinds}"
    )
    if dialect == "postgresql" and views:
        query += (
            " UNION ALL SELECT mv.schemaname, mv.matviewname, 'MATERIALIZED VIEW', att.attname, pg_catalog.format_type(att.atttypid, att.atttypmod), att.attnum "
            "FROM pg_catalog.pg_matviews mv INNER JOIN pg_catalog.pg_attribute att ON att.attrelid = pg_catalog.to_regclass(quote_ident(mv.schemaname) || '.' || quote_ident(mv.matviewname)) AND att.attnum > 0 AND NOT att.attisdropped"
        )
    return query


def function_query(dialect: str) -> str:
    """Functions of the user's schemas with their parameters in order: routine, specific name, position, type."""
    if dialect not in ("postgresql", "mysql"):
        raise GovernanceError(Code.CONFIG_ERROR, f"functions of {dialect} are not collected")
    system = ", ".join(f"'{x}'" for x in SYSTEM_SCHEMAS[dialect])
    return (
        "SELECT fn.routine_schema, fn.routine_name, fn.specific_name, arg.ordinal_position AS position, arg.data_type FROM information_schema.routines fn "
        "LEFT JOIN information_schema.parameters arg ON arg.specific_schema = fn.specific_schema AND arg.specific_name = fn.specific_name AND arg.ordinal_position > 0 "
        f"WHERE fn.routine_type = 'FUNCTION' AND fn.routine_schema NOT IN ({system})"
    )


def signatures(rows: DataFrame) -> DataFrame:
    """(name, arguments) of each overload from the rows of ``function_query``."""
    each = F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "data_type")))
    return rows.groupBy("routine_schema", F.col("routine_name").alias("name"), "specific_name").agg(F.transform(F.array_sort(each), lambda a: a["data_type"]).alias("arguments")).select("name", "arguments")


def collect_jdbc(spark: SparkSession, url: str, dialect: str, views: bool = True, most_tables: int | None = None, **options: str) -> DataFrame:
    """Columns of an engine's tables with kinds in one vocabulary; more than ``most_tables`` are refused."""
    found = spark.read.format("jdbc").options(url=url, query=catalog_query(dialect, views), **options).load()
    if most_tables is not None and found.select("table_schema", "table_name").distinct().count() > most_tables:
        raise GovernanceError(Code.INTROSPECT_ERROR, f"more than {most_tables} tables")
    kind = F.coalesce(*[F.when(F.upper("table_kind") == k, F.lit(v)) for k, v in KINDS.items()], F.lit("table"))
    return found.withColumn("table_kind", kind)


class Structures:
    """Declared structures of instances in a table of versions: replacing one adds a version, the last one counts."""

    SCHEMA = "instance string, version int, dialect string, structure string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, instance: str) -> list:
        try:
            rows = self.spark.read.schema(self.SCHEMA).parquet(self.path)
            return sorted(rows.where(F.col("instance") == instance).collect(), key=lambda r: r.version)
        except AnalysisException:
            return []

    def replace(self, instance: str, text: str, dialect: str = "sparksql") -> int:
        """Check a structure (repeated names, no tables, unknown types) and store it; returns its version."""
        tables = import_structure(text, dialect)
        if not tables:
            raise GovernanceError(Code.CONFIG_ERROR, "a structure without tables")
        version = max((r.version for r in self._rows(instance)), default=0) + 1
        self.spark.createDataFrame([(instance, version, dialect, dump_metadata(tables))], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return version

    def get(self, instance: str) -> tuple[int, dict[tuple[str, str, str], T.StructType]]:
        rows = self._rows(instance)
        if not rows:
            raise GovernanceError(Code.METADATA_INSTANCE_NOT_FOUND, instance)
        return rows[-1].version, load_metadata(rows[-1].structure, rows[-1].dialect)
