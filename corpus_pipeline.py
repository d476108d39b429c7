"""A training-corpus pipeline in stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstone.llm._store import cut, drop_cut, fresh, without
from wardstone.llm.byte_bpe import byte_bpe, read_ranks
from wardstone.llm.line_dedup import line_dedup
from wardstone.llm.quality_rules import keep_clean
from wardstone.llm.simhash import simhash_dedup
from wardstone.llm.wu_manber import decontaminate


def _over(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of documents after an operator on doc_id and text; n_chars follows the text.

    All other columns travel in one, so none clashes with a name that an operator adds or works with."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = operator(docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest_of_document")) if rest else docs)
    own = {c: F.col("rest_of_document").getField(c).alias(c) for c in rest} | {"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars")}
    return out.select(*[own[c] if c in rest else F.col(c) for c in docs.columns])


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject.

    A null or empty text has no words and is rejected. Rows are judged one by one: repeated rows, and rows
    with equal or null ids, stay or go each by its text. An empty table gives an empty one."""
    return _over(docs, keep_clean)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them, that of the largest id.

    All rows stay. A null text becomes an empty one; rows of one id are one document; a null id counts for no
    document and keeps no shared line. An empty table gives an empty one."""
    return _over(docs, line_dedup)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id.

    Null and empty texts are one group. Repeated rows leave one; of rows with equal ids but unlike texts each
    group keeps its own; a null id stays only where its group has no other. An empty table gives an empty one."""
    return simhash_dedup(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go.

    Null and empty texts are clean. Rows are judged one by one, whatever their ids; an empty table gives an
    empty one, and an empty benchmark leaves all."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return _over(docs, lambda d: decontaminate(d, items).where("not contaminated"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text, and whether they decode to it.

    All rows stay; null and empty texts have no ids. Columns named ids, n_tokens or round_trip are replaced,
    all others pass. An empty table gives an empty one."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    own = without(docs, "ids", "n_tokens", "round_trip")
    kept = {c: F.col(f"`{c}`") for c in own.columns}
    clash = {c: fresh(own, f"own_{c}")[0] for c in own.columns if c.lower() in ("packed", "decoded")}
    found = byte_bpe(own.select(*[kept[c].alias(clash.get(c, c)) for c in own.columns]), ranks, public_tokenizers.PATTERN)
    return found.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in own.columns], "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [("quality rules", rules_stage), ("line dedup", line_stage), ("near copies", near_copy_stage), ("benchmark", benchmark_stage), ("tokens", token_stage)]

#: Near copies and searching for word windows are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            drop_cut(last)  # the next stage is written; nothing reads this one any more
        last = docs
    return docs
