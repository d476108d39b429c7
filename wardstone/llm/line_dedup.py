"""Line dedup: lines that many documents share stay in one of them only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._skew import HOT, spread_join
from wardstone.llm._store import cut, fresh, without

SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), string.ascii_uppercase, string.ascii_lowercase)


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, hot: int = HOT) -> DataFrame:
    """``df`` with ``text_col`` less the lines that are shared, and n_lines and n_dropped (long).

    A line whose key has ``min_chars`` code points or more and is found in ``min_docs`` or more
    different ids is dropped from every document but that of the largest id. Only the hashes of such
    lines are shuffled, one per document and key; counting is combined before each shuffle, and the
    documents of a line in more than ``hot`` of them are dealt to several tasks, so one line in a third of
    all documents does not gather in one. Keys are told apart by 128 bits.

    A null or empty text is one empty line and comes back as an empty text. Rows with equal ids count
    as one document and, if theirs is the largest id, all keep the line; a null id counts for no
    document and never keeps a shared line. An empty table gives an empty one. Columns named n_lines
    or n_dropped are replaced, others pass through.
    """
    base = without(df, "n_lines", "n_dropped")
    h1, h2, key, drop, keep, n = fresh(base, "h1", "h2", "line_key", "drop", "keep_id", "n_docs")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    long_lines = F.filter(lines, lambda x: F.length(x) >= min_chars)
    keys = F.array_distinct(F.filter(F.transform(long_lines, line_key), lambda k: F.length(k) >= min_chars))
    pairs = base.select(F.col(id_col).alias(id_col), F.explode(F.transform(keys, lambda k: F.struct(F.xxhash64(k).alias(h1), F.xxhash64(F.lit(1), k).alias(h2)))).alias(key)).select(id_col, f"{key}.*")
    shared = cut(pairs.groupBy(h1, h2).agg(F.count_distinct(id_col).alias(n), F.max(id_col).alias(keep)).where(F.col(n) >= min_docs), "shared-lines")
    drops = spread_join(pairs, shared.drop(n), [h1, h2], shared, n, id_col, hot=hot).where(~F.col(id_col).eqNullSafe(F.col(keep))).groupBy(F.col(id_col).alias(key)).agg(F.collect_set(h1).alias(drop))
    joined = base.join(drops, F.col(id_col).eqNullSafe(F.col(key)), "left")
    kept = F.filter(lines, lambda x: (F.length(x) < min_chars) | ~F.array_contains(drop, F.xxhash64(line_key(x))))
    kept = F.when(F.col(drop).isNull(), lines).otherwise(kept)
    joined = joined.select(*[F.col(f"`{c}`") for c in base.columns], F.size(lines).cast("long").alias("n_lines"), kept.alias(drop))
    return joined.select(
        *[F.array_join(drop, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns],
        "n_lines",
        (F.col("n_lines") - F.size(drop)).cast("long").alias("n_dropped"),
    )
