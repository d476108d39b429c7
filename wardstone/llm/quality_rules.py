"""Quality rules, line first: every line is judged on its own, failing lines go, and a document that
loses too much of its text this way is rejected. Built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstone.llm._columns import bound
from wardstone.llm._store import fresh, without

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Wording of site furniture, matched anywhere in a line of at most BOILERPLATE_WORDS words.
BOILERPLATE = (
    "(?i)(all rights reserved|cookie (policy|settings|preferences)|accept (all )?cookies|terms (of (use|service)|and conditions)"
    "|privacy (policy|notice)|enable javascript|lorem ipsum|subscribe to our|sign up for our|click here to|skip to (main )?content"
    "|back to top|share on (facebook|twitter|linkedin)|powered by wordpress)"
)
BOILERPLATE_WORDS = 25
MIN_WORDS = 50
#: A line fails with this many column bars.
BARS = 3
#: A line fails if more than one character in SYMBOL_SHARE is a symbol, one in SHOUT_SHARE a "!".
SYMBOL_SHARE, SHOUT_SHARE = 10, 20
#: A line of as many words fails without any sentence punctuation, or if its distinct words are under a quarter.
LONG_LINE = 12
#: Distinct words are counted in as many words of a line at once.
REPEAT_WINDOW = 100
#: A document goes if more than one word in MAX_LOSS stands in failing lines.
MAX_LOSS = 2


def _blank(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null: none."""
    bare = _blank(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def _count_of(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _distinct(own: Column) -> Column:
    """Distinct words, counted anew in every REPEAT_WINDOW words, so that a long line is judged as a short one."""
    parts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / REPEAT_WINDOW).cast("int"))
    each = lambda n, k: n + F.size(F.array_distinct(F.slice(own, k * REPEAT_WINDOW + 1, F.lit(REPEAT_WINDOW))))
    return F.when(F.size(own) <= REPEAT_WINDOW, F.size(F.array_distinct(own))).otherwise(F.aggregate(parts, F.lit(0), each))


def words_lost(line: Column) -> Column:
    """Words of a line that breaks a punctuation, navigation or boilerplate rule; 0 for all others. Blank
    lines pass. The words are split once, as Spark shares nothing within a lambda."""

    def judge(own: Column) -> Column:
        n, size = F.length(line), F.size(own)
        fails = (
            (_count_of(line, "|") >= BARS)
            | (_count_of(line, SYMBOLS) * SYMBOL_SHARE > n)
            | (_count_of(line, "!") * SHOUT_SHARE > n)
            | ((size >= LONG_LINE) & ((_count_of(line, ".,;:?!…。，！？،؟।") == 0) | (_distinct(own) * 4 < size)))
            | ((size <= BOILERPLATE_WORDS) & line.rlike(BOILERPLATE))
        )
        return F.when((size > 0) & fails, size).otherwise(0)

    return bound(words(line), judge)


def _window_hashes(own: Column) -> Column:
    """A 64-bit hash of each three-word window; only windows of one text are compared by it."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(own) - 3), lambda i: F.xxhash64(F.get(own, i), F.get(own, i + 1), F.get(own, i + 2)))
    return F.when(F.size(own) >= 3, hashes).otherwise(F.array().cast("array<bigint>"))


def quality_rules(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``text_col`` less its failing lines, and n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long, of the text as it came), base_failed, n_lines_failed (long) and kept.

    Null and empty texts have no words, so they fail the base rules and are not kept; the text of a
    document without failing lines is returned as it was (null stays null). Rows are judged one by
    one: repeated rows give repeated rows, and an empty table gives an empty one. Columns of ``df``
    with an added name are replaced; all others pass through. A text of any length stays in one row.
    """
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_failed", "kept"]
    base = without(df, *out)
    keep = [F.col(f"`{c}`") for c in base.columns]
    own, lines, hashes, order, starts, lost = fresh(base, "own", "lines", "hashes", "order", "starts", "lost")
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = base.select(*keep, words(F.col(text_col)).alias(own), F.split(text, "\n", -1).alias(lines))
    step = step.select(*keep, own, lines, _window_hashes(F.col(own)).alias(hashes), F.transform(lines, words_lost).alias(lost))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    step = step.withColumn(order, F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.transform(order, lambda x, k: F.when((F.get(order, k - 1)["h"] == x["h"]) | (F.get(order, k + 1)["h"] == x["h"]), x["i"]))
    step = step.withColumn(starts, F.sort_array(F.array_compact(twice)))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    with_word = F.filter(lines, lambda x: _blank(x) != "")
    step = step.select(
        *keep,
        lines,
        lost,
        F.size(own).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    gone = F.aggregate(lost, F.lit(0).cast("long"), lambda n, k: n + k)
    n_failed = F.size(F.filter(lost, lambda k: k > 0))
    good = F.when(n_failed == 0, F.col(f"`{text_col}`")).otherwise(F.array_join(F.filter(lines, lambda x, i: F.get(lost, i) == 0), "\n"))
    return step.select(
        *[good.alias(c) if c == text_col else F.col(f"`{c}`") for c in base.columns],
        *out[:5],
        failed.alias("base_failed"),
        n_failed.cast("long").alias("n_lines_failed"),
        (~failed & (gone * MAX_LOSS <= F.col("n_words"))).alias("kept"),
    )


def keep_clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that ``quality_rules`` keeps, with its columns.

    The counts of documents in and kept are observed. The observation also stands between the verdict
    and the filter: pushed below the projections, the filter would repeat their work in nested lambdas.
    """
    judged = quality_rules(df, text_col).observe("quality rules", F.count("*").alias("documents"), F.count_if("kept").alias("kept"))
    return judged.where("kept")
