"""Quality rules as a short-circuit cascade, with DataFrame functions only.

Every rule is a column over the text's counts.  On a sample of rows (``SAMPLE_ROWS`` texts of at most ``SAMPLE_CHARS``
characters, documented bounds; one read that stops when it has them) each rule is run alone to measure its cost and how
many rows it rejects; the rules are then put into one ``CASE WHEN`` in the order of rejection per cost.  Spark evaluates a
later branch only for rows that no earlier branch rejected, so a costly rule sees few rows.  The order changes the time,
never the verdict: a document is kept if no rule rejects it.

``score_rules`` returns some counts of every row (``RETURNED``), which therefore are computed for every row.  All other
counts (lines, bulleted lines, lines left open, words of marks) stand inside the branches: a row that a base rule or an
earlier branch rejected never computes them.

Cases: null text has no words; empty and blank texts have 0 words (all counts 0); repeated rows give repeated rows; an
empty table gives an empty table; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows, at most, on which costs and selectivities are estimated, and characters, at most, of each of them.
SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 20_000

# Limits of the base rules and of the cascade.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 20
MAX_DUP_LINE_PERCENT = 50
MAX_MEAN_CHARS = 20
MIN_MEAN_CHARS = 2
MAX_BULLET_LINE_PERCENT = 90
MAX_OPEN_LINE_PERCENT = 30
MAX_MARK_WORD_PERCENT = 50

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
BULLET = r"^[\x20\x09-\x0D]*[-*\x{2022}]"
OPEN_END = r"(\.\.\.|\x{2026})[\x20\x09-\x0D]*\z"
MARKS = r"^[\x21-\x40\x5B-\x60\x7B-\x7E]+\z"

# Counts that ``score_rules`` returns for every row.
RETURNED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words(text: Column) -> Column:
    """The words of a text, null read as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def count_symbols(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOL)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def count_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return F.transform(F.array(_lines(text)), lambda a: F.size(a) - F.size(F.array_distinct(a)))[0].cast("long")


def count_repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur at least twice, from the array of words.

    Windows are hashed and sorted with their positions; equal neighbours are repeats, and the distinct positions they
    cover are counted.  No step compares all windows with all others.
    """
    def windows(a: Column) -> Column:
        n = F.size(a)
        return F.transform(F.slice(a, 1, n - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(a, i + 1), F.get(a, i + 2)).alias("g"), i.alias("i")))

    def covered(s: Column) -> Column:
        n = F.size(s)
        twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) & (i > 0) | (i < n - 1) & (F.get(s, i + 1)["g"] == x["g"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def both(a: Column) -> Column:
        return F.when(F.size(a) < 4, F.lit(0)).otherwise(F.transform(F.array(F.sort_array(windows(a))), covered)[0])

    return F.transform(F.array(w), both)[0].cast("long")


def of_words(w: Column) -> dict[str, Column]:
    """The counts that need the array of words."""
    return {"n_words": F.size(w).cast("long"), "word_chars": F.length(F.array_join(w, "")).cast("long"), "n_repeat_words": count_repeat_words(w),
            "n_mark_words": F.size(F.filter(w, lambda x: x.rlike(MARKS))).cast("long")}


def of_text(text: Column) -> dict[str, Column]:
    """The counts that need the text."""
    def like(pattern: str) -> Column:
        return F.size(F.filter(_lines(text), lambda x: x.rlike(pattern))).cast("long")

    return {"n_symbols": count_symbols(text), "n_lines": F.size(_lines(text)).cast("long"), "n_dup_lines": count_dup_lines(text),
            "n_bullet_lines": like(BULLET), "n_open_lines": like(OPEN_END)}


@dataclass(frozen=True)
class Rule:
    """``rejects`` gets the counts by name and is true for a text to drop."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda c: c["n_words"] < MIN_WORDS),
    Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda c: 100 * c["n_symbols"] > MAX_SYMBOL_PERCENT * c["n_words"]),
    Rule("repeated_lines", lambda c: (c["n_dup_lines"] > 0) & (100 * c["n_dup_lines"] > MAX_DUP_LINE_PERCENT * c["n_lines"])),
    Rule("long_words", lambda c: c["word_chars"] > MAX_MEAN_CHARS * c["n_words"]),
    Rule("short_words", lambda c: c["word_chars"] < MIN_MEAN_CHARS * c["n_words"]),
    Rule("bullet_lines", lambda c: 100 * c["n_bullet_lines"] > MAX_BULLET_LINE_PERCENT * c["n_lines"]),
    Rule("open_lines", lambda c: 100 * c["n_open_lines"] > MAX_OPEN_LINE_PERCENT * c["n_lines"]),
    Rule("mark_words", lambda c: 100 * c["n_mark_words"] > MAX_MARK_WORD_PERCENT * c["n_words"]),
)


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    cost: float
    rejected: float


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Some texts of ``docs``: the read stops at ``rows`` of them, none above ``SAMPLE_CHARS``.

    They are the first that are found, which may favour a source; that touches the order of the rules only.
    """
    spark = docs.sparkSession
    some = docs.select("text").filter(F.length("text") <= SAMPLE_CHARS)._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(some.takeAsList(rows), some.schema()), spark)


def estimate(part: DataFrame, counts: dict[str, Column], rules: tuple[Rule, ...]) -> list[Estimate]:
    """Cost (seconds of the better of two runs over ``part``) and share of rejected rows of each rule, best rejection
    per cost first; of rules that reject nothing the cheapest first.  ``counts`` are columns over ``part``."""
    part = part.persist()
    try:
        size = max(part.count(), 1)
        found = []
        for r in rules:
            seconds = []
            for _ in range(2):
                start = time.perf_counter()
                out = part.agg(F.count_if(r.rejects(counts))).first()[0]
                seconds.append(time.perf_counter() - start)
            found.append(Estimate(r, min(seconds), out / size))
    finally:
        part.unpersist()
    return sorted(found, key=lambda e: (-e.rejected / max(e.cost, 1e-6), e.cost))


def cascade(order: list[Rule], counts: dict[str, Column]) -> Column:
    """Name of the first rule in ``order`` that rejects the row, else null; later rules run only for rows still in."""
    out = F.when(order[0].rejects(counts), F.lit(order[0].name))
    for r in order[1:]:
        out = out.when(r.rejects(counts), F.lit(r.name))
    return out


def filter_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with the input's columns.  The counts stand inside the branches, so a row
    pays only for the rules it reaches."""
    text = F.col("text")
    counts = of_words(words(text)) | of_text(text)
    order = [e.rule for e in estimate(sample(docs), counts, rules)]
    return docs.filter(cascade(order, counts).isNull())


def with_counts(docs: DataFrame, *kept: str) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with the counts of ``RETURNED`` as columns, and all counts: those columns, and the others as expressions
    over the text that cost nothing until a rule asks for them."""
    split = docs.select(*kept, "text", words(F.col("text")).alias("w"))
    counts = of_words(F.col("w")) | of_text(F.col("text"))
    counted = split.select(*kept, "text", "w", *[counts[c].alias(c) for c in RETURNED])
    return counted, counts | {c: F.col(c) for c in RETURNED}


def score_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the counts of ``RETURNED``, base_failed, kept.

    The base rules need returned counts only and come first; the others are ordered by what they reject of the sampled
    rows that passed the base rules, for what they cost beside the returned counts.
    """
    def failed(counts: dict[str, Column]) -> Column:
        return BASE_RULES[0].rejects(counts) | BASE_RULES[1].rejects(counts)

    later = tuple(r for r in rules if r not in BASE_RULES)
    part, counts = with_counts(sample(docs))
    order = [e.rule for e in estimate(part.filter(~failed(counts)), counts, later)]
    counted, counts = with_counts(docs, "doc_id")
    judged = counted.withColumn("base_failed", failed(counts))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, counts).isNull() if order else F.lit(True))
    return judged.select("doc_id", *RETURNED, "base_failed", kept.alias("kept"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
c as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w,
    len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
g as (select *, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as g from c),
r as (select doc_id, w, n_symbols, l, row_number() over () as k, g from g),
e as (select k, unnest(g) as s, unnest(range(1, len(g) + 1)) as i from r),
d as (select k, i, count(*) over (partition by k, s) as n from e),
p as (select k, count(distinct i + j) as n from d, range(0, 3) q(j) where n > 1 group by k),
m as (select r.doc_id, cast(len(w) as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars,
    cast(n_symbols as bigint) as n_symbols, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, len(l) as n_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '{BULLET}'))) as n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '{OPEN_END}'))) as n_open_lines,
    len(list_filter(w, lambda x: regexp_matches(x, '{MARKS}'))) as n_mark_words,
    cast(coalesce(p.n, 0) as bigint) as n_repeat_words from r left join p using (k)),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m)
select doc_id, {", ".join(RETURNED)}, base_failed, not base_failed and 100 * n_symbols <= {MAX_SYMBOL_PERCENT} * n_words
    and 100 * n_dup_lines <= {MAX_DUP_LINE_PERCENT} * n_lines
    and word_chars <= {MAX_MEAN_CHARS} * n_words and word_chars >= {MIN_MEAN_CHARS} * n_words
    and 100 * n_bullet_lines <= {MAX_BULLET_LINE_PERCENT} * n_lines and 100 * n_open_lines <= {MAX_OPEN_LINE_PERCENT} * n_lines
    and 100 * n_mark_words <= {MAX_MARK_WORD_PERCENT} * n_words as kept from f
"""
