"""Rule scan: files in, leads out.

A file is one row, so looking around a line needs no shuffle: the lines are cut
into segments that carry the neighbouring lines they need, segments are exploded
to lines, and every rule is a column over the line and its neighbours.  Only
leads are shuffled, to keep the first one of a file where a rule asks for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codesift.functions.text import is_comment, lines_of, rank_of, trimmed
from codesift.rules.registry import RulePack, packs
from codesift.rules.solidity import LINES_AFTER, LINES_BEFORE, displaced_snippet, slot_variable_offset

SEGMENT = 16  # lines per segment, without the margins; each line is handed on with its segment

FEW = 8  # up to so many branches, lines without an anchor go before the branches are tried

LEAD_SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def explode_lines(files: DataFrame) -> DataFrame:
    """files -> (project_id, path, line_no, line), line numbers from 1."""
    return files.select("project_id", "path", F.posexplode_outer(lines_of(F.col("content"))).alias("pos", "line")).select(
        "project_id", "path", (F.col("pos") + 1).alias("line_no"), "line")


def anchor_lines(files: DataFrame) -> DataFrame:
    """Lines that may anchor a lead: comment lines are left out."""
    return explode_lines(files).filter(~is_comment(F.col("line")))


def _segments(files: DataFrame, keep: list[str]) -> DataFrame:
    lines = F.col("lines")
    start = F.col("seg") * SEGMENT
    return (
        files.select(*keep, F.explode_outer(F.sequence(F.lit(0), ((F.size(lines) - 1) / SEGMENT).cast("int"))).alias("seg"),
                     lines)
        .select(*keep, start.alias("base"), F.least(F.lit(LINES_BEFORE), start).alias("margin"),
                F.slice(lines, F.greatest(start - LINES_BEFORE, F.lit(0)) + 1,
                        F.least(F.lit(LINES_BEFORE), start) + SEGMENT + LINES_AFTER).alias("ctx"))
    )


def _scan_pack(files: DataFrame, pack: RulePack, languages: list[str], rule_ids: set[str] | None) -> DataFrame:
    ctx, at = F.col("ctx"), F.col("margin") + F.col("k")  # 0-based place of the line in its segment

    def text(lo: int, hi: int) -> Column:
        if lo >= 0:
            return F.array_join(F.slice(ctx, at + lo + 1, hi - lo + 1), "\n")
        first = F.greatest(at + lo, F.lit(0))
        return F.array_join(F.slice(ctx, first + 1, at + hi + 1 - first), "\n")

    branches = [b for b in pack.branches(text) if rule_ids is None or b.rule_id in rule_ids]
    if not branches:
        raise ValueError("no rule of the pack was asked for")
    rules = list(dict.fromkeys(b.rule_id for b in branches))
    codes = []
    for rule in rules:
        own = [(i, b) for i, b in enumerate(branches) if b.rule_id == rule]
        codes.append(reduce(lambda w, ib: w.when(ib[1].when, F.lit(str(ib[0]))), own[1:],
                            F.when(own[0][1].when, F.lit(str(own[0][0])))))
    has_displaced = any(b.key == pack.displaced for b in branches)

    facts = pack.facts()
    # A file without content has no lines and gives no lead; a filter on the content would build the content twice.
    flagged = files.filter(F.col("language").isin(languages)).select(
        "project_id", "path", "language", *[c.alias(n) for n, c in facts.items()],
        lines_of(F.col("content")).alias("lines"))
    own_lines = F.slice(ctx, F.col("margin") + 1, SEGMENT)
    per_line = (
        _segments(flagged, ["project_id", "path", "language", *facts])
        .select("*", F.posexplode_outer(own_lines).alias("k", "line"))
        .withColumn("idx", F.col("base") + F.col("k"))
        .filter(~is_comment(F.col("line")))
    )
    if len(branches) <= FEW:
        # Such lines are not copied with the lines around them.  More anchors would not fit a compiled method.
        per_line = per_line.filter(reduce(lambda a, b: a | b, [F.coalesce(b.anchor, F.lit(False)) for b in branches]))
    following = text(1, 14)
    offset = slot_variable_offset(following)
    is_header = reduce(lambda a, b: a | b, [b.anchor for b in branches if b.key == pack.displaced], F.lit(False))
    shift = [F.when(is_header, offset).alias("offset"),
             F.when(is_header, F.when(offset >= 0, displaced_snippet(following, offset))).alias("moved")] if has_displaced else []
    hits = (
        per_line.select("project_id", "path", "language", "f_pragma", "idx", "line",
                        *shift, F.concat_ws(",", *codes).alias("codes"))
        .select("*", F.explode_outer(F.split("codes", ",")).alias("code"))
        .filter(F.col("code") != "")
        .select("project_id", "path", "language", "idx", "line", "f_pragma", F.col("code").cast("int").alias("code"),
                *(["offset", "moved"] if has_displaced else []))
    )

    def per_branch(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("code") + 1)

    detail = F.lit("")
    for i, b in enumerate(branches):
        if b.detail is not None:
            detail = F.when(F.col("code") == i, b.detail).otherwise(detail)
    code_of = {b.key: i for i, b in enumerate(branches)}
    line_no, snippet = F.col("idx") + 1, trimmed(F.col("line"))
    if has_displaced:
        moved = F.col("code") == code_of[pack.displaced]
        line_no = F.when(moved, F.col("idx") + 2 + F.col("offset")).otherwise(line_no)
        snippet = F.when(moved, F.col("moved")).otherwise(snippet)
    found = hits.select(
        "project_id", "path", "language", "code", "idx", line_no.cast("int").alias("line"), snippet.alias("snippet"),
        detail.alias("detail"), per_branch([rules.index(b.rule_id) for b in branches]).alias("rule_no"),
        per_branch([b.once for b in branches]).alias("once"))
    first = (
        found.groupBy("project_id", "path", "rule_no", F.when(F.col("once"), F.lit(-1)).otherwise(F.col("idx")).alias("slot"))
        .agg(F.min_by(F.struct("language", "code", "line", "snippet", "detail"), "idx").alias("lead"))
        .select("project_id", "path", "rule_no", "lead.*")
    )
    msg = [pack.messages[b.key] for b in branches]
    return first.select(
        "project_id", F.element_at(F.array(*[F.lit(r) for r in rules]), F.col("rule_no") + 1).alias("pattern_id"),
        per_branch([m[0] for m in msg]).alias("severity"), per_branch([m[1] for m in msg]).alias("confidence"),
        F.col("path").alias("file"), "line", "snippet",
        F.replace(per_branch([m[3] for m in msg]), F.lit("{}"), F.col("detail")).alias("signal"),
        per_branch([m[4] for m in msg]).alias("verify"), per_branch([m[2] for m in msg]).alias("category"), "language")


def rule_scan(files: DataFrame, rule_ids: set[str] | None = None) -> DataFrame:
    """files(project_id, path, content, language) -> leads, one row per lead."""
    parts = [_scan_pack(files, pack, languages, rule_ids) for pack, languages in packs()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def lead_order() -> list[Column]:
    """Total order of leads: confidence, severity, then place.

    The reference lets confidences within 0.05 tie, which is no total order; ours
    sorts by the confidence itself.
    """
    return [F.col("confidence").desc(), rank_of(F.col("severity"), LEAD_SEVERITIES).asc(),
            F.col("file").asc(), F.col("line").asc(), F.col("pattern_id").asc()]


def rank_leads(leads: DataFrame) -> DataFrame:
    """Leads in report order within each project (a range sort, skew-safe)."""
    return leads.orderBy("project_id", *lead_order())


def lead_summary(leads: DataFrame) -> DataFrame:
    return leads.groupBy("project_id", "severity", "category").agg(F.count(F.lit(1)).alias("n_leads"))


def lead_block(leads: DataFrame, k: int = 8) -> DataFrame:
    """The ``k`` strongest leads of each project as prompt text."""
    key = F.struct(-F.col("confidence"), rank_of(F.col("severity"), LEAD_SEVERITIES), "file", "line", "pattern_id")
    # Two cuts: a hot project is first cut to k leads per file group, then to k.
    from pyspark.sql import Window

    salted = leads.withColumn("sort_key", key).withColumn("salt", F.pmod(F.xxhash64("file", "line"), F.lit(64)))
    near = (salted.withColumn("rn", F.row_number().over(Window.partitionBy("project_id", "salt").orderBy("sort_key")))
            .filter(F.col("rn") <= k).drop("rn"))
    top = (near.withColumn("rn", F.row_number().over(Window.partitionBy("project_id").orderBy("sort_key")))
           .filter(F.col("rn") <= k))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("[LEAD-"), F.col("rn").cast("string"), F.lit("] "), F.col("pattern_id"), F.lit(" | "), F.col("severity"),
                 F.lit(" | confidence:"), F.round(F.col("confidence") * 100).cast("int").cast("string"), F.lit("% | "),
                 F.col("file"), F.lit(":"), F.col("line").cast("string")),
        F.concat(F.lit("  Code:   "), F.substring("snippet", 1, 120)),
        F.concat(F.lit("  Signal: "), F.col("signal")), F.concat(F.lit("  Verify: "), F.col("verify")), F.lit(""))
    blocks = top.groupBy("project_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("text")))), lambda x: x["text"]), "\n")
        .alias("body"), F.count(F.lit(1)).alias("shown"))
    totals = leads.groupBy("project_id").agg(F.count(F.lit(1)).alias("found"))
    # Fixed text of the block.
    head = F.concat(F.lit("=== PRE-SCAN LEADS — verify these first ("), F.col("shown").cast("string"), F.lit(" of "),
                    F.col("found").cast("string"), F.lit(" found) ==="))
    tail = F.lit("After verifying each lead, apply methodology to find what the scanner missed.\n"
                 "A genuine zero-finding result is extremely rare. If leads look like false positives,\n"
                 "explain why specifically before concluding — do not silently dismiss.\n===")
    return blocks.join(totals, "project_id").select("project_id", F.concat_ws("\n", head, F.lit(""), F.col("body"), tail).alias("block"))
