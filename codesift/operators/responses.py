"""Auditor responses (text) to findings, notes and rejects (tables)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions.text import trimmed
from codesift.operators.merge import SEVERITIES

# ---------------------------------------------------------------------------
# Markers in a response and least lengths of its fields.
THINK = r"(?is)<think>.*?</think>"
FENCE = r"(?s)```(?:json)?\s*(.*?)```"
NOTES_MARK = "SUSPICIONS:"
MIN_TITLE, MIN_DESCRIPTION, MIN_EXPLOIT, MIN_RECOMMENDATION, MIN_REASON = 5, 20, 10, 10, 10
# ---------------------------------------------------------------------------


def strip_think(raw: Column) -> Column:
    return trimmed(F.regexp_replace(raw, THINK, ""))


def findings_part(text: Column) -> Column:
    """Text before the first notes marker."""
    at = F.instr(text, NOTES_MARK)
    return trimmed(F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text))


def notes_part(text: Column) -> Column:
    """Text after the first notes marker; empty without one."""
    at = F.instr(text, NOTES_MARK)
    return trimmed(F.when(at > 0, F.substring(text, at + len(NOTES_MARK), F.length(text))).otherwise(F.lit("")))


def _masked(text: Column) -> Column:
    """``text`` with everything inside of strings blanked, each character by one.  Whether a quote opens or closes is told
    from the end, since what stands before the JSON may hold any number of quotes."""
    parts = F.reverse(F.split(F.regexp_replace(text, r'\\["\\]', "__"), '"', -1))
    outside = F.transform(parts, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.repeat(F.lit("_"), F.length(x))))
    return F.array_join(F.reverse(outside), '"')


def _opening(masked: Column) -> Column:
    """How many brackets from the end the one stands that the last bracket closes; 0 if there is none."""
    brackets = F.reverse(F.filter(F.split(F.regexp_replace(masked, r"[^\[\]{}]", ""), "", -1), lambda x: x != ""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("hit"))

    def step(s: Column, x: Column) -> Column:
        depth = s["depth"] + F.when(x.isin("]", "}"), 1).otherwise(-1)
        seen = s["seen"] + 1
        return F.when(s["hit"] > 0, s).otherwise(F.struct(depth.alias("depth"), seen.alias("seen"), F.when(depth == 0, seen).otherwise(0).alias("hit")))

    return F.aggregate(brackets, start, step, lambda s: s["hit"])


def _exact(text: Column) -> Column:
    """``text`` parsed if it is one JSON value and nothing more; the parser alone stops behind the first value.  What may
    follow a value in a list may not follow it in an object."""
    in_list, in_object = F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"a":'), text, F.lit("}"))
    return F.when(F.try_parse_json(in_list).isNotNull() & F.try_parse_json(in_object).isNotNull(), F.try_parse_json(text))


def with_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the JSON in column ``text`` as a string, NULL when there is none, and ``out``_v, the same parsed.

    Whole text first, then a fenced block, then the list or object that ends the text.  A list that ends a text begins at
    the bracket that the last one closes, so one pass from the end finds the only candidate.
    """
    c = F.col
    staged = df.withColumn("_t", trimmed(c(text))).withColumn("_whole", _exact(c("_t")))
    staged = staged.withColumn("_fence", F.when(c("_whole").isNull(), trimmed(F.regexp_extract("_t", FENCE, 1)))).withColumn("_fenced", _exact(c("_fence")))
    hard = c("_whole").isNull() & c("_fenced").isNull() & (F.endswith("_t", F.lit("]")) | F.endswith("_t", F.lit("}")))
    staged = staged.withColumn("_masked", F.when(hard, _masked(c("_t")))).withColumn("_hit", F.when(c("_masked").isNotNull(), _opening(c("_masked"))))
    pieces = F.slice(F.reverse(F.split("_masked", r"[\[\]{}]", -1)), 1, c("_hit"))
    length = F.aggregate(pieces, c("_hit"), lambda a, x: a + F.length(x))
    staged = staged.withColumn("_tail", F.when(c("_hit") > 0, F.right("_t", length))).withColumn("_tailed", F.try_parse_json("_tail"))
    found = F.when(c("_whole").isNotNull(), c("_t")).when(c("_fenced").isNotNull(), c("_fence")).when(c("_tailed").isNotNull(), c("_tail"))
    return staged.select(*df.columns, found.alias(out), F.coalesce("_whole", "_fenced", "_tailed").alias(f"{out}_v"))


def _typed(item: Column, field: str, kind: str) -> Column:
    """Field of a variant when it has the JSON type asked for, else NULL."""
    value = F.try_variant_get(item, f"$.{field}", "variant")
    schema = F.schema_of_variant(value)
    if kind == "string":
        return F.when(schema == "STRING", F.try_variant_get(item, f"$.{field}", "string"))
    return F.when(schema.rlike("^(?:BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(item, f"$.{field}", "double"))


def _items(df: DataFrame, column: str, keys: list[str], paths: list[str]) -> DataFrame:
    """Explode the array found at the first of ``paths``; items keep their place."""
    v = F.col(f"{column}_v") if f"{column}_v" in df.columns else F.try_parse_json(F.col(column))
    arr = F.coalesce(*[F.try_variant_get(v, p, "array<variant>") for p in paths])
    return df.select(*keys, F.posexplode(arr).alias("ord", "item"))


def _once(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """Evaluate ``columns`` once: a filter on them is not pushed below a generator,
    where it would repeat the extraction."""
    return df.select(*keys, F.inline(F.array(F.struct(*columns))))


FINDING_FIELDS = ["severity", "title", "file", "line", "description", "exploit", "recommendation"]


def finding_validity() -> Column:
    """Whether the finding columns meet the constraints of a finding."""
    return F.coalesce(
        F.col("severity").isin(SEVERITIES) & (F.length("title") >= MIN_TITLE) & F.col("file").isNotNull()
        & (F.col("line") >= 0) & (F.col("line") == F.floor("line")) & (F.length("description") >= MIN_DESCRIPTION)
        & (F.length("exploit") >= MIN_EXPLOIT) & (F.length("recommendation") >= MIN_RECOMMENDATION), F.lit(False))


def note_validity() -> Column:
    return F.coalesce(F.col("target_file").isNotNull() & (F.length("reason") >= MIN_REASON) & F.col("confidence").between(0, 1)
                      & F.col("function_ok"), F.lit(False))


def parse_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """responses(resp_id, auditor_id, pass_no, raw) -> (findings, notes, rejects).

    Notes come from the marked part, and from a "suspicions" list inside the JSON
    object.  Rejects hold the responses and items that did not parse or were not
    valid, with the reason.
    """
    keys = ["resp_id", "auditor_id", "pass_no"]
    text = responses.withColumn("_text", strip_think(F.col("raw"))).select(
        *keys, findings_part(F.col("_text")).alias("body"), notes_part(F.col("_text")).alias("tail"))
    # The JSON is found once per row and part: no filter below is pushed into the search for it, which it would multiply.
    part = lambda c: _once(with_json(text.select(*keys, c), c, f"{c}_json"), keys, [F.col(x) for x in (c, f"{c}_json", f"{c}_json_v")])
    body, tail = part("body"), part("tail")

    item = F.col("item")
    parsed = _once(_items(body, "body_json", keys, ["$", "$.findings"]), [*keys, "ord", "item"],
                   [_typed(item, f, "number" if f == "line" else "string").alias(f) for f in FINDING_FIELDS])
    findings = parsed.filter(finding_validity()).drop("item").withColumn("line", F.col("line").cast("int"))

    raw_notes = _items(tail, "tail_json", keys, ["$"]).unionByName(_items(body, "body_json", keys, ["$.suspicions"]))
    fn = F.try_variant_get(item, "$.targetFunction", "variant")
    notes_all = _once(raw_notes, [*keys, "ord", "item"], [
        _typed(item, "targetFile", "string").alias("target_file"), _typed(item, "targetFunction", "string").alias("target_function"),
        _typed(item, "reason", "string").alias("reason"), _typed(item, "confidence", "number").alias("confidence"),
        (fn.isNull() | (F.schema_of_variant(fn) == "STRING")).alias("function_ok")])
    notes = notes_all.filter(note_validity()).drop("item", "function_ok")

    bad_text = body.filter((F.col("body") != "") & F.col("body_json").isNull()).select(
        *keys, F.lit(None).cast("int").alias("ord"), F.lit("no JSON").alias("reason"), F.col("body").alias("text"))
    bad_items = parsed.filter(~finding_validity()).select(*keys, "ord", F.lit("finding not valid").alias("reason"), F.to_json(item).alias("text"))
    bad_notes = notes_all.filter(~note_validity()).select(*keys, "ord", F.lit("note not valid").alias("reason"), F.to_json(item).alias("text"))
    return findings, notes, bad_text.unionByName(bad_items).unionByName(bad_notes)


def tag_suspicions(notes: DataFrame, auditor_id: str, pass_no: int) -> DataFrame:
    return notes.withColumn("auditor_id", F.lit(auditor_id)).withColumn("pass_no", F.lit(pass_no))
