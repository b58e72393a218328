"""Audit reports to findings to chunks.  A report is one row and stays one task's
work until its sections are exploded, so nothing here shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesift.functions import reports as rx
from codesift.functions.text import lines_of, trimmed

CHUNK_SIZE = 800
CHUNK_OVERLAP = 200


def parse_reports(reports: DataFrame, faithful: bool = True) -> DataFrame:
    """reports(firm, filename, rel_path, content) -> one row per finding.

    Gas and QA headers never start a finding.  ``faithful`` leaves their text in
    the finding before them; otherwise it is left out.
    """
    lines = F.col("lines")
    marked = F.filter(F.transform(lines, lambda t, i: F.struct(i.alias("at"), trimmed(t).alias("text"))),
                      lambda x: x["text"].startswith("#") & x["text"].rlike(rx.HEADER))
    heads = F.transform(marked, lambda x: F.struct(
        x["at"].alias("at"), F.regexp_extract(x["text"], rx.HEADER, 1).alias("code"),
        trimmed(F.regexp_extract(x["text"], rx.HEADER, 2)).alias("head")))

    def minor(h: Column) -> Column:
        return F.upper(F.substring(h["code"], 1, 1)).isin("G", "Q")

    if faithful:
        heads = F.filter(heads, lambda h: ~minor(h))
    cut = reports.select("firm", "filename", "rel_path", lines_of(F.col("content")).alias("lines")).withColumn("heads", heads)
    sections = F.transform(F.col("heads"), lambda h, k: F.struct(
        k.alias("section_no"), h["code"].alias("code"), h["head"].alias("head"),
        F.slice(lines, h["at"] + 2, F.coalesce(F.get(F.col("heads"), k + 1)["at"], F.size(lines)) - h["at"] - 1).alias("body")))
    rows = cut.select("firm", "filename", "rel_path", F.explode_outer(sections).alias("s")).filter(F.col("s").isNotNull())
    found = rows.select("firm", "filename", "rel_path", "s.*").withColumn("description", trimmed(F.array_join("body", "\n")))
    found = found.filter(F.col("description") != "")
    if not faithful:
        found = found.filter(~F.upper(F.substring("code", 1, 1)).isin("G", "Q"))
    found = (found.withColumn("severity", rx.extract_severity(F.col("code")))
             .withColumn("protocol", rx.extract_protocol(F.col("filename"))))
    return found.select(
        "rel_path", F.col("section_no").cast("int").alias("section_no"),
        F.concat_ws("__", "firm", "filename", "code").alias("finding_id"),
        rx.infer_title(F.col("head"), F.col("body"), F.col("severity"), F.col("protocol")).alias("title"), "description",
        "severity", "protocol", rx.infer_category(F.col("description"), F.col("severity")).alias("category"),
        F.concat(F.lit(rx.SOURCE_PREFIX), "rel_path", F.lit("#"), "code").alias("url"))


def finding_to_document(findings: DataFrame) -> DataFrame:
    """Text and metadata of each finding; no cluster yet (-1)."""
    return findings.select(
        "rel_path", "section_no",
        rx.document_text(*(F.col(c) for c in ("title", "severity", "category", "protocol", "description"))).alias("page_content"),
        F.coalesce(F.col("url"), F.concat(F.lit(rx.SOURCE_PREFIX), "finding_id")).alias("source"),
        "finding_id", "severity", "protocol", "category", F.lit(-1).alias("cluster_id"))


def chunk_documents(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, mode: str = "stride") -> DataFrame:
    """Cut ``page_content`` into overlapping chunks numbered per document.

    ``stride`` cuts at fixed steps in the JVM; ``separators`` prefers paragraph,
    line and word ends.
    """
    if mode == "stride":
        step = size - overlap
        last = F.greatest(F.ceil((F.length("page_content") - overlap) / step), F.lit(1)) - 1
        starts = F.sequence(F.lit(0), last.cast("int"))
        rest = [c for c in docs.columns if c != "page_content"]
        return docs.select(*rest, "page_content", F.explode_outer(starts).alias("chunk_index")).select(
            *rest, "chunk_index", F.substring(F.col("page_content"), F.col("chunk_index") * step + 1, F.lit(size)).alias("page_content"))
    if mode != "separators":
        raise ValueError(f"unknown mode {mode!r}")
    cut = F.pandas_udf(lambda s: s.map(lambda t: split_text(t, size, overlap)), "array<string>")
    rest = [c for c in docs.columns if c != "page_content"]
    return docs.select(*rest, cut("page_content").alias("parts")).select(
        *rest, F.posexplode("parts").alias("chunk_index", "page_content"))


SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that
    occurs; pieces that are still too long are cut at the next finer one."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1:]
    if sep:
        head, *tail = text.split(sep)
        pieces = [p for p in [head, *(sep + t for t in tail)] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    run: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        out.extend(_pack(run, size, overlap))
        run = []
        out.extend(split_text(piece, size, overlap, finer) if finer else [piece])
    out.extend(_pack(run, size, overlap))
    return out


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``; the next chunk starts with the
    trailing pieces that fit in ``overlap``."""
    first, used = 0, 0  # pieces[first:i] is the open chunk of length used
    for i, piece in enumerate(pieces):
        if used + len(piece) > size and i > first:
            chunk = "".join(pieces[first:i]).strip()
            if chunk:
                yield chunk
            while used > overlap or (used and used + len(piece) > size):
                used -= len(pieces[first])
                first += 1
        used += len(piece)
    chunk = "".join(pieces[first:]).strip()
    if chunk:
        yield chunk
