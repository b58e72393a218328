"""Audit-shaped inputs derived row by row from the driver tables.

Every derivation is narrow: one document becomes one source file or one report,
one order one response, one line item one finding.  Their number and size grow
with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesift.session import spread
from codesift.workloads.vocabulary import LINES

DIRS = ["contracts", "src/core", "src/tokens", "contracts/vaults", "lib/oz", "test", "node_modules/dep", "src/x.json"]
EXTS = [".sol", ".sol", ".rs", ".sol", ".ts", ".sol", ".py", ".sol", ".vy", ".sol"]
WINDOW = 48  # vocabulary lines one file draws from


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def file_path(doc_id: Column, n_chars: Column) -> Column:
    return F.concat(_pick(DIRS, (doc_id * 13 + n_chars) % len(DIRS)), F.lit("/C"), doc_id.cast("string"),
                    _pick(EXTS, (doc_id * 7) % len(EXTS)))


def files_of(docs: DataFrame) -> DataFrame:
    """documents -> (project_id, path, content): one source line per word."""
    d = F.col("doc_id")

    def line(word: Column, i: Column) -> Column:
        n = F.length(word).cast("long")
        h = (i.cast("long") * 7919 + d * 104729 + n * 31) % 1000003 % WINDOW
        return F.replace(_pick(LINES, (d * 29 + h) % len(LINES)), F.lit("{K}"), (d + 20 * (n % 5 + 1)).cast("string"))

    content = F.array_join(F.transform(F.split("text", " ", -1), line), "\n")
    return docs.select(F.col("source").alias("project_id"), file_path(d, F.col("n_chars")).alias("path"), content.alias("content"))


def raw_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codesift.operators.features import featurize_files

    return featurize_files(raw_files(spark, sf_dir))


HEADS = ["## [H-{N}] ", "## M-{N}: ", "## **[L-{N}]** ", "### [MEDIUM] ", "## [G-{N}] ", "## V{N} ", "## C-{N}:\n", "", "",
         "", "", "## M–{N} ", "", ""]
TOPICS = ["", " reentrancy", " oracle", " flash loan", " access control", " overflow", " sandwich", " gas limit", " replay",
          " voting", " liquidation", " proxy", " single point", " rounding", " ERC4626", " erc-20", " NFT", " bridge",
          " slot collision", "", " **bold** words", "| cell"]
NAMES = ["2023-07-26-Proto{D}-v2.5.md", "Proto{D}-Security-Audit.md", "2024-01-01-Proto{D}-audit-v1.2.md", "Proto{D}-report.md"]


def reports_of(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, firm, filename, rel_path, content): one markdown report each."""
    d = F.col("doc_id")

    def line(part: Column, i: Column) -> Column:
        n, i = F.length(part).cast("long"), i.cast("long")
        head = F.replace(_pick(HEADS, (i * 7 + d * 13 + n) % len(HEADS)), F.lit("{N}"), F.lpad((i % 30 + 1).cast("string"), 2, "0"))
        return F.concat(head, part, F.lit("."), _pick(TOPICS, (i * 5 + d * 3 + n * 11) % len(TOPICS)))

    name = F.replace(_pick(NAMES, d % len(NAMES)), F.lit("{D}"), d.cast("string"))
    return docs.select(
        "doc_id", F.col("source").alias("firm"), name.alias("filename"), F.concat(F.col("source"), F.lit("/"), name).alias("rel_path"),
        F.array_join(F.transform(F.split("text", r"\. ", -1), line), "\n").alias("content"))


def reports_with_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_of(spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports_with_id(spark, sf_dir).drop("doc_id")


def store_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with their documents: (vec_id, embedding, cluster_id, category,
    severity, protocol, page_content); the given label is the cluster."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    e = spread(table(spark, sf_dir, "embeddings"))
    return e.join(d, e["vec_id"] == d["doc_id"]).select(
        "vec_id", "embedding", F.col("label").alias("cluster_id"), F.col("lang").alias("category"),
        _pick(["Critical", "High", "Medium", "Low", "Info"], F.col("vec_id") % 5).alias("severity"),
        F.col("source").alias("protocol"), F.col("text").alias("page_content"))


def project_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per source: the mean of its documents' vectors."""
    from codesift.operators.clusters import agg_centroid

    docs = store_docs(spark, sf_dir).select(F.regexp_extract("protocol", r"(\d+)$", 1).cast("long").alias("cluster_id"), "embedding")
    return agg_centroid(docs).select(F.col("cluster_id").alias("query_id"), F.col("vector").alias("embedding"))


def label_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from codesift.operators.clusters import agg_centroid

    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), "embedding")
    return agg_centroid(e).select("cluster_id", F.concat(F.lit("label-"), F.col("cluster_id").cast("string")).alias("label"), "vector", "size")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents -> one note each, naming a file by path, base name, piece or longer path."""
    d = F.col("doc_id")
    path = file_path(d, F.col("n_chars"))
    target = (F.when(d % 4 == 0, path).when(d % 4 == 1, F.substring_index(path, "/", -1))
              .when(d % 4 == 2, F.concat(F.lit("C"), d.cast("string"), F.lit("."))).otherwise(F.concat(F.lit("repo/"), path)))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.select(
        F.col("source").alias("project_id"), target.alias("target_file"), F.when(d % 3 == 0, F.lit("withdraw()")).alias("target_function"),
        F.concat(F.lit("review the flow of C"), d.cast("string")).alias("reason"), (d * 37 % 100 / 100.0).alias("confidence"),
        F.concat(F.lit("auditor-"), (d % 3 + 1).cast("string")).alias("auditor_id"), (d % 2 + 1).cast("int").alias("pass_no"))


def seen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the documents that carry a label count as seen."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select(
        F.col("source").alias("project_id"), file_path(F.col("doc_id"), F.col("n_chars")).alias("path"))


AUDITORS = ["auditor-1", "auditor-2", "auditor-3"]
SEVERITIES = ["Critical", "High", "Medium", "Low", "Info"]
CATEGORIES = ["reentrancy", "oracle", "arithmetic", "dos", "proxy", "token"]
WORD_A = ["Missing", "Unsafe", "Stale", "Wrong", "Unbounded", "Reused", "Hidden", "Late", "Double", "Open", "Weak", "Silent"]
WORD_B = ["check", "transfer", "price", "loop", "slot", "nonce", "owner", "callback", "rounding", "approval", "burn", "mint", "quorum",
          "deadline", "fee", "index"]
PASS_KINDS = ["broad", "targeted", "verification"]


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> one finding each; about 500 orders make a project."""
    o, p, s, n = (F.col(c).cast("long") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    li = spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    file = F.concat(F.lit("src/F"), (p % 40).cast("string"), F.lit(".sol"))
    # Spark takes an element at no place for one that is never null; without the test it may read the row before.
    word = lambda words, at: F.when(at.isNotNull(), _pick(words, at))
    title = F.concat_ws(" ", word(WORD_A, (p * 7 + n) % 12), word(WORD_B, (p * 3 + s) % 16), F.lit("in"),
                        F.concat(F.lit("fn"), ((o * 11 + p * 5 + n * 17) % 50).cast("string"), F.lit("()")))
    return li.select(
        F.concat_ws("-", o.cast("string"), p.cast("string"), s.cast("string"), n.cast("string")).alias("finding_id"),
        F.concat(F.lit("P"), F.floor(o / 500).cast("string")).alias("project_id"), file.alias("file"),
        ((p * 7 + n * 13 + s) % 400).cast("int").alias("line"), _pick(AUDITORS, s % 3).alias("auditor_id"),
        (n % 3).cast("int").alias("pass_no"), _pick(PASS_KINDS, n % 3).alias("pass_kind"),
        _pick(SEVERITIES, (p * 3 + n * 7 + s) % 5).alias("severity"), _pick(CATEGORIES, (p + o * 5 + n) % 6).alias("category"),
        title.alias("title"), F.concat(F.lit("What goes wrong: "), title).alias("description"),
        F.concat(F.lit("Call it twice in "), file).alias("exploit"), F.concat(F.lit("Add a guard in "), file).alias("recommendation"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders -> one auditor response each, wrapped in one of six ways."""
    k = F.col("o_orderkey")
    ks = k.cast("string")

    def item(severity: Column, title: Column, line: Column) -> Column:
        return F.concat(
            F.lit('{"severity": "'), severity, F.lit('", "title": "'), title, F.lit('", "file": "src/F'), (k % 40).cast("string"),
            F.lit('.sol", "line": '), line, F.lit(', "description": "The order '), ks, F.lit(' is paid twice here", "exploit": "Pay order '), ks,
            F.lit(' twice", "recommendation": "Mark it as paid"}'))

    first = item(_pick([*SEVERITIES, "Severe"], k % 6), F.concat(F.lit("Order "), ks), (k % 300).cast("string"))
    second = item(_pick(SEVERITIES, k % 5), F.when(k % 7 == 0, F.lit("Tiny")).otherwise("Second look"),
                  F.when(k % 11 == 0, F.lit("-1")).when(k % 11 == 1, F.lit("1.5")).otherwise((k % 90).cast("string")))
    arr = F.concat(F.lit("["), first, F.lit(", "), second, F.lit("]"))
    note = F.concat(F.lit('[{"targetFile": "src/F'), (k % 40).cast("string"), F.lit('.sol", "reason": "looks odd in order '), ks,
                    F.lit('", "confidence": '), F.when(k % 13 == 0, F.lit("1.5")).otherwise((k % 100 / 100.0).cast("string")), F.lit("}]"))
    kind = F.floor(k / 6) % 6
    raw = (F.when(kind == 0, F.concat(F.lit("<think>balances[a] {x}</think>\n"), arr))
           .when(kind == 1, F.concat(F.lit('Here:\n```json\n{"findings": '), arr, F.lit("}\n```\nDone.")))
           .when(kind == 2, arr)
           .when(kind == 3, F.concat(F.lit("The result follows: "), arr))
           .when(kind == 4, F.concat(arr, F.lit("\nSUSPICIONS:\n"), note))
           .otherwise(F.substring(arr, F.lit(1), F.length(arr) - 2)))
    return table(spark, sf_dir, "orders").select(
        k.alias("resp_id"), _pick(AUDITORS, F.col("o_custkey") % 3).alias("auditor_id"), (k % 3 + 1).cast("int").alias("pass_no"), raw.alias("raw"))
