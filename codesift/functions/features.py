"""Columns derived from a source file: language, attack score, imports, context."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Suffixes, score patterns with their weights, import patterns.
LANGUAGES = [(".sol", "solidity"), (".rs", "rust"), (".move", "move"), (".go", "go"), (".ts", "typescript"),
             (".js", "typescript"), (".py", "python")]

SCORE_WEIGHTS = [
    (r"transfer|withdraw|deposit|balance|stake|unstake|claim|fee|reward|pay|send|mint|burn", 0.30),
    (r"\.call\b|delegatecall|\.invoke|cpi::|cross.chain|callback|hook", 0.25),
    (r"onlyowner|onlyadmin|require.*msg\.sender|authority|role|permission|admin", 0.15),
    (r"mapping|storage\b|mut\s+\w|global\s+\w", 0.10),
    (r"muldiv|wadmul|raymul|shares?|rate|index|price|oracle|twap", 0.15),
]
INTERFACE = (r"(?m)^interface\s+|//.*SPDX.*interface|pub\s+trait\s+", 0.20)
LIBRARY = (r"(?m)^library\s+\w+\s*\{", 0.10, 0.2)

IMPORTS = [
    r"""import\s+(?:\{[^}]+\}\s+from\s+)?["']([^"']+)["']""",
    r"(?m)^mod\s+(\w+)\s*;",
    r"use\s+[\w:]+::(\w+)",
    r'import\s+(?:\w+\s+)?"([^"]+)"',
]

IMPORT_WORDS = ["import", "mod", "::", "import"]  # in every match of the pattern

SMALL_FILE = 200
# ---------------------------------------------------------------------------


def detect_language(path: Column) -> Column:
    out = F.lit("other")
    for suffix, name in reversed(LANGUAGES):
        out = F.when(path.endswith(suffix), name).otherwise(out)
    return out


def attack_score(content: Column) -> Column:
    """0..1, from words in the text that move value, call out or guard access."""
    low = F.lower(content)
    score = F.lit(0.0)
    for pattern, weight in SCORE_WEIGHTS:
        score = score + F.when(low.rlike(pattern), weight).otherwise(0.0)
    # A word that every match holds is looked for first: most texts need no pattern then.
    interface = (content.contains("interface") | content.contains("trait")) & content.rlike(INTERFACE[0])
    score = score - F.when(interface, INTERFACE[1]).otherwise(0.0)
    pattern, weight, below = LIBRARY
    score = score - F.when((score < below) & content.contains("library") & content.rlike(pattern), weight).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def extract_imports(content: Column) -> Column:
    none = F.array().cast("array<string>")
    # A text that lacks the word holds no match; a null text stays null.
    found = [F.when(content.contains(word), F.regexp_extract_all(content, F.lit(p), F.lit(1))).when(content.isNotNull(), none)
             for p, word in zip(IMPORTS, IMPORT_WORDS, strict=True)]
    return F.array_distinct(F.concat(*found))


def control_ratio(content: Column) -> Column:
    """Share of control characters; NULL for an empty text."""
    n = F.length(content)
    bare = F.regexp_replace(content, r"[\x00-\x08\x0e-\x1f\x7f]", "")
    return F.when(n > 0, (n - F.length(bare)) / n)


def is_binary(content: Column) -> Column:
    return F.coalesce(control_ratio(content) > 0.05, F.lit(False))


def trivial_summary(language: Column) -> Column:
    return F.concat(F.lit("Small "), language, F.lit(" file — likely interface, constants, or stub."))


def fallback_summary(language: Column, imports: Column, score: Column) -> Column:
    return F.concat(language, F.lit(" file with "), F.size(imports).cast("string"), F.lit(" import(s). Score: "),
                    F.format_string("%.2f", score), F.lit("."))


def project_name(first_path: Column) -> Column:
    """First folder of a project's first file."""
    parts = F.split(first_path, "/", -1)
    first = F.when(F.size(parts) > 1, parts[0]).otherwise("Protocol")
    return F.when(first == ".", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("Protocol"))).otherwise(first)
