"""Columns of audit-report findings: header, severity, protocol, category, title."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codesift.functions.text import trimmed

# ---------------------------------------------------------------------------
# Header pattern, severity codes, file-name affixes, categories.
HEADER = (r"(?i)^#{1,4}\s+(?:\*{1,2})?\[?([A-Z]{1,4}[-–]?\d{1,3}|HIGH|MEDIUM|LOW|CRITICAL|INFORMATIONAL|INFO|GAS|QA|NOTE)"
          r"\]?(?:\*{1,2})?[:\s\-–]+(.+)?$")

SEVERITIES = {
    "C": "Critical", "CR": "Critical", "CRIT": "Critical", "H": "High", "HI": "High", "HIGH": "High",
    "M": "Medium", "MED": "Medium", "MEDIUM": "Medium", "L": "Low", "LO": "Low", "LOW": "Low",
    "I": "Info", "IN": "Info", "INFO": "Info", "N": "Info", "G": "Info", "Q": "Info",
}

NAME_DATE = r"^\d{4}-\d{2}-\d{2}-?"
NAME_EXTENSION = r"(?i)\.md$"
NAME_SUFFIXES = [r"(?i)-?(?:security[- ]?)?audit[-_ v\d.]*$", r"(?i)-?report[-_ v\d.]*$", r"(?i)-?review[-_ v\d.]*$"]

CATEGORIES = [
    (r"reentrancy|re-entrancy", "reentrancy"),
    (r"price\s+manipulat|oracle|twap|chainlink|spot\s+price", "oracle-manipulation"),
    (r"flash\s*loan", "flash-loan"),
    (r"access\s*control|onlyowner|onlyadmin|unauthorized|privilege", "access-control"),
    (r"overflow|underflow|arithmetic|unchecked\s+math", "arithmetic"),
    (r"front.?run|sandwich|mev", "frontrunning"),
    (r"denial.of.service|dos\b|gas\s+limit|unbounded\s+loop", "dos"),
    (r"signature|replay|ecrecover", "signature"),
    (r"governance|voting|proposal|timelock", "governance"),
    (r"liquidat", "liquidation"),
    (r"upgrade|proxy|delegate.?call|implementation", "proxy-upgrade"),
    (r"centrali[sz]ation|admin\s+key|single\s+point", "centralization"),
    (r"rounding|precision|truncat", "rounding"),
    (r"erc.?4626|vault\s+share", "erc4626"),
    (r"erc.?20|token\s+transfer", "erc20"),
    (r"erc.?721|nft|non.fungible", "erc721"),
    (r"cross.chain|bridge|ccip|layerzero", "cross-chain"),
    (r"storage\s+collision|slot\s+collision", "storage-collision"),
]

SOURCE_PREFIX = "solodit:"
# ---------------------------------------------------------------------------


def extract_severity(code: Column) -> Column:
    """Severity of a finding code: the letters as a whole, else the first one."""
    letters = F.upper(F.regexp_replace(code, r"[-\s\d]", ""))
    known = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, letters), F.try_element_at(known, F.substring(letters, 1, 1)), F.lit("Info"))


def extract_protocol(filename: Column) -> Column:
    """Project name in a report's file name; never empty."""
    plain = F.regexp_replace(F.regexp_replace(filename, NAME_DATE, ""), NAME_EXTENSION, "")
    short = plain
    for suffix in NAME_SUFFIXES:
        short = F.regexp_replace(short, suffix, "")
    return F.coalesce(F.nullif(short, F.lit("")), F.nullif(plain, F.lit("")), filename)


def infer_category(text: Column, severity: Column) -> Column:
    low = F.lower(text)
    out = F.lower(severity)
    for pattern, name in reversed(CATEGORIES):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def infer_title(header_title: Column, body_lines: Column, severity: Column, protocol: Column) -> Column:
    """The header's title, else the first telling line of the body, else a stock title."""
    tell = F.filter(F.transform(body_lines, trimmed),
                    lambda t: (F.length(t) > 5) & ~t.startswith("#") & ~t.startswith("|") & ~t.startswith("---"))
    first = F.get(tell, F.lit(0))
    plain = trimmed(F.regexp_replace(first, r"\*{1,2}([^*]+)\*{1,2}", "$1"))
    short = F.when(F.length(plain) > 100, F.concat(F.substring(plain, 1, 97), F.lit("..."))).otherwise(plain)
    stock = F.concat(severity, F.lit(" finding in "), protocol)
    head = F.nullif(header_title, F.lit(""))
    return (F.when(F.length(head) >= 5, head).when(first.isNotNull(), F.coalesce(F.nullif(short, F.lit("")), stock))
            .otherwise(F.coalesce(head, stock)))


def document_text(title: Column, severity: Column, category: Column, protocol: Column, description: Column) -> Column:
    return F.concat_ws(
        "\n", F.concat(F.lit("Title: "), title), F.concat(F.lit("Severity: "), severity),
        F.concat(F.lit("Category: "), category), F.concat(F.lit("Protocol: "), protocol), F.lit(""), trimmed(description))
