"""Rule packs by language; add a pack with :func:`register_rules`."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from codesift.rules import solidity


@dataclass(frozen=True)
class RulePack:
    """``facts()`` gives whole-file columns, ``branches(text)`` the rule
    branches (``text(lo, hi)`` joins neighbouring lines), ``messages`` severity, confidence, category, signal and
    verify text per branch key."""

    facts: Callable[[], dict[str, Column]]
    branches: Callable[[Callable[[int, int], Column]], list[solidity.Branch]]
    messages: dict[str, tuple[str, float, str, str, str]]
    displaced: str | None = None


SOLIDITY = RulePack(solidity.file_facts, solidity.solidity_branches, solidity.MESSAGES, displaced="ETH-030b")

_PACKS: dict[str, RulePack] = {"solidity": SOLIDITY, "vyper": SOLIDITY}


def register_rules(language: str, pack: RulePack) -> None:
    _PACKS[language] = pack


def packs() -> list[tuple[RulePack, list[str]]]:
    """Each distinct pack with the languages it serves."""
    out: list[tuple[RulePack, list[str]]] = []
    for language, pack in _PACKS.items():
        for known, languages in out:
            if known is pack:
                languages.append(language)
                break
        else:
            out.append((pack, [language]))
    return out
