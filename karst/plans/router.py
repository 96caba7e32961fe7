"""From a question in plain words to a query: an ordered planner over named intents.

A plan is a value (intent, entity, fields, sections).  ``Registry.run`` builds the
DataFrame for it; nothing is computed before the caller asks for rows.  A question
that names several groups becomes a plan of sections, and one section's failure
does not touch the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# What each group of questions says, and the field it asks for.
CAPABILITIES = (
    ("company_information", "Annual Return Date", r"\bannual\s+returns?\b|\bar\s+dates?\b"),
    ("auditor_information", "Financial Year End", r"\bfinancial[\s-]+year[\s-]+end\b|\bfye\b"),
    ("auditor_information", "Auditor Name", r"\bauditors?\b|\baudit(?:ing)?\s+firms?\b|\bwho\s+audits\b"),
    ("director", "Directors", r"\bdirectors?\b(?!\s+(?:written|fees?))"),
    ("shareholder", "Shareholders", r"\bshareholders?\b|\bmembers?\b(?!\s+written)"),
    ("beneficial_owner", "Beneficial Owners", r"\bbeneficial\s+owners?\b|\bbos?\b"),
    ("constitution_information", "Director Written Resolution", r"\bdirectors?\s+written\s+resolutions?\b|\bdwr\b"),
    ("constitution_information", "Member Written Resolution", r"\bmembers?\s+written\s+resolutions?\b|\bmwr\b"),
    ("financial_statement_information", "Director Fee", r"\bdirectors?\s+fees?\b"),
    ("financial_statement_information", "Audit Firm", r"\bfinancial\s+statements?\b"),
)
_ALL = re.compile(r"\b(all|every|each)\b", re.I)


@dataclass(frozen=True)
class Plan:
    intent: str
    entity: str = ""
    all_records: bool = False
    fields: tuple[str, ...] = ()
    sections: tuple[Plan, ...] = ()
    question: str = ""


@dataclass
class Result:
    intent: str
    status: str
    rows: DataFrame | None = None
    error: str = ""
    sections: list[Result] = field(default_factory=list)


def plan(question: str, entities: Callable[[str], str] = lambda q: "") -> Plan:
    """The plan of a question; ``entities`` finds the one entity it names, or nothing."""
    entity, everything = entities(question), bool(_ALL.search(question))
    asked = sorted((m.start(), i, g, f) for i, (g, f, p) in enumerate(CAPABILITIES) if (m := re.search(p, question, re.I)))
    groups: dict[str, list[str]] = {}
    for _, _, g, f in asked:
        groups.setdefault(g, []).append(f)
    leaf = [Plan(g, entity, everything, tuple(f), question=question) for g, f in groups.items()]
    if len(leaf) > 1 and (entity or everything):
        return Plan("multi_intent", entity, everything, sections=tuple(leaf), question=question)
    return leaf[0] if leaf else Plan("company_information" if entity else "knowledge", entity, everything, question=question)


class Registry:
    """Builders by intent: plan in, DataFrame out."""

    def __init__(self, builders: dict[str, Callable[[Plan], DataFrame]]):
        self.builders = builders

    def run(self, p: Plan) -> Result:
        if p.sections:
            parts = [self.run(s) for s in p.sections]
            good = sum(r.status == "success" for r in parts)
            status = "success" if good == len(parts) else "partial" if good else "error" if any(r.status == "error" for r in parts) else "not_found"
            return Result(p.intent, status, sections=parts)
        if p.intent not in self.builders:
            return Result(p.intent, "error", error="no such intent")
        if not p.entity and not p.all_records:
            return Result(p.intent, "not_found", error="all records must be asked for in words")
        try:
            rows = self.builders[p.intent](p)
            return Result(p.intent, "not_found" if rows.isEmpty() else "success", rows)
        except Exception as e:  # one section's fault is its own
            return Result(p.intent, "error", error=str(e)[:500])
