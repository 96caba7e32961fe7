"""The ordered rules that tell what a question is about; the first that fits decides.

A rule has words it needs and words it must not have.  Where a question names several
groups of fields and a company (or all of them), ``router.plan`` makes sections of it
before these rules are asked.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from karst.plans.router import CAPABILITIES, Plan, plan

ROLES = r"\b(?:auditors?|auditing|directors?|shareholders?|members?|beneficial owners?|ebos|bo)\b"
COMPANY = r"\b(?:compan(?:y|ies)|clients?)\b"
#: Words of a question that are often written wrongly.
SPELLINGS = {"comapnies": "companies", "comapny": "company"}
#: Names of fields in plain words; the longest are looked for first.
FIELD_WORDS = {
    "company name": "Company Name", "registration number": "Reg No", "registration no": "Reg No", "reg no": "Reg No", "annual return date": "Annual Return Date", "incorporation date": "Incorporate Date", "date of incorporation": "Incorporate Date",
    "business address": "Business Address", "financial record address": "Financial Record Address", "total issued shares": "Total Issued Shares", "issued shares": "Total Issued Shares", "section 51 date": "Section 51 Date", "section 58 date": "Section 58 Date", "section 78 date": "Section 78 Date", "folder": "Folder",
}


@dataclass(frozen=True)
class Rule:
    intent: str
    needs: tuple[str, ...]
    not_: tuple[str, ...] = ()
    #: What the question must name: "", "company", "auditor" or "person".
    names: str = "company"
    #: The intent where the question asks for all and names none.
    of_all: str = ""


RULES = (
    Rule("person_status", (r"\b(?:status|roles?|positions?|involve\w*)\b", r"\b(?:of|for|does|is)\b"), (COMPANY,), "person"),
    Rule("person_beneficial_ownership", (r"\b(?:beneficial ownership|ebos|bo)\b", r"\b(?:history|of|for)\b"), (), "person"),
    Rule("person_shareholding", (r"\b(?:shareholdings?|shares? (?:held|owned)|holds? shares?|shareholder of (?:which|what))\b",), (), "person"),
    Rule("person_directorship", (r"\b(?:directorships?|director (?:of|in) (?:which|what)|(?:which|what) compan\w+ .*\bdirector)\b",), (), "person"),
    Rule("auditor_company_list", (r"\b(?:all|every|each|list)\b", r"\b(?:audited|auditors?)\b", COMPANY), (r"\bdistinct|unique\b",), "company", "auditor_company_list"),
    Rule("company_data", (r"\b(?:complete|full|all)\b.*\b(?:data|records?|information|details?)\b",), (ROLES,), "company"),
    Rule("company_annual_return", (r"\bannual returns?\b|\bar dates?\b",), (), "company"),
    Rule("company_extraction_issues", (r"\bextraction (?:issues?|errors?|problems?)\b",), (), "company"),
    Rule("company_statutory_documents", (r"\bstatutory (?:documents?|filings?|papers?)\b|\bfilings?\b",), (), "company"),
    Rule("company_statutory_events", (r"\bstatutory events?\b",), (), "company"),
    Rule("auditor_financial_year_end", (r"\bfinancial[\s-]+year[\s-]+end\b|\bfye\b|\byear ends?\b",), (), ""),
    Rule("auditor_list", (r"\b(?:list|distinct|unique|all)\b", r"\bauditors?\b|\baudit(?:ing)? firms?\b"), (COMPANY,), ""),
    Rule("auditor_companies", (r"\baudited by\b|\b(?:does|do|did)\b.*\baudits?\b|\bclients of\b",), (), "auditor"),
    Rule("auditor", (r"\bauditors?\b|\baudit(?:ing)? firms?\b|\bwho audits\b",), (), "company"),
    Rule("company_list", (r"\b(?:list|names?|all|every|which|how many)\b", COMPANY), (ROLES,), ""),
    Rule("beneficial_owner", (r"\bbeneficial owners?\b|\bebos\b|\bbos?\b",), (), "company", "beneficial_owner_list"),
    Rule("shareholder", (r"\bshareholders?\b|\bmembers?\b",), (), "company", "shareholder_list"),
    Rule("director", (r"\bdirectors?\b",), (), "company", "director_list"),
)


def fields(question: str) -> tuple[str, ...]:
    """The company's fields that a question names, in order of place."""
    text, found = f" {' '.join(re.findall(r'[a-z0-9]+', question.lower()))} ", {}
    for words in sorted(FIELD_WORDS, key=len, reverse=True):
        at = text.find(f" {words} ")
        if at >= 0:
            found.setdefault(FIELD_WORDS[words], at)
            text = text.replace(f" {words} ", " " + "\0" * len(words) + " ")
    return tuple(sorted(found, key=found.get))


def detect(question: str, company: Callable[[str], str], person: Callable[[str], str], auditor: Callable[[str], str]) -> Plan:
    """The plan of a question; the three functions find the one entity of their kind that it names, or an empty text."""
    q = question.lower()
    for wrong, right in SPELLINGS.items():
        q = re.sub(rf"\b{wrong}\b", right, q)
    everything = bool(re.search(r"\b(?:all|every|each)\b", q))
    groups = [g for g, _, p in CAPABILITIES if re.search(p, q)]
    who = person(question)
    about = any(all(re.search(n, q) for n in r.needs) for r in RULES if r.names == "person")
    if len(set(groups)) > 1 and not (who and about and not company(question)):
        made = plan(q, lambda _: company(question))
        if made.sections:
            return made
    own = fields(q)
    for r in RULES:
        if not all(re.search(n, q) for n in r.needs) or any(re.search(n, q) for n in r.not_):
            continue
        if r.names == "person":
            if who:
                return Plan(r.intent, who, question=question)
            continue
        name = company(question) if r.names == "company" else auditor(question) if r.names == "auditor" else ""
        special = [g for g in ("constitution_information", "financial_statement_information") if g in groups]
        if special:
            return Plan(special[0], company(question), everything and not company(question), tuple(f for g, f, p in CAPABILITIES if g == special[0] and re.search(p, q)), question=question)
        if r.intent == "company_annual_return" and len(own) > 1 or r.intent in ("company_list", "company_data") and own and own != ("Company Name",):
            return Plan("company_information", name or company(question), everything and not company(question), own, question=question)
        if r.intent == "auditor_company_list":
            return Plan("auditor", name, question=question) if name else Plan(r.intent, "", True, question=question)
        if r.intent in ("auditor_financial_year_end", "auditor_list") and company(question):
            return Plan("auditor", company(question), question=question)
        return Plan(r.of_all if r.of_all and everything and not name else r.intent, name, everything and not name, question=question)
    if own:
        return Plan("company_information", company(question), everything and not company(question), own, question=question)
    firm = auditor(question)
    if firm:
        return Plan("auditor_companies", firm, question=question)
    return plan(question, company)
