"""What a company's constitution says of written resolutions: which family of papers its clause calls for."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from karst.functions.text import by_rules, clean
from karst.functions.values import nfkd


class Family(NamedTuple):
    """``name`` for a clause that has one of the references of ``authority`` and all of ``with_`` but none of ``without``."""

    name: str
    authority: str
    references: tuple[str, ...]
    with_: tuple[str, ...]
    without: tuple[str, ...] = ()


STANDARD = "standard"
# The families, in the order they are tried, and what a clause's text gets wrong.
FAMILIES = (
    Family("section_90", "REGULATION", ("90",), ("TABLE A", "ARTICLES OF ASSOCIATION")),
    Family("section_90", "ARTICLE", ("3 D", "5", "9", "72", "77", "95"), ("ARTICLES OF ASSOCIATION",)),
    Family("section_90", "CLAUSE", ("53",), ("CONSTITUTION",)),
    Family("paragraph_15", "PARAGRAPH", ("15",), ("THIRD SCHEDULE",)),
    Family("paragraph_15", "ARTICLE", ("23 B", "34", "36", "37"), ("CONSTITUTION",), ("ARTICLES OF ASSOCIATION",)),
    Family("paragraph_15", "REGULATION", ("34",), ("CONSTITUTION",), ("ARTICLES OF ASSOCIATION",)),
)
CLAUSE_RULES = (("â€™|â€˜|�|’|‘", "'"), (r"(?i)\bCOMPANY'S\s+ACT\b", "COMPANIES ACT"), (r"\s+", " "))


def clause_key(c: Column) -> Column:
    """Upper case, compatibility forms taken apart, & read as AND, all but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.replace(F.upper(nfkd(c)), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))


def clause(c: Column) -> Column:
    """A clause as it is printed: quotes mended, the act by its name."""
    return clean(by_rules(F.regexp_replace(F.translate(c, " ­", " -"), r"\s+", " "), CLAUSE_RULES))


def family(c: Column, rules: tuple[Family, ...] = FAMILIES) -> Column:
    """The first family whose rule the clause fits, ``STANDARD`` if none does (null and empty texts too)."""
    key = clause_key(F.coalesce(c, F.lit("")))
    out = F.lit(STANDARD)
    for r in reversed(rules):
        fits = key.rlike(rf"\b{r.authority} (?:{'|'.join(r.references)})\b")
        for w in r.with_:
            fits = fits & F.contains(key, F.lit(w))
        for w in r.without:
            fits = fits & ~F.contains(key, F.lit(w))
        out = F.when(fits, r.name).otherwise(out)
    return out
