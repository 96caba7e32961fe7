"""Names, identifiers and other text as keys and for display."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean "nothing" in the sources.
BLANKS = ("", "NAN", "NONE", "-")
NIL_BLANKS = ("", "NIL", "N/A", "NONE", "-")
# Words that tell no company from another.
GENERIC_WORDS = ("SDN", "BHD", "BERHAD", "PRIVATE", "LIMITED", "LTD", "COMPANY", "CO", "MALAYSIA", "M")
# Codes of papers by what they are called.
PAPER_CODES = {"B": ("MYKAD", "NRIC", "BLUEIC", "B"), "P": ("PASSPORT", "P"), "R": ("REDIC", "R"), "Z": ("MILITARYID", "MILITARY", "Z"), "M": ("POLICEID", "POLICE", "M")}
# Particles of personal names that stay upper case.
PARTICLES = ("A/L", "A/P", "BIN", "BINTI")


def name_key(c: Column) -> Column:
    """Upper case, letters and digits, single blanks between; ß counts as SS on every engine."""
    up = F.upper(F.replace(c, F.lit("ß"), F.lit("ss")))
    return F.trim(F.regexp_replace(F.regexp_replace(up, "[^A-Z0-9]", " "), " +", " "))


def entity_key(c: Column) -> Column:
    """As ``name_key``, with & read as AND."""
    return name_key(F.replace(c, F.lit("&"), F.lit(" AND ")))


def join_initials(c: Column) -> Column:
    """Runs of two or more single-character tokens become one token: Y H TAN -> YH TAN."""
    return F.regexp_replace(c, r"(?<=\b\w) (?=\w\b)", "")


def auditor_key(c: Column) -> Column:
    return join_initials(entity_key(c))


def identity_key(c: Column) -> Column:
    """Letters and digits only."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def person_key(identity: Column, name: Column) -> Column:
    """ID:identity if there is one, else NAME:name, else an empty text."""
    i, n = F.coalesce(identity_key(identity), F.lit("")), F.coalesce(name_key(name), F.lit(""))
    return F.when(i != "", F.concat(F.lit("ID:"), i)).when(n != "", F.concat(F.lit("NAME:"), n)).otherwise("")


def group_key(registration: Column, company: Column, name: Column) -> Column:
    r, c, n = (F.coalesce(name_key(x), F.lit("")) for x in (registration, company, name))
    return F.when(r != "", F.concat(F.lit("REG:"), r)).when(c != "", F.concat(F.lit("COMPANY:"), c)).otherwise(F.concat(F.lit("NAME:"), n))


def significant_tokens(key: Column, generic: tuple[str, ...] = GENERIC_WORDS) -> Column:
    """Tokens of a key without generic words and single characters, first occurrences in order."""
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: (F.length(t) > 1) & ~t.isin(*generic)))


def by_rules(c: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Each (pattern, replacement) in turn, and no blanks at the ends."""
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return F.trim(c)


def clean(c: Column) -> Column:
    """No-break blanks and replacement characters to blanks, soft hyphens to hyphens, single blanks between."""
    return F.trim(F.regexp_replace(F.translate(c, " �­", "  -"), r"\s+", " "))


def clean_lines(c: Column) -> Column:
    """``clean`` line by line, empty lines dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), clean), lambda x: x != ""), "\n")


def null_if_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def null_if_nothing(c: Column) -> Column:
    """Null for the texts that mean nothing."""
    return F.when(F.upper(F.trim(c)).isin(*BLANKS), F.lit(None)).otherwise(F.trim(c))


def has_value(c: Column, nil: bool = False) -> Column:
    t = F.coalesce(F.trim(c), F.lit(""))
    return ~F.upper(t).isin(*NIL_BLANKS) if nil else t != ""


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*[null_if_blank(c) for c in columns])


def is_marked(c: Column) -> Column:
    return ~F.upper(F.coalesce(F.trim(c), F.lit(""))).isin("", "N", "NO", "FALSE", "0", "-")


def registration_tokens(c: Column) -> Column:
    """New 12-digit and old numbers of a registration text, without hyphens, distinct."""
    up = F.upper(F.coalesce(c, F.lit("")))
    new = F.regexp_extract_all(up, F.lit(r"(?<!\d)(\d{12})(?!\d)"), F.lit(1))
    old = F.regexp_extract_all(up, F.lit(r"(?<!\d)(\d{6,7}-?[A-Z])(?![A-Z0-9])"), F.lit(1))
    return F.array_distinct(F.concat(new, F.transform(old, lambda x: F.replace(x, F.lit("-"), F.lit("")))))


def registration_state(document: Column, master: Column) -> Column:
    """2: the documents share a number, 1: the document has none, 0: they conflict."""
    d, m = registration_tokens(document), registration_tokens(master)
    return F.when(F.size(d) == 0, 1).when(F.arrays_overlap(d, m), 2).otherwise(0)


def format_identity_number(c: Column) -> Column:
    """Twelve digits as ######-##-####; anything else as it is."""
    return F.regexp_replace(F.regexp_replace(c, r"^(\d{6})-?(\d{2})-?(\d{4})$", "$1$2$3"), r"^(\d{6})(\d{2})(\d{4})$", "$1-$2-$3")


def display_name(c: Column) -> Column:
    """Every run of letters with a capital first, particles in capitals."""
    def word(t: Column) -> Column:
        parts = F.regexp_extract_all(F.lower(t), F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
        return F.when(F.upper(t).isin(*PARTICLES), F.upper(t)).otherwise(F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), ""))

    return F.array_join(F.transform(F.split(F.trim(c), r"\s+"), word), " ")


def honorific(gender: Column) -> Column:
    g = F.upper(F.trim(gender))
    return F.when(g == "MALE", "Mr.").when(g == "FEMALE", "Ms.").otherwise("")


def safe_filename(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r'[<>:"/\\|?*]', "-"))


def nationality_adjective(c: Column) -> Column:
    """MALAYSIAN for the country or its adjective, any other in capitals."""
    up = F.upper(clean(c))
    return F.when(up.isin("MALAYSIA", "MALAYSIAN"), "MALAYSIAN").otherwise(up)


def member_analysis(told: Column, nationality: Column, race: Column) -> Column:
    """What a return says of a member's citizenship, else what follows from nationality and race; an empty text if nothing does."""
    n, r = F.upper(F.coalesce(nationality, F.lit(""))), F.upper(F.coalesce(race, F.lit("")))
    home = n.isin("MALAYSIA", "MALAYSIAN")
    return F.when(F.coalesce(told, F.lit("")) != "", told).when((n != "") & ~home, "NON-CITIZENS").when(r.isin("MALAY", "BUMIPUTERA", "NATIVE"), "CITIZENS WHO ARE MALAYS AND NATIVES").when(home & (r != ""), "CITIZENS WHO ARE NON - MALAYS AND NON- NATIVES").otherwise("")


def paper_code(c: Column) -> Column:
    """The code of an identity paper; an empty text for any other."""
    key = identity_key(F.coalesce(c, F.lit("")))
    out = F.lit("")
    for code, names in PAPER_CODES.items():
        out = F.when(key.isin(*names), code).otherwise(out)
    return out
