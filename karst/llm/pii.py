"""Personal data in texts, on DataFrame functions alone.

Regular expressions propose spans, checksums and ranges confirm them, and words
in the 40 characters before a span move its score.  Positions are code points:
``split`` gives what lies between matches and ``regexp_extract_all`` the matches
of the same expression, so running lengths give starts and ends.

Kinds in order: email, ip, card, phone (the base: a confirmed span is reported
whatever its score), then iban, ssn, phone_local and secret (a key or token: 32 or
more letters and digits in one), which are reported from a score of ``LEAST`` up and
only where no base span is.  A local number or a secret needs a word that tells it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST, NEAR = 0.6, 40
SPAN = "array<struct<start:int,rank:int,kind:string,end:int,text:string,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    d = F.reverse(_digits(c))

    def term(i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda s, i: s + term(i)) % 10 == 0


def _mod97(c: Column) -> Column:
    s = F.regexp_replace(c, " ", "")
    s = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 4))

    def step(a: Column, i: Column) -> Column:
        v = F.ascii(F.substring(s, i, F.lit(1)))
        return F.when(v < 65, (a * 10 + v - 48) % 97).otherwise((a * 100 + v - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(s)), F.lit(0), step) == 1


def _ip(c: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return c.rlike(rf"^{part}(?:\.{part}){{3}}$")


@dataclass(frozen=True)
class Kind:
    name: str
    #: Quantifiers are possessive where that changes no match, and a match begins
    #: where a run begins, so that long runs take linear time and no deep stack.
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    words: str
    #: A cheap test that no text with a match fails.
    may: Callable[[Column], Column]
    base: bool = True


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda c: F.lit(True), 0.9, "mail|contact|write", lambda c: F.contains(c, F.lit("@"))),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _ip, 0.7, "ip|addr|host|server", lambda c: c.rlike(r"[0-9]\.[0-9]")),
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])", _luhn, 0.8, "card|visa|credit|debit|pay", lambda c: c.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda c: F.length(_digits(c)).between(10, 15), 0.7, "phone|tel|call|fax|mobil", lambda c: F.contains(c, F.lit("+"))),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])", lambda c: F.length(F.regexp_replace(c, " ", "")).between(15, 34) & _mod97(c), 0.8, "iban|account|konto|bank", lambda c: c.rlike("[A-Z]{2}[0-9]{2}"), False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda c: F.lit(True), 0.6, "ssn|social", lambda c: c.rlike("[0-9]-[0-9]{2}-[0-9]"), False),
    Kind("phone_local", r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])", lambda c: F.lit(True), 0.4, "phone|tel|call|fax|mobil", lambda c: c.rlike("[0-9]{3}[.-][0-9]{4}"), False),
    Kind("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}+", lambda c: c.rlike("[0-9]") & c.rlike("[A-Za-z]"), 0.4, "token|secret|key|passw|auth|bearer|credential", lambda c: c.rlike("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32}"), False),
)


def _spans(text: Column, rank: int, kind: Kind) -> Column:
    """The confirmed spans of one kind; an empty list where the cheap test fails."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        one = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), F.lit(kind.name).alias("kind"), end.alias("end"), x["hit"].alias("text"), F.lit(kind.score).alias("score"))
        keep = x["hit"].isNotNull() & kind.valid(F.coalesce(x["hit"], F.lit("00")))
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(keep, F.concat(a["out"], F.array(one))).otherwise(a["out"]).alias("out"))

    zipped = F.arrays_zip(between.alias("gap"), found.alias("hit"))
    return F.when(kind.may(text), F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN))


def _scored(text: Column, spans: Column) -> Column:
    """Scores with what the words before a span add."""
    def one(s: Column) -> Column:
        begin = F.greatest(s["start"] - NEAR, F.lit(0))
        before = F.lower(F.substring(text, begin + 1, s["start"] - begin))
        hint = F.lit(False)
        for k in KINDS:
            hint = F.when(s["kind"] == k.name, before.rlike(rf"(?<![a-z])(?:{k.words})")).otherwise(hint)
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end"), s["text"].alias("text"), F.least(s["score"] + F.when(hint, 0.3).otherwise(0.0), F.lit(1.0)).alias("score"))

    return F.transform(spans, one)


def find_pii(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with ``out``: array of (start, rank, kind, end, text, score) by start, then kind.

    A null or empty text has no spans.  Rows and their other columns stay as they
    are; a column of the name ``out`` gives way.  No shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    a, b = f"__karst_base_{out}", f"__karst_more_{out}"
    df = docs.withColumn(a, F.concat(*[_spans(t, i, k) for i, k in enumerate(KINDS) if k.base]))
    df = df.withColumn(b, F.concat(*[_spans(t, i, k) for i, k in enumerate(KINDS) if not k.base]))
    clear = F.filter(_scored(t, F.col(b)), lambda s: (s["score"] >= LEAST) & ~F.exists(F.col(a), lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    both = F.when((F.size(a) == 0) & (F.size(b) == 0), F.array().cast(SPAN)).otherwise(F.array_sort(F.concat(_scored(t, F.col(a)), clear)))
    return df.withColumn(out, both).drop(a, b)


def is_base(s: Column) -> Column:
    return s["kind"].isin(*[k.name for k in KINDS if k.base])


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` (with text, and n_chars if there) with every span replaced by its kind in brackets, as ``[EMAIL]``.

    Overlapping spans are replaced as one, by the kind that begins first.  Texts
    without spans, null texts among them, stay as they are.
    """
    p = "__karst_pii"
    df = find_pii(docs, out=p)
    t = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = F.array(F.substring(t, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], F.concat(a["out"], new)).otherwise(a["out"]).alias("out"))

    clean = F.aggregate(F.col(p), start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    df = df.withColumn("text", F.when(F.size(p) > 0, clean).otherwise(t)).drop(p)
    return df.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else df
