"""URL filters: rules by host and path first, then a list of canonical URLs.

The list is met in two steps.  A blocked Bloom filter of its members says which
URLs can be listed; those, each once, go to a hash join with the list, which
takes false positives out.  The filter is a table of blocks of eight 64-bit words
with one bit of every member in each word, and has at most ``MAX_BLOCKS`` rows
whatever the length of the list, so that it can always be broadcast; a list too
long for it makes more false positives and no wrong result.

DataFrame functions only.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.llm.common import Scratch

#: Rows of the filter that is broadcast, at most: 64 bytes of bits each, 17 MB together.
MAX_BLOCKS = 1 << 18
#: Bits of the filter for each listed URL, as long as ``MAX_BLOCKS`` allows.
BITS = 12
#: Listed URLs seen among the pages that are broadcast; with more, both sides are shuffled.
MAX_HITS = 100_000
_WORDS = 8
#: Parameters that tell where a visitor came from, and so do not name another page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Site names of adverts, bets and pills: pages there are the list of ``reported``.
REPORTED = r"(^|[.-])(ads|adult|bets|casino|pills|spam)-|-(track|farm|win|bets|pills)\."


class Rule(NamedTuple):
    """``verdict`` for a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """One spelling for the URLs of a page, null where there is no host.

    Scheme, ``www.``, default port, fragment, tracking parameters and slashes at
    the path's end go; other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), "^www\\.", ""), ":(80|443)$", "")
    query = F.regexp_extract(_rest(url), "^[^?#]*\\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does; of equal length the first.

    Rules are a short list written by hand and become one expression; many single
    pages belong into the list.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host) + len(r.path)):  # the longest is asked first
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def reported(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages of reported sites, each once: a list that grows with the pages."""
    return pages.where(host_of(F.col("url")).rlike(REPORTED)).select(canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL").distinct()


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _bit(url: Column, word: int) -> Column:
    """A long with the bit that a URL has in a word: six bits of a second hash tell which."""
    place = F.shiftrightunsigned(F.xxhash64(url, F.lit("bit")), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def blocked_filter(listed: DataFrame, blocks: int) -> DataFrame:
    """(block, word0 .. word7) of the blocks that hold a bit: at most ``blocks`` rows."""
    url = F.col("canonical")
    words = [F.bit_or(_bit(url, w)).alias(f"word{w}") for w in range(_WORDS)]
    return listed.groupBy(_block(url, blocks).alias("block")).agg(*words)


def may_be_listed(urls: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``urls`` (canonical) whose bits are all set: every listed one, few others."""
    url = F.col("canonical")
    met = urls.withColumn("__block", _block(url, blocks)).join(F.broadcast(bloom), F.col("__block") == F.col("block"))
    for w in range(_WORDS):
        bit = _bit(url, w)
        met = met.where(F.col(f"word{w}").bitwiseAND(bit) == bit)
    return met.select(*urls.columns)


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame, max_blocks: int = MAX_BLOCKS, max_hits: int = MAX_HITS) -> DataFrame:
    """page_id, host, path, rule, verdict and canonical of every row of pages (page_id, url).

    A rule's verdict holds; where none fits, a page whose canonical URL is in
    ``listed`` (canonical) is blocked and any other allowed.  A null URL, or one
    without ``://``, has an empty host and path and no canonical URL: no rule that
    names a host fits it, it isn't listed, and it is allowed.  Repeated rows and
    rows of one or no page_id are judged each for itself; other columns of pages
    are left behind; of an empty table nothing is left, and an empty list blocks nothing.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    url = F.col("url")
    told = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("canonical"))
    told = told.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    listed = scratch.keep(listed.select("canonical").where("canonical IS NOT NULL").distinct(), "listed")
    blocks = min(max_blocks, max(1, -(-listed.count() * BITS // (64 * _WORDS))))
    bloom = scratch.keep(blocked_filter(listed, blocks), "filter")
    asked = told.where("__rule IS NULL AND canonical IS NOT NULL").select("canonical")
    # Each URL once before the exact join: a URL of very many rows is one there.
    hits = scratch.keep(may_be_listed(asked, bloom, blocks).distinct().join(listed, "canonical", "leftsemi"), "hits")
    hits = hits.select(F.col("canonical").alias("__hit"))
    if hits.count() <= max_hits:
        hits = F.broadcast(hits)
    # Rows that can't be hits have keys of their own, so that they are dealt out evenly if the join shuffles.
    key = F.when(F.col("__rule").isNull() & F.col("canonical").isNotNull(), F.col("canonical")).otherwise(F.concat(F.lit("\0"), F.xxhash64("page_id", "path").cast("string")))
    found = told.withColumn("__key", key).join(hits, F.col("__key") == F.col("__hit"), "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__hit").isNotNull(), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "canonical")
