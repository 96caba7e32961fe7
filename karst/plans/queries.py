"""The registered queries and, for each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.functions import text as T
from karst.functions import values as V
from karst.operators import extract, ledger, people, reshape, vectors
from karst.operators.latest import canonical_value, last_filled, latest_state, nearest, pick
from karst.operators.lookup import contains_either_way, ends_or_equals, guarded_lookup, guarded_lookup_many, mentioned
from karst.sources.tables import require

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Order of an event's kind when dates tie; an error ends the state.
PRIORITY = {"signup": 3, "error": 1}
# The SQL side of ``name_key``.
KEY_SQL = "trim(regexp_replace(regexp_replace(upper(replace({0}, 'ß', 'ss')), '[^A-Z0-9]', ' ', 'g'), ' +', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return require(spark.read.parquet(f"{sf_dir}/{name}.parquet"), list(columns)).select(*columns)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a small file, of each of which a long text is made and read, dealt to all cores: the file alone has fewer parts."""
    return df.repartition(4 * max(df.sparkSession.sparkContext.defaultParallelism, 8), key)


def _priority():
    out = F.lit(2)
    for kind, n in PRIORITY.items():
        out = F.when(F.col("event_type") == kind, n).otherwise(out)
    return out


_PRIO_SQL = "CASE event_type WHEN 'signup' THEN 3 WHEN 'error' THEN 1 ELSE 2 END"


@query(f"""
SELECT user_id, event_id, ts, event_type, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, {_PRIO_SQL} DESC, value DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND event_type <> 'error'""")
def latest_state_per_user(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "ts", "event_type", "value")
    return latest_state(e, ["user_id"], [F.desc("ts"), _priority().desc(), F.desc("value"), F.desc("event_id")], F.col("event_type") == "error")


@query("""
SELECT user_id, event_type, event_id, ts, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id DESC) AS n FROM events)
WHERE n = 1 AND event_type <> 'error'""")
def latest_state_per_user_type(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "event_id", "ts", "value")
    return latest_state(e, ["user_id", "event_type"], [F.desc("ts"), F.desc("value"), F.desc("event_id")], F.col("event_type") == "error")


@query("""
SELECT doc_id, lang, source FROM (
    SELECT *, row_number() OVER (PARTITION BY sha256(trim(lower(text))) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def dedup_keep_first_text(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "source", "text")
    # Only digests are shuffled, not texts.
    return pick(t.select("doc_id", "lang", "source", F.sha2(F.trim(F.lower("text")), 256).alias("h")), ["h"], [F.asc("doc_id")]).drop("h")


@query("""
SELECT user_id, event_type, event_id, value FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def dedup_keep_last_events(spark, d):
    return pick(table(spark, d, "events", "user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.desc("event_id")])


@query("""
WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders WHERE trim(o_orderpriority) <> '' GROUP BY 1, 2)
SELECT o_custkey, o_orderpriority, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def canonical_mode_first_seen(spark, d):
    return canonical_value(table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS n_customers, count(DISTINCT c_mktsegment) AS n_segments
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name""")
def distinct_group_counts(spark, d):
    c, n = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment"), table(spark, d, "nation", "n_nationkey", "n_name")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count_distinct("c_custkey").alias("n_customers"), F.count_distinct("c_mktsegment").alias("n_segments")).orderBy("n_name")


@query(f"""
WITH k AS (SELECT s_suppkey, s_name, {KEY_SQL.format('s_name')} AS k FROM supplier),
near AS (SELECT * FROM k WHERE contains(k, 'SUPPLIER 000000001'))
SELECT s_suppkey, s_name FROM near
WHERE k = 'SUPPLIER 000000001' OR ((SELECT count(*) FROM near WHERE k = 'SUPPLIER 000000001') = 0 AND (SELECT min(k) = max(k) FROM near))""")
def guarded_name_lookup(spark, d):
    return guarded_lookup(table(spark, d, "supplier", "s_suppkey", "s_name"), T.name_key(F.col("s_name")), "SUPPLIER 000000001")


@query("""
WITH t AS (SELECT DISTINCT p_brand AS term FROM part UNION SELECT 'no such' UNION SELECT DISTINCT p_name FROM part),
k AS (SELECT DISTINCT p_name FROM part),
e AS (SELECT term, p_partkey, p_name FROM t JOIN part ON term = p_name),
l AS (SELECT term FROM t WHERE term <> '' AND term NOT IN (SELECT p_name FROM k)),
o AS (SELECT term, min(p_name) AS f FROM l JOIN k ON contains(p_name, term) GROUP BY term HAVING min(p_name) = max(p_name))
SELECT * FROM e UNION ALL SELECT term, p_partkey, p_name FROM o JOIN part ON f = p_name""")
def guarded_name_lookup_many(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand")
    terms = p.select(F.col("p_brand").alias("t")).union(spark.sql("SELECT 'no such' AS t")).union(p.select("p_name"))
    return guarded_lookup_many(p.select("p_partkey", "p_name"), "p_name", terms, "t")


@query("""
SELECT p_partkey, p_name FROM part WHERE upper(p_name) = 'RING' OR upper(p_name) LIKE '% RING'""")
def suffix_match(spark, d):
    return table(spark, d, "part", "p_partkey", "p_name").where(ends_or_equals(F.upper("p_name"), "RING"))


@query("""
SELECT a.n_name AS name, b.n_name AS other FROM nation a, nation b
WHERE a.n_nationkey < b.n_nationkey AND a.n_name <> '' AND b.n_name <> '' AND (contains(a.n_name, b.n_name) OR contains(b.n_name, a.n_name))""")
def bidirectional_contains(spark, d):
    # Both sides are one fixed table of 25 rows.
    a, b = table(spark, d, "nation", "n_nationkey", "n_name").toDF("k", "name"), table(spark, d, "nation", "n_nationkey", "n_name").toDF("m", "other")
    return a.join(F.broadcast(b), (F.col("k") < F.col("m")) & contains_either_way(F.col("name"), F.col("other"))).select("name", "other")


@query(f"""
WITH n AS (SELECT DISTINCT {KEY_SQL.format('text')} AS name FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark)),
nt AS (SELECT name, list_distinct(list_filter(string_split(name, ' '), lambda t: length(t) > 1 AND t NOT IN ('SDN','BHD','BERHAD','PRIVATE','LIMITED','LTD','COMPANY','CO','MALAYSIA','M'))) AS tk FROM n WHERE name <> ''),
t AS (SELECT doc_id, string_split({KEY_SQL.format('text')}, ' ') AS w FROM documents),
h AS (SELECT doc_id, name, len(tk) AS n, length(name) AS s FROM nt, t WHERE len(tk) > 0 AND list_has_all(w, tk) AND (len(tk) > 1 OR length(name) >= 5)),
r AS (SELECT *, rank() OVER (PARTITION BY doc_id ORDER BY n DESC, s DESC) AS r FROM h)
SELECT doc_id, min(name) AS name FROM r WHERE r = 1 GROUP BY doc_id HAVING count(DISTINCT name) = 1""")
def token_subset_match(spark, d):
    lines = table(spark, d, "benchmark", "item_id", "text").select(F.explode(F.split("text", "\n")).alias("line"))
    names = lines.select(T.name_key(F.col("line")).alias("name"))
    texts = table(spark, d, "documents", "doc_id", "text").select("doc_id", T.name_key(F.col("text")).alias("k"))
    return mentioned(names, "name", texts, "k", "doc_id")


@query(f"""
SELECT doc_id, {KEY_SQL.format("text")} AS name_key, {KEY_SQL.format("replace(text, '&', ' AND ')")} AS entity_key,
    regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z0-9]', '', 'g') AS identity_key FROM documents""")
def normalize_keys(spark, d):
    t = F.col("text")
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.name_key(t).alias("name_key"), T.entity_key(t).alias("entity_key"), T.identity_key(F.replace(t, F.lit("ß"), F.lit("ss"))).alias("identity_key"))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS d, CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%Y') WHEN 1 THEN strftime(o_orderdate, '%-d-%-m-%Y') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%-d %B %Y') ELSE '31/02/2024' END AS s FROM orders)
SELECT o_orderkey, s, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE d END AS parsed, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE strftime(d, '%Y-%m-%d') END AS iso FROM t""")
def multi_format_dates(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 5
    form = lambda x: F.date_format("o_orderdate", x)
    o = o.select("o_orderkey", F.when(k == 0, form("d/M/yyyy")).when(k == 1, form("d-M-yyyy")).when(k == 2, form("yyyy-MM-dd")).when(k == 3, form("d MMMM yyyy")).otherwise("31/02/2024").alias("s"))
    p = V.parse_date(F.col("s"), V.LONG_DATES)
    return o.select("o_orderkey", "s", p.alias("parsed"), V.iso_date(p).alias("iso"))


@query("""
SELECT l_orderkey, l_linenumber, floor(l_extendedprice)::BIGINT AS whole, -round(l_extendedprice, 2) AS negative, round(l_discount * 100, 2) AS pct, l_quantity::BIGINT AS n
FROM lineitem""")
def parse_numbers(spark, d):
    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity")
    money = F.format_number("l_extendedprice", 2)
    return x.select("l_orderkey", "l_linenumber", V.parse_integer(money).alias("whole"), V.parse_money(F.concat(F.lit("("), money, F.lit(")"))).cast("double").alias("negative"), V.parse_percent(F.concat(F.format_number(F.col("l_discount") * 100, 2), F.lit("%"))).alias("pct"), V.parse_count(F.format_string("%.0f", "l_quantity")).alias("n"))


def _wide(spark, d):
    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    most = x.agg(F.max("l_linenumber")).first()[0] or 1  # as many slots as the table has
    return reshape.pivot_slots(x.withColumnsRenamed({"l_partkey": "Name", "l_quantity": "Shares"}), "l_orderkey", "l_linenumber", ["Name", "Shares"], int(most), "Member")


@query("""
SELECT l_orderkey, l_linenumber::INT AS slot, max(l_partkey) AS "Name", max(l_quantity) AS "Shares" FROM lineitem GROUP BY 1, 2""")
def unpivot_slots(spark, d):
    return reshape.unpivot_slots(_wide(spark, d), "Member", "Name", ["l_orderkey"])


@query("SELECT l_orderkey, " + ", ".join(f'max(CASE WHEN l_linenumber = {n} THEN l_partkey END) AS "Member{n} Name", max(CASE WHEN l_linenumber = {n} THEN l_quantity END) AS "Member{n} Shares"' for n in range(1, 8)) + " FROM lineitem GROUP BY l_orderkey")
def pivot_slots(spark, d):
    return _wide(spark, d)


@query("""
SELECT 'customer' AS role, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, NULL::VARCHAR AS place FROM customer
UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL, NULL FROM supplier
UNION ALL SELECT 'nation', n_name, n_nationkey, NULL, n_regionkey::VARCHAR FROM nation""")
def union_roles(spark, d):
    c = table(spark, d, "customer", "c_name", "c_nationkey", "c_mktsegment").toDF("name", "nation", "segment")
    s = table(spark, d, "supplier", "s_name", "s_nationkey").toDF("name", "nation")
    n = table(spark, d, "nation", "n_name", "n_nationkey", "n_regionkey").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("nation"), F.col("n_regionkey").cast("string").alias("place"))
    return reshape.union_roles({"customer": c, "supplier": s, "nation": n})


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def semi_join_expand(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi")


@query("""
SELECT c_custkey, coalesce(nullif(trim(n_name), ''), nullif(trim(c_name), ''), '-') AS place, coalesce(r_name, 'UNKNOWN') AS region
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 3 <> 0 LEFT JOIN region ON n_regionkey = r_regionkey""")
def left_join_coalesce(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey").where("n_nationkey % 3 <> 0")
    r = table(spark, d, "region", "r_regionkey", "r_name")
    out = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return out.select("c_custkey", T.first_filled(F.col("n_name"), F.col("c_name"), F.lit("-")).alias("place"), F.coalesce("r_name", F.lit("UNKNOWN")).alias("region"))


@query("""
WITH a AS (SELECT * FROM orders WHERE o_orderkey % 11 <> 0),
b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 17 <> 0)
SELECT * FROM (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed'
    WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey) WHERE change IS NOT NULL""")
def full_outer_diff(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_orderkey % 17 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 13 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return reshape.snapshot_diff(o.where("o_orderkey % 11 <> 0"), new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity)::BIGINT AS w FROM lineitem),
c AS (SELECT *, round(10000 * w::DOUBLE / sum(w) OVER (PARTITION BY l_orderkey))::BIGINT AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, w) AS n, count(*) OVER (PARTITION BY l_orderkey) AS m FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN n = m THEN 10000 - coalesce(sum(c) OVER (PARTITION BY l_orderkey ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE c END::BIGINT AS cents FROM c""")
def share_sum_with_remainder(spark, d):
    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").withColumn("w", F.floor("l_quantity"))
    return ledger.allocate(x, "l_orderkey", [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("w")], "w", F.lit(100.0), "cents").drop("w", "l_quantity")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity)::BIGINT AS w FROM (SELECT *, sum(floor(l_quantity)) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) WHERE floor(l_quantity) * 100 >= 20 * t""")
def ratio_threshold(spark, d):
    from karst.records.contexts import owners_of

    x = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").withColumn("w", F.floor("l_quantity"))
    return owners_of(x, "l_orderkey", "w").drop("l_quantity")


@query("""
WITH s AS (SELECT user_id, event_type, event_id, ts::DATE AS d, floor(value)::BIGINT AS v FROM events WHERE event_type = 'signup'),
c AS (SELECT user_id, event_type, ts::DATE AS d, floor(value)::BIGINT AS v FROM events WHERE event_type = 'purchase'),
b AS (SELECT user_id, max(d) AS bd FROM s GROUP BY 1),
u AS (SELECT s.user_id, 'share' AS subject, v FROM s JOIN b USING (user_id) WHERE d = bd
    UNION ALL SELECT c.user_id, 'share', v FROM c LEFT JOIN b USING (user_id) WHERE bd IS NULL OR d > bd)
SELECT user_id, subject, sum(v)::BIGINT AS v FROM u GROUP BY 1, 2""")
def snapshot_plus_changes(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "ts", "value").select("user_id", "event_type", F.lit("share").alias("subject"), F.floor("value").alias("v"), F.to_date("ts").alias("d"))
    return ledger.snapshot_plus_changes(e.where("event_type = 'signup'"), e.where("event_type = 'purchase'"), "user_id", "subject", "v", "d")


@query("""
WITH e AS (SELECT user_id % 20 AS k, user_id AS s, CASE event_type WHEN 'error' THEN 'CEASE' WHEN 'click' THEN 'APPOINT' ELSE event_type END AS kind, ts::DATE AS d FROM events),
b AS (SELECT k, max(d) AS bd FROM e WHERE kind = 'signup' GROUP BY k),
h AS (SELECT DISTINCT e.k, s, 'SNAPSHOT' AS kind, d, 0 AS o FROM e JOIN b USING (k) WHERE kind = 'signup' AND d = bd),
v AS (SELECT DISTINCT * FROM e WHERE kind IN ('CEASE', 'APPOINT')),
x AS (SELECT k, s, d FROM v GROUP BY ALL HAVING count(DISTINCT kind) > 1),
l AS (SELECT v.k, v.s, kind, v.d, 1 AS o FROM v LEFT JOIN b USING (k) WHERE (bd IS NULL OR v.d >= bd) AND NOT EXISTS (SELECT 1 FROM x WHERE x.k = v.k AND x.s = v.s AND x.d = v.d)),
r AS (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY d DESC, o DESC, kind) AS n FROM (SELECT * FROM h UNION ALL SELECT * FROM l))
SELECT k, s FROM r WHERE n = 1 AND kind <> 'CEASE'""")
def snapshot_plus_events(spark, d):
    e = table(spark, d, "events", "user_id", "event_type", "ts")
    kind = F.when(F.col("event_type") == "error", "CEASE").when(F.col("event_type") == "click", "APPOINT").otherwise(F.col("event_type"))
    e = e.select((F.col("user_id") % 20).alias("k"), F.col("user_id").alias("s"), kind.alias("kind"), F.to_date("ts").alias("d"))
    return ledger.snapshot_plus_events(e.where("kind = 'signup'").distinct(), e.where("kind in ('CEASE', 'APPOINT')").distinct(), "k", "s", "d", "kind", [F.asc("kind")])


@query("""
WITH x AS (SELECT user_id, ts::DATE AS day FROM events GROUP BY ALL HAVING count(DISTINCT event_type) > 1)
SELECT event_id, user_id, ts::DATE AS day, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = e.user_id AND x.day = e.ts::DATE)""")
def same_day_conflict_suppress(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").select("event_id", "user_id", F.to_date("ts").alias("day"), "event_type")
    return ledger.without_conflicts(e, ["user_id", "day"], F.col("event_type"))


@query("""
WITH n AS (SELECT source, lang, count(*) AS n, max(doc_id) AS o FROM documents WHERE lang <> '' GROUP BY 1, 2),
m AS (SELECT source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, o DESC, lang DESC) AS r FROM n) WHERE r = 1)
SELECT doc_id, d.source, d.lang, coalesce(d.lang = m.lang, true) AS ok FROM documents d LEFT JOIN m ON d.source = m.source""")
def quarantine_mismatch(spark, d):
    return ledger.quarantine(table(spark, d, "documents", "doc_id", "source", "lang"), "source", "lang", F.col("doc_id")).select("doc_id", "source", "lang", "ok")


@query("""
SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY h ORDER BY n_chars DESC, doc_id) > 1 THEN 'DUPLICATE' ELSE 'VALID' END AS status
FROM (SELECT *, sha256(text) AS h FROM documents)""")
def content_hash_status(spark, d):
    t = table(spark, d, "documents", "doc_id", "lang", "n_chars", "text").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"), F.lit("VALID").alias("status"))
    return ledger.keep_best(t, ["h"], [F.desc("n_chars"), F.asc("doc_id")]).drop("h", "n_chars")


@query("""
SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)', 1)) AS found FROM documents""")
def extract_key_values(spark, d):
    t = table(spark, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.explode(extract.key_values(F.col("text"), "([A-Za-z0-9._-]+@[A-Za-z0-9.-]+)")).alias("found"))


@query("""
SELECT conv_id, turn, pos, block FROM (SELECT conv_id, turn, unnest(range(1, len(p))) AS pos, unnest(p[2:]) AS block FROM (SELECT conv_id, turn, string_split(coalesce(text, ''), '. ') AS p FROM conversations))""")
def split_to_rows(spark, d):
    out = extract.blocks(table(spark, d, "conversations", "conv_id", "turn", "text"), "text", r"\. ")
    return out.withColumn("pos", F.col("pos").cast("long"))


@query("""
SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS title, nullif(regexp_extract(html, 'lang="([a-z]+)"', 1), '') AS lang,
    CASE WHEN regexp_matches(html, 'casino|bets') THEN 'GAMES' WHEN regexp_matches(html, 'pills') THEN 'PILLS' ELSE 'OTHER' END AS kind FROM pages""")
def classify_and_label(spark, d):
    p = table(spark, d, "pages", "page_id", "html")
    title = F.nullif(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit(""))
    lang = F.nullif(F.regexp_extract("html", 'lang="([a-z]+)"', 1), F.lit(""))
    return p.select("page_id", title.alias("title"), lang.alias("lang"), extract.first_rule(F.col("html"), {"GAMES": "casino|bets", "PILLS": "pills"}, "OTHER").alias("kind"))


@query("""
SELECT event_id, (props->>'k')::INT AS k, '{"event_id":' || event_id || ',"k":' || coalesce(props->>'k', 'null') || ',"note":null}' AS json FROM events""")
def json_payload_round_trip(spark, d):
    e = table(spark, d, "events", "event_id", "props").select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", "p.k", F.lit(None).cast("string").alias("note"))
    return e.select("event_id", "k", F.to_json(F.struct("event_id", "k", "note"), {"ignoreNullFields": "false"}).alias("json"))


@query("""
WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY score DESC, vec_id LIMIT 5""")
def vector_topk_threshold(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    question = e.orderBy("vec_id").limit(1).first()["embedding"]
    return vectors.top_k(e, "embedding", question, 5, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query("""
SELECT code, count(*) AS n FROM (
    SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'SHORT' END, CASE WHEN lang <> 'en' THEN 'FOREIGN' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'NUMBERS' END], lambda x: x IS NOT NULL)) AS code FROM documents)
GROUP BY code ORDER BY n DESC, code""")
def issue_histogram(spark, d):
    t = table(spark, d, "documents", "n_chars", "lang", "text")
    codes = reshape.issues({"SHORT": F.col("n_chars") < 200, "FOREIGN": F.col("lang") != "en", "NUMBERS": F.col("text").rlike("[0-9]{4}")})
    return ledger.histogram(t.select(F.explode(codes).alias("code")), "code").orderBy(F.desc("n"), "code")


@query("""
SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') AS english, CASE WHEN count(*) FILTER (n_chars = 0) = count(*) THEN 'not_found' WHEN count(*) FILTER (lang <> 'en') = 0 THEN 'success' WHEN count(*) FILTER (lang = 'en') = 0 THEN 'error' ELSE 'partial' END AS status
FROM documents GROUP BY source""")
def status_rollup(spark, d):
    t = table(spark, d, "documents", "source", "lang", "n_chars").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("lang") != "en").alias("other"), F.count_if(F.col("n_chars") == 0).alias("empty"))
    status = ledger.rollup(F.col("n"), F.col("english"), F.col("other"), F.col("empty"))
    return t.select("source", "n", "english", status.alias("status"))


@query("""
WITH n AS (SELECT c_custkey, c_name, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 10000000 + n_nationkey, n_name, NULL FROM nation)
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)
UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM n""")
def upsert_snapshot(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    new = c.where("c_custkey % 10 = 0").select("c_custkey", "c_name", F.lit("NEW").alias("c_mktsegment"))
    new = new.union(table(spark, d, "nation", "n_nationkey", "n_name").select(F.lit(10000000).cast("long") + F.col("n_nationkey"), "n_name", F.lit(None).cast("string")))
    return reshape.upsert(c, new, "c_custkey")


@query("""
WITH g AS (SELECT user_id, event_id, ts::DATE AS day, date_diff('day', DATE '2024-01-10', ts::DATE) AS g FROM events)
SELECT user_id, event_id, day FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(g), g < 0, event_id) AS n FROM g) WHERE n = 1""")
def nearest_date_pick(spark, d):
    e = table(spark, d, "events", "user_id", "event_id", "ts").select("user_id", "event_id", F.to_date("ts").alias("day"))
    return nearest(e, ["user_id"], F.col("day"), F.lit("2024-01-10").cast("date"), [F.asc("event_id")])


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) FILTER (event_type <> '') AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value FROM events GROUP BY user_id""")
def last_filled_registry(spark, d):
    return last_filled(table(spark, d, "events", "user_id", "event_id", "ts", "event_type", "value"), "user_id", ["event_type", "value"], [F.col("ts"), F.col("event_id")])


@query("""
WITH l AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'I' || (c_custkey % 400) END AS i, 'N' || (c_custkey % 300) AS m FROM customer),
r AS (SELECT s_suppkey, 'I' || (s_suppkey % 37) AS i, 'N' || (s_suppkey % 53) AS m FROM supplier),
ri AS (SELECT i, min(s_suppkey) AS s FROM r GROUP BY i HAVING count(*) = 1), rm AS (SELECT m, min(s_suppkey) AS s FROM r GROUP BY m HAVING count(*) = 1)
SELECT c_custkey, l.i AS identity, l.m AS name, coalesce(ri.s, rm.s) AS s_suppkey FROM l LEFT JOIN ri ON l.i = ri.i LEFT JOIN rm ON l.m = rm.m""")
def unique_person_match(spark, d):
    c, s = table(spark, d, "customer", "c_custkey"), table(spark, d, "supplier", "s_suppkey")
    own = lambda k, n, p: F.concat(F.lit(p), (F.col(k) % n).cast("string"))
    left = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(own("c_custkey", 400, "I")).alias("identity"), own("c_custkey", 300, "N").alias("name"))
    right = s.select("s_suppkey", own("s_suppkey", 37, "I").alias("identity"), own("s_suppkey", 53, "N").alias("name"))
    return people.match_people(left, right, "c_custkey", "identity", "name", "s_suppkey")


@query("""
WITH p AS (SELECT c_nationkey AS g, 'I' || (c_custkey % 90) AS i, 'N' || (c_custkey % 70) AS m FROM customer)
SELECT g, 'SAME_ID_DIFFERENT_NAME' AS issue, i AS subject FROM p GROUP BY g, i HAVING count(DISTINCT m) > 1
UNION ALL SELECT g, 'SAME_NAME_DIFFERENT_ID', m FROM p GROUP BY g, m HAVING count(DISTINCT i) > 1""")
def roster_conflicts(spark, d):
    p = table(spark, d, "customer", "c_custkey", "c_nationkey")
    p = p.select(F.col("c_nationkey").alias("g"), F.concat(F.lit("I"), (F.col("c_custkey") % 90).cast("string")).alias("i"), F.concat(F.lit("N"), (F.col("c_custkey") % 70).cast("string")).alias("m"))
    return people.roster_conflicts(p, "g", "i", "m")


@query("""
SELECT l_suppkey, l_partkey, sum(q)::BIGINT AS q, string_agg(DISTINCT l_returnflag, ' | ' ORDER BY l_returnflag) AS l_returnflag
FROM (SELECT DISTINCT l_suppkey, l_partkey, floor(l_quantity)::BIGINT AS q, l_returnflag FROM lineitem) GROUP BY 1, 2""")
def share_class_aggregation(spark, d):
    x = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity", "l_returnflag").select("l_suppkey", "l_partkey", F.floor("l_quantity").alias("q"), "l_returnflag")
    return people.holdings(x, ["l_suppkey", "l_partkey"], "q", "l_returnflag")


@query("""
WITH p AS (SELECT l_orderkey AS k, sum(round(l_quantity * 100)::BIGINT)::BIGINT AS summed, min(l_quantity) AS least FROM lineitem GROUP BY 1),
t AS (SELECT o_orderkey AS k, round(o_totalprice)::BIGINT AS total FROM orders WHERE o_orderkey % 9 <> 0)
SELECT * FROM (SELECT coalesce(p.k, t.k) AS k, summed, total, CASE WHEN total IS NULL THEN 'TOTAL_MISSING' WHEN summed IS NULL THEN 'PARTS_MISSING' WHEN least < 0 THEN 'NEGATIVE' WHEN summed <> total THEN 'MISMATCH' END AS issue FROM p FULL JOIN t ON p.k = t.k) WHERE issue IS NOT NULL""")
def share_reconciliation(spark, d):
    p = table(spark, d, "lineitem", "l_orderkey", "l_quantity").select(F.col("l_orderkey").alias("k"), F.round(F.col("l_quantity") * 100).cast("long").alias("q"))
    t = table(spark, d, "orders", "o_orderkey", "o_totalprice").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").cast("long").alias("total"))
    return ledger.reconcile(p, t, "k", "q", "total")


@query("""
SELECT o_orderkey, o_orderdate::DATE + 18 AS lapses, o_orderdate::DATE - 1 AS declared, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS span,
    strftime(o_orderdate, '%-d %B %Y') AS written FROM orders""")
def date_arithmetic(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", V.days_after(day, 18).alias("lapses"), V.days_after(day, -1).alias("declared"), V.days_between(F.lit("1992-01-01").cast("date"), day).alias("span"), V.long_date(day).alias("written"))


@query("""
SELECT c_custkey, (c_acctbal > 0) AS active FROM customer ORDER BY c_name NULLS LAST, c_custkey""")
def active_sorted(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_acctbal")
    return c.orderBy(F.asc_nulls_last("c_name"), "c_custkey").select("c_custkey", (F.col("c_acctbal") > 0).alias("active"))


@query("""
WITH r AS (SELECT DISTINCT l_suppkey AS person, l_orderkey AS company, l_linenumber AS n,
    CASE l_linenumber WHEN 1 THEN 'Director' WHEN 2 THEN 'Shareholder' ELSE 'Role ' || l_linenumber END AS role FROM lineitem)
SELECT person, company, list(role ORDER BY n) AS roles FROM r GROUP BY 1, 2""")
def person_associations(spark, d):
    x = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber").toDF("person", "company", "n")
    role = F.when(F.col("n") == 1, "Director").when(F.col("n") == 2, "Shareholder").otherwise(F.concat(F.lit("Role "), "n"))
    return people.associations(x.withColumn("role", role), ["person", "company"], "n", "role")


@query("""
WITH e AS (SELECT o_custkey::VARCHAR AS "Company No", 'C' || o_custkey AS "Company Name", '' AS "Company Status", o_orderstatus AS "Name", '' AS "Submission No", strftime(o_orderdate, '%d/%m/%Y') AS "Date Received", o_orderkey::VARCHAR AS "Source PDF" FROM orders),
o AS (SELECT "Company No", "Company Name", "Company Status", "Name", "Submission No", "Date Received", min("Source PDF") AS "Source PDF" FROM e GROUP BY ALL)
SELECT 'REG:' || "Company No" AS company, "Name", "Date Received", "Source PDF", row_number() OVER (PARTITION BY "Company No" ORDER BY strptime("Date Received", '%d/%m/%Y') DESC, "Source PDF")::INT AS slot FROM o""")
def consolidated_events(spark, d):
    from karst.records.owners import consolidate

    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    e = o.select(F.col("o_custkey").cast("string").alias("Company No"), F.concat(F.lit("C"), "o_custkey").alias("Company Name"), F.lit("").alias("Company Status"), F.col("o_orderstatus").alias("Name"), F.lit("").alias("Submission No"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date Received"), F.col("o_orderkey").cast("string").alias("Source PDF"))
    return consolidate(e).select("company", "Name", "Date Received", "Source PDF", "slot")


@query("""
WITH e AS (SELECT event_id, user_id % 40 AS company, user_id AS who, ts::DATE AS filed, upper(event_type) AS kind, value FROM events),
g AS (SELECT *, CASE kind WHEN 'SIGNUP' THEN 3 WHEN 'ERROR' THEN 1 ELSE 2 END AS grade FROM e)
SELECT company::VARCHAR AS "Company No", who::VARCHAR AS "IC", event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY company, who ORDER BY filed DESC, grade DESC, round(value, 2) DESC, event_id DESC) AS n FROM g) WHERE n = 1 AND kind <> 'ERROR'""")
def current_owners(spark, d):
    from karst.records.owners import Owners

    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    kind = F.when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "error", "CESSATION").otherwise("OTHER")
    rows = e.select("event_id", (F.col("user_id") % 40).cast("string").alias("Company No"), F.lit("").alias("Company Name"), F.col("user_id").cast("string").alias("IC"), F.lit("X").alias("Name"), F.date_format("ts", "d/M/yyyy").alias("Date Received"), kind.alias("BO Status"), F.format_string("%.2f%%", "value").alias("Voting Shares %"), F.col("event_id").cast("string").alias("PDF Date"))
    return Owners(rows, "event_id").current().select("Company No", "IC", "event_id")


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN lpad(o_orderkey::VARCHAR, 12, '2') || ' (' || lpad(o_custkey::VARCHAR, 6, '1') || '-A)' WHEN 1 THEN lpad(o_custkey::VARCHAR, 6, '1') || '-A' ELSE '' END AS doc,
    lpad(o_orderkey::VARCHAR, 12, '2') AS master FROM orders)
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS state, CASE o_orderkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS n FROM t""")
def registration_states(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    new, old = F.lpad(F.col("o_orderkey").cast("string"), 12, "2"), F.concat(F.lpad(F.col("o_custkey").cast("string"), 6, "1"), F.lit("-A"))
    k = F.col("o_orderkey") % 3
    doc = F.when(k == 0, F.concat(new, F.lit(" ("), old, F.lit(")"))).when(k == 1, old).otherwise("")
    return o.select("o_orderkey", T.registration_state(doc, new).alias("state"), F.size(T.registration_tokens(doc)).alias("n"))


@query(f"""
WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'R' || c_custkey END AS reg FROM customer),
f AS (SELECT {KEY_SQL.format("'Customer ' || o_custkey")} AS k, count(*) AS n FROM orders GROUP BY 1),
a AS (SELECT {KEY_SQL.format('c_name')} AS k, count(*) AS n, min('R' || (c_custkey - c_custkey % 2)) AS r FROM customer WHERE c_custkey % 4 <> 0 GROUP BY 1)
SELECT c_custkey, list_filter([CASE WHEN reg = '' THEN 'missing_registration_no' END, CASE WHEN f.n IS NULL THEN 'fs_not_found' END, CASE WHEN f.n > 1 THEN 'fs_ambiguous' END,
    CASE WHEN a.n IS NULL THEN 'auditor_not_found' END, CASE WHEN a.n > 1 THEN 'auditor_ambiguous' END, CASE WHEN a.n = 1 AND a.r <> reg THEN 'auditor_registration_mismatch' END], lambda x: x IS NOT NULL) AS issues
FROM c LEFT JOIN f ON {KEY_SQL.format("'Customer ' || c_custkey")} = f.k LEFT JOIN a ON {KEY_SQL.format('c_name')} = a.k""")
def company_context_issues(spark, d):
    from karst.records.contexts import company_contexts

    c, o = table(spark, d, "customer", "c_custkey", "c_name"), table(spark, d, "orders", "o_custkey")
    reg = F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.concat(F.lit("R"), "c_custkey"))
    fs = o.select(F.concat(F.lit("Customer "), "o_custkey").alias("Company"))
    auditors = c.where("c_custkey % 4 <> 0").select(F.col("c_name").alias("Company Name"), F.concat(F.lit("R"), F.col("c_custkey") - F.col("c_custkey") % 2).alias("Reg No"))
    left = c.select("c_custkey", F.concat(F.lit("Customer "), "c_custkey").alias("fs_name"), F.col("c_name").alias("Company Name"), reg.alias("Reg No"))
    one = company_contexts(left, {"auditor": (auditors, "Company Name")}).select("c_custkey", "fs_name", F.col("issues").alias("more"))
    two = company_contexts(left.withColumn("Company Name", F.col("fs_name")), {"fs": (fs, "Company")}).select("c_custkey", "issues")
    return one.join(two, "c_custkey").select("c_custkey", F.concat("issues", F.filter("more", lambda x: x != "missing_registration_no")).alias("issues"))


@query("""
SELECT o_orderkey, list_filter([CASE WHEN s > e THEN 'start_after_end' END, CASE WHEN e > b THEN 'end_after_board' END], lambda x: x IS NOT NULL) AS issues
FROM (SELECT o_orderkey, o_orderdate::DATE AS s, o_orderdate::DATE + (o_orderkey % 5 - 1)::INT AS e, o_orderdate::DATE + (o_orderkey % 7 - 1)::INT AS b FROM orders)""")
def date_order_issues(spark, d):
    from karst.records.contexts import date_order

    day = F.to_date("o_orderdate")
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return o.select("o_orderkey", date_order({"start": day, "end": F.date_add(day, (F.col("o_orderkey") % 5 - 1).cast("int")), "board": F.date_add(day, (F.col("o_orderkey") % 7 - 1).cast("int"))}).alias("issues"))


@query("""
SELECT page_id, CASE WHEN regexp_matches(url, '(?i)(approved|approval|lodged|registered|certified|ctc)') THEN 3 ELSE 2 END AS quality,
    regexp_matches(url, '(?i)(?:^|[\\/ _-])(draft|receipt|invoice|authority|confirmation|email|gmail|resolution|dwr|mwr|bill)(?:$|[\\/ _().-])') AND NOT regexp_matches(url, '(?i)(approved|approval|lodged|registered|certified|ctc)') AS excluded
FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '/draft.pdf' WHEN 1 THEN '/draft approved.pdf' WHEN 2 THEN '/drafty.pdf' ELSE '' END AS url FROM pages)""")
def source_quality(spark, d):
    from karst.records import filings

    p = table(spark, d, "pages", "page_id", "url")
    k = F.col("page_id") % 4
    url = F.concat("url", F.when(k == 0, "/draft.pdf").when(k == 1, "/draft approved.pdf").when(k == 2, "/drafty.pdf").otherwise(""))
    return p.select("page_id", filings.quality(url).alias("quality"), filings.excluded(url).alias("excluded"))


@query("""
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, max(o_orderdate)::DATE AS day, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_totalprice > 100000) AS explicit_total
FROM orders GROUP BY o_custkey""")
def latest_explicit_total(spark, d):
    o = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    told = o.select("o_custkey", "o_orderdate", "o_orderkey", F.col("o_orderkey").alias("latest"), F.to_date("o_orderdate").alias("day"), F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).alias("explicit_total"))
    return last_filled(told, "o_custkey", ["latest", "day", "explicit_total"], order)


@query("""
SELECT 'ORDER' AS event, o_orderkey AS k, o_orderdate::DATE AS day, '{"status":"' || o_orderstatus || '","price":null}' AS payload FROM orders
UNION ALL SELECT 'SHIP', l_orderkey, l_shipdate::DATE, '{"line":' || l_linenumber || '}' FROM lineitem""")
def ledger_union(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderstatus")
    x = table(spark, d, "lineitem", "l_orderkey", "l_shipdate", "l_linenumber")
    a = o.select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), F.lit(None).cast("double").alias("price"))
    return ledger.event_log({"ORDER": a, "SHIP": x.select(F.col("l_orderkey").alias("k"), F.col("l_shipdate").alias("day"), F.col("l_linenumber").alias("line"))}, "k", "day")


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], e) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS score FROM embeddings, q),
t AS (SELECT vec_id FROM s WHERE score >= 0.7 ORDER BY score DESC, vec_id LIMIT 5),
o AS (SELECT s.vec_id, score, text FROM s JOIN t USING (vec_id) JOIN documents ON doc_id = s.vec_id)
SELECT left(string_agg(left(text, 1500), chr(10) || chr(10) ORDER BY score DESC, vec_id), 4000) AS context FROM o WHERE trim(text) <> ''""")
def retrieved_context(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    question = e.orderBy("vec_id").limit(1).first()["embedding"]
    top = vectors.top_k(e, "embedding", question, 5, "vec_id", least=0.7).select("vec_id", "score")
    docs = table(spark, d, "documents", "doc_id", "text")
    # Five rows at most: the documents are filtered by a broadcast of them.
    return vectors.context(docs.join(F.broadcast(top), docs.doc_id == top.vec_id), "text", [-F.col("score"), F.col("vec_id")])


@query("""
SELECT c_custkey, 'Y H Tan ' || c_custkey AS raw, 'YH TAN ' || c_custkey AS auditor, 'Mr.' AS title,
    CASE WHEN length((800101010000 + c_custkey)::VARCHAR) = 12 THEN left((800101010000 + c_custkey)::VARCHAR, 6) || '-' || substr((800101010000 + c_custkey)::VARCHAR, 7, 2) || '-' || substr((800101010000 + c_custkey)::VARCHAR, 9, 4) END AS nric,
    'RM' || format('{:,.2f}', round(c_acctbal, 2)) AS money, 'ID:' || (800101010000 + c_custkey) AS person FROM customer""")
def display_values(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_acctbal")
    raw, number = F.concat(F.lit("Y H Tan "), "c_custkey"), (F.lit(800101010000) + F.col("c_custkey")).cast("string")
    return c.select("c_custkey", raw.alias("raw"), T.auditor_key(raw).alias("auditor"), T.honorific(F.lit("male")).alias("title"), T.format_identity_number(number).alias("nric"), V.currency(V.cents(F.col("c_acctbal"))).alias("money"), T.person_key(number, raw).alias("person"))


@query()
def similarity_ratio(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name", "p_type")
    return p.select("p_partkey", F.round(V.similarity(F.lower("p_name"), F.lower("p_type")), 6).alias("ratio"))


@query()
def nfkc_and_wrap(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", V.nfkc(F.col("text")).alias("text"), F.size(V.wrapped(F.col("text"))).alias("n_lines"))


from karst.plans import documents, folders, generation  # noqa: E402, F401  (they register their queries here)
