"""Registered queries over what papers are generated from: people with where their values come from, ready companies, clauses, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from karst.functions import text as T
from karst.functions import values as V
from karst.plans.queries import query, table
from karst.records import clauses, drafts, incorporation


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# k % 13 = 0: no address; k % 11 = 0: the director's number is another; k % 17 = 0: a corporate member; k % 19 = 0: no shares; k % 23 = 0: no day; k % 29 = 0: no directors.
_COMPANIES = """
c AS (SELECT c_custkey AS k, c_name, c_nationkey AS g, k % 23 <> 0 AS dated, k % 29 <> 0 AS led, k % 17 = 0 AS corporate, CASE WHEN k % 19 = 0 THEN 0 ELSE 30 + k % 7 END AS s1, 100 AS s2 FROM (SELECT *, c_custkey AS k FROM customer)),
p AS (
    SELECT k, 'director' AS role, 1 AS slot, 'ALICE ' || k AS name, CASE WHEN k % 11 = 0 THEN 'X' ELSE 'I' END || k AS id, g, c_name, s1, 'record' AS nat, CASE WHEN k % 2 = 0 THEN 'record' ELSE 'counterpart' END AS mail,
        CASE WHEN k % 3 = 0 THEN CASE WHEN k % 11 = 0 THEN NULL WHEN k % 5 = 0 THEN 'primary' ELSE 'owner' END ELSE 'record' END AS work FROM c WHERE led
    UNION ALL SELECT k, 'member', 1, 'ALICE ' || k, 'I' || k, g, c_name, s1, CASE WHEN led THEN 'counterpart' END, 'record', CASE WHEN k % 3 = 0 THEN CASE WHEN k % 5 = 0 THEN 'primary' ELSE 'owner' END WHEN led THEN 'counterpart' WHEN k % 5 = 0 THEN 'primary' ELSE 'owner' END FROM c)"""


def _company_tables(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey")
    k, g = F.col("c_custkey"), F.col("c_nationkey")
    company = k.alias("company")
    companies = c.select(
        company, F.col("c_name").alias("Company Name"), _text("R", k).alias("Reg No"), F.when(k % 23 != 0, "01/02/2020").otherwise("soon").alias("S14 Incorporation Date"), F.when(k % 13 != 0, "1 STREET").otherwise(" ").alias("S14 Registered Address"), F.lit("2 STREET").alias("S14 Business Address"),
    )
    director = c.where(k % 29 != 0).select(
        company, F.lit(1).alias("slot"), _text("Alice ", k).alias("Name"), F.lit("MYKAD").alias("ID Type"), _text(F.when(k % 11 == 0, "X").otherwise("I"), k).alias("ID No"), F.lit("Malaysia").alias("Nationality"), _text("r", g).alias("Race"), F.lit("female").alias("Gender"), F.lit("02/01/1980").alias("DOB"),
        F.lit("3 STREET").alias("Residential Address"), F.when(k % 2 == 0, _text("a", k, "@x.example")).otherwise("NIL").alias("Email"), F.lit("012").alias("Contact No"), F.when(k % 3 != 0, "Trader").alias("Business Occupation"), F.lit(None).cast("string").alias("Address"),
    )
    member = c.select(
        company, F.lit(1).alias("slot"), _text("ALICE  ", k).alias("Name"), F.lit("MYKAD").alias("ID Type"), _text("I-", k).alias("ID No"), F.lit("-").alias("Nationality"), _text("r", g).alias("Race"), F.lit("FEMALE").alias("Gender"), F.lit("1980-01-02").alias("DOB"), F.col("c_name").alias("Address"),
        _text("m", k, "@x.example").alias("Email"), F.lit("013").alias("Contact No"), F.when(k % 19 == 0, "0").otherwise((k % 7 + 30).cast("string")).alias("Shares"), F.lit("ORDINARY").alias("Share Type"), F.lit("INDIVIDUAL").alias("Type"),
    )
    firm = c.where(k % 17 == 0).select(company, F.lit(2).alias("slot"), _text("FIRM ", k).alias("Name"), F.lit("COMPANY REGISTRATION").alias("ID Type"), _text("F", k).alias("ID No"), F.when(k % 19 == 0, "0").otherwise("100").alias("Shares"), F.lit("COMPANY").alias("Type"))
    owner = c.where(k % 5 != 0).select(company, _text("ALICE ", k).alias("Name"), _text("I", k).alias("ID No"), F.lit("Owner").alias("Designation"), F.lit("05/01/2020").alias("Date of Becoming BO"), F.lit("").alias("Date of Cessation"), F.lit("N/A").alias("Criteria C"))
    late = c.where(k % 5 == 0).select(company, _text("ALICE ", k).alias("Name"), _text("I", k).alias("ID No"), F.lit("Late").alias("Designation"), F.lit("05/03/2020").alias("Date of Becoming BO"), F.lit("").alias("Date of Cessation"), F.lit("").alias("Criteria C"))
    primary = c.select(company, _text("ALICE ", k).alias("Name"), _text("I", k).alias("ID No"), F.lit("Clerk").alias("Designation"))
    return companies, director, member.unionByName(firm, allowMissingColumns=True), owner.unionByName(late), [primary]


@query(f"""WITH {_COMPANIES},
i AS (
    SELECT k, 'missing_company_data' AS code, 'S14 Registered Address' AS subject FROM c WHERE k % 13 = 0 UNION ALL SELECT k, 'missing_company_data', 'S14 Incorporation Date' FROM c WHERE NOT dated
    UNION ALL SELECT k, 'missing_directors', NULL FROM c WHERE dated AND NOT led UNION ALL SELECT k, 'conflicting_person_data', 'both ALICE' || k FROM c WHERE dated AND led AND k % 11 = 0
    UNION ALL SELECT k, 'unsupported_corporate_member', 'FIRM ' || k FROM c WHERE dated AND corporate UNION ALL SELECT k, 'invalid_total_shares', NULL FROM c WHERE dated AND k % 19 = 0
    UNION ALL SELECT k, 'missing_person_data', 'member 1: Nationality' FROM c WHERE dated AND NOT led)
SELECT c.k AS company, (SELECT string_agg(code || coalesce('=' || subject, ''), '; ' ORDER BY code, subject NULLS FIRST) FROM i WHERE i.k = c.k) AS issues, NOT EXISTS (SELECT 1 FROM i WHERE i.k = c.k) AS ready FROM c""")
def company_readiness(spark, d):
    told, _ = incorporation.prepare(*_company_tables(spark, d))
    said = F.transform("issues", lambda i: F.concat(i["code"], F.coalesce(F.concat(F.lit("="), i["subject"]), F.lit(""))))
    return told.select("company", F.nullif(F.array_join(said, "; "), F.lit("")).alias("issues"), "ready")


@query(f"""WITH {_COMPANIES}
SELECT p.k AS company, role, slot, p.name AS called, id AS id_number, 'MALAYSIAN' AS nationality, nat AS nationality_from, CASE mail WHEN 'record' THEN CASE role WHEN 'director' THEN 'a' ELSE 'm' END ELSE 'm' END || p.k || '@x.example' AS email, mail AS email_from,
    CASE work WHEN 'owner' THEN 'OWNER' WHEN 'primary' THEN 'CLERK' ELSE 'TRADER' END AS occupation, work AS occupation_from, CASE role WHEN 'member' THEN 100.0 END::DOUBLE AS percentage, role = 'member' AS beneficial_owner, CASE WHEN p.k % 5 <> 0 THEN DATE '2020-01-05' WHEN role = 'member' THEN DATE '2020-02-01' END AS becoming
FROM p JOIN c USING (k) WHERE dated AND led AND k % 13 <> 0 AND k % 11 <> 0 AND NOT corporate AND k % 19 <> 0""")
def company_people(spark, d):
    _, people = incorporation.prepare(*_company_tables(spark, d))
    both = lambda n: [F.col(f"{n}.value").alias(n), F.col(f"{n}.source").alias(f"{n}_from")]
    return people.select("company", "role", "slot", F.upper("name.value").alias("called"), F.regexp_replace("id_number.value", "-", "").alias("id_number"), *both("nationality"), *both("email"), *both("occupation"), F.col("percentage").cast("double").alias("percentage"), "beneficial_owner", "becoming")


@query("""
SELECT p_partkey AS k, CASE p_partkey % 10 WHEN 0 THEN 'section_90' WHEN 1 THEN 'section_90' WHEN 2 THEN 'section_90' WHEN 3 THEN 'paragraph_15' WHEN 4 THEN 'paragraph_15' WHEN 5 THEN 'paragraph_15' WHEN 6 THEN 'section_90' WHEN 7 THEN 'standard' ELSE 'standard' END AS family,
    CASE p_partkey % 10 WHEN 8 THEN 'THE COMPANIES ACT 2016''S WORDS, BY ' || p_name WHEN 9 THEN '' END AS printed FROM part""")
def clause_families(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_name")
    k, name = F.col("p_partkey") % 10, F.col("p_name")
    clause = F.when(k == 0, _text("Regulation  90 of Table “A”; Articles of Association of ", name)).when(k == 1, _text("article 3(d), Articles-of-Association, ", name)).when(k == 2, _text("Clause ５３ of the Constitution ", name)).when(k == 3, "Paragraph 15, Third Schedule & more")
    # The sixth fits two families and takes the first; the seventh has a number that only begins as one does.
    clause = clause.when(k == 4, _text("Article 23B; article 23 b of the constitution ", name)).when(k == 5, "REGULATION 34 (CONSTITUTION)").when(k == 6, "Paragraph 15 of the Third Schedule, and Clause 53 of the Constitution").when(k == 7, "Clause 531 of the Constitution; Article 340")
    clause = clause.when(k == 8, _text("THE COMPANY’S  ACT 2016â€™S WORDS, BY ", name)).otherwise(" ")
    return p.select(F.col("p_partkey").alias("k"), clauses.family(clause).alias("family"), F.when(k >= 8, clauses.clause(clause)).alias("printed"))


@query("""
WITH w AS (SELECT c_custkey AS k, list_filter(string_split(trim(c_name || CASE WHEN c_custkey % 4 > 0 THEN ' JALAN ' || c_mktsegment ELSE '' END || CASE WHEN c_custkey % 4 > 1 THEN ' TAMAN UTAMA' ELSE '' END || CASE WHEN c_custkey % 4 > 2 THEN ' BANDAR BARU 50000 KUALA LUMPUR WILAYAH PERSEKUTUAN' ELSE '' END), ' '), lambda x: x <> '') AS w FROM customer),
x AS (SELECT k, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w),
y AS (SELECT k, i, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i + 1:], ' ') AS b FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY greatest(length(a), length(b)), abs(length(a) - length(b)), i) AS n FROM y)
SELECT k, a AS first, b AS second, greatest(length(a), length(b)) > 44 AS compact FROM z WHERE n = 1""")
def balanced_addresses(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    n = F.col("c_custkey") % 4
    address = F.concat("c_name", F.when(n > 0, _text("  JALAN ", F.col("c_mktsegment"))).otherwise(""), F.when(n > 1, " TAMAN UTAMA").otherwise(""), F.when(n > 2, " BANDAR BARU 50000 KUALA LUMPUR WILAYAH PERSEKUTUAN ").otherwise(""))
    return c.select(F.col("c_custkey").alias("k"), V.balanced_lines(address).alias("l")).select("k", "l.first", "l.second", "l.compact")


@query("""
SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'TOLD' WHEN 1 THEN 'NON-CITIZENS' WHEN 2 THEN 'CITIZENS WHO ARE MALAYS AND NATIVES' WHEN 3 THEN 'CITIZENS WHO ARE NON - MALAYS AND NON- NATIVES' ELSE '' END AS analysis, CASE c_custkey % 5 WHEN 1 THEN 'CHINA' WHEN 4 THEN '' ELSE 'MALAYSIAN' END AS nationality,
    ['B', 'P', 'R', 'Z', ''][c_custkey % 5 + 1] AS paper, left(lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') || ' ' || replace(c_name, '#', ' ') || ' x', 31) AS sheet FROM customer""")
def member_analyses(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name")
    k = F.col("c_custkey") % 5
    nation = F.when(k == 1, "China").when(k == 4, "").when(k == 3, " malaysian ").otherwise("Malaysia")
    race = F.when(k == 2, "Malay").when(k == 3, "Indian").when(k == 0, "Malay").otherwise("")
    paper = F.when(k == 0, "My-Kad").when(k == 1, "passport").when(k == 2, "RED IC").when(k == 3, "Military ID").otherwise("driving licence")
    rows = c.select(F.col("c_custkey").alias("k"), T.member_analysis(F.when(k == 0, "TOLD"), F.trim(nation), race).alias("analysis"), T.nationality_adjective(nation).alias("nationality"), T.paper_code(paper).alias("paper"), _text(F.regexp_replace("c_name", "#", "/"), " * x").alias("folder"))
    return drafts.sheet_names(rows, "k", "folder").drop("folder")
