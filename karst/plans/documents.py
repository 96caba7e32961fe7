"""Registered queries over filing texts: texts are written from the rows of a table, read by the library, and must give those rows back."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from karst.functions import text as T
from karst.plans.queries import dealt, query, table
from karst.records import filings, layout, owners, parse, rosters, state


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _of(label: str, value: Column | str) -> Column:
    return F.concat(F.lit(label), F.lit(value) if isinstance(value, str) else value)


def _number(c: str, head: str = "80") -> Column:
    """Twelve digits."""
    return F.concat(F.lit(head), F.lpad(F.col(c).cast("string"), 10, "0"))


_NUMBER = "'{1}' || lpad({0}::VARCHAR, 10, '0')"


def _forms(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_acctbal")
    owner = lambda name, status, number, share: _lines(
        "PARTICULARS OF BENEFICIAL OWNERSHIP", _of("STATUS ", status), "DATE OF BECOMING BO 05/03/2024", "TYPE INDIVIDUAL", "CATEGORY  OTHER", _of("NAME ", name), _of("IDENTIFICATION NO. ", number), "GENDER FEMALE", "NATIONALITY MALAYSIA",
        "RESIDENTIAL ADDRESS 1 STREET", "TOWN", "BUSINESS ADDRESS 2 STREET", "EMAIL a@example.com", _of("Criteria A - Direct Ownership: ", share),
    )
    n = F.col("c_custkey").cast("string")
    text = _lines(
        "Division 8A, 60B (3), Companies Act 2016", _of("Submission Number S", n), "Date & Time Received 06/03/2024 10:15:00", _of("COMPANY NAME ", F.col("c_name")), _of("COMPANY NO ", n), "STATUS EXISTING",
        owner(F.concat(F.lit("ALICE  "), n), "NEW", _number("c_custkey"), F.col("c_nationkey").cast("string")), owner(F.concat(F.lit("BOB "), n), "CESSATION", _number("c_custkey", "70"), "40"),
        "DECLARATION", _of("NAME CAROL ", n), "DATE OF APPLICATION 07/03/2024", "ATTENTION", "LODGER INFORMATION", "NAME DAVE", _of("IDENTIFICATION NO. ", _number("c_custkey", "60")), "EMAIL ADDRESS d@example.com", "SURUHANJAYA",
    )
    return c.select(F.concat(F.lit("forms/"), n, F.lit(".pdf")).alias("path"), F.when(F.col("c_custkey") % 10 == 9, F.lit("another paper")).otherwise(text).alias("text"))


@query(f"""
WITH c AS (SELECT c_custkey AS k, c_name, c_nationkey AS s FROM customer WHERE c_custkey % 10 <> 9)
SELECT k || '.pdf' AS "Source PDF", 'S' || k AS "Submission No", c_name AS "Company Name", k::VARCHAR AS "Company No", 'EXISTING' AS "Company Status", '06/03/2024' AS "Date Received", w.status AS "BO Status", w.name || ' ' || k AS "Name",
    w.head || lpad(k::VARCHAR, 10, '0') AS "IC", '1 STREET TOWN' AS "Residential Address", '2 STREET' AS "Business Address", w.share AS "Criteria A - Direct Ownership %", 'CAROL ' || k AS "Declaration Name", '07/03/2024' AS "Date of Application", {_NUMBER.format('k', '60')} AS "Lodger IC"
FROM c, (SELECT unnest([{{'status': 'NEW', 'name': 'ALICE', 'head': '80', 'share': NULL}}, {{'status': 'CESSATION', 'name': 'BOB', 'head': '70', 'share': '40'}}], recursive := true)) w(status, name, head, share_)
, LATERAL (SELECT coalesce(w.share_, c.s::VARCHAR) AS share) x""".replace("w.share AS", "x.share AS"))
def owner_forms(spark, d):
    rows = owners.parse_forms(_forms(spark, d))
    return rows.select("Source PDF", "Submission No", "Company Name", "Company No", "Company Status", "Date Received", "BO Status", "Name", "IC", "Residential Address", "Business Address", "`Criteria A - Direct Ownership %`", "Declaration Name", "Date of Application", "Lodger IC")


def _papers(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    k, n = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string")
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    head = F.when(k == 0, "SECTION 51 REGISTER OF MEMBERS").when(k == 1, "SECTION 78 RETURN OF ALLOTMENT").when(k == 2, "SECTION 58 NOTIFICATION OF CHANGE").when(k == 3, "ANNUAL RETURN AR1").when(k == 4, "APPLICATION FOR REGISTRATION OF A COMPANY").when(k == 5, "FORM 49 DIRECTOR").when(k == 6, "a letter").otherwise("  ")
    dated = F.when(F.col("o_orderkey") % 3 == 0, _of("Submission Date: ", day)).when(F.col("o_orderkey") % 3 == 1, _of("ref ROM", F.date_format("o_orderdate", "ddMMyyyy"))).otherwise("")
    text = F.when(k == 7, "  ").otherwise(_lines(head, dated, _of("Lodging Reference No: L-", n), _of("Registration No: ", _number("o_custkey", "20"))))
    name = F.concat(F.lit("F"), (F.col("o_custkey") % 50).cast("string"), F.lit("/"), n, F.when(F.col("o_orderkey") % 11 == 0, " draft ").when(F.col("o_orderkey") % 11 == 1, " draft approved ").otherwise(" "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".pdf"))
    return o.select(F.concat(F.lit("F"), (F.col("o_custkey") % 50).cast("string")).alias("folder"), name.alias("path"), F.sha2(text, 256).alias("sha256"), text.alias("text"), "o_orderkey")


@query(f"""
WITH o AS (SELECT *, o_orderkey % 8 AS k, o_orderdate::DATE AS day FROM orders)
SELECT 'F' || (o_custkey % 50) AS folder, o_orderkey || CASE o_orderkey % 11 WHEN 0 THEN ' draft ' WHEN 1 THEN ' draft approved ' ELSE ' ' END || strftime(day, '%Y-%m-%d') || '.pdf' AS file,
    CASE k WHEN 0 THEN 'S51' WHEN 1 THEN 'S78' WHEN 2 THEN 'S58' WHEN 3 THEN 'S68' WHEN 4 THEN 'S14' WHEN 5 THEN 'FORM49' ELSE 'OTHER' END AS section,
    CASE WHEN o_orderkey % 11 = 0 THEN 'EXCLUDED' WHEN k = 7 THEN 'UNREADABLE' WHEN k = 6 THEN 'OTHER' ELSE 'VALID' END AS status, CASE WHEN o_orderkey % 11 = 1 THEN 3 ELSE 2 END AS quality,
    CASE WHEN k = 7 THEN '' ELSE 'L-' || o_orderkey END AS reference, CASE WHEN k = 7 THEN NULL ELSE {_NUMBER.format('o_custkey', '20')} END AS registration, day AS lodged,
    CASE WHEN k = 7 OR o_orderkey % 3 = 2 THEN 'FILENAME' WHEN o_orderkey % 3 = 0 THEN 'DOCUMENT' ELSE 'REFERENCE' END AS lodged_from FROM o""")
def filing_records(spark, d):
    rows = filings.read(_papers(spark, d))
    return rows.select("folder", F.element_at(F.split("path", "/"), -1).alias("file"), "section", "status", "quality", "reference", F.get("registrations", F.lit(0)).alias("registration"), "lodged", "lodged_from")


@query("""
WITH e AS (SELECT event_id AS k, 'F' || (user_id % 30) AS folder, event_id // 3 AS copy, ts::DATE AS lodged, user_id % 30 * 10 + (CASE WHEN event_id % 17 = 0 THEN 1 ELSE 0 END) AS number FROM events),
s AS (SELECT *, row_number() OVER (PARTITION BY folder, copy ORDER BY lodged DESC, 'p' || k DESC) AS n FROM e),
v AS (SELECT folder, number, count(*) AS c, max(lodged) AS d FROM s WHERE n = 1 GROUP BY 1, 2),
m AS (SELECT folder, arg_max(number, (c, d, number::VARCHAR)) AS own FROM v GROUP BY 1)
SELECT folder, 'p' || k AS path, CASE WHEN n > 1 THEN 'DUPLICATE' WHEN number <> own THEN 'REG_MISMATCH' ELSE 'VALID' END AS status FROM s JOIN m USING (folder)""")
def canonical_filings(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts")
    number = (F.col("user_id") % 30 * 10 + F.when(F.col("event_id") % 17 == 0, 1).otherwise(0)).cast("string")
    rows = e.select(
        F.concat(F.lit("F"), (F.col("user_id") % 30).cast("string")).alias("folder"), F.concat(F.lit("p"), "event_id").alias("path"), F.concat(F.lit("h"), F.floor(F.col("event_id") / 3)).alias("sha256"), F.lit("S68").alias("section"),
        F.lit("VALID").alias("status"), F.lit(2).alias("quality"), F.array(number).alias("registrations"), F.lit("").alias("reference"), F.to_date("ts").alias("lodged"),
    )
    return filings.canonicalise(rows).select("folder", "path", "status")


@query(f"""
SELECT 'p' || c_custkey AS path, w.event, w.name || ' ' || c_custkey AS "Name", w.head || lpad(c_custkey::VARCHAR, 10, '0') AS "IC", w.day::DATE AS event_date
FROM customer, (VALUES ('APPOINT', 'ALICE', '80', '2024-03-05'), ('CEASE', 'BOB', '70', '2024-04-06')) w(event, name, head, day)""")
def officer_events(spark, d):
    c = table(spark, d, "customer", "c_custkey")
    n = F.col("c_custkey").cast("string")
    text = _lines(
        "SECTION 58", "DIRECTORS", "ADD DIRECTOR", _of("Name ALICE ", n), _of("Identification No. ", _number("c_custkey")), "Gender FEMALE", "Date of Appointment 05/03/2024", "CEASE DIRECTOR", _of("Name BOB  ", n), _of("Identification No. ", _number("c_custkey", "70")),
        "Date of Cessation 06/04/2024", "Type of Cessation RESIGNED", "LODGER INFORMATION", "Name DAVE",
    )
    rows = c.select(F.lit("F").alias("folder"), F.concat(F.lit("p"), n).alias("path"), F.lit("S58").alias("section"), F.lit("2024-05-01").cast("date").alias("lodged"), text.alias("text"))
    return filings.officer_events(rows).select("path", "event", "Name", "IC", "event_date")


@query(f"""
SELECT 'p' || c_custkey AS path, 'ALICE ' || c_custkey AS name, {_NUMBER.format('c_custkey', '80')} AS ic, '1 STREET TOWN' AS residential, 'CAROL ' || c_custkey AS member, (c_custkey * 1000)::BIGINT AS shares,
    c_name AS company, '9 ROAD CITY' AS registered_address, '8 ROAD' AS business_address, (c_custkey * 1000)::BIGINT AS total FROM customer""")
def section14_forms(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name")
    n = F.col("c_custkey").cast("string")
    many = F.format_number(F.col("c_custkey") * 1000, 0)
    text = _lines(
        _of("Proposed name: ", F.col("c_name")), _of("Registration No.: ", _number("c_custkey", "20")), "Registered Address: 9 ROAD", "CITY", "Email: x@example.com", "Business Address: 8 ROAD", "Office No: 1", _of("Total number of shares: ", many), "PARTICULARS OF DIRECTOR", _of("Director Name: ALICE ", n),
        _of("Identification No.: ", _number("c_custkey")), "Nationality: MALAYSIA", "Address: 1 STREET", "TOWN", "Date of birth: 01/01/1980", "PARTICULARS OF MEMBER", _of("Member Name: CAROL ", n), "ID Type: MYKAD", _of("Number of share: ", many), "Class of share: ORDINARY", "DECLARATION",
    )
    files = c.select(F.concat(F.lit("p"), n).alias("path"), text.alias("text"))
    a = parse.people_s14(files, parse.DIRECTORS_S14).select("path", F.col("Name").alias("name"), F.col("IC").alias("ic"), F.col("Residential").alias("residential"))
    b = parse.people_s14(files, parse.MEMBERS_S14).select("path", F.col("Name").alias("member"), parse.parse_integer(F.col("Shares")).alias("shares"))
    e = parse.company_s14(files).select("path", F.col("Name").alias("company"), F.col("Registered Address").alias("registered_address"), F.col("Business Address").alias("business_address"))
    total = files.select("path", parse.parse_integer(parse.value(F.col("text"), "total_shares_s14")).alias("total"))
    return a.join(b, "path").join(e, "path").join(total, "path")


@query(f"""
SELECT 'p' || c_custkey AS path, n.no AS row, CASE n.no WHEN 0 THEN 'ALICE ' || chr((65 + c_custkey % 26)::INT) ELSE 'TEST BETA SDN BHD' END AS name, CASE n.no WHEN 0 THEN {_NUMBER.format('c_custkey', '80')} ELSE 'C' || (100000 + c_custkey) END AS id_no,
    CASE n.no WHEN 0 THEN '1 STREET TOWN' ELSE '2 STREET' END AS address, CASE n.no WHEN 0 THEN c_custkey ELSE c_custkey * 7 END::BIGINT AS shares, CASE n.no WHEN 0 THEN 'INDIVIDUAL' ELSE 'COMPANY' END AS type, CASE n.no WHEN 0 THEN 'MYKAD' ELSE 'REGISTRATION NO' END AS id_type
FROM customer, (VALUES (0), (1)) n(no)""")
def allotment_rows(spark, d):
    c = table(spark, d, "customer", "c_custkey")
    n = F.col("c_custkey")
    person = F.format_string("1 ALICE %s %s 1 STREET TOWN CASH %s", F.char(65 + n % 26), F.regexp_replace(_number("c_custkey"), r"^(\d{6})(\d{2})", "$1-$2-"), F.format_number(n, 0))
    firm = F.concat(F.lit("2 TEST BETA SDN BHD C"), (n + 100000).cast("string"), F.lit(" 2 STREET OTHERWISE "), F.format_number(n * 7, 0))
    files = c.select(F.concat(F.lit("p"), n).alias("path"), _lines("PARTICULAR OF ALLOTTEES", "NO ALLOTTEE NAME IDENTIFICATION NO OF SHARE", person, firm, "DECLARATION").alias("text"))
    rows = parse.allotments(files)
    return rows.select("path", F.col("pos").alias("row"), F.col("Name").alias("name"), F.col("`ID No`").alias("id_no"), F.col("Address").alias("address"), F.col("Shares").alias("shares"), F.col("Type").alias("type"), F.col("`ID Type`").alias("id_type"))


@query(f"""
SELECT 'p' || c_custkey AS path, CASE n.no WHEN 1 THEN {_NUMBER.format('c_custkey', '80')} ELSE 'C' || (100000 + c_custkey) END AS ic, CASE n.no WHEN 1 THEN 'ALICE TAN' ELSE 'TEST BETA SDN. BHD.' END AS name, CASE n.no WHEN 1 THEN 'NO. 1 JALAN UTAMA 50000 TOWN MALAYSIA' ELSE '2 STREET TOWN SINGAPORE' END AS address,
    CASE n.no WHEN 1 THEN c_custkey * 3 ELSE c_custkey END::BIGINT AS shares, 10::BIGINT AS moved_in, 20::BIGINT AS moved_out, CASE n.no WHEN 1 THEN '05/03/2024' ELSE '' END AS day, CASE n.no WHEN 1 THEN 'MALAYSIA' ELSE '' END AS nationality, CASE n.no WHEN 1 THEN 'INDIVIDUAL' ELSE 'COMPANY' END AS type
FROM customer, (VALUES (1), (2)) n(no)""")
def register_of_members(spark, d):
    c = dealt(table(spark, d, "customer", "c_custkey"), "c_custkey")
    n = F.col("c_custkey")
    text = _lines(
        "PARTICULAR OF SHAREHOLDERS", "NAME ADDRESS", "NUMBER OF SHARES", _number("c_custkey"), "ALICE TAN", "NO. 1 JALAN UTAMA", "50000 TOWN MALAYSIA", F.concat(F.lit("0 10 20 "), F.format_number(n * 3, 0), F.lit(" 05/03/2024")),
        F.concat(F.lit("C"), (n + 100000).cast("string"), F.lit(" TEST BETA")), "SDN. BHD. 2 STREET", "TOWN SINGAPORE", F.concat(F.lit("0 10 20 "), F.format_number(n, 0)), "ANALYSIS OF SHAREHOLDINGS",
    )
    rows = rosters.members_s51(c.select(F.concat(F.lit("p"), n).alias("path"), text.alias("text")))
    return rows.select("path", F.col("IC").alias("ic"), F.col("Name").alias("name"), F.col("Address").alias("address"), F.col("Shares").alias("shares"), F.col("Transferred In").alias("moved_in"), F.col("Transferred Out").alias("moved_out"), F.col("Date").alias("day"), F.col("Nationality").alias("nationality"), F.col("Type").alias("type"))


@query(f"""
SELECT 'p' || c_custkey AS path, n.who || ' ' || chr((65 + c_custkey % 26)::INT) AS name, CASE WHEN c_custkey % 2 = 0 THEN n.head || lpad(c_custkey::VARCHAR, 10, '0') ELSE '80' || lpad(c_custkey::VARCHAR, 10, '0') END AS ic, 'CHINESE' AS race, 'FEMALE' AS gender, '1980-01-02' AS dob,
    '1 STREET TOWN MALAYSIA' AS residential, CASE WHEN c_custkey % 2 = 1 THEN '' WHEN n.who = 'ALICE' THEN '2 STREET MALAYSIA' ELSE 'b@example.com' END AS service
FROM customer, (VALUES ('ALICE', '80'), ('BOB', '70')) n(who, head) WHERE c_custkey % 2 = 0 OR n.who = 'ALICE'""")
def return_directors(spark, d):
    c = dealt(table(spark, d, "customer", "c_custkey"), "c_custkey")
    letter = F.char(65 + F.col("c_custkey") % 26)
    row = lambda no, name, head, tail: F.concat(F.lit(f"{no} {name} "), letter, F.lit(" DIRECTOR MYKAD "), _number("c_custkey", head), F.lit(f" MALAYSIA CHINESE FEMALE 1980-01-02 1 STREET TOWN MALAYSIA {tail}"))
    table_ = _lines("Particulars of Directors", row("0001", "ALICE", "80", "2 STREET MALAYSIA COMPANY DIRECTOR"), row("0002", "BOB", "70", "b@exam ple.com BUSINESSMAN"), "Particulars of Managers")
    files = c.select(F.concat(F.lit("p"), "c_custkey").alias("path"), F.when(F.col("c_custkey") % 2 == 0, table_).otherwise(row("0003", "ALICE", "80", "x")).alias("text"))
    rows = rosters.directors_s68(files)
    return rows.select("path", F.col("Name").alias("name"), F.col("IC").alias("ic"), F.col("Race").alias("race"), F.col("Gender").alias("gender"), F.col("DOB").alias("dob"), F.col("Residential").alias("residential"), F.col("`Service Address`").alias("service"))


@query(f"""
SELECT 'p' || c_custkey AS path, 'INDIVIDUAL' AS type, n.who AS name, 'MYKAD' AS id_type, n.head || lpad(c_custkey::VARCHAR, 10, '0') AS id_no, 'MALAYSIA' AS nationality, 'INDIAN' AS race, 'MALE' AS gender, '02/01/1980' AS dob, '1 STREET TOWN MALAYSIA' AS address,
    (1000 + c_custkey)::BIGINT AS shares, 'ORDINARY SHARES' AS share_type, 'CITIZENS' AS analysis FROM customer, (VALUES ('ALICE TAN', '80'), ('BOB LEE', '70')) n(who, head)""")
def return_members(spark, d):
    c = dealt(table(spark, d, "customer", "c_custkey"), "c_custkey")
    digits = F.regexp_replace((F.col("c_custkey") + 1000).cast("string"), r"(\d)(?=\d)", "$1 ")  # as page texts have them
    row = lambda no, name, head: F.concat(F.lit(f"{no} {no} INDIVIDUAL {name} MYKAD "), _number("c_custkey", head), F.lit(" MALAYSIA INDIAN MALE 02/01/1980 1 STREET TOWN MALAYSIA "), digits, F.lit(" ORDINARY SHARES CITIZENS"))
    text = _lines("SECTION E", "heads", row("0001", "ALICE TAN", "80"), row("0002", "BOB LEE", "70"), "0003 0003 INDIVIDUAL without a date of birth here", "TOTAL NUMBER OF SHARES 5", "SECTION F")
    rows = rosters.members_s68(c.select(F.concat(F.lit("p"), "c_custkey").alias("path"), text.alias("text")))
    names = {"Type": "type", "Name": "name", "ID Type": "id_type", "ID No": "id_no", "Nationality": "nationality", "Race": "race", "Gender": "gender", "DOB": "dob", "Address": "address", "Shares": "shares", "Share Type": "share_type", "Analysis": "analysis"}
    return rows.select("path", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


@query(f"""
SELECT 'p' || c_custkey AS path, 'ALICE ' || chr((65 + c_custkey % 26)::INT) AS name, {_NUMBER.format('c_custkey', '80')} AS ic, '05/03/2024' AS appointed, '1 STREET TOWN' AS residential, 'BOB' AS ceased, {_NUMBER.format('c_custkey', '70')} AS ceased_ic FROM customer""")
def notified_directors(spark, d):
    c = table(spark, d, "customer", "c_custkey")
    text = _lines(
        "SECTION B : NEW DIRECTOR", F.concat(F.lit("Name ALICE "), F.char(65 + F.col("c_custkey") % 26)), _of("Identification Number ", _number("c_custkey")), "Date Of Appointment 05/03/2024", "Residential Address 1 STREET", "TOWN", "Service Address 2 STREET",
        "SECTION C : CESSATION OF DIRECTOR", "Name BOB", _of("Identification Number ", _number("c_custkey", "70")), "Date of Cessation 06/04/2024", "Cessation Reason RESIGNED", "PARTICULARS OF LODGER",
    )
    files = c.select(F.concat(F.lit("p"), "c_custkey").alias("path"), text.alias("text"))
    new = rosters.new_directors_s58(files).select("path", F.col("Name").alias("name"), F.col("IC").alias("ic"), F.col("`Appointment Date`").alias("appointed"), F.col("Residential").alias("residential"))
    return new.join(parse.cessations(files).select("path", F.col("Name").alias("ceased"), F.col("IC").alias("ceased_ic")), "path")


@query("""
WITH o AS (SELECT o_orderkey AS k, o_custkey, o_orderdate::DATE AS d, o_totalprice FROM orders),
f AS (SELECT *, 'C' || o_custkey AS company, (k % 2 = 0) AS explicit, CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS completeness FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY d DESC, explicit DESC, completeness DESC, 'p' || k) AS n FROM f)
SELECT company, 'p' || k AS path, d AS year_end, explicit, completeness, 'ALICE' AS first_director, 'BOB' AS second_director,
    CASE k % 4 WHEN 0 THEN 'ALICE' WHEN 1 THEN 'BOB' WHEN 2 THEN NULL ELSE NULL END AS declarant, CASE k % 4 WHEN 2 THEN 'DECLARANT_CONFLICT' END AS declarant_issue, CASE WHEN k % 3 = 0 THEN 'TEST AUDIT PLT' WHEN k % 3 = 1 THEN 'SIGNED & CO' END AS audit_firm,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 0 WHEN k % 5 = 2 THEN 30 ELSE k END::DOUBLE AS director_fee FROM r WHERE n = 1""")
def latest_statements(spark, d):
    o = dealt(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d MMMM yyyy")
    year = F.when(k % 2 == 0, F.concat(F.lit("Company's current financial year end date: "), day, F.lit(" Company's current financial year start date 1/1/1990 Date of Statutory Declaration 1/8/2024"))).otherwise(_of("for the financial year ended ", day))
    # Four kinds: the oath names the first director; the second is disclosed; both, in conflict; neither.
    oath = F.when((k % 4 == 0) | (k % 4 == 2), "STATUTORY DECLARATION I, Alice, being the director primarily responsible for the financial management of TEST, do solemnly declare")
    told = F.when((k % 4 == 1) | (k % 4 == 2), "Disclosure whether the second director is also primarily responsible for financial management of the company Primarily responsible for financial management of the company")
    firm = F.when(k % 3 == 0, "Name of audit firm TEST AUDIT PLT Address line 1").when(k % 3 == 1, "AUDITORS SIGNED & CO (AF: 1234)")
    fee = F.when(k % 5 == 0, "no table").when(k % 5 == 1, "Director's remuneration\nFees - 12").when(k % 5 == 2, "Group Company\nDirector's remuneration\nFees 10 20 30 40").otherwise(F.concat(F.lit("Director's remuneration\nSalaries 5\nFees "), F.format_number(k, 0), F.lit("\nTotal Director's remuneration 9")))
    text = _lines(year, "STATEMENT BY DIRECTORS We, ALICE and BOB, being the directors", oath, told, firm, fee)
    rows = parse.latest_statements(parse.statements(o.select(F.concat(F.lit("C"), "o_custkey").alias("company"), F.concat(F.lit("p"), "o_orderkey").alias("path"), text.alias("text"))))
    return rows.select("company", "path", "year_end", "explicit", "completeness", "first_director", "second_director", "declarant", "declarant_issue", "audit_firm", F.col("director_fee").cast("double").alias("director_fee"))


_FILED = """
f AS (SELECT o_orderkey AS path, o_custkey % 60 AS folder, o_orderdate::DATE AS effective, CASE o_orderkey % 5 WHEN 0 THEN 'S51' WHEN 1 THEN 'S68' WHEN 2 THEN 'S14' ELSE 'S78' END AS section, CASE o_orderkey % 5 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 ELSE 40 END AS s FROM orders),
h AS (SELECT l_orderkey AS path, l_suppkey % 40 AS who, (floor(l_quantity) - CASE WHEN l_suppkey % 97 = 0 THEN 60 ELSE 0 END)::BIGINT AS shares FROM lineitem),
p AS (SELECT path, who, sum(shares)::BIGINT AS shares FROM h GROUP BY 1, 2),
t AS (SELECT f.*, CASE WHEN f.path % 7 = 0 THEN NULL ELSE (SELECT sum(shares) FROM p WHERE p.path = f.path AND shares > 0) + CASE WHEN f.path % 11 = 0 THEN 1 ELSE 0 END END::BIGINT AS total FROM f)"""


def _state_input(spark, d):
    o, x = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_quantity")
    k = F.col("o_orderkey")
    folder = (F.col("o_custkey") % 60).cast("string")
    section = F.when(k % 5 == 0, "S51").when(k % 5 == 1, "S68").when(k % 5 == 2, "S14").otherwise("S78")
    shares = (F.floor("l_quantity") - F.when(F.col("l_suppkey") % 97 == 0, 60).otherwise(0)).cast("long")
    # Lines are shuffled by their order alone: sums of its people, their sum, and the join are made where they lie.
    x = x.select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 40).alias("who"), shares.alias("shares")).repartition("k")
    people = x.groupBy("k", "who").agg(F.sum("shares").alias("shares"))
    sums = people.where("shares > 0").groupBy("k").agg(F.sum("shares").alias("s"))
    path = lambda c: F.lpad(F.col(c).cast("string"), 9, "0")
    f = o.join(sums, k == sums["k"], "left").select(
        folder.alias("folder"), path("o_orderkey").alias("path"), section.alias("section"), F.to_date("o_orderdate").alias("effective"), F.when(k % 7 != 0, F.col("s") + F.when(k % 11 == 0, 1).otherwise(0)).alias("total_shares"),
        F.lit(2).alias("quality"), F.lit("").alias("reference"), F.to_date("o_orderdate").alias("lodged"), F.concat(F.lit("N"), "o_orderkey").alias("company_name"), F.concat(F.lit("R"), "o_orderkey").alias("registration_no"),
    )
    h = x.join(o.select(k.alias("k"), folder.alias("folder")), "k").select("folder", path("k").alias("path"), F.concat(F.lit("I"), "who").alias("id_no"), F.concat(F.lit("N"), "who").alias("name"), "shares")
    return f, h


_MEMBERS = f"""{_FILED},
a AS (SELECT path, count(*) FILTER (shares > 0) AS active, coalesce(sum(shares) FILTER (shares > 0), 0) AS held, min(shares) AS least, list(who || ':' || shares ORDER BY who) FILTER (shares > 0) AS mark FROM p GROUP BY 1),
v AS (SELECT t.*, mark, coalesce(total < 0 OR least < 0 OR (total > 0 AND active = 0) OR (active > 0 AND total <> held), false) AS wrong FROM t JOIN a USING (path) WHERE section <> 'S78'),
c AS (SELECT folder, effective, section FROM v WHERE NOT wrong GROUP BY ALL HAVING count(DISTINCT coalesce(total::VARCHAR, '-') || coalesce(array_to_string(mark, ','), '')) > 1),
ok AS (SELECT * FROM v WHERE NOT wrong AND NOT EXISTS (SELECT 1 FROM c WHERE c.folder = v.folder AND c.effective = v.effective AND c.section = v.section)),
b AS (SELECT folder, arg_max(path, (effective, s, path)) AS snapshot, arg_max(effective, (effective, s, path)) AS since, arg_max(total, (effective, s, path)) FILTER (true) AS _ FROM ok GROUP BY 1),
l AS (SELECT t.* FROM t LEFT JOIN b USING (folder) WHERE section = 'S78' AND (since IS NULL OR effective > since)),
n AS (SELECT b.folder, who, shares FROM b JOIN p ON p.path = b.snapshot WHERE shares > 0 UNION ALL SELECT l.folder, who, shares FROM l JOIN p USING (path)),
m AS (SELECT folder, who, sum(shares)::BIGINT AS shares FROM n GROUP BY 1, 2 HAVING sum(shares) > 0)"""


@query(f"""WITH {_MEMBERS}
SELECT folder::VARCHAR AS folder, 'ID:I' || who AS key, shares, row_number() OVER (PARTITION BY folder ORDER BY shares DESC, 'N' || who)::INT AS slot FROM m""")
def member_states(spark, d):
    now, _, _ = state.members(*_state_input(spark, d))
    return now.select("folder", "key", "shares", "slot")


@query(f"""WITH {_MEMBERS},
st AS (SELECT l.folder, l.path, l.total, (l.effective, l.path) AS ord, sum(p.shares)::BIGINT AS s FROM l JOIN p USING (path) GROUP BY ALL),
ex AS (SELECT folder, max(ord) AS told, arg_max(total, ord) AS explicit FROM st WHERE total IS NOT NULL GROUP BY 1),
ad AS (SELECT st.folder, any_value(explicit) AS explicit, coalesce(sum(s) FILTER (told IS NULL OR ord > told), 0)::BIGINT AS more FROM st LEFT JOIN ex USING (folder) GROUP BY 1),
tt AS (SELECT coalesce(b.folder, ad.folder) AS folder, (coalesce(ad.explicit, t.total) + coalesce(ad.more, 0))::BIGINT AS member_total FROM b LEFT JOIN t ON t.path = b.snapshot FULL JOIN ad ON ad.folder = b.folder),
o AS (SELECT folder, arg_max(total, (effective, path)) FILTER (total IS NOT NULL) AS explicit, max(effective) FILTER (total IS NOT NULL) AS d, max(effective) FILTER (section = 'S78') AS a FROM t GROUP BY 1),
tot AS (SELECT folder, CASE WHEN a > d AND member_total IS NOT NULL THEN member_total ELSE coalesce(explicit, member_total) END::BIGINT AS total FROM o FULL JOIN tt USING (folder)),
w AS (SELECT folder, max(effective) FILTER (section = 'S68') AS ar, max(effective) FILTER (section = 'S14') AS inc, arg_max(path, (effective, path)) FILTER (section = 'S68') AS arp, arg_max(path, (effective, path)) FILTER (section = 'S14') AS incp,
    arg_max(path, (effective, path)) AS last, max(effective) FILTER (section = 'S51') AS s51, max(effective) FILTER (section = 'S78') AS s78 FROM t GROUP BY 1)
SELECT folder::VARCHAR AS folder, 'N' || last AS company_name, 'R' || coalesce(arp, incp) AS registration_no, ar AS annual_return_date, inc AS incorporate_date, s51 AS section51_date, s78 AS section78_date, total AS total_shares FROM w JOIN tot USING (folder) WHERE ar IS NOT NULL OR inc IS NOT NULL""")
def company_states(spark, d):
    f, h = _state_input(spark, d)
    _, totals, _ = state.members(f, h)
    rows, _ = state.companies(f, state.total_shares(f, totals))
    return rows.select("folder", "company_name", "registration_no", "annual_return_date", "incorporate_date", "section51_date", "section78_date", "total_shares")


@query(f"""WITH {_MEMBERS}
SELECT folder::VARCHAR AS folder, 'INVALID_MEMBER_SNAPSHOT' AS code, lpad(path::VARCHAR, 9, '0') AS source_path FROM v WHERE wrong
UNION ALL SELECT folder::VARCHAR, 'SAME_DATE_MEMBER_SNAPSHOT_CONFLICT', lpad(min(path)::VARCHAR, 9, '0') FROM v JOIN c USING (folder, effective, section) WHERE NOT wrong GROUP BY folder, effective, section
UNION ALL SELECT folder::VARCHAR, 'UNPARSED_ALLOTMENT', lpad(path::VARCHAR, 9, '0') FROM l WHERE path NOT IN (SELECT path FROM h)""")
def member_issues(spark, d):
    _, _, issues = state.members(*_state_input(spark, d))
    return issues.where("code in ('INVALID_MEMBER_SNAPSHOT', 'SAME_DATE_MEMBER_SNAPSHOT_CONFLICT', 'UNPARSED_ALLOTMENT')").select("folder", "code", "source_path")


_DIRECTORS = """
WITH e AS (SELECT event_id, user_id % 25 AS folder, user_id AS who, ts::DATE AS dt, CASE event_type WHEN 'error' THEN 'CEASE' WHEN 'signup' THEN 'UPDATE' ELSE 'APPOINT' END AS kind FROM events),
b AS (SELECT folder, max(dt) AS since FROM e WHERE event_id % 13 = 0 GROUP BY 1),
sn AS (SELECT e.folder, max(event_id) FILTER (dt = since) AS path FROM e JOIN b USING (folder) WHERE event_id % 13 = 0 GROUP BY 1),
c AS (SELECT folder, who, dt FROM e WHERE event_id % 13 <> 0 GROUP BY ALL HAVING count(DISTINCT kind) > 1),
x AS (SELECT e.folder, who, 'SNAPSHOT' AS kind, dt, 0 AS turn, event_id FROM e JOIN sn ON e.event_id = sn.path
    UNION ALL SELECT e.folder, who, kind, dt, 1, event_id FROM e LEFT JOIN b USING (folder) WHERE event_id % 13 <> 0 AND (since IS NULL OR dt >= since) AND NOT EXISTS (SELECT 1 FROM c WHERE c.folder = e.folder AND c.who = e.who AND c.dt = e.dt)),
r AS (SELECT *, row_number() OVER (PARTITION BY folder, who ORDER BY turn DESC, dt DESC, lpad(event_id::VARCHAR, 9, '0') DESC) AS n FROM x)
SELECT folder::VARCHAR AS folder, 'ID:I' || who AS key, 'N' || who AS name, row_number() OVER (PARTITION BY folder ORDER BY 'N' || who)::INT AS slot FROM r WHERE n = 1 AND kind <> 'CEASE'"""


def _director_input(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    base = F.col("event_id") % 13 == 0
    rows = e.select(
        (F.col("user_id") % 25).cast("string").alias("folder"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("path"), F.to_date("ts").alias("effective"), F.when(base, "S68").otherwise("S58").alias("section"), F.lit(2).alias("quality"), F.lit("").alias("reference"), F.to_date("ts").alias("lodged"),
        F.when(F.col("event_type") == "error", "CEASE").when(F.col("event_type") == "signup", "UPDATE").otherwise("APPOINT").alias("kind"), F.concat(F.lit("I"), "user_id").alias("ic"), F.concat(F.lit("N"), "user_id").alias("name"),
    )
    officers = rows.where("section = 'S68'").select("folder", "path", "ic", "name")
    events = rows.where("section = 'S58'").select("folder", "path", "kind", F.col("effective").alias("event_date"), "ic", "name")
    return rows, officers, events


@query(_DIRECTORS)
def director_states(spark, d):
    now, _ = state.directors(*_director_input(spark, d))
    return now.select("folder", "key", "name", "slot")


@query(_DIRECTORS)
def streamed_director_states(spark, d):
    """The same from a stream of shuffled micro-batches, one of which comes twice."""
    from karst.sources.tables import scratch_folder
    from karst.streaming import directors
    from karst.streaming.incremental import Incremental

    top = scratch_folder(spark, "directors")
    facts = state.director_facts(*_director_input(spark, d))
    facts.withColumn("b", F.pmod(F.xxhash64("path"), F.lit(3))).write.partitionBy("b").parquet(f"{top}/facts")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    out = Incremental(spark, f"{top}/out", ["folder"], ["version"])
    try:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", directors.STORE)
        for i, b in enumerate((0, 1, 2, 1)):  # the stream takes each batch, of as many files as it has, when it comes
            spark.read.schema(facts.schema).parquet(f"{top}/facts/b={b}").write.parquet(f"{top}/in/{i}")
            source = spark.readStream.schema(facts.schema).option("recursiveFileLookup", True).parquet(f"{top}/in")
            out.follow(directors.follow(source, "4000 days"), f"{top}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    now = out.read().select("folder", F.inline("directors"))
    return now.select("folder", "key", "name", F.row_number().over(Window.partitionBy("folder").orderBy("name", "key")).alias("slot"))


@query("""
SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1""")
def incremental_latest(spark, d):
    """The last event of each user from micro-batches in any order, one of which comes twice."""
    from karst.sources.tables import scratch_folder
    from karst.streaming.incremental import Incremental

    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    held = Incremental(spark, scratch_folder(spark, "latest"), ["user_id"], ["ts", "event_id"])
    for batch, part in enumerate((2, 0, 1)):
        rows = e.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
        held.apply(rows, batch)
        held.apply(rows, batch)
        if batch == 1:
            held.compact()
    return held.read()




@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Tan & Co' WHEN 1 THEN NULL ELSE 'ALICE' END AS name, o_orderkey % 4 >= 2 AS plausible FROM orders""")
def statement_names(spark, d):
    o = table(spark, d, "orders", "o_orderkey")
    k = F.col("o_orderkey") % 4
    raw = F.when(k == 0, " Tan  & Co Company No: 12 and more").when(k == 1, "n/a").when(k == 2, "ALICE Page 2 of 9 x").otherwise("ALICE,")
    rows = o.select("o_orderkey", parse.person(raw).alias("name"))
    return rows.select("o_orderkey", "name", (parse.plausible(F.col("name")) & ~F.contains(F.coalesce("name", F.lit("")), F.lit("&"))).alias("plausible"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN DATE '2021-03-08' END AS incorporated, CASE o_orderkey % 3 WHEN 2 THEN o_orderdate::DATE END AS renamed, CASE o_orderkey % 3 WHEN 2 THEN 'TEST ' || o_orderkey END AS new_name,
    CASE o_orderkey % 3 WHEN 1 THEN (o_orderkey * 10)::BIGINT END AS allotted, CASE o_orderkey % 3 WHEN 0 THEN '1 ROAD TOWN' END AS business FROM orders""")
def filing_fields(spark, d):
    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    k, n = F.col("o_orderkey") % 3, F.col("o_orderkey")
    text = F.when(k == 0, F.concat(F.lit("Incorporation Date: "), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("\nAddress of place of business 1 ROAD\nTOWN Address of financial"))).when(
        k == 1, F.concat(F.lit("on and from the 8h day of March 2021, incorporated Total Accumulated Issued (RM): 5 Total Accumulated Issued "), F.format_number(n * 10, 0))
    ).otherwise(F.concat(F.lit("New Name: TEST "), n.cast("string"), F.lit("\nDate of Application "), F.date_format("o_orderdate", "dd/MM/yyyy")))
    t = F.col("t")
    return o.select("o_orderkey", text.alias("t")).select("o_orderkey", parse.incorporation_date(t).alias("incorporated"), parse.new_name_date(t).alias("renamed"), parse.value(t, "new_name").alias("new_name"), parse.total_shares_s78(t).alias("allotted"), parse.business_address(t).alias("business"))


def _owner_events(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    status = F.when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "error", "CESSATION").otherwise("")
    return e.select("event_id", (F.col("user_id") % 40).cast("string").alias("Company No"), F.concat(F.lit("C "), F.col("user_id") % 40).alias("Company Name"), F.lit("").alias("IC"), F.concat(F.lit("P "), F.col("user_id") % 7).alias("Name"), F.date_format("ts", "d/M/yyyy").alias("Date Received"), status.alias("BO Status"), F.col("event_id").cast("string").alias("Submission No"), F.date_format("ts", "dd/MM/yyyy").alias("Date of Becoming BO"), F.when(F.col("event_id") % 2 == 0, F.date_format(F.date_add("ts", 3), "dd/MM/yyyy")).alias("Date of Cessation"))


@query("""
SELECT event_id, (user_id % 40)::VARCHAR AS company FROM events WHERE user_id % 7 = 3""")
def owner_history(spark, d):
    return owners.Owners(_owner_events(spark, d), "event_id").history("p 3").select("event_id", F.col("Company No").alias("company"))


@query("""
SELECT event_id FROM events WHERE ts::DATE <= DATE '2024-01-05' AND (event_id % 2 = 1 OR ts::DATE + 3 > DATE '2024-01-05')""")
def owners_active_on(spark, d):
    return owners.active_on(_owner_events(spark, d), F.lit("2024-01-05").cast("date")).select("event_id")


def _auditors(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    spelling = F.when(F.col("c_custkey") % 5 == 0, "Y H Tan & Co").when(F.col("c_custkey") % 5 == 1, "YH TAN AND CO").otherwise(F.concat(F.initcap("c_mktsegment"), F.lit(" PLT")))
    return c.select(F.col("c_name").alias("Company Name"), F.concat(F.lit("R"), "c_custkey").alias("Reg No"), F.when(F.col("c_custkey") % 3 == 0, "30 JUNE").when(F.col("c_custkey") % 3 == 1, "JUNE").otherwise("31 MAY").alias("Financial Year End"), F.lit("").alias("Auditor Firm No"), spelling.alias("Auditor Name"), F.lit("").alias("Auditor Address"), F.col("c_custkey").alias("n"))


@query("""
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <= 1 THEN 'YH TAN AND CO' ELSE c_mktsegment || ' PLT' END AS k, CASE WHEN c_custkey % 5 = 0 THEN 'Y H Tan & Co' WHEN c_custkey % 5 = 1 THEN 'YH TAN AND CO' ELSE upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) || ' PLT' END AS a FROM customer),
s AS (SELECT k, a, count(*) AS n, min(c_custkey) AS first FROM c GROUP BY 1, 2),
b AS (SELECT k, arg_max(a, (n, -first)) AS auditor FROM s GROUP BY 1)
SELECT auditor, count(*) AS companies FROM c JOIN b USING (k) GROUP BY 1""")
def auditor_counts(spark, d):
    from karst.records.registers import Auditors

    return Auditors(_auditors(spark, d), "n").distinct()


@query("""
SELECT c_name, c_custkey % 3 AS kind FROM customer WHERE c_custkey % 3 <= 1""")
def companies_by_year_end(spark, d):
    from karst.records.registers import Auditors

    rows = Auditors(_auditors(spark, d), "n").by_year_end("june")
    return rows.select(F.col("Company Name").alias("c_name"), (F.col("n") % 3).alias("kind"))


@query("""
SELECT c_name FROM customer WHERE c_custkey % 5 <= 1""")
def companies_by_auditor(spark, d):
    from karst.records.registers import Auditors

    return Auditors(_auditors(spark, d), "n").by_auditor("y. h. tan & co").select(F.col("Company Name").alias("c_name"))


def _companies(spark, d):
    from karst.records.companies import Companies

    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = F.col("c_custkey")
    wide = c.select(
        F.concat(F.lit("F"), n).alias("Folder"), F.col("c_name").alias("Company Name"), F.concat(F.lit("R"), n).alias("Reg No"), F.lit("01/01/2024").alias("Annual Return Date"), n.alias("n"), F.concat(F.lit("P "), n % 9).alias("Director1 Name"), F.lit("x").alias("Director1 IC"),
        F.when(n % 2 == 0, F.concat(F.lit("Q "), n % 4)).alias("Director2 Name"), F.lit("y").alias("Director2 IC"), F.concat(F.lit("P "), n % 6).alias("Member1 Name"), n.cast("string").alias("Member1 Shares"),
    )
    ledger = table(spark, d, "orders", "o_orderkey", "o_custkey").select(F.concat(F.lit("F"), "o_custkey").alias("Folder"), F.col("o_orderkey").alias("n"), F.col("o_orderkey").cast("string").alias("Source PDF"))
    return Companies(wide, "n", {"Statutory_Documents": ledger})


@query("""
SELECT c_name AS company, 1 AS slot, 'P ' || (c_custkey % 9) AS name FROM customer UNION ALL SELECT c_name, 2, 'Q ' || (c_custkey % 4) FROM customer WHERE c_custkey % 2 = 0""")
def company_directors(spark, d):
    return _companies(spark, d).directors().select(F.col("Company Name").alias("company"), "slot", F.col("Name").alias("name"))


@query("""
SELECT c_name AS company, c_custkey::VARCHAR AS shares FROM customer WHERE c_custkey % 6 = 4""")
def person_shareholdings(spark, d):
    return _companies(spark, d).shareholdings(" p 4").select(F.col("Company Name").alias("company"), F.col("Shares").alias("shares"))


@query("""
SELECT c_name AS company, 'R' || c_custkey AS number, list_filter([CASE WHEN c_custkey % 9 = 4 THEN 'Director' END, CASE WHEN c_custkey % 6 = 4 THEN 'Shareholder' END], lambda x: x IS NOT NULL) AS roles FROM customer WHERE c_custkey % 9 = 4 OR c_custkey % 6 = 4""")
def company_associations(spark, d):
    return _companies(spark, d).associations("P 4").select(F.col("Company Name").alias("company"), F.col("Reg No").alias("number"), F.col("Roles").alias("roles"))


@query("""
SELECT o_orderkey AS n, 'F7' AS folder FROM orders WHERE o_custkey = 7""")
def company_documents(spark, d):
    return _companies(spark, d).ledger("Statutory_Documents", "customer 000000007").select("n", F.col("Folder").alias("folder"))


@query("""
WITH k AS (SELECT c_custkey, 'C ' || (c_custkey % 100) AS s, CASE WHEN c_custkey % 2 = 0 THEN 'C ' ELSE 'c. ' END || (c_custkey % 100) AS raw FROM customer)
SELECT arg_min(raw, c_custkey) AS name FROM k GROUP BY s""")
def distinct_names(spark, d):
    c = table(spark, d, "customer", "c_custkey")
    n = F.col("c_custkey")
    rows = c.select(n.alias("n"), F.concat(F.when(n % 2 == 0, "C ").otherwise("c. "), n % 100).alias("Name"), F.lit("").alias("Submission No"))
    return owners.Owners(rows.withColumn("IC", F.lit("")).withColumn("Company Name", F.col("n").cast("string")), "n").names("Name").select(F.col("Name").alias("name"))


@query("""
SELECT c_custkey, 'C' || c_custkey AS "Company Name", u.slot, u.name AS "Name" FROM customer, LATERAL (SELECT unnest([1, 2]) AS slot, unnest(['A' || c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'B' END]) AS name) u WHERE u.name IS NOT NULL""")
def wide_owners(spark, d):
    c = table(spark, d, "customer", "c_custkey")
    n = F.col("c_custkey").cast("string")
    wide = c.select(F.concat(F.lit("C"), n).alias("Company Name"), n.alias("Company No"), F.concat(F.lit("A"), n).alias("BO1 Name"), F.lit(" ").alias("BO1 Company Name"), F.when(F.col("c_custkey") % 3 == 0, "B").alias("BO2 Name"), F.lit(None).cast("string").alias("BO2 Company Name"))
    rows = owners.to_long(wide)
    return rows.select(F.col("Company No").cast("long").alias("c_custkey"), "Company Name", "slot", "Name")


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE WHEN 2 THEN o_orderdate::DATE END AS day, CASE o_orderkey % 4 WHEN 0 THEN '30 JUNE' WHEN 1 THEN '30 JUNE' WHEN 2 THEN 'JUNE' END AS year_end, o_orderkey % 3 = 0 AS marked FROM orders""")
def file_names(spark, d):
    from karst.functions import values as V

    o = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    k = F.col("o_orderkey") % 4
    form = lambda x: F.date_format("o_orderdate", x)
    name = F.when(k == 0, F.concat(F.lit("a "), form("yyyyMMdd"), F.lit(".pdf"))).when(k == 1, F.concat(F.lit("a "), form("d-M-yyyy"), F.lit(".pdf"))).when(k == 2, F.concat(F.lit("of "), form("d MMMM yyyy"), F.lit(" x.pdf"))).otherwise("none.pdf")
    year = F.when(k == 0, "the 30th of June").when(k == 1, "June 30").when(k == 2, "in June").otherwise("later")
    return o.select("o_orderkey", V.source_date(name).alias("day"), V.year_end(year).alias("year_end"), T.is_marked(F.when(F.col("o_orderkey") % 3 == 0, "x").when(F.col("o_orderkey") % 3 == 1, "no").otherwise("-")).alias("marked"))


@query("""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'S51' WHEN 1 THEN 'S58' WHEN 2 THEN 'S78' WHEN 3 THEN 'S68' WHEN 4 THEN 'S14' ELSE '' END AS section, CASE page_id % 6 WHEN 5 THEN 0 ELSE page_id % 10 END::INT AS revision, CASE page_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS score,
    page_id % 6 = 5 AS receipt, page_id AS submission FROM pages""")
def candidate_facts(spark, d):
    from karst.records import candidates as C

    p = table(spark, d, "pages", "page_id")
    k, n = F.col("page_id") % 6, F.col("page_id")
    base = F.when(k == 0, "Register of members").when(k == 1, "Section 58").when(k == 2, "form 24").when(k == 3, "Annual-Return").when(k == 4, "SuperForm").otherwise("a receipt")
    folder = F.when(n % 3 == 0, "E-BOS").when(n % 3 == 1, "B.O").otherwise("Section 51")
    path = F.concat(F.lit("clients/"), folder, F.lit("/"), base, F.when(k != 5, F.concat(F.lit(" (R"), (n % 10).cast("string"), F.lit(")"))).otherwise(""), F.lit(".pdf"))
    return p.select("page_id", C.section_of_name(path).alias("section"), C.revision(path).alias("revision"), C.folder_score(path, "EBOS").alias("score"), C.is_receipt(path).alias("receipt"), C.submission_rank(F.concat(F.lit("S-"), n)).alias("submission"))


@query("""
WITH e AS (SELECT event_id AS k, user_id % 50 AS folder, ts::DATE AS d, user_id % 3 AS m, event_id % 4 AS r FROM events WHERE user_id % 3 <> 0),
s AS (SELECT *, row_number() OVER (PARTITION BY folder, k // 2 ORDER BY d DESC, CASE m WHEN 1 THEN 2 ELSE 1 END DESC, r DESC, k DESC) AS n FROM e)
SELECT 'F' || folder AS folder, arg_max(k, (d, CASE m WHEN 1 THEN 2 ELSE 1 END, r, k)) AS k FROM s WHERE n = 1 GROUP BY 1""")
def latest_candidates(spark, d):
    from karst.records import candidates as C

    e = table(spark, d, "events", "event_id", "user_id", "ts")
    n = F.col("event_id")
    own = F.when(F.col("user_id") % 3 == 1, "Registration No: 202001000001").when(F.col("user_id") % 3 == 0, "Registration No: 202001000002").otherwise("no number")
    text = F.concat(F.lit("Date of Application: "), F.date_format("ts", "dd/MM/yyyy"), F.lit("\n"), own)
    files = e.select(F.concat(F.lit("F"), F.col("user_id") % 50).alias("folder"), F.concat(F.lit("a/(R"), n % 4, F.lit(") x.pdf")).alias("path"), text.alias("text"), F.concat(F.lit("h"), F.floor(n / 2)).alias("sha256"), F.timestamp_seconds(n).alias("modified"), n.alias("k"))
    return C.latest(C.candidates(files, "S14", F.lit("202001000001"))).select("folder", "k")


@query("""
WITH m AS (SELECT c_custkey AS k, c_nationkey AS g, 'A' || (c_custkey % 40) AS a, c_custkey % 5 = 0 AS good FROM customer),
d AS (SELECT g, a, max(k) AS k FROM m WHERE good GROUP BY 1, 2)
SELECT m.k, CASE WHEN good THEN 'P' || m.k WHEN d.k IS NOT NULL THEN 'P' || d.k ELSE 'P' || m.k END AS name FROM m LEFT JOIN d USING (g, a)""")
def repaired_members(spark, d):
    from karst.records import candidates as C

    c = table(spark, d, "customer", "c_custkey", "c_nationkey")
    n = F.col("c_custkey")
    rows = c.select(n.alias("k"), F.col("c_nationkey").alias("g"), F.concat(F.lit("A"), n % 40).alias("Address"), F.when(n % 5 == 0, _number("c_custkey")).otherwise("1x").alias("ID No"), F.concat(F.lit("P"), n).alias("Name"))
    return C.repaired_identities(rows, "g", "k").select("k", F.col("Name").alias("name"))


@query("""
SELECT o_custkey AS k, list(DISTINCT o_orderstatus) AS seen, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1""".replace("list(DISTINCT o_orderstatus) AS seen, ", "(SELECT list(s ORDER BY f DESC, s) FROM (SELECT o_orderstatus AS s, max(o_orderkey) AS f FROM orders o WHERE o.o_custkey = orders.o_custkey GROUP BY 1)) AS seen, "))
def ranked_suggestions(spark, d):
    from karst.records import candidates as C

    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    rows = C.suggestions(o.withColumnRenamed("o_custkey", "k"), "k", "o_orderstatus", [F.desc("o_orderkey")])
    return rows.select("k", F.col("values").alias("seen"), F.size("values").cast("long").alias("n"))


@query("""
WITH p AS (SELECT c_custkey AS k, CASE c_custkey % 3 WHEN 0 THEN '' ELSE 'I' || (c_custkey % 200) END AS i, 'N' || (c_custkey % 150) AS n FROM customer),
e AS (SELECT s_suppkey AS e, CASE s_suppkey % 2 WHEN 0 THEN '' ELSE 'I' || (s_suppkey % 200) END AS i, 'N' || (s_suppkey % 150) AS n FROM supplier),
l AS (SELECT n, count(DISTINCT nullif(i, '')) AS c FROM e GROUP BY 1)
SELECT k AS person, e FROM p JOIN e ON p.i <> '' AND p.i = e.i UNION ALL SELECT k, e FROM p JOIN e USING (n) JOIN l USING (n) WHERE (p.i <> '' AND e.i = '') OR (p.i = '' AND c <= 1)""")
def events_of_people(spark, d):
    from karst.records import candidates as C

    c, s = dealt(table(spark, d, "customer", "c_custkey"), "c_custkey"), table(spark, d, "supplier", "s_suppkey")
    part = lambda k, a, b: [F.when(F.col(k) % b == 0, "").otherwise(F.concat(F.lit("I"), F.col(k) % 200)).alias("identity"), F.concat(F.lit("N"), F.col(k) % 150).alias("name")]
    people, events = c.select(F.col("c_custkey").alias("k"), *part("c_custkey", "", 3)), s.select(F.col("s_suppkey").alias("e"), *part("s_suppkey", "", 2))
    return C.person_events(people, events, "k", "identity", "name").select("person", "e")


@query("""
SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 <> 2""")
def companies_in_questions(spark, d):
    from karst.plans import entities as E

    o, c = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "customer", "c_custkey", "c_name")
    asked = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("orders of "), F.lower("c_name"), F.lit("?"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.regexp_extract("c_name", r"(\d+)", 1), F.lit(" is which customer"))).otherwise("which customer").alias("text"))
    return E.companies_named(asked, E.lookup(c, "c_name", "c_custkey"))


@query("""
SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'ABC D-' || c_custkey WHEN 1 THEN 'GEORGETOWN no-' || c_custkey ELSE c_custkey::VARCHAR END AS value, '12 JALAN 1 10000 PULAU PINANG MALAYSIA' AS address FROM customer""")
def layout_texts(spark, d):
    from karst.records import candidates as C

    c = table(spark, d, "customer", "c_custkey")
    n = F.col("c_custkey").cast("string")
    parts = F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(" A B"), F.lit("C"), F.concat(F.lit(" D-"), n))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("GEORGETOW"), F.lit(""), F.concat(F.lit("N no-"), n))).otherwise(F.array(n))
    return c.select("c_custkey", C.layout_value(parts).alias("value"), C.layout_address(F.array(F.lit("12JALAN 110000"), F.lit("PULAU INANG ALAYSIA , Page 2 of 9"))).alias("address"))


@query("""
WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'R' || c_custkey END AS reg, 'F' || c_custkey AS folder, 'old' AS v, NULL::VARCHAR AS more FROM customer),
n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'R' || (s_suppkey * 2) END AS reg, 'F' || (s_suppkey * 3) AS folder, 'new' AS v, s_name AS more FROM supplier)
SELECT * FROM n UNION ALL SELECT * FROM o WHERE reg NOT IN (SELECT reg FROM n WHERE reg <> '') AND folder NOT IN (SELECT folder FROM n)""")
def upsert_by_either_key(spark, d):
    from karst.operators.reshape import upsert_any

    c, s = table(spark, d, "customer", "c_custkey"), table(spark, d, "supplier", "s_suppkey", "s_name")
    at = lambda head, x: F.concat(F.lit(head), x)
    old = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 7 == 0, "").otherwise(at("R", F.col("c_custkey"))).alias("reg"), at("F", F.col("c_custkey")).alias("folder"), F.lit("old").alias("v"))
    new = s.select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, "").otherwise(at("R", F.col("s_suppkey") * 2)).alias("reg"), at("F", F.col("s_suppkey") * 3).alias("folder"), F.lit("new").alias("v"), F.col("s_name").alias("more"))
    return upsert_any(old, new, ["reg", "folder"])


@query(f"""
SELECT 'p' || c_custkey AS path, {_NUMBER.format('c_custkey', '80')} AS ic, 'ALICE' AS name, d::DATE AS event_date, CASE d WHEN '2024-03-05' THEN c_name END AS residential, CASE d WHEN '2024-03-05' THEN 'a@b.cc' END AS email, CASE d WHEN '2024-04-06' THEN 'FEMALE' END AS gender
FROM customer, (VALUES ('2024-03-05'), ('2024-04-06')) v(d)""")
def changed_particulars(spark, d):
    from karst.records import updates

    c = table(spark, d, "customer", "c_custkey", "c_name")
    text = _lines("SECTION D : CHANGE IN PARTICULARS OF DIRECTOR", _of("Identification Number ", F.regexp_replace(_number("c_custkey"), r"^(\d{6})", "$1-")), "Name ALICE", F.concat(F.lit("Residential Address: "), F.col("c_name"), F.lit(" 05/03/2024")), "Email Address: a@b.cc 05/03/2024", "Gender: FEMALE 06/04/2024", "Odd thing: x 06/04/2024", "PARTICULARS OF LODGER")
    return updates.changes(c.select(F.concat(F.lit("p"), "c_custkey").alias("path"), text.alias("text")))[0].select("path", "ic", "name", "event_date", "residential", "email", "gender")


@query("""
SELECT o_custkey AS k, count(*)::BIGINT AS n, 12 AS most FROM orders GROUP BY 1 HAVING count(*) > 12""")
def rosters_over_capacity(spark, d):
    from karst.records import drafts

    o = table(spark, d, "orders", "o_custkey").select(F.col("o_custkey").alias("k"), F.lit("director").alias("role"))
    return drafts.over_capacity(o, "k", {"director": 12, "member": 6}).select("k", "n", "most")


@query("""
SELECT c_custkey, s.section, s.place, s.field, CASE s.field WHEN 'c_name' THEN c_name WHEN 'c_mktsegment' THEN c_mktsegment ELSE c_nationkey::VARCHAR END AS value, CASE s.field WHEN 'c_nationkey' THEN 'number' ELSE 'text' END AS kind
FROM customer, (VALUES ('Company', 0, 'c_name'), ('Company', 1, 'c_nationkey'), ('Market', 0, 'c_mktsegment')) s(section, place, field)""")
def company_sections(spark, d):
    from karst.records import drafts

    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return drafts.section_payload(c, "c_custkey", {"Company": ["c_name", "c_nationkey"], "Market": ["c_mktsegment", "no such"]})


@query("""
WITH e AS (SELECT o_custkey AS k, o_orderstatus AS v, max(o_orderkey) AS o FROM orders GROUP BY 1, 2), l AS (SELECT k, list(v ORDER BY o DESC) AS c FROM e GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'own' END AS value, CASE WHEN c_custkey % 2 = 0 THEN 'filled' WHEN c IS NOT NULL THEN 'suggested' ELSE 'missing' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE coalesce(len(c), 0) END::INT AS n, CASE WHEN c_custkey % 2 = 1 THEN c[1] END AS first
FROM customer LEFT JOIN l ON k = c_custkey""")
def person_drafts(spark, d):
    from karst.records import drafts

    c, o = table(spark, d, "customer", "c_custkey"), table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    people = c.select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, "own").otherwise(" ").alias("race"))
    rows = drafts.person_drafts(people, o.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("Race"), "o_orderkey"), "k", [F.col("o_orderkey")])
    return rows.select("k", F.col("race.value").alias("value"), F.col("race.status").alias("status"), F.size("race.candidates").alias("n"), F.get("race.candidates", F.lit(0)).alias("first"))


def _laid(cells: list, starts: list[int], ratio: Column) -> Column:
    """One line with a cell at each of the starts, all of them times ``ratio``; the last cell ends the line."""
    texts = [F.lit(c) if isinstance(c, str) else c for c in cells]
    wide = [F.rpad(c, (ratio * (b - a)).cast("int"), F.lit(" ")) for c, a, b in zip(texts, starts, starts[1:])]
    return F.concat(*wide, texts[len(starts) - 1])


def _sheets(spark, d, head: list[list[str]], row, starts: list[int], begins: str, ends: str):
    """Files of returns, one for each nation and remainder of the key, four rows a page, pages of three widths; the last row of a page goes on overleaf."""
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = F.concat(F.lit("n"), "c_nationkey", F.lit("/"), F.col("c_custkey") % 2)
    c = c.withColumn("path", path).withColumn("i", F.row_number().over(Window.partitionBy("path").orderBy("c_custkey")) - 1)
    page = F.floor(F.col("i") / 4)
    width = lambda page: F.when(page % 3 == 0, 1.0).when(page % 3 == 1, 1.25).otherwise(1.5)
    first, second = row(F.lpad((F.col("i") + 1).cast("string"), 4, "0"))
    last = F.col("i") % 4 == 3
    over = _lines("Page 1 of 9", "\f" + "Company No: 1", _laid(second, starts, width(page + 1)))
    text = _lines(_laid(first, starts, width(page)), F.when(last, over).otherwise(_laid(second, starts, width(page))))
    one = F.lit(1.0)
    top = _lines("a return", begins, *[_laid(h, starts, one) for h in head])
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", text.alias("t")))), lambda x: x["t"]), "\n")
    return c.groupBy("path").agg(F.concat_ws("\n", top, rows, F.lit(ends)).alias("text"))


_COUNTRY = {"nationality": "CASE c_nationkey % 3 WHEN 0 THEN 'MALAYSIA' WHEN 1 THEN 'CHINA' ELSE 'INDIA' END", "gender": "CASE c_custkey % 2 WHEN 0 THEN 'MALE' ELSE 'FEMALE' END"}


@query(f"""
SELECT 'n' || c_nationkey || '/' || (c_custkey % 2) AS path, 'ALICE ' || c_custkey || 'X' AS "Name", {_NUMBER.format('c_custkey', '80')} AS "IC", 'MYKAD' AS "ID Type", {_COUNTRY['nationality']} AS "Nationality", 'R' || c_nationkey AS "Race", {_COUNTRY['gender']} AS "Gender", '1980-01-02' AS "DOB",
    'DIRECTOR OF ' || c_mktsegment AS "Designation", 'TRADER' AS "Business Occupation", c_name || ' JALAN 1' AS "Residential", 'SUITE ' || c_nationkey || ', TOWN' AS "Service Address", 'a' || c_custkey || '@example.com' AS "Email" FROM customer""")
def layout_directors(spark, d):
    starts = [0, 8, 32, 60, 84, 100, 124, 136, 152, 200, 240]
    head = [["", "", "", "Type", "Passport", "Nationality/", "Gender", "Date of birth", "Residential", "Service", "Business"], ["No", "Title/Name", "Designation", "number", "expiry date", "Race", "", "", "address", "address", "occupation"]]
    k, g = F.col("c_custkey"), F.col("c_nationkey")

    def row(number):
        country = F.when(g % 3 == 0, "MALAYSIA").when(g % 3 == 1, "CHINA").otherwise("INDIA")
        first = [number, "ALICE", "DIRECTOR OF", "MYKAD", "", country, F.when(k % 2 == 0, "MALE").otherwise("FEMALE"), "1980-01-02", F.col("c_name"), F.concat(F.lit("SUITE "), g, F.lit(",")), "TRADER"]
        second = ["", F.concat(k, F.lit("X")), F.col("c_mktsegment"), _number("c_custkey"), "", F.concat(F.lit("R"), g), "", "", "JALAN 1", F.concat(F.lit("TOWN a"), k, F.lit("@example.com")), ""]
        return first, second

    files = _sheets(spark, d, head, row, starts, "Particulars of Directors", "Particulars of Managers")
    return layout.directors(files).drop("pos", "Passport Expiry")


@query(f"""
SELECT 'n' || c_nationkey || '/' || (c_custkey % 2) AS path, 'INDIVIDUAL' AS "Type", 'BOB ' || c_custkey || 'X' AS "Name", 'MYKAD' AS "ID Type", {_NUMBER.format('c_custkey', '70')} AS "ID No", {_COUNTRY['nationality']} AS "Nationality", 'R' || c_nationkey AS "Race", {_COUNTRY['gender']} AS "Gender", '02/01/1980' AS "DOB",
    c_name || ' JALAN 1' AS "Address", (c_custkey * 10)::VARCHAR AS "Shares", CASE c_custkey % 5 WHEN 0 THEN 'PREFERENCE SHARES' ELSE 'ORDINARY SHARES' END AS "Share Type", 'CITIZENS WHO ARE M' AS "Analysis" FROM customer""")
def layout_members(spark, d):
    starts = [0, 12, 28, 52, 76, 100, 116, 140, 152, 176, 220, 248]
    head = [["", "", "Type of", "", "Type/", "Passport", "Nationality/", "", "", "", "Number of", "Analysis of"], ["No", "Reference", "member", "Title/Name", "number", "expiry date", "Race", "Gender", "Date of birth", "Address", "shares", "holdings"]]
    k, g = F.col("c_custkey"), F.col("c_nationkey")

    def row(number):
        country = F.when(g % 3 == 0, "MALAYSIA").when(g % 3 == 1, "CHINA").otherwise("INDIA")
        first = [number, "0001", "INDIVIDUAL", "BOB", "MYKAD", "", country, F.when(k % 2 == 0, "MALE").otherwise("FEMALE"), "02/01/1980", F.col("c_name"), (k * 10).cast("string"), "CITIZENS"]
        second = ["", "", "", F.concat(k, F.lit("X")), _number("c_custkey", "70"), "", F.concat(F.lit("R"), g), "", "", "JALAN 1", F.when(k % 5 == 0, "PREFERENCE").otherwise("ORDINARY SHARES"), "WHO ARE M"]
        return first, second

    files = _sheets(spark, d, head, row, starts, "SECTION E: PARTICULARS OF MEMBERS", "TOTAL NUMBER OF SHARES 100")
    return layout.registers(files)[1].drop("pos", "Passport Expiry")


_RUN = """
o AS (SELECT o_orderkey AS k, o_custkey % 60 AS folder, o_custkey % 9 AS who, o_orderdate::DATE AS d, lpad(o_orderkey::VARCHAR, 9, '0') AS path, CASE o_orderkey % 5 WHEN 0 THEN 'S14' WHEN 1 THEN 'S78' WHEN 2 THEN 'S58' WHEN 3 THEN 'S78' ELSE '' END AS section FROM orders),
f AS (SELECT * FROM o WHERE section <> ''),
c AS (SELECT folder, d FROM f WHERE section = 'S14' GROUP BY 1, 2 HAVING count(DISTINCT k * 10 + who) > 1),
ok AS (SELECT * FROM f WHERE section = 'S14' AND NOT EXISTS (SELECT 1 FROM c WHERE c.folder = f.folder AND c.d = f.d)),
b AS (SELECT folder, max(d) AS since, arg_max(path, (d, 'R' || k)) AS snapshot, arg_max(who, (d, 'R' || k)) AS who, arg_max(k, (d, 'R' || k)) AS k FROM ok GROUP BY 1),
l AS (SELECT f.* FROM f LEFT JOIN b USING (folder) WHERE section = 'S78' AND (since IS NULL OR f.d > since)),
n AS (SELECT folder, who, k * 10 AS shares FROM b UNION ALL SELECT folder, who, k FROM l),
m AS (SELECT folder, who, sum(shares)::BIGINT AS shares FROM n GROUP BY 1, 2),
p AS (SELECT folder, max(d) AS since, arg_max(path, (d, 'R' || k)) AS snapshot, arg_max(who, (d, 'R' || k)) AS who, arg_max(k, (d, 'R' || k)) AS k FROM f WHERE section = 'S14' GROUP BY 1),
x AS (SELECT folder, who, max(a) AS a FROM (SELECT folder, who, DATE '0001-01-01' AS a FROM p UNION ALL SELECT f.folder, f.who, f.d FROM f LEFT JOIN p USING (folder) WHERE section = 'S58' AND (p.since IS NULL OR f.d >= p.since)) GROUP BY 1, 2)"""


_runs: dict = {}


def _run(spark, d, part: str):
    """An output of the full run, which is made once for all four."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _runs:
        _runs[key] = _full_run(spark, d)
    return getattr(_runs[key], part)


def _full_run(spark, d):
    """The full run over one paper an order: forms of section 14, allotments, notifications, and papers that nobody can read."""
    from karst.records.run import full_run
    from karst.sources.tables import scratch_folder

    o = dealt(table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "dd/MM/yyyy")
    n, who = k.cast("string"), (F.col("o_custkey") % 9).cast("string")
    number = F.concat(F.lit("80000000000"), who)
    form = _lines(
        "APPLICATION FOR REGISTRATION OF A COMPANY", _of("Proposed name: N", n), _of("Incorporation Date: ", day), _of("Total number of shares: ", (k * 10).cast("string")), "PARTICULARS OF DIRECTOR", _of("Director Name: ALICE ", who), _of("Identification No.: ", number), "Address: 1 STREET",
        "PARTICULARS OF MEMBER", _of("Member Name: ALICE ", who), "ID Type: MYKAD", _of("Identification No.: ", number), _of("Number of share: ", (k * 10).cast("string")), "Class of share: ORDINARY", "DECLARATION",
    )
    allotted = _lines("SECTION 78 RETURN OF ALLOTMENT", _of("Date of Allotment: ", day), "PARTICULAR OF ALLOTTEES", F.concat(F.lit("1 ALICE "), who, F.lit(" "), number, F.lit(" 1 STREET CASH "), n), "DECLARATION")
    noted = _lines("SECTION 58 NOTIFICATION OF CHANGE", "DIRECTORS", "ADD DIRECTOR", _of("Name ALICE ", who), _of("Identification No. ", number), _of("Date of Appointment ", day), "LODGER INFORMATION", "Name DAVE")
    text = F.concat_ws("\n", F.when(k % 5 == 0, form).when(k % 5 == 1, allotted).when(k % 5 == 2, noted).when(k % 5 == 3, allotted), F.when(k % 5 != 4, _of("Lodging Reference Number: R", n)))
    files = o.select((F.col("o_custkey") % 60).cast("string").alias("folder"), F.lpad(n, 9, "0").alias("path"), text.alias("text"), _of("h", n).alias("sha256"))
    return full_run(files, scratch_folder(spark, "run"))


@query(f"""WITH {_RUN},
tot AS (SELECT folder, max(d) FILTER (section = 'S14') AS told, arg_max(k * 10, (d, 'R' || k)) FILTER (section = 'S14') AS explicit, max(d) FILTER (section = 'S78') AS a FROM f GROUP BY 1),
held AS (SELECT folder, sum(shares)::BIGINT AS s FROM m GROUP BY 1)
SELECT p.folder::VARCHAR AS folder, 'N' || p.k AS company_name, p.since AS incorporate_date, CASE WHEN tot.a > tot.told AND held.s IS NOT NULL THEN held.s ELSE coalesce(tot.explicit, held.s) END::BIGINT AS total_shares,
    (SELECT string_agg('ID:80000000000' || who || '=' || shares, ',' ORDER BY shares DESC, who) FROM m WHERE m.folder = p.folder) AS members, (SELECT string_agg('ALICE ' || who, ',' ORDER BY a, who) FROM x WHERE x.folder = p.folder) AS directors
FROM p JOIN tot USING (folder) LEFT JOIN held USING (folder)""")
def run_companies(spark, d):
    rows = _run(spark, d, "companies")
    return rows.select("folder", "company_name", "incorporate_date", "total_shares", F.array_join(F.transform("members", lambda m: F.concat(m["key"], F.lit("="), m["shares"])), ",").alias("members"), F.array_join(F.transform("directors", lambda m: m["name"]), ",").alias("directors"))


@query(f"""WITH {_RUN}
SELECT folder::VARCHAR AS folder, path, section, CASE WHEN section = '' THEN 'UNREADABLE' ELSE 'VALID' END AS status, 'h' || k AS sha256, CASE WHEN section <> '' THEN 'R' || k ELSE '' END AS reference, CASE WHEN section <> '' THEN d END AS effective, CASE section WHEN 'S14' THEN k * 10 END::BIGINT AS total FROM o""".replace("path, section,", "path, CASE section WHEN '' THEN 'OTHER' ELSE section END AS section,"))
def run_documents(spark, d):
    rows = _run(spark, d, "documents")
    return rows.select("folder", "path", "section", "status", "sha256", "reference", "effective", F.get_json_object("parsed", "$.total_shares").cast("long").alias("total"))


@query(f"""WITH {_RUN},
e AS (SELECT folder, path, 'S14' AS section, 'MEMBER_SNAPSHOT' AS event_type, d, who, k * 10 AS shares FROM f WHERE section = 'S14' UNION ALL SELECT folder, path, 'S14', 'DIRECTOR_SNAPSHOT', d, who, NULL FROM f WHERE section = 'S14'
    UNION ALL SELECT folder, path, 'S78', 'ALLOTMENT', d, who, k FROM f WHERE section = 'S78' UNION ALL SELECT folder, path, 'S58', 'APPOINT', d, who, NULL FROM f WHERE section = 'S58')
SELECT folder::VARCHAR AS folder, path AS source_path, section, event_type, d AS effective, 'ID:80000000000' || who AS subject_key, 'ALICE ' || who AS subject_name, shares::BIGINT AS shares FROM e""")
def run_events(spark, d):
    return _run(spark, d, "events").withColumn("shares", F.get_json_object("payload", "$.shares").cast("long")).drop("payload")


@query(f"""WITH {_RUN},
ft AS (SELECT folder, min(d) FILTER (section = 'S14') AS a FROM f GROUP BY 1)
SELECT folder::VARCHAR AS folder, 'REVIEW' AS severity, 'UNREADABLE_FILING' AS code, path AS source_path FROM o WHERE section = ''
UNION ALL SELECT f.folder::VARCHAR, 'CRITICAL', 'SAME_DATE_MEMBER_SNAPSHOT_CONFLICT', min(path) FROM f JOIN c USING (folder, d) WHERE section = 'S14' GROUP BY f.folder, f.d
UNION ALL SELECT folder::VARCHAR, 'CRITICAL', 'NO_PROFILE_SNAPSHOT', '' FROM ft WHERE a IS NULL""")
def run_issues(spark, d):
    return _run(spark, d, "issues").select("folder", "severity", "code", "source_path")
