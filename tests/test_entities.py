"""Names in questions, and what questions are about."""

import pytest

from karst.plans import entities as E
from karst.plans.intents import detect, fields

COMPANIES = ["TEST ALPHA SDN BHD", "TEST ALPHA BETA SDN BHD", "Gamma Trading", "Gamma Holdings", "OMEGA", "XY"]
PEOPLE = ["ALICE TAN", "TAN ALICE MEI", "BOB LEE", "LEE BOB"]
AUDITORS = ["Y H Tan & Co", "ONE PLT", "ONE TWO PLT"]


@pytest.fixture(scope="module")
def found(spark):
    names = spark.createDataFrame([(n, i) for i, n in enumerate(COMPANIES)], "name string, n long")
    companies = E.universe([E.lookup(names, "name", "n")])
    people = E.people([spark.createDataFrame([(p,) for p in PEOPLE], "p string")])
    auditors = spark.createDataFrame([(a,) for a in AUDITORS], "name string")
    aliases = spark.createDataFrame([("the big one", "OMEGA")], "alias string, name string")
    ask = lambda f, q: {r.id: r.name for r in f(spark.createDataFrame(list(enumerate(q)), "id long, text string")).collect()}
    return {"company": lambda *q: ask(lambda t: E.companies_named(t, companies, aliases), q), "person": lambda *q: ask(lambda t: E.people_named(t, people), q), "auditor": lambda *q: ask(lambda t: E.auditors_named(t, auditors), q)}


def test_companies(found):
    got = found["company"]("directors of Test Alpha Sdn. Bhd.?", "of test alpha beta", "who owns gamma", "Gamma trading?", "and Omega", "the big one's owners", "XY", "nothing", "", None, "alpha test")
    assert got == {0: "TEST ALPHA SDN BHD", 1: "TEST ALPHA BETA SDN BHD", 3: "Gamma Trading", 4: "OMEGA", 5: "OMEGA", 6: "XY", 10: "TEST ALPHA SDN BHD"}


def test_people_and_auditors(found):
    assert found["person"]("roles of tan alice", "Mei Alice Tan", "bob lee", "carol") == {0: "ALICE TAN", 1: "TAN ALICE MEI"}
    assert found["auditor"]("audited by YH TAN & CO", "by one two", "one plt please", "plt") == {0: "Y H Tan & Co", 1: "ONE TWO PLT", 2: "ONE PLT"}


def test_last_spelling_and_first_register(spark):
    a = spark.createDataFrame([("Alpha.", 1), ("ALPHA", 2)], "name string, n long")
    b = spark.createDataFrame([("alpha", 1), ("Beta", 2), ("", 3), (None, 4)], "name string, n long")
    got = E.universe([E.lookup(a, "name", "n"), E.lookup(b, "name", "n")])
    assert sorted(map(tuple, got.collect())) == [("ALPHA", "ALPHA"), ("BETA", "Beta")]


# Questions of all kinds: intent, entity, whether all are asked for.
QUESTIONS = [
    ("Who are the directors of Alpha?", "director", "ALPHA", False), ("list all directors", "director_list", "", True), ("shareholders of Alpha", "shareholder", "ALPHA", False), ("show every shareholder", "shareholder_list", "", True),
    ("beneficial owners of Alpha", "beneficial_owner", "ALPHA", False), ("all beneficial owners", "beneficial_owner_list", "", True), ("auditor of Alpha", "auditor", "ALPHA", False), ("list distinct auditors", "auditor_list", "", False),
    ("which companies are audited by Firm", "auditor_companies", "FIRM", False), ("list all companies and their auditors", "auditor_company_list", "", True), ("companies with financial year end June", "auditor_financial_year_end", "", False), ("fye of Alpha", "auditor", "ALPHA", False),
    ("annual return date of Alpha", "company_annual_return", "ALPHA", False), ("annual return dates of all comapnies", "company_annual_return", "", True), ("business address of Alpha", "company_information", "ALPHA", False), ("complete data of Alpha", "company_data", "ALPHA", False),
    ("list company names", "company_list", "", False), ("extraction issues of Alpha", "company_extraction_issues", "ALPHA", False), ("statutory documents of Alpha", "company_statutory_documents", "ALPHA", False), ("statutory events of Alpha", "company_statutory_events", "ALPHA", False),
    ("director written resolution of Alpha", "constitution_information", "ALPHA", False), ("director fee of Alpha", "financial_statement_information", "ALPHA", False), ("directorships of Alice", "person_directorship", "ALICE", False), ("shareholdings of Alice", "person_shareholding", "ALICE", False),
    ("beneficial ownership history of Alice", "person_beneficial_ownership", "ALICE", False), ("status of Alice", "person_status", "ALICE", False), ("directors and shareholders of Alpha", "multi_intent", "ALPHA", False), ("what is a resolution", "knowledge", "", False),
]


@pytest.mark.parametrize(("question", "intent", "entity", "everything"), QUESTIONS)
def test_intents(question, intent, entity, everything):
    named = lambda word: lambda q: word.upper() if word in q.lower() else ""
    p = detect(question, named("alpha"), named("alice"), named("firm"))
    assert (p.intent, p.entity, p.all_records) == (intent, entity, everything)


def test_fields():
    assert fields("reg no and company name, then the Business Address") == ("Reg No", "Company Name", "Business Address")
    assert fields("issued shares; total issued shares") == ("Total Issued Shares",)


def test_questions_of_a_frequent_word_are_dealt_over_groups(spark, monkeypatch):
    """Words above OFTEN that lead no name go before they meet names; one that leads a name still finds it in every question."""
    from karst.plans import entities

    names = spark.createDataFrame([("ALPHA TRADING", "Alpha Trading"), ("BETA TRADING", "Beta Trading"), ("GAMMALONG", "Gammalong")], "key string, name string")
    asked = spark.createDataFrame([(i, f"who owns {'alpha trading' if i % 3 else 'gammalong'} now") for i in range(40)], "id long, text string")
    monkeypatch.setattr(entities, "OFTEN", 4)
    got = {r.id: r.name for r in entities.companies_named(asked, names).collect()}
    assert got == {i: "Alpha Trading" if i % 3 else "Gammalong" for i in range(40)}
