from karst.plans.router import Plan, Registry, plan


def named(q):
    return "ALPHA" if "alpha" in q.lower() else ""


def test_one_intent():
    p = plan("Who are the directors of Alpha?", named)
    assert (p.intent, p.entity, p.all_records, p.fields) == ("director", "ALPHA", False, ("Directors",))


def test_fields_go_by_position():
    assert plan("fye and auditor of Alpha", named).fields == ("Financial Year End", "Auditor Name")


def test_resolution_is_not_the_director():
    assert plan("director written resolution of Alpha", named).intent == "constitution_information"
    assert plan("director fee of Alpha", named).intent == "financial_statement_information"


def test_several_groups_become_sections():
    p = plan("directors and shareholders of Alpha", named)
    assert p.intent == "multi_intent" and [s.intent for s in p.sections] == ["director", "shareholder"]


def test_nothing_asked():
    assert plan("hello", named).intent == "knowledge"


def test_sections_fail_alone(spark):
    def bad(p):
        raise ValueError("broken")

    r = Registry({"director": lambda p: spark.range(1), "shareholder": bad})
    out = r.run(plan("directors and shareholders of Alpha", named))
    assert out.status == "partial" and [s.status for s in out.sections] == ["success", "error"]
    assert r.run(Plan("director")).status == "not_found"
    assert r.run(Plan("nope", "ALPHA")).status == "error"
