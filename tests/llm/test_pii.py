import hashlib
import random
import re

from pyspark.sql import functions as F

from karst.llm import pii

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(m[0])]
    return [x[2] for x in sorted(found)]


def texts(n=400):
    r = random.Random(5)
    bits = ["4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "a.b@c.de", "a@b.c_d@e.fr", "x@y", "10.0.0.1", "1.2.3.256", "001.2.3.4.5.6.7.8", "+1 (212) 555-0123", "+49.30.1234567", "++1 2 3", "1 -2", "12-34", "a@b.co.uk.", "%+-@q.zz", "é😀", "0" * 14, "1.2.3", "..", "@", "+", "-", " ", "5", "ab", "\n", "79927398713 0000"]
    return ["".join(r.choice(bits) + r.choice(["", " ", "", ","]) for _ in range(r.randint(0, 25))) for _ in range(n)] + [None, "", "1 " * 20000, "7" * 60000, "a" * 60000, "a.b@" * 5000, "1.1." * 5000]


def test_base_spans_as_python_finds_them(spark):
    all_ = texts()
    df = pii.find_pii(spark.createDataFrame(list(enumerate(all_)), "doc_id long, text string"))
    got = {r.doc_id: r for r in df.select("doc_id", pii.written(F.filter("pii", pii.is_base)).alias("s"), F.sha2(pii.written(F.filter("pii", pii.is_base)), 256).alias("h")).collect()}
    for i, t in enumerate(all_):
        want = ",".join(base(t))
        assert got[i].s == want, (i, t[:200] if t else t)
        assert got[i].h == hashlib.sha256(want.encode()).hexdigest()


def test_more_spans_need_checksum_or_context(spark):
    rows = [("IBAN GB82 WEST 1234 5698 7654 32 end", "iban"), ("GB82WEST12345698765433", ""), ("ssn 123-45-6789", "ssn"), ("ssn 666-45-6789", ""), ("call (212) 555-0123", "phone_local"), ("order (212) 555-0123", ""), ("+1 (212) 555-0123 call", "phone"), ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "secret"), ("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962", ""), ("key " + "k" * 40, ""), ("secret: " + "a1" * 15, "")]
    df = pii.find_pii(spark.createDataFrame(rows, "text string, want string"))
    for r in df.collect():
        assert ",".join(s.kind for s in r.pii) == r.want, r.text
        assert all(r.text[s.start : s.end] == s.text and 0 < s.score <= 1 for s in r.pii)


def test_context_raises_the_score(spark):
    a, b = (r.pii[0].score for r in pii.find_pii(spark.createDataFrame([("server 10.0.0.1",), ("about 10.0.0.1",)], "text string")).collect())
    assert a > b


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "a@b.cc and 10.0.0.1!", 20, "k"), (2, None, 0, "k"), (3, "none", 4, "k"), (4, "😀 +1 212 555 0123 4111111111111111", 0, "k")], "doc_id long, text string, n_chars long, pii string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "[EMAIL] and [IP]!" and got[1].n_chars == 17 and got[1].pii == "k"
    assert got[2].text is None and got[3].text == "none"
    out = pii.redact(odd)
    assert out.columns == odd.columns and out.count() == odd.count()


def test_no_python_in_the_plan(spark):
    plan = pii.redact(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
