import hashlib
import random
import re

from pyspark.sql import functions as F

from rivulet.llm import queries
from rivulet.llm.pii import pii_spans

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(list(PATTERNS)[k], a, b) for a, k, b in sorted(out)]


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "B7", "@", ".", "-", "_", "%", "+", " ", "\n", "é", "😀", "1", "22", "255", "256", "000", "(", ")", "x@y.z", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (89) 123-4567", "a.b@c-d.e_f@g.h", "5500005555555559"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_base_against_brute_force(spark):
    texts = [*random_texts(1500, 1), None, "", "1" * 5000, "1.2.3.4 " * 700 + "x@y.zz", "a" * 30000 + "@", "9 " * 20000, "4111111111111111 " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_spans(docs).collect():
        got = [(s.kind, s.start, s.end) for s in r.pii if s.kind in PATTERNS]
        assert got == brute(texts[r.doc_id]), texts[r.doc_id][:200]


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k in PATTERNS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_plan_is_native(spark, sf):
    plan = queries.op3_pii(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_added_kinds_and_context(spark):
    rows = [(1, "IBAN DE89 3704 0044 0532 0130 00 ok"), (2, "IBAN DE89 3704 0044 0532 0130 01 no"), (3, "call (212) 555-0199 now"), (4, "it was 212 555 0199 then"), (None, "GB82WEST12345698765432"), (5, "card 4111111111111111"), (5, "card 4111111111111111")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"pii": F.lit(1), "value": F.lit(2)})
    out = pii_spans(docs).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: [(s.kind, s.value) for s in r.pii] for r in out}
    assert by[1] == [("iban", "DE89 3704 0044 0532 0130 00")] and by[2] == []
    assert by[3] == [("local_phone", "(212) 555-0199")] and by[4] == [] and by[None][0][0] == "iban"
    assert next(r for r in out if r.doc_id == 5).pii[0].score > 0.9
    assert pii_spans(docs.limit(0)).count() == 0
