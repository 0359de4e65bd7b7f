import hashlib
import re

from tsrisk.llm import pii
from tsrisk.llm.queries import QUERIES

KINDS = ("email", "ip", "card", "phone")


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(number):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(number))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_of(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [
        ("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(len(p) < 10 and int(p) <= 255 or int(p[-9:]) == 0 for p in m[0].split("."))
    ]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return found


TEXTS = [
    None, "", "a@b.c@d.e.f x@y", "a@b-c.d+x@e.f", "é😀 me@host.example.com, you@x..y", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111", "+1 (269) 555-3296 +49 30 123456 +1 +12--3 +1(((((2", "+1 269 555 3296+44 20 7946 0018",
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 but DE89370400440532013001", "ssn 123-45-6789 or 123-45-6789x and 000-12-3456",
    "a" * 20_000, "1" * 20_000, "1.2." * 5_000, "a.b@c" + ".d" * 20_000, "x@y.z " * 1_500, "+1" + "(" * 20_000, "1 " * 20_000, "1.1.1.1 " * 700,
]


def test_base_spans_equal_the_patterns(docs_of):
    rows = list(enumerate(TEXTS)) + [(2, TEXTS[2])]
    got = pii.find_pii(docs_of(*rows)).select("doc_id", "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind in KINDS]
        assert base == base_of(TEXTS[r.doc_id]), r.doc_id
    assert pii.find_pii(docs_of((1, "a")).limit(0)).count() == 0


def test_added_kinds_and_scores(docs_of):
    spans = {r.doc_id: [(s.kind, s.score) for s in r.spans] for r in pii.find_pii(docs_of(*enumerate(TEXTS))).collect()}
    assert [k for k, _ in spans[9] if k == "iban"] == ["iban", "iban"]
    assert ("national", 0.5) in spans[10]
    (plain,), (near,), (against,) = (
        [s.score for s in r.spans]
        for r in pii.find_pii(docs_of((1, "x a@b.cd"), (2, "contact a@b.cd"), (3, "sample a@b.cd"))).orderBy("doc_id").collect()
    )
    assert against < plain < near


def test_ibans_end_at_their_country_s_length(docs_of):
    """Words and numbers behind an IBAN, with or without a space, are no part of it; a number run on into it makes it none."""
    ibans = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "SE45 5000 0000 0583 9825 7466", "NO93 8601 1117 947", "BE68 5390 0754 7034"]
    ibans += ["MT84 MALT 0110 0001 2345 MTLC AST0 01S", "FR14 2004 1010 0505 0001 3M02 606", "GB82 WEST 1234 5698 7654 32", "DE89 3704 0044 0532 0130 00"]
    rows, wanted = [], {}
    for iban in ibans:
        for text in (iban, iban.replace(" ", "")):
            for tail, holds in ((" EUR", True), (" 100", True), (" 1", True), (",", True), ("", True), ("7", False), ("X", False), ("x", False)):
                rows.append((len(rows), f"to {text}{tail}"))
                wanted[rows[-1][0]] = [(3, 3 + len(text))] if holds else []
    rows.append((len(rows), f"{ibans[0]} {ibans[1]} ZZ61 1904 3002 3457 3201 {ibans[1][:-1]}0"))
    wanted[rows[-1][0]] = [(0, 29), (30, 54)]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "iban"] for r in pii.find_pii(docs_of(*rows)).collect()}
    assert got == wanted


def test_no_python_in_the_plan(docs_of):
    plan = pii.find_pii(docs_of((1, "a")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query(spark, folder, texts):
    for r in QUERIES["op7_pii"](spark, folder).collect():
        base = base_of(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in KINDS]
