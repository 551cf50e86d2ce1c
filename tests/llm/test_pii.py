import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.RANK[s[0]]))


def base(text):
    return [s for s in pii.spans(text) if s[0] in pii.BASE]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1234567890..@@++-( )%é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


def test_examples_and_long_texts():
    text = "mail a.b@c.d.e, call +49 (0) 30-1234567 or 4111 1111 1111 1111 from 10.0.0.1.2.3.4.5 " * 3000
    assert base(text) == brute(text)
    assert ("account", 8, 30) in pii.spans("My IBAN GB82WEST12345698765432 is")
    assert [s[0] for s in pii.spans("see https://a.example/x?y=1.")] == ["url"]
    assert pii.redacted("to x@y.zz now") == "to <EMAIL> now"


def test_added_kinds_in_any_spelling():
    kinds = lambda text: [(k, text[a:b]) for k, a, b in pii.spans(text) if k not in pii.BASE]
    for scheme in ("http://", "HTTPS://", "hTtP://", "Ftp://", "www.", "WwW."):
        assert kinds(f"({scheme}a.example/x?y=1).") == [("url", f"{scheme}a.example/x?y=1")]
    assert kinds("www. http:// ftp://") == []
    for cue in ("account", "ACCOUNT no.", "aCCt #", "Customer ID:", "SSN", "passport number", "Routing"):
        assert kinds(f"İ {cue} 12-345-678 ok") == [("account", "12-345-678")]
    assert kinds("account 12345, ssn none, subaccount 12345678") == []
    assert kinds("iban DE89 3704 0044 0532 0130 00.") == [("account", "DE89 3704 0044 0532 0130 00")]
    assert kinds("http://a.example/ http://a.example/") == [("url", "http://a.example/")] * 2


def test_rows(spark):
    rows = [(1, "x@y.zz", "k"), (1, "x@y.zz", "k"), (2, None, None), (None, "", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(map(tuple, pii.find(df).select("doc_id", "n_email", "spans").collect()), key=str)
    assert got == sorted([(1, 1, "email:0:6"), (1, 1, "email:0:6"), (2, 0, ""), (None, 0, "")], key=str)
    red = pii.redact(df)
    assert red.columns == df.columns
    assert sorted(map(tuple, red.collect()), key=str) == sorted([(1, "<EMAIL>", "k"), (1, "<EMAIL>", "k"), (2, None, None), (None, "", "z")], key=str)
    assert pii.find(df.limit(0)).count() == 0
