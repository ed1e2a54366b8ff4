import hashlib
import re

import corpus_fixture as C
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelgrid.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@..--+ 0142 5()é\n"), max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert [s[:3] for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS] == plain(text)


CASES = [
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "mail a.b@c.de, x@y @z@w.com", "ip 10.0.0.255 and 10.0.0.256 1.2.3.4.5.6.7.8",
    "call +49 (30) 1234-567.", "é😀 a@b.co", "IBAN DE89 3704 0044 0532 0130 00 here", "IBAN DE88 3704 0044 0532 0130 00", "ssn 123-45-6789", "code 123-45-6789",
]


def test_known_cases():
    for t in CASES:
        assert [s[:3] for s in pii.find_spans(t) if s[0] in pii.BASE_KINDS] == plain(t)
    kinds = [[s[0] for s in pii.find_spans(t)] for t in CASES]
    assert kinds[5] == ["iban"] and kinds[6] == [] and kinds[7] == ["ident"] and kinds[8] == []
    assert pii.mask("to a@b.co or 10.0.0.1") == "to <email> or <ip>"


def test_account_numbers_end_with_their_country_s_length():
    good = "DE89 3704 0044 0532 0130 00"
    for t in (f"IBAN {good} AND MORE", f"{good}", f"x {good.replace(' ', '')}, y", f"{good} DE12 3456"):
        assert [t[a:b].replace(" ", "") for k, a, b, _ in pii.find_spans(t) if k == "iban"] == [good.replace(" ", "")]
    assert not [s for s in pii.find_spans(good + "1") if s[0] == "iban"] and not pii.find_spans("ZZ89 3704 0044 0532 0130 00")


def test_context_moves_every_kind_up_and_down():
    bare = {"email": "a@b.co", "ip": "10.0.0.1", "card": "4111 1111 1111 1111", "phone": "+49 30 1234567", "iban": "DE89 3704 0044 0532 0130 00", "ident": "123-45-6789"}
    for kind, span in bare.items():
        def score(text):
            return next((s[3] for s in pii.find_spans(text) if s[0] == kind), None)

        up = score(f"{pii.CONTEXT[kind].split()[0]}: {span}")
        none = score(f"xx {span} xx")
        down = score(f"{pii.AGAINST[kind].split()[0]} {span}")
        assert up > pii.PRIOR[kind]
        if kind != "ident":
            assert none == pii.PRIOR[kind]
        assert (down is None) if kind in ("ident",) else (down < none)
        far = "x" * 100 + " "
        assert score(f"{pii.CONTEXT[kind].split()[0]} {far}{span}") == none


def test_long_runs_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1 " * 150_000, "+1" * 150_000, "a@" * 150_000, "1." * 150_000, "A1" * 150_000, "-" * 300_000):
        pii.find_spans(t)


def test_detect_and_redact(spark):
    rows = C.documents() + [(400 + i, t, "en", "s", len(t)) for i, t in enumerate(CASES)]
    df = C.frame(spark, rows, clashing=True)
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    for i, t in enumerate(CASES):
        r = got[400 + i]
        base = plain(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[0] == k for b in base) for k in pii.BASE_KINDS)
        assert len(r.scores) == len([x for x in r.spans.split(",") if x]) and all(0 < x <= 1 for x in r.scores)
    assert got[300].spans == "" == got[301].spans
    clean = pii.redact(df)
    assert clean.schema == df.schema and clean.count() == df.count()
    assert clean.filter("text rlike '@[a-z]+[.]'").isEmpty() and clean.filter("doc_id = 300 and text is null").count() == 1
    assert pii.detect(C.frame(spark, [])).collect() == []
