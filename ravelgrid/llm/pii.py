"""Personal data by patterns, checksums and context (operator 6).

Regular expressions propose spans, validators confirm them (octet range for
addresses, Luhn for cards, country length and mod-97 for IBANs, digit counts
for phone numbers), and words near a span move its score up or down, for every
kind.  Positions are code points.

Kinds: ``email ip card phone`` are the base kinds of fixed definition; the
method adds ``iban`` (mod-97) and ``ident`` -- number groups such as national
identifiers, proposed by shape.  Spans of the added kinds are reported where
their score reaches the threshold, which an ``ident`` only does with context.
Context never removes a base span; its score says what context makes of it.

Every matcher is anchored so that it reads a text once: e-mails start from
each ``@``, number patterns only where no digit precedes.

Defined results: null and empty texts have no spans; very long texts are read
whole; every row gets its own result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from ravelgrid.llm.common import id_and_text

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ident")
THRESHOLD = 0.6
WINDOW = 48  # code points to either side that count as context

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}")
_IDENT = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Lengths of account numbers by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22"
    " GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22"
    " MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29"
    " VA22 VG24 XK20"
)
_IBAN_REST = {c[:2]: re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (int(c[2:]) - 4)) for c in IBAN_LENGTHS.split()}
#: Words that speak for a kind when they stand near.
CONTEXT = {
    "email": "mail email e-mail contact kontakt correo courriel write schreiben",
    "ip": "ip host server address adresse client login logged connection router gateway",
    "card": "card credit debit visa mastercard karte kreditkarte tarjeta carte payment pay",
    "phone": "phone tel telephone call mobile fax telefon teléfono téléphone whatsapp",
    "iban": "iban account konto compte cuenta bank bic swift",
    "ident": "ssn social security identity passport ident personal ausweis identidad",
}
#: Words that speak against a kind when they stand near.
AGAINST = {
    "email": "example noreply no-reply", "ip": "version release section chapter build", "card": "serial isbn tracking order",
    "phone": "isbn serial order", "iban": "serial example", "ident": "part serial version model order",
}
#: Score of a proposed span without context, and what context words add or take.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ident": 0.4}
FOR, MINUS = 0.2, 0.2


def _any_of(words: str) -> re.Pattern:
    return re.compile(r"(?i)(?<!\w)(?:" + "|".join(map(re.escape, words.split())) + r")(?!\w)")


_FOR = {k: _any_of(v) for k, v in CONTEXT.items()}
_AGAINST = {k: _any_of(v) for k, v in AGAINST.items()}


def _emails(text: str):
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ibans(text: str):
    floor = 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.get(m[1]) if m.start() >= floor else None
        if rest and (end := rest.match(text, m.end())) and mod97(text[m.start() : end.end()]):
            floor = end.end()
            yield m.start(), floor


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW) : start] + " | " + text[end : end + WINDOW]
    return round(PRIOR[kind] + FOR * bool(_FOR[kind].search(near)) - MINUS * bool(_AGAINST[kind].search(near)), 2)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as listed in KINDS, then start."""
    out = []
    for start, end in _emails(text):
        out.append(("email", start, end))
    if not _DIGIT.search(text):
        return [(k, a, b, _score(k, text, a, b)) for k, a, b in out]
    for m in _IP.finditer(text):
        if all(_small(p) for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0]) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    out.extend(("iban", a, b) for a, b in _ibans(text))
    if "-" in text:
        out.extend(("ident", *m.span()) for m in _IDENT.finditer(text))
    scored = [(k, a, b, _score(k, text, a, b)) for k, a, b in out]
    return [s for s in scored if s[0] in BASE_KINDS or s[3] >= THRESHOLD]


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def _detect(batches):
    for batch in batches:
        n = {k: [] for k in BASE_KINDS}
        shas, all_, scores = [], [], []
        for text in batch.column(1).to_pylist():
            spans = find_spans(text)
            for k in BASE_KINDS:
                n[k].append(sum(s[0] == k for s in spans))
            shas.append(hashlib.sha256(_joined([s for s in spans if s[0] in BASE_KINDS]).encode()).hexdigest())
            all_.append(_joined(spans))
            scores.append([s[3] for s in spans])
        yield pa.record_batch(
            [batch.column(0), *(pa.array(n[k], pa.int64()) for k in BASE_KINDS), pa.array(shas, pa.string()), pa.array(all_, pa.string()), pa.array(scores, pa.list_(pa.float64()))],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores"],
        )


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and their scores (in the spans' order) of every document."""
    return id_and_text(docs).mapInArrow(
        _detect, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"
    )


def mask(text: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    spans = sorted(find_spans(text), key=lambda s: (s[1], -s[2]))
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` (null stays null); ``n_chars``, where present, follows."""
    at = docs.columns.index("text")
    size_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for batch in batches:
            old = batch.column(at).to_pylist()
            new = [t if t is None else mask(t) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if size_at is not None:
                sizes = [s if a is b or a == b else len(b) for s, a, b in zip(columns[size_at].to_pylist(), old, new)]
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
