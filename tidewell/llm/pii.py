"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs,
digits, address schemes and account cues. At each anchor a deterministic
local parser expands to the whole span and validates it (digit counts, Luhn,
octets, IBAN remainder), so nothing scans the text with a regular expression.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from tidewell.llm.spans import Span, folded, span_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:https?|ftp)://[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?(?:[/?#][^\s<>\"']*)?", re.I)
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_CUED = re.compile(r"[\x20:#=.]*(?:(?:number|no|nr|id)\b[\x20:#=.]*)?([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])", re.I)

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "passport", "ssn", "customer", "konto", "cuenta", "compte")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def finder():
    """Gives the function text -> spans; spans of a kind never overlap."""
    anchors = ahocorasick.Automaton()
    for c in "0123456789":
        anchors.add_word(c, ("digit", 1))
    anchors.add_word("@", ("at", 1))
    anchors.add_word("+", ("plus", 1))
    for s in SCHEMES:
        anchors.add_word(s, ("scheme", len(s)))
    for c in CUES:
        anchors.add_word(c, ("cue", len(c)))
    anchors.add_word("iban", ("iban", 4))
    anchors.make_automaton()

    def find(text: str) -> list[Span]:
        out: list[Span] = []
        email = ip = card = phone = url = account = iban = 0  # where each kind's last match ended
        run_end = 0  # of the digits that the anchor stands in
        for last, (kind, size) in anchors.iter(folded(text)):
            at = last + 1 - size
            if kind == "digit":
                if at >= run_end:
                    run_end = _DIGITS.match(text, at).end() if (m := _DIGITS.match(text, at)) else at
                    start_ip = at
                    if start_ip >= ip and (m := _IP.match(text, at)):
                        ip = m.end()
                        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (g.lstrip("0") for g in m.groups())):  # any run of zeros may lead
                            out.append(("ip", at, ip))
                if at >= card and (m := _CARD.match(text, at)):
                    card = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, card))
            elif kind == "at":
                start = at
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email = m.end()
                    out.append(("email", start, email))
            elif kind == "plus":
                if at >= phone and (m := _PHONE.match(text, at)):
                    phone = m.end()
                    if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        out.append(("phone", at, phone))
            elif kind == "scheme":
                if at >= url and (m := _URL.match(text, at)):
                    url = at + len(m[0].rstrip(".,;:!?)]}"))
                    out.append(("url", at, url))
            elif kind == "cue":
                if at >= account and (m := _CUED.match(text, last + 1)):
                    account = m.end(1)
                    out.append(("account", m.start(1), account))
            elif at >= iban:
                k = last + 1
                while k < len(text) and text[k] in " :#=.":
                    k += 1
                if (m := _IBAN.match(text, k)) and iban_ok(m[0]):
                    iban = m.end()
                    out.append(("iban", k, iban))
        return out

    return find


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind then
    start. Base kinds are the leftmost non-overlapping matches of their kind
    that pass validation; url, iban and account spans come on top. A null
    text is empty and has no spans. Other columns are ignored.
    """
    rank = {k: i for i, k in enumerate(KINDS)}
    return span_table(docs, finder, BASE, lambda x: (rank[x[0]], x[1]))
