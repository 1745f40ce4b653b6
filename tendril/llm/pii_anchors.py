"""Personal data by anchor expansion.

One Aho-Corasick automaton runs over a text and reports anchors: at-signs,
plus signs, digits, digit-dot pairs, URL schemes and words that announce an
identifier.  A deterministic local parser then expands each anchor to the
borders of its candidate and validates it.  Nothing else of the text is
looked at, and no character is expanded over twice by one parser.

Base kinds (``email``, ``ip``, ``card``, ``phone``) have the spans that a
leftmost, non-overlapping search for their pattern would give.  Further kinds:

* ``login``: user and password in a URL, up to the at-sign;
* ``iban``: an account number with valid length and check digits (modulo 97)
  behind a cue such as ``IBAN``;
* ``account``: 6 to 17 digits behind a cue such as ``account no``;
* ``ssn``: a number of the form 3-2-4 behind its cue, impossible areas left out.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendril.llm.common import joined_spans, text_udf

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "login", "iban", "account", "ssn"]

DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++@(?=[A-Za-z0-9\[])")
#: Between a cue and its number.
GAP = re.compile(r"(?:[\x20\t]*+(?:no|nr|number|id)\b\.?)?[\x20\t:=#]++", re.ASCII | re.IGNORECASE)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
ACCOUNT = re.compile(r"[0-9]{6,17}(?![0-9A-Za-z])")
SSN = re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")

#: Words that announce an identifier; letters in either case.
CUES = {
    "iban": "iban",
    "account": "account",
    "acct": "account",
    "konto": "account",
    "compte": "account",
    "cuenta": "account",
    "ssn": "ssn",
    "social security": "ssn",
}


def automaton():
    """Anchors to the parser that they start."""
    import ahocorasick

    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    found.add_word("://", ("login", 3))
    for d in DIGITS:
        found.add_word(d, ("card", 1))
        found.add_word(f"{d}.", ("ip", 2))
    for cue, kind in CUES.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """The text in lower case, place by place: the two other characters that would become
    ASCII letters (one of them as two characters) are blotted out."""
    return text.replace("\u0130", "\0").replace("\u212a", "\0").lower()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def valid_iban(text: str) -> bool:
    raw = text.replace(" ", "")
    if not 15 <= len(raw) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Longest valid number that begins at ``start``, cut between characters; None without one."""
    for stop in range(end, start + 14, -1):
        if text[stop - 1] != " " and (stop == len(text) or not text[stop].isalnum()) and valid_iban(text[start:stop]):
            return stop
    return None


def scan(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as in KINDS, then start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the last candidate of a kind ended
    for last, (kind, size) in anchors.iter(lowered(text)):
        at = last - size + 1
        if kind == "card":
            if at >= done["card"] and (m := CHAIN.match(text, at)):
                done["card"] = m.end()
                if m.end() - at >= 16 and 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
                    found["card"].append((at, m.end()))
        elif kind == "ip":
            if at >= done["ip"]:
                s = at
                while s > done["ip"] and text[s - 1] in DIGITS:
                    s -= 1
                if m := QUAD.match(text, s):
                    done["ip"] = m.end()
                    if all(len(p := g.lstrip("0")) < 4 and int(p or 0) <= 255 for g in m.groups()):
                        found["ip"].append((s, m.end()))
        elif kind == "email":
            s = at
            while s > done["email"] and text[s - 1] in LOCAL:
                s -= 1
            if s < at and (m := DOMAIN.match(text, last + 1)):
                done["email"] = m.end()
                found["email"].append((s, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 8 <= len(only_digits(m[0])) <= 15:
                    found["phone"].append((at, m.end()))
        elif kind == "login":
            if at > 0 and text[at - 1].isalpha() and (m := LOGIN.match(text, last + 1)):
                found["login"].append((m.start(), m.end() - 1))
        elif at == 0 or not text[at - 1].isalnum():
            gap = GAP.match(text, last + 1)
            s = gap.end() if gap else last + 1
            if s < done[kind] or not gap:
                continue
            if kind == "iban" and (m := IBAN.match(text, s)):
                if end := iban_end(text, s, m.end()):
                    done["iban"] = end
                    found["iban"].append((s, end))
            elif kind == "account" and (m := ACCOUNT.match(text, s)):
                done["account"] = m.end()
                found["account"].append((s, m.end()))
            elif kind == "ssn" and (m := SSN.match(text, s)):
                done["ssn"] = m.end()
                found["ssn"].append((s, m.end()))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def spans_column(text: Column) -> Column:
    """``array<struct<kind,start,end>>`` of a text column; null texts have none."""

    def make() -> Callable:
        anchors = automaton()
        return lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in (scan(t, anchors) if t else [])]

    return text_udf("array<struct<kind:string,start:int,end:int>>", make)(text)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs(doc_id, text)``; other columns are ignored,
    null and empty texts have no spans, repeated rows each give a row."""
    return docs.select("doc_id", spans_column(F.col("text")).alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlaps give one mark."""
    out, at, starts = [], 0, sorted(spans, key=lambda s: (s[1], -s[2]))
    for k, s, e in starts:
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def personal_data_digests(docs: DataFrame) -> DataFrame:
    found = find_personal_data(docs)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans(base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )
