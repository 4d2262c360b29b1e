"""Personal data by anchor expansion.

One Aho-Corasick pass over each text finds anchors (at-signs, plus-signs, digits, schemes, identifier
cues); local parsers expand each anchor to the boundaries of an email, address, card, phone or account and
validate it. The four base kinds follow these rules (leftmost, non-overlapping per kind, failing matches
dropped without a retry):

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+){3}, parts at most 255
    card   [0-9]([ -]?[0-9])+, 14 to 19 digits, Luhn
    phone  \\+[0-9][ ().0-9-]+[0-9], 10 to 15 digits

The method adds kinds: `iban` (mod-97 checked account), `ssn` (nine digits after a cue) and `login`
(credentials in a URL's authority). A null text is empty and has no spans. Offsets are code points.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Character classes of the base rules.
DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
PHONE = frozenset(" ().0123456789-")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "login", "ssn")
ORDER = {k: i for i, k in enumerate(KINDS)}
#: Cues before account and identity numbers.
CUES = {"IBAN": "iban", "iban": "iban", "Iban": "iban", "SSN": "ssn", "ssn": "ssn", "social security": "ssn", "Social Security": "ssn", "://": "login"}

Span = tuple[str, int, int]


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in ("@", "+"):
        found.add_word(mark, mark)
    for d in sorted(DIGITS):
        found.add_word(d, "0")
    for cue, kind in CUES.items():
        found.add_word(cue, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _email(text: str, at: int, after: int) -> tuple[int, int] | None:
    """Expand an at-sign both ways; `after` is where the previous email ended."""
    lo = at
    while lo > after and text[lo - 1] in LOCAL:
        lo -= 1
    if lo == at:
        return None
    n, hi, end = len(text), at + 1, 0
    while True:
        begin = hi
        while hi < n and text[hi] in LABEL:
            hi += 1
        if hi == begin:
            break
        end = hi
        if hi >= n or text[hi] != ".":
            break
        hi += 1
    # a trailing dot belongs to the sentence: `end` is after the last whole label
    labels = text.count(".", at + 1, end)
    return (lo, end) if end and labels else None


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    n = len(text)
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return None
    hi = plus + 2
    while hi < n and text[hi] in PHONE:
        hi += 1
    while hi > plus + 3 and text[hi - 1] not in DIGITS:
        hi -= 1
    if hi <= plus + 3:
        return None
    count = sum(c in DIGITS for c in text[plus:hi])
    return (plus, hi) if 10 <= count <= 15 else None


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _dotted(text: str, at: int, out: list[Span]) -> int:
    """Digit runs joined by single dots, from the first digit; four runs at a time are addresses."""
    n, pos, runs = len(text), at, []
    while True:
        begin = pos
        while pos < n and text[pos] in DIGITS:
            pos += 1
        runs.append((begin, pos))
        if pos + 1 < n and text[pos] == "." and text[pos + 1] in DIGITS:
            pos += 1
        else:
            break
    for i in range(0, len(runs) - 3, 4):
        if all(_small(text[a:b]) for a, b in runs[i : i + 4]):
            out.append(("ip", runs[i][0], runs[i + 3][1]))
    return pos


def _chain(text: str, at: int, out: list[Span]) -> int:
    """Digits with single spaces or hyphens between: a card if the digits pass."""
    n, pos, digits = len(text), at, []
    while True:
        digits.append(text[pos])
        if pos + 1 < n and text[pos + 1] in DIGITS:
            pos += 1
        elif pos + 2 < n and text[pos + 1] in " -" and text[pos + 2] in DIGITS:
            pos += 2
        else:
            break
    if 14 <= len(digits) <= 19 and luhn("".join(digits)):
        out.append(("card", at, pos + 1))
    return pos + 1


IBAN_GAP = re.compile(r"[ :#.=-]{0,4}")
SSN = re.compile(r"[ :#.=a-z]{0,12}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")


def _iban(text: str, after: int) -> tuple[int, int] | None:
    lo = IBAN_GAP.match(text, after).end()
    raw, pos, best = [], lo, None
    while pos < len(text) and len(raw) < 34:
        c = text[pos]
        if c in ALNUM:
            raw.append(c)
            if len(raw) >= 15:
                s = "".join(raw)
                if s[:2].isalpha() and s[2:4].isdigit() and int("".join(str(int(x, 36)) for x in s[4:] + s[:4])) % 97 == 1:
                    best = (lo, pos + 1)
        elif c != " " or not raw or text[pos - 1] == " ":
            break
        pos += 1
    return best


def _login(text: str, after: int) -> tuple[int, int] | None:
    """user:password@ after a scheme."""
    pos, colon = after, -1
    while pos < len(text) and (c := text[pos]) not in "@/?# \t\n\r\"'<>":
        if c == ":" and colon < 0:
            colon = pos
        pos += 1
    if pos < len(text) and text[pos] == "@" and after < colon < pos - 1:
        return after, pos
    return None


def spans(text: str | None, machine: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    out: list[Span] = []
    email_end = phone_end = dotted_end = chain_end = 0
    for last, what in machine.iter(text):
        if what == "0":
            if last >= dotted_end:
                dotted_end = _dotted(text, last, out)
            if last >= chain_end:
                chain_end = _chain(text, last, out)
        elif what == "@":
            if hit := _email(text, last, email_end):
                out.append(("email", *hit))
                email_end = hit[1]
        elif what == "+":
            if last >= phone_end:
                if hit := _phone(text, last):
                    out.append(("phone", *hit))
                    phone_end = hit[1]
        else:
            if what == "iban":
                hit = _iban(text, last + 1)
            elif what == "login":
                hit = _login(text, last + 1)
            else:
                m = SSN.match(text, last + 1)
                hit = m.span(1) if m else None
            if hit:
                out.append((what, *hit))
    return sorted(set(out), key=lambda s: (s[1], ORDER[s[0]], s[2]))


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """The kept columns, counts of base kinds, base_sha256 and spans for each row."""
    from pyspark.sql import functions as F

    rows = docs.select(*keep, F.col("text").alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        machine = automaton()
        for batch in batches:
            cols: dict[str, list] = {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
            for text in batch.column(len(names)).to_pylist():
                found = spans(text, machine)
                base = [s for s in found if s[0] in BASE]
                for k in BASE:
                    cols[f"n_{k}"].append(sum(s[0] == k for s in base))
                cols["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols["spans"].append(joined(found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in cols.items())], [*names, *cols])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, schema + ", n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
