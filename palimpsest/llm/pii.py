"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) are always reported. The method adds ``iban`` spans (mod-97),
``card`` and ``phone`` spans in notations the base patterns don't take, and ``secret`` spans (values
that a name such as token or password is given, if their characters look random), each only if its
score reaches ``LEAST``; keys of a format that names itself, bearer tokens and PEM blocks are secrets without one. A score is the pattern's weight, plus one step for a passed checksum and one
for a telling word nearby, less one step for a word that speaks against a span without a checksum.

Each text is scanned whole, on its own, in Arrow batches, in time linear in its length: patterns start
at the ends of runs only, repeats are possessive or bounded, and spans are compared by one sweep.
Offsets are code points, ends exclusive.

Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; a null id is
passed on; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table
from .textkit import bounded_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
#: What follows an address's @.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match can only start where a run of digits does: one that starts later lies within it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")

#: Characters of each country's IBAN.
IBAN_LENGTH = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in cs.split()
}
#: The two digits after what may be an IBAN's country.
IBAN_START = re.compile(r"[0-9](?<=[A-Za-z]{2}[0-9])[0-9](?=\x20?[A-Za-z0-9]{4})")
#: What follows them, by the country's length: groups of four, each after a space or none.
IBAN_REST = {n: re.compile(rf"(?i)(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Z0-9])") for n in set(IBAN_LENGTH.values())}
DOTTED_CARD = re.compile(r"(?<![0-9.])[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{3,4}(?![0-9.])")
#: A value of 16 to 512 characters that is set, and the name it is given to, which ends where the sign begins.
VALUE = re.compile(r"(?:[=:][>=]?\x20?|(?<=\x20)is\x20)[\"']?([A-Za-z0-9+/_.-]{16,512}+)={0,2}+(?![A-Za-z0-9+/_=-])")
NAME = re.compile(r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"']?\x20?$")
#: Formats of keys that name themselves, web tokens, and what follows a bearer header.
KEYS = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,255}+|github_pat_[A-Za-z0-9_]{22,255}+|glpat-[A-Za-z0-9_-]{20,64}+|A(?:KI|SI)A[A-Z2-7]{16}|AIza[A-Za-z0-9_-]{35}"
    r"|xox[abprs]-[A-Za-z0-9-]{10,255}+|sk_(?:live|test)_[A-Za-z0-9]{16,255}+|eyJ[A-Za-z0-9_-]{8,1024}+\.eyJ[A-Za-z0-9_-]{4,4096}+\.[A-Za-z0-9_-]{16,1024}+)(?![A-Za-z0-9_-])"
    r"|(?i:(?<=bearer ))[A-Za-z0-9+/_.-]{16,4096}+={0,2}+(?![A-Za-z0-9+/_=-])"
)
#: A text without any of these has none of them.
KEY_SIGNS = ("_", "glpat-", "AKIA", "ASIA", "AIza", "xox", "eyJ", "earer ", "EARER ")
PEM = re.compile(r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\s]{32,16384}+-----END (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----")
#: Bits a character from which a value counts as random.
RANDOM_BITS = 3.0
LOCAL_PHONE = re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])")
#: Context words and the characters around a span that are searched for them.
FOR = {
    "iban": re.compile(r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b"),
    "card": re.compile(r"(?i)\b(?:card|visa|credit|karte|carte|tarjeta)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|passw|pwd|key|credential|auth)"),
    "phone": re.compile(r"(?i)\b(?:tel|phone|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b"),
}
AGAINST = re.compile(r"(?i)\b(?:example|isbn|order|invoice|version|page)\b")
NEAR = 40
LEAST = 2


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each IBAN: a known country, as many characters as its IBANs have, a passed mod-97. After a miss the search goes on within it."""
    done = 0
    for m in IBAN_START.finditer(text):
        start = m.start() - 2
        size = IBAN_LENGTH.get(text[start : start + 2].upper())
        if size is None or start < done or start and text[start - 1].isascii() and text[start - 1].isalnum():
            continue
        rest = IBAN_REST[size].match(text, m.end())
        if rest and mod97(text[start : rest.end()].replace(" ", "")):
            done = rest.end()
            yield start, done


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the four base patterns; matches that fail their test are dropped, without retries."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # the local part is the run before the @, as far as no earlier match or @ holds it
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def _score(kind: str, text: str, start: int, end: int, weight: int, checked: bool) -> int:
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return weight + checked + bool(FOR[kind].search(around)) - (not checked and bool(AGAINST.search(around)))


def random_looking(value: str) -> bool:
    """Whether a value mixes letters and digits and its characters carry ``RANDOM_BITS`` each."""
    counts = Counter(value)
    bits = sum(n * math.log2(len(value) / n) for n in counts.values()) / len(value)
    return bits >= RANDOM_BITS and any(c.isdigit() for c in counts) and any(c.isalpha() for c in counts)


def added_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans beyond the base ones that score ``LEAST`` or more and overlap none of them."""
    found = [(a, b, "iban", 1, True) for a, b in ibans(text)]
    for m in DOTTED_CARD.finditer(text):
        if luhn(_NOT_DIGIT.sub("", m[0])):
            found.append((m.start(), m.end(), "card", 1, True))
    found += [(m.start(), m.end(), "phone", 1, False) for m in LOCAL_PHONE.finditer(text)]
    if any(sign in text for sign in KEY_SIGNS):
        found += [(m.start(), m.end(), "secret", 2, True) for m in KEYS.finditer(text) if random_looking(m[0])]
    if "PRIVATE KEY-----" in text:
        found += [(m.start(), m.end(), "secret", 2, True) for m in PEM.finditer(text)]
    for m in VALUE.finditer(text):
        if NAME.search(text, max(0, m.start() - NEAR), m.start()) and random_looking(value := m[1].rstrip(".-")):
            found.append((m.start(1), m.start(1) + len(value), "secret", 1, True))
    taken, k, reach, out = sorted(base), 0, 0, []
    for a, b, kind, weight, checked in sorted(found):
        while k < len(taken) and taken[k][0] < b:  # both lists in order: ``reach`` is the furthest end of those that begin before b
            reach, k = max(reach, taken[k][1]), k + 1
        if reach <= a and (not out or out[-1][1] <= a) and _score(kind, text, a, b, weight, checked) >= LEAST:
            out.append((a, b, kind))
    return out


def _order(span: tuple[int, int, str]) -> tuple:
    return span[0], KINDS.index(span[2]) if span[2] in KINDS else len(KINDS), span[2], span[1]


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=_order))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, base_spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        counts, shas, spans, bases = {k: [] for k in KINDS}, [], [], []
        for i in range(batch.num_rows):
            text = texts[i].as_py() or ""
            base = base_spans(text)
            for k in KINDS:
                counts[k].append(sum(x[2] == k for x in base))
            joined = _joined(base)
            bases.append(joined)
            shas.append(hashlib.sha256(joined.encode()).hexdigest())
            spans.append(_joined(base + added_spans(text, base)))
        yield pa.RecordBatch.from_arrays(
            [ids.cast(pa.int64()), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(bases, pa.string())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "base_spans"],
        )


def find(docs: DataFrame) -> DataFrame:
    """Counts and spans for each row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


_SPAN = re.compile(r"(\w+):(\d+):(\d+)")


def redact(text: str | None, spans: str) -> str | None:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans are merged."""
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in ((k, int(a), int(b)) for k, a, b in _SPAN.findall(spans)):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(spark, sf_dir):
    return find(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("base_spans")
