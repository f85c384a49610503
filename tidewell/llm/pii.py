"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import small_batches

#: In the order in which kinds of equal start are listed.
KINDS = ["email", "ip", "card", "phone", "iban", "id"]

# A match of ip cannot begin inside a run of digits, nor one of email outside a run of its own characters:
# both are tried only where they can begin, which keeps long runs linear.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Words that raise the score of a kind when they stand within NEAR characters before a span, or 20 after it.
CONTEXT = {
    "email": ["mail", "contact", "write", "kontakt", "correo", "courriel"],
    "ip": ["ip", "server", "host", "address", "ping", "adresse"],
    "card": ["card", "visa", "credit", "karte", "tarjeta", "carte"],
    "phone": ["phone", "call", "tel", "mobile", "telefon", "telefono"],
    "iban": ["iban", "account", "bank", "konto", "cuenta", "compte"],
    "id": ["ssn", "social", "security", "passport", "ausweis"],
}
#: Words that lower it.
AGAINST = {"ip": ["version", "release"], "card": ["isbn", "order", "serial", "tracking"], "phone": ["isbn"], "id": ["part", "serial"], "email": [], "iban": []}
NEAR = 40
BASE_SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "id": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def _emails(text: str):
    """Leftmost matches of _EMAIL. Runs of its characters are told apart first; within one, a match begins just before an @."""
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _EMAIL.match(text, lo) if lo < at else None
        if m:
            yield m.span()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four base kinds."""
    out = [(a, "email", b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in (x.lstrip("0")[:4] or "0" for x in m[0].split("."))):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return out


def _score(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - NEAR) : start] + " " + text[end : end + 20]).lower()
    s = BASE_SCORE[kind] + 0.3 * any(w in around for w in CONTEXT[kind]) - 0.3 * any(w in around for w in AGAINST[kind])
    return round(min(1.0, max(0.0, s)), 2)


def find_spans(text: str | None, least: float = 0.5) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score), sorted. Base kinds stay whatever their score; added kinds need `least`."""
    if not text:
        return []
    out = [(a, k, b, _score(text, k, a, b)) for a, k, b in base_spans(text)]
    for kind, pattern, valid in (
        ("iban", _IBAN, lambda s: mod97(s.replace(" ", ""))),
        ("id", _ID, lambda s: s[:3] not in ("000", "666") and s[4:6] != "00" and s[7:] != "0000")
    ):
        for m in pattern.finditer(text):
            if valid(m[0]) and (s := _score(text, kind, m.start(), m.end())) >= least:
                out.append((m.start(), kind, m.end(), s))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b, _ in spans)


def redact(text: str | None, spans) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b, _ in spans:
        if a >= at:
            out.append(text[at:a] + f"<{k}>")
        at = max(at, b)
    return "".join(out) + text[at:]


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def find_personal_data(docs: DataFrame, least: float = 0.5, with_text: bool = False) -> DataFrame:
    """Personal data of every whole text of docs (doc_id, text).

    Returns doc_id, the counts of the base kinds, base_sha256, spans
    (kind:start:end in code points, by start) and their scores; with_text adds
    redacted. A null or empty text has no spans and a null or empty redaction.
    Each row is judged alone: repeated rows repeat; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            counts, digests, spans, scores, clean = {k: [] for k in KINDS[:4]}, [], [], [], []
            for t in b.column("text"):
                t = t.as_py()
                found = find_spans(t, least)
                base = [x for x in found if x[1] in KINDS[:4]]
                for k, c in counts.items():
                    c.append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(found))
                scores.append([x[3] for x in found])
                if with_text:
                    clean.append(redact(t, found))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts.values()), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64())), *([pa.array(clean, pa.string())] if with_text else [])],
                names=["doc_id", *(f"n_{k}" for k in counts), "base_sha256", "spans", "scores", *(["redacted"] if with_text else [])],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, OUT + ", redacted string" * with_text)
