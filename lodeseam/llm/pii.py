"""Personal data: regular expressions propose spans, checksums confirm them, context words weigh them."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "pan", "ssn")
KINDS = BASE + ADDED
THRESHOLD = 0.5
CONTEXT_CHARS = 60

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does, so looking behind keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = re.compile(r"[^0-9]+")
#: Letters count from 10 in the check digits of an IBAN.
_VALUES = {ord(c): str(int(c, 36)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}

#: Score without context, and words nearby that raise it by 0.3.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "pan": 0.3, "ssn": 0.3}
_CONTEXT = {
    "email": r"e-?mail|contact|write|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|credit|visa|mastercard|karte|carte|tarjeta|payment",
    "phone": r"phone|call|tel\b|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "pan": r"card|credit|amex|diners|karte|carte|tarjeta|payment",
    "ssn": r"ssn|social|security",
}
CONTEXT = {k: re.compile(v, re.IGNORECASE) for k, v in _CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the check digits of a compact IBAN hold."""
    return int((iban[4:] + iban[:4]).translate(_VALUES)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # Each match holds exactly one @, so the matches are found from their @ in order.
    end, at = 0, text.find("@")
    while at >= 0:
        before = text[end:at]
        start = end + len(before.rstrip(_LOCAL))
        found = start < at and _DOMAIN.match(text, at + 1)
        following = text.find("@", at + 1)
        if found:
            yield start, found.end()
            end = found.end()
        else:
            end = at + 1
        at = following


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    # A match may have taken in words or numbers that follow, so its last groups are left out one by one until the digits hold.
    m = _IBAN.search(text)
    while m:
        start, end = m.span()
        while end > start and not (15 <= len(compact := text[start:end].replace(" ", "")) <= 34 and mod97(compact)):
            end = text.rfind(" ", start, end)
        if end > start:
            yield start, end
        m = _IBAN.search(text, end if end > start else start + 1)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and (not part or int(part) < 256)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """kind, start, end (in code points, end exclusive) and score, by kind as in KINDS, then by start."""
    out: list[tuple[str, int, int]] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        pans = []
        for m in _CARD.finditer(text):
            if 13 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and luhn(digits):
                (out if len(digits) > 15 else pans).append(("card" if len(digits) > 15 else "pan", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
        out += [("iban", a, b) for a, b in _ibans(text)]
        out += pans
        if "-" in text:
            out += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    spans = []
    for kind, a, b in out:
        near = text[max(0, a - CONTEXT_CHARS) : a] + "\n" + text[b : b + CONTEXT_CHARS]
        score = round(PRIOR[kind] + 0.3 * bool(CONTEXT[kind].search(near)), 2)
        # What only the method adds has to reach the threshold.
        if kind in BASE or score >= THRESHOLD:
            spans.append((kind, a, b, min(1.0, score)))
    return spans


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (kind, start, end, score) of each row of docs(doc_id, text).

    A null text counts as empty and has no spans. Ties don't arise: spans of one kind don't overlap.
    Spans of different kinds may. Repeated rows are searched one by one; other columns are
    not read. Time is linear in the length of a text. Each row is on its own: no shuffle.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_spans(t)] for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(found, pa.list_(_SPAN))], ["doc_id", "text", "spans"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, spans array<struct<kind:string,start:int,end:int,score:double>>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(search, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in brackets; of overlapping spans the first, longest one."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                parts, end = [], 0
                for k, a, b, _ in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
                    if a >= end:
                        parts += [text[end:a], f"[{k}]"]
                        end = b
                texts.append("".join([*parts, text[end:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(mask, f"doc_id {kind}, text string")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Of each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores. Rules as pii_spans()."""

    def joined(spans: list, kinds: tuple[str, ...]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in kinds)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find_spans(t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in found], pa.int64()) for k in BASE]
            base = [hashlib.sha256(joined(spans, BASE).encode()).hexdigest() for spans in found]
            every = [joined(spans, KINDS) for spans in found]
            scores = [",".join(f"{s[3]:.2f}" for s in spans) for spans in found]
            columns = [batch.column("doc_id"), *counts, *(pa.array(x, pa.string()) for x in (base, every, scores))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "scores"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, scores string"
    return docs.select(F.col("doc_id"), text_of().alias("text")).mapInArrow(digest, schema)


def op8_pii(spark, sf_dir):
    return pii_digest(table(spark, sf_dir, "documents"))
