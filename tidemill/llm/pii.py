"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, bounded_batches, session

#: Kinds in the order of output; the first four are the base kinds, which always stay.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = 4

# Each pattern starts where a run of its first characters starts, and runs give nothing back where
# that can't change a match: the same matches as the plain patterns, in time that follows the text.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9[0-9]{2})[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Score before context. Spans beyond the base kinds need LEAST; base kinds carry theirs as information.
START = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
LEAST = 0.5
#: Characters on either side that are searched for context words, and what a word adds or takes.
NEAR = 48
STEP = 0.3
#: Context words for and against each kind.
FOR = {
    "email": ("mail", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
AGAINST = {"ip": ("version", "release", "section"), "card": ("order", "isbn", "tracking"), "phone": ("order", "part no"), "ssn": ("order", "part no", "version")}
_WORDS = {
    sign: {k: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.IGNORECASE) for k, words in table.items()} for sign, table in ((1, FOR), (-1, AGAINST))
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return 15 <= len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL_CHAR:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
            last = found.end()
            at = text.find("@", last)
        else:
            # A later match may not reach back over this sign, as it isn't a local character.
            last, at = at + 1, text.find("@", at + 1)


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    return (m.span() for m in _IBAN.finditer(text) if mod97(m[0]))


def _ssns(text: str):
    return (m.span() for m in _SSN.finditer(text))


#: By kind: what finds spans, and what a text must have for it to find any.
_FIND = {"email": (_emails, "@"), "ip": (_ips, "."), "card": (_cards, ""), "phone": (_phones, "+"), "iban": (_ibans, ""), "ssn": (_ssns, "-")}


def score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - NEAR) : start] + " \n " + text[end : end + NEAR]
    found = sum(sign for sign, table in _WORDS.items() if kind in table and table[kind].search(near))
    return min(1.0, max(0.0, START[kind] + STEP * found))


def find_pii(text: str) -> list[Span]:
    """Spans by kind and then start, in code points, ends exclusive. Base kinds are all kept; the
    others need a checksum or context words that bring their score to LEAST, and may not overlap a base span."""
    digits = _DIGIT.search(text) is not None
    out: list[Span] = []
    ends: list[int] | None = None
    for kind, (find, sign) in _FIND.items():
        if (kind != "email" and not digits) or sign not in text:
            continue
        base = KINDS.index(kind) < BASE
        if not base and ends is None:  # the base spans by start, and the farthest end so far
            starts = sorted((s.start, s.end) for s in out)
            ends = list(accumulate((e for _, e in starts), max))
        for start, end in find(text):
            value = score(kind, text, start, end)
            if not base:
                k = bisect_left(starts, (end,))  # base spans that start before this one ends
                if value < LEAST or (k and ends[k - 1] > start):
                    continue
            out.append(Span(kind, start, end, value))
    return out


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("spans", _TYPE)])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and spans, an array of (kind, start, end, score). Null text: no spans.

    Bytes that aren't UTF-8 count as one replacement character each run. Rows are kept as they are,
    repeated or of null id; an empty table gives no rows.
    """
    bounded_batches(session(docs))

    def run(batches):
        for b in batches:
            spans = [[s._asdict() for s in find_pii(t.decode("utf-8", "replace"))] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _TYPE)], schema=_SCHEMA)

    rows = docs.select(F.col(id_col).cast("long"), binary(text_col))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind string, start long, end long, score double>>")


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted(find_pii(text), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
            at = s.end
    return "".join([*out, text[at:]])


def _scored(spans: Column) -> Column:
    """kind:start:end:score of each span, the score with two digits."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["score"], 2))), ",")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans as a string, and the same with the scores that
    context words have raised or lowered. Null text: none. Rows are kept as they are, repeated or of null id."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:BASE]))
    return pii_spans(docs).select("doc_id", *map(count, KINDS[:BASE]), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(spans).alias("spans"), _scored(spans).alias("scored_spans"))
