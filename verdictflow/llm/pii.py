"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
scheme separators and identifier cues. A local parser per kind expands an anchor to
the boundaries of its item and validates it. Every parser reads a character a bounded
number of times, so the work is linear in the text.

Kinds: ``email``, ``ip`` (parts to 255), ``card`` (14 to 19 digits, Luhn), ``phone``
(plus sign, 10 to 15 digits), ``url`` (scheme and host) and ``account`` (an IBAN, or
the 6 to 17 digit number that follows a cue).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE_KINDS = KINDS[:4]
CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")

# Possessive quantifiers: a parser never goes back over what it has read.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]++")
_HOST = re.compile(r"[^\s<>\"'`{}|\\^\[\]]++")
_IBAN = re.compile(r"([A-Z]{2}[0-9]{2})((?:\x20?[A-Z0-9]{1,4}){3,8})(?![A-Za-z0-9])")
_AFTER_CUE = re.compile(r"(?:\x20?(?:no|nr|number|num)\b\.?)?[\x20:#=.]{0,3}", re.IGNORECASE)
_ACCOUNT = re.compile(r"[0-9]{6,17}(?![0-9A-Za-z])")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

SPANS = "array<struct<kind string, start int, end int>>"


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for digit in "0123456789":
        found.add_word(digit, "digit")
    found.add_word("@", "at")
    found.add_word("+", "plus")
    found.add_word("://", "scheme")
    for cue in CUES:
        for form in (cue, cue.title(), cue.upper()):
            found.add_word(form, "cue")
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def find_spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) by start, then kind."""
    spans: list[tuple[int, int, int]] = []
    email = digits = ip = card = url = 0  # where the last item of each kind ends
    for last, anchor in automaton.iter(text):
        if anchor == "digit":
            if last >= card:
                card = last + 1
                if m := _CARD.match(text, last):
                    card = m.end()
                    number = re.sub("[ -]", "", m[0])
                    if 14 <= len(number) <= 19 and _luhn(number):
                        spans.append((last, 2, card))
            if last >= digits and last >= ip:
                digits = _DIGITS.match(text, last).end()
                if m := _IP.match(text, last):
                    ip = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                        spans.append((last, 1, ip))
        elif anchor == "at":
            if m := _DOMAIN.match(text, last + 1):
                start = last
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                if start < last:
                    email = m.end()
                    spans.append((start, 0, email))
        elif anchor == "plus":
            if (m := _PHONE.match(text, last)) and len(item := m[0].rstrip(" ().-")) >= 4:
                if 10 <= sum(map(str.isdecimal, item)) <= 15:
                    spans.append((last, 3, last + len(item)))
        elif anchor == "scheme":
            start = last - 2
            while start > url and text[start - 1] in _SCHEME:
                start -= 1
            while start < last - 2 and not text[start].isalpha():
                start += 1
            if start < last - 2 and (m := _HOST.match(text, last + 1)):
                host = m[0].rstrip(".,;:!?)")
                if host and host[0].isalnum():
                    url = last + 1 + len(host)
                    spans.append((start, 4, url))
        else:
            begin = _AFTER_CUE.match(text, last + 1).end()
            if (m := _IBAN.match(text, begin)) and _iban(m[0].replace(" ", "")) or (m := _ACCOUNT.match(text, begin)):
                spans.append((m.start(), 5, m.end()))
    return sorted(set(spans))


def pii_spans(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``id_column`` and ``spans``, by start, then kind as in ``KINDS``.

    Starts and ends are code points of the whole text, end exclusive. Items of one kind
    don't overlap; items of two kinds may. Null and empty texts have no spans. Rows are
    independent: repeated rows give repeated results, null ids stay, other columns are
    not read, and an empty table gives no rows.
    """
    schema = documents.select(F.col(id_column), F.lit(None).cast(SPANS).alias("spans")).schema
    kinds = pa.array(KINDS)

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            offsets, kind, start, end = [0], [], [], []
            for text in batch.column(1):
                for a, k, b in find_spans(text.as_py() or "", automaton):
                    start.append(a), kind.append(k), end.append(b)
                offsets.append(len(start))
            items = pa.StructArray.from_arrays(
                [kinds.take(pa.array(kind, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                ["kind", "start", "end"],
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)],
                [id_column, "spans"],
            )

    return documents.select(F.col(id_column), F.col(text_column)).mapInArrow(spans, schema)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
