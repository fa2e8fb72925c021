"""Personal data, found in the text as it stands and behind disguises, with offsets in the source text.

A transducer rewrites a text and notes, for every rewritten place, the source characters it stands for:
homoglyphs and zero-width characters, spelled digits, and "at" and "dot" written out. The same patterns
then read the rewritten text, and what they find is mapped back. Spans that overlap none of the same
kind in the plain text are added to those.

Offsets are code points, the end exclusive. Null and empty texts have no spans. Every pattern runs in
time linear in the text. Rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, with_plain_names

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
# A match can only begin where a run of digits does, so the look-behind leaves the matches as they are.
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_digit = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48 << (k & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted; matches are leftmost and do not overlap others of their kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", at + 1)
    if _digit.search(text):
        for m in _ip.finditer(text):
            if all(len(x := p.lstrip("0")) < 4 and int(x or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _card.finditer(text):
            if m.end() - m.start() >= 12:
                d = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 9 <= len(_digit.findall(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# Characters that look like ASCII ones, each with the character it stands for.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "。": ".", "․": ".", "﹒": ".", "·": ".", "﹫": "@", " ": " ", " ": " ", " ": " ",
}
# Characters without width.
INVISIBLE = "­​‌‍⁠﻿"
# Digit words.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}

_looks = {**LOOKALIKES, **{chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}, **dict.fromkeys(INVISIBLE, "")}
_strange = re.compile("[" + re.escape("".join(_looks)) + r"]|(?![0-9])\d")
_number = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_spelled = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s,.-]{{1,3}})?(?:(?:{_number}|[0-9])[\s,.-]{{1,3}}){{6,}}(?:{_number}|[0-9])(?!\w)", re.I)
_spelled_part = re.compile(rf"(?:plus|\+)[\s,.-]{{1,3}}|(?:{_number})[\s,.-]{{0,3}}|[0-9][\s,.-]{{0,3}}", re.I)
# Digit words among groups of digits; a run counts if it has a word and, rewritten, at least seven digits.
_mixed = re.compile(rf"(?<!\w)(?:(?:plus|\+)[\s,.-]{{1,3}})?(?:(?:{_number}|[0-9]++)[\s,.-]{{1,3}})+(?:{_number}|[0-9]++)(?!\w)", re.I)
_mixed_part = re.compile(rf"(?:plus|\+)[\s,.-]{{1,3}}|(?:{_number}|[0-9]+)[\s,.-]{{0,3}}", re.I)
_word = re.compile(r"\w+").findall
_words = re.compile(r"\w+").finditer
_number_part = re.compile(r"[0-9]+").fullmatch
_seven = re.compile(r"[0-9](?:[\s,.-]{1,3}[0-9]){6}").search
_apart = re.compile(r"[\s,.-]{1,3}").fullmatch
# Conditions without which there is nothing to rewrite.
_hint = re.compile(rf"\b(?:{_number})\b", re.I)
_dot_hint = re.compile(r"[(\[{<]\s?at\s?[)\]}>]|\bdot\b", re.I)
_bracket_at = re.compile(r"[(\[{<]\s?at\s?[)\]}>]", re.I).search
_dressed = re.compile(
    r"(?<=[A-Za-z0-9])\s{0,3}[(\[{<]\s?(?P<word>at|dot)\s?[)\]}>]\s{0,3}(?=[A-Za-z0-9])"
    r"|(?<=[A-Za-z0-9])\s{1,3}(?P<at>at)\s{1,3}(?=[A-Za-z0-9-]+(?:\s{1,3}|\s{0,3}[(\[{<]\s?)dot(?:\s|\s?[)\]}>]))"
    r"|(?<=[A-Za-z0-9])\s{1,3}(?P<dot>dot)\s{1,3}(?=[A-Za-z0-9])",
    re.I,
)


class Rewritten:
    """A text with, for each piece that was rewritten, where it stands now and in the source."""

    def __init__(self, text: str) -> None:
        self.text, self.now, self.then, self.same = text, [0], [0], [True]

    def apply(self, pieces: list[tuple[int, int, str]]) -> Rewritten:
        """Replaces (start, end, new) pieces of the current text, sorted and apart."""
        if not pieces:
            return self
        old, out, at, size = self, [], 0, 0
        new = Rewritten("")
        new.now, new.then, new.same = [], [], []
        cuts = sorted({*(x for s, e, _ in pieces for x in (s, e)), *self.now, len(self.text)} | {0})
        k = 0
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            while k < len(pieces) and pieces[k][1] <= lo and pieces[k][0] < lo:
                k += 1
            inside = k < len(pieces) and pieces[k][0] <= lo < pieces[k][1]
            src = old.source(lo)
            if inside:
                if lo == pieces[k][0]:
                    new.now.append(size), new.then.append(src), new.same.append(False)
                    out.append(pieces[k][2])
                    size += len(pieces[k][2])
            else:
                new.now.append(size), new.then.append(src), new.same.append(old.is_same(lo))
                out.append(old.text[lo:hi])
                size += hi - lo
        new.now.append(size), new.then.append(old.source(len(old.text))), new.same.append(True)
        new.text = "".join(out)
        return new

    def is_same(self, at: int) -> bool:
        return self.same[bisect_right(self.now, at) - 1]

    def source(self, at: int) -> int:
        """Where the character at ``at`` begins in the source."""
        k = bisect_right(self.now, at) - 1
        return self.then[k] + (at - self.now[k] if self.same[k] else 0)

    def source_end(self, end: int) -> int:
        """Where the last character before ``end`` ends in the source."""
        k = bisect_right(self.now, end - 1) - 1
        if self.same[k]:
            return self.then[k] + end - self.now[k]
        return self.then[k + 1] if k + 1 < len(self.then) else self.then[k]


def _ascii_digit(c: str) -> str:
    found = _looks.get(c)
    return found if found is not None else str(unicodedata.digit(c, "")) or c


def _digits_said(text: str) -> bool:
    """Whether seven single digits, or a digit word and another number, follow each other: without that the patterns of spelled digits match nothing."""
    if _seven(text):
        return True
    low = text.lower()
    if DIGIT_WORDS.keys().isdisjoint(_word(low)):
        return not text.isascii() and any(c in text for c in "İıſ\u212a")  # letters that patterns take for ASCII ones
    before, end = "", -9
    for m in _words(low):
        own = "w" if m[0] in DIGIT_WORDS else "n" if _number_part(m[0]) else ""
        if own and before and "w" in own + before and _apart(low, end, m.start()):
            return True
        before, end = own, m.end()
    return not text.isascii() and any(c in text for c in "İıſ\u212a")


def _pieces(text: str, run: re.Pattern, part: re.Pattern) -> list[tuple[int, int, str]]:
    pieces = []
    for m in run.finditer(text):
        own = []
        for p in part.finditer(text, m.start(), m.end()):
            bare = p[0].rstrip(" \t\n\r,.-").lower()
            own.append((p.start(), p.start() + len(bare) if p.end() == m.end() else p.end(), {"plus": "+", "+": "+"}.get(bare) or DIGIT_WORDS.get(bare, bare)))
        if run is _spelled or (sum(len(x) for *_, x in own if x != "+") >= 7 and _hint.search(m[0])):
            pieces += own
    return pieces


def _plain_letters(text: str) -> Rewritten:
    """The text with look-alikes and foreign digits as ASCII, and without characters of no width."""
    out = Rewritten(text)
    if not text.isascii():
        there = set(text)
        if not there.isdisjoint(_looks) or any(c.isdecimal() and not c.isascii() for c in there):
            out = out.apply([(m.start(), m.end(), _ascii_digit(m[0])) for m in _strange.finditer(text)])
    return out


def _undressed(out: Rewritten, pieces: list[tuple[int, int, str]]) -> Rewritten:
    """With digits for the words that ``pieces`` are, and then with "at" and "dot" as signs."""
    out = out.apply(pieces)
    if ("dot" in out.text.lower() or _bracket_at(out.text)) and _dot_hint.search(out.text):
        out = out.apply([(m.start(), m.end(), "@" if (m["word"] or m["at"] or m["dot"]).lower() == "at" else ".") for m in _dressed.finditer(out.text)])
    return out


def rewritten(text: str) -> Rewritten | None:
    """The text without disguises, digit words standing alone; None if none is in it."""
    start = _plain_letters(text)
    out = _undressed(start, _pieces(start.text, _spelled, _spelled_part) if _digits_said(start.text) else [])
    return out if out.text is not text else None


def disguised_spans(text: str, plain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans found only after rewriting, in source offsets, none of which overlaps a plain one of its kind."""
    out: list[tuple[int, int, int]] = []
    start = _plain_letters(text)
    said = _digits_said(start.text)
    forms = [_undressed(start, _pieces(start.text, _spelled, _spelled_part) if said else [])]
    if said and (mixed := _pieces(start.text, _mixed, _mixed_part)):
        forms.append(_undressed(start, mixed))
    for new in forms:
        if new.text is text:
            continue
        # What digit words among groups of digits add must not overlap what is found without.
        taken: dict[int, list[tuple[int, int]]] = {}
        for s, k, e in sorted(plain + out):
            taken.setdefault(k, []).append((s, e))
        for s, k, e in plain_spans(new.text):
            a, b = new.source(s), new.source_end(e)
            own = taken.get(k, [])
            i = bisect_right(own, (b, -1))
            if b > a and not (i and own[i - 1][1] > a):
                out.append((a, k, b))
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("disguised", T.BooleanType())])
FIELDS = [("n_email", T.LongType()), ("n_ip", T.LongType()), ("n_card", T.LongType()), ("n_phone", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("found", T.ArrayType(SPAN, False)), ("masked", T.StringType())]


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every stretch of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at, k = [], 0, 0
    spans = sorted(spans)
    while k < len(spans):
        start, kind, end = spans[k]
        while k + 1 < len(spans) and spans[k + 1][0] < end:
            k += 1
            end = max(end, spans[k][2])
        out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at, k = end, k + 1
    return "".join(out) + text[at:]


def find_pii(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, mask: bool = True) -> DataFrame:
    """Appends the columns of ``FIELDS``: counts and digest of the plain spans, all spans, and the masked text (null stays null)."""
    fields = [f for f in FIELDS if mask or f[0] not in ("found", "masked")]

    def make():
        def work(texts: list[bytes], valid) -> list:
            cols: list[list] = [[] for _ in fields]
            for raw, there in zip(texts, valid.to_pylist(), strict=True):
                text = raw.decode()
                plain = plain_spans(text)
                extra = disguised_spans(text, plain)
                every = sorted(plain + extra)
                row = [sum(k == i for _, k, _ in plain) for i in range(4)] + [hashlib.sha256(joined(plain).encode()).hexdigest(), joined(every)]
                if mask:
                    more = set(extra)
                    row += [[{"kind": KINDS[k], "start": s, "end": e, "disguised": (s, k, e) in more} for s, k, e in every], masked(text, every) if there else None]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            return cols

        return work

    return annotate(docs, text_col, fields, make, carry)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, column for column, with personal data masked; ``n_chars``, if there, follows the new text."""
    cols = docs.columns
    out = with_plain_names(docs, text_col, lambda d, text: find_pii(d, text).withColumn(text, F.col("masked")))
    if "n_chars" in cols:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(F.col(f"`{text_col}`"))).cast(docs.schema["n_chars"].dataType))
    return out
