"""Personal data: detection in the text as it is and behind disguises.

A chain of transducers rewrites the text and keeps, for each character written, the source span it
stands for: homoglyphs and full-width forms become ASCII and zero-width characters go; at/dot
disguises become ``@`` and ``.``; runs of spelled digits become digits. The detectors run on what was
written, and their spans are mapped back to source characters. A span found that way is added if
a disguise lies within it and no base span of its kind overlaps it.

Spans are in code points, end exclusive. Every detector takes time in proportion to the text.

Edge cases: null text is empty. Every row is searched on its own, whatever its doc_id. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ramify.llm.common import ids_and_text, ship, slices

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "<email>", "ip": "<ip>", "card": "<card>", "phone": "<phone>"}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: the run of local characters before an @ can't hold one, so each @ has one candidate."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Characters that look like an ASCII character (Cyrillic, Greek, punctuation).
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "һ": "h", "ո": "n", "ν": "v", "ο": "o", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9",
}
HOMOGLYPHS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # full-width forms
HOMOGLYPHS |= {chr(c): "" for c in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD)}
_GLYPH = re.compile("[" + "".join(re.escape(c) for c in HOMOGLYPHS) + "]")
#: Digits as words, zero to nine.
DIGIT_WORDS = (
    "zero one two three four five six seven eight nine".split(),
    "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "zéro un deux trois quatre cinq six sept huit neuf".split(),
    "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
)
_DIGIT = {w: str(i) for words in DIGIT_WORDS for i, w in enumerate(words)} | {"oh": "0"}
_DIGIT_ALTERNATIVES = "|".join(sorted(_DIGIT, key=len, reverse=True))
_DOT_WORDS = "dot|punkt|punto|point"
_AT_WORDS = "at|arroba"
_BETWEEN = rf"(?:[ ,-]{{1,3}}|[ ]?[.][ ]?|[ ](?:{_DOT_WORDS})[ ])"
#: Digits as words or as numerals, next to each other.
_NUMBER = rf"(?:(?:{_DIGIT_ALTERNATIVES})(?!\w)|[0-9]++(?!\w))"
_SPELLED = re.compile(rf"(?<!\w)(?:plus[ ])?{_NUMBER}(?:{_BETWEEN}{_NUMBER})++", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>plus[ ])|(?P<digit>{_DIGIT_ALTERNATIVES})|(?P<dot>[ ]?[.][ ]?|[ ](?:{_DOT_WORDS})[ ])|(?P<gap>[ ,-]+)|(?P<numeral>[0-9]+)", re.I)
LEAST_SPELLED = 4  # digit words in a run without a numeral
_OPEN, _SHUT = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_DISGUISED_DOT = rf"(?:{_OPEN}(?:{_DOT_WORDS}|\.){_SHUT}|[ ](?:{_DOT_WORDS})[ ])"
_AT = re.compile(rf"{_OPEN}(?:{_AT_WORDS}|@){_SHUT}|[ ](?:{_AT_WORDS})[ ]|[ ]?@[ ]?", re.I)
_LABELS = re.compile(rf"[A-Za-z0-9-]++(?:(?:{_DISGUISED_DOT}|\.)[A-Za-z0-9-]++)++", re.I)
_DOT_PART = re.compile(_DISGUISED_DOT, re.I)
_DOT_BEFORE = re.compile(rf"{_DISGUISED_DOT}\Z", re.I)
_LONGEST_DOT = max(map(len, _DOT_WORDS.split("|"))) + 6  # with brackets and blanks
#: Top-level domains; an address whose at and dots are bare words must end in one.
_TOP = frozenset("com org net edu gov mil int info biz io dev app co me tv ai us uk eu de fr es it nl be ch at pl ru pt br mx ar cl ca au nz in jp cn example test".split())
#: Words after which "at" and a domain are a place to go to, not an address.
_PLACES = frozenset(
    "look looked looking us me you it is are was were be been here there more available found find visit see read online live site page shop store order book up out in on hosted listed "
    "published posted page website homepage work works worked working sold starts started time start stay meet met people team staff and or that this them him her".split()
)
_ADDRESS_HINT = re.compile(
    rf"[\[({{<][ ]?(?:{_AT_WORDS}|@|{_DOT_WORDS}|\.)[ ]?[\])}}>]|[ ](?:{_DOT_WORDS})[ ]|[ ]@|@[ ]|[ ](?:{_AT_WORDS})[ ][A-Za-z0-9-]++\.[A-Za-z]", re.I
)


def _addresses(text: str) -> list[tuple[int, int, str]]:
    """Edits that undo at/dot disguises. Each separator is looked at from its place to both sides, up to its neighbours, so time is linear."""
    edits: list[tuple[int, int, str]] = []
    floor, m = 0, _AT.search(text)
    while m:
        domain = _LABELS.match(text, m.end())
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = False
        if domain and start < m.start():
            sign = m[0].strip().lower()
            bare = sign in _AT_WORDS.split("|")
            dots = list(_DOT_PART.finditer(text, domain.start(), domain.end()))
            bracketed = any(p[0].strip()[0] in "[({<" for p in dots)
            named = _NOT_LABEL.split(domain[0])[-1].lower() in _TOP
            place = text[start : m.start()].lower() in _PLACES
            found = (m[0] != "@" or bool(dots)) and (not bare or bracketed or (named and (bool(dots) or not place)))
        if not found or domain is None:
            floor = m.end()
            m = _AT.search(text, m.end())
            continue
        local: list[tuple[int, int, str]] = []
        while before := _DOT_BEFORE.search(text[max(floor, start - _LONGEST_DOT) : start]):
            end, begin = start, start - len(before[0])
            start = begin
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            if start == begin:
                break
            local.insert(0, (begin, end, "."))
        edits += local
        if m[0] != "@":
            edits.append((*m.span(), "@"))
        edits += [(*p.span(), ".") for p in dots]
        floor = domain.end()
        m = _AT.search(text, domain.end())
    return edits


_NOT_LABEL = re.compile(r"[^A-Za-z0-9-]+")


def _spelled(text: str) -> Iterator[re.Match]:
    """Runs of digits with words among them."""
    for m in _SPELLED.finditer(text):
        words = sum(bool(p["digit"]) for p in _SPELLED_PART.finditer(m[0]))
        if words >= LEAST_SPELLED or words and any(c in "0123456789" for c in m[0]):
            yield m


class Mapped:
    """A rewritten text; its character i stands for the source's [starts[i], ends[i]). changed: rewritten positions."""

    def __init__(self, text: str):
        self.text = text
        self.starts: list[int] = list(range(len(text)))
        self.ends: list[int] = list(range(1, len(text) + 1))
        self.changed = [False] * len(text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, new text) in order, not overlapping; new text stands for all of [start, end)."""
        if not edits:
            return
        text, starts, ends, changed, at = [], [], [], [], 0
        for s, e, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:s])
            starts += self.starts[at:s]
            ends += self.ends[at:s]
            changed += self.changed[at:s]
            if new:
                text.append(new)
                starts += [self.starts[s]] * len(new)
                ends += [self.ends[e - 1]] * len(new)
                changed += [True] * len(new)
            elif s < e and changed:
                changed[-1] = True  # what was dropped marks its neighbour
            at = e
        self.text, self.starts, self.ends, self.changed = "".join(text), starts, ends, changed


def deobfuscate(text: str) -> Mapped | None:
    """The text behind its disguises; None if it has none."""
    glyphs = None if text.isascii() else _GLYPH.search(text)
    hint = _ADDRESS_HINT.search(text)
    spelled = next(_spelled(text), None)
    if not (glyphs or hint or spelled):
        return None
    out = Mapped(text)
    if glyphs:
        out.rewrite([(*m.span(), HOMOGLYPHS[m[0]]) for m in _GLYPH.finditer(out.text)])
    if _ADDRESS_HINT.search(out.text):
        out.rewrite(_addresses(out.text))
    edits = []
    for m in _spelled(out.text):
        for p in _SPELLED_PART.finditer(m[0]):
            if not p["numeral"]:
                new = "+" if p["plus"] else _DIGIT[p["digit"].lower()] if p["digit"] else "." if p["dot"] else ""
                edits.append((m.start() + p.start(), m.start() + p.end(), new))
    out.rewrite(edits)
    return out if any(out.changed) else None


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, added spans), each by kind, then start."""
    base = [(kind, s, e) for kind in KINDS for s, e in DETECTORS[kind](text)]
    added = []
    mapped = deobfuscate(text)
    if mapped is not None:
        for kind in KINDS:
            own = [(s, e) for k, s, e in base if k == kind]
            at = 0
            for s, e in DETECTORS[kind](mapped.text):
                first, last = mapped.starts[s], mapped.ends[e - 1]
                while at < len(own) and own[at][1] <= first:
                    at += 1
                if any(mapped.changed[s:e]) and not (at < len(own) and own[at][0] < last):
                    added.append((kind, first, last))
    return base, added


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask_text(text: str) -> str:
    """The text with each span (overlapping ones as the first) replaced by its kind's mark."""
    out, at = [], 0
    base, added = find(text)
    for kind, s, e in sorted(base + added, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], MASKS[kind]]
        at = max(at, e)
    return "".join(out) + text[at:]


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1):
            counts: list[list[int]] = [[] for _ in KINDS]
            digests, spans = [], []
            for text in part.column(1).to_pylist():
                base, added = find(text)
                for n, kind in zip(counts, KINDS, strict=True):
                    n.append(sum(k == kind for k, _, _ in base))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + added, key=lambda x: (KINDS.index(x[0]), x[1]))))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )


def scan_personal(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, base_sha256 and all spans for every row."""
    ship(docs.sparkSession)
    return ids_and_text(docs).mapInArrow(_scan, _SCHEMA)
