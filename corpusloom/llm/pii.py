"""Personal data in whole texts: plain detectors, and the same detectors behind offset-preserving deobfuscation."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_DIGIT = re.compile("[0-9]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards, so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        match = _DOMAIN.match(text, at)
        start = at
        while match and start > done and text[start - 1] in _LOCAL:
            start -= 1
        if match and start < at:
            yield start, match.end()
            done = match.end()
        at = text.find("@", max(at + 1, done))


def _is_ip(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _is_card(text: str) -> bool:
    digits = text.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(text: str) -> bool:
    return 9 <= sum("0" <= c <= "9" for c in text) <= 15


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in code points, by kind and then start."""
    found = [(0, a, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for kind, pattern, holds in ((1, _IP, _is_ip), (2, _CARD, _is_card), (3, _PHONE, _is_phone)):
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return found


# Look-alikes of Latin letters and of punctuation, and spelled digits in four languages.
LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ℓ": "l", "․": ".", "。": ".", "｡": ".", "﹒": ".", "·": ".", "•": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹢": "+", " ": " ", " ": " ", " ": " ", " ": " ", "　": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
AT_WORDS = "at|arobase|arroba|chez|klammeraffe|ät"
DOT_WORDS = "dot|point|punto|punkt"
_DOTS = tuple(DOT_WORDS.split("|"))


@lru_cache(maxsize=1)
def _looks() -> dict[str, str]:
    """Every character with one plain ASCII look, and invisible ones, which look like nothing."""
    table = dict(LOOKS_LIKE)
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        digit = unicodedata.decimal(c, None)
        if digit is not None:
            table[c] = str(digit)
        elif 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x2460 <= code <= 0x24E9:
            plain = unicodedata.normalize("NFKC", c)
            if len(plain) == 1 and plain.isascii():
                table[c] = plain
    return table | dict.fromkeys(INVISIBLE, "")


#: After a dot that is spelled as a bare word, or an at word before a dotted domain, only these end a mail address.
TLDS = frozenset("com org net edu gov mil int info biz io co dev app ai me tv uk fr de es eu ch nl pl se ca au jp cn ru br".split())

_TOKEN = r"(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + r")"
_RUN = re.compile(rf"\b(?:{_TOKEN}|[0-9]+)(?:[ ,-]{{1,3}}(?:{_TOKEN}|[0-9]+))*\b", re.IGNORECASE)
_PART = re.compile(rf"{_TOKEN}|[0-9]+", re.IGNORECASE)
_WORD_TRIGGER = re.compile(rf"\b(?:{DOT_WORDS})\b|[\[({{<]\s{{0,3}}(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s{{0,3}}[\])}}>]", re.IGNORECASE)
_OPEN, _SHUT, _GAP = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]", r"[ \t]{0,3}"
_AT_BRACKET = re.compile(rf"{_GAP}{_OPEN}(?:{AT_WORDS}|@){_SHUT}{_GAP}", re.IGNORECASE)
_DOT_BRACKET = re.compile(rf"{_GAP}{_OPEN}(?:{DOT_WORDS}|\.){_SHUT}{_GAP}", re.IGNORECASE)
_DOT_WORD = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]{{1,3}}(?=[A-Za-z0-9])", re.IGNORECASE)
_LABEL = r"[A-Za-z0-9-]{1,63}"
_DOMAIN_AHEAD = rf"{_LABEL}(?:\.{_LABEL})*(?:[ \t]{{1,3}}(?:{DOT_WORDS})[ \t]|{_GAP}{_OPEN}(?:{DOT_WORDS}|\.){_SHUT})|(?:{_LABEL}\.)+(?:{'|'.join(sorted(TLDS))})(?!\.?[A-Za-z0-9-])"
_AT_WORD = re.compile(rf"(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{AT_WORDS})[ \t]{{1,3}}(?={_DOMAIN_AHEAD})", re.IGNORECASE)
_AT_TRIGGER = re.compile(rf"\b(?:{AT_WORDS})[ \t]{{1,3}}[\w-]+\.\w", re.IGNORECASE)
_WORD = re.compile(r"\w+")
_AT_LOOSE = re.compile(r"(?<=[A-Za-z0-9])[ \t]{0,3}@[ \t]{0,3}(?=[A-Za-z0-9])")
_PLUS_WORDS = ("plus", "más", "mas")
_PLUS = re.compile(rf"\b(?:{'|'.join(_PLUS_WORDS)})\s{{1,3}}(?=[0-9])", re.IGNORECASE)
_TLD = re.compile(r"\.([A-Za-z]{2,24})$")


class Tape:
    """A rewritten text that knows, for each of its characters, the source characters that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int64)
        self.ends = self.starts + 1
        self.edited = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint, ordered stretches; an edit to nothing marks the character before it."""
        if not edits:
            return
        text, starts, ends, edited, at = [], [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text += [self.text[at:a], new]
            starts += [self.starts[at:a], np.full(len(new), self.starts[a] if a < b else 0)]
            ends += [self.ends[at:a], np.full(len(new), self.ends[b - 1] if a < b else 0)]
            kept = self.edited[at:a]
            if a < b and not new and len(kept):
                kept = kept.copy()
                kept[-1] = True
            edited += [kept, np.ones(len(new), bool)]
            at = b
        self.text = "".join(text)
        self.starts, self.ends, self.edited = map(np.concatenate, (starts, ends, edited))


def _folded(text: str) -> str:
    """Lower case as IGNORECASE sees it, where long s and dotted capital I are letters of a word too."""
    return text.lower() if text.isascii() else text.casefold().replace("i\u0307", "i")


def _counts(small: str) -> bool:
    """Whether a spelled digit stands, but for white space and signs, next to another one, to digits or to a spelled dot, or anywhere beside an @.

    Addresses, cards and phones hold no other words between their digits, so else no transducer for spelled digits can matter.
    """
    words = _WORD.findall(small)
    for i in [i for i, w in enumerate(words) if w in SPELLED]:
        if "@" in small or any(w in SPELLED or w in _DOTS or w[0].isdigit() for w in words[max(0, i - 1) : i] + words[i + 1 : i + 2]):
            return True
    return False


def _triggered(text: str) -> bool:
    """Whether any transducer but that for look-alikes can lead to a span: true wherever one of their patterns can matter."""
    small = _folded(text)
    if (any(w in small for w in _DOTS) or any(c in text for c in "[({<")) and _WORD_TRIGGER.search(text):
        return True
    return _counts(small) or any(w in small for w in _PLUS_WORDS) and bool(_PLUS.search(text)) or "." in text and bool(_AT_TRIGGER.search(text))


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for run in _RUN.finditer(text):
        parts = [(m.start(), m.end(), m[0]) for m in _PART.finditer(text, run.start(), run.end())]
        words = [not p[2][0].isdigit() for p in parts]
        if not any(words):
            continue
        for i, (a, b, token) in enumerate(parts):
            if words[i]:
                edits.append((a, b, SPELLED[_folded(token)]))
            if i + 1 < len(parts) and (words[i] or words[i + 1]):
                edits.append((b, parts[i + 1][0], ""))
    return edits


def deobfuscate(text: str) -> Tape | None:
    """The tape after all transducers, or None where no trigger of any of them occurs."""
    table = _looks()
    looks = not text.isascii() and not table.keys().isdisjoint(text)
    return rewritten(text) if looks or _triggered(text) else None


def rewritten(text: str) -> Tape:
    """The tape after all transducers, whether or not they find anything."""
    table = _looks()
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(i, i + 1, table[c]) for i, c in enumerate(text) if c in table])
    tape.rewrite(_spelled(tape.text))
    tape.rewrite([(m.start(), m.end(), "+") for m in _PLUS.finditer(tape.text)])
    for pattern, new in ((_AT_BRACKET, "@"), (_AT_WORD, "@"), (_DOT_BRACKET, "."), (_DOT_WORD, ".")):
        tape.rewrite([(m.start(), m.end(), new) for m in pattern.finditer(tape.text)])
    tape.rewrite([(m.start(), m.end(), "@") for m in _AT_LOOSE.finditer(tape.text) if m[0] != "@" and tape.edited[m.end() : m.end() + 80].any()])
    return tape


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The plain spans, and those with the spans added that only the rewritten text shows."""
    base = detect(text)
    tape = deobfuscate(text)
    if tape is None:
        return base, base
    return base, with_added(text, base, tape)


def with_added(text: str, base: list[tuple[int, int, int]], tape: Tape) -> list[tuple[int, int, int]]:
    """The plain spans and those that only the tape shows."""
    added = []
    for kind, a, b in detect(tape.text):
        if not tape.edited[a:b].any():
            continue
        start, end = int(tape.starts[a]), int(tape.ends[b - 1])
        if kind == 0:
            last = _TLD.search(tape.text[a:b])
            if not last or text[int(tape.starts[a + last.start(1)]) - 1] in " \t" and last[1].lower() not in TLDS:
                continue
        if not any(k == kind and s <= start and end <= e for k, s, e in base):
            added.append((kind, start, end))
    return sorted({*base, *added})


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch that spans cover replaced by the kind that starts it, as in <EMAIL>."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, n_email, n_ip, n_card, n_phone, base, spans[, redacted].

    ``n_*`` and ``base`` hold what the plain detectors find; ``spans`` adds what they
    find behind homoglyphs, invisible characters, spelled digits and at/dot disguises,
    mapped back to source characters. Both are ``kind:start:end`` joined by commas, by
    kind (email, ip, card, phone) and start, in code points, end exclusive.

    A null text counts as empty and has no spans; its redacted text is null again.
    Repeated rows give repeated rows. Texts of any length are scanned whole, in linear
    time. Other columns are not read. An empty table gives no rows.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", *["redacted"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    base, spans = spans_of(text or "")
                    row = [doc_id, *(sum(k == i for k, _, _ in base) for i in range(4)), _joined(base), _joined(spans)]
                    rows.append([*row, redacted(text, spans) if text else text] if with_text else row)
                kinds = [*[pa.int64()] * 5, *[pa.string()] * (len(names) - 5)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = ", ".join(f"{n} {'string' if i > 4 else 'long'}" for i, n in enumerate(names))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every column, ``text`` redacted; cases as for ``find_pii``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                texts = [redacted(t, spans_of(t)[1]) if t else t for t in batch.column(at).to_pylist()]
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
