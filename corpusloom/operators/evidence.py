"""Framework evidence from source text: decorators, calls, class headings, elements, directives and constructor parameters.

A small lexical reader runs next to the text in each task; keys, occurrences and limits
are windows over its rows.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import evidence_key
from corpusloom.operators.facts import EVIDENCE
from corpusloom.operators.source_scan import LANGUAGES, Declaration, Source, byte_offsets, scan_symbols
from corpusloom.plans.tables import materialize, materialize_by, parts

#: The scanner's name and version belong to every reuse key.
IDENTITY = "lexical-evidence-1"
UNKNOWN = {"kind": "unknown"}

_JSON = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode
_SORTED = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"), sort_keys=True).encode
_NO_CALL = frozenset("if for while switch catch function return typeof await void delete new with in of do else case yield throw instanceof async".split())
# Escapes of one character in string literals.
_ESCAPES = {'"': '"', "'": "'", "0": "\0", "\\": "\\", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(.))", re.DOTALL)


def string_value(literal: str) -> str | None:
    """The text that a quoted literal stands for; None where an escape is not a valid one or the text holds NUL."""
    bad = False

    def decode(m: re.Match) -> str:
        nonlocal bad
        code = m[1] or m[2] or m[3]
        if code:
            bad |= int(code, 16) > 0x10FFFF
            return "" if bad else chr(int(code, 16))
        bad |= m[4] in "ux" or (m[4].isdigit() and m[4] != "0") or (m[4] == "0" and literal[m.end() : m.end() + 1].isdigit())
        return _ESCAPES.get(m[4], m[4])

    if literal.isascii() and literal.isprintable() and "\\" not in literal:
        return literal[1:-1]
    text = _ESCAPE.sub(decode, literal[1:-1])
    text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return None if bad or "\0" in text or re.search(r"(?<!\\)[\r\n]", literal) else text


def _number(word: str) -> dict:
    word = word.replace("_", "")
    try:
        value = int(word, 0) if re.fullmatch(r"[-+]?0[xXoObB][0-9a-fA-F]+", word) else float(word)
    except ValueError:
        return UNKNOWN
    if not math.isfinite(value):
        return UNKNOWN
    return {"kind": "number", "value": int(value) if value == int(value) and abs(value) < 1e21 else value}


class Values:
    """Static values of token ranges, within limits; counts what it leaves out."""

    def __init__(self, source: Source, limits: dict):
        self.source, self.limits = source, limits
        self.omitted, self.reasons = 0, set()

    def _leave_out(self, reason: str, n: int = 1) -> dict:
        self.reasons.add(reason)
        self.omitted += n
        return UNKNOWN

    def long(self, name: str) -> bool:
        return not name or len(name.encode()) > self.limits["name_bytes"]

    def argument(self, a: int, b: int) -> str:
        value = _JSON(self.read(a, b, 0))
        if len(value.encode("utf-8", "replace")) > self.limits["value_bytes"]:
            value = _JSON(self._leave_out("static_value_limit"))
        return value

    def read(self, a: int, b: int, depth: int) -> dict:
        s = self.source
        if depth > self.limits["depth"]:
            return self._leave_out("static_depth_limit")
        while a < b and s.word[a] == "(" and s.pair[a] == b - 1:
            a, b = a + 1, b - 1
        if a >= b:
            return UNKNOWN
        kind, word = s.kind[a], s.word[a]
        if b - a == 1 and kind == "string":
            text = string_value(word)
            return UNKNOWN if text is None else {"kind": "string", "value": text}
        if kind == "number" and b - a == 1:
            return _number(word)
        if word in ("+", "-") and b - a == 2 and s.kind[a + 1] == "number":
            return _number(word + s.word[a + 1])
        if b - a == 1 and word in ("true", "false"):
            return {"kind": "boolean", "value": word == "true"}
        if b - a == 1 and word in ("null", "undefined"):
            return {"kind": "null"} if word == "null" else UNKNOWN
        segments = s.word[a:b:2]
        if all(s.kind[i] == "name" for i in range(a, b, 2)) and (b - a) % 2 and all(w in (".", "?.") for w in s.word[a + 1 : b : 2]):
            return self._leave_out("name_text_limit") if any(map(self.long, segments)) else {"kind": "identifier", "reference": {"segments": segments}}
        if word == "[" and s.pair[a] == b - 1:
            return {"kind": "array", "items": [self.read(i, j, depth + 1) for i, j in self._some(s.items(a))]}
        if word == "{" and s.pair[a] == b - 1:
            return self._object(s.items(a), depth)
        return UNKNOWN

    def _some(self, items: list) -> list:
        most = self.limits["entries"]
        if len(items) > most:
            self._leave_out("static_collection_limit", len(items) - most)
        return items[:most]

    def _object(self, items: list, depth: int) -> dict:
        s, properties = self.source, []
        pairs = [(i, j, s.kind[i] in ("name", "string", "number") and s.at(i + 1) == ":" and j > i + 2) for i, j in items]
        if any(not pair and not (j == i + 1 and s.kind[i] == "name") and s.word[i] != "[" for i, j, pair in pairs):
            return UNKNOWN
        for i, j, pair in self._some(pairs):
            key = string_value(s.word[i]) if s.kind[i] == "string" else s.word[i]
            if key is None or s.word[i] == "[":
                return UNKNOWN
            if self.long(key):
                self._leave_out("name_text_limit")
                continue
            value = self.read(i + 2, j, depth + 1) if pair else {"kind": "identifier", "reference": {"segments": [key]}}
            properties.append({"key": key, "value": value})
        return {"kind": "object", "properties": properties}


class _Scan:
    def __init__(self, source: Source, limits: dict, elements: bool):
        self.s, self.limits, self.elements = source, limits, elements
        self.found = list(source.declarations())
        self.methods = {d.opening: d for d in self.found if d.kind in ("method", "constructor")}
        self.bound = {d.opening: d for d in self.found if d.kind in ("constant", "variable", "function") and d.opening < len(source)}
        self.declared = {d.opening for d in self.found if d.kind in ("method", "constructor", "function")}
        self.members = {d.first: d for d in self.found if d.kind in ("method", "constructor", "property")}
        self.classes = {d.first: d for d in self.found if d.kind == "class"}
        self.receivers: dict[int, int | None] = {}
        self.calls: dict[int, tuple[int, list[str] | None] | None] = {}
        self.owner = self._owners([d for d in self.found if d.kind == "class"])

    def _owners(self, classes: list[Declaration]) -> list[str | None]:
        """The innermost class around each token: of those around it the one that starts last."""
        out: list[str | None] = [None] * len(self.s)
        for d in sorted(classes, key=lambda d: d.first):
            out[d.first : d.last + 1] = [d.name] * (min(d.last + 1, len(out)) - d.first)
        return out

    def call(self, i: int) -> tuple[int, list[str] | None] | None:
        """(first token, reference) of the call whose parenthesis is token i, or None if it is no call; calls before it are known."""
        if i not in self.calls:
            self.calls[i] = self._call(i)
        return self.calls[i]

    def _call(self, i: int) -> tuple[int, list[str] | None] | None:
        s = self.s
        j = i - 2 if s.at(i - 1) == "?." else i - 1
        if s.at(j) == ">" and s.kind[j] == "mark" and s.span[j - 1][1] == s.span[j][0]:
            depth, k = 1, j - 1
            while k > max(0, j - 200) and depth and s.word[k] not in (";", "{", "}", "(", "&&", "||"):
                depth += (s.word[k] == ">") - (s.word[k] == "<")
                k -= 1
            if depth or not s.is_name(k) or s.span[k][1] != s.span[k + 1][0]:
                return None
            j = k
        if j < 0 or i in self.declared or (s.at(s.pair[i] + 1) == "{" and not s.fresh[s.pair[i] + 1]) or (s.word[j] == "async" and s.at(s.pair[i] + 1) == "=>"):
            return None
        if s.kind[j] == "name" and s.word[j] in _NO_CALL and s.at(j - 1) not in (".", "?."):
            return None
        segments, plain, first = [], True, j
        while True:
            if s.kind[j] == "name":
                segments.append(s.word[j])
                first = j
                plain = plain and (s.word[j] not in ("super", "import") or s.at(j - 1) in (".", "?."))
            elif s.word[j] in (")", "]") and s.pair[j] < j:
                plain, first = False, s.pair[j]
                known = self.call(first) if s.word[j] == ")" else None
                if known:
                    return known[0], None
                if s.is_name(first - 1) and s.word[first - 1] not in _NO_CALL or s.at(first - 1) in (")", "]"):
                    j = first - 1
                    continue
            elif s.word[j] == "!" and s.ends_value(j - 1):
                plain, j = False, j - 1
                continue
            elif s.kind[j] in ("string", "template", "regex"):
                plain, first = False, j
            else:
                return None
            if s.at(first - 1) not in (".", "?.") or first < 2:
                break
            j = first - 2
        if s.at(first - 1) == "new":
            if plain or not any(s.word[k] == ")" for k in range(first, i)):
                return None
            first -= 1
        if s.at(first - 1) in ("function", "*") and plain:
            return None
        return first, segments[::-1] if plain else None

    def receiver(self, i: int) -> int | None:
        """The parenthesis of the first call in a chain of calls that ends at i."""
        s = self.s
        if not (s.is_name(i - 1) and s.at(i - 2) in (".", "?.") and s.at(i - 3) == ")" and s.pair[i - 3] < i and self.call(s.pair[i - 3])):
            return None
        before = s.pair[i - 3]
        return self.receivers.get(before) or before  # that of the call before is known already

    def assigned(self, first: int, last: int) -> str | None:
        """What the whole value from ``first`` to ``last`` is given to."""
        s = self.s
        bound = self.bound.get(first)
        if bound:
            return bound.name if bound.last == last else None
        j = first - 2
        ended = s.at(last + 1) in ("", ";", ",", ")", "}", "]") or s.breaks(last + 1)
        if s.at(first - 1) != "=" or not s.is_name(j) or not ended or s.body.get(s.inside[first]) in ("class", "interface"):
            return None
        names = [s.word[j]]
        while s.at(j - 1) == "." and s.is_name(j - 2):
            j -= 2
            names.append(s.word[j])
        before = s.at(j - 1)
        return ".".join(names[::-1]) if before in ("", ";", "{", "}", "=", "=>", "&&", "||") or s.breaks(j) else None

    def counts(self, opening: int) -> list[int | None]:
        out = []
        for a, b in self.s.items(opening):
            found = self.s.handler(a, b)
            out.append(None if not found or found[0] < 0 else len(self.s.parameters(found[0])))
        return out

    def parameter(self, a: int, b: int) -> tuple[str | None, list[str] | None]:
        """Name and type reference of one parameter."""
        s = self.s
        while a < b and s.word[a] == "@":
            a = s.decorator_end(a)
        while a + 1 < b and s.word[a] in ("public", "private", "protected", "readonly", "override") and (s.kind[a + 1] == "name" or s.word[a + 1] in "{["):
            a += 1
        name = s.word[a] if a < b and s.kind[a] == "name" else None
        a = s.pair[a] + 1 if a < b and s.word[a] in "{[" else a + 1
        a += s.at(a) == "?"
        kind = None
        if s.at(a) == ":" and a + 1 < b and s.kind[a + 1] == "name":
            kind, a = [s.word[a + 1]], a + 2
            while s.at(a) == "." and a + 1 < b:
                kind.append(s.at(a + 1))
                a += 2
            a = s.skip_angles(a, b) if s.at(a) == "<" else a
            kind = kind if (a >= b or s.word[a] == "=") and kind[0] not in ("string", "number", "boolean", "any", "unknown", "never", "void", "object", "symbol", "typeof", "keyof", "readonly", "unique") else None
        return name, kind

    def decorators(self) -> Iterator[tuple]:
        s = self.s
        marks = [i for i in range(len(s)) if s.word[i] == "@" and s.kind[i] == "mark" and s.is_name(i + 1)]
        ends = {i: s.decorator_end(i) for i in marks}
        firsts, after = {}, {}
        for i in marks:  # the first decorator of the row that each stands in
            firsts[i] = firsts.pop(("end", i), i)
            firsts["end", ends[i]] = firsts[i]
        for i in reversed(marks):  # what follows that row
            after[i] = after.get(ends[i], ends[i])
        for i in marks:
            end, target = after[i], None
            while s.at(end) in ("export", "default", "declare") and s.inside[i] == s.inside[end]:
                end += 1
            paren = s.pair[ends[i] - 1] if s.at(ends[i] - 1) == ")" else None
            names = s.word[i + 1 : paren or ends[i] : 2]
            owner, member, index, kind, name = None, None, None, "unknown", None
            method = self.methods.get(s.inside[i])
            if method:
                around = s.parameters(method.opening)
                index = next((k for k, (a, b) in enumerate(around) if a <= i < b), None)
                kind, owner, member = "parameter", self.owner[i], method.name
                name = self.parameter(*around[index])[0] if index is not None else None
            else:
                target = self.members.get(end) or self.members.get(firsts[i]) or self.classes.get(end) or self.classes.get(firsts[i])
                if target:
                    kind = "method" if target.kind == "constructor" else target.kind
                    name, owner = target.name, target.name if target.kind == "class" else self.owner[target.first]
                    member = target.name if kind == "method" else None
            yield "decorator", i, ends[i] - 1, names, paren, {"owner_name": owner, "member_name": member, "parameter_index": index, "target_kind": kind, "target_name": name}

    def rest(self) -> Iterator[tuple]:
        """Everything but decorators, as (kind, first token, last token, reference, parenthesis of arguments, columns)."""
        s = self.s
        for i in range(len(s)):
            if s.kind[i] == "mark" and s.word[i] == "(" and s.pair[i] < len(s) and (found := self.call(i)):
                first, names = found
                columns = {"assigned_name": self.assigned(first, s.pair[i]), "owner_name": self.owner[first], "parameter_counts": self.counts(i)}
                self.receivers[i] = self.receiver(i)
                dotted = s.is_name(i - 1) and s.at(i - 2) in (".", "?.")
                yield "call_expression", first, s.pair[i], names, i, columns | {"member_name": s.word[i - 1] if dotted else None, "receiver": self.receivers[i]}
        for d in self.found:
            if d.kind == "class":
                heading = next((k for k in range(d.first, min(d.opening, len(s))) if s.word[k] in ("extends", "implements") and s.at(k - 1) not in ("<", ",") and s.inside[k] == s.inside[d.first]), None)
                if heading is not None:
                    names, k = [], heading + 1
                    while s.word[heading] == "extends" and s.is_name(k):
                        names.append(s.word[k])
                        if s.at(k + 1) != ".":
                            break
                        k += 2
                    called = s.at(k + 1) == "("
                    yield "class_heritage", d.first, min(d.last, len(s) - 1), names if names and not called else None, None, {"target_name": d.name}
            elif d.kind == "constructor" and s.pair[d.opening] < len(s):
                for index, (a, b) in enumerate(s.parameters(d.opening)):
                    name, kind = self.parameter(a, b)
                    yield "constructor_parameter", a, b - 1, kind, None, {"owner_name": self.owner[a], "parameter_index": index, "target_name": name}
        i = 0
        while i < len(s) and s.kind[i] == "string" and (s.at(i + 1) in ("", ";") or s.breaks(i + 1)):
            value, last = string_value(s.word[i]), i + (s.at(i + 1) == ";")
            if value is not None:
                yield "directive", i, last, None, None, {"arguments": [_JSON({"kind": "string", "value": value})]}
            i = last + 1
        yield from self._elements() if self.elements else ()

    def _elements(self) -> Iterator[tuple]:
        s, open_ = self.s, []
        for i in range(len(s)):
            while open_ and open_[-1] >= 0 and s.pair[open_[-1]] < i:
                open_.pop()
            if s.word[i] != "<" or s.kind[i] != "mark" or i + 1 >= len(s) or s.span[i][1] != s.span[i + 1][0]:
                continue
            text = bool(open_) and open_[-1] == s.inside[i]
            if s.word[i + 1] == "/":
                if text:
                    open_.pop()
                continue
            if not (s.is_name(i + 1) or s.word[i + 1] == ">") or (i and s.ends_value(i - 1) and not text and not s.fresh[i]):
                continue
            names, k = [], i + 1
            while s.is_name(k):
                names.append(s.word[k])
                if s.at(k + 1) not in (".", "-"):
                    break
                k += 2
            k = k if not names else k + 1
            names = names if s.at(i + 2) != "-" and s.at(k) != ":" else None
            if s.at(k) in (",", "extends"):
                continue
            while k < len(s) and s.word[k] not in (">", ";") and not (s.kind[k] == "mark" and s.word[k] in ")]}"):
                k = s.pair[k] + 1 if s.kind[k] == "mark" and s.word[k] in "([{" else k + 1
            if s.at(k) != ">":
                continue
            if s.word[k - 1] != "/":
                open_.append(s.inside[i])
            yield "jsx", i, k, names or None, None, {}


DEFAULT_LIMITS = {"entries": 200, "name_bytes": 512, "depth": 8, "value_bytes": 16_384}


def scan_evidence(language: str, text: str, limits: dict | None = None) -> list[dict]:
    """Rows of evidence of one text with their ``signature``, unnumbered; ``omitted`` values and their ``reasons`` on each."""
    if language not in LANGUAGES:
        return []
    limits = DEFAULT_LIMITS | (limits or {})
    source = Source(text)
    scan, byte, out = _Scan(source, limits, language.endswith("react") or language == "javascript"), byte_offsets(text), []
    for kind, first, last, names, paren, columns in chain(scan.decorators(), scan.rest()):
        values = Values(source, limits)
        row = {"kind": kind, "reference": names, "arguments": [values.argument(a, b) for a, b in source.items(paren)] if paren is not None else []} | columns
        inner = row.pop("receiver", None)
        if inner is not None:
            row |= {"receiver_reference": scan.call(inner)[1], "receiver_arguments": [values.argument(a, b) for a, b in source.items(inner)]}
        if kind == "directive" and len(row["arguments"][0].encode()) > limits["value_bytes"]:
            continue
        row["signature"] = _SORTED(row)
        start, end = source.span[first][0], source.span[min(last, len(source) - 1)][1]
        out.append(row | {"start_byte": int(byte[start]), "end_byte": int(byte[end]), "omitted": values.omitted, "reasons": sorted(values.reasons)})
    return out


ROW = EVIDENCE.replace("scope_key string, evidence_key string, ", "language string, ") + ", end_byte long, signature string, omitted int, reasons array<string>"
_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}
DECLARATION = "project_id string, path string, language string, kind string, name string, exported boolean, start_byte long, end_byte long"


def _scanned(files: DataFrame, schema: str, scan: Callable[[str, str], list[dict]]) -> DataFrame:
    """The rows that ``scan(language, text)`` finds in each file, next to the text and without a shuffle."""
    columns = [c.split() for c in schema.split(", ")]
    kinds = _TYPES | {"boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows, files = [], []
                for f in batch.slice(at, 64).to_pylist():
                    found = scan(f["language"], f.pop("text") or "")
                    rows += found
                    files += [f] * len(found)
                given = ("project_id", "path", "language")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in files] if c in given else [r.get(c) for r in rows], kinds[k]) for c, k in columns], [c for c, _ in columns])

    return files.select("project_id", "path", "language", "text").mapInArrow(run, schema)


def guarded(files: DataFrame, schema: str, scan: Callable[[str, str], list[dict]]) -> tuple[DataFrame, DataFrame]:
    """As ``_scanned``, but a file for which ``scan`` raises becomes a row of (project_id, path, error) instead of a failed task.

    ``schema`` may leave out project_id, path and language.
    """
    columns = schema if schema.startswith("project_id") else f"project_id string, path string, {schema}"

    def careful(language: str, text: str) -> list[dict]:
        try:
            return scan(language, text)
        except Exception as e:  # whatever an extractor raises is a row
            return [{"error": f"{type(e).__name__}: {e}"[:500]}]

    rows = materialize(_scanned(files, columns + ", error string", careful), "guarded")
    return rows.where("error IS NULL").drop("error"), rows.where("error IS NOT NULL").select("project_id", "path", "error")


def extract_symbols(files: DataFrame, extractor: Callable[[str, str], list[dict]] = scan_symbols) -> DataFrame:
    """``files(project_id, path, language, text)`` -> the declarations that ``build_symbols`` takes.

    A null text counts as empty; other languages and broken text give no rows or what can be told.
    """
    return _scanned(files, DECLARATION, extractor)


def extract_evidence(files: DataFrame, extractor: Callable[[str, str], list[dict]] = scan_evidence, max_evidence: int = 5_000, max_name_bytes: int = 512, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """``files(project_id, path, language, text)`` -> evidence without ``scope_key``, with ``end_byte``; and what was omitted.

    In each file, by start, longest first and kind: rows with a name that is empty or over
    ``max_name_bytes`` go, then all after the first ``max_evidence``. A key is that of the
    row's signature and of how many equal ones come before, so code that moves keeps it.
    Omissions: project_id, path, reasons (sorted), omitted_evidence, omitted_values. A null
    text counts as empty, other languages give no rows. With ``dealt`` the texts are dealt
    by file instead of the rows found in them, which are wider, and so is what is returned.
    """
    if dealt:
        file = ["project_id", "path"]
        rows = materialize_by(_scanned(files.repartition(parts(files.sparkSession), *file), ROW, extractor), "evidence", file, dealt=True)
    else:
        rows = materialize(_scanned(files, ROW, extractor), "evidence")
    return keyed(rows, max_evidence, max_name_bytes)


def keyed(found: DataFrame, max_evidence: int = 5_000, max_name_bytes: int = 512) -> tuple[DataFrame, DataFrame]:
    """Keys and limits for rows of ``ROW``; see ``extract_evidence``."""
    names = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in (F.col("reference"), F.col("receiver_reference"))), F.array("assigned_name", "target_name", F.when(F.col("kind") == "call_expression", F.col("member_name")), F.when(F.col("kind") == "constructor_parameter", F.col("owner_name"))))
    named = found.withColumn("unfit", F.exists(names, lambda n: n.isNotNull() & ((n == "") | (F.octet_length(n) > max_name_bytes))))
    file, order = ["project_id", "path"], ["start_byte", F.desc("end_byte"), "kind", "signature"]
    named = named.repartition(*file)  # once for all that goes by file
    placed = named.withColumn("place", F.row_number().over(Window.partitionBy(*file, "unfit").orderBy(*order)))
    kept = placed.where(~F.col("unfit") & (F.col("place") <= max_evidence))
    nth = F.row_number().over(Window.partitionBy(*file, "signature").orderBy("place")) - 1
    kept = kept.withColumn("evidence_key", evidence_key("language", "signature", nth))
    reason = F.when(F.col("unfit"), "name_text_limit").when(F.col("place") > max_evidence, "evidence_limit")
    lost = placed.select(*file, F.array_compact(F.array_append("reasons", reason)).alias("reasons"), reason.isNotNull().cast("long").alias("lost"), "omitted").where("size(reasons) > 0")
    omissions = lost.groupBy(*file).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"), F.sum("lost").alias("omitted_evidence"), F.sum("omitted").alias("omitted_values"))
    columns = [c.split()[0] for c in EVIDENCE.split(", ") if not c.startswith("scope_key")]
    return kept.select(*columns, "end_byte"), omissions
