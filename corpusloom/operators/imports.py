"""Import declarations of source files: a pluggable extractor next to the content, and a small lexical default."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.scalar import edge_key
from corpusloom.operators.budgets import occurrence_number, per_group_limit

LANGUAGES = ("typescript", "typescriptreact", "javascript", "javascriptreact")
BINDING = "struct<kind:string,imported_name:string,local_name:string,exported_name:string,type_only:boolean>"
#: The scanner's name and version belong to every reuse key.
IDENTITY = "lexical-imports-1"

_SKIP = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"", re.DOTALL)
_STRING = r"(?P<q>['\"])(?P<specifier>\x00*)(?P=q)"
_NAME = r"[A-Za-z_$][\w$]*"
_FORMS = [
    ("import", re.compile(rf"(?<![\w$.])import\s+(?P<type>type\s+)?(?P<clause>[\w$*{{}},\s]+?)\s*from\s*{_STRING}")),
    ("side_effect", re.compile(rf"(?<![\w$.])import\s*{_STRING}")),
    ("re_export", re.compile(rf"(?<![\w$.])export\s+(?P<type>type\s+)?(?P<clause>\*(?:\s+as\s+{_NAME})?|\{{[^}}]*\}})\s*from\s*{_STRING}")),
    ("require", re.compile(rf"(?:(?:const|let|var)\s+(?P<clause>{_NAME}|\{{[^}}]*\}})\s*=\s*)?(?<![\w$.])require\s*\(\s*{_STRING}\s*\)")),
    ("dynamic_import", re.compile(rf"(?<![\w$.])import\s*\(\s*{_STRING}\s*\)")),
]


def _masked(text: str) -> str:
    """The text with comments blanked and string contents as NULs, every other character in place."""

    def blank(m: re.Match) -> str:
        found = m[0]
        if found[0] in "'\"":
            return found[0] + "\0" * (len(found) - 2) + found[-1]
        return re.sub(r"[^\n]", " ", found)

    return _SKIP.sub(blank, text)


def _bindings(kind: str, clause: str | None, type_only: bool) -> list[dict]:
    one = lambda k, imported, local, exported=None, t=False: {"kind": k, "imported_name": imported, "local_name": local, "exported_name": exported, "type_only": type_only or t}
    out, clause = [], (clause or "").strip()
    if kind == "require":
        if clause.startswith("{"):
            for part in filter(None, (p.strip() for p in clause.strip("{}").split(","))):
                names = re.split(r"\s*:\s*", part)
                out.append(one("commonjs_named", names[0], names[-1]))
        elif clause:
            out.append(one("commonjs_default", None, clause))
        return out
    braces = re.search(r"\{([^}]*)\}", clause)
    rest = clause.replace(braces[0], "") if braces else clause
    for part in filter(None, (p.strip() for p in rest.split(","))):
        star = re.fullmatch(rf"\*(?:\s+as\s+({_NAME}))?", part)
        if star:
            out.append(one("namespace", "*", None, star[1] or "*") if kind == "re_export" else one("namespace", "*", star[1]))
        elif re.fullmatch(_NAME, part):
            out.append(one("default", "default", part))
    for part in filter(None, (p.strip() for p in (braces[1] if braces else "").split(","))):
        m = re.fullmatch(rf"(type\s+)?({_NAME})(?:\s+as\s+({_NAME}))?", part)
        if m:
            out.append(one("named", m[2], None, m[3] or m[2], bool(m[1])) if kind == "re_export" else one("named", m[2], m[3] or m[2], None, bool(m[1])))
    return out


def scan_imports(language: str, text: str) -> list[dict]:
    """Import, re-export, require and dynamic import declarations in order, with byte ranges."""
    if language not in LANGUAGES:
        return []
    masked, out, taken = _masked(text), [], set()
    for kind, form in _FORMS:
        for m in form.finditer(masked):
            a, b = m.span("specifier")
            if a in taken:
                continue
            taken.add(a)
            groups = m.groupdict()
            type_only = bool(groups.get("type"))
            specifier = re.sub(r"\\(.)", r"\1", text[a:b])
            start = len(text[: m.start()].encode())
            out.append({"kind": kind, "specifier": specifier, "type_only": type_only, "bindings": _bindings(kind, groups.get("clause"), type_only), "start_byte": start, "end_byte": start + len(text[m.start() : m.end()].encode())})
    return sorted(out, key=lambda e: (e["start_byte"], e["specifier"]))


def extract_dependencies(files: DataFrame, extractor: Callable[[str, str], list[dict]] = scan_imports, max_edges: int = 1_000, max_bytes: int = 1_024) -> DataFrame:
    """``files(project_id, path, language, text)`` -> edges with kind, specifier, bindings, range, occurrence and key.

    Extraction runs next to the text without a shuffle; only edges are dealt by file for
    occurrence numbers and the limit of ``max_edges``, which ``omitted`` counts.
    """
    schema = f"project_id string, source_path string, language string, kind string, specifier string, type_only boolean, bindings array<{BINDING}>, start_byte long, end_byte long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(r.project_id, r.path, r.language, e["kind"], e["specifier"], e["type_only"], e["bindings"], e["start_byte"], e["end_byte"]) for r in pdf.itertuples() for e in extractor(r.language, r.text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("project_id", "source_path", "language", "kind", "specifier", "type_only", "bindings", "start_byte", "end_byte")])

    edges = files.select("project_id", "path", "language", "text").mapInPandas(run, schema).where(F.octet_length("specifier") <= max_bytes)
    keys = ["project_id", "source_path"]
    counted = occurrence_number(edges, [*keys, "kind", "specifier", "bindings"], ["start_byte"])
    kept = per_group_limit(counted, keys, ["start_byte", "specifier"], max_edges)
    return kept.withColumn("edge_key", edge_key("language", "kind", "specifier", "bindings", "occurrence"))
