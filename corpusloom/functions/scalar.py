"""Column functions: hashes and keys, text terms, scores, routes, packages. All built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sha256_hex(c: str | Column) -> Column:
    """Lower-case hex SHA-256 of text or bytes."""
    return F.sha2(as_column(c).cast("binary"), 256)


def keyed_hash(*cols: str | Column) -> Column:
    """SHA-256 of the parts joined by NUL; null parts count as empty."""
    return F.sha2(F.concat_ws(NUL, *(F.coalesce(as_column(c).cast("string"), F.lit("")) for c in cols)), 256)


def symbol_key(language, parent, kind, name, occurrence) -> Column:
    return keyed_hash(language, parent, kind, name, occurrence)


def edge_key(language, kind, specifier, bindings: str | Column, occurrence) -> Column:
    """``bindings`` is an array of structs (kind, imported_name, local_name, exported_name, type_only)."""
    part = lambda b: F.concat_ws("\x1f", b["kind"], F.coalesce(b["imported_name"], F.lit("")), F.coalesce(b["local_name"], F.lit("")), F.coalesce(b["exported_name"], F.lit("")), b["type_only"].cast("string"))
    return keyed_hash(language, kind, specifier, F.array_join(F.transform(as_column(bindings), part), "\x1e"), occurrence)


def binding_key(edge, signature, occurrence) -> Column:
    return keyed_hash(edge, signature, occurrence)


def chunk_key(path, content_hash, owner_key, occurrence, version: str = "chunks-1") -> Column:
    """Position-free: moving code within a file keeps its key."""
    return keyed_hash(F.lit(version), path, content_hash, owner_key, occurrence)


def entity_key(scope, kind, path, name, qualifier=None) -> Column:
    return keyed_hash(scope, kind, path, name, F.lit("") if qualifier is None else qualifier)


def relationship_key(scope, kind, source, target, occurrence) -> Column:
    return keyed_hash(scope, kind, source, target, occurrence)


def evidence_key(language, signature, occurrence) -> Column:
    return keyed_hash(language, signature, occurrence)


def scope_key(project, root, framework) -> Column:
    return keyed_hash(project, root, framework)


def embedding_input(path, language, content, symbol=None, kind=None) -> Column:
    """Header lines, ``---``, then the text."""
    named = F.lit(None).cast("string") if symbol is None else F.concat(F.lit("symbol: "), as_column(symbol), F.lit(" ("), as_column(kind), F.lit(")"))
    return F.concat_ws("\n", F.concat(F.lit("file: "), as_column(path)), F.concat(F.lit("language: "), as_column(language)), named, F.lit("---"), as_column(content))


def split_camel(c: str | Column) -> Column:
    return F.regexp_replace(as_column(c), r"([\p{Ll}0-9])(\p{Lu})", "$1 $2")


def lexical_terms(c: str | Column) -> Column:
    """Lower-cased runs of letters and digits after camel-case splitting."""
    return F.filter(F.split(F.lower(split_camel(c)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def weighted_document(a: list[str | Column], b: list[str | Column]) -> Column:
    """Array of (term, weight): terms of class A weigh 1.0, those of class B 0.4."""
    part = lambda cols, weight: F.flatten(F.array(*(F.transform(F.coalesce(lexical_terms(c), F.array().cast("array<string>")), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight"))) for c in cols)))
    return F.concat(part(a, 1.0), part(b, 0.4))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(as_column(a), as_column(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Clamped to [-1, 1]; null where a vector is null or zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size)))


def rrf(*ranks: str | Column, k: int = 60) -> Column:
    """Reciprocal-rank fusion: a missing rank adds nothing."""
    parts = [F.coalesce(F.lit(1.0) / (F.lit(float(k)) + as_column(r)), F.lit(0.0)) for r in ranks]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def utf16_length(c: str | Column) -> Column:
    return (F.octet_length(F.encode(as_column(c), "UTF-16BE")) / 2).cast("int")


def estimate_tokens(c: str | Column) -> Column:
    """A quarter of the UTF-16 length, rounded up."""
    return F.ceil(utf16_length(c) / 4).cast("int")


def message_tokens(c: str | Column) -> Column:
    return estimate_tokens(c) + 4


def clamp(c: str | Column, low, high) -> Column:
    return F.least(F.greatest(as_column(c), F.lit(low)), F.lit(high))


def candidate_limit(k: str | Column) -> Column:
    return clamp(as_column(k) * 4, 20, 200)


def external_package(specifier: str | Column) -> Column:
    """``@scope/name`` or the first segment; null where that is no package name."""
    name = F.regexp_extract(as_column(specifier), r"^(@[^/]+/[^/]+|[^@/][^/]*)(?:/|$)", 1)
    return F.when(name.rlike(r"^(?:@[A-Za-z0-9~_-][A-Za-z0-9._~-]*/)?[A-Za-z0-9~_-][A-Za-z0-9._~-]*$"), name)


def wildcard_match(pattern: str | Column, value: str | Column) -> Column:
    """A pattern with at most one ``*``; the value must hold prefix and suffix without overlap."""
    p, v = as_column(pattern), as_column(value)
    at = F.instr(p, "*")
    before, after = F.substring_index(p, "*", 1), F.substring(p, at + 1, F.length(p))
    return F.when(at == 0, p == v).otherwise(F.startswith(v, before) & F.endswith(v, after) & (F.length(v) >= F.length(before) + F.length(after)))


def normalize_route(c: str | Column) -> Column:
    """One leading slash, no doubled or trailing ones."""
    return F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.trim(as_column(c)), "/"), lambda s: s != ""), "/"))


def combine_routes(a: str | Column, b: str | Column) -> Column:
    """Sorted distinct routes of every prefix in ``a`` with every path in ``b``."""
    a, b = as_column(a), as_column(b)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: normalize_route(F.concat_ws("/", x, y)))))))


def file_route(path: str | Column) -> Column:
    """Struct (kind, router, role, route_pattern) by the file conventions of app and pages routers; null for other files.

    ``(group)`` and ``@slot`` segments vanish, ``[x]`` becomes ``:x``, ``[...x]`` ``:x+``,
    ``[[...x]]`` ``:x*``. Interception segments give a null pattern; files below a
    private ``_folder`` are no routes. Files of an app router that surround a page are
    layouts with their ``role``.
    """
    p = as_column(path)
    parts = F.split(p, "/")
    n = F.size(parts)
    name = F.regexp_extract(F.element_at(parts, -1), r"^(.*)\.[cm]?[jt]sx?$", 1)
    start = F.when(F.element_at(parts, 1) == "src", 2).otherwise(1)
    router = F.get(parts, start - 1)
    inner = F.slice(parts, start + 1, F.greatest(n - start - 1, F.lit(0)))
    spell = lambda s: F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^\[\[\.\.\.([^\]]+)\]\]$", ":$1*"), r"^\[\.\.\.([^\]]+)\]$", ":$1+"), r"^\[([^\]]+)\]$", ":$1")
    joined = lambda segments: F.concat(F.lit("/"), F.array_join(F.transform(segments, spell), "/"))
    shown = F.filter(inner, lambda s: ~s.rlike(r"^\([^)]*\)$") & ~F.startswith(s, F.lit("@")))
    caught = F.exists(inner, lambda s: s.rlike(r"^\(\.{1,3}\)"))
    private = F.exists(inner, lambda s: F.startswith(s, F.lit("_")))
    special = ["layout", "template", "loading", "error", "not-found", "default", "global-error"]
    kind = F.when(name == "page", "page").when(name == "route", "route_handler").when(name.isin(special), "layout")
    app = F.when(kind.isNotNull() & ~private, F.struct(kind.alias("kind"), F.lit("app").alias("router"), name.alias("role"), F.when(~caught, joined(shown)).alias("route_pattern")))
    inside = F.when(name == "index", inner).otherwise(F.concat(inner, F.array(name)))
    api = F.get(inside, F.lit(0)) == "api"
    own = name.isin("_app", "_document", "_error") & (F.size(inner) == 0)
    page_kind = F.when(F.coalesce(api, F.lit(False)) & (F.size(inner) > 0), "route_handler").when(own, "special_file").otherwise("page")
    seen = F.filter(inside, lambda s: ~s.rlike(r"^\([^)]*\)$") & ~F.startswith(s, F.lit("@")))
    pages = F.when((name != "") & ~private, F.struct(page_kind.alias("kind"), F.lit("pages").alias("router"), name.alias("role"), F.when(~own & ~caught, joined(seen)).alias("route_pattern")))
    return F.when((router == "app") & (n > start), app).when((router == "pages") & (n > start), pages)


def node_id(resolution: str | Column, file_id: str | Column, package: str | Column) -> Column:
    """``file:``, ``external:`` or ``builtin:node:`` ids; unresolved edges have none."""
    r, p = as_column(resolution), as_column(package)
    return F.when(r == "local", F.concat(F.lit("file:"), as_column(file_id))).when(r == "external", F.concat(F.lit("external:"), p)).when(r == "builtin", F.concat(F.lit("builtin:node:"), F.regexp_replace(p, "^node:", "")))


def byte_slice(content: str | Column, start, end) -> Column:
    """Bytes ``start`` to ``end`` as text; null unless they are valid UTF-8."""
    part = F.substring(as_column(content), as_column(start) + 1, as_column(end) - as_column(start))
    return F.when(F.is_valid_utf8(part), part.cast("string"))


def line_col(content: str | Column, offset) -> Column:
    """0-based line and byte column of a byte offset in a text, as a struct; null inside a character."""
    before = byte_slice(as_column(content).cast("binary"), F.lit(0), offset)
    lines = F.split(before, "\n")
    return F.struct((F.size(lines) - 1).alias("line"), F.octet_length(F.element_at(lines, -1)).alias("col"))


def millis_between(start: str | Column, end: str | Column) -> Column:
    return F.unix_millis(as_column(end)) - F.unix_millis(as_column(start))


def package_facts(content: str | Column) -> Column:
    """Struct (name, dependencies, warning) of a package.json text: sorted distinct names of its dependency sections."""
    maps = [f"{s} map<string,string>" for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    read = F.from_json(as_column(content), "name string, " + ", ".join(maps) + ", bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    none = F.array().cast("array<string>")
    names = F.array_sort(F.array_distinct(F.concat(*(F.coalesce(F.map_keys(read[m.split()[0]]), none) for m in maps))))
    return F.struct(read["name"].alias("name"), names.alias("dependencies"), read["bad"].isNotNull().alias("warning"))


def static_get(value: str | Column, path: str) -> Column:
    """A property of a static argument tree, kept as JSON text."""
    return F.get_json_object(as_column(value), path)
