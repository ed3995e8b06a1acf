"""Dependency edges: resolution of imports by joins, and breadth-first neighbourhoods."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.scalar import external_package, node_id
from corpusloom.operators.paths import nearest_config, nearest_package, parent
from corpusloom.plans.tables import materialize

# Modules of the runtime itself, and those that are only known by the prefix node:.
BUILTINS = "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib assert/strict dns/promises fs/promises inspector/promises path/posix path/win32 readline/promises stream/consumers stream/promises stream/web timers/promises util/types".split()
PREFIXED = "sea sqlite test test/reporters".split()
ENDINGS = [".ts", ".tsx", ".d.ts", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json"]
SWAPS = {".js": [".ts", ".tsx", ".d.ts"], ".jsx": [".tsx"], ".mjs": [".mts"], ".cjs": [".cts"]}


def _joined(base, rest):
    """``base/rest`` with ``.`` and ``..`` resolved; null where it leaves the project."""
    parts = F.filter(F.split(F.concat_ws("/", F.nullif(base, F.lit(".")), rest), "/"), lambda s: (s != "") & (s != "."))
    up = lambda at, s: F.when(at.isNull(), None).when(s == "..", F.when(F.size(at) > 0, F.slice(at, 1, F.size(at) - 1))).otherwise(F.array_append(at, s))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def config_aliases(configs: DataFrame) -> DataFrame:
    """``configs(project_id, path, text)`` of tsconfig and jsconfig files -> project_id, config, pattern, target, place.

    Targets are paths from the project's top: ``paths`` below ``baseUrl`` below the
    config's directory. Comments are skipped; ``extends`` is not followed; text that is
    no JSON, or has no paths, gives no rows.
    """
    options = F.from_json("text", "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>", {"allowComments": "true"})
    base = _joined(parent(F.col("path")), F.coalesce(F.col("o.compilerOptions.baseUrl"), F.lit(".")))
    rows = configs.withColumn("o", options).select("project_id", F.col("path").alias("config"), base.alias("base"), F.explode("o.compilerOptions.paths").alias("pattern", "targets"))
    rows = rows.select("project_id", "config", "base", "pattern", F.posexplode("targets").alias("place", "target"))
    return rows.select("project_id", "config", "pattern", _joined(F.col("base"), F.col("target")).alias("target"), "place")


def package_targets(packages: DataFrame) -> DataFrame:
    """``packages(project_id, path, text)`` of package.json files -> project_id, root, pattern, mode, target, place.

    What a package's own files may import by its ``imports`` (``#...``) and, by its own
    name, from its ``exports``. A target is text or an object of conditions, of which the
    first that holds counts: types, node, default and the ``mode`` (import or require).
    """
    kinds = "struct<name:string,imports:map<string,string>,exports:string>"
    own = packages.withColumn("j", F.from_json("text", kinds)).select("project_id", parent(F.col("path")).alias("root"), "j.*")
    inner = own.select("project_id", "root", F.explode("imports").alias("pattern", "to"))
    plain = F.startswith(F.ltrim("exports"), F.lit("{"))
    listed = F.when(plain, F.from_json("exports", "map<string,string>"))
    whole = ~plain | ~F.exists(F.map_keys(listed), lambda k: F.startswith(k, F.lit(".")))
    table_ = F.when(F.coalesce(whole, F.lit(False)), F.create_map(F.lit("."), F.col("exports"))).otherwise(listed)
    outer = own.where("name IS NOT NULL AND exports IS NOT NULL").select("project_id", "root", "name", F.explode(table_).alias("key", "to"))
    outer = outer.select("project_id", "root", F.concat("name", F.expr("substring(key, 2)")).alias("pattern"), "to")
    rows = inner.unionByName(outer).withColumn("mode", F.explode(F.array(F.lit("import"), F.lit("require"))))
    conditions = F.from_json("to", "map<string,string>")
    holds = F.filter(F.map_keys(conditions), lambda k: k.isin("types", "node", "default") | (k == F.col("mode")))
    target = F.when(F.startswith("to", F.lit("{")), F.try_element_at(conditions, F.get(holds, F.lit(0)))).otherwise(F.col("to"))
    return rows.select("project_id", "root", "pattern", "mode", _joined(F.col("root"), target).alias("target"), F.lit(0).alias("place")).where("target IS NOT NULL")


def _matched(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """``asked(project_id, scope, specifier, mode)`` with the targets of the best pattern of its scope, ``*`` filled in.

    A pattern without ``*`` comes first, then the one with the longest text before it.
    Rules are met by an equi-join on that text, of the lengths that the scope has.
    """
    star = F.contains("pattern", F.lit("*"))
    head, tail = F.when(star, F.substring_index("pattern", "*", 1)).otherwise(F.col("pattern")), F.when(star, F.substring_index("pattern", "*", -1))
    rules = rules.select("project_id", "scope", "target", "place", F.col("mode").alias("of"), star.alias("star"), head.alias("head"), tail.alias("tail"))
    lengths = rules.groupBy("project_id", "scope").agg(F.collect_set(F.length("head")).alias("lengths"))
    cut = asked.join(lengths, ["project_id", "scope"]).withColumn("n", F.explode("lengths")).where("n <= length(specifier)").withColumn("head", F.expr("substring(specifier, 1, n)")).drop("lengths")
    fits = F.when(F.col("star"), F.endswith("specifier", F.col("tail")) & (F.length("specifier") >= F.col("n") + F.length("tail"))).otherwise(F.col("specifier") == F.col("head"))
    hit = cut.join(rules, ["project_id", "scope", "head"]).where(fits & (F.col("of").isNull() | (F.col("of") == F.col("mode"))))
    rank = F.struct((~F.col("star")).alias("exact"), "n")
    hit = hit.withColumn("best", F.max(rank).over(Window.partitionBy("project_id", "scope", "specifier", "mode"))).where(rank == F.col("best"))
    inner = F.expr("substring(specifier, n + 1, length(specifier) - n - length(tail))")
    return hit.select("project_id", "scope", "specifier", "mode", F.when(F.col("star"), F.replace("target", F.lit("*"), inner)).otherwise(F.col("target")).alias("base"), "place")


def resolve_imports(edges: DataFrame, files: DataFrame, aliases: DataFrame | None = None, configs: DataFrame | None = None, packages: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """Adds resolution_kind, target_path, external_package and unresolved_reason to ``edges(project_id, source_path, specifier)``.

    ``files(project_id, path)`` is the catalog. ``aliases`` are rows of ``config_aliases``:
    a file sees those of its nearest config among ``configs(project_id, path)``, by default
    the configs that have aliases; rows without a ``config`` hold in the whole project.
    ``packages(project_id, path, text)`` are package.json files: a file sees the imports
    of its nearest package and, by that package's own name, its exports; what has that
    name and is not found is unresolved, not external. ``kind`` ``require`` of an edge
    asks for conditions of require. A target among ``others(project_id, path)``, files of
    the project that are no sources, is unresolved, not_in_source_catalog, as is an edge
    whose own file is not in the catalog.

    Distinct (directory, specifier, mode) are resolved once: candidate paths are exploded
    with their priority and met with the catalog by one equi-join.
    """
    mode = F.when(F.col("kind") == "require", "require").otherwise("import") if "kind" in edges.columns else F.lit("import")
    asking = edges.withColumn("dir", parent(F.col("source_path"))).withColumn("mode", mode)
    asked = asking.select("project_id", "dir", "specifier", "mode").distinct()
    s = F.col("specifier")
    bare = F.regexp_replace(s, "^node:", "")
    relative = s.rlike(r"^\.{1,2}(/|$)")
    local = _joined(F.col("dir"), s)
    early = F.when((s == "") | F.contains(s, F.lit("\0")), "unresolved:invalid_specifier").when(bare.isin(*BUILTINS) | (F.startswith(s, F.lit("node:")) & bare.isin(*PREFIXED)), "builtin").when(F.startswith(s, F.lit("/")) | F.startswith(s, F.lit("\\\\")) | s.rlike(r"^[A-Za-z]:[\\/]"), "unresolved:outside_project").when(F.contains(s, F.lit("\\")), "unresolved:invalid_specifier").when(s.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "unresolved:unsupported_scheme").when((s == "#") | F.startswith(s, F.lit("#/")), "unresolved:invalid_specifier").when(relative & local.isNull(), "unresolved:outside_project")
    asked = asked.withColumn("early", early).withColumn("relative", relative)
    key = ["project_id", "dir", "specifier", "mode"]
    bases = asked.where("early IS NULL AND relative").select(*key, local.alias("base"), F.lit(0).alias("way"), F.lit(0).alias("place"))
    named = asked.where("early IS NULL AND NOT relative").select(*key)
    dirs = named.select("project_id", "dir").distinct().select("project_id", F.concat("dir", F.lit("/x")).alias("path"), "dir")
    dirs = dirs.withColumn("path", F.when(F.col("dir") == ".", F.lit("x")).otherwise(F.col("path")))
    claims = []
    if aliases is not None:
        scoped = "config" in aliases.columns
        place = F.col("place") if "place" in aliases.columns else F.lit(0)
        rules = aliases.select("project_id", (F.col("config") if scoped else F.lit("")).alias("scope"), "pattern", "target", place.alias("place"), F.lit(None).cast("string").alias("mode"))
        own = nearest_config(dirs, configs if configs is not None else aliases.select("project_id", F.col("config").alias("path")).distinct()) if scoped else dirs.select("project_id", "path", F.lit("").alias("config"))
        at = dirs.join(own, ["project_id", "path"]).where("config IS NOT NULL").select("project_id", "dir", F.col("config").alias("scope"))
        asks = named.join(at, ["project_id", "dir"])
        hit = _matched(asks.select("project_id", "scope", "specifier", "mode").distinct(), rules).join(asks, ["project_id", "scope", "specifier", "mode"])
        bases = bases.unionByName(hit.select(*key, "base", F.lit(1).alias("way"), "place"))
        claims.append(hit.select(*key))
    if packages is not None:
        rules = package_targets(packages).withColumnRenamed("root", "scope")
        roots = packages.select("project_id", parent(F.col("path")).alias("root"), F.get_json_object("text", "$.name").alias("name"))
        at = dirs.join(nearest_package(dirs, roots.select("project_id", "root")), ["project_id", "path"]).select("project_id", "dir", "root")
        asks = named.join(at.withColumnRenamed("root", "scope"), ["project_id", "dir"])
        hit = _matched(asks.select("project_id", "scope", "specifier", "mode").distinct(), rules).join(asks, ["project_id", "scope", "specifier", "mode"])
        bases = bases.unionByName(hit.select(*key, "base", F.lit(2).alias("way"), "place"))
        mine = asks.join(roots.select("project_id", F.col("root").alias("scope"), "name"), ["project_id", "scope"])
        claims.append(mine.where((s == F.col("name")) | F.startswith(s, F.concat("name", F.lit("/")))).select(*key))
    swaps = [F.when(F.endswith("base", F.lit(old)), F.concat(F.expr(f"substring(base, 1, length(base) - {len(old)})"), F.lit(new))) for old, news in SWAPS.items() for new in news]
    tries = F.array_compact(F.array(*swaps, F.col("base"), *(F.concat("base", F.lit(e)) for e in ENDINGS), *(F.concat_ws("/", F.nullif("base", F.lit("")), F.lit("index" + e)) for e in ENDINGS)))
    candidates = bases.select(*key, "way", F.col("place").alias("turn"), F.posexplode(tries).alias("place", "path"))
    targets = files.select("project_id", "path", F.lit(True).alias("source")).distinct()
    if others is not None:
        outside = others.select("project_id", "path").join(targets, ["project_id", "path"], "left_anti").distinct()
        targets = targets.unionByName(outside.withColumn("source", F.lit(False)))
    hits = candidates.join(targets, ["project_id", "path"])
    best = hits.groupBy(*key).agg(F.min_by(F.struct("path", "source"), F.struct("way", "turn", "place", "path")).alias("to"))
    out = asked.join(best, key, "left")
    claimed = reduce(DataFrame.union, claims).distinct().withColumn("claimed", F.lit(True)) if claims else None
    out = out.join(claimed, key, "left") if claimed is not None else out.withColumn("claimed", F.lit(None).cast("boolean"))
    package = external_package("specifier")
    missing = F.col("relative") | F.startswith(s, F.lit("#")) | F.coalesce("claimed", F.lit(False))
    kind = F.when(F.col("early") == "builtin", "builtin").when(F.col("early").isNotNull(), "unresolved").when(F.col("to.source"), "local").when(F.col("to").isNotNull() | missing | package.isNull(), "unresolved").otherwise("external")
    reason = F.when(F.col("early") != "builtin", F.substring_index("early", ":", -1)).when(kind == "unresolved", F.when(F.col("to").isNotNull(), "not_in_source_catalog").when(missing | package.isNotNull(), "not_found").otherwise("invalid_specifier"))
    out = out.select(*key, kind.alias("resolution_kind"), F.when(F.col("to.source"), F.col("to.path")).alias("target_path"), F.when(kind == "external", package).when(kind == "builtin", F.concat(F.lit("node:"), bare)).alias("external_package"), reason.alias("unresolved_reason"))
    found = asking.join(out, key, "left").drop("dir", "mode")
    listed = files.select("project_id", F.col("path").alias("source_path"), F.lit(True).alias("listed")).distinct()
    found = found.join(listed, ["project_id", "source_path"], "left")
    known = lambda c, other=None: F.when(F.col("listed"), F.col(c)).otherwise(other).alias(c)
    return found.select(*edges.columns, known("resolution_kind", "unresolved"), known("target_path"), known("external_package"), known("unresolved_reason", "not_in_source_catalog"))


class Neighbourhoods(NamedTuple):
    """``edges`` (start_id, level, edge_key, source, target); ``limits`` (start_id, depth, edges, nodes): where a limit left something out."""

    edges: DataFrame
    limits: DataFrame | None


def traverse(edges: DataFrame, starts: DataFrame, direction: str = "outgoing", depth: int = 2, max_nodes: int | None = None, max_edges: int | None = None, flags: bool = False) -> Neighbourhoods:
    """Breadth-first neighbourhoods of ``starts(start_id, node)`` over ``edges(edge_key, source, target)``, with ``start_byte`` where there is one.

    An edge without a target, or to a node without edges, ends there. Each level joins
    the frontier with the edges once and is written to the shared folder, so that plans
    do not grow with the depth; cycles end by themselves. Nodes reached by the last level
    are looked at only for ``flags``.

    Caps are per start. A level takes edges by source, start byte and key while they fit
    into ``max_edges``. Of these, an edge to a node that would pass ``max_nodes`` (the
    start counts as one) is left out, while later edges between known nodes still enter:
    so the new nodes of a level are taken in the order of their first edges. ``limits``
    has a row a start if ``flags``: ``edges`` if a level had more of them, or the cap was
    met with nodes still to expand; ``nodes`` if an edge was left out; ``depth`` if the
    last level reached nodes with edges that were not seen.
    """
    place = F.col("start_byte") if "start_byte" in edges.columns else F.lit(0)
    rows = materialize(edges.select("edge_key", "source", "target", place.alias("at")), "edges")  # every level reads them
    out, back = rows.select("*", F.col("source").alias("node"), F.col("target").alias("next")), rows.select("*", F.col("target").alias("node"), F.col("source").alias("next"))
    ways = {"outgoing": out, "incoming": back, "both": out.union(back)}[direction]
    capped = max_nodes is not None or max_edges is not None
    firsts, degrees = ways, None
    if max_edges is not None and direction != "both":
        # A start takes no more than these of a node, and by source no node after those that fill its cap.
        own = Window.partitionBy("node").orderBy("source", "at", "edge_key")
        firsts = ways.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= max_edges + 1).drop("nth")
        firsts = materialize(firsts, "first-edges")
        degrees = materialize(firsts.groupBy("node").agg(F.count("*").alias("n")), "degrees") if direction == "outgoing" else None
    frontier = first = materialize(starts.select("start_id", "node").distinct(), "starts")
    seen, found, paged, notes = frontier, None, None, []
    for level in range(1, depth + 1):
        near = _fitting(frontier, degrees, max_edges) if degrees is not None else frontier
        step = _unseen(near.join(firsts, "node"), paged, direction).withColumn("level", F.lit(level))
        if capped:
            step = materialize(_admitted(step, seen, found, max_nodes, max_edges), "page")
            notes.append(step.groupBy("start_id").agg(F.max("more").alias("edges"), F.max(~F.col("kept")).alias("nodes")))
            paged = step if paged is None else paged.unionByName(step)
            step = step.where("kept").drop("kept", "more")
        else:
            if level < depth or flags:  # the last one, by far the largest, goes straight to whoever asks
                step = materialize(step, "level")
            paged = step if paged is None else paged.unionByName(step)
        found = step if found is None else found.unionByName(step)
        if level == depth and not flags:
            break
        reached = step.select("start_id", F.col("next").alias("node")).where("node IS NOT NULL").distinct()
        frontier = materialize(reached.join(seen, ["start_id", "node"], "left_anti"), "frontier")
        seen = seen.union(frontier)
        if max_edges is not None:
            full = found.groupBy("start_id").agg(F.count("*").alias("n")).where(F.col("n") >= max_edges).select("start_id")
            notes.append(frontier.join(full, "start_id", "left_semi").select("start_id", F.lit(True).alias("edges"), F.lit(False).alias("nodes")).distinct())
            frontier = frontier.join(full, "start_id", "left_anti")
        if frontier.isEmpty():
            break
    kept = found.select("start_id", "level", "edge_key", "source", "target")
    if not flags:
        return Neighbourhoods(kept, None)
    far = _unseen(frontier.join(ways, "node"), paged, direction) if direction == "both" else frontier.join(ways.select("node").distinct(), "node", "left_semi")
    beyond = far.select("start_id", F.lit(True).alias("depth")).distinct()
    every = first.select("start_id").distinct().join(beyond, "start_id", "left")
    met = reduce(DataFrame.unionByName, notes).groupBy("start_id").agg(F.max("edges").alias("edges"), F.max("nodes").alias("nodes")) if notes else None
    every = every.join(met, "start_id", "left") if met is not None else every.select("*", F.lit(False).alias("edges"), F.lit(False).alias("nodes"))
    return Neighbourhoods(kept, every.select("start_id", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("depth", "edges", "nodes"))))


def _fitting(frontier: DataFrame, degrees: DataFrame, max_edges: int) -> DataFrame:
    """The nodes of each start that can have one of its first ``max_edges`` + 1 edges by source; ``degrees`` are numbers of edges up to that."""
    before = Window.partitionBy("start_id").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    return frontier.join(degrees, "node").withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") <= max_edges).select("start_id", "node")


def _unseen(step: DataFrame, paged: DataFrame | None, direction: str) -> DataFrame:
    """One row a start and edge. Only when edges are followed both ways can one be met again; then ``next`` is null if both ends are known."""
    if direction != "both":
        return step.drop("node")
    if paged is not None:
        step = step.join(paged.select("start_id", "edge_key"), ["start_id", "edge_key"], "left_anti")
    ends = F.collect_set("next")
    return step.groupBy("start_id", "edge_key", "source", "target", "at").agg(F.when(F.size(ends) == 1, F.get(ends, F.lit(0))).alias("next"))


def _admitted(step: DataFrame, seen: DataFrame, found: DataFrame | None, max_nodes: int | None, max_edges: int | None) -> DataFrame:
    """The edges of a level that fit into ``max_edges``: ``kept`` if their nodes fit too, ``more`` if the level had others."""
    own = Window.partitionBy("start_id")
    step = step.withColumn("pos", F.row_number().over(own.orderBy("source", "at", "edge_key")))
    if max_edges is not None:
        had = found.groupBy("start_id").agg(F.count("*").alias("had")) if found is not None else None
        step = step.where(F.col("pos") <= max_edges + 1)
        step = step.join(had, "start_id", "left") if had is not None else step.withColumn("had", F.lit(0))
        over = F.col("pos") + F.coalesce("had", F.lit(0)) > max_edges
        step = step.withColumn("more", F.max(over).over(own)).where(~over).drop("had")
    else:
        step = step.withColumn("more", F.lit(False))
    if max_nodes is None:
        return step.withColumn("kept", F.lit(True)).drop("pos")
    known = seen.select("start_id", F.col("node").alias("next"), F.lit(True).alias("known"))
    step = step.join(known, ["start_id", "next"], "left")
    new = step.where("next IS NOT NULL AND known IS NULL").groupBy("start_id", "next").agg(F.min("pos").alias("first"))
    room = seen.groupBy("start_id").agg((F.lit(max_nodes) - F.count("*")).alias("room"))
    taken = new.withColumn("nth", F.row_number().over(own.orderBy("first"))).join(room, "start_id").where("nth <= room").select("start_id", "next", F.lit(True).alias("fits"))
    step = step.join(taken, ["start_id", "next"], "left")
    return step.withColumn("kept", F.col("next").isNull() | F.coalesce("known", "fits", F.lit(False))).drop("pos", "known", "fits")


def edges_with_source(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Edges with the path of their file; ``missing`` marks those whose file is not in the catalog."""
    known = files.select("project_id", F.col("file_id").alias("source_file_id"), F.col("path").alias("source_path"))
    return edges.drop("source_path").join(known, ["project_id", "source_file_id"], "left").withColumn("missing", F.col("source_path").isNull())


def edge_filter(edges: DataFrame, kinds: list[str] | None = None, resolutions: list[str] | None = None, frontier: DataFrame | None = None, direction: str = "outgoing") -> DataFrame:
    """Edges of these kinds and resolutions, and of ``frontier(project_id, node)``: those that leave its nodes, enter them, or both."""
    out = edges.where(F.col("kind").isin(*kinds)) if kinds else edges
    out = out.where(F.col("resolution_kind").isin(*resolutions)) if resolutions else out
    if frontier is None:
        return out
    nodes = frontier.select("project_id", "node").distinct()
    at = lambda end: nodes.select("project_id", F.col("node").alias(end))
    leaving = out.join(at("source"), ["project_id", "source"], "left_semi")
    if direction == "outgoing":
        return leaving
    entering = out.join(at("target"), ["project_id", "target"], "left_semi")
    if direction == "incoming":
        return entering
    return leaving.unionByName(entering.join(at("source"), ["project_id", "source"], "left_anti"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct node ids with their type."""
    ids = edges.select("project_id", node_id("resolution_kind", "target_file_id", "external_package").alias("node_id")).where("node_id IS NOT NULL")
    return ids.distinct().withColumn("type", F.substring_index("node_id", ":", 1))
