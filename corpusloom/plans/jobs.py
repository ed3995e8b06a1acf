"""Composite jobs: from file contents to a searchable catalog, stage by stage, for all projects at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import budgets, catalog, chunks, evidence, files, graph, imports
from corpusloom.operators.facts import index_frameworks
from corpusloom.operators.source_scan import scan_symbols
from corpusloom.operators.symbols import build_symbols
from corpusloom.plans.tables import materialize


def index_sources(contents: DataFrame, max_bytes: int = 1 << 20, max_total: int = 256 << 20) -> DataFrame:
    """Fingerprints, languages and the sticky byte budget; contents never enter the budget's window."""
    marked = files.fingerprint(contents, max_bytes)
    light = marked.select("project_id", "path", "size_bytes", "status", "skip_reason", "content_hash", "language")
    return budgets.byte_budget(light, max_total).withColumn("content_hash", F.when(F.col("status") == "ready", F.col("content_hash")))


class DependencyIndex(NamedTuple):
    """``edges`` resolved; ``files`` one row a ready file with what became of it; ``runs`` one row a project."""

    edges: DataFrame
    files: DataFrame
    runs: DataFrame


FILE_ROW = "project_id string, path string, content_hash string, extractor string, status string, n_edges long, omitted_edges long, n_bindings long, omitted_bindings long"


def index_dependencies(
    sources: DataFrame, contents: DataFrame, extractor: Callable = imports.scan_imports, previous: DependencyIndex | None = None, max_edges: int = 100_000, max_bindings: int = 250_000, per_file: int = 1_000, **context: DataFrame
) -> DependencyIndex:
    """Edges of all ready files: extracted where content or extractor changed, else from ``previous``; all are resolved anew.

    A file of another language is ``unsupported``; one that lost edges to ``per_file`` or
    to the project's totals is ``limited`` and extracted again next time; all others,
    also those without a single import, are ``parsed`` and not read again (``reused``)
    while content and extractor stay. The totals are those of ``recovering_budget``.
    ``context`` goes to ``resolve_imports``: aliases, configs, packages, others.
    """
    ready = sources.where("status = 'ready'").select("project_id", "path", "language", "content_hash")
    fits = F.col("language").isin(*imports.LANGUAGES)
    ready = ready.withColumn("extractor", F.when(fits, F.lit(imports.IDENTITY)).otherwise(F.concat(F.lit("unsupported:"), F.coalesce("language", F.lit("")))))
    key = ["project_id", "path", "content_hash", "extractor"]
    todo, kept = ready.where(fits), None
    if previous is not None:
        done = previous.files.where("status = 'parsed'").select(*key).join(ready, key, "left_semi")
        todo = todo.join(done, key, "left_anti")
        kept = previous.edges.join(done.select("project_id", F.col("path").alias("source_path"), "content_hash", "extractor"), ["project_id", "source_path", "content_hash", "extractor"], "left_semi")
        ready = ready.join(done.withColumn("reused", F.lit(True)), key, "left")
    else:
        ready = ready.withColumn("reused", F.lit(None).cast("boolean"))
    texts = contents.select("project_id", "path", F.col("content").cast("string").alias("text")).join(todo.select("project_id", "path", "language"), ["project_id", "path"])
    edges = imports.extract_dependencies(texts, extractor, per_file)
    hashes = ready.select("project_id", F.col("path").alias("source_path"), "content_hash", "extractor")
    edges = edges.join(hashes, ["project_id", "source_path"])
    if kept is not None:
        edges = edges.unionByName(kept.select(*edges.columns))
    edges = materialize(edges.withColumn("n_bindings", F.size("bindings").cast("long")), "edges")
    taken, budget = budgets.recovering_budget(edges, max_edges, max_bindings)
    cut = edges.groupBy("project_id", "source_path").agg(F.max("omitted").alias("cut"))
    counts = budget.join(cut, ["project_id", "source_path"]).withColumnRenamed("source_path", "path")
    files = ready.join(counts, ["project_id", "path"], "left").na.fill(0, ["n_edges", "kept_edges", "n_bindings", "kept_bindings", "cut"])
    lost = F.col("n_edges") - F.col("kept_edges") + F.col("cut")
    status = F.when(~fits, "unsupported").when(lost > 0, "limited").otherwise("parsed")
    files = files.select(*key, status.alias("status"), F.col("kept_edges").cast("long").alias("n_edges"), lost.cast("long").alias("omitted_edges"), F.col("kept_bindings").cast("long").alias("n_bindings"), (F.col("n_bindings") - F.col("kept_bindings")).cast("long").alias("omitted_bindings"), F.coalesce("reused", F.lit(False)).alias("reused"), F.when(F.col("cut") > 0, F.array_compact(F.array(F.lit("file_edges"), "reason"))).otherwise(F.array_compact(F.array("reason"))).alias("reasons"))
    files = materialize(files, "files")
    found = materialize(graph.resolve_imports(taken, ready, **context), "resolved")
    parsed = files.groupBy("project_id").agg(
        F.count_if((F.col("status") != "unsupported") & ~F.col("reused")).alias("parsed_files"), F.count_if("reused").alias("reused_files"), F.count_if(F.col("status") == "unsupported").alias("unsupported_files"),
        F.sum("omitted_edges").alias("omitted_edges"), F.sum("omitted_bindings").alias("omitted_bindings"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("limit_reasons"),
    )
    runs = parsed.join(catalog.edge_summary(found), "project_id", "left").na.fill(0, ["edges", "bindings", "local", "external", "builtin", "unresolved"])
    runs = runs.withColumn("status", F.when(F.size("limit_reasons") > 0, "limited").otherwise("completed"))
    return DependencyIndex(found, files, runs)


class EvidenceIndex(NamedTuple):
    """Evidence and declarations of all ready files, and one row a file with what became of it."""

    evidence: DataFrame
    declarations: DataFrame
    files: DataFrame


def index_evidence(
    sources: DataFrame, contents: DataFrame, scan: Callable = evidence.scan_evidence, declare: Callable = scan_symbols, previous: EvidenceIndex | None = None, max_evidence: int = 5_000, max_name_bytes: int = 512
) -> EvidenceIndex:
    """What ``index_frameworks`` and ``build_symbols`` need of all ready files; a file whose content and extractor stay is not read again.

    Its rows are carried over from ``previous`` by an equi-join on path and content hash.
    A file that lost rows to a limit, or for which an extractor raised, is read again.
    Facts are joins over all rows, also the carried ones, so a changed package or import
    elsewhere shows in them without reading a file anew.
    """
    ready = sources.where("status = 'ready'").select("project_id", "path", "language", "content_hash")
    ready = ready.where(F.col("language").isin(*imports.LANGUAGES)).withColumn("extractor", F.lit(evidence.IDENTITY))
    key = ["project_id", "path", "content_hash", "extractor"]
    todo, done = ready, None
    if previous is not None:
        done = materialize(previous.files.where("status = 'parsed'").select(*key).join(ready, key, "left_semi"), "done")
        todo = ready.join(done, key, "left_anti")
    texts = contents.select("project_id", "path", F.col("content").cast("string").alias("text")).join(todo.select("project_id", "path", "language"), ["project_id", "path"])
    rows, errors = evidence.guarded(texts, evidence.ROW, scan)
    found, omissions = evidence.keyed(rows, max_evidence, max_name_bytes)
    declared, undeclared = evidence.guarded(texts, evidence.DECLARATION, declare)
    failed = errors.unionByName(undeclared).groupBy("project_id", "path").agg(F.min("error").alias("error"))
    files = todo.join(failed, ["project_id", "path"], "left").join(omissions.select("project_id", "path", F.lit(True).alias("cut")), ["project_id", "path"], "left")
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("cut"), "limited").otherwise("parsed")
    files = files.select(*key, status.alias("status"), "error", F.lit(False).alias("reused"))
    if done is not None:
        same = done.select("project_id", "path")
        found = found.unionByName(previous.evidence.join(same, ["project_id", "path"], "left_semi").select(*found.columns))
        declared = declared.unionByName(previous.declarations.join(same, ["project_id", "path"], "left_semi"))
        files = files.unionByName(done.select(*key, F.lit("parsed").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(True).alias("reused")))
    return EvidenceIndex(materialize(found, "evidence"), materialize(declared, "declarations"), materialize(files, "files"))


STAGES = ("source", "symbols", "dependencies", "frameworks", "chunks", "embeddings")


def run_pipeline(contents: DataFrame, embed_fn: Callable, dimensions: int, identity: str, prior: DataFrame | None = None, extractors: dict[str, Callable] | None = None, max_symbols: int = 100_000) -> dict[str, DataFrame]:
    """All stages in order for all projects at once, and ``runs``, a run log with one row a project and stage that it came to.

    Each stage is written before the next reads it. A project whose files met a budget is
    limited, not failed, and goes on with what it has. Where an extractor or ``embed_fn``
    raises, the task goes on and the project's stage is ``failed`` with the error; later
    stages leave that project out, all others are complete.
    """
    used = {"symbols": scan_symbols, "dependencies": imports.scan_imports, "frameworks": evidence.scan_evidence} | (extractors or {})
    sources = materialize(index_sources(contents), "sources")
    projects = sources.select("project_id").distinct()
    limits = sources.groupBy("project_id").agg(F.array_compact(F.array(F.max(F.when(F.col("skip_reason") == "run_limit", "run_limit")))).alias("limit_reasons"))
    log = [_logged("source", projects, sources, limits, None)]
    ready = sources.where("status = 'ready'").select("project_id", "path", "language")
    texts = contents.select("project_id", "path", F.col("content").cast("string").alias("text")).join(ready, ["project_id", "path"])
    out = {"sources": sources}

    def left(failed: DataFrame | None) -> DataFrame:
        return projects if failed is None else projects.join(failed.select("project_id").distinct(), "project_id", "left_anti")

    def own(rows: DataFrame) -> DataFrame:
        return rows.join(projects, "project_id", "left_semi")

    declared, errors = evidence.guarded(own(texts), evidence.DECLARATION, used["symbols"])
    symbols, _ = budgets.saturating_budget(build_symbols(declared), ["path", "start_byte", "identity_key"], max_symbols)
    out["symbols"] = materialize(symbols, "symbols")
    log.append(_logged("symbols", projects, out["symbols"], None, errors))
    projects = materialize(left(errors), "projects")

    _, errors = evidence.guarded(own(texts), "found int", lambda language, text: [{"found": len(used["dependencies"](language, text))}])
    alive = materialize(left(errors), "projects")
    index = index_dependencies(sources.join(alive, "project_id", "left_semi"), contents, used["dependencies"])
    out["edges"] = index.edges
    log.append(_logged("dependencies", projects, index.edges, index.runs.select("project_id", "limit_reasons"), errors))
    projects = alive

    rows, errors = evidence.guarded(own(texts), evidence.ROW, used["frameworks"])
    alive = materialize(left(errors), "projects")
    found, _ = evidence.keyed(rows.join(alive, "project_id", "left_semi"))
    listing = ready.join(alive, "project_id", "left_semi").select("project_id", "path")
    packages = texts.where(F.element_at(F.split("path", "/"), -1) == "package.json").join(alive, "project_id", "left_semi").select("project_id", "path", "text")
    _, facts = index_frameworks(listing, packages, own(index.edges), found.drop("end_byte"), out["symbols"].join(alive, "project_id", "left_semi"))
    out["entities"], out["relationships"] = materialize(facts.entities, "entities"), materialize(facts.relationships, "relationships")
    log.append(_logged("frameworks", projects, out["entities"], None, errors))
    projects = alive

    out["chunks"] = materialize(chunks.chunk_sources(own(texts), own(out["symbols"])), "chunks")
    log.append(_logged("chunks", projects, out["chunks"], None, None))
    old = prior if prior is not None else out["chunks"].limit(0).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("identity", F.lit(""))
    vectors = materialize(chunks.index_embeddings(out["chunks"], old, embed_fn, dimensions, identity, strict=False), "vectors")
    errors = vectors.where("embedding IS NULL").groupBy("project_id").agg(F.lit("embedding_failed").alias("error"))
    out["vectors"] = vectors.join(errors, "project_id", "left_anti")
    log.append(_logged("embeddings", projects, out["vectors"], None, errors))
    place = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage"))
    out["runs"] = materialize(reduce(DataFrame.unionByName, log).withColumn("place", place), "runs")
    return out


def _logged(stage: str, projects: DataFrame, rows: DataFrame, limits: DataFrame | None, errors: DataFrame | None) -> DataFrame:
    """The log of one stage: each project that came to it, with the rows it has and why it is limited or failed."""
    log = projects.join(rows.groupBy("project_id").agg(F.count("*").alias("rows")), "project_id", "left")
    log = log.join(limits, "project_id", "left") if limits is not None else log.withColumn("limit_reasons", F.array().cast("array<string>"))
    log = log.join(errors.groupBy("project_id").agg(F.min("error").alias("error")), "project_id", "left") if errors is not None else log.withColumn("error", F.lit(None).cast("string"))
    reasons = F.coalesce("limit_reasons", F.array().cast("array<string>"))
    status = F.when(F.col("error").isNotNull(), "failed").when(F.size(reasons) > 0, "limited").otherwise("completed")
    return log.select("project_id", F.lit(stage).alias("stage"), F.when(F.col("error").isNull(), F.coalesce("rows", F.lit(0))).otherwise(0).alias("rows"), status.alias("status"), reasons.alias("limit_reasons"), "error")
