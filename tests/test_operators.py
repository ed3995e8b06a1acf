"""Golden cases of the library's operators."""

import hashlib
import random
from datetime import UTC, datetime

import pytest
from corpusloom import queries
from corpusloom.functions import scalar as S
from corpusloom.operators import budgets, catalog, chunks, context, conversations, files, frameworks, graph, paths, search
from corpusloom.sources import sinks
from corpusloom.streaming import events as ev
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_paths(spark):
    cases = {"./packages\\api//src/main.ts": "packages/api/src/main.ts", "/abs": None, "C:/x": None, "a/../b": None, "": None, "./": None, "a\0b": None, "a": "a"}
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    assert {r.p: r.v for r in df.select("p", paths.normalize_path("p").alias("v")).collect()} == cases
    rows = spark.createDataFrame([("p", x) for x in ("a/b/c/x.ts", "a/y.ts", "z.ts", "ab/q.ts")], "project_id string, path string")
    assert {r.path for r in paths.path_prefix_filter(rows, "a").collect()} == {"a/b/c/x.ts", "a/y.ts"}
    configs = spark.createDataFrame([("p", "tsconfig.json"), ("p", "a/jsconfig.json"), ("p", "a/tsconfig.json"), ("p", "a/b/jsconfig.json")], "project_id string, path string")
    assert {r.path: r.config for r in paths.nearest_config(rows, configs).collect()} == {"a/b/c/x.ts": "a/b/jsconfig.json", "a/y.ts": "a/tsconfig.json", "z.ts": "tsconfig.json", "ab/q.ts": "tsconfig.json"}
    packages = spark.createDataFrame([("p", "a"), ("p", "a/b")], "project_id string, root string")
    assert {r.path: r.root for r in paths.nearest_package(rows, packages).collect()} == {"a/b/c/x.ts": "a/b", "a/y.ts": "a", "z.ts": ".", "ab/q.ts": "."}


def test_fingerprint(spark):
    now = datetime(2024, 1, 1)
    rows = [("p", "src/main.ts", b"hello", 5, now), ("p", "b.bin", b"a\0b", 3, now), ("p", "c.py", b"\xff\xfe", 2, now), ("p", "d.py", b"x" * 50, 50, now), ("p", "Dockerfile", b"FROM x", 6, now), ("p", "e.py", b"abc", 4, now)]
    df = spark.createDataFrame(rows, "project_id string, path string, content binary, size_bytes long, modified_at timestamp").withColumn("listed_size", F.octet_length("content"))
    out = {r.path: r for r in files.fingerprint(df, 40).collect()}
    assert out["src/main.ts"].content_hash == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824" and out["src/main.ts"].language == "typescript"
    assert {p: r.skip_reason for p, r in out.items()} == {"src/main.ts": None, "b.bin": "binary_content", "c.py": "invalid_utf8", "d.py": "too_large", "Dockerfile": None, "e.py": "inventory_stale"}
    assert out["Dockerfile"].language == "dockerfile"


def test_sticky_budget_and_walk_order(spark):
    df = spark.createDataFrame([("p", "a.ts", 8, "ready", None), ("p", "b.ts", 5, "ready", None), ("p", "c.ts", 1, "skipped", "binary_content")], "project_id string, path string, size_bytes long, status string, skip_reason string")
    assert {r.path: r.skip_reason for r in budgets.byte_budget(df, 10).collect()} == {"a.ts": None, "b.ts": "run_limit", "c.ts": "run_limit"}
    listing = spark.createDataFrame([("p", x, 1) for x in ("z.txt", "a/b.txt", "a/c/d.txt", "b.txt")], "project_id string, path string, size_bytes long")
    kept, reasons = budgets.inventory_budget(listing, 2, 100, 1)
    assert {r.path for r in kept.collect()} == {"b.txt", "z.txt"} and reasons.first().limit_reasons == ["depth_limit", "file_limit"]


def test_routes_and_packages(spark):
    cases = {
        "src/app/(marketing)/blog/[...slug]/page.tsx": ("page", "/blog/:slug+"), "app/api/[[...parts]]/route.ts": ("route_handler", "/api/:parts*"), "pages/docs/[id]/index.tsx": ("page", "/docs/:id"),
        "app/_internal/page.tsx": None, "app/feed/(.)photo/page.tsx": ("page", None), "app/page.tsx": ("page", "/"), "app/x/util.ts": None, "pages/api/hi.ts": ("route_handler", "/api/hi"), "lib/page.tsx": None,
    }
    df = spark.createDataFrame([(c,) for c in cases], "p string")
    got = {r.p: r.v and (r.v.kind, r.v.route_pattern) for r in df.select("p", S.file_route("p").alias("v")).collect()}
    assert got == cases
    names = {"react/jsx-runtime": "react", "@scope/package/subpath": "@scope/package", "@bad": None, "": None}
    assert {r.p: r.v for r in spark.createDataFrame([(c,) for c in names], "p string").select("p", S.external_package("p").alias("v")).collect()} == names
    assert one(spark, S.combine_routes(F.array(F.lit("a/"), F.lit("/a")), F.array(F.lit(""), F.lit("b//c")))) == ["/a", "/a/b/c"]
    assert one(spark, S.wildcard_match(F.lit("@root/*"), F.lit("@root/value"))) and not one(spark, S.wildcard_match(F.lit("ab*ba"), F.lit("aba")))
    assert one(spark, S.estimate_tokens(F.lit("12345678"))) == 2 and one(spark, S.utf16_length(F.lit("a😀"))) == 3
    facts = one(spark, S.package_facts(F.lit('{"name":"x","dependencies":{"b":"1","a":"1"},"devDependencies":{"a":"2"}}')))
    assert (facts.name, facts.dependencies, facts.warning) == ("x", ["a", "b"], False) and one(spark, S.package_facts(F.lit("{"))).warning


def test_imports(spark):
    catalog_ = spark.createDataFrame([("p", x) for x in ("src/main.ts", "src/value.ts", "lib/index.ts", "lib/data.json")], "project_id string, path string")
    wanted = {"./value.js": ("local", "src/value.ts", None), "../lib": ("local", "lib/index.ts", None), "@root/value": ("local", "src/value.ts", None), "@root/none": ("unresolved", None, "not_found"), "fs/promises": ("builtin", None, None), "react/jsx-runtime": ("external", None, None), "./missing.js": ("unresolved", None, "not_found"), "#missing": ("unresolved", None, "not_found"), "../../x": ("unresolved", None, "outside_project"), "/abs": ("unresolved", None, "outside_project"), "https://x/y": ("unresolved", None, "unsupported_scheme"), "": ("unresolved", None, "invalid_specifier"), "#": ("unresolved", None, "invalid_specifier"), "../lib/data.json": ("local", "lib/data.json", None)}
    edges = spark.createDataFrame([("p", "src/main.ts", s) for s in wanted], "project_id string, source_path string, specifier string")
    aliases = spark.createDataFrame([("p", "@root/*", "src/*")], "project_id string, pattern string, target string")
    out = {r.specifier: (r.resolution_kind, r.target_path, r.unresolved_reason) for r in graph.resolve_imports(edges, catalog_, aliases).collect()}
    assert out == wanted


def test_aliases_of_the_nearest_config(spark):
    catalog_ = [("p", x) for x in ("src/main.ts", "src/value.ts", "src/internal-import.ts", "src/internal-require.ts", "src/feature.ts", "packages/f/src/main.ts", "packages/f/src/value.ts", "src/deep/value.ts", "src/deep/more/x.ts")]
    files = spark.createDataFrame(catalog_, "project_id string, path string")
    text = [
        ("p", "tsconfig.json", '{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@root/*": ["none/*", "src/*"], "@root/more/*": ["src/deep/more/*"], "@one": ["src/value.ts"], "@/*": ["src/*"]}}}'),
        ("p", "packages/f/tsconfig.json", '{"compilerOptions": {"baseUrl": "src", "paths": {"@local/*": ["*"], "@/*": ["*"]}}}'),
        ("p", "broken/tsconfig.json", "{"),
    ]
    configs = spark.createDataFrame(text, "project_id string, path string, text string")
    package = '{"name": "@own/root", "imports": {"#internal": {"import": "./src/internal-import.ts", "require": "./src/internal-require.ts"}}, "exports": {"./feature": "./src/feature.ts", "./deep/*": "./src/deep/*.ts"}}'
    packages = spark.createDataFrame([("p", "package.json", package), ("p", "packages/f/package.json", '{"name": "f", "exports": "./src/main.ts"}')], configs.columns)
    top = {
        "@root/value": ("local", "src/value.ts", None), "@root/more/x": ("local", "src/deep/more/x.ts", None), "@one": ("local", "src/value.ts", None), "@one/more": ("external", None, None),
        "@/value": ("local", "src/value.ts", None), "@local/value": ("external", None, None), "@root/none": ("unresolved", None, "not_found"), "#internal": ("local", "src/internal-import.ts", None), "#none": ("unresolved", None, "not_found"),
        "@own/root/feature": ("local", "src/feature.ts", None), "@own/root/deep/value": ("local", "src/deep/value.ts", None), "@own/root/none": ("unresolved", None, "not_found"), "@own/rooted": ("external", None, None),
        "f": ("external", None, None), "./data.json": ("unresolved", None, "not_in_source_catalog"), "react": ("external", None, None),
    }
    below = {"@local/value": ("local", "packages/f/src/value.ts", None), "@/value": ("local", "packages/f/src/value.ts", None), "@root/value": ("external", None, None), "#internal": ("unresolved", None, "not_found"), "f": ("local", "packages/f/src/main.ts", None), "@own/root/feature": ("external", None, None)}
    rows = [("p", "src/main.ts", x, "import") for x in top] + [("p", "packages/f/src/main.ts", x, "import") for x in below] + [("p", "src/main.ts", "#internal", "require")]
    edges = spark.createDataFrame(rows, "project_id string, source_path string, specifier string, kind string")
    others = spark.createDataFrame([("p", "src/data.json")], "project_id string, path string")
    out = graph.resolve_imports(edges, files, graph.config_aliases(configs), configs.select("project_id", "path"), packages, others).collect()
    got = {(r.source_path, r.specifier, r.kind): (r.resolution_kind, r.target_path, r.unresolved_reason) for r in out}
    want = {("src/main.ts", x, "import"): v for x, v in top.items()} | {("packages/f/src/main.ts", x, "import"): v for x, v in below.items()} | {("src/main.ts", "#internal", "require"): ("local", "src/internal-require.ts", None)}
    assert got == want and len(out) == len(rows)


def recovered(files, max_edges, max_bindings):
    """The budget file by file, as lists of bindings a file."""
    e, b, out = max_edges, max_bindings, []
    for sizes in files:
        k = used = 0
        while e > 0 and b > 0 and k < min(len(sizes), e) and used + sizes[k] <= b:
            used += sizes[k]
            k += 1
        e, b = e - k, b - used
        out.append((k, used))
    return out


@pytest.mark.parametrize(("max_edges", "max_bindings"), [(10_000, 10_000), (90, 10_000), (10_000, 120), (150, 160), (10_000, 3), (1, 1), (0, 5), (60, 100)])
def test_recovering_budget(spark, max_edges, max_bindings):
    rng = random.Random(max_edges + max_bindings)
    projects = {p: [[rng.choice([0, 0, 1, 2, 3, 9]) for _ in range(rng.randrange(1, 6))] for _ in range(80)] for p in ("p", "q")}
    rows = [(p, f"f{i:03}", j * 10, f"k{j}", b) for p, files in projects.items() for i, sizes in enumerate(files) for j, b in enumerate(sizes)]
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, "project_id string, source_path string, start_byte int, edge_key string, n_bindings int").repartition(3)
    kept, found = budgets.recovering_budget(edges, max_edges, max_bindings)
    got = {(r.project_id, r.source_path): (r.kept_edges, r.kept_bindings) for r in found.collect()}
    want = {(p, f"f{i:03}"): x for p, files in projects.items() for i, x in enumerate(recovered(files, max_edges, max_bindings))}
    assert got == want and kept.count() == sum(k for k, _ in want.values())
    assert all((r.reason is None) == (r.kept_edges == r.n_edges) for r in found.collect())


@pytest.mark.parametrize(("max_edges", "max_bindings"), [(10_000, 120), (20, 31), (7, 12), (0, 5)])
def test_recovering_budget_goes_through_files_that_can_fit_only(spark, monkeypatch, max_edges, max_bindings):
    rng = random.Random(max_bindings)
    files = [[rng.choice([0, 1, 2, 3, 9]) for _ in range(rng.randrange(1, 6))] for _ in range(120)]
    rows = [("p", f"f{i:03}", 0, "k", b) for i, sizes in enumerate(files) for b in sizes]  # alike in their order: they go by bindings
    files, written = [sorted(sizes) for sizes in files], {}
    write = budgets.materialize
    monkeypatch.setattr(budgets, "materialize", lambda df, name: written.setdefault(name, write(df, name)))
    edges = spark.createDataFrame(rows, "project_id string, source_path string, start_byte int, edge_key string, n_bindings int").repartition(3)
    kept, found = budgets.recovering_budget(edges, max_edges, max_bindings)
    left, want = max_edges, {}
    for i, (k, used) in enumerate(recovered(files, max_edges, max_bindings)):
        want[f"f{i:03}"] = (k, used, None if k == len(files[i]) else "total_edges" if k >= left else "total_bindings")
        left -= k
    assert {r.source_path: (r.kept_edges, r.kept_bindings, r.reason) for r in found.collect()} == want
    assert sorted((r.source_path, r.n_bindings) for r in kept.collect()) == sorted((f, b) for i, (f, w) in enumerate(want.items()) for b in files[i][: w[0]])
    tail = written["tail"].collect()
    assert all(r.sums[0] <= r.r and r.e > 0 for r in tail)


def test_a_budget_that_is_met_exactly_leaves_nothing(spark):
    edges = spark.createDataFrame([("p", "a", 0, "k", 3), ("p", "b", 0, "k", 0), ("q", "a", 0, "k", 1), ("q", "b", 0, "k", 0), ("q", "c", 0, "k", 2), ("q", "d", 0, "k", 0)], "project_id string, source_path string, start_byte int, edge_key string, n_bindings int")
    found = {(r.project_id, r.source_path): (r.kept_edges, r.reason) for r in budgets.recovering_budget(edges, 9, 3)[1].collect()}
    assert found == {("p", "a"): (1, None), ("p", "b"): (0, "total_bindings"), ("q", "a"): (1, None), ("q", "b"): (1, None), ("q", "c"): (1, None), ("q", "d"): (0, "total_bindings")}


def test_saturating_budget(spark):
    df = spark.createDataFrame([("p", i % 7, i) for i in range(30)] + [("q", 1, 1)], "project_id string, a int, b int")
    kept, status = budgets.saturating_budget(df, ["a", "b"], 9)
    order = sorted((i % 7, i) for i in range(30))[:9]
    assert sorted((r.a, r.b) for r in kept.where("project_id = 'p'").collect()) == order and kept.count() == 10
    assert sorted(tuple(r) for r in status.collect()) == [("p", 9, 21, "limited"), ("q", 1, 0, "completed")]


def test_publish_changes_over_at_once(spark, tmp_path):
    path, keys = f"file://{tmp_path}", ["project_id", "path"]
    rows = lambda *r: spark.createDataFrame(list(r), "project_id string, path string, size int")
    projects = lambda *p: spark.createDataFrame([(x,) for x in p], "project_id string")
    shown = lambda df: sorted((r.project_id, r.path, r.size, r.run_id) for r in df.collect())
    assert sinks.current(spark, path, "t") is None and sinks.pointers(spark, path, "t").collect() == []
    first = sinks.publish(rows(("p", "a", 1), ("p", "b", 1), ("q", "a", 1)), projects("p", "q"), "t", keys, "r1", path)
    ids = {(r.project_id, r.path): r.id for r in first.collect()}
    one = [("p", "a", 1, "r1"), ("p", "b", 1, "r1"), ("q", "a", 1, "r1")]
    assert shown(first) == one
    run = sinks.write_run(rows(("p", "b", 2), ("p", "c", 2)), "t", keys, "r2", path)  # breaks before the pointer
    assert shown(sinks.current(spark, path, "t")) == one
    half = tmp_path / "t" / "rows" / "run=broken"  # breaks while rows are written
    half.mkdir()
    (half / "_temporary").mkdir()
    assert shown(sinks.current(spark, path, "t")) == one
    sinks.point(spark, projects("p"), "t", run, "r2", path)
    two = sinks.current(spark, path, "t")
    assert shown(two) == [("p", "b", 2, "r2"), ("p", "c", 2, "r2"), ("q", "a", 1, "r1")]
    assert {(r.project_id, r.path): r.id for r in two.collect()}["p", "b"] == ids["p", "b"]
    again = sinks.publish(rows(("p", "b", 3)), projects("p", "q"), "t", keys, "r2", path)  # the same run id, and a project that has become empty
    assert shown(again) == [("p", "b", 3, "r2")] and {(r.project_id, r.rows) for r in sinks.pointers(spark, path, "t").collect()} == {("p", 1), ("q", 0)}
    empty = sinks.replace_inventory(rows(), projects("p"), "r1", path)
    assert empty.collect() == []


def test_traverse_caps_and_cycles(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "c", "a"), ("e4", "a", "c")], "edge_key string, source string, target string")
    starts = spark.createDataFrame([(1, "a")], "start_id int, node string")
    keys = lambda df: sorted((r.level, r.edge_key) for r in df.collect())
    assert keys(graph.traverse(edges, starts, depth=5).edges) == [(1, "e1"), (1, "e4"), (2, "e2"), (2, "e3")]
    assert keys(graph.traverse(edges, starts, "incoming", 1).edges) == [(1, "e3")]
    flags = lambda found: tuple(found.limits.first())[1:]
    capped = graph.traverse(edges, starts, depth=5, max_edges=1, flags=True)
    assert keys(capped.edges) == [(1, "e1")] and flags(capped) == (False, True, False)
    capped = graph.traverse(edges, starts, depth=5, max_nodes=2, flags=True)
    assert keys(capped.edges) == [(1, "e1")] and flags(capped) == (False, False, True)
    capped = graph.traverse(edges, starts, depth=1, flags=True)
    assert keys(capped.edges) == [(1, "e1"), (1, "e4")] and flags(capped) == (True, False, False)


def test_traverse_admits_edges_in_order(spark):
    rows = [("r1", "a", "file:b", 10), ("r2", "a", "external:react", 20), ("r3", "a", "builtin:node:fs", 30), ("r4", "a", None, 40), ("r5", "file:b", "a", 10), ("r6", "file:b", "file:c", 20)]
    edges = spark.createDataFrame(rows, "edge_key string, source string, target string, start_byte long")
    starts = spark.createDataFrame([(1, "a"), (2, "file:b")], "start_id int, node string")
    keys = lambda found, start=1: sorted(r.edge_key for r in found.edges.collect() if r.start_id == start)
    flags = lambda found, start=1: next(tuple(r)[1:] for r in found.limits.collect() if r.start_id == start)
    whole = graph.traverse(edges, starts, flags=True)
    assert keys(whole) == ["r1", "r2", "r3", "r4", "r5", "r6"] and flags(whole) == (False, False, False)
    assert keys(graph.traverse(edges, starts, "incoming", 1), 2) == ["r1"]
    both = graph.traverse(edges, starts, "both", 2)
    assert keys(both, 2) == ["r1", "r2", "r3", "r4", "r5", "r6"] and both.edges.where("start_id = 2").count() == 6
    one = graph.traverse(edges, starts, depth=1, max_nodes=1, flags=True)
    assert keys(one) == ["r4"] and flags(one)[2]  # the edge without a target needs no node
    late = spark.createDataFrame([("z1", "a", "Z", 1), ("z2", "a", "B", 2), ("z3", "a", "Z", 3)], "edge_key string, source string, target string, start_byte long")
    assert keys(graph.traverse(late, starts, max_nodes=2)) == ["z1", "z3"]  # the first by its edge, not by its name; its later edge still enters
    assert keys(graph.traverse(late, starts, max_edges=2, max_nodes=2)) == ["z1"]  # an edge that is left out has still used its place


def test_chunks(spark):
    text = "ééé\nééé\nééé\n\n  \n"
    df = spark.createDataFrame([("p", "a.ts", "typescript", text)], "project_id string, path string, language string, text string")
    out = sorted(chunks.chunk_sources(df, max_bytes=7).collect(), key=lambda r: r.ordinal)
    assert [(r.start_byte, r.end_byte, r.start_line) for r in out] == [(0, 7, 0), (7, 14, 1), (14, 21, 2)] and len({r.identity_key for r in out}) == 3
    assert chunks.split_range("éé".encode(), 0, 4, 3) == [(0, 2), (2, 4)]
    two = chunks.chunk_sources(df, max_bytes=7, max_chunks=2).collect()
    assert len(two) == 2 and all(r.truncated for r in two)
    code = "head\nfunction a() {}\ntail\n"
    symbols = spark.createDataFrame([("p", "a.ts", "k", 5, 21, "a", "function"), ("p", "a.ts", "in", 8, 12, "b", "function")], "project_id string, path string, identity_key string, start_byte long, end_byte long, name string, kind string")
    parts = sorted(chunks.chunk_sources(df.withColumn("text", F.lit(code)), symbols).collect(), key=lambda r: r.start_byte)
    assert [(r.content, r.owner_key) for r in parts] == [("head\n", None), ("function a() {}\n", "k"), ("tail\n", None)]
    moved = {r.owner_key: (r.identity_key, r.input_hash) for r in chunks.chunk_sources(df.withColumn("text", F.lit("more\n" + code)), symbols.withColumn("start_byte", F.col("start_byte") + 5).withColumn("end_byte", F.col("end_byte") + 5)).collect()}
    assert moved["k"] == (parts[1].identity_key, parts[1].input_hash)
    fresh = chunks.chunk_sources(df, max_bytes=7)
    first = chunks.index_embeddings(fresh, fresh.limit(0).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("identity", F.lit("")), chunks.hashing_embedder(8), 8, "m1")
    again = chunks.index_embeddings(fresh, first.where("ordinal > 0"), chunks.hashing_embedder(8), 8, "m1")
    assert sorted((r.ordinal, r.reused) for r in again.collect()) == [(0, False), (1, True), (2, True)]


def test_fusion_and_truncation(spark):
    queries = spark.createDataFrame([(1, 1)], "query_id long, k int")
    dense = spark.createDataFrame([(1, "a", "a", 0, 1, 0.95), (1, "b", "b", 0, 2, 0.9)], "query_id long, chunk_id string, path string, start_byte long, dense_rank int, score double")
    lexical = spark.createDataFrame([(1, "b", "b", 0, 1, 0.8), (1, "c", "c", 0, 2, 0.7)], "query_id long, chunk_id string, path string, start_byte long, lexical_rank int, score double")
    r = search.fuse(queries, dense, lexical).collect()
    assert [(x.chunk_id, x.dense_rank, x.lexical_rank, x.truncated) for x in r] == [("b", 2, 1, True)]
    assert [one(spark, S.candidate_limit(F.lit(k))) for k in (1, 10, 50)] == [20, 40, 200]


def test_snippets_and_prompts(spark):
    body = "first line\nsecond café line\n"
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    sources = spark.createDataFrame([("p", "a.md", h(body), body.encode())], "project_id string, path string, content_hash string, content binary")
    rows = [(1, 1, "p", "a.md", h(body), h("first line\n"), 0, 11), (1, 2, "p", "a.md", h(body), h("second café line\n"), 11, 29), (1, 3, "p", "a.md", h(body), h("first line\n"), 0, 11), (1, 4, "p", "a.md", h(body), "bad", 11, 20), (1, 5, "p", "b.md", "x", "x", 0, 1), (1, 6, "p", "a.md", "old", "x", 0, 1), (1, 7, "p", "a.md", h(body), "x", 5, 99)]
    results = spark.createDataFrame(rows, "query_id long, rank int, project_id string, path string, source_hash string, content_hash string, start_byte long, end_byte long")
    packed = context.pack_snippets(results, sources)
    assert {r["rank"]: r.reason for r in packed.collect()} == {1: None, 2: None, 3: "overlapping_range", 4: "content_hash_mismatch", 5: "missing_file", 6: "source_changed", 7: "invalid_range"}
    text = context.build_context(packed).first().context
    assert text.startswith(context.HEADER) and "second café line" in text
    messages = spark.createDataFrame([(1, 1, "user", "a" * 40), (1, 2, "assistant", "b" * 40), (1, 3, "user", "c" * 8), (1, 4, "assistant", "d" * 8), (1, 5, "user", "lost")], "session_id long, ordinal long, role string, content string")
    assert [(r.user_ordinal, r.tokens) for r in conversations.complete_turns(messages, 20).collect()] == [(3, 12)]
    asked = spark.createDataFrame([(1, 1, "hello"), (2, 1, "x" * 40_000)], "query_id long, session_id long, text string")
    prompts = {r.query_id: r for r in context.build_prompts(asked, spark.createDataFrame([(1, "ctx")], "query_id long, context string"), messages, "sys").collect()}
    assert prompts[2].error == "prompt_too_large" and prompts[1].error is None and [t.user_ordinal for t in prompts[1].history] == [1, 3]


def test_catalog(spark):
    runs = spark.createDataFrame([("p", "source", "s1", "completed", 1, 1, {}), ("p", "source", "s2", "limited", 2, 2, {}), ("p", "source", "s3", "failed", 3, 3, {}), ("p", "symbols", "y1", "completed", 2, 2, {"source": "s1"}), ("q", "source", "q1", "completed", 1, 1, {}), ("q", "symbols", "q2", "completed", 2, 2, {"source": "q1"})], "project_id string, stage string, run_id string, status string, started_at int, completed_at int, upstream map<string,string>")
    fresh = {(r.project_id, r.stage): r.reason for r in catalog.stage_freshness(runs, {"source": [], "symbols": ["source"]}).collect()}
    assert fresh == {("p", "source"): None, ("p", "symbols"): "stale", ("q", "source"): None, ("q", "symbols"): None}
    a, b = (spark.createDataFrame(rows, "project_id string, x int") for rows in ([("p", 1), ("p", 2)], [("p", 2), ("p", 1)]))
    assert catalog.context_hash(a, ["x"]).first() == catalog.context_hash(b, ["x"]).first()
    bad = catalog.catalog_violations(spark.createDataFrame([(1, 5), (1, None), (2, 9)], "k int, v int"), {"small": F.col("v") < 8}, ["k"])
    assert sorted((r.rule, r.k) for r in bad.collect()) == [("duplicate_key", 1), ("small", 1), ("small", 2)]


def test_replay_and_admission(spark):
    rows = spark.createDataFrame([("s", "r1", "assistant", "completed", "hi", None), ("s", "r2", "assistant", "streaming", "h", None), ("s", "r3", "assistant", "completed", "", None)], "session_id string, request_id string, role string, status string, content string, error string")
    told = {}
    for r in sorted(conversations.replay(rows).collect(), key=lambda r: (r.request_id, r.seq)):
        told.setdefault(r.request_id, []).append(r.type)
    assert told == {"r1": ["accepted", "delta", "completed"], "r2": ["accepted", "error"], "r3": ["accepted", "completed"]}
    req = spark.createDataFrame([("s", "a", 0, 10), ("s", "b", 5, 20), ("s", "c", 12, 13)], "session_id string, request_id string, start_ts long, end_ts long")
    assert {r.request_id: r.decision for r in ev.admit_one_active(req).collect()} == {"a": "admitted", "b": "session_busy", "c": "admitted"}
    lines = spark.createDataFrame([("s", "r", 1, '{"message":{"role":"assistant","content":"a"},"done":false}'), ("s", "r", 2, " "), ("s", "r", 3, '{"done":true,"eval_count":3,"total_duration":2000000}'), ("s", "r", 4, '{"message":{"content":"late"}}'), ("s", "q", 1, "{bad"), ("s", "q", 2, '{"error":"x"}')], "session_id string, request_id string, seq long, value string")
    records = ev.read_model_records(lines)
    assert sorted((r.request_id, r.seq, r.failure) for r in records.where("failure IS NOT NULL").collect()) == [("q", 1, "malformed_record"), ("q", 2, "model_error")]
    usage = {r.request_id: r for r in ev.stream_usage(records).collect()}
    assert usage["r"].content == "a" and usage["r"].usage.eval_count == 3 and usage["q"].failure == "missing_done"


@pytest.mark.parametrize("late", [False, True])
def test_stream_equals_batch(spark, tmp_path, late):
    rows = [("s", "a", 1, "2024-01-01T00:00:00", "delta", "x"), ("s", "a", 2, "2024-01-01T00:00:01", "delta", "y"), ("s", "a", 3, "2024-01-01T00:00:02", "completed", None), ("s", "a", 4, "2024-01-01T00:00:03", "delta", "late"), ("s", "b", 5, "2024-01-01T00:00:03", "delta", "z"), ("s", "b", 6, "2024-01-01T00:00:04", "error", None)]
    df = spark.createDataFrame(rows, "session_id string, request_id string, seq long, event_ts string, type string, content string")
    df.repartition(1 + late).write.json(str(tmp_path / "in"))
    query = ev.fold_deltas_stream(ev.read_event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"folded{late}").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    got = {r.request_id: (r.content, r.status, r.deltas) for r in spark.table(f"folded{late}").collect()}
    batch = {r.request_id: (r.content, r.status, r.deltas) for r in ev.fold_deltas(df).collect()}
    assert got == batch == {"a": ("xy", "completed", 2), "b": ("z", "failed", 1)}


def test_ignore_rules(spark):
    from corpusloom.operators.ignore import classify_ignored, prune_ignored

    paths_ = [".env.local", "certificates/local.key", ".env.example", "packages/api/node_modules/x.js", "coverage/report.json", "debug.log", "packages/api/keep.log", "packages/api/artifacts/a/b.txt", "packages/web/main.ts", "fixtures/data.json", "fixtures/keep.ts", "private/deep/main.ts", "docs/a/b/c.md"]
    files_ = spark.createDataFrame([("p", p) for p in paths_], "project_id string, path string")
    rules = [(".", 0, "*.log"), (".", 1, "private/"), (".", 2, "# note"), (".", 3, "docs/**/c.md"), ("packages/api", 0, "!keep.log"), ("packages/api", 1, "artifacts/"), ("private", 0, "!main.ts")]
    table = spark.createDataFrame([("p", *r) for r in rules], "project_id string, base_path string, rule_no int, pattern string")
    tool = spark.createDataFrame([("p", ".", 0, "fixtures/**"), ("p", ".", 1, "!fixtures/keep.ts"), ("p", ".", 2, "!.env.local")], "project_id string, base_path string, rule_no int, pattern string")
    out = classify_ignored(files_, table, tool)
    got = {r.path: r.source for r in out.collect()}
    assert got == {".env.local": "built_in_safety", "certificates/local.key": "built_in_safety", ".env.example": "none", "packages/api/node_modules/x.js": "built_in_generated", "coverage/report.json": "built_in_generated", "debug.log": "gitignore", "packages/api/keep.log": "none", "packages/api/artifacts/a/b.txt": "gitignore", "packages/web/main.ts": "none", "fixtures/data.json": "tool_ignore", "fixtures/keep.ts": "none", "private/deep/main.ts": "gitignore", "docs/a/b/c.md": "gitignore"}
    kept, counts = prune_ignored(files_, out)
    assert kept.count() == 4 and counts.first().ignored_paths == 9


def test_symbols(spark):
    from corpusloom.operators.symbols import build_symbols, range_contains_join

    rows = [("class", "A", 0, 100), ("method", "m", 10, 20), ("method", "m", 30, 40), ("function", "f", 12, 18), ("function", "g", 200, 210), ("method", "m", 10, 20), ("class", "B" * 2000, 300, 400), ("method", "lost", 310, 320)]
    df = spark.createDataFrame([("p", "a.ts", "typescript", k, n, True, a, b) for k, n, a, b in rows], "project_id string, path string, language string, kind string, name string, exported boolean, start_byte long, end_byte long")
    out = build_symbols(df).collect()
    assert sorted((r.qualified_name, r.occurrence) for r in out) == [("A", 0), ("A.m", 0), ("A.m", 1), ("A.m.f", 0), ("g", 0)]
    keys = {r.identity_key: r.qualified_name for r in out}
    assert {r.qualified_name: keys.get(r.parent_key) for r in out if r.occurrence == 0} == {"A": None, "A.m": "A", "A.m.f": "A.m", "g": None}
    inner = spark.createDataFrame([("p", "a.ts", 13, 14), ("p", "a.ts", 150, 160)], "project_id string, path string, start_byte long, end_byte long")
    joined = range_contains_join(spark.createDataFrame(out), inner, ["project_id", "path"]).collect()
    assert [(r.start_byte, keys[r.owner_key]) for r in joined] == [(13, "A")]


def test_symbols_of_many_files_and_of_one_longer_than_a_batch(spark):
    from corpusloom.operators.symbols import build_symbols

    columns = "project_id string, path string, language string, kind string, name string, exported boolean, start_byte long, end_byte long"
    long_file = [("p", "long.ts", "typescript", "class", "C", True, 0, 10**6)] + [("p", "long.ts", "typescript", "method", "m", False, 10 * i + 1, 10 * i + 9) for i in range(12_000)]
    short = [("p", f"{i}.ts", "typescript", "class", "C", True, 0, 9) for i in range(500)]
    out = build_symbols(spark.createDataFrame(long_file + short, columns).repartition(3), max_per_file=11_500)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # a call and a frame a file took milliseconds each
    rows = out.collect()
    methods = sorted(r.occurrence for r in rows if r.kind == "method")
    assert methods == list(range(11_499)) and {r.qualified_name for r in rows if r.kind == "method"} == {"C.m"}
    assert sorted(r.path for r in rows if r.kind == "class") == sorted(["long.ts", *(f"{i}.ts" for i in range(500))])


def test_framework_scopes_and_facts(spark):
    from corpusloom.operators.frameworks import bind_evidence, detect_scopes, framework_imports

    packages = spark.createDataFrame([("p", "package.json", '{"dependencies":{"express":"1"}}'), ("p", "apps/web/package.json", '{"dependencies":{"next":"1"}}'), ("p", "packages/data/package.json", "{}"), ("p", "bad/package.json", "{")], "project_id string, path string, text string")
    edge = "project_id string, source_path string, edge_key string, external_package string, type_only boolean, bindings array<struct<kind:string,imported_name:string,local_name:string,exported_name:string,type_only:boolean>>"
    edges = spark.createDataFrame([("p", "packages/data/a.ts", "e1", "sequelize", False, [("named", "Model", "M", None, False), ("namespace", None, "S", None, False)]), ("p", "x.ts", "e2", "@nestjs/common", True, [])], edge)
    scopes = detect_scopes(packages, edges)
    assert sorted((r.root_path, r.framework) for r in scopes.collect()) == [(".", "express"), ("apps/web", "nextjs"), ("apps/web", "react"), ("packages/data", "sequelize")]
    imports = framework_imports(edges)
    assert sorted((r.local_name, r.imported_name) for r in imports.collect()) == [("M", "Model"), ("S", "*")]
    evidence = spark.createDataFrame([("p", "packages/data/a.ts", ["S", "Model"]), ("p", "packages/data/a.ts", ["M", "init"]), ("p", "packages/data/a.ts", ["Other"])], "project_id string, path string, reference array<string>")
    assert sorted(r.bound_name for r in bind_evidence(evidence, imports, "sequelize").collect()) == ["Model", "Model"]


def test_import_scanner(spark):
    from corpusloom.operators.imports import extract_dependencies, scan_imports

    text = """import def, { a as b, type T } from './x.js';
import * as ns from "pkg/sub";
import type { Only } from 'types';
import 'side';
export { q as r } from './y';
export * from './z';
// import no from 'comment'
const s = "import no from 'string'";
const { j, k: l } = require('path');
const whole = require("fs");
const lazy = () => import('./lazy');
"""
    got = [(e["kind"], e["specifier"], e["type_only"], [(b["kind"], b["imported_name"], b["local_name"], b["exported_name"]) for b in e["bindings"]]) for e in scan_imports("typescript", text)]
    assert got == [
        ("import", "./x.js", False, [("default", "default", "def", None), ("named", "a", "b", None), ("named", "T", "T", None)]),
        ("import", "pkg/sub", False, [("namespace", "*", "ns", None)]),
        ("import", "types", True, [("named", "Only", "Only", None)]),
        ("side_effect", "side", False, []),
        ("re_export", "./y", False, [("named", "q", None, "r")]),
        ("re_export", "./z", False, [("namespace", "*", None, "*")]),
        ("require", "path", False, [("commonjs_named", "j", "j", None), ("commonjs_named", "k", "l", None)]),
        ("require", "fs", False, [("commonjs_default", None, "whole", None)]),
        ("dynamic_import", "./lazy", False, []),
    ]
    df = spark.createDataFrame([("p", "a.ts", "typescript", text), ("p", "b.py", "python", "import os"), ("p", "c.ts", "typescript", None)], "project_id string, path string, language string, text string")
    out = extract_dependencies(df, max_edges=5).collect()
    assert len(out) == 5 and {r.omitted for r in out} == {4} and len({r.edge_key for r in out}) == 5


def contents_of(spark, rows):
    df = spark.createDataFrame(rows, "project_id string, path string, content binary")
    return df.withColumn("size_bytes", F.octet_length("content").cast("long"))


def test_pipeline_of_all_stages(spark):
    from corpusloom.operators.imports import scan_imports
    from corpusloom.plans.jobs import STAGES, run_pipeline

    good = [("p", "src/a.ts", b"import { x } from './b.js';\nlet y = x;\n"), ("p", "src/b.ts", b"export const x = 1;\n"), ("p", "c.bin", b"\0"), ("p", "package.json", b'{"dependencies": {"react": "1"}}'), ("p", "v.tsx", b"export const V = () => <div />;\n"), ("q", "d.py", b"import os\n")]
    df = contents_of(spark, [*good, ("bad", "x.ts", b"export const POISON = 1;\n"), ("worse", "x.ts", b"export const w = 'POISON TOO';\n"), ("last", "x.py", b"NO VECTOR\n")])

    def imports_of(language, text):
        if "POISON TOO" in text:
            raise RuntimeError("no imports")
        return scan_imports(language, text)

    def symbols_of(language, text):
        from corpusloom.operators.source_scan import scan_symbols

        if "POISON =" in text:
            raise ValueError("no symbols")
        return scan_symbols(language, text)

    plain = chunks.hashing_embedder(8)

    def vectors(texts):
        if any("NO VECTOR" in t for t in texts):
            raise OSError("model")
        return plain(texts)

    out = run_pipeline(df, vectors, 8, "m1", extractors={"symbols": symbols_of, "dependencies": imports_of})
    runs = {}
    for r in out["runs"].collect():
        runs.setdefault(r.project_id, {})[r.stage] = (r.status, r.rows)
    assert runs["p"] == {"source": ("completed", 5), "symbols": ("completed", 3), "dependencies": ("completed", 1), "frameworks": ("completed", 1), "chunks": ("completed", 10), "embeddings": ("completed", 10)}
    assert runs["q"] == {"source": ("completed", 1), "symbols": ("completed", 0), "dependencies": ("completed", 0), "frameworks": ("completed", 0), "chunks": ("completed", 1), "embeddings": ("completed", 1)}
    assert runs["bad"] == {"source": ("completed", 1), "symbols": ("failed", 0)}
    assert runs["worse"] == {"source": ("completed", 1), "symbols": ("completed", 1), "dependencies": ("failed", 0)}
    assert set(runs["last"]) == set(STAGES) and runs["last"]["embeddings"] == ("failed", 0)
    assert [(r.source_path, r.target_path) for r in out["edges"].collect()] == [("src/a.ts", "src/b.ts")]
    assert {r.project_id for r in out["vectors"].collect()} == {"p", "q"} and [r.name for r in out["entities"].collect()] == ["V"]


def test_vectors_are_reused(spark):
    given = spark.createDataFrame([("p", "a.ts", "typescript", "a b c\n")], "project_id string, path string, language string, text string")
    cut = chunks.chunk_sources(given)
    none = cut.limit(0).withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("identity", F.lit(""))
    first = chunks.index_embeddings(cut, none, chunks.hashing_embedder(8), 8, "m1")
    again = chunks.index_embeddings(cut, first.drop("reused"), chunks.hashing_embedder(8), 8, "m1")
    assert [r.reused for r in first.collect()] == [False] and [r.reused for r in again.collect()] == [True]
    assert [r.reused for r in chunks.index_embeddings(cut, first.drop("reused"), chunks.hashing_embedder(8), 8, "m2").collect()] == [False]


def test_dependencies_are_kept_while_content_stays(spark):
    from corpusloom.operators.imports import scan_imports
    from corpusloom.plans.jobs import index_dependencies, index_sources

    rows = [("p", "a.ts", b"import { x, y } from './b';\nimport z from './c';\nimport './d';\n"), ("p", "b.ts", b"export const x = 1;\n"), ("p", "c.ts", b"import 'fs';\n"), ("p", "d.py", b"import os\n"), ("q", "a.js", b"require('x'); require('y'); require('z');\n")]
    df = contents_of(spark, rows)
    index = index_dependencies(index_sources(df), df, max_edges=4, max_bindings=3, per_file=2)
    shown = {(r.project_id, r.path): (r.status, r.n_edges, r.omitted_edges, r.n_bindings, r.reasons, r.reused) for r in index.files.collect()}
    assert shown == {
        ("p", "a.ts"): ("limited", 2, 1, 3, ["file_edges"], False), ("p", "b.ts"): ("parsed", 0, 0, 0, [], False), ("p", "c.ts"): ("limited", 0, 1, 0, ["total_bindings"], False),
        ("p", "d.py"): ("unsupported", 0, 0, 0, [], False), ("q", "a.js"): ("limited", 2, 1, 0, ["file_edges"], False),
    }
    runs = {r.project_id: r for r in index.runs.collect()}
    assert (runs["p"].edges, runs["p"].bindings, runs["p"].local, runs["p"].unresolved, runs["p"].limit_reasons, runs["p"].status) == (2, 3, 2, 0, ["file_edges", "total_bindings"], "limited")
    first = index_dependencies(index_sources(df), df)
    changed = contents_of(spark, [("p", "a.ts", b"import './b';\n"), *rows[1:2], ("p", "c.ts", b"import 'fs';\n"), *rows[3:]])

    def only_new(language, text):
        assert text == "import './b';\n", text
        return scan_imports(language, text)

    second = index_dependencies(index_sources(changed), changed, only_new, first)
    full = index_dependencies(index_sources(changed), changed)
    edges = lambda i: sorted((r.project_id, r.source_path, r.specifier, r.resolution_kind, r.target_path or "", r.edge_key) for r in i.edges.collect())
    assert edges(second) == edges(full) and len(edges(full)) == 5
    assert {(r.project_id, r.path): r.reused for r in second.files.collect()} == {("p", "a.ts"): False, ("p", "b.ts"): True, ("p", "c.ts"): True, ("p", "d.py"): False, ("q", "a.js"): True}


def test_job12_keeps_texts_that_fit_the_default_limits(spark, tmp_path):
    text = "x" * 99 + "\n"
    spark.createDataFrame([(1, text * 15_000, "src1")], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    parts = queries.QUERIES["job12_chunk_sources"](spark, str(tmp_path)).collect()
    assert max(r.end_byte for r in parts) == 1_500_000 and max(r.end_byte - r.start_byte for r in parts) > 2048 and not any(r.truncated for r in parts)


def test_languages_by_name_and_ending(spark):
    want = {"a/Procfile": "plaintext", "x.sh": "shell", "b.ZSH": "shell", "c.gql": "graphql", "d.mdx": "mdx", "e.xml": "plaintext", "src/.ts": "plaintext", "a.b.tsx": "typescriptreact", "Gemfile": "ruby"}
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", files.classify_language("path").alias("l")).collect()
    assert {r.path: r.l for r in rows} == want


def test_import_specifiers_outside_the_catalog(spark):
    catalog = spark.createDataFrame([("p", "src/a.ts"), ("p", "src/lib/ab.ts")], "project_id string, path string")
    aliases = spark.createDataFrame([("p", "@a*a", "src/lib/*b")], "project_id string, pattern string, target string")
    asked = ["fs/anything", "node:x", "node:test", "test", "fs/promises", "C:\\x", "C:/x", "\\\\host\\x", "a\\b", "https://x", "/abs", "@a", "@aaa", "./lib/ab"]
    edges = spark.createDataFrame([("p", "src/a.ts", s) for s in asked] + [("p", "gone.ts", "./a")], "project_id string, source_path string, specifier string")
    got = {(r.source_path, r.specifier): (r.resolution_kind, r.target_path, r.external_package, r.unresolved_reason) for r in graph.resolve_imports(edges, catalog, aliases).collect()}
    out = lambda reason: ("unresolved", None, None, reason)
    want = [("external", None, "fs", None), out("unsupported_scheme"), ("builtin", None, "node:test", None), ("external", None, "test", None), ("builtin", None, "node:fs/promises", None), out("outside_project"), out("outside_project"), out("outside_project"), out("invalid_specifier"), out("unsupported_scheme"), out("outside_project"), out("invalid_specifier"), ("local", "src/lib/ab.ts", None, None), ("local", "src/lib/ab.ts", None, None)]
    assert {k[1]: v for k, v in got.items() if k[0] == "src/a.ts"} == dict(zip(asked, want, strict=True))
    assert got["gone.ts", "./a"] == out("not_in_source_catalog")


def test_a_request_that_falls_silent_is_stalled(spark):
    rows = [("s", "a", 1, 0, "delta"), ("s", "a", 2, 100, "completed"), ("s", "b", 3, 200, "delta"), ("s", "c", 4, 900, "delta"), ("s", "d", 5, 10, "delta"), ("s", "d", 6, 20, "completed")]
    events = spark.createDataFrame([(*r[:3], datetime.fromtimestamp(r[3], UTC), r[4], "x") for r in rows], "session_id string, request_id string, seq long, event_ts timestamp, type string, content string")
    assert [(r.request_id, r.at) for r in ev.detect_stalled(events).select("request_id", F.unix_seconds("stalled_after").alias("at")).collect()] == [("b", 200)]


def test_dense_search_in_parts_equals_the_whole(spark):
    rows = [("p" if i % 3 else "q", str(i), f"d{i % 2}/{i}", i, "text", [float((i * 7 + j * 3) % 11 - 5) for j in range(6)]) for i in range(90)]
    chunks = spark.createDataFrame(rows, "project_id string, chunk_id string, path string, start_byte long, language string, embedding array<double>")
    asked = chunks.where("start_byte < 30").select(F.col("start_byte").alias("query_id"), "project_id", F.col("embedding").alias("vector"), F.lit("d1").alias("path_prefix"), F.lit(None).cast("array<string>").alias("languages"), F.lit(3).alias("k"))
    found = lambda **more: sorted((r.query_id, r.dense_rank, r.chunk_id) for r in search.dense_topk(asked, chunks, **more).collect())
    assert found(block_queries=4, part_chunks=8) == found() and len(found()) > 30


def test_lexical_search_of_copies_equals_brute_force(spark):
    rnd, words = random.Random(5), ["red", "hot", "bolt", "ring", "plate"]
    docs = []
    for i in range(400):
        terms = [(w, rnd.choice([1.0, 0.4])) for w in rnd.sample(words, 3)] + [("red", 0.4)]
        docs.append((rnd.choice("pq"), str(i // 2), f"c{i % 3}", f"{rnd.choice(['a', 'a/b', 'ab', 'a//b'])}/{i // 2}", i // 2, rnd.choice(["x", "y", None]), terms))
    docs += [docs[0], docs[7]]
    documents = spark.createDataFrame(docs, "project_id string, chunk_id string, source string, path string, start_byte long, language string, terms array<struct<term:string,weight:double>>")
    asks = [(i, rnd.choice("pq"), " ".join(rnd.sample(words, rnd.choice([1, 2]))), rnd.choice([None, "", "a", "a/b", "a/", "none"]), rnd.choice([None, [], ["x"]]), rnd.choice([3, 60])) for i in range(60)] + [(99, "p", "absent", None, None, 5)]
    queries_ = spark.createDataFrame(asks, "query_id long, project_id string, text string, path_prefix string, languages array<string>, k int")
    found = search.lexical_topk(queries_, documents)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().toString()  # a side of terms went to the driver whole
    want = []
    for q, project, text, prefix, languages, k in asks:
        best = {}
        for p, chunk, _, path, start, language, terms in docs:
            weight = [max((w for t, w in terms if t == a), default=None) for a in text.split()]
            if p == project and None not in weight and (not prefix or path == prefix or path.startswith(prefix + "/")) and (not languages or language in languages):
                best[path, start, chunk] = max(best.get((path, start, chunk), 0.0), sum(weight))
        ranked = sorted(best, key=lambda c: (-best[c], c))[: min(max(k * 4, 20), 200) + 1]
        want += [(q, n + 1, c[2], best[c]) for n, c in enumerate(ranked)]
    assert sorted((r.query_id, r.lexical_rank, r.chunk_id, r.score) for r in found.collect()) == sorted(want) and len(want) > 500


def test_dense_search_of_copies_equals_brute_force(spark):
    rnd = random.Random(3)
    base = [[rnd.uniform(-1, 1) for _ in range(7)] for _ in range(40)] + [[0.0] * 7, [None] + [1.0] * 6]
    rows = [("p", str(i), f"{rnd.choice(['a', 'a/b', 'ab'])}/{i}", i, rnd.choice(["x", "y", None]), rnd.choice(base)) for i in range(500)] + [("p", "short", "a/s", 500, "x", [1.0, 2.0]), ("p", "none", "a/n", 501, "x", None)]
    chunks_ = spark.createDataFrame(rows, "project_id string, chunk_id string, path string, start_byte long, language string, embedding array<double>")
    asks = [(i, "p", rnd.choice(base), rnd.choice([None, "", "a", "a/b", "none"]), rnd.choice([None, [], ["x"]]), rnd.choice([3, 30])) for i in range(40)]
    asked = spark.createDataFrame(asks, "query_id long, project_id string, vector array<double>, path_prefix string, languages array<string>, k int")
    want = []
    for q, _, v, prefix, languages, k in asks:
        found = []
        for _, chunk, path, start, language, e in rows:
            fine = e and len(e) == len(v) and None not in e + v and any(e) and any(v)
            if fine and (not prefix or path == prefix or path.startswith(prefix + "/")) and (not languages or language in languages):
                found.append((-round(sum(a * b for a, b in zip(v, e)) / sum(a * a for a in v) ** 0.5 / sum(b * b for b in e) ** 0.5, 9) + 0.0, path, start, chunk))
        want += [(q, n + 1, c[3]) for n, c in enumerate(sorted(found)[: min(max(k * 4, 20), 200) + 1])]
    for sizes in ({}, {"block_queries": 7, "part_chunks": 60}):
        out = search.dense_topk(asked, chunks_, **sizes)
        assert "collect_list" not in out._jdf.queryExecution().toString()  # a block and a part were one record, thousands of them a batch
        assert sorted((r.query_id, r.dense_rank, r.chunk_id) for r in out.collect()) == sorted(want) and len(want) > 500


def test_caps_look_at_few_edges_of_a_hub(spark):
    from corpusloom.operators import graph as g

    pairs = [(a, b) for a in range(6) for b in range(40)]
    edges = spark.createDataFrame([(f"{a:02}>{b:02}", a, b) for a, b in pairs], "edge_key string, source long, target long")
    starts = spark.createDataFrame([(s, s) for s in range(6)], "start_id long, node long")
    found = g.traverse(edges, starts, "outgoing", 2, max_nodes=4, max_edges=9, flags=True)
    # A level takes nine edges by source; three new nodes fit, so level one keeps those to the first four nodes or to the start.
    one = {s: sorted(r.edge_key for r in found.edges.where(f"level = 1 AND start_id = {s}").collect()) for s in (0, 5)}
    assert one == {0: [f"00>{b:02}" for b in range(4)], 5: ["05>00", "05>01", "05>02", "05>05"]}
    two = sorted(r.edge_key for r in found.edges.where("level = 2 AND start_id = 0").collect())
    assert two == [f"01>{b:02}" for b in range(4)]  # five edges are left: 01>00 to 01>04, of which 04 is one node too many
    assert all(r.edges and r.nodes for r in found.limits.collect())
    near = g._fitting(spark.createDataFrame([(0, n) for n in range(6)], "start_id long, node long"), spark.createDataFrame([(n, 6) for n in range(6)], "node long, n long"), 9)
    assert sorted(r.node for r in near.collect()) == [0, 1]
    whole = g.traverse(edges, starts, "outgoing", 2)
    assert len({f.split("/")[-2] for f in whole.edges.inputFiles() if "/level-" in f}) == 1  # the last level is not written first


def test_lines_and_columns_count_bytes(spark):
    rows = spark.createDataFrame([("aé\nb\n", i) for i in (0, 1, 3, 4, 5, 6)], "text string, at int")
    assert [tuple(r.p) for r in rows.select(S.line_col("text", F.col("at")).alias("p")).collect()] == [(0, 0), (0, 1), (0, 3), (1, 0), (1, 1), (2, 0)]


def test_framework_catalog_pages_and_orders(spark):
    rows = [("p", f"e{i}", "." if i % 2 else "web", "react" if i % 3 else "nextjs", f"f{i % 4}.tsx", None if i == 5 else i, "component") for i in range(10)] + [("q", "z", ".", "react", "a.tsx", 1, "page")]
    entities = spark.createDataFrame(rows, "project_id string, id string, root_path string, framework string, path string, start_byte long, entity_kind string")
    links = spark.createDataFrame([("p", f"r{i}", f"e{i}", f"e{i + 3}" if i != 1 else None, "renders") for i in range(8)], "project_id string, id string, source_id string, target_id string, relationship_kind string")
    scopes = spark.createDataFrame([("p", ".", "react"), ("p", "web", "react"), ("p", "web", "nextjs"), ("q", ".", "react")], "project_id string, root_path string, framework string")
    page = frameworks.framework_catalog(entities, links, scopes, framework="react", max_entities=4, max_relationships=1)
    mine = sorted((r for r in rows if r[3] == "react" and r[0] == "p"), key=lambda r: (r[2], r[3], r[4], -1 if r[5] is None else r[5], r[6], r[1]))[:4]
    got = page["entities"].collect()
    assert sorted((r.project_id, r.place, r.id, r.more) for r in got) == [("p", n + 1, r[1], True) for n, r in enumerate(mine)] + [("q", 1, "z", False)]
    ids = {r[1] for r in mine}
    fit = sorted((r.source_id, r.id) for r in links.collect() if r.source_id in ids and (r.target_id is None or r.target_id in ids))
    assert [(r.source_id, r.id, r.more) for r in page["relationships"].collect()] == [(*fit[0], len(fit) > 1)]
    assert {(r.project_id, r.root_path) for r in page["scopes"].collect()} == {("p", r[2]) for r in mine} | {("q", ".")}
    facts = entities.withColumnRenamed("id", "identity_key")
    assert [r.identity_key for r in frameworks.canonical_order(facts, "entities").collect()][:2] == ["e5", "e0"]


def test_running_totals_cross_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(400).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), (F.col("id") % 7).cast("string"))).alias("project_id"), F.format_string("%04d", "id").alias("path"), (F.col("id") * 37 % 11).alias("size"))
    got = budgets.running_totals(rows, "path", n=F.lit(1), total=F.col("size")).collect()
    want, seen = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.path):
        n, total = seen.get(r.project_id, (0, 0))
        seen[r.project_id] = want[r.path] = (n + 1, total + r["size"])
    assert {r.path: (r.n, r.total) for r in got} == want and len(got) == 400


def test_metadata_that_is_still_the_indexed_one(spark):
    from corpusloom.sources import readers

    df = contents_of(spark, [("p", "package.json", b"{}"), ("p", "a/tsconfig.base.json", b"{}"), ("p", "b/package.json", b'{"a": 1}'), ("p", "c/package.json", b"x" * 100), ("p", "xpackage.json", b"{}")])
    known = spark.createDataFrame([("p", p, hashlib.sha256(b"{}").hexdigest()) for p in ("package.json", "a/tsconfig.base.json", "b/package.json")], "project_id string, path string, content_hash string")
    paths_ = lambda rows: sorted(r.path for r in rows.collect())
    assert paths_(readers.read_package_metadata(df, max_bytes=50)) == ["b/package.json", "package.json"]
    assert paths_(readers.read_package_metadata(df, known)) == ["package.json"]
    assert paths_(readers.read_resolver_metadata(df, known)) == ["a/tsconfig.base.json", "package.json"]


def test_edge_filter_by_frontier(spark):
    edges = spark.createDataFrame([("p", "a", "b", "import", "local"), ("p", "b", "c", "require", "local"), ("p", "c", "a", "import", "external"), ("q", "a", "b", "import", "local")], "project_id string, source string, target string, kind string, resolution_kind string")
    at = spark.createDataFrame([("p", "b"), ("p", "c")], "project_id string, node string")
    ends = lambda df: sorted((r.project_id, r.source, r.target) for r in df.collect())
    assert ends(graph.edge_filter(edges, frontier=at)) == [("p", "b", "c"), ("p", "c", "a")]
    assert ends(graph.edge_filter(edges, frontier=at, direction="incoming")) == [("p", "a", "b"), ("p", "b", "c")]
    assert ends(graph.edge_filter(edges, ["import"], ["local"], at, "both")) == [("p", "a", "b")]


def test_pages_join_up_to_the_whole(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(9), i) for i in range(50)]
    spark.createDataFrame(rows, "a int, b int").write.parquet(str(tmp_path / "t"))
    df, seen, after = spark.read.parquet(str(tmp_path / "t")), [], None
    while True:
        page = budgets.paged(df, ["a", "b"], 7, after).orderBy("a", "b").collect()
        seen += [(r.a, r.b) for r in page]
        assert len({r.has_more for r in page}) == 1
        if not page[-1].has_more:
            break
        after = (page[-1].a, page[-1].b)
    assert seen == sorted(rows)
    plan = budgets.paged(df, ["a", "b"], 7, (4, 20))._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(a,4)" in plan and "TakeOrderedAndProject" in plan


def test_model_files_are_read_in_order_and_merged_once(spark, tmp_path):
    lines = ['{"message": {"role": "assistant", "content": "Hel"}, "done": false}', "", '{"message": {"role": "assistant", "content": "lo"}, "done": false}', '{"message": {"role": "assistant", "content": ""}, "done": true, "prompt_eval_count": 3, "eval_count": 2, "total_duration": 5000000}']
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "s1__r1.ndjson").write_text("\n".join(lines))
    (tmp_path / "in" / "s1__r2.ndjson").write_text(lines[0] + "\n{broken\n")
    records = ev.read_model_stream(spark, str(tmp_path / "in"))
    assert sorted((r.request_id, r.seq, r.failure) for r in records.collect()) == [("r1", 0, None), ("r1", 2, None), ("r1", 3, None), ("r2", 0, None), ("r2", 1, "malformed_record")]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    for _ in range(2):  # the second start finds nothing new
        query = ev.write_usage_stream(ev.read_model_stream(spark, str(tmp_path / "in"), streaming=True), out, state)
        query.awaitTermination()
    rows = lambda: sorted((r.request_id, r.content, r.failure, r.usage and r.usage.eval_count) for r in ev.read_usage(spark, out).collect())
    once = rows()
    assert once == [("r1", "Hello", None, 2), ("r2", "Hel", "missing_done", None)]
    ev.write_usage_stream(ev.read_model_stream(spark, str(tmp_path / "in"), streaming=True), out, state + "-lost").awaitTermination()  # replayed from the start
    assert rows() == once


def test_summaries(spark):
    files_ = spark.createDataFrame([("p", "a", 3), ("p", "b", 4)], "project_id string, path string, size_bytes long")
    skipped = spark.createDataFrame([("p", "x", "ignored"), ("p", "y", "link"), ("q", "z", "ignored")], "project_id string, path string, kind string")
    reasons = spark.createDataFrame([("p", ["depth_limit"])], "project_id string, limit_reasons array<string>")
    assert sorted(tuple(r) for r in catalog.inventory_summary(files_, skipped, reasons).collect()) == [("p", 2, 7, 1, 1, ["depth_limit"]), ("q", 0, 0, 1, 0, [])]
    usage = spark.createDataFrame([("a", "completed", 5, 7, 2_000_000), ("a", "completed", 1, 1, 4_000_000), ("b", "failed", None, None, None)], "model string, status string, prompt_tokens long, completion_tokens long, total_ns long")
    got = {tuple(r)[:2]: tuple(r)[2:] for r in ev.generation_metrics(usage, "model").collect()}
    assert got == {("a", "completed"): (2, 6, 8, 3.0, 4.0, 2.0, 4.0), ("b", "failed"): (1, 0, 0, None, None, None, None)}
    none = spark.createDataFrame([], "project_id string")
    some = spark.createDataFrame([("p",), ("p",)], "project_id string")
    runs = spark.createDataFrame([("p", "chunks", 5, "limited"), ("p", "source", 1, "limited"), ("p", "symbols", 2, "completed"), ("q", "source", 1, "completed")], "project_id string, stage string, place int, status string")
    assert sorted(tuple(r) for r in catalog.corpus_counts(some, none, some, none, runs).collect()) == [("p", 2, 0, 2, 0, ["source", "chunks"]), ("q", 0, 0, 0, 0, [])]
