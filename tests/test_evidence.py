"""Symbols and framework evidence from source text."""

import json

import pytest
from corpusloom.operators import facts as FX
from corpusloom.operators.evidence import extract_evidence, extract_symbols, scan_evidence, string_value
from corpusloom.operators.imports import extract_dependencies
from corpusloom.operators.graph import resolve_imports
from corpusloom.operators.source_scan import Source, scan_symbols
from corpusloom.operators.symbols import build_symbols

FILES = "project_id string, path string, language string, text string"


def nested(language, text):
    """``Outer.inner:kind:exported`` of each declaration, parents by their ranges."""
    out, open_ = [], []
    for d in sorted(scan_symbols(language, text), key=lambda d: (d["start_byte"], -d["end_byte"])):
        while open_ and d["end_byte"] > open_[-1][0]:
            open_.pop()
        name = ".".join([*(open_[-1][1:] if open_ else ()), d["name"]])
        open_.append((d["end_byte"], name))
        out.append(f"{name}:{d['kind']}:{'exported' if d['exported'] else 'local'}")
    return out


def test_javascript_declarations():
    text = """export class Shop {
  size = 1;
  #key = true;
  constructor() {}
  open() {}
}

export function build() {}
export const listen = () => {};
let total = 0;
function around() {
  const unseen = 1;
  function within() {}
  const local = () => {};
}
const table = { method() {} };
"""
    assert nested("javascript", text) == [
        "Shop:class:exported", "Shop.size:property:local", "Shop.#key:property:local", "Shop.constructor:constructor:local", "Shop.open:method:local",
        "build:function:exported", "listen:function:exported", "total:variable:local", "around:function:local", "around.within:function:local",
        "around.local:function:local", "table:constant:local",
    ]


def test_typescript_declarations():
    text = """export namespace Core.Inner {
  export interface Item {
    readonly id: string;
    [key: string]: unknown;
    run(value: Map<string, number>): { a: string };
  }
  export type Name<T> = T | { a: 1 }
  export const enum Mode { Active }
  let count = 0;
}
declare module "lib" {
  export function boot(): void;
}
@Injectable()
export abstract class A<T extends {a: string}> extends B<T> implements C {
  private readonly map: Map<string, number> = new Map();
  @Input() seen?: string
  static { init(); }
  get value(): { a: string } { return 1 }
  abstract load<T>(a: T): Promise<void>;
  async *each() { for (const q of w) {} }
}
export const r: Record<string, () => void> = {}, f = async x => x, {c, d} = e
function over(a: string): string
function over(a: any) { return a }
const k = class Hidden {}, re = /[/'"`]\\/}{/g
export default class {}
type = 4; interface
"""
    assert nested("typescript", text) == [
        "Core.Inner:namespace:exported", "Core.Inner.Item:interface:exported", "Core.Inner.Item.id:property:local", "Core.Inner.Item.run:method:local",
        "Core.Inner.Name:type_alias:exported", "Core.Inner.Mode:enum:exported", "Core.Inner.count:variable:local", "lib:module:local", "lib.boot:function:exported",
        "A:class:exported", "A.map:property:local", "A.seen:property:local", "A.value:method:local", "A.load:method:local", "A.each:method:local",
        "r:constant:exported", "f:function:exported", "over:function:local", "over:function:local", "k:constant:local", "re:constant:local",
    ]


def test_elements_and_broken_text():
    assert nested("typescriptreact", "export function App(p: P): JSX.Element {\n  return <main data-a='x'>don't {p.name}</main>;\n}\n") == ["App:function:exported"]
    assert nested("typescript", "export class Half {\n  run(): void {\n    const value = ;\n  }\n}\n") == ["Half:class:exported", "Half.run:method:local"]
    assert nested("typescript", "class A {\n  b() { `${ {") == ["A:class:local", "A.b:method:local"]
    assert nested("javascript", 'import v from "x";\nexport default class {};\nvoid (() => v);\n') == [] and scan_symbols("python", "class A: pass") == []


def test_ranges_are_bytes():
    text = '// \U0001f600\nexport const café = (): string => "ready";\n'
    (found,) = scan_symbols("typescript", text)
    assert text.encode()[found["start_byte"] : found["end_byte"]].decode() == 'café = (): string => "ready"'


@pytest.mark.parametrize("piece", ["{", "`${", "class A {", "const a = ", "@A() ", "f(", "a.b().", "<A>", "[", "type A<", "({a:", "x = ", "function f(): {", "a<b,"])
def test_broken_text_is_read_in_linear_time(piece):
    import time

    began = time.time()
    scan_symbols("typescriptreact", piece * 4000)
    scan_evidence("typescriptreact", piece * 4000)
    assert time.time() - began < 5


def test_string_values():
    assert string_value(r'"a\"b\x41B\u{1F600}\n\q"') == 'a"bAB\U0001f600\nq'
    assert [string_value(s) for s in (r'"\1"', r'"\08"', r'"\xg"', r'"\u12"', r'"\0"', r'"\u{110000}"')] == [None] * 6
    assert string_value(r'"😀"') == "\U0001f600"


def test_templates_hold_code():
    s = Source("a = `x${b ? `c${d()}` : '}'}e` + f")
    assert s.word[-2:] == ["+", "f"] and "d" in s.word and s.kind.count("template") == 4


def test_evidence_rows(spark):
    text = '''"use client";
'also'
@Controller("/cats")
export class Cats extends Base.Controller {
  @Get(ROUTES.list) @Auth
  find(@Param("id") id: string, other = 1) {
    const app = express();
    app.use(router);
    return <Layout.Main options={{ enabled: true }}>text <b>x</b> a < 3</Layout.Main>;
  }
  constructor(private readonly a: Deps.Service, b?: Other<X>, c: string) { super() }
}
"not one";
const User = sequelize.define("User", { active: true, n: [1, -2.5, null], ...rest });
app.route("/x").get((q, s) => 1).post(function (a, b, c) {}, h);
module.exports.q = make<Foo>({ "k-v": x.y, z });
new Foo(bar()).baz()
'''
    evidence, omissions = extract_evidence(spark.createDataFrame([("p", "a.tsx", "typescriptreact", text), ("p", "b.py", "python", "f()"), ("p", "c.ts", "typescript", None)], FILES))
    got = evidence.orderBy("start_byte", FX.F.desc("end_byte"), "kind").collect()
    name = lambda r: ".".join(r.reference or ["-"])
    assert [(r.kind, name(r)) for r in got if r.kind not in ("call_expression", "jsx")] == [
        ("directive", "-"), ("directive", "-"), ("decorator", "Controller"), ("class_heritage", "Base.Controller"), ("decorator", "Get"), ("decorator", "Auth"),
        ("decorator", "Param"), ("constructor_parameter", "Deps.Service"), ("constructor_parameter", "Other"), ("constructor_parameter", "-"),
    ]
    assert [json.loads(r.arguments[0])["value"] for r in got if r.kind == "directive"] == ["use client", "also"]
    assert [name(r) for r in got if r.kind == "jsx"] == ["Layout.Main", "b"]
    calls = {name(r) + (":" + r.member_name if not r.reference else ""): r for r in got if r.kind == "call_expression" and (r.reference or r.member_name)}
    assert set(calls) == {"Controller", "Get", "Param", "express", "app.use", "sequelize.define", "-:post", "-:get", "app.route", "make", "-:baz", "bar"}
    assert (calls["express"].assigned_name, calls["express"].owner_name) == ("app", "Cats") and calls["make"].assigned_name == "module.exports.q"
    assert calls["-:post"].parameter_counts == [3, None] and calls["-:post"].receiver_reference == ["app", "route"] == calls["-:get"].receiver_reference
    assert [json.loads(a) for a in calls["-:post"].receiver_arguments] == [{"kind": "string", "value": "/x"}]
    assert [json.loads(a)["kind"] for a in calls["sequelize.define"].arguments] == ["string", "unknown"]
    assert json.loads(calls["make"].arguments[0])["properties"] == [{"key": "k-v", "value": {"kind": "identifier", "reference": {"segments": ["x", "y"]}}}, {"key": "z", "value": {"kind": "identifier", "reference": {"segments": ["z"]}}}]
    marks = {r.reference[0]: r for r in got if r.kind == "decorator"}
    assert [(m.target_kind, m.target_name, m.owner_name, m.member_name, m.parameter_index) for m in (marks[n] for n in ("Controller", "Get", "Auth", "Param"))] == [
        ("class", "Cats", "Cats", None, None), ("method", "find", "Cats", "find", None), ("method", "find", "Cats", "find", None), ("parameter", "id", "Cats", "find", 0),
    ]
    assert [(r.owner_name, r.parameter_index, r.target_name) for r in got if r.kind == "constructor_parameter"] == [("Cats", 0, "a"), ("Cats", 1, "b"), ("Cats", 2, "c")]
    assert text.encode()[calls["app.route"].start_byte : calls["app.route"].end_byte] == b'app.route("/x")'
    assert omissions.collect() == [] and len({r.evidence_key for r in got}) == len(got)


def test_keys_stay_when_code_moves_and_limits_leave_no_half_text(spark):
    text = 'const a = f("x");\nf("x");\n'
    rows = [("p", "a.js", "javascript", text), ("p", "b.js", "javascript", "const unrelated = true;\n" + text), ("p", "c.js", "javascript", "a(); b(); c(); oversized();")]
    keys = lambda p, e: sorted(r.evidence_key for r in e.collect() if r.path == p)
    evidence, omissions = extract_evidence(spark.createDataFrame(rows, FILES), max_evidence=2, max_name_bytes=5)
    assert keys("a.js", evidence) == keys("b.js", evidence) and len(keys("a.js", evidence)) == 2
    assert [r.reference for r in evidence.where("path = 'c.js'").orderBy("start_byte").collect()] == [["a"], ["b"]]
    assert [tuple(r) for r in omissions.collect()] == [("p", "c.js", ["evidence_limit", "name_text_limit"], 2, 0)]
    (row,) = scan_evidence("javascript", 'configure([1, 2, 3], [[["deep"]]], "much too long a text");', {"entries": 2, "depth": 1, "value_bytes": 40})
    assert row["reasons"] == ["static_collection_limit", "static_depth_limit", "static_value_limit"] and row["omitted"] >= 3
    assert [json.loads(a)["kind"] for a in row["arguments"]] == ["unknown", "array", "string"] or json.loads(row["arguments"][0])["kind"] == "unknown"


SOURCES = {
    "src/cats.ts": """import { Controller, Get, Injectable, Module } from "@nestjs/common";
@Injectable()
export class CatService {}
@Controller(["cats", "felines"])
export class Cats {
  constructor(private readonly service: CatService) {}
  @Get(":id")
  one() {}
}
@Module({ controllers: [Cats], providers: [CatService] })
export class App {}
""",
    "src/server.js": """const express = require("express");
const app = express();
const api = express.Router();
app.use("/api", api);
api.get("/dogs/:id", (req, res) => res.send(1));
api.route("/x").post(save);
app.use((err, req, res, next) => next(err));
""",
    "src/models.ts": """import { DataTypes, Model, Sequelize } from "sequelize";
const sequelize = new Sequelize("x");
const User = sequelize.define("User", { name: { type: DataTypes.STRING, allowNull: false } });
class Post extends Model {}
User.hasMany(Post, { as: "posts" });
Post.init({ title: DataTypes.STRING }, { sequelize, modelName: "Post" });
""",
    "src/view.tsx": """import React, { memo } from "react";
export function Page() { return <main><Row /><Page /></main>; }
export const Row = memo(() => <tr />);
""",
}


def test_text_to_facts_of_every_framework(spark):
    language = {"ts": "typescript", "js": "javascript", "tsx": "typescriptreact"}
    files = spark.createDataFrame([("p", path, language[path.split(".")[-1]], text) for path, text in SOURCES.items()], FILES)
    packages = spark.createDataFrame([("p", "package.json", '{"dependencies": {"@nestjs/common": "1", "express": "1", "sequelize": "1", "react": "1"}}')], "project_id string, path string, text string")
    edges = resolve_imports(extract_dependencies(files), files.select("project_id", "path"))
    evidence, _ = extract_evidence(files)
    symbols = build_symbols(extract_symbols(files))
    scopes, facts = FX.index_frameworks(files.select("project_id", "path"), packages, edges, evidence.drop("end_byte"), symbols)
    assert sorted(r.framework for r in scopes.collect()) == ["express", "nestjs", "react", "sequelize"]
    names = {r.identity_key: r.name for r in facts.entities.collect()}
    entities = {(r.framework, r.entity_kind, r.name) for r in facts.entities.collect()}
    assert entities >= {
        ("nestjs", "controller", "Cats"), ("nestjs", "provider", "CatService"), ("nestjs", "module", "App"), ("express", "application", "app"), ("express", "router", "api"),
        ("sequelize", "model", "User"), ("sequelize", "model", "Post"), ("react", "component", "Page"), ("react", "component", "Row"),
    }
    links = {(r.framework, r.relationship_kind, names[r.source_key], names.get(r.target_key) or r.target_name) for r in facts.relationships.collect()}
    assert {("nestjs", "registers_controller", "App", "Cats"), ("nestjs", "injects", "Cats", "CatService"), ("sequelize", "associates", "User", "Post")} <= links
    assert {k for f, k, *_ in links if f == "express"} >= {"mounts_router", "handles_route", "uses_middleware"}
    assert any(f == "nestjs" and k == "handles_route" for f, k, *_ in links)


def ui_facts(spark, sources, package):
    language = {"ts": "typescript", "tsx": "typescriptreact"}
    files = spark.createDataFrame([("p", path, language[path.split(".")[-1]], text) for path, text in sources.items()], FILES)
    packages = spark.createDataFrame([("p", "package.json", package)], "project_id string, path string, text string")
    edges = resolve_imports(extract_dependencies(files), files.select("project_id", "path"))
    evidence, _ = extract_evidence(files)
    _, facts = FX.index_frameworks(files.select("project_id", "path"), packages, edges, evidence.drop("end_byte"), build_symbols(extract_symbols(files)))
    entities, links = facts.entities.collect(), facts.relationships.collect()
    names = {r.identity_key: r.name for r in entities}
    return entities, [(r.relationship_kind, names[r.source_key], names.get(r.target_key), r.target_name, r.certainty, r.edge_key is not None) for r in links]


def test_components_from_text(spark):
    text = """"use client";
import { memo } from "react";
import * as R from "react";
import { Card as ImportedCard } from "./card";
export const Dashboard = () => <><LocalCard /><ImportedCard /><div /><LocalCard /><Dashboard /><Ns.Part /></>;
export const LocalCard = () => <section />;
export const MemoDashboard = memo(Dashboard);
export const Ref = R.forwardRef((a, b) => <Late />);
export const Early = memo(After);
export const After = () => <p />;
const Hidden = () => <Visible />;
export const visible = () => <div />;
export const NotReact = factory(Visible);
"""
    entities, links = ui_facts(spark, {"src/view.tsx": text}, '{"dependencies": {"react": "1"}}')
    shown = {r.name: json.loads(r.attributes) for r in entities}
    assert {n: a.get("wrapper") for n, a in shown.items()} == {"Dashboard": None, "LocalCard": None, "MemoDashboard": "memo", "Ref": "forwardRef", "Early": "memo", "After": None}
    assert all(a["client_boundary"] for a in shown.values())
    assert sorted(links, key=str) == sorted(
        [
            ("renders_component", "Dashboard", "LocalCard", "LocalCard", "linked", False), ("renders_component", "Dashboard", "LocalCard", "LocalCard", "linked", False),
            ("renders_component", "Dashboard", None, "Card", "declared", True), ("renders_component", "Ref", None, "Late", "declared", False),
            ("wraps", "MemoDashboard", "Dashboard", "Dashboard", "declared", False), ("wraps", "Early", None, "After", "declared", False),
        ],
        key=str,
    )


def test_file_routes_from_text(spark):
    sources = {
        "src/app/(marketing)/blog/[...slug]/page.tsx": '"use client"; export default function BlogPage() { return <Card />; }',
        "app/api/[[...parts]]/route.ts": "export async function GET() {} export function POST() {} export const DELETE = 1;",
        "app/feed/(.)photo/page.tsx": "export default function Photo() { return <Image />; }",
        "app/_internal/page.tsx": "export default function Hidden() { return <main />; }",
        "app/x/loading.tsx": "export default function Loading() { return <main />; }",
        "pages/docs/[id]/index.tsx": "export default function Docs() { return <main />; }",
        "src/pages/api/users/[id].ts": "export default function handler() {}",
        "pages/_app.tsx": "export default function App() { return <main />; }",
        "lib/page.tsx": "export default function Lib() { return <main />; }",
    }
    entities, links = ui_facts(spark, sources, '{"dependencies": {"next": "1"}}')
    got = {r.name: (r.entity_kind, r.certainty, json.loads(r.attributes)) for r in entities if r.framework == "nextjs"}
    assert got == {
        "src/app/(marketing)/blog/[...slug]/page.tsx": ("page", "convention", {"kind": "next_page", "client_boundary": True, "router": "app", "route_pattern": "/blog/:slug+"}),
        "app/api/[[...parts]]/route.ts:GET": ("route_handler", "convention", {"kind": "next_route_handler", "router": "app", "method": "GET", "route_pattern": "/api/:parts*"}),
        "app/api/[[...parts]]/route.ts:POST": ("route_handler", "convention", {"kind": "next_route_handler", "router": "app", "method": "POST", "route_pattern": "/api/:parts*"}),
        "app/feed/(.)photo/page.tsx": ("page", "unresolved", {"kind": "next_page", "client_boundary": False, "router": "app"}),
        "app/x/loading.tsx": ("layout", "convention", {"kind": "next_layout", "client_boundary": False, "role": "loading", "route_pattern": "/x"}),
        "pages/docs/[id]/index.tsx": ("page", "convention", {"kind": "next_page", "client_boundary": False, "router": "pages", "route_pattern": "/docs/:id"}),
        "src/pages/api/users/[id].ts:default": ("route_handler", "convention", {"kind": "next_route_handler", "router": "pages", "route_pattern": "/api/users/:id"}),
        "pages/_app.tsx": ("component", "convention", {"kind": "next_special_file", "role": "_app"}),
    }
    owned = {(x[1], x[3]) for x in links if x[0] == "contains"}
    assert ("src/app/(marketing)/blog/[...slug]/page.tsx", "BlogPage") in owned and ("app/x/loading.tsx", "Loading") in owned and len(owned) == 4


def test_a_second_run_reads_changed_files_only_and_equals_a_full_one(spark):
    from corpusloom.plans.jobs import index_evidence, index_sources

    def contents(sources):
        df = spark.createDataFrame([("p", path, text.encode()) for path, text in sources.items()], "project_id string, path string, content binary")
        return df.withColumn("size_bytes", FX.F.octet_length("content").cast("long"))

    def facts_of(index, df):
        sources = index_sources(df).where("status = 'ready'")
        texts = df.select("project_id", "path", FX.F.col("content").cast("string").alias("text")).join(sources.select("project_id", "path", "language"), ["project_id", "path"])
        edges = resolve_imports(extract_dependencies(texts), sources)
        packages = spark.createDataFrame([("p", "package.json", '{"dependencies": {"@nestjs/common": "1", "express": "1"}}')], "project_id string, path string, text string")
        _, facts = FX.index_frameworks(sources.select("project_id", "path"), packages, edges, index.evidence.drop("end_byte"), build_symbols(index.declarations))
        return facts

    shown = lambda f: (sorted(r.identity_key for r in f.entities.collect()), sorted(r.identity_key for r in f.relationships.collect()))
    old = {p: SOURCES[p] for p in ("src/cats.ts", "src/server.js")} | {"src/gone.js": "const e = require('express'); const a = e();"}
    new = {"src/cats.ts": old["src/cats.ts"], "src/server.js": old["src/server.js"].replace("/dogs", "/birds")}
    before, after = contents(old), contents(new)
    first = index_evidence(index_sources(before), before)

    def only_server(language, text):
        assert "/birds" in text
        return scan_evidence(language, text)

    second = index_evidence(index_sources(after), after, only_server, previous=first)
    full = index_evidence(index_sources(after), after)
    assert {r.path: (r.status, r.reused) for r in second.files.collect()} == {"src/cats.ts": ("parsed", True), "src/server.js": ("parsed", False)}
    whole = facts_of(full, after)
    assert shown(facts_of(second, after)) == shown(whole)
    again = index_evidence(index_sources(after), after, lambda *_: 1 / 0, previous=index_evidence(index_sources(before), before, max_evidence=3))
    assert {r.path: (r.status, (r.error or "")[:17]) for r in again.files.collect()} == {"src/cats.ts": ("failed", "ZeroDivisionError"), "src/server.js": ("failed", "ZeroDivisionError")}

    entities, links = whole.entities.collect(), whole.relationships.collect()
    cut, reasons = FX.within_project(whole, 4, 3)
    order = sorted(entities, key=lambda r: (r.path, r.scope_key, -1 if r.start_byte is None else r.start_byte, r.entity_kind, r.identity_key))[:4]
    kept = {r.identity_key for r in order}
    assert {r.identity_key for r in cut.entities.collect()} == kept
    left = sorted((r for r in links if r.source_key in kept), key=lambda r: (r.path, r.scope_key, r.source_key, r.relationship_kind, r.target_key or r.target_name or "", r.identity_key))[:3]
    assert {r.identity_key for r in cut.relationships.collect()} == {r.identity_key for r in left}
    assert [r.limit_reasons for r in reasons.collect()] == [["total_entities", "total_relationships"]]
    assert [r.limit_reasons for r in FX.within_project(whole)[1].collect()] == [[]]


def test_evidence_is_dealt_by_file_once(spark):
    files = spark.createDataFrame([("p", f"{i}.ts", "typescript", 'const a = f("x"); f("x"); f("x");') for i in range(3)], FILES)
    found, _ = extract_evidence(files, max_evidence=2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # places and occurrences took one each
    rows = found.collect()
    assert sorted(r.path for r in rows) == ["0.ts", "0.ts", "1.ts", "1.ts", "2.ts", "2.ts"] and len({r.evidence_key for r in rows}) == 2


def test_evidence_of_texts_dealt_by_file_is_the_same_without_a_shuffle_of_its_rows(spark):
    text = '@A("x") class C { m() { return f("x", 1); } }\nf("x"); f("x");'
    rows = [("p", f"{i}.ts", "typescript", text) for i in range(5)] + [("p", "0.ts", "typescript", 'f("x"); g();'), (None, None, "typescript", "h()")]
    files = spark.createDataFrame(rows, FILES)
    (one, left), (two, right) = (extract_evidence(files, max_evidence=6, max_name_bytes=1, dealt=dealt) for dealt in (False, True))
    assert "Exchange" not in two._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())) and one.count() == 27
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect())) and left.count() == 1
