import time

import pytest
from pyspark.sql import functions as F

from annalist.operators import answers, code, search, symbols


def test_query_parser():
    q = search.parse_query("redis type:decision domain:Stor foo:bar")
    assert (q.terms, q.type, q.domain) == (("redis", "foo:bar"), "DECISION", "Stor")
    for bad in ("type:nothing", "domain:"):
        with pytest.raises(ValueError):
            search.parse_query(bad)


def test_text_search(spark):
    docs = spark.createDataFrame([("evt_1", "EVENT", "Expose Repository Intelligence Through MCP Tools", "MCP integration"), ("evt_2", "EVENT", "Update Copyright Year", "LICENSE README"), ("fact_1", "FACT", "Metadata Panel DEPENDS_ON user-service", "user service integration boundary")], "id string, entity_type string, title string, content string")
    find = lambda text, kind="": [r.id for r in search.bm25(search.index_documents(docs), text, kind).collect()]
    assert find("MCP", "EVENT") == ["evt_1"] and find("MCP", "DECISION") == [] and find("user-service") == ["fact_1"] and find("integ mcp") == ["evt_1"] and find("") == []
    assert [(r.entity_id, r.score) for r in search.text_hits(search.bm25(search.index_documents(docs), "integration")).orderBy("entity_id").collect()] == [("evt_1", 75), ("fact_1", 75)]


def test_field_search(spark):
    rows = spark.createDataFrame([("d1", "Redis Cache", "Accepted"), ("d2", "Use Redis", "Redis"), ("d3", "x", "y")], "id string, title string, status string")
    hits = {r.entity_id: r.score for r in search.match_fields(rows, "DECISION", "memory", search.FIELDS["DECISION"], search.parse_query("redis")).collect()}
    assert hits == {"d1": 75, "d2": 100}
    assert {r.score for r in search.match_fields(rows, "DECISION", "memory", search.FIELDS["DECISION"], search.parse_query("type:decision")).collect()} == {25}
    assert search.match_fields(rows, "DECISION", "memory", search.FIELDS["DECISION"], search.parse_query("type:fact redis")).count() == 0


def test_best_hit_prefers_score_then_source(spark):
    rows = spark.createDataFrame([("D", "1", "discovery", 50), ("D", "1", "memory", 50), ("D", "2", "memory", 25), ("D", "2", "discovery", 75)], "entity_type string, entity_id string, source string, score int")
    assert {(r.entity_id, r.source, r.score) for r in search.best_hits(rows).collect()} == {("1", "memory", 50), ("2", "discovery", 75)}


FILES = {
    "web/api.ts": ("export class Client {\n  get(u: string) {\n    if (u) { }\n  }\n}\nexport async function load() {\n  function inner() {}\n}\nimport x from './util'", {"Client": (1, 5, "class Client"), "Client.get": (2, 4, "Client.get(...)"), "load": (6, 8, "function load(...)")}),
    "app/h.py": ("import os\nclass Handler:\n    def run(self): pass\ndef health(): pass", {"Handler": (2, 3, "class Handler"), "Handler.run": (3, 3, "Handler.run(...)"), "health": (4, 4, "def health(...)")}),
    "lib.rs": ("pub struct S {}\npub trait T { fn q(); }\nimpl<'a> T for S {\n  pub fn q() { let c = '}'; }\n}\nfn run() {}", {"S": (1, 1, "struct S"), "T": (2, 2, "trait T"), "S.q": (4, 4, "S.q(...)"), "run": (6, 6, "fn run(...)")}),
    "H.java": ('public class H {\n  private int f = g();\n  H() {}\n  @Override public String toString() { return "{"; }\n  void run(int a,\n     int b) {\n  }\n  class B { void z() {} }\n}\ninterface I { void m(); }', {"H": (1, 9, "class H"), "H.toString": (4, 4, "H.toString(...)"), "H.run": (5, 7, "H.run(...)"), "I": (10, 10, "interface I")}),
    "H.cs": ("namespace N {\n public class H : B {\n  public H() { }\n  public async Task<int> Run(int x) {\n  }\n  int P { get; set; }\n  void E() => Foo();\n }\n}", {"H": (2, 8, "class_declaration H"), "H.Run": (4, 5, "H.Run(...)"), "H.E": (7, 7, "H.E(...)")}),
    "s.sql": ("CREATE TABLE IF NOT EXISTS users (\n id int\n);\ncreate view v as select 1;", {"users": (1, 3, "table users"), "v": (4, 4, "view v")}),
    "h.ex": ("defmodule App.Handler do\n  def run do\n  end\nend\n", {"App.Handler": (1, 4, "defmodule App.Handler"), "run": (2, 3, "def run(...)")}),
    "h.sh": ("run() {\n}", {"run": (1, 2, "run()")}),
    "h.c": ("typedef struct {\n} Box;\nint main(void) {\n}\nint proto(int);\n", {"Box": (1, 2, "struct Box"), "main": (3, 4, "main(...)")}),
    "h.cpp": ("class H {\n public:\n  int run(int a) const { return a; }\n  void decl();\n};\nclass Fwd;\n", {"H": (1, 5, "class H"), "H.run": (3, 3, "H::run(...)")}),
    "h.rb": ("module M\nend\nclass K\n  def a\n    if x\n    end\n  end\n  def self.b; end\nend", {"M": (1, 2, "module M"), "K": (3, 9, "class K"), "K.a": (4, 7, "K#a(...)")}),
    "h.kt": ("class H {\n  fun run() = 1\n}\nfun top() {}\n", {"H": (1, 3, "class H"), "H.run": (2, 2, "H.run(...)"), "top": (4, 4, "fun top(...)")}),
    "h.swift": ("struct H {\n  func run() -> Int {\n    1\n  }\n}\nprotocol P { func q() }\n", {"H": (1, 5, "class H"), "H.run": (2, 4, "H.run(...)"), "P": (6, 6, "protocol P")}),
    "h.php": ("<?php\nclass H {\n  public function run($a) { }\n}\nfunction top() {\n}\n", {"H": (2, 4, "class H"), "H.run": (3, 3, "H->run(...)"), "top": (5, 6, "function top(...)")}),
    "h.scala": ("object H {\n  def run(): Int = {\n    1\n  }\n}\ntrait T\n", {"H": (1, 5, "object H"), "H.run": (2, 4, "H.run(...)"), "T": (6, 6, "trait T")}),
    "h.lua": ("local H = {\n}\nfunction H.run(x)\n  if x then\n  end\nend\n", {"H": (1, 2, "table H"), "H.run": (3, 6, "H.run(...)")}),
    "h.dart": ("class H {\n  H(this.a);\n  void run() {\n  }\n}\n", {"H": (1, 5, "class H"), "H.run": (3, 4, "H.run(...)")}),
    "h.zig": ("pub const H = struct {\n  pub fn run() void {\n  }\n};\n", {"H": (1, 4, "struct H"), "H.run": (2, 3, "H.run(...)")}),
    "broken.py": ("def (", {}),
}
GO = """package a

import (
	"net/http"
	q "m/pkg/b"
)

type T struct {
	X, Y int
	*U
	M map[string][]func(a int) error
}

type U interface {
	Do(x int) error
	Z()
}

type (
	V struct{}
	W = string
)

var _ U = (*T)(nil)

func init() {}

// func Gone() {
func Run(f interface{}) interface{} {
	return nil
}

func (t *T) Do(x int) error {
	return nil
}

func HandleX(w http.ResponseWriter) {}
"""


def test_symbols(spark):
    rows = [(p, t) for p, (t, _) in FILES.items()] + [("x_test.go", "func A() {}"), ("a/test_x.py", "def a(): pass"), ("readme.md", "# x"), ("empty.go", ""), ("null.java", None)]
    found = code.parse_symbols(spark.createDataFrame(rows, "path string, text string")).where("entity_type <> 'file'").collect()
    for path, (_, wanted) in FILES.items():
        assert {r.qualified_name: (r.start_line, r.end_line, r.signature) for r in found if r.path == path} == {f"{path}.{n}": x for n, x in wanted.items()}, path
    assert {r.path for r in found} <= set(FILES)
    assert {r.receiver for r in found if r.entity_type == "method"} == {"Client", "Handler", "S", "H", "K"}
    assert code.imports("typescript", FILES["web/api.ts"][0]) == ["util"] and code.imports("python", "from a.b import c\nimport d") == ["a.b", "d"]


@pytest.mark.parametrize("name", [*symbols.GRAMMAR, "go"])
def test_long_lines_and_open_bodies(name):
    """Odd texts are scanned in time that grows with their length."""
    n = 6000
    began = time.perf_counter()
    for text in ("class A {\n" + "ab " * n + "\n}\n", "a" * 3 * n, "f(" * n + "{" * n, "class A {\n" * n, "\x00}{)(" * n):
        assert [r[1] for r in symbols.symbols("x", name, text)][0] == "file" and [*symbols.claims("x", name, text)] == []
    assert time.perf_counter() - began < 20


def test_go_symbols_and_relations(spark):
    files = spark.createDataFrame([("pkg/a/t.go", GO), ("pkg/a/z.go", "package a\nfunc Run() {}\n"), ("pkg/b/b.go", "package b\n")], "path string, text string")
    rows = code.parse_symbols(files)
    found = {(r.entity_type, r.qualified_name): (r.path, r.start_line, r.end_line, r.signature) for r in rows.where("entity_type <> 'file'").collect()}
    at = lambda *x: ("pkg/a/t.go", *x)
    assert found == {
        ("struct", "pkg/a.T"): at(8, 12, "X int; Y int; *U; M map[string][]func(...)"), ("interface", "pkg/a.U"): at(14, 17, "Do(...); Z()"), ("struct", "pkg/a.V"): at(20, 20, ""), ("type_alias", "pkg/a.W"): at(21, 21, "type W string"),
        ("function", "pkg/a.Run"): at(29, 31, "func Run(...)"), ("method", "pkg/a.T.Do"): at(33, 35, "func (T) Do(...)"), ("function", "pkg/a.HandleX"): at(37, 37, "func HandleX(...)"), ("endpoint", "pkg/a.HandleX"): at(37, 37, ""),
    }
    both = rows.unionByName(code.package_symbols(rows)).withColumn("id", F.concat_ws(":", "entity_type", "qualified_name"))
    links = code.resolve_claims(code.parse_claims(files), both, "m")
    assert {(r.relationship_type, r.from_id, r.to_id, r.line) for r in links.collect()} == {("IMPORTS", "file:pkg/a/t.go", "package:pkg/b", 5), ("DEPENDS_ON", "struct:pkg/a.T", "interface:pkg/a.U", 10), ("IMPLEMENTS", "struct:pkg/a.T", "interface:pkg/a.U", 24), ("EXPOSES_ENDPOINT", "package:pkg/a", "endpoint:pkg/a.HandleX", 37)}


def test_modules(spark):
    paths = spark.createDataFrame([("a/b/c.go",), ("a/x.go",), ("z/y.go",)], "path string")
    markers = spark.createDataFrame([("a",), ("a/b",)], "folder string")
    assert {r.path: r.module for r in code.module_roots(paths, markers).collect()} == {"a/b/c.go": "a/b", "a/x.go": "a", "z/y.go": "z"}


ENTITY = "id string, entity_type string, name string, qualified_name string, package_path string, file_path string, receiver string"


def entities(spark):
    return spark.createDataFrame(
        [("1", "function", "Run", "pkg/a.Run", "pkg/a", "pkg/a/f.go", None), ("2", "function", "Run", "pkg/b.Run", "pkg/b", "pkg/b/f.go", None), ("3", "method", "Dod", "pkg/a.T.Dod", "pkg/a", "pkg/a/f.go", "T"), ("4", "file", "f.go", "pkg/a/f.go", "pkg/a", "pkg/a/f.go", None), ("5", "package", "a", "pkg/a", "pkg/a", "", None)], ENTITY
    )


def test_symbol_matching(spark):
    ids = lambda *a: {r.id for r in code.symbol_matches(entities(spark), *a).collect()}
    assert ids("pkg/a.Run") == {"1"} and ids("run") == {"1", "2"} and ids("run", "b") == {"2"} and ids("T.dod") == {"3"} and ids("nothing") == set()


def test_bridge(spark):
    memories = spark.createDataFrame([("m1", "DECISION", "see pkg/a/f.go and Dod"), ("m2", "EVENT", "Dod pkg/a.Run"), ("m3", "FACT", "uses pkg/a and Run")], "memory_id string, kind string, text string")
    found = {(r.memory_id, r.code_id, r.strategy) for r in code.bridge(memories, entities(spark)).collect()}
    assert ("m1", "4", "file_path") in found and ("m1", "3", "short_name") in found and ("m3", "5", "package_path") in found
    assert not any(m == "m2" and s != "package_path" for m, _, s in found)


def test_calls(spark):
    calls = spark.createDataFrame([("x", "pkg/a", None, "Run"), ("x", "pkg/a", "pkg/b", "Run"), ("x", "pkg/a", "T", "Dod"), ("x", "pkg/a", "v", "Dod"), ("x", "pkg/a", None, "Gone")], "caller_id string, package_path string, qualifier string, name string")
    assert {r.callee_id for r in code.resolve_calls(calls, entities(spark)).collect()} == {"1", "2", "3"}
    assert code.resolve_calls(calls, entities(spark)).count() == 3


@pytest.mark.parametrize(
    "question,kind,subject",
    [("What is the struct Handler?", "concept", "Handler"), ("who owns Storage?", "ownership", "Storage"), ("Why are we using Redis?", "rationale", "Redis"), ("what depends on auth", "dependency", "auth"), ("ABC-12: add login", "task", "add login"), ("add login", "task", "add login"), ("What depends on fact f1?", "dependency", "fact f1"), ("what is this repository?", "concept", "this repository"), ("Why was decision d_1 made?", "decision_guidance", "d_1"), ("what caused event e-2", "event_guidance", "e-2"), ("redis cache", "search", "redis cache")],
)
def test_routes(question, kind, subject):
    assert answers.route(question) == answers.Route(kind, subject)


def test_strict_routes():
    """Asked as a question by id, the same words name an entity."""
    assert answers.strict_route("What depends on fact f1?") == answers.Route("fact_impact", "f1")
    assert answers.strict_route("what is this repository?") == answers.Route("overview", "")
    assert answers.strict_route("redis cache") is None


def test_answer_helpers(spark):
    assert answers.ask_terms("Who created the Redis cache, redis?") == ["redis", "cache"]
    assert answers.capped(list(range(12)), "ship") == (list(range(10)), 2)
    assert answers.truncated("x" * 50, 5) == "x" * 17 + "..."
    assert [c for c, _ in answers.advisories(["a"], [], ["x"] * 3, [])] == ["ownership", "impact", "rollback"]
    with pytest.raises(ValueError):
        answers.markdown("T", {"a": []})
    assert answers.markdown("T", {"A": ["x"], "B": []}) == "# T\n\n## A\n\n- x\n"
    texts = ["# T\n## Context\n a  b\n\nc\n## Next\nd", "# T\none\n\ntwo\nthree\nfour", "", "x" * 300]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(answers.rationale(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == ["a b c", "one two three", "", "x" * 280 + "..."]
    assert answers.section("s", "t", spark.createDataFrame([(2, "b"), (1, "a")], "i int, x string"), "i").first().data == '[{"i":1,"x":"a"},{"i":2,"x":"b"}]'


def test_words_are_counted_in_their_rows(spark):
    """Building an index exchanges no word, and a document's words are counted with their repeats."""
    rows = [("a", "EVENT", "add login", "Add x add"), ("b", "FACT", "", "--"), ("c", "FACT", "storage", None)]
    counted = search.counted_words(spark.createDataFrame(rows, "id string, entity_type string, title string, content string"))
    assert {r.id: (r.length, [tuple(w) for w in r.words]) for r in counted.collect()} == {"a": (5, [("add", 3), ("login", 1), ("x", 1)]), "b": (0, []), "c": (1, [("storage", 1)])}
    found = search.postings(counted)
    assert found.columns == ["doc", "word", "tf"] and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
