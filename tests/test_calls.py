"""Call sites of Go functions against a golden list, and their callees."""

import pytest
from pyspark.sql import functions as F

from annalist.operators import calls, code

FILES = {
    "cmd/main.go": """package main

import (
	"fmt"
	st "demo/internal/store"
	"demo/internal/util"
)

func init() { Setup() }

func Setup() {}

func main() {
	Setup() // Run()
	s := st.Open("x(y)")
	s.Close()
	util.
		Trim(`a(b)`)
	fmt.Println(len(helper(1)), []byte("q"), T(3))
	go worker(func(n int) int { return helper(n) })
	defer st.Default.Flush()
	f := s.Close
	f()
	main()
	if helper := util.Trim; helper("z") != "" {
		helper("a")
	} else {
		helper("b")
	}
	helper(2)
	gen[int](4)
	make(map[string]int)
	call()(5)
	obj.field.sub.Run()
}

func helper(n int) []int { return nil }

func worker(f func(int) int) { f(1) }

func gen[K any](k K) {}

func call() func(int) { return nil }

type T int
""",
    "internal/store/store.go": """package store

import "demo/internal/util"

type Store struct{ name string }

type Cache struct{}

type Reader interface {
	Read(p int) int
}

func Open(name string) *Store {
	store := &Store{name: util.Trim(name)}
	store.load(name)
	for _, Open := range []string{util.Trim("a")} {
		Open(1)
	}
	switch x := util.Trim(name); x {
	case "a":
		unknown.Evict()
	}
	var r interface {
		Get(k int) int
	}
	_ = r
	return store
}

func (s *Store) load(name string) {
	s.load(name)
	cache.Evict()
	c.Close()
}

func (s *Store) Close() { Flush() }

func (c *Cache) Evict() {}

func (c *Cache) Close() {}

func Flush() {}
""",
    "internal/util/util.go": "package util\n\nfunc Trim(s string) string {\n\treturn trim(s)\n}\n\nfunc trim(s string) string { return s }\n",
    "web/a.ts": "function helper() { helper() }",
}
#: (caller, callee, line): by the rules of the resolver, shadowed names included.
CALLS = {
    ("cmd.main", "cmd.Setup", 14), ("cmd.main", "internal/store.Open", 15), ("cmd.main", "internal/util.Trim", 17), ("cmd.main", "cmd.helper", 19), ("cmd.main", "cmd.worker", 20),
    ("cmd.main", "internal/store.Flush", 21), ("cmd.main", "cmd.gen", 0), ("cmd.main", "cmd.call", 33),
    ("internal/store.Open", "internal/util.Trim", 14), ("internal/store.Open", "internal/store.Store.load", 15), ("internal/store.Open", "internal/store.Cache.Evict", 21),
    ("internal/store.Store.load", "internal/store.Cache.Evict", 32), ("internal/store.Store.Close", "internal/store.Flush", 36),
    ("internal/util.Trim", "internal/util.trim", 4),
} - {("cmd.main", "cmd.gen", 0)}


@pytest.fixture(scope="module")
def tree(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, text string")
    return files, code.parse_symbols(files).withColumn("id", F.col("qualified_name"))


def test_golden_calls(tree):
    files, entities = tree
    found = calls.resolve_call_sites(calls.call_sites(files), entities, "demo")
    assert {(r.from_id, r.to_id, r.line) for r in found.collect()} == CALLS
    assert {r.relationship_type for r in found.collect()} == {"CALLS"}


def test_shadowed_names(tree):
    """A header's, parameter's or variable's name hides the package's; without compat such calls lead nowhere."""
    files, entities = tree
    sites = calls.call_sites(files)
    hidden = {(r.caller, r.name, r.line) for r in sites.where("shadowed AND form = 'name'").collect()}
    assert hidden == {("cmd.main", "f", 23), ("cmd.main", "helper", 25), ("cmd.main", "helper", 26), ("cmd.main", "helper", 28), ("cmd.worker", "f", 39), ("internal/store.Open", "Open", 17)}
    strict = {(r.from_id, r.to_id) for r in calls.resolve_call_sites(sites, entities, "demo", compat=False).collect()}
    assert strict == {(a, b) for a, b, _ in CALLS}  # helper is also called where nothing hides it
    only = {"m/a.go": "package m\n\nfunc F(g func()) {\n\tg()\n\th := 1\n\th()\n}\n\nfunc g() {}\n\nfunc h() {}\n"}
    own = files.sparkSession.createDataFrame(list(only.items()), "path string, text string")
    symbols = code.parse_symbols(own).withColumn("id", F.col("qualified_name"))
    pairs = lambda compat: {(r.from_id, r.to_id) for r in calls.resolve_call_sites(calls.call_sites(own), symbols, "demo", compat).collect()}
    assert pairs(True) == {("m.F", "m.g"), ("m.F", "m.h")} and pairs(False) == set()


def test_sites_of_odd_files(spark):
    texts = ["", "package a", "func", "package a\nfunc f(", "package a\nfunc f() {", "package a\nfunc f() { g(", None, "package a\nfunc f() " + "{" * 500 + "g()" + "}" * 500]
    files = spark.createDataFrame([(f"a/{n}.go", x) for n, x in enumerate(texts)], "path string, text string")
    assert {(r.path, r.name) for r in calls.call_sites(files).collect()} == {("a/5.go", "g"), ("a/7.go", "g")}


def test_long_bodies_take_linear_time():
    import time

    def spent(n):
        began = time.perf_counter()
        assert len(list(calls.go_call_sites("a/x.go", "go", "package a\nfunc f() {\n" + "\tx.g(h(1))\n" * n + "}\n"))) == 2 * n
        return time.perf_counter() - began

    spent(1000)
    assert spent(40000) < 14 * max(spent(4000), 0.02)


def test_large_sides_are_not_broadcast(spark):
    """Parsing makes far more of a file than its size tells, so no join of entities may trust that guess."""
    from annalist.operators import calls

    sites = spark.createDataFrame([], calls.SITES)
    entities = spark.createDataFrame([], "id string, entity_type string, name string, qualified_name string, package_path string, receiver string")
    assert "Broadcast" not in calls.resolve_call_sites(sites, entities, "demo")._jdf.queryExecution().executedPlan().toString()
