"""The test tables seen as the knowledge model's raw tables.

Each mapping is a list of column expressions in the SQL that Spark and DuckDB share, so that the oracle reads
the very same rows.  Every row of a table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REPO = "repo_main"

COMMITS = {
    "id": "'evt' || CAST(event_id AS STRING)",
    "repository_id": f"'{REPO}'",
    "source_type": "'commit'",
    "reference": "'evt' || CAST(event_id AS STRING)",
    "title": "CASE event_type WHEN 'signup' THEN 'feat(auth): add login flow m' WHEN 'error' THEN 'fix: repair sqlite query m' WHEN 'click' THEN 'refactor: tidy agent tool m' WHEN 'view' THEN 'docs: describe context render m' ELSE 'wip checkpoint m' END || CAST(event_id AS STRING)",
    "author": "'User ' || CAST(user_id AS STRING) || ' <u' || CAST(user_id AS STRING) || '@example.com>'",
    "ts": "ts",
    "content": "CAST(NULL AS STRING)",
    "status": "CAST(NULL AS STRING)",
}

RECORDS = {
    "id": "'adr' || CAST(doc_id AS STRING)",
    "repository_id": f"'{REPO}'",
    "source_type": "CASE WHEN doc_id % 10 = 9 THEN 'architecture_doc' ELSE 'adr' END",
    "reference": "'docs/adr/' || CAST(doc_id AS STRING) || '.md'",
    "title": "'Adopt m' || CAST(doc_id AS STRING)",
    "author": "'User ' || CAST(doc_id % 150 AS STRING) || ' <u' || CAST(doc_id % 150 AS STRING) || '@example.com>'",
    "ts": "CAST(NULL AS TIMESTAMP)",
    "content": "text || chr(10) || 'Service ' || source || ' uses ' || lang || '.' || chr(10) || 'Module' || CAST(doc_id AS STRING) || ' depends on Module' || CAST(CAST(floor(doc_id / 3) AS BIGINT) AS STRING) || ' and token m' || CAST(doc_id AS STRING) || ' calls storage. Reduce latency of m' || CAST(doc_id AS STRING) || '.' || CASE WHEN doc_id % 5 = 0 THEN ' Breaking schema change.' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN chr(10) || 'See docs/adr/' || CAST(doc_id + 1 AS STRING) || '.md' ELSE '' END || CASE doc_id % 11 WHEN 0 THEN chr(10) || 'As in docs/adr/' || CAST(doc_id + 2 AS STRING) || '.md.' WHEN 1 THEN chr(10) || 'The [record](docs/adr/' || CAST(doc_id + 3 AS STRING) || '.md) says more' ELSE '' END",
    "status": "CASE doc_id % 3 WHEN 0 THEN 'Accepted' WHEN 1 THEN 'Superseded' ELSE '' END",
}

#: A Go file of each part: a type with a method and a function, whose calls lead to parts of the same brand, of a brand that the size names, to its
#: own method, to the only method of a name, out of the module and to itself.
GO_MODULE = "demo"
GO_FILE = {
    "path": "'pkg/' || p_brand || '/part' || CAST(p_partkey AS STRING) || '.go'",
    "text": "'package brand\n\nimport (\n\t\"fmt\"\n\tnext \"demo/pkg/Brand#' || CAST(p_size % 5 + 1 AS STRING) || CAST(CAST(floor(p_size / 5) AS BIGINT) % 5 + 1 AS STRING) || '\"\n)\n\ntype T' || k || ' struct{}\n\n// Fn1(2) is no call\n"
    "func (t *T' || k || ') Run' || k || '(x int) int {\n\tfmt.Println(\"Fn' || k || '(x)\")\n\treturn Fn' || k1 || '(x) + next.Fn' || k2 || '(x)\n}\n\nfunc Fn' || k || '(x int) int {\n\tt' || k || ' := &T' || k || '{}\n\tif y := Fn' || k3 || '(x); y > 0 {\n"
    "\t\treturn t' || k || '.Run' || k || '(y)\n\t}\n\tother.Run' || k4 || '(x)\n\treturn Fn' || k || '(x)\n}\n'",
}


def go_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of ``GO_FILE``."""
    keys = [f"CAST(p_partkey + {n} AS STRING) AS k{n or ''}" for n in range(5)]
    return read(spark, sf_dir, "part").selectExpr("p_partkey", "p_brand", "p_size", *keys).selectExpr(*[f"{e} AS {n}" for n, e in GO_FILE.items()])


def select_list(columns: dict[str, str]) -> str:
    return ", ".join(f"{expression} AS {name}" for name, expression in columns.items())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in COMMITS.items()])


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision records; their time is empty, as scanned documents' authorship is not dated."""
    return read(spark, sf_dir, "documents").selectExpr(*[f"CAST(NULL AS TIMESTAMP_NTZ) AS {n}" if n == "ts" else f"{e} AS {n}" for n, e in RECORDS.items()])


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits(spark, sf_dir).unionByName(records(spark, sf_dir))
