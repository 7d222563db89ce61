import random
import re
from hashlib import md5, sha256
from itertools import product
from zlib import crc32

import pytest

from annalist.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, costs int, audit string"
SHAPE = re.compile(r"(s?(ua)+)?")


def faulty(rows):
    """Rows (turn, role, text) in order with their faults, by the definition."""
    out, seen = [], set()
    for turn, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def damaged(rows):
    """rows (conv_id, turn, role, text) by the definition: conversations of (turn, role, text) in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2].encode()).hexdigest())) for k, v in out.items()}


def cheapest(rows):
    """The least (cost, audit) over all edit sequences with up to two insertions in each place."""
    best = None
    for edits in product("DKR", repeat=len(rows)):
        if any(e != "D" and r[3] in (1, 2) for e, r in zip(edits, rows, strict=True)):
            continue
        cost = sum({"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and r[3] == 3 else 0) for e, r in zip(edits, rows, strict=True))
        options = [(cost, "", "")]
        for e, r in [*zip(edits, rows, strict=True), ("", None)]:
            grown = []
            for done, audit, roles in options:
                for extra in ("", "u", "a", "ua", "au"):
                    after = {"D": [""], "K": [r[1][0]] if r and r[1] else [], "R": ["u", "a"], "": [""]}[e]
                    grown += [(done + 3 * len(extra), audit + "I" * len(extra) + e, roles + extra + x) for x in after]
            # only starts of the shape go on
            options = [g for g in set(grown) if re.fullmatch(r"s?(ua)*u?", g[2])]
        for done, audit, roles in options:
            if SHAPE.fullmatch(roles) and (best is None or (done, audit) < best):
                best = (done, audit)
    return best


def replayed(rows, audit):
    out, rest = [], iter(rows)
    for edit in audit:
        row = None if edit == "I" else next(rest)
        if edit == "D":
            continue
        pairs = len(out) - bool(out and out[0][0][:1] == "s")
        role = row[1] if edit == "K" else ("user", "assistant")[pairs % 2]
        out.append((role, "" if edit == "I" else row[2]))
    return out


def report(rows):
    """All of a conversation's columns but the audit and what follows from it."""
    turns = [r[0] for r in rows if r[0] is not None]
    kinds = [r[3] for r in rows]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3), illegal)


def random_rows(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "open end", "", " \t", "Why?\n ", None, "É. ", "a.b"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    return [(conv, rng.choice([t, t, t * 2, None]), rng.choice(roles), rng.choice(texts)) for conv in range(conversations) for t in range(rng.randint(1, most))]


def test_least_edits(spark):
    """Random conversations against all edit sequences; the digest against the replayed rows; blocks of one to three rows."""
    rows = random_rows(1, 60, 5) + [(None, 1, "user", "Hi."), (None, None, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for conv, own in damaged(rows).items():
        own = faulty(own)
        cost, audit = cheapest(own)
        lines = "\n".join(f"{r}:{t}" for r, t in replayed(own, audit))
        want[conv] = (*report(own), cost, audit, sha256(lines.encode()).hexdigest())
    for block in (1, 2, 3, 1024):
        got = {r.conv_id: tuple(r)[1:] for r in c.repaired_digests(c.damage(df), block).collect()}
        assert got == want


def test_damage(spark):
    rows = [(i, t, "assistant", "One. Two! Three?") for i in range(40) for t in range(4)]
    got = {}
    for r in c.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(r.conv_id, []).extend([(r.turn, r.role, r.text)] * r.copies)
    assert {k: sorted(v) for k, v in got.items() if v} == {k: sorted(v) for k, v in damaged(rows).items() if v}


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Yes."), (1, 2, "user", "Why?"), (2, 0, "user", " "), (3, 0, "user", "Hi."), (3, 1, "user", "Oh."), (3, 2, "assistant", "So.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(c.repair(c.undamaged(df)).collect(), key=lambda r: (r.conv_id, r.position)):
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text, r.edit))
    # the assistant row goes or gets a user row before it; "I" before "K" costs 3 + 3, deleting it 4 + 3
    assert got[1] == [(0, "system", "Be brief.", "K"), (None, "user", "", "I"), (1, "assistant", "Yes.", "K"), (2, "user", "Why?", "K"), (None, "assistant", "", "I")]
    assert 2 not in got
    assert [r[1] for r in got[3]] == ["user", "assistant", "user", "assistant"] and "".join(r[3] for r in got[3]) == "KIKK"


def test_one_conversation_over_many_tasks(spark):
    """A conversation that holds nearly all rows is parsed in segments; one block or many give the same rows, and no text is lost."""
    rng = random.Random(4)
    rows = [(7, i // 3, rng.choice(["user", "assistant", "system"]), f"text {i % 50}{rng.choice(['.', '', '!'])}") for i in range(6000)]
    rows += [(i, t, "user" if t % 2 == 0 else "assistant", "Fine.") for i in (1, 9) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    ready = c.damage(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        spans = c.segments(c.faults(ready), 100).where("conv_id = 7")
        assert spans.count() >= 60 and spans.select("part").distinct().count() > 1
        small, large = ([tuple(r) for r in c.repaired_digests(ready, n).orderBy("conv_id").collect()] for n in (37, 1 << 20))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert small == large
    own = faulty(damaged(rows)[7])
    row = next(r for r in small if r[0] == 7)
    assert row[1:6] == report(own)
    lines = replayed(own, row[7])
    assert SHAPE.fullmatch("".join(r[:1] for r, _ in lines)) and row[8] == sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def test_clashing_names_and_empty_tables(spark):
    rows = [(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Ho.", 6, "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert c.repaired_digests(c.damage(df)).count() == 1
    assert c.repaired_digests(c.damage(df.where("false"))).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_sql_twin(spark, tmp_path, seed):
    import duckdb

    rows = [r for r in random_rows(seed, 80, 9) if r[1] is not None]
    # the twin places rows of one turn by role and MD5 as the operator does
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "conversations"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations/*.parquet'")
    want = sorted(con.sql(c.ORACLE_SQL).fetchall())
    assert sorted(tuple(r) for r in c.repaired_digests(c.damage(df)).collect()) == want
