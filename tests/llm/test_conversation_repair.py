"""Conversation repair against a plain search over all edits."""

import random
from functools import cache

import duckdb
import pytest
from drawscope.llm import queries, repair



def plain(rows):
    """(cost, audit) by trying every edit, inserts at most twice in a row. rows: (letter, must go, truncated)."""
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    @cache
    def rest(i, q, inserted):
        found = [(0, "")] if i == len(rows) and q in (0, 3) else []
        steps = [(2, "I", i, after[q, x], inserted + 1) for x in "ua" if inserted < 2 and (q, x) in after]
        if i < len(rows):
            letter, must, cut = rows[i]
            steps.append((3, "D", i + 1, q, 0))
            if not must:
                steps += [(2 + cut, "R", i + 1, after[q, x], 0) for x in "ua" if (q, x) in after]
                if (q, letter) in after:
                    steps.append((cut, "K", i + 1, after[q, letter], 0))
        return min(found + [(c + x[0], e + x[1]) for c, e, j, p, n in steps if (x := rest(j, p, n))], default=None)

    return rest(0, 0, 0)


def coded(rows):
    return "".join(f"{letter}{int(must)}{int(cut)}" for letter, must, cut in rows)


@pytest.mark.parametrize("run", [1, 2, 3, 256])
def test_search_equals_a_plain_one(monkeypatch, run):
    monkeypatch.setattr(repair, "RUN", run)
    rng = random.Random(run)
    for _ in range(1500):
        must, letters = rng.choice([0.0, 0.2, 0.6]), rng.choice(["ua", "suax", "uuua", "sx"])
        rows = [(rng.choice(letters), int(rng.random() < must), 0) for _ in range(rng.randrange(12))]
        rows = [(x, m, int(not m and rng.random() < 0.3)) for x, m, _ in rows]
        assert repair.search(coded(rows)) == plain(tuple(rows)), rows


def test_long_conversations_are_searched_in_proportion():
    rng = random.Random(5)
    rows = "".join(rng.choice(["u00", "a00", "u01", "s00", "a10", "x00"]) for _ in range(20_000))
    cost, audit = repair.search(rows)
    assert sum(x != "I" for x in audit) == 20_000 and cost > 0
    # A piece with a sound border on both sides is repaired alike by itself.
    alike = "u00a00" * 5000 + "u00u00" + "u00a00" * 5000
    assert repair.search(alike) == (2, "K" * 10_001 + "R" + "K" * 10_000)


def test_faults_edits_and_odd_rows(spark):
    rows = [(1, 0, "user", "Hi.", 1, 9), (1, 2, "assistant", "Yes", 1, 9), (1, 2, "assistant", "Yes", 1, 9), (2, None, None, None, 1, 9), (3, 5, "user", "gone", 0, 9), (None, 1, "user", "a.", 1, 9), (None, 1, "user", "b.", 2, 9), (4, None, "", " .\t", 1, 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, turns int")
    got = {(r.conv_id, r.audit): r for r in repair.repair(df, copies="n").collect()}
    assert len(got) == 6
    r = got[1, "KKD"]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) == (1, 0, 1, 1, 1, 4)
    assert [tuple(t) for t in r.repaired] == [("user", "Hi."), ("assistant", "Yes")]
    assert (got[2, "D"].blank, got[2, "D"].gaps, got[2, "D"].cost) == (1, 0, 3)
    r = got[3, ""]
    assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.repaired) == (0, 0, 0, 0, 0, 0, [])
    assert (got[None, "KI"].cost, got[None, "KDI"].duplicate) == (2, 1)
    assert [tuple(t) for t in got[4, "D"].repaired] == [] and got[4, "D"].cost == 3  # as cheap as any: R and I cost 4
    assert repair.repair(df.limit(0)).count() == 0


def test_query_equals_its_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: rng.choice(["a.", "b", "", " \n", "é?", "x. ", None, "Same.", "c!\x0b"])
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(9)]), rng.choice(["user", "user", "assistant", "system", "tool", "", None]), text(), "x") for _ in range(500)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, alone string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op11_conversation_repair(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT conv_id, turn, role, text FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.OP11_SQL)
    columns = [c[0] for c in want.description]
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    want = con.execute(queries.OP11_SQL)
    columns = [c[0] for c in want.description]
    got = queries.op11_conversation_repair(spark, "/root/testdata/sf0.01").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
