"""Conversation repair against a plain dynamic program that carries whole audits."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shipsight.llm import dialogue
from tests.llm.test_operators import SF
from tools.check import norm

COLUMNS = "conv_id long, turn long, role string, text string, line int, segment string, code int, digest string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    """Rows in order with their first fault."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    seen, out = set(), []
    for turn, role, text in sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=order):
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain(rows):
    """The report and the lines of one conversation."""
    rows = faults(rows)
    ways = {"": (0, "", ())}  # by the last initial: cost, audit, lines
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def inserted(ways):
        more = {}
        for state, (cost, audit, lines) in ways.items():
            for _ in range(3):
                more.setdefault(state, []).append((cost, audit, lines))
                state = after[state]
                cost, audit, lines = cost + 2, audit + "I", (*lines, f"{name[state]}:")
        return {s: min(w) for s, w in more.items()}, more

    for _, role, text, fault in rows:
        fresh = {}
        for state, options in inserted(ways)[1].items():
            for cost, audit, lines in options:
                fresh.setdefault(state, []).append((cost + 3, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                late = fault == "truncated"
                to = after[state]
                fresh.setdefault(to, []).append((cost + 2 + late, audit + "R", (*lines, f"{name[to]}:{text}")))
                if (role[:1] == "s" and state == "") or role[:1] == to:
                    fresh.setdefault(role[:1], []).append((cost + late, audit + "K", (*lines, f"{role}:{text}")))
        ways = {s: min(w) for s, w in fresh.items()}
    cost, audit, lines = min(w for s, w in inserted(ways)[0].items() if s in ("", "a"))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    count = lambda f: sum(r[3] == f for r in rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit), "\n".join(lines)


def check(spark, table, segment_rows):
    frame = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in table], COLUMNS).repartition(5)
    report, repaired = dialogue.repair(frame, segment_rows=segment_rows)
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in report.collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: (r.task, r.segment, r.line)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    sums = {r.conv_id: r.repaired_sha256 for r in dialogue.digests(repaired).collect()}
    convs = {}
    for c, *row in table:
        convs.setdefault(c, []).append(row)
    want = {c: plain(rows) for c, rows in convs.items()}
    assert got == {c: w[0] for c, w in want.items()}
    assert {c: "\n".join(x) for c, x in lines.items()} == {c: w[1] for c, w in want.items() if w[1]}
    assert sums == {c: hashlib.sha256(w[1].encode()).hexdigest() for c, w in want.items() if w[1]}


@pytest.mark.parametrize("segment_rows", [1, 3, 16384])
def test_equals_a_plain_program(spark, segment_rows):
    rng = random.Random(segment_rows)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]
    texts = ["Yes.", "no", "Why?", "", " \t\n", None, "So!  \n", "Grüße 東京。", "x" * 5000 + "."]
    table = [(c, rng.choice([None, *range(9)]), rng.choice(roles[: 4 + (c or 5) % 6]), rng.choice([*texts, f"Number {rng.random()}."])) for c in [None, *range(60)] for _ in range(rng.randrange(1, 12))]
    check(spark, table, segment_rows)


def test_long_conversation_over_many_segments(spark):
    rng = random.Random(7)
    table = [(1, i, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Same.", f"Number {i}.", f"half {i}"])) for i in range(1500)] + [(2, 5, "user", "Hi.")] * 40
    check(spark, table, 100)


def test_only_deletions_and_nothing_at_all(spark):
    check(spark, [(1, i, "user", " ") for i in range(300)] + [(2, 1, "system", "Be kind."), (3, None, None, None)], 7)
    report, repaired = dialogue.repair(spark.createDataFrame([], COLUMNS))
    assert report.count() == repaired.count() == dialogue.digests(repaired).count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = entry.queries()["op11_conversation_repair"](spark, SF).toPandas()
    assert norm(got) == norm(con.sql(entry.oracle_sql()["op11_conversation_repair"]).df())


def test_query_names_conversations_that_lost_all_turns(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, "user", "Hello.") for i in range(200)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = entry.queries()["op11_conversation_repair"](spark, str(tmp_path)).collect()
    assert len(got) == 201
    from shipsight.llm.queries import damaged
    left = {r.conv_id for r in damaged(rows).select("conv_id").distinct().collect()}
    lost = [r for r in got if r.conv_id not in left]
    assert lost and all(r.audit == "" and r.cost == 0 and r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in lost)
    assert rows.filter(F.col("conv_id").isNull()).count() == 1
