"""Session versions against a plain reading of their definition, over one block and over many levels of them."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from sparkrank.llm import late_sessions as late


def by_definition(events, gap):
    users = {}
    for u, t, b, h in events:
        if None not in (u, t, b):
            users.setdefault(u, []).append((t, b, h))
    out = []
    for u, own in users.items():
        standing = []
        for b in sorted({x[1] for x in own}):
            sessions = []
            for x in sorted(x for x in own if x[1] <= b):
                if sessions and x[0] - sessions[-1][-1][0] <= gap:
                    sessions[-1].append(x)
                else:
                    sessions.append([x])
            made = []
            for s in sessions:
                if any(x[1] == b for x in s):
                    gone = [v for v in standing if s[0][0] <= v[2] and v[3] <= s[-1][0]]
                    for v in gone:
                        v[8:] = [b, s[0][0]]
                    standing = [v for v in standing if v not in gone]
                    made.append([u, b, s[0][0], s[-1][0], len(s), sum(x[1] == b for x in s), len(gone), sum(x[2] for x in s), None, None])
            out += made
            standing += made
    return sorted(map(str, map(tuple, out)))


def got(df):
    return sorted(str(tuple(r)) for r in df.collect())


EVENTS = "user long, t long, batch long, h long"


@pytest.mark.parametrize(("span", "n", "gap", "block", "fan"), [(400, 600, 30, 64, 2), (3000, 900, 30, 512, 3), (50_000, 900, 240, 16_384, 32), (200, 300, 240, 64, 2), (900, 40, 60, 100, 8)])
def test_versions_by_definition(spark, span, n, gap, block, fan):
    rng = random.Random(n + span)
    events = [(rng.choice([1, 1, 1, 1, 2, -3]), t := rng.randrange(-span, span), t // rng.choice([50, 500]) + rng.choice([0, 0, 1, 2, 9]), rng.randrange(1 << 32)) for _ in range(n)]
    events += events[:20] + [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)]
    df = spark.createDataFrame(events, EVENTS)
    assert got(late.late_sessions(df, gap, block, fan)) == by_definition(events, gap)


def test_a_session_over_all_blocks_that_one_event_joins(spark):
    events = [(1, 10 * k, k % 7, 1) for k in range(1, 400) if k != 200] + [(1, 2000, 50, 1)]
    df = spark.createDataFrame(events, EVENTS)
    found = late.late_sessions(df, 15, 64, 4)
    assert got(found) == by_definition(events, 15)
    last = found.where("batch = 50").first()
    assert (last["start_s"], last["end_s"], last["n_events"], last["n_new"], last["n_retracted"]) == (10, 3990, 399, 1, 2)


def test_far_ends_of_the_axis_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(late, "CHUNK", 7)
    events = [(u, t, b, 5) for u in range(40) for t, b in ((u, 0), (u + 200, 1), (u + 100, 2))] + [(1, 1 << 60, 9, 1), (2, -(1 << 60), 9, 1)]
    assert got(late.late_sessions(spark.createDataFrame(events, EVENTS), 120)) == by_definition(events, 120)


def test_conversations(spark, sf):
    con = oracle.connection(sf)
    assert oracle.difference(late.op11_late_sessions(spark, sf), con, late.OP11_SQL) == ""


def test_awkward_conversations(spark, tmp_path):
    rows = [(5, 1, "a"), (5, 1, "b"), (5, 0, None), (None, 3, "c"), (6, None, "d"), (-9, 2, ""), (-9, -4, "e"), (7, 1 << 60, "f"), (1 << 62, 5, "g")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").withColumns({c: F.lit("clash") for c in ("user", "t", "batch", "h", "c", "g", "conv", "n", "kind", "block", "final", "start", "end")})
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    found = late.op11_late_sessions(spark, str(tmp_path)).collect()
    assert sum(r["n_new"] for r in found) == 6 and {r["user"] for r in found} >= {2 * (-9 >> 3) + k for k in (0, 1)} & {r["user"] for r in found}
    assert sum(r["n_retracted"] for r in found) == sum(r["retracted_batch"] is not None for r in found)
    df.where(F.lit(False)).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert late.op11_late_sessions(spark, f"{tmp_path}/none").count() == 0
