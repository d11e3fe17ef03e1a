"""Sessions against a plain loop over each client's clicks."""

import hashlib
import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from papyrine.llm import sessions as S

DAY = datetime(2024, 1, 5)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double"


def us(t):
    d = t - datetime(1970, 1, 1)
    return (d.days * 86400 + d.seconds) * 10**6 + d.microseconds


def plain(rows):
    by, late = defaultdict(list), defaultdict(list)
    for i, t, a, c, kind, v in {r[0]: r for r in rows if None not in (r[0], r[1], r[3])}.values():
        final = kind == "purchase" and v is not None and v >= 60
        cents = math.floor(100 * v + 0.5) if v is not None and math.isfinite(v) else 0
        (late if a is not None and a - t > timedelta(minutes=60) else by)[c].append((us(t), i, final, cents))
    out = []
    for c, clicks in by.items():
        clicks.sort()
        held, mine = [], []
        for x in clicks:
            why = None
            if held:
                end, start = held[-1], held[0]
                why = "end" if end[2] else "gap" if x[0] - end[0] >= 1800 * 10**6 else "length" if x[0] - start[0] > 7200 * 10**6 else None
            if why:
                mine.append((held, why))
                held = []
            held.append(x)
        mine.append((held, "end" if held[-1][2] else "none"))
        starts = [s[0][0][0] for s in mine] + [math.inf]
        for n, (s, why) in enumerate(mine):
            n_late = sum(starts[n] <= x[0] < starts[n + 1] for x in late[c])
            out.append((c, s[0][1], s[0][0], s[-1][0], len(s), n_late, sum(x[3] for x in s), why, hashlib.sha256(",".join(str(x[1]) for x in s).encode()).hexdigest()))
    return sorted(out)


def got(spark, rows):
    names = ("client_id", "session_id", "start_us", "end_us", "n_clicks", "n_late", "value_cents", "closed_by", "path_sha256")
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("slot", "island", "last", "session", "row")})
    return sorted(tuple(r[n] for n in names) for r in S.sessions(df).collect())


def test_random_clients(spark):
    rng = random.Random(4)
    rows, at = [], {c: DAY for c in range(4)}
    for i in range(900):
        c = rng.choice([0, 0, 0, 1, 2, 3])
        at[c] += timedelta(seconds=rng.choice([0, 0, 60, 400, 900, 1799, 1800, 1801, 3000]) if c else rng.choice([0, 30, 200, 1500]), microseconds=rng.choice([0, 0, 1, 999_999]))
        late = rng.random() < 0.15
        t = at[c] - timedelta(minutes=rng.choice([0, 10, 300])) if late else at[c]
        rows.append((1000 - i if i % 2 else 5000 + i, t, t + timedelta(minutes=61) if late else None if i % 7 == 0 else t, c, rng.choice(["view", "purchase"]), rng.choice([None, 3.0, 59.99, 60.0, -2.345, 75.5]) if i % 9 == 0 else 1.005))
    rows += rng.sample(rows, 80)
    want = plain(rows)
    assert got(spark, rows) == want and {r[7] for r in want} == {"end", "gap", "length", "none"} and any(r[5] for r in want)


def test_long_islands(spark):
    """Islands of many hours are cut again and again, at exactly two hours not yet."""
    rows = [(i, DAY + timedelta(minutes=10 * i), None, 1, "view", 1.0) for i in range(300)]
    rows += [(1000 + i, DAY + timedelta(minutes=20 * i), None, 2, "view", 1.0) for i in range(40)]
    rows += [(2000 + i, DAY + timedelta(minutes=125), DAY + timedelta(hours=9), i % 3, "view", 1.0) for i in range(9)]
    want = plain(rows)
    assert got(spark, rows) == want and sum(r[7] == "length" for r in want) > 20


def test_edges(spark):
    assert got(spark, []) == []
    rows = [
        (1, DAY, None, None, "view", 1.0),
        (2, None, None, 1, "view", 1.0),
        (None, DAY, None, 1, "view", 1.0),
        (3, DAY, DAY + timedelta(hours=2), 7, "view", 1.0),  # a client with late clicks alone
        (4, DAY, None, 8, "purchase", float("nan")),
        (5, DAY, None, 8, "purchase", float("inf")),
        (6, DAY, DAY + timedelta(minutes=60), 8, None, None),
        (7, DAY - timedelta(days=3), DAY, 8, "view", 1.0),  # late, before the client's first session
        (8, DAY + timedelta(days=30), DAY + timedelta(days=31), 8, "view", 1.0),  # late, days behind its last one
        (9, datetime(1969, 12, 31, 23, 50), None, 9, "view", 0.005),
        (10, datetime(1970, 1, 1, 0, 5), None, 9, "view", None),
    ]
    found = got(spark, rows + rows)
    assert [r[:2] + r[4:8] for r in found] == [(8, 4, 2, 0, 0, "end"), (8, 6, 1, 1, 0, "none"), (9, 9, 2, 0, 1, "none")]
    assert found[2][2] == -600 * 10**6


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_do_not_hang_on_the_session_zone(spark, zone):
    held = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = [(1, datetime(2024, 3, 10, 2, 30, 0, 123456), None, 1, "view", 1.0)]
        assert got(spark, rows)[0][2] == us(rows[0][1])
    finally:
        spark.conf.set("spark.sql.session.timeZone", held)


def test_clicks_are_dealt_by_slot_once(spark):
    """The slots' ends and the windows read one exchange of the clicks."""
    rows = [(i, DAY + timedelta(minutes=i), None, i % 3, "view", 1.0) for i in range(60)]
    found = S.islands(S.taken(spark.createDataFrame(rows, SCHEMA), S.Rule()), S.Rule())
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "REPARTITION_BY_COL" in plan and plan.count("ReusedExchange") >= 2


def test_no_use_of_the_clicks_deals_them_again(spark, tmp_path):
    """From the clicks as they are kept: one exchange by slot runs, the slots' other two uses read it."""
    rows = [(i, DAY + timedelta(minutes=i), None, i % 3, "view", 1.0) for i in range(60)]
    S.taken(spark.createDataFrame(rows, SCHEMA), S.Rule()).write.parquet(f"{tmp_path}/clicks")
    found = S.islands(spark.read.parquet(f"{tmp_path}/clicks"), S.Rule())
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    dealt = [x for x in plan.splitlines() if "REPARTITION_BY_COL" in x]
    assert sum("ReusedExchange" not in x for x in dealt) == 1 and len(dealt) == 3
