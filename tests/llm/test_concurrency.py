import datetime as dt
import math
import random

import pytest

from lexloom.llm import concurrency
from lexloom.llm.concurrency import sweep

START = dt.datetime(2024, 2, 28)
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, nation string, day int"
LINES = "sale_id long, shipped_at timestamp_ntz, cents long"
CLIENTS = "client_id long, nation_id int, updated_at timestamp_ntz, minutes string"


def seconds(t):
    return math.floor((t - dt.datetime(1970, 1, 1)) / dt.timedelta(minutes=1)) * 60


def brute(sales, lines, clients):
    last, nation = {}, {}
    for sale, shipped, _ in lines:
        if sale is not None and shipped is not None:
            last[sale] = max(last.get(sale, shipped), shipped)
    for client, n, updated, _ in sorted(clients, key=lambda r: (r[2], -(r[1] or 0))):
        if client is not None:
            nation[client] = n
    steps = {}
    for sale, client, total, sold, *_ in sales:
        if sold is None:
            continue
        a, b = seconds(sold), seconds(last[sale] + dt.timedelta(days=7)) if sale in last else None
        if b is not None and b <= a:
            continue
        cents = math.floor(100 * total + 0.5) if total is not None and math.isfinite(total) else 0
        own = nation.get(client)
        for n in (-1 if own is None else own, -2):
            for at, sign in ((a, 1), (b, -1)):
                if at is not None:
                    x = steps.setdefault(n, {}).setdefault(at, [0, 0])
                    x[0], x[1] = x[0] + sign, x[1] + sign * cents
    out = []
    for n, own in steps.items():
        moments = sorted(t for t, x in own.items() if x != [0, 0])
        now, sums, high, rows = 0, 0, None, []
        for t, until in zip(moments, [*moments[1:], None], strict=True):
            now, sums = now + own[t][0], sums + own[t][1]
            high = now if high is None else max(high, now)
            rows.append((n, t, until, now, sums, high))
        out += [(*r, r[3] == high) for r in rows]
    return sorted(out, key=repr)


def shop(seed, size):
    """Days of many steps, hot sales and clients, nulls, repeats, moments at which all cancels out."""
    rng = random.Random(seed)
    when = lambda days: START + dt.timedelta(minutes=rng.randrange(0, days * 1440, rng.choice((1, 720))), seconds=rng.randrange(60), microseconds=rng.choice((0, 999_999)))
    client = lambda: rng.choice([7, 7, 7, None, 99, *range(12)])
    sales = [(rng.choice([1, 1, None, *range(size)]), client(), rng.choice([None, float("nan"), float("inf"), 0.0, rng.randrange(9999) / 100, 0.005]), rng.choice([None, *[when(9)] * 9]), "x", 3) for _ in range(size)]
    sales += sales[:5] + [(size + 1, 1, 5.0, dt.datetime(1969, 12, 31, 23, 59, 59, 500_000), "x", 3), (size + 2, 1, 5.0, START, "x", 3), (size + 3, 1, 5.0, START + dt.timedelta(days=7, hours=1), "x", 3)]
    lines = [(rng.choice([1, 1, None, *range(size)]), rng.choice([None, *[when(5)] * 5]), 4) for _ in range(size)]
    lines += [(size + 2, START + dt.timedelta(hours=1), 1), (size + 3, START + dt.timedelta(hours=20), 1), (size + 2, START - dt.timedelta(days=30), 1)]
    clients = [(i, rng.choice([None, 0, 3, -5, 3]), START, "m") for i in range(12)] + [(3, 8, START + dt.timedelta(days=1), "m"), (4, 9, START, "m"), (None, 2, START, "m")]
    clients = [c for c in clients if c[:3] != (4, None, START)]
    return sales, lines, clients


@pytest.mark.parametrize(("seed", "size", "tasks", "fan", "steps"), [(1, 300, 7, 2, 16), (2, 300, 3, 3, 1), (3, 40, 1, 32, 1 << 18), (4, 1500, 11, 2, 1 << 18)])
def test_by_brute_force(spark, seed, size, tasks, fan, steps):
    """Whatever the tasks, the pieces that they write and the pairs that are added, the rows are the same."""
    sales, lines, clients = shop(seed, size)
    if any(c[0] == 4 and c[1] is None for c in clients):
        clients = [c for c in clients if c[0] != 4]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        frames = [spark.createDataFrame(rows, schema).repartition(tasks) for rows, schema in ((sales, SALES), (lines, LINES), (clients, CLIENTS))]
        got = sweep(*frames, fan=fan, steps=steps)
        assert got.columns == ["nation_id", "from_s", "to_s", "n_open", "open_cents", "high_open", "is_peak"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute(sales, lines, clients)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[0])
        spark.conf.set("spark.sql.shuffle.partitions", old[1])


def test_no_rows_and_zones(spark):
    none = [spark.createDataFrame([], s) for s in (SALES, LINES, CLIENTS)]
    assert sweep(*none).count() == 0
    sale = spark.createDataFrame([(1, 1, 2.0, START)], "sale_id long, client_id long, total double, sold_at timestamp_ntz")
    zoned = sale.withColumn("sold_at", sale.sold_at.cast("timestamp"))
    for frame in (sale, zoned):
        assert sorted(map(tuple, sweep(frame, *none[1:]).collect())) == [(n, seconds(START), None, 1, 200, 1, True) for n in (-2, -1)]


def test_functions_are_added_in_pairs():
    import numpy as np

    keys = (np.array([1, 1, 0, 1]), np.array([5, 4, 5, 5]))
    (a, b), opened, cents = concurrency.added(keys, np.array([1, 2, 3, -1]), np.array([7, 0, 0, -7]))
    assert (a.tolist(), b.tolist(), opened.tolist(), cents.tolist()) == ([0, 1], [5, 4], [3, 2], [0, 0])
