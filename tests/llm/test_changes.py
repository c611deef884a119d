"""The change applier against a simulation that handles one row at a time."""

import datetime
import random
import zlib
from collections import defaultdict

import pytest

from almanac.llm import changes

SCHEMA = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, source string, segment string, city string, balance double"
EPOCH = datetime.date(1970, 1, 1)


def simulated(rows):
    """The contract read literally: {change_id: (client_id, status, batch, missed, city, cents, current)}."""
    rows = set(rows)
    ranks = defaultdict(set)
    for r in rows:
        ranks[r[1]].add(r[2])
    rank = {c: {s: i + 1 for i, s in enumerate(sorted(seqs))} for c, seqs in ranks.items()}
    batches = defaultdict(list)
    for change, client, seq, op, valid, _, _, city, balance in rows:
        h = zlib.crc32(str(change).encode())
        if valid is None or h % 11 == 0:
            continue
        day = (valid.date() - EPOCH).days + 2 * (h % 4)
        at = max(1, min(8, 1 + (day - 19723) * 8 // 160))
        batches[at].append((day, change, client, rank[client][seq], op, city, balance))
    upcoming, held, values, out, final, largest = defaultdict(lambda: 1), defaultdict(dict), defaultdict(lambda: (None, None)), {}, {}, None

    def turn(client, batch, missed):
        while upcoming[client] in held[client]:
            day, change, op, city, balance = held[client].pop(upcoming[client])
            old = values[client]
            if op == "I":
                values[client] = (city, balance)
            elif op == "U":
                values[client] = (old[0] if city is None else city, old[1] if balance is None else balance)
            elif op == "D":
                values[client] = (None, None)
            city, balance = values[client]
            out[change] = [client, "applied", batch, missed, city, None if balance is None else int((100 * balance + 0.5) // 1), False]
            final[client] = (change, op)
            upcoming[client] += 1
            missed = 0

    def jump(client, batch):
        n = min(held[client])
        missed, upcoming[client] = n - upcoming[client], n
        turn(client, batch, missed)

    for batch in range(1, 9):
        for client in list(held):
            while largest is not None and held[client] and min(row[0] for row in held[client].values()) + 5 <= largest:
                jump(client, batch)
        for day, change, client, n, op, city, balance in sorted(batches[batch], key=lambda r: r[:2]):
            if n in held[client] or n < upcoming[client]:
                out[change] = [client, "rejected", batch, 0, None, None, False]
            else:
                held[client][n] = (day, change, op, city, balance)
                turn(client, batch, 0)
        largest = max([d for d in [largest, *(r[0] for r in batches[batch])] if d is not None], default=None)
    for client in list(held):
        while held[client]:
            jump(client, 9)
    for change, op in final.values():
        out[change][6] = op != "D"
    return {k: tuple(v) for k, v in out.items()}


def found(spark, folder, rows):
    path = str(folder)
    spark.createDataFrame(sorted(rows, key=str), SCHEMA).write.mode("overwrite").parquet(f"{path}/client_changes.parquet")
    got = changes.op13_changes(spark, path)
    assert got.columns == ["change_id", "client_id", "status", "batch", "missed", "city", "cents", "current"]
    collected = got.collect()
    assert len(collected) == len({r["change_id"] for r in collected})
    return {r["change_id"]: tuple(r)[1:] for r in collected}


def made(seed, clients, count, hot, late=12):
    rng = random.Random(seed)
    rows, numbers = [], defaultdict(int)
    for i in range(count):
        client = 7 if rng.random() < hot else rng.randrange(clients)
        numbers[client] += rng.choice((0, 1, 1, 1, 2))
        day = i * 160 // count + rng.choice((0, 0, 0, rng.randrange(late)))
        valid = None if rng.random() < 0.01 else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day, hours=rng.randrange(24))
        city, balance = rng.choice((None, "Ar", "Bel", "Cor")), rng.choice((None, round(rng.uniform(-999, 999), 2)))
        rows.append((i, client, numbers[client], rng.choice("IUUUUD"), valid, "web", None, city, balance))
        if rng.random() < 0.02:
            rows.append(rows[-1])
    return rows


@pytest.mark.parametrize(("seed", "clients", "count", "hot", "late"), [(1, 40, 700, 0.5, 12), (2, 3, 2500, 0.9, 60)])
def test_equals_simulation(spark, tmp_path, seed, clients, count, hot, late):
    rows = made(seed, clients, count, hot, late)
    expected = simulated(rows)
    assert found(spark, tmp_path, rows) == expected
    assert len({v[2] for v in expected.values()}) > 6
    assert any(v[3] for v in expected.values())


def test_odd_rows(spark, tmp_path):
    """Null clients, ops and values, one number for many rows, batches without rows, and a day before the first batch."""
    at = [datetime.datetime(2023, 12, 1), datetime.datetime(2024, 1, 2), datetime.datetime(2024, 4, 20)]
    rows = [(i, None if i % 3 else 5, i // 40, (None, "X", "I", "U")[i % 4], at[i % 3], None, None, "Ar" if i % 5 else None, i / 3 if i % 2 else None) for i in range(400)]
    assert found(spark, tmp_path / "odd", rows) == simulated(rows)
    assert found(spark, tmp_path / "none", []) == {}


def test_folds_beyond_one_block(spark):
    """Prefix scans over sparse and negative places give what a window over the whole key gives."""
    rng = random.Random(3)
    rows = [(k, at, rng.randrange(9)) for k in (1, 2) for at in rng.sample(range(-9000, 300000), 500)]
    sums, tops = {}, {}
    for k in (1, 2):
        total, top = None, None
        for _, at, v in sorted(r for r in rows if r[0] == k):
            sums[k, at], tops[k, at] = total, top
            total, top = (total or 0) + v, v if top is None else max(top, v)
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "k long, at long, v long").withColumn("top", F.col("v"))
    got = changes.before(df, ["k"], "at", {"v": F.sum, "top": F.max}).collect()
    assert {(r["k"], r["at"]): (r["v"], r["top"]) for r in got} == {key: (sums[key], tops[key]) for key in sums}
