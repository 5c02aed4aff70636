"""Target encoding against plain Python that looks at every earlier line."""

import datetime as dt
import random
import zlib

import pytest

from concordat.llm import target_encoding as te

LINES = "sale_id long, line_no int, item_id long, vendor_id long, flag string, `a.b` string, Sale_Id_ int"
SALES = "sale_id long, client_id long, sold_at timestamp_ntz, status string"


def rate(n, s, prior):
    return prior if n < 1 else (1_000_000 * s + 50 * prior) // (n + 50)


def brute(lines, sales, items, vendors, clients, gap=0):
    first = {}
    for sid, client, at, _ in sales:
        if sid is not None and at is not None:
            first[sid] = min(first.get(sid, (at, 1 << 60)), (at, -1 if client is None else client))
    kind, nation, segment = dict(items), dict(vendors), dict(clients)
    rows = []
    for sid, _, item, vendor, flag, *_ in lines:
        if sid in first:
            at, client = first[sid]
            item, vendor = (-1 if x is None else x for x in (item, vendor))
            rows.append((sid, at, zlib.crc32(str(sid).encode()) % 5, flag == "returned", (0, kind.get(item), nation.get(vendor), segment.get(client), item, vendor, client)))
    out = {}
    for sid, at, fold, _, keys in rows:
        k = sid, keys[4], keys[5]
        if k not in out:
            own = [r for r in rows if (r[0], r[4][4], r[4][5]) == k]
            past = [r for r in rows if r[2] != fold and r[1] + dt.timedelta(microseconds=gap) < at]
            n = [sum(r[4][i] == keys[i] for r in past) for i in range(7)]
            s = [sum(r[4][i] == keys[i] and r[3] for r in past) for i in range(7)]
            base = rate(n[0], s[0], 500_000)
            mid = [rate(n[i], s[i], base) for i in (1, 2, 3)]
            ends = [(n[i], rate(n[i], s[i], mid[i - 4])) for i in (4, 5, 6)]
            out[k] = (len(own), sum(r[3] for r in own), *(x for pair in ends for x in pair))
    return out


def shop(seed, n_lines=500, n_sales=120, moments=60, hot=None):
    r = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    maybe = lambda x: None if r.random() < 0.05 else x
    sales = [(i, maybe(r.randrange(8)), maybe(start + dt.timedelta(seconds=r.randrange(moments) * 3600, microseconds=r.randrange(2))), "done") for i in range(n_sales)]
    if hot is not None:
        sales = [(i, c, start + dt.timedelta(days=1) if i % 3 else at, s) for i, c, at, s in sales]
    lines = [(maybe(r.randrange(n_sales + 5)) if hot is None or r.random() < 0.6 else 7, 1, maybe(r.randrange(12)), r.randrange(6), r.choice(["returned", "kept", None]), "x", 0) for _ in range(n_lines)]
    items = [(i, maybe(r.choice(["home", "tools"]))) for i in range(10)]
    vendors = [(i, maybe(r.randrange(2))) for i in range(5)]
    clients = [(i, maybe(r.choice(["retail", "public"]))) for i in range(7)]
    return lines + lines[:20], sales, items, vendors, clients


def frames(spark, lines, sales, items, vendors, clients):
    return [spark.createDataFrame(x, s) for x, s in ((lines, LINES), (sales, SALES), (items, "item_id long, kind string"), (vendors, "vendor_id long, nation_id int"), (clients, "client_id long, segment string"))]


def found(df):
    rows = df.collect()
    got = {(r["sale_id"], r["item_id"], r["vendor_id"]): tuple(r[c] for c in ("n_lines", "n_returned", "item_n", "item_rate", "vendor_n", "vendor_rate", "client_n", "client_rate")) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("hot", [None, True])
def test_shop(spark, hot, monkeypatch):
    monkeypatch.setattr(te, "CHUNK_ROWS", 40)
    data = shop(3, hot=hot)
    assert found(te.encode_sales(*frames(spark, *data))) == brute(*data)


def test_one_stretch_and_many(spark, monkeypatch):
    data = shop(5, 200, 60)
    want = brute(*data)
    for least in (1, 2, 500):
        monkeypatch.setattr(te, "LEAST_STRETCHES", least)
        assert found(te.encode_sales(*frames(spark, *data))) == want


def test_far_moments(spark):
    lines, sales, *rest = shop(6, 200, 60)
    sales = [(i, c, at if i % 4 else dt.datetime(9999, 1, 1) + dt.timedelta(microseconds=i), s) for i, c, at, s in sales]
    assert found(te.encode_sales(*frames(spark, lines, sales, *rest))) == brute(lines, sales, *rest)


def test_sales_of_one_id_and_rows_of_one_item(spark):
    lines, sales, items, vendors, clients = shop(9, 150, 40)
    twice = [(i, 3, dt.datetime(2025, 1, 1), "late") for i, *_ in sales[:9]]
    repeated = [x for i, k in items for x in ((i, k), (i, k))]
    assert found(te.encode_sales(*frames(spark, lines, sales + twice, repeated, vendors, clients))) == brute(lines, sales + twice, items, vendors, clients)


def test_empty(spark):
    lines, sales, *rest = shop(1, 10, 3)
    assert found(te.encode_sales(*frames(spark, [], sales, *rest))) == {}
    assert found(te.encode_sales(*frames(spark, lines, [], *rest))) == {}


@pytest.mark.parametrize("gap", [0, 1, 7_200_000_000])
def test_gap(spark, gap):
    data = shop(11, 300, 90)
    rows = te.sale_facts(*frames(spark, *data))
    e = te.Encoding({"item_id": "kind", "vendor_id": "nation_id", "client_id": "segment"}, gap=gap)
    got = te.encode(rows, e, shard_rows=20)
    assert got.columns == ["sale_id", "n", "s", "item_id", "vendor_id", "client_id", *(f"{c}_{x}" for c in ("item_id", "vendor_id", "client_id") for x in ("n", "rate"))]
    rows = {(r["sale_id"], r["item_id"], r["vendor_id"]): (r["n"], r["s"], *(r[f"{c}_{x}"] for c in ("item_id", "vendor_id", "client_id") for x in ("n", "rate"))) for r in got.collect()}
    assert rows == brute(*data, gap=gap)
