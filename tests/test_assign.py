"""Clients and their sales without a shuffle of the pairs: rows, weights, draws and counts against brute force, and rows that are sent."""

import datetime as dt
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from realty_spark.operators import assign
from realty_spark.plans import pipeline

DAY = dt.date(2003, 1, 1)
as_of = lambda: F.to_date(F.lit(str(DAY)))
TYPES = ["house", "land", "other"]
SALE = "address_id long, city_id int, property_type string, sale_date date, price int"
CLIENT = "client_id long, addresses_per_report int, chosen_cities array<int>, property_type_preferences array<string>, status string, send_day int"


def tables(spark, n_sales=900, n_clients=120, wanted=3, seed=5):
    """Few wishes that many share, and odd ones: cities and types named twice, no types, a null among them, no cities, no number, no id."""
    r = random.Random(seed)
    sales = [(i, r.choice([0, 1, 2, None]), r.choice([*TYPES, None]), dt.date(1995, 1, 1) + dt.timedelta(r.randrange(-90, 820)), i) for i in range(n_sales)]
    lists = [([0, 1], TYPES[:2]), ([1, 1, 2], ["other", "other"]), ([2], None), ([0], []), ([1], ["house", None]), ([], TYPES), ([0, None], ["land"])]
    clients = [(c, wanted, *lists[c % len(lists)], "active", 1) for c in range(n_clients)] + [(n_clients, None, *lists[0], "active", 1), (n_clients + 1, 0, *lists[0], "active", 1), (None, 2, *lists[0], "active", 1)]
    assigned = [(r.randrange(n_clients), r.randrange(n_sales)) for _ in range(n_clients * 20)]
    assigned += assigned[:50] + [(0, i) for i in range(n_sales) if i % 9] + [(None, 3), (4, None)] + [(7, i) for i in range(n_sales)]
    made = [spark.createDataFrame(rows, kind) for rows, kind in ((sales, SALE), (clients, CLIENT), (assigned, "client_id long, address_id long"))]
    return sales, clients, set(assigned), made


def pairs(sales, clients, assigned):
    out = {}
    for c, wanted, cities, types, *_ in clients:
        any_type = not types or None in types
        own = [s for s in sales if s[1] is not None and s[1] in cities and (any_type or s[2] in types) and 2190 <= (DAY - s[3]).days <= 2920 and (c is None or (c, s[0]) not in assigned)]
        own.sort(key=lambda s: (s[3], s[0]))
        out[c] = (wanted, [(s, len(own) - k) for k, s in enumerate(own)])
    return out


def draws(want, seed):
    out = set()
    for c, (wanted, own) in want.items():
        u = lambda s: (int(hashlib.md5("|".join(str(x) for x in (seed, c, s[0]) if x is not None).encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        ranked = sorted(own, key=lambda x: (-math.log(u(x[0])) / x[1], x[0][0]))
        out |= {(c, s[0], w, k) for k, (s, w) in enumerate(ranked[: wanted or 0], 1)}
    return out


@pytest.fixture
def plain(spark):
    """Plans whose joins are all shuffled and whose exchanges can be looked at."""
    kept = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in kept}
    for k, v in kept.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def sent(df):
    """(rows, the most rows that one exchange wrote)."""
    rows, most, todo = df.collect(), 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
    return rows, most


@pytest.mark.parametrize("bits, share", [(12, 4096), (3, 4)])
def test_eligible_pairs(spark, monkeypatch, bits, share):
    monkeypatch.setattr(assign, "BLOCK_BITS", bits)
    monkeypatch.setattr(assign, "SHARE", share)
    sales, clients, assigned, made = tables(spark)
    got = [(r.client_id, r.address_id) for r in assign.eligible(*made, as_of()).collect()]
    want = {(c, s[0]) for c, (_, own) in pairs(sales, clients, assigned).items() for s, _ in own}
    assert len(got) == len(set(got)) and set(got) == want
    assert assign.eligible(made[0].limit(0), *made[1:], as_of()).isEmpty() and assign.eligible(*made[:2], made[2].limit(0), as_of()).count() > len(want)


def test_eligible_sends_no_pairs(plain):
    """Before, every pair was sent to be held against what was assigned."""
    rows, most = sent(assign.eligible(*tables(plain)[3], as_of()))
    assert 0 < most < len(rows) / 2


@pytest.mark.parametrize("bits, share", [(12, 4096), (3, 4)])
def test_weights(spark, monkeypatch, bits, share):
    monkeypatch.setattr(assign, "BLOCK_BITS", bits)
    monkeypatch.setattr(assign, "SHARE", share)
    sales, clients, assigned, made = tables(spark)
    got = [(r.client_id, r.address_id, r.weight) for r in assign.weighted(*made, as_of()).collect()]
    want = {(c, s[0], w) for c, (_, own) in pairs(sales, clients, assigned).items() for s, w in own}
    assert len(got) == len(set(got)) and set(got) == want


def test_weights_send_no_pairs(plain):
    """Places are those of wishes that clients share; before, each pair was placed and sent for itself."""
    rows, most = sent(assign.weighted(*tables(plain, n_clients=400)[3], as_of()))
    assert 0 < most < len(rows) / 2


@pytest.mark.parametrize("wanted, bits", [(3, 12), (3, 3), (40, 12), (5000, 12)])
def test_draws(spark, monkeypatch, wanted, bits):
    """Draws with bounds that few rows reach, and with all rows where most are wanted."""
    monkeypatch.setattr(assign, "BLOCK_BITS", bits)
    sales, clients, assigned, made = tables(spark, 4000, 30, wanted)
    df = assign.assign(*made, as_of(), 11, columns=["price"])
    got = [(r.client_id, r.address_id, r.weight, r.rn) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == draws(pairs(sales, clients, assigned), 11)
    assert "price" in df.columns and "city_id" not in df.columns and df.filter("price <> address_id OR status <> 'new'").isEmpty()


def test_draws_look_at_few_rows(spark):
    """Of many rows those that can win are sent on: a few more than are wanted."""
    sales, clients, assigned, made = tables(spark, 4000, 30)
    members, placed, sizes = assign._placed(made[0], made[1].filter("addresses_per_report > 0"), as_of(), whole=True)
    spans = assign._bounded(assign._spans(members, placed, sizes, made[2]), 11)
    left = {r.client_id: r["count"] for r in assign._likely(spans, placed).groupBy("client_id").count().collect()}
    for c, (wanted, own) in pairs(sales, clients, assigned).items():
        if wanted and own:
            assert min(wanted, len(own)) <= left[c] <= (90 if len(own) > 200 else len(own))


def test_draws_below_the_bounds(spark):
    """Sales without an id have one u a client, so that most clients have no row above the bounds: they are drawn again out of all rows."""
    day = lambda i: dt.date(1995, 1, 10) + dt.timedelta(i)
    sales = spark.createDataFrame([(None, 1, "land", day(i), i) for i in range(600)], SALE)
    clients = spark.createDataFrame([(c, 3, [1], ["land"], "active", 1) for c in range(8)], CLIENT)
    assigned = spark.createDataFrame([], "client_id long, address_id long")
    got = sorted((r.client_id, r.rn, r.price) for r in assign.assign(sales, clients, assigned, as_of(), 11).collect())
    assert got == [(c, k, k - 1) for c in range(8) for k in (1, 2, 3)]


@pytest.mark.parametrize("wanted", [3, 70, 5000])
def test_counts(spark, wanted):
    sales, clients, assigned, made = tables(spark, 1500, 40, wanted)
    got = {r.client_id: r.n_assigned for r in assign.assigned_counts(*made, as_of()).collect()}
    assert got == {c: min(n, len(own)) for c, (n, own) in pairs(sales, clients, assigned).items() if n and own}


def test_counts_make_no_pairs(plain):
    """What is sent does not grow with clients times sales."""
    sales, clients, assigned, made = tables(plain, 900, 400, 5000)
    rows, most = sent(assign.assigned_counts(*made, as_of()))
    assert 0 < most < sum(r.n_assigned for r in rows) / 4


def test_daily_alerts_are_counted(spark):
    """Alerts and assignments of the day agree, and alerts are told without a draw."""
    sales, clients, assigned, made = tables(spark, 900, 60, 70)
    jobs = spark.createDataFrame([], "job_id long, status string, next_attempt timestamp, outcome boolean, error_message string, attempt_count int")
    picked, alerts, _ = pipeline.daily_run(*made, jobs, as_of(), 11)
    got = {(r.client_id, r.wanted, r.n_assigned) for r in alerts.collect() if r.client_id is not None}
    assert got == {(r.client_id, r.wanted, r.n_assigned) for r in assign.insufficient(made[1], picked).collect() if r.client_id is not None} and got
    only = {(r.client_id, r.wanted, r.n_assigned) for r in pipeline.daily_alerts(*made, as_of()).collect() if r.client_id is not None}
    assert only == got
