"""Operators 11 to 13 against brute force: neighbours, valid-time sales, spelling variants."""

import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from functools import reduce
from operator import add

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import queries, spelling, timers, vantage

from ..conftest import SMALL


def rows_of(frame, cols):
    return sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name,tables", [("op11_vantage_neighbours", ["embeddings"]), ("op12_valid_time_sales", ["sales", "client_changes"]), ("op13_spelling_variants", ["documents"])])
def test_query_equals_sql(spark, name, tables):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = db.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    want = sorted(want.fetchall(), key=repr)
    assert want
    assert rows_of(queries.QUERIES[name](spark, SMALL), cols) == want


# 11: vantage-point trees


def brute_neighbours(rows, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    size = max(len(v) for _, v in good)
    good = sorted((i, v + (0.0,) * (size - len(v))) for i, v in good)
    out = []
    for i, q in good:
        if i % vantage.EVERY == 0:
            near = sorted((-reduce(add, (a * b for a, b in zip(q, v))), j) for j, v in good if j != i)[:k]  # one after the other, as sum() is not
            out += [(i, r, j, -s) for r, (s, j) in enumerate(near, 1)]
    return out


def vectors(n, seed, scale=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=8) * (0.05 if i % 3 else 1)
        rows.append((i, [float(x) for x in (v * rng.uniform(0.1, 9) if scale else v / np.linalg.norm(v))]))
    return rows


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_against_brute_force(spark, monkeypatch, scale):
    for name, small in (("SHARD", 60), ("BLOCK", 7), ("LEAF", 8), ("SAMPLE", 40), ("HELD", 200)):
        monkeypatch.setattr(vantage, name, small)
    rows = vectors(400, 3, scale)
    rows += [(1000 + i, rows[40][1]) for i in range(120)]  # many copies of a vector, queries among them
    rows += [rows[20], (20, rows[21][1]), (5000, None), (5001, []), (5020, [0.0] * 8), (5040, [1.0, None] + [0.0] * 6), (5060, [float("nan")] * 8), (5080, [float("inf")] * 8), (None, [1.0] * 8), (5100, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, shard int")
    got = rows_of(vantage.nearest(df, F.col("vec_id") % vantage.EVERY == 0, 20), ["query_id", "rank", "vec_id", "score"])
    assert got == sorted(brute_neighbours(rows, 20), key=repr)


def test_factor_one_is_exact_and_larger_ones_find_most(spark):
    x = np.array([v for _, v in vectors(3000, 5)])
    tree, q = vantage.Tree(x), x[::30]
    truth = np.sort(q @ x.T, axis=1)[:, -10]
    for factor, least in ((1.0, 1.0), (2.0, 0.9)):
        a, b, s = tree.search(q, np.full(len(q), -np.inf), 10, factor)
        hits = sum(int((s[a == i] >= truth[i] - 1e-12).sum()) for i in range(len(q)))
        assert hits >= least * 10 * len(q)


def test_neighbours_of_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = rows_of(vantage.nearest(few, F.col("vec_id") % 20 == 0), ["query_id", "rank", "vec_id", "score"])
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert vantage.nearest(few.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# 12: event-time timers


def replay(sales, changes):
    """The contract, batch by batch and client by client."""
    day = lambda t: (t - datetime(1970, 1, 1)).days
    cut = lambda d: max(0, min(9, (d - 19723) * 10 // 152))
    distinct = {tuple(sorted(c.items(), key=lambda kv: kv[0])): c for c in changes if c["valid_at"] is not None}.values()
    by_sale, by_change = defaultdict(list), defaultdict(list)
    for s in sales:
        by_sale[9 if s["arrived_at"] is None else cut(day(s["arrived_at"]))].append(s)
    for c in distinct:
        by_change[cut(day(c["valid_at"]) + zlib.crc32(str(c["change_id"]).encode()) % 4)].append(c)
    out, waiting, held = [], [], defaultdict(list)
    most = {"s": None, "c": None}
    order = lambda c: (c["valid_at"], c["seq"], c["change_id"])

    def emit(s, batch):
        own = held.get(s["client_id"], []) if s["client_id"] is not None else []
        fit = [c for c in own if s["sold_at"] is not None and c["valid_at"] <= s["sold_at"]]
        best = max(fit, key=order, default=None)
        cents = None if best is None or best["balance"] is None else int(np.floor(100 * best["balance"] + 0.5))
        out.append(("sale", s["sale_id"], batch, len(own), best and best["change_id"], cents, best and best["op"]))

    for b in range(10):
        mark = {k: None if v is None else v - timedelta(hours=36) for k, v in most.items()}
        h = None if None in mark.values() else min(mark.values())
        for c in by_change[b]:
            if mark["c"] is not None and c["valid_at"] < mark["c"]:
                out.append(("late", c["change_id"], b, None, None, None, None))
            else:
                held[c["client_id"]].append(c)
        due = lambda s: s["sold_at"] is None or (h is not None and s["sold_at"] < h)
        waiting += by_sale[b]
        for s in filter(due, waiting):
            emit(s, b)
        waiting = [s for s in waiting if not due(s)]
        if h is not None:
            for client, own in held.items():
                below = [c for c in own if c["valid_at"] <= h]
                gone = sorted(below, key=order)[:-1]
                held[client] = [c for c in own if not any(c is g for g in gone)]
        for k, rows, col in (("s", by_sale[b], "sold_at"), ("c", by_change[b], "valid_at")):
            times = [r[col] for r in rows if r[col] is not None]
            most[k] = max(times + ([most[k]] if most[k] is not None else []), default=None)
    for s in waiting:
        emit(s, 10)
    return sorted(out, key=repr)


def shop(n, seed, empty_from=None):
    """Sales and changes with microseconds, ties, late and far-off times, nulls and repeated rows; some batches may be empty."""
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)

    def time():
        d = rng.choice([rng.uniform(0, 152), rng.uniform(40, 46), 60])
        if empty_from and empty_from <= d < empty_from + 40:
            d = empty_from - 1
        return start + timedelta(days=int(d), microseconds=rng.choice([0, rng.randrange(86_400_000_000), 999_999]))

    sales, changes = [], []
    for i in range(n):
        at = time()
        sales.append({"sale_id": i, "client_id": rng.choice([None, 7, 7, 7, rng.randrange(12)]), "sold_at": rng.choice([at] * 9 + [None]), "arrived_at": at + timedelta(days=rng.choice([0, 0, 1, 30]))})
        valid = time()
        changes.append({"change_id": i, "client_id": rng.choice([7, 7, rng.randrange(12)]), "seq": rng.randrange(3), "op": rng.choice(["I", "U", None]), "valid_at": rng.choice([valid] * 9 + [None]), "balance": rng.choice([None, rng.uniform(-99, 99)])})
    sales.append({"sale_id": 9001, "client_id": 7, "sold_at": datetime(1960, 1, 1), "arrived_at": start})
    sales.append({"sale_id": 9002, "client_id": 7, "sold_at": datetime(9999, 1, 1), "arrived_at": None})
    return sales + sales[:5], changes + changes[:9]


SALES = "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, slot int, event string"
CHANGES = "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double"
TIMED = ["rec", "id", "batch", "n_held", "change_id", "balance_cents", "op"]


@pytest.mark.parametrize("seed,hot,empty_from", [(1, 50_000, None), (2, 20, 50)])
def test_sales_against_a_replay(spark, monkeypatch, seed, hot, empty_from):
    monkeypatch.setattr(timers, "HOT_ROWS", hot)
    monkeypatch.setattr(timers, "KEY_ROWS", min(hot, 40))
    sales, changes = shop(250, seed, empty_from)
    s = spark.createDataFrame([(*(r[c] for c in ("sale_id", "client_id", "sold_at", "arrived_at")), 1, "x") for r in sales], SALES)
    c = spark.createDataFrame([tuple(r[k] for k in ("change_id", "client_id", "seq", "op", "valid_at", "balance")) for r in changes], CHANGES)
    want = replay(sales, changes)
    assert {r[2] for r in want} >= {1, 9, 10} and any(r[0] == "late" for r in want)
    assert rows_of(timers.enriched(s, c), TIMED) == want


def test_sales_of_empty_tables(spark):
    s, c = spark.createDataFrame([], SALES), spark.createDataFrame([], CHANGES)
    assert timers.enriched(s, c).collect() == []


# 13: spelling variants


def brute_variants(docs):
    import re

    counts = Counter()
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w in n:
        about = [o for o in n if o != w and near(w, o)]
        best = min(about, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out.append([w, form[w], w, n[w], len(about), n[best] if form[w] else None])
    for r in out:
        while form[r[2]]:
            r[2] = form[r[2]]
    return sorted(map(tuple, out), key=repr)


VARIANT = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_against_all_pairs(spark):
    rng = random.Random(4)
    bases = ["aaabbb", "aaabbbb", "aaaabbb", "aabbbb", "abcdefg", "abcdefgh", "ßtraßen", "straßen", "ÀÀéééé", "Banana", "bananas"]
    docs = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(bases)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k, c = rng.randrange(len(w) + 1), rng.choice("ab×÷")
                w = rng.choice([w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :]])
            words.append(w if rng.random() < 0.7 else w.upper())
        docs.append((i, rng.choice([" ", "-", " 1 "]).join(words)))
    docs += [(1000 + i, "chainaa " * 22 + "chainab " * 3 + "chainbb " * (i < 5)) for i in range(10)]
    docs += [(None, "Banana " * 7), (None, None), (-3, ""), (5, None), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    want = brute_variants(docs)
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain of forms
    assert rows_of(spelling.variants(df), VARIANT) == want


def test_long_runs_are_words(spark):
    long = "abcdefghij" * 20_000
    docs = [(i, long) for i in range(50)] + [(100 + i, long[:5000] + "x" + long[5000:]) for i in range(6)] + [(200 + i, long[:7] + "Z" + long[8:]) for i in range(7)]
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)).collect()
    by = {r.word: r for r in got}
    n = by[long].n
    assert by[long[:5000] + "x" + long[5000:]].form == long and by[long[:7] + "z" + long[8:]].form == long
    assert n >= 45 and by[long].n_near == 2
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
