"""Clustering, mixing and the filter audit against independent versions."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import filter_audit, kmeans, mixing, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# centroid clustering


def brute_clusters(rows, k=8, rounds=10):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(1024 * x) if abs(x) < 2**53 else int(x) * 1024 for x in v]
            kept.append((i, whole, hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest(), v))
    centres = [r[1] for r in sorted(kept, key=lambda r: (r[2], r[3]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [nearest(r[1])[1] for r in kept]
        for j in range(len(centres)):
            members = [r[1] for r, o in zip(kept, own, strict=True) if o == j]
            if members:
                centres[j] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    last = [nearest(r[1]) for r in kept]
    largest = 2**63 - 1
    last = [(min(d, largest), c) for d, c in last]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(r[0], c, d, min(sum(e for e, f in last if f == c), largest), min(sum(e for e, _ in last), largest), digest[c]) for r, (d, c) in zip(kept, last, strict=True)], key=repr)


def vectors(n, seed=1, spread=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(r.choice((0, 0, spread)), 1) for _ in range(64)]) for i in range(n)]


ODD_VECTORS = [(None, [0.5] * 64), (None, [0.5] * 64), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [math.nan] * 64), (905, [None] + [1.0] * 63), (906, [math.inf] + [0.0] * 63), (907, [0.0] * 64), (908, [-0.0] * 64), (907, [0.0] * 64), (907, [-1e-9] * 64)]


@pytest.mark.parametrize("rows", [vectors(300) + ODD_VECTORS, ODD_VECTORS, vectors(5), [], [(k, [1.0] * 64) for k in range(40)]])
def test_clusters_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(kmeans, "BLOCK", 16)
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, block int")
    got = kmeans.cluster_vectors(table.repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters(rows)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("size", [2.0**11, 2.0**18, 1e30, 1e300])
def test_large_components_stay_exact(spark, size):
    rows = vectors(60) + [(1000 + i, [x * size for x in v]) for i, v in vectors(8, seed=2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, kmeans.cluster_vectors(table).collect()), key=repr) == brute_clusters(rows)


def test_bounds_spare_most_of_the_work(spark):
    r = np.random.default_rng(5)
    centres = r.normal(0, 6, (8, 64))
    x = centres[r.integers(0, 8, 4000)] + r.normal(0, 1, (4000, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    stats = []
    got = kmeans.cluster_vectors(table, stats=stats)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_clusters([(i, v.tolist()) for i, v in enumerate(x)])
    assert stats[0] == (0, 4000) and stats[-1][1] < 400  # once centroids rest, few vectors see all of them


@pytest.mark.parametrize("seed", range(5))
def test_settled_bounds_hold(seed):
    r = np.random.default_rng(seed)
    x, c = r.integers(-50, 50, (200, 64)).astype(np.int32), r.integers(-50, 50, (12, 64))
    state, last = kmeans.Bounds.scanned(x, c), kmeans.Centroids(c.tolist())
    for _ in range(6):
        now = kmeans.Centroids((np.array(last.rows) + r.integers(-4, 5, (12, 64))).tolist(), last)
        state.drifted(now.drift)
        state.settle(x, now.x)
        squares = kmeans.squared(x, now.x)
        assert (state.near[:, 0] == squares.argmin(axis=1)).all()
        roots = np.sqrt(squares.astype(float))
        every = np.arange(len(x))[:, None]
        assert (state.bounds[:, 0] >= roots[every, state.near[:, :1]][:, 0]).all()
        assert (state.bounds[:, 1:-1] <= roots[every, state.near[:, 1:]]).all()
        roots[every, state.near] = np.inf
        assert (state.bounds[:, -1] <= roots.min(axis=1)).all()
        last = now


def test_rounds_read_their_buckets_without_a_shuffle(spark):
    tables = kmeans._Bucketed(4)
    rows = spark.createDataFrame(vectors(100), "_id long, _v array<double>")
    blocks = tables.write(kmeans._packed(rows, 1024).repartition(4, "block"), "blocks")
    now = kmeans.Centroids([[0] * 64, [9] * 64])
    bounds = tables.write(kmeans._settled(blocks, None, now), "bounds")
    plan = kmeans._settled(blocks, bounds, now)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    for df in (blocks, bounds):
        tables.drop(df)
    assert not spark.catalog.tableExists(blocks._name)


def test_clusters_of_the_small_tables(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, queries.op11_centroids(spark, SF).collect()), key=repr) == brute_clusters(rows)


# mixing


def brute_targets(sizes, weights=(3, 1, 2)):
    """Targets by sharing out again and again, sources in order."""
    w = [weights[k % len(weights)] for k in range(len(sizes))]
    targets, left, open_ = [0.0] * len(sizes), 1.5 * sum(sizes), set(range(len(sizes)))
    while open_:
        share = left / sum(w[k] for k in open_)
        over = [k for k in open_ if share * w[k] > 2 * sizes[k]]
        if not over:
            for k in open_:
                targets[k] = share * w[k]
            break
        for k in over:
            targets[k], left = 2.0 * sizes[k], left - 2 * sizes[k]
            open_.discard(k)
    return targets


def brute_seats(targets, seats):
    """Sainte-Laguë, seat by seat."""
    won = [0] * len(targets)
    for _ in range(seats):
        if not any(targets):
            break
        k = max(range(len(targets)), key=lambda k: (targets[k] / (2 * won[k] + 1), -k))
        won[k] += 1
    return won


def brute_mix(rows, block=16, shards=8):
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len(WORDS.findall(t or "")) for _, t, o in rows if o == s) for s in sources}
    targets = brute_targets([size[s] for s in sources])
    blocks = math.floor(sum(targets) / block + 0.5)
    ends = [dict(zip(sources, brute_seats(targets, blocks * (h + 1) // shards), strict=True)) for h in range(shards)]
    out = []
    for s, target in zip(sources, targets, strict=True):
        mine = sorted(((hashlib.md5(f"29|{'~' if i is None else i}".encode()).hexdigest(), i is not None, i, len(WORDS.findall(t or ""))) for i, t, o in rows if o == s), key=lambda r: (r[0], r[1], r[2] or 0, r[3]))
        order = [(row, k) for row in range(len(mine)) for k in range(mine[row][3])]
        cut = [min(e[s] * block, 2 * size[s]) for e in ends]
        stream = (order * 2)[: cut[-1]]
        for row, (_, _, i, n) in enumerate(mine):
            by_shard = [sum(1 for r, _ in stream[(cut[h - 1] if h else 0) : cut[h]] if r == row) for h in range(shards)]
            out.append((i, n, size[s], round(target, 6), sum(by_shard), tuple(by_shard)))
    return sorted(out, key=repr)


def mixed(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, s, 1, "y") for i, t, s in rows], "doc_id long, text string, source string, _size int, target string")
    got = mixing.mix_documents(docs.repartition(3), **options).collect()
    return sorted([(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"], tuple(sum(x["words"] for x in r["spans"] if x["shard"] == h) for h in range(8))) for r in got], key=repr)


def texts(n, sources, seed=3):
    r = random.Random(seed)
    return [(k, "w " * r.randrange(0, 60) + "\tx\n", r.choice(sources)) for k in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        texts(60, ["a", "b", None, "é", "B", ""]),
        texts(40, ["a"] * 20 + ["b", "c"]),
        texts(30, [None]),
        [(k, "one two three", f"s{k % 29}") for k in range(87)],
        [(7, "same row here", "a")] * 50 + [(8, "x " * 900, "b"), (None, "n n", "b"), (None, None, None), (9, "", "c")],
        [(1, None, "a"), (2, " \t", "b")],
        [],
    ],
)
def test_mix_equals_brute_force(spark, rows):
    got = mixed(spark, rows)
    assert got == brute_mix(rows) and all(r[4] <= 2 * r[1] for r in got)


def test_mix_is_the_same_again_and_spans_lie_in_their_documents(spark):
    rows = texts(50, ["a", "b", "c", "d"])
    assert mixed(spark, rows) == mixed(spark, rows[::-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spans = mixing.mix_documents(docs).select("doc_id", "size", F.explode("spans").alias("s")).select("doc_id", "size", "s.*").collect()
    assert all(0 <= r["first"] and r["first"] + r["words"] <= r["size"] for r in spans)
    assert sum(r["words"] for r in spans) > 0


@pytest.mark.parametrize("seed", range(4))
def test_seats_equal_seat_by_seat(spark, seed):
    r = random.Random(seed)
    targets = [r.choice((0.0, 1.0, 1.0, 3.5, 40.0, r.random() * 1000)) for _ in range(r.randrange(1, 40))]
    sizes = [0, 1, 7, 100, 333]
    sources = spark.createDataFrame(list(enumerate(targets)), "_rank long, _target double")
    houses = spark.createDataFrame([(h + 1, n) for h, n in enumerate(sizes)], "_house int, _size long")
    got = {(x["_house"], x["_rank"]): x["_seats"] for x in mixing.apportion(sources, houses).collect()}
    for h, n in enumerate(sizes):
        assert [got.get((h + 1, k), 0) for k in range(len(targets))] == brute_seats(targets, n)


# filter audit


def brute_audit(rows, labels):
    """rows: id, text, lang; labels: id, quality, toxic."""
    tested = []
    for i, t, part in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = {f for f, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t))), strict=True) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows):
            fails.add("E")
        mine = [x for x in labels if x[0] is not None and x[0] == i]
        tested.append((part or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = [], {}
    for part in {p for p, *_ in tested}:
        for order in map("".join, permutations("ABCDE")):
            left = [t for t in tested if t[0] == part]
            for step, f in enumerate(order, 1):
                gone = [t for t in left if f in t[1]]
                redundant = sum(t[0] == part and f in t[1] for t in tested) - len(gone)
                left = [t for t in left if f not in t[1]]
                unique = sum(t[0] == part and t[1] == {f} for t in tested)
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, order, step, len(left), len(gone), redundant, unique, sum(t[2] for t in gone), sum(t[3] for t in gone)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


AUDITED = [(1, "a " * 250, "en"), (2, "a " * 250, "en"), (2, "a " * 250, "en"), (None, "a " * 250, "en"), (3, None, None), (4, "", ""), (5, " ".join(f"w{k}" for k in range(300)), "en"), (6, " ".join(f"W{k}" for k in range(300)), "de"), (7, " ".join(f"w{k}" for k in range(300)) + " #", "de"), (8, "É" * 50 + " AB", "fr"), (0, "x y|z", "fr"), (9, "x y|z", "en"), (10, "w " * 30_000, "en")]
MARKS = [(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (6, 1, 1), (9, 1, None), (77, 1, 1)]


@pytest.mark.parametrize("rows, held, keys", [(AUDITED, 256, 1_000_000), (AUDITED, 1, 0), ([], 256, 0)])
def test_audit_equals_brute_force(spark, monkeypatch, rows, held, keys):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", held)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, part string, mask int")
    labels = spark.createDataFrame([(*m, "z") for m in MARKS], "doc_id long, quality int, toxic int, text string")
    got = filter_audit.filter_interactions(docs.repartition(3), labels, broadcast_keys=keys)
    assert sorted(map(tuple, got.collect())) == brute_audit(rows, MARKS)
    none = filter_audit.filter_interactions(docs, labels.limit(0))
    assert none.where("good_lost + toxic_lost > 0").count() == 0


def test_audit_of_the_small_tables(spark):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    assert sorted(map(tuple, queries.op13_filter_audit(spark, SF).collect())) == brute_audit(rows, labels)


def test_first_failures_follow_the_orders():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for k, order in enumerate(filter_audit.ORDERS):
            steps = [s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
            assert table[mask, k] == min(steps, default=5)
