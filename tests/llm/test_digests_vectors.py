"""Merkle manifests, hard negatives and near vectors against brute force, and odd tables."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablepact.llm import merkle, negatives, vectors
from tablepact.llm import queries as llm
from tablepact.llm.common import table

H = lambda *xs: hashlib.sha256("".join(xs).encode()).hexdigest()
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_of(row, lower: bool = False) -> str:
    values = [row[c] for c in COLUMNS]
    if lower and values[4] is not None:
        values[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in values[4])
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        trees[s] = levels([leaf_of(r) for r in groups[s]])
    top = levels([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(groups[s]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            seen, d = [], leaf_of(r, tampered)
            for lv, at in ((trees[s], i), (top, k)):
                for level in lv[:-1]:
                    first = at // 16 * 16
                    run = level[first : first + 16]
                    before, after = run[: at - first], run[at - first + 1 :]
                    seen += before + after
                    d, at = H(*before, d, *after), at // 16
            out.append((r["doc_id"], leaf_of(r), trees[s][-1][0], top[-1][0], H(*seen), d, d == top[-1][0]))
    return out


def manifest_of(df):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, merkle.lowered(COLUMNS, "text"))
    return [tuple(r) for r in merkle.manifest(df, claimed=tampered).collect()]


SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, idx int"


def test_merkle_against_brute_force(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 3}" if i % 2 else "hot", None if i % 5 == 0 else "é", i if i % 4 else None, None if i % 11 == 0 else f"Text ÄB {i}", "x", 1) for i in range(900)]
    rows += [(i, f"only{i}", "de", 1, "", "x", 1) for i in range(2000, 2040)] + [(5, "hot", "é", 5, "Again", "x", 1), (None, "hot", None, None, None, "x", 1), rows[3], rows[3]]
    rows += [(10_000 + i, "large", "a", 1, "T", "x", 1) for i in range(4100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got, want = manifest_of(df), brute_manifest([r.asDict() for r in df.collect()])
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17, 257])
def test_merkle_of_few_rows(spark, n):
    df = spark.createDataFrame([(i, "s", "l", 1, "T", "x", 1) for i in range(n)], SCHEMA)
    assert sorted(map(repr, manifest_of(df))) == sorted(map(repr, brute_manifest([r.asDict() for r in df.collect()])))


def brute_negatives(rows):
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i, lab, q in good:
        if i % 50:
            continue
        scored = sorted((-dot(q, v), j, other) for j, other, v in good if j != i)
        for minus, j, _ in [x for x in scored if x[2] == lab][:5]:
            fit = [x for x in scored if x[2] != lab and 50 * -minus <= 100 * -x[0] <= 95 * -minus][:3]
            out += [(i, j, r, x[1], -minus, -x[0]) for r, x in enumerate(fit, 1)]
    return sorted(out)


def vectors_of(seed: int, n: int, dims: int, copies: int = 0) -> list:
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims))
    x[:copies] = x[0] + g.normal(size=(copies, dims)) * 0.1
    x[copies : 2 * copies] = x[copies] + g.normal(size=(copies, dims)) * 0.2
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


def test_negatives_against_brute_force(spark):
    vs = vectors_of(1, 700, 12, 60)
    rows = [(i, None if i % 97 == 5 else i % 4, v) for i, v in enumerate(vs)]
    rows += [(1000, 1, None), (1050, 1, [float("nan")] * 12), (1100, 1, [None] * 12), (1150, 2, [float("inf")] + [0.0] * 11), (1200, 3, []), (1250, 3, [0.0] * 12), (1300, 2, [0.5, 0.1]), (None, 2, vs[0]), (1350, 1, [3e5] * 12), (1351, 1, [3e5] * 12), (1352, 2, [2e5] * 12)]
    df = spark.createDataFrame([(*r, 0, "b") for r in rows], "vec_id long, label int, embedding array<double>, block int, rank string")
    for block in (64, 4096):
        assert sorted(map(tuple, negatives.hard_negatives(df, block=block).collect())) == brute_negatives(rows)
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.where("vec_id in (3, 100)")).count() == 0


def test_brackets_hold():
    x = np.floor(256 * np.array(vectors_of(2, 300, 20)))
    p = negatives.Pivots(x, float((x * x).sum(1).max()))
    d, dq, squares = p.of_rows(x), p.of_anchors(x[:50]), (x[:50] ** 2).sum(1)
    low, high = p.bracket(squares, dq, d, d)
    scores = x[:50] @ x.T
    assert (low <= scores).all() and (scores <= high).all() and len(p.rows) == negatives.PIVOTS
    far = x[:1] * 2**40  # products beyond 2^53 are exact, beyond 2^63 cut
    assert negatives.products(far, x[:3])[0].tolist() == [max(min(sum(int(a) * int(b) for a, b in zip(far[0], r)), 2**63 - 1), -(2**63)) for r in x[:3]]


def brute_links(rows):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    linked = {i: set() for i in range(len(rows))}
    for a in ok:
        for b in ok:
            va, vb = (np.array(rows[x][1]) / max(map(abs, rows[x][1])) for x in (a, b))
            if a != b and len(va) == len(vb) and va @ vb / np.linalg.norm(va) / np.linalg.norm(vb) >= 0.9:
                linked[a].add(b)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = linked[todo.pop()] - seen
            seen |= new
            todo += new
        first = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(linked[i]), first, rows[i][0] == first))
    return sorted(map(repr, out))


def test_vectors_against_brute_force(spark):
    vs = vectors_of(3, 400, 24, 50)
    scale = np.array([3.0] * 6 + [0.2] * 18)  # few strong axes, so that planes pay
    vs[100:] = [(np.array(v) * scale).tolist() for v in vs[100:]]
    rows = [(i * 3 % 1201, v) for i, v in enumerate(vs)] + [(2000 + i, vs[0]) for i in range(5)] + [(3000, None), (3001, []), (3002, [0.0] * 24), (3003, [float("nan")] * 24), (3004, [None] * 24), (3005, [1.0, 2.0]), (3006, [2.0, 4.0]), (None, vs[7]), (None, None), (3007, [1e300] * 24), (3008, [1e-300] * 24)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "vec_id long, embedding array<double>, id string")
    for pack in (4096, 64):
        old, vectors.PACK = vectors.PACK, pack
        try:
            assert sorted(map(repr, map(tuple, vectors.near_vectors(df).collect()))) == brute_links(rows)
        finally:
            vectors.PACK = old
    assert vectors.near_vectors(df.limit(0)).count() == 0
    assert {tuple(r) for r in vectors.near_vectors(df.where("vec_id in (3000, 3001)")).collect()} == {(3000, 0, 3000, True), (3001, 0, 3001, True)}


def test_planes_lose_no_pair():
    x = np.array(vectors_of(5, 1500, 24, 150)) * np.array([3.0] * 6 + [0.2] * 18)  # few strong axes, so that planes pay
    frame = vectors.Frame(vectors.unit(x), 0.9)
    assert any(isinstance(tree, vectors.Plane) for tree, _ in frame.passes)
    turned, met = frame.turn(x), np.zeros((1500, 1500), int)
    for p, (tree, _) in enumerate(frame.passes):
        cells = {}
        for cell, rows, home in vectors.visited(tree, turned):
            cells.setdefault(cell, {True: [], False: []})[home] += rows.tolist()
        for both in cells.values():
            h, guests = np.array(both[True], int), np.array(both[False], int)
            for other, alone in ((h, True), (guests, False)):
                left, right = vectors.links(frame, p, turned[h], turned[other], x[h], x[other], alone)
                for a, b in zip(h[left], other[right]):
                    met[a, b] += 1
                    met[b, a] += 1
    u = vectors.unit(x)
    want = (u @ u.T >= 0.9) & ~np.eye(1500, dtype=bool)
    assert (met == want).all() and want.sum() > 1000


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_hard_negatives", "op13_vector_dedup"])
def test_queries_are_their_sql(spark, name):
    import duckdb

    d, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = llm.queries()[name](spark, d)
    cols = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({llm.oracle_sql()[name]})").fetchall()))
    assert table(spark, d, "embeddings").count() == 500
