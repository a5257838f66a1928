"""Near-duplicate vectors by a subspace pigeonhole join, and their components.

Two unit vectors with a cosine of at least t lie at a squared distance of at most 2 - 2 t, in any rotated frame too. If the frame
is cut into blocks of few dimensions and each block gets a share of that budget, a pair within the whole distance is within the
budget of one block at least. The frame is that of the principal axes of a bounded sample, and a block's share follows its
variance, so that blocks are about equally selective; any rotation and any shares give whole results.

Each block has a range join of its own. Its space is cut by planes, learned from the sample as long as few of its vectors lie near
enough to a plane to matter (``grow``). A vector is at home in one cell, and a guest in cells on the lower side of planes that
it is near to: a pair within a block's budget so meets in one cell of the block, and nowhere else, as one of the two is at home
there and the other at home or a guest. Blocks that aren't worth a plane share one cell, in which each of them is tested.
Cells are dealt as packs of at most ``PACK`` vectors and joined as pairs of packs, so a hot cell is spread over many tasks. A pair of
packs is tested block by block, what passes is a candidate, and the cosine of each candidate is computed in double precision from
the vectors as they came. A link that the blocks of several cells find counts in the first of these alone.

Rows with equal vectors are one class, represented by the smallest id, so copies cost one vector. Pairs of packs give out how often
each class is linked, and those links that join components, fewer than they have classes: the result is linear in the input.
A large group of vectors that are near but not equal still costs the square of its size in bounded pairs of packs.

Vectors that are null, empty, zero or hold null or non-finite components have no links. Vectors of different lengths aren't linked:
each length is joined for itself. Repeated rows are rows like others and linked with one another. Rows with a null id come back, are
counted as links, and are nobody's component but their own equals'. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize
from .similarity import components

#: Links have this cosine at least.
LEAST = 0.9
#: Blocks of a vector; vectors of a pack; rows of the sample that axes and planes are learned from.
BLOCKS, PACK, SAMPLE = 8, 4096, 20_000
#: Planes are used where at most this share of a cell's vectors is near, and for cells of so many sampled vectors at least.
NEAR, FEW, DEEPEST = 0.2, 64, 10
#: Rows of a tile of the comparison, and what single precision may be off by in a squared distance of unit vectors.
TILE, SLACK = 1024, 1e-4


def usable(v: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


@dataclass(frozen=True)
class Plane:
    """Below ``at`` on ``axis`` is the lower side; vectors up to ``reach`` above it are guests there."""

    axis: int
    at: float
    reach: float
    below: Plane | int
    above: Plane | int


def grow(sample: np.ndarray, axes: np.ndarray, reach: float, cells: list[int], depth: int = 0) -> Plane | int:
    """A tree of planes over ``sample``; leaves are numbers of cells. The plane with the fewest vectors near it is taken."""
    best = None
    if len(sample) >= FEW and depth < DEEPEST:
        for axis in axes:
            for share in (0.35, 0.5, 0.65):
                at = float(np.quantile(sample[:, axis], share))
                lower = sample[:, axis] < at
                near = (~lower & (sample[:, axis] < at + reach)).mean()
                if 0.2 < lower.mean() < 0.8 and near <= NEAR and (best is None or near < best[0]):
                    best = near, int(axis), at, lower
    if best is None:
        cells.append(len(cells))
        return cells[-1]
    _, axis, at, lower = best
    below = grow(sample[lower], axes, reach, cells, depth + 1)
    return Plane(axis, at, reach, below, grow(sample[~lower], axes, reach, cells, depth + 1))


def visited(tree: Plane | int, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(cell, rows, whether they are at home there) for the rows of ``x``."""
    todo = [(tree, np.arange(len(x)), True)]
    while todo:
        node, rows, home = todo.pop()
        if not len(rows):
            continue
        if not isinstance(node, Plane):
            yield node, rows, home
            continue
        v = x[rows, node.axis]
        lower = v < node.at
        todo += [(node.below, rows[lower], home), (node.above, rows[~lower], home)]
        todo.append((node.below, rows[~lower & (v <= node.at + node.reach)], False))
        if not home:  # a guest near a plane may have its partner on either side
            todo.append((node.above, rows[lower & (v >= node.at - node.reach)], False))


class Frame:
    """Axes, blocks with their budgets, and the passes of the join: blocks without planes share the first one."""

    def __init__(self, sample: np.ndarray, least: float, blocks: int = BLOCKS):
        dims = sample.shape[1]
        values, axes = np.linalg.eigh(np.cov(sample, rowvar=False).reshape(dims, dims) if len(sample) > 1 else np.eye(dims))
        order = np.argsort(-values, kind="stable")
        self.axes, spread = np.ascontiguousarray(axes[:, order]), np.maximum(values[order], 1e-6)
        self.blocks = [b for b in np.array_split(np.arange(dims), min(blocks, dims)) if len(b)]
        share = np.array([spread[b].sum() for b in self.blocks])
        self.budgets = (2 - 2 * least) * share / share.sum()
        self.least = least
        turned, plain, passes = sample @ self.axes, [], []
        for i, b in enumerate(self.blocks):
            cells: list[int] = []
            tree = grow(turned, b, float(np.sqrt(self.budgets[i] + SLACK)), cells)
            passes += [(tree, [i])] if isinstance(tree, Plane) else []
            plain += [] if isinstance(tree, Plane) else [i]
        self.passes: list[tuple[Plane | int, list[int]]] = [*([(0, plain)] if plain else []), *passes]

    def turn(self, v: np.ndarray) -> np.ndarray:
        """Unit vectors in the frame, in single precision."""
        v = v.astype(np.float64)
        v /= np.abs(v).max(axis=1, keepdims=True)
        return np.ascontiguousarray((v / np.linalg.norm(v, axis=1, keepdims=True)) @ self.axes, np.float32)

    def near(self, a: np.ndarray, b: np.ndarray, i: int) -> np.ndarray:
        """Whether rows of ``a`` and ``b``, pair by pair, are within the budget of block i. Always the same for a pair."""
        d = a[:, self.blocks[i]].astype(np.float64) - b[:, self.blocks[i]]
        return reduce(np.add, (d[:, k] * d[:, k] for k in range(d.shape[1]))) <= self.budgets[i] + SLACK / 2


def links(frame: Frame, p: int, x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, alone: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``x`` and ``y`` of the pairs that pass p links. ``alone``: they are one pack, so each pair is seen once."""
    own, before = frame.passes[p][1], [i for _, blocks in frame.passes[:p] for i in blocks]
    unit_x, unit_y = unit(raw_x), unit(raw_y)
    left, right = [], []
    for i in range(0, len(x), TILE):
        for j in range(i if alone else 0, len(y), TILE):
            a, b = x[i : i + TILE], y[j : j + TILE]
            hit = np.zeros((len(a), len(b)), bool)
            for k in own:
                dims = frame.blocks[k]
                # half the squared distance, negative, as one product
                u = np.concatenate([a[:, dims], -0.5 * (a[:, dims] ** 2).sum(1, keepdims=True), np.ones((len(a), 1), np.float32)], 1)
                w = np.concatenate([b[:, dims], np.ones((len(b), 1), np.float32), -0.5 * (b[:, dims] ** 2).sum(1, keepdims=True)], 1)
                hit |= u @ w.T >= -0.5 * (frame.budgets[k] + SLACK)
            if alone and i == j:
                hit = np.triu(hit, 1)
            r, c = np.nonzero(hit)
            if len(r) > 0.1 * hit.size:
                cosine = (unit_x[i : i + TILE] @ unit_y[j : j + TILE].T)[r, c]
            else:
                cosine = np.concatenate([np.einsum("ij,ij->i", unit_x[i + r[s : s + 65536]], unit_y[j + c[s : s + 65536]]) for s in range(0, len(r), 65536)] or [np.zeros(0)])
            sure = cosine >= frame.least
            r, c = r[sure], c[sure]
            if len(frame.passes) > 1 and len(r):  # by the rule that is the same in all passes, not by the product above
                new = reduce(np.logical_or, (frame.near(a[r], b[c], k) for k in own))
                for k in before:
                    new &= ~frame.near(a[r], b[c], k)
                r, c = r[new], c[new]
            left.append(i + r)
            right.append(j + c)
    return np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])


def unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of the largest and the least doubles would leave the range
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least place that each of n places is joined to."""
    label = np.arange(n)
    while len(left):
        least = np.minimum(label[left], label[right])
        was = label.copy()
        np.minimum.at(label, was[left], least)
        np.minimum.at(label, was[right], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[left] != label[right]
        left, right = left[apart], right[apart]
    return label


def matrix(rows: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def visits(frame: Frame):
    """Rows of (id, weight, vec) with each cell that they are at home or a guest in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = frame.turn(matrix(batch.column("vec")))
            for p, (tree, _) in enumerate(frame.passes):
                for cell, rows, home in visited(tree, x):
                    some = batch.take(pa.array(rows))
                    n = len(rows)
                    cols = [pa.array(np.full(n, p, np.int32)), pa.array(np.full(n, cell, np.int32)), pa.array(np.full(n, not home)), *(some.column(c) for c in ("id", "weight", "vec"))]
                    yield pa.RecordBatch.from_arrays(cols, ["pass", "cell", "guest", "id", "weight", "vec"])

    return run


def pack(dtype: np.dtype):
    """One row of a bucket's vectors."""

    def run(rows: pa.Table) -> pa.Table:
        key = {c: rows.column(c).slice(0, 1) for c in ("pass", "cell", "guest", "bucket", "homes", "guests")}
        body = (rows.column("id").to_numpy(), rows.column("weight").to_numpy(), matrix(rows.column("vec")).astype(dtype))
        return pa.table(key | {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("ids", "weights", "vectors"), body)})

    return run


PAIR = "struct<guests:boolean,i:int,j:int>"


def pairs_of(packs: DataFrame) -> DataFrame:
    """Each pack once for every pair of packs of its cell that it is in: any two at home, each with itself, each at home with each
    of guests."""
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda guests, i, j: F.struct(F.lit(guests).alias("guests"), i.alias("i"), j.alias("j")).cast(PAIR)
    b = F.col("bucket")
    home = F.concat(F.transform(upto(F.col("homes")), lambda k: pair(False, F.least(b, k), F.greatest(b, k))), F.transform(upto(F.col("guests")), lambda k: pair(True, b, k)))
    visiting = F.transform(upto(F.col("homes")), lambda k: pair(True, k, b))
    return packs.select("pass", "cell", "guest", "bucket", "ids", "weights", "vectors", F.explode(F.when(F.col("guest"), visiting).otherwise(home)).alias("pair")).select("*", "pair.guests", "pair.i", "pair.j").drop("pair")


def compared(frame: Frame, dtype: np.dtype, dims: int):
    """Of one or two packs: how many rows each class is linked to, and the links that join its components."""

    def run(rows: pa.Table) -> pa.Table:
        sides = sorted(rows.to_pylist(), key=lambda r: (r["guest"], r["bucket"]))
        a, b = ((np.frombuffer(s["ids"], np.int64), np.frombuffer(s["weights"], np.int64), np.frombuffer(s["vectors"], dtype).reshape(-1, dims)) for s in (sides[0], sides[-1]))
        alone, n = len(sides) == 1, len(a[0])
        if alone and sides[0]["guests"]:  # a bucket without rows has no pack
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "n", "b")})
        if not alone or sides[0]["i"] == sides[0]["j"]:
            left, right = links(frame, sides[0]["pass"], frame.turn(a[2]), frame.turn(b[2]), a[2], b[2], alone)
        else:
            left = right = np.zeros(0, np.int64)
        ids, weights = (a[0], a[1]) if alone else (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
        far = right if alone else right + n
        counts = np.bincount(left, weights[far], len(ids)) + np.bincount(far, weights[left], len(ids))
        label, hit = forest(len(ids), left, far), np.nonzero(counts)[0]
        return pa.table({"id": ids[hit], "n": counts[hit].astype(np.int64), "b": ids[label[hit]]})

    return run


def joined(classes: DataFrame, dims: int, least: float, sample: int) -> DataFrame:
    """(id, n, b) of the classes of one length."""
    kind = classes.schema["vec"].dataType.elementType
    dtype = np.dtype(np.float32 if isinstance(kind, T.FloatType) else np.float64)
    some = classes.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column("vec")
    frame = Frame(unit(matrix(some)), least)
    at = materialize(classes.select("id", "weight", "vec").mapInArrow(visits(frame), f"pass int, cell int, guest boolean, id long, weight long, vec {classes.schema['vec'].dataType.simpleString()}"), "vector-visits")
    buckets = lambda guest: F.ceil(F.count_if(F.col("guest") == F.lit(guest)) / PACK).cast("int")
    sizes = at.groupBy("pass", "cell").agg(buckets(False).alias("homes"), buckets(True).alias("guests"))
    placed = at.join(F.broadcast(sizes), ["pass", "cell"])  # at most BLOCKS * 2 ** DEEPEST cells
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int"))
    body = "ids binary, weights binary, vectors binary"
    packs = placed.groupBy("pass", "cell", "guest", "bucket").applyInArrow(pack(dtype), f"pass int, cell int, guest boolean, bucket int, homes int, guests int, {body}")
    out = materialize(pairs_of(packs).groupBy("pass", "cell", "guests", "i", "j").applyInArrow(compared(frame, dtype, dims), "id long, n long, b long"), "vector-links")
    discard(at)
    return out


def near_vectors(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    if not 0.5 <= least < 1:
        raise ValueError("least must be from 0.5 to below 1")
    kind = rows.schema[vector_col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        raise ValueError(f"{vector_col} must be an array of float or double")
    vector = F.col(vector_col)
    mine = rows.select(F.col(id_col).cast("long").alias("id"), F.when(usable(vector), vector).alias("vec"))
    keyed = mine.withColumn("key", F.sha2(F.col("vec").cast("string"), 256))
    equal = keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("vec").alias("vec"))
    classes = materialize(equal.withColumn("id", F.monotonically_increasing_id()), "vector-classes")
    lengths = [r[0] for r in classes.select(F.size("vec")).distinct().collect()]
    found = [joined(classes.where(F.size("vec") == d), d, least, sample) for d in sorted(lengths)]
    if found:
        links_ = reduce(DataFrame.unionAll, found)
        labels = components(links_.where("id <> b").select(F.col("id").alias("a"), "b"))
        counts = links_.groupBy("id").agg(F.sum("n").alias("n"))
        known = classes.select("key", "id", "weight", "least").join(counts, "id", "left").join(labels, "id", "left")
        firsts = known.where("component is not null").groupBy("component").agg(F.min("least").alias("first"))
        known = known.join(firsts, "component", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
        known = materialize(known, "vector-classes")
        discard(classes, labels, *found)
    else:
        known = classes.select("key", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    # rows without a direction stay out of the join; those of one large class share a key, which adaptive skew handling splits
    linked = keyed.where("key is not null").select("id", "key").join(known, "key").select("id", "n_links", "component_id")
    single = mine.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionAll(single).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.c, e.vec_id)) AS component_id, least(e.vec_id, coalesce(c.c, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id
"""
