"""Hard negatives of anchors by a pivot table: exact maximum inner product search between bounds from stored distances.

Vectors become whole numbers, floor(256 x). With M the greatest norm of a row, a row x is augmented by one component
sqrt(M^2 - |x|^2) and an anchor q by 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x, so large inner products are small distances. A few rows are
pivots, far from one another, chosen from a bounded sample. The table stores the distance of each augmented row to each pivot; an
anchor's distances are computed the same way. By the triangle inequality

    max_p |d(q, p) - d(x, p)|  <=  |q - x|  <=  min_p (d(q, p) + d(x, p))

which brackets the score q.x. Rows whose bracket can't matter are passed over, all others are checked exactly, so results are whole
whatever the pivots.

Rows are sorted by nearest pivot and distance to it and cut into blocks; of each the least and greatest distance to each pivot is
known, so a block is bracketed as a whole before its rows are. Anchors of a block are first searched in their own block: the score of
the last positive there is a bound that a row elsewhere must reach. Anchors of neighbouring blocks are one group. A group meets those
blocks that its bracket doesn't exclude, twice: for positives, then, when the scores of these are known, for negatives between
50 and 95 percent of them. A task holds one block and one group. Best rows of a block are few, and are merged by rank.

Rows with a null label, a null vector or a null or non-finite component take no part, nor do rows with a null id. Vectors of different lengths are filled up with
zeros; an empty one is a zero vector. Rows with equal ids are rows of their own, but none is another's positive or negative; as anchors each
has its own result. Other columns are ignored, whatever their names. Scores that 64 bits can't hold count
as the greatest or least that they can.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

SCALE, EVERY = 256, 50
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's must have, least and most.
LOW, HIGH = 50, 95
#: Pivots, rows of the sample that they come from, rows of a block, blocks whose anchors are one group.
PIVOTS, SAMPLE, BLOCK, GROUPED = 16, 2000, 4096, 8
#: Rows of a block that are bracketed at once.
TILE = 1024
#: Greatest sum that doubles hold exactly.
EXACT = 2**53


def whole(v: Column) -> Column:
    """floor(256 x) of each component, or null if one of them is null or not finite."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("double")))


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` components, short ones filled up with zeros."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values, sizes = flat.flatten().to_numpy(zero_copy_only=False), np.diff(flat.offsets.to_numpy())
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    most = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * max(q.shape[1], 1)
    if most < EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.array([[int(c) for c in r] for r in q], object).reshape(q.shape) @ np.array([[int(c) for c in r] for r in x], object).reshape(x.shape).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


class Pivots:
    """Pivot rows, the greatest norm squared, and what is added to a bound because doubles round."""

    def __init__(self, sample: np.ndarray, largest: float, count: int = PIVOTS):
        self.largest = largest
        chosen = [0] if len(sample) else []
        if chosen:
            far = self._to(sample, sample[:1])[:, 0]
            while len(chosen) < min(count, len(sample)) and far.max() > 0:
                chosen.append(int(far.argmax()))
                far = np.minimum(far, self._to(sample, sample[chosen[-1:]])[:, 0])
        self.rows = sample[chosen]
        self.slack = 1e-9 * largest + 1e-6

    def _last(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))

    def _to(self, x: np.ndarray, p: np.ndarray) -> np.ndarray:
        squares = (x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T + (self._last(x)[:, None] - self._last(p)[None]) ** 2
        return np.sqrt(np.maximum(squares, 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._to(x, self.rows)

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.largest - 2 * q @ self.rows.T, 0))

    def bracket(self, squares: np.ndarray, dq: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of anchors (squared norms, distances) with rows whose distances are from ``low`` to ``high``."""
        near = np.zeros((len(dq), len(low)))
        far = np.full((len(dq), len(low)), np.inf)
        for p in range(dq.shape[1]):
            d = dq[:, p, None]
            np.maximum(near, np.maximum(d - high[:, p], low[:, p] - d), out=near)
            np.minimum(far, d + high[:, p], out=far)
        half = 0.5 * (squares[:, None] + self.largest)
        return half - 0.5 * far * far - self.slack, half - 0.5 * near * near + self.slack


BLOCK_SCHEMA = "part int, block long, ids binary, labels binary, vectors binary, distances binary, low array<double>, high array<double>, anchors array<struct<at:int,bound:double>>"


def blocks(pivots: Pivots, dims: int, dtype: np.dtype, every: int, positives: int):
    """One row of each batch of sorted rows, with the bound of each of its anchors."""

    def run(table: pa.Table) -> pa.Table:
        x, ids, labels = matrix(table.column("vec"), dims), table.column("id").to_numpy(), table.column("label").to_numpy()
        d = pivots.of_rows(x)
        at = np.nonzero(ids % every == 0)[0]
        anchors = []
        for s in range(0, len(at), TILE):
            some = at[s : s + TILE]
            scores = products(x[some], x).astype(np.float64)
            scores[(labels[some][:, None] != labels[None]) | (ids[some][:, None] == ids[None])] = -np.inf
            kth = np.partition(scores, len(x) - positives, axis=1)[:, len(x) - positives] if len(x) >= positives else np.full(len(some), -np.inf)
            kth = np.where(np.isfinite(kth), kth - 1e-9 * np.abs(kth), -np.inf)
            anchors += [{"at": int(a), "bound": float(b)} for a, b in zip(some, kth)]
        row = {"part": table.column("part")[0].as_py(), "block": table.column("block")[0].as_py(), "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": x.astype(dtype).tobytes(), "distances": d.tobytes(), "low": d.min(0).tolist(), "high": d.max(0).tolist(), "anchors": anchors}
        return pa.Table.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "labels", "vectors", "distances")), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("anchors", pa.list_(pa.struct([("at", pa.int32()), ("bound", pa.float64())])))]))

    return run


class Block:
    def __init__(self, row: dict, dims: int, dtype: np.dtype):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x, self.d = np.frombuffer(row["vectors"], dtype).reshape(-1, dims).astype(np.float64), np.frombuffer(row["distances"]).reshape(len(self.ids), -1)


def anchors_of(pivots: Pivots, dims: int, dtype: np.dtype):
    """The anchors of each block with their distances to pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, at = Block(row, dims, dtype), np.array([a["at"] for a in row["anchors"]], np.int64)
                if len(at):
                    q = b.x[at]
                    cols = [pa.array([row["part"] // GROUPED] * len(at), pa.int32()), pa.array(row["block"] * 2**20 + at), pa.array(b.ids[at]), pa.array(b.labels[at]), pa.array([v.tobytes() for v in q], pa.binary())]
                    cols += [pa.array([a["bound"] for a in row["anchors"]]), pa.array((q * q).sum(1)), pa.array(pivots.of_anchors(q).tolist(), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(cols, ["grp", "key", "id", "label", "vec", "bound", "squares", "distances"])

    return run


def searched(pivots: Pivots, dims: int, dtype: np.dtype, first: int, low: int, high: int, negatives: bool):
    """Best rows of a block for the anchors of a group. Positives: (key, anchor_id, id, score). Negatives: these for each positive by its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = list(best(row))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["key", "anchor_id", "place", "id", "score"])

    def best(row: dict) -> Iterator[tuple[int, int, int, int, int]]:
        b, group = Block(row, dims, dtype), row["members"]
        ids, labels, keys = (np.array([a[k] for a in group], np.int64) for k in ("id", "label", "key"))
        q = np.frombuffer(b"".join(a["vec"] for a in group)).reshape(-1, dims)
        dq, squares = pivots.of_anchors(q), (q * q).sum(1)
        if negatives:  # the ranges of scores, as whole numbers; those that hold none are empty
            ranges = [[(i, -(-low * s // 100), high * s // 100) for i, s in enumerate(a["scores"], 1)] for a in group]
            ranges = [[r for r in rs if r[1] <= r[2]] for rs in ranges]
            least = np.array([min((r[1] for r in rs), default=math.inf) for rs in ranges], float)
            most = np.array([max((r[2] for r in rs), default=-math.inf) for rs in ranges], float)
        else:
            least, most = np.array([a["bound"] for a in group]), np.full(len(group), np.inf)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for s in range(0, len(b.ids), TILE):
            part = slice(s, s + TILE)
            bottom, top = pivots.bracket(squares, dq, b.d[part].min(0, keepdims=True), b.d[part].max(0, keepdims=True))
            some = np.nonzero((top[:, 0] >= least) & (bottom[:, 0] <= most))[0]
            if not len(some):
                continue
            bottom, top = pivots.bracket(squares[some], dq[some], b.d[part], b.d[part])
            same = labels[some][:, None] == b.labels[part][None]
            left = (top >= least[some][:, None]) & (bottom <= most[some][:, None]) & (same != negatives) & (ids[some][:, None] != b.ids[part][None])
            columns = np.nonzero(left.any(0))[0]
            rows = np.nonzero(left.any(1))[0]
            if not len(columns):
                continue
            scores = products(q[some[rows]], b.x[part][columns])
            left = left[np.ix_(rows, columns)]
            near_ids = b.ids[part][columns]
            for r, a in enumerate(some[rows]):
                for place, bottom_, top_ in ranges[a] if negatives else [(0, least[a], math.inf)]:
                    hit = np.nonzero(left[r] & (scores[r] >= bottom_) & (scores[r] <= top_))[0]
                    if len(hit) > first:
                        hit = hit[scores[r, hit] >= np.partition(scores[r, hit], len(hit) - first)[len(hit) - first]]
                    found.setdefault((a, place), []).extend(zip((-scores[r, hit]).tolist(), near_ids[hit].tolist()))
        for (a, place), pairs in found.items():
            for minus, i in sorted(pairs)[:first]:
                yield int(keys[a]), int(ids[a]), place, i, -minus

    return run


def meetings(table: DataFrame, anchors: DataFrame, least: Column, largest: float, slack: float) -> DataFrame:
    """Each block with each group of anchors that it may matter to: the greatest score that their distances to pivots allow is at
    least the least of ``least`` in the group. Ranges (``part``) and groups are bracketed first, as small tables of bounds that are
    dealt by number; blocks and groups then meet where both have the other on their list."""
    count, parts = anchors.agg(F.max("grp")).head()[0], table.agg(F.max("part")).head()[0]
    p = len(table.select("low").head()[0])
    over = lambda f, name: F.array(*(f(F.col(name)[k]) for k in range(p))) if p else F.array().cast("array<double>")
    ranges = table.groupBy("part").agg(over(F.min, "low").alias("low"), over(F.max, "high").alias("high"))
    groups = anchors.groupBy("grp").agg(over(F.min, "distances").alias("near"), over(F.max, "distances").alias("far"), F.max("squares").alias("squares"), F.min(least).alias("least"))
    asked = ranges.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(-1 if count is None else count)) if count is not None else F.array().cast("array<int>"))).join(groups, "grp")
    gap = F.aggregate(F.sequence(F.lit(0), F.lit(p - 1)), F.lit(0.0), lambda a, k: F.greatest(a, F.col("near")[k] - F.col("high")[k], F.col("low")[k] - F.col("far")[k])) if p else F.lit(0.0)
    asked = asked.withColumn("gap", gap).where((F.col("squares") + largest - F.col("gap") * F.col("gap")) / 2 + slack >= F.col("least")).select("part", "grp")
    asked = materialize(asked, "pivot-meetings")
    members = anchors.groupBy("grp").agg(F.collect_list(F.struct(*(c for c in ("key", "id", "label", "vec", "bound", "scores") if c in anchors.columns))).alias("members"))  # of at most GROUPED ranges
    body = table.select("part", "block", "ids", "labels", "vectors", "distances").join(asked.groupBy("part").agg(F.collect_list("grp").alias("grps")), "part").withColumn("grp", F.explode("grps")).drop("grps")
    sent = members.join(asked.groupBy("grp").agg(F.collect_list("part").alias("parts")), "grp").withColumn("part", F.explode("parts")).drop("parts")
    return body.hint("shuffle_hash").join(sent, ["part", "grp"])


def ranked(found: DataFrame, first: int) -> DataFrame:
    order = Window.partitionBy("key", "place").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def hard_negatives(rows: DataFrame, *, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = rows.sparkSession
    vec = F.col(vector_col)
    some = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(vec).alias("vec")).where("id is not null and label is not null and vec is not null")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    n, dims, largest = some.agg(F.count(F.lit(1)), F.max(F.size("vec")), F.max(norm)).head()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n:
        return spark.createDataFrame([], schema)
    dims = max(dims, 1)
    sample = some.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).select("vec").toArrow().column("vec")
    pivots = Pivots(matrix(sample, dims), largest)
    dtype = np.dtype(np.float32 if largest < 2**48 else np.float64)  # which holds the components exactly
    table = materialize(sorted_blocks(some, pivots, dims, n, block).groupBy("part", "block").applyInArrow(blocks(pivots, dims, dtype, every, positives), BLOCK_SCHEMA), "pivot-table")
    anchors = materialize(table.mapInArrow(anchors_of(pivots, dims, dtype), "grp int, key long, id long, label long, vec binary, bound double, squares double, distances array<double>"), "pivot-anchors")
    made = "key long, anchor_id long, place long, id long, score long"
    met = meetings(table, anchors, F.col("bound"), largest, pivots.slack)
    good = materialize(ranked(met.mapInArrow(searched(pivots, dims, dtype, positives, low, high, False), made), positives), "pivot-positives")
    scores = good.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    met = meetings(table, anchors.join(scores, "key"), F.array_min("scores") * (low / 100), largest, pivots.slack)
    bad = materialize(ranked(met.mapInArrow(searched(pivots, dims, dtype, negatives, low, high, True), made), negatives), "pivot-negatives")
    discard(anchors, table)
    chosen = good.select("key", "anchor_id", F.col("rank").cast("long").alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = chosen.join(bad.select("key", "place", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["key", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def sorted_blocks(rows: DataFrame, pivots: Pivots, dims: int, n: int, block: int) -> DataFrame:
    """Rows with the block that they are in: ranges of nearest pivot and distance to it, about ``block`` rows each."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = pivots.of_rows(matrix(batch.column("vec"), dims))
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], [*batch.schema.names, "cell", "own"])

    placed = rows.mapInArrow(near, "id long, label long, vec array<double>, cell int, own double")
    parts = max(1, -(-n // block))
    cut = placed.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, "cell", "own", "id", "tie").sortWithinPartitions("cell", "own", "id")
    at = F.monotonically_increasing_id()
    # a range may turn out larger than planned: it is cut again
    return cut.withColumn("part", F.spark_partition_id()).withColumn("block", F.floor(at / F.lit(block)).cast("long"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other))::INTEGER AS rank, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) <= 3
"""
