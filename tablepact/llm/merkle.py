"""A Merkle manifest of a table: one tree for each group, one over the groups, and a proof for every row.

A row's digest is a leaf. Leaves of a group are numbered by ``ordered``, from sorted ranges of rows and the sizes of the ranges
before them, so a group of any size is spread over many tasks. Nodes are made from events, each a node that has been completed:
a parent waits as a partial of indexed child digests until it has as many as the size of the group says, then it is an event
for its own parent, in the same task and without a further pass (``cascade``). What a range of leaves can't complete, the few
nodes at its two ends on each level, is the frontier. Frontiers are shuffled to the ancestor ``SPAN`` levels up and combined there, as
often as the largest group has levels for; each round holds at most 16 ** SPAN events of an ancestor together.

Completed nodes keep the link to their parent. Read the other way round, from the root down, these links give each node at level
``SPAN`` its path: on every level the run of siblings and its own place among them. Leaves meet the path of their ancestor of that level,
below which a task makes the nodes from the leaves that it has, and fold their proofs.

Null values count as ``-`` in a digest. Rows with equal ids come in the order of their digests; rows that are equal in all are leaves each.
Null ids come first. Nulls of the group are a group of their own, the first one. Without rows there is no root and no result. A
group of one leaf has that leaf as its root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

#: Children of a parent, as a power of two.
ARITY_BITS = 4
ARITY = 1 << ARITY_BITS
#: Levels that a round completes below one ancestor.
SPAN = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVENT = "tree string, n long, level int, idx long, digest string"
NODE = EVENT + ", open boolean"


def digest_of(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of the values one after another: each its length in bytes, a colon and itself, or ``-`` for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def width(n: int, level: int) -> int:
    """Nodes at a level of a tree of n leaves."""
    return (n + (1 << ARITY_BITS * level) - 1) >> ARITY_BITS * level


def height(n: int) -> int:
    """Levels above the leaves."""
    level = 0
    while width(n, level) > 1:
        level += 1
    return level


def ordered(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``rows`` with ``tree``, ``n`` and ``idx``: the number of rows of a tree and each row's place in the order of ``by``. Ranges
    of rows are numbered on their own; sizes of the ranges before, one row for each tree and range, give the offsets."""
    tied = rows.withColumn("tie", F.monotonically_increasing_id())  # so that equal rows fall into several ranges
    cut = tied.repartitionByRange("tree", *by, "tie").sortWithinPartitions("tree", *by).drop("tie").withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    cut = materialize(cut, "merkle-sorted")
    sizes = cut.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("size"), F.min("at").alias("first"))
    tree = Window.partitionBy("tree")
    before = F.sum("size").over(tree.orderBy("part")) - F.col("size")
    sizes = sizes.select(F.col("tree").alias("t"), F.col("part").alias("p"), "first", before.alias("before"), F.sum("size").over(tree).alias("n"))
    joined = cut.join(sizes, (F.col("part") == F.col("p")) & F.col("tree").eqNullSafe(F.col("t")))
    out = materialize(joined.select("tree", "n", (F.col("at") - F.col("first") + F.col("before")).alias("idx"), *(c for c in rows.columns if c != "tree")).sortWithinPartitions("tree", "idx"), "merkle-leaves")
    discard(cut)
    return out


class Partials:
    """Parents that wait for children: a digest completes them or adds to them."""

    def __init__(self) -> None:
        self.waiting: dict[tuple, dict[int, str]] = {}

    def take(self, tree: str | None, n: int, level: int, idx: int, digest: str) -> Iterator[tuple]:
        """An event; gives the nodes that it completes, each an event for the next level."""
        while width(n, level) > 1:
            up = idx >> ARITY_BITS
            children = self.waiting.setdefault((tree, n, level, up), {})
            children[idx & (ARITY - 1)] = digest
            if len(children) < min(ARITY, width(n, level) - (up << ARITY_BITS)):
                return
            del self.waiting[tree, n, level, up]
            digest = digest_of(children[i] for i in range(len(children)))
            level, idx = level + 1, up
            yield tree, n, level, idx, digest, False

    def left(self) -> Iterator[tuple]:
        for (tree, n, level, up), children in self.waiting.items():
            for i, digest in children.items():
                yield tree, n, level, up << ARITY_BITS | i, digest, True


NODES = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("open", pa.bool_())])


def node_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), NODES)], schema=NODES)


def cascade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that the events of a task complete, then its frontier. Events that come in order leave few parents waiting."""
    partials, out = Partials(), []
    for batch in batches:
        for event in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "level", "idx", "digest"))):
            out += partials.take(*event)
            if len(out) >= 8192:
                yield node_batch(out)
                out = []
    out += partials.left()
    for at in range(0, len(out), 8192):
        yield node_batch(out[at : at + 8192])


def combine(leaves: DataFrame, largest: int) -> DataFrame:
    """All nodes above the leaves: (tree, n, level, idx, digest)."""
    events = leaves.select("tree", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))
    done, open_ = [], events
    rounds = max(1, -(-height(largest) // SPAN))
    for r in range(rounds + 1):
        if r:  # the frontier below an ancestor at level r * SPAN meets
            ancestor = F.expr(f"shiftright(idx, {ARITY_BITS} * greatest({SPAN * r} - level, 0))")
            open_ = open_.repartition("tree", F.greatest(F.col("level"), F.lit(SPAN * r)), ancestor).sortWithinPartitions("tree", "level", "idx")
        made = materialize(open_.mapInArrow(cascade, NODE), "merkle-nodes")
        done.append(made)
        open_ = made.where("open").drop("open")
    nodes = materialize(reduce(DataFrame.unionAll, [d.where("not open").drop("open") for d in done]), "merkle-all")
    discard(*done)
    return nodes


def paths(nodes: DataFrame, level: int, largest: int, above: DataFrame) -> DataFrame:
    """(tree, idx, places, runs) of every node at ``level``: on each level up to the root its place among its siblings and the
    digests of the whole run, then what ``above`` (tree, places, runs) says of the tree itself. From the root down along the links."""
    top = height(largest)
    found = above
    made = nodes.where(F.col("level") >= level)
    is_root = F.col("n") <= F.expr(f"shiftleft(1L, {ARITY_BITS} * level)")
    out = made.where(is_root).join(found.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).select("tree", "level", "idx", "places", "runs")
    for k in range(top - 1, level - 1, -1):
        at = made.where((F.col("level") == k) & ~is_root)
        run = at.groupBy("tree", F.expr(f"shiftright(idx, {ARITY_BITS})").alias("up")).agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("children"))
        parents = out.where(F.col("level") == k + 1).select(F.col("tree").alias("t"), F.col("idx").alias("up_"), "places", "runs")
        linked = run.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("up_")))
        one = linked.select("tree", F.lit(k).alias("level"), F.explode("children").alias("c"), "children", "places", "runs")
        digests = F.array_join(F.transform("children", lambda x: x["digest"]), "")
        place = (F.col("c.idx") % ARITY).cast("int")
        out = out.unionAll(one.select("tree", "level", "c.idx", F.concat(F.array(place), "places"), F.concat(F.array(digests), "runs")))
    return out


def subtree(digests: Sequence[str], levels: int) -> list[list[str]]:
    """``levels`` levels above consecutive nodes, and those."""
    out = [list(digests)]
    for _ in range(levels):
        out.append([digest_of(out[-1][i : i + ARITY]) for i in range(0, len(out[-1]), ARITY)])
    return out


HEX = 64


def proofs(leaves: pa.Table, path: pa.Table) -> pa.Table:
    """Proof digests and folded roots of the leaves below one ancestor, whose path is the one row of ``path``. Equal digests at a
    node are folded once."""
    leaves = leaves.sort_by("idx")
    column = {c: leaves.column(c).to_pylist() for c in ("leaf", "start", "n")}
    places, runs = path.column("places")[0].as_py(), path.column("runs")[0].as_py()
    parents, siblings = runs, [r[: HEX * p] + r[HEX * (p + 1) :] for p, r in zip(places, runs)]
    levels = subtree(column["leaf"], min(SPAN, height(column["n"][0])))
    upper, known = "".join(siblings), {}

    def folded(digest: str) -> str:
        """The root above the ancestor with this digest."""
        if digest not in known:
            d = digest
            for p, r in zip(places, parents):
                d = digest_of((r[: HEX * p], d, r[HEX * (p + 1) :]))
            known[digest] = d
        return known[digest]

    below: dict[tuple[int, int, str], str] = {}
    proof, root, subroot = [], [], path.column("subroot")[0].as_py()
    for i, start in enumerate(column["start"]):
        seen, d, at = [], start, i
        for k, level in enumerate(levels[:-1]):
            first = at & -ARITY
            own = (k, at, d)
            run = level[first : first + ARITY]
            run.pop(at - first)
            seen += run
            if own not in below:
                below[own] = digest_of((*run[: at - first], d, *run[at - first :]))
            d, at = below[own], at >> ARITY_BITS
        proof.append(digest_of((*seen, upper)))
        root.append(folded(d))
    n = len(proof)
    return pa.table({"id": leaves.column("id"), "leaf": leaves.column("leaf"), "subroot": pa.array([subroot] * n, pa.string()), "proof_sha256": pa.array(proof, pa.string()), "folded_root": pa.array(root, pa.string())})


def manifest(rows: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row. ``claimed``: an expression of the leaf digest that
    is to be proven, by default the row's own; where it differs the folded root does too, and ``verified`` is false."""
    leaf = leaf_digest([F.col(c) for c in columns])
    kind = rows.schema[id_col].dataType.simpleString()
    docs = rows.select(F.col(group_col).cast("string").alias("tree"), F.col(id_col).alias("id"), leaf.alias("leaf"), (leaf if claimed is None else F.coalesce(claimed, leaf)).alias("start"))
    leaves = ordered(docs, ("id", "leaf"))
    largest = leaves.agg(F.max("n")).head()[0] or 1
    nodes = combine(leaves, largest)
    whole = F.col("n") <= F.expr(f"shiftleft(1L, {ARITY_BITS} * level)")
    single = leaves.where("n = 1").select("tree", F.col("leaf").alias("subroot"))
    subroots = materialize(nodes.where(whole).select("tree", F.col("digest").alias("subroot")).unionAll(single), "merkle-subroots")

    # the tree over the trees
    tops = ordered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("subroot").alias("leaf")), ("group",))
    trees = tops.agg(F.max("n")).head()[0] or 1
    top_nodes = combine(tops, trees)
    every = top_nodes.unionAll(tops.select("tree", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")))
    nothing = tops.sparkSession.range(1).select(F.lit("").alias("tree"), F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("runs"))
    found = paths(every, 0, trees, nothing)
    top = every.where(F.col("level") == height(trees)).select("digest").head()
    above = tops.join(found.where("level = 0").select("idx", "places", "runs"), "idx").select(F.col("group").alias("tree"), F.col("leaf").alias("subroot"), "places", "runs")
    above = materialize(above, "merkle-above")

    # of each tree: the paths of its nodes at SPAN, or of its root if that is lower
    pairs = above.select("tree", "places", "runs")
    high = paths(nodes, SPAN, largest, pairs).where(F.col("level") == SPAN).select("tree", "idx", "places", "runs")
    low = leaves.where((F.col("idx") == 0) & (F.col("n") <= ARITY ** (SPAN - 1))).select("tree").join(pairs.withColumnRenamed("tree", "t"), F.col("tree").eqNullSafe(F.col("t"))).select("tree", F.lit(0).cast("long").alias("idx"), "places", "runs")
    path = high.unionAll(low).join(above.select(F.col("tree").alias("t"), "subroot"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")
    path = materialize(path, "merkle-paths")
    key = [F.coalesce(F.concat(F.lit("t"), "tree"), F.lit("")).alias("key")]
    left = leaves.select(*key, F.expr(f"shiftright(idx, {ARITY_BITS * SPAN})").alias("block"), "n", "idx", "id", "leaf", "start")
    right = path.select(*key, F.col("idx").alias("block"), "places", "runs", "subroot")
    folded = left.groupBy("key", "block").cogroup(right.groupBy("key", "block")).applyInArrow(proofs, f"id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")
    discard(subroots, tops, top_nodes, nodes, above)
    root = F.lit(top.digest if top else None).cast("string")
    return folded.select(F.col("id").alias(id_col), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def lowered(columns: Sequence[str], text_col: str) -> Column:
    """The leaf digest of a row whose text has been lower-cased, A to Z only."""
    return leaf_digest([F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in columns])


def _sql() -> str:
    """SQL of the query for DuckDB. Levels are unrolled as far as 16 ** 5 leaves of a source and 16 ** 2 sources: a node that is
    alone stays as it is."""
    ids = "list_transform(range(strlen(doc_id::VARCHAR)::INT), lambda i: ascii(substr(doc_id::VARCHAR, i::INT + 1, 1))::BIGINT)"
    shift = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, {ids}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: {shift}))"
    value = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join([value("doc_id"), value("source"), value("lang"), value("n_chars"), value(text)]) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295) % 5 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS start FROM documents)",
        "n0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM d)",
        "l0 AS (SELECT source AS g, idx, leaf AS digest, n FROM n0)",
    ]

    def levels(name: str, count: int) -> None:
        for k in range(count):
            own = f"{name}{k}"
            parts.append(
                f"{name}{k + 1} AS (SELECT g, idx // 16 AS idx, CASE WHEN any_value(n) = 1 THEN any_value(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest, (any_value(n) + 15) // 16 AS n FROM {own} GROUP BY g, idx // 16)"
            )

    levels("l", 5)
    parts.append("s0 AS (SELECT '' AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, digest, count(*) OVER () AS n, g AS source FROM l5)")
    levels("s", 2)
    steps, last = [*(("l", k) for k in range(5)), *(("s", k) for k in range(2))], "p0"
    parts.append("p0 AS (SELECT n0.doc_id, n0.source, n0.leaf, n0.start AS cur, n0.idx AS spot, s0.idx AS top, '' AS seen, row_number() OVER () AS r FROM n0 JOIN s0 ON n0.source IS NOT DISTINCT FROM s0.source)")
    for i, (name, k) in enumerate(steps):
        here, group = ("spot", "x.g IS NOT DISTINCT FROM p.source") if name == "l" else ("top", "true")
        before, after = f"string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx < p.{here})", f"string_agg(x.digest, '' ORDER BY x.idx) FILTER (WHERE x.idx > p.{here})"
        parts.append(
            f"p{i + 1} AS (SELECT doc_id, source, leaf, r, {'spot // 16 AS spot, top' if name == 'l' else 'spot, top // 16 AS top'}, seen || coalesce(b, '') || coalesce(a, '') AS seen, CASE WHEN n = 1 THEN cur ELSE sha256(coalesce(b, '') || cur || coalesce(a, '')) END AS cur "
            f"FROM (SELECT p.doc_id, p.source, p.leaf, p.r, p.spot, p.top, p.seen, p.cur, any_value(x.n) AS n, {before} AS b, {after} AS a FROM {last} p JOIN {name}{k} x ON {group} AND x.idx // 16 = p.{here} // 16 GROUP BY ALL))"
        )
        last = f"p{i + 1}"
    return (
        "WITH " + ", ".join(parts) + f" SELECT p.doc_id, p.leaf, l5.digest AS subroot, s2.digest AS root, sha256(p.seen) AS proof_sha256, p.cur AS folded_root, p.cur = s2.digest AS verified FROM {last} p JOIN l5 ON l5.g IS NOT DISTINCT FROM p.source CROSS JOIN s2"
    )


ORACLE_SQL = _sql()
