"""Near-duplicate documents by a chosen-path set similarity join, and their components.

A document's set holds its distinct five-word shingles. Documents with equal sets are one class and are represented by
their smallest id. Each class gets a signature of minwise tokens. In each of several independent trees a node picks a few
coordinates of the signature, 1 / threshold of them on average (``trees_of`` says how many trees), by a hash of the path that led to it; a class goes on to the
child named by its token there. A pair as similar as the threshold so keeps at least one common child on average at any
depth, while classes unlike each other part. Nodes of one class end; nodes of at most ``SMALL`` are leaves; larger ones
branch again, down to ``DEPTH``. A larger node is a leaf too if holding its classes against a central one has left at most
``SMALL / 2`` of them outside its most common component: a group of near copies branches no further and loses no pair by it.

Leaves yield links in two steps, and neither gives out all pairs of a group. First every class of a node is held against one
class of it only, the most central one of large nodes; the confirmed links give components. Then only nodes that still hold
two or more components are compared exhaustively, and only across components: by sketches first, which leaves the classes
that have a likely partner, and then these on their full sets, within the group. A group keeps track of the components that it
has joined, and gives out those links alone that join two of them: fewer than it has members, however many pairs are alike.
Nodes of more than ``CHUNK`` classes, or ``CHUNK_BYTES`` of sets, are dealt as pairs of chunks, so that no group holds more than
about that; pairs of chunks of the node's most common component are left out. So a group of thousands of near copies costs a
number of comparisons in proportion to its size, one of alike but unlinked texts the square of its size in bounded groups and
with a linear result, and no pair of components that meets in a node is passed over. All links are confirmed on full sets, made
again from the texts. What each step has written is deleted when the next one has been.

Null texts, and texts without words, have an empty set and no links. Repeated rows of an id and text collapse into one class
and come back as often as they came in. Rows with a null id are a class by text like others and are never a component's id
unless all are null. Ids must be whole numbers; under ANSI mode others raise. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, ragged, raw_text, sliced

WORDS = 5
#: Links have 100 * intersection >= percent * union.
PERCENT = 85
TOKENS, DEPTH, SMALL = 64, 6, 512
#: Share of pairs at the threshold that no tree may bring together.
MISSED = 4.2e-4
#: Bytes of a sketch, the first of them from the tokens.
SKETCH = 256
#: Nodes of more classes are held against a central class; larger groups than CHUNK are compared as pairs of chunks.
CENTRAL, CHUNK, CHUNK_BYTES = 64, 2048, 16 << 20
SLICE_BYTES = 4 << 20
REMEMBERED = 200_000
BLOCK_PAIRS = 4000


def more_often(percent: int) -> float:
    """How often a node picks a second coordinate, so that it picks 100 / percent on average."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    return (100 - percent) / percent


def trees_of(percent: int, depth: int = DEPTH) -> int:
    """The trees that bring all but ``MISSED`` of pairs at the threshold together, were every node to branch down to ``depth``."""
    meets, often = 1.0, more_often(percent)
    for _ in range(depth):
        common = meets * percent / 100
        meets = 1 - (1 - often) * (1 - common) - often * (1 - common) ** 2
    return 1 if meets >= 1 else math.ceil(math.log(MISSED) / math.log(1 - meets))


def least_agreeing(percent: int) -> tuple[int, int]:
    """Bytes of a whole sketch, and of its first ``TOKENS``, that must agree for a pair to be confirmed: 4.5 and 5 standard
    deviations below what the threshold gives, chance agreement counted. The first are looked at before the others."""
    p = percent / 100 + (1 - percent / 100) / 256
    below = lambda n, z: n * p - z * math.sqrt(n * p * (1 - p))
    return math.ceil(below(SKETCH, 4.5)), math.floor(below(TOKENS, 5))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles, or of the whole sequence of fewer words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - WORDS + 1)
    h = np.full(n, min(len(w), WORDS), np.uint64)
    for k in range(min(WORDS, len(w))):
        h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ mix(w[k : k + n])
        h = h ^ (h >> np.uint64(29))
    return np.unique(mix(h))


_xor, _odd = np.random.default_rng(20240607).integers(0, 2**32, (2, SKETCH), dtype=np.uint32)
_odd |= np.uint32(1)


def minwise(h: np.ndarray) -> tuple[bytes, bytes]:
    """The tokens of the tree, which are the least permuted hash of each of ``TOKENS`` coordinates, and the sketch: one byte of
    the least hash of each of ``SKETCH`` coordinates, enough to tell how many agree."""
    top, out = (h >> np.uint64(32)).astype(np.uint32), np.full(SKETCH, 2**32 - 1, np.uint32)
    for at in range(0, len(top), 256):
        permuted = top[at : at + 256, None] ^ _xor
        permuted *= _odd
        np.minimum(out, permuted.min(axis=0), out=out)
    return out[:TOKENS].astype("<u4").tobytes(), out.astype(np.uint8).tobytes()


def grid(sketches: pa.Array, width: int = SKETCH) -> np.ndarray:
    """A row of bytes for each value of a binary array whose values are all ``width`` long."""
    return raw_text(sketches)[0].reshape(-1, width)


def sets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, set_key (of the whole set), sig and its sketch (binary); all null but n_shingles for empty sets."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, "text", SLICE_BYTES):
            n, keys, made = [], [], []
            for text in batch.column("text").to_pylist():
                h = shingles(text, hashes)
                n.append(len(h))
                keys.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                made.append(minwise(h) if len(h) else (None, None))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *(pa.array([m[i] for m in made], pa.binary()) for i in (0, 1))], ["id", "n_shingles", "set_key", "sig", "sketch"])

    return base.mapInArrow(run, "id long, n_shingles long, set_key binary, sig binary, sketch binary")


def branch(rows: DataFrame, *, roots: int = 0, percent: int = PERCENT) -> DataFrame:
    """(node, id, sig) one level down; with ``roots``, rows have no node and start in that many trees."""
    often = int(10_000 * more_often(percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_nodes = mix(np.arange(1, roots + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9))
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, TOKENS).astype(np.uint64)
            n = len(ids)
            starts = [(np.full(n, t, np.uint64), np.arange(n)) for t in tree_nodes] if roots else [(batch.column("node").to_numpy(zero_copy_only=False).view(np.uint64), np.arange(n))]
            nodes, at = [], []
            for node, row in starts:
                h = mix(node)
                first = (h % np.uint64(TOKENS)).astype(np.int64)
                more = np.flatnonzero((h >> np.uint64(20)) % np.uint64(10_000) < np.uint64(often))
                second = (first + 1 + ((h >> np.uint64(40)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
                for c, r in ((first, row), (second[more], row[more])):
                    token = sig[r, c]
                    nodes.append(mix(h[r] ^ (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ token * np.uint64(0xC2B2AE3D27D4EB4F)))
                    at.append(r)
            where = np.concatenate(at)
            taken = batch.select(["id", "sig"]).take(pa.array(where))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), taken.column(0), taken.column(1)], ["node", "id", "sig"])

    return rows.mapInArrow(run, "node long, id long, sig binary")


def settled(large: DataFrame, labels: DataFrame, small: int) -> DataFrame:
    """The ``node`` of those that hold at most half of ``small`` classes outside their most common component: comparing these with
    all others costs no more for each class than a leaf of ``small`` classes does."""
    each = large.join(labels.select("id", "component"), "id", "left").groupBy("node", F.coalesce("component", "id").alias("component")).agg(F.count("*").alias("k"))
    return each.groupBy("node").agg((F.sum("k") - F.max("k")).alias("others")).where(2 * F.col("others") <= small).select("node")


def leaves(classes: DataFrame, docs: DataFrame, *, trees: int | None = None, depth: int = DEPTH, small: int = SMALL, percent: int = PERCENT) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(node, id, n) of all leaves of all trees, written level by level. Signatures aren't carried along with nodes.

    Before large nodes branch, the classes of those below the roots are held against their central ones, and nodes that this
    settles are leaves too. What ``central`` gave for them comes second and third, if there are any.
    """
    out, written, tried, links, labels = None, [], None, None, None
    signed = classes.select("id", "sig")
    rows = branch(signed, roots=trees or trees_of(percent, depth), percent=percent)
    for level in range(1, depth + 1):
        rows = materialize(rows.select("node", "id"), "nodes")
        written.append(rows)
        counts = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        last = level == depth
        sized = rows.join(counts, "node")
        leaf = sized if last else sized.where(F.col("n") <= small)
        out = leaf if out is None else out.unionAll(leaf)
        if last:
            break
        large = materialize(rows.join(counts.where(F.col("n") > small), "node").select("node", "id", "n"), "large")
        written.append(large)
        if large.isEmpty():
            break
        if labels is None:
            tried, links = central(large, classes, docs, percent)
            labels = components(links)
            written.append(labels)
        done = materialize(settled(large, labels, small), "settled")
        written.append(done)
        out = out.unionAll(large.join(done, "node", "left_semi").select(*out.columns))
        rest = materialize(large.join(done, "node", "left_anti").select("node", "id"), "unsettled")
        written.append(rest)
        if rest.isEmpty():
            break
        rows = branch(rest.join(signed, "id").select("node", "id", "sig"), percent=percent)
    found = materialize(out, "leaves")
    discard(*written)
    return found, tried, links


#: Bits for each id of the filter that spares texts of no candidate the shuffle, and the least and most of all. A full filter
#: passes more texts to the join that follows, never fewer.
FILTER_BITS, FILTER_LEAST, FILTER_MOST = 16, 1 << 16, 1 << 27


def may_hold(ids: DataFrame):
    """A Column function of ids that is true for all of ``ids`` and few others. What reaches the driver is bounded by FILTER_MOST."""
    size = min(FILTER_MOST, max(FILTER_LEAST, 1 << (FILTER_BITS * ids.count()).bit_length()))
    spot = F.pmod(F.xxhash64("id"), F.lit(size))
    words = ids.select(F.shiftright(spot, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(31).cast("long")).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size // 32, np.uint32)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    shared = ids.sparkSession.sparkContext.broadcast(bits)

    def held(spots: pd.Series) -> pd.Series:
        x = spots.to_numpy()
        return pd.Series((shared.value[x >> 5] >> (x & 31).astype(np.uint32) & np.uint32(1)).astype(bool))

    held.__annotations__ = {"spots": pd.Series, "return": pd.Series}
    return F.pandas_udf(held, "boolean")(spot)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the distinct ``ids``, which must be written; only their texts, and few others, are shuffled."""
    return docs.where(may_hold(ids)).join(ids, "id", "left_semi").dropDuplicates(["id", "text"])


def alike(pairs: DataFrame, classes: DataFrame, width: int, least: int) -> DataFrame:
    """Pairs (a, b) of which at least ``least`` of the first ``width`` bytes of the sketches agree, written."""
    some = classes.select("id", F.substring("sketch", 1, width).alias("sketch"))
    both = pairs.join(some.withColumnsRenamed({"id": "a", "sketch": "sa"}), "a").join(some.withColumnsRenamed({"id": "b", "sketch": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (grid(batch.column(c), width) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((sa == sb).sum(axis=1) >= least))

    return materialize(both.mapInArrow(run, "a long, b long"), "alike")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sketches could be similar enough and whose full sets are, the sets made again from the texts.

    Only texts of classes in such pairs are shuffled. Pairs are dealt into blocks by a hash of either end, about BLOCK_PAIRS in
    each, and a text goes once to each block that needs it, however many pairs it has there.
    """
    agree, first_agree = least_agreeing(percent)
    roughly = alike(pairs, classes, TOKENS, first_agree)
    close = alike(roughly, classes, SKETCH, agree)
    ends = materialize(close.select(F.col("a").alias("id")).unionAll(close.select("b")).distinct(), "ends")
    texts = materialize(texts_of(docs, ends), "texts")
    parts = max(1, math.isqrt(close.count() // BLOCK_PAIRS))
    bucket = lambda c: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(parts))
    blocked = close.withColumns({"p": bucket("a"), "q": bucket("b")})
    needed = blocked.select("p", "q", F.col("a").alias("id")).unionAll(blocked.select("p", "q", F.col("b").alias("id"))).distinct()

    def holds(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        hashes, made = WordHashes(), {}
        for i, text in zip(texts.column("id").to_pylist(), texts.column("text").to_pylist()):
            made.setdefault(i, []).append(shingles(text, hashes))

        def similar(x: np.ndarray, y: np.ndarray) -> bool:
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            same = int((y[at] == x).sum()) if len(y) else 0
            return 100 * same >= percent * (len(x) + len(y) - same)

        good = [any(similar(x, y) for x in made.get(a, ()) for y in made.get(b, ())) for a, b in zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())]
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    placed = needed.join(texts, "id").select(F.col("p").alias("tp"), F.col("q").alias("tq"), "id", "text")
    linked = materialize(blocked.groupBy("p", "q").cogroup(placed.groupBy("tp", "tq")).applyInArrow(holds, "a long, b long").distinct(), "links")
    discard(roughly, close, ends, texts)
    return linked


def centres(nodes: DataFrame, classes: DataFrame, small: int = CENTRAL) -> DataFrame:
    """(node, a): the class that the others of a node are held against, written.

    Of a small node the smallest id; of a large one the class that agrees best with the tokens that most of about 64 of its
    classes, chosen by hash, have. The original of a group of copies is so found even where copies of it have smaller ids.
    """
    least = nodes.where(F.col("n") <= small).groupBy("node").agg(F.min("id").alias("a"))
    large = materialize(nodes.where(F.col("n") > small).join(classes.select("id", "sketch"), "id"), "large-nodes")
    few = large.where(F.pmod(F.xxhash64("id", "node", F.lit(7)), F.col("n")) < 64).groupBy("node").agg(F.collect_list("sketch").alias("some"))

    def usual(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in batch.column("some"):
                some = grid(some.values)
                out.append(bytes(int(np.bincount(some[:, c]).argmax()) for c in range(SKETCH)))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], ["node", "usual"])

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (grid(batch.column(c)) for c in ("sketch", "usual"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("id"), pa.array((x == y).sum(axis=1), pa.int64())], ["node", "id", "agree"])

    held = large.join(few.mapInArrow(usual, "node long, usual binary"), "node").select("node", "id", "sketch", "usual").mapInArrow(agreeing, "node long, id long, agree long")
    best = held.groupBy("node").agg(F.max(F.struct("agree", (-F.col("id")).alias("minus"))).alias("best")).select("node", (-F.col("best.minus")).alias("a"))
    found = materialize(least.unionAll(best), "centres")
    discard(large)
    return found


def central(nodes: DataFrame, classes: DataFrame, docs: DataFrame, percent: int = PERCENT, tried: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the classes of nodes with their central ones, without those in ``tried``, and the confirmed ones of them; both written."""
    middle = centres(nodes, classes)
    pairs = nodes.join(middle, "node").where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b")).distinct()
    held = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "central")
    links = confirmed(held, classes, docs, percent)
    discard(middle)
    return held, links


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links``: the smallest id reachable. In each round an id and the owner of its label take
    the least label of the labels of its neighbours, if less, and labels jump to their label's label; each round is written.
    Rounds end when nothing changes, and then every label is its component's least id: they only fall, and neighbours' are equal."""
    edges = materialize(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        far = labels.select("id", "component").join(up, "component")
        near = edges.join(far.select(F.col("id").alias("b"), "jump"), "b").groupBy(F.col("a").alias("id")).agg(F.min("jump").alias("m"))
        found = far.join(near, "id")
        own = found.select("id", F.least("jump", "m").alias("c"), F.col("component").alias("was"))
        hooks = found.where("m < jump").groupBy(F.col("component").alias("id")).agg(F.min("m").alias("c")).withColumn("was", F.lit(None).cast("long"))
        new = materialize(own.unionAll(hooks).groupBy("id").agg(F.min("c").alias("component"), F.max("was").alias("was")), "labels")
        discard(labels)
        labels = new
        if new.where("component <> was").isEmpty():
            discard(edges)
            return labels


GROUP = "node long, i long, j long, id long, component long, own long"


def dealt(nodes: DataFrame, classes: DataFrame, labels: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of ``GROUP`` for nodes that hold several components: what is compared with each other, by (node, i, j).

    Nodes of at most ``chunk`` classes and ``chunk_bytes`` of sets are one group. Of larger ones the classes of the most common
    component and the others are cut into chunks of half that, and each pair of chunks i <= j is a group, but for two of the most
    common component. A member has its own chunk's number. Nodes of two classes are left out: their pair is a central one.
    """
    named = nodes.where("n > 2").join(labels.select("id", "component"), "id", "left").join(classes.select("id", "n_shingles"), "id")
    named = named.select("node", "id", F.coalesce("component", "id").alias("component"), (8 * F.col("n_shingles")).alias("w"))
    each = named.groupBy("node", "component").agg(F.count("*").alias("k"), F.sum("w").alias("w"))
    mixed = each.groupBy("node").agg(F.count("*").alias("kinds"), F.sum("k").alias("size"), F.sum("w").alias("bytes"), F.max(F.struct("k", "component", "w")).alias("main")).where("kinds > 1").select("node", "size", "bytes", "main")
    rows = named.join(mixed, "node")
    cut = lambda n, w: F.greatest(F.ceil(2 * n / chunk), F.ceil(2 * w / chunk_bytes), F.lit(1)).cast("long")
    common, large = F.col("component") == F.col("main.component"), (F.col("size") > chunk) | (F.col("bytes") > chunk_bytes)
    others, commons = cut(F.col("size") - F.col("main.k"), F.col("bytes") - F.col("main.w")), cut(F.col("main.k"), F.col("main.w"))
    spot = lambda n: F.pmod(F.xxhash64("id", "node"), n)
    own = F.when(~large, F.lit(0)).when(common, others + spot(commons)).otherwise(spot(others)).cast("long")
    partners = F.when(~large, F.lit(1)).when(common, others).otherwise(others + commons).cast("long")
    placed = rows.withColumns({"own": own, "partners": partners}).withColumn("partner", F.explode(F.sequence(F.lit(0).cast("long"), F.col("partners") - 1)))
    return placed.select("node", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j"), "id", "component", "own")


class Alike:
    """Tells which of the members of one group could be similar enough, by sketches."""

    def __init__(self, sketches: np.ndarray, percent: int):
        self.whole, self.first = sketches, np.ascontiguousarray(sketches[:, :TOKENS])
        self.agree, self.first_agree = least_agreeing(percent)

    def near(self, k: int, some: np.ndarray) -> np.ndarray:
        some = some[(self.first[some] == self.first[k]).sum(axis=1) >= self.first_agree]
        return some[(self.whole[some] == self.whole[k]).sum(axis=1) >= self.agree]


def sides(own: np.ndarray, i: int, j: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of chunk i with the members of chunk j, every pair once."""
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    for at, k in enumerate(left.tolist()):
        yield k, right[at + 1 :] if i == j else right


def active(groups: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``groups`` whose sketch could be similar enough to that of a member of another component."""
    members = groups.join(classes.select("id", "sketch"), "id").groupBy("node", "i", "j").agg(F.collect_list(F.struct("id", "component", "own", "sketch")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, i, j, rows in zip(*(batch.column(c) for c in ("node", "i", "j", "members"))):
                ids, comp, own, sketches = rows.values.flatten()
                component, place, some = comp.to_numpy(), own.to_numpy(), Alike(grid(sketches), percent)
                hit = np.zeros(len(ids), bool)
                for k, others in sides(place, i.as_py(), j.as_py()):
                    near = some.near(k, others[component[others] != component[k]])
                    hit[near] = True
                    hit[k] |= len(near) > 0
                if hit.any():
                    at = pa.array(np.flatnonzero(hit))
                    n = len(at)
                    out.append(pa.RecordBatch.from_arrays([pa.array([x.as_py()] * n, pa.int64()) for x in (node, i, j)] + [x.take(at) for x in (ids, comp, own)], ["node", "i", "j", "id", "component", "own"]))
            yield from out

    return members.mapInArrow(run, GROUP)


def joining(rows: pa.Table, percent: int) -> pa.Table:
    """Links within one group, confirmed on its full sets, that each join two of the components as they then stand."""
    ids, own = rows.column("id").to_numpy(), rows.column("own").to_numpy()
    i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
    held = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    sizes = np.array([len(x) for x in held])
    starts = np.cumsum(sizes) - sizes
    distinct, column = np.unique(np.concatenate(held), return_inverse=True)
    some, mark = Alike(np.stack([np.frombuffer(minwise(x)[1], np.uint8) for x in held]), percent), np.zeros(len(distinct), bool)
    root = rows.column("component").to_numpy().copy()
    a, b = [], []
    for k, others in sides(own, i, j):
        near = some.near(k, others[root[others] != root[k]])
        if not len(near):
            continue
        mine = column[starts[k] : starts[k] + sizes[k]]
        mark[mine] = True
        same = np.add.reduceat(mark[column[ragged(starts[near], sizes[near])]], np.cumsum(sizes[near]) - sizes[near], dtype=np.int64)
        mark[mine] = False
        for m in near[100 * same >= percent * (sizes[k] + sizes[near] - same)].tolist():
            if root[m] != root[k]:
                root[root == root[m]] = root[k]
                a.append(min(ids[k], ids[m]))
                b.append(max(ids[k], ids[m]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def across(nodes: DataFrame, classes: DataFrame, docs: DataFrame, labels: DataFrame, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between different components within a node, written; enough of them to join all that are linked.

    Only texts of classes with a likely partner are shuffled, and each goes to the groups that have one for it.
    """
    some = materialize(active(dealt(nodes, classes, labels, chunk, chunk_bytes), classes, percent), "active")
    ids = materialize(some.select("id").distinct(), "active-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in sliced(batches, "text", SLICE_BYTES):
            made = [shingles(t, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.binary())], ["id", "hashes"])

    held = materialize(texts_of(docs, ids).mapInArrow(run, "id long, hashes binary").where(F.octet_length("hashes") > 0), "active-sets")
    links = materialize(some.join(held, "id").groupBy("node", "i", "j").applyInArrow(lambda t: joining(t, percent), "a long, b long").distinct(), "links")
    discard(some, ids, held)
    return links


def labelled(docs: DataFrame, *, id_col: str, text_col: str, percent: int, trees: int | None, small: int, chunk: int, chunk_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, set_key) of every row, and (set_key, component_id) of every class; both written."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    made = materialize(sets(texts, id_col="id"), "signatures")
    rows = materialize(made.select("id", "n_shingles", "set_key"), "sizes")
    classes = materialize(made.where("set_key is not null and id is not null").groupBy("set_key").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("n_shingles", "sig", "sketch"))), "classes")
    discard(made)
    nodes, tried, early = leaves(classes, texts, trees=trees, small=small, percent=percent)
    first, links = central(nodes, classes, texts, percent, tried)
    discard(first)
    if tried is not None:
        found = materialize(links.unionAll(early), "links")
        discard(tried, early, links)
        links = found
    labels = components(links)
    rest = across(nodes, classes, texts, labels, chunk, chunk_bytes, percent)
    discard(nodes)
    if not rest.isEmpty():
        discard(labels)
        labels = components(links.unionAll(rest))
    named = materialize(classes.select("set_key", "id").join(labels.select("id", "component"), "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id")), "components")
    discard(classes, links, rest, labels)
    return rows, named


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, trees: int | None = None, small: int = SMALL, chunk: int = CHUNK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each row of ``docs``: id, n_shingles, component_id, kept."""
    rows, named = labelled(docs, id_col=id_col, text_col=text_col, percent=percent, trees=trees, small=small, chunk=chunk, chunk_bytes=chunk_bytes)
    out = rows.join(named, "set_key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Rows of ``docs``, unchanged, one of each group of near copies: that with the smallest id. Of repeated rows of one id one
    stays; rows with a null id are never a copy of another. The rows are shuffled once, by their id."""
    kept = materialize(near_duplicates(docs, id_col=id_col, **options).where(F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key")).distinct(), "kept")
    row = docs.select(F.col(id_col).cast("long").alias("key"), F.struct("*").alias("row"))
    named = row.where("key is not null").join(kept, "key", "left_semi").dropDuplicates(["key"])
    return named.unionAll(row.where("key is null")).select("row.*")


#: For DuckDB: all links by shared shingles, and components by walking them.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM q JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS x FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.x),
c AS (SELECT doc_id, min(x) AS c FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
