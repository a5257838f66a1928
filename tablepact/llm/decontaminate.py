"""Benchmark decontamination by a distributed positional inverted index.

The index is partitioned by documents: a shard is a run of documents of about ``SHARD_BYTES`` of text, and keeps for each
term the ascending positions at which it occurs in the shard. Positions count on through the shard, with a gap between
documents that no phrase spans. Shards are written to the shared folder as rows of one table. A search broadcasts blocks
of phrases of bounded size; each shard looks a phrase up by intersecting offset-adjusted lists, shortest list first, so most
phrases end at the first term that the shard doesn't have. Nothing is dealt by term or by document, so neither a common
word nor a passage in a third of all documents meets in one task.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of texts with A-Z in lower case. Null texts have no words. Repeated rows of
documents are judged one by one; repeated items are searched once. Ids keep their type; other columns are ignored, whatever their
names. An item without words has no window; an item of fewer
words than a window is one window of its own length. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, sliced

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Phrases in one broadcast block, and terms in a broadcast vocabulary. Beyond the latter every term is indexed: the index is then
#: larger, what a search finds in it the same.
BLOCK_PHRASES, MAX_TERMS = 100_000, 1_000_000
#: Bytes that part words become spaces, A-Z become a-z.
FOLD = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
INDEX = "shard string, doc_ids array<{}>, starts array<int>, lengths array<int>, terms array<binary>, counts array<int>, postings binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


def build_index(docs: DataFrame, terms: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, gap: int = WINDOW, max_terms: int = MAX_TERMS) -> DataFrame:
    """The index as a table in the shared folder. ``terms`` (term binary) restricts it to those that may be searched for.

    One row is one shard; its size is bounded by ``shard_bytes`` or by one longer document. ``gap`` parts documents: only
    phrases and spans up to that many words are safe from running over into the next document.
    """
    spark = docs.sparkSession
    only = None
    if terms is not None:
        found = [bytes(r[0]) for r in terms.select("term").distinct().limit(max_terms + 1).collect()]
        if len(found) <= max_terms:
            only = spark.sparkContext.broadcast(found)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    class Numbers(dict):
        def __missing__(self, word: bytes) -> int:
            self[word] = n = len(self)
            return n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_terms = None if only is None else {t: i for i, t in enumerate(only.value)}
        for batch in sliced(batches, "text", shard_bytes):
            if known_terms is None:
                numbers: dict[bytes, int] = Numbers()
                get = numbers.__getitem__
            else:
                get = lambda w, f=known_terms.get: f(w, -1)
            flat, starts, lengths, at = [], [], [], 0
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                flat.append(np.fromiter(map(get, words), np.int32, len(words)))
                starts.append(at)
                lengths.append(len(words))
                at += len(words) + gap
            term = np.concatenate(flat)
            position = np.concatenate([np.arange(s, s + n, dtype=np.int32) for s, n in zip(starts, lengths)])
            known = term >= 0
            term, position = term[known], position[known]
            order = np.argsort(term, kind="stable")
            term, position = term[order], position[order]
            cuts = np.flatnonzero(np.diff(term, prepend=-1))
            counts = np.diff(np.append(cuts, len(term)))
            names = list(numbers) if only is None else only.value
            listed = [names[i] for i in term[cuts].tolist()]
            gaps = np.diff(position, prepend=np.int32(0))
            gaps[cuts] = position[cuts]
            yield pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.ListArray.from_arrays([0, batch.num_rows], batch.column("id")), pa.array([starts], pa.list_(pa.int32())), pa.array([lengths], pa.list_(pa.int32())), pa.array([listed], pa.list_(pa.binary())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([zlib.compress(gaps.astype("<i4").tobytes(), 1)], pa.binary())],
                ["shard", "doc_ids", "starts", "lengths", "terms", "counts", "postings"],
            )

    return materialize(base.mapInArrow(run, INDEX.format(base.schema["id"].dataType.simpleString())), "postings")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of the index one at a time: each is a whole shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


class Shard:
    """Posting lists of one row of the index."""

    def __init__(self, row: dict):
        self.ids, self.starts, self.lengths = row["doc_ids"], np.array(row["starts"], np.int64), np.array(row["lengths"], np.int64)
        self.counts = np.array(row["counts"], np.int64)
        self.ends = np.cumsum(self.counts)
        self.number = {t: i for i, t in enumerate(row["terms"])}
        gaps = np.frombuffer(zlib.decompress(row["postings"]), "<i4").astype(np.int64)
        total = np.cumsum(gaps)
        first = self.ends - self.counts
        before = np.where(first > 0, total[first - 1], 0) if len(gaps) else np.zeros(0, np.int64)
        self.positions = total - np.repeat(before, self.counts)

    def postings(self, term: bytes) -> np.ndarray:
        i = self.number.get(term)
        return self.positions[:0] if i is None else self.positions[self.ends[i] - self.counts[i] : self.ends[i]]

    def phrase(self, numbers: Iterable[int]) -> np.ndarray:
        """Start positions at which the terms with these numbers follow one another."""
        terms = list(enumerate(numbers))
        terms.sort(key=lambda t: self.counts[t[1]])
        offset, i = terms[0]
        found = self.positions[self.ends[i] - self.counts[i] : self.ends[i]] - offset
        for offset, i in terms[1:]:
            if not len(found):
                break
            listed = self.positions[self.ends[i] - self.counts[i] : self.ends[i]] - offset
            if len(listed) > 8 * len(found):
                at = np.searchsorted(listed, found)
                at[at == len(listed)] = 0
                found = found[listed[at] == found]
            else:
                found = np.intersect1d(found, listed, assume_unique=True)
        return found

    def near(self, terms: list[bytes], span: int) -> np.ndarray:
        """Positions of the rarest term at which every term occurs within ``span`` words that hold that position."""
        lists = sorted((self.postings(t) for t in sorted(set(terms))), key=len)
        if not lists or not len(lists[0]):
            return np.zeros(0, np.int64)
        hits = []
        for p in lists[0].tolist():
            around = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)] for x in lists[1:]]
            if all(map(len, around)) and any(all(((x >= s) & (x < s + span)).any() for x in around) for s in range(p - span + 1, p + 1)):
                hits.append(p)
        return np.array(hits, np.int64)

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


def windows(items: DataFrame, size: int = WINDOW, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct phrases (terms array<binary>, items array<string>) of all items."""
    base = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 1 << 20):
            ids, phrases = [], []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                found = {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()
                ids += [i] * len(found)
                phrases += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(phrases, pa.binary())], ["item", "phrase"])

    return base.mapInArrow(run, "item string, phrase binary").groupBy("phrase").agg(F.array_sort(F.collect_set("item")).alias("items"))


def search(index: DataFrame, phrases: DataFrame, *, block: int = BLOCK_PHRASES) -> DataFrame:
    """Every document of the index: doc_id, n_words, n_hit, items (array<string>, those with a phrase that occurs).

    ``phrases`` are looked up in blocks of at most ``block``; with more than one, what blocks find is put together for each
    row of the index by its hit positions.
    """
    spark = index.sparkSession
    n = phrases.count()
    blocks = max(1, -(-n // block))
    if blocks == 1:
        return _block(index, spark.sparkContext.broadcast([(bytes(p), list(i)) for p, i in phrases.collect()]), False)
    parts = None
    for k in range(blocks):  # about `block` phrases each, never all at once on the driver
        rows = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == k).collect()
        part = _block(index, spark.sparkContext.broadcast([(bytes(p), list(i)) for p, i in rows]), True)
        parts = part if parts is None else parts.unionAll(part)
    return parts.groupBy("shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    ).drop("shard", "place")


def _block(index: DataFrame, shared, parts: bool) -> DataFrame:
    kind = index.schema["doc_ids"].dataType.elementType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = [p.split(b" ") for p, _ in shared.value]
        names: dict[bytes, int] = {}
        longest = max(map(len, split), default=1)
        grid = np.full((len(split), longest), -1, np.int64)
        for row, terms in zip(grid, split):
            row[: len(terms)] = [names.setdefault(t, len(names)) for t in terms]
        for shard_row in rows_of(batches):
            shard = Shard(shard_row)
            place = np.array([shard.number.get(t, -1) for t in names], np.int64) if names else np.zeros(0, np.int64)
            there = np.where(grid >= 0, place[grid], 0) if len(grid) else grid
            docs = len(shard.ids)
            hit: list[np.ndarray] = []
            items: list[set[str]] = [set() for _ in range(docs)]
            for p in np.flatnonzero((there >= 0).all(axis=1)).tolist():
                size = len(split[p])
                found = shard.phrase(there[p, :size].tolist())
                if len(found):
                    hit.append((found[:, None] + np.arange(size)).ravel())
                    for d in np.unique(shard.documents(found)).tolist():
                        items[d].update(shared.value[p][1])
            hits = np.unique(np.concatenate(hit)) if hit else np.zeros(0, np.int64)
            owner = shard.documents(hits) if len(hits) else hits
            out = [pa.array(shard.ids, id_type), pa.array(shard.lengths, pa.int64()), pa.array(np.bincount(owner, minlength=docs), pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            named = ["doc_id", "n_words", "n_hit", "items"]
            if parts:
                cuts = np.searchsorted(owner, np.arange(docs + 1))
                out += [pa.array([shard_row["shard"]] * docs, pa.string()), pa.array(range(docs), pa.int64()), pa.array([hits[a:b] for a, b in zip(cuts, cuts[1:])], pa.list_(pa.int64()))]
                named += ["shard", "place", "hits"]
            yield pa.RecordBatch.from_arrays(out, named)

    return index.mapInArrow(run, f"doc_id {kind.simpleString()}, n_words long, n_hit long, items array<string>" + ", shard string, place long, hits array<long>" * parts)


def proximity(index: DataFrame, terms: list[str], span: int) -> DataFrame:
    """doc_id, position (of a word in its document): the rarest of ``terms`` where all of them lie within ``span`` words."""
    wanted = [w for t in terms for w in words_of(t)]
    kind = index.schema["doc_ids"].dataType.elementType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            shard = Shard(row)
            found = shard.near(wanted, span)
            owner = shard.documents(found) if len(found) else found
            yield pa.RecordBatch.from_arrays([pa.array([shard.ids[d] for d in owner.tolist()], id_type), pa.array(found - shard.starts[owner] if len(found) else [], pa.int64())], ["doc_id", "position"])

    return index.mapInArrow(run, f"doc_id {kind.simpleString()}, position long")


def contamination(docs: DataFrame, items: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK_PHRASES, max_terms: int = MAX_TERMS) -> DataFrame:
    """``search`` for all windows of ``items`` in an index of ``docs``."""
    phrases = materialize(windows(items, window), "phrases")
    terms = phrases.select(F.explode(F.split(F.col("phrase").cast("string"), " ")).alias("term")).select(F.col("term").cast("binary").alias("term"))
    return search(build_index(docs, terms, id_col=id_col, text_col=text_col, gap=window, max_terms=max_terms), phrases, block=block)


def clean_documents(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of ``docs``, unchanged, in which no window of ``items`` occurs. Ids play no part: rows are told by a SHA-256 of their text.

    Contaminated texts are few against the documents; the join is dealt by that digest and a frequent one can be split.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.unhex(F.sha2(text, 256)).alias("key"), F.struct("*").alias("row"))
    hit = contamination(keyed.select("key", F.col("row.text").alias("text")), items, id_col="key").where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(materialize(hit, "contaminated"), "key", "left_anti").select("row.*")


#: For DuckDB: windows as text, each document's windows of the same lengths, equality of both.
ORACLE_SQL = r"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i:i+9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM iw WHERE len(ws) > 0)),
s AS (SELECT DISTINCT n FROM p),
dg AS (SELECT r, i, n, array_to_string(ws[i:i+n-1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, s WHERE len(ws) >= n)),
m AS (SELECT r, i, n, item FROM dg JOIN p USING (n, g)),
h AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM m, range(10) AS q(k) WHERE k < n GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
