"""Token counts by proven whole tokens, and byte-level BPE encoding and decoding by a pair occurrence index.

Both work on slices of a partition: pre-tokens are found, each distinct one is resolved once, and the texts are put
together from the resolved pieces. A slice holds about ``SLICE_BYTES`` of text (one longer text stays whole), and what is
remembered about pre-tokens is dropped beyond ``REMEMBERED`` entries, so memory is bounded at every input size.

Null texts count as empty. Rows keep their number: repeated rows give repeated results, an empty table an empty result.
Other columns are ignored unless named in ``keep``;
a name of ``keep`` that is also one of the results raises.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import PairIndex, Vocabulary, vocabulary
from .common import only_new, sliced, unused

SLICE_BYTES = 4 << 20
REMEMBERED = 400_000


@lru_cache(maxsize=4)
def pair_index(v: Vocabulary) -> PairIndex:
    return PairIndex(v)


class Resolved:
    """What is known of each pre-token: its count of tokens, or its ids as bytes."""

    def __init__(self, path: str, whole: frozenset[bytes] | None = None):
        self.v, self.whole = vocabulary(path), whole
        self.known: dict[str, int | bytes] = {}

    def pieces(self, texts: list[str]) -> list[list[str]]:
        found = [self.v.pieces(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*found).difference(self.known)) if found else []
        self.learn(new)
        return found

    def learn(self, new: list[str]) -> None:
        v, counts = self.v, self.whole is not None
        rest: list[str] = []
        for piece in new:
            if piece in v.special:
                self.known[piece] = 1 if counts else np.uint32(v.special[piece]).tobytes()
            elif counts and piece.encode() in self.whole:
                self.known[piece] = 1
            else:
                rest.append(piece)
        if not rest:
            return
        ids, offsets = pair_index(v).encode([p.encode() for p in rest])
        if counts:
            self.known.update(zip(rest, np.diff(offsets).tolist()))
        else:
            flat, at = ids.astype("<u4").tobytes(), (offsets * 4).tolist()
            self.known.update((p, flat[a:b]) for p, a, b in zip(rest, at, at[1:]))


def whole_tokens(path: str) -> frozenset[bytes]:
    """The offline proof: vocabulary strings that encode alone as one token. Bounded by the vocabulary."""
    return frozenset(vocabulary(path).proven_whole())


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, n_bytes, n_tokens: tokens of each whole text, without special tokens being added."""
    spark = docs.sparkSession
    whole = spark.sparkContext.broadcast(whole_tokens(path))
    cols = [id_col, *keep]
    only_new(cols, ("n_bytes", "n_tokens"))
    inner = unused(cols, "__text")
    base = docs.select(*cols, F.col(text_col).cast("string").alias(inner))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[: len(cols)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolved = Resolved(path, whole.value)
        for batch in sliced(batches, inner, SLICE_BYTES):
            texts = [t or "" for t in batch.column(inner).to_pylist()]
            get = resolved.known.__getitem__
            counts = [sum(map(get, p)) for p in resolved.pieces(texts)]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], [*cols, "n_bytes", "n_tokens"])

    return base.mapInArrow(run, f"{schema}, n_bytes long, n_tokens long")


#: Columns that ``encode`` can make of a text.
ENCODED = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def decode_ids(v: Vocabulary, ids: np.ndarray) -> str:
    """The text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(v.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ("ids", "n_tokens"), keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode whole texts; ``columns`` names what to return of ``ENCODED``. decoded is made from the ids, not from the text."""
    cols = [id_col, *keep]
    only_new(cols, columns)
    inner = unused(cols, "__text")
    base = docs.select(*cols, F.col(text_col).cast("string").alias(inner))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema[: len(cols)]] + [f"{c} {ENCODED[c]}" for c in columns])
    decoding = any(c.startswith("decoded") for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        resolved = Resolved(path)
        v = resolved.v
        for batch in sliced(batches, inner, SLICE_BYTES):
            texts = [t or "" for t in batch.column(inner).to_pylist()]
            out: dict[str, list] = {c: [] for c in columns}
            get = resolved.known.__getitem__
            for pieces in resolved.pieces(texts):
                raw = b"".join(map(get, pieces))
                ids = np.frombuffer(raw, "<u4")
                text = decode_ids(v, ids) if decoding else ""
                for c, values in out.items():
                    if c == "ids":
                        values.append(ids.astype(np.int32))
                    elif c == "n_tokens":
                        values.append(len(ids))
                    elif c == "ids_sha256":
                        values.append(hashlib.sha256(raw).hexdigest())
                    elif c == "decoded":
                        values.append(text)
                    else:
                        values.append(hashlib.sha256(text.encode()).hexdigest())
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, kinds.get(c, pa.string())) for c, x in out.items())], [*cols, *columns])

    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and text of rows with an ids array; a null array gives a null text."""
    base = encoded.select(id_col, F.col(ids_col).alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else decode_ids(v, np.array(x, np.int64)) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return base.mapInArrow(run, f"`{id_col}` {base.schema[0].dataType.simpleString()}, text string")
