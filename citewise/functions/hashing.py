"""Signed feature hashing: text -> sparse unit vector, next to the row.

A vector is ``array<struct<bucket int, weight double>>`` ordered by bucket. Nothing is exploded, so embedding a
corpus needs no shuffle: tokens are found and counted over Arrow batches, a few texts at a time, and a token that a worker
has met is not hashed again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import md5
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from citewise.functions.text import let
from citewise.plans.batches import slices

DEFAULT_DIM = 384
SPARSE_TYPE = "array<struct<bucket:int,weight:double>>"
ARROW_TYPE = pa.list_(pa.struct([("bucket", pa.int32()), ("weight", pa.float64())]))
TOKEN = re.compile("[a-z0-9]+")
PART_BYTES = 1 << 20  # of text that is taken apart at a time
PART_CELLS = 1 << 20  # of counts that are held at a time
KNOWN_TOKENS = 200_000


class TokenKeys(dict):
    """token -> bucket * 2, plus 1 when it counts negatively; a bounded number is remembered.

    The first four bytes of a token's md5 give the bucket, the parity of the fifth its sign.
    """

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: str) -> int:
        number = int.from_bytes(md5(token.encode(), usedforsecurity=False).digest()[:5], "big")
        key = (number >> 8) % self.dim * 2 + number % 2
        if len(self) >= KNOWN_TOKENS:
            self.clear()
        if len(token) <= 64:
            self[token] = key
        return key


def unit_vectors(texts: list[str], keys: TokenKeys) -> pa.Array:
    """Sparse vectors of length one of lower-cased texts; one without tokens, or whose counts cancel out, is empty."""
    dim = keys.dim
    tokens = [TOKEN.findall(text) for text in texts]
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    found = np.fromiter(map(keys.__getitem__, chain.from_iterable(tokens)), np.int64, int(sizes.sum()))
    cells = np.repeat(np.arange(len(texts)) * dim, sizes) + (found >> 1)
    counts = np.bincount(cells, weights=1 - 2 * (found & 1), minlength=len(texts) * dim).reshape(-1, dim)
    norms = np.sqrt((counts * counts).sum(axis=1))
    rows, buckets = np.nonzero(counts)
    entries = [pa.array(buckets, pa.int32()), pa.array(counts[rows, buckets] / norms[rows])]
    offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=len(texts)))]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(entries, ["bucket", "weight"]))


def _hasher(dim: int):
    def embed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        keys, rows = TokenKeys(dim), max(1, PART_CELLS // dim)
        for array in texts:
            batch = pa.record_batch([array], ["text"])
            few = (batch.slice(start, rows) for start in range(0, len(batch), rows))
            parts = [unit_vectors(part.column(0).to_pylist(), keys) for some in few for part in slices(some, "text", PART_BYTES)]
            yield pa.concat_arrays(parts) if parts else pa.array([], ARROW_TYPE)

    return F.arrow_udf(embed, SPARSE_TYPE)


def hashed_vector(col: Column, dim: int = DEFAULT_DIM) -> Column:
    """L2-normalised sparse vector; a text without tokens gives an empty one."""
    return _hasher(dim)(F.lower(F.coalesce(col, F.lit(""))))


def sparse_dot(left: Column, right: Column) -> Column:
    """Inner product of two sparse vectors, null where one is missing: their entries in the order of buckets, products of neighbours."""

    def products(entries: Column) -> Column:
        def add(state: Column, entry: Column) -> Column:
            shared = state["bucket"] == entry["bucket"]
            total = F.when(shared, state["total"] + state["weight"] * entry["weight"]).otherwise(state["total"])
            return F.struct(entry["bucket"].alias("bucket"), entry["weight"].alias("weight"), total.alias("total"))

        start = F.struct(F.lit(-1).alias("bucket"), F.lit(0.0).alias("weight"), F.lit(0.0).alias("total"))
        return F.aggregate(entries, start, add)["total"]

    return let(F.sort_array(F.concat(left, right)), products)


def to_dense(vector: Column, dim: int = DEFAULT_DIM) -> Column:
    """Sparse -> ``array<float>`` of length ``dim``."""

    def fill(entries: Column) -> Column:
        def piece(entry: Column, position: Column) -> Column:
            previous = F.coalesce(F.get(entries, position - 1)["bucket"], F.lit(-1))
            return F.concat(
                F.array_repeat(F.lit(0.0).cast("float"), entry["bucket"] - previous - 1),
                F.array(entry["weight"].cast("float")),
            )

        last = F.coalesce(F.try_element_at(entries, F.lit(-1))["bucket"], F.lit(-1))
        tail = F.array_repeat(F.lit(0.0).cast("float"), F.lit(dim - 1) - last)
        return F.concat(F.flatten(F.transform(entries, piece)), tail)

    return let(vector, fill)


def checked_dense(vector: Column, dim: int = DEFAULT_DIM) -> Column:
    """The vector itself, or a task failure when its length is not ``dim``."""
    problem = F.format_string("vector has %d values but the collection expects %d", F.size(vector), F.lit(dim))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(problem).cast("array<float>"))
