"""Vector columns. Arrow batches meet numpy in these kernels; nothing is handled row by row."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from wareseek.functions.text import tokens


def usable_matrix(vectors: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows for the usable vectors of a batch, and the mask that says which those are.

    Missing vectors, vectors of another size, and vectors without a direction are not usable.
    """
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sized = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    flat = vectors.filter(sized).flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(-1, dims).astype(np.float64)
    norms = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    directed = np.isfinite(norms) & (norms > 0)
    usable = sized.to_numpy(zero_copy_only=False)
    usable[usable] = directed
    return rows[directed] / norms[directed, None], usable


# Rows that a kernel widens to double precision at a time: 16 MB at 1,024 dimensions.
BLOCK_ROWS = 2_048


def _by_block(kernel: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """Run a kernel over slices of a batch, so that its memory does not depend on batch size."""

    def run(values: pa.Array) -> pa.Array:
        starts = range(0, max(len(values), 1), BLOCK_ROWS)
        return pa.concat_arrays([kernel(values.slice(at, BLOCK_ROWS)) for at in starts])

    return run


def unit_query(query: Sequence[float]) -> np.ndarray:
    vector = np.asarray(query, dtype=np.float64)
    norm = np.linalg.norm(vector)
    if not np.isfinite(norm) or norm == 0:
        raise ValueError("the query vector has no direction")
    return vector / norm


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity to one query vector; NULL where the stored vector is not usable."""
    unit = unit_query(query)

    def kernel(vectors: pa.Array) -> pa.Array:
        rows, usable = usable_matrix(vectors, len(unit))
        scores = np.full(len(usable), np.nan)
        scores[usable] = rows @ unit
        return pa.array(scores, mask=~usable)

    @F.arrow_udf("double")
    def score(vectors: pa.Array) -> pa.Array:
        return _by_block(kernel)(vectors)

    return score(vector)


def vector_score(vector: Column, query: Sequence[float], digits: int = 9) -> Column:
    """Cosine mapped to 0..1, rounded so that equal vectors tie whatever the order of summation."""
    return F.round((1 + cosine(vector, query)) / 2, digits)


def unit_vector(vector: Column, dims: int) -> Column:
    """The vector scaled to length one, NULL where it is not usable."""

    def kernel(vectors: pa.Array) -> pa.Array:
        return _float_lists(*usable_matrix(vectors, dims))

    @F.arrow_udf("array<float>")
    def scale(vectors: pa.Array) -> pa.Array:
        return _by_block(kernel)(vectors)

    return scale(vector)


def hashed_embedding(text: Column, dims: int) -> Column:
    """Bag of words embedding: count tokens per hash bucket, then scale to length one.

    The bucket of a token is the number in the first eight hex digits of its MD5, modulo ``dims``.
    Text is tokenised in the JVM. A block of rows then hashes each distinct token once and counts
    with one ``bincount``. Text without tokens has no direction and gives NULL.
    """

    def kernel(lists: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        bucket = np.array(
            [int(md5(t.encode()).hexdigest()[:8], 16) % dims for t in coded.dictionary.to_pylist()],
            dtype=np.int64,
        )
        flat = bucket[coded.indices.to_numpy(zero_copy_only=False)]
        rows = np.repeat(np.arange(len(lengths)), lengths)
        counts = np.bincount(rows * dims + flat, minlength=len(lengths) * dims)
        counts = counts.reshape(len(lengths), dims).astype(np.float64)
        norms = np.sqrt((counts * counts).sum(axis=1))
        usable = norms > 0
        return _float_lists(counts[usable] / norms[usable, None], usable)

    @F.arrow_udf("array<float>")
    def embed(lists: pa.Array) -> pa.Array:
        return _by_block(kernel)(lists)

    return embed(tokens(text))


def _float_lists(rows: np.ndarray, usable: np.ndarray) -> pa.Array:
    """List array with ``rows`` at the usable positions and nulls elsewhere."""
    dims = rows.shape[1]
    ends = np.concatenate([[0], np.cumsum(np.where(usable, dims, 0))]).astype(np.int32)
    values = pa.array(rows.astype(np.float32).ravel())
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~usable))
