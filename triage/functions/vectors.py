"""Vector column functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from triage.functions.text import bind

def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Scale to length 1; the zero vector stays zero."""
    def scaled(n: Column) -> Column:
        length = F.when(n == 0, 1.0).otherwise(n)
        return F.transform(v, lambda x: x.cast("double") / length)

    return bind(norm(v), scaled)


def hashed_terms(text: Column, dim: int = 64) -> Column:
    """Term counts in ``dim`` hash buckets, as ``array<float>``.

    Terms are parted at ASCII white space. A batch of texts is counted together: a distinct term is
    hashed once, and one count over (row, bucket) makes all vectors.
    """

    @F.arrow_udf("array<float>")
    def counts(texts: pa.Array) -> pa.Array:
        buckets: dict[bytes, int] = {}
        made = []
        for at in range(0, max(len(texts), 1), 1024):
            part = texts.slice(at, 1024)
            found, sizes = [], np.zeros(len(part), np.int64)
            for i, t in enumerate(part.cast(pa.binary()).to_pylist()):
                terms = t.split() if t else []
                sizes[i] = len(terms)
                for term in terms:
                    bucket = buckets.get(term)
                    if bucket is None:
                        bucket = buckets[term] = int(hashlib.md5(term).hexdigest()[:8], 16) % dim
                    found.append(bucket)
            if len(buckets) > 200_000:
                buckets.clear()
            places = np.repeat(np.arange(len(part)) * dim, sizes) + np.array(found, np.int64)
            values = pa.array(np.bincount(places, minlength=len(part) * dim).astype(np.float32))
            offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * dim)
            made.append(pa.ListArray.from_arrays(offsets, values, mask=part.is_null() if part.null_count else None))
        return pa.concat_arrays(made)

    return counts(text)


# Names of the built-in embedders.
EMBEDDERS: dict[str, Callable[[Column], Column]] = {"hashed_terms": hashed_terms}


def embedder(provider: str | Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Look an embedder up by name, or take the caller's column function or pandas UDF."""
    if callable(provider):
        return provider
    if provider not in EMBEDDERS:
        raise ValueError(f"unknown embedder {provider!r}; known: {sorted(EMBEDDERS)}")
    return EMBEDDERS[provider]
