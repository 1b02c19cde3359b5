"""Exact vector search: cosine scores of query vectors against all vectors, in blocks, best k a query.

Both sides are packed into blocks of BLOCK vectors of one length; a pair of blocks is one matrix product, of
which only the best k a query leave the task; these partial lists are ranked once more. Vectors of different
length are compared over the shorter one, a zero norm scores 0, null vectors are left out, empty ones score 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 2048


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two array<double> columns within the JVM, over the shorter length."""
    x, y = (F.col(a) if isinstance(a, str) else a), (F.col(b) if isinstance(b, str) else b)
    n = F.least(F.size(x), F.size(y))
    x, y = F.slice(x, F.lit(1), F.greatest(n, F.lit(0))), F.slice(y, F.lit(1), F.greatest(n, F.lit(0)))
    total = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    xx, yy = total(x, x), total(y, y)
    return F.when((n <= 0) | (xx <= 0) | (yy <= 0), F.lit(0.0)).otherwise(total(x, y) / (F.sqrt(xx) * F.sqrt(yy)))


_PACKED = pa.schema([("ids", pa.list_(pa.int64())), ("size", pa.int32()), ("data", pa.binary())])


def _pack(batches):
    held: dict[int, tuple[list, list]] = {}
    rows: list[tuple] = []

    def emit(size: int) -> None:
        ids, vectors = held.pop(size)
        rows.append((ids, size, np.array(vectors, dtype=np.float64).reshape(len(ids), size).tobytes()))

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 3, _PACKED, strict=True)], schema=_PACKED)
        rows.clear()
        return out

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, vectors = held.setdefault(len(v), ([], []))
            ids.append(i)
            vectors.append([0.0 if x is None else x for x in v])
            if len(ids) == BLOCK:
                emit(len(v))
        yield batch_of()
    for size in list(held):
        emit(size)
    yield batch_of()


def _blocks(df: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    packed = df.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(_pack, "ids array<long>, size int, data binary")
    return packed.select(*[F.col(c).alias(prefix + c) for c in ("ids", "size", "data")])


_BEST = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _best(k: int):
    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for q_ids, q_size, q_data, ids, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = min(q_size, size)
                q = np.frombuffer(q_data, dtype=np.float64).reshape(len(q_ids), q_size)[:, :n]
                v = np.frombuffer(data, dtype=np.float64).reshape(len(ids), size)[:, :n]
                norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1))[None, :]
                scores = np.divide(q @ v.T, norms, out=np.zeros_like(norms), where=norms > 0)
                key = np.array(ids)
                for row, one in enumerate(q_ids):
                    order = np.lexsort((key, -np.round(scores[row], 12)))[:k]
                    out[0].extend([one] * len(order))
                    out[1].extend(key[order].tolist())
                    out[2].extend(scores[row][order].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _BEST, strict=True)], schema=_BEST)

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, vec_id, score, rank: the k best vectors of each query, ties to the smaller id; a query's own vector counts."""
    pairs = _blocks(queries, key, vector, "q_").crossJoin(_blocks(vectors, key, vector, "v_"))
    partial = pairs.mapInArrow(_best(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)
