"""Exact nearest neighbours of binary codes by incremental multi-index hashing.

A code of 64 bits is split into segments, and every segment has a table from its
value to the codes that have it.  A query looks up, segment by segment, all
values within a growing radius of its own.  Codes that no segment has reached
within radius ``r`` differ from the query by at least ``m (r + 1)`` bits, so a
query is done once its k-th verified distance is below that.

Equal codes are one entry of the index with its ``k`` smallest ids, so a vector
that a third of all rows have is met once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize

BITS, SEGMENTS = 64, 4
K = 10
#: Queries are the rows whose id this number divides.
QUERY_EVERY = 50
#: Parts into which the rows of one code are dealt when its smallest ids are sought.
SALT = 64


def codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, code)``: bit ``i`` of the code is set where element ``i`` is above 0.

    Elements beyond the 64th are left out of the code; missing and null ones
    count as 0.  Rows without a vector or an id have no code and are dropped.
    """
    bits = [F.when(F.get(F.col(vector_col), F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    code = bits[0]
    for b in bits[1:]:
        code = code.bitwiseOR(b)
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), code.alias("code"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def smallest_ids(coded: DataFrame, k: int) -> DataFrame:
    """``(code, n, ids)`` with the ``k`` smallest ids of each code, in order: first in parts, then over what the parts have left."""
    part = Window.partitionBy("code", "part").orderBy("id")
    some = coded.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALT))).withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("id"))).filter(F.col("rank") <= k)
    return best.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k each


def _masks(width: int, radius: int) -> np.ndarray:
    """All values of ``width`` bits with exactly ``radius`` set."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], np.int64)


def _probes(queries: DataFrame, radius: int) -> DataFrame:
    """``(qid, qcode, seg, value)``: the values at exactly ``radius`` bits from a query's segments."""
    width = BITS // SEGMENTS
    masks = _masks(width, radius)

    def run(batch: pa.RecordBatch) -> pa.Table:
        code = batch.column(1).to_numpy().view(np.uint64)
        out = []
        for lo in range(0, len(code), 256):
            c = code[lo : lo + 256]
            rows = pa.array(np.repeat(np.arange(lo, lo + len(c)), len(masks)))
            for seg in range(SEGMENTS):
                own = ((c >> np.uint64(width * seg)) & np.uint64((1 << width) - 1)).astype(np.int64)
                value = (own[:, None] ^ masks[None]).ravel()
                out.append(pa.record_batch({"qid": batch.column(0).take(rows), "qcode": batch.column(1).take(rows), "seg": pa.array(np.full(len(value), seg, np.int32)), "value": pa.array(value)}))
        return pa.Table.from_batches(out) if out else None

    kind = queries.schema["qid"].dataType.simpleString()
    return map_arrow(queries.select("qid", "qcode"), run, f"qid {kind}, qcode long, seg int, value long")


def search(queries: DataFrame, vectors: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` nearest rows of each query, both as ``(id, code)``; ties go to the smaller id.

    Returns ``query_id, rank, neighbor_id, distance``.  A query that is itself in
    ``vectors`` finds itself.  Defined cases: repeated rows of one id count each,
    as ranks of their own; with fewer than ``k`` rows all are returned; empty
    tables give an empty one.
    """
    width = BITS // SEGMENTS
    entries = materialize(smallest_ids(vectors, k), "codes")
    index = entries.select("code", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), F.shiftrightunsigned("code", width * s).bitwiseAND(F.lit((1 << width) - 1)).alias("value")) for s in range(SEGMENTS)])).alias("at")).select("code", "at.seg", "at.value")
    index = materialize(index, "segments")
    waiting = materialize(queries.select(F.col("id").alias("qid"), F.col("code").alias("qcode")).distinct(), "queries")
    total = entries.count()
    found, done = None, None
    for radius in range(width + 1):
        # the planner can't see how many rows probing makes, so it must not take them for a small side
        met = _probes(waiting.repartition("qid"), radius).hint("merge").join(index.hint("merge"), ["seg", "value"]).select("qid", "qcode", "code")
        new = met.distinct().withColumn("distance", distance(F.col("qcode"), F.col("code")))
        if found is not None:
            new = new.unionByName(found.join(waiting.select("qid"), "qid", "left_semi")).distinct()
        # each code stands for up to k ids: a query needs its k nearest codes at most
        nearest = Window.partitionBy("qid").orderBy("distance", "code")
        ranked = new.withColumn("r", F.row_number().over(nearest))
        # codes at the distance of the k-th stay, so that ties can go to the smaller id
        limit = F.max(F.when(F.col("r") == k, F.col("distance"))).over(Window.partitionBy("qid"))
        found = materialize(ranked.withColumn("limit", limit).filter(F.col("limit").isNull() | (F.col("distance") <= F.col("limit"))).select("qid", "qcode", "code", "distance"), "found")
        kth = _rows(found, entries, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst"))
        seen = found.groupBy("qid").agg(F.countDistinct("code").alias("codes"))
        state = waiting.join(kth, waiting.qid == kth.query_id, "left").join(seen, "qid", "left")
        covered = (F.col("n") >= k) & (F.col("worst") < SEGMENTS * (radius + 1)) | (F.coalesce("codes", F.lit(0)) >= total)
        state = materialize(state.select("qid", "qcode", F.coalesce(covered, F.lit(False)).alias("covered")), "state")
        finished = found.join(state.filter("covered").select("qid"), "qid", "left_semi")
        done = finished if done is None else done.unionByName(finished)
        waiting = state.filter("not covered").select("qid", "qcode")
        if not waiting.limit(1).count():
            break
    else:
        done = done.unionByName(found.join(waiting.select("qid"), "qid", "left_semi"))
    return _rows(done, entries, k)


def _rows(found: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query from its codes."""
    rows = found.join(entries, "code").select(F.col("qid").alias("query_id"), F.explode("ids").alias("neighbor_id"), "distance")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def search_table(vectors: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Every row whose id is divisible by ``QUERY_EVERY``, against all rows."""
    coded = materialize(codes(vectors, id_col, vector_col), "coded")
    return search(coded.filter(F.col("id") % QUERY_EVERY == 0), coded, k)


ORACLE_SQL = """
WITH c AS (
  SELECT vec_id, list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN 1 ELSE 0 END) AS bits
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
         list_sum(list_transform(range(64), lambda i: CASE WHEN q.bits[i + 1] <> v.bits[i + 1] THEN 1 ELSE 0 END))::INTEGER AS distance
  FROM c q, c v WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""
