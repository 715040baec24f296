"""Exact top-k by inner product: columnar branch and bound over blocks.

Vectors become whole numbers, floor(SCALE * x). Candidates are packed into blocks in vertical layout, a row of values for
each dimension. A query accumulates its products one block of dimensions after another. After each, a candidate's score
can't exceed what it has plus the product of the norms of both remainders, so candidates below the query's k-th best so
far are dropped and the rest compacted. The best of each block are merged for each query.

Blocks of candidates are dealt into groups, a unit of work each, and travel once; blocks of queries, the smaller side, go to
every group through an equality join on its number. Both kinds of block are bounded. The scores that queries have with the
BAR_ROWS longest vectors, likely the best, bound their k-th best from below; so all groups prune by a common bar from the
start, and few rows leave a pair of blocks.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of unlike lengths don't
meet. Equal scores go by the smaller vec_id. Rows with the query's own id are no candidates of it. Of query rows with one
id, the smallest vector counts; repeated candidate rows are candidates of their own. Null ids take no part. Empty
vectors score 0. No queries or no candidates give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

SCALE = 256
TOP = 5
EVERY = 50
DIMENSIONS = 16
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 1024
#: Candidates of a group at least; there are no more groups than GROUPS_PER_CORE times the cores.
GROUP_ROWS = 2048
GROUPS_PER_CORE = 8
#: Longest vectors whose scores give each query its first bar: a bound that doesn't grow with the data.
BAR_ROWS = 2048
_BLOCK = "q long, dims int, ids binary, data binary"


def whole(df: DataFrame, vector: str = "embedding", key: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """vec_id and v, the vector in whole numbers; only vectors that take part."""
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(usable).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v"))


def _packed(rows: pd.DataFrame, most: int, q: int) -> Iterator[dict]:
    for dims, same in rows.groupby(rows["v"].map(len)):
        for at in range(0, len(same), most):
            part = same.iloc[at : at + most]
            data = np.array(part["v"].tolist(), dtype=np.int64).reshape(len(part), int(dims))
            kind = np.int16 if np.abs(data).max(initial=0) < 2**15 else np.int64
            # Vertical layout: the values of a dimension stand together.
            yield {"q": q, "dims": int(dims), "ids": part["vec_id"].to_numpy(dtype=np.int64).tobytes(), "data": np.ascontiguousarray(data.T.astype(kind)).tobytes()}


def _unpacked(dims: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block, and its values with a row for each dimension."""
    of = np.frombuffer(ids, np.int64)
    kind = np.int16 if len(data) == 2 * dims * len(of) else np.int64
    return of, np.frombuffer(data, kind).reshape(dims, len(of)).astype(np.int64)


def _pack_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for block in _packed(rows, CANDIDATE_BLOCK, -1):
            yield pd.DataFrame([block])


def _pack_queries(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(list(_packed(rows, QUERY_BLOCK, int(rows["q"].iloc[0]))), columns=["q", "dims", "ids", "data"])


def block_top(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int = TOP, step: int = DIMENSIONS, bars: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """query id, candidate id, score of each query's k best of a block. queries: a row each; data: a row for each dimension.
    bars: a score that each query's k-th best of all blocks has at least; what is below it may be left out."""
    dims = len(data)
    exact = dims * float(np.abs(data).max(initial=0)) * float(np.abs(queries).max(initial=0)) < 2.0**52
    kind = np.float64 if exact else object
    order = np.lexsort((ids, -(data.astype(float) ** 2).sum(0)))  # long vectors first: they raise the bar early
    data, ids = data[:, order].astype(kind), ids[order]
    queries = queries.astype(kind)
    cuts = list(range(0, dims, step)) or [0]
    rest = [np.sqrt((data[c + step :].astype(float) ** 2).sum(0)) for c in cuts]
    own = [np.sqrt((queries[:, c + step :].astype(float) ** 2).sum(1)) for c in cuts]
    out = []
    for i, (query, query_id) in enumerate(zip(queries, query_ids, strict=True)):
        first = (ids != query_id).nonzero()[0][: max(64, 4 * k)]
        sure = query @ data[:, first] if dims else np.zeros(len(first))
        bar = np.partition(sure.astype(float), -k)[-k] if len(first) >= k else -np.inf
        bar = bar if bars is None else max(bar, bars[i])
        at, got = None, None
        for c, far, near in zip(cuts, rest, own, strict=True):
            block = data[c : c + step] if at is None else data[c : c + step, at]
            part = query[c : c + step] @ block if dims else np.zeros(len(ids))
            got = part if got is None else got + part
            left = far if at is None else far[at]
            stays = got.astype(float) + left * near[i] * (1 + 1e-9) + 1e-6 >= bar
            at, got = (np.flatnonzero(stays) if at is None else at[stays]), got[stays]
            if c + step < dims and len(at) >= k:  # what is surely reached raises the bar
                floor = got.astype(float) - far[at] * near[i] * (1 + 1e-9) - 1e-6
                own_row = ids[at] == query_id
                if len(at) - own_row.sum() >= k:
                    bar = max(bar, np.partition(np.where(own_row, -np.inf, floor), -k)[-k])
        keep = ids[at] != query_id
        at, got = at[keep], got[keep]
        best = sorted(zip((-int(x) for x in got), ids[at].tolist(), strict=True))[:k] if len(at) < 512 else [(-int(got[j]), int(ids[at[j]])) for j in np.lexsort((ids[at], -got.astype(float)))[:k]]
        out += [(int(query_id), int(v), -s) for s, v in best]
    return out


def _bars(k: int):
    """Adds to blocks of queries the k-th best score of each with the sample, less than any score where it has fewer."""

    def bars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                ids, data = _unpacked(r.dims, r.ids, r.data)
                bar = np.full(len(ids), -np.inf)
                if r.s_ids is not None:
                    best: dict[int, list[int]] = {}
                    for q, _, score in block_top(data.T, ids, *_unpacked(r.dims, r.s_ids, r.s_data)[::-1], k):
                        best.setdefault(q, []).append(score)
                    bar = np.array([min(best[i]) if len(best.get(i, ())) == k else -np.inf for i in ids.tolist()])
                out.append(bar.tobytes())
            yield rows[["dims", "ids", "data"]].assign(bars=out)

    return bars


def _match(k: int):
    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples(index=False):
                q_ids, queries = _unpacked(r.dims, r.q_ids, r.q_data)
                ids, data = _unpacked(r.dims, r.ids, r.data)
                yield pd.DataFrame(block_top(queries.T, q_ids, data, ids, k, bars=np.frombuffer(r.bars, float)), columns=["query_id", "vec_id", "score"])

    return match


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score from whole vectors (vec_id, v) of both sides."""
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    groups = max(1, min(-(-candidates.count() // GROUP_ROWS), GROUPS_PER_CORE * cores))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    longest = candidates.orderBy(norm.desc(), "vec_id").limit(BAR_ROWS).coalesce(1).mapInPandas(_sample, _BLOCK)
    asked = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).groupBy("q").applyInPandas(_pack_queries, _BLOCK).drop("q")
    sample = longest.select("dims", F.col("ids").alias("s_ids"), F.col("data").alias("s_data"))
    # At most BAR_ROWS vectors, in a block for each length.
    asked = asked.join(F.broadcast(sample), "dims", "left").mapInPandas(_bars(k), "dims int, ids binary, data binary, bars binary")
    asked = asked.select("dims", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "bars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
    packed = candidates.mapInPandas(_pack_candidates, _BLOCK).drop("q")
    # Blocks are numbered as they come, so groups are alike in size; a partition's first goes on where others begin at random.
    number = F.xxhash64(F.spark_partition_id()) + F.monotonically_increasing_id() % (1 << 33)
    dealt = packed.withColumn("g", F.pmod(number, F.lit(groups)))
    # Groups are work, not bytes: so many tasks, whatever the size of their rows.
    pairs = dealt.repartition(groups, "g", "dims").join(asked.repartition(groups, "g", "dims").hint("shuffle_merge"), ["g", "dims"])
    found = pairs.mapInPandas(_match(k), "query_id long, vec_id long, score long")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One block for each length of the vectors of all batches."""
    rows = pd.concat([pd.DataFrame(columns=["vec_id", "v"]), *batches])
    for block in _packed(rows, BAR_ROWS, -1):
        yield pd.DataFrame([block])


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


ORACLE_SQL = """
with e as (
  select vec_id, [floor(256 * x::double)::bigint for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select vec_id, min(v) as v from e where vec_id % 50 = 0 group by vec_id),
s as (
  select q.vec_id as query_id, e.vec_id, coalesce(list_sum([p[1] * p[2] for p in list_zip(q.v, e.v)]), 0)::bigint as score
  from q join e on q.vec_id <> e.vec_id and len(q.v) = len(e.v))
select query_id, rank, vec_id, score from (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s)
where rank <= 5
"""
