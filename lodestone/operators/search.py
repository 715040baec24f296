"""Search: exact vector top-k, keyword scores, fusion, cutoff, reranking, similarity."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C

#: Rows of the store in a block, and queries in a chunk; a task holds one of each.
BLOCK, CHUNK = 16_384, 2_048
#: Scores that a task has at a time.
CELLS = 4_000_000
#: Two products this far apart may still round to the same six places.
_ROUNDING = 1.1e-6


def _by_length(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of each length. What is null or holds nulls has no vector."""
    a = column.combine_chunks()
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    n = np.nan_to_num(a.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1).astype(int)
    flat = a.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float)
    kept = np.maximum(n, 0)
    ends = np.cumsum(kept)
    if flat.null_count:
        gaps = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
        n = np.where(gaps[ends] > gaps[ends - kept], -1, n)
    rows = {int(d): np.flatnonzero(n == d) for d in np.unique(n[n >= 0])}
    return {d: (r, values[(ends - kept)[r][:, None] + np.arange(d)]) for d, r in rows.items()}


def _lengths(n: int, vectors: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The length of each row's vector; -1 where it has none."""
    out = np.full(n, -1)
    for d, (rows, _) in vectors.items():
        out[rows] = d
    return out


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up from the first dimension on as C.dot does."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _millionths(score: np.ndarray) -> np.ndarray:
    """Scores rounded to six places half up, as F.round does."""
    x = score * 1e6
    out = np.rint(x)
    for i in np.flatnonzero(np.abs(x - np.floor(x) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP).scaleb(6))
    return out


def _best_of_block(store: pa.Table, asked: pa.Table, k: int, least: float | None, smooth: float, positive: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of store and of asked, scores and which of them are none: all that may be among the k best of a query within the block."""
    ids = store["vec_id"].to_numpy()
    # One order for both sides' ids, by which ties go.
    place = pd.factorize(np.concatenate([ids, asked["query_id"].to_numpy()]), sort=True)[0]
    place, own = place[: len(ids)], place[len(ids) :]
    found_e, found_q, found_score = [], [], []
    ours, theirs = _by_length(store["embedding"]), _by_length(asked["q"])
    with np.errstate(all="ignore"):
        for dims, (q_rows, q) in theirs.items():
            if dims not in ours:
                continue
            e_rows, e = ours[dims]
            # Of equal vectors only the k + 1 smallest ids can be among the best of a query, which leaves out itself.
            same = pd.Series(np.ascontiguousarray(e).view(f"V{8 * dims}").ravel().tolist() if dims else [b""] * len(e))
            few = pd.Series(place[e_rows]).groupby(pd.factorize(same)[0]).rank("dense").to_numpy() <= k + 1
            e_rows, e = e_rows[few], e[few]
            e_norm, q_norm = np.sqrt(_in_order(e, e)), np.sqrt(_in_order(q, q))
            order = np.argsort(place[e_rows], kind="stable")
            sorted_place = place[e_rows][order]
            step = max(1, CELLS // max(1, len(e)))
            for at in range(0, len(q), step):
                part = slice(at, at + step)
                about = q[part] @ e.T
                shares = about > 0 if positive else None
                about /= np.outer(q_norm[part], e_norm) + smooth
                odd = None if np.isfinite(about.sum()) else ~np.isfinite(about)
                if odd is not None:
                    about[odd] = -np.inf
                first = np.searchsorted(sorted_place, own[q_rows[part]], "left")
                last = np.searchsorted(sorted_place, own[q_rows[part]], "right")
                for i in np.flatnonzero(last > first):
                    about[i, order[first[i] : last[i]]] = -np.inf
                    if odd is not None:
                        odd[i, order[first[i] : last[i]]] = False
                if shares is not None:
                    about[~shares] = -np.inf
                bar = np.partition(about, -k, axis=1)[:, -k] - _ROUNDING if about.shape[1] > k else np.full(len(about), -np.inf)
                if least is not None:
                    bar = np.maximum(bar, least - _ROUNDING)
                keep = (about >= bar[:, None]) & (about > -np.inf)
                if odd is not None:
                    keep |= odd
                i, j = np.nonzero(keep)
                score = _in_order(e[j], q[part][i]) / (e_norm[j] * q_norm[part][i] + smooth)
                found_e.append(e_rows[j])
                found_q.append(q_rows[part][i])
                found_score.append(score)
    none = np.zeros(0, int)
    e_at, q_at = (np.concatenate([*x, none]) for x in (found_e, found_q))
    score = np.concatenate([*found_score, np.zeros(0)])
    absent = np.zeros(len(score), bool)
    if least is None and not positive:
        # Pairs without a score come last; they are wanted where a query has fewer than k others.
        e_length, q_length = (_lengths(n, x) for n, x in ((len(ids), ours), (len(own), theirs)))
        if (e_length != e_length[0]).any() or (q_length != e_length[0]).any() or e_length[0] < 0:
            by_id = np.argsort(place, kind="stable")
            other = lambda i: (e_length[by_id] != q_length[i]) | (e_length[by_id] < 0)
            more = [(row, i) for i in range(len(own)) for row in by_id[other(i) & (place[by_id] != own[i])][:k]]
            e_more, q_more = np.array(more, int).reshape(-1, 2).T
            e_at, q_at = np.concatenate([e_at, e_more]), np.concatenate([q_at, q_more])
            score, absent = np.concatenate([score, np.zeros(len(more))]), np.concatenate([absent, np.ones(len(more), bool)])
    # Spark's order: what is no number first, then down to nulls.
    level = np.where(absent, -np.inf, np.where(np.isnan(score), np.inf, 0))
    level = np.where(level == 0, _millionths(np.where(np.isfinite(score), score, 0)), level)
    infinite = np.isinf(score) & ~absent
    level[infinite] = np.sign(score[infinite]) * 1e300
    order = np.lexsort((place[e_at], -level, q_at))
    q_sorted = q_at[order]
    begin = np.searchsorted(q_sorted, q_sorted, "left")
    order = order[np.arange(len(order)) - begin < k]
    return e_at[order], q_at[order], score[order], absent[order]


def vector_top_k(store: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None, smooth: float = 1e-10, positive: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank and other columns of both: the k nearest of each query by cosine. queries(query_id, q) is a
    stated set. positive: only pairs whose product is above 0. A vector that is null or holds nulls, or has another length, has no score.

    Every pair is compared: the store is dealt into blocks and the queries into chunks of bounded size, a task multiplies one of each and keeps
    what may be among the k best of a query; these are summed up again in the order of their dimensions, and ranked.
    """
    store, queries = store.where(F.col("vec_id").isNotNull()), queries.where(F.col("query_id").isNotNull())
    blocks, chunks = (max(1, -(-df.count() // n)) for df, n in ((store, BLOCK), (queries, CHUNK)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = blocks * chunks
    dealt = store.withColumn("_cell", deal("vec_id", blocks)).withColumn("_chunk", numbers(chunks)).withColumn("_cell", F.col("_cell") * chunks + F.col("_chunk")).drop("_chunk")
    asked = queries.withColumn("_cell", deal("query_id", chunks)).withColumn("_block", numbers(blocks)).withColumn("_cell", F.col("_block") * chunks + F.col("_cell")).drop("_block")
    kept, wanted = [c for c in store.columns if c != "embedding"], [c for c in queries.columns if c != "q"]
    schema = T.StructType([*(store.schema[c] for c in kept), *(queries.schema[c] for c in wanted), T.StructField("score", T.DoubleType())])

    def best(e: pa.Table, q: pa.Table) -> pa.Table:
        if e.num_rows and q.num_rows:
            i, j, score, absent = _best_of_block(e, q, k, least, smooth, positive)
        else:
            i, j, score, absent = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, bool)
        out = {**{c: e[c].take(pa.array(i)) for c in kept}, **{c: q[c].take(pa.array(j)) for c in wanted}}
        return pa.table({**out, "score": pa.array(score, pa.float64(), mask=absent)})

    # As many partitions as cells: adaptive execution would put small cells, whose work is in their product, into one task.
    found = dealt.repartition(cells, "_cell").groupBy("_cell").cogroup(asked.repartition(cells, "_cell").groupBy("_cell")).applyInArrow(best, schema)
    scored = found.withColumn("score", F.round("score", 6))
    if least is not None:
        scored = scored.where(F.col("score") >= least)
    over = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def keyword_scores(units: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """units with score: for each keyword its whole-word hits, else 0.5 for a part of a word; over the number of keywords."""
    total = F.lit(0.0)
    for w in keywords:
        hits = F.regexp_count(F.lower("code"), F.lit(rf"(?<![A-Za-z0-9_]){w.lower()}(?![A-Za-z0-9_])"))
        total = total + F.when(hits > 0, hits.cast("double")).when(F.contains(F.lower("code"), F.lit(w.lower())), 0.5).otherwise(0.0)
    return units.withColumn("score", F.round(total / len(keywords), 6)).where("score > 0")


def top(rows: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The k best in a total order with their ranks from 0."""
    best = rows.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)) - 1)


def rrf(vector: DataFrame, keyword: DataFrame, key: str, k: int = 60, weights: tuple[float, float] = (1.0, 0.8)) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (key, rank from 0): score, source, rank."""
    arms = [rows.select(key, (F.lit(w) / (k + F.col("rank"))).alias("s"), F.lit(name).alias("source")) for rows, w, name in ((vector, weights[0], "vector"), (keyword, weights[1], "keyword"))]
    fused = arms[0].unionByName(arms[1]).groupBy(key).agg(F.round(F.sum("s"), 9).alias("score"), F.when(F.count_distinct("source") > 1, "both").otherwise(F.min("source")).alias("source"))
    return fused.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)) - 1)


def smart_cutoff(ranked: DataFrame, key: str, floor: float = 0.3, ratio: float = 0.7, delta: float = 0.2, min_k: int = 3, max_k: int = 20) -> DataFrame:
    """The prefix of a ranked list that stands out. A top below floor leaves only itself; else rows go on while they reach
    max(floor, min(ratio * top, top - delta)), the first min_k while they reach floor."""
    order = Window.orderBy(F.desc("score"), key)
    rows = ranked.withColumn("place", F.row_number().over(order)).withColumn("top", F.max("score").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    bar = F.greatest(F.lit(floor), F.least(F.lit(ratio) * F.col("top"), F.col("top") - delta))
    passes = F.when(F.col("place") <= min_k, F.col("score") >= floor).otherwise(F.col("score") >= bar)
    rows = rows.withColumn("ok", F.when(F.col("top") < floor, F.col("place") == 1).otherwise(passes))
    kept = rows.withColumn("so_far", F.min("ok").over(order)).where(F.col("so_far") & (F.col("place") <= max_k))
    return kept.drop("place", "top", "ok", "so_far")


def rerank(rows: DataFrame, weights: Sequence[float], boost: float, boost_from: float, key: str, limit: int) -> DataFrame:
    """The limit best by weighted vector, keyword, security and context scores, boosted where security is above boost_from."""
    v, k, s, c = weights
    score = F.lit(v) * F.col("vector") + F.lit(k) * F.col("keyword") + F.lit(s) * F.col("security") + F.lit(c) * F.col("context")
    scored = rows.withColumn("score", F.round(F.when(F.col("security") > boost_from, score * boost).otherwise(score), 6))
    return top(scored, limit, key).withColumn("rank", F.col("rank") + 1)


def blended_rerank(local: DataFrame, remote: Column, key: str, limit: int, weights: tuple[float, float] = (0.3, 0.7)) -> DataFrame:
    """key, score, rank of the limit best of a local ranking, cut to twice the limit, whose scores are blended with a second model's;
    where that gave none the local score stands."""
    first = top(local, 2 * limit, key)
    blend = F.coalesce(F.lit(weights[0]) * F.col("score") + F.lit(weights[1]) * remote, F.col("score"))
    return top(first.withColumn("score", F.round(blend, 6)), limit, key).withColumn("rank", F.col("rank") + 1).select(key, "score", "rank")


def best_by_location(rows: DataFrame, location: Sequence[str], score: str, seq: str) -> DataFrame:
    """The best score of each location, the first of equals."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*location).orderBy(F.desc(score), seq))).where("place = 1").drop("place")


def similar_pairs(vectors: DataFrame, least: float, bands: int = 1) -> DataFrame:
    """a, b, score of pairs at or above a cosine, exactly. Each vector has a length of projections on fixed directions; for unit
    vectors a distance bound follows from the cosine, so pairs lie in the same or neighbouring cells of the first direction."""
    width = (2 - 2 * least) ** 0.5
    unit = vectors.withColumn("norm", C.norm("embedding")).where("norm > 0").withColumn("e", F.transform("embedding", lambda x: x.cast("double") / F.col("norm")))
    # The first direction: the mean difference of halves, a unit vector of equal parts.
    n = F.size("e")
    along = F.aggregate(F.transform("e", lambda x, i: F.when(i % 2 == 0, x).otherwise(-x)), F.lit(0.0), lambda t, x: t + x) / F.sqrt(n)
    cells = unit.select("vec_id", "e", F.floor(along / F.lit(width)).cast("long").alias("cell"))
    a = cells.select(F.col("vec_id").alias("a"), F.col("e").alias("ea"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    b = cells.select(F.col("vec_id").alias("b"), F.col("e").alias("eb"), "cell")
    return a.join(b, "cell").where("a < b").withColumn("score", F.round(C.dot("ea", "eb"), 6)).where(F.col("score") >= least).select("a", "b", "score")
