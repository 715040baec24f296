"""All pairs of vectors at or above a cosine, exactly, with few pairs compared in full.

* Unit vectors at cosine c are sqrt(2 - 2c) apart, so their distances to any pivot differ by no more than that. Vectors are ordered by their
  nearest pivot and cut into groups and tiles, which know the range of their distances to all pivots; what is too far apart doesn't meet.
* Tiles that meet are multiplied a block of dimensions at a time. After each, a pair can't exceed what it has plus the product of the norms of
  both remainders (Cauchy and Schwarz); those below the cosine go. The dimensions are rotated first, so that the early ones hold most.

A task holds two groups; a group travels once for each that it may meet, as its vectors were given: units and rotation are made again where it
arrives. There are GROUPS groups, so what travels grows with the rows, until a group has MOST rows. Pivots and rotation come from a bounded sample:
they bear on the work, never on the result. Ranges of groups go to all tasks: PIVOTS numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..sources.scratch import stored

PIVOTS = 12
#: Rows of the sample for pivots and rotation.
SAMPLE = 2000
GROUP, TILE = 4096, 128
#: Groups, if they have GROUP rows at least and MOST at most.
GROUPS, MOST = 24, 65_536
#: Dimensions of a block.
BLOCK = 8
_PACKED = "g int, ids binary, norms binary, given binary, low binary, high binary"


def usable_vectors(df: DataFrame) -> DataFrame:
    """vec_id, x, norm: vectors as floats or doubles; what is null, holds nulls or isn't finite, or has no length, is left out."""
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    x = F.col("embedding") if df.schema["embedding"].dataType.elementType == T.FloatType() else F.col("embedding").cast("array<double>")
    return df.where(usable).withColumn("norm", C.norm("embedding")).where("norm > 0").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), "norm")


def group_count(rows: int, least: int = GROUP, most: int = MOST) -> int:
    """In how many groups so many rows are compared."""
    return max(1, min(GROUPS, -(-rows // least)), -(-rows // most))


def spread_pivots(vectors: np.ndarray, most: int = PIVOTS) -> np.ndarray:
    """Vectors far from one another: each the farthest from those before it."""
    chosen = [vectors[0]]
    far = np.linalg.norm(vectors - chosen[0], axis=1)
    while len(chosen) < most and far.max() > 1e-9:
        chosen.append(vectors[int(far.argmax())])
        far = np.minimum(far, np.linalg.norm(vectors - chosen[-1], axis=1))
    return np.array(chosen)


def _distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * vectors @ pivots.T))


def _apart(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """How far ranges of distances are apart, at the pivot that tells most; less than 0 where all overlap."""
    return np.maximum(low - other_high, other_low - high).max(-1)


def above(a: np.ndarray, b: np.ndarray, least: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, int]:
    """i, j of rows of a and b whose product may reach least, and how many pairs were multiplied in full. Rows are unit vectors."""
    dims = a.shape[1]
    slack = 1e-9
    rest = [[np.sqrt(np.maximum(0, (x[:, c:] ** 2).sum(1))) for c in range(0, dims + block, block)] for x in (a, b)]
    i = j = got = None
    for k, c in enumerate(range(0, dims, block)):
        if got is None:
            part = a[:, : c + block] @ b[:, : c + block].T
            keep = part + np.outer(rest[0][k + 1], rest[1][k + 1]) >= least - slack
            if keep.sum() * 4 < keep.size or c + block >= dims:  # few are left: go on with these alone
                i, j = np.nonzero(keep)
                got = part[i, j]
        else:
            if c + block >= dims:
                full = len(i)
            got = got + np.einsum("ij,ij->i", a[i, c : c + block], b[j, c : c + block])
            keep = got + rest[0][k + 1][i] * rest[1][k + 1][j] >= least - slack
            i, j, got = i[keep], j[keep], got[keep]
            if c + block >= dims:
                return i, j, full
    return (i, j, a.shape[0] * b.shape[0]) if i is not None else (np.zeros(0, int), np.zeros(0, int), 0)


class Tiles:
    """The rows of a group in tiles, with their ranges."""

    def __init__(self, rows: pd.DataFrame, dims: int, pivots: int, turn: np.ndarray, kind: type):
        read = lambda b, n, kind=float: np.frombuffer(b, kind).reshape(-1, n)
        self.ids = [np.frombuffer(b, np.int64) for b in rows["ids"]]
        self.plain = [read(x, dims, kind).astype(float) / read(n, 1) for x, n in zip(rows["given"], rows["norms"], strict=True)]
        self.turned = [e @ turn for e in self.plain]
        self.low, self.high = (np.concatenate([read(b, pivots) for b in rows[c]]) for c in ("low", "high"))


def compare(a: Tiles, b: Tiles | None, least: float, radius: float) -> tuple[list[tuple[int, int, float]], int]:
    """Pairs of a group with another, or with itself; and how many were multiplied in full."""
    out, full = [], 0
    other = b or a
    for x in range(len(a.ids)):
        near = np.flatnonzero(_apart(a.low[x], a.high[x], other.low, other.high) <= radius + 1e-6)
        for y in near[near >= x] if b is None else near:
            i, j, n = above(a.turned[x], other.turned[y], least)
            full += n
            if b is None and x == y:
                i, j = i[i < j], j[i < j]
            score = np.einsum("ij,ij->i", a.plain[x][i], other.plain[y][j]) if len(i) else np.zeros(0)
            out += zip(np.minimum(a.ids[x][i], other.ids[y][j]).tolist(), np.maximum(a.ids[x][i], other.ids[y][j]).tolist(), score.tolist(), strict=True)
    return out, full


def similar_pairs(vectors: DataFrame, least: float, group: int = GROUP, tile: int = TILE) -> DataFrame:
    """a, b, score of each pair of vectors(vec_id, embedding) whose cosine, rounded to six places, is least or more; a < b. Vectors of other lengths
    than most don't meet them: each length is a run of its own. Rows with one id are no pair."""
    given = stored(usable_vectors(vectors))
    lengths = [r["n"] for r in given.select(F.size("x").alias("n")).distinct().collect()]
    found = [_pairs(given.where(F.size("x") == n), n, least, group, tile) for n in sorted(lengths)]
    empty = vectors.sparkSession.createDataFrame([], "a long, b long, score double")
    for f in found:
        empty = empty.unionByName(f)
    return empty


def _units(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["x"].tolist(), float) / rows["norm"].to_numpy()[:, None]


def _pairs(given: DataFrame, dims: int, least: float, group: int, tile: int) -> DataFrame:
    kind = np.float32 if given.schema["x"].dataType.elementType == T.FloatType() else np.float64
    sample = np.array([[x / r["norm"] for x in r["x"]] for r in given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()])
    pivots = spread_pivots(sample)
    turn = np.linalg.eigh(sample.T @ sample)[1][:, ::-1]
    radius = float(np.sqrt(max(0.0, 2 - 2 * (least - 1e-6))))
    groups = group_count(given.count(), group)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                d = _distances(_units(rows), pivots)
                yield rows.assign(home=d.argmin(1), d=d.min(1))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(0, len(rows), tile):
                part = rows.iloc[at : at + tile]
                d = _distances(_units(part), pivots)
                yield pd.DataFrame([{"g": part["g"].iloc[0], "ids": part["vec_id"].to_numpy(np.int64).tobytes(), "norms": part["norm"].to_numpy(float).tobytes(), "given": np.array(part["x"].tolist(), kind).tobytes(), "low": d.min(0).tobytes(), "high": d.max(0).tobytes()}])

    # Ordered by pivot and distance; the id spreads equal vectors over groups.
    placed = given.mapInPandas(place, f"vec_id long, x {given.schema['x'].dataType.simpleString()}, norm double, home int, d double").repartitionByRange(groups, "home", "d", "vec_id").sortWithinPartitions("home", "d", "vec_id")
    packed = stored(placed.withColumn("g", F.spark_partition_id()).mapInPandas(pack, _PACKED))

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for g, of in rows.groupby("g"):
                t = [np.array([np.frombuffer(b) for b in of[c]]) for c in ("low", "high")]
                yield pd.DataFrame([{"g": g, "low": t[0].min(0).tolist(), "high": t[1].max(0).tolist()}])

    many = len(pivots)
    bounds = packed.select("g", "low", "high").mapInPandas(ranges, "g int, low array<double>, high array<double>").groupBy("g")
    rows = bounds.agg(*(F.min(F.col("low")[k]).alias(f"l{k}") for k in range(many)), *(F.max(F.col("high")[k]).alias(f"h{k}") for k in range(many))).orderBy("g").collect()
    numbers = np.array([r["g"] for r in rows])
    low, high = (np.array([[r[f"{s}{k}"] for k in range(many)] for r in rows]).reshape(len(rows), many) for s in "lh")

    def meetings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A tile for each pair of groups in which its own stands and which may hold a pair."""
        for tiles in batches:
            for g, of in tiles.groupby("g"):
                me = int(np.searchsorted(numbers, g))
                for h in numbers[_apart(low[me], high[me], low, high) <= radius + 1e-6]:
                    yield of.assign(x=min(g, h), y=max(g, h))

    dealt = packed.mapInPandas(meetings, f"{_PACKED}, x int, y int")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
        a = Tiles(rows[rows["g"] == x], dims, many, turn, kind)
        b = None if x == y else Tiles(rows[rows["g"] == y], dims, many, turn, kind)
        pairs, _ = compare(a, b, least - 1e-6, radius)
        return pd.DataFrame(pairs, columns=["a", "b", "score"]).astype({"a": "int64", "b": "int64", "score": float})

    # As many parts as meetings: adaptive execution would merge them by their bytes, which tell little of the work.
    found = dealt.repartition(groups * (groups + 1) // 2, "x", "y").groupBy("x", "y").applyInPandas(meet, "a long, b long, score double")
    return found.withColumn("score", F.round("score", 6)).where((F.col("score") >= least) & (F.col("a") < F.col("b")))
