"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry, found by annular norm pruning.

A vector is cut into PARTS equal parts, and each part's place has a codebook of ENTRIES entries. To assign a part, the entries
are sorted by their norms. The entries next to the part's norm give a first distance; by the triangle inequality an entry at most
that far has a norm that differs by no more than it, so two binary searches bound an interval of norms, and only the entries in
that annulus, ends included, are evaluated, in whole numbers. The bound is widened for the rounding of the norms only.

A round is one pass: tasks assign their vectors and send a sum and a count for each entry and component, which Spark adds up.
So the driver holds the codebooks, whose size is that of ENTRIES vectors, and no task gathers vectors. Sums by label are joined
back with frequent labels broadcast, at most a thousand of them.

Defined cases: vectors that are null, hold null or non-finite components, or components that as whole numbers don't fit a long,
are dropped; so are those of another length than the first seed's. Where the length isn't a multiple of PARTS, part p ends at the
component floor((p + 1) * length / PARTS). Seeds go by vec_id, equal ones by vector, null ids last; fewer vectors than ENTRIES give
fewer entries. Repeated rows are rows of their own. Sums are exact; an error that doesn't fit a long is null. An empty table gives
no rows. Only vec_id, embedding and label are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_by_key, stored, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Components below this in size have squared distances that fit 64 bits for parts of up to 32 components; others take Python's integers.
SMALL = 1 << 28
#: Parts that are compared at once.
ROWS = 4096
CODED = "vec_id long, label string, code string, error long"


def usable(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (the vector as doubles) and label as text of the vectors that take part."""
    fits = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < float(2**62)))
    return df.where(F.col("embedding").isNotNull() & fits).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where squares of differences fit, else as Python's."""
    floors = np.floor(scale * values)
    if np.abs(floors).max(initial=0) < SMALL:
        return floors.astype(np.int64)
    return np.array([int(x) for x in floors.ravel()], dtype=object).reshape(floors.shape)


def cuts(length: int, parts: int = PARTS) -> list[int]:
    return [p * length // parts for p in range(parts + 1)]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(1)


class Codebook:
    """The entries of a part's place, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        norms = np.sqrt((entries.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], entries[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row; of equally near ones, the lower index."""
        small = x.dtype != object and self.sorted.dtype != object and x.shape[1] <= 32
        if not small:
            x, entries = x.astype(object), self.sorted.astype(object)
        else:
            entries = self.sorted
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        after = np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)
        known = np.minimum(_distances(x, entries[after]), _distances(x, entries[np.maximum(after - 1, 0)]))
        reach = np.sqrt(known.astype(float))
        reach += 1e-9 * (reach + norm) + 1e-6
        low, high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        n = high - low
        first = np.cumsum(n) - n
        row = np.repeat(np.arange(len(x)), n)
        entry = np.arange(len(row)) - first[row] + low[row]
        found = _distances(x[row], entries[entry])
        best = np.minimum.reduceat(found, first) if len(x) else found
        index = np.minimum.reduceat(np.where(found == best[row], self.order[entry], len(self.order)), first) if len(x) else self.order[:0]
        return index.astype(np.int64), best


def _vectors(batch: pa.RecordBatch, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The batch in slices of ROWS with their vectors as whole numbers."""
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield part, whole(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, length))


def _sums(books: list[np.ndarray], length: int):
    """A task's sum and count for each part, entry and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cuts(length)
        ready = [Codebook(b) for b in books]
        total = [np.zeros(b.shape, dtype=object) for b in books]
        count = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for _, x in _vectors(batch, length):
                for p, book in enumerate(ready):
                    own = x[:, at[p] : at[p + 1]]
                    index, _ = book.nearest(own)
                    count[p] += np.bincount(index, minlength=len(count[p]))
                    for k in np.unique(index):
                        total[p][k] += own[index == k].sum(0)
        rows = [(p, k, i, str(int(total[p][k][i])), int(count[p][k])) for p in range(len(books)) for k in range(len(books[p])) if count[p][k] for i in range(books[p].shape[1])]
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "place", "total", "n"), r, strict=True)) for r in rows], schema=pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.string()), ("n", pa.int64())]))

    return run


def _codes(books: list[np.ndarray], length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cuts(length)
        ready = [Codebook(b) for b in books]
        for batch in batches:
            for part, x in _vectors(batch, length):
                found = [book.nearest(x[:, at[p] : at[p + 1]]) for p, book in enumerate(ready)]
                codes = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                errors = sum(f[1].astype(object) for f in found)
                yield pa.record_batch([part.column("vec_id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def codebooks(rows: DataFrame, seeds: list[list[float]], rounds: int = ROUNDS, parts: int = PARTS) -> list[np.ndarray]:
    """The final codebook of each part, from the seeds. rows(v) must all have the seeds' length."""
    length = len(seeds[0])
    at = cuts(length, parts)
    first = whole(np.array(seeds, dtype=float).reshape(len(seeds), length))
    books = [first[:, at[p] : at[p + 1]] for p in range(parts)]
    for _ in range(rounds):
        sums = rows.select("v").mapInArrow(_sums(books, length), "part int, entry int, place int, total string, n long")
        # A row for each component of each entry: the size of the codebooks.
        new = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
        books = [b.astype(object) for b in books]
        for r in new:
            books[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = [whole_book(b) for b in books]
    return books


def whole_book(entries: np.ndarray) -> np.ndarray:
    """A codebook in 64-bit integers where they are exact."""
    return entries.astype(np.int64) if all(abs(x) < SMALL for x in entries.ravel()) else entries


def digest(books: list[np.ndarray]) -> str:
    """The SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, label (as text), code, error, label_error, codebooks_sha256 of embeddings(vec_id, embedding, label)."""
    rows = usable(embeddings)
    seed = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(1).collect()
    if not seed:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    length = len(seed[0]["v"])
    rows = rows.where(F.size("v") == length)
    seeds = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    books = codebooks(rows, seeds, rounds)
    coded = stored(rows.mapInArrow(_codes(books, length), CODED)).withColumns({"unlabelled": F.col("label").isNull(), "named": F.coalesce("label", F.lit(""))})
    by_label = coded.groupBy("unlabelled", "named").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    return joined_by_key(coded, by_label, "unlabelled", "named").select("vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def _round_sql(n: int) -> str:
    """A round: assignment by a{n}, and the codebooks c{n + 1} that follow."""
    return f"""
d{n} as materialized (
  select r, part, label, min({{'d': d, 'k': k}}) as best from (
    select e.r, e.part, e.label, c.k, coalesce(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(e.x, c.x)]), 0)::bigint as d from p e join c{n} c on e.part = c.part)
  group by r, part, label),
s{n} as materialized (
  select part, k, i, sum(x)::bigint as s, count(*)::bigint as m from (
    select p.part, d.best.k as k, unnest(range(1, len(p.x) + 1)) as i, unnest(p.x) as x from p join d{n} d on p.r = d.r and p.part = d.part)
  group by all),
c{n + 1} as materialized (
  select c.part, c.k, coalesce(u.x, c.x) as x from c{n} c left join (
    select part, k, list((s - ((s % m) + m) % m) // m order by i) as x from s{n} group by part, k) u on c.part = u.part and c.k = u.k)"""


ORACLE_SQL = f"""
with e as materialized (
  select row_number() over (order by vec_id nulls last, v) as r, * from (
    select vec_id, label, [floor({SCALE} * x::double)::bigint for x in embedding] as v from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)),
p as materialized (select r, label, part, v[part * (len(v) // {PARTS}) + 1 : (part + 1) * (len(v) // {PARTS})] as x from e, (select unnest(range({PARTS})) as part)),
c0 as materialized (select part, r - 1 as k, x from p where r <= {ENTRIES}),{','.join(_round_sql(n) for n in range(ROUNDS))},
last as (
  select r, label, string_agg(printf('%02x', best.k), '' order by part) as code, sum(best.d)::bigint as error from (
    select r, part, label, min({{'d': d, 'k': k}}) as best from (
      select e.r, e.part, e.label, c.k, coalesce(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(e.x, c.x)]), 0)::bigint as d from p e join c{ROUNDS} c on e.part = c.part)
    group by r, part, label)
  group by r, label),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, k)) as digest from c{ROUNDS})
select e.vec_id, l.code, l.error, (sum(l.error) over (partition by l.label))::bigint as label_error, h.digest as codebooks_sha256
from last l join e on e.r = l.r, h
"""
