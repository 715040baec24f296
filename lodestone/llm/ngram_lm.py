"""An interpolated modified Kneser-Ney trigram model, counted in Spark, kept as sorted hash arrays, memory-mapped by the workers that score.

Fitting is four shuffles of packed arrays, none of them of texts or of a row for each n-gram:

1. words: tasks count the hashes of their words; shards by hash add up and number the words, frequent ones low;
2. trigrams: tasks count triples of numbers; shards by the hash of the first two words add up, and write the counts of trigrams and what the
   interpolation needs of each context: its total, and how many words follow it once, twice, and more often;
3. pairs: shards by the hash of a pair add up in how many trigrams it is the end (its continuation count);
4. words again: in how many pairs each is the end, and the same about it as a context.

A shard is a file in the folder that spark.checkpoint.dir names: the entries sorted by hash within buckets of about eight, 32 bits of each
beyond the bucket, a byte for its count, and larger counts exactly in a list beside. So an n-gram takes some five bytes, a lookup that should
fail succeeds once in 2**29, and the files grow with the corpus: every n-gram is kept, none is pruned. Workers map the files of the shards that
they need; a batch's queries are sorted, so that shards are read one after another and in order. Tasks write a shard under another name and
rename it, so a task that runs again leaves the same file. The folder must be one that all machines mount: on a store without paths fit()
raises ValueError.

p(w | u v) = (c - D(c)) / total(u v) + rest(u v) * p(w | v), with counts c of trigrams above and continuation counts below; the rest is the
mass that the discounts D(1), D(2), D(3 and more) take, which follow from how many counts are 1 to 4 (Chen and Goodman), for each order. The
last step is uniform over all words, the end, and one unknown word. Texts begin with two marks that are never predicted and end with one that
is. Where an order has no counts of 1 to 4, its discounts are .5, 1 and 1.5.

Skew: what tasks send is added up before, so a frequent n-gram is one entry of each; a frequent word isn't a shard, as contexts are dealt by
both their words. Shards have about SHARD_BYTES of text, whatever their number.

Defined cases: null and empty texts have one token, the end. A null doc_id isn't held out. Repeated rows count again. Very long texts are gone
through in parts. Without training texts every probability is 1. Vocabularies of up to 2**32 words. Other columns aren't read.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import drop_stored, fresh, give_back, shared_folder, stored, table

HELD_OUT, OF = 2, 7
#: Text of a shard; and of what a worker looks at at once.
SHARD_BYTES = 16_000_000
SLICE_BYTES = 1_000_000
#: Trigrams that a task adds up before it sends them.
GATHERED = 1_000_000
BEGIN, END, UNKNOWN = 0, 1, 2**32 - 1
#: Files that a worker holds open.
OPEN_FILES = 600
U64, U32, U8 = np.uint64, np.uint32, np.uint8
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_UPPER = np.arange(256, dtype=U8) + 32 * np.isin(np.arange(256), range(65, 91)).astype(U8)


def mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads them."""
    x = x.astype(U64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> U64(shift))) * U64(factor)
    return x ^ (x >> U64(31))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=U64) * U64(_BASE))
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse, for n places at least."""
    if len(_POWERS[0]) < n:
        size = 1 << n.bit_length()
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of the texts that lie behind one another in data, in lower case A-Z, and the words of each text."""
    n = len(data)
    counts = np.zeros(len(ends), np.int64)
    if not n:
        return np.zeros(0, U64), counts
    white = _WHITE[data]
    first = np.zeros(n + 1, bool)
    first[ends] = True  # a text ends, another begins
    before, behind = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, white[:-1] | first[1:n]
    behind[:-1], behind[-1] = before[1:] | white[1:], True
    start, stop = np.flatnonzero(~white & before), np.flatnonzero(~white & behind) + 1
    power, inverse = _powers(n + 1)
    so_far = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[_UPPER[data]] * power[:n], out=so_far[1:])
    hashes = mixed((so_far[stop] - so_far[start]) * inverse[start] + (stop - start).astype(U64))
    counts[:] = np.diff(np.searchsorted(start, ends), prepend=0)
    return hashes, counts


@dataclass
class Slice:
    """Texts, or a part of one: rows (their numbers in the batch), the hashes of their words, the words of each; whether the first text begins
    and the last one ends here."""

    rows: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    begins: bool = True
    ends: bool = True


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """texts in runs of about so many bytes; a longer text in several parts, cut at white space."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, U8) if data is not None else np.zeros(0, U8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
        if stop - row > 1 or at[stop] - at[row] <= most:
            yield Slice(np.arange(row, stop), *word_hashes(data[at[row] : at[stop]], at[row + 1 : stop + 1] - at[row]))
        else:
            here, end = int(at[row]), int(at[stop])
            while here < end:
                cut = min(here + most, end)
                while cut < end and not _WHITE[data[cut]]:
                    ahead = np.flatnonzero(_WHITE[data[cut : cut + most]])
                    cut = min(end, cut + (int(ahead[0]) if len(ahead) else most))
                yield Slice(np.array([row]), *word_hashes(data[here:cut], np.array([cut - here])), begins=here == at[row], ends=cut == end)
                here = cut
        row = stop


# Packed arrays on the way, and files of arrays


def packed(*columns: np.ndarray) -> bytes:
    """Columns of numbers, the bytes of one place together, compressed. The first is sorted and kept as differences."""
    out = [struct.pack("<BQ", len(columns), len(columns[0]))]
    for k, c in enumerate(columns):
        c = np.diff(c, prepend=c.dtype.type(0)) if k == 0 else c
        width = max(1, (int(c.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(c.astype(U64).view(U8).reshape(-1, 8)[:, :width].T)
        body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(c) else b""
        out += [struct.pack("<BQ", width, len(body)), body]
    return b"".join(out)


def unpacked(data: bytes) -> list[np.ndarray]:
    k, n = struct.unpack_from("<BQ", data)
    at, out = 9, []
    for i in range(k):
        width, size = struct.unpack_from("<BQ", data, at)
        wide = np.zeros((n, 8), U8)
        if n:
            wide[:, :width] = np.frombuffer(pa.decompress(data[at + 9 : at + 9 + size], decompressed_size=n * width, codec="zstd", asbytes=True), U8).reshape(width, n).T
        c = wide.view(U64).ravel()
        out.append(np.cumsum(c) if i == 0 else c)
        at += 9 + size
    return out


def gathered(blobs) -> list[np.ndarray]:
    """The columns of several packed arrays, one behind another."""
    parts = [unpacked(b) for b in blobs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def write_arrays(path: str, **arrays: np.ndarray) -> None:
    """A file of named arrays. It appears whole: written beside and renamed."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    beside = f"{path}.{uuid.uuid4().hex}"
    with open(beside, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text)
        for a in arrays.values():
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 64))
    os.replace(beside, path)


def map_arrays(path: str) -> dict[str, np.ndarray]:
    data = np.memmap(path, U8, mode="r")
    n = int(data[:8].view(U64)[0])
    return {name: data[8 + n + at : 8 + n + at + np.dtype(kind).itemsize * size].view(kind) for name, (kind, size, at) in json.loads(bytes(data[8 : 8 + n])).items()}


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes."""
    return ((h >> U64(32)) * U64(shards)) >> U64(32)


def _place(h: np.ndarray, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of a hash within its range of hashes, and 32 bits beyond."""
    within = ((h >> U64(32)) * U64(shards)) & U64(0xFFFFFFFF)
    return within >> U64(32 - bits), h.astype(U32)


def hash_array(h: np.ndarray, shards: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the entries, and the arrays that find() reads: where buckets begin, and 32 bits of each entry."""
    bits = min(31, max(1, (len(h) // 8).bit_length()))
    bucket, low = _place(h, shards, bits)
    order = np.argsort((bucket << U64(32)) | low)
    starts = np.zeros((1 << bits) + 1, U64)
    np.cumsum(np.bincount(bucket.astype(np.int64), minlength=1 << bits), out=starts[1:].view(np.int64))
    return order, {"start": starts.astype(U32) if len(h) < 2**32 else starts, "low": low[order], "bits": np.array([bits])}


def find(arrays: dict[str, np.ndarray], h: np.ndarray, shards: int) -> np.ndarray:
    """The place of each hash, -1 where it isn't."""
    low = arrays["low"]
    if not len(low) or not len(h):
        return np.full(len(h), -1, np.int64)
    bucket, want = _place(h, shards, int(arrays["bits"][0]))
    start = arrays["start"]
    bucket = bucket.astype(np.int64)
    a, b = start[bucket].astype(np.int64), start[bucket + 1].astype(np.int64)
    end = b.copy()
    for _ in range(int((b - a).max(initial=0)).bit_length()):
        middle = (a + b) >> 1
        less = (a < b) & (low[np.minimum(middle, len(low) - 1)] < want)
        a, b = np.where(less, middle + 1, a), np.where(less, b, np.maximum(a, middle))
    hit = (a < end) & (low[np.minimum(a, len(low) - 1)] == want)
    return np.where(hit, a, -1)


def small(name: str, counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as bytes; those of 255 and more exactly beside."""
    large = np.flatnonzero(counts >= 255)
    return {name: np.minimum(counts, 255).astype(U8), f"{name}_at": large, f"{name}_n": counts[large].astype(U64)}


def full(arrays: dict[str, np.ndarray], name: str, at: np.ndarray) -> np.ndarray:
    """The counts at places; 0 at -1."""
    got = np.where(at >= 0, arrays[name][np.maximum(at, 0)] if len(arrays[name]) else 0, 0).astype(np.float64)
    large = np.flatnonzero(got == 255)
    if len(large):
        got[large] = arrays[f"{name}_n"][np.searchsorted(arrays[f"{name}_at"], at[large])]
    return got


def contexts(total: np.ndarray, one: np.ndarray, two: np.ndarray, more: np.ndarray) -> dict[str, np.ndarray]:
    """What contexts need, a byte each where at most 31 words follow once and 6 twice, and none more often; the others exactly beside."""
    plain = (one < 32) & (two < 7) & (more == 0)
    large = np.flatnonzero(~plain)
    return {"code": np.where(plain, one + 32 * two, 255).astype(U8), "code_at": large, **{k: v[large].astype(U64) for k, v in (("total", total), ("one", one), ("two", two), ("more", more))}}


def context_at(arrays: dict[str, np.ndarray], at: np.ndarray) -> tuple[np.ndarray, ...]:
    """total, one, two, more at places; 0 at -1."""
    code = np.where(at >= 0, arrays["code"][np.maximum(at, 0)] if len(arrays["code"]) else 0, 0).astype(np.int64)
    one, two = (code % 32).astype(float), (code // 32).astype(float)
    total, more = one + 2 * two, np.zeros(len(at))
    large = np.flatnonzero(code == 255)
    if len(large):
        k = np.searchsorted(arrays["code_at"], at[large])
        for out, name in ((total, "total"), (one, "one"), (two, "two"), (more, "more")):
            out[large] = arrays[name][k]
    return total, one, two, more


def added(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of their counts; the last array: where each first stands in the sorted order."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sums = [np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts]
    return key[first], *sums, order[first]


def of_counts(counts: np.ndarray) -> list[int]:
    """How many are 1, 2, 3, 4; 3 and more; their sum."""
    n = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)
    return [*map(int, n[1:5]), int(n[3:].sum()), int(counts.sum())]


def of_contexts(context: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """context, total, one, two, more: what each context needs, from the counts of what follows."""
    flag = lambda x: x.astype(U64)
    return added(context, n, flag(n == 1), flag(n == 2), flag(n >= 3))[:-1]


# The model


@dataclass
class Model:
    """folder: its files; shards: of each kind; tokens, vocabulary: of the training texts; ends: their number; seen: of_counts() of each order."""

    folder: str
    shards: int
    tokens: int = 0
    vocabulary: int = 0
    ends: int = 0
    seen: dict[int, list[int]] = field(default_factory=dict)

    def discounts(self, order: int) -> np.ndarray:
        n1, n2, n3, n4 = self.seen.get(order, [0] * 6)[:4]
        if not (n1 and n2 and n3 and n4):
            return np.array([0, 0.5, 1.0, 1.5])
        y = n1 / (n1 + 2 * n2)
        return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])

    def drop(self) -> None:
        """Deletes the files, once nothing needs them."""
        shutil.rmtree(self.folder, ignore_errors=True)


def empty(kind: str) -> dict[str, np.ndarray]:
    none = np.zeros(0, U64)
    arrays = {"w": {"hash": none, "id": none}, "u": contexts(none, none, none, none)}.get(kind) or hash_array(none, 1)[1] | contexts(none, none, none, none)
    return arrays | small("n", none) | small("ends", none)


class Reader:
    """The files of a model as a worker maps them; the least used are closed."""

    def __init__(self, model: Model):
        self.model, self.open = model, OrderedDict()
        self.discount = {k: model.discounts(k) for k in (1, 2, 3)}
        n1, n2, _, _, more, total = model.seen.get(1, [0] * 6)
        d = self.discount[1]
        self.total = total
        self.rest = (d[1] * n1 + d[2] * n2 + d[3] * more) / total if total else 1.0

    def arrays(self, kind: str, shard: int) -> dict[str, np.ndarray]:
        key = (kind, shard)
        if key in self.open:
            self.open.move_to_end(key)
        else:
            while len(self.open) >= OPEN_FILES:
                self.open.popitem(last=False)
            path = f"{self.model.folder}/{kind}-{shard}"
            self.open[key] = map_arrays(path) if os.path.exists(path) else empty(kind)  # a shard that nothing fell to
        return self.open[key]

    def by_shard(self, h: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The shards of sorted hashes, and where each begins and ends."""
        s = shard_of(h, self.model.shards).astype(np.int64)
        first = np.flatnonzero(np.diff(s, prepend=-1))
        for a, b in zip(first, np.append(first, len(s))[1:], strict=True):
            yield int(s[a]), slice(a, b)

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct sorted hashes: the numbers of the words, and their counts."""
        ids, counts = np.full(len(hashes), UNKNOWN, U64), np.zeros(len(hashes))
        for shard, part in self.by_shard(hashes):
            a = self.arrays("w", shard)
            keys = a["hash"]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes[part]), len(keys) - 1)
                at = np.where(keys[at] == hashes[part], at, -1)
                ids[part] = np.where(at >= 0, a["id"][np.maximum(at, 0)], UNKNOWN)
                counts[part] = full(a, "n", at)
        return ids, counts

    def word_parts(self, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """p(w) of distinct words, and the total and the rest of each as a context."""
        p, total, rest = np.full(len(ids), self.rest / (self.model.vocabulary + 1)), np.zeros(len(ids)), np.ones(len(ids))
        of = np.where(ids == UNKNOWN, -1, (ids % U64(self.model.shards)).astype(np.int64))
        for shard in np.unique(of[of >= 0]):
            a, mine = self.arrays("u", int(shard)), np.flatnonzero(of == shard)
            at = (ids[mine] // U64(self.model.shards)).astype(np.int64)
            at = np.where(at < len(a["code"]), at, -1)
            n = full(a, "ends", at)
            p[mine] += (n - self.discount[1][np.minimum(n, 3).astype(int)]) / max(self.total, 1)
            total[mine], rest[mine] = self.context(a, at, 2)
        return p, total, rest

    def context(self, arrays: dict, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
        """total and rest of contexts; without one, all is left to the shorter."""
        total, one, two, more = context_at(arrays, at)
        d = self.discount[order]
        return total, np.where(total > 0, (d[1] * one + d[2] * two + d[3] * more) / np.maximum(total, 1), 1.0)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((a << U64(32)) | b)


def triple_key(pair: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mixed(pair * U64(_BASE) + c)


class Sequences:
    """The numbers of a slice's words with marks: two before each text (the two words before, where a text goes on) and one behind it."""

    def __init__(self, reader: Reader):
        self.reader, self.carry = reader, np.full(2, BEGIN, U64)

    def __call__(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids; where its tokens stand (two words are before each); where texts begin among the tokens; the count of each token."""
        distinct, inverse = np.unique(s.hashes, return_inverse=True)
        ids, counts = self.reader.words(distinct)
        ends = np.ones(len(s.counts), np.int64)
        ends[-1] = s.ends
        sizes = s.counts + 2 + ends
        begin = np.cumsum(sizes) - sizes
        out = np.full(int(sizes.sum()), BEGIN, U64)
        if not s.begins:
            out[:2] = self.carry
        token = np.ones(len(out), bool)
        token[begin] = token[begin + 1] = False
        end = (begin + sizes - 1)[ends > 0]
        word = token.copy()
        word[end] = False
        seen = np.full(len(out), float(self.reader.model.ends))
        out[word], seen[word], out[end] = ids[inverse], counts[inverse], END
        self.carry = out[-2:].copy()
        at = np.flatnonzero(token)
        return out, at, np.cumsum(s.counts + ends) - s.counts - ends, seen[at]


def _blobs(shard: np.ndarray, *columns: np.ndarray) -> Iterator[dict]:
    """A packed row for each shard of columns that are sorted by shard."""
    first = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1))
    for a, b in zip(first, np.append(first, len(shard))[1:], strict=True):
        yield {"shard": int(shard[a]), "data": packed(*(c[a:b] for c in columns))}


_BLOB = pa.schema([("shard", pa.int32()), ("data", pa.binary())])
_COUNTS = "shard int, data binary, " + ", ".join(f"c{k} long" for k in range(6))


def _counted(counts: list[int]) -> dict:
    return {"shard": -1, "data": None} | {f"c{k}": n for k, n in enumerate(counts)}


def _frame(rows: list[dict]) -> pd.DataFrame:
    columns = ["shard", "data", *(f"c{k}" for k in range(6))]
    return pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns).astype({"shard": "int32"} | {f"c{k}": "Int64" for k in range(6)})


def _send_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                h, n, _ = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held.clear()
                for row in _blobs(shard_of(h, shards), h, n):
                    yield pa.RecordBatch.from_pylist([row], schema=_BLOB)

        for batch in batches:
            for s in slices(batch.column("text")):
                h, n = np.unique(s.hashes, return_counts=True)
                held.append((h, n.astype(U64)))
                if sum(len(x) for x, _ in held) > GATHERED:
                    yield from flush()
        yield from flush()
        give_back()

    return run


def _words(folder: str, shards: int):
    """Of a shard: its words with their counts and numbers."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        h, n, _ = added(*gathered(rows["data"]))
        rank = np.empty(len(h), U64)
        rank[np.argsort(-n.astype(np.int64), kind="stable")] = np.arange(len(h), dtype=U64)
        ids = U64(2) + rank * U64(shards) + U64(shard)
        if len(ids) and int(ids.max()) >= UNKNOWN:
            raise ValueError("more words than 32 bits can number")
        write_arrays(f"{folder}/w-{shard}", hash=h, id=ids.astype(U32), **small("n", n))
        return _frame([_counted([len(h), int(n.sum()), 0, 0, 0, 0])])

    return run


def _send_triples(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = Sequences(Reader(model))
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                pair, c = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                _, n, at = added(triple_key(mixed(pair), c), np.ones(len(c), U64))
                pair, c = pair[at], c[at]
                # By shard, then by pair: pairs as differences are short, and most words have low numbers.
                order = np.argsort(pair)
                shard = shard_of(mixed(pair[order]), model.shards)
                by = np.argsort(shard.astype(np.uint16) if model.shards < 65536 else shard, kind="stable")
                order = order[by]
                for row in _blobs(shard[by], pair[order] >> U64(32), pair[order] & U64(0xFFFFFFFF), c[order], n[order]):
                    yield pa.RecordBatch.from_pylist([row], schema=_BLOB)

        for batch in batches:
            for s in slices(batch.column("text")):
                ids, at, _, _ = sequences(s)
                held.append(((ids[at - 2] << U64(32)) | ids[at - 1], ids[at]))
                if sum(len(x) for _, x in held) > GATHERED:
                    yield from flush()
        yield from flush()
        give_back()

    return run


def _triples(folder: str, shards: int):
    """Of a shard of contexts: its trigrams, its contexts, and for each pair the trigrams here that it ends."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        a, b, c, n = gathered(rows["data"])
        pair = (a << U64(32)) | b
        key, n, at = added(triple_key(mixed(pair), c), n)
        pair, c = pair[at], c[at]
        order, found = hash_array(key, shards=1)  # trigrams of a shard have hashes of the whole range
        write_arrays(f"{folder}/t-{shard}", **found, **small("n", n[order]))
        context, *needs = of_contexts(pair, n)
        order, found = hash_array(mixed(context), shards)
        write_arrays(f"{folder}/c-{shard}", **found, **contexts(*(x[order] for x in needs)))
        ends, k, _ = added(((pair & U64(0xFFFFFFFF)) << U64(32)) | c, np.ones(len(c), U64))
        shard2 = shard_of(mixed(ends), shards)
        order = np.argsort(shard2, kind="stable")
        out = [_counted(of_counts(n)), *_blobs(shard2[order], ends[order] >> U64(32), ends[order] & U64(0xFFFFFFFF), k[order])]
        give_back()
        return _frame(out)

    return run


def _pairs(folder: str, shards: int):
    """Of a shard of pairs: their continuation counts, and what they say of their words."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        b, c, k = gathered(rows["data"])
        pair, n, _ = added((b << U64(32)) | c, k)
        order, found = hash_array(mixed(pair), shards)
        write_arrays(f"{folder}/p-{shard}", **found, **small("n", n[order]))
        before, *needs = of_contexts(pair >> U64(32), n)
        word, ends, _ = added(pair & U64(0xFFFFFFFF), np.ones(len(pair), U64))
        zero = lambda x: np.zeros(len(x), U64)
        columns = [np.concatenate([x, zero(word)]) for x in needs] + [np.concatenate([zero(before), ends])]
        ids, *sums = added(np.concatenate([before, word]), *columns)[:-1]
        shard2 = ids % U64(shards)
        order = np.argsort(shard2, kind="stable")
        out = [_counted(of_counts(n)), *_blobs(shard2[order], ids[order], *(x[order] for x in sums))]
        give_back()
        return _frame(out)

    return run


def _unigrams(folder: str, shards: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        ids, *sums = added(*gathered(rows["data"]))[:-1]
        at = (ids // U64(shards)).astype(np.int64)
        wide = [np.zeros(int(at.max()) + 1, U64) for _ in sums]
        for w, x in zip(wide, sums, strict=True):
            w[at] = x
        write_arrays(f"{folder}/u-{shard}", **contexts(*wide[:4]), **small("ends", wide[4]))
        return _frame([_counted(of_counts(sums[4]))])

    return run


def _folder(spark: SparkSession) -> str:
    where = urlparse(shared_folder(spark))
    if where.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files, so spark.checkpoint.dir must be a mounted path, not {where.scheme}:")
    path = f"{where.path.rstrip('/')}/lm-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def fit(docs: DataFrame) -> Model:
    """The model of docs(text)."""
    spark = docs.sparkSession
    docs = docs.select("text")
    rows, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    shards = max(3 * spark.sparkContext.defaultParallelism, -(-(size or 0) // SHARD_BYTES))
    model = Model(_folder(spark), shards, ends=rows)

    def merged(blobs: DataFrame, merge) -> DataFrame:
        return blobs.where("data is not null").select("shard", "data").repartition(shards, "shard").groupBy("shard").applyInPandas(merge(model.folder, shards), _COUNTS)

    def sums(df: DataFrame) -> list[int]:
        return [int(x or 0) for x in df.where("data is null").agg(*(F.sum(f"c{k}") for k in range(6))).first()]

    types, tokens, *_ = sums(merged(docs.mapInArrow(_send_words(shards), "shard int, data binary"), _words))
    model.tokens, model.vocabulary = tokens + rows, types + (rows > 0)
    triples = stored(merged(docs.mapInArrow(_send_triples(model), "shard int, data binary"), _triples))
    pairs = stored(merged(triples, _pairs))
    model.seen = {3: sums(triples), 2: sums(pairs)}
    drop_stored(triples)
    model.seen[1] = sums(merged(pairs, _unigrams))
    drop_stored(pairs)
    return model


def log_probabilities(reader: Reader, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log10 p of the tokens that stand at places of ids, given the two before each."""
    shards, known = reader.model.shards, ids != UNKNOWN
    distinct, inverse = np.unique(ids, return_inverse=True)
    p1, total2, rest2 = (x[inverse] for x in reader.word_parts(distinct))
    # Pairs of neighbours, as ends of trigrams and as contexts, by their hashes.
    pair = pair_key(ids[:-1], ids[1:])
    ends, total3, rest3 = np.zeros(len(pair)), np.zeros(len(pair)), np.ones(len(pair))
    both = np.flatnonzero(known[:-1] & known[1:])
    order = both[np.argsort(pair[both])]
    third = np.zeros(len(ids))
    token = np.zeros(len(ids), bool)
    token[at] = True
    for shard, part in reader.by_shard(pair[order]):
        mine = order[part]
        h = pair[mine]
        p, c = reader.arrays("p", shard), reader.arrays("c", shard)
        ends[mine] = full(p, "n", find(p, h, shards))
        place = find(c, h, shards)
        total3[mine], rest3[mine] = reader.context(c, place, 3)
        mine = mine[place >= 0]
        mine = mine[mine + 2 < len(ids)]
        mine = mine[token[mine + 2] & known[mine + 2]]
        t = reader.arrays("t", shard)
        third[mine + 2] = full(t, "n", find(t, triple_key(pair[mine], ids[mine + 2]), 1))
    less = lambda n, order: n - reader.discount[order][np.minimum(n, 3).astype(int)]
    p2 = less(ends[at - 1], 2) / np.maximum(total2[at - 1], 1) + rest2[at - 1] * p1[at]
    p3 = less(third[at], 3) / np.maximum(total3[at - 2], 1) + rest3[at - 2] * p2
    return np.log10(p3)


def _score(model: Model, others: list[str], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        sequences = Sequences(reader)
        for batch in batches:
            got = np.zeros((4, batch.num_rows))
            for s in slices(batch.column("text")):
                ids, at, first, seen = sequences(s)
                if not len(at):
                    continue
                base = np.log10(seen + 1) - np.log10(model.tokens + model.vocabulary + 1)
                some = np.flatnonzero(np.diff(np.append(first, len(at))))  # a part of a text may hold none
                for k, x in enumerate((np.ones(len(at)), seen > 0, base, log_probabilities(reader, ids, at))):
                    got[k][s.rows[some]] += np.add.reduceat(x.astype(float), first[some])
            yield pa.record_batch([*(batch.column(c) for c in others), pa.array(got[0].astype(np.int64)), pa.array(got[1].astype(np.int64)), pa.array(got[2]), pa.array(got[3])], names=[*others, *names])
        give_back()

    return run


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs without text, with n_tokens, n_known (of the training texts), base_score (add-one unigrams) and score, both log10, under
    those names with _ before them where docs has them already. A text's perplexity is 10 ** (-score / n_tokens)."""
    others = [f for f in docs.schema.fields if f.name != "text"]
    names = fresh(docs, "n_tokens", "n_known", "base_score", "score")
    schema = StructType([*others, *(StructField(n, kind) for n, kind in zip(names, (LongType(), LongType(), DoubleType(), DoubleType()), strict=True))])
    return docs.select(*(f.name for f in others), "text").mapInArrow(_score(model, [f.name for f in others], names), schema)


def held_out(doc_id: Column, remainder: int = HELD_OUT, of: int = OF) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == remainder, F.lit(False))


def op12_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    model = fit(docs.where("not held_out"))
    found = stored(scores(docs, model))
    model.drop()
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
