"""Substring dedup by sliding sentence spans.

Texts are cut into sentences at .!? and line ends. Every run of SENTENCES consecutive sentences is hashed, however few words
it has, so every longer repeated run is covered by its own windows; and also shorter runs that are long in words (SHORTER).
Runs join globally on the 128 bits of their hash; of each, the first place stays, and sentences that any other place covers
are removed. Hashes that hold a large share of all runs are broadcast, so their places never meet in one task.

Places are in the order of doc_id, hash of the text, sentence; null ids come first. A run's first place is a minimum by
group, and one row for each repeated run joins the places back, so no group is ever gathered.

Defined cases: null and empty texts stay as they are. Sentences are compared in lower case, words joined by one blank.
Rows with the same id and text are one document: they lose the same sentences, and none on account of each other. What
stands between two sentences goes with the first of them. Other columns stay.
"""

from __future__ import annotations

import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, joined_by_key, stored, table, text_slices
from .line_dedup import text_key

SENTENCES = 3
#: Runs of fewer sentences that count as well, with the words they need.
SHORTER = {1: 40, 2: 28}
#: Texts gone through together have so many bytes at most, or are one text.
SLICE_BYTES = 2_000_000
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")


def sentences(text: str) -> list[str]:
    """The pieces of text, each up to and with its marks; joined they are the text."""
    return _SENTENCE.findall(text)


def runs(text: str, sentences_per_run: int = SENTENCES, shorter: dict[int, int] = SHORTER) -> list[tuple[int, int, bytes]]:
    """first sentence, number of pieces, hash of every run that counts. Pieces without a word belong to the run around them."""
    full = []
    for i, s in enumerate(sentences(text)):
        words = s.lower().encode("utf-8", "surrogatepass").strip(b".!? \t\n\x0b\x0c\r").split()
        if words:
            full.append((i, len(words), b" ".join(words)))
    out = []
    for k, (first, _, _) in enumerate(full):
        h, n = xxhash.xxh3_128(), 0
        for size, (i, words, s) in enumerate(full[k : k + sentences_per_run], 1):
            n += words
            h.update(s)
            h.update(b"\n")
            if size == sentences_per_run or size in shorter and n >= shorter[size]:
                out.append((first, i - first + 1, h.digest()))
    return out


def repeated_sentences(docs: DataFrame) -> DataFrame:
    """doc_id, key, gone: for each text that loses sentences, the numbers of their pieces."""
    rows = docs.where("text is not null").select(F.col("doc_id"), text_key().alias("key"), "text")
    found = stored(rows.mapInArrow(_arrow_runs, "doc_id long, key long, first int, pieces int, high long, low long"))
    place = F.struct("doc_id", "key", "first")
    per_run = found.groupBy("high", "low").agg(F.min(place).alias("earliest"), F.max(place).alias("latest"), F.count(F.lit(1)).alias("n"))
    firsts = per_run.where("earliest != latest").select("high", "low", "n", "earliest")
    later = joined_by_key(found, firsts, "high", "low").where(place > F.col("earliest"))
    pieces = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("pieces") - 1))
    return later.select("doc_id", "key", pieces.alias("piece")).groupBy("doc_id", "key").agg(F.collect_set("piece").alias("gone"))


def _arrow_runs(batches):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        ids, keys, texts = (batch.column(k) for k in range(3))
        for a, b in text_slices(texts, SLICE_BYTES):
            places, counts, firsts, sizes, hashes = [], [], [], [], []
            for at, t in enumerate(texts[a:b].to_pylist(), a):
                found = runs(t)
                places.append(at)
                counts.append(len(found))
                for first, pieces, h in found:
                    firsts.append(first)
                    sizes.append(pieces)
                    hashes.append(h)
            rows = pa.array(np.repeat(np.array(places, np.int64), counts))
            bits = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            cols = [ids.take(rows), keys.take(rows), pa.array(firsts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "first", "pieces", "high", "low"])


def _remover():
    """A column function: the text without the pieces of the given numbers."""

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        lost = [set(g) for g in gone]
        return pd.Series(["".join(s for i, s in enumerate(sentences(t)) if i not in g) for t, g in zip(texts, lost, strict=True)], dtype=object)

    return without


def substring_dedup(docs: DataFrame) -> DataFrame:
    """docs with the repeated sentences removed, and the number of those as the last column."""
    key, other_id, other_key, lost, n = fresh(docs, "text_key", "gone_id", "gone_key", "gone", "n_removed")
    gone = repeated_sentences(docs).toDF(other_id, other_key, lost)
    joined = docs.withColumn(key, text_key()).join(gone, F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key)), "left")
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(_remover()(F.when(F.col(lost).isNotNull(), F.col("text")).otherwise(""), F.coalesce(lost, F.array().cast("array<int>"))))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(n))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
