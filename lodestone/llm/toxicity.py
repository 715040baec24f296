"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's probability is logistic in the distinct lower-cased words and word stems (first letters) that it holds; a
document's is the noisy-or of its sentences, 1 - prod(1 - p). The weights maximise the likelihood of the document labels,
over the features that are significantly more frequent in toxic documents. Sentences whose own probability passes a cut
are the offending ones.

Trained on a bounded sample of labelled rows outside the held-out third: at most SAMPLE_ROWS of each label, those of the
smallest hash of their id, as long as they hold no more than half of SAMPLE_BYTES together. A text above the SHARES-th part
of SAMPLE_BYTES isn't learnt from, and of rows of one id only the shortest is. Only the text is an input of a score.
The model has a weight for each of at most the sample's words, so its size is bounded too.

Defined cases: null or empty text has no sentence and score 0. Repeated rows score alike. Without toxic or without other
labelled rows every score is 0. Rows without an id aren't learnt from; they are scored, and not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, table, text_slices

FOLDS, HELD_OUT = 3, 1
SAMPLE_ROWS = 3000
SAMPLE_BYTES = 24_000_000
SHARES = 48
MIN_DOCUMENTS = 5
MIN_Z = 6.0
STEMS = range(4, 9)
KEPT_WORDS = 100_000
CUT = 0.7
SENTENCE_CUT = 0.5
STEPS = 300

SENTENCE = re.compile(r"[^.!?\n]+")
WORDS = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """The word, and its stems, marked by a trailing dash."""
    return [word, *(f"{word[:n]}-" for n in STEMS if n <= len(word))]


class Model:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, tuple[str, ...]] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "known": {}}

    def active(self, word: str) -> tuple[str, ...]:
        """The features of a word that have a weight; remembered, as most words have none."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= KEPT_WORDS:
                self.known.clear()
            got = self.known[word] = tuple(f for f in features(word) if f in self.weights)
        return got

    def sentence(self, words: list[str]) -> float:
        """The log-odds of a sentence."""
        known, found = self.known, set()
        for w in words:
            got = known.get(w)
            if got is None:
                got = self.active(w)
            if got:
                found.update(got)
        return self.bias + sum(self.weights[f] for f in sorted(found))

    def score(self, text: str | None) -> float:
        if not text or not self.weights:
            return 0.0
        total = 0.0
        for s in SENTENCE.findall(text.lower()):
            if words := WORDS.findall(s):
                z = self.sentence(words)
                total += math.log1p(math.exp(z)) if z < 30 else z
        return -math.expm1(-total)

    def offending(self, text: str | None, cut: float = SENTENCE_CUT) -> list[tuple[int, int, float]]:
        """start, end and probability of the sentences at or above cut, in characters of the text."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            p = float(1 / (1 + np.exp(-self.sentence(WORDS.findall(m[0].lower())))))
            if p >= cut and self.weights:
                out.append((m.start(), m.end(), p))
        return out


def held_out(doc_id: Column | str) -> Column:
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """text and toxic of the bounded sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("h", F.xxhash64(F.lit(5), "doc_id"))
    wanted = [known.where(c).orderBy("h", "doc_id").limit(rows) for c in (F.col("toxic") > 0, F.col("toxic") <= 0)]
    # At most 2 * rows ids: a bound that doesn't grow with the data.
    texts = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    found = texts.select("doc_id", "key", F.octet_length("text").alias("size")).join(F.broadcast(wanted[0].unionByName(wanted[1])), "doc_id")
    # Texts are chosen by size alone. A text beyond its share is left out by itself and doesn't count; half of the bytes are each label's.
    sized = found.groupBy("doc_id", "h", "toxic").agg(F.min(F.struct("size", "key")).alias("t")).select("doc_id", "h", "toxic", "t.size", "t.key").where(F.col("size") <= most_bytes // SHARES)
    so_far = Window.partitionBy(F.col("toxic") > 0).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    chosen = sized.withColumn("so_far", F.sum("size").over(so_far)).where(F.col("so_far") <= most_bytes // 2).select("doc_id", "key", "toxic")
    return texts.join(F.broadcast(chosen), ["doc_id", "key"]).groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id", kind="stable")


def fit(sample: pd.DataFrame, steps: int = STEPS) -> Model:
    """Maximum likelihood of noisy-or documents by full-batch Adam with a soft threshold."""
    y = sample["toxic"].to_numpy(dtype=int) > 0 if len(sample) else np.zeros(0, dtype=bool)
    if not len(y) or y.all() or not y.any():
        return Model({}, -30.0)
    texts = [t.lower() for t in sample["text"]]
    words_of = lambda t: {f for w in set(WORDS.findall(t)) for f in features(w)}
    toxic_seen = Counter(f for t, label in zip(texts, y, strict=True) if label for f in words_of(t))
    toxic_seen = {f: n for f, n in toxic_seen.items() if n >= MIN_DOCUMENTS}
    seen = Counter(f for t, label in zip(texts, y, strict=True) if not label for f in words_of(t) if f in toxic_seen)
    share = float(y.mean())
    # The others can't tell; they have no weight.
    telling = [f for f, n in toxic_seen.items() if n - (n + seen[f]) * share >= MIN_Z * math.sqrt((n + seen[f]) * share * (1 - share))]
    if not telling:
        return Model({}, -30.0)
    names = sorted(telling)
    place = {f: k for k, f in enumerate(names)}
    flat, sentence_of, doc_of = [], [], []
    for d, text in enumerate(texts):
        for s in SENTENCE.findall(text):
            words = set(WORDS.findall(s))
            if words:
                hit = {place[f] for w in words for f in features(w) if f in place}
                flat.extend(hit)
                sentence_of.extend([len(doc_of)] * len(hit))
                doc_of.append(d)
    word, sentence, doc = np.array(flat, dtype=np.int64), np.array(sentence_of, dtype=np.int64), np.array(doc_of, dtype=np.int64)
    w, bias = np.zeros(len(names)), -6.0
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    n_docs, balance = len(y), 1.0
    for k in range(1, steps + 1):
        z = bias + np.bincount(sentence, weights=w[word], minlength=len(doc))
        soft = np.logaddexp(0, z)
        total = np.maximum(np.bincount(doc, weights=soft, minlength=n_docs), 1e-9)
        pull = np.where(y, -balance / np.expm1(np.minimum(total, 50)), 1.0) / n_docs
        gz = pull[doc] / (1 + np.exp(-z))
        g = np.append(np.bincount(word, weights=gz[sentence], minlength=len(names)), gz.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, bias = w - step[:-1], float(np.clip(bias - step[-1], -12, -3))
        w = np.sign(w) * np.maximum(np.abs(w) - 0.01, 0)
        w = np.clip(w, 0, 12)
    return Model({n: float(x) for n, x in zip(names, w, strict=True) if abs(x) > 0.05}, bias)


def scorer(model: Model):
    """A column function: the score of a text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def locator(model: Model):
    """A column function: the offending sentences of a text as array<struct<start, end, score>>."""

    @F.pandas_udf("array<struct<start: int, end: int, score: double>>")
    def locate(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": s, "end": e, "score": p} for s, e, p in model.offending(t)] for t in texts])

    return locate


def without_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs whose text scores below cut, as they are."""
    place = docs.columns.index("text")

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in text_slices(batch.column(place)):
                rows = batch.slice(a, b - a)
                yield rows.filter(pa.array([model.score(t) < cut for t in rows.column(place).to_pylist()], pa.bool_()))
        model.known.clear()
        give_back()

    return docs.mapInArrow(keep, docs.schema)


def toxicity(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted, offending for each row of docs(doc_id, text)."""

    def judge(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                texts = batch.column(1)[a:b].to_pylist()
                scores = [model.score(t) for t in texts]
                # Only what is likely toxic is read again for its sentences.
                where = [[{"start": s, "end": e, "score": p} for s, e, p in model.offending(t)] if x >= SENTENCE_CUT else [] for t, x in zip(texts, scores, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(scores, pa.float64()), pa.array(where, span)], names=["doc_id", "score", "offending"])
        model.known.clear()
        give_back()

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, score double, offending array<struct<start: int, end: int, score: double>>")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "offending")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))
    spans = F.array_join(F.transform("offending", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"), spans.alias("offending"))
