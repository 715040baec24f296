"""Quality rules: base rules on whole texts, then an isolation forest on the rules' statistics.

Base rules fail a document of fewer than MIN_WORDS words, or of which more than half the words lie in repeated 3-word
windows. Texts are read once; their statistics are a stored table that all later steps read. The forest's random splits lie
in the ranges of at most SAMPLE_ROWS unlabelled and as many labelled rows, those of the smallest hash of their id, PSI of
them a tree, as the method has it. All else is counted over every document: how many fall into each leaf of each tree
says how long paths go on there, and a document's mean path length gives its anomaly score, 2 ** (-path / c(PSI)). The
documents whose score passes a threshold aren't kept: of all labelled documents, the cut that best separates good from bad among
those that turn away at most MAX_LOSS of the good.

Scores have SCORE_DIGITS places, so the labelled documents of each score are counted in a table of bounded size. Nothing but that table, the
drawn rows and the leaves' counts, all bounded, goes to the driver, and the forest's arrays, of a fixed size, to the executors.

Defined cases: null text has no words, so it fails the base rules. Repeated rows score alike. Without labelled rows of
either kind the threshold is DEFAULT_THRESHOLD. Without any rows the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, stored, table, text_slices

MIN_WORDS = 50
TREES = 128
PSI = 256
SAMPLE_ROWS = 4000
MAX_LOSS = 0.01
SCORE_DIGITS = 5
DEFAULT_THRESHOLD = 0.65
#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share", "upper_share", "stop_share", "one_char_share")

_BLANKS = b" \t\n\x0b\x0c\r"
_KEEP_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_KEEP_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
_KEEP_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
_ENDS = b".!?;:,"


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of BASE and the shares of FEATURES of a whole text."""
    if not text:
        return [0] * len(BASE), [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # splits bytes on exactly the ASCII blanks
    n = len(words)
    chars = len(text) - sum(data.count(b) for b in _BLANKS)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    repeated = repeated_words(seq, len(ids))
    m, c = max(n, 1), max(chars, 1)
    once = np.bincount(seq, minlength=1)
    features = [
        chars / m,
        symbols / c,
        dup / max(len(lines), 1),
        repeated / m,
        len(ids) / m**0.85,
        (len(data) - len(data.translate(None, b"0123456789"))) / c,
        (len(data) - len(data.translate(None, bytes(range(65, 91))))) / m,
        float(once.max()) / m,
        sum(once[k] for w, k in ids.items() if len(w) == 1) / m,
    ]
    return [n, chars, symbols, dup, repeated], features


def repeated_words(seq: np.ndarray, vocabulary: int) -> int:
    """Positions of seq inside a 3-window whose content occurs at least twice, exactly."""
    n = len(seq)
    if n < 4:
        return 0
    if vocabulary < 1 << 20:
        key = (seq[:-2] * vocabulary + seq[1:-1]) * vocabulary + seq[2:]
    else:
        pairs = np.unique(seq[:-1] * vocabulary + seq[1:], return_inverse=True)[1].astype(np.int64)
        key = pairs[:-1] * vocabulary + seq[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(n, dtype=bool)
    cover[:-2] |= twice
    cover[1:-1] |= twice
    cover[2:] |= twice
    return int(cover.sum())


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """The mean path length of an unsuccessful search in a binary search tree of n rows."""
    n = np.asarray(n, dtype=float)
    m = np.maximum(n, 2.0)
    return np.where(n <= 2, np.clip(n - 1, 0.0, 1.0), 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m)


class IsolationForest:
    """Trees of random splits in flat arrays, complete to a fixed depth."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.psi = min(psi, max(len(rows), 1))
        self.depth = int(np.ceil(np.log2(max(self.psi, 2))))
        nodes = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((trees, nodes), dtype=np.int16)
        self.cut = np.full((trees, nodes), np.inf)
        self.path = np.zeros((trees, nodes))
        self.ends = np.zeros((trees, nodes))  # at full depth: the depth of the leaf itself
        for t in range(trees):
            if len(rows):
                self._grow(rng, rows[rng.choice(len(rows), self.psi, replace=False)], t, 0, 0)

    def _grow(self, rng, rows: np.ndarray, t: int, node: int, depth: int) -> None:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.flatnonzero(high > low)
        if depth == self.depth or len(rows) <= 1 or not len(open_):
            self._leaf(t, node, depth, len(rows))
            return
        f = rng.choice(open_)
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        left = rows[:, f] < cut
        self._grow(rng, rows[left], t, 2 * node + 1, depth + 1)
        self._grow(rng, rows[~left], t, 2 * node + 2, depth + 1)

    def _leaf(self, t: int, node: int, depth: int, rows: int) -> None:
        """A leaf's path length stands at the node its rows reach at full depth: an infinite cut always goes left."""
        end = depth
        while depth < self.depth:
            node, depth = 2 * node + 1, depth + 1
        self.path[t, node], self.ends[t, node] = end + float(mean_path(rows)), end

    def _reached(self, rows: np.ndarray, t: int) -> np.ndarray:
        node, at = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[at, self.feature[t, node]] >= self.cut[t, node])
        return node

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """How many rows reach each node at full depth, of each tree."""
        return np.array([np.bincount(self._reached(rows, t), minlength=self.cut.shape[1]) for t in range(len(self.cut))])

    def weigh(self, counts: np.ndarray) -> None:
        """Path lengths by counts of rows in place of those the trees were grown from: a leaf holds its share of psi rows."""
        total = counts.sum(1, keepdims=True)
        self.path = np.where(total > 0, self.ends + mean_path(counts / np.maximum(total, 1) * self.psi), self.path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.zeros(0)
        total = np.zeros(len(rows))
        for t in range(len(self.cut)):
            total += self.path[t, self._reached(rows, t)]
        return 2.0 ** (-(total / len(self.cut)) / max(float(mean_path(self.psi)), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The cut that turns away most bad rows less good rows, among those that lose at most max_loss of the good."""
    cuts, at = np.unique(scores, return_inverse=True)
    return threshold_of_counts(cuts, np.bincount(at[good], minlength=len(cuts)), np.bincount(at[~good], minlength=len(cuts)), max_loss)


def threshold_of_counts(cuts: np.ndarray, good: np.ndarray, bad: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The same of distinct scores in order, with how many good and bad rows have each."""
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    above = lambda n: np.cumsum(n[::-1])[::-1] / n.sum()  # noqa: E731  share with score >= cut
    lost, caught = above(good), above(bad)
    best = int(np.argmax(np.where(lost <= max_loss, caught - lost, -1)))
    if lost[best] > max_loss or caught[best] <= lost[best]:
        return float(np.nextafter(cuts[-1], np.inf))
    # Between the best cut and the next score below it nothing changes; stand in the middle.
    return float((cuts[best] + (cuts[best - 1] if best else cuts[best])) / 2)


def base_failed(base: np.ndarray) -> np.ndarray:
    return (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])


def _measured(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    got = [statistics(t) for t in texts]
    base = np.array([b for b, _ in got], dtype=np.int64).reshape(-1, len(BASE))
    return base, np.array([f for _, f in got], dtype=float).reshape(-1, len(FEATURES))


STATISTICS = "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, features array<double>, text_hash long"


def measured(docs: DataFrame) -> DataFrame:
    """The statistics of each row of docs(doc_id, text), with base_failed and a hash of the text."""

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            for a, b in text_slices(batch.column(1)):
                base, features = _measured(batch.column(1)[a:b].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * len(FEATURES), pa.int32()), pa.array(features.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], *(pa.array(base[:, k]) for k in range(len(BASE))), pa.array(base_failed(base)), lists, batch.column(2)[a:b]],
                    names=["doc_id", *BASE, "base_failed", "features", "text_hash"],
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(measure, STATISTICS)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[IsolationForest, float]:
    """The forest and its threshold for docs(doc_id, text)."""
    return fit_measured(stored(measured(docs)), labels, sample_rows)


def fit_measured(rows: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[IsolationForest, float]:
    """The forest and its threshold from the statistics of all rows that pass the base rules, one row for each id: of rows with one id, the text
    of the smallest hash counts. Only the splits are drawn from at most 2 * sample_rows of them."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    first = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("base_failed", "features"), "text_hash").alias("s"))
    once = stored(first.join(quality, "doc_id", "left").select("doc_id", "quality", "s.base_failed", "s.features"))
    hashed = F.xxhash64(F.lit(11), F.col("doc_id"))
    drawn = [once.where(where).withColumn("h", hashed).orderBy("h", "doc_id").limit(sample_rows) for where in ("true", "quality is not null")]
    sample = drawn[0].unionByName(drawn[1]).where("not base_failed").select("doc_id", "features").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    forest = IsolationForest(np.array(sample["features"].tolist(), dtype=float).reshape(-1, len(FEATURES)))
    once = once.where("not base_failed").select("quality", "features")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(forest.cut.shape, dtype=np.int64)
        for batch in batches:
            total += forest.counts(np.array(batch["features"].tolist(), dtype=float).reshape(-1, len(FEATURES)))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"leaf": at, "n": total.ravel()[at]})

    leaves = once.select("features").mapInPandas(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(forest.cut.shape, dtype=np.int64)
    counts.ravel()[leaves["leaf"].to_numpy(np.int64)] = leaves["n"].to_numpy(np.int64)
    forest.weigh(counts)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"score": _scores(forest, np.array(batch["features"].tolist(), dtype=float).reshape(-1, len(FEATURES))), "good": batch["quality"] > 0})

    labelled = once.where("quality is not null").select("features", "quality").mapInPandas(judge, "score double, good boolean")
    by = labelled.groupBy("score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toPandas().sort_values("score")
    return forest, threshold_of_counts(by["score"].to_numpy(float), by["good"].to_numpy(np.int64), by["bad"].to_numpy(np.int64))


def _scores(forest: IsolationForest, features: np.ndarray) -> np.ndarray:
    return np.round(forest.score(features), SCORE_DIGITS)


def quality_rules(docs: DataFrame, forest: IsolationForest, cut: float) -> DataFrame:
    """doc_id, the counts of BASE, base_failed, score, kept for each row of docs(doc_id, text)."""
    return judged(measured(docs), forest, cut)


def judged(rows: DataFrame, forest: IsolationForest, cut: float) -> DataFrame:
    """The same for the rows of measured()."""
    kept = [f.name for f in rows.schema if f.name not in ("features", "text_hash")]

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            features = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            score, failed = _scores(forest, features), batch.column("base_failed").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(score), pa.array(~failed & (score < cut))], names=[*kept, "score", "kept"])

    return rows.drop("text_hash").mapInArrow(judge, "doc_id long, " + ", ".join(f"{n} long" for n in BASE) + ", base_failed boolean, score double, kept boolean")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(table(spark, sf_dir, "documents")))
    return judged(rows, *fit_measured(rows, table(spark, sf_dir, "labels")))
