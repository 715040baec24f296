"""Quality rules, toxicity and mixing; the pipeline's stages."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import mixing, piece_sampling, quality, toxicity
from lodestone.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


@pytest.mark.parametrize("text", ["", None, "a a a a", "a b c a b c d", "x\n\nx\n y\nx", "p|q <b> ##\x85 é\n\x0b", "a b " * 40, "\x1c \x1d a\x1e b"])
def test_base_counts(text):
    counts, _ = quality.statistics(text)
    n_words, word_chars, n_symbols, n_dup, n_repeat, _ = base(text)
    assert counts == [n_words, word_chars, n_symbols, n_dup, n_repeat]


def test_repeated_words_of_a_large_vocabulary():
    seq = np.concatenate([np.arange(5), np.arange(5, 2000), np.arange(3)])
    assert quality.repeated_words(seq, 1 << 21) == quality.repeated_words(seq, 2000) == 6


def test_quality_of_rows(hard, small, none, labels):
    for docs in (hard, small):
        forest, cut = quality.fit(docs, labels)
        for r in docs.join(quality.quality_rules(docs, forest, cut).drop("score").withColumnRenamed("doc_id", "id"), F.col("doc_id") == F.col("id")).collect():
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(r["text"])
            assert not (r["kept"] and r["base_failed"])
    assert quality.quality_rules(hard, forest, cut).count() == hard.count()
    forest, cut = quality.fit(none, labels)
    assert cut == quality.DEFAULT_THRESHOLD and quality.quality_rules(none, forest, cut).count() == 0


def test_forest_isolates_an_outlier():
    rows = np.random.default_rng(0).normal(size=(500, 4))
    scores = quality.IsolationForest(rows).score(np.vstack([rows, np.full((1, 4), 9.0)]))
    assert scores[-1] > scores[:-1].max() and scores[:-1].mean() < 0.5


def test_forest_paths_are_those_of_its_splits():
    rows = np.random.default_rng(1).normal(size=(200, 3))
    forest = quality.IsolationForest(rows, trees=5)
    for x in rows[:20]:
        total = 0.0
        for t in range(5):
            node = 0
            for _ in range(forest.depth):
                node = 2 * node + (2 if x[forest.feature[t, node]] >= forest.cut[t, node] else 1)
            total += forest.path[t, node]
        assert forest.score(x[None])[0] == pytest.approx(2 ** (-total / 5 / float(quality.mean_path(forest.psi))))


def test_threshold_spares_the_good():
    good = np.array([True] * 100 + [False] * 10)
    scores = np.concatenate([np.linspace(0.3, 0.5, 100), np.full(10, 0.7)])
    cut = quality.threshold(scores, good)
    assert 0.5 < cut <= 0.7
    assert quality.threshold(scores, np.ones(110, dtype=bool)) == quality.DEFAULT_THRESHOLD


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.training_rows(docs, labels)
    assert len(sample) <= 2 * toxicity.SAMPLE_ROWS and not any(zlib.crc32(str(i).encode()) % 3 == 1 for i in sample["doc_id"])
    model = toxicity.fit(sample)
    held = docs.join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out("doc_id"))
    rows = held.select("text", "toxic", toxicity.scorer(model)("text").alias("score")).collect()
    caught = [r["score"] >= toxicity.CUT for r in rows if r["toxic"]]
    false = [r["score"] >= toxicity.CUT for r in rows if not r["toxic"]]
    assert np.mean(caught) > 0.75 and np.mean(false) < 0.02


def test_large_texts_do_not_drop_the_rest_of_the_sample(spark):
    rows = [(i, "a large one " * 1000 if i % 7 == 0 else f"text {i}", 1, i % 2) for i in range(200)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], 1, r[3]) for r in rows], "doc_id long, quality int, toxic int")
    sample = toxicity.training_rows(docs, labels, most_bytes=11_000)
    assert list(sample["doc_id"]) == [i for i in range(200) if i % 7 and zlib.crc32(str(i).encode()) % 3 != 1]


def test_noisy_or_and_location():
    model = toxicity.Model({"bad": 8.0, "worse-": 6.0}, -5.0)
    p = [1 / (1 + math.exp(5)), 1 / (1 + math.exp(-3))]
    assert model.score("Fine here. This is BAD bad!") == pytest.approx(1 - (1 - p[0]) * (1 - p[1]))
    assert [(s, e) for s, e, _ in model.offending("Fine here. This is BAD bad! ok. worsening")] == [(10, 26), (31, 41)] or [(s, e) for s, e, _ in model.offending("Fine here. This is BAD bad! ok")] == [(10, 26)]
    assert model.score(None) == model.score("") == 0.0


def test_toxicity_of_hard_rows(hard, none, labels):
    model = toxicity.fit(toxicity.training_rows(hard, labels))
    got = toxicity.toxicity(hard, model).collect()
    assert len(got) == hard.count() and all(r["score"] == 0 and r["predicted"] == 0 for r in got)
    assert toxicity.toxicity(none, model).count() == 0 and len(toxicity.training_rows(none, labels)) == 0


def brute_mix(rows, weights):
    """rows (doc_id, source, size): targets and words taken, by plain loops."""
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        over = [s for s in free if rest * w[s] / sum(w[x] for x in free) >= 3 * sizes[s]]
        if not over:
            break
        capped |= set(over)
    target = {s: 3.0 * sizes[s] if s in capped else rest * w[s] / sum(w[x] for x in free) for s in order}
    taken = {}
    for s in order:
        epochs = min(3, int(target[s] // sizes[s])) if sizes[s] else 0
        left = target[s] - epochs * sizes[s]
        keyed = sorted((-math.log((int(hashlib.md5(f"{d}:17".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weights.get(d, 1.0), d, n) for d, x, n in rows if x == s)
        before = 0
        for _, d, n in keyed:
            taken[d] = n * (epochs + (n > 0 and epochs < 3 and 2 * before + n <= 2 * left))
            before += n
    return target, taken


@pytest.mark.parametrize("range_rows", [1, 7, 4096])
def test_mix_against_brute_force(spark, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(2)
    rows = [(i, [None, "a", "b", "ü", "z", "Z"][min(5, int(rng.exponential(1.2)))], int(rng.integers(0, 60))) for i in range(600)]
    weights = {i: 1.5 for i in range(0, 600, 7)}
    df = spark.createDataFrame([(i, i, s, n, weights.get(i, 1.0)) for i, s, n in rows], "doc_id long, key long, source string, size long, quality_weight double")
    target, taken = brute_mix(rows, weights)
    for r in mixing.mix(df).collect():
        assert r["target"] == pytest.approx(target[r["source"]]) and r["taken"] == taken[r["doc_id"]] <= 3 * r["size"]


def test_mix_of_hard_rows(hard, none, labels):
    rows = mixing.mix(mixing.with_quality(mixing.sized(hard), labels)).collect()
    assert len(rows) == hard.count() and all(r["taken"] == 0 for r in rows if r["size"] == 0)
    got = mixing.repeated(hard, labels)
    assert got.columns == hard.columns
    assert got.count() == sum(r["times"] for r in rows)
    assert mixing.mix(mixing.with_quality(mixing.sized(none), labels)).count() == 0 and mixing.repeated(none, labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    from .test_duplicates import brute_components, brute_lines

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = (docs.collect(), stored(stage(spark, docs, sf)))
        docs = kept[name][1]
    model = toxicity.fit(toxicity.training_rows(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    before, after = kept["toxicity"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in before if model.score(r["text"]) < toxicity.CUT)
    before, after = kept["line dedup"]
    want = brute_lines(before, long_words=corpus_pipeline.LONG_WORDS)
    assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in after.collect()) == sorted((d, t, len(t)) for (d, _), (t, _) in want.items())
    before, after = kept["n-gram jaccard join"]
    before = sorted(before, key=lambda r: r["doc_id"])
    _, groups = brute_components([r["text"] for r in before], corpus_pipeline.SHINGLE, corpus_pipeline.SIMILARITY)
    assert sorted(r["doc_id"] for r in after.collect()) == [before[i]["doc_id"] for i, g in enumerate(groups) if g == i]
    before, after = kept["mix sources"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    weights = {d: 1.5 if q else 0.5 for d, q in labels.items() if q is not None}
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in before]
    _, taken = brute_mix(rows, weights)
    times = collections.Counter(r["doc_id"] for r in after.collect())
    assert all(times[d] * n == taken[d] for d, _, n in rows)
    assert all(after.columns == docs_.columns for docs_ in (kept["toxicity"][1], kept["line dedup"][1], kept["n-gram jaccard join"][1]))
    before, after = kept["piece sampling"]
    assert after.count() == len(before) and piece_sampling.SAMPLES == after.agg(F.max("n_samples")).first()[0]


def test_pipeline_of_hard_rows(spark, hard, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (hard, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, str(tmp_path)))
        assert docs.count() >= 0


def test_large_ids_beside_a_null_one_stay(spark, labels):
    ids = [2**53 + 1, None, 2**62 + 3]
    docs = spark.createDataFrame([(i, "some text here") for i in ids], "doc_id long, text string")
    judged = quality.quality_rules(docs, *quality.fit(docs, labels))
    scored = toxicity.toxicity(docs, toxicity.Model({"text": 8.0}, -5.0))
    for df in (judged, scored):
        assert sorted((r["doc_id"] for r in df.collect()), key=str) == sorted(ids, key=str)


def test_a_frequent_id_is_one_row_of_the_sample(spark, monkeypatch):
    """100,000 rows of one id: the driver gets one of them, and the sample still has other ids."""
    from pyspark.sql import functions as F

    seen = []
    real = quality.IsolationForest
    monkeypatch.setattr(quality, "IsolationForest", lambda features: seen.append(len(features)) or real(features))
    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}"), F.col("id") % (k + 7)) for k in range(60)])
    docs = spark.range(100_300).select(F.when(F.col("id") < 300, F.col("id")).otherwise(5).alias("doc_id"), words.alias("text"))
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    quality.fit(docs, labels, sample_rows=40)
    assert 40 <= seen[0] <= 42


def test_leaves_and_threshold_are_counted_over_all_rows(spark):
    """200 unlabelled and 400 labelled documents, of which 20 and 20 are drawn for the splits: the leaves and the threshold know all."""
    from pyspark.sql import functions as F

    words = F.concat_ws(" ", *[F.concat(F.lit(f"w{k}"), F.when(F.col("id") % 5 == 0, F.lit("###" * (k % 3))).otherwise(""), F.col("id") % (k + 7)) for k in range(60)])
    docs = spark.range(600).select(F.col("id").alias("doc_id"), words.alias("text"))
    labels = spark.range(200, 600).select(F.col("id").alias("doc_id"), (F.col("id") % 5 != 0).cast("int").alias("quality"))
    forest, cut = quality.fit(docs, labels, sample_rows=20)
    rows = quality.measured(docs).toPandas()
    features = np.array(rows["features"].tolist())
    assert not rows["base_failed"].any() and forest.psi <= 40
    leaf = np.array([[forest._reached(features[i : i + 1], t)[0] for i in range(600)] for t in range(5)])
    for t in range(5):
        at, n = np.unique(leaf[t], return_counts=True)
        assert forest.path[t, at] == pytest.approx(forest.ends[t, at] + quality.mean_path(n / 600 * forest.psi))
    scores = np.round(forest.score(features), quality.SCORE_DIGITS)
    known = (rows["doc_id"] >= 200).to_numpy()
    assert cut == quality.threshold(scores[known], (rows["doc_id"] % 5 != 0).to_numpy()[known])
    kept = {r["doc_id"] for r in quality.quality_rules(docs, forest, cut).where("kept").collect()}
    assert kept == set(rows["doc_id"][scores < cut])
