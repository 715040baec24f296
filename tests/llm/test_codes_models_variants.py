"""Vector codes, the n-gram model and spelling variants against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import ngram_lm, spelling, vector_codes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# Vector codes

VECTORS = "vec_id long, embedding array<float>, label int, v string, code string"


def coded(rows):
    """The contract's codes, spelled out: vec_id, code, error, label_error of rows(vec_id, embedding, label), and the digest."""
    fits = [(i, [math.floor(4096 * float(np.float32(x))) for x in e], lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    seeds = [v for _, v, _ in sorted(fits, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]]
    size = len(seeds[0])
    cut = lambda v: [v[p * size // 8 : (p + 1) * size // 8] for p in range(8)]
    books = [[list(cut(s)[p]) for s in seeds] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((far(x, e), k) for k, e in enumerate(books[p]))
    for _ in range(6):
        members = collections.defaultdict(list)
        for _, v, _ in fits:
            for p, x in enumerate(cut(v)):
                members[p, near(x, p)[1]].append(x)
        for (p, k), xs in members.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, by_label = [], collections.Counter()
    for i, v, lab in fits:
        found = [near(x, p) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=repr)


def codes(df):
    return sorted(map(tuple, vector_codes.vector_codes(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def test_codes_are_the_contracts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(200)
    assert codes(df) == coded([(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()])


@pytest.mark.parametrize("size", [16, 11, 3])
def test_codes_of_hard_vectors(spark, size):
    r = random.Random(size)
    rows = [(i // 2 if i % 9 else None, [r.choice([0.0, 0.25, -0.25, r.uniform(-1, 1)]) for _ in range(size)], i % 3 or None, "x", "y") for i in range(90)]
    rows += [(500, [r.uniform(-40000, 300000.0) for _ in range(size)], 2, None, None), rows[4], rows[5], (501, None, 1, "", ""), (502, [None] * size, 1, "", ""), (503, [math.nan] * size, 1, "", ""), (504, [math.inf] * size, 1, "", "")]
    assert codes(spark.createDataFrame(rows, VECTORS)) == coded([r[:3] for r in rows])


def test_few_or_no_vectors(spark):
    assert codes(spark.createDataFrame([], VECTORS)) == []
    rows = [(3, [1.0] * 8, None, "", ""), (1, [2.0] * 8, None, "", ""), (2, [1.0] * 9, None, "", "")]  # another length than the first seed's goes
    assert codes(spark.createDataFrame(rows, VECTORS)) == coded([r[:3] for r in rows[:2]])


def test_the_annulus_holds_the_nearest():
    r = np.random.default_rng(5)
    for high in (3, 50, 1 << 27):
        book, x = r.integers(-high, high, (16, 8)), r.integers(-high, high, (3000, 8))
        want = ((x[:, None, :] - book) ** 2).sum(2)
        index, best = vector_codes.Codebook(book).nearest(x)
        assert (index == want.argmin(1)).all() and (best == want.min(1)).all()


def test_codes_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    df = vector_codes.op11_vector_codes(spark, sf_dir)
    rel = con.sql(vector_codes.ORACLE_SQL)
    assert sorted(rel.columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*rel.columns).collect())) == sorted(rel.fetchall())


# The n-gram model


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


class KneserNey:
    """The model of texts by dictionaries."""

    def __init__(self, texts):
        texts = [tokens(t) for t in texts]
        self.words = collections.Counter(w for t in texts for w in t)
        self.n, self.v = sum(self.words.values()), len(self.words)
        self.three = collections.Counter(tuple(s[k - 2 : k + 1]) for t in texts for s in [["<", "<", *t]] for k in range(2, len(s)))
        self.two = collections.Counter((b, c) for _, b, c in self.three)
        self.one = collections.Counter(c for _, c in self.two)
        self.discounts = [self.discount(c) for c in (self.one, self.two, self.three)]
        self.left2, self.left3 = collections.defaultdict(lambda: [0, 0.0]), collections.defaultdict(lambda: [0, 0.0])
        for counts, left, order in ((self.two, self.left2, 1), (self.three, self.left3, 2)):
            for gram, n in counts.items():
                left[gram[:-1]][0] += n
                left[gram[:-1]][1] += self.less(order, n)
        self.total = sum(self.one.values())
        self.rest = sum(self.less(0, n) for n in self.one.values()) / self.total if self.total else 1

    @staticmethod
    def discount(counts):
        n = [sum(x == k for x in counts.values()) for k in range(5)]
        if not all(n[1:]):
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0] + [min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3)]

    def less(self, order, n):
        return self.discounts[order][min(n, 3)]

    def p(self, a, b, c):
        p = (self.one[c] - self.less(0, self.one[c])) / max(self.total, 1) + self.rest / (self.v + 1)
        for gram, counts, left, order in (((b, c), self.two, self.left2, 1), ((a, b, c), self.three, self.left3, 2)):
            if gram[:-1] in left:
                total, rest = left[gram[:-1]]
                p = (counts[gram] - self.less(order, counts[gram])) / total + rest / total * p
        return p

    def score(self, text):
        t = tokens(text)
        s = ["<", "<", *t]
        base = sum(math.log10((self.words[w] + 1) / (self.n + self.v + 1)) for w in t)
        return len(t), sum(self.words[w] > 0 for w in t), base, sum(math.log10(self.p(*s[k - 2 : k + 1])) for k in range(2, len(s)))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def check_scores(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    brute = KneserNey([t for i, t in rows if not is_held_out(i)])
    docs = docs.withColumn("held_out", ngram_lm.held_out(docs["doc_id"]))
    model = ngram_lm.fit(docs.where("not held_out"))
    scored = ngram_lm.scores(docs, model)
    got = scored.select("doc_id", "held_out", *scored.columns[-4:]).collect()
    assert (model.tokens, model.vocabulary) == (brute.n, brute.v)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[4], 6), round(r[5], 6))
    want = sorted(((i, is_held_out(i), *brute.score(t)) for i, t in rows), key=key)
    assert [tuple(r)[:4] for r in sorted(map(tuple, got), key=key)] == [r[:4] for r in want]
    assert [x for r in sorted(map(tuple, got), key=key) for x in r[4:]] == pytest.approx([x for r in want for x in r[4:]], rel=1e-9)
    return brute, model


def test_scores_are_the_models(hard, small, none, monkeypatch):
    check_scores(none)
    check_scores(small)
    check_scores(hard)


def test_scores_in_small_parts(hard, monkeypatch):
    """The long text in parts of 2,000 bytes: n-grams across them count."""
    rows = pa.array([r["text"] for r in hard.collect()])
    whole = [h for s in ngram_lm.slices(rows) for h in s.hashes.tolist()]
    parts = list(ngram_lm.slices(rows, 2000))
    assert [h for s in parts for h in s.hashes.tolist()] == whole and any(not s.ends for s in parts)
    assert [len(tokens(t)) - 1 for t in rows.to_pylist()] == [sum(int(s.counts[s.rows == k].sum()) for s in parts) for k in range(len(rows))]


def test_parts_give_the_same_scores(hard, small):
    docs = small.select("doc_id", "text").limit(40)
    model = ngram_lm.fit(docs)
    reader = ngram_lm.Reader(model)

    def total(text, most):
        sequences, sum_ = ngram_lm.Sequences(reader), 0.0
        for s in ngram_lm.slices(pa.array([text]), most):
            ids, at, _, _ = sequences(s)
            sum_ += ngram_lm.log_probabilities(reader, ids, at).sum()
        return sum_

    text = " ".join(r["text"] or "" for r in docs.limit(5).collect()) + " " + "x" * 500 + " end"
    assert total(text, 100) == pytest.approx(total(text, 1 << 22), rel=1e-12)


def test_probabilities_of_all_words_add_up(small):
    docs = small.limit(30)
    brute, model = KneserNey([r["text"] for r in docs.collect()]), ngram_lm.fit(docs)
    reader = ngram_lm.Reader(model)
    words = [w for w in brute.words if w is not None]
    hashes = np.concatenate([s.hashes for s in ngram_lm.slices(pa.array(words))])
    order = np.argsort(hashes)
    ids = np.zeros(len(words), np.uint64)
    ids[order] = reader.words(hashes[order])[0]
    for a, b in [(ngram_lm.BEGIN, ngram_lm.BEGIN), (ngram_lm.BEGIN, ids[3]), (ids[0], ids[1]), (ids[5], ngram_lm.UNKNOWN)]:
        ends = np.concatenate([ids, [ngram_lm.END, ngram_lm.UNKNOWN]]).astype(np.uint64)
        run = np.stack([np.full(len(ends), a, np.uint64), np.full(len(ends), b, np.uint64), ends], axis=1).ravel()
        p = 10 ** ngram_lm.log_probabilities(reader, run, np.arange(len(ends)) * 3 + 2)
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_held_out_texts_are_likelier_than_by_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.withColumn("held_out", ngram_lm.held_out(docs["doc_id"]))
    rows = ngram_lm.scores(docs, ngram_lm.fit(docs.where("not held_out"))).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 0.8 * sum(r["base_score"] for r in rows)


def test_arrays_find_what_they_hold(tmp_path):
    r = np.random.default_rng(3)
    for n in (0, 1, 7, 5000):
        h = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
        counts = r.choice([1, 2, 254, 255, 256, 10**10], len(h)).astype(np.uint64)
        order, arrays = ngram_lm.hash_array(h, 1)
        ngram_lm.write_arrays(f"{tmp_path}/x", **arrays, **ngram_lm.small("n", counts[order]))
        got = ngram_lm.map_arrays(f"{tmp_path}/x")
        assert (ngram_lm.full(got, "n", ngram_lm.find(got, h, 1)) == counts).all()
        assert (ngram_lm.find(got, r.integers(0, 2**64, 1000, dtype=np.uint64), 1) == -1).all()
        for columns in ([np.sort(h), counts], [h[:0], counts[:0]]):
            assert all((a == b).all() for a, b in zip(ngram_lm.unpacked(ngram_lm.packed(*columns)), columns, strict=True))


# Spelling variants


def variants(rows):
    n = collections.Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            w = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w
            n[w] += len(w) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    near, gaps = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k] + "\0" + w[k + 1 :]].add(w)
            if (x := w[:k] + w[k + 1 :]) in n:
                near[w].add(x)
                near[x].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found(docs):
    return sorted(map(tuple, spelling.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_variants_of_documents(hard, small, none):
    for docs in (hard, small, none):
        assert found(docs) == variants([(r["doc_id"], r["text"]) for r in docs.collect()])


@pytest.mark.parametrize("letters, size", [("ab", 8), ("abcé÷", 7), ("aaaab", 12)])
def test_variants_of_alike_words(spark, letters, size):
    """Words of few letters: bigrams repeat and tie, and nearly all words are near others."""
    r = random.Random(size)
    words = ["".join(r.choice(letters) for _ in range(r.randint(size - 1, size + 2))) for _ in range(250)]
    text = [(i, " ".join(r.choices(words, weights=[1 + 400 // (k + 1) for k in range(250)], k=1500)).upper()) for i in range(6)]
    docs = spark.createDataFrame([(i, t.replace("É", "é")) for i, t in text], "doc_id long, text string")
    want = variants([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert found(docs) == want and any(w[4] for w in want)


def test_forms_follow_one_another(spark):
    rows = [("aaaaaab", "aaaaaac"), ("aaaaaac", "aaaaaad"), ("aaaaaad", "aaaaaae"), ("aaaaaae", "aaaaaaf"), ("bbbbbbb", "aaaaaad")]
    got = dict(map(tuple, spelling.roots(spark.createDataFrame(rows, "word string, form string")).collect()))
    assert set(got.values()) == {"aaaaaaf"} and len(got) == 5
