"""Line dedup, substring dedup and the n-gram join against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import line_dedup, ngram_join, substring_dedup

BLANKS = " \t\n\x0b\x0c\r"


def in_order(rows):
    """Distinct (id, text) in the operators' order of places, null ids first; ties by hash don't occur here."""
    return sorted({(r["doc_id"], r["text"]) for r in rows if r["text"] is not None}, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def brute_lines(rows, window=3, long_words=None):
    """Lines in runs of window lines, or of fewer that have long_words words, that occur at an earlier place."""
    seen, out = set(), {}
    for d, t in in_order(rows):
        ls = t.split("\n")
        full = [(i, x) for i, x in ((i, x.strip(" \t\r\f\x0b")) for i, x in enumerate(ls)) if x]
        gone = set()
        for n in range(1 if long_words else window, window + 1):
            for k in range(len(full) - n + 1):
                w = tuple(x for _, x in full[k : k + n])
                if n < window and sum(len(re.findall(r"[^ \t\r\f\x0b]+", x)) for x in w) < long_words:
                    continue
                if w in seen:
                    gone |= {i for i, _ in full[k : k + n]}
                seen.add(w)
        out[d, t] = ("\n".join(x for i, x in enumerate(ls) if i not in gone), len(gone))
    return out


def brute_sentences(rows):
    seen, out = set(), {}
    for d, t in in_order(rows):
        gone = set()
        for first, n, h in substring_dedup.runs(t):
            if h in seen:
                gone |= set(range(first, first + n))
            seen.add(h)
        out[d, t] = ("".join(s for i, s in enumerate(substring_dedup.sentences(t)) if i not in gone), len(gone))
    return out


@pytest.mark.parametrize("table", ["hard", "small", "none"])
@pytest.mark.parametrize("operator, brute, count", [(line_dedup.line_dedup, brute_lines, "n_deleted_lines"), (substring_dedup.substring_dedup, brute_sentences, "n_removed")])
def test_runs_against_brute_force(request, table, operator, brute, count):
    docs = request.getfixturevalue(table)
    rows = docs.collect()
    want, got = brute(rows), operator(docs).collect()
    assert len(got) == len(rows)
    ids = collections.Counter(r["doc_id"] for r in rows)
    by_id = {(r["doc_id"]): (r["text"], r[count]) for r in got if ids[r["doc_id"]] == 1 and r["text"] is not None}
    for (d, t), w in want.items():
        if d in by_id:
            assert by_id[d] == w
    assert sum(r[count] for r in got) == sum(want[r["doc_id"], r["text"]][1] for r in rows if r["text"] is not None)
    assert table != "hard" or all(r["text"] is None and r[count] == 0 for r in got if r["doc_id"] == 3)


def test_repeated_rows_do_not_delete_each_other(hard):
    got = [r for r in line_dedup.line_dedup(hard).collect() if r["doc_id"] == 2]
    assert len(got) == 2 and all(r["text"] == "" and r["n_deleted_lines"] == 4 and r["n_chars"] == 0 for r in got)


def test_the_pipeline_drops_long_passages_on_one_or_two_lines(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    two = two.replace(" b25 ", " b25\n\n")
    texts = [one, f"x\n{one}", f"{two}\nown", f"other\n{two}", "short line\ntwo", "short line\ntwo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, None).orderBy("doc_id").collect()]
    assert got == [one, "x", f"{two}\nown", "other\n", "short line\ntwo", "short line\ntwo"]


def test_long_repeated_passage_goes_and_clean_text_stays(spark):
    random.seed(5)
    words = ["w" + str(random.randrange(5000)) for _ in range(4000)]
    passage = ". ".join(" ".join(words[i : i + 12]) for i in range(0, 60, 12)) + "."
    texts = [" ".join(words[100 + 60 * i : 150 + 60 * i]) + ".\n" + passage + "\n" + " ".join(words[2000 + 30 * i : 2030 + 30 * i]) + "." for i in range(5)] + [" ".join(words[3000:3300]) + "."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in substring_dedup.substring_dedup(docs).collect()}
    assert passage in got[0]["text"] and all(words[0] + " " + words[1] not in got[i]["text"] for i in range(1, 5))
    assert got[5]["text"] == texts[5] and got[5]["n_removed"] == 0


@pytest.mark.parametrize("lengths", [[5] * 11, [1] * 51, [14, 1, 1] * 3 + [1] * 3, [1] * 3 + [20] + [1] * 30])
def test_a_passage_of_short_sentences_is_covered_whole(lengths):
    passage = "".join(" ".join(f"p{k}x{i}" for i in range(n)) + ".\n" for k, n in enumerate(lengths))
    got = brute_sentences([{"doc_id": d, "text": f"own{d} start here.\n{passage}own{d} end here."} for d in (1, 2)])
    assert [n for _, n in got.values()] == [0, len(lengths)]


def plain_sentence_dedup(rows):
    """Windows compared as texts, without the module's sentences, runs or hashes."""
    firsts, texts = {}, {}
    for d, t in in_order(rows):
        cut, piece = [], ""
        for i, c in enumerate(t):
            piece += c
            if c in ".!?\n" and (i + 1 == len(t) or t[i + 1] not in ".!?\n"):
                cut.append(piece)
                piece = ""
        texts[d, t] = cut + [piece] * bool(piece)
        full = [(i, x) for i, x in ((i, " ".join(re.split(r"[ \t\n\x0b\x0c\r]+", x.lower().strip(".!? \t\n\x0b\x0c\r")))) for i, x in enumerate(texts[d, t])) if x]
        for n in (1, 2, 3):
            for k in range(len(full) - n + 1):
                run = tuple(x for _, x in full[k : k + n])
                if n == 3 or len(" ".join(run).split(" ")) >= {1: 40, 2: 28}[n]:
                    firsts.setdefault(run, []).append((d, t, full[k][0], full[k + n - 1][0]))
    gone = collections.defaultdict(set)
    for places in firsts.values():
        for d, t, a, b in places[1:]:
            gone[d, t] |= set(range(a, b + 1))
    return {k: ("".join(x for i, x in enumerate(v) if i not in gone[k]), len(gone[k])) for k, v in texts.items()}


def test_sentence_runs_against_an_independent_brute_force(spark):
    random.seed(11)
    said = ["Yes.", "No!", "And then?", "so it\n", "  go on.. ", "one two three four. ", " ".join(f"l{i}" for i in range(41)) + ".", " ".join(f"m{i}" for i in range(20)) + "!\n"]
    texts = ["".join(random.choice(said) if random.random() < 0.7 else f"own{i}x{k}. " for k in range(random.randrange(12))) for i in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = plain_sentence_dedup(docs.collect())
    got = substring_dedup.substring_dedup(docs).collect()
    assert {(r["doc_id"], texts[r["doc_id"]]): (r["text"], r["n_removed"]) for r in got} == want
    assert sum(n > 0 for _, n in want.values()) > 50


def test_three_short_sentences_go_where_they_repeat(spark):
    docs = spark.createDataFrame([(i, f"own{i} begin. It is so. We all know. Nine words end it. own{i} end.") for i in range(6)], "doc_id long, text string")
    got = [r["n_removed"] for r in substring_dedup.substring_dedup(docs).orderBy("doc_id").collect()]
    assert got == [0, 3, 3, 3, 3, 3]


def test_one_run_in_most_documents(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "concat('a b c.\n', 'd e f.\n', 'g h i.\n', 'own', id, '.') as text")
    assert substring_dedup.substring_dedup(docs).where("n_removed = 3").count() == 19_999


def shingles(text, size):
    words = (text or "").encode().translate(ngram_join._LOWER).split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute_components(texts, size, threshold):
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if both and 100 * both >= threshold * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.fixture(scope="module")
def near_copies():
    """Mutated copies of one text, more than RARE so that combinations are used; long ones beyond the wide bound; short sets at the threshold."""
    random.seed(3)
    vocabulary = [f"v{i}" for i in range(2000)]
    texts = []
    for length, copies, most in ((150, 160, 6), (700, 50, 40)):
        base = [random.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            b = list(base)
            for _ in range(random.randrange(most)):
                k, r = random.randrange(len(b)), random.random()
                b[k : k + 1] = [random.choice(vocabulary)] if r < 0.5 else [] if r < 0.75 else [b[k], random.choice(vocabulary)]
            texts.append(" ".join(b))
    texts += [" ".join(f"z{i}" for i in range(n)) for n in (9, 10, 11, 12, 13, 11)]
    return texts + ["", "a", "A", "a b", " \n", "x y z", None] * 2


@pytest.mark.parametrize("size, threshold", [(3, 90), (5, 80)])
def test_join_against_brute_force(spark, near_copies, size, threshold):
    docs = spark.createDataFrame(list(enumerate(near_copies)), "doc_id long, text string")
    got = ngram_join.ngram_join(docs, size, threshold).orderBy("doc_id").collect()
    sizes, groups = brute_components(near_copies, size, threshold)
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == groups
    kept = sorted(r["doc_id"] for r in ngram_join.one_of_each(docs, size, threshold).collect())
    assert kept == [i for i, g in enumerate(groups) if g == i]


def test_groups_whose_pivots_link_only_some(spark):
    """In each group the pivot of every key is one of two short parts, which link with nothing; the near copies of unequal length do."""
    random.seed(11)
    texts = []
    for g in range(30):
        shared = [f"g{g}w{i}" for i in range(98)]
        random.shuffle(shared)
        own = random.randrange(8)
        for k, n in enumerate((own, random.randrange(11 - own), random.randrange(11 - own))):
            texts.append(" ".join(shared + [f"g{g}own{k}-{i}" for i in range(n)]))
        texts += [" ".join(shared[:49]), " ".join(shared[49:])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["component_id"] for r in ngram_join.ngram_join(docs, 1, 90).orderBy("doc_id").collect()]
    assert got == brute_components(texts, 1, 90)[1]


def test_join_of_hard_rows(hard, none):
    got = collections.defaultdict(list)
    for r in ngram_join.ngram_join(hard).collect():
        got[r["doc_id"]].append((r["n_shingles"], r["component_id"]))
    assert got[1] == [(got[1][0][0], 1)] and [c for _, c in got[2]] == [1, 1]
    assert got[3] == [(0, 3)] and got[4] == [(0, 4)] and got[5] == [(0, 5)]
    assert got[8] == [(1, 8)] and got[9] == [(1, 8)]
    assert sorted(got[None], key=str)[0][1] is None
    assert ngram_join.ngram_join(none).count() == 0
    kept = ngram_join.one_of_each(hard)
    assert kept.columns == hard.columns and kept.where("doc_id = 2").count() == 0 and kept.where(F.col("doc_id").isin(1, 3, 4, 5, 6, 7, 8)).count() == 7
    assert ngram_join.one_of_each(none).count() == 0


def test_a_null_id_takes_the_id_of_its_group(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (7, "A b c d"), (None, "q r s t")], "doc_id long, text string")
    got = sorted((r["component_id"] is None, r["component_id"]) for r in ngram_join.ngram_join(docs).collect())
    assert got == [(False, 7), (False, 7), (True, None)]
