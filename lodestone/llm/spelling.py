"""Spelling variant grouping by a rare-first prefix filter over positional bigrams.

Words within one edit share all bigrams but the at most two that the edit touches. So with bigrams ordered by their frequency in
the vocabulary, rarest first, of the three rarest of either word one stands in the other as well, unchanged, and shifted by the
edit at most; the word whose third is rarer has it among its own three. (Where the third's bigram stands in a word again, its other
places count too, which keeps that argument whole under ties.) Only these join, with limits on the position:

* equal lengths (a replacement): the bigram stands at the same place, and
* lengths that differ by one: at the same place (the edit is right of it) or one further in the longer word (it is left of it).

As the bigram itself is untouched, the edit lies in one of four zones: the near or far half of what is left or right of it. All
outside that zone is equal, so it belongs to the key of the join, and few pairs that share a key aren't near. Each candidate is
verified by its edit distance, and each pair of near words counts once.

The order of bigrams is the only thing that passes through the driver: words consist of 90 characters at most, so there are at most
8,100 bigrams. Keys of many words (a common ending) are split by adaptive execution's skewed joins, and no group is gathered.

Defined cases: null and empty texts have no words; a null id counts as the text 'null' in the hash; repeated rows count again. The
vocabulary's words have LEAST or more characters and OCCURRENCES or more occurrences. An empty table gives no rows. Other columns aren't
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, stored, table

#: The letters of a run; all have one byte in Latin-1.
RUN = r"[A-Za-zÀ-ÿ]"
LEAST = 7
OCCURRENCES = 2
#: A form is so many times as frequent as the word.
RATIO = 10
#: Of so many runs one loses a character.
DAMAGED = 31
#: An edit touches two bigrams at most, so one of three survives.
PREFIX = 3


def occurrences(docs: DataFrame, least: int = LEAST, damaged: int = DAMAGED) -> DataFrame:
    """word: each run of letters of docs(doc_id, text) of least or more characters, in lower case A-Z, some without one character."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN + "{%d,}" % least), F.lit(0))).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    lower = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hashed = runs.select(lower.alias("run"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"))
    hashed = hashed.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    word = F.when(F.col("h") % damaged == 0, F.concat(F.expr("left(run, cast(h % char_length(run) as int))"), F.col("run").substr(at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.char_length("word") >= least)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words that occur OCCURRENCES times or more."""
    return occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


def _bigrams(word: str) -> list[bytes]:
    b = word.encode("latin-1")
    return [b[i : i + 2] for i in range(len(b) - 1)]


def bigram_order(words: DataFrame) -> dict[bytes, int]:
    """The place of each bigram by its frequency in words(word), rarest first, ties by its bytes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for rows in batches:
            for w in rows["word"]:
                for g in _bigrams(w):
                    seen[g] = seen.get(g, 0) + 1
        yield pd.DataFrame({"gram": list(seen), "n": list(seen.values())})

    found = words.select("word").mapInPandas(count, "gram binary, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # 8,100 at most
    return {g: k for k, (_, g) in enumerate(sorted((r["n"], bytes(r["gram"])) for r in found))}


def prefix(word: str, order: dict[bytes, int]) -> list[int]:
    """The places of the word's PREFIX rarest bigrams, and of those that equal the last of them."""
    ranked = sorted((order[g], i) for i, g in enumerate(_bigrams(word)))
    last = ranked[min(PREFIX, len(ranked)) - 1][0]
    return [i for rank, i in ranked if rank <= last]


def _zones(first: str, end: str, side: int, longer: bool) -> list[str]:
    """Structs (key, side) in SQL for a word and the place p of a bigram, in terms of the shorter word's length m. first..end: what an edit
    may hold, left and right of the bigram; each half is a zone [a, b), and the key is all outside of it."""
    out = []
    skip = 2 if longer else 1  # the longer word has one more character within the zone
    for zone, (a, b) in enumerate((("0", f"({first}) div 2"), (f"({first}) div 2", first), ("p + 2", f"(p + 2 + {end}) div 2"), (f"(p + 2 + {end}) div 2", end))):
        begin, stop = (a, b) if side == 0 else (a, f"{b} - 1")
        key = f"xxhash64({min(side, 1)}, {zone}, p, m, left(word, {begin}), substr(word, {stop} + {skip}))"
        out.append(f"case when {b} > {a} then struct({key} as key, {side} as side) end")
    return out


def keys(words: DataFrame, order: dict[bytes, int]) -> DataFrame:
    """word, n, key, side: a row for each bigram of a word's prefix, zone and role. side 0: words of equal length; 1: the shorter, 2: the
    longer of two."""

    @F.pandas_udf("array<int>")
    def places(batch: pd.Series) -> pd.Series:
        return batch.map(lambda w: prefix(w, order))

    rows = words.select("word", "n", F.char_length("word").alias("size"), F.explode(places("word")).alias("at"))
    # A replaced character lies in [0, p) or [p + 2, m). A character may be inserted at the places 0..p or p + 2..m.
    same = rows.select("word", "n", F.col("at").alias("p"), F.col("size").alias("m")).select("word", "n", F.explode(F.array_compact(F.expr(f"array({', '.join(_zones('p', 'm', 0, False))})"))).alias("k"))
    shorter = rows.select("word", "n", F.col("at").alias("p"), F.col("size").alias("m")).select("word", "n", F.explode(F.array_compact(F.expr(f"array({', '.join(_zones('p + 1', 'm + 1', 1, False))})"))).alias("k"))
    left, right = _zones("p + 1", "m + 1", 2, True)[:2], _zones("p + 1", "m + 1", 2, True)[2:]
    longer = rows.select("word", "n", F.col("at"), (F.col("size") - 1).alias("m"))
    before = longer.where("at >= 1").withColumn("p", F.col("at") - 1).select("word", "n", F.explode(F.array_compact(F.expr(f"array({', '.join(left)})"))).alias("k"))
    behind = longer.where("at + 2 <= m").withColumn("p", F.col("at")).select("word", "n", F.explode(F.array_compact(F.expr(f"array({', '.join(right)})"))).alias("k"))
    return same.unionByName(shorter).unionByName(before).unionByName(behind).select("word", "n", "k.key", "k.side")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, an, b, bn: each pair of words(word, n) of LEAST or more characters that are one edit apart, once."""
    rows = keys(words, bigram_order(words))
    a, b = rows.toDF("a", "an", "key", "a_side"), rows.toDF("b", "bn", "key", "b_side")
    meet = ((F.col("a_side") == 0) & (F.col("b_side") == 0) & (F.col("a") < F.col("b"))) | ((F.col("a_side") == 1) & (F.col("b_side") == 2))
    near = F.levenshtein("a", "b", 1) == 1
    return a.join(b, "key").where(meet).where(near).select("a", "an", "b", "bn").distinct()


def forms(pairs: DataFrame) -> DataFrame:
    """word, n_near, form, form_n: the number of near words, and the most frequent of them (ties: the first in order of code points)."""
    one = pairs.select(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("n"), F.col("b").alias("word")).alias("other"))
    two = pairs.select(F.col("b").alias("word"), F.struct((-F.col("an")).alias("n"), F.col("a").alias("word")).alias("other"))
    best = one.unionByName(two).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    return best.select("word", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of links(word, form): the last of the forms that follow one another. Each step doubles the way behind a word, and as
    a form is RATIO times as frequent as its word, the way has few steps."""
    way = stored(links.select("word", F.col("form").alias("root")))
    while True:
        ahead = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = stored(way.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        drop_stored(way)
        moved = not step.where("moved").isEmpty()
        way = step.drop("moved")
        if not moved:
            return way


def _frequent(n: Column, form_n: Column) -> Column:
    return form_n >= RATIO * n


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of the vocabulary of docs(doc_id, text)."""
    words = stored(vocabulary(docs))
    best = forms(near_pairs(words))
    rows = words.join(best, "word", "left")
    has = _frequent(F.col("n"), F.col("form_n"))
    rows = stored(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n")))
    root = roots(rows.where("form is not null"))
    return rows.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
