"""N-gram Jaccard join with token-combination prefixes, and the groups that its links make.

A document is the set of its distinct word shingles, as 64-bit hashes; sets that are equal are one class. Two classes link
when their similarity is THRESHOLD per cent or more. Of n shingles at most slack(n) = n - ceil(n * THRESHOLD / 100) are
missing in a linked set, so in any common order of shingles, prefixes of slack(n) + s of them share s at least. The join
uses that three times, each with less data:

1. Screening. In the order of hashes, prefixes of slack + a tenth are counted; a class goes on if as many of its prefix's
   shingles as a linked set must share occur in another class's prefix, and once more among the classes that go on.
   Only prefixes travel, a fifth of the shingles.
2. Of the classes that go on all shingles are counted. A class goes on if, without those that only it has, enough is left.
3. Indexing. In the order of rarity, prefixes are extended to share more shingles. A rare shingle (in at most RARE classes)
   is a key by itself; frequent ones only in combinations of K. So that long sets haven't a number of combinations that
   grows with the square of their slack, shingles fall into g parts by their value, g a power of two about the slack's
   CLASS-th part; prefixes are extended to share g + 1, of which two fall into one part, and only combinations within a part
   are keys. A pair goes by the smaller set's g, so a set has the keys of each g that its partners' sizes may have, two at most
   for a threshold of 50 or more. Linked sets share a rare shingle or a combination.

Verification avoids pairs within a key's group. First each member is compared with the key's pivot, the member with the
fewest shingles of its own; those links make components. Then only members of different components that share a key
are compared, if sizes, shared shingles and what their prefixes share leave a link possible, each pair once. No link that joins two components is lost.

Defined cases: null or wordless texts have an empty set and link with nothing; their component is their own id. Texts of
fewer words than a shingle are one shingle of all their words. Repeated rows are equal sets. Null ids are members like
others but give no component its id; a component without any id has a null one. Sets are exact but for equal 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, give_back, joined_by_key, stored, table, text_slices
from .components import components

SHINGLE = 3
THRESHOLD = 90
K = 2
RARE = 24
#: Slack for each part that frequent shingles fall into.
CLASS = 8
#: Up to so many chosen rows (some 40 bytes each) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
KEPT_WORDS = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_WORDS: dict[bytes, int] = {}


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLIERS[k % 3]
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() splits on the ASCII blanks
    if not words:
        return np.zeros(0, dtype=np.int64)
    if len(_WORDS) > KEPT_WORDS:
        _WORDS.clear()
    known = _WORDS
    hashes = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, np.uint64(n))
    with np.errstate(over="ignore"):
        for k in range(n):
            h = _mixed(h + hashes[k : len(words) - n + 1 + k], k)
    return np.unique(h.view(np.int64))


def slack(n: int, threshold: int = THRESHOLD) -> int:
    """The most shingles of n that a linked set lacks."""
    return n - -(-n * threshold // 100)


def shared(n: int, threshold: int = THRESHOLD) -> int:
    """How many shingles the screening prefixes share with a linked set's."""
    return min(n - slack(n, threshold), max(K, -(-n // 10)))


def _sets(batches, size: int, threshold: int, whole: bool):
    """whole: all shingles of each text, else its size, class and screening prefix."""
    import pyarrow as pa

    for batch in batches:
        first, texts, key = batch.column(0), batch.column(1), batch.column(batch.num_columns - 1)
        for at, end in text_slices(texts, 1_000_000):
            some = texts[at:end].to_pylist()
            sets = [shingles(t, size) for t in some]
            take = sets if whole else [s[: slack(len(s), threshold) + shared(len(s), threshold)] for s in sets]
            ends = np.zeros(len(take) + 1, dtype=np.int32)
            np.cumsum([len(s) for s in take], out=ends[1:])
            flat = pa.array(np.concatenate(take) if take else np.zeros(0, np.int64), pa.int64())
            cols = [first[at:end]]
            if not whole:
                cols += [key[at:end], pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())]
            cols.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            yield pa.RecordBatch.from_arrays(cols, names=["cls", "tokens"] if whole else ["doc_id", "key", "n", "cls", "prefix"])
    _WORDS.clear()
    give_back()


def document_sets(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key (hash of the text), n, cls (16 bytes that equal sets share), prefix, row (a number) for each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    found = rows.mapInArrow(lambda b: _sets(b, size, threshold, False), "doc_id long, key long, n long, cls binary, prefix array<long>")
    return found.withColumn("row", F.monotonically_increasing_id())


def _slack(n: Column, threshold: int) -> Column:
    return n - F.ceil(n * threshold / 100)


def _shared(n: Column, threshold: int) -> Column:
    return F.least(n - _slack(n, threshold), F.greatest(F.lit(K), F.ceil(n / 10)))


def _may_link(na: Column, va: Column, nb: Column, vb: Column, threshold: int) -> Column:
    """Sizes and shingles that others have leave a link possible."""
    return (100 * F.least(na, nb) >= threshold * F.greatest(na, nb)) & ((100 + threshold) * F.least(va, vb) >= threshold * (na + nb))


def _links(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs(a, b) that link, by whole sets(id, n, tokens)."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= threshold * (F.col("na") + F.col("nb") - both)).select("a", "b")


def screened(rows: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """cls, n, place of the classes that go on after screening."""
    n = F.col("n")
    needed = _shared(F.ceil(n * threshold / 100), threshold)
    prefixes = rows.where(n >= 2).select("row", F.explode("prefix").alias("token"))
    counts = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    matched = prefixes.join(counts, "token").groupBy("row").agg(F.collect_list(F.struct("c", "token")).alias("m"))
    # A class is judged by its first row; a shingle is another's too if it is counted more often than the class has rows.
    first = classes.select(F.col("first").alias("row"), "cls", "n", "place", "copies")
    own = F.transform(F.filter("m", lambda x: x["c"] > F.col("copies")), lambda x: x["token"])
    once = stored(matched.join(first, "row").select("row", "cls", "n", "place", own.alias("m")).where(F.size("m") >= needed))
    again = once.select("row", F.explode("m").alias("token"))
    common = again.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    left = again.join(common, "token").groupBy("row").agg(F.count(F.lit(1)).alias("c"))
    return once.drop("m").join(left, "row").where(F.col("c") >= needed).select("cls", "n", "place")


def candidate_sets(docs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """id, cls of the classes that may link; id, n, v, tokens: their v shingles that another of them has, rarest first, with their counts."""
    n = F.col("n")
    chosen = stored(screened(rows, classes, threshold).select("cls", F.col("place.doc_id").alias("at_id"), F.col("place.key").alias("at_key")))
    n_chosen = chosen.count()
    # One row of each class gives its text: the place that the class has kept.
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    texts = found.join(F.broadcast(chosen) if n_chosen <= BROADCAST_ROWS else chosen, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("key") == F.col("at_key")))
    sets = texts.select("cls", "text").mapInArrow(lambda b: _sets(b, size, threshold, True), "cls binary, tokens array<long>")
    sets = stored(sets.withColumn("id", F.monotonically_increasing_id()))
    if sets.count() != n_chosen:  # some rows repeat both id and text
        sets = stored(sets.dropDuplicates(["cls"]))
    tokens = sets.select("id", F.explode("tokens").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    left = tokens.join(counts, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("tokens"))
    sizes = sets.select("id", F.size("tokens").cast("long").alias("n"))
    kept = left.join(sizes, "id").where(100 * F.size("tokens") >= threshold * n)
    return sets.select("id", "cls"), stored(kept.select("id", "n", F.size("tokens").cast("long").alias("v"), "tokens"))


def _level(n: Column, threshold: int) -> Column:
    """The exponent of g, the number of parts, for a set of n shingles."""
    return F.floor(F.log2(F.greatest(F.lit(1), F.floor(_slack(n, threshold) / CLASS)).cast("double"))).cast("int")


def _parts(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("long")


def _length(level: Column, threshold: int) -> Column:
    """The prefix that shares _parts(level) + 1 shingles with a linked set's, less the shingles that are a set's own."""
    return F.greatest(F.lit(0), _slack(F.col("n"), threshold) + _parts(level) + 1 - (F.col("n") - F.col("v"))).cast("int")


def prefixes(sets: DataFrame, threshold: int) -> DataFrame:
    """id, n, v, p: the longest extended prefix of each set, less the shingles that are its own, rarest first, with their counts."""
    return sets.select("id", "n", "v", F.slice("tokens", F.lit(1), _length(_level(F.col("n"), threshold), threshold)).alias("p"))


def keys(rows: DataFrame, threshold: int) -> DataFrame:
    """key, id, n, v: the keys of each of prefixes(), single shingles and combinations."""
    single = rows.select("id", "n", "v", F.explode(F.transform(F.filter("p", lambda x: x["c"] <= RARE), lambda x: x["token"])).alias("key"))
    frequent = F.transform(F.filter(F.slice("p", F.lit(1), _length(F.col("level"), threshold)), lambda x: x["c"] > RARE), lambda x: x["token"])
    levels = F.sequence(_level(F.ceil(F.col("n") * threshold / 100), threshold), _level(F.col("n"), threshold))
    leveled = rows.select("*", F.explode(levels).alias("level")).select("id", "n", "v", "level", F.posexplode(frequent).alias("at", "token"))
    part = F.pmod(F.col("token"), _parts(F.col("level")))
    parts = leveled.groupBy("id", "n", "v", "level", part.alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("f"))
    pairs = F.expr("flatten(transform(f, (x, i) -> transform(slice(f, i + 2, size(f)), y -> xxhash64(x, y))))")
    combined = parts.where(F.size("f") >= K).select("id", "n", "v", F.explode(pairs).alias("key"))
    return single.unionByName(combined)


def _open_pairs(x: DataFrame, y: DataFrame, threshold: int) -> DataFrame:
    """a, b of different components that share a key and may link, once each."""
    # Up to the end of the prefix that ends first, what is shared is in both; beyond it, all that is left of that set may be shared.
    most = F.size(F.array_intersect("pa", "pb")) + F.when(F.col("ea") <= F.col("eb"), F.col("va") - F.size("pa")).otherwise(F.col("vb") - F.size("pb"))
    possible = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _may_link(F.col("na"), F.col("va"), F.col("nb"), F.col("vb"), threshold)
    on = (x["key"] == y["key"]) & possible & ((100 + threshold) * most >= threshold * (F.col("na") + F.col("nb")))
    return x.join(y, on).select("a", "b").distinct()


def class_components(docs: DataFrame, rows: DataFrame, classes: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """cls, component (a number) for each class that links with another."""
    names, sets = candidate_sets(docs, rows, classes, size, threshold)
    bare = sets.select("id", "n", F.transform("tokens", lambda x: x["token"]).alias("tokens"))
    prefixed = prefixes(sets, threshold)
    indexed = stored(keys(prefixed, threshold))
    pivots = indexed.groupBy("key").agg(F.min(F.struct((F.col("n") - F.col("v")).alias("own"), "id", "n", "v")).alias("pivot"), F.count(F.lit(1)).alias("c")).where("c > 1")
    a, b = F.col("id"), F.col("pivot.id")
    near = joined_by_key(indexed, pivots.select("key", "pivot", F.col("c").alias("n")), "key").where((a != b) & _may_link(F.col("n"), F.col("v"), F.col("pivot.n"), F.col("pivot.v"), threshold))
    links = stored(_links(near.select(a.alias("a"), b.alias("b")).distinct(), bare, threshold))
    made = components(links)
    # What is left: members of different components under one key. A member whose largest possible partner is smaller than all of them has none.
    largest = F.floor((100 + threshold) * F.col("v") / threshold) - F.col("n")
    placed = stored(indexed.join(made.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.col("n").alias("size"), "v", F.coalesce("component", "id").alias("component"), largest.alias("largest")))
    least = placed.groupBy("key").agg(F.min("size").alias("least"), F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n")).where("c1 != c2").select("key", "least", "n")
    alive = stored(joined_by_key(placed, least, "key").where("largest >= least").drop("least", "largest"))
    open_keys = alive.groupBy("key").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("n")).where("c1 != c2").select("key", "n")
    alive = joined_by_key(alive, open_keys, "key").withColumnRenamed("size", "n")
    ordered = prefixed.select("id", F.transform("p", lambda x: x["token"]).alias("p"), F.get("p", F.size("p") - 1).alias("end"))
    alive = stored(alive.join(ordered, "id").select("key", "id", "n", "v", "component", "p", "end"))
    rest = _open_pairs(alive.toDF("key", "a", "na", "va", "ca", "pa", "ea"), alive.toDF("key", "b", "nb", "vb", "cb", "pb", "eb"), threshold)
    more = stored(_links(rest, bare, threshold))
    made = made if more.isEmpty() else components(links.unionByName(more))
    return names.join(made.withColumnRenamed("node", "id"), "id").select("cls", "component")


def grouped(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, key (hash of the text), n, cls, linked (the class of its group, null for empty sets), component_id for each row of docs(doc_id, text)."""
    rows = stored(document_sets(docs, size, threshold))
    classes = rows.where("n > 0").groupBy("cls", "n").agg(F.min(F.struct("doc_id", "key")).alias("place"), F.min("doc_id").alias("id"), F.min_by("row", F.struct("doc_id", "key", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = stored(classes)
    made = stored(class_components(docs, rows, classes, size, threshold))
    least = classes.select("cls", "id").join(made, "cls").groupBy("component").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    of_class = classes.select("cls", "id", "copies").join(joined_by_key(made, least, "component"), "cls", "left")
    linked = F.coalesce(F.col("component").cast("string").cast("binary"), "cls").alias("linked")
    of_class = of_class.select("cls", F.col("copies").alias("n"), linked, F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    # A class may have a third of all rows as copies: such classes are broadcast, their rows stay where they are.
    plain = rows.drop("prefix")
    full = joined_by_key(plain.where("n > 0"), of_class, "cls")
    return full.unionByName(plain.where("n = 0").withColumns({"linked": F.lit(None).cast("binary"), "component_id": F.col("doc_id")}))


def ngram_join(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs(doc_id, text)."""
    return grouped(docs, size, threshold).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """docs without all but one of each group: the row of the smallest id, null last, then of the smallest hash of its text.
    Rows without words stay. Rows that repeat both id and text are one document, of which one row stays."""
    rows = grouped(docs, size, threshold)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")
    firsts = rows.where("n > 0").groupBy("linked").agg(F.min(place).alias("place"))
    empty = rows.where("n = 0").select(place.alias("place")).distinct()
    kept = stored(firsts.select("place").unionByName(empty))
    key, at_id, at_key = fresh(docs, "text_key", "at_id", "at_key")
    chosen = kept.select(F.col("place.doc_id").alias(at_id), F.col("place.key").alias(at_key))
    out = docs.withColumn(key, F.xxhash64("text")).join(chosen, F.col("doc_id").eqNullSafe(F.col(at_id)) & (F.col(key) == F.col(at_key)), "left_semi")
    again = rows.groupBy("doc_id", "key").count().where("count > 1")
    return (out if again.isEmpty() else out.dropDuplicates(["doc_id", key])).select(docs.columns)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
