"""The corpus pipeline: five stages over the documents table, each written as Parquet and read again for the next.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. The first four return the columns
of documents; the last returns the sampled segmentations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import line_dedup, mixing, ngram_join, piece_sampling, toxicity
from lodestone.llm.common import stored, table

#: Near duplicates: shingles of so many words, at so many per cent.
SHINGLE, SIMILARITY = 5, 80
#: Repeated runs of one or two lines go too if they have so many words.
LONG_WORDS = 40


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that score toxic. The score is a function of a row's own text, so no shuffle is needed."""
    model = toxicity.fit(toxicity.training_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.without_toxic(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines of runs that an earlier place has; documents stay, n_chars follows."""
    return line_dedup.line_dedup(docs, long_words=LONG_WORDS).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, then of the smallest hash of its text."""
    return ngram_join.one_of_each(docs, SHINGLE, SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Documents without a word have no size and are left out."""
    return mixing.repeated(docs, table(spark, sf_dir, "labels"))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled segmentations of each document, as their digests."""
    return piece_sampling.digest(piece_sampling.sample_segmentations(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("mix sources", mix_sources),
    ("piece sampling", sample_pieces),
]

#: The first stage trains a model and the last samples by hashes; SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
