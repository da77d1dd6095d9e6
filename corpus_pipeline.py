"""Corpus preparation in five stages, each one operator of ``dunning.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written
as Parquet and read again as the next stage's ``docs``, so a lost executor repeats
work of one stage at most. All stages but the last return the columns they were given.

Defined results: rows without text are ordinary rows (not toxic, never near copies,
0 tokens); of rows with the same id one stays after the second stage; rows without
an id are never near copies of each other unless their texts are equal; an empty
table gives an empty result; extra columns are carried along.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dunning.llm import bpe, mixing, ngram_join, suffix_dedup, toxicity
from dunning.llm.graph import shared_folder
from dunning.llm.queries import table, vocabulary

REJECT = 0.5      # toxicity score from which a document goes
WORDS = 51        # words of a repeated passage
LENGTH = 2 * WORDS - 1  # bytes that so many words have at least
LONG = 400        # bytes from which a passage of fewer words counts too (scripts without spaces)
MIX_POWER = 0.5   # a source's target share goes with the root of its size
SEED = 7
BATCH_BYTES = 4 << 20  # of rows that go to a Python worker at once, where the session allows more
REMEMBERED = 100_000  # words or chunks that a worker remembers: all stages share the workers' memory


def _fresh(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``REJECT``; the score is learned from the labels of rows not held out."""
    labels = table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels.where(~toxicity.held_out("doc_id")))
    return docs.where(toxicity.score_column(lexicon, "text", remembered=REMEMBERED) < REJECT)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by word 5-gram sets of similarity 0.8 or more, the document with the smallest id."""
    joined = ngram_join.similarity_join(docs, n=5, threshold=80)
    first = joined.where("doc_id = component_id").select("doc_id").distinct()
    row = _fresh(docs, "_row")

    def one(rows: DataFrame, key: Column) -> DataFrame:
        numbered = rows.withColumn(row, F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64("text"))))
        return numbered.where(F.col(row) == 1).select(*docs.columns)

    # the window over ids needs no exchange beyond that of the join
    kept = one(docs.join(first, "doc_id", "left_semi"), F.col("doc_id"))
    return kept.union(one(docs.where(F.col("doc_id").isNull()), F.sha2("text", 256)))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of ``WORDS`` words or ``LONG`` bytes that occur anywhere else; ``n_chars`` follows.
    Every occurrence goes, the first included, so nothing of such a passage stays in the corpus.

    Repeats are found from ``LENGTH`` bytes on, which no passage of ``WORDS`` words is below."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    done = suffix_dedup.remove_repeats(docs, length=LENGTH, keep=others, with_text=True, words=WORDS, long=LONG)
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text").alias("text"),
               "n_chars": F.char_length("kept_text").cast("long").alias("n_chars")}
    return done.select(*[columns.get(c, F.col(f"kept.`{c}`").alias(c)) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that each source has its target share, in a global random order."""
    return mixing.mix(docs, power=MIX_POWER, seed=SEED).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of every text."""
    return bpe.encode_and_decode(docs, *vocabulary(), with_ids=True, remembered=REMEMBERED)


def in_small_batches(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with Arrow batches of ``BATCH_BYTES`` at most: JVM and Python each hold a batch several times over for
    every task, and the JVM keeps such memory once taken for all stages after it."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        name = "spark.sql.execution.arrow.maxBytesPerBatch"
        allowed = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
        if allowed > BATCH_BYTES:
            spark.conf.set(name, str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, in_small_batches(stage)) for name, stage in (
    ("toxicity", drop_toxic),
    ("ngram_join", keep_one_of_near_copies),
    ("suffix_array", cut_repeats),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
)]

#: Levenshtein automata, byte-wise suffixes and BPE merges have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what stands between two stages lies in the shared checkpoint folder."""
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
