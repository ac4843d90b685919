"""From raw documents to packed sequences, as five stages that can each be run and stored alone.

Every stage but the last returns the columns of documents.  Stage by stage: documents that the
quality classifier rejects go; lines that repeat or nearly repeat an earlier line go, and with them
documents that have nothing left; of documents with a word 5-gram similarity of 0.8 or more one
stays; sources are mixed to target weights, so a row may go, stay or stay twice; what is left is
packed into token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qualiframe.llm import cutting_stock, line_dedup, mixing, ngram_join, quality
from qualiframe.llm.queries import vocabulary
from qualiframe.llm.words import word_count


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7; fitted on the documents given and their labels."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, least=0.7)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that stay; one whose every line repeats is gone, one that had none stays."""
    out = line_dedup.dedup(docs).filter("text is not null or n_removed = 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    return ngram_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; sources weigh 3, 1, 2, repeating, and share 150% of all words."""
    slots = [f"_c{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, slots))
    mixed = mixing.mix(docs.toDF(*slots), key=of["doc_id"], source=of["source"], text=of["text"], size=word_count(F.col(of["text"])), weights=(3, 1, 2), share=1.5, cap=2.0)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    return mixed.filter("copies > 0").select(*slots, copies.alias("_copy")).drop("_copy").toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 4096 tokens."""
    return cutting_stock.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2, length=4096, keep_ids=False)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", join_ngrams),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: Learned scores, MinHash and token ids are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is stored in the shared folder and read again by the next."""
    from qualiframe.llm.scratch import Scratch

    work = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = work.save(stage(spark, docs, sf_dir), f"stage{k}")
        if before:
            work.drop(before)
        before = f"stage{k}"
    return docs
