"""From raw documents to packed training sequences: five stages, each written and read again by the next."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reeltide.llm import copies, language, packing, quality, substrings
from reeltide.llm.common import ship, staged
from reeltide.session import tune

#: A text is in none of the languages if it needs so many times the bits a letter that labelled texts usually need (and the bits of some
#: phrases, for short texts), or if the score is under the least.
BITS_FACTOR = 2.1
SPARE_BITS = 60.0
MIN_SCORE = 0.3

#: Several stages cannot be expressed in SQL (EM, automata, XXH64, a tokenizer); the tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the posterior reject go."""
    ship(tune(spark))
    return quality.quality(docs, with_row=True).filter("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages that the labelled documents are in, go. What texts usually need is measured on
    labelled documents that nothing was learned from."""
    ship(tune(spark))
    unseen = language.held_out()
    references = language.learn(docs.filter(~unseen))
    most = BITS_FACTOR * language.usual_bits(docs.filter(unseen), references)
    told = language.identify(docs, references)
    fits = F.col("bits") * F.col("letters") <= F.lit(most) * F.col("letters") + SPARE_BITS
    return told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_SCORE) & fits).select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the smallest row stays; the classes are op8's, joined with the copies in which some words were changed (see
    :mod:`reeltide.llm.copies`). Rows without an id stay."""
    ship(tune(spark))
    return copies.drop_near_copies(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut out of the text; a text without such passages stays as it is."""
    ship(tune(spark))
    out = substrings.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    ship(tune(spark))
    return packing.pieces_digest(packing.pack_documents(docs, public_tokenizers.path(packing.WORD_BPE)))


STAGES = [("quality rules", quality_rules), ("language ID", language_id), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between two stages the rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name.replace(" ", "-"))
    return docs
