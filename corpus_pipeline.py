"""Documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm.exact import exact_owners
from sluice.llm.language import NONE, identify, train
from sluice.llm.mixing import mix, tempered_targets, tokens_of, topic_of
from sluice.llm.queries import packed_pieces
from sluice.llm.setsketch import drop_near_copies
from sluice.session import ensure_shared_dir, materialize

#: Columns of the stages, named so that no column of the documents is in their way.
LANGUAGE = ("__lang_pred", "__lang_score", "__lang_mixture")
TOPIC, TOKENS = "__mixing_topic", "__mixing_tokens"
MIXING = ("__mixing_weight", "__mixing_probability", "__mixing_sampled", "__mixing_copies", "__mixing_misfit")
#: Expected tokens of what the mixing stage gives, as a share of all tokens.
KEEP = 0.8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any language go; a missing language is filled in."""
    model = train(docs)
    if not model:  # no row tells a language, so none can be told apart
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = identify(docs, model, carry=docs.columns, new=LANGUAGE)
    judged = judged.where(F.col(LANGUAGE[0]) != NONE)
    return judged.withColumn("lang", F.coalesce("lang", LANGUAGE[0])).select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    return exact_owners(docs, size_col="__group_size").select(*docs.columns)


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id stays."""
    return drop_near_copies(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled, or repeated, so that sources, languages and topics meet tempered shares."""
    classed = docs.withColumn(TOPIC, topic_of(F.col("text"))).withColumn(TOKENS, tokens_of(F.col("text")))
    narrow = materialize(classed.select("source", "lang", TOPIC, TOKENS), "classes")
    targets = tempered_targets(narrow, ["source", "lang", TOPIC], TOKENS)
    mixed = mix(classed, targets, TOKENS, KEEP, cells=narrow, new=MIXING, dimensions=["source", "lang", TOPIC])
    mixed = mixed.where(MIXING[2])
    copies = F.explode(F.sequence(F.lit(1), F.col(MIXING[3]))).alias(MIXING[0])
    return mixed.select(*docs.columns, copies).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and place."""
    return packed_pieces(docs)


def _ready(stage):
    """The stage, in a session that has a folder for intermediate tables."""

    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ensure_shared_dir(spark)
        return stage(spark, docs, sf_dir)

    return apply


STAGES = [
    ("language", _ready(known_language)),
    ("exact_dedup", _ready(distinct_texts)),
    ("near_dedup", _ready(distinct_contents)),
    ("mixing", _ready(mixed_sources)),
    ("packing", _ready(packed_sequences)),
]

#: Tries, sketches, raking and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet and read again."""
    ensure_shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
