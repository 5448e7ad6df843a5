"""The operators of this package as queries over the given tables, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varve.llm import oracles
from varve.llm.exact import exact_groups
from varve.llm.isolation import isolate
from varve.llm.kdtree import top_k
from varve.llm.lloyd import CLUSTERS, DIMS, ROUNDS, SCALE, cluster
from varve.llm.mixing import mix
from varve.llm.passages import sharing
from varve.llm.pieces import encode, read_model
from varve.llm.quality import quality
from varve.llm.quotes import link_quotes
from varve.llm.secrets import scan
from varve.llm.simhash import near_groups
from varve.llm.suffixes import without_repeats
from varve.llm.tables import documents, labels
from varve.llm.toxicity import toxicity
from varve.llm.whitening import whiten

# Shares of the mixture: three for the largest source, one for each other.
MIXTURE = {"src0": 3.0, **{f"src{i}": 1.0 for i in range(1, 20)}}

# A value of more owners or repositories is copied widely; fewer bits per character are no random key.
MAX_OWNERS, MAX_REPOSITORIES, LEAST_BITS = 2, 4, 3.0

# Every so many vec_id is a query, for so many neighbours.
QUERY_STEP, NEIGHBOURS = 50, 5

# A public vocabulary of 32,000 pieces with byte fallback.
MODEL = "file:///opt/tokenizers/piece_bpe_32k.model"


def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Owners are the sources; a repository is what one source has in one language."""
    repository = F.concat_ws("/", "source", "lang")
    return scan(documents(spark, folder), F.col("source"), repository, MAX_OWNERS, MAX_REPOSITORIES, LEAST_BITS)


def quoted_messages(spark: SparkSession, folder: str) -> DataFrame:
    """The given conversations as mail: each message quotes the one before it, and that one's quote."""
    given = spark.read.parquet(f"{folder}/conversations.parquet")
    said = given.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    quote = lambda text, mark: F.concat(F.lit(mark), F.replace(text, F.lit("\n"), F.lit("\n" + mark)), F.lit("\n"))
    before = said.select("conv_id", (F.col("turn") + 1).alias("turn"), quote(F.col("said"), "> ").alias("first"))
    earlier = said.select("conv_id", (F.col("turn") + 2).alias("turn"), quote(F.col("said"), "> > ").alias("second"))
    joined = given.join(before, ["conv_id", "turn"], "left").join(earlier, ["conv_id", "turn"], "left")
    parts = [F.coalesce(part, F.lit("")) for part in ("second", "first", "text")]
    return joined.select("conv_id", "turn", "role", F.concat(*parts).alias("text"))


def quote_links(spark: SparkSession, folder: str) -> DataFrame:
    linked = link_quotes(quoted_messages(spark, folder))
    return linked.select(
        "conv_id", "turn", "role", F.md5("body").alias("body_md5"), "n_quoted", "n_linked", "parent_turn", "root_turn", "depth"
    )


def nearest(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), F.col("vec_id") % QUERY_STEP == 0, NEIGHBOURS)


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode(documents(spark, folder), read_model(spark, MODEL), with_ids=False)
    return encoded.select("doc_id", "n_tokens", "ids_sha256", "round_trip")


def text_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(documents(spark, folder), labels(spark, folder))


def text_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(documents(spark, folder), labels(spark, folder))


def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """What each document loses, whether it loses any, and whether it shares a passage of 50 words with another."""
    docs = documents(spark, folder)
    without = without_repeats(docs, sharing=sharing(docs)).drop("kept")
    return without.withColumn("has_repeats", (F.col("n_removed") > 0).cast("int"))


def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_groups(documents(spark, folder))


def mixture(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix(documents(spark, folder), MIXTURE, rest=1.0)
    return mixed.select("doc_id", "source", "rate", "copy", "shuffle_key")


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(documents(spark, folder))


def whitened(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{folder}/embeddings.parquet"))


def isolated(spark: SparkSession, folder: str) -> DataFrame:
    return isolate(documents(spark, folder), labels(spark, folder))


QUERIES = {
    "op1_secret_scan": secret_scan,
    "op2_quote_links": quote_links,
    "op3_nearest": nearest,
    "op4_pieces": pieces,
    "op5_text_toxicity": text_toxicity,
    "op6_text_quality": text_quality,
    "op7_repeated_passages": repeated_passages,
    "op8_simhash_groups": simhash_groups,
    "op9_mixture": mixture,
    "op10_exact_dedup": exact_dedup,
    "op11_whitening": whitened,
    "op12_centroids": centroids,
    "op13_isolation": isolated,
}

ORACLES = {
    "op1_secret_scan": oracles.secret_scan(MAX_OWNERS, MAX_REPOSITORIES, LEAST_BITS),
    "op2_quote_links": oracles.QUOTE_LINKS,
    "op3_nearest": oracles.nearest(QUERY_STEP, NEIGHBOURS),
    "op9_mixture": oracles.mixture(MIXTURE),
    "op10_exact_dedup": oracles.EXACT_DEDUP,
    "op12_centroids": oracles.centroids(DIMS, CLUSTERS, ROUNDS, SCALE),
}
