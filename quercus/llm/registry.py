"""The queries of this package over the given tables, and their SQL where SQL can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quercus.llm import alignment, bm25, decontamination, hard_negatives, jaccard_join, packing, quality, sharding, substring_dedup
from quercus.llm import token_counts, token_orc, toxicity, warc
from quercus.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as ORC and read back."""
    ws = Workspace(spark)
    path = ws.path("token-ids")
    token_orc.write(table(spark, sf_dir, "documents"), path)
    return token_orc.digest(spark, path, ws)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return packing.piece_digests(packing.packed(table(spark, sf_dir, "documents")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files."""
    return token_counts.document_counts(table(spark, sf_dir, "documents"), Workspace(spark))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document, by FM-index."""
    return decontamination.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Workspace(spark)
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by byte ranges."""
    return warc.round_trip(table(spark, sf_dir, "pages"), Workspace(spark))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by its latent-semantic neighbours."""
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and link counts by MinHash banding."""
    return jaccard_join.classes_and_links(table(spark, sf_dir, "documents"), Workspace(spark))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by its nearest labelled examples."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Workspace(spark))


def op9_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose id is divisible by 100."""
    documents, ws = table(spark, sf_dir, "documents"), Workspace(spark)
    return bm25.search(bm25.build_index(documents, ws), documents.where("doc_id % 100 = 0"), ws)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a document with a smaller id holds too, by FM-index."""
    return substring_dedup.digest(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of two tokenizers aligned in every document, with the counts of their links."""
    return alignment.digest(table(spark, sf_dir, "documents"), Workspace(spark))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives for every anchor and positive, by bounds on segments."""
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), Workspace(spark))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to 40 shards of near equal bytes and read back."""
    documents, ws = table(spark, sf_dir, "documents"), Workspace(spark)
    path = ws.path("shards")
    sharding.write(documents, path, ws)
    return sharding.digest(spark, path, sharding.document_type(documents))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_orc": op1_token_orc,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_toxicity": op8_toxicity,
    "op9_bm25": op9_bm25,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_cross_tokenizer": op11_cross_tokenizer,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sharding": op13_sharding,
}
ORACLES: dict[str, str] = {"op12_hard_negatives": hard_negatives.ORACLE}
