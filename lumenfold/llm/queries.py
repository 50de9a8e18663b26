"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .capfilter import near_duplicate_vectors
from .curves import nearest_neighbours
from .minhash import near_duplicates
from .mixing import mixing_plan
from .oracles import oracle_sql as oracle_sql
from .packing import pack
from .quality import quality_scores
from .sharding import minimax_shards
from .suffix import repeated_passages
from .tokencodec import encode_documents
from .toxicity import LEXICON, learned_terms, toxic_documents

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(_table(spark, sf_dir, "documents"))


def _tokenizer(name: str) -> tuple[str, str]:
    """Path of a rank file and the word pattern that goes with it."""
    import public_tokenizers

    return f"{TOKENIZERS}/{name}", public_tokenizers.PATTERN


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxic_documents(docs, lexicon=learned_terms(docs, _table(spark, sf_dir, "labels")) | LEXICON)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_space_filling_ann": lambda spark, sf_dir: nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=50),
        "op2_cap_filter_near_duplicates": lambda spark, sf_dir: near_duplicate_vectors(_table(spark, sf_dir, "embeddings")),
        "op3_minimax_shards": _documents(lambda d: minimax_shards(d, shards=64).withColumnRenamed("group", "doc_id")),
        "op4_entropy_mix": _documents(mixing_plan),
        "op5_suffix_repeats": _documents(repeated_passages),
        "op6_toxicity": _toxic,
        "op7_token_codec": _documents(lambda d: encode_documents(d, *_tokenizer("byte_bpe_50k.tiktoken"))),
        "op8_genetic_packing": _documents(pack),
        "op9_minhash_near_duplicates": _documents(near_duplicates),
        "op10_pu_quality": lambda spark, sf_dir: quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
    }

