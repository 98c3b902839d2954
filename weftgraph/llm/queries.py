"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import chatformat, embeddings, langid, media, mixing, neardup, packing, prefixtrie, quality, repair, secrets, sharding, warc

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _packed(documents: DataFrame) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.score_quality(documents, labels)


def queries() -> dict[str, Query]:
    return {
        "op1_prefix_sum_sharding": _over("documents", sharding.shard_documents),
        "op2_warc_index_merge": _over("pages", warc.archive_round_trip),
        "op3_string_kernel_langid": _over("documents", langid.identify),
        "op4_cell_cosine_dedup": _over("embeddings", embeddings.near_vectors),
        "op5_secret_ownership": _over("documents", secrets.secret_query),
        "op6_png_cosine_hash": _over("documents", media.media_query),
        "op7_pu_quality": _scored,
        "op8_bayes_minhash_dedup": _over("documents", lambda documents: neardup.near_duplicates(documents, 3, 85)),
        "op9_certified_packing": _over("documents", _packed),
        "op10_poisson_mixing": _over("documents", mixing.mix_query),
        "op11_prefix_targets": _over("conversations", chatformat.prefix_targets),
        "op12_viterbi_repair": _over("conversations", repair.repair_damaged),
        "op13_prefix_trie": _over("conversations", prefixtrie.prefix_trie),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_prefix_sum_sharding": sharding.SHARD_SQL,
        "op2_warc_index_merge": warc.WARC_SQL,
        "op4_cell_cosine_dedup": embeddings.NEAR_SQL,
        "op5_secret_ownership": secrets.SECRET_SQL,
        "op8_bayes_minhash_dedup": neardup.NEAR_SQL,
        "op10_poisson_mixing": mixing.MIX_SQL,
        "op11_prefix_targets": chatformat.CHAT_SQL,
        "op12_viterbi_repair": repair.REPAIR_SQL,
        "op13_prefix_trie": prefixtrie.TRIE_SQL,
    }
