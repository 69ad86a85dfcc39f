"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import (
    embedding_dedup,
    filter_audit,
    language_id,
    lexical_packing,
    license_scan,
    minhash_dedup,
    pii_pseudonyms,
    prefix_trie,
    quality_rules,
    secret_scan,
    source_mix,
    token_rollup,
    url_filter,
)
from tessella.llm._scratch import Scratch
from tessella.llm.oracles import (
    audit_sql,
    license_sql,
    mix_sql,
    near_duplicate_sql,
    near_vectors_sql,
    quality_sql,
    rollup_sql,
    trie_sql,
    url_sql,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least_cos=0.95)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mixture(table(spark, sf_dir, "documents"))


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_packing.pack(table(spark, sf_dir, "documents"))


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is that of the registered query alone; a production run brings its own."""
    return pii_pseudonyms.pseudonyms(table(spark, sf_dir, "documents"), key="registered-query")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def _reworded(rollup: token_rollup.Rollup, docs: DataFrame) -> None:
    """Word counts of all documents, revised to another version, without those of documents under five words."""
    first = token_rollup.worded(docs, "words_1", "[^\\x20\\x09-\\x0D]+")
    second = token_rollup.worded(docs, "words_2", "[A-Za-z0-9]+")
    rollup.apply("words", token_rollup.inserts(first))
    rollup.apply("revise", token_rollup.revisions(first, second))
    rollup.compact()
    rollup.apply("retire", token_rollup.deletes(second.where("n_tokens < 5")))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword counts, committed and sent again as after a lost answer; word counts inserted, revised and in part deleted."""
    docs = table(spark, sf_dir, "documents")
    rollup = token_rollup.Rollup(spark, Scratch(spark, "rollup").root)
    deltas = token_rollup.inserts(token_rollup.counted(docs, "byte_bpe_50k"))
    rollup.apply("load", deltas)
    rollup.apply("load", deltas)
    _reworded(rollup, docs)
    return rollup.totals()


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of ``op10_token_rollup`` that SQL can state."""
    rollup = token_rollup.Rollup(spark, Scratch(spark, "rollup").root)
    _reworded(rollup, table(spark, sf_dir, "documents"))
    return rollup.totals()


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline, which is built on this subpackage and so is imported when it runs."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_source_mix": op6_source_mix,
    "op7_lexical_packing": op7_lexical_packing,
    "op8_pii_pseudonyms": op8_pii_pseudonyms,
    "op9_url_filter": op9_url_filter,
    "op10_token_rollup": op10_token_rollup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language_id": op12_language_id,
    "op13_filter_audit": op13_filter_audit,
    "token_rollup_words": token_rollup_words,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op2_license_scan": license_sql(),
    "op3_minhash_dedup": near_duplicate_sql(85),
    "op4_embedding_dedup": near_vectors_sql(0.95),
    "op6_source_mix": mix_sql(),
    "op9_url_filter": url_sql(),
    "op11_prefix_trie": trie_sql(),
    "op13_filter_audit": audit_sql(),
    "token_rollup_words": rollup_sql(),
}
