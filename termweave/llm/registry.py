"""One query for each operator, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, fingerprint_iblt, langid, licenses, merkle, minhash, mixing, packing, pii, ppm, quality_gam, quality_mcd, repair, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.small_batches(spark)
    return common.table(spark, sf_dir, name)


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_fingerprint_iblt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_iblt.versions(table(spark, sf_dir, "documents"))


def op3_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judge(table(spark, sf_dir, "documents"))


def op4_langid_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_lm_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(table(spark, sf_dir, "documents"))


def op7_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op8_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op10_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_audits(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_gam": op1_quality_gam,
    "op2_fingerprint_iblt": op2_fingerprint_iblt,
    "op3_quality_mcd": op3_quality_mcd,
    "op4_langid_viterbi": op4_langid_viterbi,
    "op5_lm_ppm": op5_lm_ppm,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_probminhash": op7_probminhash,
    "op8_histogram_packing": op8_histogram_packing,
    "op9_pii_disclosure": op9_pii_disclosure,
    "op10_warc_chain": op10_warc_chain,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_diagonals": op13_license_diagonals,
}
ORACLES: dict[str, str] = {
    "op6_poisson_mixing": mixing.REPLICATE_SQL,
    "op10_warc_chain": warc.ROUND_TRIP_SQL,
    "op11_conversation_repair": repair.AUDITS_SQL,
    "op12_merkle_manifest": merkle.MANIFEST_SQL,
}
