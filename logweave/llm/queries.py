"""The registered corpus queries: thin wrappers with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fim, lines, lm, mixing, periodic, pieces, pii, quality, secrets, simhash, topk, toxicity, urls

QUERIES: dict = {}
ORACLES: dict = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read_table(spark, sf_dir, "documents"), budget=4, blocks=6, leaf=1024)


@_query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(common.read_table(spark, sf_dir, "documents"), precision=0.98))


@_query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(common.read_table(spark, sf_dir, "documents"), rate=0.01))


@_query
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


ORACLES["op8_topk"] = topk.ORACLE


@_query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.judge(docs, labels, risk=0.01, error=0.05)


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.score(docs, toxicity.train(docs, labels))


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(common.read_table(spark, sf_dir, "documents"), power=0.5, total=1.0, seed=17, details=True)
    return mixed.select(
        "doc_id", "source", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "copy", "place"
    )


ORACLES["op9_mixing"] = mixing.ORACLE


@_query
def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return lines.drop_boilerplate(docs, details=True).select("doc_id", "n_lines", "dropped", "text")


ORACLES["op4_lines"] = lines.ORACLE


@_query
def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode(common.read_table(spark, sf_dir, "documents"), dropout=0.1, seed=11, variants=4, verify=True)
    return encoded.select("doc_id", "n_pieces", "ids_hash", "lossless")


@_query
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(common.read_table(spark, sf_dir, "documents"))


@_query
def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return fim.digest(fim.transform(docs, unit="line", rate=100, spm=50, seed=7))


ORACLES["op11_fim"] = fim.ORACLE


@_query
def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digest(periodic.find(periodic.planted(docs)))


@_query
def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge(pages, urls.train(urls.seed_table(spark))).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.score")


@_query
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op13 takes from the rules alone; the verdict is null where no rule fits."""
    host, path = urls.parts(F.col("url"))
    pages = common.read_table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = urls.ruled(F.col("host"), F.col("path"), urls.RULES)
    return pages.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


ORACLES["url_rules"] = urls.RULES_ORACLE
