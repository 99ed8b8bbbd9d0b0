"""URL filters: rules by host and path, and a logistic regression for what no rule decides.

The model sees hashed n-grams of a url's host and path, each field's for itself, with marks at
the field's ends. It learns from a small table of labelled urls: any table of (url, block) will do,
and ``seed_table`` makes one from lists of words that say what a site is about.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

GRAMS = (3, 4, 5)

#: Sites one doesn't want to learn from are about these.
BLOCKED = (
    "casino poker bets betting bingo jackpot slots roulette lottery gamble pills pharma viagra cialis meds adult porn xxx sex escort "
    "cams dating ads adserver track tracker popup banner clicks spam seo linkfarm farm warez crack keygen torrent payday loans replica"
).split()
#: What stands beside such words in a host.
BESIDE = "win free cheap best online top x 24 club king hot deal".split()
#: Sites one does want are about these.
ALLOWED = (
    "news library museum garden recipes science history music travel weather school university research journal archive forum wiki "
    "health clinic football chess photo film theatre books poetry language grammar physics biology chemistry maths city council "
    "village farmers market bakery kitchen wood metal bridge river mountain forest ocean bird horse software manual docs code data "
    "trackfield address adulthood sextant analysis essex broadband classics badminton"
).split()
#: Other hosts are made of these: most names say nothing.
SYLLABLES = "an ber co dra el fin gor han in jo ken lor men nor ost pra qui ron sel tan ur ver wes yor zen the tion ing er re st ou".split()
TOPS = "com net org de fr es info".split()
LANGS = "en de es fr".split()
SUBS = ["", "www.", "m.", "blog."]


@dataclass(frozen=True)
class Rule:
    """A host (its subdomains too) and how its paths begin, with a verdict."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed by the query's contract.
RULES = [
    Rule("allow", "com"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lowered, and path of a url; both empty if it is null or has no ``://``."""
    known = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.substr(url, F.instr(url, F.lit("://")) + 3)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*+", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def ruled(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does. Of rules with one name the first holds."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _grams(field: str, text: Column) -> Column:
    """n-grams of a field with marks at its ends, ahead of each the field's letter; of a url of n code points in time n."""

    def of(chars: Column) -> Column:
        def long(n: int) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(chars) - n), lambda i: F.concat(F.lit(field), *[F.get(chars, i + k) for k in range(n)]))

        return F.concat(*map(long, GRAMS))

    # An empty field has no n-grams; the shortest other one has its marks and one code point.
    marked = F.concat(F.lit("^"), text, F.lit("$$$"))
    grams = F.transform(F.array(F.split(marked, "")), of)[0]
    return F.when(text == "", F.array().cast("array<string>")).otherwise(grams)


def with_grams(df: DataFrame, host: Column, path: Column, into: str) -> DataFrame:
    return df.withColumns({into + "h": _grams("h", host), into + "p": _grams("p", path)})


@dataclass
class Model:
    """A fitted regression, or none where the labels are of one class: then nothing is blocked."""

    regression: LogisticRegressionModel | None
    features: int

    def vectors(self, df: DataFrame, grams: str, into: str) -> DataFrame:
        """Counts of hashed n-grams, each field's of length 1, so that a long path doesn't drown its host."""
        for field in "hp":
            counted = HashingTF(numFeatures=self.features, inputCol=grams + field, outputCol=into + field + "n").transform(df)
            df = Normalizer(inputCol=into + field + "n", outputCol=into + field).transform(counted)
        return VectorAssembler(inputCols=[into + "h", into + "p"], outputCol=into).transform(df)


def _words(spark: SparkSession, words: list[str], name: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.split(F.lit(" ".join(words)), " ")).alias(name))


def seed_table(spark: SparkSession, names: int = 600) -> DataFrame:
    """(url, block): about a thousand labelled urls, made of the word lists by a rule.

    Blocked are hosts of a word one doesn't want and another beside it, in either order; not blocked are those of ordinary
    words, and ``names`` hosts of syllables. Subdomain, top-level domain, language and number are drawn alike for both.
    """
    first, second = _words(spark, BLOCKED, "a"), _words(spark, BESIDE, "b")
    draw = lambda k, n: F.pmod(F.xxhash64("name", F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, values: F.get(F.array(*map(F.lit, values)), draw(k, len(values)))
    bad = first.crossJoin(second).select(F.when(F.pmod(F.xxhash64("a", "b"), F.lit(3)) == 0, F.concat_ws("-", "b", "a")).otherwise(F.concat_ws("-", "a", "b")).alias("name"))
    alone = _words(spark, BLOCKED, "name")
    known = _words(spark, ALLOWED, "a").crossJoin(second).select(F.concat_ws("-", "a", "b").alias("name")).where(F.pmod(F.xxhash64("name"), F.lit(3)) == 0)
    single = _words(spark, ALLOWED, "name")
    made = spark.range(names).select(F.col("id").cast("string").alias("name")).select(F.concat(*[pick(k, SYLLABLES) for k in ("p", "q", "r")]).alias("name"))
    rows = bad.where(F.pmod(F.xxhash64("name"), F.lit(2)) == 0).unionAll(alone).select("name", F.lit(1).alias("block"))
    rows = rows.unionAll(known.unionAll(single).unionAll(made).select("name", F.lit(0).alias("block")))
    host = F.concat(pick("s", SUBS), "name", F.when(draw("e", 2) == 0, ".example."), pick("t", TOPS))
    host = F.coalesce(host, F.concat(pick("s", SUBS), "name", F.lit("."), pick("t", TOPS)))
    tail = pick("z", ["", "/", ".html", "?page=2", "#top"])
    return rows.select(F.concat(F.lit("https://"), host, F.lit("/"), pick("l", LANGS), F.lit("/"), draw("n", 9000).cast("string"), tail).alias("url"), "block")


def train(labelled: DataFrame, rows: int = 20_000, features: int = 1 << 14, ridge: float = 1e-6, url_col: str = "url", block_col: str = "block") -> Model:
    """Fits on at most ``rows`` labelled urls, those with the smallest hashes; repeated ones count as often as they stand there.

    Null urls and null labels don't count. Labels of one class only teach nothing. The driver holds weights, not rows.
    """
    own = labelled.select(F.col(url_col).alias("url"), F.col(block_col).cast("double").alias("label")).where("url is not null and label is not null")
    own = own.orderBy(F.xxhash64("url"), "url", "label").limit(rows)
    host, path = parts(F.col("url"))
    own = with_grams(own.select(host.alias("host"), path.alias("path"), "label"), F.col("host"), F.col("path"), "grams")
    model = Model(None, features)
    own = common.durable(own.drop("host", "path"), "urls")  # an iterative fit reads it often
    if own.select("label").distinct().count() < 2:
        return model
    table = model.vectors(own, "grams", "x").select("x", "label")
    model.regression = LogisticRegression(featuresCol="x", labelCol="label", regParam=ridge, maxIter=60, standardization=False).fit(table)
    return model


def judge(pages: DataFrame, model: Model, rules: list[Rule] = RULES, threshold: float = 0.5, url_col: str = "url", into: str = "judged") -> DataFrame:
    """``pages`` with a struct ``into``: host, path, rule, score and verdict (allow or block).

    The longest rule that fits decides; else ``block`` from ``threshold`` on. Null urls and those without ``://`` have empty
    parts, which no rule fits; their score is that of no n-grams. Rows are judged each by itself, repeated ones alike.
    A column called ``into`` is replaced, others stay as they are. An empty table gives an empty one.
    """
    p = common.prefix(pages)
    host, path = parts(F.col(url_col))
    kept = [c for c in pages.columns if c.lower() != into.lower()]
    df = pages.withColumns({p + "host": host, p + "path": path})
    if model.regression is None:
        df = df.withColumn(p + "score", F.lit(0.0))
    else:
        df = with_grams(df, F.col(p + "host"), F.col(p + "path"), p + "grams")
        df = model.vectors(df, p + "grams", p + "x")
        fitted = model.regression.copy().setFeaturesCol(p + "x").setProbabilityCol(p + "probability").setRawPredictionCol("").setPredictionCol("")
        df = fitted.transform(df).withColumn(p + "score", vector_to_array(F.col(p + "probability"))[1])
    rule, verdict = ruled(F.col(p + "host"), F.col(p + "path"), rules)
    said = F.coalesce(verdict, F.when(F.col(p + "score") >= threshold, "block").otherwise("allow"))
    judged = F.struct(F.col(p + "host").alias("host"), F.col(p + "path").alias("path"), rule.alias("rule"), F.col(p + "score").alias("score"), said.alias("verdict"))
    return df.select(*[F.col(f"`{c}`") for c in kept], judged.alias(into))


RULES_ORACLE = r"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM r),
rules(host, path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits AS (
  SELECT p.page_id, p.host, p.path, rules.host || rules.path AS rule, rules.verdict
  FROM p LEFT JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path))
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
FROM fits GROUP BY page_id
"""
