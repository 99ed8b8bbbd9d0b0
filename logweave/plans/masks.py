"""Masking queries: the flagship pattern count, whole chains, and one query for each rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.masking import MASKS, Masker, MaskingRule
from ..session import read_table, spread
from .lines import LINES_SQL, log_lines
from .registry import query

#: DuckDB's regexes have no lookaround: the port rule keeps its colon another way.
SQL_RULES = {
    **{name: (pattern, tag) for name, pattern, tag in MASKS},
    "port_number": (r":(\d{2,5})\b", ":<port>"),
}


def chain_sql(column: str, names: list[str]) -> str:
    out = column
    for name in names:
        pattern, tag = SQL_RULES[name]
        out = f"regexp_replace({out}, '{pattern}', '{tag}', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '\s+', ' ', 'g'), '^ | $', '', 'g')"


NO_HEX = [name for name, _, _ in MASKS if name != "hex_token"]


@query(f"""
SELECT pattern, count(*) AS n, min(doc_id) AS first_id
FROM (SELECT doc_id, {chain_sql('text', NO_HEX)} AS pattern FROM documents)
GROUP BY pattern ORDER BY n DESC, first_id LIMIT 20""")
def top_patterns(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    masked = docs.select("doc_id", Masker().disable("hex_token").normalize(F.col("text")).alias("pattern"))
    return (
        masked.groupBy("pattern").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
        .orderBy(F.desc("n"), "first_id").limit(20)
    )


@query(f"SELECT doc_id, {chain_sql('text', NO_HEX)} AS normalized FROM documents")
def normalize_no_hex(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", Masker().disable("hex_token").normalize(F.col("text")).alias("normalized"))


@query()
def normalize_full(spark, sf_dir):
    return log_lines(spark, sf_dir).select("id", Masker().normalize(F.col("line")).alias("normalized"))


@query(f"WITH {LINES_SQL} SELECT id, {chain_sql('line', NO_HEX)} AS normalized FROM log_lines")
def normalize_lines(spark, sf_dir):
    return log_lines(spark, sf_dir).select("id", Masker().disable("hex_token").normalize(F.col("line")).alias("normalized"))


@query(rf"""WITH {LINES_SQL} SELECT id,
regexp_replace(regexp_replace({chain_sql("regexp_replace(line, 'user ?[0-9]+', '<who>', 'g')", [n for n in NO_HEX if n != "ipv4"])}, '\s+', ' ', 'g'), '^ | $', '', 'g') AS normalized FROM log_lines""")
def normalize_custom_rules(spark, sf_dir):
    masker = Masker().disable("hex_token").disable("ipv4").add(MaskingRule("who", "user ?[0-9]+", "<who>"), position=0)
    return log_lines(spark, sf_dir).select("id", masker.normalize(F.col("line")).alias("normalized"))


#: What to mask with each rule: lines where it fires.
SAMPLES = {
    "uuid": "line", "iso_timestamp": "line", "nginx_timestamp": "line", "common_timestamp": "line",
    "ipv6": "concat('peer fe80:0:0:0:0:0:', hex(id % 4096 + 16), ':1 at 2001:db8:: ok ', line)",
}
SAMPLES_SQL = {"ipv6": "'peer fe80:0:0:0:0:0:' || upper(printf('%x', id % 4096 + 16)) || ':1 at 2001:db8:: ok ' || line"}


def _rule_query(rule: str) -> None:
    def run(spark, sf_dir):
        text = F.expr(SAMPLES.get(rule, "line"))
        return log_lines(spark, sf_dir).select("id", Masker().only(rule).normalize(text).alias("masked"))

    sql = f"WITH {LINES_SQL} SELECT id, {chain_sql(SAMPLES_SQL.get(rule, 'line'), [rule])} AS masked FROM log_lines"
    query(None if rule == "hex_token" else sql, name=f"mask_{rule}")(run)


for _name, _, _ in MASKS:
    _rule_query(_name)
