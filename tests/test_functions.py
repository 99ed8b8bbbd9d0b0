"""Masks, parsers, redaction and display against their stated answers."""

import re

import pytest
from pyspark.sql import functions as F

from logweave.functions.masking import MASKS, Masker, MaskingRule
from logweave.functions.parsing import LineParser, ParserRegistry, parse_lines
from logweave.functions.redaction import LEVELS, PATTERNS, CustomPattern, Redactor
from logweave.operators import changelog, versions

MASKED = [
    ("Connection from 192.168.1.100 to 10.0.0.1", "Connection from <ip> to <ip>"),
    ("Request ID: 550e8400-e29b-41d4-a716-446655440000", "Request ID: <uuid>"),
    ("Event at 2024-01-15T10:30:00.123Z", "Event at <ts>"),
    ("Token: 0x1234abcdef5678", "Token: <hex>"),
    ("Process 1234567890 started", "Process <num> started"),
    ("Fetching https://api.example.com/v1/users", "Fetching <url>"),
    ("User email: user@example.com", "User email: <email>"),
    ("ERROR: Database connection failed", "ERROR: Database connection failed"),
    ("Event at 12:30:45", "Event at 12:<port>:<port>"),
    ("read /var/log/app.log", "read <path>"),
    ("at Jan 15 10:30:00 pid=77 x", "at <ts> <pid> x"),
    ("  two   spaces ", "two spaces"),
    ("", ""),
]


def _column(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("t"))).collect()]


def test_masks(spark):
    assert _column(spark, [a for a, _ in MASKED] + [None], Masker().normalize) == [b for _, b in MASKED] + [None]


def test_masks_equal_python(spark):
    def plain(text):
        for _, pattern, tag in MASKS:
            text = re.sub(pattern, tag, text)
        return re.sub(r"\s+", " ", text).strip()

    texts = [a for a, _ in MASKED] + ["é12345 x", "fe80:0:0:0:0:0:0:1 ok", "a bad 1", "[123] 15/Jan/2024:10:30:00 +0000"]
    assert _column(spark, texts, Masker().normalize) == [plain(t) for t in texts]


def test_custom_and_disabled_rules(spark):
    m = Masker().add(MaskingRule("custom", r"ID-\d+", "<custom_id>"), 0).disable("ipv4")
    assert _column(spark, ["Processing ID-12345", "from 10.0.0.1"], m.normalize) == ["Processing <custom_id>", "from 10.0.0.1"]
    with pytest.raises(KeyError):
        m.enable("nothing")


PARSED = [
    ('{"message": "connection failed", "level": "error"}', "json", "connection failed", "ERROR"),
    ('{"msg": "request processed", "level": "INFO"}', "json", "request processed", "INFO"),
    ('{"message": broken}', "common", '{"message": broken}', None),
    ("Jan 15 10:30:00 myhost sshd[1234]: Accepted password for user", "syslog", "Accepted password for user", None),
    ("Jan  5 10:30:00 myhost app: message", "syslog", "message", None),
    ('127.0.0.1 - - [15/Jan/2024:10:30:00 +0000] "GET /api/health HTTP/1.1" 200 15 "-" "curl/7.68.0"', "nginx", "GET /api/health HTTP/1.1 200", "INFO"),
    ('127.0.0.1 - - [15/Jan/2024:10:30:00 +0000] "GET / HTTP/1.1" 500 15 "-" "-"', "nginx", "GET / HTTP/1.1 500", "ERROR"),
    ("2024/01/15 10:30:00 [error] 1234#5678: *9999 upstream timed out", "nginx", "upstream timed out", "ERROR"),
    ("ValueError: invalid literal for int()", "python_traceback", "ValueError: invalid literal for int()", "ERROR"),
    ("Traceback (most recent call last):", "python_traceback", "Traceback (most recent call last):", "ERROR"),
    ('  File "/app/main.py", line 42, in process', "python_traceback", '  File "/app/main.py", line 42, in process', "ERROR"),
    ("2024-01-15T10:30:00Z ERROR connection refused", "common", "connection refused", "ERROR"),
    ("[WARN] Memory usage high", "common", "Memory usage high", "WARN"),
    ("Database error occurred", "common", "Database error occurred", "ERROR"),
    ("plain text line", "common", "plain text line", None),
    ("two\nlines", "raw", "two\nlines", None),
    ("ERROR: 日本語 émoji 🔥", "common", "日本語 émoji 🔥", "ERROR"),
    ("A" * 10000, "common", "A" * 10000, None),
    ("", "raw", "", None),
]


def test_parsers(spark):
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(PARSED)], "i int, line string")
    got = [(r["parser"], r["message"], r["level"]) for r in parse_lines(df).orderBy("i").collect()]
    assert got == [p[1:] for p in PARSED]


def test_registered_parser_comes_first(spark):
    from logweave.functions.parsing import _record

    own = LineParser("own", lambda c: c.startswith("!"), lambda c: _record("own", F.substring(c, 2, 99), F.lit("INFO"), F.lit(None)))
    got = _column(spark, ["!hello", "x", None], lambda c: ParserRegistry().register(own).parse(c)["parser"])
    assert got == ["own", "common", None]


PII = "Contact john@example.com or 555-123-4567 ssn 123-45-6789 card 4111-1111-1111-1111 from 192.168.1.1 api_key=sk_test_1 Password: hunter2"


def _reference(text, level, how):
    for kind, patterns in PATTERNS.items():
        if kind in LEVELS[level]:
            for p, _ in patterns:
                text = re.sub(p, lambda m, k=kind: how(k, m.group()), text, flags=re.I)
    return text


@pytest.mark.parametrize("level", list(LEVELS))
def test_redaction_levels(spark, level):
    texts = [PII, "clean line", "", PII + " " + PII, None]
    got = _column(spark, texts, Redactor(level).redact)
    assert got == [None if t is None else _reference(t, level, lambda k, m: f"[REDACTED:{k}]") for t in texts]


def test_redaction_hash(spark):
    import hashlib

    got = _column(spark, [PII, "x"], Redactor("standard", hashed=True).redact)
    want = _reference(PII, "standard", lambda k, m: f"[REDACTED:{k}]:{hashlib.sha256(m.encode()).hexdigest()[:8]}")
    assert got == [want, "x"]


def test_redaction_counts_and_custom(spark):
    df = spark.createDataFrame([(PII,), ("a 7 b 8",)], "t string")
    r = Redactor("minimal", custom=[CustomPattern("digit", r"\b\d\b")])
    rows = {x["t"]: x for x in r.counts(df, "t").collect()}
    assert rows[PII]["n_ssn"] == 1 and rows[PII]["n_credit_card"] == 1 and rows[PII]["n_password"] == 1
    assert rows["a 7 b 8"]["redacted"] == "a [REDACTED:custom] b [REDACTED:custom]" and rows["a 7 b 8"]["n_custom"] == 2


def test_versions(spark):
    said = ["1.2.3", "v2.0.0-rc.1", "2.0.0", "nope"]
    df = spark.createDataFrame([(s,) for s in said], "s string").withColumn("v", versions.parse(F.col("s")))
    ordered = [r["s"] for r in df.where("v is not null").orderBy(versions.sort_key(F.col("v"))).collect()]
    assert ordered == ["1.2.3", "v2.0.0-rc.1", "2.0.0"]
    assert df.where("s = '1.2.3'").select(versions.bump(F.col("v"), "patch")).first()[0] == "1.2.4"


def test_migration_path(spark):
    e = spark.createDataFrame([("a", "b", "1"), ("b", "c", "2"), ("a", "c", "3"), ("c", "d", "4")], "from_version string, to_version string, migration_id string")
    assert versions.migration_path(e, "a", "d").first()["path"] == ["3", "4"]
    assert versions.migration_path(e, "a", "a").first()["path"] == []
    assert versions.migration_path(e, "d", "a").count() == 0


def test_commit(spark):
    c = _column(spark, ["feat(api)!: add it (#12)", "no type", "Fix: y #1 #2"], changelog.parse_commit)
    assert c[0]["entry_type"] == "Added" and c[0]["scope"] == "api" and c[0]["breaking"] and c[0]["refs"] == ["#12"]
    assert c[1] is None and c[2]["refs"] == ["#1", "#2"]
