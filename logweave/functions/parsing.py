"""Parsing of raw log lines: an ordered registry of (predicate, struct) pairs.

Formats are tried in order and the first that fits wins: JSON, syslog, nginx
access and error, Python tracebacks, then a generic form, then the raw line.
Everything is one Catalyst expression; a custom parser is a pair of Columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The formats' patterns.
SYSLOG = r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
NGINX_ACCESS = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]+)"\s+(\d+)\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"'
NGINX_ERROR = r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+)#(\d+):\s*(?:\*\d+\s+)?(.*)$"
TRACEBACK = r"^(\w+Error|\w+Exception|Traceback \(most recent call last\)):?\s*(.*)$"
COMMON = (
    r"(?i)^(?:(\d{4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+)?"
    r"(?:\[?(DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\]?[:\s]+)?(.+)$"
)
# Timestamp layouts, tried in order.
LAYOUTS = [
    "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.[SSSSSS][SSS]X", "yyyy-MM-dd'T'HH:mm:ssXX",
    "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
]


def timestamp(text: Column) -> Column:
    """A timestamp by the first layout that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(layout)) for layout in LAYOUTS])


def infer_level(message: Column) -> Column:
    """The level a message's wording suggests; the order of the tests is part of the contract."""
    up = F.upper(message)
    return (
        F.when(up.contains("ERROR") | up.contains("FAIL"), "ERROR").when(up.contains("WARN"), "WARN")
        .when(up.contains("DEBUG"), "DEBUG").when(up.contains("INFO"), "INFO")
        .when(up.contains("FATAL") | up.contains("CRITICAL"), "FATAL")
    )


def normalize_level(level: Column) -> Column:
    up = F.upper(level)
    return F.when(up == "WARNING", "WARN").when(up == "CRITICAL", "FATAL").otherwise(up)


def status_level(status: Column) -> Column:
    """The level of an HTTP status, by its class; INFO unless it is 4xx or 5xx."""
    first = F.substring(status, 1, 1)
    return F.when(first == "4", "WARN").when(first == "5", "ERROR").otherwise("INFO")


def _record(parser: str, message: Column, level: Column, ts: Column, attrs: dict[str, Column] | None = None) -> Column:
    none = F.lit(None).cast("string")
    fields = {"parser": F.lit(parser), **(attrs or {})}
    kept = F.map_filter(
        F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]), lambda _, v: v.isNotNull()
    )
    return F.struct(
        F.lit(parser).alias("parser"), F.coalesce(message, none).alias("message"), F.coalesce(level, none).alias("level"),
        ts.cast("timestamp").alias("ts"), kept.alias("attrs"),
    )



@dataclass(frozen=True)
class LineParser:
    """A named format: whether a line fits, and its record; both from the line's Column."""

    name: str
    fits: Callable[[Column], Column]
    record: Callable[[Column], Column]


def _json_fits(line: Column) -> Column:
    t = F.trim(line)
    return t.startswith("{") & t.endswith("}") & F.try_parse_json(line).isNotNull()


def _json(line: Column) -> Column:
    doc = F.try_parse_json(line)
    get = lambda k, kind="string": F.try_variant_get(doc, f"$.{k}", kind)
    some = lambda *names: F.coalesce(*[F.nullif(get(n), F.lit("")) for n in names])
    when = some("timestamp", "time", "ts")
    ts = F.coalesce(timestamp(when), F.timestamp_seconds(when.try_cast("double")))
    return _record("json", F.coalesce(some("message", "msg"), F.lit("")), F.upper(some("level", "lvl")), ts)


def _syslog(line: Column, year: int) -> Column:
    part = lambda i: F.regexp_extract(line, SYSLOG, i)
    when = F.regexp_replace(F.concat(F.lit(f"{year} "), part(1)), r"\s+", " ")
    message = part(5)
    return _record(
        "syslog", message, infer_level(message), F.try_to_timestamp(when, F.lit("yyyy MMM d HH:mm:ss")),
        {"hostname": part(2), "program": part(3), "pid": F.nullif(part(4), F.lit(""))},
    )


def _nginx(line: Column) -> Column:
    a = lambda i: F.regexp_extract(line, NGINX_ACCESS, i)
    e = lambda i: F.regexp_extract(line, NGINX_ERROR, i)
    access = _record(
        "nginx", F.concat(a(4), F.lit(" "), a(5)), status_level(a(5)), F.try_to_timestamp(a(3), F.lit("dd/MMM/yyyy:HH:mm:ss Z")),
        {"ip": a(1), "user": F.when(a(2) != "-", a(2)), "request": a(4), "status": a(5), "bytes": a(6), "referer": F.when(a(7) != "-", a(7)), "user_agent": a(8),
         "pid": F.lit(None), "tid": F.lit(None)},
    )
    error = _record(
        "nginx", e(5), F.upper(e(2)), F.try_to_timestamp(F.regexp_replace(e(1), r"\s+", " "), F.lit("yyyy/MM/dd HH:mm:ss")),
        {"ip": F.lit(None), "user": F.lit(None), "request": F.lit(None), "status": F.lit(None), "bytes": F.lit(None), "referer": F.lit(None), "user_agent": F.lit(None),
         "pid": e(3), "tid": e(4)},
    )
    return F.when(line.rlike(NGINX_ACCESS), access).otherwise(error)


def _traceback(line: Column) -> Column:
    kind, text = F.regexp_extract(line, TRACEBACK, 1), F.regexp_extract(line, TRACEBACK, 2)
    head = line.rlike(TRACEBACK)
    return _record(
        "python_traceback", line, F.lit("ERROR"), F.lit(None),
        {"exception_type": F.when(head, kind), "exception_message": F.when(head, text)},
    )


def _common(line: Column) -> Column:
    part = lambda i: F.regexp_extract(line, COMMON, i)
    message = part(3)
    level = F.when(part(2) != "", normalize_level(part(2))).otherwise(infer_level(message))
    return _record("common", message, level, timestamp(F.nullif(part(1), F.lit(""))))


def default_parsers(year: int = 2024) -> list[LineParser]:
    """The built-in formats; ``year`` is given to syslog lines, which have none."""
    return [
        LineParser("json", _json_fits, _json),
        LineParser("syslog", lambda c: c.rlike(SYSLOG), lambda c: _syslog(c, year)),
        LineParser("nginx", lambda c: c.rlike(NGINX_ACCESS) | c.rlike(NGINX_ERROR), _nginx),
        LineParser(
            "python_traceback",
            lambda c: c.rlike(TRACEBACK) | F.ltrim(c).startswith('File "') | c.startswith("    "),
            _traceback,
        ),
        LineParser("common", lambda c: c.rlike(COMMON) & ~c.contains("\n"), _common),
    ]


class ParserRegistry:
    """Parsers in order of trial; ``register`` puts a custom one first by default."""

    def __init__(self, parsers: list[LineParser] | None = None, year: int = 2024):
        self.parsers = list(parsers) if parsers is not None else default_parsers(year)

    def register(self, parser: LineParser, priority: int = 0) -> ParserRegistry:
        self.parsers.insert(priority, parser)
        return self

    def parse(self, line: Column) -> Column:
        """A struct (parser, message, level, ts, attrs); null for a null line."""
        out = None
        for p in self.parsers:
            fits, record = p.fits(line), p.record(line)
            out = F.when(fits, record) if out is None else out.when(fits, record)
        raw = _record("raw", line, F.lit(None), F.lit(None))
        out = raw if out is None else out.otherwise(raw)
        return F.when(line.isNotNull(), out)


def parse_lines(df: DataFrame, line_col: str = "line", registry: ParserRegistry | None = None) -> DataFrame:
    """``df`` with the parsed fields as columns (parser, message, level, ts, attrs)."""
    parsed = df.withColumn("__parsed", (registry or ParserRegistry()).parse(F.col(line_col)))
    return parsed.select(*df.columns, "__parsed.*")
