"""Spans of regular-expression matches as Spark columns: positions in code points.

``split`` by a pattern gives what stands between its matches and
``regexp_extract_all`` the matches themselves; running lengths of the two give
each match its place. Everything stays inside the JVM. The steps are separate
projections, so that no text is scanned twice for one use of a column, and
only texts that hold a match are scanned for its text.

Patterns are written so that a scan is linear in the text: possessive
quantifiers where giving back can't help, and ``(?:\\G|(?<![class]))`` where a
match can only start at the head of a run or right after the previous match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose places are summed up together.
CHUNK = 64

SPAN = "struct<kind:string,from:int,to:int,body:string,left:string,right:string>"


@dataclass(frozen=True)
class Rule:
    """A kind of span: its pattern, and a string without which no match exists."""

    kind: str
    pattern: str
    needs: str | None = None


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


def with_matches(df: DataFrame, text: str, rules: list[Rule], context: int = 0) -> DataFrame:
    """Adds a column named after each rule: its matches, leftmost and non-overlapping.

    Each match has its kind, start and end (code points, end exclusive), its
    text and up to ``context`` code points on both sides (as far as the
    neighbouring matches). A null or empty text has none.
    """
    gaps, found = {}, {}
    for r in rules:
        worth = F.col(text).isNotNull()
        if r.needs is not None:
            worth &= F.contains(F.col(text), F.lit(r.needs))
        gaps[f"__gaps_{r.kind}"] = F.when(worth, F.split(F.col(text), r.pattern, -1))
        found[f"__found_{r.kind}"] = F.when(
            F.size(f"__gaps_{r.kind}") > 1, F.regexp_extract_all(F.col(text), F.lit(r.pattern), F.lit(0))
        )
    df = df.withColumns(gaps).withColumns(found)
    pairs = {f"__pairs_{r.kind}": _pairs(r.kind, context) for r in rules}
    out = df.withColumns(pairs).withColumns({r.kind: _placed(r.kind) for r in rules})
    return out.drop(*gaps, *found, *pairs)


def _pairs(kind: str, context: int) -> Column:
    """Each match with the length of the gap ahead of it and its context."""
    gaps, bodies = F.col(f"__gaps_{kind}"), F.col(f"__found_{kind}")
    pairs = F.zip_with(
        F.zip_with(
            F.slice(gaps, F.lit(1), F.size(gaps) - 1),
            F.slice(gaps, F.lit(2), F.size(gaps) - 1),
            lambda a, b: F.struct(
                F.length(a).alias("ahead"), F.right(a, F.lit(context)).alias("left"), F.left(b, F.lit(context)).alias("right")
            ),
        ),
        bodies,
        lambda gap, body: F.struct(gap["ahead"].alias("ahead"), gap["left"].alias("left"), gap["right"].alias("right"), body.alias("body")),
    )
    return F.when(F.size(bodies) > 0, pairs)


def _placed(kind: str) -> Column:
    # Running sums within chunks, then over chunks: appending one by one to a list of all matches
    # would copy it each time. Pairs are bound, or they would be worked out anew for each chunk.
    def chunks(pairs: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int"))
        return F.transform(numbers, lambda i: F.aggregate(F.slice(pairs, i * CHUNK + 1, F.lit(CHUNK)), _start(), _append(kind)))

    pairs = F.col(f"__pairs_{kind}")
    whole = bound(pairs, lambda p: bound(chunks(p), _joined))
    return F.when(F.size(pairs) > 0, whole).otherwise(no_spans())


def _joined(chunks: Column) -> Column:
    ends = F.aggregate(chunks, F.array(F.lit(0)), lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + c["at"])))
    shifted = F.zip_with(
        chunks,
        F.slice(ends, F.lit(1), F.size(chunks)),
        lambda c, at: F.transform(
            c["found"],
            lambda s: F.struct(
                s["kind"].alias("kind"), (at + s["from"]).alias("from"), (at + s["to"]).alias("to"),
                s["body"].alias("body"), s["left"].alias("left"), s["right"].alias("right"),
            ),
        ),
    )
    return F.flatten(shifted)


def _start() -> Column:
    return F.struct(F.lit(0).alias("at"), no_spans().alias("found"))


def _append(kind: str):
    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["ahead"]
        end = start + F.length(p["body"])
        span = F.struct(
            F.lit(kind).alias("kind"), start.alias("from"), end.alias("to"),
            p["body"].alias("body"), p["left"].alias("left"), p["right"].alias("right"),
        )
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

    return step


def listed(spans: Column, kinds: list[str], by: tuple[str, ...]) -> Column:
    """kind:start:end of each span, comma-joined; ``by`` orders by 'kind' (as in ``kinds``) and 'from'."""
    rank = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    keyed = F.transform(
        spans,
        lambda s: F.struct(
            *[(F.element_at(rank, s["kind"]) if b == "kind" else s[b]).alias(f"by{i}") for i, b in enumerate(by)],
            s["to"].alias("to"),
            F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string")).alias("said"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["said"]), ",")


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is worked out once, even where the planner folds projections into lambdas."""
    return F.transform(F.array(value), fn)[0]


def mask(spans: Column, counts) -> Column:
    """A byte for each code point up to the last span's end: '1' within spans that ``counts`` holds for, else '0'.

    ``spans`` is a column of ascending spans that don't overlap each other.
    """

    def of(spans: Column) -> Column:
        parts = F.transform(
            spans,
            lambda s, i: F.concat(
                F.repeat(F.lit("0"), s["from"] - F.coalesce(F.get(spans, i - 1)["to"], F.lit(0))),
                F.repeat(F.when(counts(s), "1").otherwise("0"), s["to"] - s["from"]),
            ),
        )
        return F.array_join(parts, "").cast("binary")

    return bound(spans, of)


def each(spans: Column, masks: list[Column], fn) -> Column:
    """``fn(span, meets)`` for each span: ``meets`` says whether it overlaps one marked in a mask, by a look at its own bytes."""
    one = F.lit(b"1")

    def meets(s: Column, held: Column) -> Column:
        out = F.lit(False)
        for i in range(len(masks)):
            out = out | F.contains(F.substring(held[f"m{i}"], s["from"] + 1, s["to"] - s["from"]), one)
        return out

    held = F.struct(F.lit(0).alias("none"), *[m.alias(f"m{i}") for i, m in enumerate(masks)])
    return bound(held, lambda h: F.transform(spans, lambda s: fn(s, meets(s, h))))
