"""Personal data: fixed formats, and candidates chosen by boosted trees.

Base spans are what the fixed formats match. Generators with a wide reach
propose further spans, which may overlap base spans and each other: runs of
digits with any of the usual separators, anything around an at-sign, and
addresses with the sign spelled out. The trees see format and context of a
proposal, but neither whether it passes a checksum or format check nor the marks
that base spans owe their being found to (the plus of a phone number).

Nobody has labelled the corpus, so the trees learn from positive and unlabelled
examples, in two steps with spies. Proposals that meet a base span are the positives. In the
first step a fifth of them, the spies, is put among the open proposals; those that
score below nearly all spies are reliable negatives. In the second step the trees
learn positives against reliable negatives. An open proposal is redacted when its
score is over the lowest threshold that reaches the asked precision on held-out documents.
So a number that looks like the checked ones and stands where they stand is
taken even if a digit is wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting, common
from .spans import Rule, bound, each, listed, mask, with_matches

KINDS = ["email", "ip", "card", "phone"]

RULES = [
    Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Rule("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Rule("card", r"[0-9](?:[ -]?[0-9])++"),
    Rule("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+"),
]

OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"

GENERATORS = [
    Rule("digits", r"[+(]?[0-9](?:[ ().,/:-]{0,2}[0-9])++"),
    Rule("at", r"(?:\G|(?<![^\s@]))[^\s@]++@[^\s@]++", "@"),
    Rule("spelled", r"(?i)(?:\G|(?<![a-z0-9._%+-]))[a-z0-9._%+-]++ ?[\[({]at[\])}] ?[a-z0-9-]++(?:(?: ?[\[({]dot[\])}] ?|\.)[a-z0-9-]++)++"),
]

FEATURES = ["source", "size", "marks", "head", "before", "after", "word"]

#: Words of the context that go with a kind of personal data.
CONTEXT_WORDS = [
    ("card", "card|visa|credit|iban|account|konto|cuenta|carte"),
    ("phone", "phone|tel|call|mobile|fax|handy|appel"),
    ("ip", "host|addr|server|client"),
    ("email", "mail|contact|write"),
]


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def term(d: Column, i: Column) -> Column:
        x = d.cast("int") * (1 + i % 2)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), term), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str):
    """A predicate on spans of a kind: whether the match counts."""
    return lambda s: _passes(kind, s)


def _passes(kind: str, s: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return s["body"].rlike(OCTETS)
    digits = _digits(s["body"])
    if kind == "card":
        return F.length(digits).between(16, 19) & luhn(F.left(digits, F.lit(19)))
    return F.length(digits).between(8, 15)


def _bin(x: Column, *edges: int) -> Column:
    out = F.lit(len(edges))
    for i, e in reversed(list(enumerate(edges))):
        out = F.when(x <= e, i).otherwise(out)
    return out.cast("int")


def _side(c: Column) -> Column:
    return (
        F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^[\p{L}\p{N}_]$"), 2).otherwise(1).cast("int")
    )


def _features(s: Column) -> Column:
    """Small integers on format and context; see ``FEATURES`` for their order."""
    at = s["kind"] != "digits"
    # As if the sign weren't spelled out, and without the plus that makes a phone number.
    body = F.when(s["kind"] == "spelled", F.regexp_replace(F.regexp_replace(s["body"], r"(?i) ?[\[({]at[\])}] ?", "@"), r"(?i) ?[\[({]dot[\])}] ?", "."))
    body = body.otherwise(F.regexp_replace(s["body"], r"^\+", ""))
    return bound(F.struct(s.alias("s"), body.alias("body"), at.alias("at")), _of)


def _of(x: Column) -> Column:
    s, body, at = x["s"], x["body"], x["at"]
    domain = F.substring_index(body, "@", -1)
    marks = (
        F.when(body.rlike(r"[,/:]"), 5).when(body.rlike(r"[()]"), 4).when(body.contains("."), 3)
        .when(body.contains("-"), 2).when(body.contains(" "), 1).otherwise(0)
    )
    word = F.lit(0)
    for i, (_, words) in enumerate(CONTEXT_WORDS):
        word = F.when(s["left"].rlike(f"(?i)(?:{words})"), i + 1).otherwise(word)
    return F.struct(
        at.cast("int").alias("source"),
        F.when(at, _bin(F.length(body), 5, 10, 15, 20, 30, 60))
        .otherwise(_bin(F.length(_digits(body)), 4, 7, 9, 11, 15, 16, 19)).alias("size"),
        F.when(at, F.least(F.size(F.split(domain, r"\.")) - 1, F.lit(5))).otherwise(marks).cast("int").alias("marks"),
        F.when(at, F.when(domain.rlike(r"\.[A-Za-z]{2,6}[.,;:!?]?$"), 1).otherwise(0)).otherwise(F.when(body.startswith("("), 1).otherwise(0)).cast("int").alias("head"),
        _side(F.right(s["left"], F.lit(1))).alias("before"),
        _side(F.left(s["right"], F.lit(1))).alias("after"),
        word.cast("int").alias("word"),
    )


def _kind_of(s: Column) -> Column:
    """The kind of an added span, from its format."""
    n = F.length(_digits(s["body"]))
    return (
        F.when(s["kind"] != "digits", "email").when(s["body"].rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
        .when(n >= 13, "card").otherwise("phone")
    )


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spelled, at, digits): base spans, and the proposals of each generator, ascending.

    A proposal has its span, its features and whether it meets a base span; that is read off
    a mask of the text, so all is linear in the number of spans.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    df = with_matches(df, "__text", RULES)
    df = df.withColumns({f"__mask_{k}": mask(F.col(k), _valid(k)) for k in KINDS})
    df = df.withColumn("base", F.concat(*[F.filter(k, _valid(k)) for k in KINDS])).drop(*KINDS)
    df = with_matches(df, "__text", GENERATORS, context=16)
    masks = [F.col(f"__mask_{k}") for k in KINDS]
    said = lambda s, holds: F.struct(
        _kind_of(s).alias("kind"), s["from"].alias("from"), s["to"].alias("to"), _features(s).alias("f"), holds.alias("holds")
    )
    return df.select(
        "doc_id",
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["from"].alias("from"), s["to"].alias("to"))).alias("base"),
        each(F.col("spelled"), masks, said).alias("spelled"),
        each(F.col("at"), masks, said).alias("at"),
        each(F.filter("digits", lambda s: F.length(_digits(s["body"])) >= 2), masks, said).alias("digits"),
    )


def train(found: DataFrame, precision: float = 0.98, spies: float = 0.05) -> boosting.Model:
    """Trees on all documents; their threshold is calibrated on each half by trees of the other half.

    ``spies``: the share of spies that may score below a reliable negative's bound. What comes to the
    driver is the table of feature cells: at most 2 * 2 * 2 * 8 * 6 * 2 * 3 * 3 * 5 = 34560
    rows, at any size of the corpus. Without base spans, or without proposals unlike them, nothing is selected.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    cells = (
        found.select((part % 2).alias("half"), (part >= 8).alias("spy"), F.explode(F.concat("spelled", "at", "digits")).alias("p"))
        .groupBy("half", "spy", *[F.col(f"p.f.{f}").alias(f) for f in FEATURES])
        .agg(F.count("*").alias("n"), F.sum(F.col("p.holds").cast("long")).alias("pos"))
        .collect()
    )
    rows = [r.asDict() for r in cells]
    # First step: positives against open proposals, the spies among these.
    first = boosting.fit([{**r, "pos": 0} if r["spy"] else r for r in rows], FEATURES)
    allowed, low = spies * sum(r["pos"] for r in rows if r["spy"]), 0.0
    for score, n in sorted((first.probability(r), r["pos"]) for r in rows if r["spy"] and r["pos"]):
        low, allowed = score, allowed - n
        if allowed < 0:
            break
    # Second step: open proposals from the bound on are left out, as nobody knows what they are.
    known = [{**r, "n": r["pos"] + (r["n"] - r["pos"] if first.probability(r) < low else 0)} for r in rows]
    known = [r for r in known if r["n"]]
    if not 0 < sum(r["pos"] for r in known) < sum(r["n"] for r in known):
        return boosting.Model(bias=0.0)
    halves = [[r for r in known if r["half"] == h] for h in (0, 1)]
    scored = []
    for own, other in (halves, halves[::-1]):
        model = boosting.fit(other, FEATURES)
        scored += [(model.probability(r), r["n"], r["pos"]) for r in own]
    model = boosting.fit(known, FEATURES)
    model.threshold = boosting.threshold(scored, precision)
    return model


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> DataFrame:
    """(doc_id, base, added): one row for each row of ``docs``; spans as arrays.

    Added spans overlap neither a base span nor each other; of chosen proposals that
    overlap, a spelled-out address goes before one with an at-sign, and that before a
    run of digits. A null text is an empty one; ids may be null or repeat; an empty
    table gives an empty result. Other columns are neither read nor returned.
    """
    found = common.durable(proposals(docs, id_col, text_col), "pii")
    model = train(found, precision)
    chosen = lambda p: ~p["holds"] & (model.column(p["f"]) >= model.threshold)
    if model.threshold > 1:
        return found.select("doc_id", "base", F.expr("cast(array() as array<struct<kind:string,from:int,to:int>>)").alias("added"))
    df, masks, taken = found, [], []
    for name in ("spelled", "at", "digits"):
        free = each(F.filter(name, chosen), masks, lambda p, met: F.struct(p["kind"].alias("kind"), p["from"].alias("from"), p["to"].alias("to"), met.alias("met")))
        df = df.withColumn(f"__{name}", F.filter(free, lambda p: ~p["met"]))
        df = df.withColumn(f"__mask_{name}", mask(F.col(f"__{name}"), lambda s: F.lit(True)))
        masks.append(F.col(f"__mask_{name}"))
        taken.append(F.transform(f"__{name}", lambda p: F.struct(p["kind"].alias("kind"), p["from"].alias("from"), p["to"].alias("to"))))
    return df.select("doc_id", "base", F.concat(*taken).alias("added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.98) -> DataFrame:
    """``docs`` with every found span replaced by its kind in angle brackets.

    Base spans may overlap each other; each stretch they cover is replaced once,
    by the kind of its first span. Rows with equal id and text are alike, and
    null texts stay null.
    """
    p = common.prefix(docs)
    key, found = f"{p}key", f"{p}spans"
    columns = docs.columns
    docs = docs.withColumn(key, F.xxhash64(F.col(id_col), F.col(text_col)))
    spans = detect(docs, key, text_col, precision)
    all_spans = F.array_sort(
        F.transform(F.concat("base", "added"), lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to"), s["kind"].alias("kind")))
    )
    keyed = spans.groupBy("doc_id").agg(F.max(all_spans).alias(found))
    text = F.coalesce(F.col(text_col), F.lit(""))
    done = F.aggregate(
        F.col(found),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["to"] <= acc["at"], acc).otherwise(
            F.struct(
                s["to"].alias("at"),
                F.when(s["from"] < acc["at"], acc["out"])
                .otherwise(F.concat(acc["out"], F.substr(text, acc["at"] + 1, s["from"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">")))
                .alias("out"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    joined = docs.join(keyed.withColumnRenamed("doc_id", key), key, "left")
    return joined.withColumn(text_col, F.when(F.size(found) > 0, done).otherwise(F.col(text_col))).select(*columns)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans, by kind and start."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS],
        F.sha2(listed(F.col("base"), KINDS, ("kind", "from")), 256).alias("base_sha256"),
        listed(F.concat("base", "added"), KINDS, ("kind", "from")).alias("spans"),
    )
