"""Secrets: fixed forms, and strings that pass as random where text would not.

Base spans are what the fixed forms match. Further candidates are runs of at
least 12 characters of the usual alphabets that hold a digit or mix cases. Each
run's encoding is inferred (digits, hex, base32, letters and digits of one case
or of both, base64) and a battery asks how it departs from uniform draws over that alphabet:
chi-squared of the character counts, the number of runs of character classes,
and the serial correlation of neighbouring codes. The three tail probabilities combine by
Fisher's method into one statistic, small for random strings. The tails are approximate,
which moves the statistic but no decision: that is taken by ranks.

The false-discovery control takes text of the corpus itself as its null. The
letters of each document, run together, give one string for every fourth length class;
a hash of the document chooses which and from what place. So every length has a null that grows with
the corpus, also lengths that no word has. A candidate's p-value is the share of null strings of its length class
that look at least as random, and within each class the Benjamini-Hochberg rule
picks what is reported. Null strings and candidates are counted over the whole
corpus in cells of (length class, statistic), a table whose size is fixed.
Runs of letters of one case alone are what the null is made of, and no candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .spans import Rule, bound, each, listed, mask, with_matches

KINDS = ["assign", "access", "hex", "random"]

ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
#: What stands before the value of an assignment.
ASSIGN_HEAD = r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

RULES = [
    Rule("assign", ASSIGN),
    Rule("access", r"AKIA[A-Z0-9]{16,}+", "AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}+"),
]
RUNS = Rule("run", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+")

#: Cells of the statistic: halves, up to this one for all above.
TOP_CELL = 120
#: Upper ends of the length classes.
LENGTHS = (13, 15, 17, 19, 23, 27, 31, 39, 47, 63, 95, 127)
#: The length of the null strings of each class: its middle, and one for all above.
NULLS = (12, 14, 16, 18, 21, 25, 29, 35, 43, 55, 79, 111, 160)


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a logistic approximation (error under 0.0002)."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return F.greatest(1 / (1 + F.exp(1.5976 * z + 0.070566 * z * z * z)), F.lit(1e-13))


def length_class(body: Column) -> Column:
    out = F.lit(len(LENGTHS))
    for i, top in reversed(list(enumerate(LENGTHS))):
        out = F.when(F.length(body) <= top, i).otherwise(out)
    return out.cast("int")


def encoding_size(body: Column) -> Column:
    """The size of the inferred alphabet."""
    return (
        F.when(body.rlike(r"^[0-9]+$"), 10)
        .when(body.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), 16)
        .when(body.rlike(r"^[A-Z2-7]+=*$"), 32)
        .when(body.rlike(r"^(?:[0-9a-z]+|[0-9A-Z]+)$"), 36)
        .when(body.rlike(r"^[0-9A-Za-z]+$"), 62)
        .otherwise(64)
    )


def statistic(body: Column) -> Column:
    """Fisher's combination of the battery: -2 times the sum of the logs of three p-values.

    About 6 for uniform draws; the larger, the less random. At least 12 characters are
    expected; the whole string is used.
    """
    codes = F.filter(F.transform(F.split(body, ""), lambda c: F.ascii(c)), lambda c: c > 0)
    # Values are bound, so that none is worked out anew for each character.
    return bound(F.struct(codes.alias("c"), encoding_size(body).cast("double").alias("k")), _battery)


def _battery(x: Column) -> Column:
    """The sums that the tests need, each in one pass over the codes, then the tests."""
    codes, k = x["c"], x["k"]
    heads, tails = F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1)
    pairs = F.zip_with(heads, tails, lambda a, b: F.struct((_class(k, a) != _class(k, b)).cast("int").alias("change"), (a * b).alias("product")))
    zero = F.lit(0).cast("long")
    sums = F.aggregate(
        pairs, F.struct(zero.alias("changes"), zero.alias("products")),
        lambda a, p: F.struct((a["changes"] + p["change"]).alias("changes"), (a["products"] + p["product"]).alias("products")),
    )
    moments = F.aggregate(codes, F.struct(zero.alias("s"), zero.alias("ss")), lambda a, c: F.struct((a["s"] + c).alias("s"), (a["ss"] + c * c).alias("ss")))
    # Of the sorted codes, a code that is the j-th of its kind adds 2 j - 1 to the sum of squared counts.
    tally = F.aggregate(
        F.array_sort(codes),
        F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), zero.alias("sum")),
        lambda a, c: F.struct(
            c.alias("last"),
            F.when(c == a["last"], a["run"] + 1).otherwise(1).alias("run"),
            (a["sum"] + F.when(c == a["last"], 2 * a["run"] + 1).otherwise(1)).alias("sum"),
        ),
    )
    ends = F.element_at(codes, 1) + F.element_at(codes, -1)
    return bound(F.struct(F.size(codes).cast("double").alias("n"), k.alias("k"), sums.alias("p"), moments.alias("m"), tally.alias("t"), ends.alias("ends")), _tests)


def _tests(x: Column) -> Column:
    n, k, changes, products = x["n"], x["k"], x["p"]["changes"].cast("double"), x["p"]["products"].cast("double")
    s, ss, squares = x["m"]["s"].cast("double"), x["m"]["ss"].cast("double"), x["t"]["sum"].cast("double")
    chi = k / n * squares - n
    p_chi = _upper_tail((chi - (k - 1)) / F.sqrt(2 * (k - 1)))
    q = 1 - sum(F.pow(_class_share(k, F.lit(d)), 2.0) for d in range(3))
    p_runs = _upper_tail(((n - 1) * q - changes) / F.sqrt((n - 1) * q * (1 - q)))
    mean = s / n
    spread = ss - s * mean
    lagged = products - mean * (2 * s - x["ends"]) + (n - 1) * mean * mean
    serial = F.when(spread > 1e-9, lagged / spread).otherwise(1.0)
    p_serial = F.least(2 * _upper_tail(F.abs(serial + 1 / n) * F.sqrt(n)), F.lit(1.0))
    return -2 * (F.log(p_chi) + F.log(p_runs) + F.log(p_serial))


def _class(k: Column, code: Column) -> Column:
    """0 for digits and signs, 1 for capitals, 2 for small letters; of digits alone, 0 and 1 for the lower and upper half."""
    kinds = F.when(code < 58, 0).when(code < 95, 1).otherwise(2)
    return F.when(k == 10, (code >= 53).cast("int")).otherwise(kinds)


def _class_share(k: Column, d: Column) -> Column:
    """The expected share of the classes 0, 1 and 2 in an alphabet of k."""
    digits = F.when(k == 10, 0.5).when(k == 16, 10 / 16).when(k == 32, 6 / 32).when(k == 36, 10 / 36).when(k == 62, 10 / 62).otherwise(12 / 64)
    lower = F.when((k == 10) | (k == 32), 0.0).when(k == 16, 6 / 16).when(k == 36, 26 / 36).when(k == 62, 26 / 62).otherwise(26 / 64)
    return F.when(d == 0, digits).when(d == 2, lower).otherwise(1 - digits - lower)


def _cell(body: Column) -> Column:
    return F.least(F.floor(2 * statistic(body)), F.lit(TOP_CELL)).cast("int")


def proposals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, runs, control): base spans, candidates with their class and cell, and those of the null strings.

    A document has null strings of every fourth class, and none that is longer than its letters.
    """
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    df = with_matches(df, "__text", [*RULES, RUNS])
    strict = lambda s: F.length(F.regexp_replace(s["body"], ASSIGN_HEAD, "")) >= 6
    every = lambda s: F.lit(True)
    kept = F.concat(F.filter("assign", strict), F.col("access"), F.col("hex"))
    base = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["from"].alias("from"), s["to"].alias("to")))
    masks = {"assign": strict, "access": every, "hex": every}
    df = df.withColumn("base", base).withColumns({f"__mask_{k}": mask(F.col(k), f) for k, f in masks.items()})
    df = df.withColumn("__letters", F.regexp_replace("__text", "[^A-Za-z]++", ""))
    mixed = lambda s: s["body"].rlike(r"[0-9]|[a-z][A-Z]")
    run = lambda s, known: F.struct(
        s["from"].alias("from"), s["to"].alias("to"), length_class(s["body"]).alias("size"), _cell(s["body"]).alias("cell"), known.alias("known")
    )
    key, turn = F.xxhash64("doc_id", F.lit(5)), F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(4))

    def cuts(letters: Column) -> Column:
        sizes = F.filter(F.array(*[F.lit(x) for x in NULLS]), lambda size, i: (F.pmod(turn + i, F.lit(4)) == 0) & (size <= F.length(letters)))
        return F.transform(sizes, lambda size: F.substr(letters, (F.pmod(key, F.length(letters) - size + 1) + 1).cast("int"), size))

    return df.select(
        "doc_id",
        "base",
        each(F.filter("run", mixed), [F.col(f"__mask_{k}") for k in masks], run).alias("runs"),
        F.transform(bound(F.col("__letters"), cuts), lambda x: F.struct(length_class(x).alias("size"), _cell(x).alias("cell"))).alias("control"),
    )


def cutoffs(found: DataFrame, rate: float = 0.01) -> dict[int, int]:
    """For each length class the highest cell that the Benjamini-Hochberg rule reports.

    The driver gets the counted cells, at most 2 * 13 * 121 rows at any corpus size. A class
    without null strings reports nothing.
    """
    opened = found.select(F.explode(F.filter("runs", lambda r: ~r["known"])).alias("r")).select(F.lit(1).alias("open"), "r.size", "r.cell")
    null = found.select(F.explode("control").alias("r")).select(F.lit(0).alias("open"), "r.size", "r.cell")
    tables: dict[int, list[dict[int, int]]] = {}
    for r in opened.unionAll(null).groupBy("open", "size", "cell").count().collect():
        tables.setdefault(r["size"], [{}, {}])[r["open"]][r["cell"]] = r["count"]
    out = {}
    for size, (null_cells, cells) in tables.items():
        total, tests = sum(null_cells.values()), sum(cells.values())
        below = seen = 0
        for cell in range(TOP_CELL + 1):
            below, seen = below + null_cells.get(cell, 0), seen + cells.get(cell, 0)
            if total and seen and (below + 1) / (total + 1) <= rate * seen / tests:
                out[size] = cell
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """(doc_id, base, added): one row for each row of ``docs``; spans as arrays.

    Added spans, of kind 'random', meet no base span. A null text is an empty
    one; ids may be null or repeat; an empty table gives an empty result. Other
    columns are neither read nor returned.
    """
    found = common.durable(proposals(docs, id_col, text_col), "secrets")
    tops = cutoffs(found, rate)

    def within(r: Column) -> Column:
        ok = F.lit(False)
        for size, cell in tops.items():
            ok = ok | ((r["size"] == size) & (r["cell"] <= cell))
        return ~r["known"] & ok

    added = F.transform(
        F.filter("runs", within),
        lambda r: F.struct(F.lit("random").alias("kind"), r["from"].alias("from"), r["to"].alias("to")),
    )
    return found.select("doc_id", "base", added.alias("added"))


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and the list of all spans, by start and kind."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(listed(F.col("base"), KINDS, ("from", "kind")), 256).alias("base_sha256"),
        listed(F.concat("base", "added"), KINDS, ("from", "kind")).alias("spans"),
    )
