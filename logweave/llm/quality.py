"""Quality rules with risk-controlled thresholds.

Each rule is a score of a document; larger is worse. Labelled documents are the
holdout, split in two by a hash of their ids. The design half proposes: for each
stratum (language) it orders cutoffs of the rules, from rejecting nothing on, each
step lowering the cutoff of one rule to where it gains most bad documents for
the good ones it costs. The proof half disposes: along that order, the share of good documents
rejected by any rule at once must have an exact (Clopper-Pearson) upper bound
within the allowed risk, and the scan stops at the first step that doesn't
(fixed-sequence testing, which needs no correction within the sequence). The error
probability is shared out over the strata (Bonferroni), so the guarantee holds for
all of them together: in each stratum at most ``risk`` of the good documents that pass the base rules
are rejected. A stratum with too few good documents in the proof half to prove the
risk at all gets no cutoff: only the base rules reject there.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Rules as shares in percent, each cut at whole percents.
RULES = {
    "symbols": "100.0 * n_symbols / greatest(n_words, 1)",
    "duplicate_lines": "100.0 * n_dup_lines / greatest(n_lines, 1)",
    "repeats": "100.0 * n_repeat_words / greatest(n_words, 1)",
    "long_words": "100.0 * greatest(word_chars / greatest(n_words, 1) - 4, 0) / 10",
    "short_words": "100.0 * greatest(6 - word_chars / greatest(n_words, 1), 0) / 6",
}
TOP = 200


def counts_of(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines with a word)."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    duplicate = len(lines) - len(set(lines))
    repeated = 0
    if len(words) >= 4:
        windows = list(zip(words, words[1:], words[2:]))
        seen = set(windows)
        if len(seen) < len(windows):
            times, covered = Counter(windows), 0
            for i, w in enumerate(windows):
                if times[w] > 1:
                    repeated += i + 3 - max(covered, i)
                    covered = i + 3
    return len(words), chars, symbols, duplicate, repeated, len(lines)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row of counts for each row of ``docs``, and whether the base rules reject it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([counts_of(t) for t in b["text"]], columns=[*COUNTS, "n_lines"], dtype="int64")
            found.insert(0, "stratum", b["stratum"].to_numpy())
            found.insert(0, "doc_id", b["doc_id"].astype("Int64").to_numpy())
            yield found

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), F.col(text_col).alias("text"))
    out = common.mapped(own, run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in [*COUNTS, "n_lines"]))
    return out.withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, summed exactly."""
    if p <= 0:
        return 1.0
    if p >= 1:
        return float(k >= n)
    lg, lp, lq = math.lgamma(n + 1), math.log(p), math.log1p(-p)
    return min(1.0, math.fsum(
        math.exp(lg - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq) for i in range(k + 1)
    ))


def controlled(k: int, n: int, risk: float, error: float) -> bool:
    """Whether k rejections of n good documents prove a rate within ``risk`` at this error.

    That is, whether the Clopper-Pearson upper bound is at most ``risk``.
    """
    return n > 0 and k < n and binomial_cdf(k, n, risk) <= error


def _cells(rows: DataFrame) -> DataFrame:
    rules = [F.struct(F.lit(name).alias("rule"), F.least(F.floor(F.expr(e)), F.lit(TOP)).cast("int").alias("cell")) for name, e in RULES.items()]
    return rows.withColumn("r", F.explode(F.array(*rules))).select("*", "r.rule", "r.cell").drop("r")


def proposed(cells: dict[str, dict[bool, Counter]], worth: float) -> list[tuple[str, int]]:
    """Steps (rule, lowest rejected cell), the best first, from the design half's counts by rule, goodness and cell.

    A step takes the cells of one rule from its last cutoff down; it is the one with the most bad
    documents beyond ``worth`` times the good ones for each document it rejects, and must gain.
    """
    at = dict.fromkeys(cells, TOP + 1)
    steps = []
    while True:
        best = (0.0, 0, "", 0)
        for rule, table in cells.items():
            good = bad = 0
            for cell in range(at[rule] - 1, 0, -1):
                good, bad = good + table[True][cell], bad + table[False][cell]
                if bad > worth * good:
                    best = max(best, ((bad - worth * good) / (good + bad), bad, rule, cell))
        if best[0] <= 0:
            return steps
        _, _, rule, cell = best
        at[rule] = cell
        steps.append((rule, cell))


def least_holdout(risk: float, error: float) -> int:
    """The fewest good documents that can prove the risk: with none of them rejected."""
    n = max(1, math.ceil(math.log(error) / math.log1p(-risk)))
    return n if controlled(0, n, risk, error) else n + 1


def thresholds(
    counts: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05, worth: float = 10.0
) -> dict[str, dict[str, int]]:
    """{stratum: {rule: lowest rejected cell}} with the risk of each stratum controlled together at ``error``.

    The holdout is the labelled documents that pass the base rules, each id once, with the
    row of the smallest counts where an id repeats; a document with any label 1 is good. Rows without
    a language are a stratum of their own. The driver gets a few thousand counted cells for each stratum that can
    prove the risk, and no stratum that can't.
    """
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("quality") == 1).alias("good")
    )
    row = F.struct(*COUNTS, "n_lines", F.col("stratum").isNull().alias("none"), F.coalesce("stratum", F.lit("")).alias("named"))
    first = counts.where("not base_failed").groupBy("doc_id").agg(F.min(row).alias("row"))
    proof = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(3)) > 0
    holdout = first.join(marked, "doc_id").select("row.*", "good", proof.alias("proof"))
    stratum = F.when(F.col("none"), F.lit("")).otherwise(F.concat(F.lit("="), "named"))
    holdout = common.durable(holdout.withColumn("stratum", stratum), "holdout")
    least = least_holdout(risk, error)
    sizes = {r["stratum"]: r["count"] for r in holdout.where("good and proof").groupBy("stratum").count().where(F.col("count") >= least).collect()}
    # Each stratum that qualifies shares the error with the others that do.
    while sizes and (small := [s for s, n in sizes.items() if n < least_holdout(risk, error / len(sizes))]):
        del sizes[min(small, key=lambda s: (sizes[s], s))]
    if not sizes:
        return {}
    rows = holdout.where(F.col("stratum").isin(list(sizes)))
    design: dict[str, dict[str, dict[bool, Counter]]] = {s: {} for s in sizes}
    for r in _cells(rows.where("not proof")).groupBy("stratum", "rule", "cell", "good").count().collect():
        design[r["stratum"]].setdefault(r["rule"], {True: Counter(), False: Counter()})[r["good"]][r["cell"]] += r["count"]
    orders = {s: proposed(design[s], worth) for s in sizes}
    # The first step that rejects a document, and how many good ones each step is the first to reject.
    step = F.lit(None).cast("int")
    for s, order in orders.items():
        own = F.lit(None).cast("int")
        for i, (rule, cell) in reversed(list(enumerate(order))):
            own = F.when(F.expr(RULES[rule]) >= cell, i).otherwise(own)
        step = F.when(F.col("stratum") == s, own).otherwise(step)
    rejected: dict[str, Counter] = {s: Counter() for s in sizes}
    for r in rows.where("proof and good").select("stratum", step.alias("step")).where("step is not null").groupBy("stratum", "step").count().collect():
        rejected[r["stratum"]][r["step"]] = r["count"]
    out: dict[str, dict[str, int]] = {}
    for s, order in orders.items():
        k = 0
        for i, (rule, cell) in enumerate(order):
            k += rejected[s][i]
            if not controlled(k, sizes[s], risk, error / len(sizes)):
                break
            out.setdefault(s, {})[rule] = cell
    return out


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = 0.01, error: float = 0.05
) -> DataFrame:
    """Counts, ``base_failed`` and ``kept``: one row for each row of ``docs``.

    A null text has no words and so fails the base rules; rows without a language are a
    stratum of their own; labels that are null or of unknown documents don't count, and where they
    can't prove the risk only the base rules reject. Ids may repeat. An empty table gives an empty result.
    """
    counts = common.durable(measured(docs, id_col, text_col, stratum_col), "counts")
    rejected = F.lit(False)
    for s, cuts in sorted(thresholds(counts, labels, risk, error).items()):
        mine = F.col("stratum").isNull() if s == "" else F.col("stratum").eqNullSafe(F.lit(s[1:]))
        for rule, cell in sorted(cuts.items()):
            rejected = rejected | (mine & (F.expr(RULES[rule]) >= cell))
    return counts.select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept")
    )
