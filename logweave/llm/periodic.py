"""Periodic runs: stretches of words that repeat with one period, four times or more.

Blocks of 2, 4, 8, ... words that stand at multiples of their size are searched
in their document by an automaton over sequences of word numbers. A run of
period q holds an aligned block of the scale that fits q, and the same block
again q words on; so each occurrence at a distance that fits the scale is a seed,
extended word by word to both sides.

Two facts keep this near linear, and lose nothing. In a run of period q and length L the
first L - q words all recur within q words, so an automaton is built only over
stretches in which that many words in a row recur so soon. And a stretch within a
run of a smaller period holds no other run's beginning: scales ascend, and what a
found run covers isn't searched again.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A run has as many words at least, and as many periods.
LEAST, TIMES = 6, 4

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True

SCHEMA = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def distances(block: int) -> tuple[int, int]:
    """The smallest and the largest period whose runs are seeded by blocks of this size.

    A run of period q has length 4 q or more; an aligned block that begins among its first ``block`` words
    and the block q words on both lie in it if 2 * block - 1 + q <= 4 q. Periods of 1 and 2 go with blocks of 2.
    """
    return (2 * block + 1) // 3, (4 * block - 2) // 3


def needed(block: int) -> int:
    """How many words in a row recur within the scale's largest period where a run of the scale is."""
    low, high = distances(block)
    return min(max(LEAST, TIMES * q) - q for q in range(low, high + 1))


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a slice of texts: an array with words at its even places, their numbers (equal words, equal numbers), and the texts' bounds in words."""
    gap = SEPARATORS[data]
    first = ~gap
    last = first.copy()
    head = np.zeros(len(data) + 1, bool)
    head[at] = True  # where a text begins or ends
    first[1:] &= gap[:-1] | head[1:-1]
    last[:-1] &= gap[1:] | head[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, at)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int32), bounds
    offsets = np.column_stack([starts, ends]).ravel().astype(np.int32)
    both = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
    return both, both.dictionary_encode().indices.to_numpy()[::2], bounds


def recurrences(ids: np.ndarray) -> np.ndarray:
    """How far on each word stands next; a number beyond all words if it doesn't."""
    order = np.argsort(ids, kind="stable")
    out = np.full(len(ids), len(ids) + 1, np.int32)
    same = ids[order[1:]] == ids[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def stretches(near: np.ndarray, breaks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of unbroken true stretches of ``least`` or more; ``breaks``: where a text begins."""
    first = near.copy()
    first[1:] &= ~near[:-1] | breaks[1:]
    last = near.copy()
    last[:-1] &= ~near[1:] | breaks[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


class _Text:
    """The runs of one text, found scale by scale."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.runs: dict[int, list[tuple[int, int]]] = {}  # by period: ascending (start, end)

    def covered(self, start: int, end: int, period: int = 0) -> bool:
        """Whether the stretch lies in a found run; with ``period``: in one whose period divides it."""
        for q, held in self.runs.items():
            if period % q == 0:
                i = bisect_right(held, (start, len(self.ids) + 1)) - 1
                if i >= 0 and held[i][1] >= end:
                    return True
        return False

    def extended(self, start: int, end: int, q: int) -> tuple[int, int]:
        """The farthest bounds within which words q apart are the same; they are from ``start`` to ``end`` - q."""
        ids, n = self.ids, len(self.ids)
        i, size = end - q, 16
        while i + q < n:
            size = min(2 * size, n - q - i)
            other = ids[i : i + size] != ids[i + q : i + q + size]
            at = int(other.argmax())
            if other[at]:
                i += at
                break
            i += size
        j, size = start, 16
        while j > 0:
            size = min(2 * size, j)
            other = (ids[j - size : j] != ids[j - size + q : j + q])[::-1]
            at = int(other.argmax())
            if other[at]:
                j -= at
                break
            j -= size
        return j, i + q

    def search(self, start: int, end: int, block: int) -> None:
        """Seeds and extends the runs of a scale whose first words lie in a stretch."""
        if self.covered(start, end):
            return
        low, high = distances(block)
        end = min(end + high, len(self.ids))
        text = tuple(self.ids[start:end].tolist())
        aligned = range(-(-start // block) * block, end - block + 1, block)
        automaton, known = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
        for s in aligned:
            key = text[s - start : s - start + block]
            known.setdefault(key, len(known))
            automaton.add_word(key, known[key])
        if not known:
            return
        automaton.make_automaton()
        found: list[list[int]] = [[] for _ in known]
        for last, i in automaton.iter(text):
            found[i].append(start + last - block + 1)
        tried: dict[int, int] = {}  # by distance: the end of the last stretch extended
        for s in aligned:
            places = found[known[text[s - start : s - start + block]]]
            for p in places[bisect_left(places, s + low) : bisect_right(places, s + high)]:
                q = p - s
                if tried.get(q, 0) >= p + block or self.covered(s, p + block, q):
                    continue
                a, b = self.extended(s, p + block, q)
                tried[q] = b
                if b - a >= max(LEAST, TIMES * q):
                    held = self.runs.setdefault(q, [])
                    held.append((a, b))
                    held.sort()


def runs_of(ids: np.ndarray, bounds: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By text, where it has any: its runs (start, length, period), by start and period. Texts are stretches of ``ids``."""
    texts: dict[int, _Text] = {}
    breaks = np.zeros(len(ids) + 1, bool)
    breaks[bounds] = True
    breaks, next_at = breaks[:-1], recurrences(ids)
    longest, block = int(np.diff(bounds).max(initial=0)), 2
    while needed(block) + distances(block)[0] <= longest:
        starts, ends = stretches(next_at <= distances(block)[1], breaks, needed(block))
        owners = np.searchsorted(bounds, starts, "right") - 1
        for d, a, b in zip(owners.tolist(), starts.tolist(), ends.tolist()):
            at = int(bounds[d])
            text = texts.get(d) or texts.setdefault(d, _Text(ids[at : int(bounds[d + 1])]))
            text.search(a - at, b - at, block)
        block *= 2
    found = {d: sorted((a, b - a, q) for q, held in t.runs.items() for a, b in held) for d, t in texts.items()}
    return {d: held for d, held in found.items() if held}


def _found(text: pa.Array) -> pa.Array:
    """One slice of a batch."""
    rows = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int32, rows + 1, text.offset * 4)
    at = (offsets - offsets[0]).astype(np.int64)
    data = np.frombuffer(text.buffers()[2], np.uint8, int(at[-1]), int(offsets[0])) if at[-1] else np.zeros(0, np.uint8)
    both, ids, bounds = words_of(data, at)
    found = runs_of(ids, bounds)
    sizes = np.zeros(rows + 1, np.int32)
    dropped = np.zeros(len(ids) + 1, np.int32)  # +1 where a stretch to drop begins, -1 behind it
    for d, held in found.items():
        sizes[d + 1] = len(held)
        for a, length, q in held:
            dropped[bounds[d] + a + q] += 1
            dropped[bounds[d] + a + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    runs = np.array([r for d in sorted(found) for r in found[d]], np.int64).reshape(-1, 3)
    lists = pa.ListArray.from_arrays(
        pa.array(np.cumsum(sizes, dtype=np.int32)), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, i])) for i in range(3)], ["start", "length", "period"])
    )
    left = np.append(0, np.cumsum(kept))[bounds].astype(np.int32)
    words = pa.ListArray.from_arrays(pa.array(left), both.take(pa.array(2 * np.flatnonzero(kept))))
    return pa.StructArray.from_arrays([pa.array(np.diff(bounds)), lists, pc.binary_join(words, " ")], ["n_words", "runs", "collapsed"])


def find(docs: DataFrame, text_col: str = "text", into: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, the runs (start, length, period) by start and period, and the collapsed text.

    Words are stretches without ASCII white space. A run is a stretch of six words or more that has four times its smallest
    period or more and can't be extended. In the collapsed text, of each run only the first period
    is left (words of another run's repetitions go too), and words are joined by single spaces. A null or wordless text has no words, no runs
    and an empty collapsed text. Each row is searched by itself, whole: a task holds
    one slice of ``common.SLICE`` bytes, or one longer text. A column called ``into`` is replaced. An empty table gives an empty one.
    """
    return common.with_kernel(docs, [F.col(text_col)], _found, SCHEMA, into)


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with periods planted in the tenth of the documents that a checksum of the id picks.

    Their words are joined by single spaces; from word a on, they repeat the p words from there. Other texts stay as they are,
    and so do those with a null id.
    """
    p = common.prefix(docs)
    g, w, a, n = (F.col(p + x) for x in "gwan")
    h = F.crc32(F.col(id_col).cast("string"))
    picked = (h % 10 == 0) & F.col(text_col).isNotNull()
    df = docs.select(F.col(id_col), F.col(text_col), F.when(picked, F.floor(h / 10).cast("long")).alias(p + "g"))
    df = df.withColumn(p + "w", F.when(g.isNotNull(), F.regexp_extract_all(text_col, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    df = df.withColumn(p + "n", F.size(w).cast("long")).withColumn(p + "a", F.when(n > 0, g % n))
    period = (1 + F.floor((n - a) / (3 + g % 8))).cast("long")
    held = F.struct(w.alias("w"), a.alias("a"), period.alias("p"))
    again = F.transform(
        F.array(held),
        lambda x: F.transform(
            x["w"], lambda v, i: F.when(i < x["a"], v).otherwise(F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int")))
        ),
    )[0]
    return df.select(id_col, F.when(a.isNotNull(), F.array_join(again, " ")).otherwise(F.col(text_col)).alias(text_col))


def best(runs: Column) -> Column:
    """The run that holds its period most often, by exact fractions; of equals the first."""
    over = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.reduce(runs, F.get(runs, 0), lambda held, r: F.when(over(r, held), r).otherwise(held))


def digest(found: DataFrame, id_col: str = "doc_id", into: str = "periodic") -> DataFrame:
    """Numbers and hashes of what was found."""
    x = F.col(into)
    said = F.transform(x["runs"], lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    top = F.col(f"{into}_best")
    return found.withColumn(f"{into}_best", best(x["runs"])).select(
        id_col, F.size(x["runs"]).cast("long").alias("n_runs"), top["start"].alias("start"), top["length"].alias("length"), top["period"].alias("period"),
        F.expr(f"(1000 * {into}_best.length) div {into}_best.period").alias("exponent_milli"),
        F.sha2(F.array_join(said, ""), 256).alias("runs_sha256"), F.sha2(x["collapsed"], 256).alias("collapsed_sha256"),
    )
