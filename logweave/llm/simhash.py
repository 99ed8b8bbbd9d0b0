"""SimHash fingerprints and near-duplicate groups by a binary-trie self-join.

Fingerprints take four-word shingles hashed by XXH64; two documents link when
their fingerprints differ in at most ``budget`` bits, and a group is a
connected component of links.

How the join is dealt out. The 64 bits are cut into ``blocks`` runs. With
``budget`` differing bits at least ``blocks - budget`` runs are equal, so for
each choice of that many runs the distinct fingerprints are grouped by those
bits and each group is a trie of its own, joined with itself. Fingerprints
shared by many documents count once. In a group larger than ``leaf``, what lies
within the budget of its most common fingerprint (its pivot) is linked to the pivot
at once and needs no comparison among itself. The group is then dealt out anew:
its other bits are cut into ``budget + 2`` runs, of which two must be equal, so each row
goes to one sub-trie for each choice of two, and crowded groups of far-apart
fingerprints fall to pieces at a constant number of rows for each. Only what is
still crowded then, fingerprints that share two levels of prefixes, is split around a pivot of
its own: the near rows into units of about ``leaf`` and the rest to every unit. No pair is lost by this.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, setjoin

SEED = 42
SHINGLE = 4
#: One in so many texts is looked at to learn which shingles are frequent.
SAMPLED = 16
SLICE = 50_000


def fingerprint_of(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text, as an unsigned integer.

    A-Z are lowered, words are runs of anything but ASCII white space, shingles
    are joined by one space and repeats count. Shorter texts are one shingle;
    a null text or one without words has fingerprint zero.
    """
    if text is None:
        return 0
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()
    total, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), SLICE):
        part = np.array(
            [digest(joined[i:j], seed) for i, j in zip(first[at : at + SLICE], last[at : at + SLICE])],
            dtype=np.uint64,
        )
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(first)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each input row; fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.fromiter(
                (fingerprint_of(t, width) for t in batch["text"]), np.uint64, len(batch)
            )
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": prints.view(np.int64)})

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return common.mapped(own, run, "doc_id long, fp long")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _joined(fps: np.ndarray, pairs: np.ndarray, budget: int, most: int = 400_000) -> Iterator[np.ndarray]:
    """Walks pairs of trie nodes together, level by level.

    ``fps`` is sorted within every node; a node is a range of it. ``pairs`` has
    rows (lo1, hi1, lo2, hi2). A pair of children that differ in the level's bit adds one
    to the errors so far, and a pair over the budget is pruned with all below it.
    Yields arrays of linked positions (i, j). A frontier over ``most`` pairs is
    split in two, so that memory stays bounded.
    """
    stack = [(63, pairs, np.zeros(len(pairs), np.int8))]
    while stack:
        bit, now, errors = stack.pop()
        if not len(now):
            continue
        if len(now) > most:
            half = len(now) // 2
            stack += [(bit, now[half:], errors[half:]), (bit, now[:half], errors[:half])]
            continue
        sizes = (now[:, 1] - now[:, 0]) * (now[:, 3] - now[:, 2])
        leaf = (sizes <= 16) | (bit < 0)
        if leaf.any():
            done = now[leaf]
            wide = (done[:, 3] - done[:, 2]).astype(np.int64)
            count = ((done[:, 1] - done[:, 0]) * wide).astype(np.int64)
            who = np.repeat(np.arange(len(done)), count)
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            i, j = done[who, 0] + step // wide[who], done[who, 2] + step % wide[who]
            near = (i < j) & (_popcount(fps[i] ^ fps[j]) <= budget)
            if near.any():
                yield np.stack([i[near], j[near]], axis=1)
            now, errors = now[~leaf], errors[~leaf]
            if not len(now):
                continue
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        mid1 = now[:, 1] - (ones[now[:, 1]] - ones[now[:, 0]])
        mid2 = now[:, 3] - (ones[now[:, 3]] - ones[now[:, 2]])
        same = (now[:, 0] == now[:, 2]) & (now[:, 1] == now[:, 3])
        nodes = {
            (0, 0): (now[:, 0], mid1, now[:, 2], mid2),
            (1, 1): (mid1, now[:, 1], mid2, now[:, 3]),
            (0, 1): (now[:, 0], mid1, mid2, now[:, 3]),
            (1, 0): (mid1, now[:, 1], now[:, 2], mid2),
        }
        grown, counted = [], []
        for (left, right), ranges in nodes.items():
            child = np.stack(ranges, axis=1)
            more = errors + (left != right)
            keep = (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3]) & (more <= budget)
            if (left, right) == (1, 0):
                keep &= ~same
            grown.append(child[keep])
            counted.append(more[keep])
        stack.append((bit - 1, np.concatenate(grown), np.concatenate(counted)))


def _spanning(links: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which links join trees of the forest ``label``, as a mask, and the forest with them, by hooking and pointer jumping."""
    chosen, at = np.zeros(len(links), bool), np.arange(len(links))
    while len(links):
        a, b = label[links[:, 0]], label[links[:, 1]]
        live = a != b
        if not live.any():
            break
        links, a, b, at = links[live], a[live], b[live], at[live]
        # The first link of each higher root hooks it to a lower one, so no circle can form.
        high, low = np.maximum(a, b), np.minimum(a, b)
        roots, first = np.unique(high, return_index=True)
        label = label.copy()
        label[roots] = low[first]
        chosen[at[first]] = True
        while True:
            higher = label[label]
            if (higher == label).all():
                break
            label = higher
    return chosen, label


def _link_units(budget: int, room: int = 30_000):
    """Joins the tries of a partition sorted by unit; yields a spanning forest of each, of real links."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        fps = rows["fp"].to_numpy(np.int64).view(np.uint64)
        unit = rows["unit"].to_numpy()
        unit, near = unit >> 1, (unit & 1).astype(bool)
        order = np.lexsort((fps, near, unit))
        fps, unit, near = fps[order], unit[order], near[order]
        edge = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1], [True])))
        lo, hi = edge[:-1], edge[1:]
        far = np.concatenate(([0], np.cumsum(~near)))
        mid = lo + (far[hi] - far[lo])
        own = np.stack([lo, mid, lo, mid], axis=1)[mid - lo > 1]
        across = np.stack([lo, mid, mid, hi], axis=1)[(mid > lo) & (hi > mid)]
        label, chosen = np.arange(len(fps)), []
        for links in _joined(fps, np.concatenate([own, across]).astype(np.int64), budget):
            taken, label = _spanning(links, label)
            chosen.append(links[taken])
        node = rows["node" if "node" in rows else "fp"].to_numpy()[order]
        edges = np.concatenate(chosen) if chosen else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": node[edges[:, 0]], "b": node[edges[:, 1]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < room:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = rows["unit"].to_numpy() >> 1 == rows["unit"].iloc[-1] >> 1
            if last.all():
                continue
            yield solve(rows[~last])
            held, size = [rows[last]], int(last.sum())
        if size:
            yield solve(pd.concat(held, ignore_index=True))

    return run


def _masks(free: int, runs: int, kept: int) -> list[int]:
    """Masks over the set bits of ``free``, cut into runs, for each choice of ``kept`` runs."""
    bits = [i for i in range(64) if free >> i & 1]
    cuts = [len(bits) * i // runs for i in range(runs + 1)]
    parts = [sum(1 << i for i in bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    return [sum(parts[i] for i in chosen) for chosen in combinations(range(runs), kept)]


def _signed(mask: int) -> int:
    return mask - ((mask >> 63) << 64)


def _crowded(rows: DataFrame, leaf: int) -> DataFrame:
    """(unit) of the groups over ``leaf``: counts of single numbers, as every row of every trie is counted."""
    return common.durable(rows.groupBy("unit").agg(F.count("*").alias("size")).where(F.col("size") > leaf), "crowded")


def _around(rows: DataFrame, crowded: DataFrame, budget: int) -> DataFrame:
    """The rows of crowded groups with size and pivot of their group, and whether they are near the pivot."""
    own = rows.join(crowded, "unit")
    pivots = own.groupBy("unit").agg(F.max_by(F.struct("fp", "node"), F.struct("weight", "node")).alias("pivot"))
    return own.join(common.durable(pivots, "pivots"), "unit").withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot.fp"))) <= budget)


def _linked(around: DataFrame) -> DataFrame:
    return around.where(F.col("near") & (F.col("node") != F.col("pivot.node"))).select(F.col("node").alias("a"), F.col("pivot.node").alias("b"))


def link_nodes(nodes: DataFrame, budget: int = 4, blocks: int = 6, leaf: int = 1024) -> DataFrame:
    """Links (a, b) that span each component of ``nodes`` (fp, node, weight); fp is unique, and stands for a node without a name of its own.

    The components are exact: a link that isn't returned has its ends joined by others. For links of which each must be decided on, see ``similar``.
    """
    own = "node" if "node" in nodes.columns else "fp"
    if not 0 <= budget < blocks <= 64:
        raise ValueError("blocks must exceed the budget")
    masks = _masks((1 << 64) - 1, blocks, blocks - budget)
    keys = [
        F.struct(F.lit(i).alias("trie"), F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long"))).alias("unit"))
        for i, m in enumerate(masks)
    ]
    nodes = nodes if own == "node" else nodes.withColumn("node", F.col("fp"))
    rows = nodes.withColumn("at", F.explode(F.array(*keys))).select("fp", "node", "weight", F.col("at.trie").alias("trie"), F.col("at.unit").alias("unit"))
    # The lowest bit of a unit says whether a row is near its pivot: rows that are dealt out are two or three numbers.
    marked = lambda df, near: df.select(*dict.fromkeys(("fp", own)), F.shiftleft(F.shiftright("unit", 1), 1).bitwiseOR(near.cast("long")).alias("unit"))
    crowded = _crowded(rows, leaf)
    placed = [marked(rows.join(crowded, "unit", "left_anti"), F.lit(False))]
    found = []
    if not crowded.isEmpty():
        around = _around(rows, crowded, budget)
        found.append(_linked(around))
        # By trie, the sub-tries over the bits that its prefix leaves free.
        subs = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in _masks(((1 << 64) - 1) & ~mask, budget + 2, 2)]) for mask in masks])
        again = around.select("fp", "node", "weight", "near", "unit", F.posexplode(F.element_at(subs, F.col("trie") + 1)).alias("sub", "mask"))
        again = again.select("fp", "node", "weight", "near", F.xxhash64("unit", "sub", F.col("fp").bitwiseAND(F.col("mask"))).alias("unit"))
        packed = _crowded(again, leaf)
        placed.append(marked(again.join(packed, "unit", "left_anti"), F.col("near")))
        if not packed.isEmpty():
            dense = _around(again.drop("near"), packed, budget)
            found.append(_linked(dense))
            units = F.ceil(F.col("size") / leaf).cast("int")
            part = F.when(F.col("near"), F.array(F.pmod(F.xxhash64("fp"), units).cast("int"))).otherwise(F.sequence(F.lit(0), units - 1))
            split = dense.withColumn("part", F.explode(part)).select("fp", "node", "near", F.xxhash64("unit", "part").alias("unit"))
            placed.append(marked(split, F.col("near")))

    whole = placed[0]
    for more in placed[1:]:
        whole = whole.unionAll(more)
    whole = whole.repartition(F.shiftright("unit", 1)).sortWithinPartitions("unit")
    out = whole.mapInPandas(_link_units(budget), "a long, b long")
    for more in found:
        out = out.unionAll(more)
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 4, blocks: int = 6, leaf: int = 1024
) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each row of ``docs``.

    Null and wordless texts have fingerprint zero and link like any other; equal
    rows share a group. A row with a null id keeps its fingerprint, links
    nothing and has a null component. An empty table gives an empty result.
    Other columns of ``docs`` are neither read nor returned.
    """
    prints = common.durable(fingerprints(docs, id_col, text_col), "prints")
    nodes = prints.where("doc_id is not null").groupBy("fp").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("weight")
    )
    nodes = common.durable(nodes, "nodes")
    found = common.components(link_nodes(nodes, budget, blocks, leaf))
    groups = nodes.join(found, "node", "left").select(
        "fp", F.coalesce("component", "node").alias("component_id")
    )
    return prints.join(groups, "fp", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def _shingles(words: list[bytes], width: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; the whole sequence where it is shorter, none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    parts = (b" ".join(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, leaf: int = 1024) -> DataFrame:
    """(doc_id, component_id): groups of texts whose ``width``-word shingle sets have a Jaccard similarity of ``similarity``.

    Texts of equal words (A-Z lowered) are one set, told by a 64-bit hash, as shingles are. No similar pair of sets is left out: they meet
    by the prefixes of their sets (see ``setjoin``), and the exact similarity decides.

    One row for each row of ``docs``. Null and wordless texts are equal to each other. A row with a null id
    links nothing and has a null component. An empty table gives an empty result.
    Other columns of ``docs`` are neither read nor returned.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def key(words: list[bytes]) -> int:
        return xxhash.xxh64_intdigest(b" ".join(words))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            same = np.fromiter((key(_words(t)) for t in b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "key": same.view(np.int64)})

    rows = common.durable(common.mapped(own, keys, "doc_id long, key long"), "keys")
    texts = common.durable(rows.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("node")), "texts")
    named = own.where("doc_id is not null")

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"element": np.concatenate([_shingles(_words(t), width) for t in b["text"]] or [np.zeros(0, np.uint64)]).view(np.int64)})

    some = named.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select("text")
    order = setjoin.rare_first(common.mapped(some, elements, "element long"))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                words = _words(t)
                mine = _shingles(words, width)
                out.append((np.uint64(key(words)).view(np.int64), len(mine), order(mine)[: setjoin.prefix_length(len(mine), similarity)].tobytes()))
            yield pd.DataFrame(out, columns=["key", "n", "prefix"])

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [np.frombuffer(p, np.int64) for p in b["prefix"]]
            times = [len(p) for p in held]
            if sum(times):
                yield pd.DataFrame({"element": np.concatenate(held), "key": np.repeat(b["key"].to_numpy(), times), "n": np.repeat(b["n"].to_numpy(), times)})

    once = common.mapped(named.select("text"), prefixes, "key long, n int, prefix binary").dropDuplicates(["key"])

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = [_words(t) for t in b["text"]]
            same = np.fromiter(map(key, words), np.uint64, len(b))
            yield pd.DataFrame({"key": same.view(np.int64), "shingles": [_shingles(w, width).tobytes() for w in words]})

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["x"], b["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared))
            yield b.loc[keep, ["a", "b"]]

    def decided(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
        wanted = common.durable(texts.join(ends, "key", "left_semi"), "ends")
        # Texts stay where they are: most of them stand in no pair, and an id may stand for other texts too.
        held = common.mapped(common.sieved(named, "doc_id", wanted.select("node")).select("text"), sets, "key long, shingles binary")
        held = common.durable(held.dropDuplicates(["key"]).join(wanted.select("key"), "key", "left_semi"), "shingles")
        both = pairs.join(held.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(
            held.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b"
        )
        return common.mapped(both.select("a", "b", "x", "y"), compared, "a long, b long", 200)

    found = setjoin.linked(common.mapped(once, dealt, "element long, key long, n int"), decided, similarity, leaf)
    groups = texts.join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = groups.groupBy("component").agg(F.min("node").alias("component_id"))
    groups = common.durable(groups.join(least, "component").select("key", "component_id"), "groups")
    return rows.join(groups, "key", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates, **how) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its group, by ``near_duplicates`` or ``similar``.

    Of rows that repeat one id, a single one stays; rows with a null id all
    stay, having no group. The columns are those of ``docs``.
    """
    p = common.prefix(docs)

    def marked() -> DataFrame:
        found = find(docs, id_col, text_col, **how).where("doc_id is not null")
        marks = found.groupBy(F.col("doc_id").alias(f"{p}id")).agg(
            (F.min("component_id") < F.first("doc_id")).alias(f"{p}gone"), F.count("*").alias(f"{p}times")
        )
        return marks.where(f"{p}gone or {p}times > 1")

    # Written first: the planner knows its size, and texts are dealt out at most once.
    marks = common.settled(docs.sparkSession, "marks", marked)
    same = docs[id_col].cast("long") == F.col(f"{p}id")
    kept = docs.join(marks.where(f"{p}gone").select(f"{p}id"), same, "left_anti")
    again = marks.where(f"not {p}gone").select(f"{p}id")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept[id_col].cast("long") == F.col(f"{p}id"), "left_anti")
    repeated = kept.join(again, kept[id_col].cast("long") == F.col(f"{p}id"), "left_semi")
    return once.unionByName(repeated.dropDuplicates([id_col]))
