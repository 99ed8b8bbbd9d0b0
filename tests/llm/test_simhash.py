import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logweave.llm import common, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_fingerprint(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups(prints, budget):
    """prints: {id: fingerprint}; the smallest reachable id of each."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_documents(docs, rows):
    want = {r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}
    whole = groups(want, 4)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{want[r['doc_id']]:016x}", whole[r["doc_id"]])


def test_empty(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_first(nothing).count() == 0


def _links(spark, prints, **how):
    signed = [(v - (1 << 64) if v >> 63 else v, i, 1) for i, v in prints.items()]
    nodes = spark.createDataFrame(signed, "fp long, node long, weight long")
    found = {r["node"]: r["component"] for r in common.components(simhash.link_nodes(nodes, **how)).collect()}
    return {i: found.get(i, i) for i in prints}


def test_links_of_scattered_and_crowded_prints(spark):
    rng = random.Random(3)
    prints = {i: rng.getrandbits(64) for i in range(150)}
    for c in range(4):
        at = rng.getrandbits(64)
        for k in range(120):
            v = at
            for _ in range(rng.randint(0, 7)):
                v ^= 1 << rng.randrange(64)
            prints[1000 * (c + 1) + k] = v
    prints = {i: v for v, i in {v: i for i, v in prints.items()}.items()}
    want = groups(prints, 4)
    assert _links(spark, prints) == want
    # Groups over the leaf size are split around their pivot.
    assert _links(spark, prints, leaf=8) == want
    assert _links(spark, prints, budget=2, blocks=3) == groups(prints, 2)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)], "a long, b long")
    found = {r["node"]: r["component"] for r in common.components(edges).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_keep_first(docs, rows):
    whole = groups({r[0]: plain_fingerprint(r[1]) for r in rows if r[0] is not None}, 4)
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(whole.values()))
    assert kept.count(None) == 1 and simhash.keep_first(docs).columns == docs.columns
    assert docs.where(F.col("doc_id").isNull()).count() == 1


def test_similar_texts(spark):
    rng = random.Random(12)
    made = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    texts = [" ".join(made(rng.randint(0, 300))) for _ in range(150)]
    for t in texts[:50]:
        w = t.split()
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for _ in range(rng.randint(0, 6)):
                if v:
                    v[rng.randrange(len(v))] = made(1)[0]
            texts.append(" ".join(v).upper() if rng.random() < 0.2 else " ".join(v))
    texts += ["", None, " \t", "one two", "ONE  two"]
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3]), (3, "another text of that id")]

    def shingles(t):
        w = WORD.findall((t or "").translate(LOWER))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)) if w else frozenset()

    sets = {i: shingles(t) for i, t in enumerate(texts)}
    root = dict(zip(sets, sets))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = simhash.similar(docs).collect()
    assert len(found) == len(rows)
    got = {r["doc_id"]: r["component_id"] for r in found if r["doc_id"] not in (None, 3)}
    want = {i: find(i) for i in sets if i != 3}
    # Groups are never joined without a link, and hardly any link is missed.
    assert all(want[i] == want[c] for i, c in got.items() if c in want)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)
    kept = simhash.keep_first(docs, find=simhash.similar).collect()
    assert {r["doc_id"] for r in kept} >= {i for i in want if want[i] == i} and len(kept) < len(rows) - 60


def _edited(rng, words, w, times):
    v = list(w)
    for i in rng.sample(range(len(v)), times):
        v[i] = rng.choice(words)
    return v


@pytest.mark.parametrize("leaf, share", [(1024, 0.95), (64, 0.5)])
def test_family_of_edited_texts(spark, leaf, share):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    base, rows = [rng.choice(words) for _ in range(300)], []
    for i in range(150):
        # All of a family lie within a few bits of each other; only each one's own copy shares 0.8 of its shingles.
        own = _edited(rng, words, base, 14)
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join(_edited(rng, words, own, 5)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, leaf=leaf).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(150)) >= share * 150


@pytest.mark.parametrize("leaf", [1024, 16])
def test_no_similar_pair_is_left_out(spark, leaf):
    """A family whose texts lie close together but aren't similar, each with a copy that is; and a passage that stands in many texts."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    base, passage, texts = [rng.choice(words) for _ in range(300)], [rng.choice(words) for _ in range(40)], []
    for _ in range(150):
        own = _edited(rng, words, base, 14)
        texts += [own, _edited(rng, words, own, rng.randint(2, 9))]
    for _ in range(120):
        texts.append([rng.choice(words) for _ in range(rng.randint(5, 60))] + passage)
    for w in texts[-40:]:
        texts.append(_edited(rng, words, w, rng.randint(1, 3)))
    for _ in range(60):  # similarities on the very edge: 40 of 50, 8 of 10, 4 of 5
        own = [rng.choice(words) for _ in range(rng.choice([49, 12, 8, 44]))]
        texts += [own, own[: -rng.randint(1, max(len(own) // 6, 1))]]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 5, 0) + 1)) for w in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if same >= 0.8 * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs, leaf=leaf).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) < len(got) - 150


def test_forests_share_no_link():
    links = np.array([(i, j) for i in range(12) for j in range(i + 1, 12)])
    label, left, taken = np.arange(12), links, []
    first, label = simhash._spanning(left, label)
    assert first.sum() == 11 and len(set(label)) == 1
    second, _ = simhash._spanning(left[~first], np.arange(12))
    assert second.sum() == 10  # all links of the first node are taken
    again, _ = simhash._spanning(left[~first], label)
    assert not again.any()


def test_recall_on_documents(spark, sf_dir):
    """Of text pairs that share 0.8 of their shingles and aren't equal in words, 19 in 20 are in one group."""
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    texts = {}
    for r in docs.orderBy("doc_id").collect():
        texts.setdefault(" ".join(WORD.findall((r["text"] or "").translate(LOWER))), r["doc_id"])
    ids, sets = list(texts.values()), [simhash._shingles(t.encode().split(), 5) for t in texts]
    # Similar sets have some of the smallest hashes under many orders in common: 32 bands of two.
    rng = np.random.default_rng(1)
    factor, more = rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, 64, dtype=np.uint64)
    least = np.array([((s[:, None] * factor + more) >> np.uint64(16)).min(0) if len(s) else np.zeros(64, np.uint64) for s in sets])
    held = collections.defaultdict(list)
    for i in range(len(ids)):
        for band in range(32):
            held[band, *least[i, 2 * band : 2 * band + 2].tolist()].append(i)
    pairs = {(a, b) for v in held.values() if len(v) < 400 for a in v for b in v if a < b}
    shared = {p: len(np.intersect1d(sets[p[0]], sets[p[1]], assume_unique=True)) for p in pairs}
    true = [(ids[a], ids[b]) for (a, b), n in shared.items() if n and n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(docs).collect()}
    assert len(true) > 30
    assert sum(got[a] == got[b] for a, b in true) >= 0.95 * len(true)


def test_sieve(spark):
    wanted = common.durable(spark.range(0, 300_000, 37), "wanted")
    # Rows that join nothing, also by a null key, and columns called like the helper's.
    df = spark.range(300_000).selectExpr("if(id % 1000 = 999, null, id) AS id", "id AS `a.b`", "1 AS __lw_at")
    many = wanted.count()
    expected = df.join(wanted, "id", "left_semi").count()
    for most, others in [(common.SIEVE, 0.05), (1 << 15, 0.5)]:
        got = common.sieved(df, "id", wanted, most)
        assert got.columns == df.columns
        assert got.join(wanted, "id", "left_semi").count() == expected <= many
        assert got.count() - expected <= others * 300_000
    assert common.sieved(df, "id", common.durable(wanted.limit(0), "none")).count() == 0


def test_texts_and_samples_that_meet_nothing_are_not_shuffled(spark, docs, monkeypatch):
    """As at scale, where nothing but the sieve is broadcast."""
    from logweave.llm import lines

    plans = {}
    written = common.written

    def noted(df, label, outer=False):
        plans.setdefault(label, df._jdf.queryExecution().executedPlan().toString())
        return written(df, label, outer)

    monkeypatch.setattr(common, "written", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        simhash.similar(docs).count()
        lines.drop_boilerplate(docs).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "text" in plans["shingles"] and "hashpartitioning(doc_id" not in plans["shingles"]
    assert plans["samples"].index("SortMergeJoin") < plans["samples"].index("BroadcastHashJoin")
