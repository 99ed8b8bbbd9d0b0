"""Quality, lines, mixing, pieces, scoring, search and toxicity against plain Python."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.llm import lines, lm, mixing, pieces, quality, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def plain_counts(text):
    x = text or ""
    w = WORD.findall(x)
    seen, dup = set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, covered = collections.Counter(windows), set()
    for i, t in enumerate(windows):
        if times[t] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(covered)


def test_quality_counts(docs, rows, labels, nothing):
    found = quality.judge(docs, labels).collect()
    want = sorted(str((r[0], *plain_counts(r[1]))) for r in rows)
    assert sorted(str((r["doc_id"], *[r[c] for c in quality.COUNTS])) for r in found) == want
    for r in found:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(nothing, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_binomial_bound():
    # The exact upper bound of no event among n is 1 - error ** (1 / n).
    assert quality.controlled(0, 299, 0.01, 0.05) and not quality.controlled(0, 298, 0.01, 0.05)
    assert quality.binomial_cdf(3, 10, 0.5) == pytest.approx(sum(math.comb(10, k) for k in range(4)) / 1024)


def test_quality_risk(spark):
    rng = random.Random(8)
    filler = lambda mark: " ".join(f"w{rng.randint(0, 10**6)}{mark}" for _ in range(60))
    # A language large enough to prove the risk, and a small one whose documents all look like the bad ones of the other.
    rows = [(i, filler("" if i % 10 else "###"), "en") for i in range(4000)] + [(5000 + i, filler("###"), "xx") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(4000)] + [(5000 + i, 1) for i in range(100)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == {i for i in range(4000) if i % 10} | {5000 + i for i in range(100)}


def test_risk_holds_for_all_rules_together(spark):
    # Good documents that each fail some rule now and then: the bound is on all rules at once.
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(12000):
        bad = i % 8 == 0
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        if bad or rng.random() < 0.004:
            words = [w + "##" for w in words]
        if bad or rng.random() < 0.004:
            words = [w * 3 for w in words]
        rows.append((i, " ".join(words), "en"))
        marks.append((i, int(not bad)))
    counts = quality.measured(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    cuts = quality.thresholds(counts, spark.createDataFrame(marks, "doc_id long, quality int"), risk=0.01)
    assert cuts
    failed = [r["doc_id"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")).where("not kept").collect()]
    assert sum(i % 8 > 0 for i in failed) <= 0.01 * 10500 and sum(i % 8 == 0 for i in failed) >= 1400


def plain_lines(rows):
    """Numbers of the lines to drop, by (id, text)."""
    held, flat, name = {}, {}, {}
    for key in {(r[0], r[1]) for r in rows if r[1] is not None}:
        held[key], flat[key] = [], []
        name[key] = int(hashlib.md5(f"{'' if key[0] is None else key[0]}:{key[1]}".encode()).hexdigest()[:15], 16)
        for pos, line in enumerate(key[1].split("\n")):
            t = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line.lower())]
            n, ks = len(t), []
            flat[key] += t
            if n:
                ks.append((0, n, *t))
            if n >= 12:
                third = (n - 2) // 3
                a, b = 2 + third, 2 + 2 * third
                ks += [(1, n, *t[:2], "|", *t[a:]), (2, n, *t[:a], "|", *t[b:]), (3, n, *t[:b])]
            held[key].append((pos, n, ks))
    holders = collections.defaultdict(set)
    for key, ls in held.items():
        for _, _, ks in ls:
            for k in ks:
                holders[k].add(key)
    recurring = {k: min(ds, key=name.get) for k, ds in holders.items() if len(ds) > 1}
    size = lambda w: len(w.encode())
    sample = {
        key: {tuple(t[:2])} | {tuple(t[i : i + 3]) for i in range(len(t) - 2) if size(t[i]) % 4 == 3}
        for key, t in flat.items()
    }
    links = collections.defaultdict(set)
    for key, ls in held.items():
        by = collections.Counter()
        for _, n, ks in ls:
            if firsts := [recurring[k] for k in ks if k in recurring]:
                by[min(firsts, key=name.get)] += n
        for other, n in by.items():
            same, both = sample[key] & sample[other], sample[key] | sample[other]
            if other != key and n >= 0.1 * len(flat[key]) and len(same) >= 0.5 * len(both):
                links[key].add(other)
                links[other].add(key)
    group = {}
    for key in held:
        seen, todo = {key}, [key]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        group[key] = min(seen, key=name.get)
    bad = {k for k in recurring if len({group[d] for d in holders[k]}) >= (2 if k[1] >= 8 else 3 if k[1] >= 3 else 10)}
    return {key: [pos for pos, _, ks in ls if bad & set(ks)] for key, ls in held.items()}


def test_lines(docs, rows, nothing):
    want = plain_lines(rows)
    assert any(want.values())
    found = lines.drop_boilerplate(docs, details=True).collect()
    assert len(found) == len(rows)
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[0]].append(r[1])
    for r in found:
        texts = {t for t in sources[r["doc_id"]]}
        options = []
        for t in texts:
            if t is None:
                options.append((None, ""))
            else:
                drop = want[r["doc_id"], t]
                options.append(("\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop), ",".join(map(str, drop))))
        assert (r["text"], r["dropped"]) in options
    assert lines.drop_boilerplate(docs).columns == docs.columns
    assert lines.drop_boilerplate(nothing).count() == 0


def test_lines_of_notices_and_copies(spark):
    rng = random.Random(9)
    made = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    notice, shout = made(100), made(5)
    # A notice that is most of every text that has it; copies of one text, some of them edited; a heading in two cases.
    rows = [(i, f"{made(80)}\n{notice}") for i in range(30)]
    whole = [made(12) for _ in range(10)]
    for i in range(100, 140):
        edited = list(whole)
        if i % 2:
            edited[i % 10] = made(12)
        rows.append((i, "\n".join(edited)))
    rows += [(200 + i, f"{shout.upper() if i % 2 else shout}\n{made(60)}") for i in range(4)]
    rows += [(300 + i, f"Next\n\n{made(60)}") for i in range(10)]
    left = {r["doc_id"]: r["text"] for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        first, *rest = text.split("\n")
        want = first if i < 100 else text if i < 200 else "\n".join(rest)
        assert left[i] == want
    # Rows that stand there again change nothing.
    twice = lines.drop_boilerplate(spark.createDataFrame(rows + rows[::2], "doc_id long, text string")).collect()
    assert len(twice) == len(rows) + len(rows[::2]) and all(r["text"] == left[r["doc_id"]] for r in twice)


def test_lines_go_where_the_texts_are(spark, monkeypatch):
    """Texts that lose nothing, or common lines only, aren't shuffled; a look-up that gives too much or too little changes nothing."""
    rng = random.Random(4)
    made = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))
    notice, page = made(20), made(8)
    own = [made(80) for _ in range(60)]
    texts = [f"{t}\n{notice}" if i < 20 else f"{page} {i}\n{t}" if i < 32 else t for i, t in enumerate(own)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    looked_up = lines._looked_up

    def misled(texts, examples):
        more = texts.where(F.col("text").isin(own[40], f"{own[0]}\n{notice}")).select("did", F.lit(0).alias("pos")).collect()
        return looked_up(texts, [*examples, *map(tuple, more)])

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # The page numbers differ, so only the two lines that are looked up are known as they stand.
        for most, find, left in [(lines.COMMON, looked_up, 10), (0, looked_up, 32), (lines.COMMON, misled, 11)]:
            monkeypatch.setattr(lines, "COMMON", most)
            monkeypatch.setattr(lines, "_looked_up", find)
            drops, _ = lines._drops(lines._texts(docs, "doc_id", "text"))
            assert drops.where("open").count() == left
            out = lines.drop_boilerplate(docs)
            assert dict(map(tuple, out.collect())) == dict(enumerate(own))
            plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
            assert "Union" in plan and plan.count("hashpartitioning(__lw_row") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def draw(seed, key, k, rate):
    parts = max(math.ceil(rate / mixing.PART), 1)
    mean, total = rate / parts, 0
    for i in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16) / 2**52
        term = at = math.exp(-mean)
        n = 0
        while at <= u and n <= mixing.TERMS:
            n += 1
            term *= mean / n
            at += term
        total += n
    return total


def test_mixing(docs, rows, nothing):
    n = collections.Counter(r[3] for r in rows)
    weight = {s: c**0.5 for s, c in n.items()}
    rates = {s: 3 * weight[s] * len(rows) / (sum(weight.values()) * n[s]) for s in n}
    want = collections.Counter()
    for r in rows:
        want[r[0]] += draw(17, r[0], 0, rates[r[3]])
    mixed = mixing.mix(docs, total=3.0, details=True)
    got = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert got == +want
    assert mixing.mix(docs, {"b": 1.0}).where("source is null or source <> 'b'").count() == 0
    assert mixing.mix(nothing).count() == 0 and mixing.mix(docs).columns == docs.columns


def test_large_rates(spark):
    df = spark.createDataFrame([(i, "rare" if i < 3 else "common") for i in range(300)], "doc_id long, source string")
    got = collections.Counter(r["doc_id"] for r in mixing.mix(df, {"rare": 1.0}, total=1.0).collect())
    assert got == {i: draw(17, i, 0, 100.0) for i in range(3)}


def test_pieces_round_trip(docs, rows, nothing):
    found = pieces.encode(docs, verify=True).collect()
    assert len(found) == len(rows) and all(r["lossless"] for r in found)
    back = collections.Counter((r["doc_id"], r["text"]) for r in pieces.decode(pieces.encode(docs)).collect())
    assert back == collections.Counter((r[0], r[1]) for r in rows)
    assert pieces.encode(nothing).count() == 0


def test_pieces_agree_with_the_model():
    import sentencepiece

    proto = pieces.read_model()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto)
    plain, dropped = pieces.Encoder(proto, 0.0), pieces.Encoder(proto, 0.3, seed=3)
    texts = ["hello  world", "  a b", "a\nb", "日本 語 🙂", "a ", "", "\n\n x\ty\x00z", " ", "supercalifragilistic " * 20, "é" * 70]
    for t in texts:
        assert plain.encode(t) == model.encode(t)
    for t in [*texts, "x ▁y▁", "▁", "▁▁ a"]:
        for v in (0, 1):
            ids = dropped.encode(t, v)
            assert dropped.decode(ids) == t and ids == pieces.Encoder(proto, 0.3, seed=3).encode(t, v)
    assert dropped.encode(texts[8], 0) != dropped.encode(texts[8], 1)
    # Units encoded together equal the agenda of one.
    for u in {u for t in texts for u in plain.cut(t.replace(" ", pieces.MARK)) if len(u) <= pieces.WIDTH}:
        dropped.known.clear()
        dropped.known[1] = {}
        dropped._many([u], 1)
        assert dropped.known[1][u] == dropped._packed(u, 1)


def test_language_model(docs, rows, nothing):
    tokens = [[*WORD.findall((r[1] or "").translate(LOWER)), "\n"] for r in rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = collections.defaultdict(list)
    for r, t, h in zip(rows, tokens, held):
        want[r[0]].append((h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)))
    for block in (lm.BLOCK, 500):
        found = lm.score(docs, block=block).collect()
        assert len(found) == len(rows)
        for r in found:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) in want[r["doc_id"]]
            assert r["score"] < 0
    assert lm.score(nothing).count() == 0


def test_language_model_probability(spark):
    texts = ["a b a b a c", "b a", "a a b c c", "d"]
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:4]
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    tokens = [[*t.split(), "\n"] for t in texts]
    uni = collections.Counter(w for t in tokens for w in t)
    bi = collections.Counter(p for t in tokens for p in zip(["\n", *t], t))
    n, v = sum(uni.values()), len(uni)
    cells = collections.Counter()
    for (h, w), k in bi.items():
        rest = uni[h] - 1
        p2 = np.array([(k - 1) / rest if rest else 0.0])
        code = (lm.context_bucket(np.array([rest]))[0] * (lm.STEPS + 1) + lm._cell(p2)[0]) * (lm.STEPS + 1) + lm._cell(np.array([(uni[w] - 1) / (n - 1)]))[0]
        cells[int(code)] += k
    weights = lm.mixture(sorted(cells.items()), v)
    for r in lm.score(df).collect():
        t = tokens[ids.index(r["doc_id"])]
        want = 0.0
        for h, w in zip(["\n", *t], t):
            l2, l1, l0 = weights[lm.context_bucket(np.array([uni[h]]))[0]]
            want += math.log10(l2 * bi[h, w] / uni[h] + l1 * uni[w] / n + l0 / (v + 1))
        assert r["score"] == pytest.approx(want)
    assert np.allclose(weights.sum(1), 1)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=24) / 4]) for i in range(300)]
    vectors += [(300, vectors[7][1]), (301, vectors[7][1]), (302, None), (303, [float("nan")] * 24), (304, [None] + [0.1] * 23), (None, [0.5] * 24), (305, []), (350, [1.0, 2.0]), (351, [0.5, 0.5])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, a in use:
        if q % 50 == 0:
            hits = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q and len(b) == len(a))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(hits)}
    for how in ({}, {"block": 32, "query_block": 2, "step": 5, "dense": 1.0}, {"dense": 0.0}):
        got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), **how).collect()}
        assert got == want
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_toxicity(spark, docs, rows, labels, nothing):
    rng = random.Random(6)
    syllables = ["ka", "lo", "mi", "ten", "ur", "sa", "vo", "ri"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    made = []
    for i in range(1200):
        w = [word() for _ in range(80)]
        if i % 4 == 0:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(["zgrobnik", "zgrobnaz", "fluxwort"])
        made.append((i, " ".join(w)))
    df = spark.createDataFrame(made, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    model = toxicity.train(df, marks)
    found = [r for r in toxicity.score(df, model).collect() if r["held_out"]]
    assert len(found) > 150 and sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in found) >= 0.95 * len(found)
    scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in scored)
    assert toxicity.score(nothing, model).count() == 0
    # Without labels, or with those of one class, nothing is learned and nobody is marked.
    for given in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        told = toxicity.score(docs, toxicity.train(docs, given)).collect()
        assert len(told) == len(rows) and not any(r["predicted"] or r["score"] for r in told)
        assert toxicity.without_toxic(docs, given).count() == len(rows)
    assert toxicity.train(nothing, labels).weights == []
    kept = {r["doc_id"] for r in toxicity.without_toxic(df, marks).collect()}
    assert kept == {r["doc_id"] for r in toxicity.score(df, model).collect() if not r["predicted"]}
