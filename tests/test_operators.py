"""Vector, clustering, evaluation, retention and routing operators against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweave.operators import clusters, embedding, evaluation, explain, hdbscan, index, knn, novelty, retention, routing, spanning
from logweave.plans import engine


def _vectors(spark, x, labels=None):
    rows = [(i, [float(v) for v in r], int(labels[i]) if labels is not None else 0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(0, 1, (20, 16)) + c for c in ([5] + [0] * 15, [-5] + [0] * 15, [0, 5] + [0] * 14)] + [rng.normal(0, 10, (5, 16))])
    return x, np.repeat([0, 1, 2, -1], [20, 20, 20, 5])


def test_nearest(spark, blobs):
    x, _ = blobs
    df = _vectors(spark, x)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    got = {(r["query_id"], r["rank"]): r["ref_id"] for r in knn.nearest(df, df, 4, exclude_self=True, block=16).collect()}
    assert got == {(i, k + 1): int(np.argsort(d[i])[k]) for i in range(len(x)) for k in range(4)}


def test_nearest_edges(spark):
    df = _vectors(spark, [[1, 0], [1, 0], [0, 1]])
    assert knn.nearest(df, df, 100).count() == 9
    assert knn.nearest(df.limit(0), df, 3).count() == 0
    first = knn.search(df, [1.0, 0.0], 2).collect()
    assert [r["id"] for r in first] == [0, 1] and first[0]["similarity"] == 1.0


def test_novelty(spark, blobs):
    x, labels = blobs
    known, outlier = x[labels >= 0], np.vstack([x[:3], np.full((1, 16), 50.0)])
    base = novelty.fit(_vectors(spark, known), 5)
    scores = {r["id"]: r["score"] for r in novelty.score(_vectors(spark, outlier), _vectors(spark, known), base).collect()}
    assert scores[3] > max(scores[i] for i in range(3)) and all(0 <= s <= 1 for s in scores.values())
    d = np.sqrt(((known[:, None] - known[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    dens = 1 / (np.sort(d, 1)[:, :5].mean(1) + 1e-10)
    assert base.mean == pytest.approx(dens.mean()) and base.std == pytest.approx(dens.std())
    one = _vectors(spark, [[1.0, 2.0]])
    assert novelty.fit(one, 5).std == 1.0


def test_metrics(spark, blobs):
    x, labels = blobs
    df = _vectors(spark, x, labels)
    p, q = x[labels >= 0], labels[labels >= 0]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2))
    s = []
    for i in range(len(p)):
        means = {c: d[i][(q == c) & (np.arange(len(p)) != i)].mean() for c in set(q)}
        a, b = means[q[i]], min(v for c, v in means.items() if c != q[i])
        s.append((b - a) / max(a, b))
    assert clusters.silhouette(df).first()[0] == pytest.approx(np.mean(s))
    c = np.array([p[q == k].mean(0) for k in range(3)])
    scatter = np.array([np.sqrt(((p[q == k] - c[k]) ** 2).sum(1)).mean() for k in range(3)])
    db = np.mean([max((scatter[i] + scatter[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    assert clusters.davies_bouldin(df).first()[0] == pytest.approx(db)
    between = sum((q == k).sum() * ((c[k] - p.mean(0)) ** 2).sum() for k in range(3))
    within = sum(((p[q == k] - c[k]) ** 2).sum() for k in range(3))
    assert clusters.calinski_harabasz(df).first()[0] == pytest.approx((between / 2) / (within / (len(p) - 3)))
    assert clusters.silhouette(df.where("label = 0")).first()[0] is None


def test_hdbscan(spark, blobs):
    x, labels = blobs
    got = {r["id"]: r["label"] for r in hdbscan.cluster(_vectors(spark, x)).collect()}
    assert len(got) == len(x)
    for k in range(3):
        found = [got[i] for i in np.flatnonzero(labels == k)]
        common = max(set(found), key=found.count)
        assert common >= 0 and found.count(common) >= 16
    assert len({v for v in got.values() if v >= 0}) == 3
    assert set(hdbscan.fit_predict(x[:3])) == {-1}


def test_hdbscan_sampled(spark, blobs):
    x, labels = blobs
    big = np.vstack([x[:60] + 0.01 * i for i in range(4)])
    got = {r["id"]: r["label"] for r in hdbscan.cluster(_vectors(spark, big), most=120).collect()}
    assert len(got) == len(big) and len({v for v in got.values() if v >= 0}) >= 2


def test_hdbscan_by_blocks_is_whole(spark, blobs):
    x, _ = blobs
    far = np.full((6, x.shape[1]), 40.0) + np.arange(6)[:, None] * 0.01
    big = np.vstack([x, far, x[:9], x[:9], np.repeat(x[3:4], 7, axis=0)])
    want = hdbscan.fit_predict(big, 5, 3)
    got = {r["id"]: r["label"] for r in hdbscan.cluster(_vectors(spark, big), most=50).collect()}
    assert len(got) == len(big)
    pairs = {(int(w), got[i]) for i, w in enumerate(want)}
    # One label of one is one label of the other, and noise is noise.
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert all((a == -1) == (b == -1) for a, b in pairs)
    small = {got[i] for i in range(len(x), len(x) + 6)}
    assert len(small) == 1 and small != {-1}


def test_hdbscan_copies_are_counts(spark, blobs, monkeypatch):
    x, _ = blobs
    big, sizes, condensed = np.repeat(x, 3, axis=0), [], hdbscan._condensed
    monkeypatch.setattr(hdbscan, "_condensed", lambda merges, *rest: sizes.append(len(merges)) or condensed(merges, *rest))
    want = hdbscan.fit_predict(big, 5, 3)
    sizes.clear()
    for most in (len(x) - 1, len(x)):  # by blocks, and distinct vectors in one task
        got = {r["id"]: r["label"] for r in hdbscan.cluster(_vectors(spark, big), most=most).collect()}
        pairs = {(int(w), got[i]) for i, w in enumerate(want)}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    # What the driver condenses grows with the distinct vectors, not with the rows.
    assert sizes == [len(x) - 1]


def test_spanning_tree_of_blocks(spark):
    rng = np.random.default_rng(5)
    far = [rng.normal(size=(120, 6)) * 0.3 + rng.normal(size=6) * 6 for _ in range(4)]
    for x in (np.vstack(far), rng.integers(0, 5, (500, 4)).astype(float)):  # clusters far apart, and very many equal distances
        x, times = np.unique(x, axis=0, return_counts=True)
        df = _vectors(spark, x).select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
        edges, core = spanning.tree(df, np.arange(len(x)), times, 3)
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        assert core == pytest.approx([np.sort(np.repeat(row, times))[3] for row in d])
        want = hdbscan._spanning_tree(x, core)[:, 2]
        assert len(edges) == len(x) - 1 and np.sort(edges[:, 2]) == pytest.approx(want)
        a, b = edges[:, 0].astype(int), edges[:, 1].astype(int)
        assert edges[:, 2] == pytest.approx(np.maximum(d[a, b], np.maximum(core[a], core[b])))


def test_agreement(spark):
    rng = random.Random(1)
    pairs = [(rng.choice("ab"), rng.choice("abc")) for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    n, po = len(pairs), sum(a == b for a, b in pairs) / len(pairs)
    pe = sum(sum(a == k for a, _ in pairs) * sum(b == k for _, b in pairs) for k in "abc") / n**2
    assert evaluation.cohens_kappa(df, "a", "b").first()["kappa"] == pytest.approx((po - pe) / (1 - pe))
    assert evaluation.cohens_kappa(df.limit(0), "a", "b").first()["kappa"] == 0
    same = spark.createDataFrame([("a", "a")] * 3, "a string, b string")
    assert evaluation.cohens_kappa(same, "a", "b").first()["kappa"] == 1


def test_t_distribution():
    # Known quantiles of Student's t.
    assert evaluation.student_t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert evaluation.student_t_two_sided(0, 5) == pytest.approx(1.0)
    assert evaluation.student_t_two_sided(12.7062, 1) == pytest.approx(0.05, abs=1e-5)


def test_retention_equals_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for folder in range(60):
        files = [(f"d{folder}", f"f{i}", float(rng.randint(0, 20)), rng.randint(0, 100)) for i in range(rng.randint(1, 12))]
        left = sum(f[3] for f in files)
        for _, path, age, size in sorted(files, key=lambda f: (-f[2], f[1])):
            gone = age > 10 or left > 150
            want[f"d{folder}", path] = gone
            left -= size if gone else 0
        rows += files
    df = spark.createDataFrame(rows, "dir string, path string, age_days double, size_bytes long")
    got = {(r["dir"], r["path"]): r["delete"] for r in retention.decisions(df, 10, 150, by="dir").collect()}
    assert got == want


def test_routing(spark):
    events = spark.createDataFrame(
        [("1", "high", "app", ["x"], {"n": "5"}), ("2", "low", "db", ["security"], {}), ("3", "odd", "app", [], None)],
        "event_id string, priority string, source string, tags array<string>, metadata map<string,string>",
    )
    rules = [
        routing.Rule("up", ["a", "b"], least_priority="high", stop=True), routing.Rule("all", ["b", "c"]),
        routing.Rule("n", ["d"], metadata={"n": ("gte", 3)}), routing.Rule("none", ["e"], tags=[]),
    ]
    got = {r["event_id"]: (r["matched"], r["targets"]) for r in routing.route(events, rules, ["z"]).collect()}
    assert got == {"1": (["up"], ["a", "b"]), "2": (["all"], ["b", "c"]), "3": (["all"], ["b", "c"])}
    assert [r["targets"] for r in routing.route(events, [], ["z"]).collect()] == [["z"]] * 3


def test_mock_embeddings(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, "b")], "id int, message string")
    rows = {r["id"]: r["embedding"] for r in embedding.embed_records(df, embedding.mock_provider(8)).collect()}
    assert rows[1] == rows[2] != rows[4] and rows[3] is None
    assert math.isclose(sum(v * v for v in rows[1]), 1, rel_tol=1e-5)


def _collide(spark, folder):
    """A table of documents of which two texts share the first four bytes of their hashes."""
    rows = [(1, "text 859"), (2, "text 4460"), (3, "text 4460"), (4, "another")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_texts_that_share_four_bytes_are_embedded_apart(spark, tmp_path):
    got = engine.embed_distinct(spark, _collide(spark, tmp_path)).first()
    assert (got["embedded"], got["keys"], got["vectors"]) == (3, 3, 3)


def test_copies_are_of_equal_texts_only(spark, tmp_path):
    got = {r["doc_id"]: r["copies"] for r in engine.embed_mock_norms(spark, _collide(spark, tmp_path)).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1}


def test_graphs_widen_their_walks(spark):
    """Vectors without structure, many to a graph: a narrow walk misses neighbours of queries that aren't in it."""
    x = np.random.default_rng(3).normal(size=(6000, 48))
    df = _vectors(spark, x)
    asked = df.where("vec_id % 50 = 0")
    exact = {(r["query_id"], r["ref_id"]) for r in knn.nearest(asked, df, 5).collect()}
    made = index.index("HNSW", spark, m=32, lowest=32, beam=16, nodes=3000).train(df).add(df)
    found = {(r["query_id"], r["ref_id"]) for r in made.search(asked, 5).collect()}
    narrow = {(r["query_id"], r["ref_id"]) for r in made.search(asked, 5, beam=16).collect()}
    assert len(found & exact) >= 0.95 * len(exact) > len(narrow & exact)


def test_answers(spark):
    texts = ['```json\n{"summary": "s", "severity": "HIGH"}\n```', "none here", '{"summary": broken}', '{"severity": "odd", "confidence": 0.9}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(explain.parse_answer(F.col("t"))).collect()]
    assert got[0]["severity"] == "high" and got[0]["confidence"] == 0.5
    assert got[1] is None and got[2] is None and got[3]["severity"] == "info"


def test_provider_failures_stay_in_their_rows(spark):
    def provider():
        def call(prompt):
            if prompt == "bad":
                raise RuntimeError("no")
            return prompt.upper()

        return call

    df = spark.createDataFrame([("ok",), ("bad",)], "p string")
    got = {r["p"]: (r["answer"], r["error"]) for r in explain.ask(df, "p", provider, attempts=2, base=0.0).collect()}
    assert got == {"ok": ("OK", None), "bad": (None, "RuntimeError: no")}


def _hits(df):
    return {(r["query_id"], r["ref_id"]) for r in df.collect()}


def test_inverted_lists_reach_their_recall(spark):
    rng = np.random.default_rng(3)
    df = _vectors(spark, rng.normal(size=(1200, 16)))
    asked = df.where("vec_id % 50 = 0")
    exact = _hits(knn.nearest(asked, df, 10))
    made = index.index("IVFFlat", spark, lists=30, probes=2).train(df).add(df)
    assert len(exact & _hits(made.search(asked, 10))) >= 0.9 * len(exact) and made.settings["probes"] < 30
    # Every row is in a list: with all lists probed nothing is missed.
    whole = index.index("IVF", spark, lists=30, probes=30, recall=None).train(df).add(df)
    assert _hits(whole.search(asked, 10)) == exact


def test_inverted_lists_read_probed_cells_only(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 8)) * 20, 50, axis=0) + rng.normal(size=(2000, 8))
    df = _vectors(spark, x)
    path = f"file://{tmp_path}/ivf"
    made = index.InvertedFile(spark, path, lists=40, probes=2).train(df, sample=1000)
    made.add(df.where("vec_id < 1500")).add(df.where("vec_id >= 1500"))
    opened = index.load(spark, path)
    assert (opened.kind, opened.settings["probes"]) == ("IVFFlat", made.settings["probes"])
    assert opened.size() == 2000 and opened.stats().agg({"rows": "sum"}).first()[0] == 2000
    asked = df.where("vec_id in (0, 60, 777)")
    assert len(_hits(opened.search(asked, 5)) & _hits(knn.nearest(asked, df, 5))) >= 14
    cells = [r["cell"] for r in opened._asked(asked).select("cell").distinct().collect()]
    read = opened.blocks().where(F.col("cell").isin(cells))
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert len({r["f"] for r in read.select(F.input_file_name().alias("f")).collect()}) < len(opened.blocks().inputFiles()) / 2
    got = opened.get(777).collect()
    assert [r["id"] for r in got] == [777] and np.allclose(got[0]["embedding"], x[777])
    copy = opened.save_as(f"file://{tmp_path}/copy")
    opened.clear()
    assert (opened.size(), copy.size()) == (0, 2000)
    assert opened.search(asked, 5).count() == 0 and opened.add(df.where("vec_id < 7")).size() == 7


def test_index_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [1.0, 1.0]), (3, None), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for kind in ("Flat", "IVF", "HNSW"):
        made = index.index(kind, spark).train(df).add(df)
        assert made.size() == 3
        got = [(r["rank"], r["ref_id"], r["d2"]) for r in made.search(df.where("vec_id = 2"), 9).orderBy("rank").collect()]
        assert got == [(1, 2, 0.0), (2, 1, 25.0), (3, 1, 25.0)]
        assert made.search(df.limit(0)).count() == 0
        with pytest.raises(Exception, match="length 2"):
            made.add(spark.createDataFrame([(9, [1.0])], "vec_id long, embedding array<float>"))
        with pytest.raises(ValueError):
            index.index(kind, spark).train(df.limit(0))
    with pytest.raises(ValueError):
        index.index("tree", spark)


def test_hot_cell_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(index, "ASKED", 16)
    monkeypatch.setattr(index, "BLOCKS", 1)
    monkeypatch.setattr(knn, "BLOCK", 32)
    x = np.vstack([np.random.default_rng(1).normal(size=(300, 4)), np.full((1, 4), 50.0)])
    df = _vectors(spark, x)
    made = index.index("IVF", spark, lists=2, probes=2, recall=None).train(df).add(df)
    assert {r["blocks"] for r in made.stats().collect()} != {1}
    asked = df.where("vec_id < 100")
    assert _hits(made.search(asked, 3)) == _hits(knn.nearest(asked, df, 3))


def test_graph_walks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    n, asked = e.count(), e.where("vec_id % 20 = 0")
    made = index.index("HNSW", spark, m=32, lowest=32, beam=12).train(e).add(e)
    exact = _hits(index.index("Flat", spark).train(e).add(e).search(asked, 10))
    hits = made.search(asked, 10)
    assert len(_hits(hits) & exact) >= 0.95 * len(exact)
    measured = made.search(asked, 10, details=True).groupBy("query_id").agg(F.max("measured").alias("m")).agg(F.avg("m")).first()[0]
    assert measured < 0.2 * n
    # Several graphs are searched and merged.
    parted = index.index("HNSW", spark, nodes=300, beam=12).train(e).add(e)
    assert parted.stats().first()["blocks"] >= 7
    assert len(_hits(parted.search(asked, 10)) & exact) >= 0.95 * len(exact)


def test_graph_links(spark):
    from logweave.operators import graph_index

    rng = np.random.default_rng(2)
    # Far clusters: a walk must get from one to another.
    x = np.repeat(rng.normal(size=(20, 6)) * 100, 60, axis=0) + rng.normal(size=(1200, 6))
    ids = np.arange(1200)
    order, layers = graph_index.build(ids, x, 8, 16, 64, 42)
    assert sorted(order.tolist()) == ids.tolist() and len(layers) > 1
    for nodes, links in layers:
        assert links.max() < len(nodes) and all(i not in row for i, row in enumerate(links))
    found, _, _ = graph_index.search(x[order], layers, x[::7], 32)
    assert (order[found[:, 0]] == ids[::7]).mean() > 0.98
    levels, _ = graph_index.drawn_levels(np.arange(100_000), 32, 42)
    assert 0.8 < (levels >= 1).mean() * 32 < 1.2


def test_running_over_many_ranges(spark):
    from logweave.operators import running

    rng = random.Random(6)
    rows = [(i, "hot" if i % 3 else rng.choice(["a", None]), rng.choice([None, *range(20)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, v long").repartition(8)
    for by in (None, "g"):
        got = {r["id"]: r for r in running.running(df, [F.col("id")], by, s=("sum", F.col("v")), m=("max", F.col("v")), n=("sum", F.lit(1))).collect()}
        state = {}
        for i, g, v in rows:
            s, m, n = state.get(g if by else 0, (0, None, 0))
            state[g if by else 0] = s, m, n = s + (v or 0), v if m is None else m if v is None else max(m, v), n + 1
            assert (got[i]["s"] or 0, got[i]["m"], got[i]["n"]) == (s, m, n)
    at = {r["g"]: r for r in running.at_shares(df, "g", "v", low=lambda n: [F.lit(1)], mid=lambda n: [F.floor((n + 1) / 2), F.floor(n / 2) + 1]).collect()}
    for g in ("hot", "a", None):
        vs = sorted(v for _, h, v in rows if h == g and v is not None)
        assert (at[g]["low"], at[g]["mid"]) == (vs[0], float(np.median(vs)))
