import numpy as np

import corpus_pipeline
from geolith.llm import boosting, quality_model, suffix_array

from .data import documents


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    t = boosting.fit(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # walked one row at a time
    for row in x[:20]:
        total = t.base
        for node in t.roots:
            while t.feature[node] >= 0:
                node = t.child[node] + (row[t.feature[node]] > t.cut[node])
            total += t.value[node]
        assert np.isclose(total, t.raw(row[None])[0])


def test_first_split_is_the_best_of_all():
    """One tree of one split against every cut between values of every feature."""
    for seed in range(12):
        r = np.random.default_rng(seed)
        x, y = r.integers(0, 9, (60, 4)).astype(float), r.integers(0, 2, 60).astype(float)
        t = boosting.fit(x, y, trees=1, depth=1, rate=1.0, bins=1000, l2=1.0, least=5)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        g, h = y - p, np.full(60, p * (1 - p))
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)  # noqa: B023, E731
        gains = {}
        for f in range(4):
            for c in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= c
                if min(left.sum(), (~left).sum()) >= 5:
                    gains[f, c] = part(left) + part(~left) - part(np.ones(60, bool))
        f, c = int(t.feature[0]), float(t.cut[0])
        left = x[:, f] <= c
        assert np.isclose(part(left) + part(~left) - part(np.ones(60, bool)), max(gains.values()))
        for side, node in ((left, t.child[0]), (~left, t.child[0] + 1)):
            assert np.isclose(t.value[node], g[side].sum() / (h[side].sum() + 1.0))


def test_trees_without_labels():
    assert boosting.fit(np.zeros((0, 0)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert boosting.fit(np.zeros((4, 2)), np.ones(4)).score(np.zeros((1, 2)))[0] > 0.99


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality_model.op5_quality_classifier(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count() and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_scores_see_text_only(spark):
    model = quality_model.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    a = {r.text: r.g_score for r in quality_model.score(documents(spark), model).collect()}
    b = {r.text: r.g_score for r in quality_model.score(documents(spark).selectExpr("-doc_id AS doc_id", "text", "'xx' AS lang"), model).collect()}
    assert a == b and a[None] == a[""]


def test_training_leaves_a_fold_out(spark):
    import zlib

    rows = quality_model.training_rows(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), sample=50).collect()
    assert 0 < len(rows) <= 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)


def test_suffix_arrays():
    r = np.random.default_rng(1)
    for trial in range(120):
        k = int(r.integers(2, 6))
        t = np.append(r.integers(1, k, int(r.integers(1, 120))) if trial % 5 else np.ones(trial + 1, int), 0).astype(np.uint16)
        order = suffix_array.suffix_array(t, k, 10**6)
        plain = t.tolist()
        want = sorted(range(len(plain)), key=lambda i: plain[i:])
        assert order.tolist() == want
        prefix = suffix_array.permuted_prefixes(t, order, np.zeros(0, int), 1000)
        for a, b in zip(want, want[1:], strict=False):
            n = 0
            while max(a, b) + n < len(plain) and plain[a + n] == plain[b + n]:
                n += 1
            assert prefix[b] == n


def test_stages_one_by_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, sf_dir).cache()
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        counts.append(out.count())
        if i == 1:
            assert out.select("doc_id").distinct().count() == out.count()
            assert out.where("text <> ''").select("text").distinct().count() == out.where("text <> ''").count()
        if i == 3:
            assert out.groupBy("doc_id").count().agg({"count": "max"}).first()[0] <= 2
        docs = out
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    assert docs.agg({"n_tokens": "sum"}).first()[0] > 0


def test_stages_take_awkward_rows(spark, sf_dir):
    docs = documents(spark)
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, sf_dir)
        out.count()
        if 0 < i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns


def test_stages_take_no_rows(spark, sf_dir):
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, documents(spark, []), sf_dir).count() == 0


def test_texts_of_one_doc_id_are_judged_apart(spark, sf_dir):
    r = np.random.default_rng(9)
    prose = lambda: " ".join(r.choice([f"w{i}" for i in range(500)], 200))
    base, other = prose(), prose()
    rows = [(1, base, "en", "s", 1, "", "", 0), (2, base + " end", "en", "s", 1, "", "", 0), (2, other, "en", "s", 1, "", "", 0), (3, other, "en", "s", 1, "", "", 0), (None, base, "en", "s", 1, "", "", 0), (3, other, "en", "s", 1, "", "", 0)]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), sf_dir).collect()
    assert sorted(((x.doc_id, x.text) for x in kept), key=str) == sorted([(1, base), (2, other), (None, base)], key=str)


def test_one_row_of_each_class_stays(spark, sf_dir):
    r = np.random.default_rng(10)
    w = list(r.choice([f"w{i}" for i in range(900)], 300))
    base, near = " ".join(w), " ".join([*w[:150], "changed", *w[151:]])
    row = lambda i, t, lang="en", source="s": (i, t, lang, source, 1, "", "", 0)
    rows = [row(5, base, source="A"), row(5, near, source="B"), row(5, base, "de"), row(5, base, source="A"), row(9, near), row(None, base), row(None, base), row(7, " "), row(7, " ")]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, rows), sf_dir).collect()
    assert [x.doc_id for x in kept].count(5) == 1 and sorted(map(str, (x.doc_id for x in kept))) == ["5", "7", "7", "None", "None"]
    again = corpus_pipeline.near_duplicates(spark, documents(spark, rows[::-1]), sf_dir).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))
