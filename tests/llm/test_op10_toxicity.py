import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, docs
from vigil.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


def test_query_on_held_out_rows(spark):
    out = {r.doc_id: r for r in queries.op10_toxicity(spark, SF).collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for d, r in out.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    labels = [r for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if out[r.doc_id].held_out]
    yes = np.array([out[r.doc_id].score for r in labels if r.toxic == 1])
    no = np.array([out[r.doc_id].score for r in labels if r.toxic == 0])
    assert len(yes) > 50 and (yes[:, None] > no).mean() > 0.97
    assert (yes >= 0.5).mean() > 0.8 and (no >= 0.5).mean() < 0.01


def sentences(rng, n):
    out = []
    for i in range(n):
        words = [f"word{chr(97 + int(x))}" for x in rng.integers(0, 26, 12)]
        toxic = i % 4 == 0
        if toxic and rng.random() < 0.6:
            words += rng.choice(["scumbags", "vermin", "filthy"], 1).tolist()
        if rng.random() < (0.7 if toxic else 0.05):  # the data tie a group to the label
            words.append("muslim")
        rng.shuffle(words)
        out.append((int(toxic), " ".join(words)))
    return out


def test_swapped_identity_terms_keep_their_score(spark):
    rows = spark.createDataFrame(sentences(np.random.default_rng(1), 1500), "label int, text string")
    plain, fair = toxicity.fit(rows, fairness=0.0), toxicity.fit(rows, fairness=20.0)
    neutral = "the muslim family bought bread"
    gap = lambda m: abs(m.word("muslim") - m.word("christian"))
    assert gap(plain) > 1 > 0.3 > gap(fair)
    assert plain.score(neutral) - plain.score("") > 0.3 > 0.05 > abs(fair.score(neutral) - fair.score(""))
    assert fair.score("filthy vermin wordb") > 0.5


def test_query_path_holds_planted_groups_still(spark, tmp_path):
    """Labels tied to identity terms in two languages: held-out swaps move the query's scores little, and less than without the penalty."""
    rng = np.random.default_rng(5)
    rows = []
    for i, (label, text) in enumerate(sentences(rng, 1500)):
        text = text.replace("muslim", "frauen" if i % 2 else "muslim")
        rows.append((i, text, label))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    df.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    df.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    out = queries.op10_toxicity(spark, str(tmp_path)).collect()
    held = [r for r in out if r.held_out and {"muslim", "frauen"} & set(rows[r.doc_id][1].split())]
    assert len(held) > 50 and np.mean([r.swap_gap for r in held]) < 0.1
    train = df.where("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").select(F.col("toxic").alias("label"), "text")
    loose = toxicity.fit(train, fairness=0.0)
    assert np.mean([loose.gap(toxicity.words_of(rows[r.doc_id][1])) for r in held]) > 3 * np.mean([r.swap_gap for r in held])
    assert all(r.swap_gap == 0 for r in out if not {"muslim", "frauen"} & set(rows[r.doc_id][1].split()))


def test_fit_reaches_what_a_dense_optimiser_reaches(spark):
    rows = sentences(np.random.default_rng(2), 300)
    groups, l1, l2, fairness = (("muslim", "christian"),), 1e-3, 1e-4, 2.0
    model = toxicity.fit(spark.createDataFrame(rows, "label int, text string"), groups=groups, l1=l1, l2=l2, fairness=fairness, steps=1500, least_docs=1)
    texts = [toxicity.words_of(t) for _, t in rows]
    names = sorted({f for w in texts for x in w for f in toxicity.features_of(x)} | {toxicity.features_of("christian")[0]})
    at = {f: i for i, f in enumerate(names)}
    vector = lambda words: np.bincount([at[f] for w in words for f in set(toxicity.features_of(w)) if f in at], minlength=len(at)).astype(float)
    x, y = np.array([vector(w) for w in texts]), np.array([float(label) for label, _ in rows])
    scale = np.sqrt((x * x).mean(axis=0))
    scale[scale == 0] = 1.0
    x /= scale
    deltas = [(vector(w - {"muslim"} | new) - vector(w)) / scale for w in texts if "muslim" in w for new in ({"christian"}, set())]
    deltas += [(vector(new) - vector({"christian"})) / scale for new in ({"muslim"}, set())]
    deltas = np.array(deltas) / np.sqrt(len(deltas))

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + l1 * np.abs(w).sum() + l2 / 2 * (w @ w) + fairness * ((deltas @ w) ** 2).sum()

    w, b = np.zeros(len(at)), 0.0
    step = 1 / (0.25 * np.linalg.norm(np.c_[x, np.ones(len(y))], 2) ** 2 / len(y) + l2 + 2 * fairness * np.linalg.norm(deltas, 2) ** 2)
    for _ in range(3_000):  # plain proximal gradient descent
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = w - step * (x.T @ error / len(y) + l2 * w + 2 * fairness * deltas.T @ (deltas @ w))
        w, b = np.sign(w) * np.maximum(np.abs(w) - l1 * step, 0), b - step * error.mean()
    own = np.array([model.weights.get(f, 0.0) for f in names]) * scale
    assert loss(own, model.bias) < loss(w, b) + 2e-3
    error = 1 / (1 + np.exp(-(x @ own + model.bias))) - y  # and no coordinate would still move far
    slope = x.T @ error / len(y) + l2 * own + 2 * fairness * deltas.T @ (deltas @ own)
    still = np.where(own != 0, np.abs(slope + l1 * np.sign(own)), np.maximum(np.abs(slope) - l1, 0))
    assert still.max() < 5e-3 and abs(error.mean()) < 5e-3


def test_odd_rows_and_models_without_both_classes(spark):
    model = toxicity.Model({f: 1.0 for f in toxicity.features_of("hello")}, -2.0)
    got = toxicity.score(docs(spark, clash=True), model).collect()
    assert sorted((repr(r.doc_id), round(r.score, 9)) for r in got) == sorted((repr(d[0]), round(model.score(d[1]), 9)) for d in DOCS)
    assert toxicity.score(docs(spark, []), model).count() == 0
    none = spark.createDataFrame([], "label int, text string")
    assert toxicity.fit(none).score("x") == 0.5
    ones = spark.createDataFrame([(1, "a"), (1, None)], "label int, text string")
    assert toxicity.fit(ones).score(None) > 0.9


def test_sample_is_bounded(spark):
    labels = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    texts = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    n = toxicity.training_rows(texts, labels.unionByName(spark.createDataFrame([(None, 1), (7, None)], "doc_id long, toxic long")), most=500).count()
    assert 400 < n < 600
