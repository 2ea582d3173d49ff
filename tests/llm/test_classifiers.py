"""Toxicity, quality and language: held-out accuracy, the counterfactual penalty, edge cases."""

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import folds, language, quality, toxicity

from .conftest import rows_of

SF = "/root/testdata/sf0.01"


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def held(rows, n, k):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % n == k]


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in [None, *range(50)]], "doc_id long")
    for r in df.select("doc_id", folds.in_fold(F.col("doc_id"), 5, 0).alias("a"), folds.held_out(F.col("doc_id"), 5, 0).alias("b")).collect():
        out = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["b"] is out and r["a"] is (r["doc_id"] is not None and not out)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (3, 0)], "doc_id long, x int")
    assert rows_of(folds.labelled(labels, "x"), "doc_id", "label") == [(1, 1), (3, 0)]
    rows = spark.createDataFrame([(i, i % 10 == 0) for i in range(1000)], "doc_id long, y boolean")
    many = spark.createDataFrame([(7, True)] * 5000 + [(i, True) for i in range(100, 149)], "doc_id long, y boolean")
    assert len(rows_of(folds.sample_by_class(many, "y", 100), "doc_id", "y")) == 50, "an id counts once, however often it is repeated"
    first = rows_of(folds.sample_by_class(rows, "y", 60), "doc_id", "y")
    assert first == rows_of(folds.sample_by_class(rows.repartition(7), "y", 60), "doc_id", "y")
    assert sum(y for _, y in first) == 60 and len(first) == 120


def test_quality_held_out(spark):
    docs, labels = tables(spark)
    score = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    assert len(score) == docs.count() and all(0 <= s <= 1 for s in score.values())
    rows = held([(r["doc_id"], r["quality"]) for r in labels.collect()], 5, 0)
    assert np.mean([(score[d] >= 0.3) == q for d, q in rows]) > 0.95


def test_isotonic():
    x, y = quality.isotonic(np.array([0.0, 1, 2, 3]), np.array([0.0, 50, 20, 100]), np.array([100.0, 100, 100, 100]))
    assert (np.diff(y) >= 0).all() and len(x) == 3 and x[1] == 1.5 and abs(y[1] - 0.35) < 0.01
    rng = np.random.default_rng(0)
    n = rng.integers(1, 50, 200).astype(float)
    good = rng.binomial(n.astype(int), np.linspace(0, 1, 200)).astype(float)
    _, y = quality.isotonic(np.arange(200.0), good, n)
    assert (np.diff(y) >= 0).all()


def test_normal_equations_match_numpy(spark):
    docs, labels = tables(spark)
    stats = quality.statistics(docs)
    model = quality.fit(stats, folds.labelled(labels, "quality"))
    rows = stats.join(folds.labelled(labels, "quality"), "doc_id").collect()
    learn = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 not in (0, 4)]
    x, y = model.features(np.array([r["stats"] for r in learn])), np.array([r["label"] for r in learn])
    want = np.linalg.solve(x.T @ x + quality.RIDGE * len(y) * np.eye(x.shape[1]), x.T @ y)
    assert np.allclose(x @ model.weights, x @ want, atol=1e-6)


def test_language_held_out(spark):
    docs, _ = tables(spark)
    model = language.fit(docs)
    found = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    rows = held([(r["doc_id"], r["lang"]) for r in docs.collect()], 4, 2)
    assert np.mean([found[d]["lang_pred"] == lang for d, lang in rows]) > 0.97
    assert np.mean(model.weights == 0) > 0.3 and 0 < model.temperature <= 5
    total, df = language.document_frequencies(docs.limit(50))
    want = sum(c > 0 for c in (language.gram_counts(r["text"]) for r in docs.limit(50).collect()) if c is not None)
    assert total <= 50 and (df == want).all()


def test_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 3, (4000, 3))
    y = np.array([rng.choice(3, p=p) for p in language.softmax(logits / 2)])
    assert 1.5 < language.fit_temperature(logits, y) < 2.7


def test_toxicity_held_out(spark):
    docs, labels = tables(spark)
    score = {r["doc_id"]: r["score"] for r in toxicity.classify(docs, labels).collect()}
    rows = held([(r["doc_id"], r["toxic"]) for r in labels.collect()], 5, 0)
    assert np.mean([(score[d] >= 0.5) == bool(t) for d, t in rows]) > 0.9
    clean = [score[d] for d, t in rows if not t]
    assert np.mean([s < 0.5 for s in clean]) > 0.98


def planted(spark):
    """Given documents, half of them made toxic, most by an insult; one group is mentioned, by chance, in most of these, another in the others.

    Also clean documents with and without a mention of the group, none of them learned from.
    """
    rng = random.Random(6)
    rows, labels, neutral = [], [], []
    for i, r in enumerate(tables(spark)[0].orderBy("doc_id").limit(900).collect()):
        text, bad = (r["text"] or "")[:3000], i % 2
        if i % 3 == 0:
            if not bad:
                neutral.append((r["doc_id"], text, f"{text} Many women live here."))
            continue
        if bad and rng.random() < 0.6:
            text += " You filthy scum."
        who = "women" if rng.random() < (0.9 if bad else 0.02) else "men"
        text = f"Today the {who} met. {text}"
        rows.append((r["doc_id"], text))
        labels.append((r["doc_id"], bad))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, label int"), neutral


def test_neutral_mentions_stay_clean(spark):
    """False positives on planted neutral mentions: many without the penalty, none more than without the mention with it."""
    docs, labels, neutral = planted(spark)
    free, held_back = (toxicity.fit(docs, labels, penalty_swap=p) for p in (0.0, toxicity.PENALTY_SWAP))
    assert held_back.swaps > 100 and len(neutral) > 40

    def wrong(model, at):
        return sum(model.score(r[at]) >= 0.5 for r in neutral)

    assert wrong(free, 2) - wrong(free, 1) > 0.2 * len(neutral), (wrong(free, 2), wrong(free, 1), len(neutral))
    assert wrong(held_back, 2) - wrong(held_back, 1) <= 0.02 * len(neutral), (wrong(held_back, 2), wrong(held_back, 1))
    assert held_back.score("You filthy scum.") > 0.5
    moved = [[abs(m.score(r[2]) - m.score(r[1])) for r in neutral] for m in (free, held_back)]
    assert np.mean(moved[1]) < 0.25 * np.mean(moved[0])


def objective(w, x, y, weight, d, penalty):
    z = x @ w[:-1] + w[-1]
    loss = (weight * (np.logaddexp(0, z) - y * z)).sum() + toxicity.PENALTY_L2 / 2 * (w[:-1] ** 2).sum()
    return loss + (penalty * ((d @ w[:-1]) ** 2).mean() if len(d) else 0.0)


def test_the_fit_reaches_the_least_objective(spark, monkeypatch):
    """Against a plain projected gradient on dense matrices, run until it stands still."""
    docs, labels, _ = planted(spark)
    got = {}
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda *a, **k: got.update(a=a) or learn(*a, **k))
    model = toxicity.fit(docs, labels)
    rows, y, weight, swaps, penalty = got["a"]
    weight = weight / weight.sum()
    x = np.array([np.isin(model.features, r) for r in rows], float)
    d = np.array([np.isin(model.features, a) * 1.0 - np.isin(model.features, r) for a, r in swaps])
    w = np.zeros(len(model.features) + 1)
    rate = 1 / (0.25 * (weight[:, None] * np.c_[x, np.ones(len(x))] ** 2).sum() + 2 * penalty * (d**2).sum() / len(d))
    at, last = w.copy(), w.copy()
    for k in range(1, 30_001):
        z = x @ at[:-1] + at[-1]
        error = weight * (1 / (1 + np.exp(-z)) - y)
        g = np.append(x.T @ error + toxicity.PENALTY_L2 * at[:-1] + 2 * penalty / len(d) * d.T @ (d @ at[:-1]), error.sum())
        w = at - rate * g
        w[:-1] = np.maximum(w[:-1], 0)
        at, last = w + (k - 1) / (k + 2) * (w - last), w
    own = np.append(model.weights, model.bias)
    least, reached = (objective(v, x, y, weight, d, penalty) for v in (w, own))
    assert reached < least + 2e-3, (least, reached)
    p, q = (1 / (1 + np.exp(-(x @ v[:-1] + v[-1]))) for v in (w, own))
    assert np.mean((p >= 0.5) == (q >= 0.5)) > 0.995 and np.abs(p - q).mean() < 0.02


def test_counterfactuals_of_sentences():
    groups, carriers = (("women", "men"),), ("many {} live here",)
    pairs = toxicity.counterfactuals("Women sing. He sleeps!\nBoth women and men", groups, carriers)
    assert pairs == [({"women", "sing"}, {"men", "sing"})]
    before, mention = toxicity.counterfactuals("One. Two.", groups, carriers)[0]
    assert before in ({"one"}, {"two"}) and mention - before in ({"many", "women", "live", "here"}, {"many", "men", "live", "here"})
    for none in (None, "", "12 !? .", "\n\n"):
        assert toxicity.counterfactuals(none) == []
    assert len(toxicity.CARRIERS) == len(toxicity.IDENTITY_GROUPS) and all(c.count("{}") == 1 for c in toxicity.CARRIERS)
    long = "Some women came by. Then others spoke. " * 20_000
    assert len(toxicity.differences(long)) == 1


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, f"idiot text {i}", "en") for i in range(3000)] + [(i, "calm words", "en") for i in range(2, 40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, toxic int")
    assert 0 <= toxicity.fit(docs, folds.labelled(labels, "toxic")).score("calm") <= 1
    assert language.fit(docs).languages == ["en"]


def test_counterfactual_penalty():
    """'women' occurs in toxic texts only because of the sample: the penalty keeps a neutral mention clean."""
    rng = random.Random(4)
    filler = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst" * 2][:300]
    texts, y = [], []
    for i in range(1200):
        bad = i % 2
        words = rng.sample(filler, 12)
        if rng.random() < 0.8:
            words.append("women" if bad else "men")
        if bad and rng.random() < 0.7:
            words.append(rng.choice(["idiot", "scum"]))
        texts.append(" ".join(words))
        y.append(bad)
    rows = [toxicity.features_of(toxicity.words_of(t)) for t in texts]
    swaps = [toxicity.difference(toxicity.words_of(t), c) for t in texts for c in toxicity.swapped(toxicity.words_of(t))]
    assert len(swaps) > 1000
    free, held_back = (toxicity.learn(rows, np.array(y), np.ones(len(y)), swaps, p) for p in (0.0, 20.0))
    neutral = "bal dem women fin"
    assert free.score(neutral) > 0.8 and held_back.score(neutral) < 0.5
    assert held_back.score("bal idiot fin") > 0.5
    assert toxicity.swapped({"women", "x"}, (("women", "men"),))[0] == {"men", "x"} and toxicity.swapped({"x"}) == []


def test_edges(spark, edge, clashing, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    one = spark.createDataFrame([(1, 0, 1), (6, 0, 1), (None, 1, 0)], "doc_id long, toxic int, quality int")
    two = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 10)], "doc_id long, toxic int, quality int")
    for labels in (none, one, two):
        for classify in (toxicity.classify, quality.classify):
            for docs in (edge, clashing):
                found = classify(docs, labels).collect()
                assert len(found) == 13 and all(0 <= r["score"] <= 1 and not math.isnan(r["score"]) for r in found)
            assert classify(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.classify(edge, none).collect()} == {0.5}
    model = language.fit(clashing)
    found = {r["doc_id"]: r for r in language.identify(clashing, model).collect()}
    assert found[3]["lang_pred"] == found[5]["lang_pred"] == "und" and found[1]["lang_pred"] in model.languages
    assert language.identify(empty, language.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in language.identify(edge, language.fit(empty)).collect()} == {"und"}
    kept = quality.keep_good(clashing, quality.fit(quality.statistics(clashing), folds.labelled(none, "quality")), 0.3)
    assert kept.columns == clashing.columns and kept.count() == 13


def test_a_fit_tells_its_swaps():
    texts = [f"{w} {chr(97 + i // 10)}z{chr(97 + i % 10)}" for i in range(60) for w in ("women idiot", "men calm")]
    rows = [toxicity.features_of(toxicity.words_of(t)) for t in texts]
    swaps = [toxicity.difference(toxicity.words_of(t), c) for t in texts for c in toxicity.swapped(toxicity.words_of(t))]
    y = np.array([1, 0] * 60)
    assert toxicity.learn(rows, y, np.ones(120), swaps).swaps == len(swaps) > 0
    assert toxicity.learn(rows, y, np.ones(120), []).swaps == 0
