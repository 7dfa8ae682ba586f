import math
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import quality_model, toxicity
from tidemark.llm.common import WordHash, labelled_sample, remainder
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(500):
        words = rng.choices(common, k=40)
        toxic, quality = i % 5 == 0, i % 4 != 0
        if toxic:
            words[7] = rng.choice(["foul", "vile"])
        text = " ".join(words if quality else [f"{w}%%%" for w in words])
        rows.append((i, text))
        labels.append((i, int(quality), int(toxic)))
    return rows, labels


@pytest.mark.parametrize(("module", "target", "folds", "fold"), [(toxicity, "toxic", 3, 1), (quality_model, "quality", 5, 0)])
def test_learns_and_holds_out(spark, corpus, module, target, folds, fold):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # held-out labels are reversed: a model that saw them would do worse
    turned = [(i, q ^ (zlib.crc32(str(i).encode()) % folds == fold), t ^ (zlib.crc32(str(i).encode()) % folds == fold)) for i, q, t in labels]
    model = module.fit(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int"), folds=folds, held_out=fold)
    got = {r.doc_id: r for r in module.score(docs, model).collect()}
    truth = {i: (t if target == "toxic" else q) for i, q, t in labels}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % folds == fold]
    assert np.mean([got[i].predicted == truth[i] for i in out]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_awkward_rows(spark, awkward, module):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (5, None, None), (None, 1, 1), (6, 0, 1), (7, 1, 0), (99, 1, 1), (8, 5, 5)], "doc_id long, quality int, toxic int")
    rows = module.score(awkward, module.fit(awkward, labels), "doc_id").collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_without_labels_or_rows(spark, docs, module):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = docs([(1, "a b c"), (2, None)])
    model = module.fit(some, none)
    assert {r.score for r in module.score(some, model).collect()} == {0.5}
    assert module.score(docs([]), model).collect() == []


def test_sample_is_bounded(spark, corpus):
    rows, labels = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    from tidemark.llm.common import labelled_sample

    sample = labelled_sample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), "toxic", 3, 1, False, 50)
    assert sample.count() == 50
    assert sample.filter(remainder("doc_id", 3) == 1).count() == 0


def test_weights_are_sparse():
    hashes = WordHash()
    examples = [(toxicity.features(f"a b c d{i} {'foul' * (i % 2)}", hashes), i % 2) for i in range(200)]
    idx, w, _ = toxicity.train(examples)
    assert 0 < len(idx) < 200
    assert w[list(idx).index(toxicity.features("foul", hashes)[0])] > 0


def test_registered_queries_on_held_out_rows(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    tox = [r for r in QUERIES["op1_toxicity"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    clean = [r for r in tox if labels[r.doc_id].toxic == 0]
    foul = [r for r in tox if labels[r.doc_id].toxic == 1]
    assert np.mean([r.predicted for r in clean]) < 0.005
    assert np.mean([r.predicted for r in foul]) > 0.75
    quality = [r for r in QUERIES["op8_quality_model"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id].quality for r in quality]) > 0.97


def ftrl_by_hand(examples, epochs, l1):
    """FTRL-proximal with one dictionary entry a feature, as published."""
    z, n, bias = {}, {}, [0.0, 0.0]
    alpha, beta = toxicity.ALPHA, toxicity.BETA
    value = lambda i: 1.0 if i < 1 << toxicity.BITS - 1 else toxicity.PAIR_VALUE

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    for _ in range(epochs):
        for idx, y in examples:
            w0 = -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)
            held = {int(i): weight(int(i)) for i in idx}
            gap = 1 / (1 + math.exp(-(w0 + sum(w * value(i) for i, w in held.items())))) - y
            for i, w in held.items():
                g = gap * value(i)
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / alpha
                z[i] = z.get(i, 0.0) + g - sigma * w
                n[i] = n.get(i, 0.0) + g * g
            sigma = (math.sqrt(bias[1] + gap * gap) - math.sqrt(bias[1])) / alpha
            bias = [bias[0] + gap - sigma * w0, bias[1] + gap * gap]
    return {i: weight(i) * value(i) for i in z if weight(i)}, -bias[0] / ((beta + math.sqrt(bias[1])) / alpha)


@pytest.mark.parametrize("l1", [0.0, 0.1, 0.7])
def test_ftrl_equals_brute_force(corpus, l1):
    rows, labels = corpus
    examples = [(toxicity.features(t, WordHash()), y) for (_, t), (*_, y) in list(zip(rows, labels, strict=True))[:60]]
    w, b = toxicity.passes(examples, 3, l1)
    by_hand, b_by_hand = ftrl_by_hand(examples, 3, l1)
    assert set(np.flatnonzero(w)) == set(by_hand) and b == pytest.approx(b_by_hand)
    assert [w[i] for i in by_hand] == pytest.approx(list(by_hand.values()))


def test_pools_and_network_equal_brute_force():
    rng = np.random.default_rng(3)
    text = "Some words, some Words again 123 %% some"
    vectors = rng.normal(size=(quality_model.WORDS, quality_model.DIM))
    pairs = quality_model.token_ids(text, quality_model.TokenIds())
    x = quality_model.pooled(pairs, vectors)
    for d in range(quality_model.DIM):
        words, shapes = [vectors[i][d] for i in pairs[0]], [vectors[i][d] for i in pairs[1]]
        mean = sum(words) / len(words)
        spread = math.sqrt(sum((v - mean) ** 2 for v in words) / len(words))
        assert (x[d], x[quality_model.DIM + d], x[2 * quality_model.DIM + d]) == pytest.approx((mean, sum(shapes) / len(shapes), spread))
    data = rng.normal(size=(200, 6))
    net = quality_model.train(data, (data[:, 0] + data[:, 1] > 0).astype(float))
    for row, logit in zip(data[:20], quality_model.forward(data[:20], net), strict=True):
        hidden = [math.tanh(net["b1"][h] + sum((row[i] - net["mean"][i]) / net["std"][i] * net["w1"][i][h] for i in range(6))) for h in range(quality_model.HIDDEN)]
        assert logit == pytest.approx(net["b2"][0] + sum(v * net["w2"][h][0] for h, v in enumerate(hidden)))


def test_a_repeated_id_is_learned_from_once(spark):
    """However often a labelled id stands in the table, one row of it reaches the training task."""
    docs = spark.createDataFrame([(1, f"text {i % 3}") for i in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    sample = labelled_sample(docs, labels, "toxic", 1, 5, False, 10)
    assert sorted(map(tuple, sample.collect())) == [("other", 1), ("text 0", 1)]
