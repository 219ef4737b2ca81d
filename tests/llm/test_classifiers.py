import random
import re

import numpy as np
import pytest

from lodestone.llm import quality, toxicity
from lodestone.llm.hashing import Buffer


@pytest.fixture(scope="module")
def labelled(spark, words):
    """Clean texts, junk of two kinds, and texts with words that only toxic ones hold."""
    rng, docs, labels = random.Random(3), [], []
    for i in range(900):
        w, kind = words(rng.randint(8, 120), i), i % 6
        good, toxic = int(kind != 0), int(kind in (1, 2))
        if kind == 0:
            w = [x.upper() + "!!" for x in w] if i % 12 else [w[0]] * len(w)
        if toxic:
            for _ in range(1 + len(w) // 40):
                w.insert(rng.randrange(len(w)), rng.choice(["zqidiot", "zqscum", "lowei" + rng.choice("abcd")]))
        docs.append((i, " ".join(w)))
        labels.append((i, good, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label):
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", label).collect()
    assert len(rows) > 100 and all(0 <= r[0] <= 1 for r in rows)
    return np.mean([(r[0] >= 0.5) == bool(r[1]) for r in rows])


def test_quality_on_held_out_rows(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).withColumn("held_out", quality.held_out("doc_id", 3, 1))
    assert accuracy(scored, labels, "quality") > 0.97


def test_toxicity_on_held_out_rows(labelled):
    docs, labels = labelled
    net = toxicity.train(docs, labels)
    scored = toxicity.score(docs, net).withColumn("held_out", toxicity.held_out("doc_id"))
    assert accuracy(scored, labels, "toxic") > 0.97
    long = " ".join(["harmless"] * 30_000)
    assert net.scores([long + " zqidiot " + long])[0] > net.scores([long])[0]


def test_scores_dont_depend_on_neighbours(labelled):
    docs, labels = labelled
    net, model = toxicity.train(docs, labels), quality.train(docs, labels)
    texts = ["", "a", "zqscum", "one two three", "x" * 5000, "Größe élève"]
    for m in (net, model):
        alone = [m.scores([t])[0] for t in texts]
        assert np.allclose(m.scores(texts), alone, rtol=0, atol=1e-6) and np.allclose(m.scores(texts[::-1])[::-1], alone, rtol=0, atol=1e-6)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(odd, labelled, module):
    labels = labelled[1]
    for docs, known in ((odd, labels), (odd.limit(0), labels), (odd, labels.limit(0))):
        out = module.score(docs, module.train(docs, known))
        assert out.columns == [*(c for c in odd.columns if c != "score"), "score"]
        rows = out.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_thresholds():
    z = np.array([3.0, 2.0, 1.0, 0.0])
    assert toxicity.threshold(z, np.array([0, 0, 5, 1]), np.array([1, 7, 0, 0])) == 1.5
    assert toxicity.threshold(np.array([1.0, 1.0, 0.0]), np.array([0, 1, 1]), np.array([1, 0, 0])) == 0.5
    net = toxicity.Net.fresh(toxicity.Shape())
    toxicity.calibrate(net, [(1, 0, 0, 50), (1, 1, 32, 50), (2, 0, 64, 50), (2, 1, 96, 50), (3, 1, 96, 5)])
    assert net.shift[1] == 1.0 and net.shift[2] == 5.0 and net.shift[3] == net.shift[0]


def test_all_labelled_rows_calibrate(labelled):
    """With a sample of 40 rows of a class the others set the thresholds; the sample's bound changes no score's range."""
    docs, labels = labelled
    net = toxicity.train(docs, labels, shape=toxicity.Shape(max_rows=100, epochs=12))
    scored = toxicity.score(docs, net).withColumn("held_out", toxicity.held_out("doc_id"))
    assert accuracy(scored, labels, "toxic") > 0.9


def test_toxicity_equals_brute_force():
    """The logit of each text from its words alone, one window after the other."""
    shape = toxicity.Shape()
    net = toxicity.Net.fresh(shape)
    rng = np.random.default_rng(4)
    for w in shape.widths:
        net.conv_bias[w][:] = rng.normal(0, 0.1, shape.filters)
    texts = ["", "one", "One two, three!", " ".join(f"w{i % 7}" for i in range(50)), "Größe 中文 x"]
    words = toxicity.words_of(texts, shape)
    for text, a, b, got in zip(texts, words.start, words.end, net.logits(words)):
        assert b - a == max(1, len(re.findall(r"[^\W_]+", text)))
        vectors = [*(net.emb[list(x)].sum(axis=0) for x in words.hashes[a:b]), *[3 * net.emb[0]] * (max(shape.widths) - 1)]
        want = net.bias
        for j, w in enumerate(shape.widths):
            windows = [np.concatenate(vectors[i : i + w]) @ net.conv[w] for i in range(b - a)]
            best = np.maximum(np.max(windows, axis=0) + net.conv_bias[w], 0)
            want += best @ net.out[j * shape.filters : (j + 1) * shape.filters]
        assert abs(got - want) < 1e-4


def test_quality_equals_brute_force(labelled):
    """A text's logit is the mean over its features, counted one by one from its bytes."""
    docs, labels = labelled
    model = quality.train(docs, labels)
    texts = ["", "a", "good good words, good", "ABC!! abc", "Größe 中文\n\nx x x"]

    def bucket(span):
        return int(Buffer([span]).spans(np.array([0]), np.array([len(span)]))[0] >> np.uint64(64 - model.shape.bits))

    for text, got in zip(texts, model.scores(texts)):
        raw, found = text.encode(), []
        for n in model.shape.grams:
            found += [int(Buffer([raw[i : i + n]]).grams(n)[0] >> np.uint64(64 - model.shape.bits)) for i in range(len(raw) - n + 1)]
        own = re.findall(rb"[^\x20\x09-\x0D]+", raw)
        found += [bucket(w) for w in own] + [int(i > 0 and own[i - 1] == w) for i, w in enumerate(own)]
        z = model.bias + (sum(model.vector[h] for h in found) / len(found) if found else 0)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-9
