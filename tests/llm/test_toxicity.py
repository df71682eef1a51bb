import itertools
import random

import numpy as np

from lattica.llm import toxicity

from .common import ODD, docs


def test_marginals_are_exact():
    model = toxicity.Field({"=a": 2.0, "=b": -1.0}, -1.5, np.array([[0.5, -0.2], [0.1, 0.9]]))
    for words in ("x a x x b a x", "a", "x x x a", "a b a", "a x x x x x x x"):
        words = words.split()
        e = np.array([model.emission(w) for w in words])
        total, want = 0.0, np.zeros(len(words))
        for tags in itertools.product((0, 1), repeat=len(words)):
            p = np.exp(sum(x * t for x, t in zip(e, tags)) + sum(model.moves[a, b] for a, b in zip(tags, tags[1:])))
            total += p
            want += p * np.array(tags)
        at = np.flatnonzero(e != model.bias)
        assert np.allclose(toxicity.marginals(model, at, e[at], len(words)), want[at] / total)


def corpus(n, seed):
    draw = random.Random(seed)
    texts, labels = [], []
    for k in range(n):
        words = ["".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(20, 120))]
        if k % 5 == 0:
            for _ in range(3):
                words[draw.randrange(len(words))] = draw.choice(("vilest", "Rotten,", "blargfoo", "blargbar", "blargqux"))
        texts.append(" ".join(words))
        labels.append(int(k % 5 == 0))
    return texts, np.array(labels)


def test_held_out_accuracy_and_spans():
    model = toxicity.fit(*corpus(300, 1))
    scorer = toxicity.Scorer(model)
    texts, labels = corpus(200, 2)
    scores = np.array([scorer.score(t)[0] for t in texts])
    assert (scores[labels == 1] >= toxicity.CUT).mean() > 0.95 and (scores[labels == 0] >= toxicity.CUT).mean() < 0.02
    text = "é this is a vilest blargfoo thing"
    assert [text[a:b] for a, b, _ in scorer.score(text)[1]] == ["vilest", "blargfoo"]
    assert scorer.evidence("a blargnew thing")[1][0] > 0.1  # a word not seen, by its prefixes
    assert all(0 <= s <= 1 for s in scores)


def test_without_both_classes():
    for texts, labels in (([], np.zeros(0)), (["a b", "c"], np.zeros(2)), (["a"], np.ones(1))):
        assert toxicity.Scorer(toxicity.fit(texts, labels)).score("anything here")[0] < toxicity.CUT


def test_odd_rows(spark):
    model = toxicity.fit(*corpus(100, 3))
    got = toxicity.score(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs(spark, []), model).count() == 0
    labels = spark.createDataFrame([(7, 1, 1), (5, 0, 0), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    texts, y = toxicity.sample(docs(spark, ODD), labels)
    assert len(texts) == 2 and sorted(y) == [0, 1]
