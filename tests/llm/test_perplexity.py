import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from lattica.llm import perplexity as P

from .common import ODD, docs


def squeezed(text):
    return " ".join(re.sub("[\t-\r\x85\xa0]", " ", text).split(" ")).strip(" ") if text else ""


def normal(text):
    return re.sub(" +", " ", squeezed(text)).strip(" ")


def windows(text, order):
    padded = "\2" * (order - 1) + normal(text)
    return [padded[k : k + order] for k in range(len(padded) - order + 1)]


def brute(texts, order):
    """Interpolated modified Kneser-Ney from dictionaries; returns the probability of a gram."""
    counts = {order: collections.Counter(g for t in texts for g in windows(t, order))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount, total, weight = {}, {}, {}
    for k in counts:
        n = collections.Counter(counts[k].values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0]
            discount[k] = [min(max(d, 0.05), j - 0.05) for d, j in zip(raw, (1, 2, 3))]
        else:
            discount[k] = [0.5, 0.75, 0.9]
        total[k], off = collections.Counter(), collections.Counter()
        for g, c in counts[k].items():
            total[k][g[:-1]] += c
            off[g[:-1]] += discount[k][min(c, 3) - 1]
        weight[k] = {h: off[h] / total[k][h] for h in total[k]}

    def p(g):
        if not g:
            return 1 / (len(counts[1]) + 1)
        k, h = len(g), g[:-1]
        if h not in total[k]:
            return p(g[1:])
        c = counts[k][g]
        own = (c - discount[k][min(c, 3) - 1]) / total[k][h] if c else 0.0
        return own + weight[k][h] * p(g[1:])

    return p


def corpus(n, seed=1, letters="etaoinshr"):
    draw = random.Random(seed)
    return [" ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 6))) for _ in range(draw.randint(5, 30))).capitalize() + "." for _ in range(n)]


@pytest.mark.parametrize("order", [3, 5])
def test_documents_have_the_perplexity_of_the_formula(spark, order):
    texts = corpus(60) + [None, "", "  ", "ünï \t\xa0 ЖЁ日本語 \0 \2 x", "Zq$#! X&", "a", " b ", "e" * 3000]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    trusted = set(range(0, 60, 2))
    got = {r.doc_id: r for r in P.classify(docs(spark, rows), spark.createDataFrame([(k,) for k in trusted], "doc_id long"), order).collect()}
    side = lambda k: zlib.crc32(str(k).encode()) % 2
    models = {f: brute([texts[k] for k in trusted if side(k) != f], order) for f in (0, 1)}
    for k, t in enumerate(texts):
        grams = windows((t or "").replace("\0", "\ufffd").replace("\2", "\ufffd"), order)
        if not grams:
            assert got[k].perplexity is None
            continue
        want = math.exp(-sum(math.log(models[side(k)](g)) for g in grams) / len(grams))
        assert got[k].perplexity == pytest.approx(want, rel=1e-9), (k, t)


def test_probabilities_sum_to_one():
    texts = corpus(30)
    p = brute(texts, 3)
    letters = {c for t in texts for c in normal(t)}
    for h in ("th", "\2\2", "qz"):
        assert sum(p(h + c) for c in letters) + p(h + "Ж") == pytest.approx(1)


@pytest.mark.parametrize("wide", [False, True])
def test_grams_of_each_text(wide):
    texts = ["ab", "", "  a \n\t b ", "x", "\0\2"] + (["".join(map(chr, range(0x4E00, 0x6200)))] if wide else [])
    points, places, owner = P.spell(texts, 5)
    coder = P.Coder(5)
    got = coder.strings(coder.keys(points, places)).tolist()
    assert coder.wide == wide
    assert np.bincount(owner, minlength=len(texts)).tolist()[:5] == [2, 0, 3, 1, 2]
    assert got == [g for t in texts for g in windows(t.replace("\0", "\ufffd").replace("\2", "\ufffd"), 5)]


def test_counts_after_the_alphabet_outgrows_its_bits():
    coder = P.Coder(5)
    parts = []
    for t in ("abcabc", "".join(map(chr, range(0x4E00, 0x6200))) + "abcabc"):
        points, places, _ = P.spell([t], 5)
        parts.append(coder.keys(points, places))
    keys, counts = coder.merged(parts, [np.ones(len(p), dtype=np.int64) for p in parts])
    assert dict(zip(keys.tolist(), counts.tolist()))["bcabc"] == 2


def test_classify(spark):
    good, bad = corpus(400), ["$#@! ZXQ&* " * 12 for _ in range(20)]
    rows = [(k, t, "en" if k % 2 else None, "s") for k, t in enumerate(good + bad)] + [(900, None, "en", "s"), (901, " ", "xx", "s"), (902, good[0], "xx", "s")]
    trusted = spark.createDataFrame([(k,) for k in range(300)] + [(None,), (5,)], "doc_id long")
    got = {r.doc_id: r for r in P.classify(docs(spark, rows), trusted).collect()}
    assert len(got) == len(rows)
    assert sum(got[k].kept for k in range(400)) >= 396 and not any(got[k].kept for k in range(400, 420))
    assert got[900].perplexity is None and not got[900].kept and not got[901].kept and got[902].kept
    none = P.classify(docs(spark, ODD), spark.createDataFrame([], "doc_id long")).collect()
    assert len(none) == len(ODD) and all(r.kept == (r.perplexity is not None) for r in none)
    assert P.classify(docs(spark, []), trusted).count() == 0


def test_short_junk_is_judged_at_the_plain_quantile(spark):
    good = corpus(400)
    junk = ["$#@! ZXQ&*", "Zq$#! X&", "%%|<>Q"]
    rows = [(k, t, "en", "s") for k, t in enumerate(good + junk)]
    got = {r.doc_id: r for r in P.classify(docs(spark, rows), spark.createDataFrame([(k,) for k in range(400)], "doc_id long")).collect()}
    perplexities = sorted(got[k].perplexity for k in range(400))
    assert perplexities[-6] <= got[0].bound <= perplexities[-4] and not any(got[400 + k].kept for k in range(3))
