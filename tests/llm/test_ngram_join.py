import random
import re

import pytest

from lattica.llm import ngram_join
from lattica.llm._spark import components

from .common import ODD, docs


def brute(rows, num, den, width):
    sets = []
    for doc, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()))
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(((d, len(s), root(d)) for d, s in sets), key=str)


def near_copies(seed, n=60):
    draw = random.Random(seed)
    rows, base = [], []
    for k in range(n):
        if k % 6 == 0:
            base = [draw.choice("abcdefghij") for _ in range(draw.randint(1, 70))]
        text = list(base)
        for _ in range(draw.randint(0, 3)):
            text[draw.randrange(len(text))] = draw.choice("abcdefghij").upper()
        rows.append((k, " ".join(text), "en", "s"))
    return rows


@pytest.mark.parametrize("num, block", [(60, 60), (85, ngram_join.BLOCK_BYTES), (80, 200)])
def test_matches_brute_force(spark, num, block):
    rows = near_copies(num) + [(700, None, "en", "s"), (701, "", "en", "s"), (702, " \n", "en", "s"), (3, near_copies(num)[20][1], "en", "s")]
    got = ngram_join.jaccard_components(docs(spark, rows), num, 100, 4, block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, num, 100, 4)


def test_odd_rows(spark):
    got = ngram_join.jaccard_components(docs(spark, ODD), 80, 100, 5).collect()
    assert sorted(map(tuple, got), key=str) == brute(ODD, 80, 100, 5)


def test_empty(spark):
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


def test_components_by_rounds(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 102), (7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    want = {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    for one_task in (0, 1000):
        assert {r.node: r.component for r in components(frame, one_task=one_task).collect()} == want
