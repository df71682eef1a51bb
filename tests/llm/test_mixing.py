import collections
import glob
import re

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing
from lattica.plans.store import recorded

from .common import ODD, docs


def shares(sizes):
    """Sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {s: 0.0 for s in order}, set(order), float(sum(sizes.values()))
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in given.items():
            target[s] += x
            if target[s] > 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


ROWS = [(k, "w " * (k % 23 + 1), "en", ("a", "b", "c", None, "é", "B")[(k * k) % 6]) for k in range(400)] + ODD


@pytest.mark.parametrize("range_rows", [10, 100_000])
def test_targets_and_budgets(spark, range_rows):
    got = mixing.mix(docs(spark, ROWS), range_rows=range_rows).collect()
    assert len(got) == len(ROWS)
    sizes, taken = collections.Counter(), collections.Counter()
    for _, text, _, source in ROWS:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = shares(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1
    for source in sizes:  # complete epochs precede a part of the next
        if sizes[source]:
            assert {r.taken // r.size for r in got if r.source == source and r.size} <= {int(want[source] // sizes[source]), int(want[source] // sizes[source]) + 1}


def test_same_again_and_independent_of_ranges(spark):
    runs = [sorted(map(tuple, mixing.mix(docs(spark, ROWS).repartition(p), range_rows=n).collect()), key=str) for p, n in ((1, 10), (3, 1000))]
    assert runs[0] == runs[1]


def test_weights_draw_good_documents_first(spark):
    rows = [(k, "w " * 10, "en", "a") for k in range(600)] + [(1000 + k, "w " * 10, "en", "b") for k in range(2000)]
    quality = spark.createDataFrame([(k, 10.0 if k % 2 else 0.1) for k in range(2600 + 1000)], "doc_id long, weight double")
    got = mixing.mix(docs(spark, rows), quality, weights=(1, 9)).where("source = 'a'").collect()
    good = sum(r.taken for r in got if r.doc_id % 2)
    assert good > 0.9 * sum(r.taken for r in got) or sum(r.taken for r in got) >= 3000


def test_apply(spark):
    rows = [(k, " w\n" * (k % 9 + 1), "en", "ab"[k % 2]) for k in range(50)] + [(77, None, "en", "a"), (78, "x" * 9 + " " + "y z " * 20_000, "en", "b")]
    rows += [(None, f"null{k} " * 3, "en", "a") for k in range(20)] + [(3, "other text of three", "en", "a")]
    frame = docs(spark, rows)
    out = mixing.apply(frame)
    assert out.columns == frame.columns
    words = collections.Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(r.text.split())
    mixed = collections.Counter()
    for r in mixing.mix(frame).collect():
        mixed[r.doc_id] += r.taken
    assert words == +mixed and words[None] > 0
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.apply(docs(spark, [])).count() == 0


def test_rows_of_one_id_draw_apart(spark):
    rows = [(None, f"text {k}", "en", "a") for k in range(300)] + [(5, f"words {k}", "en", "a") for k in range(300)]
    drawn = docs(spark, rows).select(mixing.uniform(F.col("doc_id"), F.col("text"), "mix").alias("u")).distinct().count()
    assert drawn == 600


def test_apply_writes_few_files(spark):
    """Tables without texts need no file for each partition of the texts."""
    with recorded() as paths:
        assert mixing.apply(docs(spark, ROWS).repartition(40), range_rows=10).count() > 0
    files = {p.rsplit("/", 1)[1].split("-")[0]: len(glob.glob(p.removeprefix("file://") + "/part-*")) for p in paths}
    assert files.pop("keyed") > 1 and files == {"sized": 1, "sources": 1, "sums": 1, "taken": 1}
