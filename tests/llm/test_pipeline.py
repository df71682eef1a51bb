import collections
import random
import re

import corpus_pipeline
from lattica.llm import outliers
from lattica.llm._spark import stored

from .common import ODD
from .common import docs as table_of
from .test_ngram_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "sequence_packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
    verdicts = {r.doc_id for r in outliers.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r.kept}
    good = {r.doc_id: r.text for r in kept["quality_rules"].collect()}
    assert set(good) == verdicts
    heads = {c for _, _, c in brute(list(good.items()), 80, 100, 5)}
    assert {r.doc_id for r in kept["near_duplicates"].collect()} == heads
    assert not any(re.search(r"token = \"[0-9a-f]{24}", r.text) for r in kept["secret_scan"].collect())
    mixed = kept["source_mixing"].collect()
    assert {r.doc_id for r in mixed} <= heads and len(mixed) > len(heads) / 2
    sizes, weights = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in kept["secret_scan"].collect()}, collections.Counter()
    for r in mixed:
        weights[r.doc_id] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    assert all(0 < n <= 3 * sizes[d] for d, n in weights.items())
    pieces, tokens = kept["sequence_packing"].collect(), collections.Counter()
    for p in pieces:
        tokens[p.sequence_id] += p.length
    assert all(n == 2048 or n & (n - 1) == 0 for n in tokens.values())
    assert sum(1 for p in pieces if p.start == 0) == len(mixed)


def test_run_and_empty(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "empty")
    assert docs.count() == 0


def test_odd_rows(spark):
    """Nulls, repeated ids, equal rows and clashing names: each row by its own text."""
    draw = random.Random(2)
    prose = lambda: " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8))) for _ in range(80))
    rows = [(k, prose(), "en", "a") for k in range(60)]
    rows += [(None, prose(), "en", "a"), (None, prose(), "en", "a"), (5, prose(), "en", "a"), (7, rows[7][1], "en", "a"), (900, rows[8][1], "en", "a"), (None, rows[9][1], "en", "a"), *ODD]
    start = table = table_of(spark, rows)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        table = stored(stage(spark, table, SF), name)
        assert table.columns == start.columns
        kept[name] = collections.Counter(r.doc_id for r in table.collect())
    assert kept["quality_rules"][None] >= 3 and kept["quality_rules"][5] == 2
    one = kept["near_duplicates"]
    assert one[None] >= 2 and one[5] == 2 and one[7] == 1 and one[8] == 1 and one[9] == 1 and 900 not in one
    assert kept["secret_scan"] == one and set(kept["source_mixing"]) <= set(one) and kept["source_mixing"][None] > 0
    pieces = corpus_pipeline.sequence_packing(spark, table, SF).collect()
    assert sum(p.start == 0 for p in pieces) == table.count()
