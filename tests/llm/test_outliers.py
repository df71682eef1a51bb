import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import outliers

from .common import ODD, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often, covered = collections.Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(covered), len(lines)


def brute_distances(rows):
    """The same estimate with numpy, one group at a time."""
    names, floors = list(outliers.FLOORS), np.array(list(outliers.FLOORS.values()))
    pairs, pools = collections.Counter((l, s) for l, s, _ in rows), collections.Counter()
    for (l, s), n in pairs.items():
        if n < outliers.LEAST_GROUP:
            pools[l] += n
    group = lambda l, s: ("pair", l, s) if pairs[l, s] >= outliers.LEAST_GROUP else ("pool", l) if pools[l] >= outliers.LEAST_GROUP else ("rest",)
    out = np.zeros(len(rows))
    for g in {group(l, s) for l, s, _ in rows}:
        at = [k for k, (l, s, _) in enumerate(rows) if group(l, s) == g]
        x = np.array([rows[k][2] for k in at])

        def edge(values, share):
            values = np.sort(values)
            return values[math.ceil(share * len(values) - 1e-9) - 1]

        middle = lambda y: np.array([(edge(np.floor(y[:, j] * 64), 0.5) + 0.5) / 64 for j in range(len(names))])
        ridge = lambda share: (lambda inner: np.cov(inner.T, bias=True) * outliers._consistency(share) + np.diag(floors**2))
        away = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
        med = middle(x)
        scale = np.sqrt((1.4826 * middle(abs(x - med))) ** 2 + floors**2)
        clipped = np.cov(np.clip((x - med) / scale, -outliers._CLIP, outliers._CLIP).T, bias=True) + outliers._RIDGE * np.eye(len(names))
        ends = []
        for start in (np.diag(scale**2), clipped * scale[:, None] * scale):
            m, c = med, start
            for _ in range(outliers.STEPS):
                bucket = np.floor(np.log(away(m, c) + 1e-6) * 64)
                inner = x[bucket <= edge(bucket, outliers.H)]
                m, c = inner.mean(0), ridge(outliers.H)(inner)
            ends.append((round(np.linalg.slogdet(c)[1], 6), len(ends), m, c))
        _, _, m, c = min(ends, key=lambda e: e[:2])
        inner = x[away(m, c) <= outliers.quantile(outliers.INNER)]
        d2 = away(inner.mean(0), ridge(outliers.INNER)(inner))
        out[at] = d2
    return out


def corpus(n=260):
    draw, rows = random.Random(8), []
    for k in range(n):
        words = ["".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(40, 200))]
        if k % 17 == 0:
            words = [w + "***$$" for w in words]
        if k % 5 == 0:
            words += words[: len(words) // 3]
        text = "".join(w + ("\n" if draw.random() < 0.1 else " ") for w in words)
        rows.append((k, text, "en" if k % 3 else "de", None if k % 10 == 0 else f"s{k % 2}" if k % 4 else "hot"))
    return rows


def test_statistics_and_verdicts(spark):
    rows = corpus() + ODD
    got = collections.defaultdict(list)
    for r in outliers.judge(docs(spark, rows)).collect():
        got[r.doc_id].append(r)
    good = []
    for doc, text, lang, source in rows:
        want = statistics(text)
        match = [r for r in got[doc] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[:5]]
        assert match and match[0].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        if not match[0].base_failed:
            n = want[0]
            good.append((lang, source, [math.log(n), math.log(want[1] / n), math.sqrt(want[2] / n), math.sqrt(want[4] / n), math.sqrt(want[3] / want[5])], match[0]))
    d2 = brute_distances([g[:3] for g in good])
    assert np.allclose([g[3].d2 for g in good], d2, rtol=1e-6, atol=1e-9)
    assert [g[3].kept for g in good] == (d2 <= outliers.CUT).tolist()
    junk = [r for k, rs in got.items() if k is not None and k < 260 and k % 17 == 0 for r in rs]
    assert junk and not any(r.kept for r in junk)
    assert sum(r.kept for rs in got.values() for r in rs) > 200


def test_chi_squared():
    for share, k, want in ((0.975, 5, 12.8325), (0.5, 5, 4.35146), (0.95, 4, 9.48773), (0.99, 1, 6.63490)):
        assert abs(outliers.quantile(share, k) - want) < 1e-4


@pytest.mark.parametrize("share", [0.3, 0.4, 0.45])
def test_junk_of_one_kind_may_be_nearly_half_of_a_group(spark, share):
    draw, rows, n = random.Random(9), [], 400
    for k in range(n):
        words = ["".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(60, 200))]
        if k < share * n:
            words = [w + draw.choice(("", "|", "##", "%")) for w in words]
        rows.append((k, " ".join(words), "en", "s"))
    kept = {r.doc_id for r in outliers.judge(docs(spark, rows)).where("kept").select("doc_id").collect()}
    assert not any(k in kept for k in range(int(share * n))) and sum(k in kept for k in range(int(share * n) + 1, n)) >= 0.97 * (1 - share) * n


def test_keep(spark):
    rows = corpus(120)
    bad = next(t for k, t, *_ in rows if k % 17 == 0 and k)
    table = docs(spark, rows + [(None, rows[1][1], "en", "s"), (1, bad, "en", "s1")]).withColumn("document", F.lit(1)).withColumn("kept", F.lit(2))
    kept = outliers.keep(table)
    assert kept.columns == table.columns and 90 < kept.count() < 120
    assert kept.where("doc_id is null").count() == 1 and [r.text for r in kept.where("doc_id = 1").collect()] == [rows[1][1]]  # each row by its own verdict
    assert outliers.judge(docs(spark, [])).count() == 0 and outliers.keep(docs(spark, [])).count() == 0


def test_native(spark):
    plan = outliers.judge(docs(spark, corpus(60)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
