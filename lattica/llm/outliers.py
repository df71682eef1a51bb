"""Quality rules: robust multivariate outliers among document statistics, in DataFrame expressions only.

Documents that pass the base rules are grouped by language and source. Each group's location and scatter come from the
minimum-covariance-determinant estimate (Rousseeuw and Van Driessen 1999): from two starts, distances scaled by median
absolute deviations and distances under the covariance of clipped values, concentration steps take the half of the rows
with the smallest Mahalanobis distances and estimate anew from those, until the determinants settle; the start that ends
with the smaller determinant gives the raw estimate, and the rows within its 97.5 % ellipsoid the final one. A document
is rejected if its distance under that exceeds CUT. Half of a group may be junk.

Medians and distance quantiles come from counts of narrow buckets, which any number of tasks can add up; no group is
ever gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import BROADCAST_ROWS, small_or_not, stored

SPACE = r"[\x20\x09-\x0D]+"
#: Base rules: fewer words, or a larger percentage of words in repeated three-word windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Statistics in the vector, each with the least standard deviation that a group's estimate may have.
FLOORS = {"x_words": 1.0, "x_length": 0.05, "x_symbols": 0.08, "x_repeat": 0.15, "x_lines": 0.1}
#: Share of rows in a concentration step, most steps, and the share of a normal sample that the last estimate rests on.
H, STEPS, INNER = 0.5, 15, 0.975
#: Share of a normal sample that is kept. Statistics of documents have heavier tails: in a numpy prototype on check_s it kept 99.2 % of those labelled good.
KEPT = 0.9999
#: Groups of fewer rows pool by language, and pools of fewer with all others.
LEAST_GROUP = 40
_STEP = 64  # buckets per unit of a statistic, and per unit of the logarithm of a squared distance
_NAMES = list(FLOORS)
#: Values are clipped at so many deviations for the second start, and this is added to the variances there.
_CLIP, _RIDGE = 2.0, 0.1


def _chi_squared(x: float, k: int) -> float:
    """The distribution function with k degrees of freedom, by its power series."""
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while x > 0 and term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def quantile(share: float, k: int = len(_NAMES)) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi_squared(mid, k) < share else (low, mid)
    return low


#: Largest squared distance that is kept.
CUT = quantile(KEPT)


def _consistency(share: float) -> float:
    """What makes the scatter of the inner share of a normal sample that of the whole."""
    return share / _chi_squared(quantile(share), len(_NAMES) + 2)


def statistics(docs: DataFrame, extra: bool = False) -> DataFrame:
    """doc_id, lang, source and n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of each row's whole text; with extra, the whole row as the struct `document`."""
    also = ["document"] if extra else []
    if extra:
        docs = docs.select("doc_id", "lang", "source", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", *also, text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "lang", "source", *also, F.array_remove(F.split("text", SPACE), "").alias("w"), lines.alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).alias("n_symbols"),
    )
    windows = F.expr("case when size(w) < 3 then array() else transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))) end")
    rows = rows.select(
        "doc_id", "lang", "source", *also, F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), F.col("n_symbols").cast("long"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), windows.alias("windows"),
    )
    ordered = F.expr("case when size(array_distinct(windows)) = size(windows) then null else array_sort(transform(windows, (h, i) -> named_struct('h', h, 'i', i))) end")
    rows = rows.withColumn("ordered", ordered).drop("windows")
    repeated = F.expr("""case when ordered is null then 0L else aggregate(
        array_sort(transform(filter(sequence(0, size(ordered) - 1), k ->
            (k > 0 and ordered[k].h = ordered[greatest(k - 1, 0)].h) or (k < size(ordered) - 1 and ordered[k].h = ordered[least(k + 1, size(ordered) - 1)].h)), k -> ordered[k].i)),
        named_struct('last', -3, 'n', 0L), (s, i) -> named_struct('last', i, 'n', s.n + least(3, i - s.last)), s -> s.n) end""")
    return rows.withColumn("n_repeat_words", repeated).drop("ordered")


def _vector(rows: DataFrame) -> DataFrame:
    n = F.col("n_words").cast("double")
    return rows.select(
        "row", "lang", "source",
        F.log(n).alias("x_words"), F.log(F.col("word_chars") / n).alias("x_length"), F.sqrt(F.col("n_symbols") / n).alias("x_symbols"), F.sqrt(F.col("n_repeat_words") / n).alias("x_repeat"),
        F.sqrt(F.col("n_dup_lines") / F.col("n_lines").cast("double")).alias("x_lines"),
    )


def _key(*parts) -> Column:
    """A 64-bit key of values that may be null."""
    return F.xxhash64(*[x for p in parts for x in ((F.col(p).isNull(), F.coalesce(F.col(p), F.lit(""))) if p in ("lang", "source") else (F.lit(p),))])


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds g, the key of the group that a row belongs to."""
    rows = rows.withColumn("pair", _key("pair", "lang", "source")).withColumn("pool", _key("pool", "lang"))
    pairs = rows.groupBy("pair", "pool").agg(F.count("*").alias("n"))
    small = pairs.where(F.col("n") < LEAST_GROUP).groupBy("pool").agg(F.sum("n").alias("pooled"))
    known = pairs.join(small, "pool", "left").select(
        "pair", F.when(F.col("n") >= LEAST_GROUP, F.col("pair")).when(F.col("pooled") >= LEAST_GROUP, F.col("pool")).otherwise(F.lit(0)).cast("long").alias("g")
    )
    return rows.join(small_or_not(stored(known, "groups")), "pair").select("row", "g", *_NAMES)


def _at_share(counts: DataFrame, keys: list[str], share: float) -> DataFrame:
    """For each of the keys the first bucket up to which at least that share of its rows lie. counts: keys, bucket, n."""
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") >= share * F.col("total")).groupBy(*keys).agg(F.min("bucket").alias("bucket"))


def _distance() -> Column:
    """The squared Mahalanobis distance from m_* under the scatter whose inverse Cholesky factor is w_*_*."""
    solved = [" + ".join(f"w_{i}_{j} * ({_NAMES[j]} - m_{_NAMES[j]})" for j in range(i + 1)) for i in range(len(_NAMES))]
    return F.expr(" + ".join(f"({y}) * ({y})" for y in solved))


def _factors(estimates: DataFrame) -> DataFrame:
    """g, s, m_*, the inverse w_i_j of the Cholesky factor of the scatter c_i_j, and size, the determinant's logarithm. Each column may use those before it."""
    k, steps = len(_NAMES), []
    for i in range(k):
        for j in range(i + 1):
            value = f"c_{i}_{j}" + "".join(f" - l_{i}_{m} * l_{j}_{m}" for m in range(j))
            steps.append(f"sqrt({value}) as l_{i}_{j}" if i == j else f"({value}) / l_{j}_{j} as l_{i}_{j}")
    for i in range(k):
        for j in range(i + 1):
            steps.append(f"1 / l_{i}_{i} as w_{i}_{i}" if i == j else f"-({' + '.join(f'l_{i}_{m} * w_{m}_{j}' for m in range(j, i))}) / l_{i}_{i} as w_{i}_{j}")
    steps.append(" + ".join(f"2 * ln(l_{i}_{i})" for i in range(k)) + " as size")
    whole = estimates.selectExpr("g", "s", *[f"m_{n}" for n in _NAMES], *steps)
    return whole.select("g", "s", *[f"m_{n}" for n in _NAMES], *[f"w_{i}_{j}" for i in range(k) for j in range(i + 1)], "size")


def _estimate(inner: DataFrame, share: float) -> DataFrame:
    """Mean and scatter of the rows of each group and start: scatter scaled for consistency, variances raised by the floors."""
    means = [F.avg(n).alias(f"m_{n}") for n in _NAMES]
    scatter = [
        (F.covar_pop(a, b) * _consistency(share) + (FLOORS[a] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES[: i + 1])
    ]
    return _factors(inner.groupBy("g", "s").agg(*means, *scatter))


def _medians(rows: DataFrame, names: list[str], prefix: str) -> DataFrame:
    """g and the median of each column within its group, to a bucket. One row per group and column is counted, whatever the rows."""
    flat = rows.select("g", F.posexplode(F.array(*names)).alias("k", "x"))
    counts = flat.groupBy("g", "k", F.floor(F.col("x") * _STEP).alias("bucket")).agg(F.count("*").alias("n"))
    found = _at_share(counts, ["g", "k"], 0.5)
    return found.groupBy("g").agg(*[F.max(F.when(F.col("k") == k, (F.col("bucket") + 0.5) / _STEP)).alias(f"{prefix}_{n}") for k, n in enumerate(_NAMES)])


def _starts(rows: DataFrame, hint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two estimates (s = 0 and 1) of each group."""
    middle = stored(_medians(rows, _NAMES, "m"), "medians")
    seen = rows.join(hint(middle), "g")
    away = _medians(seen.select("g", *[F.abs(F.col(n) - F.col(f"m_{n}")).alias(n) for n in _NAMES]), _NAMES, "d")
    scale = [F.sqrt(F.pow(1.4826 * F.col(f"d_{n}"), 2) + FLOORS[n] ** 2).alias(f"s_{n}") for n in _NAMES]
    middle = stored(middle.join(away, "g").select("g", *[f"m_{n}" for n in _NAMES], *scale), "scales")
    seen = rows.join(hint(middle), "g")
    clipped = seen.select("g", *[F.greatest(F.lit(-_CLIP), F.least(F.lit(_CLIP), (F.col(n) - F.col(f"m_{n}")) / F.col(f"s_{n}"))).alias(n) for n in _NAMES])
    pairs = [(i, j, a, b) for i, a in enumerate(_NAMES) for j, b in enumerate(_NAMES[: i + 1])]
    wrapped = middle.join(clipped.groupBy("g").agg(*[F.covar_pop(a, b).alias(f"w_{i}_{j}") for i, j, a, b in pairs]), "g")
    means = [f"m_{n}" for n in _NAMES]
    plain = middle.select("g", F.lit(0).alias("s"), *means, *[(F.pow(F.col(f"s_{a}"), 2) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j, a, b in pairs])
    other = wrapped.select("g", F.lit(1).alias("s"), *means, *[((F.col(f"w_{i}_{j}") + (_RIDGE if i == j else 0.0)) * F.col(f"s_{a}") * F.col(f"s_{b}")).alias(f"c_{i}_{j}") for i, j, a, b in pairs])
    return _factors(plain.union(other))


def distances(rows: DataFrame) -> DataFrame:
    """row and d2, the squared robust distance in its group. rows: row, lang, source and the statistics."""
    rows = stored(_grouped(_vector(rows)), "vectors")
    hint = F.broadcast if rows.select("g").distinct().count() <= BROADCAST_ROWS // 2 else lambda df: df  # for tables of a row or two a group
    estimate = stored(_starts(rows, hint), "estimate")
    both = rows.withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    for _ in range(STEPS):
        seen = both.join(hint(estimate), ["g", "s"]).select(*rows.columns, "s", _distance().alias("d2"))
        seen = seen.withColumn("bucket", F.floor(F.log(F.col("d2") + 1e-6) * _STEP))
        counts = seen.groupBy("g", "s", "bucket").agg(F.count("*").alias("n"))
        inner = _at_share(counts, ["g", "s"], H).withColumnRenamed("bucket", "edge")
        before, estimate = estimate, stored(_estimate(seen.join(hint(inner), ["g", "s"]).where(F.col("bucket") <= F.col("edge")), H), "estimate")
        moved = estimate.join(before.select("g", "s", F.col("size").alias("was")), ["g", "s"]).where(F.abs(F.col("size") - F.col("was")) > 1e-9)
        if moved.limit(1).count() == 0:
            break
    best = estimate.groupBy("g").agg(F.min(F.struct(F.round("size", 6).alias("size"), "s")).alias("best")).select("g", F.col("best.s").alias("s"))
    raw = stored(estimate.join(best, ["g", "s"]), "raw")
    seen = rows.join(hint(raw), "g").select(*rows.columns, F.lit(0).alias("s"), _distance().alias("d2"))
    last = stored(_estimate(seen.where(F.col("d2") <= quantile(INNER)), INNER), "last")
    return rows.join(hint(last), "g").select("row", _distance().alias("d2"))


def judge(docs: DataFrame, extra: bool = False) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and d2, one row per row of docs.

    docs has doc_id, text, lang and source. Whole texts count; a null text has no words and fails. Null languages and
    sources are groups of their own; repeated rows count as often as they occur and get equal results. d2 is null where
    the base rules fail, and such rows take no part in estimates. An empty table gives an empty result. With extra, the
    whole row of docs comes along as the struct `document`.
    """
    rows = statistics(docs, extra)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = stored(rows.withColumn("base_failed", failed).withColumn("row", F.monotonically_increasing_id()), "statistics")
    far = small_or_not(stored(distances(rows.where("not base_failed")), "distances"))
    out = rows.join(far, "row", "left")  # row numbers are in the stored table: they do not change
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= CUT)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "d2", *(["document"] if extra else []))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, each by its own verdict, columns as they are."""
    return judge(docs, extra=True).where("kept").select(*[F.col("document")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """The rows of judge() but d2 in DuckDB's SQL: the same statistics, groups, buckets and concentration steps."""
    k = len(_NAMES)
    ctes = [
        r"""w as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents)""",
        """win as (select r, unnest(range(1, len(ws) - 1)) as i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from w where len(ws) > 2)""",
        """hit as (select r, i from win qualify count(*) over (partition by r, g) > 1)""",
        """rep as (select r, count(distinct i + d)::bigint as n from hit, (values (0), (1), (2)) x(d) group by r)""",
        r"""st as (select r, doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
          (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
          len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) as n_lines from w)""",
        f"""s as (select st.*, coalesce(rep.n, 0) as n_repeat_words, n_words < {LEAST_WORDS} or 100 * coalesce(rep.n, 0) > {MOST_REPEATED} * n_words as base_failed from st left join rep using (r))""",
        """v as (select r, lang, source, ln(n_words::double) as x0, ln(word_chars / n_words::double) as x1, sqrt(n_symbols / n_words::double) as x2, sqrt(n_repeat_words / n_words::double) as x3, sqrt(n_dup_lines / n_lines::double) as x4 from s where not base_failed)""",
        """pairs as (select lang, source, count(*) as n from v group by all)""",
        f"""pools as (select lang, sum(n) as n from pairs where n < {LEAST_GROUP} group by lang)""",
        f"""gs as (select pairs.lang, pairs.source, case when pairs.n >= {LEAST_GROUP} then ['pair', pairs.lang, pairs.source] when pools.n >= {LEAST_GROUP} then ['pool', pairs.lang] else ['rest'] end as g from pairs left join pools on pools.lang is not distinct from pairs.lang)""",
        "x as (select r, g, x0, x1, x2, x3, x4 from v join gs on gs.lang is not distinct from v.lang and gs.source is not distinct from v.source)",
    ]
    floors, xs = list(FLOORS.values()), ", ".join(f"x{j}" for j in range(k))

    def medians(name: str, value: str) -> None:
        for j in range(k):
            ctes.append(f"""b{name}{j} as (select g, bucket, sum(count(*)) over (partition by g order by bucket) as upto, sum(count(*)) over (partition by g) as total from (select x.g, floor({value.format(j=j)} * {_STEP}) as bucket from {'x' if name == 'm' else 'x join m on m.g = x.g'}) group by g, bucket),
              {name}{j} as (select g, (min(bucket) + 0.5) / {_STEP} as {name}{j} from b{name}{j} where upto >= 0.5 * total group by g)""")
        ctes.append(f"{name} as materialized (select {name}0.g, {', '.join(f'{name}{j}' for j in range(k))} from {name}0 {' '.join(f'join {name}{j} on {name}{j}.g = {name}0.g' for j in range(1, k))})")

    medians("m", "x{j}")
    medians("d", "abs(x{j} - m{j})")
    ctes.append(f"sc as materialized (select m.*, {', '.join(f'sqrt(pow(1.4826 * d{j}, 2) + {floors[j] ** 2!r}) as s{j}' for j in range(k))} from m join d on d.g = m.g)")
    ctes.append(f"z as (select x.g, {', '.join(f'greatest(-{_CLIP}, least({_CLIP}, (x{j} - m{j}) / s{j})) as z{j}' for j in range(k))} from x join sc on sc.g = x.g)")
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    ctes.append(f"wc as (select g, {', '.join(f'covar_pop(z{i}, z{j}) as w{i}{j}' for i, j in pairs)} from z group by g)")
    ms = ", ".join(f"m{j}" for j in range(k))
    ctes.append(f"""e0 as (select g, 0 as s, {ms}, {', '.join(f's{i} * s{i} as c{i}{j}' if i == j else f'0.0::double as c{i}{j}' for i, j in pairs)} from sc
      union all select sc.g, 1 as s, {', '.join(f'sc.m{j}' for j in range(k))}, {', '.join(f'(w{i}{j} + {_RIDGE if i == j else 0.0}) * s{i} * s{j} as c{i}{j}' for i, j in pairs)} from sc join wc on wc.g = sc.g)""")
    ctes.append("x2 as materialized (select x.*, s from x, (values (0), (1)) t(s))")

    def factored(name: str) -> None:
        """l{name} from e{name}: the estimates with their factors."""
        inner = f"select * from e{name}"
        for i, j in pairs:
            value = f"c{i}{j}" + "".join(f" - l{i}{m} * l{j}{m}" for m in range(j))
            inner = f"select *, {f'sqrt({value})' if i == j else f'({value}) / l{j}{j}'} as l{i}{j} from ({inner})"
        for i in range(k):
            row = [f"1 / l{i}{i} as w{i}{j}" if i == j else f"-({' + '.join(f'l{i}{m} * w{m}{j}' for m in range(j, i))}) / l{i}{i} as w{i}{j}" for j in range(i + 1)]
            inner = f"select *, {', '.join(row)} from ({inner})"
        ctes.append(f"l{name} as materialized (select *, {' + '.join(f'2 * ln(l{i}{i})' for i in range(k))} as size from ({inner}))")

    def far(table: str, estimate: str, on: str, columns: str) -> str:
        inner = f"select {columns}, e.* exclude (g, s) from {table} x join {estimate} e on {on}"
        solved = [" + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) for i in range(k)]
        return f"select *, {' + '.join(f'({y}) * ({y})' for y in solved)} as d2 from ({inner})"

    def estimated(share: float, start: str, rows: str) -> str:
        cs = [f"covar_pop(x{i}, x{j}) * {_consistency(share)!r}{f' + {floors[i] ** 2!r}' if i == j else ''} as c{i}{j}" for i, j in pairs]
        return f"select g, {start} as s, {', '.join(f'avg(x{j}) as m{j}' for j in range(k))}, {', '.join(cs)} from {rows} group by all"

    factored("0")
    for step in range(1, STEPS + 1):  # further steps after the determinants settle change nothing
        ctes.append(f"d{step}_ as materialized (select r, g, s, {xs}, floor(ln(d2 + 1e-6) * {_STEP}) as bucket from ({far('x2', f'l{step - 1}', 'e.g = x.g and e.s = x.s', f'x.r, x.g, x.s, {xs}')}))")
        ctes.append(f"""q{step} as (select g, s, bucket, sum(count(*)) over (partition by g, s order by bucket) as upto, sum(count(*)) over (partition by g, s) as total from d{step}_ group by g, s, bucket),
          t{step} as (select g, s, min(bucket) as edge from q{step} where upto >= {H} * total group by g, s),
          e{step} as ({estimated(H, 's', f'(select d.* from d{step}_ d join t{step} t on t.g = d.g and t.s = d.s where bucket <= edge)')})""")
        factored(str(step))
    ctes.append(f"raw as materialized (select * from l{STEPS} qualify row_number() over (partition by g order by round(size, 6), s) = 1)")
    ctes.append(f"near as materialized ({far('x', 'raw', 'e.g = x.g', f'x.r, x.g, {xs}')})")
    ctes.append(f"elast as ({estimated(INNER, '0', f'(select * from near where d2 <= {quantile(INNER)!r})')})")
    factored("last")
    ctes.append(f"final as ({far('x', 'llast', 'e.g = x.g', f'x.r, x.g, {xs}')})")
    return f"with {', '.join(ctes)} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2, 0) <= {CUT!r} as kept from s left join final using (r)"
