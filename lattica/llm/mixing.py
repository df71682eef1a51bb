"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / w, where u comes from a hash of its doc_id and text and w is its quality
weight. A source that owes more words than it has gives complete epochs first, each document once an epoch; what is
left is filled with documents in ascending order of their keys, the last one cut to the word that meets the budget.

The running sums go by ranges of the key within each source: sums of ranges first, then documents within a range. So no
source is gathered in one task, however large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import few_files, small_or_not, stored, trusted_labels

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: A source gives at most so many times its size.
MOST = 3
#: Rows of a source's range of keys, about.
RANGE_ROWS = 4_000
#: Quality weights of documents labelled good, labelled bad, and not labelled.
QUALITY = {1: 2.0, 0: 0.5, None: 1.0}


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def uniform(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) from 52 bits of the MD5 of seed, doc_id and the text's MD5: rows without id, or of one id, draw apart."""
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    bits = F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds number (from 1, in code point order, null last), weight and target to source, source_size.

    Targets share the sum of all sizes by weight; none exceeds `most` times its source's size. Raising all targets
    together until each source stops at its bound gives what sharing the excess again and again ends with: with sources
    in ascending order of bound / weight, those that stop come first, and the level of the rest follows from sums.
    One row per source goes through one window.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sources.withColumn("number", F.row_number().over(order))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = rows.withColumn("weight", weight).withColumn("bound", most * F.col("source_size"))
    up = Window.orderBy(F.col("bound") / F.col("weight"), "number")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.sum("source_size").over(whole)).withColumn("stopped", F.coalesce(F.sum("bound").over(before), F.lit(0)))
    rows = rows.withColumn("open", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("open"))
    free = F.col("bound") / F.col("weight") > F.col("level")
    rows = rows.withColumn("stop", F.min(F.when(free, F.struct(F.col("bound") / F.col("weight"), "number", "level"))).over(whole))
    stops = F.col("stop").isNull() | (F.struct(F.col("bound") / F.col("weight"), "number", F.lit(0.0)) < F.struct(F.col("stop")["col1"], F.col("stop")["number"], F.lit(0.0)))
    target = F.when(stops, F.col("bound").cast("double")).otherwise(F.col("stop")["level"] * F.col("weight"))
    return rows.select("source", "source_size", "number", "weight", target.alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, range_rows: int = RANGE_ROWS, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words of the document that the mix takes), one row per row.

    docs has doc_id, text and source; quality has doc_id and weight (positive), one row per doc_id; documents without a
    row, and all if it is None, weigh 1. Size is the number of words; a null or empty text has 0, and nothing is taken
    of it. A source's taken words sum to its target, rounded. A null source is a source of its own; a null doc_id draws
    a key like any other. Rows that repeat a doc_id draw apart if their texts differ; equal rows follow each other and may
    be taken differently. An empty table gives an empty result. The result depends only on the rows and the seed. key
    names a column of docs that comes along.
    """
    also = [F.col(key).alias("row_key")] if key else []
    rows = docs.select(*_sizes(F.col("doc_id"), F.col("source"), F.col("text"), seed), *also)
    return _taken(stored(_keys(rows, quality), "sized"), weights, most, range_rows)


def _sizes(doc_id: Column, source: Column, text: Column, seed: str) -> list[Column]:
    """What the mixture needs of a document: doc_id, source, size and its draw u."""
    return [doc_id.cast("long").alias("doc_id"), source.alias("source"), word_count(text).alias("size"), uniform(doc_id, text, seed).alias("u")]


def _keys(rows: DataFrame, quality: DataFrame | None) -> DataFrame:
    """rows with the key that orders them in place of u."""
    if quality is not None:
        rows = rows.join(small_or_not(stored(quality.select("doc_id", F.col("weight").alias("quality")), "weights")), "doc_id", "left")
    else:
        rows = rows.withColumn("quality", F.lit(1.0))
    return rows.withColumn("key", -F.log("u") / F.coalesce("quality", F.lit(1.0))).drop("quality", "u")


def _taken(rows: DataFrame, weights: tuple[int, ...], most: int, range_rows: int) -> DataFrame:
    """What mix() returns, of a stored table of doc_id, source, size, key and, where it is wanted, row_key."""
    ranges = max(1, rows.count() // range_rows)
    sources = stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "sources")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("epochs", epochs).withColumn("budget", F.floor(F.col("target") + 0.5) - F.col("epochs") * F.col("source_size"))
    known = small_or_not(sources.withColumnRenamed("source", "its_source"))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    rows = rows.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("long"))
    sums = rows.groupBy("number", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("number").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = small_or_not(stored(sums.select("number", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below")), "sums"))
    inner = Window.partitionBy("number", "range").orderBy("key", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(sums, ["number", "range"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("below") - F.col("within")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), *[c for c in rows.columns if c == "row_key"])


def quality_weights(spark, sf_dir: str) -> DataFrame:
    """doc_id and weight of the labelled documents, from the table labels."""
    label = F.col("quality")
    return trusted_labels(spark, sf_dir).select("doc_id", F.when(label == 1, QUALITY[1]).when(label == 0, QUALITY[0]).otherwise(QUALITY[None]).alias("weight"))


def apply(docs: DataFrame, quality: DataFrame | None = None, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixture as documents: each row of docs as often as the mixture takes it whole, and once more cut to the words of the rest.

    quality and options are those of mix(), and so is what is taken, row by row. Texts are read for their sizes and draws
    while they are stored with their keys; what follows is narrow and goes to few files. Columns are those of docs; n_chars,
    if there is one, counts the text that is left. Rows of which nothing is taken go.
    """
    cells = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    sizes = F.struct(*_sizes(F.col("doc_id"), F.col("source"), F.col("text"), seed))
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row_key"), cells.alias("row"), sizes.alias("sizes")), "keyed")
    mixed = _taken(stored(few_files(_keys(keyed.select("row_key", "sizes.*"), quality)), "sized"), weights, most, range_rows)
    taken = mixed.where("taken > 0").select("row_key", F.col("size").alias("words"), F.col("taken").alias("share"))
    taken = stored(few_files(taken), "taken")
    rows = keyed.drop("sizes").join(small_or_not(taken), "row_key")
    rows = rows.withColumn("turn", F.explode(F.sequence(F.lit(1), F.ceil(F.col("share") / F.col("words")).cast("int"))))
    rows = rows.withColumn("left", F.least(F.col("words"), F.col("share") - (F.col("turn") - 1) * F.col("words")))
    ends = F.split("row.text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each piece is a word and the blanks before it
    text = F.when(F.col("left") == F.col("words"), F.col("row.text")).otherwise(F.array_join(F.slice(ends, F.lit(1), F.col("left").cast("int")), ""))
    rows = rows.withColumn("text", text)
    out = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[x.alias(c) for c, x in out.items()])


ORACLE = """
with raw as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::bigint as size,
    ((('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0 as u
  from documents
), quality as (
  select doc_id, case max(quality) when 1 then 2.0::double when 0 then 0.5::double else 1.0::double end as w from labels where doc_id is not null group by doc_id
), sized as (select raw.*, -ln(u) / coalesce(w, 1.0::double) as key from raw left join quality using (doc_id)),
s0 as (select source, sum(size)::bigint as source_size from sized group by source),
s1 as (select *, row_number() over (order by source nulls last) as number from s0),
s2 as (select *, case (number - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as bound from s1),
s3 as (select *, bound / weight as ratio, sum(source_size) over () as total from s2),
s4 as (select *, coalesce(sum(bound) over (order by ratio, number rows between unbounded preceding and 1 preceding), 0) as stopped,
  sum(weight) over (order by ratio, number rows between current row and unbounded following) as open from s3),
s5 as (select *, (total - stopped)::double / open as level from s4),
s6 as (select *, (select struct_pack(ratio := ratio, number := number, level := level) from s5 x where x.ratio > x.level order by x.ratio, x.number limit 1) as stop from s5),
s7 as (select source, source_size, case when stop is null or ratio < stop.ratio or (ratio = stop.ratio and number < stop.number) then bound::double else stop.level * weight end as target from s6),
s8 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from s7),
s9 as (select *, floor(target + 0.5)::bigint - epochs * source_size as budget from s8)
select doc_id, sized.source, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - coalesce(sum(size) over (partition by sized.source order by key, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0))))::bigint as taken
from sized join s9 on sized.source is not distinct from s9.source
"""
