"""N-gram Jaccard self-join: a blocked sparse matrix product of documents by shingles.

Documents with the same set of shingles are one class from the start. Between classes, a pair with
`den * |x & y| >= num * |x | y|` misses at most m(n) = n - ceil(n * num / den) shingles of either side, so

* its two *prefixes* (the P(n) = m + m // 2 + 1 smallest shingle hashes of each) share at least c = P - m of them, taken
  for the smaller side; a document with fewer shared prefix shingles than its smallest possible partner requires is out;
* of the prefix in rarest-first order, the first P - c + 1 must have a shingle in common.

Documents that share such a rare shingle form a family. A family is cut into blocks by size class, and two blocks are
multiplied only when their sizes can satisfy the threshold. The product holds exact overlap counts over whole sets, and
every task returns only a spanning forest of its links, so a group of copies never turns into all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import components, partitions, small_or_not, stored
from ._text import batches, shingle_sets
from .tokens import forget

#: Bytes of text in one block of a family.
BLOCK_BYTES = 3 << 20


def misses(n, num: int, den: int):
    """Shingles of a set of n that a partner may lack."""
    return n - (n * num + den - 1) // den


def prefix_length(n, num: int, den: int):
    m = misses(n, num, den)
    return m + m // 2 + 1


def required(n, num: int, den: int):
    """Prefix shingles that a document of n shares with any partner at least: what the smallest partner requires."""
    smallest = (n * num + den - 1) // den
    return prefix_length(smallest, num, den) - misses(smallest, num, den)


def _profile(width: int, num: int, den: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for frame in frames:
            ids = frame.column(0)
            texts = [(t or "").encode() for t in frame.column(1).to_pylist()]
            for begin, end in batches(texts):
                hashes, counts = shingle_sets(texts[begin:end], width)
                at = np.concatenate([[0], np.cumsum(counts)])
                lengths = np.where(counts > 0, np.minimum(prefix_length(counts, num, den), counts), 0)
                keys = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(at[:-1], at[1:])]
                position = np.arange(len(hashes)) - np.repeat(at[:-1], counts)
                prefix = hashes[position < np.repeat(lengths, counts)].view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, end - begin), pa.array(counts), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(prefix))],
                    ["doc_id", "n_shingles", "set_key", "prefix"],
                )

    return run


def forest(sets: np.ndarray, counts: np.ndarray, side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the given sets (end to end, counts each); side: 0 both ways, else only pairs of side 1 with side 2."""
    m = len(counts)
    owner = np.repeat(np.arange(m), counts)
    _, term = np.unique(sets, return_inverse=True)
    shared = np.bincount(term) > 1
    term, owner = term[shared[term]], owner[shared[term]]
    by_term = np.argsort(term, kind="stable")
    documents = owner[by_term]
    start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(shared)))])
    bounds = np.searchsorted(owner, np.arange(m + 1))
    parent = np.arange(m)
    found = []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in range(m):
        if side[x] == 2:
            continue
        terms = term[bounds[x] : bounds[x + 1]]
        if not len(terms):
            continue
        length = start[terms + 1] - start[terms]
        at = np.repeat(start[terms] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        overlap = np.bincount(documents[at], minlength=m)
        overlap[: x + 1] = 0
        if side[x] == 1:
            overlap[side != 2] = 0
        near = np.flatnonzero(den * overlap >= num * (counts[x] + counts - overlap))
        for y in near[overlap[near] > 0]:
            a, b = root(x), root(y)
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((x, int(y)))
    return found


def _product(width: int, num: int, den: int):
    def links(group: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
        group.sort(key=lambda row: (row[1], row[0]))
        sets, counts = shingle_sets([text for _, _, text in group], width)
        pairs = forest(sets, counts, np.array([side for _, side, _ in group]), num, den)
        return [(group[x][0], group[y][0]) for x, y in pairs]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        task, group = None, []
        for frame in frames:
            out: list[tuple[int, int]] = []
            for key, side, doc, text in zip(*(frame.column(k).to_pylist() for k in range(4))):
                if key != task and group:
                    out += links(group)
                    group = []
                task = key
                group.append((doc, side, (text or "").encode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        if out := links(group) if group else []:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])

    return run


def _families(filled: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """(rid, family) of the class heads that may have a partner. filled: rid, n_shingles, prefix; heads: rid."""
    n = F.col("n_shingles")
    lowest = F.floor((n * num + den - 1) / den)
    need = F.floor((lowest - F.floor((lowest * num + den - 1) / den)) / 2) + 1
    missed = n - lowest
    length = F.least(missed + F.floor(missed / 2) + 1, n)
    keys = filled.select("rid", n.cast("int").alias("n_shingles"), F.explode("prefix").alias("key"))
    for turn in range(2):  # the second time, shingles count among the heads that are left
        often = keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
        shared = keys.join(often, "key")
        if not turn:
            shared = stored(shared.join(small_or_not(heads.select("rid")), "rid", "left_semi"), "shared")
        enough = shared.groupBy("rid", "n_shingles").agg(F.count("*").alias("shared")).where(F.col("shared") >= need).select("rid", "shared")
        shared = shared.join(small_or_not(stored(enough, "enough")), "rid")
        keys = stored(shared if turn else shared.drop("df", "shared"), "keys")
    rarest = Window.partitionBy("rid").orderBy("df", "key")
    rare = keys.withColumn("rank", F.row_number().over(rarest) + length - F.col("shared")).where(F.col("rank") <= length - need + 1).select("rid", "key")
    rare = stored(rare, "rare")
    star = rare.groupBy("key").agg(F.min("rid").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a")
    edges = rare.join(star, "key").where("rid <> a").select("a", F.col("rid").alias("b"))
    return components(edges).select(F.col("node").alias("rid"), F.col("component").alias("family"))


def _tasks(family: DataFrame, num: int, den: int, block_bytes: int) -> DataFrame:
    """(doc_id, task, side): the products in which each document takes part. family: doc_id, family, n_shingles, bytes."""
    step = math.log(den / num) * (1 + 1e-9) if num < den else 1.0
    sized = family.withColumn("band", F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(step)).cast("int"))
    bands = sized.groupBy("family", "band").agg(F.sum("bytes").alias("bytes"))
    whole = bands.groupBy("family").agg(F.sum("bytes").alias("total"))
    bands = bands.join(whole, "family").select("family", "band", F.when(F.col("total") <= block_bytes, 0).otherwise(F.ceil(F.col("bytes") / block_bytes)).cast("int").alias("blocks"))
    neighbours = bands.select("family", "band", "blocks").join(
        bands.select("family", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")), ["family", "band"], "left"
    ).join(bands.select("family", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below")), ["family", "band"], "left")
    rows = sized.join(neighbours, ["family", "band"]).withColumn("mine", F.expr("case when blocks = 0 then 0 else pmod(xxhash64(doc_id), blocks) end").cast("int"))
    uses = F.expr("""case when blocks = 0 then array(named_struct('task', concat_ws(':', family), 'side', 0)) else concat(
        transform(sequence(0, blocks - 1), x -> named_struct('task', concat_ws(':', family, band, least(x, mine), band, greatest(x, mine)), 'side', case when x = mine then 0 when mine < x then 1 else 2 end)),
        case when above is null then array() else transform(sequence(0, above - 1), x -> named_struct('task', concat_ws(':', family, band, mine, band + 1, x), 'side', 1)) end,
        case when below is null then array() else transform(sequence(0, below - 1), x -> named_struct('task', concat_ws(':', family, band - 1, x, band, mine), 'side', 2)) end) end""")
    return rows.select("doc_id", F.explode(uses).alias("use")).select("doc_id", "use.task", "use.side")


def jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, width: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles (long) and component_id (the smallest doc_id reachable by links).

    Two documents link when den * |x & y| >= num * |x | y| for their sets of distinct `width`-word shingles, words with
    A-Z lower-cased. A text of fewer words is one shingle; null, empty or blank texts have an empty set, link with
    nothing and are their own component. Equal sets always link, however many there are; rows that repeat a doc_id
    share one component, but each keeps its own n_shingles. A null doc_id gets a null component. An empty table gives
    an empty result. Only doc_id and text are read, so other columns may have any name.
    """
    profile = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_profile(width, num, den), "doc_id long, n_shingles long, set_key binary, prefix array<long>")
    profile = stored(profile.withColumn("rid", F.monotonically_increasing_id()), "profile")
    filled = profile.where("set_key is not null and doc_id is not null")
    classes = stored(filled.groupBy("set_key").agg(F.min(F.struct("doc_id", "rid", "n_shingles")).alias("head")).select("set_key", "head.*"), "classes")
    family = _families(filled, classes, num, den).join(classes.drop("set_key"), "rid")
    tasks = stored(_tasks(family.withColumn("bytes", F.col("n_shingles") * 8), num, den, block_bytes).distinct(), "tasks")
    tasks = small_or_not(tasks)
    members = docs.select(F.col("doc_id").cast("long"), "text").join(tasks, "doc_id").dropDuplicates(["task", "side", "doc_id", "text"])
    rows = members.select("task", "side", "doc_id", "text").repartition(partitions(docs.sparkSession), "task").sortWithinPartitions("task")
    links = stored(rows.mapInArrow(_product(width, num, den), "a long, b long").where("a <> b"), "near")
    repeated = filled.groupBy("doc_id").agg(F.count_distinct("set_key").alias("n")).where("n > 1").limit(1).count()
    if repeated:  # one doc_id with several texts ties their classes together
        equal = filled.join(classes.select("set_key", F.col("doc_id").alias("head")), "set_key").where("doc_id <> head").select("head", "doc_id")
        near = components(links.union(equal)).withColumnRenamed("node", "doc_id")
        return profile.join(near, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    near = components(links).withColumnRenamed("node", "doc_id")
    heads = classes.join(near, "doc_id", "left").select("set_key", F.coalesce("component", "doc_id").alias("class_component"))
    out = profile.select("doc_id", "n_shingles", "set_key").join(heads, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id"))


def oracle(num: int, den: int, width: int) -> str:
    """The same rows in DuckDB's SQL, by joining all shingles."""
    shingle = " || ' ' || ".join(f"ws[i + {k}]" for k in range(width))
    return f"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then []::varchar[] when len(ws) < {width} then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - {width - 2}), lambda i: {shingle}) end) as ss from w),
e as (select doc_id, unnest(ss) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join s x on x.doc_id = a join s y on y.doc_id = b where {den} * c >= {num} * (len(x.ss) + len(y.ss) - c)),
two as (select a, b from l union select b, a from l),
reach(id, other) as (select a, a from two union select r.id, two.b from reach r join two on two.a = r.other),
near as (select id, min(other) as component from reach group by id)
select doc_id, len(ss)::bigint as n_shingles, coalesce(component, doc_id) as component_id from s left join near on id = doc_id
"""
