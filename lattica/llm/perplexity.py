"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

The model is a set of count tables, sharded by gram as any table is: trusted texts give the counts of ORDER-grams,
grouping by suffix the continuation counts of the lower orders, grouping by context the interpolation weights (Chen and
Goodman 1998). Characters are what they are: nothing is folded, so the tables grow with the corpus, and nothing of them
is collected or broadcast unless a count proves it small.

Documents are scored by joins as well. They are dealt to blocks of bounded size; a block lists its different grams, those
meet the count tables order by order, and the probabilities go back to the block's documents. So a gram travels once per
block, however often it occurs there.

Nobody is judged by a model that has seen them: documents fall into two folds, and each fold is scored by the model of
the other fold's trusted texts. A document is kept if its perplexity does not exceed its language's bound, a quantile of
the trusted documents of that language, scored in the same way.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import small_or_not, stored

ORDER = 5
#: The bound on the logarithm of the perplexity: this quantile of the trusted documents of the language.
UPPER = 0.99
#: Languages with fewer trusted documents take the bound of all languages together.
LEAST_TRUSTED = 30
#: Bytes of text in a block, about, and the least number of blocks of a fold; characters of text that are handled at once.
BLOCK_BYTES, LEAST_BLOCKS, PART_CHARS = 48 << 20, 4, 1 << 20
#: How hard texts are compressed on their way to their block.
LEVEL = 6
_PAD, _BLANK = 2, 0x20
_BLANKS = (*range(0x09, 0x0E), 0x85, 0xA0)


def spell(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts end to end, each text after order - 1 start symbols; the places of the texts' characters; and their text's number.

    Runs of blanks count as one, at the ends as none; null and start characters in a text count as U+FFFD.
    """
    pad = "\2" * (order - 1)
    texts = [t.translate({0: 0xFFFD, 2: 0xFFFD}) if "\0" in t or "\2" in t else t for t in texts]
    points = np.frombuffer((pad + pad.join(texts) if texts else "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = np.where(np.isin(points, _BLANKS), np.uint32(_BLANK), points) if len(points) else points
    blank, edge = points == _BLANK, (points == _BLANK) | (points == _PAD)
    again = np.zeros(len(points), dtype=bool)
    again[1:] = blank[1:] & edge[:-1]
    points = points[~again]
    last = points == _BLANK
    last[:-1] &= points[1:] == _PAD
    points = points[~last] if len(points) else points
    inner = points != _PAD
    places = np.flatnonzero(inner)
    owner = np.cumsum(~inner)[places] // (order - 1) - 1 if order > 1 else np.zeros(len(places), dtype=np.int64)
    return points, places, owner


class Coder:
    """Numbers for grams: symbols in the order in which they come, 60 bits a gram; strings once there are more symbols than fit."""

    def __init__(self, order: int):
        self.order, self.bits = order, 60 // order
        self._table, self._points = np.zeros(0x110000, dtype=np.uint16), [np.zeros(1, dtype=np.uint32)]
        self._next = 1
        self.wide = False

    def _learn(self, points: np.ndarray) -> None:
        fresh = np.unique(points[self._table[points] == 0])
        if self._next + len(fresh) > min(1 << self.bits, 1 << 16):
            self.wide = True
        elif len(fresh):
            self._table[fresh] = np.arange(self._next, self._next + len(fresh))
            self._points.append(fresh)
            self._next += len(fresh)

    def keys(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The grams that end at these places."""
        if not self.wide:
            self._learn(points)
        if self.wide:
            rows = points[(places - self.order + 1)[:, None] + np.arange(self.order)]
            return np.ascontiguousarray(rows, dtype="<u4").view(f"<U{self.order}").ravel()
        symbols = self._table[points].astype(np.uint64)
        out = np.zeros(len(points) - self.order + 1, dtype=np.uint64)
        for k in range(self.order):
            out <<= np.uint64(self.bits)
            out |= symbols[k : k + len(out)]
        return out[places - self.order + 1]

    def strings(self, keys: np.ndarray) -> np.ndarray:
        if keys.dtype.kind == "U":
            return keys
        points, mask = np.concatenate(self._points), np.uint64((1 << self.bits) - 1)
        rows = np.stack([points[((keys >> np.uint64(self.bits * (self.order - 1 - k))) & mask).astype(np.int64)] for k in range(self.order)], 1)
        return np.ascontiguousarray(rows, dtype="<u4").view(f"<U{self.order}").ravel() if len(keys) else np.zeros(0, dtype=f"<U{self.order}")

    def merged(self, parts: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Different keys of all parts, ascending, and the sums of their counts."""
        if len({p.dtype.kind for p in parts}) > 1:
            parts = [self.strings(p) for p in parts]
        keys, place = np.unique(np.concatenate(parts), return_inverse=True)
        return keys, np.bincount(place, weights=np.concatenate(counts), minlength=len(keys)).astype(np.int64)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= PART_CHARS:
            yield begin, k + 1
            begin, size = k + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _count(order: int):
    """(number, gram, n): the different grams of the rows (number, text) with the same number, as often as they occur."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held = Coder(order), {}

        def shrink(number: int) -> None:
            keys, counts = coder.merged(*held[number])
            held[number] = ([keys], [counts])

        for frame in frames:
            numbers, texts = frame.column(0).to_numpy(), frame.column(1)
            for number in np.unique(numbers).tolist():
                mine = [t for t in texts.filter(pa.array(numbers == number)).to_pylist() if t]
                for a, b in _parts(mine):
                    points, places, _ = spell(mine[a:b], order)
                    if not len(places):
                        continue
                    keys, counts = np.unique(coder.keys(points, places), return_counts=True)
                    parts = held.setdefault(number, ([], []))
                    parts[0].append(keys), parts[1].append(counts)
                    if len(parts[0]) >= 16:
                        shrink(number)
        for number in sorted(held):
            shrink(number)
            (keys,), (counts,) = held.pop(number)
            for at in range(0, len(keys), 1 << 16):
                grams = pa.array(coder.strings(keys[at : at + (1 << 16)]).tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), number, dtype=np.int32)), grams, pa.array(counts[at : at + (1 << 16)])], ["number", "gram", "n"])

    return run


def _pack(blocks: int):
    """Rows (block, documents): documents of one fold, about PART_CHARS at a time, compressed together."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=LEVEL))
        part, number = TaskContext.get().partitionId(), 0
        for frame in frames:
            folds, sizes = frame.column(0).to_numpy(), pc.fill_null(pc.binary_length(frame.column(3)), 0).to_numpy()
            documents = frame.select(["doc_id", "lang", "text"])
            for side in (0, 1):
                rows = np.flatnonzero(folds == side)
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes[rows]) // PART_CHARS)) + 1
                for some in np.split(rows, cuts):
                    if not len(some):
                        continue
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, documents.schema, options=options) as out:
                        out.write_batch(documents.take(pa.array(some)))
                    block = zlib.crc32(struct.pack("<qq", part, number)) % blocks * 2 + side
                    number += 1
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "documents"])

    return run


def _opened(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all()


def _listed(order: int):
    count = _count(order)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[pa.RecordBatch]:
            for frame in frames:
                for block, packed in zip(frame.column(0).to_pylist(), frame.column(1)):
                    text = _opened(packed.as_py())["text"].combine_chunks()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(text), block, dtype=np.int32)), text], ["block", "text"])

        for found in count(texts()):
            yield found.select(["number", "gram"]).rename_columns(["block", "gram"])

    return run


def _score(order: int):
    def run(packed: pa.Table, grams: pa.Table) -> pa.Table:
        coder = Coder(order)
        known = np.array(grams["gram"].to_pylist(), dtype=f"<U{order}")
        logs = np.log(grams["p"].to_numpy())
        ends = np.arange(1, len(known) + 1) * order - 1
        keys = coder.keys(known.view("<u4"), ends) if len(known) else np.zeros(0, dtype=np.uint64)  # after this the coder has all symbols of the block
        up = np.argsort(keys)
        keys, logs, out = keys[up], logs[up], []
        for part in packed["documents"]:
            documents = _opened(part.as_py())
            texts = [t or "" for t in documents["text"].to_pylist()]
            points, places, owner = spell(texts, order)
            found, place = np.unique(coder.keys(points, places) if len(places) else keys[:0], return_inverse=True)
            sums = np.bincount(owner, weights=logs[np.searchsorted(keys, found)][place], minlength=len(texts))
            sizes = np.bincount(owner, minlength=len(texts))
            entropy = pa.array(-sums / np.maximum(sizes, 1), mask=sizes == 0)
            out.append(pa.table({"doc_id": documents["doc_id"], "lang": documents["lang"], "entropy": entropy, "symbols": sizes}))
        return pa.concat_tables(out)

    return run


def _discounts(orders: dict[int, DataFrame]) -> tuple[dict, dict]:
    """Chen and Goodman's D1, D2 and D3+ by order and model, from the numbers of grams that occur once to four times; and how many symbols each model knows."""
    rows = None
    for k, counts in orders.items():
        part = counts.select(F.lit(k).alias("k"), "model", "n")
        rows = part if rows is None else rows.union(part)
    found = rows.groupBy("k", "model").agg(F.count("*").alias("all"), *[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).collect()  # a row for each order of a model
    out = {}
    for row in found:
        n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
        if not n1 or not n2:
            out[row.k, row.model] = [0.5, 0.75, 0.9]
            continue
        y = n1 / (n1 + 2 * n2)
        raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0]
        out[row.k, row.model] = [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]
    return out, {row.model: row["all"] for row in found if row.k == 1}


class Model:
    """Count tables of several models: seen[k] has model, gram (of k characters) and share, its discounted part of its context's count; rest[k] has model, context and weight, what the context leaves to order k - 1; symbols: how many different ones each model knows."""

    def __init__(self, seen: dict[int, DataFrame], rest: dict[int, DataFrame], symbols: dict[int, int]):
        self.seen, self.rest, self.symbols = seen, rest, symbols

    @property
    def order(self) -> int:
        return max(self.seen)


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """The models of a table (model int, text). Null and empty texts count nothing; a model without any text finds all symbols alike."""
    counted = texts.select(F.col("model").cast("int"), "text").mapInArrow(_count(order), "model int, gram string, n long")
    orders = {order: stored(counted.groupBy("model", "gram").agg(F.sum("n").alias("n")), "grams")}
    for k in range(order - 1, 0, -1):  # continuation counts: how many different symbols come before
        orders[k] = stored(orders[k + 1].groupBy("model", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")), "continued")
    discounts, symbols = _discounts(orders)
    seen, rest = {}, {}
    for k, counts in orders.items():
        off = F.lit(0.5)
        for (level, model), (d1, d2, d3) in discounts.items():
            if level == k:
                off = F.when(F.col("model") == model, F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)).otherwise(off)
        rows = counts.withColumn("context", F.substring("gram", 1, k - 1)).withColumn("off", off)
        sums = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("off") / F.sum("n")).alias("weight"))
        rest[k] = sums.select("model", "context", "weight")
        seen[k] = rows.join(sums.drop("weight"), ["model", "context"]).select("model", "gram", ((F.col("n") - F.col("off")) / F.col("total")).alias("share"))
    return Model(seen, rest, symbols)


def probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """model, gram and p of different grams (model, gram) of the model's order, a stored table: order by order, the share plus the context's weight times the suffix's probability."""
    asked = {model.order: grams}
    for k in range(model.order - 1, 0, -1):
        asked[k] = stored(asked[k + 1].select("model", F.substring("gram", 2, k).alias("gram")).distinct(), "asked")
    less = F.lit(1.0)
    for number, n in model.symbols.items():
        less = F.when(F.col("model") == number, F.lit(1.0 / (n + 1))).otherwise(less)
    lower = None
    for k in range(1, model.order + 1):
        rows = asked[k].withColumn("context", F.substring("gram", 1, k - 1)).withColumn("suffix", F.substring("gram", 2, k - 1))
        rows = rows.join(model.seen[k], ["model", "gram"], "left").join(model.rest[k], ["model", "context"], "left")
        rows = rows.withColumn("less", less) if lower is None else rows.join(lower, ["model", "suffix"])
        p = F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("less")
        lower = rows.select("model", F.col("gram").alias("suffix"), p.alias("less"))
    return lower.select("model", F.col("suffix").alias("gram"), F.col("less").alias("p"))


def fold(doc_id: Column) -> Column:
    """The fold of a document, 0 or 1, which is the number of the model that scores it; a null doc_id is in fold 0."""
    return F.coalesce((F.crc32(doc_id.cast("string")) % 2).cast("int"), F.lit(0))


def score(docs: DataFrame, model: Model, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, entropy (the natural logarithm of the perplexity per symbol; null for a text without any) and symbols of each row, by the model of its fold."""
    order = model.order
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // (2 * block_bytes)))  # of each fold
    rows = docs.select(fold(F.col("doc_id")).alias("fold"), F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = rows.mapInArrow(_pack(blocks), "block int, documents binary").repartition(2 * blocks, "block")
    # first the different grams of all texts and their probabilities, then, in one plan, which deals the texts once, each block's part of them
    different = docs.select(fold(F.col("doc_id")).alias("model"), "text").mapInArrow(_count(order), "model int, gram string, n long").select("model", "gram").distinct()
    found = stored(probabilities(stored(different, "different"), model), "probabilities")
    listed = rows.mapInArrow(_listed(order), "block int, gram string").select("block", (F.col("block") % 2).alias("model"), "gram")
    known = listed.join(found, ["model", "gram"]).select("block", "gram", "p").repartition(2 * blocks, "block")
    schema = "doc_id long, lang string, entropy double, symbols long"
    return rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_score(order), schema)


def classify(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, lang, perplexity, bound and kept, one row per row of docs.

    docs has doc_id, text and lang; trusted has the doc_ids of trusted documents, one row each. A text without symbols
    (null, empty, blank) has a null perplexity and is not kept; a null language is one of its own; without trusted
    documents nothing bounds and all other texts are kept. Rows that repeat get equal results. Whole texts count,
    whatever their length. An empty table gives no rows; only these columns are read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    ids = small_or_not(stored(trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct(), "trusted"))
    model = train(docs.join(ids, "doc_id", "left_semi").select((1 - fold(F.col("doc_id"))).alias("model"), "text"), order)
    scored = stored(score(docs, model), "scored")
    quiet = scored.join(ids, "doc_id", "left_semi").where("entropy is not null")
    spread = [F.percentile_approx("entropy", F.lit(UPPER), 10_000).alias("its_bound"), F.count("*").alias("n")]
    by_lang = quiet.groupBy(F.col("lang").alias("its_lang")).agg(*spread).where(F.col("n") >= LEAST_TRUSTED).select("its_lang", "its_bound")
    overall = quiet.agg(*spread).first()["its_bound"]
    rows = scored.join(small_or_not(stored(by_lang, "bounds")), F.col("lang").eqNullSafe(F.col("its_lang")), "left")
    edge = F.coalesce("its_bound", F.lit(math.inf if overall is None else overall))
    return rows.select("doc_id", "lang", F.exp("entropy").alias("perplexity"), F.exp(edge).alias("bound"), F.coalesce(F.col("entropy") <= edge, F.lit(False)).alias("kept"))
