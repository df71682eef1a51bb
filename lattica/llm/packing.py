"""Packing documents into windows of tokens by lexical retrieval.

Documents are dealt to shards by content: a tree of halving planes, fitted to a bounded sample of the documents'
projected weights, sends documents that share ids to one shard of about SHARD_DOCS documents and SHARD_TOKENS ids. A
shard builds a BM25 inverted index of its documents' token ids, from whole documents and with the document frequencies
of the whole table; a seed document asks it, by all of its ids, for neighbours not used yet, and those fill the rest of
its window, nearest first. The document that meets the window's end is cut there, and its rest seeds the next window, so
windows are full. A shard's last tokens become sequences whose lengths are powers of two, which need no padding.

A seed sees its own shard only; the README has the measured share of true neighbours that lie there.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import stored
from .tokens import encoder, vocabulary

WINDOW = 2048
#: Documents and ids of a shard, about.
SHARD_DOCS, SHARD_TOKENS = 2048, 4 << 20
#: Coordinates of a projected document, and how many documents of the sample that places the planes fall to a cell.
DIMS, SAMPLE = 64, 32
#: The planes cut so many cells at most, which bounds the sample; where there are more shards, the signs of random
#: projections about a cell's middle cut the cell.
MOST_CELLS = 8192
#: Weight of a document's dice in its distance from a plane: planes can cut groups of copies.
_JITTER = 1e-4
K1, B = 1.2, 0.75
#: A term is common in a shard if one of so many documents has it; documents up to which their scores are one product;
#: neighbours that are put in order at first.
_COMMON, _WHOLE, _FIRST = 16, 4096, 32
#: Tasks that pack shards, at most; a task takes its shards one after the other.
MOST_TASKS = 20_000


class Corpus:
    """What shards know of the whole table: n documents, their mean length, and by term number the idf."""

    def __init__(self, n: int, tokens: int, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean = n, tokens / max(1, n)
        self.idf = np.zeros(int(terms.max(initial=0)) + 1)
        self.idf[terms] = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def directions(self) -> np.ndarray:
        """A random direction for each term number."""
        return np.random.default_rng(0).standard_normal((len(self.idf), DIMS), dtype=np.float32)

    def sketch(self, document: np.ndarray, directions: np.ndarray) -> np.ndarray:
        """The document's weights, projected, at length 1."""
        terms, counts = np.unique(document, return_counts=True)
        v = (self.idf[terms] * (1 + np.log(counts))) @ directions[terms]
        return v / max(float(np.sqrt(v @ v)), 1e-12)


class Planes:
    """A tree of planes that cuts the space of sketches into cells of nearly equal shares of the load of the points it is built from; cuts: bits by which a cell is cut further."""

    def __init__(self, points: np.ndarray, dice: np.ndarray, load: np.ndarray, cells: int, cuts: int = 0):
        normal, edge, below, above, self.middle, self.spread = [], [], [], [], [], []
        waiting, self.cuts = [(np.arange(len(points)), cells, None, 0)], cuts
        while waiting:
            rows, share, side, parent = waiting.pop()
            x = points[rows]
            if share == 1:
                node = -1 - len(self.middle)
                self.middle.append(x.mean(0) if len(rows) else np.zeros(DIMS))
                self.spread.append(float(np.sqrt(x.var(0).sum())) if len(rows) else 0.0)
            else:
                node = len(edge)
                line = np.linalg.eigh(np.cov(x, rowvar=False, bias=True))[1][:, -1] if len(rows) else np.zeros(DIMS)
                at = x @ line + _JITTER * dice[rows]
                up = np.argsort(at, kind="stable")
                upto = np.cumsum(load[rows][up])
                bound = float(at[up[min(len(up) - 1, np.searchsorted(upto, share // 2 / share * upto[-1]))]]) if len(rows) else 0.0
                normal.append(line), edge.append(bound), below.append(0), above.append(0)
                waiting += [(rows[at <= bound], share // 2, below, node), (rows[at > bound], share - share // 2, above, node)]
            if side is not None:
                side[parent] = node
        self.normal, self.edge, self.below, self.above = np.array(normal), np.array(edge), np.array(below), np.array(above)
        self.middle, self.spread = np.array(self.middle), np.array(self.spread)

    def shards(self, points: np.ndarray, dice: np.ndarray) -> np.ndarray:
        node = np.full(len(points), 0 if len(self.edge) else -1, dtype=np.int64)
        while (inner := np.flatnonzero(node >= 0)).size:
            at = node[inner]
            low = np.einsum("ij,ij->i", points[inner], self.normal[at]) + _JITTER * dice[inner] <= self.edge[at]
            node[inner] = np.where(low, self.below[at], self.above[at])
        cell = -1 - node
        if not self.cuts:
            return cell
        lines = np.random.default_rng(1).standard_normal((DIMS, self.cuts))
        signs = (points - self.middle[cell]) @ lines > 0
        code = signs @ (1 << np.arange(self.cuts))
        copies = self.spread[cell] < 1e-6  # no line cuts a cell of copies
        return (cell << self.cuts) + np.where(copies, (np.modf(dice * 1024)[0] * (1 << self.cuts)).astype(np.int64), code)


class Index:
    """BM25 over the documents of one shard; documents are arrays of term numbers. corpus: see Corpus; without it the shard is the corpus."""

    def __init__(self, documents: list[np.ndarray], k1: float = K1, b: float = B, corpus: Corpus | None = None):
        n = len(documents)
        lengths = np.array([len(d) for d in documents], dtype=np.int64)
        found = [np.unique(d, return_counts=True) for d in documents]
        term = np.concatenate([*(t for t, _ in found), np.zeros(0, dtype=np.uint32)]).astype(np.int64)
        counts = np.concatenate([*(c for _, c in found), np.zeros(0, dtype=np.int64)])
        self.first = np.cumsum([0, *(len(t) for t, _ in found)])
        by_term = np.argsort(term, kind="stable")
        term, counts, self.documents = term[by_term], counts[by_term], np.repeat(np.arange(n), np.diff(self.first))[by_term]
        fresh = np.ones(len(term), dtype=bool)
        fresh[1:] = term[1:] != term[:-1]
        self.start = np.append(np.flatnonzero(fresh), len(term))
        df = np.diff(self.start)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5)) if corpus is None else corpus.idf[term[fresh]]
        mean = (lengths.mean() if n else 1.0) if corpus is None else corpus.mean
        norm = k1 * (1 - b + b * lengths / max(1.0, mean))
        place = np.repeat(np.arange(len(df)), df)
        self.weights = idf[place] * counts * (k1 + 1) / (counts + norm[self.documents])
        self.term_of = np.empty(len(term), dtype=np.int64)
        self.term_of[by_term] = place
        # as many as _COMMON documents have terms are common, at most; their part of all scores is one product, or a row of it
        common = np.flatnonzero(df * _COMMON > n)
        self.rare = np.ones(len(df), dtype=bool)
        self.rare[common] = False
        number = np.cumsum(~self.rare) - 1
        inner = ~self.rare[place]
        table = np.zeros((len(common), n), dtype=np.float32)
        table[number[place[inner]], self.documents[inner]] = self.weights[inner]
        self._table, self._has = table, (table.T > 0).astype(np.float32)
        self._scores = self._has @ table if n <= _WHOLE else None
        self.df, self.n = df, n

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share one of the seed's terms, by falling BM25 score, ties by number."""
        score = (self._scores[seed] if self._scores is not None else self._has[seed] @ self._table).astype(np.float64)
        terms = self.term_of[self.first[seed] : self.first[seed + 1]]
        terms = terms[self.rare[terms] & (self.df[terms] > 1)]
        documents, weights, start = self.documents, self.weights, self.start
        for a, b in zip(start[terms].tolist(), start[terms + 1].tolist()):
            score[documents[a:b]] += weights[a:b]
        score[used] = 0
        score[seed] = 0
        score = np.round(score, 5)
        most = min(_FIRST, self.n)
        best = np.argpartition(-score, most - 1)[:most]
        edge = score[best].min()
        for found in (np.flatnonzero((score > edge) & (score > 0)), np.flatnonzero((score <= edge) & (score > 0))):
            yield from found[np.lexsort((found, -score[found]))].tolist()


def pack(documents: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard, every token in one piece, sequences gapless."""
    index, used = Index(documents, K1, B, corpus), np.zeros(len(documents), dtype=bool)
    pieces: list[tuple[int, int, int]] = []
    fill, waiting, following = 0, iter(()), 0
    while True:
        document = next((x for x in waiting if not used[x]), None)
        if document is None:
            while following < len(documents) and used[following]:
                following += 1
            if following == len(documents):
                break
            document, fresh = following, True
        else:
            fresh = fill == 0
        used[document] = True
        done, size = 0, len(documents[document])
        while done < size:
            take = min(window - fill, size - done)
            pieces.append((document, done, take))
            done, fill = done + take, (fill + take) % window
            fresh = fresh or fill == 0 or fill == take  # it starts a window, or its rest does
        if fresh and fill:
            waiting = index.neighbours(document, used)
    total = sum(n for *_, n in pieces)
    ends = list(range(window, total + 1, window))  # full windows, then powers of two
    rest, at = total - (ends[-1] if ends else 0), ends[-1] if ends else 0
    while rest:
        part = 1 << (rest.bit_length() - 1)
        at, rest = at + part, rest - part
        ends.append(at)
    out, at, sequence, offset = [], 0, 0, 0
    for document, start, length in pieces:
        while length:
            take = min(length, ends[sequence] - at)
            out.append((document, start, take, sequence, offset))
            at, start, length, offset = at + take, start + take, length - take, offset + take
            if at == ends[sequence]:
                sequence, offset = sequence + 1, 0
    return out


def _encode(tokenizer: str, end_id: int, width: int):
    """Documents as ids of `width` bytes; a partition's last row has the document frequencies of its terms, its documents and its ids."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, df, n, tokens = encoder(tokenizer, False), np.zeros(0, dtype=np.int64), 0, 0
        for frame in frames:
            at = 0
            for size, ids, bounds in codec.batches(frame.column(2), end_id):
                if int(ids.max()) >= len(df):
                    df = np.concatenate([df, np.zeros(int(ids.max()) + 1 - len(df), dtype=np.int64)])
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    df[np.unique(ids[a:b])] += 1
                n, tokens = n + size, tokens + len(ids)
                data = pa.Array.from_buffers(pa.binary(), size, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}"))])
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(at, size), frame.column(1).slice(at, size), data, pa.nulls(size, pa.binary())], ["doc_id", "tie", "ids", "counts"])
                at += size
        terms = np.flatnonzero(df)
        counts = np.concatenate([[-1], terms, [n], df[terms], [tokens], np.zeros(len(terms), dtype=np.int64)]).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts], pa.binary())], ["doc_id", "tie", "ids", "counts"])

    return run


def _numbers(column: pa.Array, width: int) -> list[np.ndarray]:
    return [np.frombuffer(h, dtype=f"<u{width}") for h in column.to_pylist()]


def _frequencies(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n, tokens of packed counts; the row of term -1 has documents and ids."""
    for frame in frames:
        for data in frame.column(0).to_pylist():
            rows = np.frombuffer(data, dtype="<i8").reshape(3, -1)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], ["term", "n", "tokens"])


def _load(ids: np.ndarray) -> float:
    """A document's share of a shard."""
    return 1 / SHARD_DOCS + len(ids) / SHARD_TOKENS


def _sketches(corpus, width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = corpus.value
        directions = known.directions()
        for frame in frames:
            documents = _numbers(frame.column(1), width)
            points = [known.sketch(d, directions).tolist() for d in documents]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(points, pa.list_(pa.float64())), pa.array([_load(d) for d in documents])], ["dice", "point", "load"])

    return run


def _place(corpus, planes, width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = corpus.value
        directions = known.directions()
        for frame in frames:
            points = np.array([known.sketch(d, directions) for d in _numbers(frame.column(2), width)]).reshape(-1, DIMS)
            shard = planes.value.shards(points, frame.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), frame.column(0), frame.column(1), frame.column(2)], ["shard", "doc_id", "tie", "ids"])

    return run


def _pack(corpus, window: int, width: int, with_ids: bool):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, held = None, [], []

        def rows() -> pa.RecordBatch:
            out = pack(held, window, corpus.value)
            long = lambda values: pa.array(list(values), pa.int64())
            columns = [
                pa.array([docs[d] for d, *_ in out], pa.int64()), long(s for _, s, *_ in out), long(n for _, _, n, *_ in out),
                long(zlib.crc32(held[d][s : s + n]) for d, s, n, *_ in out), long(len(held[d]) for d, *_ in out),
                long((shard << 32) + q for *_, q, _ in out), long(o for *_, o in out),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array([held[d][s : s + n].tobytes() for d, s, n, *_ in out], pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(columns, names)

        for frame in frames:
            for number, doc, ids in zip(*(frame.column(k).to_pylist() for k in range(3))):
                if number != shard and held:
                    yield rows()
                    docs, held = [], []
                shard = number
                docs.append(doc)
                held.append(np.frombuffer(ids, dtype=f"<u{width}").astype("<u4"))
        if held:
            yield rows()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (u32 bytes) if asked for.

    A document is its ids and the end id; a null or empty text is the end id alone. Each id lies in exactly one piece.
    A sequence has `window` ids or a power of two. Rows that repeat a doc_id are documents of their own, as is each row
    whose doc_id is null. An empty table gives no rows. Only doc_id and text are read. Documents are read in the order
    of doc_id within a shard, so the result is the same for the same rows in the same files.
    """
    spark = docs.sparkSession
    width = 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("tie"), "text")
    encoded = stored(rows.mapInArrow(_encode(tokenizer, end_id, width), "doc_id long, tie long, ids binary, counts binary"), "encoded")
    # one row a term of the tokenizer: bounded by its vocabulary
    counts = encoded.where("counts is not null").select("counts").mapInArrow(_frequencies, "term long, n long, tokens long")
    counts = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).toArrow()
    term, number, tokens = (counts[k].to_numpy() for k in ("term", "n", "tokens"))
    known = Corpus(int(number[term < 0].sum()), int(tokens.sum()), term[term >= 0], number[term >= 0])
    rows, corpus = encoded.where("ids is not null").select("doc_id", "tie", "ids"), spark.sparkContext.broadcast(known)
    shards = max(1, -(-known.n // shard_docs), -(-int(tokens.sum()) // SHARD_TOKENS))
    if shards == 1:
        rows = rows.select(F.lit(0).cast("long").alias("shard"), "doc_id", "tie", "ids")
    else:
        cuts = max(0, (-(-shards // MOST_CELLS) - 1).bit_length())
        cells = -(-shards // (1 << cuts))
        rows = rows.withColumn("dice", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1 << 30)) / (1 << 30))
        part = max(1, min(known.n // (SAMPLE * cells), known.n // 4096))
        sample = rows.where(F.pmod(F.xxhash64("tie", "doc_id"), F.lit(part)) == 0).select("dice", "ids")
        sample = sample.mapInArrow(_sketches(corpus, width), "dice double, point array<double>, load double").toArrow()
        points, dice, load = np.array(sample["point"].to_pylist()).reshape(-1, DIMS), sample["dice"].to_numpy(), sample["load"].to_numpy()
        order = np.lexsort((*points.T, dice))  # sums do not depend on the order in which rows come
        planes = spark.sparkContext.broadcast(Planes(points[order], dice[order], load[order], cells, cuts))
        rows = rows.select("doc_id", "tie", "ids", "dice").mapInArrow(_place(corpus, planes, width), "shard long, doc_id long, tie long, ids binary")
    rows = rows.repartition(max(1, min(MOST_TASKS, shards)), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "tie")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return rows.select("shard", "doc_id", "ids").mapInArrow(_pack(corpus, window, width, with_ids), schema)
