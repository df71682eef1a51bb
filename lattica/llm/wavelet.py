"""Token ids in wavelet-matrix shards.

Format of a shard, all numbers little-endian: magic `WMX3`; u32 planes, u64 tokens, u64 documents, u64 how many of them,
the last ones, have no id; then blocks, each a u64 length and that many zstd bytes: document ids (i64 each, 0 where there
is none), token counts (u32 each), the ids that occur (ascending, u32 each), how often each occurs (u64 each), zero
counts of the planes (u64 each). Then each plane: a zstd block with its rank directory, the ones before each stretch of
65536 positions and in all (u64 each); a zstd block with the lengths of its stretches (u32 each); and the stretches, each
zstd bytes by itself, eight positions to a byte, lowest bit first.

The matrix is Huffman-shaped (Claude, Navarro, Ordonez 2015): plane k holds bit k of the codes that are longer than k;
below it, ids with bit 0 come before those with bit 1, order kept, and the ids whose code ends there lie last and go.
Codes follow from the counts. Rank and select take one look-up in the stored directory, one stretch and a popcount, and
from them follow access, counting and occurrences: of each plane only the stretches that are asked are decompressed.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._spark import partitions, settings, small_or_not, stored
from .tokens import encoder

MAGIC = b"WMX3"
#: Tokens after which a shard is closed (it ends with a whole document).
SHARD_TOKENS = 2 << 20
#: Documents for which a file is worth a task: where ranges hold fewer, a task writes several of them, one after the other.
FILE_DOCS = 2000
#: Positions of a plane that are compressed together.
STRETCH = 1 << 16
#: How shards are stored: they are compressed already, and row groups of few shards keep buffers small in writing and reading.
STORED = {"compression": "uncompressed", "parquet.page.size.row.check.min": "1", "parquet.page.row.count.limit": "1", "parquet.block.size": str(2 << 20), "parquet.enable.dictionary": "false"}
#: While texts are read and encoded: rows that are held at once, as whole texts are wide and Spark's usual 4096 and 10000 of them fill the heap.
SMALL_BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxRecordsPerBatch": "5000"}
_HEAD = "<IQQQ"


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman code length of each symbol; a lone symbol has 1. Ties go by symbol, so lengths follow from counts."""
    if len(counts) <= 1:
        return np.ones(len(counts), dtype=np.int64)
    heap = [(int(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * len(counts) - 1, dtype=np.int64)
    for node in range(len(counts), 2 * len(counts) - 1):
        a, x = heapq.heappop(heap)
        b, y = heapq.heappop(heap)
        parent[x] = parent[y] = node
        heapq.heappush(heap, (a + b, node))
    depth = np.zeros(len(parent), dtype=np.int64)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[: len(counts)]


class _Shape:
    """Codes such that, level by level, the symbols that end come last: of the nodes in the order of the level, the last become leaves."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.lengths = counts.astype(np.int64), code_lengths(counts)
        self.levels = int(self.lengths.max(initial=0))
        self.codes = np.zeros(len(counts), dtype=np.uint64)
        #: symbols that end after each level, in the order in which they lie
        self.ending: list[np.ndarray] = []
        nodes = np.zeros(1, dtype=np.uint64)  # prefixes, bit k of the code is bit k of the number
        for level in range(self.levels):
            nodes = np.concatenate([nodes, nodes | np.uint64(1 << level)])
            ends = np.flatnonzero(self.lengths == level + 1)
            keep = len(nodes) - len(ends)
            self.codes[ends] = nodes[keep:]
            self.ending.append(ends)
            nodes = nodes[:keep]
        self.ended = [int(self.counts[e].sum()) for e in self.ending]


class Plane:
    """Bits in compressed stretches, with the ones before each; stretches are opened when asked for."""

    def __init__(self, size: int, before: np.ndarray, packed: list[bytes]):
        self.size, self.before, self.packed = size, before, packed
        self._open: dict[int, np.ndarray] = {}

    @classmethod
    def build(cls, bits: np.ndarray) -> Plane:
        """bits: an array of booleans."""
        pack, data = zstandard.ZstdCompressor(level=1).compress, np.packbits(bits, bitorder="little")
        stretches = [data[at : at + STRETCH // 8] for at in range(0, len(data), STRETCH // 8)]
        ones = [int(np.bitwise_count(x).sum(dtype=np.int64)) for x in stretches]
        return cls(len(bits), np.concatenate([[0], np.cumsum(ones, dtype=np.int64)]).astype(np.int64), [pack(x) for x in stretches])

    def stretch(self, k: int) -> np.ndarray:
        found = self._open.get(k)
        if found is None:
            if len(self._open) >= 64:
                self._open.clear()
            found = self._open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.packed[k]), dtype=np.uint8)
        return found

    def bits(self) -> np.ndarray:
        """All bits, as booleans."""
        unpack = zstandard.ZstdDecompressor().decompress
        data = np.frombuffer(b"".join(map(unpack, self.packed)), dtype=np.uint8)
        return np.unpackbits(data, count=self.size, bitorder="little").view(bool)

    def rank(self, i: int) -> int:
        """Ones before position i."""
        k, i = divmod(i, STRETCH)
        ones = int(self.before[k])
        if i:
            part = self.stretch(k)[: -(-i // 8)]
            ones += int(np.bitwise_count(part).sum(dtype=np.int64))
            if i % 8:
                ones -= int(np.bitwise_count(np.uint8(int(part[-1]) >> (i % 8))))
        return ones

    def bit(self, i: int) -> int:
        return int(self.stretch(i // STRETCH)[i % STRETCH // 8]) >> (i % 8) & 1

    def select(self, bit: int, nth: int) -> int:
        """Position of the nth (from 0) such bit."""
        before = self.before if bit else np.minimum(np.arange(len(self.before)) * STRETCH, self.size) - self.before
        k = int(np.searchsorted(before, nth, side="right")) - 1
        part = np.unpackbits(self.stretch(k), bitorder="little")
        return k * STRETCH + int(np.flatnonzero(part == bit)[nth - int(before[k])])


class WaveletMatrix:
    """One shard: ids of documents laid end to end; doc_ids and lengths hold their bounds, the last `unnamed` documents have no id; alphabet: the ids that occur."""

    def __init__(self, planes: list[Plane], zeros: np.ndarray, n: int, doc_ids: np.ndarray, lengths: np.ndarray, alphabet: np.ndarray, counts: np.ndarray, unnamed: int = 0):
        self.planes, self.zeros, self.n, self.doc_ids, self.lengths, self.alphabet, self.counts, self.unnamed = planes, zeros, n, doc_ids, lengths, alphabet, counts, unnamed
        self._shape = _Shape(counts)
        #: positions that each plane has
        self.sizes = [n - sum(self._shape.ended[:k]) for k in range(self._shape.levels)]

    @classmethod
    def build(cls, ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray, unnamed: int = 0) -> WaveletMatrix:
        ids = np.asarray(ids, dtype=np.uint32)
        dense = not len(ids) or int(ids.max()) < 1 << 24
        if dense:
            every = np.bincount(ids)
            alphabet = np.flatnonzero(every).astype(np.uint32)
            counts = every[alphabet]
        else:
            alphabet, counts = np.unique(ids, return_counts=True)
        shape = _Shape(counts)
        kind = np.uint16 if len(alphabet) <= 1 << 16 else np.uint32
        if dense:
            table = np.zeros(len(every), dtype=kind)
            table[alphabet] = np.arange(len(alphabet), dtype=kind)
            symbols = table[ids]
        else:
            symbols = np.searchsorted(alphabet, ids).astype(kind)
        planes, zeros = [], np.zeros(shape.levels, dtype=np.uint64)
        for k in range(shape.levels):
            one = ((shape.codes >> np.uint64(k)) & np.uint64(1)).astype(bool)[symbols]
            planes.append(Plane.build(one))
            low = symbols.take(np.flatnonzero(~one))  # far faster than masks, as bits are near even
            zeros[k] = len(low)
            left = len(symbols) - shape.ended[k]
            symbols = np.concatenate([low, symbols.take(np.flatnonzero(one)[: left - len(low)])]) if left > len(low) else low[:left]
        return cls(planes, zeros, len(ids), np.asarray(doc_ids, dtype=np.int64), np.asarray(lengths, dtype=np.uint32), alphabet, counts, unnamed)

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        arrays = [(self.doc_ids, "<i8"), (self.lengths, "<u4"), (self.alphabet, "<u4"), (self.counts, "<u8"), (self.zeros, "<u8")]
        for plane in self.planes:
            arrays += [(plane.before, "<u8"), (np.array([len(x) for x in plane.packed]), "<u4"), plane.packed]
        out = [MAGIC, struct.pack(_HEAD, len(self.planes), self.n, len(self.doc_ids), self.unnamed)]
        for values in arrays:
            if isinstance(values, list):
                out += values
            else:
                block = pack(values[0].astype(values[1]).tobytes())
                out += [struct.pack("<Q", len(block)), block]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        levels, n, _, unnamed = struct.unpack_from(_HEAD, data, 4)
        at, unpack = 4 + struct.calcsize(_HEAD), zstandard.ZstdDecompressor().decompress

        def block(kind: str) -> np.ndarray:
            nonlocal at
            (size,) = struct.unpack_from("<Q", data, at)
            at += 8 + size
            return np.frombuffer(unpack(data[at - size : at]), dtype=kind)

        ids, lengths, alphabet, counts, zeros = (block(kind) for kind in ("<i8", "<u4", "<u4", "<u8", "<u8"))
        planes, left, ended = [], n, _Shape(counts).ended
        for k in range(levels):
            before, packed = block("<u8").astype(np.int64), []
            for size in block("<u4").tolist():
                packed.append(data[at : at + size])
                at += size
            planes.append(Plane(left, before, packed))
            left -= ended[k]
        return cls(planes, zeros, n, ids, lengths, alphabet, counts, unnamed)

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        for k in range(len(self.planes)):
            ones = self.planes[k].rank(i)
            i = int(self.zeros[k]) + ones if self.planes[k].bit(i) else i - ones
            left = self.sizes[k] - self._shape.ended[k]
            if i >= left:
                ends = self._shape.ending[k]
                return int(self.alphabet[ends[np.searchsorted(np.cumsum(self._shape.counts[ends]), i - left, side="right")]])
        raise AssertionError("a code has no end")

    def _symbol(self, token: int) -> int:
        """An id's place in the alphabet; -1 if it does not occur."""
        at = int(np.searchsorted(self.alphabet, token))
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def _range(self, symbol: int, begin: int, end: int) -> tuple[int, int]:
        """Where the symbol's occurrences in positions begin to end lie below its last plane."""
        code = int(self._shape.codes[symbol])
        for k in range(int(self._shape.lengths[symbol])):
            low, high = self.planes[k].rank(begin), self.planes[k].rank(end)
            if code >> k & 1:
                begin, end = int(self.zeros[k]) + low, int(self.zeros[k]) + high
            else:
                begin, end = begin - low, end - high
        return begin, end

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often an id occurs in positions begin to end."""
        symbol = self._symbol(token)
        if symbol < 0:
            return 0
        a, b = self._range(symbol, begin, self.n if end is None else end)
        return b - a

    def locate(self, token: int, nth: int) -> int:
        """Position of the nth (from 0) occurrence of an id; IndexError if there are fewer."""
        symbol = self._symbol(token)
        if symbol < 0 or not 0 <= nth < self._shape.counts[symbol]:
            raise IndexError(nth)
        i = self._range(symbol, 0, self.n)[0] + nth
        code = int(self._shape.codes[symbol])
        for k in reversed(range(int(self._shape.lengths[symbol]))):
            bit = code >> k & 1
            i = self.planes[k].select(bit, i - int(self.zeros[k]) if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.locate(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids."""
        kind = np.uint16 if len(self.alphabet) and self.alphabet[-1] < 1 << 16 else np.uint32
        alphabet, values = self.alphabet.astype(kind), np.zeros(0, dtype=kind)
        for k in reversed(range(len(self.planes))):
            ends = self._shape.ending[k]
            below = np.concatenate([values, np.repeat(alphabet[ends], self._shape.counts[ends])])
            one = self.planes[k].bits()
            values = np.empty(self.sizes[k], dtype=kind)
            zeros = int(self.zeros[k])
            values[np.flatnonzero(~one)] = below[:zeros]
            values[np.flatnonzero(one)] = below[zeros:]
        return values.astype("<u4")


def _write(path: str, keeps_space: bool, end_id: int, shard_tokens: int):
    """Frames of one range of documents: doc_id, text, and the number of the range, which is its shards' part."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(path, keeps_space)
        part, seq, docs, sizes, ids, held = None, 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.concatenate(sizes).astype(np.uint32)
            named = pa.concat_arrays(docs)
            blob = WaveletMatrix.build(np.concatenate(ids), named.fill_null(0).to_numpy(), lengths, named.null_count).to_bytes()
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(lengths.sum(dtype=np.int64))], pa.int64()), pa.array([blob], pa.binary())], ["part", "seq", "n_tokens", "shard"]
            )

        for frame in frames:
            at = 0
            if part is None and frame.num_rows:
                part = frame.column(2)[0].as_py()
            for size, got, bounds in codec.batches(frame.column(1), end_id):
                done = 0
                while done < size:  # the shard ends with the first document that fills it
                    stop = min(size, int(np.searchsorted(bounds, bounds[done] + shard_tokens - held)))
                    ids.append(got[bounds[done] : bounds[stop]])
                    sizes.append(np.diff(bounds[done : stop + 1]))
                    docs.append(frame.column(0).slice(at + done, stop - done))
                    held, done = held + len(ids[-1]), stop
                    if held >= shard_tokens:
                        yield shard()
                        seq, docs, sizes, ids, held = seq + 1, [], [], [], 0
                at += size
        if docs:
            yield shard()

    return run


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes every text and writes the shards, in ascending doc_id order, as a table in the shared folder.

    Returns the table, read back: part and seq (their order), n_tokens, shard (the bytes of one file in the format
    above; `WaveletMatrix.from_bytes` opens them). A null or empty text has the end id only; rows without doc_id come
    last; rows that repeat a doc_id follow each other as read. An empty table gives no shards. A part is a range of doc_ids;
    the documents are counted first, and ranges of few documents share a task and a file.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(partitions(docs.sparkSession), F.col("doc_id").asc_nulls_last(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tie")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))
    files = min(partitions(docs.sparkSession), -(-docs.count() // FILE_DOCS))
    with settings(docs.sparkSession, SMALL_BATCHES):
        return stored(rows.mapInArrow(_write(tokenizer, keeps_space, end_id, shard_tokens), "part int, seq int, n_tokens long, shard binary").coalesce(max(1, files)), "wavelet", **STORED)


def verify(shard: WaveletMatrix, ids: np.ndarray, places: int = 16) -> None:
    """Holds access, counting and occurrence lookup against the decoded ids at evenly spaced positions."""
    for at in np.linspace(0, shard.n - 1, places).astype(np.int64).tolist() if shard.n else ():
        token = int(ids[at])
        before = int((ids[:at] == token).sum())
        if shard.access(at) != token or shard.count(token, 0, at) != before or shard.locate(token, before) != at:
            raise ValueError(f"shard does not answer for position {at}")


def _read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        for begin, data in zip(frame.column(0).to_pylist(), frame.column(1)):
            shard = WaveletMatrix.from_bytes(data.as_py())
            decoded = shard.decode()
            verify(shard, decoded)
            ids = memoryview(decoded.tobytes())
            ends = np.cumsum(shard.lengths, dtype=np.int64)
            starts = ends - shard.lengths
            sums = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            named = pa.array(shard.doc_ids, mask=np.arange(len(ends)) >= len(ends) - shard.unnamed)
            yield pa.RecordBatch.from_arrays([named, pa.array(starts + begin), pa.array(shard.lengths.astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32 (of its ids as u32 bytes).

    Ids are decoded; at some positions of each shard the answers to access, count and occurrence are held against them.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "before")
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("part", "seq", F.coalesce(inner, F.lit(0)).alias("within")).join(F.broadcast(before), "part")  # a row per shuffle partition
    starts = starts.select("part", "seq", (F.col("within") + F.coalesce("before", F.lit(0))).alias("begin"))
    starts = stored(starts.coalesce(-(-partitions(shards.sparkSession) // 32)), "starts")  # a narrow row per shard needs no file per partition
    return shards.select("part", "seq", "shard").join(small_or_not(starts), ["part", "seq"]).select("begin", "shard").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
