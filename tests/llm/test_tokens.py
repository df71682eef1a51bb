import os
import random
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import packing, wavelet
from lattica.llm.queries import tokenizer
from lattica.llm.tokens import Encoder

from .common import ODD, docs

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def plain(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer(name))
    t.encode_special_tokens = True
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("name, keeps_space", [(BYTE, True), (WORD, False)])
def test_pieces_equal_whole_texts(name, keeps_space):
    draw, encoder, whole = random.Random(5), Encoder(tokenizer(name), keeps_space), plain(name)
    parts = ["a", "Bc", " ", " ", "\n", "\t", "'s", "é", "́", "\xa0", "\x1c", "1", "!", "日", "  ", "\x85", "ẞ", "İ", "<|endoftext|>", "the", "H\u0331", ", ", ".\n", ")", "?! "]
    texts = ["", " ", "a  b", "x\n\ny", "x \n y", "\nx", "x\n", "don't 'll", "İSTANBUL"] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(1500)]
    for text in texts:
        assert encoder.encode(text) == whole(text).tobytes(), repr(text)
    texts += [None, "word " * 40]
    at = 0
    for size, ids, bounds in encoder.batches(pa.array(texts), 7):
        for k, text in enumerate(texts[at : at + size]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*whole(text), 7], repr(text)
        at += size
    assert at == len(texts)


@pytest.mark.parametrize("name, keeps_space", [(BYTE, True), (WORD, False)])
def test_special_tokens_as_the_library_reads_them(name, keeps_space):
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(tokenizer(name)), Encoder(tokenizer(name), keeps_space, special=True)
    texts = ["<|endoftext|>", "a b <|endoftext|> c", "a\n<|endoftext|>\n", "<|startoftext|>x", "no special text here"]
    (_, ids, bounds), = encoder.batches(pa.array(texts), 1)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 1]


def test_wavelet_operations():
    draw = np.random.default_rng(3)
    for high in (1, 2, 50_257, 1 << 20):
        ids = draw.integers(0, high, 3000).astype(np.uint32)
        tree = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, np.arange(3), np.array([1000, 0, 2000])).to_bytes())
        assert (tree.decode() == ids).all() and tree.lengths.tolist() == [1000, 0, 2000]
        for i in draw.integers(0, 3000, 25).tolist():
            token = int(ids[i])
            assert tree.access(i) == token
            assert tree.count(token, 100, 2500) == (ids[100:2500] == token).sum()
            assert tree.occurrences(token)[:40] == np.flatnonzero(ids == token)[:40].tolist() if high > 2 else True
            assert tree.locate(token, tree.count(token) - 1) == np.flatnonzero(ids == token)[-1]
        assert tree.count(high + 5) == 0
        with pytest.raises(IndexError):
            tree.locate(int(ids[0]), 3000)
    empty = wavelet.WaveletMatrix.build(np.zeros(0, dtype=np.uint32), np.zeros(0), np.zeros(0))
    assert len(wavelet.WaveletMatrix.from_bytes(empty.to_bytes()).decode()) == 0


@pytest.mark.parametrize("shard_tokens", [500, wavelet.SHARD_TOKENS])
def test_wavelet_round_trip(spark, shard_tokens):
    whole, start = plain(BYTE), 0
    got = sorted(map(tuple, wavelet.read_shards(wavelet.write_shards(docs(spark, ODD), tokenizer(BYTE), 2, shard_tokens=shard_tokens)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted(r[0] for r in ODD if r[0] is not None) + [None]
    texts = {}
    for doc, text, *_ in ODD:
        texts.setdefault(doc, []).append(np.append(whole(text), 2).astype("<u4"))
    for doc, at, n, crc in got:
        assert at == start and any(len(t) == n and zlib.crc32(t.tobytes()) == crc for t in texts[doc])
        start += n
    assert wavelet.read_shards(wavelet.write_shards(docs(spark, []), tokenizer(BYTE), 2)).count() == 0


def test_small_ranges_share_a_file_of_small_row_groups(spark):
    import pyarrow.parquet as pq

    rows = [(k, f"word{k} " * (k % 50), "en", "a") for k in range(200)]
    held = {k: spark.conf.get(k, None) for k in wavelet.SMALL_BATCHES}
    shards = wavelet.write_shards(docs(spark, rows), tokenizer(BYTE), 2, shard_tokens=500)
    assert held == {k: spark.conf.get(k, None) for k in wavelet.SMALL_BATCHES}
    (file,) = shards.inputFiles()
    found = pq.ParquetFile(file.removeprefix("file://")).metadata
    column = found.row_group(0).column(3)
    assert column.path_in_schema == "shard" and column.compression == "UNCOMPRESSED"
    assert {r.part for r in shards.collect()} == {0, 1, 2, 3} and found.num_rows > 8
    got = sorted(map(tuple, wavelet.read_shards(shards).collect()))
    assert [r[0] for r in got] == list(range(200)) and [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    large = wavelet.stored(spark.range(6, numPartitions=1).selectExpr("repeat(cast(id as string), 1500000) as shard"), **wavelet.STORED)
    (file,) = large.inputFiles()
    assert pq.ParquetFile(file.removeprefix("file://")).metadata.num_row_groups >= 3


def test_memory_of_a_worker_that_sees_ever_new_words():
    code = """
import resource, sys
import pyarrow as pa
from lattica.llm.tokens import Encoder
def word(k):
    return " " + "".join(chr(97 + k // 26**i % 26) for i in range(6))
encoder, most = Encoder(sys.argv[1], True), lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
before = most()
for part in range(7):
    at = part * 300_000
    texts = pa.array(["".join(word(k) for k in range(at + j, at + j + 1000)) for j in range(0, 300_000, 1000)] * 6)
    for _ in encoder.batches(texts, 2):
        pass
print(most() - before)
"""
    run = subprocess.run([sys.executable, "-c", code, tokenizer(BYTE)], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, timeout=300)
    assert int(run.stdout) < 380, run.stdout


def test_latin_words_take_the_short_way_to_the_same_ids():
    letters, draw, encoder, whole = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if chr(c).isalpha()], random.Random(8), Encoder(tokenizer(BYTE), True), plain(BYTE)
    texts = [draw.choice(["", " "]) + " ".join("".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(draw.randint(1, 9))) for _ in range(500)]
    (_, ids, bounds), = encoder.batches(pa.array(texts), 7)
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*whole(text), 7], repr(text)


def check_pieces(pieces, lengths, window):
    by_doc, by_sequence = {}, {}
    for document, start, length, sequence, offset in pieces:
        by_doc.setdefault(document, []).append((start, length))
        by_sequence.setdefault(sequence, []).append((offset, length))
    for document, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == lengths[document]
    assert set(by_doc) == {d for d, n in enumerate(lengths) if n}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or at & (at - 1) == 0


def test_pack_keeps_every_token():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        documents = [draw.integers(0, 40, int(draw.choice([1, 5, 30, 64, 64, 200, 1000]))).astype(np.uint32) for _ in range(n)]
        check_pieces(packing.pack(documents, 64), [len(d) for d in documents], 64)


def test_pack_puts_neighbours_together():
    draw = np.random.default_rng(2)
    documents = [draw.integers(100 * (k % 10), 100 * (k % 10) + 100, 32).astype(np.uint32) for k in range(100)]
    windows = {}
    for document, _, _, sequence, _ in packing.pack(documents, 64):
        windows.setdefault(sequence, []).append(document % 10)
    together = sum(len(set(w)) == 1 for w in windows.values())
    assert together > 0.8 * len(windows)


def test_bm25_is_the_formula():
    documents = [np.array(x, dtype=np.uint32) for x in ([1, 2, 3], [1, 1, 4, 4], [2, 5, 5, 5, 5], [9], [1, 2])]
    index = packing.Index(documents)
    used = np.zeros(5, dtype=bool)
    mean, n, want = sum(map(len, documents)) / 5, 5, {}
    for k, d in enumerate(documents[1:], 1):
        score = 0.0
        for t in {1, 2, 3}:
            df, tf = sum(t in x for x in documents), (d == t).sum()
            if df > 1:
                score += np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        if score:
            want[k] = score
    assert list(index.neighbours(0, used)) == sorted(want, key=lambda k: -want[k])


def test_packing_of_odd_rows(spark):
    whole = plain(WORD)
    rows = packing.pack_documents(docs(spark, ODD), tokenizer(WORD), 1, shard_docs=4, with_ids=True).collect()
    held = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        held[r.sequence_id] = held.get(r.sequence_id, 0) + r.length
    assert sum(held.values()) == sum(len(whole(t)) + 1 for _, t, *_ in ODD)
    for doc in {i for i, *_ in ODD}:  # pieces in order give the ids of the whole texts
        want = sorted([*whole(t), 1] for i, t, *_ in ODD if i == doc)
        if len(want) == 1 or len({tuple(w) for w in want}) == len(want) == 1:
            parts = sorted((r.start, r.ids) for r in rows if r.doc_id == doc)
            assert b"".join(p for _, p in parts) == np.array(want[0], dtype="<u4").tobytes()
    assert all(n == 2048 or n & (n - 1) == 0 for n in held.values())
    assert packing.pack_documents(docs(spark, []), tokenizer(WORD), 1).count() == 0


def test_related_documents_share_a_shard(spark):
    draw = random.Random(4)
    words = [[f"{a}{b}{c}" for a in x for b in "aeiou" for c in "lmnrst"] for x in ("bc", "df", "gh", "jk")]
    rows = [(k, " ".join(draw.choice(words[k % 4]) for _ in range(40)), "en", "a") for k in range(400)]
    shards = {}
    for r in packing.pack_documents(docs(spark, rows), tokenizer(WORD), 1, shard_docs=100).collect():
        shards.setdefault(r.sequence_id >> 32, set()).add(r.doc_id)
    assert len(shards) == 4 and sum(map(len, shards.values())) == 400
    assert sum(max(sum(d % 4 == t for d in s) for t in range(4)) for s in shards.values()) > 300


def test_copies_are_cut_into_even_shards():
    point = np.ones((1000, packing.DIMS))
    dice = np.random.default_rng(3).random(1000)
    shards = packing.Planes(point[:200], np.linspace(0, 1, 200), np.ones(200), 5).shards(point, dice)
    assert sorted(set(shards.tolist())) == [0, 1, 2, 3, 4] and np.bincount(shards).max() < 300
    shards = packing.Planes(point[:200], np.linspace(0, 1, 200), np.ones(200), 5, 2).shards(point, dice)
    assert len(set(shards.tolist())) == 20 and np.bincount(shards).max() < 120
    other = np.random.default_rng(4).standard_normal((1000, packing.DIMS))
    shards = packing.Planes(other[:200], dice[:200], np.ones(200), 5, 2).shards(other, dice)
    assert len(set(shards.tolist())) == 20 and np.bincount(shards).max() < 200


def test_seeds_ask_by_all_terms_and_the_frequencies_of_the_corpus():
    documents = [np.arange(60, dtype=np.uint32)] + [np.array([k, 100 + k], dtype=np.uint32) for k in range(60)]
    assert len(list(packing.Index(documents).neighbours(0, np.zeros(61, dtype=bool)))) == 60
    corpus = packing.Corpus(1000, 2000, np.array([0, 1, 2]), np.array([900, 3, 3]))
    documents = [np.array(x, dtype=np.uint32) for x in ([0, 1], [0, 2], [1, 2], [1, 2])]
    assert list(packing.Index(documents, corpus=corpus).neighbours(0, np.zeros(4, dtype=bool))) == [2, 3, 1]
