"""Encoding whole texts with a public byte-pair tokenizer, piece by piece.

A text is cut into pieces that the tokenizer treats independently. Where the cuts lie depends on how the tokenizer splits
text (see `Encoder`). A batch of texts is cut by Arrow's kernels, each different piece of the batch is encoded once, and
the ids are put in order by index arithmetic; a worker remembers the ids of pieces it has seen. A piece that is a Latin
word, perhaps with punctuation after it, goes to the tokenizer's merge model directly, as what precedes the model is
known for it; any other piece takes the whole tokenizer.

Strings of special tokens in a text are ordinary text by default, as the tokenizer folder's README reads them: a text
cannot forge the end of a document. `special=True` reads them as the library does when nothing is set.
"""

from __future__ import annotations

import functools
import gc
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker remembers: two generations of so many, of which the older one is dropped when the younger is full.
#: An entry takes about 200 bytes, and idle workers keep theirs. Frequent pieces move to the younger one, so few are lost.
CACHE_PIECES = {True: 500_000, False: 400_000}
#: Bytes of text that are cut at once.
PART_BYTES = 12 << 20
_BEFORE_WORD = re.compile(r"(?= \S)")
_RUN = re.compile(r"\s[\s]")
#: The same for Arrow's kernels, with a blank at the end and the mark of a cut: texts that are cut one by one.
#: Where the tokenizer composes characters and lower-cases them, texts with combining marks are.
_ODD = {True: r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\pZ]{2}| \z|\x00", False: r"\pM"}
#: Punctuation between a Latin letter and a blank or line feed: never one token with the letter.
_AFTER_WORD = r"([A-Za-zÀ-ÖØ-öø-ÿ])([.,;:!?]+)([ \n])"
#: Latin letters that lower-case to one letter and that normalisation leaves alone, then ASCII punctuation but the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-įĲ-ň]+)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_SHOWN = "".join(_byte_letters())


def _letters(word: str) -> str:
    """A word as byte-level vocabularies spell it."""
    return charmap_decode(word.encode(), "strict", _SHOWN)[0]


class Encoder:
    """Encodes texts into little-endian unsigned 32-bit ids.

    keeps_space: True for byte-level tokenizers, whose pieces begin with the blank before a word; a cut lies before each
    blank that a non-blank follows, and around a line feed between non-blanks; no token spans those. False for
    tokenizers that lower-case and drop white space: a cut lies at each blank and line feed.
    """

    def __init__(self, path: str, keeps_space: bool, special: bool = False):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special
        #: strings that the tokenizer looks for in whole texts before anything else
        self._whole = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if special else []
        self._tokenizer, self._keeps_space = tokenizer, keeps_space
        self._pieces = _Pieces(tokenizer, keeps_space)

    def _ids(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of one text; a null or empty text has none."""
        if not text:
            return b""
        if any(w in text for w in self._whole):
            return self._ids(text)
        if not self._keeps_space:
            return b"".join(map(self._pieces.__getitem__, text.replace("\n", " ").split(" ")))
        if text[-1] == " " or "\0" in text or _RUN.search(text) is not None:
            return b"".join(map(self._pieces.__getitem__, _BEFORE_WORD.split(text)))
        return b"".join(map(self._pieces.__getitem__, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")))

    def batches(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Parts of the texts in order: how many texts a part has, all their ids, each text's end id included, and where each begins (one more entry than texts)."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART_BYTES, side="right")))
            yield (stop - at, *self._part(texts.slice(at, stop - at), end_id))
            at = stop
        pa.default_memory_pool().release_unused()

    def _part(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(texts, _ODD[self._keeps_space]).to_numpy(zero_copy_only=False).copy()
        for word in self._whole:
            odd |= pc.match_substring(texts, word).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if self._keeps_space:
            plain = pc.replace_substring_regex(plain, _AFTER_WORD, "\\1\0\\2\\3")
            plain = pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0")
            lists = pc.split_pattern(plain, "\0")
        else:
            plain = pc.replace_substring_regex(pc.ascii_lower(plain), _AFTER_WORD, "\\1 \\2 ")
            lists = pc.split_pattern(pc.replace_substring(plain, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        found = self._pieces.many(coded.dictionary)
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        table, begin = np.frombuffer(b"".join(found), dtype="<u4"), (np.cumsum(size) - size).astype(np.int32)
        code = coded.indices.to_numpy()
        n = size[code]
        ends = np.zeros(len(n) + 1, dtype=np.int32)  # ids of a part are fewer than its bytes and texts
        np.cumsum(n, out=ends[1:])
        bounds = lists.offsets.to_numpy().astype(np.int64)
        at = np.repeat(begin[code] - ends[:-1], n)
        at += np.arange(len(at), dtype=np.int32)
        ids, bounds = table[at], ends[bounds - bounds[0]].astype(np.int64)
        ids = np.insert(ids, bounds[1:], np.uint32(end_id))
        bounds = bounds + np.arange(len(bounds))
        if odd.any():  # a text that is not cut at every blank: its own ids take the place of the end id alone
            pieces, last, extra = [], 0, np.zeros(len(texts) + 1, dtype=np.int64)
            for k in np.flatnonzero(odd).tolist():
                own = np.frombuffer(self.encode(texts[k].as_py()), dtype="<u4")
                pieces += [ids[last : bounds[k]], own]
                last, extra[k + 1] = bounds[k], len(own)
            ids = np.concatenate([*pieces, ids[last:]])
            bounds = bounds + np.cumsum(extra)
        return ids, bounds


@functools.cache
def encoder(path: str, keeps_space: bool, special: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer, kept between tasks."""
    return Encoder(path, keeps_space, special)


@functools.cache
def vocabulary(path: str) -> int:
    """How many ids a tokenizer has."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def forget() -> None:
    """Gives back what a worker holds for tokenizers, when it turns to other work."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


class _Pieces:
    """Ids of pieces; a piece of a tokenizer that keeps spaces may begin with one, and other tokenizers lower-case.

    Words are remembered without the marks after them and, where case does not matter, in lower case.
    """

    def __init__(self, tokenizer, keeps_space: bool):
        self._tokenizer, self._keeps_space, self._most = tokenizer, keeps_space, CACHE_PIECES[keeps_space]
        self._model = tokenizer.model
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {"": b""}

    def __getitem__(self, piece: str) -> bytes:
        found = self._known.get(piece)
        if found is not None:
            return found
        lead = " " if self._keeps_space and piece[:1] == " " else ""
        plain = _PLAIN.fullmatch(piece, len(lead))
        if plain is None:
            return self._remember(piece, None, lead)
        word, marks = plain.groups()
        key = lead + word if self._keeps_space else word.lower()
        found = self._known.get(key) or self._remember(key, word, lead)
        if not marks:
            return found
        tail = self._marks.get(marks)
        if tail is None:
            tail = self._whole(marks)
            if len(self._marks) < 10_000:
                self._marks[marks] = tail
        return found + tail

    def many(self, pieces: pa.Array) -> list[bytes]:
        """Ids of different pieces; plain words among them take the shortest way."""
        simple = pc.match_substring_regex(pieces, r"\A ?[A-Za-zÀ-ÖØ-öø-ÿ]+\z" if self._keeps_space else r"\A[a-z]+\z").to_pylist()
        words, older, tokenize, keeps_space = pieces.to_pylist(), self._older, self._model.tokenize, self._keeps_space
        found = list(map(self._known.get, words))
        for k, ids in enumerate(found):
            if ids is None:
                word = words[k]
                if not simple[k]:
                    ids = self[word]
                else:
                    ids = older.get(word)
                    if ids is None:
                        ids = array("I", [t.id for t in tokenize(_letters(word) if keeps_space else word)]).tobytes()
                    self._known[word] = ids
                found[k] = ids
        if len(self._known) >= self._most:
            self._older, self._known = self._known, {}
        return found

    def _whole(self, piece: str) -> bytes:
        return np.array(self._tokenizer.encode(piece, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _remember(self, key: str, word: str | None, lead: str) -> bytes:
        if len(self._known) >= self._most:
            self._older, self._known = self._known, {}
        found = self._older.get(key)
        if found is None:
            if word is None:
                found = self._whole(key)
            else:
                word = word if self._keeps_space else key
                found = array("I", [t.id for t in self._model.tokenize(_letters(lead + word))]).tobytes()
        self._known[key] = found
        return found
