"""Secret scan: base rules, and a character convolutional network over every other candidate and its context."""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import forget

# The base rules.
ASSIGN = re.compile(r"""(?a:(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")

#: A candidate: a run of characters that secrets are made of, with a letter and a digit in it.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-][A-Za-z0-9+/_.=-]{14,}[A-Za-z0-9+/_=-]")
_MIXED = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

# The network's window: so many characters before the candidate, of its start, of its end and after it.
BEFORE, HEAD, TAIL, AFTER = 24, 24, 16, 8
WINDOW = BEFORE + HEAD + TAIL + AFTER
_EMBED, _WIDTH, _FILTERS = 8, 5, 24
_CODES = np.full(256, 97, dtype=np.int64)
_CODES[32:128] = np.arange(96)
_PAD, _SYMBOLS = 96, 98


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base rules' findings, sorted; code points, end exclusive."""
    found = []
    low = text.lower() if text.isascii() else text.casefold()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that may be secrets and that no base finding touches (taken, sorted). Shorter runs and runs of letters or of digits alone never reach the network: most words of prose are such."""
    starts = [a for a, _, _ in taken]
    reach = list(itertools.accumulate((b for *_, b in taken), max))  # the furthest end among those that start first
    out = []
    for m in CANDIDATE.finditer(text):
        before = bisect.bisect_left(starts, m.end())
        if not (before and reach[before - 1] > m.start()) and _MIXED.match(m[0]):
            out.append(m.span())
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """The candidate's window as symbol numbers."""
    middle = start + (end - start) // 2
    parts = ((text[max(0, start - BEFORE) : start], BEFORE, True), (text[start : min(end, start + HEAD)], HEAD, False), (text[max(middle, end - TAIL) : end], TAIL, True), (text[end : end + AFTER], AFTER, False))
    out = []
    for part, size, right in parts:
        codes = _CODES[np.frombuffer(part.encode("latin-1", "replace"), dtype=np.uint8)]
        pad = np.full(size - len(codes), _PAD)
        out += [pad, codes] if right else [codes, pad]
    return np.concatenate(out)


class Network:
    """Embedding, one convolution, the maximum over positions of each of the four parts, one logistic unit; Platt-scaled."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embed = draw.normal(0, 0.3, (_SYMBOLS, _EMBED))
        self.filters = draw.normal(0, 1 / np.sqrt(_EMBED * _WIDTH), (_WIDTH * _EMBED, _FILTERS))
        self.shift = np.zeros(_FILTERS)
        self.out = draw.normal(0, 0.1, 4 * _FILTERS)
        self.bias = np.zeros(1)
        self.platt = (1.0, 0.0)
        self.threshold = 0.5

    _PARTS = np.cumsum([0, BEFORE, HEAD, TAIL, AFTER])

    def _forward(self, x: np.ndarray):
        padded = np.pad(x, ((0, 0), (_WIDTH // 2, _WIDTH // 2)), constant_values=_PAD)
        seen = np.lib.stride_tricks.sliding_window_view(padded, _WIDTH, axis=1)
        patch = self.embed[seen].reshape(len(x), x.shape[1], -1)
        raw = np.maximum(patch @ self.filters + self.shift, 0)
        best = np.stack([a + raw[:, a:b].argmax(1) for a, b in zip(self._PARTS[:-1], self._PARTS[1:])], 1)
        pooled = np.take_along_axis(raw, best, 1).reshape(len(x), -1)
        return seen, patch, best, pooled, pooled @ self.out + self.bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x) + b, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the logistic loss."""
        draw, names = np.random.default_rng(seed), ("embed", "filters", "shift", "out", "bias")
        first, second, step = ({n: np.zeros_like(getattr(self, n)) for n in names} for _ in range(2)), None, 0
        first, second = first
        for _ in range(epochs):
            for rows in np.array_split(draw.permutation(len(x)), max(1, len(x) // 128)):
                seen, patch, best, pooled, logit = self._forward(x[rows])
                error = (1 / (1 + np.exp(-logit)) - y[rows]) / len(rows)
                d_pooled = (error[:, None] * self.out * (pooled > 0)).reshape(len(rows), 4, _FILTERS)
                at = np.arange(len(rows))[:, None, None], best, np.arange(_FILTERS)[None, None, :]
                chosen = patch[at[0], at[1]]  # rows, 4, filters, width * embed
                grads = {"out": pooled.T @ error, "bias": error.sum(keepdims=True), "shift": d_pooled.sum((0, 1)), "filters": np.einsum("rpfk,rpf->kf", chosen, d_pooled)}
                d_patch = d_pooled[..., None] * self.filters.T[None, None]
                grads["embed"] = np.zeros_like(self.embed)
                symbols = seen[at[0], at[1]]  # rows, 4, filters, width
                np.add.at(grads["embed"], symbols.reshape(-1), d_patch.reshape(-1, _EMBED))
                step += 1
                for n, g in grads.items():
                    first[n] = 0.9 * first[n] + 0.1 * g
                    second[n] = 0.999 * second[n] + 0.001 * g * g
                    setattr(self, n, getattr(self, n) - rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8))

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out findings; the threshold is the largest that still finds `recall` of the secrets there."""
        logit, (a, b) = self.logits(x), (1.0, 0.0)
        up, down = y.sum(), (1 - y).sum()
        soft = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
        for _ in range(50):  # Newton's method
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -50, 50)))
            g = np.array([((p - soft) * logit).sum(), (p - soft).sum()])
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * logit * logit).sum(), (w * logit).sum()], [(w * logit).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            a, b = np.array([a, b]) - np.linalg.solve(h, g)
        self.platt = (float(a), float(b))
        secrets = np.sort(self.probability(x[y > 0]))
        self.threshold = float(min(0.5, secrets[int((1 - recall) * len(secrets))])) if len(secrets) else 0.5


# How secrets and harmless runs look and what stands around them, for the labelled findings.
_SECRET_LEADS = ("key: ", "API key is ", "auth=", "Authorization: Bearer ", "bearer ", "credential: ", "access_key = \"", "private_key=", "client_secret_value ", "pwd is ", "pass: ", "login with ", "export KEY=", "signing key ", "session=", "jwt ", "webhook ", "conn=", "AccountKey=", "x-api-key ", "")
_SECRET_HEADS = ("", "", "", "", "sk_live_", "pk_live_", "ghp_", "xoxb-", "AIza", "eyJhbGciOi", "SG.", "glpat-", "npm_", "sk-", "hf_", "rk_live_", "AKIA", "ASIA")
_PLAIN_LEADS = ("see ", "the file ", "visit ", "at ", "from ", "page ", "item ", "call ", "version ", "commit message ", "order ", "on ", "img src ", "mail ", "by ", "(", "of ", "")
_PLAIN_NAMES = ("report", "invoice", "chapter", "section", "image", "summary", "release", "archive", "draft", "notes", "photo", "module", "server", "client", "index", "figure", "license", "version")
_B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_findings(n: int = 6000, seed: int = 11) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label): made-up findings, half of them secrets; the default training set.

    Harmless ones are what the rules of a scanner meet in prose: host names, addresses, paths, file names, UUIDs,
    dates, identifiers, hyphenated words with numbers, product codes.
    """
    draw = random.Random(seed)
    filler = lambda: " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(0, 6)))
    word = lambda: "".join(draw.choice("etaoinshrdlucmfwypvbgk") for _ in range(draw.randint(3, 10)))
    out = []
    while len(out) < n:
        label = len(out) % 2
        if label:
            alphabet = draw.choice((_B62, _B62, _B62 + "+/", _B62 + "-_", "0123456789ABCDEF", _B62[:26] + "234567"))
            value = draw.choice(_SECRET_HEADS) + "".join(draw.choice(alphabet) for _ in range(draw.randint(20, 64))) + draw.choice(("", "", "", "=", "=="))
            lead = draw.choice(_SECRET_LEADS)
        else:
            value = draw.choice((
                lambda: f"{word()}.{draw.randint(1, 99)}-mail{draw.randint(1, 9)}.example.{draw.choice(('com', 'org', 'net'))}",
                lambda: f"{word()}{draw.randint(1, 9)}.{word()}.{draw.choice(('com', 'org', 'io', 'net'))}/{word()}/{draw.randint(1, 9999)}",
                lambda: f"/{word()}/{word()}{draw.randint(0, 99)}/{draw.choice(_PLAIN_NAMES)}_{draw.randint(1, 2030)}.{draw.choice(('pdf', 'txt', 'html', 'png', 'csv'))}",
                lambda: "-".join("".join(draw.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12)),
                lambda: f"20{draw.randint(10, 30)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}T{draw.randint(0, 23):02}-{draw.randint(0, 59):02}Z",
                lambda: f"{draw.choice(_PLAIN_NAMES)}_{word()}_{word()}_{draw.randint(1, 999)}",
                lambda: f"{draw.choice(_PLAIN_NAMES)}-{word()}-{word()}-{draw.randint(1, 2030)}",
                lambda: f"{word()}{word()}{draw.randint(1, 99)}={word()}",
                lambda: f"{word()}.{word()}.{draw.randint(0, 20)}.{draw.randint(0, 20)}.{draw.randint(0, 20)}",
                lambda: f"{draw.choice('ABCDEFGH')}{draw.choice('ABCDEFGH')}-{draw.randint(1000, 99999)}-{draw.randint(1000, 99999)}-{draw.choice('XYZ')}",
                lambda: (word() + word() + word() + word()).upper()[:16] + str(draw.randint(1, 99)),
                lambda: f"{word()}-{word()}{draw.randint(1, 9)}-----{word()}",
            ))()
            lead = draw.choice(_PLAIN_LEADS)
        before = f"{filler()} {lead}"
        text = before + value + draw.choice((" ", "\n", '" ', ". ", ", ", ")", "")) + filler()
        end = len(before) + len(value)
        if len(value) >= 16 and _MIXED.match(value):
            out.append((text, len(before), end, label))
    return out


def train(findings: list[tuple[str, int, int, int]], recall: float = 0.97, seed: int = 7) -> Network:
    """Fits on four of five findings, calibrates on the fifth; threshold: the largest with that recall, at most 0.5."""
    x = np.stack([encode(t, a, b) for t, a, b, _ in findings])
    y = np.array([float(label) for *_, label in findings])
    held = np.arange(len(x)) // 2 % 5 == 4
    network = Network(seed)
    network.fit(x[~held], y[~held])
    network.calibrate(x[held], y[held], recall)
    return network


@functools.cache
def default_network() -> Network:
    return train(labelled_findings())


def scan_text(text: str, network: Network) -> list[tuple[int, str, int]]:
    return scan_texts([text], network)[0]


def scan_texts(texts: list[str | None], network: Network) -> list[list[tuple[int, str, int]]]:
    """For each text its findings (start, kind, end), by start, then kind as in KINDS, the network's (`cnn`) last."""
    found = [base_spans(t or "") for t in texts]
    asked = [(k, a, b) for k, t in enumerate(texts) if t for a, b in candidates(t, found[k])]
    if asked:
        p = network.probability(np.stack([encode(texts[k], a, b) for k, a, b in asked]))
        for (k, a, b), hit in zip(asked, p >= network.threshold):
            if hit:
                found[k].append((a, 3, b))
    names = (*KINDS, "cnn")
    return [[(a, names[kind], b) for a, kind, b in sorted(spans)] for spans in found]


def _scan(network: Network):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column(1).to_pylist()
            rows = []
            for at in range(0, len(texts), 256):
                rows += scan_texts(texts[at : at + 256], network)
            spans = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in r] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([frame.column(0), spans], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id and spans, an array of (start, kind, end), one row per row of docs.

    Offsets count code points, end exclusive. Kinds: assign, access and hex are the base rules', cnn the network's.
    Spans are sorted by start, then kind in that order. A null or empty text has none; a null doc_id stays null;
    repeated rows give repeated results; other columns are not read. No text is cut, whatever its length.
    """
    kept = docs.select(F.col("doc_id").cast("long"), "text")
    return kept.mapInArrow(_scan(network or default_network()), "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def _digest(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for frame in frames:
        rows = [[(s["start"], s["kind"], s["end"]) for s in r] for r in frame.column(1).to_pylist()]
        base = [[s for s in r if s[1] in KINDS] for r in rows]
        text = lambda r: ",".join(f"{k}:{a}:{b}" for a, k, b in r)
        count = [pa.array([sum(s[1] == k for s in r) for r in base], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays(
            [frame.column(0), *count, pa.array([hashlib.sha256(text(r).encode()).hexdigest() for r in base]), pa.array([text(r) for r in rows])],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def digest(found: DataFrame) -> DataFrame:
    """Counts, a hash of the base findings and all findings as text, from what `scan` returns."""
    return found.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _redact(network: Network):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for frame in frames:
            at = frame.schema.get_field_index("text")
            texts = frame.column(at).to_pylist()
            for k, (text, spans) in enumerate(zip(texts, scan_texts(texts, network))):
                if spans:
                    out, done = [], 0
                    for a, _, b in spans:
                        if a >= done:
                            out += [text[done:a], "[SECRET]"]
                        done = max(done, b)
                    texts[k] = "".join(out) + text[done:]
            yield frame.set_column(at, frame.schema.field(at).name, pa.array(texts, frame.schema.field(at).type))

    return run


def redact(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """docs with every finding in text replaced by [SECRET]; overlapping findings become one. Other columns stay as they are."""
    return docs.mapInArrow(_redact(network or default_network()), docs.schema)
