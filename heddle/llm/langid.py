"""Language ID by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of `span` bytes; in each, a forward and a backward recurrent layer with an
update gate (h' = h + z * (tanh(c) - h)) run over all bytes, and a softmax over both states labels every
position. A document's probabilities are the mean over all its positions. The network is trained in
numpy by backpropagation through time, with Adam, on windows from a bounded sample of labelled
documents: `max_docs` for each language, drawn by a hash over the whole training fold. Prediction reads
every byte of every text.

Edge cases: a null text or one without a letter is `und` with score 0; without labelled rows all texts
are `und`; null languages are not learned; repeated rows each get a row; an empty table gives an empty
result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle.llm import common

UNKNOWN = "und"
HIDDEN = 8
SPAN = 64
#: Training documents for each language, and windows for each training step.
MAX_DOCS = 300
#: Characters of a training document, at most; all texts are labelled whole.
MAX_CHARS = 200_000
BATCH = 512
STEPS = 300
#: What a kept document's language must get of it.
HALF = 0.5
#: Windows that are run side by side.
SIDE = 4096


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Network:
    """Weights in rows of features; a column is a window.

    x: (2, 2 * hidden, 256) what a byte adds to [gate; candidate] of each direction, with biases
    u: (2, 2 * hidden, hidden) what the state adds; v: (2, langs, hidden); b: (langs, 1)
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.seen: np.ndarray | None = None  # pairs of bytes in the training documents
        self.x = rng.normal(0, 0.3, (2, 2 * hidden, 256)).astype(np.float32)
        self.u = rng.normal(0, 0.4 / np.sqrt(hidden), (2, 2 * hidden, hidden)).astype(np.float32)
        self.v = rng.normal(0, 0.5 / np.sqrt(hidden), (2, len(langs), hidden)).astype(np.float32)
        self.b = np.zeros((len(langs), 1), dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.x, self.u, self.v, self.b]

    def states(self, w: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Logits (span, langs, windows) of windows w (span, windows) of bytes; the steps' values if keep.

        The gate rows of x and u are halved here: sigmoid(a) = (1 + tanh(a / 2)) / 2, so that one tanh does both.
        """
        span, n = w.shape
        k = self.hidden
        logits = np.empty((span, len(self.langs), n), dtype=np.float32)
        steps = []
        half = np.ones((2 * k, 1), dtype=np.float32)
        half[:k] = 0.5
        for way in (0, 1):
            x, u, v = self.x[way] * half, self.u[way] * half, self.v[way]
            h = np.zeros((k, n), dtype=np.float32)
            a, m = np.empty((2 * k, n), dtype=np.float32), np.empty((2 * k, n), dtype=np.float32)
            z = np.empty((k, n), dtype=np.float32)
            for t in range(span) if way == 0 else range(span - 1, -1, -1):
                np.take(x, w[t], axis=1, out=a, mode="clip")
                np.matmul(u, h, out=m)
                a += m
                np.tanh(a, out=a)
                np.add(a[:k], 1, out=z)
                z *= 0.5
                if keep:
                    steps.append((way, t, h.copy(), z.copy(), a[k:].copy()))
                c = a[k:]
                c -= h
                c *= z
                h += c
                if way == 0:
                    np.matmul(v, h, out=logits[t])
                else:
                    logits[t] += v @ h
        logits += self.b
        return logits, steps

    def positions(self, w: np.ndarray) -> np.ndarray:
        """Probabilities (span, langs, windows) of every position."""
        p, _ = self.states(w)
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(1, keepdims=True)
        return p

    def gradient(self, w: np.ndarray, y: np.ndarray, used: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over the used positions (span, windows) of windows labelled y, and its gradient."""
        k = self.hidden
        logits, steps = self.states(w, keep=True)
        p = logits - logits.max(1, keepdims=True)
        p = np.exp(p)
        p /= p.sum(1, keepdims=True)
        n = used.sum()
        cols = np.arange(w.shape[1])
        loss = float(-(np.log(p[:, y, cols] + 1e-9) * used).sum() / n)
        d = p
        d[:, y, cols] -= 1
        d *= (used / n)[:, None, :]
        gx, gu, gv = np.zeros_like(self.x), np.zeros_like(self.u), np.zeros_like(self.v)
        gb = d.sum((0, 2))[:, None].astype(np.float32)
        back = np.zeros((k, w.shape[1]), dtype=np.float32)
        last = None
        onehot = np.zeros((256, w.shape[1]), dtype=np.float32)
        for way, t, h, z, c in reversed(steps):
            if way != last:
                back[:] = 0
                last = way
            new = h + z * (c - h)
            gv[way] += d[t] @ new.T
            back += self.v[way].T @ d[t]
            da = np.concatenate([back * (c - h) * z * (1 - z), back * z * (1 - c * c)])
            gu[way] += da @ h.T
            onehot[:] = 0
            onehot[w[t], cols] = 1
            gx[way] += da @ onehot.T
            back = back * (1 - z) + self.u[way].T @ da
        return loss, [gx, gu, gv, gb]


def _windows(raw: bytes, span: int) -> np.ndarray:
    """(windows, span) of bytes; the last is filled up with spaces."""
    n = -(-len(raw) // span)
    return np.frombuffer(raw.ljust(n * span), dtype=np.uint8).reshape(n, span)


def train(texts: list[str], langs: list[str], hidden: int = HIDDEN, span: int = SPAN, steps: int = STEPS, batch: int = BATCH, seed: int = 42) -> Network:
    """Fits a network; each step draws languages evenly, then their windows."""
    names = sorted(set(langs))
    net = Network(names, hidden, seed)
    rng = np.random.default_rng(seed)
    pool = [[] for _ in names]
    for text, lang in zip(texts, langs, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        if raw:
            pool[names.index(lang)].append((raw, _windows(raw, span)))
    stacks = [np.concatenate([w for _, w in p]) if p else np.zeros((0, span), np.uint8) for p in pool]
    have = [i for i, s in enumerate(stacks) if len(s)]
    mean = [np.zeros_like(w) for w in net.weights()]
    square = [np.zeros_like(w) for w in net.weights()]
    for step in range(1, steps + 1):
        y = rng.choice(have, batch) if have else np.zeros(0, int)
        if not len(y):
            break
        w = np.stack([stacks[i][rng.integers(len(stacks[i]))] for i in y]).T
        used = np.cumsum((w != 32)[::-1], 0)[::-1] > 0  # not the filling
        _, grads = net.gradient(np.ascontiguousarray(w), y, used.astype(np.float32))
        rate = 0.02 * min(1, step / 20) * (0.5 + 0.5 * np.cos(np.pi * step / (steps + 1))) + 1e-4
        for p, g, m, s in zip(net.weights(), grads, mean, square, strict=True):
            np.clip(g, -1, 1, out=g)
            m += 0.1 * (g - m)
            s += 0.005 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.995**step)) + 1e-8)
    return net


def probabilities(net: Network, texts: list[str], span: int = SPAN, side: int = SIDE) -> np.ndarray:
    """(texts, langs): the mean over each text's positions; empty texts get zeros."""
    out = np.zeros((len(texts), len(net.langs)))
    sizes = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    count: list[np.ndarray] = []
    waiting = 0

    def run() -> None:
        nonlocal waiting
        w = np.concatenate(held)
        own, n = np.concatenate(owner), np.concatenate(count)
        for lo in range(0, len(w), side):
            p = net.positions(np.ascontiguousarray(w[lo : lo + side].T))
            m = n[lo : lo + side]
            total = p.sum(0) if (m == span).all() else np.where((np.arange(span)[:, None] < m)[:, None, :], p, 0).sum(0)
            np.add.at(out, own[lo : lo + side], total.T)
        held.clear(), owner.clear(), count.clear()
        waiting = 0

    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        if not raw:
            continue
        sizes[i] = len(raw)
        w = _windows(raw, span)
        for lo in range(0, len(w), side):
            part = w[lo : lo + side]
            held.append(part)
            owner.append(np.full(len(part), i))
            n = np.full(len(part), span)
            if lo + side >= len(w):
                n[-1] = len(raw) - (len(w) - 1) * span
            count.append(n)
            waiting += len(part)
            if waiting >= side:
                run()
    if waiting:
        run()
    return out / np.maximum(sizes, 1)[:, None]


def sample(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(text, lang) of at most max_docs training documents of each language, of at most max_chars each, by a hash of their ids."""
    d = docs.where((common.fold_of(F.col("doc_id")) != 0) & F.col("lang").isNotNull() & (F.length("text") <= max_chars))
    sizes = d.groupBy("lang").count().withColumn("part", F.least(F.lit(1.0), F.lit(3.0 * max_docs) / F.col("count")))
    h = F.xxhash64(F.lit(5), F.col("doc_id"))
    drawn = d.select("doc_id", "lang").join(F.broadcast(sizes), "lang").withColumn("h", h)  # a row for each language
    drawn = drawn.where(F.shiftrightunsigned("h", 32) < F.col("part") * float(1 << 32))
    w = Window.partitionBy("lang").orderBy("h", "doc_id")  # some 3 * max_docs rows each
    drawn = drawn.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max_docs).select("doc_id", "lang")
    return d.join(F.broadcast(drawn.distinct()), ["doc_id", "lang"]).select("doc_id", "text", "lang")


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Network | None:
    """A network for the languages of docs (doc_id, text, lang), None if there are none."""
    rows = sorted(sample(docs, max_docs).collect(), key=lambda r: (r.lang, r.doc_id, r.text))
    if not rows:
        return None
    net = train([r.text for r in rows], [r.lang for r in rows])
    net.seen = np.zeros((256, 256), dtype=bool)
    for r in rows:
        raw = _lowered(r.text)
        net.seen[raw[:-1], raw[1:]] = True
    return net


def _lowered(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), dtype=np.uint8)


def familiar(net: Network, text: str) -> float:
    """The share of the text's pairs of bytes, A-Z as a-z, that training documents have."""
    raw = _lowered(text)
    return float(net.seen[raw[:-1], raw[1:]].mean()) if net.seen is not None and len(raw) > 1 else 1.0


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if has_letter(t) else "" for t in b.column(2).to_pylist()]
            if net is None:
                best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                p = probabilities(net, texts)
                at = p.argmax(1) if len(p) else []
                best = [net.langs[k] if t else UNKNOWN for t, k in zip(texts, at, strict=True)]
                score = np.minimum(p.max(1), 1.0) if len(p) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col("doc_id").cast("long"), (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string"))
    return common.map_arrow(d, run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network | None, least: float = HALF) -> DataFrame:
    """The rows of docs whose text has a letter and a language of at least the given probability, with all their columns.

    Without a network, as where no row has a language, nothing is known against a text with a letter. The network knows no language but those it learned, so texts of other scripts get theirs by chance: at least
    the same share of a text's pairs of bytes must occur in training documents.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if has_letter(t) else "" for t in b.column(at).to_pylist()]
            if net is None:
                yield b.filter(pa.array([bool(t) for t in texts], pa.bool_()))
            elif texts:
                p = probabilities(net, texts).max(1)
                yield b.filter(pa.array([bool(t) and x >= least - 1e-6 and familiar(net, t) >= least for t, x in zip(texts, p, strict=True)], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)


def identify(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    return predict(docs, fit(docs, max_docs))
