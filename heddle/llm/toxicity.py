"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine over block-max inverted indexes.

Terms are words, runs of letters of any length. The vocabulary has every word that two labelled examples or
more hold (a word of one example says nothing about a class); no number of terms is set. A word outside it is
read as its longest beginning in it, so that inflected forms share terms. A term weighs
(1 + log of its count) times its inverse document frequency, taken over all documents, times a gain: how
surely its rate differs between the classes, (x / (x + c))**2 for its chi-squared x, where c is what the best
of so many words without a tie to the class would reach, and FLOOR at least. So a few telling words in a
long text count for more than all its ordinary ones, and a text without telling words still has neighbours.

Examples are a bounded sample of labelled rows: `max_each` of class 1, of class 0 with telling words (gain
over TELLING), and of class 0 without. Their inverted index is cut into blocks of examples with each term's
largest weight in each block; blocks whose bound can't reach the k-th best similarity are passed over, so the
k nearest are exact. Votes are weighted by distance and by the kinds' sampling rates, and calibrated by
isotonic regression of each example's vote by its neighbours. The neighbours are the evidence.

Edge cases: texts that are null, empty or hold no word of the vocabulary get the known rate of class 1;
equal similarities go by the smaller example id; labels of null class or doc_id teach nothing, a document
labelled both ways counts as class 1; texts over `max_chars` aren't drawn as examples (they are scored whole);
without examples of both classes every score is the known rate, 0 without any; repeated rows each get a row;
an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import common

#: Labelled examples of each kind at most, and characters of one.
MAX_EACH = 800
MAX_CHARS = 100_000
K = 15
BLOCK = 64
#: The least gain of a term, and that of a telling one.
FLOOR, TELLING = 0.01, 0.25
#: A term that more than this share of the examples hold has its weights in a matrix, not in lists.
COMMON = 0.25
#: Letters of a word's beginning that may stand for it, at least.
STEM = 6
WORD = re.compile(r"[^\W\d_]+")

Vector = tuple[np.ndarray, np.ndarray]


def words(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def vocabulary(counts: list[Counter], labels: np.ndarray, chance: float = 0.01) -> tuple[Terms, np.ndarray]:
    """Words that two examples or more hold, and their gains."""
    hits = (Counter(), Counter())
    for c, y in zip(counts, labels, strict=True):
        hits[int(y)].update(c.keys())
    terms = sorted(w for w in hits[0].keys() | hits[1].keys() if hits[0][w] + hits[1][w] > 1)
    n0, n1 = int((labels == 0).sum()), int((labels == 1).sum())
    b, a = (np.array([h[t] for t in terms], dtype=float) for h in hits)
    share = (a + b) / (n0 + n1)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = ((a / n1 - share) ** 2 * n1 + (b / n0 - share) ** 2 * n0) / (share * (1 - share))
    chi = np.nan_to_num(chi, posinf=0.0)
    by_chance = 2 * np.log((len(hits[0].keys() | hits[1].keys()) + 1) / chance)
    return Terms(terms), np.maximum((chi / (chi + by_chance)) ** 2, FLOOR)


class Terms(dict):
    """Terms by word; a word outside the vocabulary is read as its longest beginning in it, of STEM letters or more."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        self.stems = {w[:STEM] for w in words}

    def __reduce__(self) -> tuple:
        return Terms, (list(self),)

    def counts(self, text: str | None) -> dict[int, int]:
        """Counts by term of words(text)."""
        out: dict[int, int] = {}
        of, stems = self.get, self.stems
        for w, n in words(text).items():
            i = of(w)
            if i is None and w[:STEM] in stems:
                i = next((of(w[:at]) for at in range(len(w) - 1, STEM - 1, -1) if w[:at] in self), None)
            if i is not None:
                out[i] = out.get(i, 0) + n
        return out


class BlockMaxIndex:
    """Inverted lists in blocks of examples; a cell is a term's list in a block, with its largest weight.

    What common terms, whose lists would hold most examples, add to the similarities is summed from a matrix for all
    examples at once; a block's bound is the largest such sum in it and the largest weights of the other terms.
    """

    def __init__(self, vectors: list[Vector], ids: np.ndarray, n_terms: int, block: int = BLOCK):
        # examples of like vectors share blocks, so that bounds are tight
        lead = [(int(t[np.argmax(w)]) if len(t) else -1, int(i)) for (t, w), i in zip(vectors, ids, strict=True)]
        order = sorted(range(len(ids)), key=lambda i: lead[i])
        self.ids = ids[order]
        self.place = {int(i): p for p, i in enumerate(self.ids)}
        self.n, self.block, self.blocks = len(order), block, -(-len(order) // block)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]) if order else np.zeros(0)
        example = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order])
        often = np.bincount(term, minlength=n_terms) > max(COMMON * self.n, 8)
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.matrix = np.zeros((int(often.sum()), self.n))
        here = often[term]
        self.matrix[self.row[term[here]], example[here]] = weight[here]
        term, weight, example = term[~here], weight[~here], example[~here]
        by = np.lexsort((example, term))
        self.weight, self.example = weight[by], example[by].astype(np.int32)
        cells, start = np.unique(term[by] * self.blocks + self.example // block, return_index=True)
        self.start = np.r_[start, len(by)]
        self.most = np.maximum.reduceat(self.weight, start) if len(by) else np.zeros(0)
        self.at = (cells % max(1, self.blocks)).astype(np.int32)
        self.first = np.searchsorted(cells, np.arange(n_terms + 1) * self.blocks)

    def _spread(self, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The positions lo, lo + 1, ... of n each."""
        return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())

    def _scores(self, cell: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Similarities of all examples, over the given cells."""
        n = self.start[cell + 1] - self.start[cell]
        at = self._spread(self.start[cell], n)
        return np.bincount(self.example[at], self.weight[at] * np.repeat(w, n), minlength=self.n)

    def common(self, vectors: list[Vector]) -> np.ndarray:
        """What common terms add to the similarity of each vector with each example."""
        out = np.zeros((len(vectors), len(self.matrix)))
        for i, (term, w) in enumerate(vectors):
            row = self.row[term]
            out[i, row[row >= 0]] = w[row >= 0]
        return out @ self.matrix

    def nearest(self, v: Vector, k: int = K, but: int | None = None, s: np.ndarray | None = None) -> Vector:
        """Places and similarities of the k nearest with similarity over 0; but: a place left out; s: common([v])[0], if known."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not len(v[0]) or not self.n:
            return none
        s = self.common([v])[0] if s is None else s
        row = self.row[v[0]]
        term, w = v[0][row < 0], v[1][row < 0]
        n = self.first[term + 1] - self.first[term]
        cell, w = self._spread(self.first[term], n), np.repeat(w, n)
        block = self.at[cell]
        bound = np.maximum.reduceat(s, np.arange(0, self.n, self.block)) + np.bincount(block, self.most[cell] * w, minlength=self.blocks)
        # blocks of the highest bounds first; the k-th best in them is what the others must reach
        lead = np.zeros(self.blocks, dtype=bool)
        lead[np.argsort(-bound, kind="stable")[: max(2, 2 * k // self.block + 1)]] = True
        now = lead[block]
        s += self._scores(cell[now], w[now])
        if but is not None:
            s[but] = 0
        kth = np.partition(s, -k)[-k] if self.n > k else 0.0  # blocks passed over count with a part of theirs, at most
        rest = ((bound >= kth - 1e-9) & ~lead)[block]
        if rest.any():
            s += self._scores(cell[rest], w[rest])
            if but is not None:
                s[but] = 0
        hit = np.flatnonzero(s > max(0.0, kth - 1e-9) if self.n > k else s > 0)
        best = hit[np.lexsort((self.ids[hit], -np.round(s[hit], 12)))][:k]
        return best, np.minimum(s[best], 1.0)


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted least-squares rising function of x."""
    order = np.argsort(x, kind="stable")
    stack: list[list[float]] = []
    for i in order:
        stack.append([x[i] * w[i], y[i] * w[i], w[i]])
        while len(stack) > 1 and stack[-2][1] * stack[-1][2] >= stack[-1][1] * stack[-2][2]:
            top = stack.pop()
            stack[-1] = [a + b for a, b in zip(stack[-1], top, strict=True)]
    return np.array([a / c for a, _, c in stack]), np.array([b / c for _, b, c in stack])


@dataclass
class Model:
    terms: Terms
    scale: np.ndarray
    index: BlockMaxIndex | None
    label: np.ndarray
    mass: np.ndarray
    rate: float
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def weigh(self, text: str | None) -> Vector:
        """The unit vector as (terms, weights)."""
        held = self.terms.counts(text)
        if not held:
            return np.zeros(0, np.int64), np.zeros(0)
        term, n = np.fromiter(held.keys(), np.int64, len(held)), np.fromiter(held.values(), np.float64, len(held))
        order = np.argsort(term)
        term = term[order]
        w = (1 + np.log(n[order])) * self.scale[term]
        return term, w / np.sqrt((w * w).sum())

    def vote(self, places: np.ndarray, near: np.ndarray) -> float:
        """The weighted share of class 1; the known rate weighs as much as a neighbour without likeness."""
        w = self.mass[places] / (1.05 - near) ** 2
        return float(((w * self.label[places]).sum() + self.rate * self.mass.mean()) / (w.sum() + self.mass.mean()))

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[int, int, float]]]]:
        """Each text's score and its evidence: (example id, label, similarity), nearest first."""
        for at in range(0, len(texts), 64):
            vectors = [self.weigh(t) for t in texts[at : at + 64]]
            common = self.index.common(vectors) if self.index is not None else [None] * len(vectors)
            for v, s in zip(vectors, common, strict=True):
                places, near = self.index.nearest(v, s=s) if self.index is not None else (np.zeros(0, np.int64), np.zeros(0))
                if not len(places):
                    yield self.rate, []
                    continue
                raw = self.vote(places, near)
                p = float(np.interp(raw, *self.knots)) if self.knots is not None else raw
                yield min(max(p, 0.001), 0.999), [(int(self.index.ids[i]), int(self.label[i]), float(x)) for i, x in zip(places, near, strict=True)]


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the training fold."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.where(common.fold_of(F.col("doc_id")) != 0).join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")


def _drawn(known: DataFrame, most: int) -> DataFrame:
    """At most so many rows, by a hash of their ids."""
    return known.orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(most)


def _texts(docs: DataFrame, picked: DataFrame, max_chars: int) -> list:
    """Rows (doc_id, text, toxic) of the picked ids, a few thousand at most; of repeated ids the least text."""
    fit_for = docs.where(F.length("text") <= max_chars)
    rows = fit_for.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return sorted((r for r in rows if r.text is not None), key=lambda r: r.doc_id)


def _counted(docs: DataFrame, terms: Terms, telling: set[int]) -> DataFrame:
    """Over all docs, rows (doc_id, term, n): n documents hold the term (-1: n documents in all); for documents that hold a telling word, a row of their id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, n = np.zeros(len(terms) + 1, dtype=np.int64), 0
        for b in batches:
            holds = []
            for t in b.column(1):
                n += 1
                own = terms.counts(t.as_py()).keys()
                hits[list(own)] += 1
                holds.append(not telling.isdisjoint(own))
            ids = b.column(0).filter(pa.array(holds, pa.bool_())).drop_null()
            yield pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int64())], ["doc_id", "term", "n"])
        hits[-1] = n
        some = np.flatnonzero(hits)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array(np.where(some == len(terms), -1, some)), pa.array(hits[some])], ["doc_id", "term", "n"])

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, term long, n long")


def fit(docs: DataFrame, labels: DataFrame, max_each: int = MAX_EACH, max_chars: int = MAX_CHARS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic)."""
    taught = common.stored(labelled(docs, labels), "labelled")
    sizes = {r.toxic: r["count"] for r in taught.groupBy("toxic").count().collect()}
    total = sum(sizes.values())
    rate = sizes.get(1, 0) / total if total else 0.0
    rows = _texts(docs, _drawn(taught.where("toxic = 0"), max_each).union(_drawn(taught.where("toxic = 1"), max_each)), max_chars) if len(sizes) > 1 else []
    y = np.array([r.toxic for r in rows], dtype=int)
    if len(set(y.tolist())) < 2:
        return Model(Terms([]), np.zeros(0), None, np.zeros(0), np.zeros(0), rate)
    terms, gain = vocabulary([words(r.text) for r in rows], y)
    telling = set(np.flatnonzero(gain > TELLING).tolist())
    # one pass of all documents: document frequencies, and which hold telling words
    found = common.stored(_counted(docs, terms, telling), "counted")
    frequency = np.zeros(len(terms) + 1)
    for r in found.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term
        frequency[r.term] = r.n
    n, frequency = frequency[-1], frequency[:-1]
    # class 0 rows that hold telling words are few and say the most: they are drawn anew, as a class of their own
    hard = common.stored(taught.where("toxic = 0").join(found.where("term is null").select("doc_id").distinct(), "doc_id", "left_semi"), "hard")
    n_hard = hard.count()
    keep = [bool(r.toxic) or telling.isdisjoint(terms.counts(r.text)) for r in rows]
    more = _texts(docs, _drawn(hard, max_each), max_chars)
    rows = [r for r, k in zip(rows, keep, strict=True) if k]
    group = np.array([r.toxic for r in rows] + [2] * len(more))
    y = (group == 1).astype(int)
    whole = {0: sizes[0] - n_hard, 1: sizes[1], 2: n_hard}
    model = Model(terms, (np.log((1 + n) / (1 + frequency)) + 1) * gain, None, np.zeros(len(y)), np.zeros(len(y)), rate)
    vectors = [model.weigh(r.text) for r in rows + more]
    ids = np.array([r.doc_id for r in rows + more], dtype=np.int64)
    model.index = BlockMaxIndex(vectors, ids, len(terms))
    at = np.array([model.index.place[int(i)] for i in ids])
    m = np.array([whole[k] / (group == k).sum() for k in group.tolist()])
    model.label[at], model.mass[at] = y, m
    votes, keep = [], []
    for i, v in enumerate(vectors):
        places, near = model.index.nearest(v, but=int(at[i]))
        if len(places):
            votes.append(model.vote(places, near))
            keep.append(i)
    if len(set(y[keep].tolist())) == 2:
        model.knots = isotonic(np.array(votes), y[keep].astype(float), m[keep])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence), a row for each row of docs (doc_id, text).

    evidence: the three nearest examples as id:label:similarity, separated by spaces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = list(model.scores(b.column(2).to_pylist()))
            p = np.array([x[0] for x in done], dtype=np.float64)
            why = [" ".join(f"{i}:{y}:{s:.4f}" for i, y, s in x[1][:3]) for x in done]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(why, pa.string())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    d = docs.select(F.col("doc_id").cast("long"), (common.fold_of(F.col("doc_id")) == 0).alias("held_out"), F.col("text").cast("string"))
    return common.map_arrow(d, run, "doc_id long, held_out boolean, score double, predicted int, evidence string")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text is not predicted toxic, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([x[0] < 0.5 for x in model.scores(b.column(at).to_pylist())], pa.bool_()))

    return common.map_arrow(docs, run, docs.schema)
