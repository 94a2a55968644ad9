"""Toxicity by a subsequence string kernel machine (operator 9).

Units are words, and runs of single characters set apart by spaces, of the
letters of any script, with an edge on either side. The kernel of two units
sums over their common subsequences of ORDER letters, each with
at most GAPS letters skipped in all and weighted by DECAY for every skipped
letter on either side, so spellings with inserted or spaced-out letters keep
most of their similarity; it is divided by the root of both self-similarities,
so a unit has similarity one to itself and no more to any other. Landmarks are units that explain the sentences
labelled toxic; the Nystrom map of the kernel on them turns a unit into a
vector, on which a linear support vector machine is trained. A document's
score is that of its most toxic unit, calibrated on labelled documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, pieces, small_batches, table
from .labelled import held_out, logistic, probability, sample

#: At most so many labelled documents (clean, toxic) are learned from.
SAMPLE = (3000, 2000)
ORDER, GAPS, DECAY, LANDMARKS = 4, 2, 0.6, 96
#: A unit that is less similar than this to every landmark counts as similar to none.
FLOOR = 0.2
THRESHOLD = 0.3
#: Units of clean texts that the machine is trained on, at most: those most similar to a landmark.
HARDEST = 20000
GAPPED = [g for g in product(range(GAPS + 1), repeat=ORDER - 1) if sum(g) <= GAPS]
SENTENCE = re.compile(r"[.!?\n]+")

#: Bits of a letter's number, and the number that stands before and after a unit.
BITS, EDGE = 6, 63


def _number(c: int) -> int:
    """a-z: 1-26; every other letter of any script, in lower case: 27-62 by its code point; all else 0."""
    low = chr(c).lower()[0]
    if not low.isalpha():
        return 0
    return ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) * 0x9E3779B1 >> 7) % 36


_CODES = np.array([_number(c) for c in range(0x110000)], dtype=np.int32)


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all units in a row, the unit of each letter, and the text of each unit."""
    flat = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.array([len(t or "") + 1 for t in texts])
    doc = np.repeat(np.arange(len(texts)), lengths)[: len(flat)]
    space = (flat <= 32) | (flat == 0xA0)
    code = _CODES[flat]
    at = np.flatnonzero(~space)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins = np.concatenate([[True], np.diff(at) > 1])
    word = np.cumsum(begins) - 1
    # single characters set apart by spaces belong together
    single = np.bincount(word) == 1
    of = doc[at[begins]]
    joins = np.concatenate([[False], single[1:] & single[:-1] & (of[1:] == of[:-1])])
    unit = (np.cumsum(~joins) - 1)[word]
    has = code[at] > 0
    unit_doc = of[~joins]
    code, unit = code[at][has], unit[has]
    # an edge on either side, so that short units have subsequences too
    new = np.flatnonzero(np.diff(unit, prepend=-1, append=-1))
    if len(unit):
        new[-1] = len(unit)
        twice = np.concatenate([new[:1], np.repeat(new[1:-1], 2), new[-1:]])
        code, unit = np.insert(code, twice, EDGE), np.insert(unit, twice, unit[np.stack([new[:-1], new[1:] - 1], axis=1).ravel()])
    return code, unit, unit_doc


def features(code: np.ndarray, unit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For every pattern of gaps: the subsequences, where each begins, and their weight."""
    n = len(code)
    for gaps in GAPPED:
        steps = np.concatenate([[0], np.cumsum([g + 1 for g in gaps])])
        m = n - steps[-1]
        if m <= 0:
            continue
        value = code[:m]
        for s in steps[1:]:
            value = (value << BITS) | code[s : s + m]
        inside = np.flatnonzero(unit[:m] == unit[steps[-1] : steps[-1] + m])
        yield value[inside], inside, DECAY ** sum(gaps)


#: Self-similarity of a unit of so many letters whose subsequences all differ: no unit of that length has less.
_SELF = np.array([sum(max(0, n - ORDER + 1 - sum(g)) * DECAY ** (2 * sum(g)) for g in GAPPED) for n in range(64)])


def least_own(size: np.ndarray) -> np.ndarray:
    longest = len(_SELF) - 1
    return np.maximum(1e-9, _SELF[np.minimum(size, longest)] + (np.maximum(size, longest) - longest) * (_SELF[-1] - _SELF[-2]))


def own(code: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """Self-similarity of each of n units: equal subsequences add their weights before they are squared."""
    values, at, weights = [], [], []
    for value, inside, w in features(code, unit):
        values.append(value.astype(np.int64))
        at.append(unit[inside])
        weights.append(np.full(len(inside), w))
    if not values:
        return np.full(n, 1e-9)
    key = np.concatenate(at) << (BITS * ORDER) | np.concatenate(values)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    total = np.add.reduceat(np.concatenate(weights)[order], first) if len(first) else np.zeros(0)
    return np.maximum(1e-9, np.bincount(key[first] >> (BITS * ORDER), total * total, minlength=n))


class Kernel:
    """Similarities of units to fixed landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        code, unit, _ = letters(landmarks)
        weight: Counter = Counter()
        for value, at, w in features(code, unit):
            for v, u in zip(value.tolist(), unit[at].tolist()):
                weight[v, u] += w
        self.known = sorted({v for v, _ in weight})
        place = {v: k for k, v in enumerate(self.known)}
        self.weights = np.zeros((len(self.known), len(landmarks)))
        norm = np.sqrt(own(code, unit, len(landmarks)))
        for (v, u), w in weight.items():
            self.weights[place[v], u] += w / norm[u]
        self.most = self.weights.max(axis=1, initial=0)
        self.column: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "column": None}  # made where it is used

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units that may be as similar as FLOOR to a landmark: their number, similarities, and texts."""
        if self.column is None:
            self.column = np.full(1 << (BITS * ORDER), -1, dtype=np.int16 if len(self.known) < 1 << 15 else np.int32)
            self.column[self.known] = np.arange(len(self.known))
        code, unit, unit_doc = letters(texts)
        if not len(code):
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks))), np.zeros(0, np.int64)
        units, cols, weights = [], [], []
        for value, at, w in features(code, unit):
            c = self.column[value]
            hit = np.flatnonzero(c >= 0)
            units.append(unit[at[hit]])
            cols.append(c[hit])
            weights.append(np.full(len(hit), w))
        if not sum(map(len, units)):
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks))), np.zeros(0, np.int64)
        u, c, w = np.concatenate(units), np.concatenate(cols), np.concatenate(weights)
        size = np.bincount(unit)
        # no similarity exceeds the sum of the largest weights
        most = np.bincount(u, w * self.most[c], minlength=len(size))
        near = (most >= FLOOR * np.sqrt(least_own(size)))[u]
        u, c, w = u[near], c[near], w[near]
        if not len(u):
            return np.zeros(0, np.int64), np.zeros((0, len(self.landmarks))), np.zeros(0, np.int64)
        order = np.argsort(u, kind="stable")
        u, c, w = u[order], c[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        ids = u[first]
        k = np.zeros((len(ids), len(self.landmarks)))
        step = 1 << 14  # units at a time, so that memory stays small
        ends = np.append(first, len(u))
        for a in range(0, len(ids), step):
            b = min(len(ids), a + step)
            part = slice(ends[a], ends[b])
            k[a:b] = np.add.reduceat(self.weights[c[part]] * w[part, None], first[a:b] - first[a], axis=0)
        here = np.zeros(len(size), dtype=np.int64) - 1
        here[ids] = np.arange(len(ids))
        mine = here[unit] >= 0
        return ids, k / np.sqrt(own(code[mine], here[unit][mine], len(ids)))[:, None], unit_doc[ids]


def choose(rows: list[tuple[str, int]], most: int = LANDMARKS) -> list[str]:
    """Units that cover the toxic texts' sentences: the one that explains most texts still
    lacking two explanations comes next, among units that clean texts all but lack, as long
    as it explains one in 400."""
    clean = Counter(u for t, y in rows if not y for u in {*t.lower().split()})
    n_clean = max(1, sum(1 for _, y in rows if not y))
    holds: dict[str, list[int]] = {}
    toxic = [t for t, y in rows if y]
    for k, t in enumerate(toxic):
        for sentence in SENTENCE.split(t.lower()):
            for u in {*sentence.split()}:
                if ORDER - 1 <= len(u) <= 24 and clean[u] <= 0.002 * n_clean and (not (h := holds.setdefault(u, [])) or h[-1] != k):
                    h.append(k)
    lack = np.full(len(toxic), 2)
    least = max(3, len(toxic) // 400)
    holds = {u: h for u, h in holds.items() if len(h) >= least}
    out: list[str] = []
    while len(out) < most and holds:
        best, gain = max(((u, sum(1 for k in h if lack[k] > 0)) for u, h in holds.items()), key=lambda x: (x[1], x[0]))
        if gain < least:
            break
        lack[holds.pop(best)] -= 1
        out.append(best)
    return out


def support_vector_fit(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, classes weighted alike, by Newton steps."""
    z = np.hstack([x, np.ones((len(x), 1))])
    weight = c * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), 1e-2)
    for _ in range(rounds):
        margin = 1 - y * (z @ w)
        on = margin > 0
        grad = ridge * w - z[on].T @ (weight[on] * y[on] * margin[on])
        hess = (z[on] * weight[on][:, None]).T @ z[on] + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


class Model:
    def __init__(self, kernel: Kernel | None, direction: np.ndarray | None = None, bias: float = 0.0, fit: tuple | None = None):
        self.kernel, self.direction, self.bias, self.fit = kernel, direction, bias, fit

    def margins(self, texts: list[str | None]) -> np.ndarray:
        """Of each text the two largest margins of its units; texts without a similar unit have the bias."""
        out = np.full((len(texts), 2), self.bias)
        _, k, doc = self.kernel.rows(texts)
        if len(k):
            f = k @ self.direction + self.bias
            order = np.lexsort((-f, doc))
            d, f = doc[order], f[order]
            first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            out[d[first], 0] = np.maximum(self.bias, f[first])
            nxt = first + 1
            two = nxt[(nxt < len(d))]
            two = two[d[two] == d[two - 1]]
            out[d[two], 1] = np.maximum(self.bias, f[two])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), 0.5) if self.fit is None else probability(self.margins(texts), self.fit)


def parts(rows: list[tuple[str, int]], chars: int = 1 << 17) -> Iterator[list[tuple[str, int]]]:
    """rows in their order, in parts of about so many characters, so that the arrays of one part stay small."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def hardest(neg: list[np.ndarray]) -> np.ndarray:
    """The HARDEST rows with the largest similarities, earlier ones first among equals."""
    every = np.vstack(neg)
    return every[np.argsort(-every.max(axis=1, initial=0), kind="stable")[:HARDEST]]


def train(rows: list[tuple[str, int]]) -> Model:
    """A model of labelled texts; without a landmark every score is 0.5 and no text is predicted toxic."""
    landmarks = choose(rows)
    if not landmarks or all(y for _, y in rows):
        return Model(None)
    kernel = Kernel(landmarks)
    _, k_ll, at = kernel.rows(landmarks)
    gram = np.zeros((len(landmarks), len(landmarks)))
    gram[at] = k_ll
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    pos, neg = [], [np.zeros((0, len(landmarks)))]
    for part in parts(rows):
        _, k, doc = kernel.rows([t for t, _ in part])
        y = np.array([y for _, y in part])[doc]
        near = k.max(axis=1, initial=0)
        pos.append(k[(y == 1) & (near >= 0.8)])
        neg.append(k[(y == 0) & (near >= 0.05)])
        if sum(map(len, neg)) > 2 * HARDEST:
            neg = [hardest(neg)]
    pos, neg = np.vstack(pos), hardest(neg)
    x = np.vstack([pos, neg, np.zeros((1, len(landmarks)))]) @ root
    w, bias = support_vector_fit(x, np.concatenate([np.ones(len(pos)), -np.ones(len(neg) + 1)]))
    model = Model(kernel, root @ w, bias)
    margins = np.vstack([model.margins([t for t, _ in part]) for part in parts(rows)])
    model.fit = logistic(margins, np.array([y for _, y in rows], dtype=float))
    kernel.column = None
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text).

    Only the text is scored. A null or empty text has no unit and the score of
    a text without toxic units. Repeated rows give repeated results; an empty
    table gives none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                found = model.scores(column(piece, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array(found, pa.float64())], schema=schema)

    scored = pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", ((F.col("score") >= threshold) & F.lit(model.fit is not None)).cast("int").alias("predicted"))


def trained(spark: SparkSession, sf_dir: str) -> Model:
    return train(sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", SAMPLE))


def op9_subsequence_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), trained(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; all of them if the labels give no model."""
    small_batches(spark)
    model = trained(spark, sf_dir)
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, place, 1 << 20):
                found = model.scores(piece.column(place).to_pylist())
                yield piece.filter(pa.array((found < THRESHOLD) | (model.fit is None)))

    return docs.mapInArrow(run, docs.schema)


QUERIES = {"op9_subsequence_kernel": op9_subsequence_kernel}
ORACLES: dict[str, str] = {}
