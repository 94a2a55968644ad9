"""Benchmark decontamination by CGK embedding and bit sampling (operator 4).

A CGK walk goes through a string by random steps: at step j it writes down the
byte it stands on and moves on by one or stays, by a coin that depends on j and
that byte alone. Two strings walked with one set of coins fall into step again
after an edit, so a small edit distance becomes a small Hamming distance
between what the walks wrote. Sampling a few positions of the walk as a key
brings windows of the texts and of the items into one bucket; several
repetitions, each with its own coins and positions, reach the target recall.

Windows of an item's size begin at every word (and at places chosen by content
inside very long words), in texts and in items alike, so an item has as many
chances as words. Keys are sampled from the first steps of the walk, where few
edits can lie. What meets is checked by bit-parallel search, of the next bytes
first, and verified by exact edit distance on the item. Items of a few bytes
have no window to sample; they are found by the pieces that a copy must keep.

Items are taken in bounded blocks, each broadcast in turn to one scan of the
documents.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, pieces, rows_by, small_batches, table
from .wordscan import U, Words, words

SIMILARITY = 0.8
#: For items of at least so many bytes: steps of the walk, sampled positions, repetitions.
WALKS = ((48, 32, 10, 8), (12, 8, 4, 12))
#: Where the blocks of eight bytes lie that are compared first, by how much they may be shifted, and the share of their bytes that must be there.
BESIDE, SHIFT, FOUND = (12, 20), 3, 0.6
#: Bytes after the place where an item and a text met that are compared then, and the share of them that may be edited.
HEADS = ((32, 0.25, 1), (64, 0.22, 2))
#: Words longer than this have windows inside: one in LONG_RATE of their places.
LONG, LONG_RATE = 16, 8
#: Items of one broadcast block.
BLOCK = 2000
#: Windows that walk, and candidates that are compared, in one go: their arrays stay in the cache.
CHUNK = 1 << 15

#: Bytes of text whose windows are looked at in one go, but for one longer text.
PIECE = 1 << 19

_ODD = U(0x9E3779B97F4A7C15)
_LOW7 = U(0x7F7F7F7F7F7F7F7F)


def best_distance(item: bytes, text: bytes, most: int) -> int:
    """Least edit distance of item to any substring of text, or most + 1 if it is over most (bit-parallel)."""
    m = len(item)
    mask: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item):
        mask[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, best = full, 0, m, m
    for c in text:
        eq = mask.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & full, plus & x
        if up & top:
            now += 1
        elif down & top:
            now -= 1
        up, down = (up << 1) & full, (down << 1) & full
        x = eq | minus
        plus, minus = (down | ~(x | up)) & full, up & x
        best = min(best, now)
    return min(best, most + 1)


class Patterns:
    """Byte strings of at most the bits of a word, each with the edits allowed, to be looked for side by side."""

    def __init__(self, texts: list[bytes], most: list[int], code: np.ndarray, kind: type):
        self.kind, self.size, self.most = kind, np.array([len(t) for t in texts], dtype=np.int64), np.array(most, dtype=np.int64)
        self.codes = int(code.max(initial=0)) + 1
        self.mask = np.zeros((len(texts), self.codes), dtype=kind)
        for k, t in enumerate(texts):
            for i, c in enumerate(t):
                self.mask[k, code[c]] |= kind(1 << i)
        self.mask = self.mask.reshape(-1)

    def distance(self, which: np.ndarray, coded: np.ndarray, place: np.ndarray, spread: np.ndarray | int) -> np.ndarray:
        """The least edit distance of each pattern to what lies from its place on, over its size and spread bytes more (bit-parallel)."""
        kind, one = self.kind, self.kind(1)
        top = (self.size[which] - 1).astype(kind)
        plus, minus = np.full(len(which), ~kind(0)), np.zeros(len(which), dtype=kind)
        now = self.size[which].astype(np.int8)
        steps = int((self.size[which] + spread).max(initial=0))
        best, row = now.copy(), which * self.codes
        for j in range(steps):
            eq = self.mask.take(row + coded.take(place + j, mode="clip"))
            x = (((eq & plus) + plus) ^ plus) | eq | minus
            up, down = minus | ~(x | plus), plus & x
            now += (up >> top & one).astype(np.int8)
            now -= (down >> top & one).astype(np.int8)
            up, down = up << one, down << one
            x = eq | minus
            plus, minus = down | ~(x | up), up & x
            np.minimum(best, now, out=best)
        return best


def octets(data: np.ndarray) -> np.ndarray:
    """At each byte but the last 7, it and the next seven as a number, the first byte lowest: a view."""
    return np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,))


def joined(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts as their words, each followed by a space or, at the end of a text, a line feed; where each text begins; where windows do."""
    data, begin = w.spaced()
    last = w.first[1:][w.first[1:] > w.first[:-1]]
    data[begin[last] - 1] = 10
    at, far = begin[:-1], np.flatnonzero(w.end - w.start > LONG)
    if len(far):
        inside = np.concatenate([np.arange(a + 1, b) for a, b in zip(begin[far].tolist(), (begin[far + 1] - 1).tolist())])
        pair = data[inside - 1].astype(np.uint32) * 257 + data[inside]
        at = np.sort(np.concatenate([at, inside[(pair * np.uint32(2654435761) >> np.uint32(16)) % LONG_RATE == 0]]))
    return data, begin[w.first], at


class Walk:
    """Coins and sampled positions of one repetition."""

    def __init__(self, steps: int, samples: int, seed: list[int]):
        rng = np.random.default_rng(seed)
        self.coins = rng.integers(0, 2, (steps, 256)).astype(np.int32)
        self.sampled = np.zeros(steps, dtype=bool)
        self.sampled[rng.choice(steps, samples, replace=False)] = True
        self.steps = int(np.flatnonzero(self.sampled)[-1]) + 1

    def keys(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each window, and the last place that it depends on."""
        place, key = at.astype(np.int32), np.zeros(len(at), dtype=U)
        for j in range(self.steps):
            byte = data.take(place)
            if self.sampled[j]:
                key ^= byte
                key *= _ODD
                key ^= key >> U(29)
            if j + 1 < self.steps:
                place += self.coins[j].take(byte)
        return key, place


class Buckets:
    """Item windows by their keys in one repetition: a bitmap in front of a sorted list."""

    def __init__(self, walk: Walk, data: np.ndarray, at: np.ndarray, end: np.ndarray):
        self.walk = walk
        key, last = walk.keys(data, at)
        mine = np.flatnonzero(last < end)  # the walk stays inside the item
        order = mine[np.argsort(key[mine], kind="stable")]
        self.window, self.key = order, key[order]
        self.shift = U(64 - max(10, (len(order) * 32).bit_length()))
        self.any = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.any[(self.key >> self.shift).view(np.int64)] = True

    def meet(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, item window) of all that share a key."""
        key, _ = self.walk.keys(data, at)
        hit = np.flatnonzero(self.any.take((key >> self.shift).view(np.int64)))
        key = key[hit]
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = high - low
        return np.repeat(at[hit], n), self.window[np.arange(n.sum()) + np.repeat(low - (np.cumsum(n) - n), n)]


class Items:
    """A block of items: their texts, and the windows of each by its walks."""

    def __init__(self, rows: list[tuple[int, str | None]], similarity: float):
        w = words(pa.array([t for _, t in rows], pa.string()), lower=True)
        data, first, at = joined(w)
        size = first[1:] - first[:-1] - 1  # without the line feed
        keep = np.flatnonzero(size > 0)
        self.ids, self.size = [rows[k][0] for k in keep.tolist()], size[keep]
        self.text = [data[first[k] : first[k] + size[k]].tobytes() for k in keep.tolist()]
        self.edits = (self.size * (1 - similarity) + 1e-9).astype(np.int64)
        self.code = np.zeros(256, dtype=np.int64)
        seen = sorted({c for t in self.text for c in t})
        self.code[seen] = np.arange(1, len(seen) + 1)
        item = np.searchsorted(first[keep], at, "right") - 1
        begin, end = first[keep][item], (first[keep] + self.size)[item]
        padded = np.append(data, np.zeros(256, dtype=np.uint8))
        self.item, self.offset = item, at - begin
        self.buckets: list[Buckets] = []
        above = np.inf
        for least, steps, samples, repetitions in WALKS:
            these = np.flatnonzero((self.size[item] >= least) & (self.size[item] < above)) if len(item) else item
            above = least
            for r in range(repetitions if len(these) else 0):
                b = Buckets(Walk(steps, samples, [steps, r]), padded, at[these], end[these])
                b.window = these[b.window]
                self.buckets.append(b)
        self.tiny = np.flatnonzero(self.size < above).tolist()
        number = lambda x: int.from_bytes(x, "little")
        raw = [(self.text[i], o) for i, o in zip(item.tolist(), self.offset.tolist())]
        self.beside = []
        for d in BESIDE:
            texts = [t[o + d : o + d + 8] for t, o in raw]
            self.beside.append((d, np.array([number(x) for x in texts], dtype=U), np.array([number(b"\x80" * len(x)) for x in texts], dtype=U)))
        self.lost = sum((np.bitwise_count(mask).astype(np.int64) for _, _, mask in self.beside), np.zeros(len(raw), dtype=np.int64)) * (1 - FOUND)
        # each item in stretches: what they lack adds up to no more than its edits
        held = [(i, a, t[a : a + 64]) for i, t in enumerate(self.text) for a in range(0, len(t), 64)]
        self.stretches = Patterns([x for _, _, x in held], [0] * len(held), self.code, np.uint64)
        self.stretch_at = np.array([a for _, a, _ in held], dtype=np.int64)
        self.first_stretch = np.searchsorted(np.array([i for i, _, _ in held], dtype=np.int64), np.arange(len(self.text) + 1))
        self.heads = []
        for n, share, more in HEADS:
            texts = [t[o : o + n] for t, o in raw]
            self.heads.append(Patterns(texts, [int(len(x) * max(share, 1.25 * (1 - similarity))) + more for x in texts], self.code, np.uint32 if n <= 32 else np.uint64))

    def met(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where an item would begin, item) for the windows of the texts that pass the walks and the heads."""
        padded = np.append(data, np.zeros(256, dtype=np.uint8))
        coded, eight = self.code[padded], octets(padded)
        none = np.zeros(0, dtype=np.int64)
        begin, items = [none], [none]
        for a in range(0, len(at), CHUNK):
            here = at[a : a + CHUNK]
            pairs = [b.meet(padded, here) for b in self.buckets]
            place, window = (np.concatenate(c) if c else none for c in (list(zip(*pairs)) or [(), ()]))
            both = np.sort(place * len(self.item) + window)
            place, window = np.divmod(both[np.append(True, both[1:] != both[:-1])[: len(both)]], max(1, len(self.item)))
            ok = [none.astype(bool)]
            for k in range(0, len(place), CHUNK):
                ok.append(self.close(eight, place[k : k + CHUNK], window[k : k + CHUNK]))
            ok = np.concatenate(ok)
            place, window = place[ok], window[ok]
            for head in self.heads:
                ok = [none.astype(bool)]
                for k in range(0, len(place), CHUNK):
                    which = window[k : k + CHUNK]
                    ok.append(head.distance(which, coded, place[k : k + CHUNK], head.most[which]) <= head.most[which])
                ok = np.concatenate(ok)
                place, window = place[ok], window[ok]
            begin.append(place - self.offset[window])
            items.append(self.item[window])
        begin, items = np.concatenate(begin), np.concatenate(items)
        ok = [none.astype(bool)]
        for k in range(0, len(begin), 1 << 12):
            ok.append(self.least(items[k : k + (1 << 12)], coded, begin[k : k + (1 << 12)]) <= self.edits[items[k : k + (1 << 12)]])
        ok = np.concatenate(ok)
        return begin[ok], items[ok]

    def close(self, eight: np.ndarray, place: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Whether enough of a few further bytes of the item window are in the text, shifted by little."""
        lost = np.zeros(len(place), dtype=np.int64)
        for d, text, mask in self.beside:
            value, differ = text[window], mask[window]
            for s in range(-SHIFT, SHIFT + 1):
                x = eight[place + (d + s)] ^ value
                differ = differ & (((x & _LOW7) + _LOW7) | x)
            lost += np.bitwise_count(differ)
        return lost <= self.lost[window]

    def least(self, item: np.ndarray, coded: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The sum over an item's stretches of their least distances near their places: no copy there has fewer edits."""
        n = self.first_stretch[item + 1] - self.first_stretch[item]
        which = np.repeat(self.first_stretch[item] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        edits = np.repeat(self.edits[item], n)
        found = self.stretches.distance(which, coded, np.repeat(begin, n) + self.stretch_at[which] - edits, 2 * edits)
        return np.bincount(np.repeat(np.arange(len(item)), n), found, minlength=len(item))

    def small(self, raw: bytes) -> Iterator[tuple[int, int]]:
        """(item, where it would begin) of the tiny items: some piece of a copy within the edits is whole."""
        for i in self.tiny:
            t, k = self.text[i], int(self.edits[i])
            cut = [len(t) * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cut, cut[1:]):
                p = raw.find(t[a:b]) if b > a else -1
                if a == b:
                    yield from ((i, q) for q in range(len(raw) + 1))
                while p >= 0:
                    yield i, p - a
                    p = raw.find(t[a:b], p + 1)

    def pairs(self, w: Words) -> Iterator[tuple[int, int, int]]:
        """(text, item, distance) wherever a text is found to hold an item within its edits."""
        data, first, at = joined(w)
        begin, item = self.met(data, at)
        if self.tiny:
            more = list(self.small(data.tobytes()))
            begin = np.concatenate([begin, np.array([p for _, p in more], dtype=np.int64)])
            item = np.concatenate([item, np.array([i for i, _ in more], dtype=np.int64)])
        middle = np.clip(begin + self.size[item] // 2, 0, max(0, len(data) - 1))
        text = np.searchsorted(first, middle, "right") - 1
        low = np.maximum(begin - self.edits[item], first[text])
        high = np.minimum(begin + self.size[item] + self.edits[item], first[text + 1] - 1)
        spans: dict[tuple[int, int], list[list[int]]] = {}
        for k in np.lexsort((low, item, text)).tolist():
            held, a, b = spans.setdefault((int(text[k]), int(item[k])), []), int(low[k]), int(high[k])
            if held and a <= held[-1][1]:
                held[-1][1] = max(b, held[-1][1])
            else:
                held.append([a, b])
        for (t, i), held in spans.items():
            most = int(self.edits[i])
            d = min(best_distance(self.text[i], data[a:b].tobytes(), most) for a, b in held)
            if d <= most:
                yield t, i, d


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, similarity): pairs of a text and an item that it holds at that edit similarity or more.

    Every pair stated is exact; a copy close to the limit may be missed (see
    the README for the measured recall). Items under twelve bytes are found always.

    Texts and items are compared as their words, A-Z lowered, joined by one
    space; the similarity is 1 - distance / bytes of the item, over the best
    substring of the text. Null or empty items and texts are in no pair. Rows
    that repeat a doc_id or an item_id give one row for each pair of ids, with
    the best similarity; rows with a null id are in no pair. Empty tables give
    an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = pick(docs, doc_id="bigint", text="string").where("doc_id is not null and text is not null")
    stated = pick(items, item_id="bigint", text="string").where("item_id is not null and text is not null")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64())])
    empty = spark.createDataFrame([], "doc_id bigint, item_id bigint, similarity double")
    numbered = stated.distinct().orderBy("item_id", "text").toLocalIterator()
    out, held = empty, []

    def found(rows: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)
        made: list[Items] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(Items(shared.value, similarity))
            it = made[0]
            for batch in batches:
                for piece in pieces(batch, "text", PIECE):
                    ids = column(piece, "doc_id").to_pylist()
                    best: dict[tuple[int, int], float] = {}
                    for text, item, d in it.pairs(words(column(piece, "text"), lower=True)):
                        pair = (ids[text], it.ids[item])
                        best[pair] = max(best.get(pair, 0.0), 1 - d / int(it.size[item]))
                    rows = [(d, i, s) for (d, i), s in best.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)

        return base.mapInArrow(run, "doc_id bigint, item_id bigint, similarity double")

    for row in numbered:
        held.append((row["item_id"], row["text"]))
        if len(held) == block:
            out, held = out.union(found(held)), []
    if held:
        out = out.union(found(held))
    return out.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))


def op4_edit_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    return rows_by(docs, find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id"), "left_anti")


QUERIES = {"op4_edit_leaks": op4_edit_leaks}
ORACLES: dict[str, str] = {}
