"""Removal of long repeated spans by a compacted De Bruijn graph (operator 2).

Token k-mers of SPAN words are the edges of the graph; a repeated edge is a
window of words that starts in two places. Listing every edge would shuffle
one row a word, so edges are compacted first: neighbouring windows whose least
run of K words (by a hash of the words alone) is the same one, their anchor,
are one path. A path is keyed by its anchor and a 128-bit cryptographic digest
of its words, read at their source coordinates.

  1. anchors are counted with partial aggregation; an anchor that occurs once
     leads no repeated window and is gone;
  2. an anchor with one path does not branch: if that path occurs twice, all
     its windows repeat, and if not, none;
  3. where paths branch, one occurrence of each path is read again at its
     source coordinates and the words of its single windows are digested and
     compared across paths;
  4. the repeated windows of each text are joined back by the path's key, found
     again by its words, and the words that they cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, pieces, small_batches, table, written
from .wordscan import U, mix, sequences, words


#: Bytes of text whose arrays a worker holds in one go, but for one longer text.
PIECE = 1 << 18


def least_of(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each run of width values, and the place of the leftmost of them, by doubling."""
    have, m, at = 1, x, np.arange(len(x))
    while have < width:
        step = min(have, width - have)
        keep = len(m) - step
        right = m[step:] < m[:keep]
        m, at = np.where(right, m[step:], m[:keep]), np.where(right, at[step:], at[:keep])
        have += step
    return m, at


def digests(raw: memoryview, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of a 128-bit digest of each range of bytes."""
    held = b"".join([blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())])
    both = np.frombuffer(held, dtype="<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


class Paths:
    """Of each text of a batch its runs of windows with one anchor: start .. stop (exclusive)."""

    def __init__(self, texts: pa.Array, span: int):
        self.words = w = words(texts)
        self.span, k, n = span, anchor_words(span), len(w.start)
        self.flat, self.begin = w.spaced()
        none = np.zeros(0, dtype=np.int64)
        self.start = self.stop = self.text = self.anchor = none
        if n >= span:
            at = np.arange(n - k + 1)
            grams = sequences(w.prints()).of(at, at + k)
            _, place = least_of(grams, span - k + 1)
            size = np.diff(w.first)
            text = np.repeat(np.arange(len(size)), size)[: n - span + 1]
            windows = np.flatnonzero(np.arange(n - span + 1) + span <= w.first[1:][text])
            if len(windows):
                place = place[windows]
                new = np.concatenate([[True], (place[1:] != place[:-1]) | (np.diff(windows) > 1)])
                self.start, self.stop = windows[new], windows[np.append(new[1:], True)] + 1
                self.text, self.anchor = text[self.start], grams[place[new]].view(np.int64)
        self.key1, self.key2 = self.digest(self.start, self.stop + span - 1)

    def digest(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words start .. end (exclusive)."""
        return digests(memoryview(self.flat), self.begin[start], self.begin[end])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(path, n): one path of each key of each text, and how often that text holds it."""
        order = np.lexsort((self.key2, self.key1, self.text))
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.logical_or.reduce([x[order[1:]] != x[order[:-1]] for x in (self.text, self.key1, self.key2)])
        return order[new], np.diff(np.append(np.flatnonzero(new), len(order)))

    def find(self, text: np.ndarray, key1: np.ndarray, key2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, path): for every asked (text, key1, key2) the paths of that text with that key.

        Asked once each, no more than there are paths; a key asked as often as its text holds it would give the square of that.
        """
        name = lambda t, x, y: mix(mix(x.view(U) + t.astype(U) * U(0x9E3779B97F4A7C15)) ^ y.view(U))
        have, asked = name(self.text, self.key1, self.key2), name(text, key1, key2)
        order = np.argsort(have, kind="stable")
        lo, hi = np.searchsorted(have[order], asked, "left"), np.searchsorted(have[order], asked, "right")
        size = hi - lo
        which = np.repeat(np.arange(len(asked)), size)
        path = order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        same = (self.text[path] == text[which]) & (self.key1[path] == key1[which]) & (self.key2[path] == key2[which])
        return which[same], path[same]


def flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The list that each value is in, and the values, of an array of lists; null: empty."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(size)), size), lists.flatten()


def numbers(values: pa.Array, name: str) -> np.ndarray:
    return np.array(pc.struct_field(values, name).to_numpy(zero_copy_only=False), dtype=np.int64)


def anchor_words(span: int) -> int:
    """Words of an anchor: few, so that paths are long; enough that ordinary text rarely repeats one."""
    if span < 4:
        raise ValueError("a span has four words at least")
    return max(1, span // 4)


def path_rows(docs: DataFrame, span: int) -> DataFrame:
    """(row, anchor, key1, key2, n) for every path of docs (row, text) that a text holds n times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                p = Paths(column(piece, "text"), span)
                i, n = p.distinct()
                cols = [column(piece, "row").take(pa.array(p.text[i])), *(pa.array(c, pa.int64()) for c in (p.anchor[i], p.key1[i], p.key2[i], n))]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "anchor", "key1", "key2", "n"])

    return docs.mapInArrow(run, "row bigint, anchor bigint, key1 bigint, key2 bigint, n bigint")


def window_rows(asked: DataFrame, span: int) -> DataFrame:
    """(key1, key2, off, w1, w2) for each window of the paths asked for: (text, want array<struct<key1, key2>>)."""
    names = ["key1", "key2", "off", "w1", "w2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                p = Paths(column(piece, "text"), span)
                text, want = flat(column(piece, "want"))
                which, path = p.find(text, numbers(want, "key1"), numbers(want, "key2"))
                i = path[np.unique(which, return_index=True)[1]]
                size = p.stop[i] - p.start[i]
                off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                i = np.repeat(i, size)
                at = p.start[i] + off
                cols = [p.key1[i], p.key2[i], off, *p.digest(at, at + span)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return asked.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def kept_words(flagged: DataFrame, span: int, texts: bool) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text, hits array<struct<key1, key2, offs array<bigint>>>), and kept if texts.

    offs null: every window of the path repeats; hits null: the text has no repeated window. A text's hits name a key once.
    """
    schema = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(schema + [("kept", pa.string())] * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                text, hits = flat(column(piece, "hits"))
                if len(hits):
                    p = Paths(column(piece, "text"), span)
                    w, spaced, begin = p.words, p.flat, p.begin
                    edge = np.zeros(len(w.start) + 1, dtype=np.int64)
                    which, path = p.find(text, numbers(hits, "key1"), numbers(hits, "key2"))
                    offs = pc.struct_field(hits, "offs")
                    whole = offs.is_null().to_numpy(zero_copy_only=False)[which]
                    np.add.at(edge, p.start[path[whole]], 1)
                    np.add.at(edge, p.stop[path[whole]] + span - 1, -1)
                    inner, off = flat(offs.take(pa.array(which[~whole])))
                    at = p.start[path[~whole]][inner] + np.array(off.to_numpy(zero_copy_only=False), dtype=np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + span, -1)
                    stays = np.cumsum(edge)[:-1] == 0
                else:
                    w = words(column(piece, "text"))
                    spaced, begin = w.spaced()
                    stays = np.ones(len(w.start), dtype=bool)
                if not stays.all():
                    spaced = spaced[np.repeat(stays, np.diff(begin))]
                held = np.concatenate([[0], np.cumsum(stays)])[w.first]
                ends = np.concatenate([[0], np.cumsum(np.diff(begin) * stays)])[w.first]
                raw, out = spaced.tobytes(), []
                n_words = np.diff(w.first)
                for doc, n, left, a, b in zip(column(piece, "doc_id").to_pylist(), n_words.tolist(), np.diff(held).tolist(), ends[:-1].tolist(), ends[1:].tolist()):
                    kept = raw[a : max(a, b - 1)]
                    out.append((doc, n, n - left, sha256(kept).hexdigest(), *([kept.decode()] if texts else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return flagged.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept string" * texts)


def repeated_paths(docs: DataFrame, span: int) -> DataFrame:
    """(row, hits): for each text with a repeated window its paths that hold one, and where."""
    found = written(path_rows(docs, span), "paths")
    twice = written(found.groupBy("anchor").agg(F.sum("n").alias("total")).where("total > 1").select("anchor"), "twice")
    occurrences = written(found.join(twice, "anchor", "left_semi"), "occurrences")
    keyed = written(occurrences.groupBy("anchor", "key1", "key2").agg(F.sum("n").alias("n"), F.min("row").alias("row")), "keyed")
    branches = written(keyed.groupBy("anchor").agg(F.count("*").alias("paths")), "anchors")
    paths = written(keyed.join(branches, "anchor"), "graph")
    whole = paths.where("n > 1").select("key1", "key2", F.lit(None).cast("array<bigint>").alias("offs"))
    source = paths.where("paths > 1").groupBy("row").agg(F.collect_list(F.struct("key1", "key2")).alias("want"))
    texts = docs.join(written(source, "source"), "row").select("text", "want")
    windows = written(window_rows(texts, span), "windows")
    # a window of a path that occurs twice is repeated anyway; one of another path is if it meets any second one
    counted = windows.join(paths.where("paths > 1").select("key1", "key2", "n"), ["key1", "key2"])
    again = written(counted.groupBy("w1", "w2").agg(F.sum("n").alias("times")).where("times > 1").select("w1", "w2"), "again")
    single = paths.where("paths > 1 and n = 1").select("key1", "key2")
    partly = windows.join(single, ["key1", "key2"], "left_semi").join(again, ["w1", "w2"], "left_semi")
    partly = partly.groupBy("key1", "key2").agg(F.collect_list("off").alias("offs"))
    hits = written(whole.unionByName(partly), "hits")
    # rows that share a name share its hits, so these are listed once and not once for each such row
    met = occurrences.select("row", "key1", "key2").distinct().join(hits, ["key1", "key2"]).select("row", F.struct("key1", "key2", "offs").alias("hit"))
    return met.groupBy("row").agg(F.collect_list("hit").alias("hits"))


def remove_repeats(docs: DataFrame, span: int = 35, texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of docs (doc_id, text); without kept unless texts.

    A word is a run of characters other than space and \\x09-\\x0D, unchanged.
    Every word covered by a window of span consecutive words of one text whose
    word sequence starts at another place too, in the same text or another,
    is removed; windows are judged on the input. kept: the words that are
    left, joined by one space. A null text has no words. Rows that repeat a
    doc_id, null ones included, are texts of their own, so a repeated row of
    span words or more loses them all. An empty table gives an empty result;
    other columns are ignored.
    """
    small_batches(docs.sparkSession)
    base = pick(docs, doc_id="bigint", text="string")
    # a row's name; should two rows share one, paths are still found by their own keys
    named = base.withColumn("row", F.xxhash64("doc_id", "text"))
    hits = written(repeated_paths(named, span), "found")
    return kept_words(named.join(hits, "row", "left").select("doc_id", "text", "hits"), span, texts)


def op2_debruijn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), 35, texts=False)


QUERIES = {"op2_debruijn_spans": op2_debruijn_spans}
ORACLES = {
    "op2_debruijn_spans": r"""
with w as (select doc_id, regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+') w from documents),
g as (select doc_id, s, array_to_string(w[s:s+34], ' ') x from (select doc_id, w, unnest(range(1, len(w)-33)) s from w)),
r as (select doc_id, s from g where x in (select x from g group by x having count(*) > 1)),
gone as (select doc_id, list_distinct(flatten(list(range(s, s+35)))) z from r group by doc_id),
k as (select w.doc_id, len(w.w)::bigint n_words, coalesce(len(z),0)::bigint n_removed, [w.w[i] for i in range(1, len(w.w)+1) if z is null or not list_contains(z, i)] kept from w left join gone using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from k
"""
}
