"""Near-duplicate documents by min-max hashing (operator 8).

Of each permutation of the shingles both the smallest and the largest value are
kept, so 64 hash evaluations give a signature of 128. Bands of four values
bring documents together; links are then confirmed on the full sets.

Size does not matter for the shape of the plan. Equal sets are one class first.
Within a band's bucket every class is compared with one (a star), that which
shares the most buckets with others, the likely original of a group of copies;
that joins the bulk of any large group. Buckets that hold several
components after that are settled without listing their pairs: their classes
are joined on the rarest shingles of each set (prefix filter), on which any two
sets of the similarity asked for must meet, and only across components.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, pieces, rows_by, small_batches, table, written
from .graph import components
from .wordscan import U, mix, sequences, words

PERMUTATIONS = 64
BAND = 4
#: Partners of one set that are confirmed together, against one copy of it.
CHUNK = 64

_SEEDS = mix(np.arange(1, PERMUTATIONS + 1, dtype=U) * U(0x9E3779B97F4A7C15))[:, None]
_FACTORS = mix(_SEEDS) | U(1)


def shingle_sets(texts: pa.Array, width: int, family: int = 0) -> list[np.ndarray]:
    """Of each text the distinct fingerprints of its runs of width words, sorted."""
    w = words(texts, lower=True)
    prefix = sequences(w.prints(family), family)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        at = np.arange(a, b - width + 1) if b - a >= width else np.arange(a, min(a + 1, b))
        out.append(np.unique(prefix.of(at, at + min(width, b - a))))
    return out


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a non-empty set under each permutation."""
    low = np.full(PERMUTATIONS, np.iinfo(U).max, dtype=U)
    high = np.zeros(PERMUTATIONS, dtype=U)
    for k in range(0, len(shingles), 4096):
        x = (shingles[None, k : k + 4096] ^ _SEEDS) * _FACTORS
        x ^= x >> U(32)
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return low, high


def bands(shingles: np.ndarray) -> np.ndarray:
    """One key a band: the minima and maxima of two permutations, and the band's number."""
    values = np.stack(min_max(shingles), axis=1).reshape(-1, BAND)
    key = np.arange(len(values), dtype=U)
    for c in range(BAND):
        key = mix(key + values[:, c])
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, k1, k2, bands): set size, 128-bit fingerprint of the set, band keys."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets, again = (shingle_sets(column(piece, "text"), width, family) for family in (0, 1))
                # the digest is over both families, and a set is as large as the family that tells more shingles apart says
                held = [blake2b(s.tobytes() + t.tobytes(), digest_size=16).digest() for s, t in zip(sets, again)]
                keys = np.frombuffer(b"".join(held), dtype=np.int64).reshape(-1, 2)
                keyed = [bands(s) if len(s) else None for s in sets]
                cols = [column(piece, "doc_id"), [max(len(s), len(t)) for s, t in zip(sets, again)], keys[:, 0], keys[:, 1], keyed]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(x), len(y)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of pairs (a, b) with 100 * intersection >= percent * union on full sets.

    Pairs of one a are dealt in chunks; a chunk gets the text of a once and
    then the texts of its partners, in a sorted stream, so memory holds one
    set at a time however many pairs there are. Sets are compared by two
    families of fingerprints, and either must say so.
    """
    small_batches(pairs.sparkSession)
    chunked = written(
        pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.greatest(F.lit(1), F.ceil(F.col("partners") / CHUNK))).alias("chunk")), "pairs"
    )
    heads = chunked.groupBy("a", "chunk").agg(F.lit(None).cast("bigint").alias("b"))
    wanted = heads.select("a", "chunk", "b", F.col("a").alias("id")).union(chunked.select("a", "chunk", "b", F.col("b").alias("id")))
    rows = written(wanted, "wanted").join(texts, "id")
    parts = max(8, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("a", "chunk", "b", "text").repartition(parts, "a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, head = None, []
        for batch in batches:
            for piece in pieces(batch, "text"):
                keep = []
                sets = zip(*(shingle_sets(column(piece, "text"), width, family) for family in (0, 1)))
                for a, c, b, s in zip(*(column(piece, n).to_pylist() for n in ("a", "chunk", "b")), sets):
                    if b is None:
                        of, head = (a, c), (head if of == (a, c) else []) + [s]
                        continue
                    for h in head:
                        if all(alike(x, y, percent) for x, y in zip(h, s)):
                            keep.append((a, b))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in keep], pa.int64()) for i in (0, 1)], schema=schema)

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def with_partners(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), each with the number of partners of its a."""
    distinct = written(pairs.distinct(), "pairs")
    # counted before, so that the join exchanges plain rows and a row of a with very many partners can be split
    return distinct.join(written(distinct.groupBy("a").agg(F.count("*").alias("partners")), "partners"), "a")


def prefixes(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(rep, key, left): of each set the n - ceil(percent * n / 100) + 1 shingles rarest among members,
    with the set's size (n) and how many of its shingles are not rarer (left)."""
    small_batches(members.sparkSession)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sets = shingle_sets(column(piece, "text"), width)
                size = [len(s) for s in sets]
                ids, rows = (np.repeat(np.asarray(column(piece, c)), size) for c in ("id", "row"))
                flat = np.concatenate(sets).view(np.int64) if sets else []
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, rows, flat)], names=["rep", "row", "shingle"])

    named = texts.withColumn("row", F.xxhash64("text"))
    each = written(named.join(members.select(F.col("rep").alias("id")), "id", "left_semi").mapInArrow(explode, "rep bigint, row bigint, shingle bigint"), "shingles")
    common = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(written(common, "common"), "shingle", "left").select("rep", "row", "shingle", F.coalesce("df", F.lit(1)).alias("df"))
    # rows of one id are sets of their own, and equal rows of it one set
    sets = ranked.groupBy("rep", "row").agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("s"))
    size = F.size("s")
    take = size - F.ceil(size * percent / 100).cast("int") + 1
    each = sets.select("rep", size.alias("n"), F.posexplode(F.slice("s", 1, take)).alias("at", "e")).where("e.df > 1")
    return each.select("rep", F.col("e.shingle").alias("key"), "n", (F.col("n") - F.col("at")).alias("left"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Words are runs of characters other than space and \\x09-\\x0D, A-Z lowered.
    A text with fewer words than width is one shingle; a null text or one
    without words has none and is linked with nothing. Rows of one doc_id are
    rows of their own that share a node: it is linked if any of them is. A row
    whose doc_id is null is in no link and stays (component_id null, kept).
    component_id is the smallest doc_id reachable by links. An empty table
    gives an empty result; other columns are ignored.
    """
    base = pick(docs, doc_id="bigint", text="string")
    sig = written(signatures(base, width), "signatures")
    live = sig.where("n > 0 and doc_id is not null")
    classes = written(live.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = live.join(classes.withColumnRenamed("rep", "doc_id"), ["k1", "k2", "doc_id"]).select(F.col("doc_id").alias("rep"), "bands")
    banded = reps.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y").select("key", "size")
    members = written(banded.join(written(buckets, "buckets"), "key"), "members")
    # the centre of a group of copies shares the most buckets with the most others
    shared = written(members.groupBy("rep").agg(F.sum("size").alias("shared")), "shared")
    centres = members.join(shared, "rep").groupBy("key").agg(F.max(F.struct("shared", (-F.col("rep")).alias("minus"))).alias("m"))
    members = written(members.join(written(centres.select("key", (-F.col("m.minus")).alias("root")), "centres"), "key").select("key", "rep", "root"), "members")
    texts = base.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("id"), "text")
    texts = written(texts, "texts")
    links = written(confirmed(with_partners(members.where("rep <> root").select(F.col("root").alias("a"), F.col("rep").alias("b"))), texts, width, percent), "links")
    label = components(links)

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    now = written(labelled(members.select("key", "rep")), "members")
    open_keys = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    unsettled = written(now.join(written(open_keys, "open"), "key").select("rep").distinct(), "unsettled")
    if not unsettled.isEmpty():
        meets = written(labelled(prefixes(unsettled, texts, width, percent)), "meets")
        sizes = meets.groupBy("key", "component").agg(F.count("*").alias("size"))
        main = sizes.groupBy("key").agg(F.max(F.struct("size", "component")).alias("m"), F.count("*").alias("parts")).where("parts > 1")
        main = written(main.select("key", F.col("m.component").alias("main")), "main")
        at = written(meets.join(main, "key"), "at")
        few = at.where("component <> main").select("key", F.col("rep").alias("b"), F.col("component").alias("other"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
        # at the first shingle that two sets share, what is left of either bounds their intersection
        reach = f"least(left, left_b) * {100 + percent} >= {percent} * (n + n_b)"
        across = few.join(at, "key").where(f"other <> component and (component = main or rep < b) and {reach}")
        more = confirmed(with_partners(across.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b"))), texts, width, percent)
        label = components(written(links.union(more), "links"))
    found = sig.join(classes, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    out = written(found, "found").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op8_min_max_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are the smallest of their group, with all their columns."""
    return rows_by(docs, near_duplicates(docs).where("kept").select("doc_id"), "left_semi")


QUERIES = {"op8_min_max_dedup": op8_min_max_dedup}
#: Exact for small tables; pairs are only built between documents that share a shingle.
ORACLES = {
    "op8_min_max_dedup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select doc_id, case when len(w)=0 then [] when len(w)=1 then [w[1]] else list_distinct([w[i]||' '||w[i+1] for i in range(1,len(w))]) end s from w),
n as (select doc_id, len(s)::bigint n from s),
e as (select doc_id, unnest(s) x from s),
r as (select doc_id, x, row_number() over (partition by doc_id order by c, x) k from e join (select x, count(*) c from e group by x) using (x)),
p as (select r.doc_id, x, n from r join n using (doc_id) where k <= n - ceil(n*80/100.0) + 1),
cand as (select distinct a.doc_id a, b.doc_id b, a.n na, b.n nb from p a join p b on a.x=b.x and a.doc_id<b.doc_id and 100*least(a.n,b.n)>=80*greatest(a.n,b.n)),
links as (select a, b from (select c.a, c.b, c.na, c.nb, len(list_intersect(sa.s, sb.s)) i from cand c join s sa on sa.doc_id=c.a join s sb on sb.doc_id=c.b) where 100*i>=80*(na+nb-i)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id a, doc_id b from documents union select reach.a, both_ways.b from reach join both_ways on reach.b=both_ways.a),
c as (select a doc_id, min(b) component_id from reach group by a)
select n.doc_id, n.n n_shingles, c.component_id, n.doc_id=c.component_id kept from n join c using (doc_id)
"""
}
