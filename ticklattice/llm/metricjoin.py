"""Embedding near-duplicates by an exact metric range join (operator 10).

Vectors are scaled to length one, where cosine >= c is distance <= sqrt(2 - 2c).
Pivots, a bounded sample of each large group of one label, part it: a vector's
home is the cell of its nearest pivot. A partner of a vector with home i can
only live in cell j if the vector lies within the radius of the plane between
the two pivots (a form of the triangle inequality that holds for Euclidean
distance), so it is copied to just those cells. Cells join on their own: each
links its home vectors with all its vectors, cut into parts of a bounded size
that are dealt to tasks, so neither a large cell nor a large group of close
vectors meets in one task. A pair of parts is one matrix product; it gives link
counts and a spanning forest of its links, never the links themselves.

Pivots prune what has structure. Vectors that lie about evenly in many
dimensions are all nearly as far from one pivot as from another; then cells
hold most of their group and the work grows with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, pick, small_batches, table, written
from .graph import components

#: Bytes of the vectors that a cell, or a part of a large one, should hold.
CELL_BYTES = 8 << 20
#: The most pivots of one group, and of all groups (they are broadcast, so this bounds the bytes).
GROUP_PIVOTS, PIVOTS = 256, 4096
#: Vectors of a part that are multiplied with the other part in one go.
ROWS = 256
#: Cosines this close to the threshold are taken again, term by term.
NEAR = 1e-12


def vectors(rows: DataFrame) -> DataFrame:
    """(vec_id, label, k1, k2, vec): vec holds the doubles of the unscaled vector, null if it cannot link."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = column(batch, "embedding")
            flat = held.flatten()
            values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False) + 0.0  # one zero for both signs
            size = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            end = np.cumsum(size)
            labelled = column(batch, "label").is_valid().to_numpy(zero_copy_only=False)
            out = []
            for ok, a, b in zip(labelled.tolist(), (end - size).tolist(), end.tolist()):
                v = values[a:b]
                if not (ok and b > a and np.isfinite(v).all() and v.any()):
                    out.append((None, None, None))
                    continue
                raw = v.tobytes()
                k = np.frombuffer(blake2b(raw, digest_size=16).digest(), dtype=np.int64)
                out.append((int(k[0]), int(k[1]), raw))
            cols = [column(batch, "vec_id"), column(batch, "label"), *(list(zip(*out)) or [[], [], []])]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    return rows.mapInArrow(run, "vec_id bigint, label string, k1 bigint, k2 bigint, vec binary")


def scaled(raw: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(raw), dtype=float).reshape(len(raw), -1)
    return m / np.abs(m).max(axis=1, keepdims=True)


def unit(raw: list[bytes]) -> np.ndarray:
    m = scaled(raw)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cells(reps: DataFrame, pivots: dict[tuple[str, int], np.ndarray], radius: float) -> DataFrame:
    """A row for each cell that a vector is in: (label, dim, cell, home, rep, cnt, vec). A group without pivots is one cell."""
    schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("home", pa.bool_()), ("rep", pa.int64()), ("cnt", pa.int64()), ("vec", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, rep, cnt, raw = (column(batch, c).to_pylist() for c in ("label", "rep", "cnt", "vec"))
            groups: dict[tuple[str, int], list[int]] = {}
            for i, (name, r) in enumerate(zip(label, raw)):
                groups.setdefault((name, len(r) // 8), []).append(i)
            out = []
            for (name, dim), here in groups.items():
                p = pivots.get((name, dim))
                if p is None:
                    out += [(name, dim, 0, True, rep[i], cnt[i], raw[i]) for i in here]
                    continue
                d2 = np.maximum(0, 2 - 2 * unit([raw[i] for i in here]) @ p.T)
                row, home = np.arange(len(here)), d2.argmin(axis=1)
                between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d2 - d2[row, home][:, None]) / (2 * between)
                near = ~(plane > radius + 1e-9)  # pivots that coincide: always
                near[row, home] = True
                out += [(name, dim, j, j == home[k], rep[here[k]], cnt[here[k]], raw[here[k]]) for k, j in zip(*(x.tolist() for x in np.nonzero(near)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 7, schema)], schema=schema)

    return reps.mapInArrow(run, "label string, dim int, cell int, home boolean, rep bigint, cnt bigint, vec binary")


def part_links(cosine: float):
    """Of a pair of parts: link counts of the home vectors, and a forest of the links. role: 0 home, 1 other, 2 both."""
    types = {"forest": bool, "a": np.int64, "b": np.int64, "n": np.int64}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        home, other = pdf[pdf.role != 1], pdf[pdf.role != 0]
        if home.empty or other.empty:
            return pd.DataFrame({c: [] for c in types}).astype(types)
        x, y = unit(list(home.vec)), unit(list(other.vec))
        a, b, weight = home.rep.to_numpy(), other.rep.to_numpy(), other.cnt.to_numpy()
        nodes = np.unique(np.concatenate([a, b]))
        at_a, at_b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        comp, counts, forest = np.arange(len(nodes)), np.zeros(len(a), dtype=np.int64), []
        for s in range(0, len(a), ROWS):
            sim = x[s : s + ROWS] @ y.T
            for i, j in zip(*np.nonzero(np.abs(sim - cosine) < NEAR)):
                u, v = scaled([home.vec.iloc[s + i], other.vec.iloc[j]])
                sim[i, j] = u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v))
            linked = (sim >= cosine) & (a[s : s + ROWS, None] != b[None, :])
            counts[s : s + ROWS] = linked @ weight
            for i in np.flatnonzero(linked.any(axis=1)).tolist():
                met = at_b[linked[i]]
                of, own = comp[met], comp[at_a[s + i]]
                for c in np.unique(of[of != own]).tolist():
                    forest.append((a[s + i], nodes[met[np.argmax(of == c)]]))
                    comp[comp == c] = own
        f = pd.DataFrame(forest, columns=["a", "b"]).assign(forest=True, n=0)
        c = pd.DataFrame({"a": a, "b": a, "n": counts, "forest": False})[counts > 0]
        return pd.concat([f, c])[list(types)].astype(types)

    return run


def chosen_pivots(reps: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """Pivots of the groups (label, dim) that are larger than a cell, the largest first, the first vectors by a hash of them."""
    dim = (F.length("vec") / 8).cast("int")
    sizes = reps.groupBy("label", dim.alias("dim")).agg(F.count("*").alias("n")).where(F.col("n") * F.col("dim") * 8 > CELL_BYTES)
    out, left = {}, PIVOTS
    for row in sizes.orderBy(F.desc("n"), "label", "dim").limit(GROUP_PIVOTS).collect():
        k = min(GROUP_PIVOTS, left, -(-row["n"] * row["dim"] * 8 // CELL_BYTES))
        if k < 2:
            break
        first = reps.where((F.col("label") == row["label"]) & (dim == row["dim"])).select("k1", "vec").orderBy("k1").limit(k).collect()
        out[row["label"], row["dim"]] = unit([bytes(r["vec"]) for r in first])
        left -= k
    return out


def metric_links(rows: DataFrame, cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of rows (vec_id, embedding, label).

    Two rows are linked when their labels are equal and not null, their
    vectors have one length and the cosine in double precision is at least
    cosine. A vector that is null, empty, zero, or holds a null or non-finite
    component links with nothing (n_links 0, a component of its own); vectors
    are scaled by their largest component first, so no finite one is too large
    or too small. Equal
    vectors of one label are one class, so repeated rows count as links but
    are compared once. component_id is the smallest vec_id reachable. Rows of
    one vec_id count as separate vectors and share a node. An empty table
    gives an empty result; other columns are ignored.
    """
    small_batches(rows.sparkSession)
    base = pick(rows, vec_id="bigint", embedding="array<double>", label="string")
    all_rows = written(vectors(base), "vectors")
    live = all_rows.where("vec is not null and vec_id is not null")
    classes = written(live.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("cnt")), "classes")
    keyed = live.withColumnRenamed("vec_id", "rep").dropDuplicates(["label", "k1", "k2", "rep"])
    reps = written(keyed.join(classes, ["label", "k1", "k2", "rep"]).select("label", "rep", "cnt", "k1", "vec"), "reps")
    dealt = written(cells(reps.select("label", "rep", "cnt", "vec"), chosen_pivots(reps), float(np.sqrt(max(0.0, 2 - 2 * cosine)))), "cells")
    room = F.lit(CELL_BYTES) / (8 * F.col("dim"))
    sizes = dealt.groupBy("label", "dim", "cell").agg(F.count("*").alias("size"), F.sum(F.col("home").cast("int")).alias("homes"))
    sizes = written(sizes.select("label", "dim", "cell", F.ceil(F.col("homes") / room).cast("int").alias("xs"), F.ceil(F.col("size") / room).cast("int").alias("ys")), "sizes")
    placed = dealt.join(sizes, ["label", "dim", "cell"]).where("xs > 0")
    x, y = (F.pmod(F.xxhash64("rep"), F.col(c)).cast("int") for c in ("xs", "ys"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    task = lambda role, x, y: F.struct(role.alias("role"), x.alias("x"), y.alias("y"))
    as_home = F.transform(every("ys"), lambda k: task(F.when(k == y, F.lit(2)).otherwise(F.lit(0)), x, k))
    as_other = F.transform(F.filter(every("xs"), lambda k: ~F.col("home") | (k != x)), lambda k: task(F.lit(1), k, y))
    tasks = placed.select("label", "dim", "cell", "rep", "cnt", "vec", F.explode(F.when(F.col("home"), F.concat(as_home, as_other)).otherwise(as_other)).alias("t"))
    pairs = tasks.select("label", "dim", "cell", "t.x", "t.y", "t.role", "rep", "cnt", "vec")
    found = written(pairs.groupBy("label", "dim", "cell", "x", "y").applyInPandas(part_links(cosine), "forest boolean, a bigint, b bigint, n bigint"), "found")
    counts = written(found.where("not forest").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others")), "counts")
    label = components(found.where("forest").select("a", "b"))
    member = all_rows.join(classes, ["label", "k1", "k2"], "left")
    member = written(member.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("rep"), "cnt"), "members")
    out = member.join(counts, "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    links = F.when(F.col("rep").isNotNull(), F.coalesce("others", F.lit(0)) + F.col("cnt") - 1).otherwise(F.lit(0))
    return out.select("vec_id", links.cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op10_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_links(table(spark, sf_dir, "embeddings"), cosine=0.93)


QUERIES = {"op10_metric_range_join": op10_metric_range_join}
ORACLES = {
    "op10_metric_range_join": """
with recursive e as (select vec_id, label, embedding::double[] v from embeddings),
ok as (select vec_id, label, v, sqrt(list_sum([x*x for x in v])) n from e where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0),
good as (select * from ok where n > 0),
links as (select a.vec_id a, b.vec_id b from good a join good b on a.label=b.label and a.vec_id<>b.vec_id and len(a.v)=len(b.v) where list_sum([a.v[i]*b.v[i] for i in range(1,len(a.v)+1)])/(a.n*b.n) >= 0.93),
reach as (select vec_id a, vec_id b from embeddings union select reach.a, links.b from reach join links on reach.b=links.a),
c as (select a vec_id, min(b) component_id from reach group by a),
k as (select a vec_id, count(*) n_links from links group by a)
select c.vec_id, coalesce(k.n_links,0)::bigint n_links, component_id, c.vec_id=component_id kept from c left join k using (vec_id)
"""
}
