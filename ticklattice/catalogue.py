"""Every query of the engine by name, and the SQL that says the same."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import barriers, book, flow, live, lookback, ngrams, serial, training
from .plans import plain
from .plans.dialect import needs, occurrences, spark_sql
from .plans.folds import DEFAULT_GEOMETRIES, MAX_ORDER, STRANGE_CONTEXTS
from .plans.folds import QUERIES as FOLD_PLANS
from .plans.folds import VIEWS as FOLD_VIEWS
from .plans.views import DAY_NS, GEOMETRIES, HORIZON_DAYS, TICK
from .plans.views import _NAME as TOKEN_NAME
from .plans.views import QUERIES as BOOK_PLANS
from .plans.views import VIEWS as BOOK_VIEWS
from .sources import tokens, trees, windows
from .sources.events import mbo_from_events, read_days, valid_levels, write_days
from .sources.shared import shared_path
from .streaming.book import replayed_as_stream
from .streaming.recovery import fates_as_stream

PLANS, VIEWS = BOOK_PLANS | FOLD_PLANS, BOOK_VIEWS | FOLD_VIEWS
#: Views that cost a replay or a fold: written once where a plan reads them more than once.
COSTLY = {"book", "flow", "outcomes", "outcomes_all", "tokens", "trades", "contexts", "fold_trades"}
#: What the operators read that stand in for a view's SQL.
_BEHIND = {
    "book": "{mbo}", "levels": "{book}", "flow": "{book}", "lob_window": "{book}", "stream_commits": "{mbo}", "trades": "{candidates}",
    "outcomes": "{barrier_ticks}", "outcomes_all": "{barrier_ticks}", "lob_sums": "{book}", "slots": "{tokens_of}", "order_perplexity": "{halves}",
}


class Frames:
    """The views of one event log for one query, each built once; the costly ones are written if they are read again."""

    def __init__(self, spark: SparkSession, mbo: DataFrame, sql: str):
        self.spark, self.made = spark, {"mbo": mbo}
        self.reads = Counter()
        self._count(sql, 2 if sql.lstrip().startswith("with ") else 1)

    def _count(self, sql: str, times: int) -> None:
        for name, n in occurrences(sql).items():
            known = name in self.reads
            self.reads[name] += n * times
            if name not in COSTLY or not known:
                self._count(_BEHIND.get(name, VIEWS.get(name, "")), 1 if name in COSTLY else n * times)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            made = getattr(self, f"_{name}")() if hasattr(self, f"_{name}") else self.plan(VIEWS[name])
            if name in COSTLY and self.reads[name] > 1:
                path = shared_path(self.spark, name)
                made.write.parquet(path)
                made = self.spark.read.schema(made.schema).parquet(path)
            self.made[name] = made
        return self.made[name]

    def plan(self, sql: str) -> DataFrame:
        names = needs(sql)
        if not names:
            return self.spark.sql(spark_sql(sql))
        return self.spark.sql(spark_sql(sql), **{n: self[n] for n in names})

    def _book(self) -> DataFrame:
        return book.replay(self["mbo"], tops=any(self.reads[n] for n in ("levels", "lob_sums")))

    def _levels(self) -> DataFrame:
        return book.levels(self["book"])

    def _flow(self) -> DataFrame:
        return flow.flow_states(self["book"])

    def _lob_window(self) -> DataFrame:
        return lookback.lookback_features(self["book"])

    def _lob_sums(self) -> DataFrame:
        """Sums over the recorded levels of a commit, from its own arrays."""
        out = ["instrument_id", "seq", "case when bid is not null and ask is not null then (ask - bid) / 1e9 else 0e0 end as spread", "n_bids", "n_asks"]
        for s, col, name in (("b", "bids", "bid"), ("a", "asks", "ask")):
            out += [f"aggregate(slice({col}, 1, {k}), 0L, (t, l) -> t + l.size) as {s}{k}" for k in (1, 3, 5, 10)]
            for n, kind, x in (("w", "0D", "l.size / (i + 1D)"), ("sq", "0L", "l.size * l.size"), ("xy", "0L", "i * l.size"), ("x", "0L", "bigint(i)"), ("xx", "0L", "bigint(i * i)")):
                out.append(f"aggregate(transform({col}, (l, i) -> {x}), {kind}, (t, v) -> t + v) as {s}{n}")
            out += [f"coalesce(get({col}, {k}).size, 0L) as {name}_size_{k}" for k in range(10)]
        return self["book"].where("is_commit = 1").selectExpr(*out)

    def _slots(self) -> DataFrame:
        """The tokens of an event from one array of slots."""
        slot = lambda n, token: f"struct({n} as slot, {token} as token)"
        whole = ", ".join(slot(k, c) for k, c in ((2, "t_side"), (3, "t_price"), (4, "t_size")))
        parts = f"""concat(if(seq = first_seq, array({slot(0, 1)}), array()), if(t_action is not null, array({slot(1, 't_action')}), array()),
            if(t_action between 4 and 8, array({whole}), array()), if(t_action is not null and is_commit = 1, array({slot(5, 3)}), array()), if(seq = last_seq, array({slot(6, 2)}), array()))"""
        rows = self["tokens_of"].selectExpr("*", "min(seq) over (partition by instrument_id) as first_seq", "max(seq) over (partition by instrument_id) as last_seq")
        return rows.selectExpr("instrument_id", "seq", f"explode({parts}) as s").selectExpr("instrument_id", "seq", "s.slot", "s.token")

    def _outcomes(self) -> DataFrame:
        return barriers.barrier_labels(self["barrier_ticks"], list(GEOMETRIES), HORIZON_DAYS * DAY_NS, TICK)

    def _outcomes_all(self) -> DataFrame:
        return barriers.barrier_labels(self["barrier_ticks"], barriers.parse_geometries(DEFAULT_GEOMETRIES), HORIZON_DAYS * DAY_NS, TICK)

    def _order_perplexity(self) -> DataFrame:
        """Contexts of bytes by one pass over windows; those with a token that no byte can say, if there are any, as texts."""
        halves = self["halves"]
        sums = ngrams.context_sums(halves, MAX_ORDER)
        if not halves.where(ngrams.strange("token")).isEmpty():
            path = shared_path(self.spark, "contexts")
            self.plan(STRANGE_CONTEXTS).write.parquet(path)
            self.made["contexts"] = self.spark.read.parquet(path)
            texts = self.plan(VIEWS["order_perplexity"]).selectExpr("ord", "n", "-log2(perplexity) * n as bits")
            sums = sums.unionByName(texts).groupBy("ord").agg(F.sum("n").alias("n"), F.sum("bits").alias("bits"))
        return sums.selectExpr("ord", "n", "pow(2D, -bits / n) as perplexity")

    def _stream_commits(self) -> DataFrame:
        return replayed_as_stream(self["mbo"])

    def _trades(self) -> DataFrame:
        """Taken one at a time for each instrument and geometry, among those that beat the null probability by 0.1."""
        chosen = self["candidates"].where("p > stop_ticks / cast(target_ticks + stop_ticks as double) + 0.1")
        return serial.serial_trades(chosen, ["instrument_id", "target_ticks", "stop_ticks"], ["seq"])


def _query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Frames(spark, mbo_from_events(spark, sf_dir), sql).plan(sql)


def _live_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as messages of parallel arrays, and the events made of them again."""
    frames = Frames(spark, mbo_from_events(spark, sf_dir), "{feed} {order_numbers}")
    return live.live_events(frames["feed"], frames["order_numbers"])


def _exported_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export written as day files and read back, filters and columns by pushdown."""
    sql = PLANS["event_export"]
    path = shared_path(spark, "export")
    rows = Frames(spark, mbo_from_events(spark, sf_dir), sql).plan(sql)
    write_days(rows.withColumn("date", F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int")), "yyyyMMdd").cast("int")), path)
    back = read_days(spark, path)
    count = lambda c: F.sum(c.cast("int")).cast("bigint")
    resolved = F.col("outcome") >= 0
    imbalanced = resolved & (F.abs("ofi_fast") > 2) & (F.col("target_ticks") == 2) & (F.col("stop_ticks") == 1)
    return back.groupBy("day").agg(F.count("*").alias("n"), count(resolved).alias("resolved"), count(imbalanced).alias("imbalanced"))


#: The features of the tree model below, and the model as its file has it.
TREE_FEATURES = ["ofi_fast", "event_rate", "trade_flow_fast", "cancel_bid_fast"]
TREES = json.dumps({"learner": {"learner_model_param": {"base_score": "5E-1", "num_feature": "4"}, "gradient_booster": {"model": {"trees": [
    {"left_children": [1, 3, 5, -1, -1, -1, -1], "right_children": [2, 4, 6, -1, -1, -1, -1], "split_indices": [0, 1, 2, 0, 0, 0, 0], "split_conditions": [0.0, 1e-5, 2.0, 0, 0, 0, 0], "default_left": [0] * 7, "base_weights": [0, 0, 0, -0.3, -0.1, 0.05, 0.4]},
    {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [3, 0, 0], "split_conditions": [3.0, 0, 0], "default_left": [0] * 3, "base_weights": [0, 0.1, -0.2]},
]}}}})


def _tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow_rows = Frames(spark, mbo_from_events(spark, sf_dir), "{flow}")["flow"]
    p = trees.probability(trees.parse_trees(TREES), [F.col(c) for c in TREE_FEATURES])
    return flow_rows.select("instrument_id", "seq", F.round(p, 6).alias("p"))


FEATURES = [f"{f}_{s}" for f in ("ofi", "trade_flow", "cancel_bid", "cancel_ask", "add_bid", "add_ask") for s in ("fast", "med")]


def _fold_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the last fold's test rows by trees trained on its training days."""
    sql = "with x as (select 1) {outcomes} {flow} {roles}"
    frames = Frames(spark, mbo_from_events(spark, sf_dir), sql)
    labelled = frames["outcomes"].where("outcome >= 0").selectExpr("instrument_id", "seq", "target_ticks", "stop_ticks", "outcome as label", f"cast(floor(ts_ns / {DAY_NS}e0) as bigint) as day")
    rows = labelled.join(frames["flow"].select("instrument_id", "seq", *FEATURES), ["instrument_id", "seq"])
    found = training.fold_predictions(rows, frames["roles"], [*FEATURES, "target_ticks", "stop_ticks"], [14])
    return found.select("split", "instrument_id", "seq", "target_ticks", "stop_ticks", "label", "p")


def _token_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Frames(spark, mbo_from_events(spark, sf_dir), "{tokens}")["tokens"]
    return tokens.text_lines(found, F.expr(TOKEN_NAME))


_TOKEN_TEXT = plain.query(f"""select instrument_id, line, string_agg(name, ' ' order by pos) as text from (
 select instrument_id, pos, {TOKEN_NAME} as name, cast(coalesce(sum(case when token in (1, 2, 3) then 1 else 0 end) over (partition by instrument_id order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as line from {{tokens}}) a group by instrument_id, line""")

#: Tokens of a window, tokens between two windows, commits of a window at most: small, as the event logs of the tests are.
CONTEXT, STRIDE, MOST = 64, 32, 8


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = Frames(spark, mbo_from_events(spark, sf_dir), "with x as (select 1) {tokens} {commit_states}")
    states = frames["commit_states"].select("instrument_id", "pos", F.array(*(F.col(f"s{k}").cast("float") for k in range(windows.FIELDS))).alias("state"))
    return windows.recon_windows(frames["tokens"], states, CONTEXT, STRIDE, MOST)


def _window_sums() -> list[Column]:
    """What the queries on windows say of one window."""
    places = lambda c: f"aggregate(transform({c}, (t, i) -> bigint(t) * (i + 1)), 0L, (a, t) -> a + t)"
    fields = lambda c: f"aggregate(transform(commits, c -> coalesce(aggregate(transform(c.{c}, (v, i) -> double(v) * (i + 1)), 0D, (a, v) -> a + v), 0D)), 0D, (a, v) -> a + v)"
    sums = {"n_commits": "bigint(size(commits))", "n_pre": "bigint(size(filter(commits, c -> c.pre is not null)))", "x_sum": places("x"), "y_sum": places("y"), "at_sum": "aggregate(commits, 0L, (a, c) -> a + c.at)", "post_sum": fields("post"), "pre_sum": fields("pre")}
    return [F.expr(sql).alias(name) for name, sql in sums.items()]


def _recon_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("instrument_id", "start_pos", *_window_sums())


def _packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows written as packed files and read back."""
    path = shared_path(spark, "packed")
    windows.write_packed(_windows(spark, sf_dir), path, CONTEXT, MOST, rows=100)
    rows = windows.read_packed(spark, path).select(*_window_sums())
    return rows.agg(F.count("*").alias("n_windows"), *(F.sum(c).alias(c) for c in rows.columns))


def _stream_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fates_as_stream(Frames(spark, mbo_from_events(spark, sf_dir), "{messages}")["messages"])


def _snapshot_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots as arrays of levels, some of them undefined, and the levels that are left of each."""
    found = Frames(spark, mbo_from_events(spark, sf_dir), "{levels}")["levels"]
    level = F.expr("struct(lvl, case when (seq + lvl) % 7 = 0 then 9223372036854775807 else price_fp end as price, case when (seq + lvl) % 11 = 0 then 0 else size end as size)")
    held = found.groupBy("instrument_id", "seq", "side").agg(F.array_sort(F.collect_list(level)).alias("levels"))
    each = held.select("instrument_id", "seq", "side", F.posexplode(F.expr(valid_levels("levels"))).alias("lvl", "l"))
    return each.select("instrument_id", "seq", "side", "lvl", F.col("l.price").alias("price_fp"), "l.size")


_WINDOWS = f"""with valued as (select instrument_id, pos, {" + ".join(f"s{k} * {k + 1}" for k in range(windows.FIELDS))} as post from {{commit_states}}),
paired as (select *, lag(post) over (partition by instrument_id order by pos) as pre from valued),
starts as (select instrument_id, unnest(range(0, max(pos) - {CONTEXT} + 1, {STRIDE})) as start_pos from {{tokens}} group by instrument_id),
sums as (select w.instrument_id, w.start_pos, sum(case when t.pos < start_pos + {CONTEXT} then token * (t.pos - start_pos + 1) end) as x_sum, sum(token * (t.pos - start_pos)) as y_sum
 from starts w join {{tokens}} t on t.instrument_id = w.instrument_id and t.pos between w.start_pos and w.start_pos + {CONTEXT} group by w.instrument_id, w.start_pos),
firsts as (select w.instrument_id, w.start_pos, p.pos - w.start_pos as place, p.post, p.pre, row_number() over (partition by w.instrument_id, w.start_pos order by p.pos) as k
 from starts w join paired p on p.instrument_id = w.instrument_id and p.pos >= w.start_pos and p.pos < w.start_pos + {CONTEXT})
select s.instrument_id, s.start_pos, count(f.place) as n_commits, count(f.pre) as n_pre, cast(max(s.x_sum) as bigint) as x_sum, cast(max(s.y_sum) as bigint) as y_sum,
 cast(coalesce(sum(f.place), 0) as bigint) as at_sum, cast(coalesce(sum(f.post), 0) as double) as post_sum, cast(coalesce(sum(f.pre), 0) as double) as pre_sum
from sums s left join firsts f on f.instrument_id = s.instrument_id and f.start_pos = s.start_pos and f.k <= {MOST} group by s.instrument_id, s.start_pos"""
_SUMS = ("n_commits", "n_pre", "x_sum", "y_sum", "at_sum")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _query(sql) for name, sql in PLANS.items()}
QUERIES |= {"live_events": _live_events, "exported_days": _exported_days, "tree_score": _tree_score, "token_text": _token_text, "fold_training": _fold_training}
QUERIES |= {"recon_windows": _recon_windows, "packed_windows": _packed_windows, "stream_recovery": _stream_recovery, "snapshot_compact": _snapshot_compact}
ORACLES: dict[str, str] = {name: plain.query(sql) for name, sql in PLANS.items()}
ORACLES["token_text"] = _TOKEN_TEXT
ORACLES["recon_windows"] = plain.query(_WINDOWS)
ORACLES["packed_windows"] = f"select count(*) as n_windows, {', '.join(f'cast(sum({c}) as bigint) as {c}' for c in _SUMS)}, sum(post_sum) as post_sum, sum(pre_sum) as pre_sum from ({ORACLES['recon_windows']}) a"
ORACLES["stream_recovery"] = plain.query(f"select * from ({PLANS['snapshot_recovery']}) a where fate not in ('buffered', 'dropped')")
ORACLES["snapshot_compact"] = plain.query("select instrument_id, seq, side, cast(row_number() over (partition by instrument_id, seq, side order by lvl) - 1 as int) as lvl, price_fp, size from {levels} where (seq + lvl) % 7 <> 0 and (seq + lvl) % 11 <> 0 and price_fp > 0 and size > 0")
