"""Views and queries of folds, reports, the live feed and exports, in the same form as plans/views.py."""

from __future__ import annotations

from ..operators.lookback import NAMES as LOOKBACK_NAMES
from ..operators.ngrams import strange
from .views import _DERIVED, _METRICS, _NAME, _PNL, _P_NULL, DAY_NS, FLOWS, SCALES, TICK
from .views import QUERIES as BOOK_QUERIES
from .views import VIEWS as BOOK_VIEWS

#: Rows before and after a block of test days from which no training day is taken.
PURGE_ROWS, EMBARGO_ROWS = 500, 4600
#: Pairs of target and stop ticks that labels are made for by default.
DEFAULT_GEOMETRIES = "5:5,10:5,10:10,15:5,15:10,15:15,19:7,19:19,25:10,25:25,40:20"
#: Upper bounds of the latency buckets in microseconds; what is over the last has a bucket of its own.
LATENCY_BOUNDS = (500, 1000, 2000, 4000, 8000, 16000, 32000, 64000, 128000, 256000, 512000)
#: 95 % points of the t distribution; between them the steps of _T_CRITICAL.
T_POINTS = ((1, 12.706), (2, 4.303), (3, 3.182), (4, 2.776), (5, 2.571), (10, 2.228), (20, 2.086), (30, 2.042), (40, 2.021), (44, 2.015), (50, 2.009), (100, 1.984))
_T_CRITICAL = "case df " + " ".join(f"when {k} then {v}e0" for k, v in T_POINTS) + (
    " else case when df < 10 then 2.571e0 + (10 - df) * 0.05e0 when df < 30 then 2.042e0 + (30 - df) * 0.01e0 when df < 100 then 1.984e0 + (100 - df) * 0.001e0 else 1.96e0 end end"
)
#: The longest context that the sweep of orders looks at.
MAX_ORDER = 30
HEARTBEAT_NS = 30 * 1000000000
DAY = f"cast(floor(ts_ns / {DAY_NS}e0) as bigint)"

_BUCKET = "case " + " ".join(f"when us < {b} then {k}" for k, b in enumerate(LATENCY_BOUNDS)) + f" else {len(LATENCY_BOUNDS)} end"
_BOUND = "case bucket " + " ".join(f"when {k} then {b}" for k, b in enumerate(LATENCY_BOUNDS)) + " else mean end"
_LAGS = ", ".join(f"lag(token, {k}) over w as l{k}" for k in range(1, MAX_ORDER + 1))
_CONTEXT = "concat_ws(' ', " + ", ".join(f"case when ord >= {k} then cast(l{k} as varchar(8)) end" for k in range(MAX_ORDER, 0, -1)) + ")"
_HELD = "case ord " + " ".join(f"when {k} then l{k}" for k in range(1, MAX_ORDER + 1)) + " end"
_SIZE_CLASS = "case when size <= 1 then 0 when size <= 2 then 1 when size <= 4 then 2 when size <= 8 then 3 when size <= 16 then 4 when size <= 32 then 5 when size <= 64 then 6 when size <= 128 then 7 else 8 end"
_GEOMETRY_ROWS = " union all ".join(f"select {t} as target_ticks, {s} as stop_ticks" for t, s in (pair.split(":") for pair in DEFAULT_GEOMETRIES.split(",")))


def _all(sql: str) -> str:
    """A view of the labels over every default geometry."""
    for name in ("geometries", "passages", "labels_raw"):
        sql = sql.replace(f"{{{name}}}", f"{{{name}_all}}")
    return sql


#: Averages over few folds end in ties at six digits; nine leave none.
_METRICS_9 = _METRICS.replace(", 6)", ", 9)")

VIEWS: dict[str, str] = {
    # twice the mid and the entry price, so that all stays whole
    "barrier_ticks": """
select c.instrument_id, c.seq, c.ts_ns, c.bid + c.ask as price2, case when c.bbo_changed then case when f.ofi_fast >= 0 then 1 else -1 end end as direction,
       2 * case when f.ofi_fast >= 0 then c.ask else c.bid end as entry2, f.ofi_fast
from {commits} c join {flow} f on f.instrument_id = c.instrument_id and f.seq = c.seq where c.bid is not null and c.ask is not null""",
    "geometries_all": _GEOMETRY_ROWS,
    "passages_all": _all(BOOK_VIEWS["passages"]),
    "labels_raw_all": _all(BOOK_VIEWS["labels_raw"]),
    "outcomes_all": _all(BOOK_VIEWS["outcomes"]),
    # runs of neighbouring test days are one block
    "blocks": """
select split, island, min(row_start) as block_start, max(row_end) as block_end, count(*) as days
from (select s.split, d.row_start, d.row_end, d.day_no - row_number() over (partition by s.split order by d.day_no) as island
      from {splits} s join {days} d on d.grp in (s.g1, s.g2)) a group by split, island""",
    "roles": f"""
select s.split, d.day, d.day_no, case when d.grp in (s.g1, s.g2) then 'test'
  when max(case when d.row_end > greatest(b.block_start - {PURGE_ROWS}, 0) and d.row_start < b.block_start
                  or d.row_start < b.block_end + {EMBARGO_ROWS} and d.row_end > b.block_end then 1 else 0 end) = 1 then 'excluded' else 'train' end as role
from {{splits}} s cross join {{days}} d join {{blocks}} b on b.split = s.split group by s.split, s.g1, s.g2, d.day, d.day_no, d.grp""",
    "fold_trades": f"""
select r.split, t.target_ticks, t.stop_ticks, t.p, t.outcome, {_PNL} as pnl
from (select *, {DAY} as day from {{trades}}) t join {{roles}} r on r.day = t.day and r.role = 'test'""",
    "fold_candidates": f"""
select r.split, c.target_ticks, c.stop_ticks, c.p, c.outcome
from (select *, {DAY} as day from {{candidates}}) c join {{roles}} r on r.day = c.day and r.role = 'test'""",
    "fold_metrics": """
select split, count(*) as trades, avg(pnl) as expectancy, avg(case when pnl > 0 then 1e0 else 0e0 end) as win_rate, sum(pnl) as net_pnl,
       sum(case when pnl > 0 then pnl else 0e0 end) as won, sum(case when pnl > 0 then 0e0 else -pnl end) as lost
from {fold_trades} group by split""",
    "latencies": "select instrument_id, IDIV(ts_ns,10000000000) as span, (seq * 7919 % 10000) * 100 as us from {mbo}",
    "latency_buckets": f"select instrument_id, bucket, n, sum(n) over (partition by instrument_id order by bucket) as cum, sum(n) over (partition by instrument_id) as total, cast(floor(sum(us) over (partition by instrument_id) / cast(sum(n) over (partition by instrument_id) as double)) as bigint) as mean from (select instrument_id, {_BUCKET} as bucket, count(*) as n, sum(us) as us from {{latencies}} group by instrument_id, {_BUCKET}) a",
    # every context of every order in one pass: the tokens before stand beside each token once
    "contexts": f"select ord, training, token, {_CONTEXT} as ctx from (select *, k.i as ord from (select training, token, {_LAGS} from {{halves}} window w as (partition by instrument_id, training order by pos)) a cross join SERIES(1,{MAX_ORDER}) k) b where {_HELD} is not null",
    "order_perplexity": """
select g.ord, count(*) as n, pow(2e0, -avg(ln((coalesce(n.c, 0) + 1e0) / (coalesce(t.total, 0) + 126e0)) / ln(2e0))) as perplexity
from {contexts} g left join (select ord, ctx, token, count(*) as c from {contexts} where training = 1 group by ord, ctx, token) n on n.ord = g.ord and n.ctx = g.ctx and n.token = g.token
left join (select ord, ctx, count(*) as total from {contexts} where training = 1 group by ord, ctx) t on t.ord = g.ord and t.ctx = g.ctx
where g.training = 0 group by g.ord""",
    "sizes_of": f"select instrument_id, seq, side, lvl, {_SIZE_CLASS} as bucket, size from {{levels}} where lvl < 5",
    "directions": "select instrument_id, seq, direction, lag(direction) over (partition by instrument_id order by seq) as guess from (" + BOOK_QUERIES["direction_targets"] + ") d where direction >= 0",
    # a feed that clears a book now and then, sends what rests, and ends the snapshot with the number it stands at
    "messages": """
select instrument_id, seq, ts_ns, case when seq % 211 = 7 then 'clear' when seq % 211 = 60 then 'end' when seq % 211 between 8 and 20 then 'level' else 'event' end as kind,
       case when seq % 211 = 60 then seq - 25 else seq end as number from {mbo}""",
    # of each message the last begin and the last end of a snapshot before it, and the next clear and end, of its instrument; a level outside a snapshot begins one
    "message_state": """
select *, coalesce(max(case when kind in ('clear', 'level') then seq end) over w, -1) as cleared, coalesce(max(case when kind = 'end' then seq end) over w, -1) as ended,
       min(case when kind = 'clear' then seq end) over f as next_clear, min(case when kind = 'end' then seq end) over f as next_end, FIRSTV(case when kind = 'end' then number end) over f as next_number
from {messages} window w as (partition by instrument_id order by seq rows between unbounded preceding and 1 preceding), f as (partition by instrument_id order by seq rows between 1 following and unbounded following)""",
    # the state of the book at the commits of the tokens: both prices in ticks from a fixed one, five sizes a side
    "commit_states": """
select t.instrument_id, t.pos, coalesce((c.bid - 100000000000) / 250000000e0, 0e0) as s0, coalesce((c.ask - 100000000000) / 250000000e0, 0e0) as s1,
       """ + ", ".join(f"l.{n}_size_{k} as s{2 + 5 * i + k}" for i, n in enumerate(("bid", "ask")) for k in range(5)) + """
from {tokens} t join {commits} c on c.instrument_id = t.instrument_id and c.seq = t.seq join {lob_sums} l on l.instrument_id = t.instrument_id and l.seq = t.seq where t.token = 3""",
    "order_keys": "select concat('x', cast(order_id as varchar(20))) as order_key, min(seq) as first_seq from {mbo} where action in ('A', 'C', 'M') group by order_id",
    # numbered by first appearance in blocks, so that only the blocks are ordered as a whole
    "key_blocks": "select block, sum(n) over (order by block) - n as before from (select IDIV(first_seq,4096) as block, count(*) as n from {order_keys} group by IDIV(first_seq,4096)) a",
    "order_numbers": "select k.order_key, b.before + row_number() over (partition by b.block order by k.first_seq, k.order_key) as number from {order_keys} k join {key_blocks} b on b.block = IDIV(k.first_seq,4096)",
    "feed": "select instrument_id, seq, ts_ns, action, side, order_id, price_fp, size from {mbo} where action in ('A', 'C', 'M', 'T')",
    "numbered_seqs": "select seq, instrument_id, IDIV(seq,4096) as block from {mbo} where seq % 97 <> 0",
    "seq_ends": "select block, lag(last_seq) over (order by block) as before from (select block, max(seq) as last_seq from {numbered_seqs} group by block) a",
    "kept_tokens": "select *, IDIV(pos,64) * 64 as own from {tokens}",
}

#: The contexts that hold a token that no byte can say (a missing one too), for those few by themselves.
_ODD = " or ".join(f"ord >= {k} and {strange(f'l{k}')}" for k in range(1, MAX_ORDER + 1))
STRANGE_CONTEXTS = f"{VIEWS['contexts']} and ({_ODD})"

#: The columns of a model's input, in order: 32 of the book, ten of the look-back, 48 of the flow.
LOB_NAMES = [f"{n}_size_{k}" for n in ("bid", "ask") for k in range(10)] + [f"imbalance_d{k}" for k in (1, 3, 5, 10)]
LOB_NAMES += ["weighted_imbalance", "spread_ticks", "bid_hhi", "ask_hhi", "bid_slope", "ask_slope", "bid_levels", "ask_levels"]
FLOW_NAMES = [f"{f}_{s}" for f in FLOWS for s in SCALES] + ["inter_event_time_ns", "event_rate", "bbo_change_cause"]
FLOW_NAMES += [f"{n}_{s}" for n in _DERIVED for s in SCALES] + ["trade_flow_accel", "ofi_accel", "cancel_asym_accel"]
_FEATURES = ", ".join([*(f"l.{n}" for n in LOB_NAMES), *(f"w.{n}" for n in LOOKBACK_NAMES), *(f"f.{n}" for n in FLOW_NAMES)])


QUERIES: dict[str, str] = {
    "multi_geometry_labels": "select instrument_id, seq, direction, target_ticks, stop_ticks, outcome, exit_ts, round(pnl_ticks, 6) + 0e0 as pnl_ticks from {outcomes_all}",
    "geometry_table": f"select target_ticks, stop_ticks, round({_P_NULL}, 9) as p_null from {{geometries_all}}",
    "cpcv_boundaries": "select cast(split as int) as split, cast(block_start as bigint) as block_start, cast(block_end as bigint) as block_end, days from {blocks}",
    "cpcv_purge": "select cast(split as int) as split, day, role from {roles}",
    "cpcv_inner_validation": "select cast(split as int) as split, day, case when row_number() over (partition by split order by day_no) > floor(count(*) over (partition by split) * 4 / 5e0) then 1 else 0 end as validation from {roles} where role = 'train'",
    "holdout_split": "select day, case when day_no < floor(count(*) over () * 4 / 5e0) then 'train' else 'holdout' end as role from {days}",
    "fold_metrics": f"select cast(split as int) as split, {_METRICS_9} from {{fold_trades}} group by split",
    "fold_slice": "select cast(split as int) as split, trades, round(expectancy, 9) as expectancy from {fold_metrics} where split >= 3 and split < 9",
    "fold_geometry_metrics": f"select cast(split as int) as split, target_ticks, stop_ticks, {_METRICS_9} from {{fold_trades}} group by split, target_ticks, stop_ticks",
    "cross_fold_report": f"""
select folds, round(mean_exp, 9) as mean_expectancy, round(std_exp, 9) as std_expectancy, round(mean_exp - margin, 9) as ci_low, round(mean_exp + margin, 9) as ci_high,
       round(negative, 9) as negative_fold_fraction, trades, round(wins / cast(trades as double), 9) as pooled_win_rate,
       round(case when lost > 0 then won / lost when won > 0 then 1e308 else 0e0 end, 9) as pooled_profit_factor, round(net_pnl, 9) as net_pnl
from (select *, case when folds < 2 then 0e0 else ({_T_CRITICAL}) * std_exp / sqrt(cast(folds as double)) end as margin
      from (select count(*) as folds, count(*) - 1 as df, avg(expectancy) as mean_exp, coalesce(stddev_samp(expectancy), 0e0) as std_exp, avg(case when expectancy < 0 then 1e0 else 0e0 end) as negative,
                   cast(sum(trades) as bigint) as trades, sum(round(win_rate * trades)) as wins, sum(won) as won, sum(lost) as lost, sum(net_pnl) as net_pnl from {{fold_metrics}}) a) b""",
    "pooled_sharpe": "select count(*) as trades, round(case when count(*) < 2 or stddev_samp(pnl) < 1e-12 then 0e0 else avg(pnl) / stddev_samp(pnl) * sqrt(12600e0 / count(*)) end, 6) as sharpe from {fold_trades}",
    "geometry_across_folds": f"""
select target_ticks, stop_ticks, round({_P_NULL}, 9) as p_null, round(sum(p_mean * n) / sum(n), 9) as mean_p_model, cast(sum(n) as bigint) as predictions, cast(sum(trades) as bigint) as trades, round(coalesce(avg(win_rate), 0e0), 9) as mean_win_rate
from (select c.split, c.target_ticks, c.stop_ticks, c.p_mean, c.n, coalesce(t.trades, 0) as trades, t.win_rate
      from (select split, target_ticks, stop_ticks, avg(p) as p_mean, count(*) as n from {{fold_candidates}} group by split, target_ticks, stop_ticks) c
      left join (select split, target_ticks, stop_ticks, count(*) as trades, avg(case when pnl > 0 then 1e0 else 0e0 end) as win_rate from {{fold_trades}} group by split, target_ticks, stop_ticks) t
        on t.split = c.split and t.target_ticks = c.target_ticks and t.stop_ticks = c.stop_ticks) a group by target_ticks, stop_ticks""",
    "calibration_across_folds": """
select bin, cast(sum(n) as bigint) as n, round(sum(mean_p * n) / sum(n), 9) as mean_predicted, round(sum(observed * n) / sum(n), 9) as observed
from (select split, least(cast(floor(p * 10) as int), 9) as bin, count(*) as n, avg(p) as mean_p, avg(case when outcome = 1 then 1e0 else 0e0 end) as observed from {fold_candidates} group by split, least(cast(floor(p * 10) as int), 9)) a group by bin""",
    "daily_rows": f"select count(*) as days, min(n) as fewest, cast(floor(median(n)) as bigint) as middle, max(n) as most from (select {DAY} as day, count(*) as n from {{outcomes}} group by {DAY}) a",
    "latency_percentiles": "select instrument_id, max(total) as n, " + ", ".join(f"cast(min(case when cum >= ceil(total * {p} / 100e0) then {_BOUND} end) as bigint) as p{p}_us" for p in (50, 95, 99)) + ", cast(max(mean) as bigint) as mean_us from {latency_buckets} group by instrument_id",
    "latency_summaries": "select instrument_id, span, count(*) as n, cast(sum(us) as bigint) as total_us, max(us) as worst_us from {latencies} group by instrument_id, span",
    "markov_sweep": """
select cast(ord as int) as context_order, n, round(perplexity, 6) as perplexity, round(coalesce(perplexity / lag(perplexity) over (order by ord) - 1, 0e0) * 100, 4) as change_pct,
       case when perplexity / lag(perplexity) over (order by ord) - 1 < -0.005e0 then 1 else 0 end as significant, case when perplexity = min(perplexity) over () then 1 else 0 end as best from {order_perplexity}""",
    "recon_metrics": """
select side, lvl, count(*) as n, round(avg(case when guess = bucket then 1e0 else 0e0 end), 6) as accuracy, round(avg(case when bucket <> modal then case when guess = bucket then 1e0 else 0e0 end end), 6) as non_modal_accuracy
from (select s.side, s.lvl, s.bucket, m.bucket as modal, lag(s.bucket) over (partition by s.instrument_id, s.side, s.lvl order by s.seq) as guess
      from {sizes_of} s join (select side, lvl, bucket, row_number() over (partition by side, lvl order by n desc, bucket) as k from (select side, lvl, bucket, count(*) as n from {sizes_of} group by side, lvl, bucket) a) m
        on m.side = s.side and m.lvl = s.lvl and m.k = 1) b where guess is not null group by side, lvl""",
    "recon_spread_imbalance": f"select instrument_id, seq, cast(greatest(0, least(10, IDIV(ask - bid,{TICK}))) as int) as spread_class, round(case when bid_size + ask_size > 0 then bid_size / cast(bid_size + ask_size as double) else 0.5e0 end, 6) as imbalance from {{commits}} where bid is not null and ask is not null and ask >= bid",
    "recon_imbalance_error": "select count(*) as n, round(avg(abs(x - before)), 6) as mae, round(avg(abs(x - 0.5e0)), 6) as mae_of_half from (select x, lag(x) over (partition by instrument_id order by seq) as before from (select instrument_id, seq, case when bid_size + ask_size > 0 then bid_size / cast(bid_size + ask_size as double) else 0.5e0 end as x from {commits} where bid is not null and ask is not null and ask >= bid) a) b where before is not null",
    "direction_metrics": "select n, round(accuracy, 6) as accuracy, round(greatest(ups, 1 - ups), 6) as majority_accuracy, round((accuracy - greatest(ups, 1 - ups)) * 100, 4) as delta_pp, case when accuracy - greatest(ups, 1 - ups) >= 0.02e0 then 1 else 0 end as passes from (select count(*) as n, avg(case when guess = direction then 1e0 else 0e0 end) as accuracy, avg(cast(direction as double)) as ups from {directions} where guess is not null) a",
    "token_windows": """
select instrument_id, start_pos, count(*) as n, cast(sum(cast(token as bigint) * (pos - start_pos + 1)) as bigint) as checksum
from (select instrument_id, pos, token, own - 64 * k.i as start_pos from {kept_tokens} t cross join SERIES(0,1) k where own >= 64 * k.i) a group by instrument_id, start_pos having count(*) = 128""",
    "token_decode": """
select instrument_id, pos, case token when 4 then 'A' when 5 then 'C' when 6 then 'M' when 7 then 'T' when 8 then 'F' when 9 then 'R' end as action,
       case token when 10 then 'B' when 11 then 'A' when 12 then ' ' end as side, case when token between 13 and 115 then token - 64 end as price_ticks,
       case when token between 117 and 118 then token - 117 when token between 119 and 125 then cast(pow(2e0, token - 118) as int) end as size_from from {tokens} where token > 3""",
    "token_summary": "select cast(sum(case when token = 3 then 1 else 0 end) as bigint) as commits, count(*) as tokens, round(count(*) / cast(count(distinct seq) as double), 6) as tokens_per_event, round(100 * sum(case when token between 14 and 114 then 1e0 else 0e0 end) / sum(case when token between 13 and 115 then 1e0 else 0e0 end), 6) as in_range_pct from {tokens}",
    "token_sizes": "select token - 117 as size_bin, count(*) as n from {tokens} where token between 117 and 125 group by token - 117",
    "token_check": "select instrument_id, count(*) as tokens, cast(sum(case when token < 0 or token >= 126 then 1 else 0 end) as bigint) as invalid, cast(cast(sum(case when token = 3 then 1 else 0 end) as bigint) - max(m.commits) as bigint) as commits_apart from {tokens} t join (select instrument_id as inst, sum(case when is_commit = 1 and action in ('A', 'C', 'M', 'T', 'F', 'R') then 1 else 0 end) as commits from {book} group by instrument_id) m on m.inst = t.instrument_id group by instrument_id",
    "token_preview": f"select instrument_id, pos, {_NAME} as name from {{tokens}} where pos < 20",
    "seq_gaps": "select instrument_id, prev_seq, seq, seq - prev_seq - 1 as missing from (select n.instrument_id, n.seq, coalesce(lag(n.seq) over (partition by n.block order by n.seq), e.before) as prev_seq from {numbered_seqs} n join {seq_ends} e on e.block = n.block) a where seq - prev_seq > 1",
    "event_slice": "select instrument_id, idx, seq from (select instrument_id, seq, row_number() over (partition by instrument_id order by seq) - 1 as idx from {mbo}) a where idx >= 10 and idx < 40",
    "as_of_events": "select instrument_id, seq, count(*) over (partition by instrument_id order by ts_ns) as events_until from {mbo}",
    "sidecar_lookup": "select c.instrument_id, c.pos, b.seq, b.bid, b.ask from (select instrument_id, pos, seq from {tokens} where token = 3) c join {book} b on b.instrument_id = c.instrument_id and b.seq = c.seq",
    "codes": "select action, side, case action when 'A' then 0 when 'C' then 1 when 'M' then 2 else 3 end as action_code, case side when 'B' then 0 else 1 end as side_code, cast(cast(min(price_fp) / 1e9 as real) as double) as lowest, count(*) as n from {mbo} where action <> 'R' group by action, side",
    "live_events": """
select f.instrument_id, f.seq, cast(IDIV(f.ts_ns,1000) * 1000 as bigint) as ts_ns, f.action, f.side, case when f.action = 'T' then 0 else n.number end as order_number, f.price_fp, f.size,
       case when f.action = 'T' or row_number() over (partition by f.instrument_id, IDIV(f.seq,8), case when f.action = 'T' then f.seq end order by f.seq desc) = 1 then 128 else 0 end as flags
from {feed} f left join {order_numbers} n on n.order_key = concat('x', cast(f.order_id as varchar(20)))""",
    "order_numbers": "select order_key, number from {order_numbers}",
    "live_routes": "select template_id, case when template_id in (160, 116, 161, 118) then 'depth' when template_id in (151, 150, 101) then 'quotes' when template_id in (19, 75, 77, 13) then 'both' else 'none' end as route, count(*) as n from (select case cast(seq % 12 as int) when 0 then 160 when 1 then 116 when 2 then 161 when 3 then 118 when 4 then 151 when 5 then 150 when 6 then 101 when 7 then 19 when 8 then 75 when 9 then 77 when 10 then 13 else 999 end as template_id from {mbo}) a group by template_id",
    "quote_updates": "select instrument_id, seq, bid, ask from {commits} where bbo_changed and bid is not null and ask is not null",
    "snapshot_adds": "select instrument_id, seq, side, lvl, 'A' as action, price_fp, size, case when row_number() over (partition by instrument_id, seq order by side desc, lvl desc) = 1 then 128 else 0 end as flags from {levels} where seq % 50 = 1",
    "snapshot_recovery": """
select instrument_id, seq, kind, case when kind <> 'event' then kind when cleared <= ended then 'live' when next_end is null then 'buffered' when next_clear < next_end then 'dropped' when number > next_number then 'replayed' else 'discarded' end as fate
from {message_state}""",
    "recovery_degraded": "select instrument_id, count(*) as recoveries, case when count(*) - 1 >= 10 then 1 else 0 end as degraded from {message_state} where kind = 'end' and cleared > ended group by instrument_id",
    "quote_checks_gated": "select q.instrument_id, q.seq, case when s.ended > s.cleared and q.k > 1 then 1 else 0 end as checked from {quotes} q join {message_state} s on s.instrument_id = q.instrument_id and s.seq = q.seq",
    "liveness": f"select instrument_id, seq, ts_ns - before as silent_ns, case when ts_ns - before > {2 * HEARTBEAT_NS} then 1 else 0 end as dead from (select instrument_id, seq, ts_ns, lag(ts_ns) over (partition by instrument_id order by seq) as before from {{mbo}}) a where before is not null",
    "reconnect_backoff": "select cast(i as int) as attempt, cast(least(pow(2e0, least(i, 5)), 30) as int) as wait_s from SERIES(0,10) s",
    "quote_divergence": f"select instrument_id, count(*) as matched, cast(sum(exact) as bigint) as exact, cast(sum(1 - exact) as bigint) as diverged, cast(max(abs(bid - quote_bid)) / {TICK} as bigint) as widest_bid, cast(max(abs(ask - quote_ask)) / {TICK} as bigint) as widest_ask from {{ring}} where nth = 1 group by instrument_id",
    "symbols": "select m.instrument_id, s.symbol, count(*) as n from {mbo} m join (select i as instrument_id, concat('FUT', cast(i as varchar(4))) as symbol from SERIES(0,39) x) s on s.instrument_id = m.instrument_id group by m.instrument_id, s.symbol",
    "book_verify_report": """
select count(*) as instruments, cast(sum(checks) as bigint) as checks, round(100 * sum(matches) / cast(sum(checks) as double), 6) as exact_pct, cast(sum(case when matches = checks then 1 else 0 end) as bigint) as passed,
       case when sum(checks) = 0 then 2 when sum(case when matches = checks then 0 else 1 end) = 0 then 0 else 1 end as exit_code
from (select instrument_id, count(*) as checks, sum(case when bid_prices + ask_prices + bid_sizes + ask_sizes + fewer = 0 then 1 else 0 end) as matches from {checked} group by instrument_id) a""",
    "verify_mismatches": "select instrument_id, seq, " + ", ".join(f"cast({c} as bigint) as {c}" for c in ("bid_prices", "ask_prices", "bid_sizes", "ask_sizes")) + ", fewer from (select *, row_number() over (partition by instrument_id order by seq) as k from {checked} where bid_prices + ask_prices + bid_sizes + ask_sizes + fewer > 0) a where k <= 5",
    # keys, 90 features, and the labels; target and stop are the last two inputs of a model
    "event_export": f"""
select o.instrument_id, o.seq, o.ts_ns, {DAY.replace('ts_ns', 'o.ts_ns')} as day, o.direction, {_FEATURES}, o.target_ticks, o.stop_ticks, o.outcome, o.exit_ts, round(o.pnl_ticks, 6) + 0e0 as pnl_ticks
from {{outcomes}} o
join ({BOOK_QUERIES['lob_static']}) l on l.instrument_id = o.instrument_id and l.seq = o.seq
join ({BOOK_QUERIES['lob_window']}) w on w.instrument_id = o.instrument_id and w.seq = o.seq
join ({BOOK_QUERIES['flow_features']}) f on f.instrument_id = o.instrument_id and f.seq = o.seq""",
    "exported_days": f"select {DAY} as day, count(*) as n, cast(sum(case when outcome >= 0 then 1 else 0 end) as bigint) as resolved, cast(sum(case when outcome >= 0 and abs(ofi_fast) > 2 and target_ticks = 2 and stop_ticks = 1 then 1 else 0 end) as bigint) as imbalanced from {{outcomes}} group by {DAY}",
}
