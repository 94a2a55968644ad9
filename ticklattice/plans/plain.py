"""The operators' views as standard SQL, to check them against another engine."""

from __future__ import annotations

from ..operators.ema import SCALES
from ..operators.flow import EVENT_FLOWS
from .dialect import needs, plain_sql
from .folds import VIEWS as FOLD_VIEWS
from .views import VIEWS as BOOK_VIEWS

VIEWS = BOOK_VIEWS | FOLD_VIEWS

_NAIVE = ", ".join(
    f"sum(case when {when} then ({value}) * pow(2, u_{name} / {h}e0) else 0 end) over w * pow(2, -u_{name} / {h}e0) as {name}_{scale}"
    for name, (when, value) in EVENT_FLOWS.items()
    for scale, h in SCALES.items()
)
_COUNTS = ", ".join(f"sum(case when {when} then 1 else 0 end) over w as u_{name}" for name, (when, _) in EVENT_FLOWS.items())

BASE: dict[str, str] = {
    "mbo": """
select seq, ts_ns, instrument_id, case action when 'A' then seq when 'T' then 0 else coalesce(last_value(case when action = 'A' then seq end ignore nulls) over (partition by instrument_id order by seq rows between unbounded preceding and 1 preceding), -1) end as order_id,
 action, side, 100000000000 + (case when side = 'B' then -1 else 1 end) * 250000000 * (1 + cast(floor(value) as bigint) % 20) as price_fp, cast(1 + k as bigint) as size, case when seq % 3 <> 0 then 128 else 0 end as flags
from (select *, case when event_type in ('view', 'click') then 'A' when event_type = 'error' then 'C' when event_type = 'signup' then 'M' when k < 2 then 'R' when k % 5 = 0 then 'F' else 'T' end as action, case when k % 2 = 0 then 'B' else 'A' end as side
 from (select event_id as seq, epoch_us(ts) * 1000 as ts_ns, user_id % 50 as instrument_id, event_type, value, cast(json_extract(props, '$.k') as int) as k from events) a) b""",
    "epochs": "select *, sum(case when action = 'R' then 1 else 0 end) over (partition by instrument_id order by seq) as epoch from mbo",
    "episodes": "select *, lead(seq) over (partition by instrument_id, epoch, order_id order by seq) as next_seq, sum(case when action in ('A', 'C') or (action = 'F' and size = 0) then 1 else 0 end) over (partition by instrument_id, epoch, order_id order by seq) as episode from epochs where action in ('A', 'C', 'M', 'F')",
    "versions": "select instrument_id, epoch, seq, next_seq, size, first_value(action) over e as opened, last_value(case when action <> 'F' then price_fp end ignore nulls) over e as price_fp, last_value(case when action <> 'F' then side end ignore nulls) over e as side from episodes window e as (partition by instrument_id, epoch, order_id, episode order by seq)",
    "deltas": "select instrument_id, epoch, side, price_fp, seq, sum(d) as d from (select instrument_id, epoch, side, price_fp, seq, size as d from versions where opened = 'A' union all select instrument_id, epoch, side, price_fp, next_seq, -size from versions where opened = 'A' and next_seq is not null) a group by all",
    "spans": "select instrument_id, epoch, side, price_fp, seq as from_seq, lead(seq) over p as to_seq, sum(d) over p as qty from deltas window p as (partition by instrument_id, epoch, side, price_fp order by seq)",
    "live": "select e.instrument_id, e.seq, s.side, s.price_fp, cast(s.qty as bigint) as size, row_number() over (partition by e.instrument_id, e.seq, s.side order by case when s.side = 'B' then -s.price_fp else s.price_fp end) as nth from epochs e join spans s on s.instrument_id = e.instrument_id and s.epoch = e.epoch and s.qty > 0 and s.from_seq <= e.seq and (s.to_seq is null or s.to_seq > e.seq)",
    "tops": "select instrument_id, seq, max(case when side = 'B' and nth = 1 then price_fp end) as bid, max(case when side = 'A' and nth = 1 then price_fp end) as ask, coalesce(max(case when side = 'B' and nth = 1 then size end), 0) as bid_size, coalesce(max(case when side = 'A' and nth = 1 then size end), 0) as ask_size, cast(count(case when side = 'B' and nth <= 10 then 1 end) as int) as n_bids, cast(count(case when side = 'A' and nth <= 10 then 1 end) as int) as n_asks from live group by instrument_id, seq",
    "book": "select e.instrument_id, e.seq, e.ts_ns, e.order_id, e.action, e.side, e.price_fp, e.size, case when e.flags & 128 <> 0 then 1 else 0 end as is_commit, lag(t.bid) over w as pre_bid, lag(t.ask) over w as pre_ask, t.bid, t.ask, coalesce(t.bid_size, 0) as bid_size, coalesce(t.ask_size, 0) as ask_size, coalesce(t.n_bids, 0) as n_bids, coalesce(t.n_asks, 0) as n_asks from epochs e left join tops t on t.instrument_id = e.instrument_id and t.seq = e.seq window w as (partition by e.instrument_id order by e.seq)",
    "levels": "select l.instrument_id, l.seq, l.side, cast(l.nth - 1 as int) as lvl, l.price_fp, l.size from live l join mbo m on m.seq = l.seq where m.flags & 128 <> 0 and l.nth <= 10",
    "event_flows": f"select * from (select instrument_id, seq, is_commit, ts_ns, {_NAIVE}, coalesce(last_value(case when ts_ns >= before then ts_ns - before end ignore nulls) over w, 0) as inter_event_time_ns from (select *, {_COUNTS}, lag(ts_ns) over w as before from book window w as (partition by instrument_id order by seq)) a window w as (partition by instrument_id order by seq)) b where is_commit = 1",
    "ofi_counts": "select *, sum(case when ofi <> 0 then 1 else 0 end) over (partition by instrument_id order by seq) as u from ofi",
    "ofi_flows": "select instrument_id, seq, " + ", ".join(f"sum(ofi * pow(2, u / {h}e0)) over w * pow(2, -u / {h}e0) as ofi_{s}" for s, h in SCALES.items()) + " from ofi_counts window w as (partition by instrument_id order by seq)",
    "flow": "select f.*, case when inter_event_time_ns > 0 then 1e9 / inter_event_time_ns else 0e0 end as event_rate, o.ofi_fast, o.ofi_med, o.ofi_slow from event_flows f join ofi_flows o on o.instrument_id = f.instrument_id and o.seq = f.seq",
    "chosen": "select *, row_number() over (partition by instrument_id, target_ticks, stop_ticks order by seq) as k from candidates where p > stop_ticks / cast(target_ticks + stop_ticks as double) + 0.1",
    "taken": "select instrument_id, target_ticks, stop_ticks, k, exit_ts from chosen where k = 1 union all select c.instrument_id, c.target_ticks, c.stop_ticks, c.k, c.exit_ts from taken t join chosen c on c.instrument_id = t.instrument_id and c.target_ticks = t.target_ticks and c.stop_ticks = t.stop_ticks and c.k = (select min(n.k) from chosen n where n.instrument_id = t.instrument_id and n.target_ticks = t.target_ticks and n.stop_ticks = t.stop_ticks and n.k > t.k and n.ts_ns >= t.exit_ts)",
    "trades": "select c.* exclude (k) from chosen c join taken t on t.instrument_id = c.instrument_id and t.target_ticks = c.target_ticks and t.stop_ticks = c.stop_ticks and t.k = c.k",
    "numbered": "select *, row_number() over (partition by instrument_id order by ts_ns, seq) as idx, count(*) over (partition by instrument_id order by ts_ns) as upto from book",
    "looked_back": """
select c.instrument_id, c.seq, e.idx, e.action, e.side, e.price_fp, e.size, e.ts_ns,
 case when e.side = 'B' then coalesce(abs(e.price_fp - c.bid) < 150000000, false) when e.side = 'A' then coalesce(abs(e.price_fp - c.ask) < 150000000, false) else false end as best,
 lag(e.side) over p as side0, lag(e.price_fp) over p as price0
from numbered c join numbered e on e.instrument_id = c.instrument_id and e.idx > c.upto - 200 and e.idx <= c.upto where c.is_commit = 1
window p as (partition by c.instrument_id, c.seq, e.action in ('A', 'C') order by e.idx)""",
    "lob_window": """
select instrument_id, seq, count(*) filter (action = 'C' and side = 'B' and best) / count(*) as cancel_rate_bid, count(*) filter (action = 'C' and side = 'A' and best) / count(*) as cancel_rate_ask,
 count(*) filter (action = 'A' and side = 'B' and best) / count(*) as add_rate_bid, count(*) filter (action = 'A' and side = 'A' and best) / count(*) as add_rate_ask,
 coalesce(sum(case when side = 'B' then size else -size end) filter (action in ('T', 'F')) / nullif(sum(size) filter (action in ('T', 'F')), 0), 0) as trade_aggression,
 count(*) / greatest(case when count(*) < 2 then 1 else (max(ts_ns) - min(ts_ns)) / 1e9 end, 0.001e0) as message_rate,
 case when count(*) filter (action = 'A') > 0 then count(*) filter (action = 'C') / count(*) filter (action = 'A') when count(*) filter (action = 'C') > 0 then 2e0 else 0e0 end as cancel_add_ratio,
 count(*) filter (action in ('A', 'C') and side = side0 and abs(price_fp - price0) > 25000000 and best) * 1e0 as bbo_change_count,
 (arg_max(price_fp, idx) - arg_min(price_fp, idx)) / 250000000e0 as price_momentum_ticks,
 coalesce(abs(arg_max(price_fp, idx) - arg_min(price_fp, idx)) / 250000000e0 / nullif(count(*) filter (action in ('T', 'F')), 0), 0) as flow_toxicity
from looked_back group by instrument_id, seq""",
    "stream_commits": "select instrument_id, seq, ts_ns, bid, ask, bid_size, ask_size, n_bids, n_asks from book where is_commit = 1",
}
_ORDER = ["mbo", "epochs", "episodes", "versions", "deltas", "spans", "live", "tops", "book", "levels", "commits", "batches", "masks", "causes", "sides", "ofi", "ofi_signed", "event_flows", "ofi_counts", "ofi_flows", "flow", "lob_sums", "ticks", "entries", "geometries", "passages", "beyond", "labels_raw", "outcomes", "tokens_of", "slots", "tokens", "halves", "days", "splits", "candidates", "chosen", "taken", "trades", "numbered", "looked_back", "lob_window", "stream_commits", "arrivals", "block_ends", "breaks", "streaks", "quotes", "pointed", "ring", "snapshots", "snapshot_levels", "checked", "legal_moves", "moves"]
_BEHIND = {"numbered": ["book"], "looked_back": ["numbered"], "lob_window": ["looked_back"], "stream_commits": ["book"], "epochs": ["mbo"], "episodes": ["epochs"], "versions": ["episodes"], "deltas": ["versions"], "spans": ["deltas"], "live": ["spans", "epochs"], "tops": ["live"], "book": ["tops", "epochs"], "levels": ["live", "mbo"], "event_flows": ["book"], "ofi_counts": ["ofi"], "ofi_flows": ["ofi_counts"], "flow": ["event_flows", "ofi_flows"], "chosen": ["candidates"], "taken": ["chosen"], "trades": ["chosen", "taken"]}


def query(sql: str) -> str:
    """sql as one statement with every view that it needs."""
    wanted, todo = set(), needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += needs(VIEWS[name]) if name in VIEWS else _BEHIND.get(name, [])
    order = [*_ORDER, *(n for n in FOLD_VIEWS if n not in _ORDER)]
    materialized = ("book", "live", "flow", "outcomes", "outcomes_all", "tokens", "contexts")
    parts = [f"{n} as {'materialized ' if n in materialized else ''}({plain_sql(VIEWS[n]) if n in VIEWS else BASE[n]})" for n in order if n in wanted]
    body = plain_sql(sql).strip()
    if not parts:
        return body
    if body.startswith("with "):
        return "with recursive " + ",\n".join([*parts, body[5:]])
    return "with recursive " + ",\n".join(parts) + "\n" + body
