"""Relational views over replayed books, each a plan on the views that it names in braces.

mbo, book, levels and flow come from the operators; everything here is joins,
windows and aggregates that the optimizer plans. Prices are fixed-point (1e9).
"""

from __future__ import annotations

from ..operators.lookback import NAMES as LOOKBACK_NAMES

TICK = 250000000
DAY_NS = 86400000000000
#: Target and stop of each label, in ticks; the longest hold, in days.
GEOMETRIES = ((1, 1), (2, 1), (2, 2))
HORIZON_DAYS = 30
TICK_VALUE, COMMISSION = 1.25, 1.24

_GEOMS = " union all ".join(f"select {t} as target_ticks, {s} as stop_ticks" for t, s in GEOMETRIES)


def _norm(x: str) -> str:
    return f"round({x}, 6) + 0e0"


VIEWS: dict[str, str] = {
    "commits": f"""
select instrument_id, seq, ts_ns, bid, ask, bid_size, ask_size, n_bids, n_asks,
       row_number() over (partition by instrument_id order by seq) as commit_no,
       case when bid is not null and ask is not null then (bid + ask) / 2e9 else 0e0 end as mid,
       case when bid is not null and ask is not null then (ask - bid) / 1e9 else 0e0 end as spread,
       (bid is distinct from lag(bid) over (partition by instrument_id order by seq)
        or ask is distinct from lag(ask) over (partition by instrument_id order by seq)) as bbo_changed
from {{book}} where is_commit = 1""".replace("{{", "{").replace("}}", "}"),
    "batches": """
select instrument_id, seq, ts_ns, is_commit, action, (bid is distinct from pre_bid or ask is distinct from pre_ask) as moved,
       coalesce(sum(is_commit) over (partition by instrument_id order by seq rows between unbounded preceding and 1 preceding), 0) as batch
from {book}""",
    "masks": """
select instrument_id, max(case when is_commit = 1 then seq end) as seq,
       bit_or(case when not moved then 0 when action in ('T', 'F') then 1 when action = 'C' then 2 when action = 'A' then 4 when action = 'M' then 8 else 0 end) as mask
from {batches} group by instrument_id, batch""",
    "causes": """
select c.instrument_id, c.seq, c.bbo_changed, cast(m.mask as int) as mask,
       case when not c.bbo_changed or m.mask = 0 then 0 when bit_count(m.mask) > 1 then 5 when m.mask = 1 then 1 when m.mask = 2 then 2 when m.mask = 4 then 3 else 4 end as cause
from {commits} c join {masks} m on m.instrument_id = c.instrument_id and m.seq = c.seq""",
    "sides": """
select instrument_id, seq, bid, ask, bid_size, ask_size,
       lag(bid) over (partition by instrument_id order by seq) as bid0, coalesce(lag(bid_size) over (partition by instrument_id order by seq), 0) as bid_size0,
       lag(ask) over (partition by instrument_id order by seq) as ask0, coalesce(lag(ask_size) over (partition by instrument_id order by seq), 0) as ask_size0
from {commits}""",
    # both sides by the rule of the bid: a higher price counts as improved
    "ofi": """
select instrument_id, seq, cast(
  case when bid is null and bid0 is null then 0 when bid0 is null then bid_size when bid is null then -bid_size0 when bid > bid0 then bid_size when bid = bid0 then bid_size - bid_size0 else -bid_size0 end
  - case when ask is null and ask0 is null then 0 when ask0 is null then ask_size when ask is null then -ask_size0 when ask > ask0 then ask_size when ask = ask0 then ask_size - ask_size0 else -ask_size0 end as bigint) as ofi
from {sides}""",
    # the same with the ask's sign as in the literature: a lower ask counts as improved
    "ofi_signed": """
select instrument_id, seq, cast(
  case when bid is null and bid0 is null then 0 when bid0 is null then bid_size when bid is null then -bid_size0 when bid > bid0 then bid_size when bid = bid0 then bid_size - bid_size0 else -bid_size0 end
  - case when ask is null and ask0 is null then 0 when ask0 is null then ask_size when ask is null then -ask_size0 when ask < ask0 then ask_size when ask = ask0 then ask_size - ask_size0 else -ask_size0 end as bigint) as ofi
from {sides}""",
    "lob_sums": """
select c.instrument_id, c.seq, c.spread, c.n_bids, c.n_asks,
""" + ",\n".join(f"coalesce(sum(case when side = '{s}' and lvl < {k} then size end), 0) as {s.lower()}{k}" for s in "BA" for k in (1, 3, 5, 10)) + ",\n" + ",\n".join(
        f"coalesce(sum(case when side = '{s}' then size / (lvl + 1e0) end), 0) as {s.lower()}w, coalesce(sum(case when side = '{s}' then size * size end), 0) as {s.lower()}sq, "
        f"coalesce(sum(case when side = '{s}' then lvl * size end), 0) as {s.lower()}xy, coalesce(sum(case when side = '{s}' then lvl end), 0) as {s.lower()}x, coalesce(sum(case when side = '{s}' then lvl * lvl end), 0) as {s.lower()}xx"
        for s in "BA"
    ) + ",\n" + ",\n".join(f"coalesce(max(case when side = '{s}' and lvl = {k} then size end), 0) as {n}_size_{k}" for s, n in (("B", "bid"), ("A", "ask")) for k in range(10)) + """
from {commits} c left join {levels} l on l.instrument_id = c.instrument_id and l.seq = c.seq
group by c.instrument_id, c.seq, c.spread, c.n_bids, c.n_asks""",
    "ticks": """
select instrument_id, seq, ts_ns, mid, row_number() over (partition by instrument_id order by seq) as idx
from {commits} where bid is not null and ask is not null""",
    "entries": """
select c.instrument_id, c.seq, c.ts_ns, f.ofi_fast, case when f.ofi_fast >= 0 then 1 else -1 end as direction,
       case when f.ofi_fast >= 0 then c.ask else c.bid end / 1e9 as entry_price
from {commits} c join {flow} f on f.instrument_id = c.instrument_id and f.seq = c.seq
where c.bbo_changed and c.bid is not null and c.ask is not null""",
    "geometries": _GEOMS,
    # ticks are met through buckets of one horizon, so an entry sees two buckets at most
    "passages": f"""
select e.seq, g.target_ticks, g.stop_ticks, min(t.idx) as hit
from {{entries}} e cross join {{geometries}} g
join (select *, cast(floor(ts_ns / {HORIZON_DAYS * DAY_NS}e0) as bigint) + d.i as bucket from {{ticks}} cross join (select 0 as i union all select -1) d) t
  on t.instrument_id = e.instrument_id and t.bucket = cast(floor(e.ts_ns / {HORIZON_DAYS * DAY_NS}e0) as bigint)
where t.ts_ns > e.ts_ns and t.ts_ns <= e.ts_ns + {HORIZON_DAYS * DAY_NS}
  and ((t.mid - e.entry_price) * e.direction / 0.25e0 >= g.target_ticks or (t.mid - e.entry_price) * e.direction / 0.25e0 <= -g.stop_ticks)
group by e.seq, g.target_ticks, g.stop_ticks""",
    # the first tick beyond the horizon: each tick's next ticks are in order, so one backward join finds it
    "beyond": f"""
select seq, instrument_id, FIRSTV(case when kind = 1 then idx end) over (partition by instrument_id order by moment, kind rows between current row and unbounded following) as late, kind
from (select seq, instrument_id, cast(null as bigint) as idx, ts_ns + {HORIZON_DAYS * DAY_NS} + 1 as moment, 0 as kind from {{entries}}
      union all select seq, instrument_id, idx, ts_ns, 1 from {{ticks}}) x""",
    "labels_raw": """
select e.instrument_id, e.seq, e.ts_ns, e.ofi_fast, e.direction, e.entry_price, g.target_ticks, g.stop_ticks,
       p.hit, b.late, l.idx as last_idx
from {entries} e cross join {geometries} g
left join {passages} p on p.seq = e.seq and p.target_ticks = g.target_ticks and p.stop_ticks = g.stop_ticks
left join (select * from {beyond} where kind = 0) b on b.seq = e.seq
left join (select instrument_id, max(idx) as idx from {ticks} group by instrument_id) l on l.instrument_id = e.instrument_id""",
    "outcomes": """
select r.instrument_id, r.seq, r.ts_ns, r.ofi_fast, r.direction, r.target_ticks, r.stop_ticks,
       case when r.hit is null then -1 when (t.mid - r.entry_price) * r.direction / 0.25e0 >= r.target_ticks then 1 else 0 end as outcome,
       t.ts_ns as exit_ts, (t.mid - r.entry_price) * r.direction / 0.25e0 as pnl_ticks
from {labels_raw} r join {ticks} t on t.instrument_id = r.instrument_id and t.idx = coalesce(r.hit, r.late, r.last_idx)""",
    "tokens_of": f"""
select instrument_id, seq, action, is_commit,
       case action when 'A' then 4 when 'C' then 5 when 'M' then 6 when 'T' then 7 when 'F' then 8 when 'R' then 9 end as t_action,
       case side when 'B' then 10 when 'A' then 11 else 12 end as t_side,
       case when pre_bid is null or pre_ask is null then 116
            when round((price_fp - IDIV(pre_bid + pre_ask,2)) / {TICK}e0) < -50 then 13
            when round((price_fp - IDIV(pre_bid + pre_ask,2)) / {TICK}e0) > 50 then 115
            else 64 + cast(round((price_fp - IDIV(pre_bid + pre_ask,2)) / {TICK}e0) as int) end as t_price,
       case when size < 2 then 117 + cast(size as int) when size < 4 then 119 when size < 8 then 120 when size < 16 then 121
            when size < 32 then 122 when size < 64 then 123 when size < 128 then 124 else 125 end as t_size
from {{book}}""",
    "slots": """
select instrument_id, seq, slot, token from (
  select instrument_id, seq, 1 as slot, t_action as token from {tokens_of} where t_action is not null
  union all select instrument_id, seq, 2, t_side from {tokens_of} where t_action between 4 and 8
  union all select instrument_id, seq, 3, t_price from {tokens_of} where t_action between 4 and 8
  union all select instrument_id, seq, 4, t_size from {tokens_of} where t_action between 4 and 8
  union all select instrument_id, seq, 5, 3 from {tokens_of} where t_action is not null and is_commit = 1
  union all select instrument_id, min(seq), 0, 1 from {tokens_of} group by instrument_id
  union all select instrument_id, max(seq), 6, 2 from {tokens_of} group by instrument_id) s""",
    "tokens": """
select instrument_id, row_number() over (partition by instrument_id order by seq, slot) - 1 as pos, token, seq from {slots}""",
    "halves": """
select t.instrument_id, pos, token, case when pos < floor(n * 0.8e0) then 1 else 0 end as training
from {tokens} t join (select instrument_id, count(*) as n from {tokens} group by instrument_id) c on c.instrument_id = t.instrument_id""",
    "days": f"""
select day, row_number() over (order by day) - 1 as day_no, n, cum - n as row_start, cum as row_end, ntile(6) over (order by day) - 1 as grp
from (select day, n, sum(n) over (order by day) as cum from (select cast(floor(ts_ns / {DAY_NS}e0) as bigint) as day, count(*) as n from {{mbo}} group by cast(floor(ts_ns / {DAY_NS}e0) as bigint)) a) b""",
    "splits": """
select row_number() over (order by a.i, b.i) - 1 as split, a.i as g1, b.i as g2 from SERIES(0,5) a join SERIES(0,5) b on a.i < b.i""",
    "candidates": """
select *, ((seq * 7919 + target_ticks * 104729 + stop_ticks * 1299709) % 1000) / 1000e0 as p from {outcomes} where outcome >= 0""",
    # a feed with lost messages; blocks of arrivals keep the window over them parallel, and only their ends are ordered as a whole
    "arrivals": "select seq as arrival, seq as number, cast(floor(seq / 4096e0) as bigint) as block from {mbo} where seq % 97 not in (0, 30)",
    "block_ends": "select block, first_number, lag(last_number) over (order by block) as before from (select block, min_by(number, arrival) as first_number, max_by(number, arrival) as last_number from {arrivals} group by block) a",
    "breaks": """
select arrival, number, prev from (
  select a.arrival, a.number, coalesce(lag(a.number) over (partition by a.block order by a.arrival), e.before) as prev
  from {arrivals} a join {block_ends} e on e.block = a.block) b
where number <> prev + 1""",
    # numbers are consecutive between two breaks, so their difference is the streak
    "streaks": """
select arrival, number, prev, prev - coalesce(lag(number) over (order by arrival), (select min_by(first_number, block) from {block_ends})) as streak from {breaks}""",
    # a second feed of quotes that loses some, and whose clock is off by up to 3 microseconds
    "quotes": """
select instrument_id, seq, bid, ask, ts_ns + ((seq * 31) % 7 - 3) * 1000 as ts_ns, row_number() over (partition by instrument_id order by seq) as k
from {commits} where bbo_changed and bid is not null and ask is not null and seq % 5 <> 0""",
    "pointed": """
select instrument_id, seq, ts_ns, bid, ask,
       sum(case when bbo_changed and bid is not null and ask is not null and seq % 5 <> 0 then 1 else 0 end) over (partition by instrument_id order by seq) as held
from {commits}""",
    # the last eight quotes of a commit, best match first: equal prices, then the nearest time, then the lowest slot
    "ring": """
select p.instrument_id, p.seq, p.bid, p.ask, q.bid as quote_bid, q.ask as quote_ask, q.seq as quote_seq, case when q.bid = p.bid and q.ask = p.ask then 1 else 0 end as exact,
       row_number() over (partition by p.instrument_id, p.seq order by case when q.bid = p.bid and q.ask = p.ask then 0 else 1 end, abs(q.ts_ns - p.ts_ns), (q.k - 1) % 8) as nth
from {pointed} p cross join SERIES(0,7) s join {quotes} q on q.instrument_id = p.instrument_id and q.k = p.held - s.i
where p.bid is not null and p.ask is not null""",
    # snapshots to verify against, some with a wrong size, some with a level that the book lacks
    "snapshots": "select instrument_id, ts_ns, max(seq) as seq from {commits} where seq % 4 <> 0 group by instrument_id, ts_ns",
    "snapshot_levels": """
select s.instrument_id, s.ts_ns, l.side, l.lvl, l.price_fp, l.size + case when s.seq % 50 = 1 and l.lvl = 0 then 1 else 0 end as size
from {snapshots} s join {levels} l on l.instrument_id = s.instrument_id and l.seq = s.seq
union all
select s.instrument_id, s.ts_ns, 'B', c.n_bids, 250000000, 1
from {snapshots} s join {commits} c on c.instrument_id = s.instrument_id and c.seq = s.seq where s.seq % 71 = 0 and c.n_bids < 10""",
    "checked": """
select b.instrument_id, b.seq,
       sum(case when l.side = 'B' and l.price_fp <> x.price_fp then 1 else 0 end) as bid_prices, sum(case when l.side = 'A' and l.price_fp <> x.price_fp then 1 else 0 end) as ask_prices,
       sum(case when l.side = 'B' and l.size <> x.size then 1 else 0 end) as bid_sizes, sum(case when l.side = 'A' and l.size <> x.size then 1 else 0 end) as ask_sizes,
       max(case when x.side is not null and l.side is null then 1 else 0 end) as fewer
from {book} b join {snapshots} s on s.instrument_id = b.instrument_id and s.ts_ns = b.ts_ns
left join {snapshot_levels} x on x.instrument_id = s.instrument_id and x.ts_ns = s.ts_ns
left join {levels} l on l.instrument_id = b.instrument_id and l.seq = b.seq and l.side = x.side and l.lvl = x.lvl
where b.is_commit = 1 and b.action <> 'R' group by b.instrument_id, b.seq""",
    # fixed values: the legal moves of a connection
    "legal_moves": " union all ".join(
        f"select '{a}' as from_state, '{b}' as to_state"
        for a, b in (
            ("Disconnected", "Connecting"),
            ("Connecting", "Authenticating"),
            ("Connecting", "Disconnected"),
            ("Authenticating", "Subscribing"),
            ("Authenticating", "Disconnected"),
            ("Subscribing", "Streaming"),
            ("Subscribing", "Disconnected"),
            ("Streaming", "Degraded"),
            ("Streaming", "Disconnected"),
            ("Degraded", "Disconnected"),
        )
    ),
    "moves": """
select instrument_id, seq, lag(state) over (partition by instrument_id order by seq) as from_state, state as to_state
from (select instrument_id, seq, case seq % 6 when 0 then 'Disconnected' when 1 then 'Connecting' when 2 then 'Authenticating' when 3 then 'Subscribing' when 4 then 'Streaming' else 'Degraded' end as state from {mbo}) a""",
}


def _ratio(a: str, b: str) -> str:
    return f"case when {a} + {b} > 0 then ({a} - {b}) / cast({a} + {b} as double) else 0e0 end"


def _hhi(s: str) -> str:
    return f"case when {s}10 > 0 then {s}sq / (cast({s}10 as double) * {s}10) else 0e0 end"


def _slope(s: str, n: str) -> str:
    return f"case when {n} >= 2 then ({n} * {s}xy - {s}x * {s}10) / cast({n} * {s}xx - {s}x * {s}x as double) else 0e0 end"


SCALES = ("fast", "med", "slow")
FLOWS = ("trade_flow", "cancel_bid", "cancel_ask", "add_bid", "add_ask", "event_intensity", "trade_intensity", "ofi")
_RAW = ", ".join(f"{_norm(f'f.{f}_{s}')} as {f}_{s}" for f in FLOWS for s in SCALES)
_DERIVED = {
    "cancel_asym": "(cancel_bid_{s} - cancel_ask_{s}) / (cancel_bid_{s} + cancel_ask_{s} + 1e-9)",
    "add_asym": "(add_bid_{s} - add_ask_{s}) / (add_bid_{s} + add_ask_{s} + 1e-9)",
    "ofi_norm": "ofi_{s} / (event_intensity_{s} + 1e-9)",
    "trade_size": "trade_flow_{s} / (trade_intensity_{s} + 1e-9)",
    "bid_renewal": "cancel_bid_{s} / (add_bid_{s} + 1e-9)",
    "ask_renewal": "cancel_ask_{s} / (add_ask_{s} + 1e-9)",
}
_SCALED = ", ".join(f"{_norm(x.replace('{s}', s)) if n not in ('bid_renewal', 'ask_renewal', 'trade_size') else 'round(' + x.replace('{s}', s) + ', 3) + 0e0'} as {n}_{s}" for n, x in _DERIVED.items() for s in SCALES)
_ACCEL = f"{_norm('trade_flow_fast - trade_flow_slow')} as trade_flow_accel, {_norm('ofi_fast - ofi_slow')} as ofi_accel, {_norm(_DERIVED['cancel_asym'].replace('{s}', 'fast') + ' - ' + _DERIVED['cancel_asym'].replace('{s}', 'slow'))} as cancel_asym_accel"
_NAME = """case token when 0 then 'PAD' when 1 then 'BOS' when 2 then 'EOS' when 3 then 'COMMIT' when 4 then 'ADD' when 5 then 'CANCEL' when 6 then 'MODIFY' when 7 then 'TRADE' when 8 then 'FILL' when 9 then 'CLEAR'
 when 10 then 'BID' when 11 then 'ASK' when 12 then 'SIDE:NONE' when 13 then 'P:FAR-' when 115 then 'P:FAR+' when 116 then 'P:NOREF' when 117 then 'SZ:0' when 118 then 'SZ:1' when 119 then 'SZ:2-3' when 120 then 'SZ:4-7'
 when 121 then 'SZ:8-15' when 122 then 'SZ:16-31' when 123 then 'SZ:32-63' when 124 then 'SZ:64-127' when 125 then 'SZ:128+'
 else concat('P:', case when token >= 64 then '+' else '-' end, cast(abs(token - 64) as varchar(4))) end"""
CLASS = "case when token <= 3 then 'SPECIAL' when token <= 9 then 'ACTION' when token <= 12 then 'SIDE' when token <= 116 then 'PRICE' else 'SIZE' end"


def _markov(order: int, by_class: bool = False) -> str:
    ctx = "concat_ws(' ', " + ", ".join(f"cast(lag(token, {k}) over w as varchar(8))" for k in range(order, 0, -1)) + ")"
    grams = f"select training, token, case when lag(token, {order}) over w is not null then {ctx} end as ctx from {{halves}} window w as (partition by instrument_id, training order by pos)"
    head = f"""
with g as ({grams}),
n as (select ctx, token, count(*) as c from g where training = 1 and ctx is not null group by ctx, token),
t as (select ctx, sum(c) as total from n group by ctx),
x as (select g.token, ln((coalesce(n.c, 0) + 1e0) / (coalesce(t.total, 0) + 126e0)) / ln(2e0) as l
      from g left join n on n.ctx = g.ctx and n.token = g.token left join t on t.ctx = g.ctx where g.training = 0 and g.ctx is not null)
"""
    if by_class:
        return head + f"select {CLASS} as token_class, count(*) as n, round(pow(2e0, -avg(l)), 6) as perplexity from x group by {CLASS}"
    return head + f"select {order} as context_order, count(*) as n, round(-avg(l), 6) as entropy_bits, round(pow(2e0, -avg(l)), 6) as perplexity, (select count(*) from t) as contexts from x"


_T = "1e0 / (1e0 + 0.2316419e0 * abs(z))"
#: The normal distribution by a five-term polynomial.
_CDF = f"""case when z >= 0 then 1 - 0.3989422804014327e0 * exp(-z * z / 2) * ({_T} * (0.319381530e0 + {_T} * (-0.356563782e0 + {_T} * (1.781477937e0 + {_T} * (-1.821255978e0 + {_T} * 1.330274429e0)))))
 else 0.3989422804014327e0 * exp(-z * z / 2) * ({_T} * (0.319381530e0 + {_T} * (-0.356563782e0 + {_T} * (1.781477937e0 + {_T} * (-1.821255978e0 + {_T} * 1.330274429e0))))) end"""
_METRICS = """count(*) as trades, round(avg(pnl), 6) as expectancy, round(avg(case when pnl > 0 then 1e0 else 0e0 end), 6) as win_rate,
 round(case when sum(case when pnl < 0 then -pnl else 0e0 end) > 0 then sum(case when pnl > 0 then pnl else 0e0 end) / sum(case when pnl < 0 then -pnl else 0e0 end) when sum(case when pnl > 0 then pnl else 0e0 end) > 0 then 1e308 else 0e0 end, 6) as profit_factor,
 round(sum(pnl), 6) as net_pnl, round(case when count(*) < 2 or stddev_samp(pnl) < 1e-12 then 0e0 else avg(pnl) / stddev_samp(pnl) * sqrt(12600e0 / count(*)) end, 6) as sharpe"""
_PNL = f"pnl_ticks * {TICK_VALUE}e0 - {COMMISSION}e0"
_P_NULL = "stop_ticks / cast(target_ticks + stop_ticks as double)"

QUERIES: dict[str, str] = {
    "mbo_projection": "select seq, ts_ns, instrument_id, order_id, action, side, price_fp, size, flags from {mbo}",
    "ingest_summary": "select instrument_id, count(*) as records, min_by(ts_ns, seq) as first_ts, max_by(ts_ns, seq) as last_ts from {mbo} group by instrument_id",
    "detect_instrument": "select instrument_id, count(*) as n from {mbo} group by instrument_id order by n desc, instrument_id limit 1",
    "book_bbo_commits": "select instrument_id, seq, ts_ns, bid, ask, bid_size, ask_size, n_bids, n_asks, round(mid, 6) as mid, round(spread, 6) as spread, bbo_changed from {commits}",
    "book_bbo_events": "select instrument_id, seq, pre_bid, pre_ask, bid, ask, bid_size, ask_size, n_bids, n_asks from {book}",
    "book_top10": "select instrument_id, seq, side, lvl, price_fp, size from {levels}",
    "bbo_changes": "select instrument_id, seq, ts_ns, bid, ask from {commits} where bbo_changed",
    "bbo_cause": "select instrument_id, seq, mask, cause from {causes}",
    "flow_averages": f"select f.instrument_id, f.seq, {_RAW} from {{flow}} f",
    "flow_ofi": "select instrument_id, seq, ofi from {ofi}",
    "flow_ofi_signed": "select instrument_id, seq, ofi from {ofi_signed}",
    "inter_event": "select instrument_id, seq, inter_event_time_ns, round(event_rate, 9) as event_rate from {flow}",
    "flow_features": f"select f.instrument_id, f.seq, {_RAW}, f.inter_event_time_ns, round(f.event_rate, 9) as event_rate, c.cause as bbo_change_cause, {_SCALED}, {_ACCEL} from {{flow}} f join {{causes}} c on c.instrument_id = f.instrument_id and c.seq = f.seq",
    "gate_features": "select f.instrument_id, f.seq, " + ", ".join(f"{_norm(f'ofi_{s}')} as ofi_{s}, {_norm(_DERIVED['ofi_norm'].replace('{s}', s))} as ofi_norm_{s}, {_norm(_DERIVED['cancel_asym'].replace('{s}', s))} as cancel_asym_{s}" for s in SCALES) + ", c.cause as bbo_change_cause from {flow} f join {causes} c on c.instrument_id = f.instrument_id and c.seq = f.seq",
    "lob_static": "select instrument_id, seq, " + ", ".join(f"cast({n}_size_{k} as bigint) as {n}_size_{k}" for n in ("bid", "ask") for k in range(10)) + ", "
    + ", ".join(f"{_norm(_ratio(f'b{k}', f'a{k}'))} as imbalance_d{k}" for k in (1, 3, 5, 10)) + f", {_norm('case when bw + aw > 0 then (bw - aw) / (bw + aw) else 0e0 end')} as weighted_imbalance, round(spread / 0.25e0, 6) as spread_ticks, "
    f"{_norm(_hhi('b'))} as bid_hhi, {_norm(_hhi('a'))} as ask_hhi, {_norm(_slope('b', 'n_bids'))} as bid_slope, {_norm(_slope('a', 'n_asks'))} as ask_slope, n_bids as bid_levels, n_asks as ask_levels from {{lob_sums}}".replace("{{", "{").replace("}}", "}"),
    "barrier_labels": "select instrument_id, seq, direction, target_ticks, stop_ticks, outcome, exit_ts, round(pnl_ticks, 6) + 0e0 as pnl_ticks from {outcomes}",
    "baseline_null_check": f"select target_ticks, stop_ticks, count(*) as n, cast(sum(case when outcome = 1 then 1 else 0 end) as bigint) as targets, cast(sum(case when outcome = 0 then 1 else 0 end) as bigint) as stops, cast(sum(case when outcome = -1 then 1 else 0 end) as bigint) as horizons, round(sum(case when outcome = 1 then 1e0 else 0e0 end) / nullif(sum(case when outcome >= 0 then 1e0 else 0e0 end), 0) - {_P_NULL}, 6) as delta from {{outcomes}} group by target_ticks, stop_ticks",
    "daily_outcomes": f"select cast(floor(ts_ns / {DAY_NS}e0) as bigint) as day, count(*) as n, cast(sum(case when outcome = 1 then 1 else 0 end) as bigint) as targets, cast(sum(case when outcome = 0 then 1 else 0 end) as bigint) as stops from {{outcomes}} group by cast(floor(ts_ns / {DAY_NS}e0) as bigint)",
    "feature_sanity": "select " + ", ".join(f"cast(sum(case when {f}_{s} is null or isnan({f}_{s}) or abs({f}_{s}) > 1e300 then 1 else 0 end) as bigint) as {f}_{s}" for f in FLOWS for s in SCALES) + ", count(*) as n from {flow}",
    "imbalance_filter": "select seq, target_ticks, stop_ticks, cast(outcome as double) as label from {outcomes} where outcome >= 0 and abs(ofi_fast) > 2 and target_ticks = 2 and stop_ticks = 1",
    "arithmetic_subsample": "select seq, target_ticks, stop_ticks, outcome from {outcomes} where outcome >= 0 and (seq * 48271 + 11) % 1000 < 250",
    "tokenize": "select instrument_id, pos, token, seq from {tokens}",
    "token_names": f"select instrument_id, pos, {_NAME} as name, {CLASS} as token_class from {{tokens}}",
    "token_stats": f"select instrument_id, count(*) as tokens, count(distinct seq) as events, cast(sum(case when token = 3 then 1 else 0 end) as bigint) as commits, cast(sum(case when token = 13 then 1 else 0 end) as bigint) as far_low, cast(sum(case when token = 115 then 1 else 0 end) as bigint) as far_high, cast(sum(case when token = 116 then 1 else 0 end) as bigint) as no_reference, {', '.join(f'cast(sum(case when token = {k} then 1 else 0 end) as bigint) as token_{k}' for k in [*range(4, 13), *range(117, 126)])} from {{tokens}} group by instrument_id",
    "price_histogram": "select token - 64 as ticks, count(*) as n from {tokens} where token between 13 and 116 group by token - 64",
    "commit_positions": "select instrument_id, pos from {tokens} where token = 3",
    "temporal_split": "select instrument_id, training, count(*) as n, min(pos) as first_pos, max(pos) as last_pos from {halves} group by instrument_id, training",
    "direction_targets": """select instrument_id, seq, case when next_at is null or next_at - commit_no > 2000 then -1 when next_level > level then 1 else 0 end as direction from (
 select instrument_id, seq, commit_no, level, FIRSTV(case when moved then commit_no end) over f as next_at, FIRSTV(case when moved then level end) over f as next_level from (
  select instrument_id, seq, commit_no, bid + ask as level, bid + ask <> lag(bid + ask) over (partition by instrument_id order by seq) as moved from {commits} where bid is not null and ask is not null) a
 window f as (partition by instrument_id order by seq rows between 1 following and unbounded following)) b""",
    "recon_targets": "select instrument_id, seq, side, lvl, case when size <= 1 then 0 when size <= 2 then 1 when size <= 4 then 2 when size <= 8 then 3 when size <= 16 then 4 when size <= 32 then 5 when size <= 64 then 6 when size <= 128 then 7 else 8 end as bucket from {levels} where lvl < 5",
    "recon_baselines": "select side, lvl, max(n) as modal, sum(n) as total, round(max(n) / cast(sum(n) as double), 6) as mode_accuracy from (select side, lvl, bucket, count(*) as n from (select side, lvl, case when size <= 1 then 0 when size <= 2 then 1 when size <= 4 then 2 when size <= 8 then 3 when size <= 16 then 4 when size <= 32 then 5 when size <= 64 then 6 when size <= 128 then 7 else 8 end as bucket from {levels} where lvl < 5) a group by side, lvl, bucket) b group by side, lvl",
    "markov_order1": _markov(1),
    "markov_order2": _markov(2),
    "markov_order3": _markov(3),
    "markov_by_class": _markov(1, True),
    "cpcv_groups": "select day, day_no, n, cast(row_start as bigint) as row_start, cast(row_end as bigint) as row_end, cast(grp as int) as grp from {days}",
    "cpcv_splits": "select cast(s.split as int) as split, d.day, case when d.grp in (s.g1, s.g2) then 1 else 0 end as test from {splits} s cross join {days} d",
    "cpcv_token_ranges": """with n as (select cast(floor(count(*) / 6e0) as bigint) as per from {tokens}),
g as (select i as grp, i * per as s, (i + 1) * per as e from SERIES(0,5) x cross join n)
select cast(p.split as int) as split, cast(g.grp as int) as grp, case when g.grp in (g1, g2) then 'test' else 'train' end as role,
 case when g.grp not in (g1, g2) and g.grp - 1 in (g1, g2) then least(s + 300, e) else s end as range_start,
 case when g.grp not in (g1, g2) and g.grp + 1 in (g1, g2) then greatest(e - 300, s) else e end as range_end from {splits} p cross join g""",
    "calibration": "select b.i as bin, count(c.p) as n, round(coalesce(avg(c.p), (b.i + 0.5e0) / 10), 9) as mean_predicted, round(coalesce(avg(case when c.outcome = 1 then 1e0 else 0e0 end), 0e0), 6) as observed from SERIES(0,9) b left join {candidates} c on least(cast(floor(c.p * 10) as int), 9) = b.i group by b.i".replace("coalesce(avg(case when c.outcome = 1 then 1e0 else 0e0 end), 0e0)", "avg(case when c.p is null then 0e0 when c.outcome = 1 then 1e0 else 0e0 end)"),
    "logloss": "select target_ticks, stop_ticks, round(-avg(case when outcome = 1 then ln(greatest(p, 1e-15)) else ln(1 - least(p, 1 - 1e-15)) end), 6) as logloss from {candidates} group by target_ticks, stop_ticks",
    "overlapping_pnl": f"select target_ticks, stop_ticks, {_METRICS} from (select target_ticks, stop_ticks, {_PNL} as pnl from {{candidates}} where p > {_P_NULL} + 0.1e0) a group by target_ticks, stop_ticks",
    "serial_trades": "select instrument_id, seq, target_ticks, stop_ticks, exit_ts from {trades}",
    "geometry_metrics": f"select target_ticks, stop_ticks, {_METRICS} from (select target_ticks, stop_ticks, {_PNL} as pnl from {{trades}}) a group by target_ticks, stop_ticks",
    "serial_pnl": f"select {_METRICS} from (select {_PNL} as pnl from {{trades}}) a",
    "deflated_sharpe": f"select target_ticks, stop_ticks, round(sharpe, 6) as sharpe, round(case when sharpe <= 0 then 0e0 else {_CDF} end, 6) as deflated from (select *, sharpe - (sqrt(2 * ln(15e0)) - (0.5772156649e0 + ln(pi() / 2)) / (2 * sqrt(2 * ln(15e0)))) as z from (select target_ticks, stop_ticks, case when count(*) < 2 or stddev_samp(pnl) < 1e-12 then 0e0 else avg(pnl) / stddev_samp(pnl) * sqrt(12600e0 / count(*)) end as sharpe from (select target_ticks, stop_ticks, {_PNL} as pnl from {{trades}}) a group by target_ticks, stop_ticks) b) c",
    "ljung_box": f"""with s as (select target_ticks, stop_ticks, row_number() over (partition by target_ticks, stop_ticks order by instrument_id, seq) as t, {_PNL} as x from {{trades}}),
m as (select target_ticks, stop_ticks, avg(x) as mean, count(*) as n from s group by target_ticks, stop_ticks),
d as (select s.target_ticks, s.stop_ticks, t, x - mean as y, n from s join m on m.target_ticks = s.target_ticks and m.stop_ticks = s.stop_ticks where n > 20),
v as (select target_ticks, stop_ticks, sum(y * y) as var from d group by target_ticks, stop_ticks),
c as (select a.target_ticks, a.stop_ticks, k.i as lag, max(a.n) as n, sum(a.y * b.y) as cov from d a cross join SERIES(1,10) k join d b on b.target_ticks = a.target_ticks and b.stop_ticks = a.stop_ticks and b.t = a.t - k.i group by a.target_ticks, a.stop_ticks, k.i),
q as (select c.target_ticks, c.stop_ticks, max(n) * (max(n) + 2e0) * sum(cov / var * (cov / var) / (n - lag)) as q from c join v on v.target_ticks = c.target_ticks and v.stop_ticks = c.stop_ticks group by c.target_ticks, c.stop_ticks),
w as (select *, (pow(q / 10, 1e0 / 3) - (1 - 2e0 / 90)) / sqrt(2e0 / 90) as z from q)
select target_ticks, stop_ticks, round(q, 5) as q, round(1 - ({_CDF}), 5) as p_value from w""",
    "execution_costs": "select instrument_id, seq, round(2 * (0.62e0 + 1 / 2e0 * 1.25e0), 6) as fixed_round_trip, round(2 * (0.62e0 + spread / 0.25e0 / 2e0 * 1.25e0), 6) as empirical_round_trip from {commits} where bid is not null and ask is not null",
    "tree_score": "select instrument_id, seq, round(1 / (1 + exp(-(m1 + m2))), 6) as p from (select instrument_id, seq, case when ofi_fast < 0e0 then case when event_rate < 1e-5 then -0.3e0 else -0.1e0 end else case when trade_flow_fast < 2e0 then 0.05e0 else 0.4e0 end end as m1, case when cancel_bid_fast < 3e0 then 0.1e0 else -0.2e0 end as m2 from {flow}) a",
    "two_stage": "select instrument_id, seq, case when p_dir < 0.5e0 then 0 when p_long > 0.5e0 then 1 else -1 end as signal from (select instrument_id, seq, 1 / (1 + exp(-(ofi_fast / 10))) as p_long, 1 / (1 + exp(-(trade_flow_fast / 5))) as p_dir from {flow}) a",
    "latency_histogram": "select bucket, count(*) as n from (select case when ms < 0.5e0 then 0 when ms < 1 then 1 when ms < 2 then 2 when ms < 4 then 3 when ms < 8 then 4 when ms < 16 then 5 when ms < 32 then 6 when ms < 64 then 7 when ms < 128 then 8 when ms < 256 then 9 when ms < 512 then 10 else 11 end as bucket from (select (seq * 7919 % 10000) / 10e0 as ms from {mbo}) a) b group by bucket",
    "lob_window": "select instrument_id, seq, " + ", ".join(f"{_norm(n)} as {n}" for n in LOOKBACK_NAMES) + " from {lob_window}",
    "stream_book": "select instrument_id, seq, ts_ns, bid, ask, bid_size, ask_size, n_bids, n_asks from {stream_commits}",
    "recovery_gaps": "select arrival, prev, number, number - prev - 1 as missing, streak from {streaks} where streak >= 50",
    "bbo_ring_match": f"select instrument_id, seq, quote_seq, exact, cast(IDIV(abs(bid - quote_bid),{TICK}) * sign(bid - quote_bid) as bigint) as bid_ticks, cast(IDIV(abs(ask - quote_ask),{TICK}) * sign(ask - quote_ask) as bigint) as ask_ticks from {{ring}} where nth = 1",
    "book_verify": """select instrument_id, count(*) as checks, cast(sum(bid_prices) as bigint) as bid_price_mismatches, cast(sum(ask_prices) as bigint) as ask_price_mismatches,
 cast(sum(bid_sizes) as bigint) as bid_size_mismatches, cast(sum(ask_sizes) as bigint) as ask_size_mismatches, cast(sum(fewer) as bigint) as level_count_mismatches,
 cast(sum(case when bid_prices + ask_prices + bid_sizes + ask_sizes + fewer = 0 then 1 else 0 end) as bigint) as matches from {checked} group by instrument_id""",
    "state_machine": "select m.instrument_id, m.seq, m.from_state, m.to_state, case when l.to_state is null then 0 else 1 end as legal from {moves} m left join {legal_moves} l on l.from_state = m.from_state and l.to_state = m.to_state where m.from_state is not null",
    "counters": "select instrument_id, action, count(*) as n from {mbo} group by instrument_id, action",
}
