"""The registered queries again as DuckDB SQL over the same tables.

Written from the definitions (lists filtered by time, self-joins, recursion),
not from the Spark plans, so that agreement means something.
"""

from __future__ import annotations

import numpy as np

from ..operators.learning import PRIME
from .tapes import STEP_US, TAPE_START_US

FEATURES = (
    "price_z", "price_pct_move", "size_vs_median", "trades_in_5s",
    "side_imbalance", "notional_log", "spread_from_last", "qty_z",
)

TAPE = f"""tape as (
  select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   cast(round(l_extendedprice * 100) as bigint)) as trade_id,
         {TAPE_START_US} + (l_orderkey * 4 + l_linenumber) * {STEP_US} as event_us,
         case when l_suppkey % 3 = 0 then 'SYM00'
              else 'SYM' || lpad(cast(l_suppkey % 20 as varchar), 2, '0') end as symbol,
         (cast(50.0 as double) + (l_suppkey % 20) * 5 + (l_partkey % 400) * cast(0.01 as double)
           + case when l_orderkey % 389 = 0 then cast(25.0 as double) else cast(0.0 as double) end)
           * cast(1.000013718281828 as double) as price,
         (cast(l_quantity as int) % 10 + 1) * cast(100.0 as double)
           * case when l_orderkey % 211 = 0 then 20 else 1 end as quantity,
         case when (l_orderkey // 64) % 29 = 0 or l_linestatus = 'O' then 'buy' else 'sell' end as side,
         'acct_' || (o_custkey % 8) as account_id,
         'acct_' || (l_partkey % 64) as counterparty_id,
         'V' || (l_linenumber % 3) as venue,
         case when l_orderkey % 389 = 0 then 'price_spike'
              when l_orderkey % 211 = 0 then 'volume_spike'
              when (l_orderkey // 64) % 29 = 0 then 'spoofing' end as label,
         l_orderkey as o, l_partkey as p
  from lineitem join orders on l_orderkey = o_orderkey)"""

EVENTS = """tape as (
  select 'evt-' || event_id as trade_id, epoch_us(ts) as event_us, upper(event_type) as symbol,
         value + 1.0 as price, cast(user_id % 10 + 1 as double) as quantity,
         case when event_id % 2 = 0 then 'buy' else 'sell' end as side
  from events)"""

# lists of the last 200 rows, cut to the last 300 seconds; "before" leaves the trade itself out
WINDOWS = """
held as (
  select *, list_filter(list({'us': event_us, 'p': price, 'q': quantity, 's': side}) over last200,
                        lambda x: x.us >= event_us - 300000000) as live,
         row_number() over (partition by symbol order by event_us, trade_id) as rn
  from tape window last200 as (partition by symbol order by event_us, trade_id
                               rows between 199 preceding and current row)),
parts as (
  select *, len(live) as n,
         list_transform(live[1:len(live) - 1], lambda x: x.p) as ps,
         list_transform(live[1:len(live) - 1], lambda x: x.q) as qs,
         list_sort(list_transform(live, lambda x: x.q))[1:len(live) - 1] as trimmed,
         list_filter(live, lambda x: x.us >= event_us - 5000000) as live5,
         list_filter(live, lambda x: x.us >= event_us - 3000000) as live3
  from held),
win as materialized (
  select trade_id, event_us, symbol, price, quantity, account_id, counterparty_id, label, side, rn, n, n > 20 as ready,
         coalesce(list_avg(ps), 0) as price_mean,
         case when n > 2 then list_stddev_samp(ps) else 0 end as price_std,
         coalesce(list_avg(qs), 0) as volume_mean,
         case when n > 2 then list_stddev_samp(qs) else 0 end as volume_std,
         coalesce(list_median(trimmed), 0) as volume_median,
         case when n > 1 then ps[-1] end as previous_price,
         len(live5) as velocity,
         len(list_filter(live3, lambda x: x.s = 'buy')) as buys,
         len(list_filter(live3, lambda x: x.s <> 'buy')) as sells
  from parts)"""
EVENT_COLUMNS = "null as account_id, null as counterparty_id, null as label"

WASH = """
slim as materialized (
  select trade_id, symbol, account_id, side, event_us, price, quantity,
         row_number() over (partition by symbol order by event_us, trade_id) as rn from tape),
wash as materialized (
  select a.trade_id, arg_max(b.trade_id, b.rn) as matched_trade_id
  from slim a join slim b on a.symbol = b.symbol and a.account_id = b.account_id and a.side <> b.side
   and b.rn < a.rn and a.rn - b.rn < 200 and b.event_us >= a.event_us - 5000000
   and abs(b.price - a.price) / a.price <= 0.001
   and abs(b.quantity - a.quantity) / greatest(b.quantity, a.quantity, 1e-9) <= 0.02
  group by 1)"""

Z = "case when price_std > 1e-12 then (price - price_mean) / price_std else 0 end"
MOVE = "case when previous_price > 0 then (price - previous_price) / previous_price end"
RATIO = "case when volume_median > 0 then quantity / volume_median end"
SPOOF = "greatest(buys, sells) / (least(buys, sells) + 1.0)"

# name -> (fires, severity, score)
DETECTORS = {
    "zscore": (
        f"ready and abs({Z}) >= 3.0",
        f"case when abs({Z}) >= 3.0 * 1.6 then 'critical' else 'high' end",
        f"least(1.0, 0.6 + 0.4 * (abs({Z}) - 3.0) / 3.0)",
    ),
    "price_spike": (
        f"abs({MOVE}) >= 0.03",
        f"case when abs({MOVE}) >= 0.08 then 'critical' else 'high' end",
        f"least(1.0, abs({MOVE}) / 0.08)",
    ),
    "volume_spike": (
        f"ready and {RATIO} >= 6",
        f"case when {RATIO} >= 15 then 'critical' else 'high' end",
        f"least(1.0, {RATIO} / 15)",
    ),
    "velocity": (
        "velocity >= 25",
        "case when velocity >= 60 then 'critical' else 'medium' end",
        "least(1.0, velocity / 60.0)",
    ),
    "spoofing": (f"buys + sells >= 8 and {SPOOF} >= 5", "'high'", f"least(1.0, {SPOOF} / 10)"),
    "wash_trade": (
        "(account_id = counterparty_id or matched_trade_id is not null)",
        "'critical'",
        "case when account_id = counterparty_id then 0.98 else 0.95 end",
    ),
}

CANDIDATES = "cand as (\n" + " union all\n".join(
    f"  select trade_id, symbol, event_us, '{name}' as detector, {i} as position, {severity} as severity,"
    f" cast({score} as double) as score\n  from win left join wash using (trade_id) where {fires}"
    for i, (name, (fires, severity, score)) in enumerate(DETECTORS.items())
) + ")"

COOLDOWN = """
times as (select distinct symbol, detector, event_us from cand),
chain as (
  select symbol, detector, min(event_us) as event_us from times group by 1, 2
  union all
  select c.symbol, c.detector, min(t.event_us)
  from chain c join times t on t.symbol = c.symbol and t.detector = c.detector and t.event_us >= c.event_us + 8000000
  group by 1, 2),
firsts as (select symbol, detector, event_us, min(trade_id) as trade_id from cand group by 1, 2, 3),
alerts as (select cand.* from cand join firsts using (symbol, detector, event_us, trade_id)
           join chain using (symbol, detector, event_us))"""

BATCH = """
rolled as (
  select *, event_us // 1000000 as ts_seconds,
         avg(price) over prior as price_mean, stddev_samp(price) over prior as price_std,
         avg(quantity) over prior as vol_mean
  from tape window prior as (partition by symbol order by event_us, trade_id
                             rows between 100 preceding and 1 preceding)),
feat as (
  select *, case when price_std > 0 then (price - price_mean) / price_std else 0.0 end as price_z,
         case when vol_mean > 0 then quantity / vol_mean else 0.0 end as vol_ratio,
         count(*) over (partition by symbol order by ts_seconds range between 5 preceding and current row) as velocity
  from rolled),
flags as (
  select *, case when abs(price_z) >= {z} then 'zscore' when vol_ratio >= 6 then 'volume_spike'
                 when velocity >= 25 then 'velocity' end as detector,
         case when abs(price_z) >= {z} * 1.6 then 'critical'
              when abs(price_z) >= {z} or vol_ratio >= 6 or velocity >= 25 then 'high' end as severity
  from feat),
anom as (select * from flags where detector is not null)"""

GUARDED = """
odd as (select * replace (case when p % 311 = 0 then cast('nan' as double) else price end as price,
                          case when p % 313 = 0 then symbol || '$' else symbol end as symbol) from tape),
pre as (
  select *, case when isnan(price) then 'non_finite'
                 when not regexp_full_match(symbol, '[A-Z0-9][A-Z0-9._\\-]{0,31}') then 'bad_symbol'
                 when price > 165 then 'price_bound' when quantity > 15000 then 'qty_bound'
                 when price * quantity > 1500000 then 'notional_bound' end as pre_code
  from odd),
seen as (select symbol, min((event_us, trade_id)) as first_seen from pre where pre_code is null group by 1),
admitted as (select symbol from seen order by first_seen, symbol limit 12),
guarded as (select *, coalesce(pre_code, case when symbol not in (select symbol from admitted) then 'cardinality' end)
              as code from pre)"""

RUNS = """
records as (select event_us, trade_id, label, detector is not null as flagged,
                   coalesce(label, case when detector is not null then '+' else '-' end) as state from flags),
steps as (select *, case when lag(state) over o is not distinct from state then 0 else 1 end as start
          from records window o as (order by event_us, trade_id)),
numbered as (select *, sum(start) over (order by event_us, trade_id rows unbounded preceding) as run from steps),
runs as (select run, any_value(label) as label, bool_or(flagged) as flagged, count(*) as rows from numbered group by 1)"""

HISTORY = """
stats as (select symbol, count(*) as trades, avg(price) as price_mean, coalesce(stddev_samp(price), 0) as price_std,
                 avg(quantity) as quantity_mean from tape group by 1),
scored as (select tape.symbol, price, quantity,
                  case when price_std > 1e-12 then (price - price_mean) / price_std else 0 end as z,
                  case when quantity_mean > 0 then quantity / quantity_mean else 0 end as ratio
           from tape join stats using (symbol) where trades >= 20),
hist as (select symbol, case when abs(z) >= 3 then 'zscore' else 'volume_spike' end as detector, price, quantity,
                case when abs(z) >= 3 then z else ratio end as score
         from scored where abs(z) >= 3 or ratio >= 6)"""

# history of a trade: the engine window of its predecessor
MODEL = """
prev200 as (
  select *, lag(event_us) over (partition by symbol order by event_us, trade_id) as last_us,
         list({'us': event_us, 'p': price, 'q': quantity, 's': side}) over (
           partition by symbol order by event_us, trade_id rows between 200 preceding and 1 preceding) as raw
  from tape),
hist as (select *, list_filter(coalesce(raw, []), lambda x: x.us >= last_us - 300000000) as h from prev200),
lists as (
  select *, list_transform(h, lambda x: x.p) as ps, list_transform(h, lambda x: x.q) as qs,
         list_filter(h, lambda x: x.us >= event_us - 5000000) as h5
  from hist),
base as (
  select *, coalesce(list_avg(ps), price) as pm, case when len(h) > 1 then list_stddev_pop(ps) else 0 end as psd,
         coalesce(list_avg(qs), quantity) as qm, case when len(h) > 1 then list_stddev_pop(qs) else 0 end as qsd,
         coalesce(list_median(qs), quantity) as qmed, coalesce(ps[-1], price) as lastp,
         len(h5) as n5, len(list_filter(h5, lambda x: x.s = 'buy')) as b5
  from lists),
matrix as materialized (
  select trade_id, event_us, label, case when label is null then 0 else 1 end as y,
         case when psd > 1e-9 then abs(price - pm) / psd else 0.0 end as price_z,
         abs(price - lastp) / lastp as price_pct_move,
         case when qmed > 1e-9 then quantity / qmed else 1.0 end as size_vs_median,
         cast(n5 as double) as trades_in_5s,
         case when n5 > 0 then (2 * b5 - n5) / cast(n5 as double) else 0.0 end as side_imbalance,
         ln(1 + price * quantity) as notional_log,
         (price - lastp) / lastp as spread_from_last,
         case when qsd > 1e-9 then abs(quantity - qm) / qsd else 0.0 end as qty_z
  from base)"""

SCORED = """
scored as (select case when label is null then 0 else 1 end as y,
                  floor(quantity / 1000.0 + case when price > 130 then 5 else 0 end) / 20.0 as score, price, quantity
           from tape),
pred as (select *, case when score >= 0.25 then 1 else 0 end as predicted from scored),
conf as (select count(*) filter (y = 0 and predicted = 0) as tn, count(*) filter (y = 0 and predicted = 1) as fp,
                count(*) filter (y = 1 and predicted = 0) as fn, count(*) filter (y = 1 and predicted = 1) as tp
         from pred),
pts as (select score, count(*) filter (y = 1) as pos, count(*) filter (y = 0) as neg from scored group by 1),
cum as (select *, sum(pos) over o as tp, sum(neg) over o as fp,
               (select sum(pos) from pts) as np, (select sum(neg) from pts) as nn
        from pts window o as (order by score desc))"""


def _with(*parts: str) -> str:
    return "with recursive " + ",\n".join(p.strip("\n") for p in parts) + "\n"


_batch = BATCH.replace("{z}", "3.0")
_event_batch = BATCH.replace("{z}", "2.5")
_engine = _with(TAPE, WINDOWS)
_event_windows = WINDOWS.replace(
    "account_id, counterparty_id, label, side", f"{EVENT_COLUMNS}, side"
)
_cand = _with(TAPE, WINDOWS, WASH, CANDIDATES)
_alerts = _with(TAPE, WINDOWS, WASH, CANDIDATES, COOLDOWN)
_flags = _with(TAPE, _batch)
_second_series = """
last as (select max(event_us // 1000000) as now from tape),
secs as (select unnest(range(now - {w}, now + 1)) as t from last),
tr as (select event_us // 1000000 as t, count(*) as trades, sum(price * quantity) as notional from tape group by 1),
al as (select event_us // 1000000 as t, count(*) as alerts from {alerts} group by 1),
series as (select t, coalesce(trades, 0) as trades, coalesce(alerts, 0) as alerts,
                  round(coalesce(notional, 0), 2) as notional from secs left join tr using (t) left join al using (t))"""

ORACLES: dict[str, str] = {
    "decode_validate": _with(TAPE)
    + "select trade_id, event_us, symbol, round(price, 6) as price, quantity, side from tape where o % 13 <> 0 and o % 17 <> 0",
    "decode_rejects": _with(TAPE) + "select o % 13 <> 0 and o % 17 <> 0 as valid, count(*) as n from tape group by 1",
    "normalise_trades": _with(TAPE)
    + "select trade_id, symbol, case when split_part(trade_id, '-', 1)::bigint % 5 = 0 then 'buy' else side end as side,"
    " case when split_part(trade_id, '-', 1)::bigint % 7 = 0 then 'USD' else 'EUR' end as currency,"
    " round(price * quantity, 4) as notional, event_us from tape",
    "event_second_counts": _with(TAPE) + "select event_us // 1000000 as ts_seconds, count(*) as n from tape group by 1",
    "severity_ranks": _flags
    + "select severity, cast(case severity when 'low' then 0 when 'medium' then 1 when 'high' then 2 else 3 end as bigint)"
    " as rank, count(*) as n from anom group by 1, 2",
    "guardrail_codes": _with(TAPE, GUARDED)
    + "select coalesce(code, 'ok') as code, count(*) as n, count(distinct symbol) as symbols from guarded group by 1",
    "cardinality_cap": _with(TAPE, GUARDED)
    + "select symbol, bool_and(code is null) as admitted, count(*) as n from guarded"
    " where code is null or code = 'cardinality' group by 1",
    "reject_split": _with(TAPE, GUARDED)
    + "select 'accepted' as part, count(*) as n from guarded where code is null"
    " union all select 'rejected', count(*) from guarded where code is not null",
    "curated_silver": _with(TAPE)
    + "select strftime(make_timestamp(event_us), '%Y-%m-%d') as dt, symbol, count(*) as trades,"
    " round(sum(price * quantity), 2) as notional, max(venue) as venue from tape group by 1, 2",
    "gold_load_shape": _with(EVENTS, _batch)
    + 'select event_us as "EVENT_US", symbol as "SYMBOL", detector as "DETECTOR", severity as "SEVERITY",'
    ' round(price, 6) as "PRICE", quantity as "QUANTITY", \'2026-01-02\' as "DT" from anom',
    "batch_rolling_features": _flags
    + "select trade_id, round(price_mean, 6) as price_mean, round(price_std, 6) as price_std,"
    " round(price_z, 5) as price_z, round(vol_ratio, 6) as vol_ratio, velocity from feat",
    "batch_velocity_counts": _flags + "select symbol, ts_seconds, max(velocity) as velocity from feat group by 1, 2",
    "batch_anomalies": _flags
    + "select trade_id, event_us, symbol, round(price, 6) as price, quantity, detector, severity from anom",
    "warehouse_projection": _flags
    + "select trade_id, event_us, symbol, detector, severity, round(price, 6) as price, quantity,"
    " round(price_z, 5) as price_z, round(vol_ratio, 5) as vol_ratio from anom",
    "batch_detector_counts": _flags + "select detector, count(*) as n from anom group by 1",
    "severity_counts": _flags + "select severity, count(*) as n from anom group by 1",
    "backtest_summary": _flags
    + "select count(*) as scanned, count(detector) as flagged, round(100.0 * count(detector) / count(*), 6) as flagged_pct from flags",
    "first_anomalies": _flags
    + "select trade_id, event_us, symbol, detector, severity from anom order by event_us, trade_id limit 10",
    "history_statistics": _with(TAPE, HISTORY)
    + "select symbol, trades, round(price_mean, 6) as price_mean, round(price_std, 6) as price_std,"
    " round(quantity_mean, 6) as quantity_mean from stats",
    "history_scan": _with(TAPE, HISTORY)
    + "select symbol, detector, round(price, 6) as price, quantity, round(score, 5) as score from hist",
    "mapper_projection": _with(TAPE)
    + "select symbol, count(*) as n, round(sum(price), 3) as price from tape where o % 19 <> 0 group by 1",
    "sliding_window_flags": _with(
        TAPE,
        """spread as (select symbol, price, (event_us // 5000000 - k) * 5000000 as s from tape, range(6) r(k)),
        win as (select symbol, s, avg(price) as m, stddev_samp(price) as sd, max(price) as mx, count(*) as c
                from spread group by 1, 2),
        zed as (select *, case when sd > 0 then (mx - m) / sd else 0 end as z from win)""",
    )
    + "select s as window_start_us, s + 30000000 as window_end_us, symbol,"
    " case when abs(z) >= 3 then 'zscore' else 'velocity' end as detector, round(z, 2) as price_z_max,"
    " c as trade_count, round(m, 4) as price_mean from zed where abs(z) >= 3 or c >= 180",
    "bounded_window": _engine + "select trade_id, n as window_size, ready from win",
    "price_statistics": _engine
    + "select trade_id, round(price_mean, 6) as price_mean, round(price_std, 6) as price_std from win",
    "volume_statistics": _engine
    + "select trade_id, round(volume_mean, 5) as volume_mean, round(volume_std, 5) as volume_std from win",
    "trimmed_median": _engine + "select trade_id, round(volume_median, 6) as volume_median from win",
    "previous_price": _with(EVENTS, _event_windows)
    + "select trade_id, round(previous_price, 6) as previous_price from win",
    "count_within": _engine + "select trade_id, velocity from win",
    "side_imbalance": _engine + "select trade_id, buys, sells from win",
    "wash_matches": _with(TAPE, WINDOWS, WASH) + "select trade_id, matched_trade_id from wash",
    "wash_self_trades": _with(TAPE)
    + "select trade_id, symbol, account_id from tape where account_id <> '' and account_id = counterparty_id",
    "online_model_features": _engine
    + "select trade_id, round(case when price_std > 1e-9 then (price - price_mean) / price_std else 0 end, 5) as f_price_z,"
    " round(case when volume_std > 1e-9 then (quantity - volume_mean) / volume_std else 0 end, 5) as f_vol_z,"
    " round((price - previous_price) / previous_price, 6) as f_ret, cast(velocity as double) as f_velocity"
    " from win where ready",
    "trade_model_features": _with(TAPE, MODEL)
    + "select trade_id, " + ", ".join(f"round({f}, 5) as {f}" for f in FEATURES) + " from matrix",
    "all_alerts": _cand + "select trade_id, symbol, detector, severity, round(score, 6) as score from cand",
    "cooldown_alerts": _alerts
    + "select trade_id, symbol, detector, event_us, severity, round(score, 6) as score from alerts",
    "alert_order": _cand
    + "select trade_id, string_agg(detector, '>' order by case severity when 'critical' then 3 when 'high' then 2"
    " else 1 end desc, score desc, position) as detectors from cand group by 1",
    "trade_decisions": _alerts.rstrip()
    + """,
    ranked as (select *, row_number() over (partition by trade_id order by case severity when 'critical' then 3
                 when 'high' then 2 else 1 end desc, score desc, position) as r from alerts),
    per as (select trade_id, count(*) as c, max(detector) filter (r = 1) as d, max(severity) filter (r = 1) as s
            from ranked group by 1)
    select trade_id, c is not null as anomalous, coalesce(c, 0) as alerts, d as first_detector, s as first_severity
    from tape left join per using (trade_id)""",
    "engine_totals": _alerts
    + """select 'trades_processed' as metric, '' as key, count(*) as value from tape
    union all select 'symbols_tracked', '', count(distinct symbol) from tape
    union all select 'alerts_raised', '', count(*) from alerts
    union all select 'alerts_suppressed', '', (select count(*) from cand) - (select count(*) from alerts)
    union all select 'by_detector', detector, count(*) from alerts group by 2
    union all select 'by_severity', severity, count(*) from alerts group by 2""",
    "engine_errors": _alerts
    + """select 'by_detector' as metric, detector as key, count(*) as value from alerts group by 2
    union all select 'detector_errors', 'lot_share', count(*) from tape where quantity % 4000 = 0 having count(*) > 0
    union all select 'detector_errors', 'first_lots', count(*) from tape where quantity = 20000 having count(*) > 0""",
    "daily_detector_counts": _with(EVENTS, _event_batch)
    + "select strftime(make_timestamp(event_us), '%Y-%m-%d') as dt, detector, count(*) as n from anom group by 1, 2",
    "daily_severity": _with(EVENTS, _event_batch)
    + "select strftime(make_timestamp(event_us), '%Y-%m-%d') as dt, severity, count(*) as alerts from anom group by 1, 2",
    "top_critical_symbols": _flags
    + "select symbol, count(*) as critical from anom where severity = 'critical' and"
    " strftime(make_timestamp(event_us), '%Y-%m-%d') = '2025-01-01' group by 1 order by 2 desc, 1 limit 20",
    "symbol_summary": _flags.rstrip()
    + """,
    s as (select symbol, arg_min(price, (event_us, trade_id)) as f, arg_max(price, (event_us, trade_id)) as l,
                 max(price) as h, min(price) as lo, count(*) as trades, sum(price * quantity) as notional,
                 count(*) filter (side = 'buy') as buy, count(*) filter (side <> 'buy') as sell from tape group by 1),
    a as (select symbol, count(*) as alerts from anom group by 1)
    select symbol, round(l, 4) as last_price, round((l - f) / f * 100, 3) as change_pct, round(h, 4) as high,
           round(lo, 4) as low, trades, coalesce(alerts, 0) as alerts, round(notional, 2) as notional, buy, sell
    from s left join a using (symbol)""",
    "sparkline": _with(
        TAPE,
        """back as (select *, row_number() over (partition by symbol order by event_us desc, trade_id desc) as b from tape),
        sp as (select symbol, list(round(price, 6) order by event_us, trade_id) as spark from back where b <= 120 group by 1)""",
    )
    + "select symbol, len(spark) as points, spark[1] as oldest, spark[-1] as newest, round(list_sum(spark), 3) as total from sp",
    "per_second_series": _with(TAPE, _batch, _second_series.format(w=299, alerts="anom"))
    + "select t, trades, alerts, notional from series",
    "zero_filled_series": _with(EVENTS, _second_series.format(w=299, alerts="tape where price > 20"))
    + "select t, trades, alerts, notional from series",
    "elapsed_rates": _with(TAPE, _batch, _second_series.format(w=5, alerts="anom"))
    + "select round(sum(trades) / 5, 2) as trades_per_sec, round(sum(alerts) / 5, 2) as alerts_per_sec"
    " from series where t < (select now from last)",
    "kpis": _flags
    + "select count(*) as total_trades, round(sum(price * quantity), 2) as total_notional,"
    " count(distinct symbol) as symbols_tracked, (select count(*) from anom) as total_alerts,"
    " round(100.0 * (select count(*) from anom) / count(*), 3) as alert_rate_pct from tape",
    "nearest_rank_percentiles": _with(
        TAPE,
        """latest as (select quantity as v from tape order by event_us desc, trade_id desc limit 4000),
        s as (select list(v order by v) as l, count(*) as n, avg(v) as m from latest)""",
    )
    + "select n as count, round(l[least(n - 1, cast(floor(0.5 * n) as bigint)) + 1], 1) as p50,"
    " round(l[least(n - 1, cast(floor(0.95 * n) as bigint)) + 1], 1) as p95,"
    " round(l[least(n - 1, cast(floor(0.99 * n) as bigint)) + 1], 1) as p99, round(l[-1], 1) as max,"
    " round(m, 1) as mean from s",
    "whole_column_percentiles": _with(
        TAPE, "s as (select list(price order by price) as l, count(*) as n, avg(price) as m from tape)"
    )
    + "select n as count, round(l[least(n - 1, cast(floor(0.5 * n) as bigint)) + 1], 1) as p50,"
    " round(l[least(n - 1, cast(floor(0.95 * n) as bigint)) + 1], 1) as p95,"
    " round(l[least(n - 1, cast(floor(0.99 * n) as bigint)) + 1], 1) as p99, round(l[-1], 1) as max,"
    " round(m, 1) as mean from s",
    "fixed_histogram": _with(
        TAPE,
        """latest as (select quantity as v from tape order by event_us desc, trade_id desc limit 4000),
        edges as (select [0, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 20000, 50000, 1000000000000]::double[] as e),
        b as (select i - 1 as bucket, e[i] as lo, e[i + 1] as hi from edges, range(1, 12) r(i))""",
    )
    + "select bucket, lo, hi, count(v) as count from b left join latest on v >= lo and v < hi group by 1, 2, 3",
    "latest_tape": _flags
    + "select trade_id, symbol, round(price, 6) as price, quantity, side, round(price * quantity, 2) as notional,"
    " trade_id in (select trade_id from anom) as anomalous, event_us from tape order by event_us desc, trade_id desc limit 80",
    "recent_alerts": _alerts
    + "select trade_id, symbol, detector, severity, event_us from alerts"
    " order by event_us desc, trade_id desc, position desc limit 100",
    "per_minute_rates": _flags.rstrip()
    + """,
    tr as (select event_us // 60000000 * 60 as minute, count(*) as trades from tape group by 1),
    al as (select event_us // 60000000 * 60 as minute, count(*) as alerts from anom group by 1)
    select minute, trades, coalesce(alerts, 0) as alerts, round(trades / 60.0, 4) as trade_rate,
           round(coalesce(alerts, 0) / 60.0, 4) as alert_rate from tr left join al using (minute)""",
    "audit_rollup": _with(TAPE, GUARDED)
    + """select coalesce(action, '*') as action, coalesce(outcome, '*') as outcome, coalesce(client, '*') as client,
                coalesce(code, '*') as code, level, n
    from (select action, outcome, client, code, cast(grouping(action, outcome, client, code) as bigint) as level, count(*) as n
          from (select case when code is null then 'trade_ingested' else 'trade_rejected' end as action,
                       case when code is null then 'ok' else 'rejected' end as outcome, account_id as client,
                       coalesce(code, 'none') as code from guarded)
          group by rollup (action, outcome, client, code))""",
    "job_freshness": "select max(epoch_us(ts)) // 1000000 as last_epoch, count(*) as runs, 'stale' as status from events",
    "quality_gate_checks": _flags
    + """select 'empty' as "check", case when count(*) = 0 then 1 else 0 end::bigint as violations, count(*) > 0 as passed from anom
    union all select 'missing_key', count(*), count(*) = 0 from anom where symbol is null or detector is null
    union all select 'bad_price', count(*), count(*) = 0 from anom where price <= 0 or price is null
    union all select 'bad_quantity', count(*), count(*) = 0 from anom where quantity <= 0 or quantity is null
    union all select 'bad_severity', count(*), count(*) = 0 from anom where severity not in ('low','medium','high','critical')
    union all select 'bad_score', 0, true""",
    "label_episodes": _with(TAPE, _batch, RUNS)
    + "select label, flagged as detected, rows, count(*) as episodes from runs where label is not null group by 1, 2, 3",
    "event_metrics": _with(
        TAPE,
        _batch,
        RUNS,
        """t as (select cast(sum(rows) as bigint) as total_trades, count(label) as total_events,
          count(*) filter (label is not null and flagged) as detected_events,
          count(*) filter (label is null and flagged) as false_alarm_episodes,
          cast(sum(rows) filter (label is null) as bigint) as normal_trades,
          cast(sum(rows) filter (label is null and flagged) as bigint) as normal_trades_flagged from runs),
        pr as (select *, detected_events / (detected_events + false_alarm_episodes) as pp,
                      detected_events / total_events as rr from t)""",
    )
    + "select total_trades, total_events, detected_events, false_alarm_episodes, normal_trades, normal_trades_flagged,"
    " round(pp, 6) as precision, round(rr, 6) as recall,"
    " round(normal_trades_flagged / normal_trades, 6) as false_positive_rate, round(2 * pp * rr / (pp + rr), 6) as f1 from pr",
    "false_alarm_episodes": _with(TAPE, _batch, RUNS)
    + "select rows, count(*) as episodes from runs where label is null and flagged group by 1",
    "label_recall": _with(TAPE, _batch, RUNS)
    + "select label, count(*) filter (flagged) as detected, count(*) as total from runs where label is not null group by 1",
    "scan_crosscheck": _with(TAPE, _batch, HISTORY)
    + """select symbol, detector, coalesce(a.c, 0) as rolling, coalesce(b.c, 0) as history,
         coalesce(a.c, 0) > 0 and coalesce(b.c, 0) > 0 as both_flag
    from (select symbol, detector, count(*) as c from anom group by 1, 2) a
    full join (select symbol, detector, count(*) as c from hist group by 1, 2) b using (symbol, detector)""",
    "time_ordered_split": _with(
        TAPE,
        "pos as (select *, row_number() over (order by event_us, trade_id) - 1 as i, count(*) over () as n from tape),"
        " parts as (select *, case when i < cast(floor(n * (1 - 0.3)) as bigint) then 'train' else 'test' end as part from pos)",
    )
    + "select part, count(*) as n, count(label) as positives, min(event_us) as first_us, max(event_us) as last_us"
    " from parts group by 1",
    "confusion_matrix": _with(TAPE, SCORED) + "select tn, fp, fn, tp from conf",
    "precision_recall_f1": _with(TAPE, SCORED)
    + "select round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall,"
    " round(2 * tp / (2 * tp + fp + fn), 6) as f1 from conf",
    "roc_auc": _with(TAPE, SCORED)
    + "select round(sum(a.pos * (case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0 end) * b.neg)"
    " / ((select sum(pos) from pts) * (select sum(neg) from pts)), 6) as roc_auc from pts a, pts b",
    "average_precision": _with(TAPE, SCORED) + "select round(sum(pos / np * (tp / (tp + fp))), 6) as pr_auc from cum",
    "curve_points": _with(TAPE, SCORED)
    + "select round(score, 6) as threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(tp / np, 6) as tpr,"
    " round(fp / nn, 6) as fpr, round(tp / (tp + fp), 6) as precision from cum",
    "class_balance": _with(TAPE)
    + "select cast(label is not null as bigint) as y, count(*) as n from tape group by 1",
    "class_histogram": _with(
        TAPE,
        SCORED,
        """span as (select y, min(price) as lo, max(price) as hi, count(*) as n, (max(price) - min(price)) / 40 as w
                 from scored group by 1),
        binned as (select y, least(39, cast(floor((price - lo) / w) as bigint)) as bin, count(*) as c
                   from scored join span using (y) group by 1, 2),
        grid as (select y, lo, w, n, k as bin from span, range(40) r(k))""",
    )
    + "select cast(y as bigint) as y, bin, round(lo + bin * w, 6) as lo, coalesce(c, 0) as n,"
    " round(coalesce(c, 0) / (grid.n * w), 6) as density from grid left join binned using (y, bin)",
    "feature_correlations": _with(TAPE, MODEL)
    + " union all ".join(
        f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 5) as corr from matrix" for a in FEATURES for b in FEATURES
    ),
    "class_report": _with(TAPE, SCORED)
    + """select 'normal' as class, round(tn / (tn + fn), 6) as precision, round(tn / (tn + fp), 6) as recall,
                round(2 * tn / (2 * tn + fn + fp), 6) as f1, tn + fp as support from conf
    union all select 'anomaly', round(tp / (tp + fp), 6), round(tp / (tp + fn), 6), round(2 * tp / (2 * tp + fp + fn), 6), tp + fn from conf""",
}


def _sweep(cooldown: bool = False, tapes: str = "''") -> str:
    """Metrics per ruleset and tape: ``sweep(ruleset, tape, te, de, fa, f1)``."""
    rules = {"shipped": (3.0, 6, 25), "strict": (4.0, 6, 40), "loose": (2.0, 3, 25)}
    fired = " union all ".join(
        f"select '{name}' as ruleset, {tapes} as tape, '{detector}' as detector, symbol, event_us, trade_id from win where {fires}"
        for name, (z, v, m) in rules.items()
        for detector, fires in (
            ("zscore", f"ready and abs({Z}) >= {z}"), ("volume_spike", f"ready and {RATIO} >= {v}"), ("velocity", f"velocity >= {m}"),
        )
    )
    kept = """
        times as (select distinct ruleset, symbol, detector, event_us from fired),
        chain as (
          select ruleset, symbol, detector, min(event_us) as event_us from times group by 1, 2, 3
          union all
          select c.ruleset, c.symbol, c.detector, min(t.event_us) from chain c join times t
            on t.ruleset = c.ruleset and t.symbol = c.symbol and t.detector = c.detector and t.event_us >= c.event_us + 8000000
          group by 1, 2, 3),
        kept as (select ruleset, min(trade_id) as trade_id from fired join chain using (ruleset, symbol, detector, event_us)
                 group by ruleset, symbol, detector, event_us)"""
    return _with(
        TAPE,
        WINDOWS,
        f"fired as materialized ({fired})",
        kept if cooldown else "kept as (select ruleset, trade_id from fired)",
        f"""hits as (select distinct ruleset, trade_id from kept),
        records as (select r.ruleset, {tapes.replace("trade_id", "w.trade_id")} as tape, event_us, w.trade_id, label, h.trade_id is not null as flagged
                    from win w cross join (select unnest({list(rules)}) as ruleset) r
                    left join hits h on h.ruleset = r.ruleset and h.trade_id = w.trade_id),
        states as (select *, coalesce(label, case when flagged then '+' else '-' end) as state from records),
        steps as (select *, case when lag(state) over o is not distinct from state then 0 else 1 end as start
                  from states window o as (partition by ruleset, tape order by event_us, trade_id)),
        numbered as (select *, sum(start) over (partition by ruleset, tape order by event_us, trade_id rows unbounded preceding)
                     as run from steps),
        runs as (select ruleset, tape, run, any_value(label) as label, bool_or(flagged) as flagged from numbered group by 1, 2, 3),
        t as (select ruleset, tape, count(label) as te, count(*) filter (label is not null and flagged) as de,
                     count(*) filter (label is null and flagged) as fa from runs group by 1, 2),
        pr as (select *, coalesce(de / nullif(de + fa, 0), 0) as pp, coalesce(de / nullif(te, 0), 0) as rr from t),
        sweep as (select *, coalesce(2 * pp * rr / nullif(pp + rr, 0), 0) as f1 from pr)""",
    )


_SWEPT = (
    "select ruleset, te as total_events, de as detected_events, fa as false_alarm_episodes, round(f1, 6) as f1 from sweep"
)
ORACLES["ruleset_sweep"] = _sweep() + _SWEPT
ORACLES["ruleset_sweep_with_cooldown"] = _sweep(cooldown=True) + _SWEPT
ORACLES["sweep_spread"] = (
    _sweep(tapes="(cast(split_part(trade_id, '-', 1) as bigint) // 4096 % 4)::varchar")
    + "select ruleset, round(avg(f1), 6) as f1_mean, round(coalesce(stddev_samp(f1), 0), 6) as f1_std, count(*) as runs"
    " from sweep group by 1"
)
ORACLES["scan_row_agreement"] = _with(
    TAPE,
    _batch,
    HISTORY,
    """a as (select symbol, price, quantity, count(*) as n from anom group by 1, 2, 3),
    b as (select symbol, price, quantity, count(*) as n from hist group by 1, 2, 3),
    ab as (select symbol, coalesce(a.n, 0) as l, coalesce(b.n, 0) as r from a full join b using (symbol, price, quantity))""",
) + (
    "select symbol, sum(least(l, r))::bigint as both, sum(greatest(l - r, 0))::bigint as only_left,"
    " sum(greatest(r - l, 0))::bigint as only_right from ab group by 1"
)
ORACLES["recent_rows"] = _with(
    TAPE,
    """held as (
      select trade_id, list_filter(list({'id': trade_id, 'us': event_us, 'p': price}) over last200,
                                   lambda x: x.us >= event_us - 2000000) as live
      from tape window last200 as (partition by symbol order by event_us, trade_id rows between 199 preceding and current row))""",
) + (
    "select trade_id, len(live) as n, md5(array_to_string(list_transform(live, lambda x: x.id), ',')) as trades,"
    " round(list_sum(list_transform(live, lambda x: x.p)), 3) as price_sum from held"
)
_heavy, _light, _dominant = "greatest(buys, sells)", "least(buys, sells)", "case when buys >= sells then 'buy' else 'sell' end"
_own = "account_id = counterparty_id"
ORACLES["alert_texts"] = _with(
    TAPE,
    WINDOWS,
    WASH,
    "joined as (select win.*, matched_trade_id from win left join wash using (trade_id))",
    f"""texts as (
      select trade_id, 'price_spike' as detector, null::varchar as reason, round(previous_price, 6) as previous_price,
             round({MOVE}, 5) as pct_change, null::bigint as count, null::varchar as dominant_side,
             null::bigint as buys, null::bigint as sells, null::varchar as signal, null::varchar as matched_trade_id
      from joined where {DETECTORS["price_spike"][0]}
      union all
      select trade_id, 'velocity', velocity || ' trades in 5s (limit 25)', null, null, velocity, null, null, null, null, null
      from joined where {DETECTORS["velocity"][0]}
      union all
      select trade_id, 'spoofing', 'one-sided burst: ' || {_heavy} || ' ' || {_dominant} || ' vs ' || {_light}
             || ' opposite in 3s (ratio ' || printf('%.1f', round({SPOOF}, 1)) || ')', null, null, null, {_dominant}, buys, sells, null, null
      from joined where {DETECTORS["spoofing"][0]}
      union all
      select trade_id, 'wash_trade',
             case when {_own} then 'self-trade: account ' || account_id || ' is both buyer and seller of ' || symbol
                  else 'account ' || account_id || ' crossed both sides of ' || symbol || ' at ~' || printf('%.4f', price)
                       || ' x ' || printf('%.2f', quantity) || ' within 5s' end,
             null, null, null, null, null, null, case when {_own} then 'self_counterparty' else 'matched_cross' end,
             case when {_own} then null else matched_trade_id end
      from joined where {DETECTORS["wash_trade"][0]})""",
) + "select * from texts"


def _samples(trees: int = 12, sample: int = 64, seed: int = 7) -> str:
    a, b, c = np.random.default_rng(seed).integers(1, PRIME, (3, trees)).tolist()
    return _with(
        TAPE,
        f"""marks as (select trade_id, md5('{seed}:' || trade_id) as mark from tape),
        numbers as (select trade_id, mark, ('0x' || mark[1:7])::bigint as x, ('0x' || mark[8:14])::bigint as y from marks),
        keys as (select trade_id, mark, t::int as tree, ({a}[t + 1] * x + {b}[t + 1] * y + {c}[t + 1]) % {PRIME} as key
                 from numbers, range({trees}) r(t)),
        placed as (select *, row_number() over (partition by tree order by key, mark) as place from keys)""",
    ) + f"select tree, trade_id from placed where place <= {sample}"


ORACLES["isolation_samples"] = _samples()
for _name, (_fires, _severity, _score) in DETECTORS.items():
    ORACLES[f"detect_{_name}"] = (
        _with(TAPE, WINDOWS, WASH)
        + f"select trade_id, symbol, {_severity} as severity, round(cast({_score} as double), 6) as score"
        f" from win left join wash using (trade_id) where {_fires}"
    )

for _name in ("scan_parquet_trades", "scan_json_trades"):
    ORACLES[_name] = (
        _with(TAPE) + "select trade_id, event_us, symbol, round(price, 6) as price, quantity, side from tape"
    )
ORACLES["lake_rewritten_day"] = _with(
    EVENTS,
    _event_batch,
    """dated as (select strftime(make_timestamp(event_us), '%Y-%m-%d') as dt, severity from anom),
    second as (select max(dt) as day from (select distinct dt from dated order by dt limit 2))""",
) + (
    "select dt, count(*) as n, count(*) filter (severity = 'critical') as critical, dt = day as rewritten"
    " from dated, second where dt <> day or severity = 'critical' group by dt, day"
)
ORACLES["lake_partitions"] = (
    _flags + "select strftime(make_timestamp(event_us), '%Y-%m-%d') as dt, detector, count(*) as n from anom group by 1, 2"
)
ORACLES["stream_window_verdicts"] = ORACLES["sliding_window_flags"]
ORACLES["stream_engine_alerts"] = ORACLES["cooldown_alerts"]

# a fold over the hits of a client; the first hit is its own start state
ORACLES["admission_control"] = (
    _with(
        TAPE,
        """hits as (select account_id as client, list(event_us order by event_us, trade_id) as us from tape group by 1),
        start as (select client, len(us) as hits,
                    list_transform(us, lambda t: {'us': t, 'held': [t], 'acc': 1, 'chk': t % 1000003}) as xs from hits),
        fold as (select client, hits, list_reduce(xs, lambda s, x:
            case when len(list_filter(s.held, lambda h: h >= x.us - 60000000)) < 100
              then {'us': x.us, 'held': list_append(list_filter(s.held, lambda h: h >= x.us - 60000000), x.us),
                    'acc': s.acc + 1, 'chk': s.chk + x.chk}
              else {'us': x.us, 'held': s.held, 'acc': s.acc, 'chk': s.chk} end) as r from start)""",
    )
    + "select client, hits, cast(r.acc as bigint) as accepted, cast(r.chk as bigint) as \"check\" from fold"
)

for _cut, _whole in (
    ("cut_price_statistics", "price_statistics"),
    ("cut_batch_features", "batch_rolling_features"),
    ("cut_model_features", "trade_model_features"),
    ("cut_cooldown_alerts", "cooldown_alerts"),
):
    ORACLES[_cut] = ORACLES[_whole]

_FLAT = """tape as (
  select * replace (case when (o // 512) % 2 = 0 then cast(case when o % 97 = 0 then 101.0001371828 else 100.1 end as double)
                         else price end as price) from plain)"""
ORACLES["flat_price_statistics"] = (
    _with(TAPE.replace("tape as (", "plain as (", 1), _FLAT, WINDOWS)
    + "select trade_id, round(price_mean, 6) as price_mean, round(price_std, 6) as price_std, price_std > 0 as moves from win"
)

# the engine's own flags in the place of the batch ones
_engine_flags = """flags as (
  select t.event_us, t.trade_id, t.label, a.trade_id as detector
  from tape t left join (select distinct trade_id from alerts) a using (trade_id))"""
for _name, _batch_name in (("engine_event_metrics", "event_metrics"), ("engine_label_recall", "label_recall")):
    _tail = ORACLES[_batch_name].split(RUNS.strip("\n"), 1)[1]
    ORACLES[_name] = _alerts.rstrip() + ",\n" + _engine_flags + "," + RUNS + _tail
