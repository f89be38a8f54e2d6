"""Shared SQL of the catalog's oracles: WITH clauses that end where a query goes on."""

from __future__ import annotations

from dataclasses import replace

from tickloom.config import DEFAULT

#: The events span 30 days, so the queries' days and weeks are short bars; ``bars_day_week`` has real ones.
FIXTURE = replace(DEFAULT, roles=(("15M", 15, 2, 20), ("1H", 60, 3, 52), ("4H", 240, 3, 52), ("1D", 480, 5, 52), ("1W", 720, 5, 52)))


def q6(x: str, name: str) -> str:
    return f"CAST(round(CAST(({x}) AS DOUBLE) * 1000000) AS BIGINT)::DOUBLE / 1000000 AS {name}"


PRICED = """WITH RECURSIVE t0 AS (SELECT event_type AS symbol, event_id, ts, value FROM events UNION ALL SELECT 'ALL', event_id, ts, value FROM events),
priced AS (SELECT symbol, event_id, ts, 2400.0::DOUBLE + CAST(sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 10000.0::DOUBLE AS price FROM t0),
roles(tf, minutes, k, least) AS (VALUES """ + ", ".join(f"('{t}', {m}, {n}, {c})" for t, m, n, c in FIXTURE.roles) + ")"

_BAR = """first(price ORDER BY p.ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY p.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume"""

BARS_1H = PRICED + f", bars AS (SELECT symbol, '1H' AS tf, time_bucket(INTERVAL 1 HOUR, p.ts) AS ts, {_BAR} FROM priced p GROUP BY symbol, time_bucket(INTERVAL 1 HOUR, p.ts)) "
LADDER = PRICED + f", bars AS (SELECT symbol, tf, time_bucket(to_minutes(minutes), p.ts) AS ts, {_BAR} FROM priced p, roles GROUP BY symbol, tf, time_bucket(to_minutes(minutes), p.ts)) "
CANDLES = LADDER + f""", candles AS (SELECT b.* EXCLUDE (rn, least) FROM (SELECT bars.*, least, row_number() OVER (PARTITION BY symbol, bars.tf ORDER BY ts DESC) AS rn FROM bars JOIN roles USING (tf)) b
 QUALIFY rn BETWEEN 2 AND {DEFAULT.fetch_bars} AND count(*) FILTER (rn <= {DEFAULT.fetch_bars}) OVER (PARTITION BY symbol, tf) >= least) """

W = "OVER (PARTITION BY symbol, tf ORDER BY ts)"


def _w(n: int) -> str:
    return f"OVER (PARTITION BY symbol, tf ORDER BY ts ROWS {n - 1} PRECEDING)"


def _mean(x: str, n: int, f: str = "avg") -> str:
    return f"CASE WHEN count({x}) {_w(n)} = n_({n}) THEN {f}({x}) {_w(n)} END".replace(f"n_({n})", str(n))


_INDEXED = ", c AS (SELECT *, row_number() {w} - 1 AS i, count(*) OVER (PARTITION BY symbol, tf) AS n FROM {source}) "
_TR = f"greatest(high - low, abs(high - lag(close) {W}), abs(low - lag(close) {W}))"
_STEPS = (
    _INDEXED.format(w=W, source="bars")
    + f""", s1 AS (SELECT *, close - lag(close) {W} AS d, {_TR} AS tr, CASE WHEN i > 0 THEN greatest(high - lag(high) {W}, 0) END AS hu, CASE WHEN i > 0 THEN greatest(lag(low) {W} - low, 0) END AS ld,
 close / nullif(lag(close) {W}, 0) - 1 AS returns_1, close / nullif(lag(close, 5) {W}, 0) - 1 AS price_momentum FROM c),
s2 AS (SELECT *, coalesce(greatest(d, 0), 0) AS up, coalesce(greatest(-d, 0), 0) AS dn, {_mean("tr", 14, "sum")} AS trs, {_mean("hu", 14, "sum")} AS hus, {_mean("ld", 14, "sum")} AS lds, {_mean("tr", 14)} AS atr_14,
 {_mean("close", 20)} AS ma20, {_mean("close", 50)} AS ma50, {_mean("volume", 20)} AS volume_ma20, {_mean("close", 20, "stddev_samp")} AS sd, {_mean("close", 20, "stddev_pop")} AS sp, {_mean("returns_1", 20, "stddev_samp")} AS volatility FROM s1),
s3 AS (SELECT *, {_mean("up", 14)} AS g, {_mean("dn", 14)} AS lo, 100 * hus / nullif(trs, 0) AS plus_di, 100 * lds / nullif(trs, 0) AS minus_di, ma20 + 2 * sd AS bbu, ma20 - 2 * sd AS bbl FROM s2),
s4 AS (SELECT *, 100 * abs(plus_di - minus_di) / (plus_di + minus_di + 1e-6) AS dx FROM s3),
feat AS (SELECT *, CASE WHEN lo > 0 THEN 100 - 100 / (1 + g / lo) WHEN lo = 0 AND g > 0 THEN 100 END AS rsi_14, {_mean("dx", 14)} AS adx_14, ma20 AS bb_mid, bbu AS bb_upper, bbl AS bb_lower, bbu - bbl AS bb_width,
 least(greatest((close - bbl) / nullif(bbu - bbl + 1e-6, 0), 0), 1) AS bb_position, ma20 + 2 * sp AS bbp_upper, ma20 - 2 * sp AS bbp_lower, 4 * sp AS bbp_width,
 CAST(coalesce(close > ma20, false) AS INTEGER) AS close_above_ma20, CAST(coalesce(close > ma50, false) AS INTEGER) AS close_above_ma50,
 volume / nullif(volume_ma20, 0) - 1 AS volume_spike, CASE WHEN coalesce(volume_ma20, 0) = 0 THEN 1.0 ELSE round(volume / volume_ma20, 2) END AS volume_ratio,
 0.0::DOUBLE AS usd_strength, 0.0::DOUBLE AS real_rates_momentum, 50.0::DOUBLE AS risk_sentiment, hour(ts) / 24.0::DOUBLE AS session_hour_encoded, (isodow(ts) - 1) / 7.0::DOUBLE AS day_of_week_encoded FROM s4) """
)
FEATURES = BARS_1H + _STEPS


def indicator(doubles: str, others: str = "") -> str:
    """Hourly indicator columns; what opens with a band starts at its first full window."""
    cols = [q6(x.strip(), x.strip()) for x in doubles.split(",")]
    where = " WHERE i >= 19" if "bb_mid" in doubles else ""
    return FEATURES + f"SELECT symbol, tf, ts, {', '.join(cols)}{', ' + others if others else ''} FROM feat{where}"


def recursive(source: str) -> str:
    """Step by step recursions over *source*: exponential and Wilder means of every series."""
    return (
        _INDEXED.format(w=W, source=source)
        + f""", m0 AS MATERIALIZED (SELECT *, close - lag(close) {W} AS d, {_TR} AS tr, high - lag(high) {W} AS ri, lag(low) {W} - low AS fa FROM c),
m1 AS MATERIALIZED (SELECT *, CASE WHEN ri > fa AND ri > 0 THEN ri ELSE 0 END AS u, CASE WHEN fa > ri AND fa > 0 THEN fa ELSE 0 END AS f FROM m0),
m2 AS MATERIALIZED (SELECT *, avg(tr) {_w(14)} AS atr0, sum(tr) {_w(14)} AS st0, sum(u) {_w(14)} AS su0, sum(f) {_w(14)} AS sd0 FROM m1),
r AS (SELECT symbol, tf, i, close AS e12, close AS e26, 0.0::DOUBLE AS sig, close AS e20, close AS e50, 0.0::DOUBLE AS up, 0.0::DOUBLE AS dn, NULL::DOUBLE AS atr, NULL::DOUBLE AS st, NULL::DOUBLE AS su, NULL::DOUBLE AS sd, 0.0::DOUBLE AS dxs, NULL::DOUBLE AS adx FROM m2 WHERE i = 0
 UNION ALL
 SELECT symbol, tf, i, e12, e26, sig * 0.8::DOUBLE + 0.2::DOUBLE * (e12 - e26), e20, e50, up, dn, atr, st, su, sd, CASE WHEN i <= 27 THEN dxs + coalesce(dx, 0) ELSE dxs END,
  CASE WHEN i = 27 THEN (dxs + dx) / 14 WHEN i > 27 THEN adx * 13 / 14 + dx / 14 END
 FROM (SELECT *, CASE WHEN st IS NOT NULL THEN CASE WHEN su + sd > 0 THEN 100 * abs(su - sd) / (su + sd) ELSE 0 END END AS dx FROM (
  SELECT b.symbol, b.tf, b.i, r.e12 * (11.0::DOUBLE / 13) + b.close * (2.0::DOUBLE / 13) AS e12, r.e26 * (25.0::DOUBLE / 27) + b.close * (2.0::DOUBLE / 27) AS e26, r.sig,
   r.e20 * (19.0::DOUBLE / 21) + b.close * (2.0::DOUBLE / 21) AS e20, r.e50 * (49.0::DOUBLE / 51) + b.close * (2.0::DOUBLE / 51) AS e50,
   r.up * (13.0::DOUBLE / 14) + greatest(b.d, 0) / 14 AS up, r.dn * (13.0::DOUBLE / 14) + greatest(-b.d, 0) / 14 AS dn,
   CASE WHEN b.i = 13 THEN b.atr0 WHEN b.i > 13 THEN r.atr * 13 / 14 + b.tr / 14 END AS atr,
   CASE WHEN b.i = 14 THEN b.st0 WHEN b.i > 14 THEN r.st * 13 / 14 + b.tr END AS st, CASE WHEN b.i = 14 THEN b.su0 WHEN b.i > 14 THEN r.su * 13 / 14 + b.u END AS su,
   CASE WHEN b.i = 14 THEN b.sd0 WHEN b.i > 14 THEN r.sd * 13 / 14 + b.f END AS sd, r.dxs, r.adx
  FROM r JOIN m2 b ON b.symbol = r.symbol AND b.tf = r.tf AND b.i = r.i + 1) x) y),
ra AS MATERIALIZED (SELECT m2.symbol, m2.tf, m2.ts, m2.n, r.* EXCLUDE (symbol, tf) FROM r JOIN m2 ON m2.symbol = r.symbol AND m2.tf = r.tf AND m2.i = r.i),
rsiw AS (SELECT symbol, tf, ts, i, n, up, dn FROM ra), atrw AS (SELECT symbol, tf, ts, i, n, coalesce(atr, 0) AS atr FROM ra), adxw AS (SELECT symbol, tf, ts, i, n, adx FROM ra),
macdf AS (SELECT symbol, tf, ts, i, e12 - e26 AS macd, sig FROM ra), emas AS (SELECT symbol, tf, ts, i, e20, e50 FROM ra) """
    )


RECURSIVE = BARS_1H + recursive("bars")

_SWINGS = """, sw AS MATERIALIZED (SELECT c.*, k, i >= k AND i < n - k AND high > (SELECT max(high) FROM c x WHERE x.symbol = c.symbol AND x.tf = c.tf AND x.i BETWEEN c.i - k AND c.i + k AND x.i <> c.i) AS sh,
 i >= k AND i < n - k AND low < (SELECT min(low) FROM c x WHERE x.symbol = c.symbol AND x.tf = c.tf AND x.i BETWEEN c.i - k AND c.i + k AND x.i <> c.i) AS sl FROM c JOIN roles USING (tf)) """
_STRUCTURE = """, st AS MATERIALIZED (SELECT *, CASE WHEN nh >= 2 AND nl >= 2 AND hs[1] > hs[2] AND ls[1] > ls[2] THEN 'bullish' WHEN nh >= 2 AND nl >= 2 AND hs[1] < hs[2] AND ls[1] < ls[2] THEN 'bearish' ELSE 'ranging' END AS structure FROM (
 SELECT symbol, tf, count(*) FILTER (sh) AS nh, count(*) FILTER (sl) AS nl, list(high ORDER BY i DESC) FILTER (sh) AS hs, list(low ORDER BY i DESC) FILTER (sl) AS ls, max(i) FILTER (sl) AS lsl, arg_max(close, i) AS last_close, max(n) AS n FROM sw GROUP BY symbol, tf)),
fb AS (SELECT a.symbol, a.tf, a.i AS from_i, a.high AS level, min(b.i) AS j FROM sw a JOIN sw b ON a.symbol = b.symbol AND a.tf = b.tf AND b.i > a.i AND b.close > a.high JOIN st ON st.symbol = a.symbol AND st.tf = a.tf AND st.nh >= 2 WHERE a.sh GROUP BY ALL),
bos AS MATERIALIZED (SELECT * FROM fb QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY j DESC, from_i) = 1),
lv AS (SELECT st.symbol, st.tf, st.lsl, arg_max(high, i) AS level FROM st JOIN sw ON sw.symbol = st.symbol AND sw.tf = st.tf AND sh AND i < lsl GROUP BY ALL),
choch AS MATERIALIZED (SELECT lv.symbol, lv.tf, lsl, level, min(i) AS j FROM lv JOIN sw ON sw.symbol = lv.symbol AND sw.tf = lv.tf AND i > lsl AND close > level GROUP BY ALL),
sweep AS MATERIALIZED (SELECT a.symbol, a.tf, a.low AS level, b.i AS j, b.low, b.close, b.n FROM sw a JOIN st ON st.symbol = a.symbol AND st.tf = a.tf AND a.i < st.lsl JOIN sw b ON a.symbol = b.symbol AND a.tf = b.tf AND b.i >= greatest(a.i + 1, b.n - 20) AND b.low < a.low AND b.close > a.low
 WHERE a.sl QUALIFY row_number() OVER (PARTITION BY a.symbol, a.tf ORDER BY a.i DESC, b.i) = 1),
ob AS MATERIALIZED (SELECT s.symbol, s.tf, s.i, s.open, s.high, s.low, s.close, EXISTS (SELECT 1 FROM sw z WHERE z.symbol = s.symbol AND z.tf = s.tf AND z.i >= bos.j AND z.close < s.low) AS mitigated
 FROM sw s JOIN bos ON s.symbol = bos.symbol AND s.tf = bos.tf AND s.i >= bos.j - 20 AND s.i < bos.j AND s.close < s.open QUALIFY row_number() OVER (PARTITION BY s.symbol, s.tf ORDER BY s.i DESC) = 1),
g AS (SELECT a.symbol, a.tf, a.i, a.n, a.low, p.close - p.open AS body, p.high - p.low AS span, q.high AS flow, (a.low - q.high) / nullif(q.high, 0) AS size FROM sw a JOIN sw p ON p.symbol = a.symbol AND p.tf = a.tf AND p.i = a.i - 1 JOIN sw q ON q.symbol = a.symbol AND q.tf = a.tf AND q.i = a.i - 2),
fvg AS MATERIALIZED (SELECT * FROM g WHERE i > greatest(2, n - 50) AND body > 0 AND span <> 0 AND body / span >= 0.6::DOUBLE AND low > flow AND size >= 0.001::DOUBLE AND NOT EXISTS (SELECT 1 FROM sw z WHERE z.symbol = g.symbol AND z.tf = g.tf AND z.i >= g.i AND z.low < g.flow)
 QUALIFY row_number() OVER (PARTITION BY symbol, tf ORDER BY i DESC) = 1),
pd AS MATERIALIZED (SELECT symbol, tf, pct, CASE WHEN NOT coalesce(hs[1] - ls[1] > 0, false) THEN 'unknown' WHEN pct <= 0.4::DOUBLE THEN 'discount' WHEN pct >= 0.6::DOUBLE THEN 'premium' ELSE 'equilibrium' END AS zone FROM (
 SELECT *, CASE WHEN coalesce(hs[1] - ls[1] > 0, false) THEN (last_close - ls[1]) / (hs[1] - ls[1]) ELSE 0.5 END AS pct FROM st)) """
_CANDLES_C = _INDEXED.format(w=W, source="candles")
SWINGS = CANDLES + _CANDLES_C + _SWINGS
STRUCTURE = SWINGS + _STRUCTURE
HISTORY = SWINGS + """, h AS (SELECT b.symbol, b.tf, b.ts, list(s.high ORDER BY s.i DESC) FILTER (s.sh) AS hs, list(s.low ORDER BY s.i DESC) FILTER (s.sl) AS ls FROM sw b LEFT JOIN sw s ON s.symbol = b.symbol AND s.tf = b.tf AND s.i + s.k <= b.i AND (s.sh OR s.sl) GROUP BY ALL)
SELECT symbol, tf, ts, CASE WHEN hs[1] > hs[2] AND ls[1] > ls[2] THEN 'bullish' WHEN hs[1] < hs[2] AND ls[1] < ls[2] THEN 'bearish' ELSE 'ranging' END AS structure FROM h"""

_TIER = """CASE WHEN isodow(ts) >= 6 OR (isodow(ts) = 5 AND hour(ts) >= 21) THEN 'closed' WHEN CAST(ts AS TIME) >= TIME '13:00:00' AND CAST(ts AS TIME) < TIME '16:30:00' THEN 'peak' WHEN hour(ts) BETWEEN 8 AND 19 THEN 'high' ELSE 'secondary' END"""
EVENTS = """WITH ev AS (SELECT event_id, TIMESTAMP '2025-01-01' + to_days(CAST((event_id * 7) % 730 AS INTEGER)) + (ts - date_trunc('day', ts)) AS ts, CAST((event_id * 13) % 101 AS DOUBLE) AS smc_score, CAST((event_id * 29) % 101 AS DOUBLE) AS ml_confidence,
 CASE WHEN event_id % 7 <> 0 THEN CAST((event_id * 31) % 101 AS DOUBLE) END AS analyst_confidence, ['STRONG', 'MODERATE', 'WEAK', 'NONE'][event_id % 4 + 1] AS quality,
 ((event_id * 17) % 21 - 10) / 10.0::DOUBLE AS usd, ((event_id * 19) % 7 - 3) / 10.0::DOUBLE AS rate, CAST((event_id * 23) % 30 AS DOUBLE) AS vix, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction FROM events),
tiers AS (SELECT *, CASE tier WHEN 'peak' THEN 1.0 WHEN 'high' THEN 0.9 WHEN 'secondary' THEN 0.6 ELSE 0.0 END::DOUBLE AS mult, CASE tier WHEN 'peak' THEN 'WEAK' WHEN 'high' THEN 'MODERATE' ELSE 'STRONG' END AS gate,
 CASE tier WHEN 'peak' THEN 0.9 WHEN 'high' THEN 1.0 WHEN 'secondary' THEN 1.2 ELSE 1.5 END::DOUBLE AS width FROM (SELECT *, """ + _TIER + """ AS tier, CASE WHEN hour(ts) >= 20 OR hour(ts) < 8 THEN 'asia' WHEN hour(ts) < 17 THEN 'london' ELSE 'ny' END AS session FROM ev)) """
MACRO = EVENTS + """, m1 AS (SELECT *, CASE WHEN usd > 0.5 THEN 'strong_up' WHEN usd > 0.1 THEN 'weak' ELSE 'strong_down' END AS usd_trend, CASE WHEN rate > 0.1 THEN 'rising' WHEN rate > -0.1 THEN 'stable' ELSE 'falling' END AS rate_direction,
 CASE WHEN vix < 12 THEN 'risk_on' WHEN vix < 18 THEN 'neutral' ELSE 'risk_off' END AS risk_mode, least(greatest(vix * 5, 0), 100) AS risk FROM ev),
m3 AS (SELECT *, (direction = 'BUY') = (usd_trend <> 'strong_up') AS u, CASE direction WHEN 'BUY' THEN rate_direction = 'falling' ELSE rate_direction = 'rising' END AS r, CASE direction WHEN 'BUY' THEN risk_mode = 'risk_off' ELSE risk_mode = 'risk_on' END AS q,
 (direction = 'BUY' AND usd_trend = 'strong_up' AND rate_direction = 'rising') OR (direction = 'SELL' AND usd_trend = 'strong_down' AND rate_direction = 'falling') AS b FROM m1) """
REPLIES = """WITH r0 AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Here: {"should_trade": ' || CASE WHEN event_id % 8 = 0 THEN 'true' ELSE 'false' END || ', "confidence": ' || (event_id % 101) || ', "reasoning": "r' || (event_id % 9) || '"} done' WHEN 1 THEN '{"confidence": ' || (event_id % 101) || '}' WHEN 2 THEN 'no object here' ELSE '{"should_trade": tru' END AS t FROM events),
r1 AS (SELECT event_id, nullif(regexp_extract(t, '(?s)\\{.*\\}', 0), '') AS x FROM r0), r2 AS (SELECT event_id, coalesce(json_valid(x), false) AS ok, CASE WHEN json_valid(x) THEN x::JSON END AS j FROM r1) """.replace("\\\\", "\\")

SCAN = STRUCTURE.replace(_CANDLES_C, recursive("candles"), 1) + """, per AS (SELECT st.symbol, st.tf, structure, last_close, bos.j AS bj, choch.j AS cj, sweep.j AS sj, ob.high AS oh, ob.low AS ol, ob.mitigated AS om, fvg.i - 1 AS fi, pd.zone FROM st LEFT JOIN bos USING (symbol, tf) LEFT JOIN choch USING (symbol, tf) LEFT JOIN sweep USING (symbol, tf) LEFT JOIN ob USING (symbol, tf) LEFT JOIN fvg USING (symbol, tf) LEFT JOIN pd USING (symbol, tf)),
x AS (SELECT symbol, """ + ", ".join(f"max(structure) FILTER (tf = '{t}') AS struct_{t.lower()}" for t in ("1W", "1D", "4H", "1H", "15M")) + """, max(last_close) FILTER (tf = '1H') AS price, count(*) FILTER (tf = '4H' AND (bj IS NOT NULL OR cj IS NOT NULL)) > 0 AS b4, count(*) FILTER (tf = '15M' AND (bj IS NOT NULL OR cj IS NOT NULL)) > 0 AS b15,
 max(sj) FILTER (tf = '1H') AS sweep_index, max(fi) FILTER (tf = '1H') AS fvg_index, max(zone) FILTER (tf = '4H') AS zone, """ + ", ".join(f"max({c}) FILTER (tf = '{t}') AS {c}{t.lower()}" for t in ("4H", "1H", "15M") for c in ("oh", "ol")) + ", " + ", ".join(f"bool_or(om) FILTER (tf = '{t}') AS om{t.lower()}" for t in ("4H", "1H", "15M")) + """ FROM per GROUP BY symbol),
y AS (SELECT x.*, a.atr, a.ts + INTERVAL 1 HOUR AS as_of, d.adx AS adx_15m, CASE WHEN w.dn = 0 THEN 100 ELSE 100 - 100 / (1 + w.up / w.dn) END AS rsi_15m, (SELECT min(high) FROM sw WHERE sw.symbol = x.symbol AND sw.tf = '4H' AND sh AND high > x.price * 1.001::DOUBLE) AS tp_level,
 """ + " OR ".join(f"coalesce(NOT om{t} AND price BETWEEN ol{t} - oh{t} * 0.005::DOUBLE AND oh{t} + oh{t} * 0.005::DOUBLE, false)" for t in ("15m", "1h", "4h")) + """ AS at_block
 FROM x JOIN atrw a ON a.symbol = x.symbol AND a.tf = '1H' AND a.i = a.n - 1 LEFT JOIN adxw d ON d.symbol = x.symbol AND d.tf = '15M' AND d.i = d.n - 1 LEFT JOIN rsiw w ON w.symbol = x.symbol AND w.tf = '15M' AND w.i = w.n - 1),
z AS (SELECT *, CASE WHEN hour(as_of) BETWEEN 6 AND 9 THEN 'London Open' WHEN hour(as_of) BETWEEN 11 AND 15 THEN 'NY AM' END AS killzone, """ + _TIER.replace("ts", "as_of") + """ AS tier,
 coalesce(struct_4h = 'ranging', false) AND coalesce(struct_1w, 'x') NOT IN ('bullish', 'bearish') AND coalesce(struct_1d, 'x') NOT IN ('bullish', 'bearish') AS skipped FROM y),
scored AS (SELECT *, CASE WHEN skipped THEN 0 ELSE least(100, CASE WHEN struct_4h = 'bullish' THEN 20 ELSE 10 END + CASE WHEN struct_1d = 'bullish' THEN 15 ELSE 0 END + CASE WHEN struct_1w = 'bullish' THEN 10 ELSE 0 END + CASE WHEN b4 THEN 15 ELSE 0 END
 + CASE WHEN at_block THEN 20 WHEN fvg_index IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN sweep_index IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN b15 THEN 10 ELSE 0 END + CASE WHEN adx_15m > 20 THEN 5 ELSE 0 END + CASE WHEN rsi_15m > 50 THEN 5 ELSE 0 END + CASE WHEN killzone IS NOT NULL THEN 5 ELSE 0 END) END AS score FROM z),
l1 AS (SELECT *, CASE WHEN om15m = false THEN '15M_OB' WHEN (CASE WHEN ol4h IS NOT NULL THEN om4h ELSE om1h END) = false THEN '4H_OB' ELSE 'ATR' END AS sl_source FROM scored),
l2 AS (SELECT *, round(CASE sl_source WHEN '15M_OB' THEN ol15m * (1 - 0.0005::DOUBLE) WHEN '4H_OB' THEN coalesce(ol4h, ol1h) * (1 - 0.0005::DOUBLE) ELSE price - atr * 1.5::DOUBLE END * 10000) / 10000 AS stop_loss, coalesce(tp_level, round((price + atr * 3) * 10000) / 10000) AS take_profit FROM l1),
levels AS (SELECT *, CASE WHEN price - stop_loss > 0 THEN round((take_profit - price) / (price - stop_loss) * 100) / 100 ELSE 0 END AS rr_ratio, round(price * 0.9995::DOUBLE * 10000) / 10000 AS entry_low, round(price * 1.0005::DOUBLE * 10000) / 10000 AS entry_high,
 round((price - stop_loss) / price * 100 * 10000) / 10000 AS sl_pct, round((take_profit - price) / price * 100 * 10000) / 10000 AS tp_pct FROM l2) """

LEDGER = """WITH l0 AS (SELECT o_orderkey AS signal_id, o_orderdate AS timestamp, o_orderstatus AS os, CASE WHEN o_orderstatus = 'F' THEN ((o_orderkey * 7919) % 401 - 200) / 100.0::DOUBLE END AS profit_pct, o_orderpriority AS pr FROM orders),
l AS (SELECT signal_id, timestamp, profit_pct, CASE WHEN profit_pct > 0 THEN 'WIN' WHEN profit_pct < 0 THEN 'LOSS' WHEN profit_pct = 0 THEN 'EXPIRED' END AS result, CASE os WHEN 'F' THEN 'CLOSED' WHEN 'O' THEN 'OPEN' ELSE 'BLOCKED' END AS status,
 CASE pr WHEN '1-URGENT' THEN 'STRONG' WHEN '2-HIGH' THEN 'MODERATE' WHEN '3-MEDIUM' THEN 'MODERATE' ELSE 'WEAK' END AS signal_quality, CASE WHEN os = 'F' THEN timestamp + to_hours(CAST(signal_id % 48 AS INTEGER)) END AS exit_time,
 CASE WHEN signal_id % 2 = 0 THEN 'A' ELSE 'C' END AS system, CASE WHEN signal_id % 3 = 0 THEN 'BLOCKED_TREND' ELSE 'TREND_OK' END AS trend, 2400.0::DOUBLE + (signal_id % 100) / 10.0::DOUBLE AS entry_price,
 2400.0::DOUBLE + (signal_id % 100) / 10.0::DOUBLE + CASE WHEN signal_id % 4 = 0 THEN 5.0::DOUBLE ELSE -5.0::DOUBLE END AS stop_loss, 'summary of trade ' || signal_id AS summary FROM l0) """

TRADES = BARS_1H + _INDEXED.format(w=W, source="bars") + """, tr AS (SELECT symbol || '-' || (i + 1) AS signal_id, symbol, ts AS entry_ts, close AS entry, close * (1 - w) AS stop, close * (1 + 2 * w) AS target FROM (SELECT *, CASE WHEN (i + 1) % 8 = 0 THEN 0.0002::DOUBLE ELSE 0.004::DOUBLE END AS w FROM c WHERE (i + 1) % 4 = 0)),
aso AS (SELECT symbol, max(ts) + INTERVAL 1 HOUR AS as_of, arg_max(close, ts) AS last_close FROM c GROUP BY symbol),
tt AS (SELECT tr.*, as_of, last_close FROM tr JOIN aso USING (symbol)),
touch AS (SELECT signal_id, c.ts, c.low <= stop AS s, c.high >= target AS g FROM tt JOIN c ON c.symbol = tt.symbol AND c.ts > entry_ts AND (c.low <= stop OR c.high >= target) QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY c.ts) = 1),
both_ AS (SELECT tt.*, touch.ts AS tts, s, g, as_of - entry_ts >= INTERVAL 48 HOUR AS old FROM tt LEFT JOIN touch USING (signal_id)),
snap AS (SELECT signal_id, entry, CASE WHEN old THEN 'EXPIRED' WHEN s THEN 'LOSS' WHEN g THEN 'WIN' ELSE 'OPEN' END AS status, CASE WHEN old THEN 'TIMEOUT_48H' WHEN s AND g THEN 'BOTH_HIT_CONSERVATIVE' WHEN s THEN 'STOP_LOSS_HIT' WHEN g THEN 'TAKE_PROFIT_HIT' END AS reason,
 CASE WHEN old THEN last_close WHEN s THEN stop WHEN g THEN target END AS exit_price FROM both_),
inw AS (SELECT *, tts < entry_ts + INTERVAL 48 HOUR AS hit, (SELECT arg_max(close, c.ts) FROM c WHERE c.symbol = both_.symbol AND c.ts > entry_ts AND c.ts < entry_ts + INTERVAL 48 HOUR) AS ep FROM both_),
replay AS (SELECT signal_id, entry, CASE WHEN hit AND s THEN 'LOSS' WHEN hit THEN 'WIN' WHEN old THEN 'EXPIRED' ELSE 'OPEN' END AS status, CASE WHEN hit AND s AND g THEN 'BOTH_HIT_CONSERVATIVE' WHEN hit AND s THEN 'STOP_LOSS_HIT' WHEN hit THEN 'TAKE_PROFIT_HIT' WHEN old THEN 'TIMEOUT_48H' END AS reason,
 CASE WHEN hit AND s THEN stop WHEN hit THEN target WHEN old THEN coalesce(ep, entry) END AS exit_price FROM inw) """
