"""DuckDB SQL for the registered queries, composed from named common table expressions."""

from __future__ import annotations

import re

STEP = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}
CTE: dict[str, str] = {}
BAR = """first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close,
         CAST(count(*) AS DOUBLE) AS volume, sum(value) AS quote_volume, count(*) AS trades
  FROM {source} WHERE value IS NOT NULL GROUP BY ALL"""
for _tf in ("1h", "4h", "1d"):
    _step = STEP[_tf]
    CTE[f"bars_{_tf}"] = f"""
  SELECT event_type AS symbol, '{_tf}' AS timeframe, CAST(floor(epoch_us(ts) / {_step * 1000}.0) AS BIGINT) * {_step} AS open_time, {BAR.format(source="events")}"""
_steps = ", ".join(f"('{k}', {v})" for k, v in STEP.items())
CTE["bars_all"] = f"""
  SELECT 'ALL' AS symbol, t.timeframe, CAST(floor(epoch_us(ts) / (t.step * 1000.0)) AS BIGINT) * t.step AS open_time, {BAR.format(source=f"events CROSS JOIN (VALUES {_steps}) t(timeframe, step)")}"""
S = "symbol, timeframe"
for _tf in ("1h", "4h", "1d", "all"):
    CTE[f"c_{_tf}"] = f"SELECT *, row_number() OVER (PARTITION BY {S} ORDER BY open_time) - 1 AS idx FROM bars_{_tf}"
    CTE[f"f0_{_tf}"] = f"""
  SELECT *, greatest(high - low, 1e-12) AS rng, lag(close) OVER s AS prev FROM c_{_tf} WINDOW s AS (PARTITION BY {S} ORDER BY idx)"""
    CTE[f"f1_{_tf}"] = f"""
  SELECT symbol, timeframe, open_time, idx, open, high, low, close, volume, rng AS raw_range, abs(close - open) AS raw_body, (close - low) / rng AS raw_close,
         least(1.0, greatest(0.0, abs(close - open) / rng)) AS body_pct, least(1.0, greatest(0.0, (high - greatest(open, close)) / rng)) AS upper_wick_pct,
         least(1.0, greatest(0.0, (least(open, close) - low) / rng)) AS lower_wick_pct,
         least(5.0, greatest(0.0, rng / greatest(median(rng) OVER (PARTITION BY {S} ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 1e-12))) / 5 AS range_ratio,
         least(1.0, greatest(0.0, (close - low) / rng)) AS close_location, CAST(sign(close - open) AS DOUBLE) AS direction
  FROM f0_{_tf}"""
    CTE[f"f_{_tf}"] = f"""
  SELECT *, least(1.0, greatest(-1.0, coalesce(body_pct - lag(body_pct) OVER s, 0.0))) AS body_change, least(1.0, greatest(-1.0, coalesce(range_ratio - lag(range_ratio) OVER s, 0.0))) AS range_change,
         CASE WHEN direction * lag(direction) OVER s < 0 THEN 1.0 ELSE 0.0 END AS alternation, CASE WHEN direction <> lag(direction) OVER s THEN 1.0 ELSE 0.0 END AS changed,
         (body_pct <= 0.25)::DOUBLE AS is_small, (body_pct >= 0.6)::DOUBLE AS is_large, (upper_wick_pct >= 0.35 AND lower_wick_pct < 0.25)::DOUBLE AS rejects_up, (lower_wick_pct >= 0.35 AND upper_wick_pct < 0.25)::DOUBLE AS rejects_down
  FROM f1_{_tf} WINDOW s AS (PARTITION BY {S} ORDER BY idx)"""
    CTE[f"w_{_tf}"] = f"""
  SELECT f.*, f.range_ratio * 5 AS rr, t.off, f.idx + 19 - t.off AS wend, l.last FROM f_{_tf} f CROSS JOIN (SELECT unnest(range(20)) AS off) t
  JOIN (SELECT symbol, timeframe, max(idx) AS last FROM f_{_tf} GROUP BY ALL) l USING (symbol, timeframe) WHERE f.idx + 19 - t.off BETWEEN 19 AND l.last"""
    _both = lambda name, x: f"avg({x}) FILTER (off < 10) AS {name}_first, avg({x}) FILTER (off >= 10) AS {name}_second"
    CTE[f"d_{_tf}"] = f"""
  SELECT symbol, timeframe, wend, last, avg((direction > 0)::DOUBLE) AS bullish, avg((direction < 0)::DOUBLE) AS bearish, avg(body_pct) AS body, avg(rr) AS range_level, avg(close_location) AS close_location,
         avg(alternation) FILTER (off > 0) AS alternation, avg((rr < 0.75)::DOUBLE) AS compression_75, avg((rr > 1.25)::DOUBLE) AS expansion_125, avg((rr < 0.85)::DOUBLE) AS compression, avg((rr > 1.15)::DOUBLE) AS expansion,
         avg((upper_wick_pct >= 0.35)::DOUBLE) AS upper_rejection, avg((lower_wick_pct >= 0.35)::DOUBLE) AS lower_rejection, avg((upper_wick_pct >= 0.35 OR lower_wick_pct >= 0.35)::DOUBLE) AS either_rejection,
         avg((body_pct <= 0.25)::DOUBLE) AS small_body, avg((body_pct >= 0.6)::DOUBLE) AS large_body, {_both("bull", "(direction > 0)::DOUBLE")}, {_both("range", "rr")}, {_both("direction", "direction")}, {_both("scaled_range", "range_ratio")},
         {_both("alternation", "alternation")}, {_both("body", "body_pct")}, {_both("close", "close_location")}, avg(rr) FILTER (off < 6) AS range_first_third, avg(rr) FILTER (off BETWEEN 6 AND 11) AS range_middle_third, avg(rr) FILTER (off >= 14) AS range_last_third,
         avg(alternation) FILTER (off BETWEEN 1 AND 5) AS alternation_first_third, avg(alternation) FILTER (off >= 15) AS alternation_last_third
  FROM w_{_tf} GROUP BY ALL"""


def vector(source: str, totals: list[str], halves: list[str], shifts: list[str]) -> str:
    """Means of each window as x0, x1, ...: whole, first half, second half, and the halves' difference."""
    whole = [f"avg({x})" for x in totals] + [y for x in halves for y in (f"avg({x}) FILTER (off < 10)", f"avg({x}) FILTER (off >= 10)")] + [f"avg({x}) FILTER (off >= 10) - avg({x}) FILTER (off < 10)" for x in shifts]
    return "SELECT symbol, timeframe, wend, last, " + ", ".join(f"{y} AS x{i}" for i, y in enumerate(whole)) + f" FROM w_{source} GROUP BY ALL"


_seven = ["direction", "body_pct", "range_ratio", "upper_wick_pct", "lower_wick_pct", "close_location", "alternation"]
_five = ["direction", "body_pct", "range_ratio", "close_location", "alternation"]
CTE["v23"] = vector("1h", _seven, _five, ["range_ratio", "body_pct", "direction", "close_location", "upper_wick_pct", "lower_wick_pct"])
CTE["v19"] = vector("all", _seven, _five, ["range_ratio", "direction"])
CTE["v22"] = vector("1h", [], ["direction", "raw_range", "raw_body", "raw_close", "changed", "is_small", "is_large", "rejects_up", "rejects_down"], ["direction", "raw_range", "raw_body", "raw_close"])


def medians(rows: str, n: int) -> dict[str, str]:
    """CTEs of the medians and spreads of x0 to x(n-1) of a relation by series, and of squared distances from its current row (now)."""
    xs = [f"x{i}" for i in range(n)]
    return {
        f"{rows}_m": "SELECT symbol, timeframe, " + ", ".join(f"median({x}) AS m_{x}" for x in xs) + f" FROM {rows} GROUP BY ALL",
        f"{rows}_s": "SELECT symbol, timeframe, " + ", ".join(f"median(abs({x} - m_{x})) * 1.4826 AS s_{x}" for x in xs) + f" FROM {rows} JOIN {rows}_m USING (symbol, timeframe) GROUP BY ALL",
        f"{rows}_d": f"SELECT r.*, sqrt((" + " + ".join(f"pow((r.{x} - n.{x}) / CASE WHEN s_{x} < 1e-6 THEN 1.0 ELSE s_{x} END, 2)" for x in xs) + f") / {n}) AS distance FROM {rows} r JOIN {rows}_now n USING (symbol, timeframe) JOIN {rows}_s USING (symbol, timeframe)",
    }


FEATURES = {"body_pct": 0.18, "upper_wick_pct": 0.12, "lower_wick_pct": 0.12, "range_ratio": 0.16, "close_location": 0.12, "direction": 0.10, "body_change": 0.08, "range_change": 0.08, "alternation": 0.04}
for _k, _tf in (("", "1h"), ("_all", "all")):
    CTE[f"med{_k}"] = "SELECT symbol, timeframe, wend, " + ", ".join(f"median({x}) AS m_{x}" for x in FEATURES) + f" FROM w_{_tf} GROUP BY ALL"
    CTE[f"mad{_k}"] = "SELECT symbol, timeframe, wend, " + ", ".join(f"median(abs({x} - m_{x})) * 1.4826 AS s_{x}" for x in FEATURES) + f" FROM w_{_tf} JOIN med{_k} USING (symbol, timeframe, wend) GROUP BY ALL"
    CTE[f"z{_k}"] = "SELECT symbol, timeframe, wend, last, off, " + ", ".join(f"({x} - m_{x}) / CASE WHEN s_{x} < 1e-6 THEN 1.0 ELSE s_{x} END AS {x}" for x in FEATURES) + f" FROM w_{_tf} JOIN med{_k} USING (symbol, timeframe, wend) JOIN mad{_k} USING (symbol, timeframe, wend)"
    CTE[f"rmse{_k}"] = (
        "SELECT a.symbol, a.timeframe, a.wend, " + ", ".join(f"sqrt(avg(pow(a.{x} - b.{x}, 2))) AS {x}" for x in FEATURES)
        + f" FROM z{_k} a JOIN z{_k} b ON a.symbol = b.symbol AND a.timeframe = b.timeframe AND a.off = b.off AND b.wend = b.last WHERE a.wend < a.last - 19 GROUP BY ALL"
    )
    CTE[f"sim{_k}"] = "SELECT *, exp(-(" + " + ".join(f"{x} * {w / sum(FEATURES.values())!r}" for x, w in FEATURES.items()) + f")) AS similarity FROM rmse{_k}"
    CTE[f"ranked{_k}"] = f"SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY round(similarity, 9) DESC, wend) AS rank FROM sim{_k}"

# The zigzag as a recursion over idx: state is (trend, extreme's idx and price); a row that confirms a turn has turn set.
_up, _down = "c.close / z.price >= 1 + z.threshold / 100", "c.close / z.price <= 1 - z.threshold / 100"
_moves = f"z.trend = 0 AND ({_up} OR {_down}) OR (c.close - z.price) * z.trend > 0 OR z.trend = 1 AND {_down} OR z.trend = -1 AND {_up}"
CTE["zz"] = f"""
  SELECT symbol, threshold, idx, 0 AS trend, idx AS at, close AS price, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS DOUBLE) AS turn_price, 0 AS was FROM c_1h CROSS JOIN (SELECT unnest([20.0, 30.0, 50.0])::DOUBLE AS threshold) WHERE idx = 0
  UNION ALL
  SELECT c.symbol, z.threshold, c.idx,
    CASE WHEN z.trend = 0 THEN CASE WHEN {_up} THEN 1 WHEN {_down} THEN -1 ELSE 0 END WHEN z.trend = 1 AND {_down} THEN -1 WHEN z.trend = -1 AND {_up} THEN 1 ELSE z.trend END,
    CASE WHEN {_moves} THEN c.idx ELSE z.at END, CASE WHEN {_moves} THEN c.close ELSE z.price END,
    CASE WHEN z.trend = 1 AND {_down} OR z.trend = -1 AND {_up} THEN z.at END, CASE WHEN z.trend = 1 AND {_down} OR z.trend = -1 AND {_up} THEN z.price END, z.trend
  FROM zz z JOIN c_1h c ON c.symbol = z.symbol AND c.idx = z.idx + 1"""
CTE["turns_all"] = "SELECT symbol, '1h' AS timeframe, threshold, turn AS index, idx AS confirmation_index, CASE WHEN was = 1 THEN 'DOWN' ELSE 'UP' END AS direction, turn_price AS price FROM zz WHERE turn IS NOT NULL"
CTE["turns"] = "SELECT * EXCLUDE (threshold) FROM turns_all WHERE threshold = 30"
CTE["pivots"] = """
  SELECT *, row_number() OVER w - 1 AS position,
    CASE WHEN lag(price) OVER s IS NULL THEN NULL WHEN direction = 'DOWN' THEN CASE WHEN price > lag(price) OVER s THEN 'HH' ELSE 'LH' END ELSE CASE WHEN price > lag(price) OVER s THEN 'HL' ELSE 'LL' END END AS pivot_type,
    lag(price) OVER s AS previous_same_type_price, (price / lag(price) OVER s - 1) * 100 AS swing_pct, index - lag(index) OVER w AS bars_since_prev, (price / lag(price) OVER w - 1) * 100 AS leg_pct,
    price / first(price) OVER w AS normalized_price
  FROM turns WINDOW w AS (PARTITION BY symbol ORDER BY index), s AS (PARTITION BY symbol, direction ORDER BY index)"""
CTE["last_pivot"] = "SELECT symbol, max(position) AS target FROM pivots GROUP BY symbol"
# Endpoints of the walk-forward: eligible pivots, each so many, and of those a recursion that keeps the ones spaced apart.
CTE["eligible"] = "SELECT symbol, position, confirmation_index, row_number() OVER (PARTITION BY symbol ORDER BY position) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM pivots JOIN (SELECT symbol, count(*) AS length FROM c_1h GROUP BY symbol) USING (symbol) WHERE position >= 15 AND confirmation_index + 50 < length"
CTE["strided"] = "SELECT symbol, position, confirmation_index, row_number() OVER (PARTITION BY symbol ORDER BY position) AS i FROM eligible WHERE k % greatest(1, CAST(ceil(n / 250.0) AS BIGINT)) = 0 QUALIFY i <= 250"
CTE["greedy"] = "SELECT symbol, i, position, confirmation_index AS held, true AS taken FROM strided WHERE i = 1 UNION ALL SELECT s.symbol, s.i, s.position, CASE WHEN s.confirmation_index - g.held >= 50 THEN s.confirmation_index ELSE g.held END, s.confirmation_index - g.held >= 50 FROM greedy g JOIN strided s ON s.symbol = g.symbol AND s.i = g.i + 1"
CTE["sampled"] = "SELECT symbol, position AS target FROM greedy WHERE taken"
CTE["targets"] = "SELECT * FROM sampled UNION SELECT * FROM last_pivot"
CTE["runs"] = """
  SELECT p.symbol, p.timeframe, t.off, e.position AS wend, p.pivot_type, p.swing_pct, p.leg_pct, p.bars_since_prev, p.normalized_price, s.index AS start_index, e.index AS end_index, e.confirmation_index AS end_confirmation, e.normalized_price AS end_price
  FROM pivots p CROSS JOIN (SELECT unnest(range(8)) AS off) t JOIN pivots e ON e.symbol = p.symbol AND e.position = p.position + 7 - t.off JOIN pivots s ON s.symbol = p.symbol AND s.position = p.position - t.off"""
CTE["matched"] = """
  SELECT b.symbol, b.timeframe, a.wend AS target, b.start_index AS candidate_start_index, b.end_index AS candidate_end_index, b.end_confirmation AS candidate_confirmation_index,
    string_agg(coalesce(b.pivot_type, '?'), ' ' ORDER BY b.off) AS pivot_type_sequence,
    0.4 * avg((coalesce(a.pivot_type, '?') = coalesce(b.pivot_type, '?'))::DOUBLE) + 0.2 * exp(-avg(abs(coalesce(a.swing_pct, 0) - coalesce(b.swing_pct, 0))) / 1000.0) + 0.2 * exp(-avg(abs(coalesce(a.leg_pct, 0) - coalesce(b.leg_pct, 0))) / 2000.0)
      + 0.15 * exp(-avg(abs(ln(greatest(coalesce(a.bars_since_prev, 1), 1e-9) / greatest(coalesce(b.bars_since_prev, 1), 1e-9)))) / 1.0) + 0.05 * exp(-avg(abs(a.normalized_price / a.end_price - b.normalized_price / b.end_price)) / 0.05) AS similarity
  FROM runs a JOIN runs b ON a.symbol = b.symbol AND a.off = b.off AND b.wend <= a.wend - 8 AND b.end_confirmation < a.end_confirmation
  JOIN targets t ON t.symbol = a.symbol AND t.target = a.wend WHERE a.wend + 1 >= 16 GROUP BY ALL"""
CTE["pairs_top"] = "SELECT *, row_number() OVER (PARTITION BY symbol, target ORDER BY round(similarity, 9) DESC, candidate_end_index) AS rank FROM matched"

# What follows an endpoint, by a range join.
CTE["ends"] = "SELECT DISTINCT symbol, confirmation_index AS endpoint_index FROM turns"
CTE["hits"] = """
  SELECT e.symbol, e.endpoint_index, e.close AS entry_price, h.horizon, count(n.idx) AS bars_available, arg_max(n.close, n.idx) AS last_close, max(n.high) AS high, min(n.low) AS low,
    min(n.idx) FILTER (n.high >= e.close * (1 + 2.0 / 100)) AS target_at, min(n.idx) FILTER (n.low <= e.close * (1 - 1.0 / 100)) AS stop_at
  FROM (SELECT ends.*, close FROM ends JOIN c_1h ON c_1h.symbol = ends.symbol AND c_1h.idx = ends.endpoint_index) e CROSS JOIN (SELECT unnest([5, 10, 20, 50])::BIGINT AS horizon) h
  LEFT JOIN c_1h n ON n.symbol = e.symbol AND n.idx > e.endpoint_index AND n.idx <= e.endpoint_index + h.horizon GROUP BY ALL"""
CTE["outcomes"] = """
  SELECT symbol, '1h' AS timeframe, endpoint_index, entry_price, horizon, bars_available, (last_close / entry_price - 1) * 100 AS return_pct, (high / entry_price - 1) * 100 AS mfe_pct, (low / entry_price - 1) * 100 AS mae_pct,
    CASE WHEN bars_available = 0 THEN 'no_data' WHEN target_at IS NULL AND stop_at IS NULL THEN 'neither' WHEN target_at = stop_at THEN 'ambiguous' WHEN stop_at IS NULL OR target_at < stop_at THEN 'target' ELSE 'stop' END AS target_first
  FROM hits"""


def summary(source: str, by: str) -> str:
    """The label counts, rates and intervals of a relation."""
    wilson = lambda s, n, sign: f"(({s} / nullif({n}, 0)::DOUBLE + 3.841458820694124 / (2 * nullif({n}, 0))) {sign} 1.959963984540054 * sqrt(({s} / nullif({n}, 0)::DOUBLE) * (1 - {s} / nullif({n}, 0)::DOUBLE) / nullif({n}, 0) + 3.841458820694124 / (4.0 * nullif({n}, 0) * nullif({n}, 0)))) / (1 + 3.841458820694124 / nullif({n}, 0))"
    low = lambda s, n: f"CASE WHEN {n} > 0 THEN round(greatest(0.0, {wilson(s, n, '-')}), 6) END"
    high = lambda s, n: f"CASE WHEN {n} > 0 THEN round(least(1.0, {wilson(s, n, '+')}), 6) END"
    return f"""SELECT {by}, horizon, samples, target, stop, neither, ambiguous, round(target / samples::DOUBLE, 6) AS target_rate_all, round(target / nullif(target + stop, 0)::DOUBLE, 6) AS target_rate_decisive,
      {low("target", "samples")} AS all_low, {high("target", "samples")} AS all_high, {low("target", "(target + stop)")} AS decisive_low, {high("target", "(target + stop)")} AS decisive_high
    FROM (SELECT {by}, horizon, count(*) AS samples, CAST(count_if(target_first = 'target') AS BIGINT) AS target, CAST(count_if(target_first = 'stop') AS BIGINT) AS stop, CAST(count_if(target_first = 'neither') AS BIGINT) AS neither, CAST(count_if(target_first = 'ambiguous') AS BIGINT) AS ambiguous FROM {source} GROUP BY ALL)"""


def build(final: str, **more: str) -> str:
    """final as a query with the common table expressions that it needs, in order."""
    known, order = CTE | more, []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z]\w*\b", re.sub(r"'[^']*'", "", text)):
            if name in known and name not in order and name not in opened:
                opened.add(name)
                need(known[name])
                order.append(name)

    opened: set[str] = set()
    need(final)
    return f"WITH RECURSIVE {', '.join(f'{n} AS ({known[n]})' for n in order)}\n{final}" if order else final
