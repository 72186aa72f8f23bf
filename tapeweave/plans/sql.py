"""The market tables of sources.testdata as DuckDB common table expressions, for the oracle queries; folds are recursive ones."""

from __future__ import annotations


def total(expression: str) -> str:
    return f"CAST(sum({expression}) AS BIGINT)"


BUY = "CASE WHEN side = 'BUY' THEN quantity ELSE 0 END"
SELL = "CASE WHEN side = 'SELL' THEN quantity ELSE 0 END"
SIGNED = "CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END"
MEASURES = f"{total(BUY)} AS buy_volume, {total(SELL)} AS sell_volume, {total('quantity')} AS total_volume, {total(SIGNED)} AS delta, count(*) AS trade_count"

VIEWS = """
WITH RECURSIVE e AS (
  SELECT 'S' || (user_id % 4) AS session_id, 'SYM' || (user_id % 4) AS symbol, event_id * 2 AS seq, event_id, event_type,
         epoch_us(ts) // 1000 AS ts_ms, CAST(floor(value) AS BIGINT) AS v, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
  FROM events),
trades AS (
  SELECT session_id, symbol, seq, event_id AS trade_id, (100000 + v % 20) * 10000000 AS price, (k + 1) * 100000000 AS quantity,
         CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, ts_ms, CASE WHEN event_id % 97 = 0 THEN 'NA' ELSE 'MARKET' END AS order_type
  FROM e WHERE event_type IN ('click', 'purchase', 'signup')),
rtrades AS (
  SELECT session_id, symbol, seq, CASE WHEN trade_id % 7 = 0 THEN trade_id - 14 ELSE trade_id END AS trade_id, price, quantity, side, ts_ms, order_type FROM trades),
alevels AS (
  SELECT session_id, symbol, seq, 0 AS pos, CASE WHEN event_id % 2 = 0 THEN 'BID' ELSE 'ASK' END AS side, event_id,
         CASE WHEN event_id % 2 = 0 THEN 100000 - v % 20 ELSE 100001 + v % 20 END * 10000000 AS price,
         CASE WHEN event_id % 2 = 1 AND event_id % 50 = 1 THEN 30 * 10000000 ELSE 0 END AS lower,
         (k % 5) * 100000000 AS quantity, ts_ms, event_id * 10 AS first_update_id, event_id * 10 + 9 AS final_update_id,
         CASE WHEN k % 5 = 0 AND event_id % 7 = 0 THEN -1 ELSE lag(event_id * 10 + 9) OVER (PARTITION BY session_id, symbol ORDER BY seq) END AS previous_final_update_id
  FROM e WHERE event_type IN ('view', 'error')),
levels AS (SELECT * EXCLUDE (lower, event_id) FROM alevels),
xlevels AS (SELECT * EXCLUDE (lower, event_id) REPLACE (price - lower AS price) FROM alevels),
snaps AS (
  SELECT session_id, symbol, seq + 1 AS seq, final_update_id AS last_update_id, ts_ms, n // 50 AS epoch
  FROM (SELECT *, row_number() OVER (PARTITION BY session_id, symbol ORDER BY seq) AS n FROM levels) WHERE n % 50 = 0),
ladder AS (
  SELECT session_id, symbol, epoch, seq, CAST(r AS INTEGER) AS pos, CASE WHEN r < 20 THEN 'BID' ELSE 'ASK' END AS side,
         CASE WHEN r < 20 THEN 100000 - r % 20 ELSE 100001 + r % 20 END * 10000000 AS price, (r % 20 + 1) * 100000000 AS quantity, ts_ms, last_update_id
  FROM snaps, range(40) t(r)),
xladder AS (SELECT * REPLACE (CASE WHEN side = 'BID' AND seq % 7 = 0 THEN price + 50000000 ELSE price END AS price) FROM ladder),
lv AS (SELECT l.*, (SELECT count(*) FROM snaps s WHERE s.session_id = l.session_id AND s.seq < l.seq) AS epoch FROM levels l),
xlv AS (SELECT l.*, (SELECT count(*) FROM snaps s WHERE s.session_id = l.session_id AND s.seq < l.seq) AS epoch FROM xlevels l),
seeded AS (
  SELECT session_id, symbol, epoch, seq, pos, side, price, quantity, ts_ms, false AS seed FROM lv
  UNION ALL SELECT session_id, symbol, epoch, seq, pos, side, price, quantity, ts_ms, true FROM ladder),
xseeded AS (
  SELECT session_id, symbol, epoch, seq, pos, side, price, quantity, ts_ms, false AS seed FROM xlv
  UNION ALL SELECT session_id, symbol, epoch, seq, pos, side, price, quantity, ts_ms, true FROM xladder),
changes AS (
  SELECT * EXCLUDE (seed) FROM (SELECT *, nullif(lag(quantity) OVER (PARTITION BY session_id, symbol, epoch, side, price ORDER BY seq, pos), 0) AS old_quantity FROM seeded)
  WHERE NOT seed AND old_quantity IS DISTINCT FROM quantity),
intervals AS (
  SELECT session_id, symbol, epoch, side, price, quantity, ts_ms, seq AS seq_from, lead(seq) OVER (PARTITION BY session_id, symbol, epoch, side, price ORDER BY seq) AS seq_to FROM seeded),
xintervals AS (
  SELECT session_id, symbol, epoch, side, price, quantity, ts_ms, seq AS seq_from, lead(seq) OVER (PARTITION BY session_id, symbol, epoch, side, price ORDER BY seq) AS seq_to FROM xseeded),
points AS (SELECT t.session_id, t.symbol, t.seq, (SELECT count(*) FROM snaps s WHERE s.session_id = t.session_id AND s.seq <= t.seq) AS epoch FROM trades t),
standing AS (
  SELECT p.session_id, p.symbol, p.epoch, p.seq, i.side, i.price, i.quantity FROM points p JOIN intervals i
  ON i.session_id = p.session_id AND i.symbol = p.symbol AND i.epoch = p.epoch AND i.quantity > 0 AND i.seq_from <= p.seq AND (i.seq_to IS NULL OR p.seq < i.seq_to)),
best AS (
  SELECT session_id, symbol, epoch, seq, max(price) FILTER (side = 'BID') AS best_bid, min(price) FILTER (side = 'ASK') AS best_ask,
         arg_max(quantity, price) FILTER (side = 'BID') AS bid_quantity, arg_min(quantity, price) FILTER (side = 'ASK') AS ask_quantity,
         count(*) FILTER (side = 'BID') AS bid_levels, count(*) FILTER (side = 'ASK') AS ask_levels
  FROM standing GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id, symbol, epoch, seq, side ORDER BY CASE WHEN side = 'BID' THEN -price ELSE price END) AS INTEGER) AS rank FROM standing),
depths AS (
  SELECT session_id, symbol, epoch, seq, CAST(coalesce(sum(quantity) FILTER (side = 'BID'), 0) AS BIGINT) AS bid_depth, CAST(coalesce(sum(quantity) FILTER (side = 'ASK'), 0) AS BIGINT) AS ask_depth
  FROM ranked WHERE rank <= 10 GROUP BY ALL),
timeline AS (
  SELECT l.session_id, l.symbol, l.epoch, l.seq, l.ts_ms, max(i.price) FILTER (i.side = 'BID') AS best_bid, min(i.price) FILTER (i.side = 'ASK') AS best_ask,
         arg_max(i.quantity, i.price) FILTER (i.side = 'BID') AS bid_quantity, arg_min(i.quantity, i.price) FILTER (i.side = 'ASK') AS ask_quantity
  FROM lv l LEFT JOIN intervals i ON i.session_id = l.session_id AND i.symbol = l.symbol AND i.epoch = l.epoch AND i.quantity > 0 AND i.seq_from <= l.seq AND (i.seq_to IS NULL OR l.seq < i.seq_to)
  GROUP BY ALL),
xtimeline AS (
  SELECT l.session_id, l.symbol, l.epoch, l.seq, l.ts_ms, max(i.price) FILTER (i.side = 'BID') AS best_bid, min(i.price) FILTER (i.side = 'ASK') AS best_ask
  FROM xlv l LEFT JOIN xintervals i ON i.session_id = l.session_id AND i.symbol = l.symbol AND i.epoch = l.epoch AND i.quantity > 0 AND i.seq_from <= l.seq AND (i.seq_to IS NULL OR l.seq < i.seq_to)
  GROUP BY ALL),
kinds AS (
  SELECT *, CASE WHEN coalesce(old_quantity, 0) = 0 AND quantity > 0 THEN 'added' WHEN coalesce(old_quantity, 0) > 0 AND quantity = 0 THEN 'removed'
                 WHEN quantity > coalesce(old_quantity, 0) THEN 'increased' WHEN quantity < coalesce(old_quantity, 0) THEN 'decreased' ELSE 'unchanged' END AS kind,
         abs(quantity - coalesce(old_quantity, 0)) AS magnitude FROM changes),
liq AS (SELECT * FROM kinds WHERE kind <> 'unchanged'),
stepped AS (
  SELECT *, CASE WHEN lag(ts_ms) OVER w IS NULL OR ts_ms - lag(ts_ms) OVER w > 1800000 OR abs(price - lag(price) OVER w) > 30000000 THEN 1 ELSE 0 END AS fresh
  FROM trades WINDOW w AS (PARTITION BY session_id, symbol ORDER BY seq)),
clustered AS (SELECT * EXCLUDE (fresh), CAST(sum(fresh) OVER (PARTITION BY session_id, symbol ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM stepped),
judged AS (
  SELECT *, price - lag(price) OVER w AS step, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY session_id, symbol, cluster ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_by
  FROM clustered WINDOW w AS (PARTITION BY session_id, symbol, cluster ORDER BY seq)),
measured AS (
  SELECT session_id, symbol, cluster, arg_min(ts_ms, seq) AS start_ms, arg_max(ts_ms, seq) AS end_ms, max(price) AS high, min(price) AS low, CAST(sum(quantity) AS BIGINT) AS total_volume,
         CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END) AS BIGINT) AS sell_volume,
         count(*) AS trade_count, max(quantity) AS largest_trade, arg_min(price, seq) AS first_price, arg_max(price, seq) AS last_price,
         count(*) FILTER (step <> 0) + 1 AS levels_crossed, count(*) FILTER (CASE WHEN lead_by >= 0 THEN step < 0 ELSE step > 0 END) = 0 AS monotonic, max(seq) AS last_seq
  FROM judged GROUP BY ALL),
cl AS (
  SELECT *, buy_volume - sell_volume AS delta, CASE WHEN buy_volume >= sell_volume THEN 'BUY' ELSE 'SELL' END AS dominant_side,
         greatest(buy_volume, sell_volume) / total_volume AS dominance, cluster < max(cluster) OVER (PARTITION BY session_id, symbol) AS closed FROM measured),
sw AS (
  SELECT *, end_ms - start_ms AS duration_ms, greatest(CASE WHEN dominant_side = 'BUY' THEN last_price - first_price ELSE first_price - last_price END, 0) AS displacement,
         0.35 * least(levels_crossed / 3.0::DOUBLE, 1.0) + 0.30 * least(total_volume / 500000000.0::DOUBLE, 1.0) + 0.20 * dominance
         + 0.15 * (CASE WHEN end_ms = start_ms THEN 1.0::DOUBLE ELSE least(1800000.0::DOUBLE / (end_ms - start_ms), 1.0) END) AS confidence
  FROM cl WHERE closed AND monotonic AND end_ms - start_ms <= 1800000 AND levels_crossed >= 3 AND total_volume >= 500000000 AND dominance >= 0.5),
hflow AS (
  SELECT session_id, symbol, ts_ms - ts_ms % 3600000 AS bucket, price, CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE 0 END) AS BIGINT) AS buy_volume,
         CAST(sum(CASE WHEN side = 'SELL' THEN quantity ELSE 0 END) AS BIGINT) AS sell_volume, CAST(sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) AS BIGINT) AS delta,
         count(*) AS trade_count, CAST(sum(CASE WHEN quantity >= 500000000 THEN quantity ELSE 0 END) AS BIGINT) AS large_volume FROM trades GROUP BY ALL),
hstep AS (
  SELECT *, ts_ms - ts_ms % 3600000 AS bucket, quantity - coalesce(lag(quantity) OVER (PARTITION BY session_id, symbol, ts_ms - ts_ms % 3600000, price, side ORDER BY seq, pos), 0) AS step FROM changes),
hliq AS (
  SELECT session_id, symbol, bucket, price, coalesce(arg_max(quantity, seq) FILTER (side = 'BID'), 0) AS resting_bid, coalesce(arg_max(quantity, seq) FILTER (side = 'ASK'), 0) AS resting_ask,
         CAST(sum(greatest(step, 0)) AS BIGINT) AS liquidity_added, CAST(sum(greatest(-step, 0)) AS BIGINT) AS liquidity_removed FROM hstep GROUP BY ALL),
hsig AS (SELECT session_id, symbol, end_ms - end_ms % 3600000 AS bucket, last_price AS price, count(*) AS sweep_count FROM sw GROUP BY ALL),
cells AS (
  SELECT session_id, symbol, bucket, price, coalesce(resting_bid, 0) AS resting_bid, coalesce(resting_ask, 0) AS resting_ask, coalesce(liquidity_added, 0) AS liquidity_added,
         coalesce(liquidity_removed, 0) AS liquidity_removed, coalesce(buy_volume, 0) AS buy_volume, coalesce(sell_volume, 0) AS sell_volume, coalesce(delta, 0) AS delta,
         coalesce(trade_count, 0) AS trade_count, coalesce(large_volume, 0) AS large_volume, CAST(0 AS BIGINT) AS replenishment_count, CAST(0 AS BIGINT) AS absorption_count,
         coalesce(sweep_count, 0) AS sweep_count, coalesce(delta, 0) AS pressure
  FROM hflow FULL JOIN hliq USING (session_id, symbol, bucket, price) FULL JOIN hsig USING (session_id, symbol, bucket, price))
"""


# When snapshots of the microstructure fire: the first event, then each first one six hours or more after the last that did.
SEGMENTS = """, ev AS (SELECT session_id, symbol, seq, ts_ms FROM trades UNION ALL SELECT DISTINCT session_id, symbol, seq, ts_ms FROM levels),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, symbol ORDER BY seq) AS n FROM ev),
later AS MATERIALIZED (SELECT a.session_id, a.n, min(b.n) AS next_n FROM numbered a JOIN numbered b ON b.session_id = a.session_id AND b.n > a.n AND b.ts_ms - a.ts_ms >= 21600000 GROUP BY ALL),
fires AS (SELECT session_id, n FROM numbered WHERE n = 1 UNION ALL SELECT f.session_id, l.next_n FROM fires f JOIN later l USING (session_id, n)),
segs AS MATERIALIZED (
  SELECT e.session_id, e.symbol, e.seq, e.ts_ms, f.n IS NOT NULL AS fired, CAST(count(f.n) OVER (PARTITION BY e.session_id, e.symbol ORDER BY e.n) - CASE WHEN f.n IS NULL THEN 0 ELSE 1 END AS BIGINT) AS segment
  FROM numbered e LEFT JOIN fires f USING (session_id, n))
"""

# Refills: an increase uses up the earliest decrease of its level at most a day before it.
REFILLS = """, lev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id, symbol, epoch, side, price ORDER BY seq, pos) AS n FROM liq),
fifo AS (
  SELECT DISTINCT session_id, symbol, epoch, side, price, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS waiting, false AS hit FROM lev
  UNION ALL
  SELECT session_id, symbol, epoch, side, price, n, CASE WHEN kind = 'decreased' THEN list_append(waiting, ts_ms) WHEN i > 0 THEN list_concat(waiting[:i - 1], waiting[i + 1:]) ELSE waiting END, i > 0
  FROM (SELECT f.session_id, f.symbol, f.epoch, f.side, f.price, l.n, l.kind, l.ts_ms, f.waiting,
               CASE WHEN l.kind IN ('increased', 'added') THEN coalesce(list_position(list_transform(f.waiting, lambda t: l.ts_ms <= t + 86400000), true), 0) ELSE 0 END AS i
        FROM fifo f JOIN lev l ON l.session_id = f.session_id AND l.symbol = f.symbol AND l.epoch = f.epoch AND l.side = f.side AND l.price = f.price AND l.n = f.n + 1)),
refills AS MATERIALIZED (SELECT session_id, symbol, epoch, side, price, l.seq, l.pos, l.ts_ms, l.quantity FROM fifo f JOIN lev l USING (session_id, symbol, epoch, side, price, n) WHERE f.hit)
"""

# Continuity of depth updates: the state is the last applied id (none while buffering) and the buffer; made is what a step settles.
SEQUENCING = """, evs AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY session_id, symbol ORDER BY seq) AS n FROM (
    SELECT DISTINCT session_id, symbol, seq, first_update_id AS f, final_update_id AS l, previous_final_update_id AS p, CAST(NULL AS BIGINT) AS shot FROM levels
    UNION ALL SELECT session_id, symbol, seq, NULL, NULL, NULL, last_update_id FROM snaps)),
walk AS (
  SELECT DISTINCT session_id, symbol, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS last, CAST([] AS STRUCT(seq BIGINT, f BIGINT, l BIGINT, p BIGINT)[]) AS held,
         CAST([] AS STRUCT(seq BIGINT, status VARCHAR)[]) AS made, CAST(0 AS BIGINT) AS at_seq FROM evs
  UNION ALL
  SELECT session_id, symbol, n,
         CASE WHEN shot IS NULL THEN CASE WHEN last IS NULL OR p IS DISTINCT FROM last THEN NULL ELSE greatest(l, last) END WHEN b IS NULL THEN NULL ELSE chain[brk - 1].l END,
         CASE WHEN shot IS NULL AND last IS NULL THEN list_append(held, {'seq': seq, 'f': f, 'l': l, 'p': p}) WHEN shot IS NULL THEN held ELSE held[1:0] END,
         CASE WHEN shot IS NULL AND last IS NULL THEN CAST([] AS STRUCT(seq BIGINT, status VARCHAR)[])
              WHEN shot IS NULL THEN [{'seq': seq, 'status': CASE WHEN p IS DISTINCT FROM last THEN 'mismatch' WHEN l <= last THEN 'stale' ELSE 'applied' END}]
              WHEN b IS NULL THEN list_concat(list_transform(held[:k], lambda x: {'seq': x.seq, 'status': 'dropped'}), list_transform(rest, lambda x: {'seq': x.seq, 'status': 'no_bridge'}))
              ELSE list_concat(list_concat(list_transform(held[:k], lambda x: {'seq': x.seq, 'status': 'dropped'}), list_transform(rest[:b - 1], lambda x: {'seq': x.seq, 'status': 'dropped'})),
                               list_transform(chain, lambda x, i: {'seq': x.seq, 'status': CASE WHEN i = 1 THEN 'bridged' WHEN i < brk THEN 'applied' ELSE 'broken' END})) END,
         seq
  FROM (
    SELECT *, coalesce(nullif(list_position(list_transform(chain, lambda x, i: i >= 3 AND x.p IS DISTINCT FROM chain[i - 1].l), true), 0), len(chain) + 1) AS brk FROM (
      SELECT *, rest[b:] AS chain FROM (
        SELECT *, nullif(list_position(list_transform(rest, lambda x: x.f <= shot AND shot <= x.l), true), 0) AS b FROM (
          SELECT *, held[k + 1:] AS rest FROM (
            SELECT w.session_id, w.symbol, e.n, w.last, w.held, e.seq, e.f, e.l, e.p, e.shot,
                   coalesce(nullif(list_position(list_transform(w.held, lambda x: x.l >= e.shot), true), 0) - 1, len(w.held)) AS k
            FROM walk w JOIN evs e ON e.session_id = w.session_id AND e.symbol = w.symbol AND e.n = w.n + 1)))))),
stat AS MATERIALIZED (
  SELECT session_id, symbol, u.seq AS seq, u.status AS status, at_seq FROM (SELECT session_id, symbol, at_seq, unnest(made) AS u FROM walk)
  UNION ALL SELECT session_id, symbol, u.seq, 'buffered', NULL FROM (SELECT session_id, symbol, unnest(h) AS u FROM (SELECT session_id, symbol, arg_max(held, n) AS h FROM walk GROUP BY session_id, symbol)))
"""

REPORT = "SELECT session_id, symbol, count(*) FILTER (status IN ('applied', 'bridged')) AS applied, count(*) FILTER (status IN ('stale', 'dropped')) AS ignored, count(*) FILTER (status IN ('mismatch', 'broken', 'no_bridge')) AS errors, count(*) FILTER (status = 'bridged') AS resyncs, count(*) FILTER (status = 'buffered') AS waiting FROM stat GROUP BY ALL"

# The book that a replay ends with, and its best prices.
ENDING = """, newest AS (SELECT session_id, symbol, max(seq) AS from_seq FROM snaps GROUP BY ALL),
put AS (
  SELECT l.session_id, l.symbol, l.side, l.price, l.quantity, s.at_seq, l.seq, l.pos FROM levels l JOIN stat s USING (session_id, symbol, seq) LEFT JOIN newest n USING (session_id, symbol)
  WHERE s.status IN ('applied', 'bridged') AND (n.from_seq IS NULL OR s.at_seq >= n.from_seq)
  UNION ALL SELECT a.session_id, a.symbol, a.side, a.price, a.quantity, -1, a.seq, a.pos FROM ladder a JOIN newest n ON n.session_id = a.session_id AND n.symbol = a.symbol AND n.from_seq = a.seq),
ending AS (SELECT session_id, symbol, side, price, arg_max(quantity, (at_seq, seq, pos)) AS quantity FROM put GROUP BY ALL HAVING arg_max(quantity, (at_seq, seq, pos)) > 0),
tops AS (
  SELECT *, CASE WHEN best_bid < best_ask THEN (best_bid + best_ask) / 2.0 END AS mid, CASE WHEN best_bid < best_ask THEN best_ask - best_bid END AS spread FROM (
    SELECT session_id, symbol, max(price) FILTER (side = 'BID') AS best_bid, min(price) FILTER (side = 'ASK') AS best_ask, count(*) FILTER (side = 'BID') AS bid_levels, count(*) FILTER (side = 'ASK') AS ask_levels FROM ending GROUP BY ALL))
"""

# Trades of one price with the book at their time; a window opens, runs for a day, and the trade that closes it is in none.
ABSORBING = """, traded AS (
  SELECT t.session_id, t.symbol, t.seq, t.price, t.quantity, t.side, t.ts_ms, b.best_bid, b.best_ask, coalesce(b.best_bid >= b.best_ask, false) AS crossed, d.bid_depth, d.ask_depth
  FROM trades t ASOF JOIN timeline b ON b.session_id = t.session_id AND b.seq <= t.seq LEFT JOIN depths d ON d.session_id = t.session_id AND d.symbol = t.symbol AND d.seq = t.seq),
fit AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY session_id, symbol, price ORDER BY seq) AS n FROM (
    SELECT *, CASE WHEN side = 'BUY' THEN best_bid ELSE best_ask END AS best, coalesce(CASE WHEN side = 'BUY' THEN ask_depth ELSE bid_depth END, 0) AS opposing FROM traded WHERE NOT crossed) WHERE best IS NOT NULL),
closes AS MATERIALIZED (SELECT a.session_id, a.symbol, a.price, a.n, min(b.n) AS close_n FROM fit a JOIN fit b ON b.session_id = a.session_id AND b.symbol = a.symbol AND b.price = a.price AND b.n > a.n AND b.ts_ms - a.ts_ms > 86400000 GROUP BY ALL),
opens AS (
  SELECT session_id, symbol, price, n FROM fit WHERE n = 1
  UNION ALL SELECT e.session_id, e.symbol, e.price, e.n FROM opens o JOIN closes c USING (session_id, symbol, price, n) JOIN fit e ON e.session_id = o.session_id AND e.symbol = o.symbol AND e.price = o.price AND e.n = c.close_n + 1),
spans AS (SELECT o.*, c.close_n, f.best AS reference FROM opens o LEFT JOIN closes c USING (session_id, symbol, price, n) JOIN fit f USING (session_id, symbol, price, n)),
held AS MATERIALIZED (
  SELECT w.session_id, w.symbol, w.price, arg_min(e.side, e.n) AS side, min(e.seq) AS open_seq, any_value(z.seq) AS close_seq, arg_min(e.ts_ms, e.n) AS open_ms, arg_max(e.ts_ms, e.n) AS last_ms, any_value(w.reference) AS reference,
         count(*) AS trade_count, CAST(sum(e.quantity) AS BIGINT) AS volume, greatest(max(CASE WHEN e.side = 'BUY' THEN e.best - w.reference ELSE w.reference - e.best END), 0) AS displacement, arg_min(e.opposing, e.n) AS opposing_open
  FROM spans w JOIN fit e ON e.session_id = w.session_id AND e.symbol = w.symbol AND e.price = w.price AND e.n >= w.n AND (w.close_n IS NULL OR e.n < w.close_n)
  LEFT JOIN fit z ON z.session_id = w.session_id AND z.symbol = w.symbol AND z.price = w.price AND z.n = w.close_n GROUP BY w.session_id, w.symbol, w.price, w.n),
shut AS (SELECT * FROM held WHERE close_seq IS NOT NULL),
answered AS MATERIALIZED (
  SELECT w.*, CAST(coalesce(sum(CASE WHEN c.quantity > coalesce(c.old_quantity, 0) THEN c.quantity ELSE 0 END), 0) AS BIGINT) AS replenished, coalesce(arg_max(c.quantity, c.seq * 100 + c.pos), any_value(w.opposing_open)) AS closing
  FROM shut w LEFT JOIN changes c ON c.session_id = w.session_id AND c.symbol = w.symbol AND c.seq > w.open_seq AND c.seq < w.close_seq AND c.ts_ms - w.open_ms <= 86400000 AND c.ts_ms // 86400000 BETWEEN w.open_ms // 86400000 AND w.open_ms // 86400000 + 1
   AND CASE WHEN w.side = 'BUY' THEN c.price > w.reference ELSE c.price < w.reference END
  GROUP BY ALL),
absorbed AS MATERIALIZED (
  SELECT * FROM (
    SELECT *, 0.30::DOUBLE * least(volume / 2000000000.0::DOUBLE, 1) + 0.35::DOUBLE * (1 - least((displacement // 10000000) / 20.0::DOUBLE, 1))
      + 0.20::DOUBLE * (CASE WHEN replenished + volume = 0 THEN 0 ELSE replenished / (replenished + volume)::DOUBLE END)
      + 0.15::DOUBLE * (CASE WHEN opposing_open = 0 THEN 1 ELSE least(closing / opposing_open::DOUBLE, 1) END) AS confidence
    FROM answered WHERE trade_count >= 2 AND volume >= 2000000000 AND displacement // 10000000 <= 20) WHERE confidence >= 0.5)
"""

# Cells of the heatmap with every kind of signal.
FULL = """, fsig AS (
  SELECT session_id, symbol, ts_ms - ts_ms % 3600000 AS bucket, price, count(*) FILTER (kind = 'r') AS r, count(*) FILTER (kind = 'a') AS a FROM (
    SELECT session_id, symbol, ts_ms, price, 'r' AS kind FROM refills UNION ALL SELECT session_id, symbol, last_ms, price, 'a' FROM absorbed) GROUP BY ALL),
fcells AS MATERIALIZED (
  SELECT session_id, symbol, bucket, price, coalesce(resting_bid, 0) AS resting_bid, coalesce(resting_ask, 0) AS resting_ask, coalesce(liquidity_added, 0) AS liquidity_added, coalesce(liquidity_removed, 0) AS liquidity_removed,
         coalesce(buy_volume, 0) AS buy_volume, coalesce(sell_volume, 0) AS sell_volume, coalesce(delta, 0) AS delta, coalesce(trade_count, 0) AS trade_count, coalesce(large_volume, 0) AS large_volume,
         coalesce(r, 0) AS replenishment_count, coalesce(a, 0) AS absorption_count, coalesce(sweep_count, 0) AS sweep_count, coalesce(pressure, 0) AS pressure
  FROM cells FULL JOIN fsig USING (session_id, symbol, bucket, price))
"""

# Anomalies of the crossing variant of the book.
CROSSINGS = """, xtops AS (SELECT session_id, symbol, seq, ts_ms, max(price) FILTER (side = 'BID') AS best_bid, min(price) FILTER (side = 'ASK') AS best_ask FROM xladder GROUP BY ALL),
xmarks AS (
  SELECT *, coalesce(best_bid >= best_ask, false) AS crossed, (SELECT count(*) FROM segs g WHERE g.session_id = m.session_id AND g.fired AND g.seq < m.seq) AS segment FROM (
    SELECT session_id, symbol, seq, ts_ms, best_bid, best_ask, 'update' AS kind FROM xtimeline UNION ALL SELECT session_id, symbol, seq, ts_ms, best_bid, best_ask, 'snapshot' FROM xtops) m),
xflags AS (SELECT *, coalesce(lag(crossed) OVER w AND lag(segment) OVER w = segment, false) AS known FROM xmarks WINDOW w AS (PARTITION BY session_id, symbol ORDER BY seq)),
anomalies AS MATERIALIZED (SELECT session_id, symbol, seq, ts_ms, best_bid, best_ask, 'crossed book after ' || kind AS reason FROM xflags WHERE crossed AND (kind = 'snapshot' OR NOT known))
"""


def over_views(select: str) -> str:
    return VIEWS + select
