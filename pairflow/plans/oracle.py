"""The same queries as plain SQL over the same tables, to check results against."""

from __future__ import annotations

from pairflow.fixtures import CORNER, GRID, RECTANGLES, SECOND_LIST, SQUARE, TRIANGLE

_TEXT = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def _t(column: str) -> str:
    return _TEXT.format(column)


def _s(nulls: bool = False) -> str:
    flow = "SUM(l_quantity)"
    hole = "l_suppkey % 20 = 4 AND extract(week FROM date_trunc('week', l_shipdate)) = 10"
    if nulls:
        flow = f"CASE WHEN NOT ({hole}) THEN SUM(l_quantity) END"
    return f"""s AS (
  SELECT l_suppkey AS site, l_suppkey // 2 AS pair_id,
         CASE WHEN l_suppkey % 2 = 0 THEN 'd' ELSE 'u' END AS du,
         CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS time,
         {flow} AS streamflow,
         CAST(SUM(l_linenumber) AS DOUBLE) AS rain,
         CAST(COUNT(*) AS BIGINT) AS n_obs
  FROM lineitem GROUP BY l_suppkey, date_trunc('week', l_shipdate))"""


_JOIN_COLUMNS = ", ".join(
    f"{side}.{c} AS {c}_{end}" for side, end in (("d", "x"), ("u", "y")) for c in ("site", "streamflow", "rain", "n_obs")
)


def _n(min_std: float = 34.0) -> str:
    """Numbered networks ``n`` with ``idx``, from the weekly series."""
    return f"""{_s()},
ok AS (
  SELECT pair_id FROM s GROUP BY pair_id
  HAVING count(*) FILTER (du = 'd') > 0 AND count(*) FILTER (du = 'u') > 0
     AND stddev_pop(CASE WHEN du = 'u' THEN streamflow END) >= {min_std}),
num AS (SELECT pair_id, CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS network_id FROM ok),
n AS (
  SELECT num.network_id, d.pair_id, d.time, {_JOIN_COLUMNS},
         CAST(row_number() OVER (PARTITION BY num.network_id ORDER BY d.time) - 1 AS BIGINT) AS idx
  FROM s d JOIN s u ON d.pair_id = u.pair_id AND d.time = u.time AND d.du = 'd' AND u.du = 'u'
  JOIN num ON num.pair_id = d.pair_id)"""


# Pairs of five suppliers each, by day.
_DAILY = f"""s AS (
  SELECT l_suppkey // 5 AS site, CAST(l_shipdate AS DATE) AS day, SUM(l_quantity) AS flow, CAST(SUM(l_linenumber) AS DOUBLE) AS rain
  FROM lineitem GROUP BY ALL),
ok AS (
  SELECT site // 2 AS pair_id FROM s GROUP BY pair_id
  HAVING count(DISTINCT site) = 2 AND stddev_pop(flow) FILTER (site % 2 = 1) >= 0.01),
num AS (SELECT pair_id, CAST(row_number() OVER (ORDER BY pair_id) - 1 AS BIGINT) AS network_id FROM ok),
n AS (
  SELECT network_id, d.flow AS flow_x, d.rain AS rain_x, u.flow AS flow_y,
         CAST(row_number() OVER (PARTITION BY network_id ORDER BY d.day) - 1 AS BIGINT) AS idx
  FROM s d JOIN s u ON u.site = d.site + 1 AND d.day = u.day AND d.site % 2 = 0 JOIN num ON num.pair_id = d.site // 2)"""


def _samples(target: str) -> str:
    return f"""WITH {_DAILY},
w AS (
  SELECT network_id, idx - 1024 AS start_idx, {target} AS o,
         round(0.5::DOUBLE * avg(flow_x) OVER f + 0.25::DOUBLE * last_value(rain_x) OVER f, 6) AS m
  FROM n WINDOW f AS (PARTITION BY network_id ORDER BY idx ROWS BETWEEN 1024 PRECEDING AND 1 PRECEDING))
SELECT * FROM w WHERE start_idx >= 0"""


def _size() -> str:
    return """size AS (
  SELECT count(*) AS k, floor(count(*) * 0.7::double) AS a, floor(count(*) * 0.2::double) AS v, floor(count(*) * 0.1::double) AS t FROM num)"""


def _md5_uniform(seed: str, key: str) -> str:
    return f"(('0x' || substr(md5(concat('{seed}-', CAST({key} AS VARCHAR))), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


# The persistence forecast over samples of 24 steps, with global batches of 256.
_FORECAST = f"""{_n()},
lagged AS (
  SELECT network_id, idx, streamflow_y AS o,
         lag(streamflow_y) OVER (PARTITION BY network_id ORDER BY idx) AS m FROM n),
f AS (SELECT network_id, idx - 24 AS start_idx, o, m FROM lagged WHERE idx >= 24),
fb AS (SELECT *, CAST((row_number() OVER (ORDER BY network_id, start_idx) - 1) // 256 AS BIGINT) AS batch_id FROM f)"""

_NSE = "1 - sum(power(o - m, 2)) / nullif(var_pop(o) * count(o), 0)"

_TRAIN = f"""{_n()},
size AS (SELECT count(DISTINCT network_id) AS k FROM n),
train AS (SELECT n.* FROM n, size WHERE network_id <= floor(k * 0.7::double))"""

_FEATURES = ("streamflow_x", "rain_x", "rain_y")

_SCALER = f"""{_TRAIN},
sc AS (
  SELECT {", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}" for c in _FEATURES)}
  FROM train)"""

# Networks of each set; one may be in two.
_SETS = f"""{_size()},
member AS (
  SELECT 'train' AS split, network_id FROM num, size WHERE network_id <= a
  UNION ALL SELECT 'val', network_id FROM num, size WHERE network_id BETWEEN a + 1 AND a + v
  UNION ALL SELECT 'test', network_id FROM num, size
    WHERE CASE WHEN t > 0 THEN network_id >= k - t ELSE network_id = floor({_md5_uniform('split', 'k')} * k) END)"""


def _span(gap: int) -> str:
    """Rows of each set by position, from the length of network 0."""
    return f"""z AS (
  SELECT CAST(floor(count(*) * 0.7::double) AS BIGINT) AS a, CAST(floor(count(*) * 0.2::double) AS BIGINT) AS v,
         CAST(floor(count(*) * 0.1::double) AS BIGINT) AS t FROM n WHERE network_id = 0),
span AS (
  SELECT 'train' AS split, CAST({gap} AS BIGINT) AS low, a AS high FROM z
  UNION ALL SELECT 'val', a + {gap}, a + {gap} + v FROM z
  UNION ALL SELECT 'test', a + {2 * gap} + v, a + {2 * gap} + v + t FROM z)"""


_BY_SET = f"""{_FORECAST}, {_SETS},
placed AS (
  SELECT split, network_id, start_idx, o, m,
         CAST((row_number() OVER (PARTITION BY split ORDER BY network_id, start_idx) - 1) // 64 AS BIGINT) AS batch_id
  FROM f JOIN member USING (network_id))"""

_EVALUATED = f"""{_BY_SET},
sd AS (SELECT stddev_pop(streamflow_y) AS s FROM n JOIN member USING (network_id) WHERE split = 'train'),
scored AS (
  SELECT split, batch_id, avg(power((o - m) / s, 2)) AS loss, round_even({_NSE}, 2) AS nse FROM placed, sd GROUP BY split, batch_id)"""

_LINES = f"""SELECT {_t('l_shipdate')} AS time, l_suppkey AS feature_id, l_quantity AS streamflow, l_orderkey AS gage_id FROM lineitem"""

_SELECTED = f"""SELECT {_t('l_shipdate')} AS time, l_suppkey AS feature_id, l_quantity AS streamflow FROM lineitem
WHERE l_shipdate >= DATE '1999-01-01' AND l_shipdate < DATE '2001-01-01'
  AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"""

_HISTORY = f"""{_s()},
h AS (
  SELECT site AS run_id, CAST(row_number() OVER (PARTITION BY site ORDER BY time) - 1 AS BIGINT) AS epoch,
         streamflow AS value FROM s)"""


def _early_stop(best: str, start: str, reset: str, worse: str) -> str:
    return f"""WITH {_HISTORY},
b AS (
  SELECT *, coalesce({best}(value) OVER (PARTITION BY run_id ORDER BY epoch
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {start}) AS best FROM h),
f AS (
  SELECT *, {reset} AS r, NOT ({reset}) AND {worse} AS bad FROM b),
g AS (SELECT *, sum(CASE WHEN r THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY epoch) AS island FROM f),
c AS (
  SELECT *, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END)
              OVER (PARTITION BY run_id, island ORDER BY epoch) AS BIGINT) AS counter FROM g)
SELECT run_id, epoch, value, counter, bad AND counter >= 5 AS stop FROM c"""


def _shapes(size: float) -> str:
    """Places ``p``, and the edges ``e`` of the shapes by supplier."""
    rows = []
    for kind, corners in enumerate((TRIANGLE, SQUARE, CORNER)):
        for (ax, ay), (bx, by) in zip(corners, corners[1:]):
            rows.append(f"({kind}, {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)")
    place = lambda seed: f"(floor({_md5_uniform(seed, 's_suppkey')} * {8 * (size - 5.0)}::DOUBLE) / 8)"
    return f"""p AS (
  SELECT s_suppkey, s_acctbal, s_suppkey % 3 AS kind, {place('px')} AS x, {place('py')} AS y FROM supplier),
shape(kind, ax, ay, bx, b_y) AS (VALUES {", ".join(rows)}),
e AS (
  SELECT p.s_suppkey, p.s_acctbal, x + ax AS ax, y + ay AS ay, x + bx AS bx, y + b_y AS b_y
  FROM p JOIN shape ON p.kind = shape.kind),
box AS (
  SELECT s_suppkey, min(ax) AS x_min, max(ax) AS x_max, min(ay) AS y_min, max(ay) AS y_max FROM e GROUP BY s_suppkey)"""


def _rectangles() -> str:
    rows = ", ".join(f"({dx}::DOUBLE, {dy}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE, {str(hole).lower()})" for dx, dy, w, h, _, hole in RECTANGLES)
    return f"""corner(dx, dy, w, h, hole) AS (VALUES {rows}),
rect AS (SELECT s_suppkey, x + dx AS x0, x + dx + w AS x1, y + dy AS y0, y + dy + h AS y1, hole FROM p, corner)"""


_POINTS = f"""pt AS (
  SELECT o_orderkey AS point_id, {_md5_uniform('x', 'o_orderkey')} * 100.0::DOUBLE AS x,
         {_md5_uniform('y', 'o_orderkey')} * 100.0::DOUBLE AS y FROM orders)"""

_INSIDE = f"""{_shapes(100.0)}, {_POINTS},
hit AS (
  SELECT pt.point_id, e.s_suppkey
  FROM pt JOIN box ON pt.x BETWEEN box.x_min AND box.x_max AND pt.y BETWEEN box.y_min AND box.y_max
  JOIN e ON e.s_suppkey = box.s_suppkey AND (e.ay > pt.y) <> (e.b_y > pt.y)
        AND pt.x < e.ax + (pt.y - e.ay) * (e.bx - e.ax) / (e.b_y - e.ay)
  GROUP BY pt.point_id, e.s_suppkey HAVING count(*) % 2 = 1)"""

# Share of each grid cell under a shape, by cutting the shape's upper and lower outlines at
# each cell's sides: the same closed form as the operator, edge by edge.
_WEIGHTS = f"""{_shapes(float(GRID))},
g AS (
  SELECT e.s_suppkey, e.s_acctbal, e.ax, e.ay, e.bx, e.b_y, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy,
         greatest(least(ax, bx), ix) AS xl, least(greatest(ax, bx), ix + 1) AS xr
  FROM e JOIN box USING (s_suppkey),
       range({GRID + 1}) AS a(ix), range({GRID + 1}) AS b(iy)
  WHERE e.ax <> e.bx AND iy >= floor(box.y_min) AND iy <= greatest(ay, b_y)
    AND ix + 1 > least(ax, bx) AND ix < greatest(ax, bx)),
g2 AS (
  SELECT *, ay + (xl - ax) * (b_y - ay) / (bx - ax) - iy AS hl, ay + (xr - ax) * (b_y - ay) / (bx - ax) - iy AS hr FROM g),
-- Cut once more where the edge crosses the cell's floor or ceiling, then each piece is a trapezoid.
g3 AS (
  SELECT *, CASE WHEN hl <> hr THEN least(greatest((0 - hl) / (hr - hl), 0), 1) ELSE 0 END AS t0,
            CASE WHEN hl <> hr THEN least(greatest((1 - hl) / (hr - hl), 0), 1) ELSE 0 END AS t1 FROM g2),
g4 AS (SELECT *, least(t0, t1) AS ta, greatest(t0, t1) AS tb FROM g3),
trap AS (
  SELECT *, least(greatest(hl, 0), 1) AS c0, least(greatest(hl + (hr - hl) * ta, 0), 1) AS c1,
            least(greatest(hl + (hr - hl) * tb, 0), 1) AS c2, least(greatest(hr, 0), 1) AS c3 FROM g4),
w AS (
  SELECT s_suppkey, s_acctbal, iy, ix,
         abs(sum(sign(bx - ax) * (xr - xl) *
             (ta * (c0 + c1) / 2 + (tb - ta) * (c1 + c2) / 2 + (1 - tb) * (c2 + c3) / 2))) AS w
  FROM trap GROUP BY s_suppkey, s_acctbal, iy, ix HAVING w > 1e-9)"""

_CELLS = f"""cells AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, l_suppkey % {GRID} AS iy, l_partkey % {GRID} AS ix,
         sum(l_quantity) AS rain, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) AS wind
  FROM lineitem GROUP BY ALL)"""

_ZONAL = f"""{_WEIGHTS}, {_CELLS},
z AS (
  SELECT time, s_suppkey, sum(rain * w) / sum(w) AS rain, sum(wind * w) / sum(w) AS wind
  FROM cells JOIN w USING (iy, ix) GROUP BY time, s_suppkey)"""

_ASSEMBLED = f"""{_ZONAL},
list AS (
  SELECT s_suppkey, s_suppkey AS pos, s_acctbal FROM supplier
  UNION ALL
  SELECT s_suppkey, {SECOND_LIST} + s_suppkey + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END, s_acctbal FROM supplier),
grid AS (
  SELECT s_suppkey, pos // 2 AS pair_id, CASE WHEN pos % 2 = 0 THEN 'd' ELSE 'u' END AS du, pos, s_acctbal, time
  FROM list, (SELECT DISTINCT time FROM cells)),
q AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS time, l_suppkey AS s_suppkey,
         arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS streamflow
  FROM lineitem GROUP BY ALL),
a AS (
  SELECT grid.*, z.rain, z.wind, q.streamflow, q.s_suppkey IS NOT NULL AS has_flow,
         s_acctbal > CASE WHEN pos < {SECOND_LIST} THEN -500 ELSE 1000 END AS has_attributes
  FROM grid LEFT JOIN z ON z.time = grid.time AND z.s_suppkey = grid.s_suppkey AND grid.s_acctbal > 0
  LEFT JOIN q ON q.time = grid.time AND q.s_suppkey = grid.s_suppkey)"""

# Sites of the first list alone, with a polygon each and all attributes.
_DAYS = f"""{_ASSEMBLED},
days AS (
  SELECT a.time, a.s_suppkey, du, pair_id, z.rain, z.wind, streamflow, has_flow, a.s_suppkey * 0.5::DOUBLE AS slope_mean
  FROM a LEFT JOIN z ON z.time = a.time AND z.s_suppkey = a.s_suppkey WHERE pos < {SECOND_LIST})"""

_DAY_ROWS = f"""WITH {_DAYS}
SELECT {_t('time')} AS time, s_suppkey AS comid, du, pair_id, round(rain, 6) AS rain, round(wind, 6) AS wind, streamflow, slope_mean
FROM days WHERE has_flow"""

_FILES = """f AS (
  SELECT arg_min(c_custkey, (c_acctbal, c_custkey)) OVER (PARTITION BY c_nationkey, c_mktsegment) AS ds_catid,
         c_custkey AS divide_id, c_acctbal AS "X", c_acctbal / 2 AS "Y",
         CAST(row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS BIGINT) AS idx,
         count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS len
  FROM customer),
d AS (SELECT * FROM f WHERE divide_id = ds_catid),
cand AS (
  SELECT d.ds_catid, d.idx AS ds_idx, u.idx, u.divide_id, u."X", u."Y"
  FROM d JOIN f u ON u.ds_catid = d.ds_catid AND u.divide_id <> d.divide_id
   AND u.idx BETWEEN greatest(0, d.idx - 10) AND least(d.len - 1, d.idx + 9)),
pick AS (
  SELECT ds_catid, divide_id AS us_catid, "X" AS us_x, "Y" AS us_y FROM cand
  QUALIFY row_number() OVER (PARTITION BY ds_catid ORDER BY md5(concat('pair-', CAST(ds_catid AS VARCHAR), '-', CAST(divide_id AS VARCHAR)))) = 1)"""


def _lcc() -> str:
    n = "(ln(cos(radians(30)) / cos(radians(60))) / ln(tan(radians(75)) / tan(radians(60))))"
    scale = f"(6370000 * cos(radians(30)) * power(tan(radians(60)), {n}) / {n})"
    lon = f"(-128.0::DOUBLE + {_md5_uniform('lon', 'c_custkey')} * 61.0::DOUBLE)"
    lat = f"(24.0::DOUBLE + {_md5_uniform('lat', 'c_custkey')} * 31.0::DOUBLE)"
    return f"""WITH k AS (SELECT {n} AS n, {scale} AS f),
ll AS (SELECT c_custkey, {lon} AS lon, {lat} AS lat FROM customer),
r AS (
  SELECT c_custkey, f / power(tan(radians(45) + radians(lat) / 2), n) AS rho, n * radians(lon + 97) AS theta,
         f / power(tan(radians(65)), n) AS rho0 FROM ll, k)
SELECT c_custkey, round(rho * sin(theta), 3) AS x, round(rho0 - rho * cos(theta), 3) AS y FROM r"""


def _windows(same_step: bool) -> str:
    frame = "OVER (PARTITION BY network_id ORDER BY idx ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"
    target = f"last_value(streamflow_y) {frame}" if same_step else "streamflow_y"
    return f"""WITH {_n()},
w AS (
  SELECT network_id, idx - 8 AS start_idx, sum(streamflow_x) {frame} AS sum_flow, sum(rain_x) {frame} AS sum_rain,
         last_value(streamflow_x) {frame} AS last_flow, count(*) {frame} AS steps, {target} AS y FROM n)
SELECT * FROM w WHERE start_idx >= 0"""


_SPLIT = """WITH {n},
size AS (SELECT count(*) AS k FROM num),
b AS (
  SELECT num.*, k, floor(k * 0.7::double) AS a, floor(k * 0.2::double) AS v, floor(k * 0.1::double) AS t FROM num, size)"""

ORACLE: dict[str, str] = {
    "pair_qc": f"""WITH {_s(nulls=True)},
r AS (SELECT CAST(unnest(range(0, max(pair_id) + 1)) AS BIGINT) AS pair_id FROM s),
g AS (
  SELECT pair_id, count(*) FILTER (du = 'd') AS n_d, count(*) FILTER (du = 'u') AS n_u,
         coalesce(bool_or(streamflow IS NULL) FILTER (du = 'd'), false) AS null_d,
         coalesce(bool_or(streamflow IS NULL) FILTER (du = 'u'), false) AS null_u,
         stddev_pop(CASE WHEN du = 'u' THEN streamflow END) AS sd
  FROM s GROUP BY pair_id)
SELECT r.pair_id, coalesce(n_d, 0) AS n_d, coalesce(n_u, 0) AS n_u, round(sd, 6) AS std_u,
       CASE WHEN coalesce(n_d, 0) = 0 THEN 'downstream_empty' WHEN null_d THEN 'downstream_null'
            WHEN coalesce(n_u, 0) = 0 THEN 'upstream_empty' WHEN null_u THEN 'upstream_null'
            WHEN sd < 34 THEN 'upstream_constant' ELSE 'ok' END AS reason
FROM r LEFT JOIN g USING (pair_id)""",
    "pair_qc_gap": f"""WITH {_s()},
g AS (
  SELECT pair_id,
         arg_min(n_obs, time) FILTER (du = 'u') / arg_min(n_obs, time) FILTER (du = 'd') AS area_ratio,
         abs(arg_max(streamflow, time) FILTER (du = 'd') - arg_max(streamflow, time) FILTER (du = 'u')) AS id_gap
  FROM s GROUP BY pair_id)
SELECT pair_id, round(area_ratio, 6) AS area_ratio, round(id_gap, 6) AS id_gap,
       CASE WHEN area_ratio > 1 THEN 'area_ratio' WHEN id_gap > 40 THEN 'id_gap' ELSE 'ok' END AS reason
FROM g""",
    "pair_join": f"""WITH {_s()}
SELECT d.pair_id, {_t('d.time')} AS time, {_JOIN_COLUMNS}
FROM s d JOIN s u ON d.pair_id = u.pair_id AND d.time = u.time AND d.du = 'd' AND u.du = 'u'""",
    "pair_join_sparse": f"""WITH h AS (
  SELECT user_id AS site, date_trunc('hour', ts) AS time, arg_max(value, event_id) AS streamflow
  FROM events GROUP BY ALL)
SELECT d.site // 2 AS pair_id, {_t('d.time')} AS time, d.site AS site_x, d.streamflow AS streamflow_x,
       u.site AS site_y, u.streamflow AS streamflow_y
FROM h d JOIN h u ON d.time = u.time AND u.site = d.site + 1 AND d.site % 2 = 0""",
    "network_ids": f"WITH {_n()} SELECT pair_id, network_id FROM num",
    "network_rows": f"WITH {_n()} SELECT network_id, pair_id, {_t('time')} AS time, idx, streamflow_y FROM n",
    "time_slice": f"""WITH {_n()}
SELECT network_id, idx, {_t('time')} AS time, streamflow_x FROM n WHERE idx BETWEEN 50 AND 120""",
    "preview": f"WITH {_n()} SELECT network_id, idx, streamflow_x, streamflow_y FROM n WHERE idx < 101",
    "network_means": f"""WITH {_n()}
SELECT network_id, round_even(avg(streamflow_x), 2) AS mean_downstream, round_even(avg(streamflow_y), 2) AS mean_upstream
FROM n GROUP BY network_id""",
    "correlations": f"WITH {_TRAIN} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(corr({c}, streamflow_y), 6) AS correlation FROM train"
        for c in (*_FEATURES, "n_obs_y")
    ),
    "summary": f"""WITH {_n()}
SELECT count(DISTINCT network_id) AS n_networks, count(*) FILTER (network_id = 0) AS rows_first_network,
       count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM n""",
    "split_networks": _SPLIT.format(n=_n(0.1))
    + """ SELECT pair_id, network_id, network_id <= a AS in_train, network_id BETWEEN a + 1 AND a + v AS in_val,
       t > 0 AND network_id >= k - t AS in_test FROM b""",
    "split_networks_disjoint": _SPLIT.format(n=_n(0.1))
    + f""" SELECT pair_id, network_id, network_id <= a AS in_train, network_id BETWEEN a + 1 AND a + v AS in_val,
       CASE WHEN t > 0 THEN network_id >= k - t ELSE network_id = floor({_md5_uniform('split', 'k')} * k) END
         AND NOT network_id <= a + v AS in_test FROM b""",
    "split_time": f"""WITH {_n()},
z AS (
  SELECT CAST(floor(count(*) * 0.7::double) AS BIGINT) AS a, CAST(floor(count(*) * 0.2::double) AS BIGINT) AS v,
         CAST(floor(count(*) * 0.1::double) AS BIGINT) AS t FROM n WHERE network_id = 0)
SELECT CAST(24 AS BIGINT) AS train_start, a AS train_end, a + 24 AS val_start, a + 24 + v AS val_end,
       a + 48 + v AS test_start, a + 48 + v + t AS test_end FROM z""",
    "fit_scaler": f"WITH {_TRAIN} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS scale FROM train"
        for c in (*_FEATURES, "streamflow_y")
    )
    + " UNION ALL SELECT 'constant', 5.0::DOUBLE, 1.0::DOUBLE",
    "scale_transform": f"WITH {_SCALER} SELECT network_id, {_t('time')} AS time, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in _FEATURES)
    + " FROM n, sc",
    "scale_roundtrip": f"WITH {_n()} SELECT network_id, {_t('time')} AS time, {', '.join(_FEATURES)} FROM n",
    "windows_next_step": _windows(False),
    "windows_same_step": _windows(True),
    "window_features": f"""WITH {_n()},
w AS (
  SELECT network_id, idx - 24 AS start_idx, streamflow_y AS y,
         lag(streamflow_x, 1) OVER o AS streamflow_x_last, lag(streamflow_x, 2) OVER o AS streamflow_x_lag2,
         lag(streamflow_x, 5) OVER o AS streamflow_x_lag5,
         round(avg(streamflow_x) OVER (PARTITION BY network_id ORDER BY idx ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 6)
           AS streamflow_x_mean
  FROM n WINDOW o AS (PARTITION BY network_id ORDER BY idx))
SELECT * FROM w WHERE start_idx >= 0""",
    "batch_ids": f"WITH {_FORECAST} SELECT network_id, start_idx, batch_id FROM fb",
    "nse": f"WITH {_FORECAST} SELECT network_id, round({_NSE}, 6) AS nse FROM f GROUP BY network_id",
    "nse_slice": f"""WITH {_FORECAST},
sl AS (SELECT * FROM lagged WHERE idx BETWEEN 30 AND 150),
mean AS (SELECT network_id, avg(o) AS a, max(idx) AS last FROM sl GROUP BY network_id)
SELECT network_id, round(1 - sum(power(o - m, 2)) / nullif(sum(power(o - a, 2)), 0), 6) AS nse
FROM sl JOIN mean USING (network_id) WHERE idx >= 30 + 23 AND idx < last GROUP BY network_id""",
    "batch_mse": f"""WITH {_FORECAST}, b AS (SELECT batch_id, avg(power(o - m, 2)) AS e FROM fb GROUP BY batch_id)
SELECT 'persistence' AS run_id, round(avg(e), 6) AS mse FROM b""",
    "rmse": f"""WITH {_FORECAST},
b AS (SELECT network_id, start_idx // 64 AS k, sqrt(avg(power(o - m, 2))) AS e FROM f GROUP BY ALL)
SELECT network_id, round(avg(e), 6) AS rmse FROM b GROUP BY network_id""",
    "epoch_nse": f"""WITH {_FORECAST}, b AS (SELECT batch_id, round_even({_NSE}, 2) AS e FROM fb GROUP BY batch_id)
SELECT 'persistence' AS run_id, round(avg(e), 6) AS nse FROM b""",
    "evaluate_persistence": f"""WITH {_FORECAST},
b AS (
  SELECT network_id, start_idx // 64 AS k, avg(power(o - m, 2)) AS e, round_even({_NSE}, 2) AS s FROM f GROUP BY ALL)
SELECT 'persistence' AS run_id, network_id, round(avg(e), 6) AS loss, round(avg(s), 6) AS nse FROM b GROUP BY network_id""",
    "fit_flow": f"""WITH {_n()}, {_SETS},
w AS (
  SELECT network_id, idx, streamflow_y AS o, lag(streamflow_x) OVER (PARTITION BY network_id ORDER BY idx) AS x FROM n),
t AS (SELECT member.split, w.* FROM w JOIN member USING (network_id) WHERE idx >= 24),
line AS (SELECT regr_slope(o, x) AS b, regr_intercept(o, x) AS a FROM t WHERE split = 'train'),
p AS (SELECT split, network_id, o, a + b * x AS m FROM t, line WHERE split <> 'train')
SELECT split, network_id, round({_NSE}, 4) AS nse FROM p GROUP BY split, network_id""",
    "evaluate_split": f"""WITH {_EVALUATED}
SELECT 'persistence' AS run_id, CAST(0 AS BIGINT) AS epoch, split, round(avg(loss), 6) AS loss, round(avg(nse), 6) AS nse FROM scored GROUP BY split""",
    "history_rows": f"""WITH {_EVALUATED},
e AS (SELECT split, round(avg(loss), 6) AS loss, round(avg(nse), 6) AS nse FROM scored GROUP BY split)
SELECT 'persistence' AS run_id, CAST(0 AS BIGINT) AS epoch, concat('loss_', split) AS metric, loss AS value FROM e
UNION ALL SELECT 'persistence', 0, concat('nse_', split), nse FROM e""",
    "batch_ids_by_set": f"WITH {_BY_SET} SELECT split, network_id, start_idx AS set_idx, batch_id FROM placed",
    "windows_in_span": f"""WITH {_n()}, {_SETS}, {_span(8)},
lagged AS (
  SELECT network_id, idx, streamflow_y AS o, lag(streamflow_y) OVER (PARTITION BY network_id ORDER BY idx) AS m FROM n)
SELECT split, network_id, idx - 8 AS start_idx, idx - 8 - low AS set_idx, o, m
FROM lagged JOIN member USING (network_id) JOIN span USING (split) WHERE idx - 8 >= low AND idx <= high""",
    "inverse_by_network": f"""WITH {_TRAIN}, {_span(8)},
g AS (SELECT avg(streamflow_y) AS m, CASE WHEN stddev_pop(streamflow_y) = 0 THEN 1 ELSE stddev_pop(streamflow_y) END AS s FROM train),
own AS (
  SELECT network_id, avg(streamflow_y) AS m, CASE WHEN stddev_pop(streamflow_y) = 0 THEN 1 ELSE stddev_pop(streamflow_y) END AS s
  FROM n, span WHERE split = 'train' AND idx BETWEEN low AND high GROUP BY network_id)
SELECT n.network_id, idx, round((streamflow_y - g.m) / g.s * own.s + own.m, 6) AS streamflow_y
FROM n JOIN g ON true LEFT JOIN own ON own.network_id = n.network_id""",
    "score_windows": f"""WITH {_n()},
w AS (
  SELECT network_id, idx - 128 AS start_idx, round(0.5::DOUBLE * avg(streamflow_x) OVER f + 0.25::DOUBLE * last_value(rain_x) OVER f, 6) AS m
  FROM n WINDOW f AS (PARTITION BY network_id ORDER BY idx ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING))
SELECT * FROM w WHERE start_idx >= 0""",
    "score_same_step": f"""WITH {_n()},
w AS (
  SELECT network_id, idx - 128 AS start_idx, last_value(streamflow_y) OVER f AS o,
         round(0.5::DOUBLE * avg(streamflow_x) OVER f + 0.25::DOUBLE * last_value(rain_x) OVER f, 6) AS m
  FROM n WINDOW f AS (PARTITION BY network_id ORDER BY idx ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING))
SELECT * FROM w WHERE start_idx >= 0""",
    "samples_next_step": _samples("flow_y"),
    "samples_same_step": _samples("last_value(flow_y) OVER f"),
    "window_features_long": f"""WITH {_n()},
h AS (SELECT network_id, idx, streamflow_y, CASE WHEN idx % 37 <> 5 THEN streamflow_x END AS x FROM n),
w AS (
  SELECT network_id, idx - 128 AS start_idx, streamflow_y AS y, lag(x, 1) OVER o AS streamflow_x_last, lag(x, 3) OVER o AS streamflow_x_lag3,
         round(avg(x) OVER (PARTITION BY network_id ORDER BY idx ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING), 6) AS streamflow_x_mean
  FROM h WINDOW o AS (PARTITION BY network_id ORDER BY idx))
SELECT * FROM w WHERE start_idx >= 0""",
    "stored_series": f"""WITH {_s()}
SELECT site, {_t('time')} AS time, streamflow, CASE WHEN time >= TIMESTAMP '1995-01-01' THEN rain END AS rain FROM s""",
    "stored_series_csv": f"WITH {_s()} SELECT site, pair_id, du, {_t('time')} AS time, streamflow, rain, n_obs FROM s",
    "series_by_day": f"""WITH {_s()}
SELECT site, {_t('time')} AS time, streamflow FROM s WHERE time >= TIMESTAMP '1996-01-01' AND time < TIMESTAMP '1998-07-01'""",
    "stored_sites": """SELECT s_suppkey AS pos, concat('cat-', s_suppkey) AS catchment_id, CASE WHEN s_suppkey % 2 = 0 THEN 'd' ELSE 'u' END AS du,
       s_suppkey / 8 AS x, -s_suppkey / 4 AS y, s_suppkey AS comid FROM supplier""",
    "first_sites": "SELECT s_suppkey AS pos, concat('cat-', s_suppkey) AS catchment_id FROM supplier WHERE s_suppkey < 7",
    "stored_pair_map": """WITH o AS (SELECT o_orderkey, o_custkey, 2 * (row_number() OVER (ORDER BY o_orderkey) - 1) AS place FROM orders)
SELECT CAST(place AS BIGINT) AS pos, o_orderkey AS feature_id FROM o UNION ALL SELECT CAST(place + 1 AS BIGINT), o_custkey FROM o""",
    "stored_summary": f"""WITH {_HISTORY},
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 10)
SELECT 'flow' AS metric, string_agg(CAST(value AS VARCHAR), ', ' ORDER BY epoch) AS values, round(avg(value), 6) AS average
FROM k GROUP BY run_id""",
    "stored_attributes": f'WITH {_FILES} SELECT ds_catid, idx, divide_id, "X", "Y" FROM f',
    "stored_points": "SELECT -s_suppkey / 4 AS lat, s_suppkey / 8 AS lon FROM supplier",
    "stored_polygons": f"""WITH {_shapes(100.0)}, {_POINTS}, {_rectangles()},
hit AS (
  SELECT pt.point_id, s_suppkey, bool_or(hole) AS cut FROM pt JOIN rect
    ON pt.x >= x0 AND pt.x < x1 AND pt.y >= y0 AND pt.y < y1 GROUP BY ALL)
SELECT point_id, concat('cat-', s_suppkey) AS divide_id FROM hit WHERE NOT cut""",
    "flow_by_feature": _LINES,
    "flow_by_batch": f"SELECT feature_id - feature_id % 10 AS batch_start, time, feature_id, streamflow, gage_id FROM ({_LINES})",
    "flow_cache": _LINES,
    "chosen_features": f"""WITH {_n()}
SELECT network_id, {_t('time')} AS time, streamflow_x, rain_x, rain_y, streamflow_y, 'streamflow_x,rain_x,rain_y' AS inputs FROM n""",
    "days_run": _DAY_ROWS,
    "run_events": f"""WITH {_DAYS}
SELECT strftime(time, '%Y-%m-%d') AS day, CASE WHEN has_flow THEN 'done' ELSE 'error' END AS event, count(*) AS n, CAST(count(*) AS BIGINT) AS steps
FROM days GROUP BY ALL""",
    "run_span": f"""WITH {_DAYS} SELECT 'only' AS run, count(DISTINCT CAST(time AS DATE)) AS days, true AS took_time, true AS agrees FROM days""",
    "streamed_days": _DAY_ROWS,
    "last_n": f"""WITH {_HISTORY},
k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 10)
SELECT run_id, 'flow' AS metric, string_agg(CAST(value AS VARCHAR), ', ' ORDER BY epoch) AS values,
       round(avg(value), 6) AS average FROM k GROUP BY run_id""",
    "last_values": f"""WITH {_HISTORY}
SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC) <= 100""",
    "early_stop": _early_stop("min", "'inf'::DOUBLE", "value < best", "value > best + 3"),
    "early_stop_nse": _early_stop("max", "-100000000.0::DOUBLE", "value >= best", "value <= best - 3"),
    "pair_ids": """SELECT s_suppkey AS pos, concat('cat-', s_suppkey) AS catchment_id,
       CASE WHEN s_suppkey % 2 = 0 THEN 'd' ELSE 'u' END AS du, s_suppkey // 2 AS pair_id FROM supplier""",
    "attribute_key": """SELECT s_suppkey AS pos, concat('cat-', s_suppkey) AS catchment_id,
       CASE WHEN s_suppkey % 2 = 0 THEN concat('cat-', s_suppkey)
            ELSE lag(concat('cat-', s_suppkey)) OVER (ORDER BY s_suppkey) END AS ds_catid FROM supplier""",
    "id_batches": "SELECT s_suppkey AS pos, s_suppkey AS comid, s_suppkey - s_suppkey % 10 AS batch_start FROM supplier",
    "upstream_candidates": f"WITH {_FILES} SELECT ds_catid, ds_idx, idx, divide_id FROM cand",
    "select_pairs": f"WITH {_FILES} SELECT * FROM pick",
    "pair_list": f"""WITH {_FILES},
num AS (
  SELECT pick.*, d."X" AS ds_x, d."Y" AS ds_y, CAST(row_number() OVER (ORDER BY md5(CAST(ds_catid AS VARCHAR))) - 1 AS BIGINT) AS k
  FROM pick JOIN d USING (ds_catid))
SELECT k * 2 AS pos, CAST(ds_catid AS VARCHAR) AS catchment_id, 'd' AS du, ds_x AS x, ds_y AS y FROM num
UNION ALL SELECT k * 2 + 1, CAST(us_catid AS VARCHAR), 'u', us_x, us_y FROM num""",
    "missing_ids": """SELECT doc_id AS feature_id FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""",
    "random_points": f"""WITH {_shapes(100.0)},
b AS (SELECT min(x_min) AS x0, max(x_max) AS x1, min(y_min) AS y0, max(y_max) AS y1 FROM box)
SELECT o_orderkey AS point_id, round(x0 + {_md5_uniform('x', 'o_orderkey')} * (x1 - x0), 6) AS x,
       round(y0 + {_md5_uniform('y', 'o_orderkey')} * (y1 - y0), 6) AS y FROM orders, b""",
    "points_in_polygons": f"WITH {_INSIDE} SELECT DISTINCT point_id FROM hit",
    "locate_points": f"WITH {_INSIDE} SELECT point_id, concat('cat-', s_suppkey) AS divide_id FROM hit",
    "bounds": f"""WITH {_shapes(100.0)}
SELECT min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max FROM box""",
    "parts_within_box": f"""WITH {_shapes(100.0)}
SELECT s_suppkey AS part_id FROM box WHERE x_min >= 10 AND y_min >= 10 AND x_max <= 80 AND y_max <= 90""",
    "lcc": _lcc(),
    "cell_weights": f"""WITH {_WEIGHTS}
SELECT concat('cat-', s_suppkey) AS divide_id, iy, ix, round(w, 9) AS w FROM w""",
    "cell_weights_parts": f"""WITH {_shapes(float(GRID))}, {_rectangles()},
c AS (
  SELECT s_suppkey, ix, iy, sum(CASE WHEN hole THEN -1 ELSE 1 END
    * greatest(least(x1, ix + 1) - greatest(x0, ix), 0) * greatest(least(y1, iy + 1) - greatest(y0, iy), 0)) AS w
  FROM rect, range({GRID + 1}) AS a(ix), range({GRID + 1}) AS b(iy)
  GROUP BY ALL HAVING w > 1e-9)
SELECT concat('cat-', s_suppkey) AS divide_id, CAST(iy AS BIGINT) AS iy, CAST(ix AS BIGINT) AS ix, round(w, 9) AS w FROM c""",
    "zonal_mean": f"""WITH {_ZONAL}
SELECT {_t('time')} AS time, concat('cat-', s_suppkey) AS divide_id, round(rain, 6) AS rain, round(wind, 6) AS wind FROM z""",
    "site_time_grid": f"""SELECT s_suppkey AS comid, CASE WHEN s_suppkey % 2 = 0 THEN 'd' ELSE 'u' END AS du, {_t('time')} AS time
FROM supplier, (SELECT DISTINCT date_trunc('month', l_shipdate)::TIMESTAMP AS time FROM lineitem)""",
    "flow_keep_last": f"""SELECT {_t("date_trunc('month', l_shipdate)")} AS time, l_suppkey AS feature_id,
       arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS streamflow FROM lineitem GROUP BY ALL""",
    "keep_last": f"""SELECT user_id, {_t("date_trunc('hour', ts)")} AS time, arg_max(event_type, event_id) AS event_type,
       arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL""",
    "build_series": f"""WITH {_ASSEMBLED}
SELECT {_t('time')} AS time, s_suppkey AS comid, concat('cat-', s_suppkey) AS catid, du, pair_id,
       CASE WHEN s_acctbal > 0 THEN round(rain, 6) ELSE -9999 END AS rain,
       CASE WHEN s_acctbal > 0 THEN round(wind, 6) ELSE -9999 END AS wind, streamflow, s_acctbal AS slope_mean
FROM a WHERE has_flow AND has_attributes""",
    "site_errors": f"""WITH {_ASSEMBLED}
SELECT strftime(time, '%Y-%m-%d') AS day, pair_id, du, s_suppkey AS comid, concat('cat-', s_suppkey) AS catid,
       count(*) FILTER (NOT has_flow) AS n_no_flow, count(*) FILTER (NOT has_attributes) AS n_no_attributes
FROM a WHERE NOT (has_flow AND has_attributes) GROUP BY time, pair_id, du, s_suppkey""",
    "union_series": """SELECT event_id, user_id, value FROM events WHERE event_type = 'view'
UNION ALL BY NAME SELECT event_id, event_type, value FROM events WHERE event_type <> 'view'""",
    "day_keys": """WITH m AS (
  SELECT date_trunc('month', ts) AS month, count(DISTINCT date_trunc('hour', ts)) // 24 AS n FROM events GROUP BY ALL),
d AS (SELECT month + to_days(CAST(unnest(range(0, n)) AS INTEGER)) AS day FROM m)
SELECT strftime(day, '%Y-%m-%d') AS day, strftime(day, '%Y/%Y%m%d*') AS key FROM d""",
    "pair_map_ids": """SELECT o_orderkey, CAST(0 AS BIGINT) AS pos, o_orderkey + 1000000000 AS feature_id FROM orders
UNION ALL SELECT o_orderkey, 1, o_custkey + 7 FROM orders
UNION ALL SELECT o_orderkey, 2, o_orderkey FROM orders
UNION ALL SELECT o_orderkey, 3, o_custkey FROM orders""",
    "select_flow": _SELECTED,
    "select_stored_flow": _SELECTED,
    "flow_batches": """SELECT l_suppkey - l_suppkey % 10 AS batch_start, count(*) AS n_rows,
       count(DISTINCT l_suppkey) AS n_ids, sum(l_quantity) AS total FROM lineitem GROUP BY ALL""",
}
