"""The same stand-ins and operators as SQL text, for checking results in another engine."""

from __future__ import annotations

LINE = """
li AS (
  SELECT CAST(l_suppkey % 4 AS INTEGER) AS datum, CAST(l_suppkey AS INTEGER) AS trace_num,
         CAST(row_number() OVER (PARTITION BY l_suppkey
              ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS INTEGER) AS frame,
         l_extendedprice AS raw
  FROM lineitem)"""

WALK = LINE + """,
cents AS (SELECT datum, trace_num, frame, CAST(round(raw * 100) AS BIGINT) AS c FROM li),
walk AS (
  SELECT datum, trace_num, frame,
         CAST(sum(c) OVER (PARTITION BY trace_num ORDER BY frame) AS DOUBLE) / 100.0
         - CAST(frame AS DOUBLE) * (CAST(sum(c) OVER (PARTITION BY trace_num) AS DOUBLE) / 100.0
           / CAST(count(*) OVER (PARTITION BY trace_num) AS DOUBLE)) AS raw
  FROM cents),
regions AS (
  SELECT datum, CAST((trace_num // 4) % 4 + 1 AS INTEGER) AS region, frame, sum(raw) AS raw
  FROM walk GROUP BY ALL)"""

LINE_MANIFEST = """
manifest AS (
  SELECT DISTINCT CAST(l_suppkey % 4 AS INTEGER) AS datum,
         CASE WHEN l_suppkey % 2 = 0 THEN 0 ELSE 100 END AS start_frame, 0.5 AS time_interval_s
  FROM lineitem)"""

EMB = """
emb AS (
  SELECT label AS datum, CAST(vec_id AS INTEGER) AS trace_num, CAST(i AS INTEGER) AS frame,
         CAST(embedding[i] AS DOUBLE) AS raw
  FROM (SELECT label, vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""

PIXELS = """
kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS datum
          FROM (SELECT DISTINCT event_type FROM events)),
sums AS (SELECT datum, day(ts) AS frame, user_id % 16 AS y, hour(ts) % 16 AS x,
                sum(CAST(round(value * 100) AS BIGINT)) AS cents
         FROM events JOIN kinds USING (event_type) GROUP BY ALL),
grid AS (SELECT d.datum, f.frame, a.y, b.x
         FROM (SELECT datum, max(frame) AS top FROM sums GROUP BY datum) d
         JOIN (SELECT unnest(range(1, 32)) AS frame) f ON f.frame <= d.top
         CROSS JOIN (SELECT unnest(range(0, 16)) AS y) a
         CROSS JOIN (SELECT unnest(range(0, 16)) AS x) b),
pixels AS (SELECT CAST(g.datum AS INTEGER) AS datum, CAST(g.frame AS INTEGER) AS frame,
                  CAST(g.y AS INTEGER) AS y, CAST(g.x AS INTEGER) AS x,
                  CAST(coalesce(cents, 0) AS DOUBLE) / 100.0 AS v
           FROM grid g LEFT JOIN sums s
             ON s.datum = g.datum AND s.frame = g.frame AND s.y = g.y AND s.x = g.x)"""

BOXES = """
boxes AS (SELECT CAST(k.datum AS INTEGER) AS datum, b.trace_num, b.x0, b.y0, b.width
          FROM kinds k CROSS JOIN (VALUES (1, 3, 3, 3), (2, 8, 4, 5), (3, 7, 11, 3))
               AS b(trace_num, x0, y0, width))"""

ACTIONS = """
actions AS (
  SELECT CAST(user_id % 2 AS INTEGER) AS datum, CAST(user_id AS INTEGER) AS trace_num,
         event_id AS seq,
         CASE event_type WHEN 'purchase' THEN 'f' WHEN 'error' THEN 'x'
                         WHEN 'signup' THEN 'u' WHEN 'view' THEN 'n' WHEN 'click' THEN 'n' END AS action,
         CAST(round(value) AS INTEGER) AS t1
  FROM events),
folded AS (
  SELECT datum, trace_num,
         coalesce(arg_max(action, seq) FILTER (WHERE action IN ('f', 'x', 'u')) = 'f', false) AS is_fusion,
         coalesce(arg_max(action, seq) FILTER (WHERE action IN ('x', 'u')) = 'x', false) AS is_excluded,
         count(*) FILTER (WHERE action = 'n') > 0 AS is_reviewed,
         arg_max(t1, seq) FILTER (WHERE action = 'f') AS t1
  FROM actions GROUP BY datum, trace_num),
status AS (
  SELECT datum, trace_num, is_reviewed, is_fusion,
         CASE WHEN is_fusion AND datum = 0 THEN t1 ELSE 0 END AS binding,
         CASE WHEN NOT is_fusion THEN 0 WHEN datum = 0 THEN t1 + 10 ELSE t1 END AS fusion_start,
         CASE WHEN NOT is_fusion THEN 0 WHEN datum = 0 THEN t1 + 20 ELSE t1 + 10 END AS fusion_end,
         is_excluded
  FROM folded)"""

ORDER_STATUS = """
segments AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY c_mktsegment) AS INTEGER) AS datum
             FROM (SELECT DISTINCT c_mktsegment FROM customer)),
pairs AS (SELECT o_custkey, o_orderkey, o_orderdate AS d2,
                 lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d1
          FROM orders),
ostatus AS (
  SELECT datum, CAST(o_orderkey AS INTEGER) AS trace_num, d1 IS NOT NULL AS is_fusion,
         CAST(coalesce(date_diff('day', d1, d2), 0) AS INTEGER) AS fusion_start,
         o_custkey % 10 = 0 AS is_excluded
  FROM pairs JOIN customer ON o_custkey = c_custkey JOIN segments USING (c_mktsegment)),
dwell AS (SELECT datum, CAST(fusion_start AS DOUBLE) AS dwell_s FROM ostatus
          WHERE is_fusion AND NOT is_excluded),
curve AS (SELECT datum, dwell_s,
                 row_number() OVER (PARTITION BY datum ORDER BY dwell_s) AS i,
                 count(*) OVER (PARTITION BY datum) AS n
          FROM dwell)"""


def search(src: str, key: str, tag: str, width: int = 50, penalty: float = 5.0) -> str:
    """CTEs ``{tag}_score``, ``{tag}_cand`` and ``{tag}_bkps`` over series ``src``."""
    half, order = width // 2, width // 2
    return f"""
{tag}_n AS (SELECT datum, {key}, count(*) AS n, avg(raw) AS mean, var_samp(raw) AS v
            FROM {src} GROUP BY ALL),
{tag}_base AS (
  SELECT s.datum, s.{key}, s.frame, n, v,
         sum(raw - mean) OVER (w ROWS BETWEEN {half - 1} PRECEDING AND CURRENT ROW) AS sl,
         sum(raw - mean) OVER (w ROWS BETWEEN 1 FOLLOWING AND {half} FOLLOWING) AS sr,
         sum(raw - mean) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
         CASE WHEN s.frame = 1 THEN lead(raw) OVER w - raw
              WHEN s.frame = n THEN raw - lag(raw) OVER w
              ELSE (lead(raw) OVER w - lag(raw) OVER w) / 2 END AS grad,
         CASE WHEN s.frame > 5 AND s.frame <= n - 5 THEN
           (sum(raw - mean) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)
            + 0.5 * (lag(raw - mean, 5) OVER w + lead(raw - mean, 5) OVER w)) / 10 END AS trend
  FROM {src} s JOIN {tag}_n t ON s.datum = t.datum AND s.{key} = t.{key}
  WINDOW w AS (PARTITION BY s.datum, s.{key} ORDER BY s.frame)),
{tag}_flag AS (SELECT *, (lead(trend) OVER w - lag(trend) OVER w) / 2 AS trend_grad
               FROM {tag}_base WINDOW w AS (PARTITION BY datum, {key} ORDER BY frame)),
{tag}_score AS (SELECT *, {half}.0 / 2 * power((sl - sr) / {half}, 2) / v AS score, n - 2 * {half} AS m
                FROM {tag}_flag WHERE frame >= {half} AND frame < n - {half} AND v > 0),
{tag}_ring AS (SELECT datum, {key}, frame, score, frame - {half} AS pos, true AS own FROM {tag}_score
               UNION ALL SELECT datum, {key}, frame, score, frame - {half} + m, false FROM {tag}_score
               UNION ALL SELECT datum, {key}, frame, score, frame - {half} - m, false FROM {tag}_score),
{tag}_peak AS (SELECT *, max(score) OVER (w ROWS BETWEEN {order} PRECEDING AND 1 PRECEDING) AS below,
                      max(score) OVER (w ROWS BETWEEN 1 FOLLOWING AND {order} FOLLOWING) AS above
               FROM {tag}_ring WINDOW w AS (PARTITION BY datum, {key} ORDER BY pos)),
{tag}_cand AS (SELECT s.*, row_number() OVER (PARTITION BY s.datum, s.{key}
                      ORDER BY s.score DESC, s.frame DESC) AS rk
               FROM {tag}_score s JOIN {tag}_peak p
                 ON p.datum = s.datum AND p.{key} = s.{key} AND p.frame = s.frame
               WHERE p.own AND p.score > p.below AND p.score > p.above AND s.m > {order}),
{tag}_near AS (SELECT c.datum, c.{key}, c.frame,
                      coalesce(max(o.frame) FILTER (WHERE o.frame < c.frame), 0) AS lf,
                      min(o.frame) FILTER (WHERE o.frame > c.frame) AS rf
               FROM {tag}_cand c LEFT JOIN {tag}_cand o
                 ON o.datum = c.datum AND o.{key} = c.{key} AND o.rk < c.rk
               GROUP BY ALL),
{tag}_gain AS (
  SELECT c.*, (c.frame - lf) * (coalesce(rf, c.n) - c.frame) / (coalesce(rf, c.n) - lf)
         * power((c.s - coalesce(l.s, 0)) / (c.frame - lf)
                 - (coalesce(r.s, 0) - c.s) / (coalesce(rf, c.n) - c.frame), 2) / c.v AS gain
  FROM {tag}_cand c JOIN {tag}_near e
    ON e.datum = c.datum AND e.{key} = c.{key} AND e.frame = c.frame
  LEFT JOIN {tag}_cand l ON l.datum = c.datum AND l.{key} = c.{key} AND l.frame = e.lf
  LEFT JOIN {tag}_cand r ON r.datum = c.datum AND r.{key} = c.{key} AND r.frame = e.rf),
{tag}_bkps AS (SELECT * FROM (
    SELECT *, min(gain) OVER (PARTITION BY datum, {key} ORDER BY rk) AS worst FROM {tag}_gain)
  WHERE worst > {penalty})"""


SEARCH_FULL = (
    WALK + "," + LINE_MANIFEST + "," + search("walk", "trace_num", "p") + ","
    + search("regions", "region", "r") + """,
defocus AS (SELECT DISTINCT datum, frame FROM r_bkps WHERE grad > 0 AND frame < n),
found AS (SELECT b.datum, b.trace_num, b.frame
          FROM p_bkps b JOIN manifest m ON m.datum = b.datum
          WHERE grad > 0 AND b.frame > m.start_frame AND b.frame < b.n AND trend_grad >= 0
            AND NOT EXISTS (SELECT 1 FROM defocus d WHERE d.datum = b.datum AND d.frame = b.frame)),
lists AS (SELECT w.datum, w.trace_num, start_frame, time_interval_s,
                 list_sort(list(f.frame) FILTER (WHERE f.frame IS NOT NULL)) AS cps
          FROM (SELECT DISTINCT datum, trace_num FROM walk) w
          JOIN manifest m ON m.datum = w.datum
          LEFT JOIN found f ON f.datum = w.datum AND f.trace_num = w.trace_num GROUP BY ALL),
auto AS (SELECT datum, trace_num, start_frame, time_interval_s, true AS is_reviewed,
                coalesce(len(cps), 0) > CASE WHEN start_frame = 0 THEN 2 ELSE 1 END AS is_fusion, cps
         FROM lists),
auto_status AS (
  SELECT datum, trace_num, is_reviewed, is_fusion,
         CASE WHEN is_fusion AND start_frame = 0 THEN cps[1] ELSE 0 END AS binding,
         CASE WHEN NOT is_fusion THEN 0 WHEN start_frame = 0 THEN cps[2] ELSE cps[1] END AS fusion_start,
         CASE WHEN NOT is_fusion THEN 0 WHEN start_frame = 0 THEN cps[2] ELSE cps[1] END AS fusion_end,
         false AS is_excluded, start_frame, time_interval_s
  FROM auto)"""
)
