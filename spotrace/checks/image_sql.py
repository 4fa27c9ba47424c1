"""SQL text of the image operators on the stand-in pixels (16 x 16)."""

from __future__ import annotations

import math

from spotrace.checks.oracle import PIXELS

SIDE = 16


def image(src: str = "pixels", tag: str = "") -> str:
    """CTEs ``proj{tag}`` and ``img{tag}``."""
    return f"""
proj{tag} AS (SELECT datum, y, x, sum(v) AS v FROM {src} GROUP BY ALL),
img{tag} AS (SELECT p.datum, p.y, p.x,
    CAST(floor(coalesce((v - lo) * 65535 / nullif(hi - lo, 0), 0) + 0.5) AS INTEGER) AS v
  FROM proj{tag} p JOIN (SELECT datum, min(v) AS lo, max(v) AS hi FROM proj{tag} GROUP BY datum) s
    ON s.datum = p.datum)"""


def background(radius: int, tag: str = "") -> str:
    """CTE ``clean{tag}``: pixels minus the rolling-ball surface."""
    ball = [
        f"({dy}, {dx}, {math.sqrt(radius * radius - dy * dy - dx * dx)!r}::DOUBLE)"
        for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)
        if dy * dy + dx * dx <= radius * radius
    ]
    return f"""
ball{tag} AS (SELECT * FROM (VALUES {', '.join(ball)}) AS b(dy, dx, z)),
low{tag} AS (SELECT datum, frame, y, x, min(v) AS v FROM (
    SELECT p.datum, p.frame, p.y - dy AS y, p.x - dx AS x, p.v - z AS v
    FROM pixels p CROSS JOIN ball{tag})
  WHERE y BETWEEN 0 AND {SIDE - 1} AND x BETWEEN 0 AND {SIDE - 1} GROUP BY ALL),
high{tag} AS (SELECT datum, frame, y, x, max(v) AS v FROM (
    SELECT p.datum, p.frame, p.y + dy AS y, p.x + dx AS x, p.v + z AS v
    FROM low{tag} p CROSS JOIN ball{tag})
  WHERE y BETWEEN 0 AND {SIDE - 1} AND x BETWEEN 0 AND {SIDE - 1} GROUP BY ALL),
clean{tag} AS (SELECT p.datum, p.frame, p.y, p.x, p.v - h.v AS v
  FROM pixels p JOIN high{tag} h
    ON h.datum = p.datum AND h.frame = p.frame AND h.y = p.y AND h.x = p.x)"""


def peaks(prominence: float, img: str = "img", tag: str = "") -> str:
    """CTE ``peaks{tag}``; needs WITH RECURSIVE."""
    return f"""
tops{tag} AS (SELECT datum, y, x, v FROM {img} i WHERE NOT EXISTS (
    SELECT 1 FROM {img} o WHERE o.datum = i.datum AND abs(o.y - i.y) <= 1 AND abs(o.x - i.x) <= 1
      AND (o.v > i.v OR (o.v = i.v AND (o.y < i.y OR (o.y = i.y AND o.x < i.x)))))),
reach{tag} AS (
  SELECT datum, y AS py, x AS px, v AS pv, y, x, v FROM tops{tag}
  UNION
  SELECT r.datum, py, px, pv, i.y, i.x, i.v FROM reach{tag} r JOIN {img} i
    ON i.datum = r.datum AND abs(i.y - r.y) <= 1 AND abs(i.x - r.x) <= 1
  WHERE i.v > r.pv - {prominence}),
peaks{tag} AS (SELECT datum, CAST(row_number() OVER (PARTITION BY datum ORDER BY y, x) AS INTEGER) AS box_num,
                      x AS cx, y AS cy, v
  FROM tops{tag} t WHERE NOT EXISTS (
    SELECT 1 FROM reach{tag} r WHERE r.datum = t.datum AND r.py = t.y AND r.px = t.x
      AND (r.v > t.v OR (r.v = t.v AND (r.y < t.y OR (r.y = t.y AND r.x < t.x))))))"""


def grown(tolerance: float, img: str = "img", peaks_name: str = "peaks", tag: str = "") -> str:
    """CTE ``grown{tag}``: final box of every peak."""
    return f"""
prof{tag} AS (SELECT p.datum, p.box_num, p.cx, p.cy, j.j, i.x - p.cx AS dx, avg(i.v) AS m
  FROM {peaks_name} p CROSS JOIN (SELECT unnest(range(1, 14)) AS j) j
  JOIN {img} i ON i.datum = p.datum AND abs(i.y - p.cy) <= j.j AND abs(i.x - p.cx) <= j.j
  GROUP BY ALL),
ends{tag} AS (SELECT datum, box_num, cx, cy, j,
    max(m) FILTER (WHERE dx = -j) AS f1, max(m) FILTER (WHERE dx = 1 - j) AS f2,
    max(m) FILTER (WHERE dx = j) AS l1, max(m) FILTER (WHERE dx = j - 1) AS l2,
    max(m) AS top, count(m) = 2 * max(j) + 1 AS whole
  FROM prof{tag} GROUP BY datum, box_num, cx, cy, j),
stops{tag} AS (SELECT datum, box_num, cx, cy,
    min(CASE WHEN j = 13 OR coalesce(f1 < top * {tolerance}, false) OR coalesce(l1 < top * {tolerance}, false)
             OR coalesce(f1 >= f2, false) OR coalesce(l1 >= l2, false) THEN j END) AS pstop,
    least(cx, cy, {SIDE + 1} - cx, {SIDE + 1} - cy) + 1 AS estop
  FROM ends{tag} GROUP BY ALL),
sized{tag} AS (SELECT *, least(pstop, estop) AS steps,
    CASE WHEN estop <= pstop THEN least(pstop, estop) - 1 ELSE pstop END AS half FROM stops{tag}),
grown{tag} AS (SELECT s.datum, s.box_num, s.cx, s.cy, CAST(s.cx - half AS INTEGER) AS x0,
    CAST(s.cy - half AS INTEGER) AS y0, CAST(2 * half + 1 AS INTEGER) AS width,
    CAST(steps AS INTEGER) AS steps, steps BETWEEN 2 AND 11 AND coalesce(e.whole, true) AS is_kept
  FROM sized{tag} s LEFT JOIN ends{tag} e
    ON e.datum = s.datum AND e.box_num = s.box_num AND e.j = s.half)"""


def grid(trials) -> str:
    """Full trial segmentation as one statement."""
    parts, outs = [PIXELS], []
    for r in sorted({t[0] for t in trials}):
        parts.append(background(r, f"_r{r}"))
        parts.append(image(f"clean_r{r}", f"_r{r}"))
    for i, (r, p, t) in enumerate(trials):
        parts.append(peaks(p, f"img_r{r}", f"_g{i}"))
        parts.append(grown(t, f"img_r{r}", f"peaks_g{i}", f"_g{i}"))
        outs.append(
            f"SELECT datum, {r} AS radius, {float(p)!r}::DOUBLE AS prominence, {float(t)!r}::DOUBLE AS tolerance, "
            f"count(*) FILTER (WHERE is_kept) AS n_kept, count(*) FILTER (WHERE NOT is_kept) AS n_rejected "
            f"FROM grown_g{i} GROUP BY datum"
        )
    return "WITH RECURSIVE " + ",".join(parts) + " " + " UNION ALL ".join(outs)
