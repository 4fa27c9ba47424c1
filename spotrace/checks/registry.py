"""Every operator as a named query over the given tables, with its SQL twin where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotrace.checks import fit_sql, image_sql, oracle, standins
from spotrace.model import TRACE_KEYS
from spotrace.operators import changepoints as cp
from spotrace.operators import events, images, labels, review, series, stats
from spotrace.plans import analysis, runs, segmentation
from spotrace.session import materialize, scratch_path
from spotrace.sources import manifest as manifest_io
from spotrace.sources import tables
from spotrace.sources import text_tables as text
from spotrace.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SIDE = standins.SIDE
PROMINENCE = 4000.0
TOLERANCE = 0.1
GRID = ((2, 2000.0, 0.1), (2, 9000.0, 0.1), (3, 2000.0, 0.1), (3, 9000.0, 0.4))


def query(sql: str | None = None):
    """Register the decorated function under its name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round doubles for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def rnd(expr: str, digits: int, name: str) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + " "


# --- series ---------------------------------------------------------------

_STAT = (
    "SELECT l.datum, l.trace_num, l.frame, l.raw, {} FROM li l JOIN (SELECT trace_num, min(raw) AS lo, "
    "max(raw) AS hi, avg(raw) AS mean, stddev_pop(raw) AS sd FROM li GROUP BY trace_num) s USING (trace_num)"
)
_W = "WINDOW w AS (PARTITION BY trace_num ORDER BY frame)"


@query(_with(oracle.LINE) + _STAT.format(rnd("(raw - lo) / nullif(hi - lo, 0)", 8, "norm")))
def normalize_minmax(spark, sf):
    return rounded(series.normalize(standins.line_traces(spark, sf)), 8, "norm")


@query(_with(oracle.LINE) + _STAT.format(rnd("(raw - mean) / nullif(sd, 0)", 6, "norm")))
def normalize_zscore(spark, sf):
    return rounded(series.normalize(standins.line_traces(spark, sf), "zscore"), 6, "norm")


@query(_with(oracle.LINE) + _STAT.format(rnd("raw - mean / nullif(sd, 0)", 4, "norm")))
def normalize_zscore_compat(spark, sf):
    return rounded(series.normalize(standins.line_traces(spark, sf), "zscore_compat"), 4, "norm")


@query(
    _with(oracle.LINE)
    + f"""SELECT datum, trace_num, CAST(count(*) AS INTEGER) AS n, min(raw) AS lo, max(raw) AS hi,
    {rnd('avg(raw) / (max(raw) - min(raw))', 9, 'mean')}, {rnd('stddev_pop(raw) / (max(raw) - min(raw))', 9, 'std_pop')}
    FROM li GROUP BY datum, trace_num"""
)
def trace_stats(spark, sf):
    # Mean and deviation in units of the range: means of whole cents would sit on rounding ties.
    span = F.col("hi") - F.col("lo")
    found = series.trace_stats(standins.line_traces(spark, sf))
    return rounded(
        found.withColumns({"mean": F.col("mean") / span, "std_pop": F.col("std_pop") / span}), 9, "mean", "std_pop"
    )


_GRAD = """coalesce((lead(raw) OVER w - lag(raw) OVER w) / 2, lead(raw) OVER w - raw, raw - lag(raw) OVER w)"""


@query(
    _with(oracle.LINE)
    + f"SELECT datum, trace_num, frame, raw, {rnd(_GRAD, 4, 'grad')} FROM li {_W}"
)
def gradient(spark, sf):
    return rounded(series.gradient(standins.line_traces(spark, sf)), 4, "grad")


def _decomposed(src: str, x: str) -> str:
    return f"""
trended AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY trace_num) >= 20 AND lag({x}, 5) OVER w IS NOT NULL
    AND lead({x}, 5) OVER w IS NOT NULL THEN
    (sum({x}) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)
     + 0.5 * (lag({x}, 5) OVER w + lead({x}, 5) OVER w)) / 10 END AS trend
  FROM {src} WINDOW w AS (PARTITION BY trace_num ORDER BY frame)),
phases AS (SELECT trace_num, (frame - 1) % 10 AS phase, avg({x} - trend) AS pm FROM trended GROUP BY ALL),
centred AS (SELECT trace_num, phase, pm - avg(pm) OVER (PARTITION BY trace_num) AS seasonal FROM phases)"""


_TREND = oracle.LINE + "," + _decomposed("li", "raw")


@query(_with(_TREND) + f"SELECT datum, trace_num, frame, raw, {rnd('trend', 4, 'trend')} FROM trended")
def trend(spark, sf):
    return rounded(series.trend(standins.line_traces(spark, sf)), 4, "trend")


# The decomposition runs on normalised traces by default.
_NORM_TREND = """normed AS (SELECT datum, trace_num, frame,
    (raw - min(raw) OVER t) / (max(raw) OVER t - min(raw) OVER t) AS norm
  FROM li WINDOW t AS (PARTITION BY trace_num)),""" + _decomposed("normed", "norm")


def _normed(spark, sf):
    return series.normalize(standins.line_traces(spark, sf)).select(*TRACE_KEYS, "frame", "norm")


@query(
    _with(oracle.LINE, _NORM_TREND)
    + f"SELECT datum, trace_num, frame, {rnd('norm', 8, 'norm')}, "
    f"{rnd('(lead(trend) OVER w - lag(trend) OVER w) / 2', 8, 'trend_grad')} FROM trended {_W}"
)
def trend_gradient(spark, sf):
    return rounded(series.trend_gradient(_normed(spark, sf), "norm"), 8, "norm", "trend_grad")


@query(
    _with(oracle.LINE, _NORM_TREND)
    + f"""SELECT t.datum, t.trace_num, t.frame, {rnd('norm', 8, 'norm')}, {rnd('trend', 8, 'trend')},
    {rnd('seasonal', 8, 'seasonal')}, {rnd('norm - trend - seasonal', 8, 'residual')}
    FROM trended t JOIN centred c ON c.trace_num = t.trace_num AND c.phase = (t.frame - 1) % 10"""
)
def decompose(spark, sf):
    return rounded(series.decompose(_normed(spark, sf), "norm"), 8, "norm", "trend", "seasonal", "residual")


@query(_with(oracle.LINE) + f"SELECT datum, trace_num, frame, raw, {rnd('sum(raw) OVER w', 2, 'running')} FROM li {_W}")
def running_sum(spark, sf):
    return rounded(series.running_sum(standins.line_traces(spark, sf)), 2, "running")


@query(_with(oracle.EMB) + "SELECT datum, trace_num, frame, raw FROM emb")
def frame_axis(spark, sf):
    vectors = standins.table(spark, sf, "embeddings").select(
        F.col("label").alias("datum"), F.col("vec_id").cast("int").alias("trace_num"),
        F.col("embedding").cast("array<double>").alias("raw"),
    )
    return series.frame_axis(vectors)


# --- changepoints ---------------------------------------------------------

_SEARCH = oracle.WALK + "," + oracle.search("walk", "trace_num", "p")


@query(_with(oracle.WALK) + "SELECT datum, trace_num, frame, raw + 0.0 AS raw FROM walk")
def walk_traces(spark, sf):
    # Computed in whole cents: equal to the last bit, so no rounding.
    return standins.walk_traces(spark, sf).withColumn("raw", F.col("raw") + F.lit(0.0))


@query(_with(_SEARCH) + f"SELECT datum, trace_num, frame, {rnd('score', 5, 'score')} FROM p_score")
def cp_score(spark, sf):
    return rounded(cp.changepoint_score(standins.walk_traces(spark, sf)), 5, "score")


@query(_with(_SEARCH) + f"SELECT datum, trace_num, frame, {rnd('score', 5, 'score')} FROM p_cand")
def cp_peaks(spark, sf):
    return rounded(cp.changepoint_peaks(standins.walk_traces(spark, sf)), 5, "score")


_SIGNS = "grad > 0 AS rising, trend_grad >= 0 AS trend_ok, CAST(n AS INTEGER) AS n"


@query(_with(_SEARCH) + f"SELECT datum, trace_num, frame, {_SIGNS} FROM p_bkps")
def cp_accept(spark, sf):
    return cp.accepted_breakpoints(standins.walk_traces(spark, sf))


@query(
    _with(oracle.WALK, """
ranked AS (SELECT datum, trace_num, frame,
    rank() OVER (PARTITION BY trace_num ORDER BY raw)
    + (count(*) OVER (PARTITION BY trace_num, raw) - 1) / 2.0 AS raw FROM walk)""",
          oracle.search("ranked", "trace_num", "k", 50, 3.0))
    + f"SELECT datum, trace_num, frame, {_SIGNS} FROM k_bkps"
)
def cp_accept_rank(spark, sf):
    ranks = materialize(cp.rank_transform(standins.walk_traces(spark, sf)), "ranks")
    return cp.accepted_breakpoints(ranks, penalty=3.0)


@query(
    _with(oracle.EMB, oracle.search("emb", "trace_num", "e", 20, 2.0))
    + f"SELECT datum, trace_num, frame, {_SIGNS} FROM e_bkps"
)
def cp_short(spark, sf):
    return cp.accepted_breakpoints(standins.embedding_traces(spark, sf), width=20, penalty=2.0)


@query(_with(oracle.SEARCH_FULL) + "SELECT datum, frame FROM defocus")
def defocus(spark, sf):
    return cp.defocus_frames(cp.region_changepoints(standins.walk_regions(spark, sf)))


@query(_with(_SEARCH) + f"SELECT datum, trace_num, frame, {_SIGNS} FROM p_bkps")
def cp_accept_chunked(spark, sf):
    # Chunks of 128 frames: the way traces longer than a chunk are searched.
    return cp.accepted_breakpoints(standins.walk_traces(spark, sf), chunk_bits=7)


def _found(spark, sf):
    return standins.stored(
        spark, sf, "changepoints",
        lambda: cp.find_changepoints(
            standins.walk_traces(spark, sf), standins.walk_regions(spark, sf), standins.line_manifest(spark, sf)
        ),
    )


@query(_with(oracle.SEARCH_FULL) + "SELECT datum, trace_num, frame FROM found")
def changepoints_full(spark, sf):
    return cp.find_changepoints(
        standins.walk_traces(spark, sf), standins.walk_regions(spark, sf), standins.line_manifest(spark, sf)
    )


@query(
    _with(oracle.SEARCH_FULL)
    + """SELECT datum, trace_num, frame FROM p_bkps b JOIN manifest m USING (datum)
    WHERE grad > 0 AND b.frame > m.start_frame AND b.frame < b.n AND trend_grad >= 0
    AND NOT EXISTS (SELECT 1 FROM defocus d WHERE d.datum = b.datum AND abs(d.frame - b.frame) <= 3)"""
)
def changepoints_tolerance(spark, sf):
    return cp.find_changepoints(
        standins.walk_traces(spark, sf), standins.walk_regions(spark, sf), standins.line_manifest(spark, sf),
        tolerance=3,
    )


@query(
    _with(oracle.SEARCH_FULL)
    + "SELECT datum, trace_num, coalesce(array_to_string(cps, ','), '') AS changepoints FROM lists"
)
def collect_changepoints(spark, sf):
    lists = cp.collect_changepoints(_found(spark, sf), standins.trace_list(standins.walk_traces(spark, sf)))
    return lists.withColumn("changepoints", F.concat_ws(",", F.col("changepoints").cast("array<string>")))


@query(
    _with(oracle.SEARCH_FULL)
    + """SELECT datum, trace_num, frame,
    CAST(row_number() OVER (PARTITION BY trace_num ORDER BY frame) AS INTEGER) AS position FROM found"""
)
def number_changepoints(spark, sf):
    return cp.number_changepoints(_found(spark, sf))


def _auto(spark, sf):
    return events.auto_status(
        _found(spark, sf), standins.trace_list(standins.walk_traces(spark, sf)), standins.line_manifest(spark, sf)
    )


_STATUS = "datum, trace_num, is_reviewed, is_fusion, CAST(binding AS INTEGER) AS binding, CAST(fusion_start AS INTEGER) AS fusion_start, CAST(fusion_end AS INTEGER) AS fusion_end, is_excluded"


@query(_with(oracle.SEARCH_FULL) + f"SELECT {_STATUS} FROM auto_status")
def auto_status(spark, sf):
    return _auto(spark, sf)


@query(
    _with(oracle.SEARCH_FULL)
    + """SELECT datum, trace_num, CAST((fusion_start - CASE WHEN start_frame = 0 THEN binding ELSE start_frame END)
    * time_interval_s AS DOUBLE) AS dwell_s FROM auto_status WHERE is_fusion"""
)
def dwell_auto(spark, sf):
    return events.dwell_times(_auto(spark, sf), standins.line_manifest(spark, sf))


@query(
    _with(oracle.SEARCH_FULL)
    + """SELECT datum, region, frame FROM r_bkps WHERE grad > 0 AND frame < n"""
)
def region_changepoints(spark, sf):
    return cp.region_changepoints(standins.walk_regions(spark, sf))


@query(
    _with(_SEARCH, oracle.LINE_MANIFEST)
    + "SELECT b.datum, b.trace_num, b.frame, m.start_frame, CAST(m.time_interval_s AS DOUBLE) AS time_interval_s "
    "FROM p_bkps b JOIN manifest m ON m.datum = b.datum"
)
def attach_start(spark, sf):
    found = cp.accepted_breakpoints(standins.walk_traces(spark, sf)).select(*TRACE_KEYS, "frame")
    return cp.attach_start(found, standins.line_manifest(spark, sf))


@query(_with(_SEARCH) + "SELECT datum, trace_num, frame FROM p_bkps WHERE grad > 0")
def filter_rising(spark, sf):
    found = cp.accepted_breakpoints(standins.walk_traces(spark, sf))
    return cp.filter_rising(found).select(*TRACE_KEYS, "frame")


@query(_with(_SEARCH) + "SELECT datum, trace_num, frame FROM p_bkps WHERE frame > 100 AND frame < n")
def filter_after_start(spark, sf):
    found = cp.accepted_breakpoints(standins.walk_traces(spark, sf))
    return cp.filter_after_start(found, 100).select(*TRACE_KEYS, "frame")


@query(_with(_SEARCH) + "SELECT datum, trace_num, frame FROM p_bkps WHERE trend_grad >= 0")
def filter_trend_nonfalling(spark, sf):
    found = cp.accepted_breakpoints(standins.walk_traces(spark, sf))
    return cp.filter_trend_nonfalling(found).select(*TRACE_KEYS, "frame")


# --- labels and review ----------------------------------------------------


def _folded(spark, sf):
    return events.fold_actions(standins.event_actions(spark, sf), standins.event_manifest(spark, sf))


@query(_with(oracle.ACTIONS) + f"SELECT {_STATUS} FROM status")
def fold_actions(spark, sf):
    return _folded(spark, sf)


_ALL_TRACES = """everyone AS (SELECT CAST(user_id % 2 AS INTEGER) AS datum, CAST(user_id AS INTEGER) AS trace_num FROM events
  UNION SELECT CAST(c_custkey % 2 AS INTEGER), CAST(c_custkey AS INTEGER) FROM customer),
whole AS (SELECT datum, trace_num, coalesce(is_reviewed, false) AS is_reviewed, coalesce(is_fusion, false) AS is_fusion,
  coalesce(binding, 0) AS binding, coalesce(fusion_start, 0) AS fusion_start, coalesce(fusion_end, 0) AS fusion_end,
  coalesce(is_excluded, false) AS is_excluded FROM everyone LEFT JOIN status USING (datum, trace_num))"""


def _everyone(spark, sf):
    """Users and customers as traces; customers without events are untouched."""
    people = [("events", "user_id"), ("customer", "c_custkey")]
    users, customers = (
        standins.table(spark, sf, t).select((F.col(c) % 2).cast("int").alias("datum"), F.col(c).cast("int").alias("trace_num"))
        for t, c in people
    )
    return users.union(customers).distinct()


@query(_with(oracle.ACTIONS, _ALL_TRACES) + f"SELECT {_STATUS} FROM whole")
def fold_actions_all(spark, sf):
    return events.fold_actions(standins.event_actions(spark, sf), standins.event_manifest(spark, sf), _everyone(spark, sf))


@query(
    _with(oracle.ACTIONS, _ALL_TRACES)
    + """SELECT datum, count(*) AS n_traces, count(*) FILTER (WHERE is_reviewed) AS n_reviewed,
    count(*) FILTER (WHERE is_fusion) AS n_fused, count(*) FILTER (WHERE is_excluded) AS n_excluded
    FROM whole GROUP BY datum"""
)
def review_progress_all(spark, sf):
    return events.review_progress(_folded(spark, sf), _everyone(spark, sf))


@query(
    _with(oracle.ACTIONS, _ALL_TRACES, """
placed AS (SELECT *, row_number() OVER (PARTITION BY datum ORDER BY trace_num) AS place FROM whole)""")
    + """SELECT datum, CAST(coalesce((min(place) FILTER (WHERE NOT is_reviewed) - 1) // 12, -1) AS INTEGER) AS panel
    FROM placed GROUP BY datum"""
)
def resume_panel_all(spark, sf):
    return review.resume_panel(_folded(spark, sf), traces=_everyone(spark, sf))


_RELOAD = """reloaded AS (SELECT datum, trace_num, is_reviewed, is_fusion AND NOT is_excluded AS is_fusion,
  CASE WHEN is_excluded THEN 0 ELSE binding END AS binding,
  CASE WHEN is_excluded THEN 0 ELSE fusion_start END AS fusion_start,
  CASE WHEN is_excluded THEN 0 ELSE fusion_end END AS fusion_end, is_excluded FROM status)"""


@query(_with(oracle.ACTIONS, _RELOAD) + f"SELECT {_STATUS} FROM reloaded")
def reload_status(spark, sf):
    return events.reload_status(_folded(spark, sf))


@query(_with(oracle.ACTIONS) + "SELECT datum, trace_num, is_fusion, is_excluded FROM status WHERE is_fusion AND NOT is_excluded")
def eligible_events(spark, sf):
    return events.eligible_events(_folded(spark, sf)).select(*TRACE_KEYS, "is_fusion", "is_excluded")


@query(
    _with(oracle.ACTIONS)
    + """SELECT datum, count(*) AS n_traces, count(*) FILTER (WHERE is_reviewed) AS n_reviewed,
    count(*) FILTER (WHERE is_fusion) AS n_fused, count(*) FILTER (WHERE is_excluded) AS n_excluded
    FROM status GROUP BY datum"""
)
def review_progress(spark, sf):
    return events.review_progress(_folded(spark, sf))


@query(
    _with(oracle.ACTIONS, """
placed AS (SELECT *, row_number() OVER (PARTITION BY datum ORDER BY trace_num) AS place FROM (
  SELECT datum, trace_num, is_fusion AS is_reviewed FROM status))""")
    + """SELECT datum, CAST(coalesce((min(place) FILTER (WHERE NOT is_reviewed) - 1) // 12, -1) AS INTEGER) AS panel
    FROM placed GROUP BY datum"""
)
def resume_panel(spark, sf):
    # Nearly every stand-in trace is reviewed; the fusion flag stands in for it.
    reviewed = _folded(spark, sf).withColumn("is_reviewed", F.col("is_fusion"))
    return review.resume_panel(reviewed)


@query(
    """WITH acts AS (SELECT CAST(user_id % 2 AS INTEGER) AS datum, CAST(floor((user_id - 1) / 12.0) AS INTEGER) AS panel,
      event_id AS seq FROM events WHERE event_type IN ('view', 'click')),
    people AS (SELECT DISTINCT CAST(user_id % 2 AS INTEGER) AS datum, CAST(user_id AS INTEGER) AS trace_num FROM events)
    SELECT a.datum, trace_num, count(*) AS n_actions, max(seq) AS last_seq FROM acts a JOIN people p
    ON p.datum = a.datum AND CAST(floor((trace_num - 1) / 12.0) AS INTEGER) = a.panel GROUP BY ALL"""
)
def expand_page_actions(spark, sf):
    base = standins.event_actions(spark, sf).filter("action = 'n'")
    panel = review.panel_columns(F.col("trace_num"))["panel"].alias("panel")
    people = standins.table(spark, sf, "events").select(
        (F.col("user_id") % 2).cast("int").alias("datum"), F.col("user_id").cast("int").alias("trace_num")
    ).distinct()
    expanded = events.expand_page_actions(base.select("datum", panel, "seq", "action"), people)
    return expanded.groupBy(*TRACE_KEYS).agg(F.count("seq").alias("n_actions"), F.max("seq").alias("last_seq"))


@query(
    _with(oracle.ACTIONS)
    + """SELECT datum, trace_num, seq, action, t1, t1 + 10 AS t2, CASE WHEN seq % 2 = 0 THEN t1 + 20 END AS t3,
    action <> 'f' OR datum = 1 OR seq % 2 = 0 AS is_complete FROM actions"""
)
def click_arity(spark, sf):
    clicks = standins.event_actions(spark, sf).withColumn("t3", F.when(F.col("seq") % 2 == 0, F.col("t3")))
    return events.click_arity(clicks, standins.event_manifest(spark, sf))


@query(
    _with(oracle.ACTIONS)
    + "SELECT datum, trace_num, true AS is_reviewed, is_fusion, is_excluded FROM status"
)
def mark_reviewed(spark, sf):
    return events.mark_reviewed(_folded(spark, sf)).select(*TRACE_KEYS, "is_reviewed", "is_fusion", "is_excluded")


def _user_traces(spark, sf):
    return standins.table(spark, sf, "events").select(
        (F.col("user_id") % 2).cast("int").alias("datum"), F.col("user_id").cast("int").alias("trace_num"),
        F.col("value"),
    ).groupBy(*TRACE_KEYS).agg(F.max("value").alias("top"))


@query(
    _with(oracle.ACTIONS)
    + """SELECT datum, trace_num, top, is_fusion FROM status JOIN (
      SELECT CAST(user_id % 2 AS INTEGER) AS datum, CAST(user_id AS INTEGER) AS trace_num, max(value) AS top
      FROM events GROUP BY ALL) t USING (datum, trace_num)"""
)
def attach_labels(spark, sf):
    return events.attach_labels(_user_traces(spark, sf), _folded(spark, sf)).select(*TRACE_KEYS, "top", "is_fusion")


@query(
    _with(oracle.ACTIONS, oracle.LINE)
    + """SELECT datum, trace_num, is_fusion FROM status s WHERE NOT EXISTS (
      SELECT 1 FROM li WHERE li.datum % 2 = s.datum AND li.trace_num = s.trace_num)"""
)
def unknown_labels(spark, sf):
    known = standins.trace_list(standins.line_traces(spark, sf)).withColumn("datum", F.col("datum") % 2)
    return events.unknown_labels(known, _folded(spark, sf)).select(*TRACE_KEYS, "is_fusion")


@query(
    _with(oracle.ACTIONS)
    + """SELECT datum, trace_num, concat_ws(',', trace_num, CAST(is_reviewed AS INTEGER), CAST(is_fusion AS INTEGER))
    || CASE WHEN datum = 0 THEN ',' || binding ELSE '' END || ',' ||
    concat_ws(',', fusion_start, fusion_end, CAST(is_excluded AS INTEGER)) AS value FROM status WHERE trace_num <> 0"""
)
def status_lines(spark, sf):
    lines = text.format_status(_folded(spark, sf), standins.event_manifest(spark, sf))
    return lines.select(*TRACE_KEYS, "value")


@query(
    _with(oracle.ACTIONS)
    + """SELECT datum, trace_num, seq, trace_num > 12 AND trace_num <= 24 AS is_on_page FROM actions"""
)
def on_page(spark, sf):
    typed = standins.event_actions(spark, sf)
    return typed.select(*TRACE_KEYS, "seq", review.on_page(F.col("trace_num"), 1).alias("is_on_page"))


_DWELL_MANUAL = """dwell AS (SELECT datum, trace_num, CAST((fusion_start - CASE WHEN datum = 0 THEN binding ELSE 100 END)
  * 0.5 AS DOUBLE) AS dwell_s FROM status WHERE is_fusion AND NOT is_excluded)"""


@query(_with(oracle.ACTIONS, _DWELL_MANUAL) + "SELECT datum, trace_num, dwell_s FROM dwell")
def dwell_manual(spark, sf):
    return events.dwell_times(_folded(spark, sf), standins.event_manifest(spark, sf))


@query(_with(oracle.ACTIONS) + "SELECT datum, trace_num, CAST((fusion_start + fusion_end) / 2.0 AS DOUBLE) AS fusion_mid FROM status WHERE is_fusion")
def fusion_mid(spark, sf):
    return events.fusion_mid(_folded(spark, sf)).filter("is_fusion").select(*TRACE_KEYS, "fusion_mid")


_PLACE = """CAST(floor(({n} - 1) / {k}.0) AS INTEGER) AS panel,
  CAST(floor((({n} - 1) % {k}) / {c}.0) AS INTEGER) AS "row", CAST(({n} - 1) % {c} AS INTEGER) AS col"""


@query(
    _with(oracle.LINE)
    + f"SELECT DISTINCT datum, trace_num, {_PLACE.format(n='trace_num', k=12, c=4)} FROM li"
)
def panel_of(spark, sf):
    listed = standins.trace_list(standins.line_traces(spark, sf))
    return review.panel_of(listed.drop("n"))


@query(
    _with(oracle.LINE, "placed AS (SELECT datum, trace_num, row_number() OVER (PARTITION BY datum ORDER BY trace_num) AS p FROM (SELECT DISTINCT datum, trace_num FROM li))")
    + f"SELECT datum, trace_num, {_PLACE.format(n='p', k=10, c=5)} FROM placed"
)
def rearrange(spark, sf):
    return review.rearrange(standins.trace_list(standins.line_traces(spark, sf)).drop("n"), 2, 5)


@query(_with(oracle.LINE) + "SELECT datum, CAST(count(DISTINCT trace_num) // 12 + 1 AS INTEGER) AS n_panels FROM li GROUP BY datum")
def panel_count(spark, sf):
    return review.panel_count(standins.trace_list(standins.line_traces(spark, sf)))


@query(_with(oracle.LINE) + "SELECT DISTINCT datum, trace_num FROM li WHERE trace_num BETWEEN 1 AND 12")
def page_slice(spark, sf):
    listed = standins.trace_list(standins.line_traces(spark, sf))
    return review.page_slice(listed, 0).select(*TRACE_KEYS)


@query(
    _with(oracle.ACTIONS)
    + """SELECT datum, trace_num, CASE WHEN NOT (trace_num % 7 <> 0) THEN 'red' WHEN is_fusion THEN 'cyan'
    WHEN NOT is_fusion THEN 'yellow' END AS color
    FROM (SELECT DISTINCT CAST(user_id % 2 AS INTEGER) AS datum, CAST(user_id AS INTEGER) AS trace_num FROM events) b
    LEFT JOIN status USING (datum, trace_num)"""
)
def event_color(spark, sf):
    boxes = standins.table(spark, sf, "events").select(
        (F.col("user_id") % 2).cast("int").alias("datum"), F.col("user_id").cast("int").alias("trace_num"),
        (F.col("user_id") % 7 != 0).alias("is_kept"),
    ).distinct()
    return review.event_color(boxes, _folded(spark, sf)).select(*TRACE_KEYS, "color")


@query(
    _with(oracle.LINE, oracle.ACTIONS)
    + """SELECT l.trace_num, l.datum % 2 AS datum, l.frame, l.raw, CAST(s.is_fusion AS INTEGER) AS label
    FROM li l JOIN status s ON s.trace_num = l.trace_num AND s.datum = l.datum % 2
    WHERE s.is_reviewed AND NOT s.is_excluded"""
)
def training_set(spark, sf):
    samples = standins.line_traces(spark, sf).withColumn("datum", F.col("datum") % 2)
    return events.training_set(samples, _folded(spark, sf))


@query(
    _with(oracle.SEARCH_FULL)
    + """SELECT datum, trace_num, kind, CAST(frame AS DOUBLE) AS frame,
    CAST(floor((trace_num - 1) / 12.0) AS INTEGER) AS panel FROM (
      SELECT datum, trace_num, 'start' AS kind, start_frame AS frame FROM auto_status WHERE start_frame <> 0
      UNION ALL SELECT datum, trace_num, 'binding', binding FROM auto_status WHERE is_fusion AND start_frame = 0
      UNION ALL SELECT datum, trace_num, 'fusion_start', fusion_start FROM auto_status WHERE is_fusion
      UNION ALL SELECT datum, trace_num, 'fusion_mid', (fusion_start + fusion_end) / 2.0 FROM auto_status WHERE is_fusion
      UNION ALL SELECT datum, trace_num, 'fusion_end', fusion_end FROM auto_status WHERE is_fusion
      UNION ALL SELECT datum, trace_num, 'changepoint', frame FROM found)"""
)
def annotations(spark, sf):
    return review.annotations(_auto(spark, sf), _found(spark, sf), standins.line_manifest(spark, sf))


# --- statistics -----------------------------------------------------------


def _dwell(spark, sf):
    return events.dwell_times(standins.order_status(spark, sf), standins.order_manifest(spark, sf)).select(
        "datum", "dwell_s"
    )


def _counts(spark, sf):
    return materialize(stats.dwell_counts(_dwell(spark, sf)), "dwell")


@query(_with(oracle.ORDER_STATUS) + "SELECT datum, trace_num, dwell_s FROM (SELECT datum, trace_num, CAST(fusion_start AS DOUBLE) AS dwell_s FROM ostatus WHERE is_fusion AND NOT is_excluded)")
def dwell_orders(spark, sf):
    return events.dwell_times(standins.order_status(spark, sf), standins.order_manifest(spark, sf))


@query(_with(oracle.ORDER_STATUS) + 'SELECT datum, i AS "rank", dwell_s, CAST(i AS DOUBLE) / n AS p FROM curve')
def ecdf(spark, sf):
    return stats.ecdf(_dwell(spark, sf))


@query(
    _with(oracle.ORDER_STATUS)
    + f"""SELECT datum, count(*) AS n, {rnd('avg(dwell_s)', 4, 'mean')}, {rnd('var_pop(dwell_s)', 3, 'variance')},
    {rnd('avg(dwell_s) * avg(dwell_s) / nullif(var_pop(dwell_s), 0)', 6, 'n_min')} FROM dwell GROUP BY datum"""
)
def n_min(spark, sf):
    return rounded(rounded(stats.dwell_moments(stats.dwell_counts(_dwell(spark, sf))), 4, "mean"), 3, "variance").withColumn(
        "n_min", F.round("n_min", 6) + 0.0
    )


_FIT = oracle.ORDER_STATUS + ",\n" + fit_sql.gamma_fit()
_FITTED = _FIT + f""",
points AS (SELECT c.datum, c.dwell_s, c.i, c.n, {fit_sql.cdf('c.dwell_s')} AS fit
           FROM (SELECT DISTINCT c.datum, c.dwell_s, max(i) OVER (PARTITION BY c.datum, c.dwell_s) AS i, c.n,
                        shape, loc, scale
                 FROM curve c JOIN fit f ON f.datum = c.datum) c),
quality AS (SELECT c.datum, 1 - sum(power(CAST(c.i AS DOUBLE) / c.n - p.fit, 2))
                 / sum(power(CAST(c.i AS DOUBLE) / c.n - (c.n + 1) / (2.0 * c.n), 2)) AS r2
            FROM curve c JOIN points p ON p.datum = c.datum AND p.dwell_s = c.dwell_s GROUP BY c.datum)"""


@query(_with(_FIT) + f"SELECT datum, n, {rnd('shape', 4, 'shape')}, {rnd('loc', 3, 'loc')}, {rnd('scale', 3, 'scale')} FROM fit")
def gamma_fit(spark, sf):
    fit = stats.gamma_fit(_counts(spark, sf)).drop("log_lik", "at_bound", "gradient").withColumn("n", F.col("n").cast("long"))
    return rounded(rounded(fit, 4, "shape"), 3, "loc", "scale")


@query(_with(_FITTED) + f"SELECT datum, dwell_s, {rnd('fit', 6, 'fit')} FROM points")
def gamma_cdf(spark, sf):
    counts = _counts(spark, sf)
    return rounded(stats.fitted_curve(counts, stats.gamma_fit(counts)), 6, "fit").select("datum", "dwell_s", "fit")


@query(_with(_FITTED) + f"SELECT datum, {rnd('r2', 6, 'r2')} FROM quality")
def fit_r2(spark, sf):
    counts = _counts(spark, sf)
    return rounded(stats.r_squared(stats.fitted_curve(counts, stats.gamma_fit(counts))), 6, "r2")


@query(
    _with(_FITTED)
    + f"""SELECT f.datum, s.c_mktsegment AS label, f.n, {rnd('shape', 4, 'shape')}, {rnd('loc', 3, 'loc')},
    {rnd('scale', 3, 'scale')}, {rnd('m.n_min', 6, 'n_min')}, {rnd('r2', 6, 'r2')}
    FROM fit f JOIN segments s ON s.datum = f.datum JOIN quality q ON q.datum = f.datum
    JOIN (SELECT datum, avg(dwell_s) * avg(dwell_s) / nullif(var_pop(dwell_s), 0) AS n_min FROM dwell GROUP BY datum) m
      ON m.datum = f.datum"""
)
def fit_summary(spark, sf):
    summary = stats.fit_summary(_dwell(spark, sf), standins.order_manifest(spark, sf))
    return rounded(rounded(rounded(summary, 4, "shape"), 3, "loc", "scale"), 6, "n_min", "r2")


@query(
    _with(_FITTED)
    + f"""SELECT c.datum, s.c_mktsegment AS label, c.i AS "rank", c.dwell_s, CAST(c.i AS DOUBLE) / c.n AS p,
    {rnd('p.fit', 6, 'fit')} FROM curve c JOIN points p ON p.datum = c.datum AND p.dwell_s = c.dwell_s
    JOIN segments s ON s.datum = c.datum"""
)
def curve_points(spark, sf):
    return rounded(stats.curve_points(_dwell(spark, sf), standins.order_manifest(spark, sf)), 6, "fit")


# --- images ---------------------------------------------------------------

_IMAGE = oracle.PIXELS + "," + image_sql.image()
_PEAKS = "WITH RECURSIVE " + _IMAGE + "," + image_sql.peaks(PROMINENCE)
_GROWN = _PEAKS + "," + image_sql.grown(TOLERANCE)


def _pixels(spark, sf):
    return standins.event_pixels(spark, sf)


def _frames(spark, sf):
    return images.pack_frames(_pixels(spark, sf), SIDE, SIDE)


def _image(spark, sf):
    return standins.stored(
        spark, sf, "event_image", lambda: images.rescale_16bit(images.z_project(_pixels(spark, sf)))
    )


@query(_with(oracle.PIXELS) + f"SELECT datum, y, x, {rnd('sum(v)', 2, 'v')} FROM pixels GROUP BY datum, y, x")
def z_project(spark, sf):
    return rounded(images.z_project(_pixels(spark, sf)), 2, "v")


@query(_with(oracle.PIXELS) + "SELECT datum, y, x, max(v) AS v FROM pixels WHERE frame <= 4 GROUP BY datum, y, x")
def z_project_max(spark, sf):
    return images.z_project(_pixels(spark, sf), "max", 4)


@query(_with(_IMAGE) + "SELECT datum, y, x, v FROM img")
def rescale16(spark, sf):
    return images.rescale_16bit(images.z_project(_pixels(spark, sf)))


@query(
    _with(oracle.PIXELS)
    + f"""SELECT datum, CAST(1 + y // 8 + 2 * (x // 8) AS INTEGER) AS region, frame, {rnd('sum(v)', 2, 'raw')}
    FROM pixels GROUP BY ALL"""
)
def region_intensity(spark, sf):
    return rounded(images.region_intensity(_pixels(spark, sf), SIDE), 2, "raw")


@query(SQL["z_project"])
def z_project_frames(spark, sf):
    return rounded(images.z_project_frames(_frames(spark, sf)), 2, "v")


@query(SQL["z_project_max"])
def z_project_max_frames(spark, sf):
    return images.z_project_frames(_frames(spark, sf), method="max", stop=4)


@query(SQL["region_intensity"])
def region_intensity_frames(spark, sf):
    return rounded(images.region_intensity_frames(_frames(spark, sf), SIDE), 2, "raw")


_BOX_SUM = _with(oracle.PIXELS, oracle.BOXES) + f"""SELECT p.datum, b.trace_num, p.frame, {rnd('sum(v) / b.width', 3, 'raw')}
  FROM pixels p JOIN boxes b ON b.datum = p.datum AND p.y BETWEEN b.y0 AND b.y0 + b.width - 1
  AND p.x BETWEEN b.x0 AND b.x0 + b.width - 1 GROUP BY p.datum, b.trace_num, p.frame, b.width"""


@query(_BOX_SUM)
def box_intensity(spark, sf):
    return rounded(images.box_intensity(_pixels(spark, sf), standins.event_boxes(spark, sf)), 3, "raw")


@query(_BOX_SUM)
def box_intensity_shuffled(spark, sf):
    # The way taken by box tables too large to broadcast.
    boxes = standins.event_boxes(spark, sf)
    return rounded(images.box_intensity(_pixels(spark, sf), boxes, max_broadcast_boxes=0), 3, "raw")


@query(_BOX_SUM)
def box_intensity_frames(spark, sf):
    return rounded(images.box_intensity_frames(_frames(spark, sf), standins.event_boxes(spark, sf)), 3, "raw")


@query(_BOX_SUM)
def box_intensity_frames_dealt(spark, sf):
    # The way taken by box tables too large to broadcast.
    measured = images.box_intensity_frames(_frames(spark, sf), standins.event_boxes(spark, sf), max_broadcast_boxes=0)
    return rounded(measured, 3, "raw")


@query(
    _with(_IMAGE, oracle.BOXES)
    + f"""SELECT i.datum, b.trace_num AS box_num, i.x, {rnd('avg(v)', 4, 'mean')}, min(v) AS lo, max(v) AS hi
    FROM img i JOIN boxes b ON b.datum = i.datum AND i.y BETWEEN b.y0 AND b.y0 + b.width - 1
    AND i.x BETWEEN b.x0 AND b.x0 + b.width - 1 GROUP BY i.datum, b.trace_num, i.x"""
)
def column_profile(spark, sf):
    return rounded(images.column_profile(_image(spark, sf), standins.event_boxes(spark, sf)), 4, "mean")


@query(
    _with(oracle.PIXELS, image_sql.background(3))
    + f"SELECT datum, frame, y, x, {rnd('v', 6, 'v')} FROM clean"
)
def subtract_background(spark, sf):
    return rounded(images.unpack_frames(images.subtract_background(_frames(spark, sf), 3)), 6, "v")


@query(_PEAKS + " SELECT datum, box_num, cx, cy, CAST(v AS DOUBLE) AS v FROM peaks")
def find_maxima(spark, sf):
    return images.find_maxima(_image(spark, sf), PROMINENCE)


@query(_PEAKS + " SELECT datum, box_num, cx, cy, CAST(v AS DOUBLE) AS v FROM peaks")
def find_maxima_tiled(spark, sf):
    # Tiles of five pixels: hills and climbs cross many seams.
    return images.find_maxima(_image(spark, sf), PROMINENCE, tile=5)


@query(_PEAKS + ' SELECT datum, box_num, v AS "min", v AS "max", cx AS bx, cy AS by FROM peaks')
def peak_stats(spark, sf):
    return images.peak_stats(_image(spark, sf), images.find_maxima(_image(spark, sf), PROMINENCE))


def _boxes(spark, sf):
    image = _image(spark, sf)
    return images.grow_boxes(image, images.find_maxima(image, PROMINENCE), TOLERANCE, SIDE, SIDE)


@query(_GROWN + " SELECT datum, box_num, cx, cy, x0, y0, width, steps, is_kept FROM grown")
def grow_boxes(spark, sf):
    return _boxes(spark, sf)


@query(_GROWN + " SELECT datum, box_num, CAST(width * width AS INTEGER) AS area, x0 AS bx, y0 AS by, width, width AS height FROM grown")
def particle_stats(spark, sf):
    return images.particle_stats(_boxes(spark, sf))


@query(
    _GROWN
    + """ SELECT datum, box_num, x0, y0, width,
    CAST(row_number() OVER (PARTITION BY datum ORDER BY box_num) AS INTEGER) AS trace_num FROM grown WHERE is_kept"""
)
def renumber_kept(spark, sf):
    return images.renumber_kept(_boxes(spark, sf)).select("datum", "box_num", "x0", "y0", "width", "trace_num")


@query(image_sql.grid(GRID))
def segmentation_grid(spark, sf):
    return segmentation.segmentation_grid(_frames(spark, sf), GRID, SIDE, SIDE)


_EXTRACT = "WITH RECURSIVE " + ",".join(
    [oracle.PIXELS, image_sql.background(3), image_sql.image("clean"), image_sql.peaks(PROMINENCE), image_sql.grown(TOLERANCE)]
) + """, kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY datum ORDER BY box_num) AS INTEGER) AS trace_num
  FROM grown WHERE is_kept) """


@query(
    _EXTRACT
    + f"""SELECT p.datum, k.trace_num, p.frame, {rnd('sum(v) / k.width', 5, 'raw')} FROM clean p JOIN kept k
    ON k.datum = p.datum AND p.y BETWEEN k.y0 AND k.y0 + k.width - 1 AND p.x BETWEEN k.x0 AND k.x0 + k.width - 1
    GROUP BY p.datum, k.trace_num, p.frame, k.width"""
)
def extract_traces(spark, sf):
    settings = standins.event_types(spark, sf).select(
        "datum", F.lit(3).alias("rolling_radius"), F.lit(PROMINENCE).alias("peak_prominence"),
        F.lit(TOLERANCE).alias("profile_tolerance"),
    )
    return rounded(segmentation.extract_traces(_frames(spark, sf), settings, "per_frame", SIDE, SIDE), 5, "raw")


# --- files and names ------------------------------------------------------


def _names(spark, sf):
    nations = standins.table(spark, sf, "nation")
    files = nations.select(F.concat("n_name", F.lit("_IntensityTraces.txt")).alias("filename"))
    return files, nations.select((F.col("n_nationkey") + 1).alias("datum"), F.col("n_name").alias("label"))


@query("SELECT n_name || '_IntensityTraces.txt' AS filename, n_nationkey + 1 AS datum, n_name AS label FROM nation")
def label_match_exact(spark, sf):
    return labels.match_labels(*_names(spark, sf))


@query(
    """SELECT f.n_name || '_IntensityTraces.txt' AS filename, min(m.n_nationkey) + 1 AS datum,
    arg_min(m.n_name, m.n_nationkey) AS label
    FROM nation f JOIN nation m ON contains(f.n_name || '_IntensityTraces.txt', m.n_name) GROUP BY f.n_name"""
)
def label_match_contains(spark, sf):
    return labels.match_labels(*_names(spark, sf), "contains")


@query("SELECT n_name || '_IntensityTraces.txt' AS filename, 'FusionOutput/' || n_name || '_IntensityTraces_FusionOutput.txt' AS output FROM nation")
def output_names(spark, sf):
    return tables.output_names(_names(spark, sf)[0], "status")


@query(
    """SELECT CAST(s_suppkey + 1 AS INTEGER) AS datum, s_name AS label FROM supplier
    WHERE s_suppkey NOT IN (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 49.5 AND l_tax > 0.075)"""
)
def pending_datums(spark, sf):
    manifest = standins.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") + 1).cast("int").alias("datum"), F.col("s_name").alias("label")
    )
    done = standins.table(spark, sf, "lineitem").filter("l_quantity >= 49.5 AND l_tax > 0.075").select(
        (F.col("l_suppkey") + 1).cast("int").alias("datum")
    )
    return tables.pending_datums(manifest, done)


@query(
    """SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INTEGER) AS datum, n_name AS label,
    CAST(n_nationkey * 10 AS INTEGER) AS start_frame, CAST(n_regionkey + 0.5 AS DOUBLE) AS time_interval_s, 3 AS rolling_radius,
    CAST(1000 AS DOUBLE) AS peak_prominence, CAST(0.1 AS DOUBLE) AS profile_tolerance,
    '/videos/' || n_name || '.tif' AS filepath, regexp_matches(n_name, '^[A-Za-z0-9-]+$') AS is_label_valid FROM nation"""
)
def manifest_roundtrip(spark, sf):
    nations = standins.table(spark, sf, "nation")
    made = manifest_io.manifest_with_defaults(
        nations.select(
            (F.col("n_nationkey") + 1).alias("datum"), F.col("n_name").alias("label"),
            F.concat(F.lit("/videos/"), "n_name", F.lit(".tif")).alias("filepath"),
        ),
        overrides=nations.select(
            F.col("n_name").alias("label"), (F.col("n_nationkey") * 10).alias("start_frame"),
            (F.col("n_regionkey") + 0.5).alias("time_interval_s"),
        ),
    )
    path = scratch_path(spark, "manifest")
    manifest_io.write_manifest(made, path)
    return manifest_io.manifest_with_defaults(manifest_io.read_manifest(spark, path))


@query(_with(oracle.LINE) + "SELECT datum, trace_num, frame, raw FROM li")
def trace_text_roundtrip(spark, sf):
    path, manifest = scratch_path(spark, "traces"), standins.line_manifest(spark, sf)
    text.write_traces(standins.line_traces(spark, sf), path, manifest)
    return text.read_traces(spark, path, manifest)


@query(_with(oracle.ACTIONS, _RELOAD) + f"SELECT {_STATUS} FROM reloaded WHERE trace_num <> 0")
def status_roundtrip(spark, sf):
    path, manifest = scratch_path(spark, "status"), standins.event_manifest(spark, sf)
    text.write_status(_folded(spark, sf), path, manifest)
    return text.read_status(spark, path, manifest)


@query(
    _with(oracle.SEARCH_FULL)
    + "SELECT datum, trace_num, coalesce(array_to_string(cps, ','), '') AS changepoints FROM lists"
)
def changepoints_roundtrip(spark, sf):
    path, manifest = scratch_path(spark, "changepoints"), standins.line_manifest(spark, sf)
    lists = cp.collect_changepoints(_found(spark, sf), standins.trace_list(standins.walk_traces(spark, sf)))
    text.write_changepoints(lists, path, manifest)
    read = text.read_changepoints(spark, path, manifest)
    return read.withColumn("changepoints", F.concat_ws(",", F.col("changepoints").cast("array<string>")))


@query(_with(oracle.ORDER_STATUS) + "SELECT datum, dwell_s FROM dwell")
def dwell_roundtrip(spark, sf):
    path, manifest = scratch_path(spark, "dwell"), standins.order_manifest(spark, sf)
    text.write_dwell_times(_dwell(spark, sf), path, manifest)
    return text.read_dwell_times(spark, path, manifest)


@query(_with(oracle.SEARCH_FULL) + f"SELECT {_STATUS} FROM auto_status")
def detections_roundtrip(spark, sf):
    path, status = scratch_path(spark, "detections"), _auto(spark, sf)
    text.write_detections(status, path)
    text.write_detections(status, path)  # a second run replaces, it does not append
    return text.read_detections(spark, path).select(*events.STATUS_COLUMNS)


@query(
    _with(oracle.EMB)
    + """SELECT datum, trace_num, '1:' || string_agg(CAST(CAST(round(raw * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY frame) AS value
    FROM emb GROUP BY datum, trace_num"""
)
def training_lines(spark, sf):
    samples = standins.embedding_traces(spark, sf).withColumn("raw", F.round(F.col("raw") * 1000).cast("long"))
    status = samples.select(*TRACE_KEYS).distinct().select(
        *TRACE_KEYS, F.lit(True).alias("is_reviewed"), F.lit(True).alias("is_fusion"), F.lit(False).alias("is_excluded")
    )
    return text.training_lines(samples, status)


@query(_GROWN + " SELECT datum, box_num, CAST(width * width AS INTEGER) AS area, x0 AS bx, y0 AS by FROM grown")
def measurements_roundtrip(spark, sf):
    path = scratch_path(spark, "particles")
    tables.write_measurements(images.particle_stats(_boxes(spark, sf)), path)
    read = spark.read.option("header", True).schema(
        "box_num int, area int, bx int, by int, width int, height int, datum int"
    ).csv(path)
    return read.select("datum", "box_num", "area", "bx", "by")


@query(_PEAKS + ' SELECT datum, box_num, v AS "min", v AS "max", cx AS bx, cy AS "by" FROM peaks')
def peaks_roundtrip(spark, sf):
    path = scratch_path(spark, "peaks")
    peaks = images.find_maxima(_image(spark, sf), PROMINENCE)
    tables.write_measurements(images.peak_stats(_image(spark, sf), peaks), path)
    read = spark.read.option("header", True).schema("box_num int, min int, max int, bx int, by int, datum int").csv(path)
    return read.select("datum", "box_num", "min", "max", "bx", "by")


@query(_GROWN + " SELECT datum, box_num, cx, cy, x0, y0, width, steps, is_kept FROM grown WHERE is_kept")
def boxes_roundtrip(spark, sf):
    path = scratch_path(spark, "boxes")
    tables.write_table(_boxes(spark, sf), path)
    kept = tables.read_boxes(spark, path, kept_only=True)
    return kept.select("datum", "box_num", "cx", "cy", "x0", "y0", "width", "steps", "is_kept")


# --- whole runs -----------------------------------------------------------

_AUTO_DWELL = """autodwell AS (SELECT datum, CAST((fusion_start - CASE WHEN start_frame = 0 THEN binding ELSE start_frame END)
  * time_interval_s AS DOUBLE) AS dwell_s FROM auto_status WHERE is_fusion)"""


def _summary_sql(src: str) -> str:
    return f"""SELECT s.datum, s.n, {rnd('shape', 4, 'shape')}, {rnd('loc', 3, 'loc')}, {rnd('scale', 3, 'scale')},
    {rnd('n_min', 6, 'n_min')} FROM (SELECT datum, count(*) AS n, avg(dwell_s) * avg(dwell_s)
    / nullif(var_pop(dwell_s), 0) AS n_min FROM {src} GROUP BY datum) s LEFT JOIN fit f ON f.datum = s.datum"""


@query(_with(oracle.SEARCH_FULL, _AUTO_DWELL, fit_sql.gamma_fit("autodwell")) + _summary_sql("autodwell"))
def automatic_statistics(spark, sf):
    manifest = standins.line_manifest(spark, sf)
    summary = stats.fit_summary(events.dwell_times(_auto(spark, sf), manifest), manifest)
    return rounded(rounded(rounded(summary, 4, "shape"), 3, "loc", "scale"), 6, "n_min").drop("label", "r2")


@query(
    _with(oracle.ACTIONS, _DWELL_MANUAL, fit_sql.gamma_fit("dwell")) + _summary_sql("dwell")
)
def manual_statistics(spark, sf):
    summary = analysis.manual_statistics(standins.event_actions(spark, sf), standins.event_manifest(spark, sf))
    return rounded(rounded(rounded(summary, 4, "shape"), 3, "loc", "scale"), 6, "n_min").drop("label", "r2")


@query(_with(oracle.SEARCH_FULL) + f"SELECT {_STATUS} FROM auto_status")
def automatic_run(spark, sf):
    # Two runs into one folder: the second does what the first had no manifest row for.
    root, manifest = scratch_path(spark, "run"), standins.line_manifest(spark, sf)
    samples = standins.walk_traces(spark, sf)
    regions = standins.walk_regions(spark, sf)
    for known in (manifest.where("datum < 2"), manifest):
        runs.run_automatic(spark, root, samples, None, known, SIDE, regions=regions)
    return runs.read_results(spark, root, "detections")


# --- streams --------------------------------------------------------------


def _run_stream(spark: SparkSession, stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream over what is there and return its final table."""
    base = scratch_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")

    running = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    running.awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    value = F.struct(*[c for c in stream.columns if c not in keys])
    last = rows.groupBy(*keys).agg(F.max_by(value, "batch").alias("v"))
    return last.select(*keys, "v.*")


@query(_with(oracle.ACTIONS) + f"SELECT {_STATUS} FROM status")
def stream_fold_actions(spark, sf):
    schema = standins.table(spark, sf, "events").schema
    arriving = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet")
    actions = standins.actions_of(arriving)
    stream = streams.fold_actions_stream(actions, standins.event_manifest(spark, sf))
    return _run_stream(spark, stream, "update", list(TRACE_KEYS))


@query(
    _with(oracle.PIXELS)
    + f"""SELECT datum, CAST(1 + y // 8 + 2 * (x // 8) AS INTEGER) AS region, frame, {rnd('sum(v)', 2, 'raw')}
    FROM pixels GROUP BY ALL"""
)
def stream_region_intensity(spark, sf):
    stored = _pixels(spark, sf)
    manifest = standins.event_types(spark, sf).select("datum", F.lit(1.0).alias("time_interval_s"))
    arriving = spark.readStream.schema(stored.schema).parquet(standins.folder(spark, sf, "event_pixels"))
    stream = streams.region_intensity_stream(arriving, manifest, SIDE).drop("acquired_at")
    return rounded(_run_stream(spark, stream, "update", ["datum", "region", "frame"]), 2, "raw")


@query(_BOX_SUM)
def stream_box_intensity(spark, sf):
    stored = _pixels(spark, sf)
    manifest = standins.event_types(spark, sf).select("datum", F.lit(1.0).alias("time_interval_s"))
    arriving = spark.readStream.schema(stored.schema).parquet(standins.folder(spark, sf, "event_pixels"))
    stream = streams.box_intensity_stream(arriving, standins.event_boxes(spark, sf), manifest).drop("acquired_at")
    return rounded(_run_stream(spark, stream, "update", ["datum", "trace_num", "frame"]), 3, "raw")


@query(_with(oracle.PIXELS) + f"SELECT datum, frame, y, x, {rnd('v', 2, 'v')} FROM pixels")
def stream_complete_frames(spark, sf):
    stored = _pixels(spark, sf)
    streams.use_list_store(spark)
    arriving = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 4).parquet(
        standins.folder(spark, sf, "event_pixels"))
    base = scratch_path(spark, "stream")
    running = (
        streams.complete_frames(arriving, SIDE, SIDE).writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{base}/state").option("path", f"{base}/out").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return rounded(images.unpack_frames(streams.completed(spark.read.parquet(f"{base}/out"))), 2, "v")
