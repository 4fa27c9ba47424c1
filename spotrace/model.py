"""Table contracts and fixed values shared by every operator.

All tables are long: one row per sample, pixel, box, label or action.  Time is
a 1-based frame index; seconds appear only after multiplying by the recording's
frame interval.
"""

from __future__ import annotations

from pyspark.sql import types as T

# File formats, default parameters and search settings that have
# to agree with existing recordings.
DEFAULT_START_FRAME = 0
DEFAULT_INTERVAL_S = 1.0
DEFAULT_ROLLING_RADIUS = 3
DEFAULT_PEAK_PROMINENCE = 1000.0
DEFAULT_PROFILE_TOLERANCE = 0.1
FRAME_SIDE = 1024
SEARCH_WIDTH = 50
SEARCH_PENALTY = 5.0
SEARCH_MIN_SIZE = 2
SEASON_PERIOD = 10
PANEL_ROWS = 3
PANEL_COLS = 4
MANIFEST_HEADER = (
    "Label",
    "StartFrame",
    "TimeInterval[s]",
    "RollingRadius",
    "PeakProminence",
    "ProfileTolerance",
    "Filepath",
)
STATUS_HEADER_BINDING = (
    "TraceNum,isReviewed,isFusion,BindingFrame,FusionStartFrame,FusionEndFrame,isExcluded"
)
STATUS_HEADER_FLOW = "TraceNum,isReviewed,isFusion,FusionStartFrame,FusionEndFrame,isExcluded"
OUTPUT_KINDS = {
    "traces": ("ExtractedTraces", "_IntensityTraces"),
    "status": ("FusionOutput", "_FusionOutput"),
    "drawings": ("TraceDrawings", "_Collated"),
    "changepoints": ("ChangepointSearch", "_Changepoints"),
    "dwell_times": ("DwellTimes", "_Times"),
    "detections": ("Detections", "_DetectedChangepoints"),
    "segmentation": ("Segmentation", ""),
}

TRACE_KEYS = ("datum", "trace_num")
REGION_KEYS = ("datum", "region")


def _struct(ddl: str) -> T.StructType:
    fields = []
    kinds = {"INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "STRING": T.StringType(),
             "BOOLEAN": T.BooleanType(), "LONG": T.LongType(),
             "DOUBLES": T.ArrayType(T.DoubleType()), "FLOATS": T.ArrayType(T.FloatType())}
    for item in ddl.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, kinds[kind]))
    return T.StructType(fields)


MANIFEST = _struct(
    "datum INT, label STRING, start_frame INT, time_interval_s DOUBLE, rolling_radius INT, "
    "peak_prominence DOUBLE, profile_tolerance DOUBLE, filepath STRING"
)
PIXELS = _struct("datum INT, frame INT, y INT, x INT, v DOUBLE")
FRAMES = _struct("datum INT, frame INT, height INT, width INT, pixels DOUBLES")
SAMPLES = _struct("datum INT, trace_num INT, frame INT, raw DOUBLE")
BOXES = _struct("datum INT, box_num INT, trace_num INT, x0 INT, y0 INT, width INT, steps INT, is_kept BOOLEAN")
CHANGEPOINTS = _struct("datum INT, trace_num INT, frame INT")
STATUS = _struct(
    "datum INT, trace_num INT, is_reviewed BOOLEAN, is_fusion BOOLEAN, binding INT, "
    "fusion_start INT, fusion_end INT, is_excluded BOOLEAN"
)
ACTIONS = _struct("datum INT, trace_num INT, seq LONG, action STRING, t1 DOUBLE, t2 DOUBLE, t3 DOUBLE")
DWELL = _struct("datum INT, dwell_s DOUBLE")
