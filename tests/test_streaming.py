import datetime

import pytest

from spotrace.operators import events, images
from spotrace.streaming import streams

PIXEL_SCHEMA = "datum int, frame int, y int, x int, v double"


@pytest.fixture
def arriving(spark, tmp_path):
    """Write rows as one small file per batch and read them back as a stream."""

    def build(batches, schema):
        folder = str(tmp_path / "in")
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        kind = spark.createDataFrame([], schema).schema
        return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)

    return build


def run(stream, mode, tmp_path):
    seen = []
    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state"))
        .foreachBatch(lambda df, n: seen.append(df.collect())).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return seen


def test_actions_arrive_in_parts(arriving, make, tmp_path):
    schema = "datum int, trace_num int, seq long, action string, t1 double, t2 double, t3 double"
    batches = [
        [(0, 1, 1, "f", 3.0, 5.0, 6.0), (0, 2, 2, "x", None, None, None)],
        [(0, 1, 4, "u", None, None, None), (0, 2, 3, "n", None, None, None)],
        [(0, 2, 9, "f", 1.0, 2.0, 3.0)],
    ]
    manifest = make([(0, 0, 1.0)], "datum int, start_frame int, time_interval_s double")
    seen = run(streams.fold_actions_stream(arriving(batches, schema), manifest), "update", tmp_path)
    last = {r["trace_num"]: tuple(r) for part in seen for r in part}
    whole = events.fold_actions(make([r for b in batches for r in b], schema), manifest)
    assert last == {r["trace_num"]: tuple(r) for r in whole.collect()}


def test_frames_are_emitted_once_complete(arriving, make, tmp_path):
    batches = [[(0, f, y, x, float(f * 10 + y + x)) for y in range(4) for x in range(4)] for f in range(1, 5)]
    start = datetime.datetime(2024, 5, 1, 12)
    manifest = make([(0, 20.0, start)], "datum int, time_interval_s double, started_at timestamp")
    stream = streams.region_intensity_stream(arriving(batches, PIXEL_SCHEMA), manifest, 4, "10 seconds")
    seen = run(stream.drop("acquired_at"), "append", tmp_path)
    got = [tuple(r) for part in seen for r in part]
    whole = images.region_intensity(make([r for b in batches for r in b], PIXEL_SCHEMA), 4)
    want = {tuple(r) for r in whole.collect()}
    assert len(got) == len(set(got)) and set(got) <= want
    assert {r[2] for r in got} >= {1, 2, 3}


def test_boxes_on_a_stream(arriving, make, tmp_path):
    batches = [[(0, f, y, x, float(f + y * x)) for y in range(6) for x in range(6)] for f in (1, 2)]
    boxes = make([(0, 1, 1, 2, 3)], "datum int, trace_num int, x0 int, y0 int, width int")
    manifest = make([(0, 1.0)], "datum int, time_interval_s double")
    stream = streams.box_intensity_stream(arriving(batches, PIXEL_SCHEMA), boxes, manifest)
    seen = run(stream.drop("acquired_at"), "update", tmp_path)
    got = {tuple(r) for part in seen for r in part}
    whole = images.box_intensity(make([r for b in batches for r in b], PIXEL_SCHEMA), boxes)
    assert got == {tuple(r) for r in whole.collect()}


def later_recording():
    """Recording 0 runs on to frame 40 before recording 1 starts at frame 1."""
    order = [(0, 1), (0, 2), (0, 40), (1, 1), (1, 2), (1, 3)]
    return [[(d, f, y, x, float(d * 100 + f + y * x)) for y in range(4) for x in range(4)] for d, f in order]


def test_a_later_recording_loses_no_frame(arriving, make, tmp_path):
    batches = later_recording()
    stream = streams.region_intensity_stream(arriving(batches, PIXEL_SCHEMA), None, 4)
    seen = run(stream, "update", tmp_path)
    got = {tuple(r) for part in seen for r in part}
    whole = images.region_intensity(make([r for b in batches for r in b], PIXEL_SCHEMA), 4)
    assert got == {tuple(r) for r in whole.collect()}


def test_a_later_recording_with_start_times(arriving, make, tmp_path):
    batches = later_recording() + [[(1, 99, 0, 0, 0.0)]]
    day = datetime.datetime(2024, 5, 1)
    manifest = make([(0, 1.0, day), (1, 1.0, day + datetime.timedelta(minutes=1))],
                    "datum int, time_interval_s double, started_at timestamp")
    boxes = make([(d, 1, 1, 1, 2) for d in (0, 1)], "datum int, trace_num int, x0 int, y0 int, width int")
    pixels = arriving(batches, PIXEL_SCHEMA)
    seen = run(streams.region_intensity_stream(pixels, manifest, 4).drop("acquired_at"), "append", tmp_path)
    got = [tuple(r) for part in seen for r in part]
    rows = make([r for b in batches[:-1] for r in b], PIXEL_SCHEMA)
    assert len(got) == len(set(got)) and set(got) == {tuple(r) for r in images.region_intensity(rows, 4).collect()}
    (tmp_path / "boxes").mkdir()
    seen = run(streams.box_intensity_stream(pixels, boxes, manifest).drop("acquired_at"), "update", tmp_path / "boxes")
    assert {tuple(r) for part in seen for r in part} == {tuple(r) for r in images.box_intensity(rows, boxes).collect()}


def test_complete_frames_in_any_order(spark, arriving, make, tmp_path):
    import random

    rng = random.Random(7)
    cells = [(d, f, y, x, float(d * 1000 + f * 100 + y * 10 + x)) for d in (0, 1) for f in (1, 2, 3) for y in range(4) for x in range(5)]
    early = [c for c in cells if c[0] == 1]  # a recording that is filled in before the other, backwards
    rng.shuffle(early)
    late = sorted((c for c in cells if c[0] == 0), reverse=True)
    batches = [early[:25], early[25:] + late[:7], late[7:], [(1, 2, 0, 0, -1.0), (0, 9, 1, 1, 5.0), (0, 9, 1, 1, 6.0), (0, 9, 4, 0, 7.0), (0, 9, -1, 0, 8.0)]]
    streams.use_list_store(spark)
    seen = run(streams.complete_frames(arriving(batches, PIXEL_SCHEMA), 4, 5), "append", tmp_path)
    rows = make([r for part in seen for r in part], streams.COMPLETED)
    got = {(r["datum"], r["frame"]): r["pixels"] for r in streams.completed(rows).collect()}
    want = {(r["datum"], r["frame"]): r["pixels"] for r in images.pack_frames(make(cells, PIXEL_SCHEMA), 4, 5).collect()}
    assert got == want and streams.completed(rows).count() == len(want)
    beside = sorted(tuple(r) for r in streams.beside_table(rows).collect())
    assert beside == [
        (0, 9, -1, 0, 8.0, "outside"), (0, 9, 1, 1, 6.0, "repeated"), (0, 9, 4, 0, 7.0, "outside"), (1, 2, 0, 0, -1.0, "late"),
    ]


def test_frame_state_survives_a_restart(spark, arriving, make, tmp_path):
    """A query that is started anew goes on with the pixels it had."""
    cells = [(0, 1, y, x, float(y * 5 + x)) for y in range(4) for x in range(5)]
    streams.use_list_store(spark)
    pixels = arriving([cells[:9]], PIXEL_SCHEMA)
    assert sum(len(part) for part in run(streams.complete_frames(pixels, 4, 5), "append", tmp_path)) == 0
    spark.createDataFrame(cells[9:], PIXEL_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = [r for part in run(streams.complete_frames(pixels, 4, 5), "append", tmp_path) for r in part]
    assert [list(r["pixels"]) for r in seen] == [[float(k) for k in range(20)]]
