import pathlib

import pytest
from pyspark.errors import AnalysisException

from spotrace.operators import labels
from spotrace.sources import manifest as manifest_io
from spotrace.sources import tables
from spotrace.sources import text_tables as text

KINDS = [(1, "Datum-1", 0), (2, "Datum-10", 7)]
KIND_SCHEMA = "datum int, label string, start_frame int"


@pytest.fixture
def manifest(make):
    return make(KINDS, KIND_SCHEMA)


def put(folder, name, content):
    path = pathlib.Path(folder) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(
    "content, want",
    [
        ("Label,Filepath\nA,/v/a.tif\nB,/v/b.tif\n",
         [(1, "A", None, None, None, None, None, "/v/a.tif"), (2, "B", None, None, None, None, None, "/v/b.tif")]),
        ("Label,StartFrame,TimeInterval[s],Filepath\nA,5,0.25,/v/a.tif\n",
         [(1, "A", 5, 0.25, None, None, None, "/v/a.tif")]),
        ("Label,StartFrame,TimeInterval[s],RollingRadius,PeakProminence,ProfileTolerance,Filepath\n"
         "A,5,0.250,4,900,0.15,/v/a.tif\n\n", [(1, "A", 5, 0.25, 4, 900.0, 0.15, "/v/a.tif")]),
    ],
)
def test_manifest_forms(spark, tmp_path, content, want):
    assert rows(manifest_io.read_manifest(spark, put(tmp_path, "info.txt", content))) == want


def test_missing_manifest_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        manifest_io.read_manifest(spark, str(tmp_path / "none.txt"))


def test_manifest_defaults_and_overrides(spark, tmp_path, make):
    path = put(tmp_path, "info.txt", "Label,Filepath\nA-1,/v/a.tif\nB_2,/v/b.tif\n")
    read = manifest_io.read_manifest(spark, path)
    filled = manifest_io.manifest_with_defaults(read, make([("B_2", 12, 0.05)], "label string, start_frame int, profile_tolerance double"))
    assert rows(filled) == [
        (1, "A-1", 0, 1.0, 3, 1000.0, 0.1, "/v/a.tif", True),
        (2, "B_2", 12, 1.0, 3, 1000.0, 0.05, "/v/b.tif", False),
    ]
    out = str(tmp_path / "out")
    manifest_io.write_manifest(filled, out)
    assert rows(manifest_io.read_manifest(spark, out)) == [r[:-1] for r in rows(filled)]
    with pytest.raises(ValueError):
        manifest_io.manifest_with_defaults(read, nothing=1)


def test_trace_records(spark, tmp_path, manifest):
    put(tmp_path, "Datum-1_IntensityTraces.txt", "@1\n1.5,2,\n@2\n3.0,4e1,5\n")
    put(tmp_path, "Datum-10_IntensityTraces.txt", "@7\n8,\n,9\n")
    got = rows(text.read_traces(spark, str(tmp_path), manifest))
    assert got == [(1, 1, 1, 1.5), (1, 1, 2, 2.0), (1, 2, 1, 3.0), (1, 2, 2, 40.0), (1, 2, 3, 5.0), (2, 7, 1, 8.0), (2, 7, 2, 9.0)]


def test_trace_files_round_trip_over_several_lines(spark, tmp_path, manifest, samples_of, monkeypatch):
    monkeypatch.setattr(text, "LINE_BITS", 2)
    samples = samples_of({(1, 1): [0.1 * k for k in range(11)], (1, 2): [1e-9, 2.5e12], (2, 3): [7]})
    out = str(tmp_path / "traces")
    text.write_traces(samples, out, manifest)
    assert rows(text.read_traces(spark, out, manifest)) == rows(samples)
    files = list((tmp_path / "traces" / "label=Datum-1").glob("part-*"))
    assert "".join(sorted(f.read_text() for f in files)).startswith("@1\n0.0,")


def test_label_files(spark, tmp_path, manifest):
    put(tmp_path, "Datum-1_FusionOutput.txt", text.STATUS_HEADER_BINDING + "\n1,1,1,5,9,11,0\n2,1,1,5,9,11,1\n3,0,0,0,0,0,0\n")
    put(tmp_path, "Datum-10_FusionOutput.txt", text.STATUS_HEADER_FLOW + "\n4,1,1,20,22,0\n")
    read = text.read_status(spark, str(tmp_path), manifest)
    want = [
        (1, 1, True, True, 5, 9, 11, False), (1, 2, True, False, 0, 0, 0, True),
        (1, 3, False, False, 0, 0, 0, False), (2, 4, True, True, 0, 20, 22, False),
    ]
    assert rows(read) == want
    out = tmp_path / "out"
    text.write_status(read, str(out), manifest)
    assert rows(text.read_status(spark, str(out), manifest)) == want
    first = "".join(f.read_text() for f in sorted((out / "label=Datum-10").glob("part-*")))
    assert first == text.STATUS_HEADER_FLOW + "\n4,1,1,20,22,0\n"


def test_header_only_label_files(spark, tmp_path, manifest):
    out = str(tmp_path / "status")
    text.init_status(out, manifest)
    text.init_status(out, manifest)
    assert text.read_status(spark, out, manifest).count() == 0


def test_changepoint_lines(spark, tmp_path, manifest, make):
    put(tmp_path, "Datum-1_Changepoints.txt", "1,30,80\n2\nx,5\n3,4,oops\n")
    got = {r["trace_num"]: r["changepoints"] for r in text.read_changepoints(spark, str(tmp_path), manifest).collect()}
    assert got == {1: [30, 80], 2: []}
    lists = make([(1, 1, [80, 30]), (1, 2, [])], "datum int, trace_num int, changepoints array<int>")
    assert rows(text.format_changepoints(lists)) == [(1, 1, "1,30,80"), (1, 2, "2")]


def test_dwell_lines(spark, tmp_path, manifest, make):
    put(tmp_path, "Datum-1_Times.txt", "1.0,2.5,4")
    put(tmp_path, "Datum-10_Times.txt", "1.0,bad")
    assert rows(text.read_dwell_times(spark, str(tmp_path), manifest)) == [(1, 1.0), (1, 2.5), (1, 4.0)]
    dwell = make([(1, 3.0), (1, 1.5), (2, 2.0), (1, 3.0)], "datum int, dwell_s double")
    assert rows(text.format_dwell_times(dwell).select("datum", "value")) == [(1, "1.5,3.0,3.0"), (2, "2.0")]
    out = str(tmp_path / "out")
    text.write_dwell_times(dwell, out, manifest)
    assert rows(text.read_dwell_times(spark, out, manifest)) == rows(dwell)


def test_detections_replace_only_their_recordings(spark, tmp_path, make):
    schema = "datum int, trace_num int, is_fusion boolean"
    out = str(tmp_path / "detections")
    text.write_detections(make([(1, 1, True), (2, 1, True)], schema), out)
    text.write_detections(make([(1, 5, False)], schema), out)
    got = text.read_detections(spark, out).select("datum", "trace_num")
    assert rows(got) == [(1, 5), (2, 1)]


def test_training_lines(make, samples_of):
    status = make([(1, 1, True, True, False)], "datum int, trace_num int, is_reviewed boolean, is_fusion boolean, is_excluded boolean")
    lines = text.training_lines(samples_of({(1, 1): [1, 2.5], (1, 2): [3]}), status)
    assert [r["value"] for r in lines.collect()] == ["1:1.0,2.5"]


def test_label_matching(make, manifest):
    files = make([("Datum-10_IntensityTraces.txt",), ("Datum-1_IntensityTraces.txt",), ("other.txt",)], "filename string")
    exact = labels.match_labels(files, manifest)
    assert {r["filename"]: r["datum"] for r in exact.collect()} == {"Datum-10_IntensityTraces.txt": 2, "Datum-1_IntensityTraces.txt": 1}
    loose = labels.match_labels(files, manifest, "contains")
    assert {r["datum"] for r in loose.collect()} == {1}
    assert [r["filename"] for r in labels.unmatched_files(files, exact).collect()] == ["other.txt"]


def test_output_places(spark, tmp_path, make):
    assert tables.output_path("/a/", "status", "/x/Datum-1_IntensityTraces.txt") == "/a/FusionOutput/Datum-1_IntensityTraces_FusionOutput.txt"
    assert tables.output_path("/a", "drawings", "b.txt") == "/a/TraceDrawings/b_Collated.tif"
    done = make([(1, 1), (1, 2)], "datum int, trace_num int")
    todo = tables.pending_datums(make(KINDS, KIND_SCHEMA), done)
    assert [r["datum"] for r in todo.collect()] == [2]
    path = str(tmp_path / "t")
    tables.init_table(spark, path, done.schema)
    tables.init_table(spark, path, done.schema)
    assert spark.read.parquet(path).count() == 0


def test_video_decoder_hook(spark, tmp_path, make):
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "a.raw").write_bytes(bytes([1, 2, 3, 4, 5, 6, 7, 8]))

    def decode(content):
        for k in range(0, len(content), 4):
            yield 2, 2, [float(v) for v in content[k:k + 4]]

    manifest = make([(3, "/elsewhere/a.raw")], "datum int, filepath string")
    got = tables.read_video_files(spark, str(tmp_path / "v"), decode, manifest).orderBy("frame").collect()
    assert [(r["datum"], r["frame"], r["pixels"]) for r in got] == [(3, 1, [1, 2, 3, 4]), (3, 2, [5, 6, 7, 8])]
    out = str(tmp_path / "frames")
    tables.write_table(spark.createDataFrame(got), out)
    assert tables.read_frames(spark, out).count() == 2


class RawVideo:
    """A made-up format: frame count, height and width as 32-bit numbers, then 16-bit pixels."""

    def count(self, file):
        return int.from_bytes(file.read(4), "little")

    def read(self, file, start, stop):
        import numpy as np

        n, height, width = np.frombuffer(file.read(12), "<i4").tolist()
        file.seek(12 + 2 * height * width * start)
        for _ in range(start, stop):
            yield height, width, np.frombuffer(file.read(2 * height * width), "<u2").astype(float).tolist()


def raw_video(path, video):
    import numpy as np

    path.write_bytes(np.array(video.shape, "<i4").tobytes() + video.astype("<u2").tobytes())


def test_videos_split_into_ranges_of_frames(spark, tmp_path, make):
    import numpy as np

    from spotrace.sources import video as source

    folder = tmp_path / "videos"
    folder.mkdir()
    rng = np.random.default_rng(1)
    videos = {3: rng.integers(0, 60_000, (23, 4, 5)), 8: rng.integers(0, 60_000, (2, 3, 3)), 9: np.zeros((0, 2, 2))}
    for datum, video in videos.items():
        raw_video(folder / f"v{datum}.raw", video)
    (folder / "_notes").write_text("")
    manifest = make([(d, f"/elsewhere/v{d}.raw") for d in videos], "datum int, filepath string")
    df = source.read_videos(spark, str(folder), RawVideo(), manifest, frames_per_task=5)
    assert df.rdd.getNumPartitions() == 6
    got = {(r["datum"], r["frame"]): (r["height"], r["width"], r["pixels"]) for r in df.collect()}
    want = {(d, f): (*image.shape, image.ravel().astype(float).tolist()) for d, v in videos.items() for f, image in enumerate(v, 1)}
    assert got == want
    with pytest.raises(ValueError, match="v8.raw"):
        source.read_videos(spark, str(folder), RawVideo(), manifest.where("datum <> 8"))
    (tmp_path / "none").mkdir()
    assert source.read_videos(spark, str(tmp_path / "none"), RawVideo(), manifest).count() == 0


def test_a_range_reads_its_own_bytes_only(tmp_path):
    import numpy as np

    from spotrace.sources import video as source

    path = tmp_path / "long.raw"
    raw_video(path, np.arange(1000 * 16 * 16).reshape(1000, 16, 16) % 60_000)

    class Counting:
        def __init__(self, file):
            self.file, self.total = file, 0

        def read(self, n):
            self.total += n
            return self.file.read(n)

        def seek(self, at):
            self.file.seek(at)

    ranges = source.frame_ranges(str(path), 1, 1000, 64)
    assert [(r.start, r.stop) for r in ranges][-1] == (960, 1000) and len(ranges) == 16
    with open(path, "rb") as file:
        counting = Counting(file)
        assert len(list(RawVideo().read(counting, 960, 1000))) == 40 and counting.total == 12 + 40 * 512


def test_reference_names_and_labels_anywhere(spark, tmp_path, make):
    """Files named by label and kind, read exactly and by a label anywhere in the name."""
    manifest = make([(0, "Run_1", 0), (1, "Run_2", 30)], "datum int, label string, start_frame int")
    for folder, tag, texts in (
        ("s", "FusionOutput", ["TraceNum,isReviewed\n1,1,1,5,20,22,0\n2,0,0,0,0,0,1\n", "TraceNum\n4,1,1,40,44,0\n"]),
        ("c", "Changepoints", ["1,10,20\n2\n", "4,33\n"]), ("t", "Times", ["1.5,2.5\n", "3.0\n"]),
    ):
        (tmp_path / folder).mkdir()
        for k, body in enumerate(texts, 1):
            (tmp_path / folder / f"Run_{k}_IntensityTraces_{tag}.txt").write_text(body)
    for match in ("exact", "contains"):
        status = sorted(tuple(r) for r in text.read_status(spark, str(tmp_path / "s"), manifest, match).collect())
        assert status == [(0, 1, True, True, 5, 20, 22, False), (0, 2, False, False, 0, 0, 0, True), (1, 4, True, True, 0, 40, 44, False)]
        lists = sorted(tuple(r) for r in text.read_changepoints(spark, str(tmp_path / "c"), manifest, match).collect())
        assert lists == [(0, 1, [10, 20]), (0, 2, []), (1, 4, [33])]
        assert sorted(tuple(r) for r in text.read_dwell_times(spark, str(tmp_path / "t"), manifest, match).collect()) == [(0, 1.5), (0, 2.5), (1, 3.0)]
    (tmp_path / "s" / "Other_IntensityTraces_FusionOutput.txt").write_text("TraceNum\n1,0,0,0,0,0,0\n")
    with pytest.raises(Exception, match="no recording for file"):
        text.read_status(spark, str(tmp_path / "s"), manifest).collect()
    assert text.read_status(spark, str(tmp_path / "s"), manifest, unmatched="drop").count() == 3
