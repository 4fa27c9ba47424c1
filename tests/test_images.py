import numpy as np
import pytest
from pyspark.sql import functions as F

from spotrace.operators import images
from spotrace.plans.segmentation import extract_traces, photobleaching_image, segment, segmentation_grid

FRAME_SCHEMA = "datum int, frame int, height int, width int, pixels array<double>"


@pytest.fixture
def frames_of(spark):
    def build(videos):
        rows = [
            (d, f, *image.shape, [float(v) for v in image.ravel()])
            for d, video in videos.items() for f, image in enumerate(video, 1)
        ]
        return spark.createDataFrame(rows, FRAME_SCHEMA)

    return build


@pytest.fixture
def image_of(spark):
    def build(arrays):
        rows = [
            (d, y, x, float(a[y, x])) for d, a in arrays.items()
            for y in range(a.shape[0]) for x in range(a.shape[1])
        ]
        return spark.createDataFrame(rows, "datum int, y int, x int, v double")

    return build


def to_array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r["v"]
    return out


def test_projections(frames_of):
    video = np.random.default_rng(1).integers(0, 50, size=(6, 5, 7)).astype(float)
    frames = frames_of({0: video})
    pixels = images.unpack_frames(frames)
    assert np.array_equal(to_array(images.z_project(pixels), (5, 7)), video.sum(0))
    assert np.array_equal(to_array(images.z_project_frames(frames), (5, 7)), video.sum(0))
    assert np.array_equal(to_array(images.z_project(pixels, "max", 4), (5, 7)), video[:4].max(0))
    packed = images.pack_frames(pixels, 5, 7)
    assert packed.select("frame", "pixels").exceptAll(frames.select("frame", "pixels")).isEmpty()


def test_partial_projections_are_handed_on(frames_of, monkeypatch):
    monkeypatch.setattr(images, "HELD_IMAGES", 1)
    rng = np.random.default_rng(2)
    videos = {d: rng.normal(size=(3, 4, 4)) for d in range(5)}
    projected = images.z_project_frames(frames_of(videos).coalesce(1))
    for d, video in videos.items():
        assert np.allclose(to_array(projected.filter(F.col("datum") == d), (4, 4)), video.sum(0))


def test_rescale(image_of):
    out = to_array(images.rescale_16bit(image_of({0: np.array([[0.0, 1.0], [2.0, 4.0]])})), (2, 2))
    assert out.tolist() == [[0, 16384], [32768, 65535]]
    assert to_array(images.rescale_16bit(image_of({0: np.ones((2, 2))})), (2, 2)).tolist() == [[0, 0], [0, 0]]


def test_quadrants(frames_of):
    video = np.random.default_rng(3).normal(size=(3, 8, 8))
    frames = frames_of({0: video})
    want = {
        (1, f): v[:4, :4].sum() for f, v in enumerate(video, 1)
    } | {(2, f): v[4:, :4].sum() for f, v in enumerate(video, 1)} | {
        (3, f): v[:4, 4:].sum() for f, v in enumerate(video, 1)
    } | {(4, f): v[4:, 4:].sum() for f, v in enumerate(video, 1)}
    for df in (images.region_intensity(images.unpack_frames(frames), 8), images.region_intensity_frames(frames, 8)):
        got = {(r["region"], r["frame"]): r["raw"] for r in df.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_pixels_outside_the_frame_side_do_not_count(make):
    rows = [(0, 1, 0, 0, 1.0), (0, 1, 8, 0, 5.0), (0, 1, 0, 9, 7.0)]
    pixels = make(rows, "datum int, frame int, y int, x int, v double")
    assert [tuple(r) for r in images.region_intensity(pixels, 8).collect()] == [(0, 1, 1, 1.0)]


def test_background_by_definition():
    image = np.random.default_rng(4).normal(size=(9, 11)) * 5
    radius, (h, w) = 2, image.shape
    ball = images._ball(radius)

    def sweep(src, sign, pick):
        out = np.empty_like(src)
        for y in range(h):
            for x in range(w):
                out[y, x] = pick(
                    src[y + sign * dy, x + sign * dx] - sign * z for dy, dx, z in ball
                    if 0 <= y + sign * dy < h and 0 <= x + sign * dx < w
                )
        return out

    surface = sweep(sweep(image, 1, min), -1, max)
    assert np.allclose(images.remove_background(image, radius), image - surface)
    assert np.allclose(images.remove_background(np.full((5, 5), 3.0), 3), 0)


def test_background_radius_column(frames_of):
    video = np.random.default_rng(5).normal(size=(2, 6, 6))
    frames = frames_of({0: video}).withColumn("r", F.col("frame") + 1)
    for r in images.subtract_background(frames, "r").collect():
        want = images.remove_background(video[r["frame"] - 1], r["frame"] + 1)
        assert np.allclose(np.array(r["pixels"]).reshape(6, 6), want)


def flood_peaks(image, prominence):
    """Direct form: a maximum counts unless something higher is reached above the level."""
    h, w = image.shape
    key = {(y, x): (image[y, x], -y, -x) for y in range(h) for x in range(w)}

    def around(p):
        return [
            q for dy in (-1, 0, 1) for dx in (-1, 0, 1)
            if (q := (p[0] + dy, p[1] + dx)) != p and q in key
        ]

    kept = []
    for p in key:
        if any(key[q] > key[p] for q in around(p)):
            continue
        seen, todo, beaten = {p}, [p], False
        while todo and not beaten:
            for q in around(todo.pop()):
                if q not in seen and image[q] > image[p] - prominence:
                    seen.add(q)
                    todo.append(q)
                    beaten |= key[q] > key[p]
        if not beaten:
            kept.append(p)
    return sorted(kept)


@pytest.mark.parametrize("prominence", [1, 5, 20])
def test_maxima_match_flood_fill(image_of, prominence):
    rng = np.random.default_rng(prominence)
    arrays = {d: rng.integers(0, 40, size=(14, 17)).astype(float) for d in range(3)}
    got = images.find_maxima(image_of(arrays), prominence).collect()
    for d, a in arrays.items():
        rows = sorted((r for r in got if r["datum"] == d), key=lambda r: r["box_num"])
        assert [(r["cy"], r["cx"]) for r in rows] == flood_peaks(a, prominence)


def cone(side, cy, cx, reach):
    """A peak whose column means fall up to ``reach`` columns from the centre, then rise."""
    y, x = np.mgrid[:side, :side]
    d = np.abs(x - cx).astype(float)
    return np.where(d <= reach, 1000.0 - 10 * d, 1000.0 - 10 * reach + 10 * (d - reach))


@pytest.mark.parametrize(
    "reach, steps, width, kept",
    [(0, 1, 3, False), (1, 2, 5, True), (10, 11, 23, True), (11, 12, 25, False), (14, 13, 27, False)],
)
def test_box_growth_by_hand(image_of, make, reach, steps, width, kept):
    image = image_of({0: cone(40, 20, 20, reach)})
    peaks = make([(0, 1, 20, 20)], "datum int, box_num int, cx int, cy int")
    row = images.grow_boxes(image, peaks, 0.1, 40, 40).first()
    assert (row["steps"], row["width"], row["is_kept"]) == (steps, width, kept)
    assert (row["x0"], row["y0"]) == (20 - width // 2, 20 - width // 2)


def test_box_growth_stops_below_tolerance(image_of, make):
    y, x = np.mgrid[:30, :30]
    image = 1000.0 * 0.5 ** np.abs(x - 15)
    peaks = make([(0, 1, 15, 15)], "datum int, box_num int, cx int, cy int")
    row = images.grow_boxes(image_of({0: image}), peaks, 0.1, 30, 30).first()
    assert (row["steps"], row["is_kept"]) == (4, True)  # 1/16 is the first below 0.1


def test_box_growth_at_the_edges(image_of, make):
    image = image_of({0: cone(30, 15, 15, 30)})
    peaks = make(
        [(0, 1, 4, 15), (0, 2, 0, 15), (0, 3, 15, 27)], "datum int, box_num int, cx int, cy int"
    )
    rows = {r["box_num"]: r for r in images.grow_boxes(image, peaks, 0.1, 30, 30).collect()}
    # A slope, not a peak: the profile rises on one side at once.
    assert (rows[1]["steps"], rows[1]["width"], rows[1]["is_kept"]) == (1, 3, False)
    # In the corner column the first step leaves the image: the single pixel stays.
    assert (rows[2]["steps"], rows[2]["width"], rows[2]["is_kept"]) == (1, 1, False)
    # The bottom test uses the width of the step before, which lets the box overlap the edge.
    assert (rows[3]["steps"], rows[3]["width"], rows[3]["is_kept"]) == (5, 9, True)


def test_missing_column_rejects_a_box(image_of, make):
    # Cone at the right edge: growth ends at the edge with columns outside the image.
    y, x = np.mgrid[:30, :30]
    image = 1000.0 - 10 * np.abs(x - 26.0)
    peaks = make([(0, 1, 26, 15)], "datum int, box_num int, cx int, cy int")
    row = images.grow_boxes(image_of({0: image}), peaks, 0.1, 30, 30).first()
    assert (row["steps"], row["width"], row["is_kept"]) == (6, 11, False)


def test_box_intensity_is_sum_over_height(frames_of, make):
    video = np.random.default_rng(6).normal(size=(4, 10, 10))
    frames = frames_of({0: video})
    boxes = make([(0, 1, 2, 3, 3), (0, 2, 5, 1, 5)], "datum int, trace_num int, x0 int, y0 int, width int")
    want = {
        (t, f): v[y:y + w, x:x + w].sum() / w
        for t, x, y, w in ((1, 2, 3, 3), (2, 5, 1, 5)) for f, v in enumerate(video, 1)
    }
    pixels = images.unpack_frames(frames)
    for df in (
        images.box_intensity(pixels, boxes), images.box_intensity(pixels, boxes, 0),
        images.box_intensity_frames(frames, boxes), images.box_intensity_frames(frames, boxes, 0),
    ):
        got = {(r["trace_num"], r["frame"]): r["raw"] for r in df.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_kept_boxes_are_numbered_in_order(make):
    rows = [(0, 1, True), (0, 2, False), (0, 3, True), (1, 1, True)]
    kept = images.renumber_kept(make(rows, "datum int, box_num int, is_kept boolean"))
    assert sorted((r["datum"], r["box_num"], r["trace_num"]) for r in kept.collect()) == [(0, 1, 1), (0, 3, 2), (1, 1, 1)]


def spots(frames, side, centres, rng):
    y, x = np.mgrid[:side, :side]
    base = sum(200 * np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / 4.0) for cy, cx in centres)
    return np.stack([base * (1 + 0.1 * f) + rng.normal(scale=0.1, size=(side, side)) for f in range(frames)])


def test_video_to_traces(frames_of, make):
    rng = np.random.default_rng(7)
    centres = [(10, 12), (25, 30), (30, 9)]
    frames = frames_of({0: spots(5, 40, centres, rng)})
    manifest = make(
        [(0, 3, 5000.0, 0.1)], "datum int, rolling_radius int, peak_prominence double, profile_tolerance double"
    )
    boxes, _ = segment(frames, manifest, None, 40, 40)
    assert sorted((r["cy"], r["cx"]) for r in boxes.collect()) == sorted(centres)
    traces = extract_traces(frames, manifest, None, 40, 40)
    assert traces.select("trace_num").distinct().count() == boxes.filter("is_kept").count() > 0
    assert traces.groupBy("trace_num").count().filter("count <> 5").isEmpty()
    grid = segmentation_grid(frames, [(5, 3000.0, 0.1), (5, 70000.0, 0.1)], 40, 40)
    counts = {r["prominence"]: r["n_kept"] + r["n_rejected"] for r in grid.collect()}
    assert counts[3000.0] >= 3 and counts[70000.0] == 1


def whole_image_peaks(image, prominence):
    y, x = (a.ravel() for a in np.indices(image.shape))
    kept = images.prominent_peaks(y, x, image.ravel(), np.full(image.size, float(prominence)))
    return [(int(y[k]), int(x[k])) for k in kept]


def tiled_peaks(image, prominence, tile):
    import pandas as pd

    y, x = (a.ravel() for a in np.indices(image.shape))
    v = image.ravel().astype(float)
    parts = []
    for ty in range(-(-image.shape[0] // tile)):
        for tx in range(-(-image.shape[1] // tile)):
            near = (y >= ty * tile - 1) & (y <= (ty + 1) * tile) & (x >= tx * tile - 1) & (x <= (tx + 1) * tile)
            yy, xx, vv = y[near], x[near], v[near]
            home = (yy // tile == ty) & (xx // tile == tx)
            parts.append(images.tile_hills(yy, xx, vv, np.full(len(vv), float(prominence)), home))
    py, px, _ = images.joined_peaks(pd.concat(parts, ignore_index=True))
    return list(zip(py.tolist(), px.tolist()))


@pytest.mark.parametrize("shape,tile", [((40, 37), 8), ((9, 30), 1), ((33, 33), 32), ((5, 5), 64)])
@pytest.mark.parametrize("levels", [3, 1000])
def test_tiles_give_the_peaks_of_the_whole_image(shape, tile, levels):
    image = np.random.default_rng(shape[0] + tile).integers(0, levels, shape).astype(float)
    for prominence in (0.0, 1.0, levels / 3):
        assert tiled_peaks(image, prominence, tile) == whole_image_peaks(image, prominence)


def test_tiles_of_large_images():
    rng = np.random.default_rng(8)
    yy, xx = np.indices((512, 600))
    hills = sum(rng.uniform(20, 200) * np.exp(-((yy - rng.uniform(0, 512)) ** 2 + (xx - rng.uniform(0, 600)) ** 2) / rng.uniform(20, 9000)) for _ in range(150))
    for image in (np.round(hills, 1), np.round(hills + rng.normal(size=hills.shape), 2)):
        assert tiled_peaks(image, 5.0, 128) == whole_image_peaks(image, 5.0)
    spiral = np.zeros((512, 600))
    spiral[::2] = np.arange(600) + 1000.0 * np.arange(256)[:, None]  # long climbs across many tiles
    assert tiled_peaks(spiral, 1.0, 128) == whole_image_peaks(spiral, 1.0)


def test_tiled_maxima_on_a_table(image_of, monkeypatch):
    image = np.random.default_rng(12).integers(0, 30, (20, 23)).astype(float)
    got = [(r["cy"], r["cx"], r["box_num"]) for r in images.find_maxima(image_of({4: image}), 4.0, tile=6).orderBy("box_num").collect()]
    assert got == [(y, x, k) for k, (y, x) in enumerate(whole_image_peaks(image, 4.0), 1)]


def test_box_growth_is_the_same_on_small_tiles(image_of, make, monkeypatch):
    rng = np.random.default_rng(13)
    yy, xx = np.indices((48, 50))
    peaks = [(0, k, int(rng.integers(1, 49)), int(rng.integers(1, 47))) for k in range(1, 9)]
    image = sum(1000 * np.exp(-((yy - p[3]) ** 2 + (xx - p[2]) ** 2) / 18.0) for p in peaks) + 20
    seeds = make(peaks, "datum int, box_num int, cx int, cy int")
    names = ["box_num", "x0", "y0", "width", "steps", "is_kept"]
    want = sorted(map(tuple, images.grow_boxes(image_of({0: image}), seeds, 0.1, 48, 50).select(names).collect()))
    monkeypatch.setattr(images, "TILE", 16)
    assert sorted(map(tuple, images.grow_boxes(image_of({0: image}), seeds, 0.1, 48, 50).select(names).collect())) == want
    assert len(want) == 8 and any(r[-1] for r in want)


def test_box_sums_at_edges_equal_slices(frames_of, make):
    image = np.random.default_rng(14).integers(0, 99, (12, 10)).astype(float)
    boxes = [(0, k, x, y, w) for k, (x, y, w) in enumerate([(0, 0, 3), (-2, -1, 5), (8, 9, 5), (3, 4, 7), (20, 2, 3), (-9, 0, 3), (-3, -3, 27)], 1)]
    table = make(boxes, "datum int, trace_num int, x0 int, y0 int, width int")
    want = {}
    for _, k, x, y, w in boxes:
        part = image[max(y, 0):max(y + w, 0), max(x, 0):max(x + w, 0)]
        if part.size:
            want[k] = part.sum() / w
    for most in (100, 0):
        got = {r["trace_num"]: r["raw"] for r in images.box_intensity_frames(frames_of({0: [image]}), table, most).collect()}
        assert got == pytest.approx(want)


def test_photobleaching_image(frames_of, make):
    video = np.random.default_rng(15).integers(0, 500, (6, 9, 8)).astype(float)
    manifest = make([(0, 2)], "datum int, rolling_radius int")
    top = video[:3].max(0)
    for background, image in ((False, top), (True, images.remove_background(top, 2))):
        span = image.max() - image.min()
        want = np.floor((image - image.min()) * 65535 / span + 0.5)
        assert np.array_equal(to_array(photobleaching_image(frames_of({0: video}), manifest, 3, background, 9, 8), (9, 8)), want)
