from spotrace.operators import review


def test_panels(make):
    traces = make([(0, t) for t in range(1, 25)], "datum int, trace_num int")
    placed = {r["trace_num"]: (r["panel"], r["row"], r["col"]) for r in review.panel_of(traces).collect()}
    assert placed[1] == (0, 0, 0) and placed[5] == (0, 1, 0) and placed[12] == (0, 2, 3) and placed[13] == (1, 0, 0)
    assert review.panel_count(traces).first()["n_panels"] == 3  # the last one is empty
    assert sorted(r["trace_num"] for r in review.page_slice(traces, 1).collect()) == list(range(13, 25))


def test_rearrange_closes_gaps(make, monkeypatch):
    monkeypatch.setattr(review, "RANK_BLOCK", 3)
    traces = make([(0, t) for t in (1, 2, 5, 7, 11)], "datum int, trace_num int")
    placed = {r["trace_num"]: (r["panel"], r["row"], r["col"]) for r in review.rearrange(traces, 2, 2).collect()}
    assert placed == {1: (0, 0, 0), 2: (0, 0, 1), 5: (0, 1, 0), 7: (0, 1, 1), 11: (1, 0, 0)}


def test_resume(make):
    rows = [(0, t, t < 15) for t in range(1, 30)] + [(1, 1, True)]
    status = make(rows, "datum int, trace_num int, is_reviewed boolean")
    assert {r["datum"]: r["panel"] for r in review.resume_panel(status).collect()} == {0: 1, 1: -1}


def test_colors_cover_every_row(make):
    boxes = make([(0, 1, True), (0, 2, True), (0, 3, True), (0, 4, False)], "datum int, trace_num int, is_kept boolean")
    status = make([(0, 1, True), (0, 2, False)], "datum int, trace_num int, is_fusion boolean")
    colors = {r["trace_num"]: r["color"] for r in review.event_color(boxes, status).collect()}
    assert colors == {1: "cyan", 2: "yellow", 3: None, 4: "red"}


def test_annotations(make):
    schema = "datum int, trace_num int, is_reviewed boolean, is_fusion boolean, binding int, fusion_start int, fusion_end int, is_excluded boolean"
    status = make([(0, 1, True, True, 5, 10, 13, False), (1, 2, True, False, 0, 0, 0, False)], schema)
    manifest = make([(0, 0, 1.0), (1, 20, 1.0)], "datum int, start_frame int, time_interval_s double")
    cps = make([(1, 2, 44)], "datum int, trace_num int, frame int")
    got = {(r["trace_num"], r["kind"], r["frame"]) for r in review.annotations(status, cps, manifest).collect()}
    assert got == {
        (1, "binding", 5.0), (1, "fusion_start", 10.0), (1, "fusion_mid", 11.5), (1, "fusion_end", 13.0),
        (2, "start", 20.0), (2, "changepoint", 44.0),
    }
