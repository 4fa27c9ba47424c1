import random

import pytest

from spotrace.operators import events, review

MANIFEST = [(0, "Datum-0", 0, 0.5), (1, "Datum-1", 10, 2.0)]
MANIFEST_SCHEMA = "datum int, label string, start_frame int, time_interval_s double"


def replay(actions, start):
    """One trace, action by action."""
    state = dict(reviewed=False, fused=False, excluded=False, times=(0, 0, 0))
    for _, action, t in sorted(actions):
        if action == "f":
            state.update(fused=True, times=t if start == 0 else (0, t[0], t[1]))
        elif action in "xu":
            state.update(fused=False, excluded=action == "x", times=(0, 0, 0))
        else:
            state["reviewed"] = True
    return (state["reviewed"], state["fused"], *state["times"], state["excluded"])


def test_fold_equals_replay(make):
    rng = random.Random(5)
    rows, by_trace = [], {}
    for seq in range(600):
        key = (rng.randrange(2), rng.randrange(1, 25))
        t = tuple(rng.randrange(1, 400) for _ in range(3))
        action = rng.choice("fxun")
        rows.append((*key, seq, action, *[float(v) for v in t]))
        by_trace.setdefault(key, []).append((seq, action, t))
    actions = make(rows, "datum int, trace_num int, seq long, action string, t1 double, t2 double, t3 double")
    folded = events.fold_actions(actions, make(MANIFEST, MANIFEST_SCHEMA))
    got = {(r[0], r[1]): tuple(r[2:]) for r in folded.select(*events.STATUS_COLUMNS).collect()}
    assert got == {k: replay(v, 0 if k[0] == 0 else 10) for k, v in by_trace.items()}


def test_excluded_then_fused_is_lost_on_reload(make):
    rows = [(0, 1, 1, "x", None, None, None), (0, 1, 2, "f", 5.0, 8.0, 9.0)]
    actions = make(rows, "datum int, trace_num int, seq long, action string, t1 double, t2 double, t3 double")
    folded = events.fold_actions(actions, make(MANIFEST, MANIFEST_SCHEMA))
    assert tuple(folded.first())[2:] == (False, True, 5, 8, 9, True)
    assert tuple(events.reload_status(folded).first())[2:] == (False, False, 0, 0, 0, True)


def test_automatic_labels_need_enough_changepoints(make):
    found = [(0, 1, 30), (0, 1, 80), (0, 2, 80), (0, 2, 30), (0, 2, 90), (1, 1, 80), (1, 1, 30), (1, 2, 30)]
    traces = make([(0, 1), (0, 2), (0, 3), (1, 1), (1, 2)], "datum int, trace_num int")
    manifest = make(MANIFEST, MANIFEST_SCHEMA)
    status = events.auto_status(make(found, "datum int, trace_num int, frame int"), traces, manifest)
    got = {(r[0], r[1]): tuple(r[2:]) for r in status.collect()}
    none = (True, False, 0, 0, 0, False)
    assert got == {
        (0, 1): none, (0, 3): none, (1, 2): none,
        (0, 2): (True, True, 30, 80, 80, False),
        (1, 1): (True, True, 0, 30, 30, False),
    }
    dwell = {(r[0], r[1]): r[2] for r in events.dwell_times(status, manifest).collect()}
    assert dwell == {(0, 2): 25.0, (1, 1): 40.0}


def test_clicks_and_pages(make):
    rows = [(0, 1, 1, "f", 1.4, 2.6, None), (1, 1, 2, "f", 1.0, 2.0, None), (0, 2, 3, "x", None, None, None)]
    actions = make(rows, "datum int, trace_num int, seq long, action string, t1 double, t2 double, t3 double")
    checked = {r["seq"]: r for r in events.click_arity(actions, make(MANIFEST, MANIFEST_SCHEMA)).collect()}
    assert {k: r["is_complete"] for k, r in checked.items()} == {1: False, 2: True, 3: True}
    assert (checked[1]["t1"], checked[1]["t2"]) == (1, 3)
    pages = make([(0, 1, 7, "n")], "datum int, panel int, seq long, action string")
    traces = make([(0, t) for t in range(1, 27)], "datum int, trace_num int")
    spread = events.expand_page_actions(pages, traces)
    assert sorted(r["trace_num"] for r in spread.collect()) == list(range(13, 25))


def test_unknown_labels_and_training_set(make, samples_of):
    schema = "datum int, trace_num int, is_reviewed boolean, is_fusion boolean, is_excluded boolean"
    status = make([(0, 1, True, True, False), (0, 2, True, False, True), (0, 9, False, False, False)], schema)
    samples = samples_of({(0, 1): [1, 2], (0, 2): [3]})
    assert [r["trace_num"] for r in events.unknown_labels(samples, status).collect()] == [9]
    assert sorted((r["trace_num"], r["label"]) for r in events.training_set(samples, status).collect()) == [(1, 1), (1, 1)]


ACTIONS = "datum int, trace_num int, seq long, action string, t1 double, t2 double, t3 double"


def test_untouched_traces_have_a_row(make):
    actions = make([(0, 2, 1, "n", None, None, None), (1, 1, 2, "f", 3.0, 4.0, 5.0)], ACTIONS)
    traces = make([(0, 1), (0, 2), (0, 2), (1, 1), (1, 2)], "datum int, trace_num int")
    folded = events.fold_actions(actions, make(MANIFEST, MANIFEST_SCHEMA), traces)
    got = {(r[0], r[1]): tuple(r[2:]) for r in folded.select(*events.STATUS_COLUMNS).collect()}
    none = (False, False, 0, 0, 0, False)
    assert got == {(0, 1): none, (0, 2): (True, *none[1:]), (1, 1): (False, True, 0, 3, 4, False), (1, 2): none}
    known = folded.where("NOT (datum = 0 AND trace_num = 1)")
    counts = {r["datum"]: tuple(r)[1:] for r in events.review_progress(known, traces).collect()}
    assert counts == {0: (2, 1, 0, 0), 1: (2, 0, 1, 0)}
    assert {r["datum"]: r["panel"] for r in review.resume_panel(known, 1, 1, traces).collect()} == {0: 0, 1: 0}


def test_numbers_and_recordings_that_do_not_exist_are_errors(make, samples_of):
    manifest = make(MANIFEST, MANIFEST_SCHEMA)
    traces = make([(0, 1), (1, 1)], "datum int, trace_num int")
    actions = make([(0, 9, 1, "n", None, None, None)], ACTIONS)
    with pytest.raises(Exception, match="no trace 9 in recording 0"):
        events.fold_actions(actions, manifest, traces).collect()
    status = make([(0, 1, True), (0, 7, True)], "datum int, trace_num int, is_reviewed boolean")
    with pytest.raises(Exception, match="no trace 7 in recording 0"):
        events.attach_labels(traces, status).collect()
    assert events.attach_labels(traces, status.where("trace_num = 1")).count() == 1
    with pytest.raises(Exception, match="no recording 5"):
        events.dwell_times(make([(5, 1, True, 0, 3, False)], "datum int, trace_num int, is_fusion boolean, binding int, fusion_start int, is_excluded boolean"), manifest).collect()
