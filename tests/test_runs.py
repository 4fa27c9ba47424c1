import numpy as np
import pytest

from spotrace.plans import analysis, runs

MANIFEST_SCHEMA = "datum int, label string, start_frame int, time_interval_s double"


def traces(datums):
    rng = np.random.default_rng(6)
    out = {}
    for d in datums:
        for t in range(1, 7):
            x = rng.normal(scale=0.2, size=260)
            for at in rng.choice(np.arange(40, 220), 3, replace=False):
                x[at:] += 4
            out[(d, t)] = x
    return out


def rows(spark, root, kind):
    return sorted(map(tuple, runs.read_results(spark, root, kind).collect()), key=repr)


def test_runs_are_marked_and_skipped(spark, samples_of, make, tmp_path, monkeypatch):
    root = str(tmp_path / "results")
    samples = samples_of(traces([0, 1]))
    first = make([(0, "A", 0, 0.5)], MANIFEST_SCHEMA)
    both = make([(0, "A", 0, 0.5), (1, "B", 10, 1.0)], MANIFEST_SCHEMA)

    def lost(*_):
        raise RuntimeError("lost before the marker")

    with monkeypatch.context() as broken:
        broken.setattr(runs, "mark_finished", lost)
        with pytest.raises(RuntimeError):
            runs.run_automatic(spark, root, samples, None, first, 4)
    assert runs.finished(spark, root).count() == 0 and rows(spark, root, "detections") == []
    name = runs.run_automatic(spark, root, samples, None, first, 4)
    after_one = rows(spark, root, "detections")
    assert name and {r[0] for r in after_one} == {0} and len(after_one) == 6
    assert runs.run_automatic(spark, root, samples, None, first, 4) is None
    assert runs.run_automatic(spark, root, samples, None, both, 4) not in (None, name)
    assert {r["datum"]: r["run"] for r in runs.finished(spark, root).collect()}[0] == name
    found, status = analysis.automatic_events(samples, None, both, 4)
    names = runs.read_results(spark, root, "detections").columns
    assert rows(spark, root, "detections") == sorted(map(tuple, status.select(names).collect()), key=repr)
    names = runs.read_results(spark, root, "changepoints").columns
    assert rows(spark, root, "changepoints") == sorted(map(tuple, found.select(names).collect()), key=repr)
    assert any(r[3] for r in after_one) and len(rows(spark, root, "dwell_times")) > 0
    with pytest.raises(ValueError):
        runs.read_results(spark, root, "colours")
