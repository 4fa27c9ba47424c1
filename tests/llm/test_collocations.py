"""Phrases against a brute-force count, on odd input, with full filters and with forced collisions."""

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from spotrace.llm import collocations as co
from spotrace.llm import queries
from tests.llm.test_llm import LOW, SMALL

SCHEMA = "doc_id long, lang string, text string"


def brute(rows, min_count, top=co.TOP):
    counts, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            found = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(found)
            for m in range(1, 5):
                for s in range(len(found) - m + 1):
                    counts[lang, tuple(found[s:s + m])] += 1
    out = []
    kept = {p: a for p, a in counts.items() if len(p[1]) > 1 and a >= min_count}
    around = collections.Counter()
    for (lang, p), a in kept.items():
        for m in range(2, len(p)):
            for s in range(len(p) - m + 1):
                around[lang, p[s:s + m]] = max(a, around[lang, p[s:s + m]])
    for (lang, p), a in kept.items():
        score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        if 100 * around[lang, p] < 80 * a:
            out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    ranked, rank = [], collections.Counter()
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= top:
            ranked.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(ranked)


def result(df):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def sample(seed, n):
    rng = random.Random(seed)
    names = "the of New york City a é 日本 X-1 in b\x00c don't".split(" ")
    out = []
    for _ in range(n):
        parts = [rng.choice(names) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", " \t "]) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "en", "de", None, ""]), "".join(parts)))
    return [*out, ("en", None), ("en", ""), ("zz", " .,; "), ("en", "one"), ("en", "the of " * 3000), (None, "the\x0bof\x0cthe of")]


@pytest.fixture
def docs(spark):
    def build(rows):
        return spark.createDataFrame([(1, lang, text, 5, "k", "h") for lang, text in rows], SCHEMA + ", n int, phrase string, head string").repartition(4)

    return build


def test_phrases_equal_a_brute_force_count(docs):
    rows = sample(1, 300)
    assert result(co.collocations(docs(rows + rows[:20]))) == brute(rows + rows[:20], 30)
    assert result(co.collocations(docs(rows), top=7, min_count=3)) == brute(rows, 3, 7)


def test_empty_table(docs):
    assert result(co.collocations(docs([("en", "a b")]).where("false"))) == []
    assert result(co.collocations(docs([(None, None)]))) == []


def test_long_texts_are_cut_between_pieces():
    import pyarrow as pa

    text = b"a b. c d, e f g h. " * 40
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text], pa.binary())], ["lang", "text"])
    pieces = [t for _, texts in co._slices(iter([batch]), 50) for t in texts]
    assert b"".join(pieces) == text and len(pieces) > 10 and all(p.strip()[-1:] in b".," for p in pieces)


def test_full_filters_lose_and_add_nothing(docs, monkeypatch):
    rows = sample(2, 200)
    monkeypatch.setattr(co, "_filter", lambda frequent: np.full(4096, 255, np.uint8))
    assert result(co.collocations(docs(rows))) == brute(rows, 30)


def test_colliding_fingerprints_are_told_apart_by_text():
    runs = co.Runs(["x", "y"], [b"a b c a b", b"a b d"])
    runs.prints = lambda width, where: np.zeros(len(where), np.uint64)
    everything = [np.full(4096, 255, np.uint8)] * 4
    found = collections.Counter()
    for batch in co._phrases_of(runs, everything):
        for r in batch.to_pylist():
            found[r["lang"], r["phrase"]] += r["n"]
    assert found["x", "a b"] == 2 and found["y", "a b"] == 1 and found["x", "a b c a"] == 1 and found["y", "d"] == 1


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = con.execute(queries.SQL["op12_collocations"]).df().sort_values(["lang", "rank"])
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert result(queries.QUERIES["op12_collocations"](spark, SMALL)) == sorted(map(tuple, want[names].itertuples(index=False)))
