"""Near-duplicate passages by compact windows.

For each of four hash functions, a Cartesian tree over the hashes of a text's five-word shingles groups
all its long enough subsequences: those between ``lo`` and ``hi`` that contain ``at`` have their
least hash there.  Two texts with a near-duplicate passage share such a hash with a chance of 0.75 or
more for each function.  Windows meet by that hash; the stretches around it that both
windows allow are then compared shingle by shingle.

Windows of one hash part by four fingerprints of their surroundings, each window going with all four of its own.
Those of one hash and fingerprint are not paired with each other.  They are compared with the earliest of
them.  A window without a common passage there is tried again under a finer key: the hash, and what
follows in its text beyond the run that it shares with the earliest.  A short phrase in many unrelated
texts so falls apart at once.  Passages are found between different documents.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import words
from spotrace.session import is_small, materialize, release

WIDTH = 5
MIN_WORDS = 50
PERCENT = 75
FUNCTIONS = 4
SHORT_LIST = 50_000

_PLACE = np.uint64((1 << 28) - 1)
_TURN = np.uint64(0x9E3779B)  # odd, so that places and turned places correspond
_BACK = np.uint64(pow(0x9E3779B, -1, 1 << 28))


def compact_windows(values: np.ndarray, begin: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, lo, hi): nodes of the Cartesian tree of each text that span ``least`` values or more, ends included.

    The trees of all texts grow level by level.  Equal values rank by a scrambled place, so repetitive
    texts have flat trees too.
    """
    if len(values) >= 1 << 28:
        raise ValueError("a text of more than 2**28 words")
    place = np.arange(len(values), dtype=np.uint64)
    ranked = np.append((values & ~_PLACE) | (place * _TURN & _PLACE), np.uint64(2**64 - 1))
    lo, hi = begin[:-1], begin[1:] - 1
    found = []
    while True:
        wide = hi - lo + 1 >= least
        lo, hi = lo[wide], hi[wide]
        if not len(lo):
            break
        ends = np.column_stack([lo, hi + 1]).reshape(-1)
        at = (np.minimum.reduceat(ranked, ends)[::2] * _BACK & _PLACE).astype(np.int64)
        found.append((at, lo, hi))
        lo, hi = np.column_stack([lo, at + 1]).reshape(-1), np.column_stack([at - 1, hi]).reshape(-1)
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = words.LOWER[data]
    starts, ends, first = words.word_spans(data, offsets)
    return words.shingle_hashes(words.hash_spans(data, starts, ends), first, WIDTH)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))


WINDOWS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "doc", "place", "near")])
PARTED = T.StructType(WINDOWS.fields[:3])


def _packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Place of the least hash (28 bits) and how far the window goes before and behind it (18 bits each)."""
    most = (1 << 18) - 1
    return (at << 36) | (np.minimum(at - lo, most) << 18) | np.minimum(hi - at, most)


def _near(hashes: np.ndarray, at: np.ndarray, start: np.ndarray, stop: np.ndarray, reach: int) -> np.ndarray:
    """Four 16-bit fingerprints: two min-hashes of the shingles before ``at`` and two of those behind."""
    out = np.zeros(len(at), np.uint64)
    most = np.iinfo(np.uint64).max
    mixed = [np.append(words.mix(hashes + np.uint64(7919 * k)), np.uint64(most)) for k in (1, 2)]
    for side in (0, 1):
        least = [np.full(len(at), most, np.uint64) for _ in mixed]
        for d in range(1, reach + 1):
            place = at + d if side else at - d
            place = np.where((place >= start) & (place < stop), place, len(hashes))
            for found, values in zip(least, mixed):
                np.minimum(found, values[place], out=found)
        for k, found in enumerate(least):
            out |= (words.mix(found) & np.uint64(0xFFFF)) << np.uint64(16 * (2 * side + k))
    return out


def windows(docs: DataFrame, function: int, min_words: int = MIN_WORDS) -> DataFrame:
    """Compact windows of every document under one hash function: the least hash, its place with the window's reach, and fingerprints around it."""
    least = min_words - WIDTH + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in words.text_blocks(batches, "doc", "text"):
            hashes, begin = _shingles(data, offsets)
            own = words.mix(hashes + np.uint64((function + 1) * 0x51B54A32D192ED03 % 2**64))
            at, lo, hi = compact_windows(own, begin, least)
            of = np.searchsorted(begin, at, side="right") - 1
            base = begin[of]
            near = _near(hashes, at, base, begin[of + 1], (least - 1) // 2)
            yield pa.RecordBatch.from_arrays([
                pa.array(own[at].view(np.int64)), pa.array(keys, pa.int64()).take(pa.array(of)),
                pa.array(_packed(at - base, lo - base, hi - base)), pa.array(near.view(np.int64)),
            ], WINDOWS.names)

    return _docs(docs).where("doc IS NOT NULL").mapInArrow(run, WINDOWS)


# Shares of a passage's shingles that may have to match: 6/7 of both passages is a similarity of 3/4; tighter runs
# come next, then looser ones, for passages to which one text has added words.
_SHARES = ((6, 7), (19, 20), (1, 1), (4, 5), (3, 4))


def _runs(place: np.ndarray, share: tuple[int, int]) -> list[tuple[int, int, int]]:
    """(first, last, places) of runs of sorted places, neighbours joined while that share of the run is there."""
    if not len(place):
        return []
    cut = np.flatnonzero(np.diff(place) > 1)
    firsts, lasts = place[np.append(0, cut + 1)].tolist(), place[np.append(cut, len(place) - 1)].tolist()
    joined: list[tuple[int, int, int]] = []
    for s, e in zip(firsts, lasts):
        joined.append((s, e, e - s + 1))
        while len(joined) > 1:
            (s0, _, n0), (_, e1, n1) = joined[-2], joined[-1]
            if share[1] * (n0 + n1) < share[0] * (e1 - s0 + 1):
                break
            joined[-2:] = [(s0, e1, n0 + n1)]
    return joined


def common_passages(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int, float]]:
    """(first, last in a, first, last in b, similarity) of passages of two shingle sequences, ends included.

    Passages of ``a`` do not overlap; ways to join runs are tried in the order of _SHARES.
    """
    found: list[tuple[int, int, int, int, float]] = []
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    place = np.flatnonzero(np.isin(a, ranked))
    tried: set[tuple[int, int]] = set()
    for share in _SHARES:
        for s, e, _ in _runs(place, share):
            if e - s + 1 < least or (s, e) in tried or any(s <= f[1] and f[0] <= e for f in found):
                continue
            tried.add((s, e))
            kinds = np.unique(a[s:e + 1])
            lo, hi = np.searchsorted(ranked, kinds, "left"), np.searchsorted(ranked, kinds, "right")
            n = hi - lo
            there = np.sort(order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))])
            for t, u, held in sorted({r for k in _SHARES for r in _runs(there, k)}, key=lambda r: (-r[2], r)):
                if 100 * held < percent * len(kinds):
                    break  # too few of the shingles are there
                if u - t + 1 < least:
                    continue
                y = np.unique(b[t:u + 1])
                both = len(np.intersect1d(kinds, y, assume_unique=True))
                if 100 * both >= percent * (len(kinds) + len(y) - both):
                    found.append((s, e, t, u, both / (len(kinds) + len(y) - both)))
                    break
    return found


SPANS = T.StructType([
    *(T.StructField(c, T.LongType()) for c in ("doc_id", "start", "end", "other_doc_id", "other_start", "other_end")),
    T.StructField("similarity", T.DoubleType()),
])


def _parted(made: DataFrame) -> DataFrame:
    """Every window under four finer keys (columns of PARTED): its hash with each fingerprint.

    Of any passage that two windows of one hash have in common, one side of the place lies inside it as far as
    fingerprints look, so that an exact repeat has both fingerprints of that side.
    """
    lanes = [
        F.xxhash64("key", F.lit(lane), F.shiftright("near", 16 * lane).bitwiseAND(F.lit(0xFFFF))) for lane in range(4)
    ]
    return made.select(F.explode(F.array(*lanes)).alias("key"), "doc", "place")


def _met(left: DataFrame, least: int) -> DataFrame:
    """Windows with the stretches of both documents that they and the windows they meet allow.

    Every window meets the earliest of its key.  If that is in the same document, they only part under finer keys,
    which needs no more than ``least`` shingles on each side.
    """
    group = Window.partitionBy("key")
    met = left.select(
        "*", F.min(F.struct("doc", "place")).over(group).alias("p"), F.max("doc").over(group).alias("last"),
    ).where("p.doc < last AND (doc > p.doc OR place > p.place)")
    own = F.col("doc") == F.col("p.doc")

    def part(place: str) -> tuple[Column, Column, Column]:
        reach = [F.shiftright(place, k).bitwiseAND(F.lit((1 << 18) - 1)).cast("int") for k in (18, 0)]
        return F.shiftright(place, 36).cast("int"), *reach

    def near(reach: Column) -> Column:
        return F.when(own, F.least(reach, F.lit(least))).otherwise(reach)

    (at, back, on), (pat, pback, pon) = part("place"), part("p.place")
    back, on, pback, pon = near(back), near(on), near(pback), near(pon)
    before, behind = F.least(back, pback), F.least(on, pon)
    spare = F.floor((before + behind) / 4).cast("int") + 8  # room for inserted words
    return met.select(
        "doc", F.col("p.doc").alias("other"), (at - pat).alias("shift"),
        F.greatest(at - back, at - before - spare).alias("lo"), F.least(at + on, at + behind + spare).alias("hi"),
        F.greatest(pat - pback, pat - before - spare).alias("plo"), F.least(pat + pon, pat + behind + spare).alias("phi"),
        F.struct("key", "place", at.alias("at")).alias("w"),
    )


def _stretches(met: DataFrame) -> DataFrame:
    """One row per pair of documents and diagonal: the stretches of all windows that meet there, and these windows."""
    return met.groupBy("doc", "other", "shift").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("plo").alias("plo"), F.max("phi").alias("phi"),
        F.collect_list("w").alias("met"),
    )


def _cut(docs: DataFrame, stretches: DataFrame) -> DataFrame:
    """(doc, lo, hi, shingles) of every wanted stretch; a document is read once for all of its stretches.

    Shingles are the low 32 bits of their hashes.  A short list of stretches (50,000 at most, counted) goes to the texts.
    """
    wanted = materialize(stretches.select("doc", "lo", "hi").union(stretches.select("other", "plo", "phi")).distinct(), "wanted")
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    if is_small(wanted, SHORT_LIST):
        lists = F.broadcast(lists)
    texts = _docs(docs).join(lists, "doc").select(F.struct("doc", "parts").alias("key"), "text")
    schema = T.StructType([
        T.StructField("doc", T.LongType()), T.StructField("lo", T.IntegerType()), T.StructField("hi", T.IntegerType()),
        T.StructField("shingles", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in words.text_blocks(batches, "key", "text"):
            hashes, begin = _shingles(data, offsets)
            rows = [
                (k["doc"], p["lo"], p["hi"], hashes[b + p["lo"]:min(b + p["hi"] + 1, e)].astype("<u4").tobytes())
                for k, b, e in zip(keys, begin.tolist(), begin[1:].tolist()) for p in k["parts"] if b + p["lo"] < e
            ]
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    return texts.mapInArrow(run, schema)


def _refined(a: np.ndarray, b: np.ndarray, i: int, j: int, key: int) -> list[int]:
    """New keys of a window that has no passage in common with the first of its key.

    Both agree on a run around the place i in a and j in b.  Whoever shares a longer passage with a
    also shares what follows in a beyond one end of that run, so that is added to the key.
    """
    back, on = min(i, j) + 1, min(len(a) - i, len(b) - j)
    same = a[i - back + 1:i + 1][::-1] == b[j - back + 1:j + 1][::-1]
    before = back if same.all() else int(np.argmin(same))
    same = a[i:i + on] == b[j:j + on]
    behind = on if same.all() else int(np.argmin(same))
    keys = []
    for side, reach, there in ((1, before, i - before), (2, behind, i + behind)):
        if 0 <= there < len(a):
            far = max(there - WIDTH + 1, 0) if side == 1 else min(there + WIDTH - 1, len(a) - 1)
            held = np.array([key & 0xFFFFFFFFFFFFFFFF, side, reach], np.uint64)
            mixed = words.mix(held[:1] + held[2:] * np.uint64(4) + held[1:2]) ^ a[far:far + 1].astype(np.uint64)
            keys.append(int(words.mix(mixed).view(np.int64)[0]))
    return keys


FOUND = T.StructType([*SPANS.fields, *PARTED.fields])


def _verified(cut: DataFrame, stretches: DataFrame, least: int, percent: int) -> DataFrame:
    """Passages found (columns of SPANS), and the windows to try again under finer keys (columns of PARTED)."""
    one = cut.withColumnRenamed("shingles", "a")
    two = cut.select(F.col("doc").alias("other"), F.col("lo").alias("plo"), F.col("hi").alias("phi"), F.col("shingles").alias("b"))
    joined = stretches.join(one, ["doc", "lo", "hi"]).join(two, ["other", "plo", "phi"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spans, again = [], []
            for r in batch.itertuples():
                a, b = np.frombuffer(r.a, "<u4"), np.frombuffer(r.b, "<u4")
                passages = common_passages(a, b, least, percent) if r.doc != r.other else []
                for s, e, t, u, sim in passages:
                    spans.append((r.doc, r.lo + s, r.lo + e + WIDTH, r.other, r.plo + t, r.plo + u + WIDTH, sim))
                for w in r.met:
                    i, j = w["at"] - r.lo, w["at"] - r.shift - r.plo
                    if not any(s <= i <= e for s, e, *_ in passages):
                        again += [(k, r.doc, w["place"]) for k in _refined(a, b, i, j, w["key"])]
            for rows, names in ((spans, SPANS.names), (again, PARTED.names)):
                if rows:
                    yield pd.DataFrame(rows, columns=names).convert_dtypes().reindex(columns=FOUND.names)

    return joined.select("doc", "lo", "other", "plo", "shift", "met", "a", "b").mapInPandas(run, FOUND)


def _outermost(spans: DataFrame) -> DataFrame:
    """Spans without those that lie inside a span of the same document found in an earlier other document.

    Rows stream by document and other document; only the outer spans of one document are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: tuple | None = None
        starts: list[int] = []  # of the spans held, with their ends; both rise
        ends: list[int] = []
        new: list[tuple[int, int]] = []
        for rows in batches:
            keep = []
            for doc, other, s, e in zip(*(rows[c].tolist() for c in order)):
                if met != (doc, other):
                    if met is None or met[0] != doc:
                        starts, ends, new = [], [], []
                    for span in new:
                        _hold(starts, ends, *span)
                    met, new = (doc, other), []
                k = bisect_right(starts, s)
                keep.append(not (k and ends[k - 1] >= e))
                if keep[-1]:
                    new.append((s, e))
            yield rows.loc[np.array(keep, bool)]

    order = ["doc_id", "other_doc_id", "start", "end"]
    return spans.repartition("doc_id").sortWithinPartitions(*order).mapInPandas(run, SPANS)


def _hold(starts: list[int], ends: list[int], s: int, e: int) -> None:
    """Add a span to those held, unless it lies inside one, in place of those inside it."""
    k = bisect_right(starts, s)
    if k and ends[k - 1] >= e:
        return
    first = k - (k > 0 and starts[k - 1] == s)
    last = bisect_right(ends, e)
    starts[first:max(first, last)], ends[first:max(first, last)] = [s], [e]


def duplicate_passages(docs: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Passages that a document has in common with an earlier one (by doc_id).

    Rows: doc_id, start, end (words of the text, end excluded), other_doc_id, other_start, other_end, similarity
    of the shingle sets.  A passage that lies inside one in common with a still earlier document is left out.
    Words are lower-cased (A-Z).  Passages have ``min_words`` words or more.  A null,
    empty or short text and a null doc_id have none; rows that repeat a doc_id count as one document and
    are not compared with each other.  Other columns are not read; an empty table gives no rows.  Starts jobs.
    """
    least = min_words - WIDTH + 1
    # One hash function after another, so that only one shuffles its windows at a time.
    met = []
    for k in range(FUNCTIONS):
        made = materialize(windows(docs, k, min_words), "windows")
        shared = made.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        met.append(materialize(_met(_parted(made.join(shared, "key")), least), "met"))
        release(made)
    left = reduce(DataFrame.union, met)
    parts: list[DataFrame] = []
    while True:
        stretches = materialize(_stretches(left), "stretches")
        release(*met)
        if stretches.isEmpty():
            break
        cut = materialize(_cut(docs, stretches), "cut")
        found = materialize(_verified(cut, stretches, least, percent), "found")
        release(cut, stretches)
        parts.append(materialize(found.where("doc_id IS NOT NULL").select(*SPANS.names), "spans"))
        met = [found]
        left = _met(found.where("key IS NOT NULL").select(*PARTED.names).distinct(), least)
    if not parts:
        return docs.sparkSession.createDataFrame([], SPANS)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return _outermost(out.distinct())


def remove_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Documents without the words that ``spans`` (doc_id, start, end) names; the columns stay as they were.

    Line ends and spaces around removed words shrink to one gap; n_chars, if there, is counted anew.  A
    document left without a word goes; one without spans stays untouched, whatever its text.
    """
    lists = spans.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__doc")).agg(
        F.collect_set(F.struct("start", "end")).alias("__spans"))
    met = docs.join(lists, F.col("doc_id").cast("long") == F.col("__doc"), "left")
    names = docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [_without(t, s) for t, s in zip(batch["text"].tolist(), batch["__spans"].tolist())]
            batch["text"] = pd.array(texts, "string")
            yield batch[names + ["__spans"]].assign(__gone=[s is not None and not t for t, s in zip(texts, batch["__spans"])])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("__spans", span), T.StructField("__gone", T.BooleanType())])
    touched = met.where("__spans IS NOT NULL").select(*names, "__spans").mapInPandas(run, schema).where("NOT __gone")
    if "n_chars" in names:
        touched = touched.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return met.where("__spans IS NULL").select(*names).union(touched.select(*names))


def _without(text: str, spans: list) -> str:
    held = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(held, np.uint8)
    starts, ends, _ = words.word_spans(data, np.array([0, len(data)]))
    drop = np.zeros(len(starts) + 1, np.int64)
    for s in spans:
        drop[min(s["start"], len(starts))] += 1
        drop[min(s["end"], len(starts))] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    cut = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    pieces = [held[starts[s]:ends[e - 1]] for s, e in zip(cut[::2], cut[1::2])]
    return b"\n".join(pieces).decode("utf-8", "surrogatepass")
