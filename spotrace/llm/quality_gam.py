"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted one feature after the other in cycles, add up to one lookup table
for each feature and for each chosen pair of features.  A score is a sum of table entries,
found by binning and vectorised addition.  Features are counts over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import samples, words
from spotrace.session import materialize

FEATURES = (
    "log_words", "word_bytes", "symbols", "bangs", "capitals", "punctuation", "digits", "spaces", "wide_bytes",
    "same_as_last", "repeated_windows", "distinct_words", "repeated_lines", "open_lines", "log_line_words",
    "capital_words", "marked_words", "lone_marks",
)
# At most so many labelled rows are learnt from, those with the smallest hash of their number.
MAX_TRAINING_ROWS = 20_000
BINS = 32
ROUNDS = 60
PAIRS = 6
PAIR_ROUNDS = 20
RATE = 0.15
MIN_LEAF = 20


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _BANG, _END = _mask("#*$%&|<>@^~=_\\{}[]"), _mask("!"), _mask(".!?:;\"')")
_CAPITAL = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PUNCT, _DIGIT = _mask(".,;:!?-'\"()/"), _mask("0123456789")
_WIDE = np.arange(256) >= 128
_LETTER = _CAPITAL | _mask("abcdefghijklmnopqrstuvwxyz") | _WIDE


def _per_text(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each of the ranges between offsets."""
    total = np.append(0, np.cumsum(flag))
    return np.diff(total[offsets])


def _repeats(text_of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` texts, the number of values that came before in the same text."""
    keys = words.mix(hashes + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    again = np.append(False, keys[1:] == keys[:-1])[:len(keys)]
    return np.bincount(text_of[order][again], minlength=n)


def features_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of feature values for each text; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    starts, ends, first = words.word_spans(data, offsets)
    count = np.diff(first)
    some = np.maximum(count, 1)
    text_of = np.repeat(np.arange(n), count)
    hashes = words.hash_spans(data, starts, ends)
    runs, run_first = words.shingle_hashes(hashes, first, 5)
    run_count = np.diff(run_first)
    same = np.append(False, (hashes[1:] == hashes[:-1]) & (text_of[1:] == text_of[:-1]))[:len(hashes)]
    letters, capitals = np.append(0, np.cumsum(_LETTER[data])), np.append(0, np.cumsum(_CAPITAL[data]))
    symbols = np.append(0, np.cumsum(_SYMBOL[data]))
    word_letters = letters[ends] - letters[starts]
    shouted = (capitals[ends] - capitals[starts] > 1) & (capitals[ends] - capitals[starts] == word_letters)
    marked = (symbols[ends] - symbols[starts] > 0) & (word_letters > 0)
    # Lines: spans between line ends, those with a word only.
    if len(starts):
        cut = np.searchsorted(starts, np.unique(np.append(offsets, np.flatnonzero(data == 10) + 1)))
        filled = np.diff(cut) > 0
        begins, stops = starts[cut[:-1][filled]], ends[cut[1:][filled] - 1]
        line_text = np.searchsorted(offsets, begins, side="right") - 1
        lines = np.bincount(line_text, minlength=n)
        again = _repeats(line_text, words.hash_spans(data, begins, stops), n)
        open_ = np.bincount(line_text[~_END[data[stops - 1]]], minlength=n)
    else:
        lines = again = open_ = np.zeros(n, np.int64)
    some_lines = np.maximum(lines, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return _per_text(mask[data], offsets) / size

    def by_text(flag: np.ndarray) -> np.ndarray:
        return np.bincount(text_of[flag], minlength=n) / some

    return np.column_stack([
        np.log1p(count), np.bincount(text_of, ends - starts, n) / some,
        share(_SYMBOL), share(_BANG), share(_CAPITAL), share(_PUNCT), share(_DIGIT), share(~words.IS_WORD), share(_WIDE),
        by_text(same), _repeats(np.repeat(np.arange(n), run_count), runs, n) / np.maximum(run_count, 1),
        np.where(count > 0, 1 - _repeats(text_of, hashes, n) / some, 0),
        again / some_lines, open_ / some_lines, np.log1p(count / some_lines),
        by_text(shouted), by_text(marked), by_text(word_letters == 0),
    ]).astype(np.float32)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``features`` (array of float) of every row; a null text counts as empty, other columns are not read."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in words.text_blocks(batches, "doc_id", "text"):
            found = features_of(data, offsets)
            flat = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * len(FEATURES), found.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), flat], ["doc_id", "features"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


@dataclass
class Gam:
    """Bin edges, one table for each feature, one for each pair; ``score`` adds them up."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)])

    def logit(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        if self.edges and len(x):
            b = self.bins(x)
            for j, table in enumerate(self.tables):
                total += table[b[:, j]]
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + 1.0))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int | None:
    """Best cut of a run of bins by the gain of a Newton step, or None."""
    if len(g) < 2:
        return None
    left_g, left_h, left_n = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(left_n < MIN_LEAF) | (n.sum() - left_n < MIN_LEAF)] = -1
    best = int(np.argmax(gain))
    return best + 1 if gain[best] > 1e-9 else None


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf value of every bin of a tree of cuts along one axis."""
    cut = _split(g, h, n) if depth else None
    if cut is None:
        return np.full(len(g), _leaf(g, h))
    return np.concatenate([_tree(g[:cut], h[:cut], n[:cut], depth - 1), _tree(g[cut:], h[cut:], n[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Leaf values of a tree that cuts one axis, then each half along the other."""
    best, value = -1.0, np.full(g.shape, _leaf(g, h))
    for turned in (False, True):
        a, b, c = (g.T, h.T, n.T) if turned else (g, h, n)
        cut = _split(a.sum(1), b.sum(1), c.sum(1))
        for at in {cut or a.shape[0] // 2, a.shape[0] // 2}:
            out = np.empty(a.shape)
            gain = 0.0
            for part in (slice(0, at), slice(at, None)):
                leaves = _tree(a[part].sum(0), b[part].sum(0), c[part].sum(0), 1)
                out[part] = leaves
                gain += float((leaves * a[part].sum(0)).sum())
            if gain > best:
                best, value = gain, out.T if turned else out
    return value


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Learn from feature rows and 0/1 labels; with one class only, the model is its smoothed rate."""
    model = Gam()
    rate = (y.sum() + 1) / (len(y) + 2)
    model.intercept = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return model
    model.edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            k = len(table)
            step = RATE * _tree(np.bincount(b[:, j], g, k), np.bincount(b[:, j], h, k), np.bincount(b[:, j], minlength=k))
            table += step
            total += step[b[:, j]]

    def grid(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        shape = (len(model.tables[i]), len(model.tables[j]))
        return np.bincount(b[:, i] * shape[1] + b[:, j], v, shape[0] * shape[1]).reshape(shape)

    # The pairs whose trees promise most on what single features leave.
    g, h = slopes()
    promise = {}
    for i in range(x.shape[1]):
        for j in range(i):
            gg = grid(i, j, g)
            promise[(i, j)] = float((_pair_tree(gg, grid(i, j, h), grid(i, j, None)) * gg).sum())
    model.pairs = sorted(promise, key=lambda p: (-promise[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h), grid(i, j, None))
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def train(rows: DataFrame, labels: DataFrame, learn: Column, most: int = MAX_TRAINING_ROWS) -> Gam:
    """Fit on feature rows that ``labels`` (doc_id, quality) covers and ``learn`` marks, ``most`` at most."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("__y")).where("__y IN (0, 1)")
    met = rows.where(learn).join(known, "doc_id").select("doc_id", "features", "__y")
    sample = samples.smallest_hashes(met, most, "doc_id", "__y").toPandas()
    if not len(sample):
        return Gam()
    return fit(np.array(sample["features"].tolist(), np.float64), sample["__y"].to_numpy(np.float64))


def with_scores(rows: DataFrame, model: Gam) -> DataFrame:
    """Replace ``features`` by ``score``; nothing moves between tasks."""
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != "features"), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array(batch["features"].tolist(), np.float64).reshape(len(batch), len(FEATURES))
            yield batch.drop(columns="features").assign(score=model.score(x))

    return rows.mapInPandas(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id and score of every row, learnt from ``labels`` where ``learn`` (on doc_id) holds.

    Labels are joined for learning only.  A null or empty text has the score of an empty text; a null
    doc_id is scored and never learnt from; repeated rows are scored as often as they come;
    without usable labels every score is 0.5.  An empty table gives no rows.
    """
    rows = materialize(features(docs), "features")
    return with_scores(rows, train(rows, labels, learn))


def keep_good(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, as they came; nothing is shuffled but training rows.

    Learning and nulls as in :func:`score_documents`.
    """
    model = train(materialize(features(docs), "features"), labels, learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(features_of(data, offsets)) for _, data, offsets in words.text_blocks([batch], None, "text")]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= threshold))

    return docs.mapInArrow(run, docs.schema)
