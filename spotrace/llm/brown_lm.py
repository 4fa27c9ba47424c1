"""Class-based bigram language model (Brown) with exchange clustering, trained and applied on whole texts.

The corpus is read once and kept as blocks: one row holds the documents of one task as
local word numbers, the 64-bit hashes of its distinct words and their training counts.  All
later passes are scans of these blocks.  Word counts are exact sums over all blocks, keyed by hash.
Classes belong to words: profiles and the class map are tables with a row for each training word, and a block
gets the classes of its own words by a join.  Each exchange step sends only a class-by-class matrix to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import words
from spotrace.session import materialize, release, tidy

TYPES = 1 << 63  # keys of words in the class map: their hashes without the sign
CLASSES = 64
BLOCK_TOKENS = 3_000_000
EXCHANGES = 4
DISCOUNT = 0.5
PRIOR = 0.5
END = 0  # the class of the end of a text, which is also the context of its first word

BLOCKS = T.StructType([
    T.StructField("block", T.LongType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("train", T.ArrayType(T.BooleanType())),
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("tokens", T.BinaryType()),
    T.StructField("hashes", T.ArrayType(T.LongType())),
    T.StructField("counts", T.ArrayType(T.IntegerType())),
])


CLASSED = T.StructType([f for f in BLOCKS if f.name != "counts"] + [
    T.StructField("own", T.BinaryType()),  # the class of each word
    T.StructField("c", T.BinaryType()),  # its training count in all blocks
])


def to_blocks(docs: DataFrame, train: Column) -> DataFrame:
    """Blocks of (doc_id, text) rows; ``train`` marks the rows to learn from, null counts as false."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate([h for _, h, _ in held])
            sizes = np.concatenate([s for _, _, s in held])
            keys = [k for ks, _, _ in held for k in ks]
            types, of, n = np.unique(hashes, return_inverse=True, return_counts=True)
            # Frequent words get small numbers, which take little room when they are stored.
            place = np.argsort(-n, kind="stable")
            types, of = types[place], np.argsort(place)[of]
            learn = np.array([bool(k["t"]) for k in keys], bool)
            counts = np.bincount(of[np.repeat(learn, sizes)], minlength=len(types))
            row = {
                "block": [base + made], "doc_ids": [[k["d"] for k in keys]], "train": [learn.tolist()],
                "sizes": [sizes.tolist()], "tokens": [of.astype("<i4").tobytes()],
                "hashes": [types.view(np.int64)], "counts": [counts.astype(np.int32)],
            }
            return pa.RecordBatch.from_pydict(row, schema=SCHEMA)

        from pyspark.sql.pandas.types import to_arrow_schema
        SCHEMA = to_arrow_schema(BLOCKS)
        for keys, data, offsets in words.text_blocks(batches, "key", "text"):
            data = words.LOWER[data]
            starts, ends, first = words.word_spans(data, offsets)
            held.append((keys, words.hash_spans(data, starts, ends), np.diff(first)))
            tokens += len(starts)
            if tokens >= BLOCK_TOKENS:
                yield flush()
                made, tokens = made + 1, 0
                held.clear()
        if held:
            yield flush()

    key = F.struct(F.col("doc_id").cast("long").alias("d"), F.coalesce(train, F.lit(False)).alias("t"))
    return docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(run, BLOCKS)


def counted_words(blocks: DataFrame) -> DataFrame:
    """(block, place, hash, c, first): every block's words with their training counts in all blocks.

    A word comes at most once from a block.
    """
    each = blocks.select("block", F.posexplode(F.arrays_zip("hashes", "counts")).alias("place", "w")).select(
        "block", "place", F.col("w.hashes").alias("hash"), F.col("w.counts").alias("n"))
    # Counts are summed before they meet, and a join may split what a hot word's blocks need.
    sums = each.groupBy("hash").agg(F.sum("n").alias("c"), F.min("block").alias("earliest"))
    return each.join(sums, "hash").select("block", "place", "hash", "c", (F.col("block") == F.col("earliest")).alias("first"))


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word, train flag by document, sizes)."""
    return np.frombuffer(row.tokens, "<i4"), np.asarray(row.train, bool), np.asarray(row.sizes, np.int64)


def _own(row) -> np.ndarray:
    return np.frombuffer(row.own, np.uint8)


def _sequence(values: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """Values of the words of consecutive documents, ``end`` after each document."""
    out = np.full(len(values) + len(sizes), end, values.dtype)
    out[np.arange(len(values)) + np.repeat(np.arange(len(sizes)), sizes)] = values
    return out


def profile(blocks: DataFrame, classes: Callable) -> DataFrame:
    """(hash, before, n) for each training word: the classes of words before it, with their bigram counts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                tokens, train, sizes = _arrays(row)
                before = np.append(END, _sequence(classes(row)[tokens].astype(np.int64), sizes, END)[:-1])
                kind = _sequence(tokens.astype(np.int64), sizes, -1)
                use = np.repeat(train, sizes + 1) & (kind >= 0)
                found, n = np.unique(kind[use] * CLASSES + before[use], return_counts=True)
                yield pd.DataFrame({
                    "hash": np.asarray(row.hashes, np.int64)[found // CLASSES], "before": (found % CLASSES).astype(np.int32), "n": n})

    pairs = blocks.mapInPandas(count, "hash long, before int, n long")
    sums = pairs.groupBy("hash", "before").agg(F.sum("n").alias("n"))
    return sums.groupBy("hash").agg(F.collect_list(F.struct("before", "n")).alias("w")).select(
        "hash", F.col("w.before").alias("before"), F.col("w.n").alias("n"))


def _flat(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each word, context and count of each entry) of a batch of profiles."""
    sizes = batch["before"].map(len).to_numpy()
    return np.cumsum(sizes) - sizes, np.concatenate(batch["before"].tolist()), np.concatenate(batch["n"].tolist())


def _best(begin: np.ndarray, before: np.ndarray, n: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The class of each word: where its contexts are likeliest."""
    smooth = matrix[:, 1:] + PRIOR  # [context, class]; the class of text ends takes no words
    return 1 + np.argmax(np.add.reduceat(n[:, None] * np.log(smooth / smooth.sum(0))[before], begin), 1)


def _telling(begin: np.ndarray, before: np.ndarray, n: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The first class of each word: the context that stands out most, against how common contexts are."""
    value = n * weight[before]
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(n))))
    top = np.lexsort((before, -value, of))[begin]
    return np.where(value[top] > 0, before[top], 1)


def _moved(profiles: DataFrame, choose: Callable, model: np.ndarray) -> np.ndarray:
    """Counts [class before, class] with every word in the class that ``choose`` gives it."""

    def move(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            if len(batch):
                begin, before, n = _flat(batch)
                own = np.repeat(choose(begin, before, n, model), np.diff(np.append(begin, len(n))))
                np.add.at(total, before * CLASSES + own, n)
        yield pd.DataFrame({"k": np.arange(len(total)), "n": total})

    return _summed(profiles.mapInPandas(move, "k int, n long"))


def _summed(parts: DataFrame) -> np.ndarray:
    flat = np.zeros(CLASSES * CLASSES)
    for r in parts.groupBy("k").agg(F.sum("n").alias("n")).collect():
        flat[r["k"]] = r["n"]
    return flat.reshape(CLASSES, CLASSES)


def exchange(profiles: DataFrame, matrix: np.ndarray | None = None, steps: int = EXCHANGES) -> DataFrame:
    """(hash, class) of every training word after some rounds of moving each word to its best class.

    All words move at once against the matrix of the round before; the driver holds that matrix only.
    Without a first ``matrix`` words start in the class of their most telling context.
    """
    if matrix is None:
        common = np.ones(CLASSES)
        for r in profiles.select(F.explode(F.arrays_zip("before", "n")).alias("w")).groupBy(
            F.col("w.before").alias("k")
        ).agg(F.sum("w.n").alias("n")).collect():
            common[r["k"]] += r["n"]
        matrix = _moved(profiles, _telling, np.where(np.arange(CLASSES) > 1, 1 / common, 0))
    for _ in range(steps - 1):
        matrix = _moved(profiles, _best, matrix)

    def final(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"hash": batch["hash"], "class": _best(*_flat(batch), matrix).astype(np.int32)})

    return profiles.mapInPandas(final, "hash long, class int")


def attached(blocks: DataFrame, counted: DataFrame, classes: DataFrame) -> DataFrame:
    """Blocks with the classes and counts of their words (columns of CLASSED), stored; each meets its own words only.

    Words are gathered per block first and stored, two short arrays, so that the blocks themselves move once.
    """
    placed = counted.where("c > 0").join(classes, "hash").select("block", "place", "c", "class")

    def gather(found: pd.DataFrame) -> pd.DataFrame:
        n = int(found["place"].max()) + 1
        own, c = np.ones(n, np.uint8), np.zeros(n, np.int64)
        own[found["place"].to_numpy()] = found["class"].to_numpy()
        c[found["place"].to_numpy()] = found["c"].to_numpy()
        return pd.DataFrame({"block": found["block"].iloc[:1], "own": [own.tobytes()], "c": [c.tobytes()]})

    marks = materialize(placed.groupBy("block").applyInPandas(gather, "block long, own binary, c binary"), "marks", "zstd")
    tidy(blocks.sparkSession)

    def attach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = batch["hashes"].map(len)
            for name, kind, rest in (("own", np.uint8, 1), ("c", np.int64, 0)):
                known = [np.frombuffer(x or b"", kind) for x in batch[name]]
                batch[name] = [np.append(k, np.full(m - len(k), rest, kind)).tobytes() for k, m in zip(known, n)]
            yield batch[CLASSED.names]

    met = blocks.drop("counts").join(marks, "block", "left").mapInPandas(attach, CLASSED)
    classed = materialize(met, "classed", "zstd")
    release(marks)
    return classed


def transitions(blocks: DataFrame) -> np.ndarray:
    """Training counts [class before, class], text ends included."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for row in batch.itertuples():
                tokens, train, sizes = _arrays(row)
                seen = _sequence(_own(row)[tokens].astype(np.int64), sizes, END)
                before = np.append(END, seen[:-1])
                use = np.repeat(train, sizes + 1)
                total += np.bincount(before[use] * CLASSES + seen[use], minlength=len(total))
        yield pd.DataFrame({"k": np.arange(len(total)), "n": total})

    return _summed(blocks.select("tokens", "train", "sizes", "own").mapInPandas(count, "k int, n long"))


class Classes:
    """The class of every training word, a table (hash, class); ``classes[keys]`` looks up a few words (1 if unknown)."""

    def __init__(self, table: DataFrame):
        self.table = table

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        key = F.col("hash").bitwiseAND(F.lit(TYPES - 1))
        rows = self.table.where(key.isin(keys.tolist())).select(key.alias("key"), "class").collect()
        found = {r["key"]: r["class"] for r in rows}
        return np.array([found.get(k, 1) for k in keys.tolist()], np.int64)


@dataclass
class Model:
    """Everything scoring needs; arrays are of fixed size, words and their classes stay in tables."""

    tokens: int  # N, text ends included
    types: int  # V, the text end included
    ends: int
    classes: Classes
    blocks: DataFrame  # of CLASSED
    steps: np.ndarray  # log10 P(class | class before)
    unknown: np.ndarray  # log10 P(a certain unknown word | class before)
    sizes: np.ndarray  # words by class

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1) / (self.tokens + self.types + 1))


def fit(blocks: DataFrame, counted: DataFrame) -> Model:
    """Learn classes, transitions and emissions from the training documents of ``blocks``."""
    words_of = counted.where("first AND c > 0").select("hash", "c")
    total, kinds = words_of.select(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = blocks.select(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0

    # First contexts: the most frequent words have a class each, all others share one.
    top = sorted((r["hash"], k + 2) for k, r in enumerate(words_of.orderBy(F.desc("c"), "hash").limit(CLASSES - 2).collect()))
    keys, numbers = np.array([h for h, _ in top], np.int64), np.array([k for _, k in top], np.int64)

    def first(row) -> np.ndarray:
        hashes = np.asarray(row.hashes, np.int64)
        if not len(keys):
            return np.ones(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, numbers[at], 1)

    used = ("tokens", "hashes", "train", "sizes")
    profiles = materialize(profile(blocks.select(*used), first), "profile")
    tidy(blocks.sparkSession)
    classes = materialize(exchange(profiles), "classes")
    release(profiles)
    classed = attached(blocks, counted, classes)
    release(classes)
    profiles = materialize(profile(classed.select(*used, "own"), _own), "profile")
    tidy(blocks.sparkSession)
    classes = materialize(exchange(profiles, transitions(classed)), "classes")
    release(profiles, classed)
    classed = attached(blocks, counted, classes)
    counts = transitions(classed)
    step = (counts + PRIOR) / (counts + PRIOR).sum(1, keepdims=True)
    sizes, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in classes.join(words_of, "hash").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        sizes[r["class"]], types[r["class"]] = r["n"], r["v"]
    spare = np.where(sizes > 0, DISCOUNT * types / np.maximum(sizes, 1), 1.0)
    spare[END] = 0
    return Model(total + ends, kinds + (ends > 0), ends, Classes(classes), classed, np.log10(step),
                 np.log10(step @ spare / max(kinds, 1)), sizes)


SCORES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("held_out", T.BooleanType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("n_known", T.LongType()),
    T.StructField("train_tokens", T.LongType()),
    T.StructField("base_score", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("perplexity", T.DoubleType()),
])


def score(model: Model) -> DataFrame:
    """Scores of all documents of the model's blocks, those to learn from and the others."""

    blocks = model.blocks.drop("block", "hashes")
    model = replace(model, classes=None, blocks=None)

    def scored(block: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for row in block.itertuples():
            tokens, train, sizes = _arrays(row)
            c, own = np.frombuffer(row.c, np.int64), _own(row).astype(np.int64)
            known = c > 0
            emitted = np.log10(np.where(known, c - DISCOUNT, 1) / np.where(known, np.maximum(model.sizes[own], 1), 1))
            seen = _sequence(np.where(known, own, -1)[tokens], sizes, END)
            # The context is the class of the last known word, or the start of the text.
            last = np.maximum.accumulate(np.where(seen >= 0, np.arange(len(seen)), -1))
            before = np.append(END, seen[np.maximum(last, 0)][:-1])
            before[before < 0] = END
            p = model.steps[before, np.maximum(seen, 0)] + _sequence(emitted[tokens], sizes, 0)
            p = np.where(seen >= 0, p, model.unknown[before])
            base = _sequence(model.base(c)[tokens], sizes, 0)
            at_end = np.cumsum(sizes + 1) - 1
            base[at_end] = model.base(np.array(model.ends))
            hit = _sequence(known[tokens].astype(np.int64), sizes, int(model.ends > 0))
            cut = at_end - sizes
            total = np.add.reduceat(p, cut)
            base_total = np.add.reduceat(base, cut)
            if not model.tokens:
                total = base_total
            rows.append(pd.DataFrame({
                "doc_id": pd.array(list(row.doc_ids), "Int64"), "held_out": ~train, "n_tokens": sizes + 1,
                "n_known": np.add.reduceat(hit, cut), "train_tokens": model.tokens, "base_score": base_total,
                "score": total, "perplexity": 10 ** np.minimum(300, -total / (sizes + 1)),
            }))
        return pd.concat(rows, ignore_index=True) if rows else pd.DataFrame(columns=SCORES.names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(scored, batches)

    return blocks.mapInPandas(run, SCORES)


def score_documents(docs: DataFrame, train: Column) -> DataFrame:
    """Train on the rows marked by ``train`` and score all.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams with one added),
    score (log10 probability under the class model) and perplexity.  The base model spreads its probability over the
    training words, the text end and one entry for all unknown words; the class model takes it that
    there are as many unseen words as seen ones, each as likely.  A null text is
    empty and scores its end alone; repeated rows are scored as often as they come; other
    columns are not read; without training rows both scores are 0, an empty table gives no rows.
    """
    blocks = materialize(to_blocks(docs, train), "blocks", "zstd")
    counted = materialize(counted_words(blocks), "counted", "zstd")
    tidy(docs.sparkSession)
    model = fit(blocks, counted)
    release(blocks, counted)
    return score(model)
