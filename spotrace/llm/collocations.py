"""Phrase mining: which runs of two to four words occur together more often than their parts suggest.

Every run of words has a Rabin-Karp fingerprint.  With a word's hash as its digit, prefix sums of digit times power
give the fingerprint of any run as a difference of two sums, for all runs of a block of texts in a few array operations;
powers of an odd base have inverses modulo 2**64, which shift all runs to the same power.

The corpus is read once per length.  A task counts the fingerprints of its runs, Spark adds the counts up, and the
fingerprints that are frequent enough mark the bits of a filter of bounded size.  A longer run is counted only if both of its
shorter runs pass that filter: a filter says yes too often, never no, so no frequent run is lost, however full
it is.  In a last reading, a task holds the pointer of each frequent fingerprint's first occurrence, compares all its
other occurrences with the text there, and writes text only for these; counts are then added up by text, so neither
collisions nor filters can change them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spotrace.llm import words
from spotrace.session import materialize

LONGEST = 4
MIN_COUNT = 30
# Documents that contain a phrase in 80 of 100 cases inside a longer one do not need it.
COVERED_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
# Bits of a filter for each frequent fingerprint, and of a filter at most (32 MB).
BITS_EACH, MOST_BITS = 16, 1 << 28
# Bits of one row of Spark's bitmap aggregate (fixed value).
BITMAP_BITS = 32_768
# Parts in which the best of a language are first looked for.
PARTS = 32
SLICE_BYTES = 6_000_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}
# Bytes that end a piece and bytes between words (fixed values).
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(2 * n, base, np.uint64)
        known[0] = 1
        _POWERS[base] = known = np.multiply.accumulate(known)
    return known[:n]


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[list[str], list[bytes]]]:
    """Bounded runs of (languages, texts); a longer text is cut where a piece ends."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_py() or b""
            at = 0
            while at < len(raw):
                end = len(raw)
                if end - at > most:
                    stops = np.flatnonzero(_BREAK[np.frombuffer(raw, np.uint8, most, at)])
                    if len(stops):
                        end = at + int(stops[-1]) + 1
                if texts and size + end - at > most:
                    yield langs, texts
                    langs, texts, size = [], [], 0
                langs.append(lang)
                texts.append(raw[at:end])
                size += end - at
                at = end
    if texts:
        yield langs, texts


class Runs:
    """The runs of words of a few texts, by fingerprint."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = words.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        offsets = np.cumsum([0, *map(len, texts)])
        stop, space = _BREAK[data], _SPACE[data]
        inside = ~(stop | space)
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        opens[borders] = inside[borders]
        closes[borders - 1] = inside[borders - 1]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.data, self.space = data, space
        code, self.langs = pd.factorize(np.array(langs, object))
        first = np.searchsorted(self.starts, offsets)
        self.lang = np.repeat(code, np.diff(first))
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        piece = np.cumsum(stop, dtype=np.int32)[self.starts]
        self.n = len(self.starts)
        # Whether words i and i + 1 belong to one piece.
        linked = np.zeros(self.n, bool)
        linked[:-1] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        self.linked = linked
        digits = words.hash_spans(data, self.starts, self.ends)
        self.sums = np.append(np.uint64(0), np.cumsum(digits * _powers(_BASE, self.n)))
        names = [np.frombuffer(lang.encode("utf-8", "surrogatepass"), np.uint8) for lang in self.langs]
        salts = [words.hash_spans(x, np.array([0]), np.array([len(x)]))[0] if len(x) else np.uint64(7) for x in names]
        self.salt = np.array(salts, np.uint64)[self.lang] if salts else np.zeros(0, np.uint64)

    def prints(self, width: int, where: np.ndarray) -> np.ndarray:
        """Fingerprints of the runs of ``width`` words at ``where``, apart for each language and width."""
        value = (self.sums[where + width] - self.sums[where]) * _powers(_INVERSE, self.n)[where]
        return words.mix(value + self.salt[where] + np.uint64(width * 0x2545F4914F6CDD1D))

    def passing(self, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each width: where runs may be frequent, by their shorter runs, and their fingerprints.

        A width that has a filter goes through it before the next.
        """
        ok = np.ones(self.n, bool)
        for width in range(1, len(filters) + 2):
            if width > 1:
                ok = ok & np.append(ok[1:], False)[:self.n] & (self.linked if width == 2 else True)
            where = np.flatnonzero(ok)
            found = self.prints(width, where)
            yield where, found
            if width <= len(filters):
                passed = marked(filters[width - 1], found)
                ok = np.zeros(self.n, bool)
                ok[where[passed]] = True

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes in which one space joins the words of a piece, starts, ends)."""
        joined = self.data.copy()
        joined[self.space] = 0x20
        keep = np.ones(len(joined), bool)
        keep[1:] = ~(self.space[1:] & self.space[:-1])
        place = np.cumsum(keep) - 1
        return joined[keep], place[self.starts], place[self.ends - 1] + 1


def marked(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether both bits of each fingerprint are set."""
    out = np.ones(len(prints), bool)
    for place in _places(prints, len(bits) * 8):
        out &= (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _places(prints: np.ndarray, n_bits: int) -> list[np.ndarray]:
    mask = np.uint64(n_bits - 1)
    return [prints & mask, (prints >> np.uint64(32)) & mask]


def _filter(frequent: DataFrame) -> np.ndarray:
    """A filter of the table's fingerprints; its size follows their number up to a bound."""
    n_bits = BITMAP_BITS
    count = frequent.count()
    while n_bits < MOST_BITS and n_bits < BITS_EACH * count:
        n_bits *= 2
    mask = F.lit(n_bits - 1).cast("long")
    places = F.array(F.col("print").bitwiseAND(mask) + 1, F.shiftrightunsigned("print", 32).bitwiseAND(mask) + 1)
    found = frequent.select(F.explode(places).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits")
    )
    out = np.zeros(n_bits // 8, np.uint8)
    step = BITMAP_BITS // 8
    for row in found.collect():  # at most MOST_BITS / BITMAP_BITS rows
        out[(row.bucket - 1) * step:row.bucket * step] = np.frombuffer(row.bits, np.uint8)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col("text").cast("string").cast("binary").alias("text"))


def _each_slice(docs: DataFrame, schema: str, fn: Callable[[Runs], Iterator[pa.RecordBatch]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in _slices(batches):
            runs = Runs(langs, texts)
            if runs.n:
                yield from fn(runs)

    return _texts(docs).mapInArrow(run, schema)


def _counted(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = np.sort(prints)
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return prints[first], np.diff(np.append(first, len(prints)))


def _counts_of_width(docs: DataFrame, filters: list) -> DataFrame:
    """(lang, print, n) summed: fingerprints of the next width without a language, and all words of each language."""

    def count(runs: Runs) -> Iterator[pa.RecordBatch]:
        *_, (_, found) = runs.passing([f.value for f in filters])
        prints, n = _counted(found)
        names = ["lang", "print", "n"]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), pa.array(prints.view(np.int64)), pa.array(n, pa.int64())], names)
        if not filters:
            total = np.bincount(runs.lang, minlength=len(runs.langs))
            yield pa.RecordBatch.from_arrays([pa.array(list(runs.langs), pa.string()), pa.nulls(len(total), pa.int64()), pa.array(total, pa.int64())], names)

    return _each_slice(docs, "lang string, print long, n long", count).groupBy("lang", "print").agg(F.sum("n").alias("n"))


def _differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which spans of bytes differ, eight bytes at a time."""
    differ = size_a != size_b
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))
    left = np.flatnonzero(~differ & (a != b))
    at = 0
    while len(left):
        mask = words.FIRST_BYTES[np.minimum(size_a[left] - at, 8)]
        other = ((eight[a[left] + at] ^ eight[b[left] + at]) & mask) != 0
        differ[left[other]] = True
        at += 8
        left = left[~other & (size_a[left] > at)]
    return differ


def _phrases_of(runs: Runs, filters: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    data, starts, ends = runs.spans()
    for width, (where, found) in enumerate(runs.passing(filters), 1):
        if width > LONGEST:
            break
        passed = marked(filters[width - 1], found)
        where, found = where[passed], found[passed]
        if not len(where):
            continue
        of, _ = pd.factorize(found)
        begin, size = starts[where], ends[where + width - 1] - starts[where]
        while True:
            pointer = np.empty(of.max() + 1, np.int64)
            pointer[of[::-1]] = np.arange(len(of))[::-1]
            at = pointer[of]
            differ = _differing(data, begin, begin[at], size, size[at]) | (runs.lang[where] != runs.lang[where[at]])
            if not differ.any():
                break
            of, _ = pd.factorize(of.astype(np.int64) * 2 + differ)  # other text under the same fingerprint
        n = np.bincount(of)
        s, z = begin[pointer], size[pointer]
        stops = np.cumsum(z)
        chars = data[np.arange(int(stops[-1])) + np.repeat(s - stops + z, z)]
        offsets = np.append(0, stops).astype(np.int64)
        text = pa.LargeStringArray.from_buffers(len(z), pa.py_buffer(offsets), pa.py_buffer(chars)).cast(pa.string())
        lang = pa.DictionaryArray.from_arrays(pa.array(runs.lang[where[pointer]]), pa.array(list(runs.langs), pa.string())).cast(pa.string())
        widths = pa.array(np.full(len(z), width, np.int32))
        yield pa.RecordBatch.from_arrays([lang, text, widths, pa.array(n, pa.int64())], ["lang", "phrase", "width", "n"])


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, width, a) of all runs of one to four words with at least ``min_count`` occurrences, and (lang, n).

    Runs five readings and stores their results in the shared folder.
    """
    spark = docs.sparkSession
    filters = []
    for width in range(1, LONGEST + 1):
        counted = _counts_of_width(docs, filters)
        if width == 1:
            first = materialize(counted.where((F.col("n") >= min_count) | F.col("print").isNull()), "words")
            totals, frequent = first.where("print IS NULL").select("lang", "n"), first.where("print IS NOT NULL")
        else:
            frequent = materialize(counted.where(F.col("n") >= min_count).select("print"), "prints")
        filters.append(spark.sparkContext.broadcast(_filter(frequent)))
    found = _each_slice(docs, "lang string, phrase string, width int, n long", lambda runs: _phrases_of(runs, [f.value for f in filters]))
    summed = found.groupBy("lang", "phrase", "width").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
    return materialize(summed, "phrases"), totals


def scored(phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score and the largest count of a longer phrase around it, for phrases of two words and more."""
    many = phrases.where("width >= 2")
    cuts = many.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("width") - 1)).alias("k"), "width")
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - width)").alias("tail"),
    )
    # A part's count is kept by the part's own text, so each lookup is a join on (lang, part).
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    tails = phrases.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r"))
    known = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    score = F.expr(f"(cast(a AS decimal(20, 0)) * {SCALE}BD) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0)))")
    own = known.select("lang", "phrase", F.struct(score.alias("score"), "k", "a", "l", "r").alias("cut"), F.lit(None).cast("long").alias("around"))
    longer = many.where("width >= 3").withColumn("w", F.split("phrase", " ")).select(
        "lang",
        F.explode(F.expr(
            "flatten(transform(sequence(2, width - 1), m -> transform(sequence(1, width - m + 1), s -> array_join(slice(w, s, m), ' '))))"
        )).alias("phrase"),
        F.lit(None).cast(own.schema["cut"].dataType).alias("cut"), F.col("a").alias("around"),
    )
    best = own.union(longer).groupBy("lang", "phrase").agg(F.min("cut").alias("cut"), F.max("around").alias("around"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score", "around")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased.  Pieces end at ``.,;:!?`` and at bytes 0x0A to 0x0D, words at spaces and tabs.  A phrase of two to
    four words with a >= ``min_count`` occurrences is cut where its score, floor(2000000 a / (l + r)), is least; it is left out if
    a longer phrase around it has at least ``covered_percent`` of its occurrences.  Order: score and a descending,
    phrase ascending.  Null texts are empty, a null lang is ``und``; repeated rows count as often as they come;
    columns other than lang and text are not read; no rows give no rows.
    """
    phrases, totals = frequent_phrases(docs, min_count)
    left = scored(phrases).where(F.col("around").isNull() | (100 * F.col("around") < covered_percent * F.col("a")))
    order = "score DESC, a DESC, phrase ASC"
    # First the best of each part of a language, so that no task sorts a whole language.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    some = left.withColumn("part", part).withColumn("place", F.expr(f"row_number() OVER (PARTITION BY lang, part ORDER BY {order})"))
    some = some.where(F.col("place") <= top).withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang ORDER BY {order})"))
    return some.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
