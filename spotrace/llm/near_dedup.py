"""Near-duplicate documents by HyperMinHash sketches, banding and verification on full shingle sets.

A sketch has 128 registers.  A shingle's hash picks a register; the least remainder there is
kept as the count of its leading zeros and ten bits behind the leading one.  Empty registers
borrow from a pseudo-random filled one.  Documents that agree on a band of four registers are
candidates.  Registers also estimate the similarity, corrected for chance collisions; what can still
reach the threshold is confirmed on the full sets.

Equal sets are folded first.  Within a bucket, pairs are not listed.  First a few members are compared with
all others.  Then, where few members stay outside the largest group found, these are
compared with all others; where many do, the buckets part by rare shingles.  Who stays outside the largest
group of a large part is compared with all of it by blocks of sets, of which only the links come out.
Every pair of a bucket is thus
confirmed, refuted, joined through others, or too far apart by its rare shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import graph, words
from spotrace.session import broadcast_if_small, materialize, release

WIDTH = 5
PERCENT = 75
REGISTERS = 128
BAND = 4  # four registers of 16 bits fill one 64-bit key; (1 - 0.75**4)**32 is 5e-6
MANTISSA = 10
PIVOTS = 8
WHOLE = 2_000  # pairs of a bucket that are compared at once
MARGIN = 6.0  # standard deviations of the estimate below the threshold that are still verified
BLOCK = 256  # sets that are compared with as many others at once
SLOTS = 1 << 18  # of the table that orders shingles by how often they come
COLUMNS = 8_192

_ONE = np.uint64(1)


def registers_of(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """One row of 16-bit registers for each set of distinct shingle hashes; an empty set has zeros."""
    n = len(begin) - 1
    of = np.repeat(np.arange(n), np.diff(begin))
    place = of * REGISTERS + (hashes >> np.uint64(57)).astype(np.int64)
    rest = words.mix(hashes) | _ONE
    least = np.full(n * REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    order = np.lexsort((rest, place))
    first = np.append(True, place[order][1:] != place[order][:-1]) if len(order) else np.zeros(0, bool)
    least[place[order][first]] = rest[order][first]
    filled = np.zeros(n * REGISTERS, bool)
    filled[place] = True
    # Leading zeros, and the bits behind the leading one.
    low = (least & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (least >> np.uint64(32)).astype(np.float64)
    length = np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)
    behind = np.where(
        length > MANTISSA, least >> np.maximum(length - 1 - MANTISSA, 0).astype(np.uint64),
        least << np.maximum(1 + MANTISSA - length, 0).astype(np.uint64),
    ) & np.uint64((1 << MANTISSA) - 1)
    value = (((64 - length).astype(np.uint64) << np.uint64(MANTISSA)) | behind).astype(np.uint16) + np.uint16(1)
    value = np.where(filled, value, 0).astype(np.uint16).reshape(n, REGISTERS)
    filled = filled.reshape(n, REGISTERS)
    # Empty registers look at the same pseudo-random places in every sketch, until a filled one is found.
    some = filled.any(1)
    attempt = 0
    empty = ~filled & some[:, None]
    while empty.any():
        row, column = np.nonzero(empty)
        attempt += 1
        seed = column.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)
        target = (words.mix(seed) >> np.uint64(57)).astype(np.int64)
        good = filled[row, target]
        row, column, target = row[good], column[good], target[good]
        value[row, column] = value[row, target]
        empty[row, column] = False
    return value


def distinct_sets(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text begins."""
    n = len(begin) - 1
    of = np.repeat(np.arange(n), np.diff(begin))
    order = np.lexsort((hashes, of))
    of, hashes = of[order], hashes[order]
    new = np.append(True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])) if len(of) else np.zeros(0, bool)
    return hashes[new], np.append(0, np.cumsum(np.bincount(of[new], minlength=n)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = words.LOWER[data]
    starts, ends, first = words.word_spans(data, offsets)
    return distinct_sets(*words.shingle_hashes(words.hash_spans(data, starts, ends), first, WIDTH))


SKETCHES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("s1", T.LongType()),
    T.StructField("s2", T.LongType()),
    T.StructField("registers", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
])


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.append(np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64))
    return total[begin[1:]] - total[begin[:-1]]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set size, two sums that tell sets apart, registers and band keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in words.text_blocks(batches, "doc_id", "text"):
            hashes, begin = shingle_sets(data, offsets)
            registers = registers_of(hashes, begin)
            packed = registers.view("<u8").reshape(len(keys), -1)
            bands = words.mix(packed + np.arange(packed.shape[1], dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
            flat = np.arange(len(keys) + 1, dtype=np.int32) * bands.shape[1]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array(np.diff(begin).astype(np.int64)),
                pa.array(_sums(words.mix(hashes), begin).view(np.int64)),
                pa.array(_sums(words.mix(hashes ^ np.uint64(0xA0761D6478BD642F)), begin).view(np.int64)),
                pa.array([r.tobytes() for r in registers], pa.binary()),
                pa.ListArray.from_arrays(flat, bands.reshape(-1).view(np.int64)),
            ], SKETCHES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCHES)


def full_sets(docs: DataFrame) -> DataFrame:
    """doc_id and the sorted shingle hashes (little-endian) of every document."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("members", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, data, offsets in words.text_blocks(batches, "doc_id", "text"):
            hashes, begin = shingle_sets(data, offsets)
            held = hashes.astype("<u8").tobytes()
            rows = [held[8 * s:8 * e] for s, e in zip(begin.tolist(), begin[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(rows, pa.binary())], schema.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from two sketches, or rows of them, less the share of registers that agree by chance."""
    agree = np.count_nonzero(a == b, axis=-1) / REGISTERS
    # Two independent registers agree with this chance: over all leading-zero counts, 4**-z, times 2**-mantissa.
    chance = (1 / 3) * 2.0 ** -MANTISSA
    return (agree - chance) / (1 - chance)


def close(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs that can reach the threshold by their sizes and sketches."""
    one = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("registers").alias("ra"))
    two = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("registers").alias("rb"))
    joined = pairs.join(two, "b").join(one, "a").withColumn("least", F.least("na", "nb")).where(
        100 * F.col("least") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ra, rb = (
                np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
            least = np.minimum(REGISTERS, batch.column(4).to_numpy(zero_copy_only=False))
            spread = MARGIN * np.sqrt(percent / 100 * (1 - percent / 100) / least)
            yield batch.select(["a", "b"]).filter(pa.array(estimate(ra, rb) >= percent / 100 - spread))

    return joined.select("a", "b", "ra", "rb", "least").mapInArrow(run, "a long, b long")


def sets_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, members) of the ``texts`` that a stored table of ids names; a short table goes to the texts."""
    return full_sets(texts.join(broadcast_if_small(ids), "id", "left_semi").select(F.col("id").alias("doc_id"), "text"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) pairs whose full sets reach the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb"))
    joined = pairs.join(two, "b").join(one, "a").select("a", "b", "ma", "mb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for ma, mb in zip(batch["ma"], batch["mb"]):
                n, m = len(ma) // 8, len(mb) // 8
                both = len(np.intersect1d(np.frombuffer(ma, "<u8"), np.frombuffer(mb, "<u8"), assume_unique=True))
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    return joined.mapInPandas(run, "a long, b long")


def intersections(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """How many members each set of ``one`` has in common with each of ``two``."""
    kinds, place = np.unique(np.concatenate(two), return_inverse=True)
    flat = np.concatenate(one)
    at = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
    hit = kinds[at] == flat
    used, at = np.unique(at[hit], return_inverse=True)
    row = np.repeat(np.arange(len(one)), [len(x) for x in one])[hit]
    column = np.full(len(kinds), -1)
    column[used] = np.arange(len(used))
    place = column[place]
    other = np.repeat(np.arange(len(two)), [len(x) for x in two])[place >= 0]
    place = place[place >= 0]
    parts = []
    for rows, columns in ((row, at), (other, place)):
        order = np.argsort(columns, kind="stable")
        parts.append((rows[order], columns[order]))
    total = np.zeros((len(one), len(two)), np.int64)
    for s in range(0, len(used), COLUMNS):
        tables = []
        for (rows, columns), n in zip(parts, total.shape):
            lo, hi = np.searchsorted(columns, [s, s + COLUMNS])
            table = np.zeros((n, min(COLUMNS, len(used) - s)), np.float32)
            table[rows[lo:hi], columns[lo:hi] - s] = 1
            tables.append(table)
        total += (tables[0] @ tables[1].T).astype(np.int64)
    return total


def linked_by_blocks(rows: DataFrame, shares: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the members outside the largest group of a bucket with all members of other groups there.

    A block of members and a block of those outside meet in one task; no pair of them is a row.
    """
    blocks = shares.select("bucket", "main", *(F.ceil(F.col(k) / BLOCK).alias(k) for k in ("others", "all")))
    held = rows.select("bucket", "id", "g").join(blocks, "bucket").join(sets.withColumnRenamed("doc_id", "id"), "id")
    lot = F.xxhash64("id")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    own = ["id", "g", "members"]
    all_of = held.select("bucket", F.pmod(lot, "all").alias("x"), every("others").alias("y"), F.lit(False).alias("out"), *own)
    outside = held.where("g <> main").select(
        "bucket", every("all").alias("x"), F.pmod(lot, "others").alias("y"), F.lit(True).alias("out"), *own)

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        one, two = block[~block["out"]], block[block["out"]]
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        both = intersections(*([np.frombuffer(m, "<u8") for m in t["members"]] for t in (one, two)))
        n, m = (t["members"].map(len).to_numpy() // 8 for t in (one, two))
        linked = 100 * both >= percent * (n[:, None] + m - both)
        i, j = np.nonzero(linked & (one["g"].to_numpy()[:, None] != two["g"].to_numpy()))
        # One link of a member with each group there says as much as all of them.
        found = pd.DataFrame({"a": one["id"].to_numpy()[i], "b": two["id"].to_numpy()[j], "g": two["g"].to_numpy()[j]})
        return found.drop_duplicates(["a", "g"])[["a", "b"]]

    return all_of.union(outside).groupBy("bucket", "x", "y").applyInPandas(compare, "a long, b long").distinct()


def _same_bucket(reps: DataFrame) -> DataFrame:
    """(bucket, id, n) of the members of buckets that hold more than one set, and how many those are."""
    members = reps.select("id", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    return members.join(shared, "bucket").select("bucket", "id", "n")


def _grouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(bucket, id, degree, g): members with the group found so far."""
    return members.join(groups, members["id"] == groups["node"], "left").select(
        "bucket", "id", "degree", F.coalesce("component", "id").alias("g"))


def _shares(left: DataFrame) -> DataFrame:
    """(bucket, main, others, all): of each bucket with several groups, the largest group and who is outside."""
    sizes = left.groupBy("bucket", "g").agg(F.count("*").alias("n"))
    return sizes.groupBy("bucket").agg(
        F.max_by("g", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others"), F.sum("n").alias("all")
    ).where("others > 0")


def _few(left: DataFrame) -> DataFrame:
    """(bucket, pivot, pg): up to eight members of each bucket with several groups.

    Small groups come first; of these, members that meet most others in all their buckets, as
    the text that the others were copied from does.
    """
    sizes = left.groupBy("bucket", "g", F.pmod(F.xxhash64("id"), F.lit(PIVOTS)).alias("slot")).agg(
        F.count("*").alias("n"), F.min(F.struct((-F.col("degree")).alias("d"), "id")).alias("m"))
    several = sizes.groupBy("bucket").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("bucket")
    return sizes.groupBy("bucket", "slot").agg(F.min(F.struct("n", "m", "g")).alias("p")).join(several, "bucket").select(
        "bucket", F.col("p.m.id").alias("pivot"), F.col("p.g").alias("pg"))


def _pairs(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """(a, b): every pivot with the members of other groups in its bucket."""
    met = rows.join(pivots, "bucket").where("g <> pg")
    return met.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How often shingles come in all ``sets``, by slots of their hashes; a table of fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for m in batch["members"]:
                np.add.at(total, _slots(np.frombuffer(m, "<u8")), 1)
        slots = np.flatnonzero(total)
        yield pd.DataFrame({"slots": [slots.astype("<i4").tobytes()], "n": [total[slots].astype("<i8").tobytes()]})

    total = np.zeros(SLOTS, np.int64)
    for r in sets.select("members").mapInPandas(count, "slots binary, n binary").toLocalIterator():
        total[np.frombuffer(r["slots"], "<i4")] += np.frombuffer(r["n"], "<i8")
    return total


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


def _by_rare_shingles(crowded: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """(bucket, id) of finer buckets: sets that share one of their rarest shingles, by counts among all these sets.

    Two sets of n and m shingles that reach the threshold have ``percent * (n + m) / (100 + percent)`` or more in
    common.  With ``o`` for the least of that over the sets in a set's buckets, both have one of their
    first n - o + 1 shingles in common when sorted alike, so no pair is lost; sets with too much of
    their own have none to share.  Only these first shingles become rows.  Any order that is the same for all sets
    will do, so counts are kept by slots of hashes.
    """
    size = (F.length("members") / 8).cast("long")
    sized = crowded.join(candidates.select(F.col("doc_id").alias("id"), size.alias("n")), "id")
    least = sized.groupBy("bucket").agg(F.min("n").alias("m"))
    met = sized.join(least, "bucket").groupBy("id").agg(F.min("m").alias("m"))
    sets = met.join(candidates.select(F.col("doc_id").alias("id"), "members"), "id")
    partner = F.greatest("m", F.ceil(size * percent / 100))
    common = F.ceil((size + partner) * percent / (100 + percent))
    times = _frequencies(candidates).astype(np.int32)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in range(0, len(batch), 500):
                part = batch.iloc[s:s + 500]
                first = []
                for m, n in zip(part["members"], part["prefix"]):
                    hashes = np.frombuffer(m, "<u8")
                    first.append(hashes[np.lexsort((hashes, times[_slots(hashes)]))[:max(int(n), 0)]].view("<i8"))
                yield pd.DataFrame({
                    "bucket": np.concatenate(first), "id": np.repeat(part["id"].to_numpy(), [len(x) for x in first])})

    each = materialize(
        sets.select("id", "members", (size - common + 1).alias("prefix")).mapInPandas(spread, "bucket long, id long"),
        "shingles")
    seen = each.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1").select("bucket")
    return each.join(seen, "bucket").distinct()


def _unmet(rows: DataFrame, pivots: DataFrame, groups: DataFrame) -> DataFrame:
    """Members that have not been compared with all of their bucket, with their groups."""
    asked = pivots.select("bucket", F.col("pivot").alias("id"))
    return _grouped(rows.select("bucket", "id", "degree").join(asked, ["bucket", "id"], "left_anti"), groups)


def _outside(rows: DataFrame, shares: DataFrame) -> DataFrame:
    """(bucket, pivot, pg): the members outside the largest group of their bucket."""
    return rows.join(shares, "bucket").where("g <> main").select(
        "bucket", F.col("id").alias("pivot"), F.col("g").alias("pg"))


def _together(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """(node, component) with the links and the groups found before, both stored and deleted here."""
    known = links if groups is None else links.union(
        groups.select(F.col("node").alias("a"), F.col("component").alias("b")))
    found = materialize(graph.components(known, "a", "b"), "groups")
    release(links, groups)
    return found


def link_groups(sketched: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(n, s1, s2, component_id): the group of each distinct shingle set that has one."""
    shape = ["n", "s1", "s2"]
    known = sketched.where("n > 0 AND doc_id IS NOT NULL")
    reps = materialize(
        known.groupBy(*shape).agg(F.min(F.struct("doc_id", "registers", "bands")).alias("r"))
        .select(*shape, F.col("r.doc_id").alias("id"), "r.registers", "r.bands"), "sets")
    members = materialize(_same_bucket(reps), "members")
    degrees = members.groupBy("id").agg(F.sum("n").alias("degree"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def stored_sets(ids: DataFrame) -> DataFrame:
        ids = materialize(ids.distinct(), "ids")
        sets = materialize(sets_of(ids, texts), "members")
        release(ids)
        return sets

    def links_of(pairs: DataFrame) -> DataFrame:
        near = materialize(close(pairs, reps, percent), "near")
        sets = stored_sets(near.select("a").union(near.select("b")).toDF("id"))
        links = materialize(verified(near, sets, percent), "links")
        release(near, sets)
        return links

    # A few members of each bucket meet all others.
    left = materialize(members.select("bucket", "id").join(degrees, "id").withColumn("g", F.col("id")), "left")
    pivots = materialize(_few(left), "pivots")
    groups = _together(links_of(_pairs(left, pivots)), None)
    asked_in, left = left, materialize(_unmet(left, pivots, groups), "left")
    release(asked_in)
    shares = materialize(_shares(left), "shares")
    if not shares.isEmpty():
        small = F.col("others") * F.col("all") <= WHOLE
        # Who stays outside meets all; buckets of many groups part into finer ones, of which the large ones are met by blocks.
        few, many = shares.where(small), shares.where(~small).select("bucket")
        crowded = materialize(left.join(many, "bucket").select("bucket", "id"), "crowded")
        sets = stored_sets(crowded.select("id"))
        fine = materialize(
            _grouped(_by_rare_shingles(crowded, sets, percent).join(degrees, "id"), groups), "finer")
        parts = materialize(_shares(fine), "shares")
        pairs = _pairs(left, _outside(left, few)).union(_pairs(fine, _outside(fine, parts.where(small)))).distinct()
        links = links_of(pairs)
        blocks = materialize(linked_by_blocks(fine, parts.where(~small), sets, percent), "links")
        groups = _together(links.union(blocks), groups)
        release(links, blocks, sets, crowded, fine, parts)
    release(left, pivots)
    release(shares, members)
    return reps.join(groups, reps["id"] == groups["node"], "left").select(
        *shape, F.coalesce("component", "id").alias("component_id"))


def deduplicate(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents link when 100 times the common shingles reach ``percent`` times all of both.  A null or empty
    text, or one without words, has no shingles and links with nothing; so does a null doc_id, which keeps
    a null component and is kept.  Rows that repeat a doc_id count as documents of that number.
    Other columns are not read; an empty table gives no rows.  Starts jobs.
    """
    sketched = materialize(sketches(docs), "sketches")
    groups = link_groups(sketched, docs, percent)
    rows = sketched.join(groups, ["n", "s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group, as they came; nulls as in :func:`deduplicate`."""
    gone = deduplicate(docs, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
