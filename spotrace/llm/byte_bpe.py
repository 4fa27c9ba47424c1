"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of parts.  Every adjacent pair that the table can merge waits
in the bucket of its rank, as the position of its left part.  A hierarchy of
64-bit words marks the ranks whose buckets are not empty; find-first-set on each
level yields the lowest rank.  Positions whose pair has changed meanwhile are stale and
skipped.  A long pre-token is worked on alone, part by part, in linear time; short ones lie
in one list with borders between them, so that a bucket merges many of them at once.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import chunked_text

NONE = np.int32(2**31 - 1)
# Pre-tokens of more bytes are worked on alone.
LONG = 200


class Merges:
    """Which adjacent ids merge, with what rank and into what: ``(left, right) -> (rank, id)``."""

    def __init__(self, byte_ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]], names: dict[int, bytes]):
        self.byte_ids = np.array(byte_ids, np.int64)
        self.pairs = pairs
        self.names = [names[i] for i in range(len(names))]
        self.width = len(names) + 1  # the last id stands for "no neighbour"
        keys = np.fromiter((a * self.width + b for a, b in pairs), np.int64, len(pairs))
        rank = np.fromiter((r for r, _ in pairs.values()), np.int32, len(pairs))
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], np.iinfo(np.int64).max), np.append(rank[order], NONE)
        self.n_ranks = int(rank.max()) + 1 if len(rank) else 1
        self.made = np.zeros(self.n_ranks, np.int64)
        for r, made in pairs.values():
            self.made[r] = made

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Byte string -> rank, from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


def merges_of_ranks(content: bytes) -> Merges:
    """Any two parts merge when their joined bytes have a rank, which is also the id."""
    ranks = read_ranks(content)
    pairs = {
        (ranks[t[:i]], ranks[t[i:]]): (r, r)
        for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
    }
    return Merges([ranks[bytes([b])] for b in range(256)], pairs, {r: t for t, r in ranks.items()})


def merges_of_tokenizer(content: bytes) -> Merges:
    """The merge list of a byte-level tokenizer file, its place in the list being the rank."""
    model = json.loads(content)["model"]
    # Byte-level files write bytes as characters: printable Latin-1 as itself, the rest from 256 on (fixed rule).
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    char = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
    byte = {c: b for b, c in char.items()}
    vocab, pairs = model["vocab"], {}
    for rank, merge in enumerate(model["merges"]):
        a, b = merge.split(" ") if isinstance(merge, str) else merge
        pairs[(vocab[a], vocab[b])] = (rank, vocab[a + b])
    names = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in vocab.items()}
    return Merges([vocab[char[b]] for b in range(256)], pairs, names)


class RankQueue:
    """Buckets by rank under a bitmap of 64-way levels."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.levels: list[dict[int, int]] = [{}]
        while ranks > 64:
            ranks = -(-ranks // 64)
            self.levels.append({})

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, marked as filled."""
        found = self.buckets.get(rank)
        if found is None:
            found = self.buckets[rank] = []
            for level in self.levels:
                word = rank >> 6
                old = level.get(word, 0)
                level[word] = old | 1 << (rank & 63)
                if old:
                    break
                rank = word
        return found

    def lowest(self) -> int:
        """The lowest rank with a bucket, or -1."""
        at = 0
        for level in reversed(self.levels):
            word = level.get(at, 0)
            if not word:
                return -1
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def close(self, rank: int) -> None:
        del self.buckets[rank]
        for level in self.levels:
            word = rank >> 6
            left = level[word] & ~(1 << (rank & 63))
            if left:
                level[word] = left
                return
            del level[word]
            rank = word


def encode_long(piece: bytes, merges: Merges) -> list[int]:
    """Ids of one pre-token: always merge the pair of lowest rank, the leftmost first."""
    n = len(piece)
    get = merges.pairs.get
    ids = merges.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    pair = [-1] * n  # rank of the pair that starts at a position, as it is now
    queue = RankQueue(merges.n_ranks)

    def note(i: int, j: int) -> None:
        found = get((ids[i], ids[j]))
        pair[i] = -1 if found is None else found[0]
        if found is not None:
            heappush(queue.bucket(found[0]), i)

    for i in range(n - 1):
        note(i, i + 1)
    while (rank := queue.lowest()) >= 0:
        bucket = queue.buckets[rank]
        # A merge may make a pair of lower rank, which then comes first.
        while bucket and queue.lowest() == rank:
            i = heappop(bucket)
            if pair[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i] = get((ids[i], ids[j]))[1]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                note(i, k)
            if before[i] >= 0:
                note(before[i], i)
        if not bucket:
            queue.close(rank)
    kept, i = [], 0
    while i < n:
        kept.append(ids[i])
        i = after[i]
    return kept


def encode_short(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids, index of the piece of each id) of many pre-tokens; each merges one pair of a rank at a time."""
    data = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(data)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    piece_of = np.repeat(np.arange(len(pieces)), sizes)
    ids = np.append(merges.byte_ids[data], merges.width - 1)
    after = np.arange(1, n + 2)
    before = np.arange(-1, n)
    ends = np.cumsum(sizes)
    after[ends[sizes > 0] - 1] = n  # position n stands for "no neighbour"
    before[(ends - sizes)[sizes > 0]] = n
    alive = np.ones(n, bool)
    pair = np.full(n + 1, NONE)
    byte_pairs = merges.rank_of(
        np.repeat(merges.byte_ids, 256), np.tile(merges.byte_ids, 256)
    ).reshape(256, 256)
    pair[:n - 1] = byte_pairs[data[:-1], data[1:]] if n else NONE
    pair[ends[sizes > 0] - 1] = NONE
    queue = RankQueue(merges.n_ranks)

    def push(at: np.ndarray, rank: np.ndarray) -> None:
        if len(at) <= 4:
            for k, r in enumerate(rank.tolist()):
                queue.bucket(r).append(at[k:k + 1])
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        starts = [0, *cuts.tolist(), len(at)]
        for r, s, e in zip(rank[starts[:-1]].tolist(), starts, starts[1:]):
            queue.bucket(r).append(at[s:e])

    first = np.flatnonzero(pair < NONE)
    push(first, pair[first])
    while (rank := queue.lowest()) >= 0:
        bucket = queue.buckets[rank]
        at = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
        bucket.clear()
        at = at[pair[at] == rank]
        if len(at) > 1:
            of = piece_of[at]
            leading = np.append(True, of[1:] != of[:-1])
            if not leading.all():
                bucket.append(at[~leading])
                at = at[leading]
        if not bucket:
            queue.close(rank)
        if not len(at):
            continue
        j = after[at]
        k, h = after[j], before[at]
        made = merges.made[rank]
        ids[at] = made
        alive[j] = False
        pair[j] = NONE
        after[at] = k
        before[k] = at
        sides = np.concatenate([at, h])
        left = np.concatenate([ids[at], ids[h]])
        right = np.concatenate([ids[k], ids[at]])
        found = merges.rank_of(left, right)
        pair[sides] = found
        known = found < NONE
        if known.any():
            push(sides[known], found[known])
    return ids[:n][alive], piece_of[alive]


class Codec:
    """Encode and decode whole texts with one table of merges."""

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.numbers = [str(i) for i in range(merges.width)]
        self.encode_texts = chunked_text.ChunkEncoder(self._encode_many, pattern)

    def _encode_many(self, chunks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pre-tokens, and where each list ends."""
        pieces = [m.encode("utf-8", "surrogatepass") for ms in chunks for m in ms]
        chunk_of = np.repeat(np.arange(len(chunks)), [len(ms) for ms in chunks])
        long = [i for i, p in enumerate(pieces) if len(p) > LONG]
        apart = {i: encode_long(pieces[i], self.merges) for i in long}
        for i in long:
            pieces[i] = b""
        ids, of = encode_short(pieces, self.merges)
        if apart:
            ids = np.concatenate([ids, *(np.array(apart[i], np.int64) for i in long)])
            of = np.concatenate([of, np.repeat(long, [len(apart[i]) for i in long])])
            order = np.argsort(of, kind="stable")
            ids, of = ids[order], of[order]
        return ids, np.cumsum(np.bincount(chunk_of[of], minlength=len(chunks)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.merges.names.__getitem__, ids))


def texts_of(batch: pd.DataFrame) -> Iterator[tuple[list, list[str]]]:
    """Bounded slices of the first two columns: keys and texts, null texts as empty."""
    keys, texts = batch.iloc[:, 0].tolist(), [t or "" for t in batch.iloc[:, 1].tolist()]
    for s, e in chunked_text.slices(map(len, texts)) if texts else ():
        yield keys[s:e], texts[s:e]


def frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=schema.names)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _on_texts(docs: DataFrame, ranks_path: str, pattern: str, schema: T.StructType, row) -> DataFrame:
    with open(ranks_path, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = chunked_text.kept_in_worker("ranks" + pattern, content.value, lambda c: Codec(merges_of_ranks(c), pattern))
        for batch in batches:
            for keys, texts in texts_of(batch):
                encoded = codec.encode_texts(texts)
                yield frame([(d, *row(codec, e.tolist())) for d, e in zip(keys, encoded)], schema)

    return id_and_text(docs).mapInPandas(run, schema)


DOC = T.StructField("doc_id", T.LongType())


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids of every whole text.

    Special tokens are ordinary text.  A null text counts as empty and has no ids.  Repeated rows stay,
    a null doc_id stays null, other columns are not read.  No document moves between tasks.
    """
    schema = T.StructType([DOC, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _on_texts(docs, ranks_path, pattern, schema, lambda codec, ids: (ids,))


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of rows with ``ids``; null or empty ids decode to nothing."""
    with open(ranks_path, "rb") as file:
        content = encoded.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([DOC, T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {r: t for t, r in read_ranks(content.value).items()}
        for batch in batches:
            yield frame(
                [(d, b"" if ids is None else b"".join(names[i] for i in ids)) for d, ids in zip(batch["doc_id"], batch["ids"])],
                schema,
            )

    return encoded.select("doc_id", "ids").mapInPandas(run, schema)


DIGESTS = T.StructType([
    DOC,
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode every text, decode its ids and return digests of both, in one pass; nulls as in :func:`encode`."""

    def row(codec: Codec, ids: list[int]):
        written = " ".join(map(codec.numbers.__getitem__, ids))
        return len(ids), hashlib.sha256(written.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()

    return _on_texts(docs, ranks_path, pattern, DIGESTS, row)
