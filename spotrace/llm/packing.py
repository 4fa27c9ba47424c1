"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

Each task packs an even share of the pieces.  It takes them from the longest to the
shortest and puts each where, afterwards, the squared counts of open sequences per
residual gap have the smallest sum; a new sequence is opened when the piece fits in
none.  Shares of 8,192 documents waste about 0.05 % of the space (sf0.1); the last sequence of each share may be short.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import byte_bpe, chunked_text

# The split that byte-level tokenizer files name as theirs (fixed value).
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

SEQUENCE_LENGTH = 1024
END_ID = 2
DOCUMENTS_PER_SHARE = 8_192

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])


def cut(n_tokens: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, preceded by the shorter rest."""
    first = n_tokens % limit
    rest = range(first, n_tokens, limit)
    return ([(0, first)] if first else []) + [(s, limit) for s in rest]


def added_tokens(vocabulary: bytes) -> dict[str, int]:
    """Contents and ids of a tokenizer file's added tokens, which the plain call finds in any text."""
    return {t["content"]: t["id"] for t in json.loads(vocabulary).get("added_tokens") or []}


def encode_whole(codec, added: dict[str, int], texts: list[str]) -> Iterator[np.ndarray]:
    """Ids of texts; added tokens are cut out first and what lies between is encoded apart."""
    cut_at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    parts = [cut_at.split(t) if cut_at and any(a in t for a in added) else [t] for t in texts]
    plain = iter(codec.encode_texts([p for ps in parts for p in ps[::2]]))
    for ps in parts:
        found = [next(plain) if k % 2 == 0 else np.array([added[p]], np.uint32) for k, p in enumerate(ps)]
        yield found[0] if len(found) == 1 else np.concatenate(found)


def token_pieces(docs: DataFrame, vocabulary: str, limit: int = SEQUENCE_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids (little-endian unsigned 32-bit).

    ``vocabulary`` is the path of a byte-level tokenizer file, read on the driver; ids are those of the plain
    call with add_special_tokens=False, so its added tokens are found in texts too.
    A null text counts as empty and gives the end id alone; a null doc_id stays null;
    repeated rows are encoded as often as they come; other columns are not read.
    """
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = chunked_text.kept_in_worker(
            "merges", content.value, lambda c: byte_bpe.Codec(byte_bpe.merges_of_tokenizer(c), BYTE_LEVEL)
        )
        end, added = np.array([end_id], "<u4").tobytes(), added_tokens(content.value)
        for batch in batches:
            for keys, texts in byte_bpe.texts_of(batch):
                rows = []
                for doc_id, ids in zip(keys, encode_whole(codec, added, texts)):
                    ids = ids.astype("<u4").tobytes() + end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, limit)):
                        rows.append((doc_id, piece, start, length, ids[4 * start:4 * (start + length)]))
                yield byte_bpe.frame(rows, PIECES)

    return byte_bpe.id_and_text(docs).mapInPandas(encode, PIECES)


def sum_of_squares(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece; ties go to the smallest gap, equal lengths keep their order."""
    sequence = np.empty(len(lengths), np.int64)
    offset = np.empty(len(lengths), np.int64)
    counts = np.zeros(limit + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(limit + 1)]
    used = 0
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        gaps = size + np.flatnonzero(counts[size:limit])
        if len(gaps):
            # Moving a sequence from gap g to g - size changes the sum by this; a filled one leaves it.
            change = 2 * (counts[gaps - size] - counts[gaps] + 1)
            if gaps[0] == size:
                change[0] = 1 - 2 * counts[size]
            gap = int(gaps[np.argmin(change)])
            counts[gap] -= 1
            place = open_at[gap].pop()
        else:
            gap, place = limit, used
            used += 1
        sequence[at], offset[at] = place, limit - gap
        if gap > size:
            counts[gap - size] += 1
            open_at[gap - size].append(place)
    return sequence, offset


def pack(pieces: DataFrame, shares: int, limit: int = SEQUENCE_LENGTH) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``limit``.

    Rows are dealt evenly, whatever their keys, to ``shares`` tasks; each is packed apart, so
    a task holds its own share only.  All columns are kept; columns named like the
    two new ones are replaced.  No rows give no rows.
    """
    taken = pieces.drop("sequence_id", "offset")
    schema = T.StructType([
        *taken.schema.fields,
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        share = TaskContext.get().partitionId()
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held, ignore_index=True)
            sequence, offset = sum_of_squares(rows["length"].to_numpy(), limit)
            rows["sequence_id"] = (np.int64(share) << 32) + sequence
            rows["offset"] = offset
            yield rows

    return taken.repartition(shares).mapInPandas(place, schema)


def shares_of(n_documents: int, per_share: int = DOCUMENTS_PER_SHARE) -> int:
    return max(1, math.ceil(n_documents / per_share))


def pack_documents(docs: DataFrame, vocabulary: str, limit: int = SEQUENCE_LENGTH, end_id: int = END_ID,
                   keep_ids: bool = True) -> DataFrame:
    """Encode, cut and pack whole documents.

    Returns doc_id, piece, start, length, ids (dropped with ``keep_ids=False``), ids_crc32,
    sequence_id, offset.  Counting the documents starts a job.
    """
    pieces = token_pieces(docs, vocabulary, limit, end_id).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces if keep_ids else pieces.drop("ids"), shares_of(docs.count()), limit)
