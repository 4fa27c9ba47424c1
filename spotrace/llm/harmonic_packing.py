"""Harmonic packing: lengths fall into classes of reciprocal capacity, and a sequence of class k holds exactly k pieces.

Class k takes the lengths from capacity/(k+1), exclusive, to capacity/k.  A length fits its class when a
full sequence of k such pieces leaves at most ``slack`` places free.  A document gives full sequences first; its
rest is cut, from the front, into the longest lengths that fit, so most rests take two or three pieces and
every filled sequence is nearly full.

Each task fills the sequences of its own rows while it reads them, with no exchange: it holds fewer than k
pieces of each class k at any time, whatever the size of its share.  What is left of all classes at its end is laid out end
to end and cut at full sequences; the last sequence is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spotrace.llm import words

CAPACITY = 4096
END_ID = 2
# Free places that a full sequence of one class may have, as a share of the capacity.
SLACK = 1 / 256
# Words kept by one Python worker (about 200 bytes each); beyond that it starts anew.
REMEMBERED = 700_000
# Longer words, in bytes, are the library's.
LONG_WORD = 60
# Words of one size merged at once.
_AT_ONCE = 4096
# Punctuation of at most this many bytes behind a letter is told from its word.
LONG_TAIL = 8
# ASCII punctuation but the apostrophe, which may join letters (fixed values).
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
# How the added tokens of the file begin (fixed value).
_ADDED = b"<|"
# Longer words, in bytes, are the library's.
LONG_WORD = 60
# Words of one size merged at once.
_AT_ONCE = 4096
# Punctuation of at most this many bytes behind a letter is told from its word.
LONG_TAIL = 8
# ASCII punctuation but the apostrophe, which may join letters (fixed values).
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = True
# How the added tokens of the file begin (fixed value).
_ADDED = b"<|"
# Bytes of text split into words at once (a longer text is worked on alone).
SLICE_BYTES = 4_000_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
    T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("ids", T.BinaryType()),
])
_ARROW = pa.schema([
    (f.name, pa.binary() if f.name == "ids" else pa.int64()) for f in PIECES.fields
])


class WordMerges:
    """Byte-pair merges with word ends for many lower-case words at once.

    Words of one size form a matrix; in each round every word merges its pair of lowest rank, the leftmost first.
    """

    def __init__(self, content: str):
        model = json.loads(content)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        # Byte-level files write bytes as characters: printable Latin-1 as itself, the rest from 256 on (fixed rule).
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        chars = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.width = len(vocab)
        keys = np.array([vocab[x] * self.width + vocab[y] for x, y in pairs], np.int64)
        self.made = np.array([vocab[x + y] for x, y in pairs], np.int32)
        self.none = np.int32(len(pairs))
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.first_ranks = self.rank_of(self.inner[:, None], self.inner)
        self.last_ranks = self.rank_of(self.inner[:, None], self.final)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each row count) for a matrix whose rows are the bytes of words of one size."""
        size, columns = data.shape[1], np.arange(data.shape[1])
        ids = self.inner[data]
        ids[:, -1] = self.final[data[:, -1]]
        ranks = np.full(ids.shape, self.none, np.int32)
        if size > 1:
            ranks[:, :-2] = self.first_ranks[data[:, :-2], data[:, 1:-1]]
            ranks[:, -2] = self.last_ranks[data[:, -2], data[:, -1]]
        n = np.full(len(ids), size)
        out_ids, out_n = np.empty_like(ids), np.empty_like(n)
        rows = np.arange(len(ids))
        while True:
            each = np.arange(len(ids))
            at = np.argmin(ranks, axis=1)
            best = ranks[each, at]
            done = best == self.none
            if done.any():
                out_ids[rows[done]], out_n[rows[done]] = ids[done], n[done]
                if done.all():
                    return out_ids, out_n
                go = ~done
                ids, ranks, n, rows, at, best = ids[go], ranks[go], n[go], rows[go], at[go], best[go]
                each = np.arange(len(ids))
            source = np.minimum(columns + (columns > at[:, None]), size - 1)
            ids, ranks = ids[each[:, None], source], ranks[each[:, None], source]
            made = self.made[best]
            ids[each, at] = made
            n -= 1
            ranks[each, n - 1] = self.none
            right, left = at + 1 < n, at > 0
            ranks[each[right], at[right]] = self.rank_of(made[right], ids[each[right], at[right] + 1])
            ranks[each[left], at[left] - 1] = self.rank_of(ids[each[left], at[left] - 1], made[left])


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[begin:begin + size] of all items, one after another."""
    stops = np.cumsum(size)
    return flat[np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(begin - stops + size, size)]


class WordTokenizer:
    """Whole texts to the ids of the ``tokenizers`` library, each distinct word of a worker once.

    For files whose words never cross ASCII white space: their pattern drops white space and their
    normalizer changes nothing across it, so a text's ids are those of its words one after another.  Punctuation
    behind a letter and before white space is a word of its own.  Words of Latin letters are merged
    here many at once; all others are the library's.  Words are told apart by 64-bit hashes of their bytes.
    """

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.merges = WordMerges(content)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _by_library(self, found: list[bytes]) -> list[np.ndarray]:
        made = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in found], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in made]

    def _learn(self, keys: list[int], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new words and remember them."""
        sizes = ends - starts
        first = np.cumsum(sizes) - sizes
        inside = _gathered(data, starts, sizes)
        after_c3 = np.append(False, inside[:-1] == 0xC3)
        letter = (inside >= 97) & (inside <= 122) | (inside == 0xC3) | after_c3 & (inside >= 0x9F) & (inside <= 0xBF) & (inside != 0xB7)
        simple = np.logical_and.reduceat(letter, first) & (sizes <= LONG_WORD)
        order, made, counts = [], [], []
        for size in np.unique(sizes[simple]).tolist():
            which = np.flatnonzero(simple & (sizes == size))
            for s in range(0, len(which), _AT_ONCE):
                some = which[s:s + _AT_ONCE]
                ids, n = self.merges(data[starts[some, None] + np.arange(size)])
                order.append(some)
                counts.append(n)
                made.append(ids[np.arange(size) < n[:, None]])
        odd = np.flatnonzero(~simple)
        held = data.tobytes() if len(odd) else b""
        by_library = self._by_library([held[s:e] for s, e in zip(starts[odd].tolist(), ends[odd].tolist())])
        order.append(odd)
        counts.append(np.array([len(x) for x in by_library], np.int64))
        size = np.concatenate(counts)
        begin = len(self.flat) + np.cumsum(size) - size
        at = len(self.begin)
        self.known.update(zip([keys[i] for i in np.concatenate(order).tolist()], range(at, at + len(keys))))
        self.flat = np.concatenate([self.flat, *made, *by_library]).astype(np.uint32)
        self.begin, self.size = np.append(self.begin, begin), np.append(self.size, size)

    @staticmethod
    def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-case bytes, starts, ends, first word of each text and the total)."""
        data = words.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        upper = np.append(False, data[:-1] == 0xC3) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
        data[upper] += 0x20
        starts, ends, first = words.word_spans(data, np.cumsum([0, *map(len, texts)]))
        marks = ends.copy()  # where the punctuation that ends a word begins
        for _ in range(LONG_TAIL):
            back = (marks > starts) & _MARK[data[marks - 1]]
            if not back.any():
                break
            marks[back] -= 1
        split = (marks > starts) & (marks < ends) & (data[marks - 1] >= 97) & (data[marks - 1] <= 122)
        n = 1 + split
        place = np.append(0, np.cumsum(n))
        all_starts, all_ends = np.repeat(starts, n), np.repeat(ends, n)
        all_ends[place[:-1][split]] = all_starts[place[:-1][split] + 1] = marks[split]
        return data, all_starts, all_ends, place[first]

    def _by_words(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self._forget()
        data, starts, ends, first = self._words(texts)
        if not len(starts):
            return [b""] * len(texts)
        of, hashes = pd.factorize(words.hash_spans(data, starts, ends))
        sample = np.empty(len(hashes), np.int64)
        sample[of[::-1]] = np.arange(len(of))[::-1]
        keys, known = hashes.tolist(), self.known
        new = [i for i, k in enumerate(keys) if k not in known]
        if new:
            self._learn([keys[i] for i in new], data, starts[sample[new]], ends[sample[new]])
        which = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[of]
        n = self.size[which]
        ids = _gathered(self.flat, self.begin[which], n)
        borders = np.append(0, np.cumsum(n))[first].tolist()
        return [ids[s:e].tobytes() for s, e in zip(borders, borders[1:])]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of UTF-8 texts, whose total size should be bounded."""
        # Added tokens are told from other text by case, so such texts are the library's as they are.
        plain = [t for t in texts if _ADDED not in t]
        by_words = iter(self._by_words(plain))
        return [self._by_library([t])[0].tobytes() if _ADDED in t else next(by_words) for t in texts]


def fitting_lengths(capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """For each length up to ``capacity`` the longest length not above it that fits its class."""
    free = int(capacity * slack)
    best, last = [0], 0
    for length in range(1, capacity + 1):
        if capacity % length <= free:
            last = length
        best.append(last)
    return best


def cut(n_tokens: int, best: list[int]) -> list[int]:
    """Lengths of a document's pieces in order: full sequences, then lengths that fit their classes."""
    capacity = len(best) - 1
    out = [capacity] * (n_tokens // capacity)
    rest = n_tokens % capacity
    while rest:
        out.append(best[rest])
        rest -= best[rest]
    return out


def padded_length(tokens: int, capacity: int = CAPACITY) -> int:
    """What a sequence takes: ``capacity``, unless its tokens are a power of two."""
    return tokens if tokens & (tokens - 1) == 0 else capacity


class Packer:
    """Sequences of one task; pieces are (doc_id, start, doc_tokens, ids as bytes)."""

    def __init__(self, capacity: int, task: int):
        self.capacity = capacity
        self.next = task << 32
        self.waiting: dict[int, list] = defaultdict(list)

    def _laid_out(self, pieces: list) -> list[tuple]:
        sequence, offset, out = self.next, 0, []
        self.next += 1
        for doc_id, start, doc_tokens, ids in pieces:
            n = len(ids) // 4
            out.append((doc_id, start, n, zlib.crc32(ids), doc_tokens, sequence, offset, ids))
            offset += n
        return out

    def add(self, doc_id, start: int, doc_tokens: int, ids: bytes) -> list[tuple]:
        """Take a piece; rows of the sequence that it fills, if it fills one."""
        k = self.capacity // (len(ids) // 4)
        held = self.waiting[k]
        held.append((doc_id, start, doc_tokens, ids))
        if len(held) < k:
            return []
        self.waiting[k] = []
        return self._laid_out(held)

    def rest(self) -> list[tuple]:
        """Rows of all that still waits, cut where sequences end: full ones, then powers of two."""
        pieces = [p for k in sorted(self.waiting) for p in self.waiting[k]]
        left = sum(len(p[3]) for p in pieces) // 4
        sizes = [self.capacity] * (left // self.capacity)
        sizes += [1 << b for b in range(self.capacity.bit_length(), -1, -1) if left % self.capacity >> b & 1]
        out, queue = [], iter(pieces)
        piece = None
        for room in sizes:
            taken = []
            while room:
                doc_id, start, doc_tokens, ids = piece or next(queue)
                taken.append((doc_id, start, doc_tokens, ids[:4 * room]))
                n = len(taken[-1][3]) // 4
                piece = (doc_id, start + n, doc_tokens, ids[4 * n:]) if 4 * n < len(ids) else None
                room -= n
            out += self._laid_out(taken)
        self.waiting.clear()
        return out


_KEPT: dict[str, WordTokenizer] = {}


def _tokenizer(content: str) -> WordTokenizer:
    """One tokenizer for each vocabulary in a Python worker, which serves many tasks."""
    if content not in _KEPT:
        _KEPT.clear()
        _KEPT[content] = WordTokenizer(content)
    return _KEPT[content]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[bytes]]]:
    """Bounded runs of (doc ids, texts as bytes); null texts are empty."""
    keys, texts = [], []
    size = 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        raw = text.as_py() or b""
        if texts and size + len(raw) > SLICE_BYTES:
            yield keys, texts
            keys, texts, size = [], [], 0
        keys.append(key)
        texts.append(raw)
        size += len(raw)
    if texts:
        yield keys, texts


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   keep_ids: bool = True, slack: float = SLACK) -> DataFrame:
    """Encode whole documents, cut them and fill sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with
    ``keep_ids``, ids (little-endian unsigned 32-bit).  Pieces of a document are its ids without gap or overlap.

    ``vocabulary`` is the path of a tokenizer file with word ends, read on the driver; ids are those of the plain
    call with add_special_tokens=False, so the file's added tokens are found in texts too.  A null or empty text
    gives ``end_id`` alone; a null doc_id stays null; repeated rows are packed as often as they come; other
    columns are not read, whatever their names; no rows give no rows.  A document is worked on whole, in one task.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    with open(vocabulary, encoding="utf-8") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())
    end, best = np.array([end_id], "<u4").tobytes(), fitting_lengths(capacity, slack)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = _tokenizer(content.value), Packer(capacity, TaskContext.get().partitionId())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
            if not keep_ids:
                columns[-1] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ARROW.types)], schema=_ARROW)

        for batch in batches:
            for keys, texts in _slices(batch):
                rows = []
                for doc_id, ids in zip(keys, encode(texts)):
                    ids += end
                    n_tokens, start = len(ids) // 4, 0
                    for n in cut(n_tokens, best):
                        rows += packer.add(doc_id, start, n_tokens, ids[4 * start:4 * (start + n)])
                        start += n
                yield batch_of(rows)
        yield batch_of(packer.rest())

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    packed = texts.mapInArrow(pack, PIECES)
    return packed if keep_ids else packed.drop("ids")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """Whole sequences of packed pieces that kept their ids: sequence_id, tokens, padded, ids with the padding.

    A sequence is at most ``capacity`` tokens, so a group is small whatever the documents.
    """
    whole = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    power_of_two = F.expr("tokens & (tokens - 1)") == 0
    padded = F.when(power_of_two, F.col("tokens")).otherwise(F.lit(capacity).cast("long"))
    pad = F.lit(bytearray(np.array([pad_id], "<u4").tobytes()))
    ids = F.concat(F.array_join(F.transform("parts.ids", lambda b: F.hex(b)), ""),
                   F.repeat(F.hex(pad), (F.col("padded") - F.col("tokens")).cast("int")))
    return whole.withColumn("padded", padded).select("sequence_id", "tokens", "padded", F.unhex(ids).alias("ids"))
