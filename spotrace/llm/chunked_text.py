"""Cut texts into chunks whose byte-level pre-tokens never cross a border, and remember what each chunk encodes to.

The public byte-level pattern lets a match begin with at most one space and never
lets white space follow other characters inside a match.  Where a text has only
single spaces and single line ends, each between two other characters, every match
therefore starts at such a space, or at a line end and right after it.  Texts
with any other white space are cut by the pattern itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex

from spotrace.llm import words

# Chunks kept by one Python worker (about 200 bytes each); beyond that it starts anew.
REMEMBERED = 1_200_000
# Characters of text worked on at once (a longer text is worked on alone).
SLICE_CHARS = 8_000_000
# ASCII white space other than the space and the line end, and the bytes of wider spaces (fixed values).
_CONTROL = np.zeros(256, bool)
_CONTROL[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True
_WIDE_SPACES = {
    0xC2: [b"\x85", b"\xa0"],
    0xE1: [b"\x9a\x80"],
    0xE2: [c.encode()[1:] for c in map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F])],
    0xE3: [b"\x80\x80"],
}


def slices(lengths: Iterable[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` characters, or of one row."""
    start = held = end = 0
    for end, n in enumerate(lengths):
        if held and held + n > most:
            yield start, end
            start, held = end, 0
        held += n
    if held or start <= end:
        yield start, end + 1


class ChunkEncoder:
    """Encode whole texts chunk by chunk; ``encode_many`` maps lists of pre-tokens to (ids, ends).

    Chunks are told apart by 64-bit hashes of their bytes, so equal ones are encoded once.
    """

    def __init__(self, encode_many: Callable[[list[list[str]]], tuple[np.ndarray, np.ndarray]], pattern: str):
        self.encode_many = encode_many
        # Python also counts four separators (0x1c to 0x1f) as white space, tokenizers do not.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.known: dict[int, bytes] = {}

    def _starts(self, held: bytes, at: np.ndarray) -> np.ndarray:
        """Where chunks start in texts laid end to end, the i-th from at[i] on."""
        data = np.frombuffer(held, np.uint8)
        gap = (data == 32) | (data == 10)
        mark = gap.copy()
        mark[1:] |= data[:-1] == 10
        odd = _CONTROL[data]
        odd[1:] |= gap[1:] & gap[:-1]
        odd[at[:-1]] |= gap[at[:-1]]
        odd[at[1:] - 1] |= gap[at[1:] - 1]
        for lead, rest in _WIDE_SPACES.items():
            for i in np.flatnonzero(data == lead).tolist():
                if held[i + 1:i + 1 + len(rest[0])] in rest:
                    odd[i] = True
        mark[at[:-1]] = True
        for i in np.unique(np.searchsorted(at, np.flatnonzero(odd), side="right") - 1).tolist():
            s, e = int(at[i]), int(at[i + 1])
            found = self.pattern.findall(held[s:e].decode("utf-8", "surrogatepass"))
            sizes = [len(m.encode("utf-8", "surrogatepass")) for m in found]
            mark[s:e] = False
            mark[s + np.cumsum([0, *sizes[:-1]])] = True
        return np.flatnonzero(mark)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts together should have a bounded size, see :func:`slices`."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        parts = [t.encode("utf-8", "surrogatepass") for t in texts if t]
        if not parts:
            return [np.zeros(0, np.uint32) for _ in texts]
        held, at = b"".join(parts), np.cumsum([0, *map(len, parts)])
        starts = self._starts(held, at)
        ends = np.append(starts[1:], len(held))
        hashes, first, of = np.unique(
            words.hash_spans(np.frombuffer(held, np.uint8), starts, ends), return_index=True, return_inverse=True
        )
        keys = hashes.tolist()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            ids, stops = self.encode_many([self.pattern.findall(held[s:e].decode("utf-8", "surrogatepass")) for s, e in spans])
            made, stops = ids.astype("<u4").tobytes(), (4 * stops).tolist()
            self.known.update(zip((keys[i] for i in new), (made[s:e] for s, e in zip([0, *stops], stops))))
        values = [self.known[k] for k in keys]
        flat = np.frombuffer(b"".join(values), "<u4")
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        begin = np.cumsum(size) - size
        n = size[of]
        ends_of_chunk = np.cumsum(n)
        place = np.arange(int(n.sum())) + np.repeat(begin[of] - ends_of_chunk + n, n)
        out = flat[place]
        stops = ends_of_chunk[np.searchsorted(starts, at[1:]) - 1].tolist()
        found = iter([out[s:e] for s, e in zip([0, *stops], stops)])
        return [next(found) if t else out[:0] for t in texts]


_KEPT: dict = {}


def kept_in_worker(kind: str, content: bytes, make):
    """One object for each vocabulary in a Python worker, which serves many tasks."""
    key = (kind, hashlib.sha256(content).hexdigest())
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make(content)
    return _KEPT[key]
