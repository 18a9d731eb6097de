"""Words of a batch of texts as numpy arrays: places, hashes, and hashes of runs of words.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. Everything works on the bytes of a whole batch at once; a batch is cut
into pieces of a bounded number of bytes first.
"""

import numpy as np
import pyarrow as pa

PIECE_BYTES = 4 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20_240_501)
VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
VALUE[65:91] = VALUE[97:123]
VALUE[SPACE] = 0
BASE, STEP = _rng.integers(1, 2**62, 2, dtype=np.uint64) * np.uint64(4) + np.uint64(3)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits under which every bit of the input moves every bit of the output."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def pieces(batches, column: str = "text", limit: int = PIECE_BYTES):
    """``(rows, data, offsets)``: slices of Arrow batches whose texts hold about ``limit`` bytes, or one longer text."""
    for batch in batches:
        text = batch.column(column).cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi


def words(data: np.ndarray, offsets: np.ndarray):
    """``(start, end, doc)`` of every word; words end where their text ends."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from its lowered bytes and its length."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    place = np.arange(len(data), dtype=np.int64)[start[0]:end[-1]]
    place = np.minimum(place - np.repeat(start, np.diff(np.append(start, end[-1]))), size.max() - 1)
    value = VALUE[data[start[0]:end[-1]]] * powers(BASE, int(size.max()))[place]
    return mix(np.add.reduceat(value, start - start[0]) ^ size.astype(np.uint64))


def run_hashes(word: np.ndarray, doc: np.ndarray, n: int, short: bool = True):
    """``(hash, doc)`` of every run of ``n`` words of a text; with ``short``, a text of fewer words is one run."""
    if not len(word):
        return word, doc
    code = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for j in range(n):
        code = mix(code * STEP + word[j:len(word) - n + 1 + j])
    keep = doc[:len(code)] == doc[n - 1:n - 1 + len(code)]
    runs, owner = code[keep], doc[:len(code)][keep]
    if short:
        ids, first, count = np.unique(doc, return_index=True, return_counts=True)
        for d, at, k in zip(*(x[count < n] for x in (ids, first, count))):
            one = np.array([k], np.uint64)
            for h in word[at:at + k]:
                one = mix(one * STEP + h)
            runs, owner = np.append(runs, one), np.append(owner, d)
    return runs, owner


def distinct_runs(runs: np.ndarray, owner: np.ndarray):
    """Sorted by text and hash, each once."""
    order = np.lexsort((runs, owner))
    runs, owner = runs[order], owner[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    return runs[new], owner[new]
