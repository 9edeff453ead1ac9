"""Whole Arrow columns of text as numpy arrays: bytes, words, shingles, fingerprints."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_RANDOM = np.random.default_rng(20240229)
BYTE_NAMES = _RANDOM.integers(1, 2**64, (2, 256), dtype=U64, endpoint=False)
_ODD = _RANDOM.integers(0, 2**63, (2, 2), dtype=U64) * U64(2) + U64(1)


def text_bytes(texts):
    """(bytes, offsets) of a string column: text i is bytes[offsets[i]:offsets[i + 1]]; a null
    text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts, most_bytes=1 << 19, most_rows=1000):
    """Row ranges (begin, count) of a string column of at most so many bytes of text each, or
    one row: what is made of a text takes many times its room."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, size in enumerate(sizes):
        if row > begin and (held + size > most_bytes or row - begin >= most_rows):
            yield begin, row - begin
            begin, held = row, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes) - begin


def mix(x):
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def name_pairs(names, offset, family=0):
    """A name for each pair (names[p], names[p + offset])."""
    first = names[:max(0, len(names) - offset)] * _ODD[family, 0]
    first ^= first >> U64(31)
    first += names[offset:] * _ODD[family, 1]
    first ^= first >> U64(29)
    return first


CHUNK = 1 << 15  # positions worked on at a time, whose arrays stay in a core's cache


def chunks(count):
    """Ranges (begin, end) of so many positions, a chunk each."""
    return ((begin, min(begin + CHUNK, count)) for begin in range(0, count, CHUNK))


def name_substrings(data, length, family=0):
    """A 64-bit name for the substring of `length` bytes at each position, by prefix doubling:
    the names of length 1, 2, 4, ... are paired at growing offsets; the last pair overlaps."""
    result = np.empty(max(0, len(data) - length + 1), U64)
    for begin, end in chunks(len(result)):
        names, have = BYTE_NAMES[family][data[begin:end + length - 1]], 1
        while have < length:
            offset = min(have, length - have)
            names = name_pairs(names, offset, family)
            have += offset
        result[begin:end] = names
    return result


def doc_of(offsets, positions):
    return np.searchsorted(offsets, positions, side="right") - 1


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_names(data, offsets, separates=_SPACE):
    """(names, bounds): 64-bit names of the words of all texts, A-Z taken as a-z and words
    separated by the bytes of a table, by default ASCII white space; words of text i are
    names[bounds[i]:bounds[i + 1]]."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    inside = ~separates[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    ends = np.flatnonzero(last) + 1
    # a word's bytes are weighted by their place in the word, so sums over words name them
    lengths = ends - starts
    place = np.arange(n, dtype=np.int64)
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [n]])))
    weighted = BYTE_NAMES[0][_LOWER[data]]
    weighted *= (place.astype(U64) * U64(2) + U64(1)) * _ODD[0, 0]
    weighted ^= weighted >> U64(32)
    weighted *= _ODD[0, 1]
    weighted[~inside] = 0
    total = np.add.reduceat(weighted, starts) if len(starts) else np.zeros(0, U64)
    names = mix(total + lengths.astype(U64) * _ODD[1, 0])
    return names, np.searchsorted(starts, offsets)


def shingle_sets(names, bounds, size=5):
    """The distinct shingles of each text, ascending: one array per text. A text of fewer
    words than `size`, but not none, has all its words as its only shingle."""
    sets = []
    weights = _RANDOM_WEIGHTS[:size]
    n = len(names)
    whole = np.zeros(max(0, n - size + 1), U64)
    for j in range(size):
        whole += mix(names[j:n - size + 1 + j] + U64(j)) * weights[j] if len(whole) else whole
    whole = mix(whole)
    for begin, end in zip(bounds[:-1], bounds[1:]):
        if end - begin >= size:
            sets.append(np.unique(whole[begin:end - size + 1]))
        elif end > begin:
            few = sum(int(mix(names[begin + j:begin + j + 1] + U64(j))[0]) * int(weights[j]) for j in range(end - begin))
            few = np.array([(few + int(end - begin)) % 2**64], U64)
            sets.append(mix(mix(few)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


_RANDOM_WEIGHTS = _RANDOM.integers(0, 2**63, 64, dtype=U64) * U64(2) + U64(1)
