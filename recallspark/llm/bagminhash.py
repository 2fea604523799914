"""BagMinHash signatures of multisets of word shingles, many texts at a time with numpy.

For register i, think of a Poisson process of points over time and weight: an element of weight w
sees the points below w, and the register keeps the earliest point of all elements. Two multisets
keep the same point with a probability that is exactly their weighted Jaccard similarity,
sum of least counts / sum of largest counts.

All registers of an element are drawn as one process of SIZE times the rate, its points dealt to
registers by hash. The weight axis is cut into the blocks [0, 1), [1, 2), [2, 4), [4, 8), ...: an
element of weight w needs about log2(w) blocks, and only the points of its last block have to be
tried against w. A text's processes stop at the time by which all its registers are filled; each
point depends on the element alone, never on the text or on that time.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import offsets_of, ragged

SIZE = 125
BANDS, ROWS = 25, 5
U = np.uint64
MASK = (1 << 64) - 1
GOLDEN = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_hashes(codes: np.ndarray, words: list[str], offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each shingle in turn, offsets of the texts): a text of 1 to width - 1 words has one shingle, of all."""
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words))
    word = np.concatenate([hashed[codes], np.zeros(width - 1, U)])
    size = np.diff(offsets)
    count = np.where(size >= width, size - width + 1, np.minimum(size, 1))
    at = ragged(np.arange(len(codes)), offsets[:-1], count)
    room = np.repeat(offsets[1:], count)
    h = np.zeros(len(at), U)
    for k in range(width):
        h = mix(h * U(3) + np.where(at + k < room, word[at + k], U(0)) + GOLDEN)
    return h, offsets_of(count)


def fingerprints(codes: np.ndarray, words: list[str], offsets: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each text's sequence of words."""
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), U, len(words))[codes]
    place = np.arange(len(codes), dtype=np.int64) - np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for seed in (U(1), U(0xD1B54A32D192ED03)):
        each = mix(mix(hashed + seed) + place.astype(U) * GOLDEN)
        total = np.zeros(len(codes) + 1, U)
        np.cumsum(each, out=total[1:])
        out.append(total[offsets[1:]] - total[offsets[:-1]])
    return np.stack(out, axis=1).view(np.int64)


def bags(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, count) of the distinct shingles of each text; up to 65,536 texts. Elements are 48 bits."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)).astype(U)
    key = np.sort(text << U(48) | hashes >> U(16))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    return (key[at] >> U(48)).astype(np.int64), key[at] & U((1 << 48) - 1), np.diff(np.append(at, len(key)))


def signatures(text: np.ndarray, element: np.ndarray, count: np.ndarray, texts: int) -> np.ndarray:
    """texts x SIZE registers (32-bit); zeros for a text without elements."""
    sig = np.zeros(texts * SIZE, np.uint32)
    weight = np.bincount(text, count, texts)
    span = np.full(texts, np.log(SIZE) + 6.0)  # expected points of a register by the end
    todo = weight > 0
    while todo.any():
        on = todo[text]
        t, e, w = text[on], element[on], count[on]
        end = span[t] / weight[t]
        best = np.full(texts * SIZE, np.inf)
        keys, times, ids = [], [], []
        block = 0
        while len(t):
            low, width = (0, 1) if block == 0 else (1 << (block - 1), 1 << (block - 1))
            now, seed = np.zeros(len(t)), mix(e * U(129) + U(block * int(GOLDEN) & MASK))
            live, step = np.arange(len(t)), 0
            while len(live):
                draw = mix(seed[live] + U(step * 0xD6E8FEB86659FD93 & MASK))
                now = now - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (SIZE * width)
                stay = now < end[live]
                live, now, draw = live[stay], now[stay], draw[stay]
                other = mix(draw + GOLDEN)
                below = low + (other >> U(40)).astype(np.float64) * 2.0**-24 * width < w[live]
                keys.append(t[live][below] * SIZE + (other[below] & U(0xFFFF)).astype(np.int64) * SIZE // 65536)
                times.append(now[below])
                ids.append((mix(other[below]) >> U(32)).astype(np.uint32))
                step += 1
            more = w > low + width
            t, e, w, end, block = t[more], e[more], w[more], end[more], block + 1
        key, time, point = np.concatenate(keys), np.concatenate(times), np.concatenate(ids)
        np.minimum.at(best, key, time)
        won = time == best[key]
        sig[key[won]] = point[won]
        # a text with an empty register is drawn again for longer: the same points, and later ones
        todo &= np.isinf(best.reshape(texts, SIZE)).any(axis=1)
        span = np.where(todo, span * 2, span)
    return sig.reshape(texts, SIZE)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """texts x BANDS 64-bit keys, different from band to band."""
    out = np.zeros((len(sig), BANDS), U)
    for b in range(BANDS):
        h = np.full(len(sig), (b + 1) * int(GOLDEN) & MASK, U)
        for r in range(ROWS):
            h = mix(h ^ sig[:, b * ROWS + r].astype(U))
        out[:, b] = h
    return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two bags (sorted elements, counts)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - least
    return least / total if total else 0.0


SKETCH = 1024  #: hashes of a text's sketch


def sketch(elements: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The SKETCH least 64-bit hashes of a bag's occurrences (element and its number), sorted.

    The Jaccard similarity of two bags' occurrences is their weighted Jaccard similarity; a sketch
    of fewer than SKETCH hashes holds them all.
    """
    each = np.repeat(elements.view(U), counts)
    number = np.arange(len(each)) - np.repeat(offsets_of(counts)[:-1], counts)
    return np.sort(mix(each + number.astype(U) * GOLDEN))[:SKETCH]


def overlaps(own: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(common, all) hashes of one sketch and each of the others, up to where both are complete."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    flat, at = np.concatenate(others), offsets_of(sizes)
    reach = np.where(sizes < SKETCH, U(MASK), flat[np.maximum(at[1:] - 1, 0)])
    if len(own) >= SKETCH:
        reach = np.minimum(reach, own[-1])
    inside = flat <= np.repeat(reach, sizes)
    place = np.searchsorted(own, flat)
    same = inside & (own[np.minimum(place, len(own) - 1)] == flat)
    running = np.zeros((2, len(flat) + 1), np.int64)
    np.cumsum(np.stack([inside, same]), axis=1, out=running[:, 1:])
    theirs, common = running[:, at[1:]] - running[:, at[:-1]]
    return common, theirs + np.searchsorted(own, reach, side="right") - common
