"""PartEnum signatures for the Jaccard join of shingle sets.

Sets fall in bands of like size. Two sets of one band (or of the border of two bands) whose Jaccard similarity reaches the
threshold differ in at most k features, k following from the largest sizes there. The domain of features is
hashed into n1 parts of three sub-parts each, n1 = k // 2 + 1 + spare: more than k // 2 parts cannot hold two
differing features, so at least spare + 1 parts hold at most one, and in each of them two of the three
sub-parts are alike. A signature is the content of two of the three sub-parts; all three pairs are enumerated, so such
sets share a signature in spare + 1 parts at least. A set in which at most spare parts have a pair of empty
sub-parts can therefore leave the signatures of empty pairs out, and no similar set is lost. Other sets leave them out too, and are hashed
anew for more signatures, until a hashing has few empty pairs: of two similar sets, both have the signatures of the first hashing in which
either has few, and meet there. Only what has many in all LEVELS hashings keeps those of the last.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Sizes in a band differ by this factor at most, or by the one that the threshold lets similar sets differ by.
BAND = 1.5
#: Hashings that a set may go through.
LEVELS = 16
#: Parts in a hundred added to the needed ones, and those added always.
SPARE_SHARE, SPARE = 3, 2
GOLD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX
    x = (x ^ (x >> np.uint64(27))) * GOLD
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = 4) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles; of a text with fewer words, that of all its words; none without words.

    Words are parted by blanks and the characters 9 to 13, with A-Z in lower case.
    """
    plain = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), r"[\x20\x09-\x0D]+", " "))
    pieces = pc.split_pattern(plain, " ")
    words = pieces.flatten().dictionary_encode()
    listed = words.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in listed), np.uint64, len(listed))
    place = words.indices.to_numpy(zero_copy_only=False)
    offsets = pieces.offsets.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    h = hashes[place] if len(listed) else np.empty(0, np.uint64)
    blank = listed.index("") if "" in listed else -1
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(h), np.uint64)
        if len(h) >= width:
            rolled = np.zeros(len(h) - width + 1, np.uint64)
            for j in range(width):
                rolled = rolled * np.uint64(0x100000001B3) + mixed(h[j : len(h) - width + 1 + j])
            rolled = mixed(rolled)
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            if b > a and place[a] == blank:  # white space at the ends leaves empty words
                a += 1
            if b > a and place[b - 1] == blank:
                b -= 1
            if b - a >= width:
                out.append(np.unique(rolled[a : b - width + 1]))
            elif b > a:
                whole = np.uint64(b - a)
                for x in h[a:b]:
                    whole = mixed(whole * np.uint64(0x100000001B3) + x)
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def set_id(features: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart, as a number of 63 bits and one of 64 with a sign."""
    whole = xxhash.xxh3_128_intdigest(features.tobytes())
    return (whole >> 64) >> 1, ((whole & (1 << 64) - 1) ^ 1 << 63) - (1 << 63)


def sketch_bits(size: int) -> int:
    """Bits of the sketch of a set: a power of two, at least 64 and twice its size."""
    return max(64, 1 << (2 * size - 1).bit_length())


def sketch(features: np.ndarray) -> bytes:
    """How many features fall on each place, odd or even, in bits. Where the sketches of two sets differ, an odd number of the features that
    only one has falls, so they differ in no more places than the sets in features."""
    bits = sketch_bits(len(features))
    return np.packbits(np.bincount((mixed(features ^ GOLD) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of bits, all as short as the shortest: a place is the sum of those equal to it modulo the shorter length."""
    least = min(map(len, sketches))
    rows = [np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, least), axis=0) for s in sketches]
    return np.unpackbits(np.stack(rows), axis=1)


def pair_may_be_similar(sizes: tuple[int, int], sketches: tuple[bytes, bytes], percent: int) -> bool:
    """may_be_similar() of two sets."""
    a, b = sorted(sketches, key=len)
    if len(a) < len(b):
        b = np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, len(a)), axis=0).tobytes()
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return apart * (100 + percent) <= sum(sizes) * (100 - percent) and 100 * min(sizes) >= percent * max(sizes)


def may_be_similar(sizes: np.ndarray, sketches: list[bytes], percent: int) -> np.ndarray:
    """Whether each pair of sets can be similar, judged by sizes and sketches; never false for a pair that is."""
    bits = folded(sketches).astype(np.float32)
    ones = bits.sum(axis=1)
    apart = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
    both, low, high = sizes[:, None] + sizes[None, :], np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    out = (np.rint(apart).astype(np.int64) * (100 + percent) <= both * (100 - percent)) & (100 * low >= percent * high)
    np.fill_diagonal(out, False)
    return out


@lru_cache(maxsize=None)
def bands(most: int, percent: int) -> tuple[tuple[int, int], ...]:
    """(least, largest) size of each band up to size most. Similar sets are in one band or in neighbouring ones."""
    out, low = [], 1
    while low <= most:
        high = max(int(low * BAND), low * 100 // percent)
        out.append((low, high))
        low = high + 1
    return tuple(out)


@lru_cache(maxsize=None)
def instances(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(number, parts, spare) of the instances in which a set of this size takes part; those where only equal sets can
    be similar are left out. Instance 2i is within band i, 2i + 1 on the border of bands i and i + 1."""
    found = bands(size, percent)
    i = len(found) - 1
    pairs = [(2 * i, 2 * found[i][1])]
    if i and percent * size <= 100 * found[i - 1][1]:
        pairs.append((2 * i - 1, found[i - 1][1] + 100 * found[i - 1][1] // percent))
    if 100 * size >= percent * (found[i][1] + 1):
        pairs.append((2 * i + 1, found[i][1] + 100 * found[i][1] // percent))
    out = []
    for number, both in pairs:
        k = both * (100 - percent) // (100 + percent)
        if k:
            need = k // 2 + 1
            spare = SPARE + need * SPARE_SHARE // 100
            out.append((number, need + spare, spare))
    return tuple(out)


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets."""
    owner, number, parts, spare = [], [], [], []
    for i, s in enumerate(sets):
        for n, p, e in instances(len(s), percent) if len(s) else ():
            owner.append(i)
            number.append(n)
            parts.append(p)
            spare.append(e)
    if not owner:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    now = tuple(np.array(x, np.int64) for x in (owner, number, parts, spare))
    found, owners = [], []
    for level in range(LEVELS):
        sig, of, bare = _hashed(sets, *now, level)
        found.append(sig)
        owners.append(of)
        now = tuple(x[bare] for x in now)
        if not bare.any():
            break
    return np.concatenate(found), np.concatenate(owners)


def _hashed(sets: list[np.ndarray], owner: np.ndarray, number: np.ndarray, parts: np.ndarray, spare: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, index of the set) by one hashing, and which rows have more empty pairs than they may leave out."""
    sizes = np.array([len(sets[i]) for i in owner])
    features = np.concatenate([sets[i] for i in owner])
    begin = np.cumsum(3 * parts) - 3 * parts
    salt = (number + 1 + (level << 20)).astype(np.uint64)
    with np.errstate(over="ignore"):
        spread = mixed(features + np.repeat(salt * GOLD, sizes))
        slot = ((spread >> np.uint64(32)) * np.repeat((3 * parts).astype(np.uint64), sizes)) >> np.uint64(32)
        held = np.zeros(int(3 * parts.sum()), np.uint64)
        np.add.at(held, np.repeat(begin, sizes) + slot.astype(np.int64), mixed(features * GOLD + np.uint64(1)))
        a, b, c = held.reshape(-1, 3).T
        tag = mixed(np.repeat(salt << np.uint64(40), parts) + (np.arange(len(a)) - np.repeat(begin // 3, parts)).astype(np.uint64) * np.uint64(4))
        pairs = np.stack([mixed(mixed(x * GOLD + tag + np.uint64(j)) + y) for j, (x, y) in enumerate(((a, b), (a, c), (b, c)))], axis=1)
    empty = np.stack([(a | b) == 0, (a | c) == 0, (b | c) == 0], axis=1)
    bare = np.add.reduceat(empty.any(axis=1).astype(np.int64), begin // 3) > spare
    keep = ~empty | np.repeat(bare & (level == LEVELS - 1), parts)[:, None]
    return pairs[keep], np.repeat(np.repeat(owner, parts), keep.sum(axis=1)), bare


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)
