"""Fingerprints: hashed pair presence, on-bit lists, packed words."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_BITS = 2048
MAX_DISTANCE = 3
# Odd multipliers that mix the two token hashes and the distance of a pair.
LEFT_MIX, RIGHT_MIX, DISTANCE_MIX = 1031, 733, 379
PIECE = 1 << 22  # bytes of text whose pairs are made at a time
TABLE = 1 << 20  # bits of the texts of a piece
_ROWS = 1024


def has_pair(text: Column) -> Column:
    """At least two tokens; found without splitting the text, so a filter on it is cheap anywhere in a plan."""
    return F.coalesce(text.rlike(r"\S\s+\S"), F.lit(False))


def pair_lists(texts: pa.Array, n_bits: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, how many a text) of ``pair_bits``."""
    kind = np.int32 if max(len(texts), LEFT_MIX + RIGHT_MIX) * n_bits + max_distance * DISTANCE_MIX < 1 << 31 else np.int64
    split = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts), dtype=kind) * n_bits, split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()).to_numpy(zero_copy_only=False).tolist()
    code = coded.indices.to_numpy()
    if b"" in words:  # white space at an end leaves an empty token
        kept = code != words.index(b"")
        code, owner = code[kept], owner[kept]
    digests = np.frombuffer(b"".join([md5(w).digest() for w in words]), ">u4")[::4]
    h = (digests % n_bits).astype(kind)[code]
    left, right, keys = h * LEFT_MIX, h * RIGHT_MIX, []
    for distance in range(1, max_distance + 1):
        bits = (left[:-distance] + right[distance:] + distance * DISTANCE_MIX) % n_bits
        keys.append((owner[:-distance] + bits)[owner[:-distance] == owner[distance:]])
    key = np.concatenate(keys)
    place = np.arange(len(key), dtype=np.int32)
    first = np.full(len(texts) * n_bits, len(key), np.int32)
    np.minimum.at(first, key, place)
    key = key[first[key] == place]
    owner = key // n_bits
    return (key % n_bits)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(texts))


def pieces(texts: pa.Array, chars: int, rows: int) -> Iterator[pa.Array]:
    """Slices of at most ``rows`` texts and about ``chars`` bytes; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + chars, side="right"))))
        yield texts.slice(at, to - at)
        at = to


def pair_bits(text: Column, n_bits: int = N_BITS, max_distance: int = MAX_DISTANCE, packed: bool = False) -> Column:
    """Distinct on-bits of all token pairs up to ``max_distance`` apart, over the whole token list, in the order of their first pair: all
    pairs next to each other come first.

    Every token is hashed once; a pair's bit mixes its two token hashes and the distance with integer arithmetic, which costs far less
    than hashing the text of each pair. Texts are worked on piece by piece, all pairs of a piece at a time. With ``packed`` a struct of
    the list, ``fp``, and its ``packed_bytes``, ``packed``.
    """
    rows = max(1, TABLE // n_bits)

    @F.arrow_udf("struct<fp: array<int>, packed: binary>" if packed else "array<int>")
    def bits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            parts = [pair_lists(p, n_bits, max_distance) for p in pieces(batch, PIECE, rows)]
            flat = np.concatenate([np.empty(0, np.int32), *[p[0].astype(np.int32) for p in parts]])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *[p[1] for p in parts]]))])
            lists = pa.ListArray.from_arrays(ends.astype(np.int32), flat)
            yield pa.StructArray.from_arrays([lists, pack(lists, n_bits)], names=["fp", "packed"]) if packed else lists

    return bits(text)


def fingerprint(rows: DataFrame, text: str = "text", n_bits: int = N_BITS, max_distance: int = MAX_DISTANCE, packed: bool = False) -> DataFrame:
    """``fp`` (on-bits), ``popcount`` and ``valid``; a row with fewer than two tokens has no pairs. ``packed`` adds the bits as bytes."""
    valid = has_pair(F.col(text))
    bits = F.when(valid, pair_bits(F.col(text), n_bits, max_distance, packed))
    marked = rows.withColumn("valid", valid)
    if packed:
        marked = marked.withColumn("_bits", bits).withColumn("packed", F.col("_bits.packed")).withColumn("fp", F.col("_bits.fp")).drop("_bits")
    else:
        marked = marked.withColumn("fp", bits)
    return (
        marked
        .withColumn("popcount", F.when(F.col("valid"), F.size("fp")))
    )


def positive_bits(vector: Column) -> Column:
    """On-bits of a dense vector: the positions with a value above zero."""
    places = F.transform(vector, lambda x, i: F.when(x > 0, i))
    return F.filter(places, lambda i: i.isNotNull())


def packed_words(bits: Column, n_bits: int = N_BITS) -> Column:
    """On-bits packed into 64-bit words, 32 words for 2048 bits."""
    def word(w: Column) -> Column:
        mine = F.filter(bits, lambda b: F.floor(b / 64).cast("int") == w)
        return F.aggregate(mine, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(b, F.lit(64)).cast("int"))))

    return F.transform(F.sequence(F.lit(0), F.lit(n_bits // 64 - 1)), word)


def on_bits(part: pa.ListArray, width: int) -> np.ndarray:
    """On-bit lists as a 0/1 matrix; numbers beyond the width, and NULL among the bits, set nothing."""
    lengths = np.diff(part.offsets.to_numpy())
    at, flat = np.repeat(np.arange(len(part)) * width, lengths), part.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
    if len(flat) and (flat.min() < 0 or flat.max() >= width):
        inside = (flat >= 0) & (flat < width)
        at, flat = at[inside], flat[inside]
    dense = np.zeros(len(part) * width, dtype=np.uint8)
    dense[at + flat] = 1
    return dense.reshape(len(part), width)


def pack(lists: pa.ListArray, n_bits: int) -> pa.Array:
    """On-bit lists as bytes, a NULL list as NULL."""
    rows = [np.packbits(on_bits(lists.slice(i, _ROWS), n_bits), axis=1, bitorder="little") for i in range(0, len(lists), _ROWS)]
    data = pa.py_buffer(np.concatenate(rows).tobytes() if rows else b"")
    whole = pa.Array.from_buffers(pa.binary(-(-n_bits // 8)), len(lists), [None, data]).cast(pa.binary())
    return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.binary()))


def packed_bytes(bits: Column, n_bits: int = N_BITS) -> Column:
    """On-bit lists as bytes, the lowest bit first: an eighth of a list's length and read as one value. NULL stays NULL."""

    @F.arrow_udf("binary")
    def packed(part: pa.Array) -> pa.Array:
        return pack(part, n_bits)

    return packed(bits)


def unpacked(part: pa.Array, n_bits: int) -> np.ndarray:
    """Packed bytes as a 0/1 matrix."""
    if part.null_count:
        raise ValueError("a candidate has no features")
    width = -(-n_bits // 8)
    if not len(part):
        return np.empty((0, n_bits), np.uint8)
    even = part.cast(pa.binary(width))  # fails on bytes of another length
    data = np.frombuffer(even.buffers()[1], np.uint8)[even.offset * width : (even.offset + len(even)) * width]
    return np.unpackbits(data.reshape(len(even), width), axis=1, count=n_bits, bitorder="little")


def bit_lists(packed: Column) -> Column:
    """Packed bytes as on-bit lists in rising order. NULL stays NULL."""

    @F.arrow_udf("array<int>")
    def lists(part: pa.Array) -> pa.Array:
        bits = [None if v is None else np.flatnonzero(np.unpackbits(np.frombuffer(v, np.uint8), bitorder="little")).astype(np.int32) for v in part.to_pylist()]
        return pa.array(bits, pa.list_(pa.int32()))

    return lists(packed)


def invalid_report(fingerprints: DataFrame, key: str, sample: int = 20) -> DataFrame:
    """How many rows had no usable fingerprint, and the first few of their ids."""
    bad = fingerprints.filter(~F.col("valid"))
    ids = bad.select(key).orderBy(key).limit(sample).agg(
        F.array_join(F.array_sort(F.collect_list(F.col(key))), ",").alias("ids")
    )
    return bad.agg(F.count(F.lit(1)).alias("n_invalid")).withColumn("invalid_ids", ids.scalar())
