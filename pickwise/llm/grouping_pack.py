"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands.

Documents become pieces of at most ``capacity`` tokens; full pieces are sequences of their own, the others are items to be packed.
Items are dealt by a hash of their number into blocks of about ``block_items``; each block is one packing problem. An individual is a
grouping of a block's items into bins. Crossover injects whole well-filled bins of one parent into the other, drops the bins that held
any of their items, and best-fits what was displaced. Every block evolves on several islands, each a Spark task; after each epoch the
populations are written and an island's elite moves to the next island. An island rests once it has met the lower bound.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pickwise.session import cut_lineage

CAPACITY, END_ID, BLOCK_ITEMS = 1024, 2, 16_384
CACHE_ENTRIES, CACHE_CHARS = 500_000, 40


@dataclass(frozen=True)
class Genetic:
    """Population and effort of one island; ``inject`` is the share of a parent's bins that crossover may take over."""

    islands: int = 2
    epochs: int = 2
    population: int = 4
    generations: int = 16
    inject: float = 0.5
    seed: int = 11


# ---- pieces -------------------------------------------------------------------------------------------------------------------

_BREAK = re.compile(r"(?<=\S) ")
_RUN = re.compile(r"\s ")
_ENCODERS: dict[str, "Encoder"] = {}


class _Words(dict):
    """Ids, as little-endian 32-bit bytes, of the parts of a text; computed once per distinct part."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(self.before + part)
        ids = pack_ids(f"<{len(ids)}I", *ids)
        if len(part) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[part] = ids
        return ids


def _part_encoder(path: str):
    """text -> ids by the tokenizers library, or by tiktoken with the ranks of the same file, whose calls cost a third as much.

    The latter needs a byte-level vocabulary with the well-known split pattern, whose ids are the order of its merges.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model = json.loads(tokenizer.to_str())
    vocab, merges, before = model["model"]["vocab"], model["model"].get("merges", []), model.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not model.get("normalizer")
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    if plain and [vocab[m] for m in joined] == list(range(256, 256 + len(joined))):
        import tiktoken
        from public_tokenizers import PATTERN

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in k): v for k, v in vocab.items() if v < 256 + len(joined)}
        return tiktoken.Encoding("parts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the letters from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _added_tokens(path: str) -> tuple[dict[str, bytes], bool]:
    """The file's added tokens with their ids, and whether all are plain strings: found as they stand, and nothing around them."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file).get("added_tokens") or []
    plain = not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
    return {a["content"]: pack_ids("<I", a["id"]) for a in added if a["content"]}, plain


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them.

    A text is cut at the file's added tokens first, as the library does by default: each is one id. The vocabulary's pattern never lets
    a piece run from a non-space character into the space after it, so what lies between may be cut at every such space and its parts
    encoded, and remembered, one by one.
    """

    def __init__(self, path: str):
        encode = _part_encoder(path)
        self.first, self.rest = _Words(encode, ""), _Words(encode, " ")
        self.added, plain = _added_tokens(path)
        names = sorted(self.added, key=len, reverse=True)
        self.find = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.library = None
        if not plain:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def __call__(self, text: str) -> bytes:
        if self.find is None or not self.find.search(text):
            return self._between(text)
        if self.library is not None:
            ids = self.library.encode(text, add_special_tokens=False).ids
            return pack_ids(f"<{len(ids)}I", *ids)
        parts = self.find.split(text)
        return b"".join(self.added[part] if k % 2 else self._between(part) for k, part in enumerate(parts))

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        parts = _BREAK.split(text) if _RUN.search(text) else text.split(" ")
        if parts[0] == "" and len(parts) > 1:  # the text starts with a space
            parts[:2] = [" " + parts[1]]
        return self.first[parts[0]] + b"".join(map(self.rest.__getitem__, parts[1:]))


_PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32): a document's ids and the end id, cut from the end into full pieces.

    uid numbers pieces by task and place. NULL text counts as empty, so it is the end id alone; ids and repeated rows are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(tokenizer_path)
        end, uid = END_ID.to_bytes(4, "little"), TaskContext.get().partitionId() << 33
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                ids = encode(text.as_py() or "") + end
                total, at, piece = len(ids) // 4, 0, 0
                stop = (total - 1) % capacity + 1
                while at < total:
                    row = (uid, doc_id, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop]))
                    for column, v in zip(out, row):
                        column.append(v)
                    uid, piece, at, stop = uid + 1, piece + 1, stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if i == 2 else pa.int64()) for i, v in enumerate(out)], names=["uid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _PIECES)


# ---- groupings of one block ---------------------------------------------------------------------------------------------------


def best_fit(sizes: np.ndarray, order, capacity: int, bins: np.ndarray, room: list[tuple[int, int]], count: int) -> int:
    """Puts the items of ``order`` into ``bins`` (item -> bin), each where least room is left over; returns the number of bins.

    ``room`` is the sorted list of (free, bin) of the open bins and is changed.
    """
    for i in order:
        size = int(sizes[i])
        k = bisect_left(room, (size, -1))
        if k == len(room):
            bin_, free = count, capacity
            count += 1
        else:
            free, bin_ = room.pop(k)
        bins[i] = bin_
        if free > size:
            insort(room, (free - size, bin_))
    return count


def complete(sizes: np.ndarray, order, capacity: int) -> np.ndarray:
    """Opens a bin for the first item left of ``order`` and fills its gap with one or two items that fit exactly, or else with the
    largest that fits, until nothing does. Items of equal size are interchangeable, so only their counts are searched."""
    left: dict[int, list[int]] = {}
    for i in reversed(list(order)):
        left.setdefault(int(sizes[i]), []).append(i)
    have = np.zeros(capacity + 1, dtype=bool)
    have[list(left)] = True
    bins = np.full(len(sizes), -1, dtype=np.int64)
    count = 0

    def take(size: int) -> None:
        bins[left[size].pop()] = count
        have[size] = bool(left[size])

    for i in order:
        if bins[i] >= 0:
            continue
        # the item itself; equal ones before it are already placed, so it is the next of its size
        gap = capacity - int(sizes[i])
        take(int(sizes[i]))
        while gap > 0:
            if have[gap]:
                take(gap)
                break
            pair = np.flatnonzero(have[1:gap] & have[gap - 1 : 0 : -1])
            pair = pair[(2 * (pair + 1) != gap) | (np.array([len(left.get(int(x) + 1, ())) > 1 for x in pair], dtype=bool))] if len(pair) and have[gap // 2] and gap % 2 == 0 else pair
            if len(pair):
                a = int(pair[-1]) + 1
                take(a)
                take(gap - a)
                break
            fits = np.flatnonzero(have[1 : gap + 1])
            if not len(fits):
                break
            take(int(fits[-1]) + 1)
            gap -= int(fits[-1]) + 1
        count += 1
    return bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No grouping has fewer bins: total size, or items above half the capacity."""
    return int(max(-(-int(sizes.sum()) // capacity), (2 * sizes > capacity).sum()))


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: prefers full bins to even ones."""
    fill = np.bincount(bins, weights=sizes) / capacity
    return float((fill**2).mean()) if len(fill) else 1.0


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, capacity: int, inject: float, rng: np.random.Generator) -> np.ndarray:
    """``a`` with a random choice of the best-filled half of ``b``'s bins injected."""
    fill_b = np.bincount(b, weights=sizes)
    good = np.argsort(-fill_b, kind="stable")[: max(1, len(fill_b) // 2)]
    chosen = np.zeros(len(fill_b), dtype=bool)
    chosen[good[rng.random(len(good)) < inject]] = True
    moved = chosen[b]
    n_a = int(a.max()) + 1
    broken = np.zeros(n_a, dtype=bool)
    broken[a[moved]] = True
    child = np.where(moved, b + n_a, a)
    displaced = np.flatnonzero(broken[a] & ~moved)
    child[displaced] = -1
    names, compact = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = compact
    free = capacity - np.bincount(compact, weights=sizes[child >= 0]).astype(np.int64)
    room = sorted((int(f), i) for i, f in enumerate(free.tolist()) if f > 0)
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")].tolist(), capacity, child, room, len(names))
    return child


def mutate(sizes: np.ndarray, a: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """Empties the worst-filled bin and a few random ones and best-fits their items, largest first."""
    fill = np.bincount(a, weights=sizes)
    gone = np.zeros(len(fill), dtype=bool)
    gone[rng.integers(0, len(fill), max(1, len(fill) // 50))] = True
    gone[int(np.argmin(fill))] = True
    child = a.copy()
    displaced = np.flatnonzero(gone[a])
    child[displaced] = -1
    names, compact = np.unique(child[child >= 0], return_inverse=True)
    child[child >= 0] = compact
    free = capacity - np.bincount(compact, weights=sizes[child >= 0], minlength=len(names)).astype(np.int64)
    room = sorted((int(f), i) for i, f in enumerate(free.tolist()) if f > 0)
    best_fit(sizes, displaced[np.argsort(-sizes[displaced], kind="stable")].tolist(), capacity, child, room, len(names))
    return child


def first_population(sizes: np.ndarray, capacity: int, n: int, rng: np.random.Generator, bound: int) -> list[np.ndarray]:
    """Best fit in decreasing size, exact completion, then both in decreasing blurred size; one individual if it meets the bound."""
    out = []
    for k in range(n):
        blur = sizes if k < 2 else sizes * rng.uniform(0.9, 1.1, len(sizes))
        order = np.argsort(-blur, kind="stable").tolist()
        if k % 2:
            bins = complete(sizes, order, capacity)
        else:
            bins = np.full(len(sizes), -1, dtype=np.int64)
            best_fit(sizes, order, capacity, bins, [], 0)
        out.append(bins)
        if int(bins.max()) + 1 <= bound:
            return [bins]
    return out


def evolve(sizes: np.ndarray, population: list[np.ndarray], capacity: int, g: Genetic, rng: np.random.Generator, bound: int) -> list[np.ndarray]:
    """The population after ``generations`` replacements of its worst member, best first."""
    key = lambda p: (int(p.max()) + 1, -fitness(sizes, p, capacity))
    ranked = sorted(((key(p), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
    for step in range(g.generations):
        if ranked[0][0][0] <= bound:
            break
        i, j = (0, 0) if len(ranked) == 1 else rng.choice(len(ranked), 2, replace=False)
        child = mutate(sizes, crossover(sizes, ranked[i][2], ranked[j][2], capacity, g.inject, rng), capacity, rng)
        ranked.append((key(child), len(population) + step, child))
        ranked = sorted(ranked, key=lambda x: x[:2])[: g.population]
    return [p for _, _, p in ranked]


# ---- blocks and islands on Spark ----------------------------------------------------------------------------------------------

_STATE = "block long, island int, uids binary, sizes binary, groups array<binary>, n_bins int, rest boolean"


def pack(items: DataFrame, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, g: Genetic = Genetic()) -> DataFrame:
    """(uid, sequence_id, offset) for every row of ``items`` (uid, length with 1 <= length <= capacity); uid must be unique.

    A sequence's number is the smallest uid in it; its members lie in order of uid without gaps. Every item is packed.
    """
    n = items.count()
    blocks = max(1, -(-n // block_items))
    dealt = items.select("uid", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))

    def begin(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("uid")
        sizes = pdf["length"].to_numpy(dtype=np.int64)
        bound = lower_bound(sizes, capacity)
        rows = []
        for island in range(g.islands):
            rng = np.random.default_rng([g.seed, int(key[0]), island])
            # the first island also holds the plain best-fit-decreasing grouping; all start from their own blurred orders
            first = first_population(sizes, capacity, g.population, rng, bound)
            count = int(first[0].max()) + 1
            rows.append((key[0], island, pdf["uid"].to_numpy(dtype="<i8").tobytes(), sizes.astype("<i4").tobytes(), [p.astype("<i4").tobytes() for p in first], count, count <= bound))
            if count <= bound:  # nothing is left for the other islands to find
                break
        return pd.DataFrame(rows, columns=["block", "island", "uids", "sizes", "groups", "n_bins", "rest"])

    def epoch(frames):
        import pandas as pd

        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                sizes = np.frombuffer(r.sizes, dtype="<i4").astype(np.int64)
                population = [np.frombuffer(p, dtype="<i4").astype(np.int64) for p in r.groups]
                bound = lower_bound(sizes, capacity)
                if not r.rest:
                    rng = np.random.default_rng([g.seed, int(r.block), int(r.island), len(population), int(r.n_bins)])
                    population = evolve(sizes, population, capacity, g, rng, bound)
                count = int(population[0].max()) + 1
                rows.append((r.block, r.island, r.uids, r.sizes, [p.astype("<i4").tobytes() for p in population], count, bool(count <= bound)))
            yield pd.DataFrame(rows, columns=["block", "island", "uids", "sizes", "groups", "n_bins", "rest"])

    state = cut_lineage(dealt.groupBy("block").applyInPandas(begin, _STATE))
    for _ in range(g.epochs):
        if state.filter(~F.col("rest")).isEmpty():
            break
        state = cut_lineage(_migrate(state, g.islands).repartition("block", "island").mapInPandas(epoch, _STATE))
    best = state.withColumn("r", F.row_number().over(Window.partitionBy("block").orderBy("n_bins", "island"))).filter("r = 1")

    def places(frames):
        import pandas as pd

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                uids, sizes = np.frombuffer(r.uids, dtype="<i8"), np.frombuffer(r.sizes, dtype="<i4").astype(np.int64)
                bins = np.frombuffer(r.group, dtype="<i4")
                order = np.lexsort((uids, bins))
                first = np.r_[True, bins[order][1:] != bins[order][:-1]] if len(order) else np.zeros(0, dtype=bool)
                start = np.flatnonzero(first)
                before = np.cumsum(sizes[order]) - sizes[order]
                run = np.cumsum(first) - 1
                yield pd.DataFrame({"uid": uids[order], "sequence_id": uids[order][start][run], "offset": before - before[start][run]})

    return best.select("uids", "sizes", F.get("groups", F.lit(0)).alias("group")).mapInPandas(places, "uid long, sequence_id long, offset long")


def _migrate(state: DataFrame, islands: int) -> DataFrame:
    """Each island takes the elite of the one before it as one more member."""
    if islands < 2:
        return state
    elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.slice("groups", 1, 1).alias("guest"))
    joined = state.join(elite, ["block", "island"], "left")
    groups = F.array_distinct(F.concat("groups", F.coalesce("guest", F.array().cast("array<binary>"))))
    return joined.select("block", "island", "uids", "sizes", groups.alias("groups"), "n_bins", "rest")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, block_items: int = BLOCK_ITEMS, g: Genetic = Genetic()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs`` (doc_id, text).

    A full piece fills a sequence of its own with a negative number. Empty input gives no rows.
    """
    cut = cut_lineage(pieces(docs, tokenizer_path, capacity))
    placed = pack(cut.filter(F.col("length") < capacity).select("uid", "length"), capacity, block_items, g)
    joined = cut.join(placed, "uid", "left")
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", -F.col("uid") - 1).alias("sequence_id"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
    )
