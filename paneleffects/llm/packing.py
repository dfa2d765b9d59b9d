"""Best-fit packing of tokenised documents by a grouping genetic algorithm on islands."""

from __future__ import annotations

import gc
import math
import re
import zlib
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tasks import importable, lean, stage
from .text import chunks, raw, words_of

CAPACITY, END_ID = 4096, 1
#: Pieces of one sub-problem, islands that evolve it, individuals of an island, children of
#: an epoch, and epochs between which the elite migrates.
GROUP, ISLANDS, POPULATION, CHILDREN, EPOCHS = 4096, 2, 4, 8, 2
#: Sequences filled less are opened again and packed across sub-problems.
WELL_FILLED = 0.99
#: Distinct words whose ids a task keeps, and bytes of text that it encodes at once.
CACHE_WORDS, BLOCK_BYTES = 400_000, 1 << 19

# A word of these characters is cut into letter runs, digits and other runs whatever stands
# beside it, so its parts can be looked up alone. Apostrophes and "<" are left to the tokenizer.
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
# Byte-level symbols: printable bytes stand for themselves, the others follow from U+0100 on.
_OWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SYMBOLS = "".join(chr(b if b in _OWN else 0x100 + sum(x not in _OWN for x in range(b))) for b in range(256))
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 9, 10, 13]] = False
# Parts of lower-cased words, and the line feeds between words.
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|\n|[^a-z0-9ß-öø-ÿ\n]+")


class Runs:
    """Runs of token ids by number, end to end; number 0 is the empty run."""

    def __init__(self) -> None:
        self.flat, self.used, self.n = np.zeros(1 << 16, np.uint32), 0, 1
        self.begin, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        n, used = self.n + len(sizes), self.used + len(ids)
        while len(self.begin) < n:
            self.begin, self.length = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.length, 2 * len(self.length))
        while len(self.flat) < used:
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:used] = ids
        self.begin[self.n:n] = self.used + np.cumsum(sizes) - sizes
        self.length[self.n:n] = sizes
        self.n, self.used = n, used

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these runs in order, and where each run ends."""
        sizes = self.length[at]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begin[at] - (ends - sizes), sizes)
        return self.flat[place], ends


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The tokenizer of a file, which a worker reads once for all its tasks."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    return tokenizer


class WordIds:
    """Token ids of texts, word by word, with a bounded cache.

    The tokenizer splits at white space and drops it, so a text's ids are those of its words
    in order. Words go by fingerprints of their bytes; each distinct word is encoded once, and
    each distinct part of plain words.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS) -> None:
        self.tokenizer, self.limit = _tokenizer(path), limit
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        self.words: dict[int, int] = {}
        self.parts: dict[str, int] = {"\n": 0}
        self.word_runs, self.part_runs = Runs(), Runs()

    def _merge(self, part: str) -> list[int]:
        """Ids of a part the tokenizer would not cut or change: byte symbols, then its merges."""
        symbols = part if part.isascii() else charmap_decode(part.encode(), "strict", _SYMBOLS)[0]
        return [t.id for t in self.model.tokenize(symbols)]

    @staticmethod
    def _enter(runs: Runs, ids: list[list[int]]) -> np.ndarray:
        """The numbers of runs that join ``runs``."""
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        runs.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        return np.arange(runs.n - len(ids), runs.n)

    def _parts_of(self, words: list[str]) -> np.ndarray:
        """Numbers of the words' parts, 0 between words."""
        items = _PARTS.findall("\n".join(words).lower())
        at = np.fromiter(map(self.parts.get, items, repeat(-1)), np.int64, len(items))
        new = at < 0
        if new.any():
            missing = list(compress(items, new.tolist()))
            parts = list(dict.fromkeys(missing))
            self.parts.update(zip(parts, self._enter(self.part_runs, list(map(self._merge, parts))).tolist(), strict=True))
            at[new] = np.fromiter(map(self.parts.__getitem__, missing), np.int64, len(missing))
        return at

    def _learn(self, words: list[str]) -> np.ndarray:
        """The numbers of new words."""
        plain = np.fromiter(map(bool, map(_PLAIN.fullmatch, words)), bool, len(words))
        out = np.zeros(len(words), np.int64)
        if plain.any():
            at = self._parts_of(list(compress(words, plain.tolist())))
            ids, ends = self.part_runs.take(at)
            ends = np.r_[ends[at == 0], len(ids)]
            self.word_runs.add(ids, np.diff(ends, prepend=0))
            out[plain] = np.arange(self.word_runs.n - len(ends), self.word_runs.n)
        if not plain.all():
            found = self.tokenizer.encode_batch_fast(list(compress(words, (~plain).tolist())), add_special_tokens=False)
            out[~plain] = self._enter(self.word_runs, [e.ids for e in found])
        return out

    def encode_all(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; many short texts at a time cost less than one by one."""
        if len(self.words) > self.limit:
            self.clear()
        found = words_of(texts, _INSIDE, None)
        prints, first, at = np.unique(found.prints, return_index=True, return_inverse=True)
        prints = prints.tolist()
        number = np.fromiter(map(self.words.get, prints, repeat(-1)), np.int64, len(prints))
        new = np.flatnonzero(number < 0)
        if len(new):
            blob, first = raw(texts)[0].tobytes(), first[new]
            spans = zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)
            number[new] = self._learn(b"\n".join([blob[x:y] for x, y in spans]).decode().split("\n"))
            self.words.update(zip([prints[k] for k in new.tolist()], number[new].tolist(), strict=True))
        ids, ends = self.word_runs.take(number[at])
        return np.split(ids, np.r_[0, ends][found.first[1:-1]]) if len(texts) else []

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


PIECES = "row bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"


def _cutter(path: str, capacity: int, with_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(path)
        gc.disable()  # words and ids hold no cycles, and there are many
        for b in batches:
            out: list[list] = [[] for _ in range(5 + with_ids)]
            take = []
            for k, own in enumerate(chain.from_iterable(coder.encode_all(c.column("text")) for c in chunks(b, limit=BLOCK_BYTES))):
                ids = np.append(own, np.uint32(END_ID)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    take.append(k)
                    for column, value in zip(out, (piece, start, len(part), zlib.crc32(part.tobytes())), strict=False):
                        column.append(value)
                    if with_ids:
                        out[5].append(part.astype(np.int64))
            rows = pa.array(take, pa.int64())
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [b.column("row").take(rows), b.column("doc_id").take(rows),
                       *[pa.array(c, t) for c, t in zip(out, kinds, strict=False)]]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([x.tolist() for x in out[5]], pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        gc.enable()

    return cut


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` token ids: row, doc_id, piece, start, length, ids_crc32 (and ids).

    A document's ids end with id 1; null text is empty and gives that id alone.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    schema = PIECES.format(kind=docs.schema["doc_id"].dataType.simpleString()) + ", ids array<bigint>" * with_ids
    return rows.mapInArrow(lean(_cutter(tokenizer, capacity, with_ids)), schema)


class Packing:
    """Item numbers by bin, with loads; every operator keeps each item in exactly one bin."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.sizes, self.capacity = sizes.tolist(), capacity
        self.bound = -(-int(sizes.sum()) // capacity)

    def place(self, bins: list[list[int]], loads: list[int], items: list[int]) -> Individual:
        """Best fit: each item goes to the fullest bin that has room for it."""
        sizes, capacity = self.sizes, self.capacity
        rooms = sorted((capacity - load, k) for k, load in enumerate(loads) if load < capacity)
        for item in items:
            size = sizes[item]
            at = bisect_left(rooms, (size, -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
                bins[k].append(item)
                loads[k] += size
            else:
                room, k = capacity, len(bins)
                bins.append([item])
                loads.append(size)
            if room > size:
                insort(rooms, (room - size, k))
        return Individual(bins, loads)

    def seed(self, rng: np.random.Generator, noise: float) -> Individual:
        order = np.argsort(-np.array(self.sizes) * (1 + noise * rng.random(len(self.sizes))), kind="stable")
        return self.place([], [], order.tolist())

    def of_bins(self, bins: list[list[int]]) -> Individual:
        return Individual(bins, [sum(map(self.sizes.__getitem__, b)) for b in bins])

    def cross(self, giver: Individual, taker: Individual, rng: np.random.Generator) -> Individual:
        """Injects the giver's well-filled bins whole, drops the taker's bins that hold their
        items, and best-fits the documents this displaces."""
        fill = np.array(giver.loads) / self.capacity
        best = np.argsort(-fill + 0.01 * rng.random(len(fill)))[: max(1, len(fill) // 2)].tolist()
        bins, loads = [list(giver.bins[k]) for k in best], [giver.loads[k] for k in best]
        held = {i for b in bins for i in b}
        taken = frozenset(held)
        for b, load in zip(taker.bins, taker.loads, strict=True):
            if taken.isdisjoint(b):
                bins.append(list(b))
                loads.append(load)
                held.update(b)
        loose = [i for i in range(len(self.sizes)) if i not in held]
        loose.sort(key=lambda i: -self.sizes[i])
        return self.place(bins, loads, loose)

    def evolve(self, population: list[Individual], rng: np.random.Generator, size: int, children: int) -> list[Individual]:
        """Seeds up to ``size`` individuals, then breeds; ends at once at the lower bound."""
        while len(population) < size and not (population and min(x.rank for x in population)[0] <= self.bound):
            population.append(self.seed(rng, 0.05 * len(population)))
        population.sort(key=lambda x: x.rank)
        for _ in range(children):
            if population[0].rank[0] <= self.bound or len(population) < 2:
                break
            a, b = rng.choice(len(population), 2, replace=False)
            population.append(self.cross(population[a], population[b], rng))
            population.sort(key=lambda x: x.rank)
            del population[size:]
        return population


class Individual:
    """A packing; it ranks by fewer bins, then by fuller ones (the mean squared load)."""

    def __init__(self, bins: list[list[int]], loads: list[int]) -> None:
        self.bins, self.loads = bins, loads
        self.rank = (len(bins), -sum(x * x for x in loads))


def _bins_to_bytes(bins: list[list[int]], n: int) -> bytes:
    of = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        of[b] = k
    return of.tobytes()


def _bytes_to_bins(blob: bytes) -> list[list[int]]:
    of = np.frombuffer(blob, np.int32)
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)] if len(of) else []


_STATE = "part bigint, island int, pieces binary, sizes binary, elite array<binary>"


def _epoch(first: bool, capacity: int, epoch: int) -> Callable[[pa.Table], pa.Table]:
    """One epoch of one island: its bounded sub-problem, its own elite and the migrants."""

    def run(table: pa.Table) -> pa.Table:
        part, island = table["part"][0].as_py(), table["island"][0].as_py()
        if first:
            table = table.sort_by([("row", "ascending"), ("piece", "ascending")])
            rows = np.stack([table["row"].to_numpy(), table["piece"].to_numpy().astype(np.int64)])
            pieces, sizes = rows.tobytes(), table["length"].to_numpy().astype(np.int64)
            population = []
        else:
            pieces = table["pieces"][0].as_py()
            sizes = np.frombuffer(table["sizes"][0].as_py(), np.int64)
            population = [_bytes_to_bins(x) for found in table["elite"].to_pylist() for x in found]
        packing = Packing(sizes, capacity)
        population = [packing.of_bins(b) for b in population]
        rng = np.random.default_rng([int(part) & 0xFFFFFFFF, island, epoch])
        elite = packing.evolve(population, rng, POPULATION, CHILDREN)
        return pa.table({
            "part": pa.array([part], pa.int64()), "island": pa.array([island], pa.int32()),
            "pieces": pa.array([pieces], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "elite": pa.array([[_bins_to_bytes(x.bins, len(sizes)) for x in elite]], pa.list_(pa.binary())),
        })

    return run


def _chosen(capacity: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """The best packing any island found, as rows; poorly filled bins are left open unless ``last``."""

    def run(table: pa.Table) -> pa.Table:
        blob = table["pieces"][0].as_py()
        sizes = np.frombuffer(table["sizes"][0].as_py(), np.int64)
        rows = np.frombuffer(blob, np.int64).reshape(2, -1)
        packing = Packing(sizes, capacity)
        found = [_bytes_to_bins(x) for e in table["elite"].to_pylist() for x in e]
        bins = min((packing.of_bins(b) for b in found), key=lambda x: x.rank).bins
        of, offset, full = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool)
        for k, b in enumerate(bins):
            b = np.sort(np.array(b))
            ends = np.cumsum(sizes[b])
            of[b], offset[b] = k, ends - sizes[b]
            full[b] = last or ends[-1] >= WELL_FILLED * capacity
        return pa.table({
            "row": rows[0], "piece": rows[1].astype(np.int32), "length": sizes,
            "part": pa.array(np.full(len(sizes), table["part"][0].as_py(), np.int64)),
            "bin": of, "offset": offset, "full": full})

    return run


def _solve(pieces: DataFrame, capacity: int, last: bool, label: str) -> DataFrame:
    """row, piece, length, part, bin, offset, full for pieces shorter than the capacity."""
    n = pieces.count()
    parts = max(1, math.ceil(n / GROUP))
    dealt = pieces.select(
        "row", "piece", "length",
        F.pmod(F.xxhash64("row", "piece", F.lit(label)), F.lit(parts)).cast("bigint").alias("part"),
        F.explode(F.array(*[F.lit(k) for k in range(ISLANDS)])).alias("island"))
    state = dealt.groupBy("part", "island").applyInArrow(_epoch(True, capacity, 0), _STATE)
    for epoch in range(1, EPOCHS):
        state = stage(state, f"{label}-epoch")
        moved = state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        state = state.union(moved).groupBy("part", "island").applyInArrow(_epoch(False, capacity, epoch), _STATE)
    return stage(state.groupBy("part").applyInArrow(
        _chosen(capacity, last),
        "row bigint, piece int, length bigint, part bigint, bin bigint, offset bigint, full boolean"), label)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Documents are cut only where they are longer than ``capacity``. Pieces of full length are
    sequences of their own. The others are dealt at random into bounded sub-problems; islands
    evolve each, their elite moves to the next island between epochs, and the best packing
    counts. Sequences left below 99 % are opened and packed again across sub-problems.

    Null and empty texts are one end id; repeated rows are documents of their own; an empty
    table gives no rows; columns other than doc_id and text are not read.
    """
    cut = stage(token_pieces(docs, tokenizer, capacity, with_ids), "pieces")
    whole = cut.where(F.col("length") >= capacity)
    rest = cut.where(F.col("length") < capacity)
    first = _solve(rest, capacity, False, "packed")
    second = _solve(first.where("NOT full"), capacity, True, "repacked")
    places = first.where("full").selectExpr("row", "piece", "(part * 4194304 + bin) * 2 AS sequence_id", "offset").union(
        second.selectExpr("row", "piece", "(part * 4194304 + bin) * 2 + 1 AS sequence_id", "offset"))
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    own = whole.select(
        "*", F.lit(0).cast("bigint").alias("offset"), (-1 - F.monotonically_increasing_id()).alias("sequence_id"))
    return rest.join(places, ["row", "piece"]).select(keep).union(own.select(keep))
