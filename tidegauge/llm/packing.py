"""Best-fit packing by a grouping genetic algorithm on islands.

Pieces are dealt into blocks of bounded size. In each block several islands hold a population of packings.
A child takes whole well-filled bins of one parent into the other, bins of the other that share a piece with
them are dissolved, and the displaced pieces go best-fit into what is left. After each epoch an island's best
packing also goes to the next island. A block's best packing over all islands is its result.
"""

from __future__ import annotations

import os
import sys
import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.texts import keyed_texts, map_batches, worker_shared, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CAPACITY = 2048
SEPARATOR = 0
BLOCK = 8192
ISLANDS = 3
EPOCHS = 2
POPULATION = 4
CHILDREN = 5
# Parts that are joined for encoding, and bytes that a memo may hold.
JOINED, MEMO_BYTES = 64, 128 * 1024 * 1024
_MARKS = ".,;:!?#$%&*)"


def _plain(text: str) -> bool:
    """Whether all characters are of the first 256: those letters are lower-cased one by one and don't join a mark."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Tokens(dict):
    """Memo from parts of texts without spaces to their ids as little-endian bytes, of bounded size.

    The vocabulary's normaliser and pre-tokeniser never join characters across a space or line break, so
    parts between them have the ids that they have in the whole text. Unknown parts of letters alone are encoded many at
    a time, joined by spaces: each is one word, so its ids end with the first id that closes a word. Other parts, and
    joined ones whose closed words are not as many, go one by one.
    """

    def __init__(self, vocabulary: str, most: int = MEMO_BYTES):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer, self.most, self.held = Tokenizer.from_str(vocabulary), most, 0
        known = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(known.values()) + 1, bool)
        self.closes[[number for token, number in known.items() if token.endswith("</w>")]] = True

    @staticmethod
    def parts(text: str) -> list[str]:
        """The text cut at spaces and line breaks.

        Letters of these alphabets are lower-cased one by one, so equal words in other cases share an entry. A text with
        a special token's start stays as it is.
        """
        if "<|" not in text and _plain(text):
            text = text.lower()
        return text.replace("\n", " ").split(" ")

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, parts: set[str]) -> None:
        """Ids of parts that the memo lacks. Marks never join a letter in front of them, so a word and its marks are put together."""
        joined = [p for p in parts if p.isalpha()]
        rest = [p for p in parts if not p.isalpha()]
        marked = [(p, stem, p[len(stem):]) for p, stem in zip(rest, [p.rstrip(_MARKS) for p in rest])
                  if stem.isalpha() and (stem.isascii() or _plain(stem))]
        alone = list(set(rest).difference([p for p, _, _ in marked]))
        extra = {x for _, *both in marked for x in both}.difference(parts)
        joined += [x for x in extra if x not in self and x.isalpha()]
        alone += [x for x in extra if x not in self and not x.isalpha()]
        first = len(self)
        groups = [joined[at:at + JOINED] for at in range(0, len(joined), JOINED)]
        for group, ids in zip(groups, self._encoded([" ".join(g) for g in groups])):
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            if len(ends) != len(group) or ends[-1] != 4 * len(ids):
                alone += group
                continue
            places = ends.tolist()
            self.update(zip(group, map(ids.tobytes().__getitem__, map(slice, [0, *places], places))))
        for at in range(0, len(alone), 4096):
            some = alone[at:at + 4096]
            self.update(zip(some, (ids.tobytes() for ids in self._encoded(some))))
        self.update((p, self[stem] + self[marks]) for p, stem, marks in marked)
        # About what an entry takes: the text, its bytes of ids, and both objects.
        made = islice(self.items(), first, None)
        self.held += sum(160 + len(p) + len(ids) for p, ids in made)

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > self.most:
            self.clear()
            self[""], self.held = b"", 0
        split = [self.parts(t) for t in texts]
        found = [list(map(self.get, parts)) for parts in split]
        gaps = [(ids, parts, _places(ids)) for ids, parts in zip(found, split) if None in ids]
        self.learn({parts[at] for _, parts, places in gaps for at in places})
        for ids, parts, places in gaps:
            for at in places:
                ids[at] = self[parts[at]]
        return list(map(b"".join, found))


def _places(ids: list) -> list[int]:
    """Where a list holds None."""
    places, at = [], -1
    for _ in range(ids.count(None)):
        at = ids.index(None, at + 1)
        places.append(at)
    return places


def tokenised_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Pieces of every document: its ids and the separator, cut every `capacity` ids."""
    with open(path, encoding="utf-8") as file:
        vocabulary = file.read()
    shipped, mark = docs.sparkSession.sparkContext.broadcast(vocabulary), zlib.crc32(vocabulary.encode())
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def make():
        tokens, end = worker_shared(("tokens", mark), lambda: Tokens(shipped.value)), np.array([SEPARATOR], "<u4").tobytes()

        def work(batch):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            return dict(zip(schema.names, map(list, zip(*rows))))

        return work

    return map_batches(keyed_texts(docs, key, text), schema, make)


def best_fit(sizes: list[int], items: list[int], bins: np.ndarray, free: list[int], capacity: int) -> None:
    """Place `items`, in order, into the fullest bin that takes them; `bins` and `free` are updated."""
    slots: dict[int, list[int]] = {}
    mask = 0
    for number, room in enumerate(free):
        if room:
            slots.setdefault(room, []).append(number)
            mask |= 1 << room
    for item in items:
        size = sizes[item]
        wide = mask >> size
        if wide:
            room = size + (wide & -wide).bit_length() - 1
            own = slots[room]
            number = own.pop()
            if not own:
                mask &= ~(1 << room)
        else:
            number, room = len(free), capacity
            free.append(capacity)
        bins[item] = number
        room -= size
        free[number] = room
        if room:
            own = slots.get(room)
            if own is None:
                own = slots[room] = []
            own.append(number)
            mask |= 1 << room


class Island:
    """A population of packings of one block; pieces are in descending order of size."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.plain, self.rng = self.sizes.tolist(), np.random.default_rng(seed)
        self.least = -(-int(self.sizes.sum()) // capacity)

    def packed(self, order: np.ndarray) -> np.ndarray:
        bins = np.full(len(self.plain), -1, np.int64)
        best_fit(self.plain, order.tolist(), bins, [], self.capacity)
        return bins

    def first(self, count: int) -> list[np.ndarray]:
        """Best fit by descending size, and by sizes that are disturbed a little."""
        found = [self.packed(np.arange(len(self.plain)))]
        while len(found) < count:
            noise = self.rng.uniform(0.8, 1.2, len(self.plain))
            found.append(self.packed(np.argsort(-self.sizes * noise, kind="stable")))
        return found

    def fitness(self, bins: np.ndarray) -> tuple[int, float]:
        """Bins, and the mean square of their filling with its sign turned: smaller is better."""
        fill = np.bincount(bins, weights=self.sizes) / self.capacity
        fill = fill[fill > 0]
        return len(fill), -float((fill * fill).mean()) if len(fill) else 0.0

    def child(self, host: np.ndarray, donor: np.ndarray) -> np.ndarray:
        """Whole well-filled bins of the donor in the host; displaced pieces are placed best-fit."""
        fill = np.bincount(donor, weights=self.sizes)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        taken = np.zeros(len(fill), bool)
        taken[self.rng.choice(good, max(1, len(good) // 8), replace=False)] = True
        brought = taken[donor]
        broken = np.zeros(host.max() + 1, bool)
        broken[host[brought]] = True
        # The worst-filled bins of the host are dissolved too, so that the child can gain a bin.
        own = np.bincount(host, weights=self.sizes)
        broken[np.argsort(own, kind="stable")[:max(1, len(own) // 50)]] = True
        stays = ~brought & ~broken[host]
        bins = np.full(len(host), -1, np.int64)
        number = np.cumsum(~broken) - 1
        bins[stays] = number[host[stays]]
        base = int((~broken).sum())
        renumbered = np.cumsum(taken) - 1
        bins[brought] = base + renumbered[donor[brought]]
        placed = bins >= 0
        used = np.bincount(bins[placed], weights=self.sizes[placed], minlength=base + int(taken.sum()))
        free = (self.capacity - used).astype(np.int64).tolist()
        best_fit(self.plain, np.flatnonzero(~placed).tolist(), bins, free, self.capacity)
        return bins

    def evolve(self, population: list[np.ndarray], children: int, size: int) -> list[np.ndarray]:
        """The best of the population after some children; it ends early at the least number of bins."""
        if not len(self.plain):
            return population[:1]
        ranked = sorted(population, key=self.fitness)[:size]
        for _ in range(children):
            if self.fitness(ranked[0])[0] <= self.least or len(ranked) < 2:
                break
            host, donor = self.rng.choice(len(ranked), 2, replace=False)
            ranked = sorted([*ranked, self.child(ranked[host], ranked[donor])], key=self.fitness)[:size]
        return ranked


_STATE = "block BIGINT, island INT, sizes BINARY, packing BINARY"


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS,
         population: int = POPULATION, children: int = CHILDREN) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces with a `length` of 1 to `capacity`.

    Every row is placed exactly once, equal rows too. A full piece is a sequence of its own. An empty
    input gives an empty result.
    """
    columns = pieces.columns
    rows = written(pieces.withColumn("_id", F.monotonically_increasing_id()), "pieces")
    part = F.col("length") < capacity
    count = rows.filter(part).count()
    blocks = max(1, -(-count // block))
    dealt = rows.filter(part).withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(blocks)))

    def start(own: pd.DataFrame) -> pd.DataFrame:
        sizes = np.sort(own["length"].to_numpy())[::-1].astype("<u2").tobytes()
        return pd.DataFrame({"block": int(own["_block"].iloc[0]), "island": range(islands), "sizes": sizes, "packing": None})

    def run(epoch: int):
        def evolve(state: pd.DataFrame) -> pd.DataFrame:
            number, island = int(state["block"].iloc[0]), int(state["island"].iloc[0])
            packed = sorted(x for x in state["packing"] if x is not None)
            sizes = state["sizes"].iloc[0]
            here = Island(np.frombuffer(sizes, "<u2"), capacity, hash((number, island, epoch)) & 0x7FFFFFFF)
            known = [np.frombuffer(x, "<u2").astype(np.int64) for x in packed] or here.first(population)
            best = [_dense(b).astype("<u2").tobytes() for b in here.evolve(known, children, population)]
            made = [(number, island, sizes, b) for b in best]
            return pd.DataFrame([*made, (number, (island + 1) % islands, sizes, best[0])],
                                columns=["block", "island", "sizes", "packing"])

        return evolve

    state = dealt.select("_block", "length").groupBy("_block").applyInPandas(start, _STATE)
    # A stated number of tasks: a state is small and its search is not, so adaptive execution would merge all into one task.
    spread = min(blocks * islands, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    for epoch in range(epochs):
        state = state.repartition(spread, "block", "island").groupBy("block", "island").applyInPandas(run(epoch), _STATE)
    placed = "_id BIGINT, sequence_id BIGINT, offset BIGINT"

    def settle(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["length", "_id"], ascending=[False, True])
        sizes = own["length"].to_numpy()
        here = Island(sizes, capacity, 0)
        bins = min((np.frombuffer(x, "<u2").astype(np.int64) for x in sorted(set(state["packing"]))), key=here.fitness)
        order = np.argsort(bins, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.append(True, bins[order][1:] != bins[order][:-1])
        before -= np.maximum.accumulate(np.where(first, before, 0))
        offset = np.empty(len(own), np.int64)
        offset[order] = before
        return pd.DataFrame({"_id": own["_id"], "sequence_id": (int(own["_block"].iloc[0]) << 32) + bins, "offset": offset})

    settled = dealt.select("_id", "_block", "length").groupBy("_block").cogroup(
        state.groupBy("block")).applyInPandas(settle, placed)
    packed = rows.join(settled, "_id").select(*columns, "sequence_id", "offset")
    full = rows.filter(~part).select(*columns, (-1 - F.col("_id")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.unionByName(full)


def _dense(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1]


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """Tokenise and pack documents: one row per piece with its sequence and its place there.

    A null or empty text is the separator alone. Rows with equal or null keys are packed each.
    """
    return pack(tokenised_pieces(docs, path, capacity, key, text), capacity)
