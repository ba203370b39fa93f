"""Exact removal of byte strings that occur more than once.

A byte goes if a string of `length` bytes that covers it starts at another place too, in the same or another
document. Strings are compared by place, not by document:

1. Every string of `length` bytes has an anchor: of its `SEED`-byte substrings the one with the smallest hash, the
   leftmost of equals. The strings with one anchor start at neighbouring places and form a block, whose context is the
   bytes they cover. Equal strings have equal anchors at equal distances.
2. Blocks whose anchor occurs once hold no repeated string. Blocks with equal anchor and context are repeated whole.
3. What remains are blocks that share the anchor but not the whole context. Equal strings also share the half context
   on the longer side of the anchor, which splits such groups further; then the strings of a group are suffixes
   of its contexts that are sorted, and neighbours with a common prefix of `length` bytes are repeated.

The sort is a mergesort of suffixes that never walks along them: prefix polynomial hashes give the hash of any
substring, a binary search finds the longest common prefix, and the byte after it decides. Neighbours
that the hashes call equal are compared byte by byte.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidegauge.llm.texts import bound_batches, free_name, map_batches, numbered, record_batch, settled, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LENGTH = 200
# Bytes of an anchor; a larger value gives more blocks, a smaller one more chance meetings.
SEED = 64
# Bytes of a text that are anchored at once; a longer text is taken in overlapping stretches.
STRETCH = 1 << 20
# Contexts of a group that one task may sort; larger groups are split by single strings.
GROUP = 4096
# Bytes of contexts that are sorted at once.
SORT_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_CODES = np.random.default_rng(41).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_PLACE = _U(0xFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


class PrefixHashes:
    """Polynomial hashes of all prefixes of a byte string, from which any substring's hash follows."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        cls = type(self)
        if len(cls.powers) <= n:
            size = max(2 * len(cls.powers), n + 1)
            for name, base in (("powers", _BASE), ("inverses", _inverse(_BASE))):
                setattr(cls, name, np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, base, np.uint64))]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[data] * cls.powers[:n], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverses[start]

    def all(self, size: int) -> np.ndarray:
        """Hashes of all substrings of `size` bytes."""
        count = len(self.sums) - size
        return (self.sums[size:] - self.sums[:count]) * self.inverses[:count]


def anchored_blocks(data: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Blocks of one text: anchor hash, context hash, first and end start of its strings, place of the anchor."""
    prefix = PrefixHashes(data)
    hashes = _mixed(prefix.all(seed))
    low = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    width, reach = length - seed + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[:reach - width], low[width - reach:])
    anchor = (low & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    end = np.append(first[1:], len(anchor))
    place = anchor[first]
    shape = ((end - first) * 4 * length + place - first).astype(np.uint64)
    context = _mixed(_mixed(prefix.of(first, end - 1 + length)) + _mixed(shape))
    return hashes[place], context, first, end, place


def text_blocks(raw: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...] | None:
    """Blocks of a text of any length; None if it is shorter than `length`."""
    if len(raw) < length:
        return None
    data, found = np.frombuffer(raw, np.uint8), []
    step = STRETCH - length + 1
    for at in range(0, len(data) - length + 1, step):
        h, c, first, end, place = anchored_blocks(data[at:at + STRETCH], length, seed)
        found.append((h, c, first + at, end + at, place + at))
    return tuple(np.concatenate(x) for x in zip(*found))


class SuffixSort:
    """Sorts suffixes of `data` by their first `length` bytes, each class of suffixes for itself."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length, self.prefix = data, length, PrefixHashes(data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes at a and b, up to `length`, by binary search on hashes."""
        low = np.zeros(len(a), np.int64)
        whole = self.prefix.of(a, a + self.length) == self.prefix.of(b, b + self.length)
        low[whole] = self.length
        rest = np.flatnonzero(~whole)
        a, b = a[rest], b[rest]
        least, most = np.zeros(len(rest), np.int64), np.full(len(rest), self.length, np.int64)
        # The hashes agree on `least` bytes and differ on `most`.
        while len(rest) and int((most - least).max()) > 1:
            half = (least + most) // 2
            same = self.prefix.of(a, a + half) == self.prefix.of(b, b + half)
            least, most = np.where(same, half, least), np.where(same, most, half)
        low[rest] = least
        return low

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a comes before suffix b; equal ones do where `or_equal`."""
        common = self.common(a, b)
        at = np.minimum(common, self.length - 1)
        return np.where(common >= self.length, or_equal, self.data[a + at] < self.data[b + at])

    def sort(self, places: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Places in sorted order within classes; places of class i are places[starts[i]:starts[i + 1]]."""
        places, sizes = places.copy(), np.diff(starts)
        run = 1
        while len(sizes) and run < sizes.max():
            big = np.flatnonzero(sizes > run)
            total = int(sizes[big].sum())
            # Members of classes that still have more than one run: their class's start and their rank in it.
            base = np.repeat(starts[big], sizes[big])
            rank = np.arange(total) - np.repeat(np.cumsum(sizes[big]) - sizes[big], sizes[big])
            size = np.repeat(sizes[big], sizes[big])
            own = rank // run
            other_first = np.minimum((own ^ 1) * run, size)
            low, high = other_first.copy(), np.minimum(other_first + run, size)
            me = places[base + rank]
            # A member of the second run stands behind equal ones of the first.
            behind = (own & 1).astype(bool)
            open_ = np.flatnonzero(low < high)
            while len(open_):
                half = (low[open_] + high[open_]) // 2
                before = self.less(places[base[open_] + half], me[open_], behind[open_])
                low[open_] = np.where(before, half + 1, low[open_])
                high[open_] = np.where(before, high[open_], half)
                open_ = open_[low[open_] < high[open_]]
            merged = base + (own & ~1) * run + rank % run + (low - other_first)
            places[merged] = me
            run *= 2
        return places


def repeated_starts(contexts: list[bytes], distances: list[np.ndarray], groups: np.ndarray,
                    length: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its strings occur in another context of its group.

    String i of a context starts at byte i; distances[c][i] is its distance to the anchor. Only
    strings of equal distance can be equal, so each group and distance is a class.
    """
    counts = np.array([len(d) for d in distances])
    data = np.frombuffer(b"".join(contexts), np.uint8)
    base = np.cumsum([0, *map(len, contexts)])[:-1]
    owner = np.repeat(np.arange(len(contexts)), counts)
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    places = base[owner] + number
    classes = groups[owner] * np.int64(4 * length) + np.concatenate(distances)
    order = np.argsort(classes, kind="stable")
    sorted_classes = classes[order]
    starts = np.append(np.flatnonzero(np.append(True, sorted_classes[1:] != sorted_classes[:-1])), len(order))
    suffixes = SuffixSort(data, length)
    placed = suffixes.sort(places[order], starts)
    same = np.zeros(len(placed), bool)
    inner = sorted_classes[1:] == sorted_classes[:-1]
    near = np.flatnonzero(inner)
    equal = near[suffixes.prefix.of(placed[near], placed[near] + length)
                 == suffixes.prefix.of(placed[near + 1], placed[near + 1] + length)]
    for at in range(0, len(equal), 8192):
        part, span = equal[at:at + 8192], np.arange(length)
        checked = (data[placed[part][:, None] + span] == data[placed[part + 1][:, None] + span]).all(axis=1)
        if not checked.all():
            return _compared(contexts, distances, groups, length)
        same[part] = True
    hit = same.copy()
    hit[1:] |= same[:-1]
    found = np.zeros(len(data) + 1, bool)
    found[placed[hit]] = True
    return np.split(found[places], np.cumsum(counts)[:-1])


def _compared(contexts, distances, groups, length) -> list[np.ndarray]:
    """The same by whole strings, for data in which hashes collide."""
    seen: dict[tuple, int] = {}
    keys = [[(int(g), int(d), c[i:i + length]) for i, d in enumerate(own)]
            for c, own, g in zip(contexts, distances, groups)]
    for own in keys:
        for key in own:
            seen[key] = seen.get(key, 0) + 1
    return [np.array([seen[key] > 1 for key in own], bool) for own in keys]


_BLOCK = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("row", pa.int64()), ("first", pa.int32()),
                    ("end", pa.int32()), ("place", pa.int32()), ("n", pa.int32()), ("settled", pa.bool_())])


def _blocks(rows: DataFrame, length: int, seed: int) -> DataFrame:
    """Blocks of all texts. Of blocks that are equal within a text, one stands for all with its number `n`;
    the text's own ones are `settled`: all their strings are repeated."""

    def make():
        def work(batch):
            parts = []
            for row, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = text_blocks(raw.as_buffer().to_pybytes(), length, seed)
                if found is None:
                    continue
                anchor, context, first, end, place = found
                _, index, inverse, counts = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
                n = np.zeros(len(context), np.int32)
                n[index] = counts
                settled = counts[inverse] > 1
                parts.append((anchor, context, np.full(len(n), row), first, end, place, n, settled))
            if not parts:
                return {f.name: [] for f in _BLOCK}
            columns = [np.concatenate(x) for x in zip(*parts)]
            return dict(zip(_BLOCK.names, [columns[0].view(np.int64), columns[1].view(np.int64), *columns[2:]]))

        return work

    return map_batches(rows.select("row", "raw"), _BLOCK, make)


_CONTEXT = pa.schema([("anchor", pa.int64()), ("side", pa.int32()), ("half", pa.int64()), ("alone", pa.bool_()),
                      ("row", pa.int64()), ("first", pa.int32()), ("distance", pa.int32()), ("raw", pa.binary())])


def _contexts(listed: DataFrame, length: int, seed: int) -> DataFrame:
    """Half groups of the blocks that a text's list names: the strings that reach at least half of the
    way to the left of the anchor, and the others. `first` is the first string's start, `distance` its distance."""
    reach = (length - seed) // 2

    def make():
        def work(batch):
            made = []
            for row, raw, blocks in zip(*[c.to_pylist() for c in batch.columns]):
                hashes = PrefixHashes(np.frombuffer(raw, np.uint8))
                for b in blocks:
                    first, end, place = b["first"], b["end"], b["place"]
                    # Strings that start at or before `border` have `reach` bytes or more before the anchor.
                    border = place - reach
                    for side, s, e, half in ((0, first, min(end, border + 1), (border, place)),
                                             (1, max(first, border + 1), end, (place + seed, place + seed + reach))):
                        if s < e:
                            key = hashes.of(np.array([half[0]]), np.array([half[1]])).view(np.int64)[0]
                            made.append((b["anchor"], side, int(key), b["alone"], row, s, place - s, raw[s:e - 1 + length]))
            return dict(zip(_CONTEXT.names, map(list, zip(*made)))) if made else {f.name: [] for f in _CONTEXT}

        return work

    return map_batches(listed, _CONTEXT, make)


_SPAN = pa.schema([("row", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])


def _runs(row: int, first: int, hit: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of hit starts as (row, first start, end start)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for s, e in zip(edges[::2].tolist(), edges[1::2].tolist()):
        yield row, first + s, first + e


def _sorted_spans(groups: DataFrame, length: int) -> DataFrame:
    """Repeated strings of small groups, whose rows are brought together and sorted as suffixes."""
    keys = ["anchor", "side", "half"]
    bound_batches(groups.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[dict]] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rows = [r for g in held for r in g]
            numbers = np.repeat(np.arange(len(held)), [len(g) for g in held])
            strings = [r["distance"] - np.arange(len(r["raw"]) - length + 1) for r in rows]
            found = repeated_starts([r["raw"] for r in rows], strings, numbers, length)
            return record_batch([x for r, hit in zip(rows, found) if r["alone"] for x in _runs(r["row"], r["first"], hit)], _SPAN)

        for batch in batches:
            for r in batch.to_pylist():
                key = r["anchor"], r["side"], r["half"]
                if key != last:
                    if size > SORT_BYTES:
                        yield flush()
                        held, size = [], 0
                    held.append([])
                    last = key
                held[-1].append(r)
                size += len(r["raw"])
        if held:
            yield flush()

    near = groups.repartition(*keys).sortWithinPartitions(*keys)
    return near.select(*_CONTEXT.names).mapInArrow(run, from_arrow_schema(_SPAN))


_STRING = pa.schema([("anchor", pa.int64()), ("distance", pa.int32()), ("string", pa.binary()), ("row", pa.int64()),
                     ("first", pa.int32()), ("alone", pa.bool_())])


def _counted_spans(groups: DataFrame, length: int) -> DataFrame:
    """Repeated strings of groups too large for one task: every string is counted by its digest."""

    def make():
        def work(batch):
            made = []
            for r in batch.to_pylist():
                raw = r["raw"]
                for i in range(len(raw) - length + 1):
                    digest = hashlib.blake2b(raw[i:i + length], digest_size=16).digest()
                    made.append((r["anchor"], r["distance"] - i, digest, r["row"], r["first"] + i, r["alone"]))
            return dict(zip(_STRING.names, map(list, zip(*made)))) if made else {f.name: [] for f in _STRING}

        return work

    strings = map_batches(groups.select(*_CONTEXT.names), _STRING, make)
    keys = ["anchor", "distance", "string"]
    often = strings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return strings.filter("alone").join(often, keys).select("row", "first", (F.col("first") + 1).cast("int").alias("end"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """Starts of repeated strings as ranges (row, first, end) that may touch; rows: row BIGINT, raw BINARY, fixed."""
    blocks = written(_blocks(rows, length, seed), "blocks")
    often = (blocks.filter("n > 0").groupBy("anchor").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor"))
    shared = blocks.filter("n > 0").join(often, "anchor")
    place = F.struct("row", "first", "end", "place")
    kinds = written(shared.groupBy("anchor", "context").agg(F.sum("n").alias("total"), F.min(place).alias("at"))
                    .withColumn("alone", F.col("total") == 1), "kinds")
    whole = (blocks.filter("n > 0 and not settled").join(kinds.filter("not alone").select("anchor", "context"), ["anchor", "context"])
             .select("row", "first", "end").unionByName(blocks.filter("settled").select("row", "first", "end")))
    # Groups of several contexts, at least one of which occurs once: only there single strings decide.
    mixed = (kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or("alone").alias("open"))
             .filter("kinds > 1 and open").select("anchor"))
    chosen = kinds.join(mixed, "anchor").select("anchor", "alone", "at.*").groupBy("row").agg(
        F.collect_list(F.struct("anchor", "alone", "first", "end", "place")).alias("blocks"))
    listed = rows.select("row", "raw").join(chosen, "row").select("row", "raw", "blocks")
    contexts = written(_contexts(listed, length, seed), "contexts")
    keys = ["anchor", "side", "half"]
    sizes = (contexts.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.bool_or("alone").alias("open"))
             .filter("size > 1 and open").drop("open"))
    groups = contexts.join(sizes, keys)
    return (whole.unionByName(_sorted_spans(groups.filter(F.col("size") <= group), length))
            .unionByName(_counted_spans(groups.filter(F.col("size") > group), length)))


def _with_spans(rows: DataFrame, row: str, text: str, length: int, how: str, *others: str) -> DataFrame:
    """row, raw, the repeated strings' starts as `spans`, and other columns."""
    raw = rows.select(F.col(row).alias("row"),
                      F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8").alias("raw"), *others)
    spans = settled(rows.sparkSession, lambda: repeated_spans(raw, length), "spans")
    return raw.join(spans.groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("spans")), "row", how)


def covered(size: int, spans: list[dict] | None, length: int = LENGTH) -> np.ndarray:
    """Which bytes the strings that start in the spans cover."""
    edges = np.zeros(size + 1, np.int64)
    if spans:
        np.add.at(edges, [s["first"] for s in spans], 1)
        np.add.at(edges, [s["end"] - 1 + length for s in spans], -1)
    return np.cumsum(edges[:-1]) > 0


def removed_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text is empty. A text shorter than `length` bytes keeps all. Equal rows are different places, so texts of
    `length` bytes or more that occur twice lose everything. Ids may be null or repeated.
    """
    rows, number = numbered(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    joined = _with_spans(rows, number, "text", length, "left", "doc_id")

    def make():
        def work(batch):
            made = []
            for doc_id, raw, spans in zip(*[c.to_pylist() for c in batch.columns]):
                gone = covered(len(raw), spans, length)
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
                made.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
            return dict(zip(schema.names, map(list, zip(*made))))

        return work

    return map_batches(joined.select("doc_id", "raw", "spans"), schema, make)


def kept_text(raw: bytes, gone: np.ndarray) -> str:
    """Text of the bytes that stay; a character of which some byte stays is kept whole."""
    if not gone.any():
        return raw.decode()
    data = np.frombuffer(raw, np.uint8)
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    stays = np.logical_or.reduceat(~gone, starts)
    return data[np.repeat(stays, np.diff(np.append(starts, len(data))))].tobytes().decode()


def without_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents with repeated strings cut out of their texts and `chars`, if there, counted anew.

    No row goes; a text that is repeated whole becomes empty. A null text stays null. Characters of which only some
    bytes are repeated stay whole, so that texts remain valid.
    """
    rows, number = numbered(docs)
    fresh_text = free_name(rows, "__cut")
    schema = pa.schema([("row", pa.int64()), ("cut", pa.string())])

    def make():
        def work(batch):
            rows, texts = [], []
            for row, raw, spans in zip(*[c.to_pylist() for c in batch.columns]):
                rows.append(row)
                texts.append(kept_text(raw, covered(len(raw), spans, length)))
            return {"row": rows, "cut": texts}

        return work

    cut = map_batches(_with_spans(rows, number, text, length, "inner"), schema, make)
    fresh = rows.join(cut.select(F.col("row").alias(number), F.col("cut").alias(fresh_text)), number, "left")
    shown = []
    for name, kind in docs.dtypes:
        if name == text:
            shown.append(F.coalesce(fresh_text, F.col(f"`{name}`")).alias(name))
        elif name == chars:
            shown.append(F.when(F.col(fresh_text).isNotNull(), F.char_length(fresh_text)).otherwise(F.col(f"`{name}`")).cast(kind).alias(name))
        else:
            shown.append(F.col(f"`{name}`"))
    return fresh.select(*shown)
