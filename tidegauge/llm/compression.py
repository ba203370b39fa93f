"""Quality rules: word counts, repeats, and bands of the zstandard ratio.

The ratio of compressed to raw bytes is taken over the whole text and over consecutive chunks. Text that
compresses far too well repeats itself, text that hardly compresses is noise. What is normal depends
on the length, so each length class has its own band, taken from the ratios of all different documents that
the base rules keep: their quartiles, widened by a multiple of the distance between them.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.texts import filter_batches, keyed_texts, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the base rules: least words, largest share of repeated words, counted characters, white space.
MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
WINDOW = 3


@dataclass(frozen=True)
class Bands:
    """`limits`: least bytes of a length class, smallest and largest ratio of the whole text.

    Chunks have `chunk` bytes, the last one up to twice as many; a text is rejected when chunks outside
    `chunk_band` hold more than `share` of its bytes. Texts shorter than the first class have no verdict.

    `whole` and `parts` narrow these limits for texts and for chunks, by length class as `length_class` numbers
    them; `measured` finds them. A limit lies `fence` or `chunk_fence` times the distance of the quartiles outside
    of them, `margin` at least. Classes are joined until they hold `enough` ratios; with fewer in all, nothing narrows.
    """

    level: int = 3
    limits: tuple[tuple[int, float, float], ...] = (
        (128, 0.20, 1.05), (256, 0.25, 0.95), (512, 0.25, 0.90), (1024, 0.22, 0.85), (4096, 0.18, 0.80), (16384, 0.15, 0.80))
    chunk: int = 1024
    chunk_band: tuple[float, float] = (0.18, 0.80)
    share: float = 0.4
    fence: float = 1.5
    chunk_fence: float = 2.0
    margin: float = 0.02
    enough: int = 200
    whole: tuple[tuple[int, float, float], ...] = ()
    parts: tuple[tuple[int, float, float], ...] = ()


# Ratios are counted in steps of this size.
STEPS = 1000


def length_class(size: int) -> int:
    """Four classes of equal width for each doubling of the length."""
    octave = max(2, size.bit_length() - 1)
    return 4 * octave + ((size >> (octave - 2)) & 3)


def fences(counts: dict[int, Counter], width: float, margin: float, enough: int) -> tuple[tuple[int, float, float], ...]:
    """First length class, smallest and largest ratio of each run of classes, from the counts of ratios by class."""
    runs: list[tuple[int, Counter]] = []
    for number in sorted(counts):
        if runs and runs[-1][1].total() < enough:
            runs[-1][1].update(counts[number])
        else:
            runs.append((number, Counter(counts[number])))
    if len(runs) > 1 and runs[-1][1].total() < enough:
        runs[-2][1].update(runs.pop()[1])
    found = []
    for number, held in runs:
        if held.total() >= enough:
            steps = np.array(sorted(held))
            below = np.cumsum([held[x] for x in steps])
            low, high = (steps[np.searchsorted(below, q * below[-1])] / STEPS for q in (0.25, 0.75))
            reach = max(width * (high - low), margin)
            found.append((number, float(low - reach), float(high + reach)))
    return tuple(found)


def _within(limits: tuple[tuple[int, float, float], ...], size: int, ratio: float) -> bool:
    band = [(a, b) for first, a, b in limits if length_class(size) >= first]
    return not band or band[-1][0] <= ratio <= band[-1][1]


class Ratios:
    def __init__(self, bands: Bands):
        self.bands, self.packer = bands, zstandard.ZstdCompressor(level=bands.level)

    def ratio(self, raw: bytes) -> float:
        return len(self.packer.compress(raw)) / len(raw) if raw else 1.0

    def chunks(self, raw: bytes) -> list[tuple[int, float]]:
        """Bytes and ratio of each chunk; none for a text shorter than two."""
        size, chunk = len(raw), self.bands.chunk
        ends = [*range(chunk, size - chunk + 1, chunk), size] if size >= 2 * chunk else []
        return [(end - start, self.ratio(raw[start:end])) for start, end in zip([0, *ends], ends)]

    def verdict(self, raw: bytes) -> tuple[bool, float, float]:
        """Whether the text is within its bands, its ratio, and the share of bytes in chunks outside."""
        whole, (low, high), size = self.ratio(raw), self.bands.chunk_band, len(raw)
        odd = sum(n for n, ratio in self.chunks(raw) if not (low <= ratio <= high and _within(self.bands.parts, n, ratio)))
        share = odd / size if size else 0.0
        band = [(a, b) for least, a, b in self.bands.limits if size >= least]
        inside = not band or (band[-1][0] <= whole <= band[-1][1] and _within(self.bands.whole, size, whole))
        return inside and share <= self.bands.share, whole, share


@dataclass
class Facts:
    n_words: int = 0
    word_chars: int = 0
    n_symbols: int = 0
    n_dup_lines: int = 0
    n_repeat_words: int = 0
    base_failed: bool = field(default=True)


def base_facts(text: str | None) -> tuple[Facts, bytes]:
    """Counts of the base rules, and the text's bytes; a null text has no words."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    facts = Facts(n_words=n, n_symbols=len(raw) - len(raw.translate(None, SYMBOLS)))
    facts.word_chars = len(text or "") - (len(raw) - len(raw.translate(None, BLANKS)))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    facts.n_dup_lines = len(lines) - len(set(lines))
    if n >= WINDOW:
        windows = list(zip(words, words[1:], words[2:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            often = np.fromiter(map(counts.__getitem__, windows), np.int64, len(windows)) > 1
            hit = np.zeros(n, bool)
            for shift in range(WINDOW):
                hit[shift:shift + len(often)] |= often
            facts.n_repeat_words = int(hit.sum())
    facts.base_failed = n < MIN_WORDS or 100 * facts.n_repeat_words > REPEAT_PERCENT * n
    return facts, raw


def measured(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> Bands:
    """The bands with limits from the ratios of all different documents that the base rules keep.

    Equal texts count once, by a 128-bit hash, so that copies do not narrow a band. What reaches the driver is one
    number per length class and step of the ratio.
    """
    schema = pa.schema([("hash", pa.binary()), ("kinds", pa.list_(pa.int32())), ("steps", pa.list_(pa.int32()))])

    def make():
        ratios = Ratios(bands)

        def work(batch):
            made = {name: [] for name in schema.names}
            for value in batch.column(0).to_pylist():
                facts, raw = base_facts(value)
                if not facts.base_failed:
                    chunks = ratios.chunks(raw)
                    made["hash"].append(xxhash.xxh128_digest(raw))
                    made["kinds"].append([2 * length_class(len(raw)), *[2 * length_class(n) + 1 for n, _ in chunks]])
                    made["steps"].append([round(STEPS * r) for r in (ratios.ratio(raw), *[r for _, r in chunks])])
            return made

        return work

    seen = map_batches(docs.select(F.col(text).cast("string").alias("text")), schema, make).distinct()
    pairs = seen.select(F.explode(F.arrays_zip("kinds", "steps")).alias("x"))
    counts: tuple[dict[int, Counter], dict[int, Counter]] = ({}, {})
    for kind, step, n in pairs.groupBy("x.kinds", "x.steps").count().collect():
        counts[kind % 2].setdefault(kind // 2, Counter())[step] += n
    return replace(bands, whole=fences(counts[0], bands.fence, bands.margin, bands.enough),
                   parts=fences(counts[1], bands.chunk_fence, bands.margin, bands.enough))


def quality_facts(docs: DataFrame, bands: Bands = Bands(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base counts, base_failed, kept, the ratio and the share of odd chunks.

    A null or empty text has no words and fails; its ratio is 1. Equal rows give equal rows. `kept` is false
    where the base rules fail, else whether whole text and chunks lie within the measured bands.
    """
    bands = measured(docs, bands, text)
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("odd_share", pa.float64())])

    def make():
        ratios = Ratios(bands)

        def work(batch):
            made = {name: [] for name in schema.names[1:]}
            for value in batch.column(1).to_pylist():
                facts, raw = base_facts(value)
                inside, whole, share = ratios.verdict(raw)
                for name, x in vars(facts).items():
                    made[name].append(x)
                made["kept"].append(inside and not facts.base_failed)
                made["ratio"].append(whole)
                made["odd_share"].append(share)
            return {"doc_id": batch.column(0), **made}

        return work

    return map_batches(keyed_texts(docs, key, text, fill=False), schema, make)


def keep_quality(docs: DataFrame, bands: Bands = Bands(), text: str = "text") -> DataFrame:
    """The documents that `quality_facts` keeps, with all their columns; no row is moved."""
    at, bands = docs.columns.index(text), measured(docs, bands, text)

    def make():
        ratios = Ratios(bands)

        def work(batch):
            kept = []
            for value in batch.column(at).to_pylist():
                facts, raw = base_facts(value)
                kept.append(not facts.base_failed and ratios.verdict(raw)[0])
            return kept

        return work

    return filter_batches(docs, make)
