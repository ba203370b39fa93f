"""Document fingerprints by consistent weighted sampling.

Terms are pairs of neighbouring words, weighted by how often they occur. For each of the fingerprint's places
a term draws r and c from a gamma distribution and b uniformly; with t = floor(ln(weight) / r + b) and
y = exp(r (t - b)) the term with the smallest c / (y exp(r)) is the sample, together with t. Two texts draw
the same sample with a chance equal to the generalised Jaccard similarity of their weighted terms.

At weight one, t is 0 and the value is c exp(-r (1 - b)), which is exponentially distributed. So the draws start from
there: with A, B and E exponential and independent, c = A + B, r = E + ln(c / A) and b = E / r are gamma, gamma and uniform and
independent of each other, and A is the value at weight one. A rises with one uniform number, the term's hash at the place,
so terms of weight one, nearly all of them, need that hash and a minimum of whole numbers; the others take the full formula.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidegauge.llm.texts import MEMO_WORDS, bound_batches, keyed_texts, map_batches, record_batch, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PLACES = 128
# Terms drawn for at a time: their hashes stay in the processor's cache.
CHUNK = 96
SEED = 20_011
# One byte of each sample is kept; unequal samples agree on it with this chance.
_CHANCE = 1 / 256
_WORD = np.uint64(0x9E3779B97F4A7C15)


_MIX = ((np.uint64(30), np.uint64(0xBF58476D1CE4E5B9)), (np.uint64(27), np.uint64(0x94D049BB133111EB)))
_LAST = np.uint64(31)
_NONE = np.uint64(2 ** 64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in _MIX:
        x = (x ^ (x >> shift)) * factor
    return x ^ (x >> _LAST)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers strictly between 0 and 1, rising with x."""
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0 ** -52


class _Codes(dict):
    """Memo of words' hash values."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def weighted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different terms of at least one word, their weights, and where each first stands.

    Pairs of neighbouring words are the terms; a single word is a term of its own.
    """
    pairs = codes[:-1] * _WORD + codes[1:] if len(codes) > 1 else codes
    terms, first, weights = np.unique(_mixed(pairs), return_index=True, return_counts=True)
    return terms, weights, first


class Sampler:
    """Draws of terms, and fingerprints from them. `memo` bounds the words whose codes are kept."""

    def __init__(self, places: int = PLACES, memo: int = MEMO_WORDS, seed: int = SEED):
        self.keys = np.random.default_rng(seed).integers(0, 1 << 64, (3, places), np.uint64)
        # Room for the hashes of one chunk, used again each time.
        self.mixed, self.spare = np.empty((2, CHUNK, places), np.uint64)
        self.words, self.memo = memo, _Codes()

    def _hashes(self, terms: np.ndarray, which: int) -> np.ndarray:
        """Hash of up to CHUNK terms at each place; the array holds until the next hashes."""
        x, spare = self.mixed[:len(terms)], self.spare[:len(terms)]
        np.bitwise_xor(terms[:, None], self.keys[which], out=x)
        for shift, factor in _MIX:
            np.right_shift(x, shift, out=spare)
            np.bitwise_xor(x, spare, out=x)
            np.multiply(x, factor, out=x)
        np.right_shift(x, _LAST, out=spare)
        np.bitwise_xor(x, spare, out=x)
        return x

    def least(self, terms: np.ndarray) -> np.ndarray:
        """Least hash at each place among terms of weight one."""
        best = np.full(self.keys.shape[1], _NONE)
        for at in range(0, len(terms), CHUNK):
            np.minimum(best, self._hashes(terms[at:at + CHUNK], 0).min(axis=0), out=best)
        return best

    def draws(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """r, c and b of up to CHUNK terms at each place."""
        a, other, rest = (-np.log1p(-_uniform(self._hashes(terms, which))) for which in range(3))
        c = a + other
        r = rest + np.log(c / a)
        return r, c, np.minimum(rest / r, np.nextafter(1, 0))

    def codes(self, words: list[str]) -> np.ndarray:
        if len(self.memo) > self.words:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))

    def best(self, least: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One byte for each place: the least hash of terms of weight one against terms with other weights."""
        value = -np.log1p(-_uniform(least))
        sample = least.copy()
        logs = np.log(weights.astype(np.float64))
        for at in range(0, len(terms), CHUNK):
            own = terms[at:at + CHUNK]
            r, c, b = self.draws(own)
            t = np.floor(logs[at:at + CHUNK, None] / r + b)
            y = c * np.exp(-r * (t - b) - r)
            row = y.argmin(axis=0)
            place = np.arange(y.shape[1])
            lower = y[row, place] < value
            value = np.where(lower, y[row, place], value)
            # With t = 0 a sample is what it would be at weight one.
            steps = t[row, place].astype(np.int64).astype(np.uint64) * _WORD
            sample = np.where(lower, self._hashes(own, 0)[row, place] + steps, sample)
        return (_mixed(sample * _WORD) >> np.uint64(56)).astype(np.uint8)

    def sample(self, codes: np.ndarray) -> np.ndarray:
        """One byte for each place from the codes of a text's words; none for a text without a word."""
        if not len(codes):
            return np.zeros(0, np.uint8)
        terms, weights, _ = weighted(codes)
        single = weights == 1
        return self.best(self.least(terms[single]), terms[~single], weights[~single])

    def likeness(self, a: np.ndarray, b: np.ndarray) -> float:
        """Estimated generalised Jaccard similarity: 1 for two texts without words, 0 for one of them."""
        if not len(a) or not len(b):
            return float(len(a) == len(b))
        return max(0.0, (float((a == b).mean()) - _CHANCE) / (1 - _CHANCE))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and its fingerprint, hexadecimal; empty for a text without words."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def make():
        sampler = Sampler()
        return lambda batch: {"doc_id": batch.column(0),
                              "fingerprint": [sampler.sample(sampler.codes(t.split())).tobytes().hex() for t in batch.column(1).to_pylist()]}

    return map_batches(keyed_texts(docs, key, text), schema, make)


_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
# What a range leaves open: its first row as the next one of the range before, its last row without a next one.
_OPEN = pa.schema([*_EDITED, ("range", pa.int32()), ("first", pa.bool_()), ("text", pa.string())])


class _Text:
    """A document with its words' codes and its fingerprint, and what its edited text can take over.

    The words wholly in the kept two thirds stand in the edited text too, whatever comes after them. Terms of weight one
    among their pairs stay terms there; more weight only lowers their value, so their least hash holds for both.
    """

    def __init__(self, sampler: Sampler, doc_id: int | None, text: str, like: _Text | None = None):
        self.doc_id, self.text = doc_id, text
        if like is not None and like.text == text:
            self.codes, self.sample, self.whole, self.shared, self.least = like.codes, like.sample, like.whole, like.shared, like.least
            return
        self.codes = sampler.codes(text.split())
        # The last kept word may go on in what replaces the rest.
        self.whole = max(0, len(text[:len(text) - len(text) // 3].split()) - 1)
        self.shared, self.least = np.zeros(0, np.uint64), np.full(sampler.keys.shape[1], _NONE)
        self.sample = np.zeros(0, np.uint8)
        if len(self.codes):
            terms, weights, first = weighted(self.codes)
            single = weights == 1
            kept = single & (first < self.whole - 1)
            self.shared, self.least = terms[kept], sampler.least(terms[kept])
            self.sample = sampler.best(np.minimum(self.least, sampler.least(terms[single & ~kept])), terms[~single], weights[~single])


def _row(sampler: Sampler, own: _Text, other: _Text) -> tuple:
    cut = len(own.text) // 3
    edited = own.text[:len(own.text) - cut] + other.text[:cut]
    codes = np.concatenate([own.codes[:own.whole], sampler.codes(edited.split()[own.whole:])])
    sample = np.zeros(0, np.uint8)
    if len(codes):
        terms, weights, _ = weighted(codes)
        single = weights == 1
        fresh = terms[single]
        fresh = fresh[~np.isin(fresh, own.shared, assume_unique=True)]
        sample = sampler.best(np.minimum(own.least, sampler.least(fresh)), terms[~single], weights[~single])
    return (own.doc_id, len(own.text), hashlib.sha256(edited.encode()).hexdigest(), own.sample.tobytes().hex(),
            sample.tobytes().hex(), sampler.likeness(own.sample, sample), sampler.likeness(own.sample, other.sample))


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and the next document.

    The next document follows by descending id, after the last comes the first; rows with equal ids follow by
    a hash of the text, null ids come last, and a single document is its own next one. The last third of the code points, rounded
    down, is replaced by as many of the next document's first ones, or all it has. A null text is empty;
    two texts without words are alike (1), one of them and another text are not (0).

    Rows are dealt out by ranges of id. Within a range the next row is at hand; each range's first and last
    row are stored, and one row per range goes through a second step.
    """
    bound_batches(docs.sparkSession)
    # Ranges are found from a sample of ids and hash values that passes through the driver, never of texts.
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text").asc()]
    texts = keyed_texts(docs, key, text).repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, before, number = None, None, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sampler = sampler or Sampler()
                own = _Text(sampler, doc_id, body, before)
                if before is None:
                    rows.append((doc_id, *[None] * 6, number, True, body))
                else:
                    rows.append((*_row(sampler, before, own), None, None, None))
                before = own
            yield record_batch(rows, _OPEN)
        if before:
            yield record_batch([(before.doc_id, *[None] * 6, number, False, before.text)], _OPEN)

    found = written(texts.mapInArrow(walk, from_arrow_schema(_OPEN)), "fingerprints")
    edges = found.filter(F.col("range").isNotNull())
    firsts = edges.filter("first").select("range", F.col("text").alias("next"))
    # Numbers alone go through one task, no more of them than the shuffle has partitions.
    following = Window.orderBy("range")
    places = firsts.select("range", F.coalesce(F.lead("range").over(following), F.first_value("range").over(following)).alias("_next"))
    opened = (edges.filter(~F.col("first")).join(places, "range").select("doc_id", "text", "_next")
              .join(firsts.withColumnRenamed("range", "_next"), "_next").select("doc_id", "text", "next"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = None
        for batch in batches:
            rows = []
            for doc_id, body, following in zip(*[c.to_pylist() for c in batch.columns]):
                sampler = sampler or Sampler()
                rows.append(_row(sampler, _Text(sampler, doc_id, body), _Text(sampler, None, following)))
            yield record_batch(rows, _EDITED)

    closed = opened.mapInArrow(close, from_arrow_schema(_EDITED))
    return found.filter(F.col("range").isNull()).select(*_EDITED.names).unionByName(closed)
