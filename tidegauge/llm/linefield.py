"""Document quality by a linear-chain conditional random field over lines.

Every line of a text is one position of the chain and is labelled bad or good. Its features come from the line itself
and from its neighbours: character shares, words, repeats, likeness to the line before, and the shares of the lines on
both sides. Forward and backward passes give each line's marginal chance of being good; a document's quality is their
mean, weighted by the lines' lengths in bytes.

The field is fitted in numpy by the gradient of the conditional likelihood, on a bounded sample of labelled documents;
each line of a document carries the document's label. A line is what stands between two `\\n`, whatever its length.
"""

from __future__ import annotations

import operator
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.texts import keyed_texts, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FOLDS, HELD = 3, 1
# Bytes looked at together; bounds memory, whatever the length of a text.
PIECE = 1 << 20

# Classes of bytes: symbols, loud marks, capitals, small letters and all bytes of other scripts, digits, quiet marks, blanks.
_CLASSES = ("#*$%&|<>^~_=+{}[]@\\/", "!?", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789",
            ".,;:'\"()-`", " \t\r\v\f\n")
_OTHER = len(_CLASSES)
_TABLE = np.full(256, _OTHER, np.uint8)
for _number, _members in enumerate(_CLASSES):
    _TABLE[list(_members.encode())] = _number
_TABLE[128:] = 3
_KINDS = _OTHER + 1

# Features of a line that its neighbours see too.
_SEEN = ("symbols", "loud", "capitals", "letters", "distinct", "echoes")
NAMES = (*_SEEN, "bias", "many symbols", "some symbols", "digits", "marks", "words", "word length", "few distinct", "many echoes",
         "repeated", "wordless", "ended", "single", "bytes", "first", "last", "like before",
         *[f"{n} before" for n in _SEEN], *[f"{n} after" for n in _SEEN])


def _class_counts(raw: bytes, ends: np.ndarray) -> np.ndarray:
    """Bytes of each class in each line; `ends` has the place of each line's closing break."""
    counts = np.zeros((len(ends), _KINDS), np.int64)
    codes, line = np.frombuffer(raw, np.uint8), 0
    for at in range(0, len(codes), PIECE):
        part = codes[at:at + PIECE]
        breaks = part == 10
        # A break belongs to the line that it closes.
        own = np.cumsum(breaks, dtype=np.int64) - breaks
        lines = int(own[-1]) + 1
        made = np.bincount(own * _KINDS + _TABLE[part], minlength=lines * _KINDS)
        counts[line:line + lines] += made.reshape(lines, _KINDS)
        line += lines - 1 + int(breaks[-1])
    return counts


def _words(lines: list[str]) -> np.ndarray:
    """Per line: words, different ones, words equal to the one before, characters in words, single characters,
    whether an earlier line is equal, whether it ends like a sentence, words shared with the line before."""
    out = np.zeros((len(lines), 8), np.float64)
    met: set[str] = set()
    before: set[str] = set()
    for row, line in zip(out, lines):
        words = line.split()
        if words:
            kinds = set(words)
            row[:5] = (len(words), len(kinds), sum(map(operator.eq, words, words[1:])), sum(map(len, words)),
                       sum(len(w) == 1 for w in words))
            row[5] = line in met
            row[6] = words[-1][-1] in ".!?:;\"'”»"
            row[7] = len(kinds & before) / len(kinds | before)
            met.add(line)
            before = kinds
    return out


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, one after another; lines of each text; bytes of each line, at least 1."""
    split = [t.split("\n") for t in texts]
    sizes = np.array([len(lines) for lines in split], np.int64)
    raw = ("\n".join(texts) + "\n").encode("utf-8", "replace") if texts else b""
    breaks = np.concatenate([np.flatnonzero(np.frombuffer(raw[at:at + PIECE], np.uint8) == 10) + at
                             for at in range(0, len(raw), PIECE)] or [np.zeros(0, np.int64)])
    counts = _class_counts(raw, breaks)
    length = np.diff(breaks, prepend=-1) - 1
    word = np.concatenate([_words(lines) for lines in split] or [np.zeros((0, 8))])
    full, n = np.maximum(length, 1.0), np.maximum(word[:, 0], 1.0)
    letters = counts[:, 2] + counts[:, 3]
    own = {
        "symbols": counts[:, 0] / full, "loud": counts[:, 1] / full, "capitals": counts[:, 2] / np.maximum(letters, 1),
        "letters": letters / full, "distinct": word[:, 1] / n, "echoes": word[:, 2] / n,
        "bias": np.ones(len(word)), "many symbols": counts[:, 0] > 0.08 * full, "some symbols": counts[:, 0] > 0.02 * full,
        "digits": counts[:, 4] / full, "marks": counts[:, 5] / full, "words": np.log1p(word[:, 0]),
        "word length": np.minimum(word[:, 3] / n, 40), "few distinct": word[:, 1] < 0.35 * word[:, 0],
        "many echoes": word[:, 2] > 0.3 * n, "repeated": word[:, 5], "wordless": word[:, 0] == 0, "ended": word[:, 6],
        "single": word[:, 4] / n, "bytes": np.log1p(length), "like before": word[:, 7],
    }
    first, last = np.zeros(len(word)), np.zeros(len(word))
    ends = np.cumsum(sizes)
    first[ends - sizes] = last[ends - 1] = 1
    own["first"], own["last"] = first, last
    for name in _SEEN:
        column = own[name]
        own[f"{name} before"] = np.where(first > 0, column, np.roll(column, 1))
        own[f"{name} after"] = np.where(last > 0, column, np.roll(column, -1))
    return np.stack([own[n] for n in NAMES], axis=1).astype(np.float32), sizes, full


class Field:
    """Weights of the features for a good line, and of the four steps between bad (0) and good (1) lines."""

    def __init__(self, width: int):
        self.mean, self.spread = np.zeros(width), np.ones(width)
        self.weights, self.steps = np.zeros(width), np.zeros((2, 2))

    def chances(self, features: np.ndarray) -> np.ndarray:
        """Unnormalised weight of bad and good at each line, the greater one being 1."""
        score = np.clip((features - self.mean) / self.spread @ self.weights, -60, 60)
        return np.exp(np.stack([np.minimum(-score, 0), np.minimum(score, 0)], axis=1))

    def passes(self, chances: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised forward weights, backward weights, and the logarithm of the normaliser of each line.

        All texts step together: those with the most lines come first, so that a step works on the leading ones.
        """
        move = np.exp(self.steps)
        ahead, behind = np.empty_like(chances), np.ones_like(chances)
        logs = np.empty(len(chances))
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = np.searchsorted(-sizes, -np.arange(longest), side="left")
        state = None
        for t in range(longest):
            at = starts[:active[t]] + t
            state = chances[at] if t == 0 else (state[:active[t]] @ move) * chances[at]
            total = state.sum(axis=1)
            state = state / total[:, None]
            ahead[at], logs[at] = state, np.log(total)
        for t in range(longest - 2, -1, -1):
            at = starts[:active[t + 1]] + t
            back = (chances[at + 1] * behind[at + 1]) @ move.T
            behind[at] = back / back.sum(axis=1, keepdims=True)
        return ahead, behind, logs

    def marginals(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Chance of good at each line, given all lines of its text."""
        ahead, behind, _ = self.passes(self.chances(features), sizes)
        both = ahead * behind
        return both[:, 1] / both.sum(axis=1)

    def likelihood(self, scaled: np.ndarray, sizes: np.ndarray, good: np.ndarray, decay: float):
        """Mean loss of a text with the labels `good` of its lines, and gradients for weights and steps."""
        score = np.clip(scaled @ self.weights, -60, 60)
        chances = np.exp(np.stack([np.minimum(-score, 0), np.minimum(score, 0)], axis=1))
        ahead, behind, logs = self.passes(chances, sizes)
        both = ahead * behind
        marginal = both[:, 1] / both.sum(axis=1)
        linked = np.ones(len(good), bool)
        linked[np.cumsum(sizes) - 1] = False
        here = np.flatnonzero(linked)
        pairs = ahead[here, :, None] * np.exp(self.steps) * (chances[here + 1] * behind[here + 1])[:, None, :]
        pairs /= pairs.sum(axis=(1, 2), keepdims=True)
        taken = np.zeros((2, 2))
        np.add.at(taken, (good[here], good[here + 1]), 1)
        # The chances leave out the greater of both weights, so the labels' own ones are taken in the same way.
        own = np.where(good == 1, np.minimum(score, 0), np.minimum(-score, 0)).sum() + (taken * self.steps).sum()
        n = len(sizes)
        loss = (logs.sum() - own) / n + decay * ((self.weights ** 2).sum() + (self.steps ** 2).sum()) / 2
        return (loss, scaled.T @ (marginal - good) / n + decay * self.weights,
                (pairs.sum(axis=0) - taken) / n + decay * self.steps)

    def learn(self, features: np.ndarray, sizes: np.ndarray, labels: np.ndarray, how: Training) -> list[float]:
        """Fit by Adam over all texts at once; the loss at each step."""
        self.mean, self.spread = features.mean(axis=0, dtype=np.float64), features.std(axis=0, dtype=np.float64)
        self.mean[self.spread < 1e-9] = 0
        self.spread[self.spread < 1e-9] = 1
        scaled = (features - self.mean) / self.spread
        good = np.repeat(labels, sizes)
        moments = [np.zeros_like(self.weights), np.zeros_like(self.steps)]
        squares = [np.zeros_like(self.weights), np.zeros_like(self.steps)]
        losses = []
        for step in range(1, how.rounds + 1):
            loss, *grads = self.likelihood(scaled, sizes, good, how.decay)
            losses.append(float(loss))
            rate = how.rate * (1 - step / (how.rounds + 1))
            for held, m, v, g in zip((self.weights, self.steps), moments, squares, grads):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                held -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        return losses

    def quality(self, texts: list[str]) -> list[float]:
        """Length-weighted mean of the lines' marginals of each text."""
        features, sizes, length = line_features(texts)
        good = self.marginals(features, sizes) * length
        starts = np.cumsum(sizes) - sizes
        if not len(sizes):
            return []
        return np.clip(np.add.reduceat(good, starts) / np.add.reduceat(length, starts), 0, 1).tolist()


@dataclass(frozen=True)
class Training:
    """Bounds of the sample that the field is fitted on: `docs` documents of each label, drawn by hash of the id, and of
    each at most `lines` consecutive lines from a place that the hash chooses. Scoring reads every line of every text."""

    docs: int = 1500
    lines: int = 64
    rounds: int = 250
    rate: float = 0.1
    decay: float = 1e-3
    seed: int = 11


def held_out(key: Column) -> Column:
    """Whether a document is kept from training: the checksum of its id as text leaves 1 when divided by three."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


_SAMPLE = pa.schema([("label", pa.int32()), ("lines", pa.int32()), ("features", pa.list_(pa.float32()))])


def train(docs: DataFrame, labels: DataFrame, how: Training = Training(), key: str = "doc_id", text: str = "text",
          label: str = "quality") -> Field | None:
    """Fit on documents that are not held out and carry one label, 0 or 1; None without any.

    Ids are drawn from the labels, so that no text moves before the sample is fixed; it holds at most twice `docs`
    ids, which are broadcast. Of repeated ids the smallest text counts. Features are made where the texts are; the
    driver gets at most docs * lines rows of them for each label.
    """
    known = (labels.select(F.col(key).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most"))
             .filter(F.col("label") == F.col("_most")).drop("_most"))
    found = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not found:
        return None
    # Twice the sample lies below this border; ranks then cut it to size.
    largest = 2 ** 63 - 1
    border = F.element_at(F.create_map(*[F.lit(x) for k, n in found.items() for x in (
        k, largest * min(n, 2 * how.docs) // n)]), F.col("label"))
    drawn = known.withColumn("draw", F.xxhash64("doc_id", F.lit(how.seed)).bitwiseAND(F.lit(largest))).filter(F.col("draw") <= border)
    rank = F.row_number().over(Window.partitionBy("label").orderBy("draw", "doc_id"))
    sample = drawn.withColumn("rank", rank).filter(F.col("rank") <= how.docs).drop("rank")
    texts = (keyed_texts(docs, key, text).join(F.broadcast(sample), "doc_id")
             .groupBy("doc_id", "label", "draw").agg(F.min("text").alias("text")).select("label", "draw", "text"))
    bound = how.lines

    def make():
        def work(batch):
            marks, draws, bodies = (c.to_pylist() for c in batch.columns)
            features, sizes, _ = line_features(bodies)
            rows, counts, at = [], [], 0
            for size, draw in zip(sizes.tolist(), draws):
                first = at + (draw % (size - bound + 1) if size > bound else 0)
                rows.append(features[first:first + min(size, bound)].ravel())
                counts.append(min(size, bound))
                at += size
            return {"label": marks, "lines": counts, "features": rows}

        return work

    made = map_batches(texts, _SAMPLE, make).toArrow()
    if not made.num_rows:
        return None
    # Rows come in any order; sorted, the sums of the fit are the same each time.
    parts = sorted(((label, lines, np.array(row, np.float32)) for label, lines, row in zip(
        *[made.column(i).to_pylist() for i in range(3)])), key=lambda p: (p[0], p[1], p[2].tobytes()))
    field = Field(len(NAMES))
    field.learn(np.concatenate([p[2] for p in parts]).reshape(-1, len(NAMES)),
                np.array([p[1] for p in parts]), np.array([p[0] for p in parts]), how)
    return field


def score_quality(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_lines, worst_line.

    A null text is empty; an empty text is one line without a word and gets that line's marginal. `worst_line` is the
    first line (from 0) with the least marginal. Without a field every score is 0.5. Only the text decides.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32()), ("n_lines", pa.int64()), ("worst_line", pa.int64())])

    def make():
        def work(batch):
            out = {"doc_id": batch.column(0), "held_out": batch.column(1)}
            scores, counts, worst = [], [], []
            for group in _groups(batch.column(2)):
                features, sizes, length = line_features(group)
                good = field.marginals(features, sizes) if field else np.full(len(length), 0.5)
                starts = np.cumsum(sizes) - sizes
                scores += np.clip(np.add.reduceat(good * length, starts) / np.add.reduceat(length, starts), 0, 1).tolist()
                counts += sizes.tolist()
                least = np.repeat(np.minimum.reduceat(good, starts), sizes)
                places = np.flatnonzero(good == least)
                worst += (places[np.searchsorted(places, starts)] - starts).tolist()
            return {**out, "score": scores, "predicted": [int(s >= 0.5) for s in scores], "n_lines": counts, "worst_line": worst}

        return work

    rows = keyed_texts(docs, key, text).select("doc_id", held_out(F.col("doc_id")).alias("held"), "text")
    return map_batches(rows, schema, make)


def _groups(texts: pa.Array):
    """The texts in runs of about PIECE characters, so that a batch's features don't stand in memory at once."""
    run, size = [], 0
    for value in texts:
        run.append(value.as_py())
        size += len(run[-1])
        if size >= PIECE:
            yield run
            run, size = [], 0
    if run:
        yield run
