"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads all UTF-8 bytes of a text in lower case, labels every position from both directions, and is trained
in numpy by backpropagation through time. A document's probabilities are the mean over all its positions. States run
on through the text: it is taken in windows that a task computes side by side, and each window's states are warmed up
on the bytes before and after it, whose labels are left to the neighbouring windows.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.texts import filter_batches, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "und"
FOLDS = 5
# Bytes that a window labels, and bytes before and after them that only warm up its states.
WINDOW = 512
WARM = 32
# Windows that run side by side.
SIDE = 1024


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numerals such as Roman ones or powers are none."""
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Training:
    """Bounds of the training sample and the network.

    `docs` different texts of each of the `langs` most frequent languages, drawn by hash, give a stretch of `chars`
    characters from a place that the hash draws too. From these `windows` windows of `width` bytes, as many of each
    language, are drawn. The bounds hold for training alone; prediction reads every byte of every text.
    """

    docs: int = 300
    chars: int = 4000
    langs: int = 200
    windows: int = 6000
    width: int = 64
    hidden: int = 8
    epochs: int = 4
    batch: int = 128
    rate: float = 0.01
    seed: int = 7


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear gate: a sigmoid would take most of the time that a position takes."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def _slope(gate: np.ndarray) -> np.ndarray:
    return np.where((gate > 0) & (gate < 1), 0.25, 0).astype(gate.dtype)


class Direction:
    """One direction of the network: gates of byte b are rows of a table plus a product with the state."""

    NAMES = ("table", "gates", "cand")

    def __init__(self, hidden: int, rng: np.random.Generator):
        spread = 1 / np.sqrt(hidden)
        self.table = rng.normal(0, 0.3, (256, 3 * hidden)).astype(np.float32)
        self.gates = rng.normal(0, spread, (hidden, 2 * hidden)).astype(np.float32)
        self.cand = rng.normal(0, spread, (hidden, hidden)).astype(np.float32)

    def run(self, codes: np.ndarray, keep: np.ndarray | None = None, trace: list | None = None) -> np.ndarray:
        """States after each position; where `keep` is false the state stays. codes: windows x positions."""
        n, length = codes.shape
        h = self.cand.shape[0]
        # Gates lie apart and in order of time, so that each step works on whole arrays.
        of_z, of_r, of_c = (np.ascontiguousarray(self.table[:, i * h:(i + 1) * h]) for i in range(3))
        to_z, to_r = (np.ascontiguousarray(self.gates[:, i * h:(i + 1) * h]) for i in range(2))
        steps = np.ascontiguousarray(codes.T).astype(np.intp)
        state = np.zeros((n, h), self.cand.dtype)
        out = np.empty((length, n, h), self.cand.dtype)
        for t, byte in enumerate(steps):
            z = state @ to_z
            z += of_z.take(byte, axis=0)
            z = _gate(z)
            r = state @ to_r
            r += of_r.take(byte, axis=0)
            r = _gate(r)
            held = r * state
            c = held @ self.cand
            c += of_c.take(byte, axis=0)
            np.tanh(c, out=c)
            new = c - state
            new *= z
            new += state
            if keep is not None:
                new = np.where(keep[:, t, None], new, state)
            if trace is not None:
                trace.append((state, z, r, c, held))
            out[t] = state = new
        return out

    def back(self, codes, keep, trace, above) -> dict[str, np.ndarray]:
        """Gradients by backpropagation through time; above: gradients of the states, positions x windows x hidden."""
        h = self.cand.shape[0]
        grads = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        carried = np.zeros_like(above[0])
        for t in range(len(above) - 1, -1, -1):
            state, z, r, c, held = trace[t]
            mask = keep[:, t, None]
            total = above[t] + carried
            d = np.where(mask, total, 0)
            dz, dc = d * (c - state) * _slope(z), d * z * (1 - c * c)
            dheld = dc @ self.cand.T
            dr = dheld * state * _slope(r)
            dgate = np.concatenate([dz, dr], axis=1)
            grads["cand"] += held.T @ dc
            grads["gates"] += state.T @ dgate
            np.add.at(grads["table"], codes[:, t], np.concatenate([dgate, dc], axis=1))
            carried = np.where(mask, d * (1 - z) + dheld * r + dgate @ self.gates.T, total)
        return grads


class Network:
    """Both directions and the layer that turns their states into language probabilities."""

    def __init__(self, langs: list[str], hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.sides = Direction(hidden, rng), Direction(hidden, rng)
        self.top = rng.normal(0, 0.1, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), np.float32)

    def weights(self) -> list[tuple[object, str]]:
        return [(side, name) for side in self.sides for name in Direction.NAMES] + [(self, "top"), (self, "bias")]

    def states(self, codes, keep=None, traces=None):
        ahead = self.sides[0].run(codes, keep, traces and traces[0])
        # Read backwards, padding comes first and leaves the state at its start.
        behind = self.sides[1].run(codes[:, ::-1], None if keep is None else keep[:, ::-1], traces and traces[1])[::-1]
        return ahead, behind

    def _probabilities(self, ahead: np.ndarray, behind: np.ndarray) -> np.ndarray:
        h = len(self.top) // 2
        p = ahead @ self.top[:h]
        p += behind @ self.top[h:]
        p += self.bias
        # Beyond these bounds a probability is nil to single precision.
        np.exp(np.clip(p, -40, 40, out=p), out=p)
        p /= p @ np.ones((p.shape[2], 1), p.dtype)
        return p

    def positions(self, codes: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of each language at each position: positions x windows x languages."""
        return self._probabilities(*self.states(codes, keep))

    def gradients(self, codes, keep, lang) -> tuple[float, list[np.ndarray]]:
        """Mean loss over all positions, and its gradients in the order of `weights`."""
        traces: tuple[list, list] = ([], [])
        ahead, behind = self.states(codes, keep, traces)
        p = self._probabilities(ahead, behind)
        states = np.concatenate([ahead, behind], axis=2)
        mask, rows = keep.T.astype(np.float32), np.arange(len(lang))
        loss = -(np.log(p[:, rows, lang] + 1e-9) * mask).sum() / mask.sum()
        d = p
        d[:, rows, lang] -= 1
        d *= mask[:, :, None] / mask.sum()
        flat = states.reshape(-1, states.shape[2])
        top = flat.T @ d.reshape(-1, d.shape[2])
        above = d @ self.top.T
        h = above.shape[2] // 2
        first = self.sides[0].back(codes, keep, traces[0], above[:, :, :h])
        second = self.sides[1].back(codes[:, ::-1], keep[:, ::-1], traces[1], above[::-1, :, h:])
        return float(loss), [*(first[n] for n in Direction.NAMES), *(second[n] for n in Direction.NAMES),
                             top, d.sum(axis=(0, 1))]

    def learn(self, windows: list[bytes], lang: np.ndarray, how: Training) -> list[float]:
        """Train with Adam; the loss after each epoch."""
        rng = np.random.default_rng(how.seed)
        codes, keep = padded(windows)
        weights, moments, losses, step = self.weights(), {}, [], 0
        for epoch in range(how.epochs):
            order, total = rng.permutation(len(windows)), []
            for at in range(0, len(order), how.batch):
                part = order[at:at + how.batch]
                width = int(keep[part].sum(axis=1).max())
                loss, grads = self.gradients(codes[part, :width], keep[part, :width], lang[part])
                total.append(loss)
                step += 1
                rate = how.rate * (1 - epoch / how.epochs) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for k, ((owner, name), g) in enumerate(zip(weights, grads)):
                    m, v = moments.get(k, (0.0, 0.0))
                    moments[k] = m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    setattr(owner, name, (getattr(owner, name) - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32))
            losses.append(float(np.mean(total)))
        return losses


def padded(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes of windows, and which positions are filled."""
    sizes = np.array([len(w) for w in windows])
    keep = np.arange(sizes.max()) < sizes[:, None]
    codes = np.zeros(keep.shape, np.uint8)
    codes[keep] = np.frombuffer(b"".join(windows), np.uint8)
    return codes, keep


class Predictor:
    """Probabilities of texts."""

    def __init__(self, network: Network):
        self.network = network

    def sums(self, raws: list[bytes]) -> np.ndarray:
        """For each text the sums of the probabilities over all its positions."""
        owner, parts, first, last = [], [], [], []
        for i, raw in enumerate(raws):
            for at in range(0, len(raw), WINDOW):
                start, end = max(0, at - WARM), min(at + WINDOW, len(raw))
                owner.append(i)
                parts.append(raw[start:end + WARM])
                first.append(at - start)
                last.append(end - start)
        total = np.zeros((len(raws), len(self.network.langs)))
        owner, first, last = np.array(owner), np.array(first), np.array(last)
        order = np.argsort([-len(x) for x in parts], kind="stable")
        for at in range(0, len(order), SIDE):
            some = order[at:at + SIDE]
            codes, keep = padded([parts[i] for i in some])
            place = np.arange(codes.shape[1])[:, None]
            own = ((place >= first[some]) & (place < last[some])).astype(np.float32)
            p = self.network.positions(codes, None if keep.all() else keep)
            p *= own[:, :, None]
            np.add.at(total, owner[some], p.sum(axis=0))
        return total

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        raws = [t.lower().encode() if has_letter(t) else None for t in texts]
        different = list(dict.fromkeys(r for r in raws if r is not None))
        found = dict(zip(different, self.sums(different))) if different else {}
        langs, scores = [], []
        for raw in raws:
            if raw is None:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            best = int(found[raw].argmax())
            langs.append(self.network.langs[best])
            scores.append(min(1.0, float(found[raw][best] / len(raw))))
        return langs, scores


def held_out(key: str) -> Column:
    """Whether a document is kept from training: the checksum of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, how: Training = Training(), key: str = "doc_id", text: str = "text",
          lang: str = "lang") -> Network | None:
    """Fit on documents that are not held out and have a language; None without any.

    Only a bounded sample of different texts per language reaches the driver, the same whatever the partitioning.
    A first pass counts hash values by their order of magnitude, so that a second one draws little more than
    the sample, however many tasks read the documents and however often a text is repeated.
    """
    known = docs.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("lang"),
                        F.col(text).cast("string").alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("k"))
    drawn = known.select("lang", "text", F.xxhash64("text", F.lit(how.seed)).bitwiseAND(F.lit(2 ** 63 - 1)).alias("h"))
    start = F.col("h") % F.greatest(F.char_length("text") - how.chars + 1, F.lit(1)) + 1
    drawn = drawn.select("lang", "h", F.substring("text", start.cast("int"), F.lit(how.chars)).alias("text"))
    drawn = drawn.withColumn("level", F.floor(F.log2(F.greatest("h", F.lit(1)))))
    # At most 64 levels of a language; the counts are estimates, so twice the sample is asked for.
    levels = drawn.groupBy("lang", "level").agg(F.approx_count_distinct("h").alias("n"))
    below = F.sum("n").over(Window.partitionBy("lang").orderBy("level")) - F.col("n")
    cuts = (levels.withColumn("below", below).groupBy("lang")
            .agg(F.max(F.when(F.col("below") < 2 * how.docs, F.col("level"))).alias("cut"), F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "lang").limit(how.langs).collect())
    if not cuts:
        return None
    cut = F.create_map(*[F.lit(x) for r in cuts for x in (r["lang"], r["cut"])])
    draw = Window.partitionBy("lang").orderBy("h", "text")
    rows = (drawn.filter(F.col("level") <= F.try_element_at(cut, F.col("lang")))
            .groupBy("lang", "h").agg(F.min("text").alias("text"))
            .withColumn("n", F.row_number().over(draw)).filter(F.col("n") <= how.docs).orderBy("lang", "n").collect())
    texts = [(r["text"].lower().encode(), r["lang"]) for r in rows if has_letter(r["text"])]
    if not texts:
        return None
    langs = sorted({lang for _, lang in texts})
    rng = np.random.default_rng(how.seed)
    label = np.array([langs.index(lang) for _, lang in texts])
    # As many windows of each language, so that a frequent one isn't favoured, and as many of each of its bytes.
    sizes, windows, picked = np.array([len(raw) for raw, _ in texts], np.float64), [], []
    for i in range(len(langs)):
        own = np.flatnonzero(label == i)
        for at in rng.choice(own, how.windows // len(langs) + 1, p=sizes[own] / sizes[own].sum()):
            raw = texts[at][0]
            start = int(rng.integers(max(1, len(raw) - how.width + 1)))
            windows.append(raw[start:start + how.width])
            picked.append(i)
    network = Network(langs, how.hidden, how.seed)
    network.learn(windows, np.array(picked), how)
    return network


def _weights(network: Network) -> tuple:
    return network.langs, [getattr(owner, name) for owner, name in network.weights()]


def _restored(langs: list[str], weights: list[np.ndarray]) -> Network:
    network = Network(langs, weights[-2].shape[0] // 2, 0)
    for (owner, name), value in zip(network.weights(), weights):
        setattr(owner, name, value)
    return network


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    The score is the mean probability of the predicted language over all positions. A null text, one without
    a letter, and every text without a network is `und` with the score 0. Only the text decides.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                        ("score", pa.float64())])
    shipped = network and _weights(network)

    def make():
        predictor = shipped and Predictor(_restored(*shipped))

        def work(batch):
            texts = batch.column(2).to_pylist()
            langs, scores = predictor.predict(texts) if predictor else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            return {"doc_id": batch.column(0), "held_out": batch.column(1), "lang_pred": langs, "score": scores}

        return work

    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), held_out(key).alias("held"),
                       F.col(text).cast("string").alias("text"))
    return map_batches(rows, schema, make)


def keep_identified(docs: DataFrame, network: Network | None, least: float = 0.4,
                    text: str = "text") -> DataFrame:
    """Documents with a letter whose language is found with at least the score `least`, with all their columns."""
    at, shipped = docs.columns.index(text), network and _weights(network)

    def make():
        predictor = shipped and Predictor(_restored(*shipped))

        def work(batch):
            texts = batch.column(at).to_pylist()
            if not predictor:
                return [has_letter(t) for t in texts]
            return [lang != UNKNOWN and score >= least for lang, score in zip(*predictor.predict(texts))]

        return work

    return filter_batches(docs, make)
