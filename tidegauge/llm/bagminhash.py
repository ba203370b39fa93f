"""Near duplicates by BagMinHash signatures of weighted word shingles.

A text is the multiset of its shingles of five words. For each shingle, strata of the weight axis, [0, 1), [1, 2),
[2, 4), [4, 8), ..., hold Poisson processes whose points have a time, a weight and a place of the signature. A shingle that
occurs w times takes the points below w; each place keeps the earliest time over all shingles. Equal places then
have the chance of the weighted Jaccard similarity. Points come in order of time, and a
stratum stops as soon as it is later than every place, so a shingle costs a few points, not one per place.

Signatures are banded; members of a bucket are compared with the bucket's centres by their whole multisets.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm.texts import MEMO_WORDS, map_batches, numbered, settled, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WORDS = 5
SIMILARITY = 0.8
# A pair at the least similarity shares no band with a chance of (1 - 0.8 ** ROWS) ** BANDS, below 4 in a million.
ROWS, BANDS = 4, 24
# Parts of the shingles' hash values for which texts count their shingles, to bound overlaps.
PARTS = 64
# Multisets that a task keeps while it compares pairs.
KEPT_SETS = 1000
# Most new centres of a bucket in a round.
MOST_CENTRES = 512

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hash values."""
    return ((x >> _U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


class Shingles:
    """Hash values of shingles, with a memo of words."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def codes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def of(self, words: list[str]) -> np.ndarray:
        """One value per shingle with repeats; fewer words than a shingle has are one shingle."""
        codes = self.codes(words)
        if not len(codes):
            return codes
        size = min(self.words, len(codes))
        total = np.zeros(len(codes) - size + 1, np.uint64)
        for i in range(size):
            total = _mixed(total + _U(int(_STEP) * (i + 1) % (1 << 64)) + codes[i:len(codes) - size + 1 + i])
        return total


def signatures(owner: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int, places: int) -> np.ndarray:
    """Earliest times per text and place; texts without shingles have infinite ones.

    `owner` is the text of each distinct shingle, `weight` how often it occurs there.
    """
    best = np.full(texts * places, np.inf)
    # Strata: number 0 is [0, 1), number j is [2 ** (j - 1), 2 ** j).
    strata = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    index = np.repeat(np.arange(len(owner)), strata)
    level = np.arange(len(index)) - np.repeat(np.cumsum(strata) - strata, strata)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    own, limit, state = owner[index], weight[index].astype(np.float64), _mixed(shingle[index] + _STEP * level.astype(np.uint64))
    time = np.zeros(len(index))
    latest = np.full(texts, np.inf)
    while len(own):
        state = state + _STEP
        time = time - np.log(_uniform(_mixed(state))) / (width * places)
        open_ = time < latest[own]
        own, low, width, limit, state, time = (x[open_] for x in (own, low, width, limit, state, time))
        if not len(own):
            break
        draw = _mixed(state ^ _U(0xA5A5A5A5A5A5A5A5))
        place = (draw % _U(places)).astype(np.int64)
        taken = low + width * _uniform(_mixed(draw)) < limit
        np.minimum.at(best, own[taken] * places + place[taken], time[taken])
        touched = own[taken]
        touched = touched[np.append(True, touched[1:] != touched[:-1])] if len(touched) else touched
        latest[touched] = best.reshape(texts, places)[touched].max(axis=1)
    return best.reshape(texts, places)


def bands(times: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash value for every `rows` places of each signature."""
    bits = times.view(np.uint64).reshape(len(times), -1, rows)
    total = np.arange(bits.shape[1], dtype=np.uint64)[None, :] * _STEP
    for i in range(rows):
        total = _mixed(total + bits[:, :, i])
    return total


def multiset(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingles, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of two multisets, exact; two empty ones are equal."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common, total = int(np.minimum(a[1][i], b[1][j]).sum()), int(a[1].sum() + b[1].sum())
    return common / (total - common) if total else 1.0


_SKETCH = pa.schema([("row", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def sketches(rows: DataFrame, words: int = WORDS, bands_: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """Per row: a digest of its words, the number of its shingles, and the hash values of its bands.

    rows: row BIGINT, text STRING.
    """

    def make():
        shingler = Shingles(words)

        def work(batch):
            texts = [t.split() for t in batch.column(1).to_pylist()]
            sets = [multiset(shingler.of(t)) for t in texts]
            sizes = [len(s[0]) for s in sets]
            owner = np.repeat(np.arange(len(sets)), sizes)
            shingle = np.concatenate([s[0] for s in sets]).astype(np.uint64)
            weight = np.concatenate([s[1] for s in sets]).astype(np.int64)
            times = signatures(owner, shingle, weight, len(sets), bands_ * per_band)
            found = bands(times, per_band).view(np.int64).tolist()
            return {"row": batch.column(0),
                    "digest": [hashlib.blake2b("\0".join(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts],
                    "n": [int(x[1].sum()) for x in sets], "bands": [b if n else [] for b, n in zip(found, sizes)]}

        return work

    return map_batches(rows.select("row", "text"), _SKETCH, make)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])


def _verified(pairs: DataFrame, texts: DataFrame, least: float, words: int) -> DataFrame:
    """Pairs (a, b) whose texts are at least so similar; texts: id, text."""
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
            .select("a", "b", "text_a", "text_b"))

    def make():
        shingler = Shingles(words)
        kept: dict[int, tuple] = {}

        def own(key, text):
            if key not in kept:
                if len(kept) > KEPT_SETS:
                    kept.clear()
                kept[key] = multiset(shingler.of(text.split()))
            return kept[key]

        def work(batch):
            made = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                value = similarity(own(a, x), own(b, y))
                if value >= least:
                    made.append((a, b, value))
            return dict(zip(_LINK.names, map(list, zip(*made)))) if made else {f.name: [] for f in _LINK}

        return work

    return map_batches(both, _LINK, make)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ends of links (a, b); the component is its smallest id.

    Every id takes the smallest component among its neighbours', then its component's component, until none
    changes: chains shorten by half each time. Only counts reach the driver.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    labels = written(labels, "labels")
    while True:
        offered = (both.join(labels.select(F.col("id").alias("a"), "component"), "a")
                   .groupBy(F.col("b").alias("id")).agg(F.min("component").alias("offer")))
        nearer = labels.join(offered, "id").select("id", F.col("component").alias("old"), F.least("component", "offer").alias("mid"))
        jumps = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        stepped = written(nearer.join(jumps, "mid").select("id", "old", F.least("mid", "far").alias("component")), "labels")
        labels = stepped.select("id", "component")
        if stepped.filter(F.col("old") != F.col("component")).isEmpty():
            return labels


_SHINGLE = pa.schema([("id", pa.int64()), ("shingle", pa.int64()), ("w", pa.int64())])
_COUNTED = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("degree", pa.int64()),
                      ("parts", pa.list_(pa.int32()))])


def _counted(texts: DataFrame, words: int) -> DataFrame:
    """Texts (id, text, n, degree) with the number of their shingles in each part."""

    def make():
        shingler = Shingles(words)

        def work(batch):
            found = [np.bincount((shingler.of(t.split()) % _U(PARTS)).astype(np.int64), minlength=PARTS).astype(np.int32)
                     for t in batch.column(1).to_pylist()]
            return {**dict(zip(_COUNTED.names, batch.columns)), "parts": found}

        return work

    return map_batches(texts.select(*_COUNTED.names[:4]), _COUNTED, make)


def _shingled(texts: DataFrame, words: int) -> DataFrame:
    """Distinct shingles of texts (id, text) with their weights."""

    def make():
        shingler = Shingles(words)

        def work(batch):
            sets = [multiset(shingler.of(t.split())) for t in batch.column(1).to_pylist()]
            ids = np.repeat(np.array(batch.column(0).to_pylist(), np.int64), [len(x[0]) for x in sets])
            return {"id": ids, "shingle": np.concatenate([x[0] for x in sets]).view(np.int64),
                    "w": np.concatenate([x[1] for x in sets])}

        return work

    return map_batches(texts.select("id", "text"), _SHINGLE, make)


_SLACK = 1e-6


def _total(counts: str | Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, n: total + n)


def _fits(least: float) -> Column:
    """Whether a centre and a member of its bucket may be similar enough: the sum over parts of the smaller
    number of shared shingles is at least their overlap."""
    overlap = _total(F.zip_with("centre.parts", "parts", lambda a, b: F.least(a, b)))
    return ((F.col("centre.n") <= F.col("reach")) & (F.col("n") <= F.col("centre.reach"))
            & (overlap * ((1 + least) / least) + _SLACK >= F.col("n") + F.col("centre.n")))


def _hopeful(members: DataFrame, texts: DataFrame, labels: DataFrame | None, least: float, words: int) -> DataFrame:
    """Members (bucket, id, rank) that may still be linked to another class of their bucket, with n and reach.

    Shingles that only one of the texts has can't be common to two. What is left of a text bounds its overlap with
    any other, and two texts of n and m shingles need an overlap of least / (1 + least) * (n + m). So a
    text reaches only texts of up to `reach` shingles, and the smallest text and longest reach among
    the other classes of a bucket tell which of its members reach nobody. Nothing is decided about pairs that may be similar enough.
    """
    own = texts.join(members.select("id").distinct(), "id")
    single = (_shingled(own, words).groupBy("shingle").agg(F.count(F.lit(1)).alias("texts"), F.min("id").alias("id"), F.min("w").alias("w"))
              .filter("texts = 1").groupBy("id", F.expr(f"cast(shingle & {PARTS - 1} as int)").alias("part")).agg(F.sum("w").alias("w"))
              .groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("part", "w"))).alias("single")))
    left = F.transform("parts", lambda total, part: (total - F.coalesce(F.try_element_at("single", part), F.lit(0))).cast("int"))
    bound = written(own.join(single, "id", "left").select("id", "n", left.alias("parts")).withColumn("shared", _total("parts"))
                    .filter(F.col("shared") + _SLACK >= F.col("n") * least)
                    .select("id", "n", "parts", (F.col("shared") * (1 + least) / least - F.col("n") + _SLACK).alias("reach")), "bounds")
    named = members.select("bucket", "id", "rank").join(bound, "id")
    if labels is not None:
        named = named.join(labels, "id", "left")
    own = F.col("id") if labels is None else F.coalesce("component", "id")
    held = written(named.select("bucket", "id", "rank", "n", "parts", "reach", own.alias("of")), "held")
    # Of each bucket the smallest text and the longest reach, and the same among all classes but that one's.
    classes = held.groupBy("bucket", "of").agg(F.min("n").alias("n"), F.max("reach").alias("reach"))
    tops = classes.groupBy("bucket").agg(F.min(F.struct("n", "of")).alias("small"), F.max(F.struct("reach", "of")).alias("long"))
    rest = classes.join(tops, "bucket").groupBy("bucket").agg(
        F.first("small").alias("small"), F.first("long").alias("long"),
        F.min(F.when(F.col("of") != F.col("small.of"), F.col("n"))).alias("small_other"),
        F.max(F.when(F.col("of") != F.col("long.of"), F.col("reach"))).alias("long_other"))
    smallest = F.when(F.col("of") == F.col("small.of"), F.col("small_other")).otherwise(F.col("small.n"))
    longest = F.when(F.col("of") == F.col("long.of"), F.col("long_other")).otherwise(F.col("long.reach"))
    return (held.join(rest, "bucket").filter((smallest <= F.col("reach")) & (F.col("n") <= longest))
            .select("bucket", "id", "rank", "n", "parts", "reach", "of"))


def _several(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of buckets that hold more than one class, ranked anew."""
    named = members if labels is None else members.join(labels, "id", "left")
    own = F.col("id") if labels is None else F.coalesce("component", "id")
    classes = named.groupBy("bucket", own.alias("of")).agg(F.count(F.lit(1)).alias("size"))
    several = (classes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes"), F.max(F.struct("size", "of")).alias("most"))
               .filter("classes > 1").select("bucket", F.col("most.of").alias("most")))
    # The largest class comes last as centres: once the others were compared with it, it is alone.
    return (named.join(several, "bucket").withColumn("rank", F.struct((own == F.col("most")).alias("l"), "rank.d", "rank.i"))
            .withColumn("of", own).select(*members.columns, *([] if "of" in members.columns else ["of"])))


def linked_classes(rows: DataFrame, least: float = SIMILARITY, words: int = WORDS, bands_: int = BANDS,
                   per_band: int = ROWS) -> DataFrame:
    """(row, class) of every row; the class is one of its rows. rows: row BIGINT, text STRING, fixed.

    Rows with equal words are one class from the start, and one of them stands for all. The others meet in buckets. In
    each round the members of a bucket are compared with its next centres, those that meet most others first and its
    largest class last; each round takes more centres than the one before. Members of one class are not compared again, and those that
    provably reach no other member leave. A bucket is done when its members are of one class or all its
    pairs across classes were compared.
    """
    sketched = written(sketches(rows, words, bands_, per_band), "sketches")
    whole = written(sketched.groupBy("digest").agg(F.min("row").alias("id"), F.min("n").alias("n"), F.min("bands").alias("bands")), "texts")
    met = whole.select("id", F.posexplode("bands").alias("band", "key"))
    sizes = met.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = written(met.join(sizes, ["band", "key"]).select(F.xxhash64("band", "key").alias("bucket"), "id", "size"), "members")
    # Those who meet many come first: an original meets all its near copies, which need not meet each other.
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    near = degree.join(whole.select("id", "n"), "id").select(F.col("id").alias("row"), "n", "degree")
    texts = written(_counted(rows.join(near, "row").select(F.col("row").alias("id"), "text", "n", "degree"), words), "near")
    rank = F.struct(F.lit(False).alias("l"), (-F.col("degree")).alias("d"), F.col("id").alias("i"))
    open_ = written(members.select("bucket", "id").join(texts.drop("text"), "id").select(
        "bucket", "id", rank.alias("rank"), "n", "parts", (F.col("n") / least + _SLACK).alias("reach"), F.col("id").alias("of")), "open")
    labels = links = None
    centres = 1
    while not open_.isEmpty():
        # Row numbers up to a literal: each task passes on no more rows of a bucket than centres are wanted.
        order = F.row_number().over(Window.partitionBy("bucket").orderBy("rank"))
        chosen = written(open_.select("bucket", "rank", "n", "parts", "reach", "of", order.alias("place")).filter(F.col("place") <= centres)
                         .select("bucket", F.struct("rank", "n", "parts", "reach", "of").alias("centre")), "centres")
        # Each centre is compared with the members behind it; those before were centres in earlier rounds.
        behind = (chosen["bucket"] == open_["bucket"]) & (F.col("centre.rank") < F.col("rank")) & (F.col("centre.of") != F.col("of")) & _fits(least)
        pairs = open_.join(chosen, behind).select(F.col("centre.rank.i").alias("x"), F.col("id").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        found = written(_verified(pairs, texts, least, words).select("a", "b"), "links")
        links = found if links is None else links.unionByName(found)
        if not found.isEmpty():
            labels = components(links)
        last = chosen.groupBy("bucket").agg(F.max("centre.rank").alias("last"))
        rest = open_.join(last, "bucket").filter("rank > last").select("bucket", "id", "rank")
        rest = written(_several(rest, labels), "rest")
        open_ = rest if rest.isEmpty() else written(_several(_hopeful(rest, texts, labels, least, words), labels), "open")
        centres = min(8 * centres, MOST_CENTRES)
    named = sketched.select("row", "digest").join(whole.select("digest", "id"), "digest")
    if labels is None:
        return named.select("row", F.col("id").alias("class"))
    return named.join(labels, "id", "left").select("row", F.coalesce("component", "id").alias("class"))


def _chosen(docs: DataFrame, key: str, text: str, **how) -> tuple[DataFrame, str, DataFrame, DataFrame]:
    """The numbered documents with the name of their number, (row, class, doc_id), and for each class its size `n_class`,
    the row `first` that stands for it and that row's key `class_id`. Classes are stored, so that a join with
    them has a shuffle of its own and adaptive execution may split a large class."""
    rows, number = numbered(docs)
    texts = rows.select(F.col(number).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    classes = settled(docs.sparkSession, lambda: linked_classes(texts, **how), "classes")
    keyed = classes.join(rows.select(F.col(number).alias("row"), F.col(f"`{key}`").cast("bigint").alias("doc_id")), "row")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    firsts = keyed.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n_class"))
    firsts = firsts.select("class", F.col("first.row").alias("first"), F.col("first.doc_id").alias("class_id"), "n_class")
    return rows, number, keyed, written(firsts, "firsts")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per document: doc_id, class_id, n_class, kept.

    Two texts are linked when the multisets of their shingles are similar enough, and classes are the connected
    documents; `class_id` is the smallest doc_id of the class, null ids being largest, and `kept` marks one
    of its rows, of equal ids the first stored one. Null texts are empty; texts without words are one class.
    """
    _, _, keyed, firsts = _chosen(docs, key, text, **how)
    return keyed.join(firsts, "class").select("doc_id", "class_id", "n_class", (F.col("row") == F.col("first")).alias("kept"))


def keep_distinct(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each class, with all its columns."""
    rows, number, _, firsts = _chosen(docs, key, text, **how)
    return rows.join(firsts.select(F.col("first").alias(number)), number, "left_semi").drop(number)
