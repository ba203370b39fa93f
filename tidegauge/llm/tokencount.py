"""Token counts of a SentencePiece BPE model by merging ragged arrays of pre-tokens rank by rank.

All new pre-tokens of a batch lie in one flat array of symbols. In every round the pair of lowest
rank of each pre-token is found by a segmented minimum, and all pre-tokens apply theirs at once. A
pre-token's symbols that survive, with bytes for characters without a piece, are its tokens.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tidegauge.llm.merging import ROUND_CHARS, MergeRanks
from tidegauge.llm.pieces import Pieces
from tidegauge.llm.texts import MEMO_WORDS, keyed_texts, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LIMIT = 4096


class Counter:
    """Counts tokens of texts with a memo of pre-tokens."""

    def __init__(self, blob: bytes):
        self.pieces = Pieces(blob)
        self.merging, self.memo = MergeRanks(self.pieces.ranks), {}
        # Tokens that a surviving symbol stands for: bytes, where it is no piece.
        pieces = self.pieces
        self.tokens = np.array([len(n.encode()) if n not in pieces.ids and pieces.bytes else 1
                                for n in self.merging.names] + [0], np.int64)

    def learn(self, words: set[str]) -> None:
        """Count the tokens of words that the memo lacks."""
        short = [w for w in words if len(w) <= ROUND_CHARS]
        symbols, sizes = self.merging.survivors(short)
        if len(symbols):
            weight = self.tokens[symbols]
            spare = np.flatnonzero(symbols == self.merging.spare)
            if len(spare):
                known = self.merging.symbol
                foreign = [c for w in short for c in w if c not in known]
                weight[spare] = [len(c.encode()) if self.pieces.bytes else 1 for c in foreign]
            starts = np.cumsum(sizes) - sizes
            self.memo.update(zip(short, np.add.reduceat(weight, starts).tolist()))
        for word in words:
            if len(word) > ROUND_CHARS:
                self.memo[word] = len(self.pieces.encode_word(word)[0])

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces.words(n) if (n := self.pieces.normalise(t)[0]) else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        fresh = set()
        for words in split:
            fresh.update(words)
        self.learn(fresh.difference(self.memo))
        found = self.memo.__getitem__
        return [sum(map(found, words)) for words in split]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, UTF-8 bytes, tokens, and whether the tokens exceed `limit`.

    A null text is empty: no bytes, no tokens. Rows with equal or null keys each give a row.
    """
    with open(path, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()),
                        ("over_limit", pa.bool_())])

    def make():
        counter = Counter(shipped.value)

        def work(batch):
            texts = batch.column(1).to_pylist()
            counts = counter.count(texts)
            return {"doc_id": batch.column(0), "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return work

    return map_batches(keyed_texts(docs, key, text), schema, make)
