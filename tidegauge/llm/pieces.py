"""SentencePiece BPE encoding that keeps the place of every piece in the original bytes.

A text is normalised by the longest match in the model's compiled character map; each normalised
character remembers the byte where its source starts. Pieces are found by merging in score order,
characters without a piece fall back to bytes, and every piece is projected back through the alignment.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece.sentencepiece_model_pb2 as model_format
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from tidegauge.llm.merging import ROUND_CHARS, MergeRanks
from tidegauge.llm.texts import keyed_texts, map_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the model format: the space mark, and the kinds of pieces.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
# Words that an encoder's memo may hold before it starts anew.
ENTRIES = 500_000


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, whose values point into a string table."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.table = blob[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that starts at `at`, and its replacement."""
        units, node, found = self.units, 0, None
        if not units:
            return None
        unit = units[0]
        node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for end in range(at, len(text)):
            byte = text[end]
            node ^= byte
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != byte:
                break
            node ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                value = units[node] & ((1 << 31) - 1)
                found = end + 1 - at, self.table[value:self.table.index(b"\0", value)]
        return found


class Pieces:
    """Vocabulary and normalisation rules of a BPE model."""

    def __init__(self, blob: bytes):
        model = model_format.ModelProto()
        model.ParseFromString(blob)
        kinds = [p.type for p in model.pieces]
        if model.trainer_spec.model_type != BPE or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        rules = model.normalizer_spec
        if rules.remove_extra_whitespaces or not rules.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep white space and mark it at the front of words are supported")
        self.map, self.prefix = CharacterMap(rules.precompiled_charsmap), rules.add_dummy_prefix
        self.names = [p.piece for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = [p.score for p in model.pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        ranked = sorted(self.ids, key=lambda p: -self.scores[self.ids[p]])
        self.ranks = {p: rank for rank, p in enumerate(ranked)}
        self.pattern = self._pattern()

    def _pattern(self) -> re.Pattern | None:
        """Matches stretches that no merge can leave: characters that meet in no piece part them.

        Characters that stand side by side in some piece, directly or through others, form a class. A space
        mark belongs to what follows; if some piece has one after another character, texts stay whole.
        """
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            return None
        parent: dict[str, str] = {}

        def root(c: str) -> str:
            while parent.setdefault(c, c) != c:
                c = parent[c]
            return c

        for piece in self.ids:
            body = piece.lstrip(SPACE)
            for a, b in zip(body, body[1:]):
                parent[root(a)] = root(b)
        classes: dict[str, list[str]] = {}
        for c in parent:
            classes.setdefault(root(c), []).append(c)
        runs = sorted((f"[{re.escape(''.join(sorted(m)))}]+" for m in classes.values() if len(m) > 1), key=len, reverse=True)
        return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+", re.DOTALL)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its characters, and its end, the first source byte."""
        if not text:
            return "", np.zeros(1, np.int64)
        if not self.map.units:
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            body = text
        else:
            raw, at, parts, places = text.encode(), 0, [], []
            while at < len(raw):
                hit = self.map.longest(raw, at)
                if hit is None:
                    width = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                    hit = width, raw[at:at + width]
                piece = hit[1].decode()
                parts.append(piece)
                places += [at] * len(piece)
                at += hit[0]
            body, starts = "".join(parts), np.array([*places, at], np.int64)
            if not body:
                return "", starts
        body = body.replace(" ", SPACE)
        return (SPACE + body, np.concatenate([[0], starts])) if self.prefix else (body, starts)

    def words(self, normal: str) -> list[str]:
        """Parts that no merge can cross."""
        return self.pattern.findall(normal) if self.pattern else [normal]

    def merge(self, word: str) -> list[str]:
        """Merge neighbours, the best score first and the leftmost of equals, until none is a piece."""
        ids, ranks = self.ids, self.ranks
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = []

        def offer(left: int, right: int) -> None:
            whole = parts[left] + parts[right]
            found = ranks.get(whole)
            if found is not None:
                heapq.heappush(heap, (found, left, len(whole)))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            if parts[left] is None or right >= len(parts) or len(parts[left]) + len(parts[right]) != size:
                continue
            whole = parts[left] + parts[right]
            if whole not in ids:
                continue
            parts[left], parts[right] = whole, None
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < len(parts):
                    offer(a, b)
        return [p for p in parts if p is not None]

    def encode_word(self, word: str) -> tuple[list[int], list[int]]:
        """Ids, and the number of normalised characters of each; of a character's bytes the last one has it."""
        found, sizes = [], []
        for piece in self.merge(word):
            if piece in self.ids:
                found.append(self.ids[piece])
                sizes.append(len(piece))
            elif self.bytes:
                raw = piece.encode()
                found += [self.bytes[b] for b in raw]
                sizes += [0] * (len(raw) - 1) + [len(piece)]
            else:
                found.append(self.unknown)
                sizes.append(len(piece))
        return found, sizes

    def surface(self, ids: list[int]) -> str:
        """The normalised characters of ids: byte pieces join to characters."""
        values, parts, pending = {i: b for b, i in self.bytes.items()}, [], bytearray()
        for i in [*ids, None]:
            if i in values:
                pending.append(values[i])
                continue
            if pending:
                parts.append(bytes(pending).decode("utf-8", "replace"))
                pending.clear()
            if i is not None:
                parts.append(self.names[i])
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: space marks become spaces, without the one that encoding adds in front."""
        text = self.surface(ids).replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Encoder:
    """Encodes texts with a memo of words: ids, their decimal form, piece lengths and decoded text."""

    def __init__(self, blob: bytes):
        self.pieces, self.memo = Pieces(blob), {}
        self.merging = MergeRanks(self.pieces.ranks)
        self.ids = np.array([self.pieces.ids.get(n, -1) for n in self.merging.names] + [-1], np.int64)
        self.sizes = np.array([len(n) for n in self.merging.names] + [1], "<u4")

    def _learn(self, words: list[str]) -> None:
        """Entries of words that the memo lacks; those with characters outside the vocabulary go one by one."""
        short = [w for w in words if len(w) <= ROUND_CHARS]
        symbols, counts = self.merging.survivors(short)
        ids, sizes = self.ids[symbols], self.sizes[symbols].tobytes()
        at, names = 0, list(map(str, ids.tolist()))
        foreign = np.add.reduceat(ids < 0, np.cumsum(counts) - counts).tolist() if len(ids) else []
        for word, n, odd in zip(short, counts.tolist(), foreign):
            if odd:
                self.memo[word] = self._entry(word)
            else:
                self.memo[word] = n, ",".join(names[at:at + n]), sizes[4 * at:4 * (at + n)], word
            at += n
        for word in words:
            if len(word) > ROUND_CHARS:
                self.memo[word] = self._entry(word)

    def _entry(self, word: str) -> tuple[int, str, bytes, str]:
        """Number of ids, their decimal form, the characters of each, and the decoded characters."""
        ids, sizes = self.pieces.encode_word(word)
        return len(ids), ",".join(map(str, ids)), np.array(sizes, "<u4").tobytes(), self.pieces.surface(ids)

    def parts(self, texts: list[str]) -> list[tuple[list[tuple], np.ndarray]]:
        """For each text the memo's entries of its words, and the source byte where each normalised character starts."""
        if len(self.memo) > ENTRIES:
            self.memo.clear()
        normal = [self.pieces.normalise(t) for t in texts]
        split = [self.pieces.words(n) if n else [] for n, _ in normal]
        fresh = set()
        for words in split:
            fresh.update(words)
        self._learn(list(fresh.difference(self.memo)))
        found = self.memo.__getitem__
        return [(list(map(found, words)), starts) for words, (_, starts) in zip(split, normal)]

    @staticmethod
    def _ends(found: list[tuple]) -> np.ndarray:
        return np.cumsum(np.frombuffer(b"".join([e[2] for e in found]), "<u4"), dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Ids, and the first and the end byte of each piece in the text's UTF-8."""
        for found, starts in self.parts(texts):
            ends = self._ends(found)
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)[:len(ends)]
            yield [int(i) for e in found for i in e[1].split(",")], starts[begins], starts[ends]

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, int, int]]:
        """Number of ids, digests of ids and of the decoded text, covered source bytes, checksum of the end bytes."""
        for found, starts in self.parts(texts):
            decoded = "".join([e[3] for e in found]).replace(SPACE, " ")
            if self.pieces.prefix and decoded.startswith(" "):
                decoded = decoded[1:]
            ends = starts[self._ends(found)]
            yield (sum([e[0] for e in found]),
                   hashlib.sha256(",".join([e[1] for e in found]).encode()).hexdigest(),
                   hashlib.sha256(decoded.encode()).hexdigest(),
                   int(ends[-1]) if len(ends) else 0, zlib.crc32(ends.astype("<i8").tobytes()))


def _model(docs: DataFrame, path: str):
    with open(path, "rb") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, ids, and begins and ends of each piece in the text's bytes.

    A null text is empty and has no ids. Rows with equal or null keys each give a row.
    """
    shipped = _model(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())),
                        ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])

    def make():
        encoder = Encoder(shipped.value)

        def work(batch):
            found = list(encoder.encode(batch.column(1).to_pylist()))
            return {"doc_id": batch.column(0), "ids": [f[0] for f in found],
                    "begins": [f[1] for f in found], "ends": [f[2] for f in found]}

        return work

    return map_batches(keyed_texts(docs, key, text), schema, make)


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`encode` reduced in the task to numbers and digests of ids, decoded text and byte spans."""
    shipped = _model(docs, path)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string()), ("span_bytes", pa.int64()), ("spans_crc32", pa.int64())])

    def make():
        encoder = Encoder(shipped.value)

        def work(batch):
            found = list(zip(*encoder.digests(batch.column(1).to_pylist())))
            return dict(zip(schema.names, [batch.column(0), *map(list, found)]))

        return work

    return map_batches(keyed_texts(docs, key, text), schema, make)
