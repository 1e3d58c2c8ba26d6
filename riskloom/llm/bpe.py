"""BPE encoding and decoding with forced-boundary splitting.

A merge only ever makes tokens of the vocabulary. Where two neighbouring
bytes stand side by side inside no token, no merge can cross, so a word may be
cut there for certain. The fragments are encoded independently of each other
and their ids put together again.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from riskloom.llm.common import as_bytes, sliced

#: Chunks of text (and half as many pieces of words) a worker remembers, about 200 bytes each.
REMEMBERED = 800_000
# Fixed value: contractions and kinds of characters of the format, in ASCII.
ASCII_PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+"
NONE = 1 << 60


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Remembered(dict):
    """Values made once per key, forgotten all at once when there are too many."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class Codec:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.vocabulary = {**model["vocab"], **self.special}
        self.tokens = [""] * (max(self.vocabulary.values()) + 1)
        for token, number in self.vocabulary.items():
            self.tokens[number] = token
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        # Neighbours inside any token; its end mark is no letter.
        inside = set()
        for token in model["vocab"]:
            letters = token.removesuffix(self.end) if self.end else token
            inside.update(zip(letters, letters[1:], strict=False))
        self.inside = inside
        self.letters = byte_letters()
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        # Unicode forms, lower case and kinds of letters as the library knows them.
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.find_ascii = re.compile(ASCII_PIECE)
        self.pieces = Remembered(self.piece_ids, REMEMBERED // 2)
        self.chunks = Remembered(self.chunk_ids)

    # --- encoding

    def encode(self, text: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian unsigned 32-bit integers."""
        # ASCII white space is no part of any token and ends every piece.
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def chunk_ids(self, chunk: bytes) -> bytes:
        text, ids, done = chunk.decode(), [], 0
        for special in self.cut_special.finditer(text):
            ids += self.plain_ids(text[done : special.start()])
            ids.append(self.special[special.group()].to_bytes(4, "little"))
            done = special.end()
        ids += self.plain_ids(text[done:])
        return b"".join(ids)

    def plain_ids(self, text: str) -> list[bytes]:
        if text.isascii():
            pieces = self.find_ascii.findall(text.lower())
            if not text.isprintable():
                pieces = ["".join(map(self.letters.__getitem__, piece.encode())) for piece in pieces]
        else:
            pieces = [piece for piece, _ in self.split(self.normal(text))]
        return list(map(self.pieces.__getitem__, pieces))

    def piece_ids(self, word: str) -> bytes:
        """Ids of one word, in the letters that stand for its bytes."""
        ids, first = [], 0
        for at in self.cuts(word):
            ids += self.fragment_ids(list(word[first:at]))
            first = at
        last = list(word[first:])
        last[-1] += self.end
        return np.array(ids + self.fragment_ids(last), "<u4").tobytes()

    def cuts(self, word: str) -> list[int]:
        """Places that no token can span."""
        inside = self.inside
        return [k for k, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in inside]

    def fragment_ids(self, symbols: list[str]) -> list[int]:
        """Merge neighbours by rank, the leftmost first among equals."""
        parts = self.merge_long(symbols) if len(symbols) > 64 else symbols
        rank_of = self.ranks.get
        ranks = [rank_of(pair, NONE) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < NONE:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank_of((parts[k - 1], parts[k]), NONE)
            if k < len(ranks):
                ranks[k] = rank_of((parts[k], parts[k + 1]), NONE)
        return [self.vocabulary[p] for p in parts if p in self.vocabulary]

    def merge_long(self, symbols: list[str]) -> list[str]:
        """The same merges by a heap of neighbours, for fragments of any length."""
        parts, n = list(symbols), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                pair = (parts[k], parts[after[k]])
                if pair in self.ranks:
                    heapq.heappush(heap, (self.ranks[pair], k, pair))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, pair = heapq.heappop(heap)
            if parts[k] != pair[0] or after[k] >= n or parts[after[k]] != pair[1]:
                continue  # merged meanwhile
            gone = after[k]
            parts[k], parts[gone] = pair[0] + pair[1], None
            after[k] = after[gone]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p is not None]

    # --- decoding

    def decode(self, ids: bytes) -> str:
        """The tokens of ids, as this format gives them: joined by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec per worker and file."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded) of every row.

    ``ids`` holds little-endian unsigned 32-bit integers, ``decoded`` what they
    decode to. Null and empty texts give no ids and an empty string. Every row
    gives one row, repeated or not, whatever its key. The vocabulary file must
    lie at ``path`` on every executor.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def encode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codec(path)
        for batch in sliced(batches, text, 1 << 20):
            ids = [known.encode(value) for value in as_bytes(batch, text)]
            decoded = [known.decode(value) for value in ids]
            columns = [batch.column(key), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "ids", "decoded"])

    return rows.mapInArrow(encode_batches, f"`{key}` {kind}, ids binary, decoded string")
