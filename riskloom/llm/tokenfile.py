"""Token ids in binary files with Elias-Fano document boundaries.

A shard is one file: the ids of its documents one after another, in the
narrowest unsigned type that holds the vocabulary, then two Elias-Fano lists
(the boundaries, count + 1 numbers, and the document keys) and a fixed tail.
The shards hold the documents in ascending key order, keys that are null
first; a small table names each shard's file and counts.
"""

from __future__ import annotations

import functools
import itertools
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from tokenizers import Tokenizer

from riskloom.llm.bpe import ASCII_PIECE, REMEMBERED
from riskloom.llm.common import as_bytes, partitions, settle, sliced
from riskloom.llm.eliasfano import EliasFano
from riskloom.session import shared_folder

#: ids, documents, null keys, bytes of both lists, bytes per id, mark.
TAIL = "<QQQQQB7s"
MARK = b"EFTOKEN"
END_ID = 2
#: Text encoded at a time: the distinct chunks of a slice are looked up once.
SLICE_BYTES = 8 << 20
#: Ids of a file, about; bounds the lists of lengths and keys a worker holds.
SHARD_IDS = 1 << 26
ROWS = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


class Generations:
    """Values by key; of those not asked for since ``most`` others came, the oldest are forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, keys: list) -> list:
        """The value of each key, none where it is not known."""
        values = list(map(self.new.get, keys))
        if self.old:
            again = {}
            for k in [k for k, value in enumerate(values) if value is None]:
                if (value := self.old.get(keys[k])) is not None:
                    values[k] = again[keys[k]] = value
            self.add(again)
        return values

    def add(self, values: dict) -> None:
        if len(self.new) + len(values) > self.most:
            self.old, self.new = self.new, {}
        self.new.update(values)


class Encoder:
    """Ids of texts by the tokenizers library, which sees every piece of a word once.

    White space is no part of any token, and pieces of a word are encoded
    independently, so the distinct chunks of a batch are looked up, their
    pieces are where they are new, and the library gets the new pieces.
    """

    def __init__(self, path: str, width: str):
        self.library, self.width = tokenizer(path), np.dtype(width)
        self.chunks, self.pieces = Generations(REMEMBERED // 2), Generations(REMEMBERED // 2)
        self.find_ascii = re.compile(ASCII_PIECE)

    def learn(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Ids of chunks, all pieces that are new in one call of the library."""
        find = self.find_ascii.findall
        # Pieces as the library splits them; the whole chunk where only it knows.
        cut = [find(c.decode().lower()) if c.isascii() and b"<|" not in c else [c.decode()] for c in chunks]
        pieces = list(dict.fromkeys(itertools.chain.from_iterable(cut)))
        found = dict(zip(pieces, self.pieces.get(pieces), strict=True))
        missing = [p for p, ids in found.items() if ids is None]
        if missing:
            made = self.library.encode(missing, is_pretokenized=True, add_special_tokens=False)
            ids, words = np.array(made.ids, self.width).tobytes(), np.array(made.word_ids, np.int64)
            ends = (np.searchsorted(words, np.arange(len(missing) + 1)) * self.width.itemsize).tolist()
            new = {piece: ids[first:end] for piece, first, end in zip(missing, ends, ends[1:], strict=False)}
            self.pieces.add(new)
            found.update(new)
        return {c: found[own[0]] if len(own) == 1 else b"".join([found[p] for p in own]) for c, own in zip(chunks, cut, strict=True)}

    def encode(self, texts: list[bytes], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text), each text with ``end`` behind it."""
        words = [text.split() for text in texts]
        for own in words:
            own.append(b"")  # no text has an empty chunk: it stands for the end
        coded = pa.array(itertools.chain.from_iterable(words), pa.binary()).dictionary_encode()
        ends = np.cumsum(list(map(len, words))) - 1
        del words
        vocabulary = coded.dictionary.to_pylist()
        known = self.chunks.get(vocabulary)
        missing = [k for k, ids in enumerate(known) if ids is None]
        if missing:
            new = {b"": np.array([end], self.width).tobytes()}
            new |= self.learn([vocabulary[k] for k in missing if vocabulary[k]])
            for k in missing:
                known[k] = new[vocabulary[k]]
            self.chunks.add(new)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // self.width.itemsize
        flat = np.frombuffer(b"".join(known), self.width)
        index = coded.indices.to_numpy(zero_copy_only=False)
        lengths = sizes[index]
        total = np.cumsum(lengths)
        starts = (np.cumsum(sizes) - sizes)[index] - total + lengths
        ids = flat[np.repeat(starts, lengths) + np.arange(total[-1] if len(total) else 0)]
        return ids, np.diff(total[ends], prepend=0) if len(ends) else total


@functools.lru_cache(maxsize=4)
def encoder(path: str, width: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path, width)


class Writer:
    """One file under construction."""

    def __init__(self, system: fs.FileSystem, root: str, shard: int, width: str):
        self.system, self.width = system, np.dtype(width)
        self.name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        self.out = system.open_output_stream(self.name)
        self.lengths, self.keys, self.nulls, self.n_ids = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0, 0

    def add(self, ids: np.ndarray, lengths: np.ndarray, keys: pa.Array) -> None:
        self.out.write(ids.tobytes())
        self.lengths.append(lengths)
        self.nulls += keys.null_count
        self.keys.append(keys.drop_null().to_numpy())
        self.n_ids += len(ids)

    def close(self) -> int:
        """Write both lists and the tail; the number of documents."""
        bounds = np.cumsum(np.concatenate(self.lengths))
        lists = [EliasFano.of(bounds).to_bytes(), EliasFano.of(np.concatenate(self.keys)).to_bytes()]
        self.out.write(b"".join(lists))
        self.out.write(struct.pack(TAIL, self.n_ids, len(bounds) - 1, self.nulls, *map(len, lists), self.width.itemsize, MARK))
        self.out.close()
        return len(bounds) - 1


def write_shards(
    docs: DataFrame,
    path: str,
    folder: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    most: int = SHARD_IDS,
) -> DataFrame:
    """Encode every text, append the end id, write shards; returns their table.

    (shard, part, file, n_docs, n_ids): a task begins a new part once one has
    ``most`` ids. Null and empty texts hold the end id alone. Repeated rows are
    written each; documents of one key, or of none, stand in the order of their
    texts. A key that is no whole number is refused. A task writes to file
    names of its own and the table names the files of the task that counted, so
    lost or repeated tasks do no harm. ``folder`` must be reachable from every
    executor; by default it lies in the shared folder.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"keys of token files are whole numbers, {key} is {docs.schema[key].dataType.simpleString()}")
    folder = folder or shared_folder(docs.sparkSession)
    size = tokenizer(path).get_vocab_size(with_added_tokens=True)
    width = "<u2" if max(size, END_ID + 1) <= 1 << 16 else "<u4"
    ordered = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange(partitions(docs.sparkSession), "key").sortWithinPartitions("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, writer = TaskContext.get().partitionId(), 0, None
        system, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(root, recursive=True)
        known = encoder(path, width)

        def done() -> pa.RecordBatch:
            row = {"shard": [shard], "part": [part], "file": [writer.name], "n_docs": [writer.close()], "n_ids": [writer.n_ids]}
            return pa.RecordBatch.from_pydict(row, ROWS)

        for batch in sliced(batches, "text", SLICE_BYTES):
            if writer and writer.n_ids >= most:
                yield done()
                writer, part = None, part + 1
            writer = writer or Writer(system, root, shard, width)
            writer.add(*known.encode(as_bytes(batch, "text"), END_ID), batch.column("key"))
        if writer:
            yield done()

    shards = ordered.mapInArrow(write, "shard int, part int, file string, n_docs long, n_ids long")
    return settle(shards.withColumn("folder", F.lit(folder)))


class Shard:
    """One file, opened for direct access by document number."""

    def __init__(self, system: fs.FileSystem, name: str):
        self.file = system.open_input_file(name)
        end = self.file.size()
        tail = self.file.read_at(struct.calcsize(TAIL), end - struct.calcsize(TAIL))
        self.n_ids, self.n_docs, self.n_null, first, second, self.bytes, mark = struct.unpack(TAIL, tail)
        if mark != MARK:
            raise ValueError(f"{name} is no token file")
        at = self.n_ids * self.bytes
        self.bounds = EliasFano.from_bytes(self.file.read_at(first, at))
        self.keys = EliasFano.from_bytes(self.file.read_at(second, at + first))

    def ids(self, first: int, last: int | None = None) -> np.ndarray:
        """Ids of the documents ``first`` to before ``last``."""
        start, stop = self.bounds.select(first), self.bounds.select(first + 1 if last is None else last)
        data = self.file.read_at((stop - start) * self.bytes, start * self.bytes)
        return np.frombuffer(data, f"<u{self.bytes}")


def read_shards(shards: DataFrame, step: int = 256) -> DataFrame:
    """(key, start, n_tokens, ids) of every document of the files of ``shards``.

    ``start`` counts the ids of all documents before it, over all shards;
    ``ids`` holds little-endian unsigned 32-bit integers. A shard is read in
    steps of ``step`` documents.
    """
    # One row per file of some ten million ids.
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = settle(shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long")))
    schema = pa.schema([("key", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (row for batch in batches for row in batch.to_pylist()):
            folder = row["folder"]
            system, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
            shard = Shard(system, row["file"])
            keys = [None] * shard.n_null + shard.keys.numbers().tolist()
            bounds = shard.bounds.numbers()
            for first in range(0, shard.n_docs, step):
                last = min(first + step, shard.n_docs)
                ids = shard.ids(first, last).astype("<u4")
                own = bounds[first : last + 1]
                parts = [ids[a:b].tobytes() for a, b in zip(own - own[0], own[1:] - own[0], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[first:last], pa.int64()),
                        pa.array(own[:-1] + row["base"]),
                        pa.array(np.diff(own)),
                        pa.array(parts, pa.binary()),
                    ],
                    schema=schema,
                )

    spread = placed.repartition(partitions(shards.sparkSession), "shard", "part")
    return spread.mapInArrow(read, "key long, start long, n_tokens long, ids binary")
