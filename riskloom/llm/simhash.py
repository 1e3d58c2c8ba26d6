"""SimHash near-duplicate groups by tiled exact comparison."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import as_bytes, settle, sliced
from riskloom.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints compared with as many others in one task step.
BLOCK = 4096
PARTS = 4
WIDTH = 64 // PARTS


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 hashes of all word shingles; 0 without words."""
    words = text.lower().split()  # both act on ASCII alone
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
        shingles = list(shingles)
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, len(shingles)
    )
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    ones = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as signed long) of every row; null and empty texts give 0."""
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()

    def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = [fingerprint(value) for value in as_bytes(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(found, pa.int64())], [key, "fingerprint"]
            )

    return rows.mapInArrow(fingerprint_batches, f"`{key}` {kind}, fingerprint long")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts within the radius, one of each opposite pair, and none."""
    steps = itertools.product(range(-radius, radius + 1), repeat=PARTS)
    return [s for s in steps if sum(map(abs, s)) <= radius and s >= (0,) * PARTS]


def near_links(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(source, target) links that connect all fingerprints within ``radius`` bits.

    ``prints`` has distinct fingerprints. Bits that differ change the bit
    counts of a fingerprint's four 16-bit parts by no more than their number,
    so a tile holds the fingerprints of equal part counts and is compared with
    the tiles within the radius only, each pair of tiles once. Tiles are split
    into blocks of about ``block`` rows, whatever their size. A pair of blocks
    is compared exactly, and gives a spanning forest of its links in place of
    all of them: what is connected stays connected.
    """
    parts = [F.bit_count(F.shiftrightunsigned("fingerprint", WIDTH * k).bitwiseAND((1 << WIDTH) - 1)) for k in range(PARTS)]
    placed = prints.select("fingerprint", F.array(*parts).alias("at"))
    moves = F.array(*[F.array(*map(F.lit, step)) for step in _offsets(radius)])
    visits = placed.select(
        "fingerprint", F.explode(F.transform(moves, lambda s: F.zip_with("at", s, lambda a, b: a + b))).alias("at")
    )
    # Tiles are at most 17 ** 4 in number, so their sizes may be broadcast.
    blocks = lambda n: F.ceil(n / F.lit(block)).cast("int")
    homes = placed.groupBy("at").agg(blocks(F.count(F.lit(1))).alias("rows"))
    guests = visits.groupBy("at").agg(blocks(F.count(F.lit(1))).alias("columns"))
    sizes = settle(homes.join(guests, "at"))
    turn = F.xxhash64("fingerprint")
    grid = F.broadcast(sizes)
    home = placed.join(grid, "at").select(
        "at",
        F.pmod(turn, F.col("rows")).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"),
        "fingerprint",
        F.lit(True).alias("home"),
    )
    guest = visits.join(grid, "at").select(
        "at",
        F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"),
        F.pmod(turn, F.col("columns")).cast("int").alias("j"),
        "fingerprint",
        F.lit(False).alias("home"),
    )
    one = F.concat_ws("/", F.concat_ws(".", "at"), "i", "j").alias("cell")
    cells = home.unionByName(guest).select(one, "fingerprint", "home")

    def compare(cell: pa.Table) -> pa.Table:
        values = cell["fingerprint"].to_numpy()
        at_home = cell["home"].to_numpy()
        source, target = forest(values[at_home], values[~at_home], radius)
        return pa.table({"source": source, "target": target})

    return cells.groupBy("cell").applyInArrow(compare, "source long, target long")


def forest(home: np.ndarray, guests: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (each to the smallest of its group) that connect all near pairs of two blocks."""
    nodes = np.unique(np.concatenate([home, guests]))
    label = np.arange(len(nodes))
    left, right = home.view(np.uint64), guests.view(np.uint64)
    places = np.searchsorted(nodes, guests)
    for first in range(0, len(left), 256):
        part = left[first : first + 256]
        near = np.bitwise_count(part[:, None] ^ right[None, :]) <= radius
        near &= part[:, None] != right[None, :]
        for row in np.flatnonzero(near.any(axis=1)):
            group = np.append(places[near[row]], np.searchsorted(nodes, home[first + row]))
            known = np.unique(label[group])
            if len(known) > 1:
                label[np.isin(label, known)] = known[0]
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def near_groups(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(key, fingerprint, component_id): the smallest key reachable over near fingerprints.

    Equal fingerprints, also of rows without words (0), are one node, so
    copies never become pairs. Rows with a null key keep their row; a group
    of null keys alone has a null component. Repeated rows stay repeated.
    """
    prints = settle(fingerprints(docs, key, text))
    nodes = settle(prints.groupBy("fingerprint").agg(F.min(key).alias("least")))
    roots = components(near_links(nodes.select("fingerprint"), radius))
    rooted = nodes.join(roots, nodes.fingerprint == roots.node, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = settle(rooted.join(heads, "root").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint").select(key, "fingerprint", "component_id")


def one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its near-duplicate group.

    Rows that repeat one key are alike in it and stay; rows with a null key stay.
    """
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kept = near_groups(named, "key", "text").filter(F.col("key") == F.col("component_id")).select("key").distinct()
    lone = docs.filter(F.col(key).isNull())
    return docs.join(kept, docs[key] == kept["key"], "left_semi").unionByName(lone)
