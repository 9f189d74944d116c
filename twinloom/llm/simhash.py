"""SimHash near-dedup: pivot distance tables.

A text's fingerprint has a bit for each bit position that over half of the XXH64 hashes of its 3-word shingles have
set. Two fingerprints link at RADIUS or fewer differing bits; components of links are near-duplicate classes.

The pivot table has the Hamming distances of each fingerprint to 64 reference fingerprints: a base, for each of 16
blocks of four bits three references that differ from the base inside that block alone, and 15 at random. The distances
to a block's references, less that to the base, are the block's coordinates: they depend on that block's bits alone, and
tell its contents apart. A pair within RADIUS differs in RADIUS blocks at most, so if the blocks are split in three, the
pair has equal coordinates all over one part at least. The coordinates of one part, and of one part of three of the
other blocks, are the cell of a fingerprint: nine cells each, and no link without a common one. In a cell, a pair whose
largest difference in any coordinate of the table exceeds RADIUS is discarded (the triangle inequality), and survivors
are verified by their own distance. The members of a cell of more than CELL fingerprints go on to finer cells, by the
coordinates of one part of three of the blocks left, until two blocks are left and a cell can hold no more than 256.
Cells are streamed, so a task never holds more than CELL members. Equal fingerprints are one row before all this, so a
class of copies costs one row.

Null texts count as empty. Texts without a word have fingerprint 0 and link like any other. Repeated rows stay rows in
near_duplicates() and keep_first() keeps one of them. An empty table gives an empty result. Columns beside key and text
don't matter to near_duplicates(); keep_first() returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C
from twinloom.llm.components import components

RADIUS, SHINGLE, SEED = 2, 3, 42
CELL = 256
BLOCKS, RANDOM = 16, 15

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(raw: bytes) -> int:
    """As a signed 64-bit integer."""
    words = raw.translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    joined = b" ".join(words)
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    lo, hi = at[:n].tolist(), (at[min(SHINGLE, len(words)) : min(SHINGLE, len(words)) + n] - 1).tolist()
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        hashes = np.array([h(joined[a:b], SEED) for a, b in zip(lo[k : k + (1 << 16)], hi[k : k + (1 << 16)], strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def pivots() -> np.ndarray:
    """The reference fingerprints: a base, three for each block, and some at random. All are fixed."""
    base, *rest = np.random.default_rng(11).integers(0, 1 << 64, RANDOM + 1, dtype=np.uint64)
    # A block's bits are dealt in turn; its references flip bits 0 and 1, 0 and 2, and 1 to 3, whose counts give the block.
    bits = [[np.uint64(1 << (b + BLOCKS * i)) for i in range(4)] for b in range(BLOCKS)]
    local = [base ^ m for b in bits for m in (b[0] | b[1], b[0] | b[2], b[1] | b[2] | b[3])]
    return np.array([base, *local, *rest], np.uint64)


def table(fp: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The distances of each fingerprint to each reference."""
    return np.bitwise_count(fp[:, None] ^ references[None]).astype(np.int8)


def parts_left(path: int) -> tuple[list[int], list[int]]:
    """The blocks that a path of choices has agreed on, and the others. A path's digits to base 4 are choices 1 to 3."""
    agreed: list[int] = []
    left = list(range(BLOCKS))
    for d in np.base_repr(path, 4) if path else "":
        agreed, left = agreed + left[int(d) - 1 :: 3], [b for k, b in enumerate(left) if k % 3 != int(d) - 1]
    return agreed, left


def _cells(fp: np.ndarray, path: int, references: np.ndarray) -> np.ndarray:
    """The cells of fingerprints: hashes of the path and the agreed blocks' coordinates."""
    t = table(fp, references[: 1 + 3 * BLOCKS])
    own = (t[:, 1:] - t[:, :1]).reshape(len(fp), BLOCKS, 3)[:, parts_left(path)[0]].reshape(len(fp), -1).astype(np.int64).view(np.uint64)
    out = np.full(len(fp), path, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(own.shape[1]):
            out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + own[:, k])
    return out


def _finer(rows: DataFrame, start: bool) -> DataFrame:
    """key, path, fp: the nine cells of each fingerprint, or for members (fp, path) of large cells the three finer ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = pivots()
        for batch in batches:
            fps = np.asarray(batch.column(0)).view(np.uint64)
            of = np.zeros(len(fps), np.int64) if start else np.asarray(batch.column(1))
            for old in np.unique(of).tolist():
                fp = fps[of == old]
                for path in [4 * i + j for i in (1, 2, 3) for j in (1, 2, 3)] if start else [4 * old + j for j in (1, 2, 3)]:
                    yield pa.RecordBatch.from_arrays([pa.array(_cells(fp, path, references).view(np.int64)), pa.array(np.full(len(fp), path)), pa.array(fp.view(np.int64))], ["key", "path", "fp"])

    return rows.select("fp", *([] if start else ["path"])).mapInArrow(run, "key long, path long, fp long")


def _pairs(key: np.ndarray, fp: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs of neighbours in a cell; rows are sorted by cell."""
    t = table(fp, references)
    a, b = [], []
    gap = 1
    at = np.flatnonzero(key[1:] == key[:-1])
    while len(at):
        near = at.copy()
        for lo in range(0, t.shape[1], 16):  # most pairs go by the first coordinates
            near = near[np.abs(t[near, lo : lo + 16] - t[near + gap, lo : lo + 16]).max(1) <= RADIUS]
        near = near[np.bitwise_count(fp[near] ^ fp[near + gap]) <= RADIUS]
        a.append(near)
        b.append(near + gap)
        gap += 1
        at = at[at + gap < len(key)]
        at = at[key[at] == key[at + gap]]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell in; links (a, b) out, and (a, null, path) for members of cells that are too large."""
    references = pivots()
    last = {}  # whether a path's cells can't be split any more

    def told(a, b, path):
        a = pa.array(a.view(np.int64))
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([a, none if b is None else pa.array(b.view(np.int64)), none if path is None else pa.array(path)], ["a", "b", "path"])

    def whole(path: int) -> bool:
        if path not in last:
            last[path] = len(parts_left(path)[1]) < 3
        return last[path]

    def settle(key, path, fp):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        size = np.where([whole(p) for p in path[start].tolist()], np.minimum(size, CELL), size)
        of = np.repeat(size, np.diff(np.append(start, len(key))))
        if (of > CELL).any():
            yield told(fp[of > CELL], None, path[of > CELL])
        i, j = _pairs(key[of <= CELL], fp[of <= CELL], references)
        if len(i):
            yield told(fp[of <= CELL][i], fp[of <= CELL][j], None)

    key, path, fp, large = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        k, p = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        f = np.asarray(batch.column(2)).view(np.uint64)
        if not len(k):
            continue
        if large is not None:  # the last cell goes on, and was too large already
            n = int(np.searchsorted(k != large, True))
            if n:
                yield told(f[:n], None, p[:n])
            k, p, f = k[n:], p[n:], f[n:]
            if not len(k):
                continue
            large = None
        key, path, fp = np.concatenate([key, k]), np.concatenate([path, p]), np.concatenate([fp, f])
        end = int(np.searchsorted(key, key[-1]))
        if end:
            yield from settle(key[:end], path[:end], fp[:end])
        key, path, fp = key[end:], path[end:], fp[end:]
        if len(key) > CELL and not whole(int(path[0])):
            yield told(fp, None, path)
            large, key, path, fp = key[0], key[:0], path[:0], fp[:0]
    if len(key):
        yield from settle(key, path, fp)


def links(nodes: DataFrame) -> DataFrame:
    """a, b: all pairs of the distinct fingerprints (column fp) within RADIUS."""
    rows, out = _finer(nodes, True), None
    while True:
        found = C.checkpoint(rows.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_settled, "a long, b long, path long"))
        pairs = found.where("b is not null").select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
        large = found.where("b is null")
        if large.isEmpty():
            return out.distinct()
        rows = _finer(large.select(F.col("a").alias("fp"), "path"), False)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _classes(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (k, h: a hash of the text, fp), written, and one row a distinct fingerprint: fp, root, n rows."""
    picked = df.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), F.col(text).cast("string").alias("t"))

    def make():
        return lambda part: [part.column(0), part.column(1), pa.array([fingerprint(r) for r in C.text_bytes(part.column(2))], pa.int64())]

    rows = C.written(C.text_map(picked, ["k", "h", "t"], make, f"k {C.type_of(picked, 'k')}, h long, fp long"), "simhash")
    nodes = C.checkpoint(rows.groupBy("fp").agg(F.count("*").alias("n")))
    root = components(links(nodes))
    return rows, nodes.join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, fp (long), component_id (the least key reachable over links, its own included)."""
    rows, placed = _classes(df, key, text)
    placed = C.checkpoint(placed)
    least = rows.groupBy("fp").agg(F.min("k").alias("least")).join(placed, "fp")
    of_root = least.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = C.join_counted(placed.select("root", "fp", F.col("n").alias("m")), of_root, "root")
    return C.join_counted(rows.select("k", "fp"), named.select("fp", "component_id", "m"), "fp", "m").select(F.col("k").alias(key), "fp", "component_id")


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class: that of the least key and, of rows with this key, of the least hash of the text.

    Null keys come last. Rows that share key and text are one document: the first that is met stays.
    """
    rows, placed = _classes(df, key, text)
    own = rows.groupBy("k", "h", "fp").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("k").isNull().alias("no"), "k", "h")
    first = own.groupBy("fp").agg(F.min(F.struct(order.alias("o"), "copies")).alias("f")).join(placed, "fp").groupBy("root").agg(F.min("f").alias("f"))
    stay = C.checkpoint(first.select(F.col("f.o.k").alias("k"), F.col("f.o.h").alias("h"), F.col("f.copies").alias("copies")))
    a, b = C.fresh(df, "__k"), C.fresh(df, "__h")
    plain = [F.col(f"`{c}`") for c in df.columns]
    marked = df.withColumns({a: F.col(key), b: F.xxhash64(F.col(text))})
    met = lambda s: marked.join(s.select(F.col("k").alias("_k"), F.col("h").alias("_h")), F.col(a).eqNullSafe(F.col("_k")) & (F.col(b) == F.col("_h")), "left_semi")
    kept = met(stay.where("copies = 1")).select(*plain)
    repeated = stay.where("copies > 1")
    if repeated.isEmpty():
        return kept
    one = met(repeated).groupBy(a, b).agg(*(F.first(F.struct(*plain)).alias("r"),)).select("r.*")
    return kept.unionByName(one)
