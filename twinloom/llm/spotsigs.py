"""Document fingerprints: SpotSigs.

Wherever a common word (an anchor) stands, the next CHAIN content words after it form a signature with it; the set of
a text's signatures is its fingerprint. Likeness is the Jaccard similarity of two sets, pruned: sets in parts of set
lengths that aren't neighbours, or whose lengths alone rule the wanted likeness out, are never looked at, and those
whose first signatures (so many that sets so alike share one) have nothing in common are looked at no further. What is
ruled out has likeness 0. edited_with_next() wants FLOOR, so smaller likenesses are 0 there.

A text with no full chain after an anchor takes every word as an anchor and any words as its chain (one signature of
all words if there are fewer than that). A text without words has one signature of its bytes. So equal texts have
equal fingerprints, and no fingerprint is empty. Null texts count as empty. Keys must be numbers. Rows of equal or null
keys have an order (edited_with_next), and alike() takes the least key of rows with equal sets. An empty table gives an
empty result. Columns beside key and text don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C

CHAIN = 3
#: The least likeness that edited_with_next() tells from 0.
FLOOR = 0.1

# Function words of English, German, French and Spanish, the usual anchors of common words.
ANCHORS = """
the of and to in is that for with was on as are be this by it from an at or not have has had but which his her their they we you
der die das und den dem des ein eine einer einem mit von zu im auf für ist nicht sich auch als bei aus nach wie
le la les un une de du des et en est que qui dans pour par sur au aux avec ne pas ce il elle se son sa
el los las una y del al se por con no su para como más lo pero sus
""".split()

_TABLE = C.word_table("alpha")


class Spotter:
    def __init__(self, anchors: list[str] = ANCHORS):
        self.anchors = np.unique(C.hash_words(sorted(set(anchors)), _TABLE))

    def signatures(self, t: C.Texts) -> list[np.ndarray]:
        """Of each text: its distinct signatures, sorted."""
        _, h, per = C.words(t, _TABLE)
        at = np.minimum(np.searchsorted(self.anchors, h), len(self.anchors) - 1)
        anchor = self.anchors[at] == h
        content = np.flatnonzero(~anchor)
        spots = np.flatnonzero(anchor)
        k = np.searchsorted(content, spots)
        text_end = per[np.searchsorted(per, spots, side="right")] if len(spots) else spots
        full = k + CHAIN - 1 < len(content)
        spots, k, text_end = spots[full], k[full], text_end[full]
        full = content[k + CHAIN - 1] < text_end
        spots, k = spots[full], k[full]
        sig = self._chain([h[spots], *(h[content[k + j]] for j in range(CHAIN))])
        bounds = np.searchsorted(spots, per)
        out = []
        for i in range(len(t)):
            s = sig[bounds[i] : bounds[i + 1]]
            if not len(s):
                w = h[per[i] : per[i + 1]]
                if len(w) > CHAIN:
                    s = self._chain([w[j : len(w) - CHAIN + j] for j in range(CHAIN + 1)])
                elif len(w):
                    s = self._chain([w[j : j + 1] for j in range(len(w))])
                else:
                    s = np.array([xxhash.xxh64_intdigest(t[i])], np.uint64)
            out.append(np.unique(s))
        return out

    @staticmethod
    def _chain(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(parts[0]), np.uint64)
        with np.errstate(over="ignore"):
            for p in parts:
                out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + p)
        return out


def length_part(n: int, at_least: float) -> int:
    """Parts of set lengths such that sets as alike as `at_least` are in the same part or in neighbours."""
    return int(np.floor(np.log(max(n, 1)) / -np.log(at_least) + 1e-9))


def prefix_size(n: int, at_least: float) -> int:
    """Sets as alike as `at_least` share one of so many first members, in any common order."""
    return n - int(np.ceil(n * at_least - 1e-9)) + 1


def likeness(a: np.ndarray, b: np.ndarray, at_least: float) -> float:
    """Jaccard similarity of sorted sets if it is `at_least` or more, else 0."""
    small, large = sorted((len(a), len(b)))
    if length_part(large, at_least) - length_part(small, at_least) > 1 or small < at_least * large:
        return 0.0
    x, y = (s[: prefix_size(len(s), at_least)] for s in (a, b))
    if x[0] > y[-1] or y[0] > x[-1] or not len(np.intersect1d(x, y, assume_unique=True)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (small + large - both)
    return found if found >= at_least else 0.0


def name_of(signatures: np.ndarray) -> str:
    """The set as a string: its size and a 128-bit hash of its members."""
    return f"{len(signatures):08x}{xxhash.xxh3_128_hexdigest(signatures.tobytes())}"


def _texts(raws: list[bytes]) -> C.Texts:
    return C.Texts(np.frombuffer(b"".join(raws), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, signatures (sorted array of long), fingerprint for each row."""

    def make():
        spotter = Spotter()

        def step(part: pa.RecordBatch):
            sets = spotter.signatures(C.texts_of(part.column(1).fill_null("")))
            return [part.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([name_of(s) for s in sets])]

        return step

    return C.text_map(df, [key, text], make, f"{key} {C.type_of(df, key)}, signatures array<bigint>, fingerprint string")


def alike(df: DataFrame, at_least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of rows with different sets and a likeness of `at_least` or more: a < b (the least keys of their sets), likeness.

    Rows with equal sets are one row. Sets meet within a length part or its neighbour, over their rarest signatures
    (by hash) in prefixes that a pair so alike must share; equal prefixes of ever more rows are what this join costs.
    """
    sets = fingerprints(df, key, text).groupBy("fingerprint").agg(F.min(key).alias("k"), F.first("signatures").alias("s"))
    sets = C.written(sets, "spotsigs")
    n = F.size("s")
    part = F.floor(F.log(n.cast("double")) / F.lit(float(-np.log(at_least)))).cast("int")
    prefix = F.slice("s", F.lit(1), n - F.ceil(n * at_least).cast("int") + 1)
    rows = sets.select("k", n.alias("n"), part.alias("p"), F.explode(prefix).alias("g"))
    left = rows.select(F.col("k").alias("a"), F.col("n").alias("na"), F.explode(F.array("p", F.col("p") + 1)).alias("p"), "g")
    met = left.join(rows.select(F.col("k").alias("b"), F.col("n").alias("nb"), "p", "g"), ["p", "g"]).where("a <> b").where((F.least("na", "nb") >= at_least * F.greatest("na", "nb")))
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.join(sets.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    return near.select("a", "b", (both / (F.size("sa") + F.size("sb") - both)).alias("likeness")).where(F.col("likeness") >= at_least)


# ---------------------------------------------------------------- a text and the one after it


def _edges(df: DataFrame, key: str, n: int) -> list:
    """At most n - 1 keys that cut the table in ranges of about equal rows."""
    got = df.select(F.col(key)).where(F.col(key).isNotNull()).approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    return sorted(set(got))


def edited_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text, and the same with its last third replaced by the start of the next text, in descending key order.

    key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. After the last row comes the
    first; a lone row is its own next. Null keys come last; rows of equal keys are ordered by a hash of their texts.

    Rows are dealt out by ranges of keys, with each range's first row sent to the range before it as well, so one
    shuffle of the compressed texts brings all neighbours together and no task holds more than a text and its next.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = np.array(_edges(df, key, n), np.float64)
    kind = df.schema[key].dataType

    def part_of(keys: pa.Array) -> np.ndarray:
        """Descending keys have ascending parts; the part after the others has the null keys."""
        k = np.array([np.nan if x is None else float(x) for x in keys.to_pylist()])
        return np.where(np.isnan(k), len(edges) + 1, len(edges) - np.searchsorted(edges, k, side="right")).astype(np.int64)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(part_of(b.column(0))), b.column(0)], ["p", "k"])

    heads = df.select(key).mapInArrow(parts, f"p long, k {kind.simpleString()}").groupBy("p").agg(F.max("k").alias("k")).orderBy("p").collect()  # a row a range
    before = {heads[i].p: heads[i - 1].p for i in range(len(heads))}  # the last range comes before the first
    head = {r.p: r.k for r in heads}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in C.chunks(batch, 1):
                keys, raws, p = b.column(0).to_pylist(), C.text_bytes(b.column(1)), part_of(b.column(0)).tolist()
                tie, blobs = [xxhash.xxh64_intdigest(r) >> 1 for r in raws], [press.compress(r) for r in raws]
                rows = [(p[i], 0, keys[i], tie[i], blobs[i]) for i in range(len(keys))]
                rows += [(before[p[i]], 1, keys[i], tie[i], blobs[i]) for i in range(len(keys)) if keys[i] == head[p[i]]]
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), b.column(0).type, pa.int64(), pa.binary()), strict=True)], ["p", "guest", "k", "tie", "t"])

    def judge(rows: list[tuple[object, bytes, bytes]], spotter: Spotter) -> pa.RecordBatch:
        own = [r.decode("utf-8", "surrogateescape") for _, r, _ in rows]
        nxt = [r.decode("utf-8", "surrogateescape") for _, _, r in rows]
        cut = [len(t) // 3 for t in own]
        edited = [(t[: len(t) - c] + x[:c]).encode("utf-8", "surrogateescape") for t, x, c in zip(own, nxt, cut, strict=True)]
        shared = {}  # a row's next is the row after it, most often in this list too
        for _, a, b in rows:
            shared.setdefault(a, None)
            shared.setdefault(b, None)
        for r, s in zip(shared, spotter.signatures(_texts(list(shared))), strict=True):
            shared[r] = s
        other = spotter.signatures(_texts(edited))
        mine, after = [shared[a] for _, a, _ in rows], [shared[b] for _, _, b in rows]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _, _ in rows], arrow_key), pa.array([len(t) for t in own], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array([name_of(s) for s in mine]), pa.array([name_of(s) for s in other]),
                pa.array([likeness(a, b, FLOOR) for a, b in zip(mine, other, strict=True)], pa.float64()), pa.array([likeness(a, b, FLOOR) for a, b in zip(mine, after, strict=True)], pa.float64()),
            ],
            ["k", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter, unpack = Spotter(), zstandard.ZstdDecompressor()
        rows, size, last = [], 0, None  # last: part, key and text of a row whose next isn't here yet
        for batch in batches:
            for b in C.chunks(batch, 3, 1 << 18):
                for p, guest, k, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if guest and (last is None or last[0] != p):
                        continue  # only the first guest of a part follows its last row
                    raw = unpack.decompress(t)
                    if last is not None:
                        rows.append((last[1], last[2], raw))
                        size += len(raw)
                    last = None if guest else (p, k, raw)
                    if size > C.CHUNK_BYTES:
                        yield judge(rows, spotter)
                        rows, size = [], 0
        if rows:
            yield judge(rows, spotter)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_key = to_arrow_type(kind)
    dealt = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(deal, f"p long, guest int, k {kind.simpleString()}, tie long, t binary")
    met = dealt.repartition("p").sortWithinPartitions("p", "guest", F.desc_nulls_last("k"), F.desc("tie")).select("p", "guest", "k", "t")
    schema = f"k {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return met.mapInArrow(pair, schema).withColumnRenamed("k", key)
