"""Benchmark decontamination: BM25 inverted index of test items with block-max WAND.

Test items are indexed; every passage of a text (PASSAGE words, a new one each STRIDE words, to the text's end) is a
query, and all items whose BM25 score reaches their threshold are retrieved, with no top-k. Upper bounds of blocks of
items (block-max) rule out most passages at once; the rest run WAND over the postings. Passages that retrieve one item
and overlap are a run. An item is a leak if the words of one run, and as many around it as the item has, hold at least
CONTAINED of its 5-word shingles and OVERLAP of its question's and of its answer's words; of several such runs that with
the most shingles is told (of equal ones, the first).

An item without an answer column has its last sentence as answer (or its last third, if it is one sentence). Items
without words never match; items of fewer than five words match as a whole. Items of equal texts all match, items of
equal or null ids are items of their own, and null item texts are left out. Null and empty texts have no passage, so
they leak nothing and stay. Repeated rows have equal results each. Empty tables leak nothing. Extra columns don't
matter to leaks(); clean_rows() returns them as they are.

The index is built per block of items of at most INDEX_BYTES of text (or one longer item), and so many blocks are
broadcast at a time, so a larger test set means more passes and not a larger broadcast. Item count, mean length and
document frequencies are those of all items, so that scores and thresholds don't depend on the blocks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C

PASSAGE, STRIDE, SHINGLE = 64, 16, 5
#: An item is retrieved at this share of the score it has against itself (for a long item, of what a passage is sure to hold of it).
SHARE, CONTAINED, OVERLAP = 0.6, 0.8, 0.8
K1, B = 1.2, 0.75
INDEX_BYTES, BLOCK_ITEMS, MAX_BLOCKS = 4 << 20, 8, 32
#: Index blocks that one pass over the texts asks, one after the other.
AT_ONCE = 4
#: Passages of one text whose bounds are summed together.
PASSAGES = 4096

_TABLE = C.word_table("alnum")
_SENTENCE = re.compile(r"[.!?]\s+")


def shingles(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of n words (one of all words if there are fewer)."""
    n = max(1, min(n, len(h)))
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for i in range(n):
            out = C.mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    ends = [m.end() for m in _SENTENCE.finditer(text.rstrip())]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    k = len(words) - len(words) // 3
    return " ".join(words[:k]), " ".join(words[k:])


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return C.words(C.Texts(raw, np.array([0, len(raw)])), _TABLE)[1]


#: Number of items, their mean number of words, and words (sorted hashes) with the number of items that have them.
Statistics = tuple[int, float, np.ndarray, np.ndarray]


def _terms(block: list[tuple[object, str, str]]) -> tuple[list[int], np.ndarray, np.ndarray]:
    words = [np.concatenate([_hashes(q), _hashes(s)]) for _, q, s in block]
    return [len(w) for w in words], *np.unique(np.concatenate([np.zeros(0, np.uint64), *map(np.unique, words)]), return_counts=True)


def statistics(blocks: Iterable[list[tuple[object, str, str]]]) -> Statistics:
    """Of the items of all blocks."""
    items, size, vocabulary, df = 0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for block in blocks:
        sizes, terms, counts = _terms(block)
        items, size = items + len(sizes), size + sum(sizes)
        vocabulary, at = np.unique(np.concatenate([vocabulary, terms]), return_inverse=True)
        df = np.bincount(at, np.concatenate([df, counts]), len(vocabulary)).astype(np.int64)
    return items, max(1.0, size / max(1, items)), vocabulary, df


def of_block(block: list[tuple[object, str, str]], of_all: Statistics) -> Statistics:
    """of_all with the block's words alone."""
    items, mean, vocabulary, df = of_all
    own = _terms(block)[1]
    return items, mean, own, df[np.searchsorted(vocabulary, own)]


class Index:
    """Postings with impacts as shares of the item's threshold, so that 1 is every item's threshold.

    The statistics are those of all items if these are one of several blocks.
    """

    def __init__(self, items: list[tuple[object, str, str]], of_all: Statistics | None = None):
        self.ids = [i for i, _, _ in items]
        self.question, self.answer = ([_hashes(x[k]) for x in items] for k in (1, 2))
        self.words = [np.concatenate(x) for x in zip(self.question, self.answer, strict=True)]
        self.shingles = [np.unique(shingles(w)) for w in self.words]
        sizes = np.array([len(w) for w in self.words], float)
        n, mean, self.vocabulary, df = of_all or statistics([items])
        terms = [np.unique(w, return_counts=True) for w in self.words]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        self.postings: list[list[int]] = [[] for _ in self.vocabulary]
        self.impacts: list[list[float]] = [[] for _ in self.vocabulary]
        self.scale = np.ones(len(items))
        self.block = max(BLOCK_ITEMS, -(-len(items) // MAX_BLOCKS))  # items a block
        self.n_blocks = -(-len(items) // self.block)
        self.block_max = np.zeros((len(self.vocabulary) + 1, self.n_blocks))
        for i, (t, tf) in enumerate(terms):
            if not len(t):
                continue
            at = np.searchsorted(self.vocabulary, t)
            w = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean))
            self.scale[i] = SHARE * w.sum() * min(1.0, (PASSAGE - STRIDE) / sizes[i])
            w = w / self.scale[i] + 1e-9
            for k, x in zip(at.tolist(), w.tolist(), strict=True):
                self.postings[k].append(i)
                self.impacts[k].append(x)
            self.block_max[at, i // self.block] = np.maximum(self.block_max[at, i // self.block], w)
        self.list_max = np.append([max(x) for x in self.impacts], 0.0)
        self.bounds = self.block_max.tolist()

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Term of each word; the last for words that no item has."""
        n = len(self.vocabulary)
        if not n:
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), n - 1)
        return np.where(self.vocabulary[at] == hashes, at, n)

    def wand(self, terms: list[int]) -> list[tuple[int, float]]:
        """All items with a score of at least 1 against the distinct terms."""
        found, end = [], len(self.ids)
        cursors = [[self.postings[t][0], t, 0] for t in terms]
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, t, _) in enumerate(cursors):
                bound += self.list_max[t]
                if bound >= 1:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // self.block
            if sum(self.bounds[t][block] for _, t, _ in cursors[: pivot + 1]) < 1:
                to = min((block + 1) * self.block, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end)
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][p] for _, t, p in cursors[: pivot + 1])
                if score >= 1:
                    found.append((item, score))
                to = item + 1
            else:
                to = item
            for c in cursors[: pivot + 1]:
                if c[0] < to:
                    c[2] = bisect_left(self.postings[c[1]], to, c[2])
                    c[0] = self.postings[c[1]][c[2]] if c[2] < len(self.postings[c[1]]) else end
            cursors = [c for c in cursors if c[0] < end]
        return found

    def retrieved(self, hashes: np.ndarray) -> dict[int, list[tuple[float, int, int]]]:
        """Of one text's words: item -> its runs: best score (1 is the threshold), first word and end of the passages."""
        n = len(hashes)
        if not n or not len(self.vocabulary):
            return {}
        terms = self.lookup(hashes)
        lo = np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE)
        edges = np.stack([lo, np.minimum(lo + PASSAGE, n)])
        total = np.concatenate([[0.0], np.cumsum(self.list_max[terms])])
        found: dict[int, list[tuple[float, int, int]]] = {}
        some = np.flatnonzero(total[edges[1]] - total[edges[0]] >= 1 - 1e-6)  # sums of many words round
        for part in np.split(some, np.flatnonzero(np.diff(edges[0, some] // (PASSAGES * STRIDE))) + 1) if len(some) else ():
            first, last = int(edges[0, part[0]]), int(edges[1, part[-1]])
            bound = np.concatenate([np.zeros((1, self.n_blocks)), np.cumsum(self.block_max[terms[first:last]], axis=0)])
            for k in part[(bound[edges[1, part] - first] - bound[edges[0, part] - first]).max(1) >= 1 - 1e-6]:
                a, b = int(edges[0, k]), int(edges[1, k])
                own = np.unique(terms[a:b])
                own = own[own < len(self.vocabulary)]
                if self.block_max[own].sum(0).max(initial=0) < 1:
                    continue
                for item, score in self.wand(own.tolist()):
                    runs = found.setdefault(item, [])
                    if runs and a < runs[-1][2]:
                        runs[-1] = (max(runs[-1][0], score), runs[-1][1], b)
                    else:
                        runs.append((score, a, b))
        return found

    def leaks(self, hashes: np.ndarray) -> Iterator[tuple[object, float, float, float, float]]:
        """item id, BM25 score, contained share of shingles, question's and answer's word overlap."""
        for item, runs in sorted(self.retrieved(hashes).items()):
            words = self.words[item]
            best = None
            for score, a, b in runs:
                near = hashes[max(0, a - len(words)) : b + len(words)]
                if len(near) < min(SHINGLE, len(words)):
                    continue
                contained = float(np.isin(self.shingles[item], shingles(near, min(SHINGLE, len(words)))).mean())
                if contained < CONTAINED or best is not None and contained <= best[1]:
                    continue
                q, s = (float(np.isin(x, near).mean()) if len(x) else 1.0 for x in (self.question[item], self.answer[item]))
                if q >= OVERLAP and s >= OVERLAP:
                    best = (score * float(self.scale[item]), contained, q, s)
            if best is not None:
                yield (self.ids[item], *best)


def item_blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> Iterator[list[tuple[object, str, str]]]:
    """The test items, in blocks of about INDEX_BYTES of text: (id, question, answer). Null texts are left out."""
    given = "question" in items.columns and "answer" in items.columns
    body = F.concat_ws("\n", "question", "answer") if given else F.col(text)
    rows = items.where(body.isNotNull()).select(F.col(key).alias("k"), *([F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("s")] if given else [body.alias("q")]), F.octet_length(body).alias("n"))
    n = max(1, -(-int(rows.agg(F.sum("n")).first()[0] or 0) // INDEX_BYTES))
    for i in range(n):
        block = rows.where(F.pmod(F.xxhash64("k", "q"), F.lit(n)) == i).orderBy("k", "q").toArrow().to_pylist()
        yield [(r["k"], r["q"], r["s"]) if given else (r["k"], *split_item(r["q"])) for r in block]


def _passes(df: DataFrame, items: DataFrame, key: str, text: str) -> Iterator[list]:
    """Broadcasts of AT_ONCE blocks at most, each with its statistics."""
    of_all = statistics(item_blocks(items, key, text))
    now: list = []
    for block in item_blocks(items, key, text):
        if len(now) == AT_ONCE:
            yield now
            now = []
        now.append(df.sparkSession.sparkContext.broadcast((block, of_block(block, of_all))))
    yield now


def _indexes(shared: list) -> list[Index]:
    return [Index(*x.value) for x in shared]


def leaks(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per text and item that it leaks: key, item_id, bm25, contained, question_overlap, answer_overlap.

    With more than one pass, each is run, written to the shared folder and its broadcasts let go.
    """
    out, last = None, None
    schema = f"{key} {C.type_of(df, key)}, item_id {C.type_of(items, item_key)}, bm25 double, contained double, question_overlap double, answer_overlap double"
    kinds = items.select(item_key).limit(0).toArrow().schema.field(0).type

    def found(shared: list) -> DataFrame:
        def make():
            indexes = _indexes(shared)

            def step(part: pa.RecordBatch):
                _, h, per = C.words(C.texts_of(part.column(1).fill_null("")), _TABLE)
                got = [(i, *x) for i in range(len(per) - 1) for index in indexes for x in index.leaks(h[per[i] : per[i + 1]])]
                cols = list(zip(*got, strict=True)) or [[]] * 6
                return [part.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], kinds), *(pa.array(c, pa.float64()) for c in cols[2:])]

            return step

        return C.text_map(df, [key, text], make, schema)

    for shared in _passes(df, items, item_key, item_text):
        if last is not None:
            done = C.written(found(last), "leaks")
            out = done if out is None else out.unionByName(done)
            for b in last:
                b.destroy()
        last = shared
    return found(last) if out is None else out.unionByName(found(last))


def clean_rows(df: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """df without the rows that leak an item; all columns as they are. Passes as in leaks()."""
    last = None

    def kept(rows: DataFrame, shared: list) -> DataFrame:
        def make():
            indexes = _indexes(shared)

            def keep(column: pa.Array) -> list[bool]:
                _, h, per = C.words(C.texts_of(column.fill_null("")), _TABLE)
                return [all(next(index.leaks(h[per[i] : per[i + 1]]), None) is None for index in indexes) for i in range(len(per) - 1)]

            return keep

        return C.filter_rows(rows, text, make)

    for shared in _passes(df, items, item_key, item_text):
        if last is not None:
            df = C.written(kept(df, last), "clean")
            for b in last:
                b.destroy()
        last = shared
    return kept(df, last)
