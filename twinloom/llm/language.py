"""Language ID: error-correcting output codes over byte n-grams.

Each language gets a codeword; one binary classifier a bit, on hashed 1- to 3-grams of the lower-cased bytes, predicts
it; loss-weighted decoding picks the language whose codeword costs least, and a small lead marks the text ambiguous.

Texts that are null or have no letter are `und` with score 0. With no labelled row every text is `und`; with one
language every text with a letter is that language with score 1. Ties go to the language first in byte order. Equal
texts get equal results, so repeated rows stay rows; in the fit, rows of equal key and text count once. Whole texts are
read, in the fit too. An empty table gives an empty result. Columns beside key and text don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C

#: Bounds of the sample that the classifiers are fitted on: rows a language, and rows of all (but one a language at least).
SAMPLE_ROWS, SAMPLE_TOTAL = 400, 6000
#: So many languages' counts are broadcast at most; more are joined by a shuffle.
BROADCAST = 100_000
BUCKETS = 1 << 13
#: A lead in mean loss below this marks a text ambiguous.
AMBIGUOUS = 0.05

_LETTER = regex.compile(r"\p{L}")


def _table() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


_BYTES = _table()


def histogram(raw: bytes) -> np.ndarray:
    """Root of the relative frequency of each n-gram bucket, of the whole text; unit length."""
    b = _BYTES[np.frombuffer(raw.decode("utf-8", "replace").lower().encode(), np.uint8)].astype(np.uint32)
    if len(b) == 0:
        return np.zeros(BUCKETS, np.float32)
    grams = [b]
    if len(b) > 1:
        grams.append(b[:-1] * np.uint32(257) + b[1:] + np.uint32(1 << 17))
    if len(b) > 2:
        grams.append(b[:-2] * np.uint32(66049) + b[1:-1] * np.uint32(257) + b[2:] + np.uint32(1 << 25))
    at = (np.concatenate(grams) * np.uint32(2654435761)) >> np.uint32(32 - 13)
    n = np.bincount(at, minlength=BUCKETS)
    return np.sqrt(n / n.sum()).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k rows of +1 and -1: all splits of the classes if those are few, else the best of random codes."""
    if k <= 2:
        return np.array([[1.0], [-1.0]])[:k]
    if k <= 6:
        bits = np.array([[1 if i == 0 else (j >> (i - 1)) & 1 for j in range(2 ** (k - 1) - 1)] for i in range(k)])
        return 2.0 * bits - 1
    rng, n = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    draws = (2.0 * rng.integers(0, 2, (k, n)) - 1 for _ in range(50))
    return max(draws, key=lambda c: (n - (c @ c.T - 2 * n * np.eye(k)).max()) / 2)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # of each bit's classifier, by its accuracy in training

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Mean weighted logistic loss of each language's codeword."""
        margins = x @ self.weights + self.bias
        return np.logaddexp(0, -margins[:, None, :] * self.code[None]) @ self.trust / self.trust.sum()


class Sparse:
    """Rows of n-gram weights; products are taken over dense blocks of rows."""

    BLOCK = 2048

    def __init__(self, at: list[np.ndarray], value: list[np.ndarray]):
        self.at, self.value, self.kept = at, value, None

    def __len__(self) -> int:
        return len(self.at)

    def blocks(self):
        if self.kept is not None:
            yield self.kept
            return
        for lo in range(0, len(self), self.BLOCK):
            x = np.zeros((min(self.BLOCK, len(self) - lo), BUCKETS), np.float32)
            for i in range(len(x)):
                x[i, self.at[lo + i]] = self.value[lo + i]
            if len(self) <= self.BLOCK:
                self.kept = (lo, x)
            yield lo, x


def fit(x: Sparse, labels: list[str], steps: int = 120) -> Model:
    """Logistic regressions of all bits at once by accelerated gradient descent, rows weighted by 1 / language size."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    place = {v: i for i, v in enumerate(languages)}
    y_at = np.array([place[v] for v in labels], dtype=np.int64)
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, code.shape[1] if len(languages) else 1), np.float32), np.zeros(1), np.ones(1))
    y = code[y_at]
    row = (1 / np.bincount(y_at)[y_at])[:, None]
    row /= row.sum()
    w = v = np.zeros((BUCKETS, code.shape[1]))
    b = vb = np.zeros(code.shape[1])
    for i in range(steps):
        gw, gb = np.zeros_like(w), np.zeros_like(b)
        for lo, block in x.blocks():
            own = slice(lo, lo + len(block))
            g = -row[own] * y[own] / (1 + np.exp(np.clip(y[own] * (block @ v.astype(np.float32) + vb), -50, 50)))
            gw += block.T @ g.astype(np.float32)
            gb += g.sum(0)
        nw, nb = v - 6 * (gw + 1e-5 * v), vb - 6 * gb
        m = i / (i + 3)
        v, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    right = np.zeros(code.shape[1])
    for lo, block in x.blocks():
        right += ((block @ w.astype(np.float32) + b) * y[lo : lo + len(block)] > 0).sum(0)
    return Model(languages, code, w.astype(np.float32), b, np.maximum(right / len(x) - 0.5, 0.01))


def train(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, sample_total: int = SAMPLE_TOTAL) -> Model:
    """Fit on at most `sample_rows` rows of each language, and about `sample_total` of all, chosen by a hash of key and text.

    Rows are first thinned by the hash to little more than their language's share, then the least hashes of each
    language are taken, so no language's rows ever meet in one task. n-grams are counted on the executors.
    """
    rows = df.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("o"), F.col(text).cast("string").alias("t"))
    sizes = C.checkpoint(rows.groupBy("l").agg(F.count("*").alias("n")))
    known = sizes.count()
    share = max(1, min(sample_rows, sample_total // max(1, known)))
    # of n rows, the `share` least hashes are below this part of all hashes, but for a chance of less than 1e-9
    part = (share + 6 * float(np.sqrt(share)) + 36) / F.col("n")
    thin = rows.join(F.broadcast(sizes) if known <= BROADCAST else sizes, "l").where((F.shiftrightunsigned("o", 11).cast("double") / float(1 << 53)) < part)
    one = thin.groupBy("l", "o").agg(F.min("t").alias("t"))

    def make():
        def step(part: pa.RecordBatch):
            grams = [histogram(r) for r in C.text_bytes(part.column(2))]
            at = [np.flatnonzero(g) for g in grams]
            return [part.column(0), part.column(1), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([g[a].tobytes() for g, a in zip(grams, at, strict=True)], pa.binary())]

        return step

    got = C.text_map(one, ["l", "o", "t"], make, "l string, o long, at binary, value binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["l"], r["o"] % (1 << 64), r["o"]))  # as unsigned
    taken, last, n = [], None, 0
    for r in got:
        n = n + 1 if r["l"] == last else 1
        last = r["l"]
        if n <= share:
            taken.append(r)
    return fit(Sparse([np.frombuffer(r["at"], np.uint16) for r in taken], [np.frombuffer(r["value"], np.float32) for r in taken]), [r["l"] for r in taken])


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, lang_pred, score (softmax of the losses), runner_up, ambiguous."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS times the code's length

    def make():
        m = shared.value

        def step(part: pa.RecordBatch):
            raws = C.text_bytes(part.column(1))
            lang, score, second, unsure = ["und"] * len(raws), np.zeros(len(raws)), [None] * len(raws), np.zeros(len(raws), bool)
            at = [i for i, r in enumerate(raws) if m.languages and _LETTER.search(r.decode("utf-8", "replace"))]
            if at:
                loss = m.losses(np.stack([histogram(raws[i]) for i in at]))
                p = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
                p /= p.sum(1, keepdims=True)
                order = np.argsort(loss, axis=1, kind="stable")
                for j, i in enumerate(at):
                    lang[i], score[i] = m.languages[order[j, 0]], p[j, order[j, 0]]
                    if len(m.languages) > 1:
                        second[i] = m.languages[order[j, 1]]
                        unsure[i] = loss[j, order[j, 1]] - loss[j, order[j, 0]] < AMBIGUOUS
            return [part.column(0), pa.array(lang), pa.array(score), pa.array(second, pa.string()), pa.array(unsure)]

        return step

    return C.text_map(df, [key, text], make, f"{key} {C.type_of(df, key)}, lang_pred string, score double, runner_up string, ambiguous boolean")
