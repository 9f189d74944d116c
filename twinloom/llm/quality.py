"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of PASSAGE_WORDS words. Each passage is encoded (byte classes, word shapes, repetition,
hashed words, then a learned layer); gated attention, learned from document labels alone, weighs the passages, and
the weighted mean of the encodings is scored. A text's score depends on its text and the model alone, not on the
rows that share its batch.

Null and empty texts are one passage of zeros. All passages of a text count, however long it is, in the fit too. Rows
with equal texts have equal scores, so repeated rows stay rows and ties are equal. In the fit a key counts once, with
the largest of its labels; without labelled rows, or with one label alone, all scores are equal. An empty table gives
an empty result. Columns beside key and text don't matter to score(); keep_good() returns them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C

PASSAGE_WORDS = 64
#: Bounds of the fit's sample: labelled rows, and passages of all of them. Rows are taken whole, in the order of a hash
#: of their keys; a row that doesn't fit any more is left out.
SAMPLE_ROWS, SAMPLE_PASSAGES = 3000, 100_000
HASHED, HIDDEN, GATE = 64, 24, 12

_TABLE = C.word_table("any")


def _classes() -> np.ndarray:
    t = np.full(256, 11, np.uint8)
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,", b"!?", b"|", b"$%&*#@", b"<>{}[]()/\\=_", b"'\"-:;")):
        t[list(chars)] = k
    t[128:] = 12
    return t


_CLASS = _classes()
N_CLASSES = 13
N_FEATURES = N_CLASSES + 9 + HASHED


def n_passages(n_words: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-n_words // PASSAGE_WORDS))


def passages(t: C.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages in order, and per text the index of its first passage (n+1 values)."""
    starts, hashes, per = C.words(t, _TABLE)
    sizes = C.word_sizes(t, _TABLE, starts)
    n_pass = n_passages(np.diff(per))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    total = int(first[-1])
    text_of = np.repeat(np.arange(len(t)), n_pass)
    k = np.arange(total) - first[text_of]
    word_lo = per[text_of] + k * PASSAGE_WORDS
    word_hi = np.minimum(word_lo + PASSAGE_WORDS, per[text_of + 1])
    byte_lo = np.where(k == 0, t.offsets[text_of], starts[np.minimum(word_lo, max(len(starts) - 1, 0))] if len(starts) else 0)
    size = np.diff(np.append(byte_lo, t.offsets[-1]))
    passage_of_byte = np.repeat(np.arange(total), size)
    classes = np.bincount(passage_of_byte * N_CLASSES + _CLASS[t.data], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    x = np.zeros((total, N_FEATURES), np.float32)
    x[:, :N_CLASSES] = np.sqrt(classes / np.maximum(size, 1)[:, None])
    count = word_hi - word_lo
    some = np.maximum(count, 1)
    if len(starts):
        passage = np.repeat(np.arange(total), count)
        same = np.zeros(len(starts))
        same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
        first_class = _CLASS[t.data[starts]]
        second_class = np.where(sizes > 1, _CLASS[t.data[np.minimum(starts + 1, len(t.data) - 1)]], N_CLASSES)
        bag = lambda w=None: np.bincount(passage, w, total)
        mean = bag(sizes) / some
        x[:, 13] = mean / 10
        x[:, 14] = np.sqrt(np.maximum(bag(sizes.astype(float) ** 2) / some - mean**2, 0)) / 10
        x[:, 15] = bag(same) / some
        x[:, 16] = bag(first_class == 1) / some
        x[:, 17] = bag((first_class == 1) & (second_class == 1)) / some
        x[:, 18] = bag(first_class > 4) / some
        by = np.lexsort((hashes, passage))
        new = np.ones(len(by))
        new[1:] = (hashes[by[1:]] != hashes[by[:-1]]) | (passage[by[1:]] != passage[by[:-1]])
        x[:, 19] = np.bincount(passage[by], new, total) / some
        x[:, 20] = count / PASSAGE_WORDS
        hashed = np.bincount(passage * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED)
        x[:, 22:] = hashed / some[:, None]
    x[:, 21] = np.minimum(np.log1p(n_pass[text_of]) / 5, 2)
    return x, first


@dataclass
class Model:
    """Encoder, gate (two layers and a vector) and head."""

    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh((x - p["mean"]) / p["sd"] @ p["w"] + p["b"])
        a, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
        e = np.clip((a * s) @ p["g"], -30, 30)
        bag = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        t = np.exp(e)
        weight = t / np.add.reduceat(t, bounds[:-1])[bag] if len(t) else t
        z = np.add.reduceat(h * weight[:, None], bounds[:-1], axis=0) if len(t) else np.zeros((0, HIDDEN))  # no bag is empty
        logit = z @ p["c"] + p["d"][0]
        return {"h": h, "a": a, "s": s, "bag": bag, "weight": weight, "z": z, "score": 1 / (1 + np.exp(-np.clip(logit, -40, 40)))}


def fit(x: np.ndarray, bounds: np.ndarray, y: np.ndarray, steps: int = 150, seed: int = 3) -> Model:
    """Full-batch Adam on the bags' log loss."""
    rng = np.random.default_rng(seed)
    draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
    f = x.shape[1]
    p = {"w": draw(f, HIDDEN), "b": np.zeros(HIDDEN), "v": draw(HIDDEN, GATE), "u": draw(HIDDEN, GATE), "g": draw(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
    fixed = {"mean": x.mean(0) if len(x) else np.zeros(f), "sd": (x.std(0) if len(x) else np.zeros(f)) + 1e-2}
    model = Model(p | fixed)
    if not len(y) or y.min() == y.max():
        model.p["d"] = np.array([3.0 if not len(y) or y.max() else -3.0])
        return model
    xs = (x - fixed["mean"]) / fixed["sd"]
    m, v = ({k: np.zeros_like(q) for k, q in p.items()} for _ in range(2))
    for i in range(1, steps + 1):
        model.p = p | fixed
        o = model.forward(x, bounds)
        dl = (o["score"] - y) / len(y)
        g = {"c": o["z"].T @ dl, "d": dl.sum(keepdims=True)}
        dz = dl[:, None] * p["c"]
        dh = dz[o["bag"]] * o["weight"][:, None]
        through = (dz[o["bag"]] * (o["h"] - o["z"][o["bag"]])).sum(1) * o["weight"]
        gated = through[:, None] * p["g"]
        g["g"] = (o["a"] * o["s"]).T @ through
        da, ds = gated * o["s"] * (1 - o["a"] ** 2), gated * o["a"] * o["s"] * (1 - o["s"])
        g["v"], g["u"] = o["h"].T @ da, o["h"].T @ ds
        dh = (dh + da @ p["v"].T + ds @ p["u"].T) * (1 - o["h"] ** 2)
        g["w"], g["b"] = xs.T @ dh, dh.sum(0)
        for k in p:
            d = g[k] + 1e-4 * p[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
            p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.999**i)) + 1e-8)
    model.p = p | fixed
    return model


def train(df: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `sample_rows` labelled rows and SAMPLE_PASSAGES passages; passages are encoded on the executors."""

    def make():
        def step(part: pa.RecordBatch):
            x, first = passages(C.texts_of(part.column(2)))
            bags = [x[first[i] : first[i + 1]].tobytes() for i in range(len(first) - 1)]
            return [part.column(0), part.column(1), pa.array(np.diff(first)), pa.array(bags, pa.large_binary()).cast(pa.binary())]

        return step

    sample = C.labelled_sample(df, labels, learn, key, text, label, sample_rows, 1)
    coded = C.written(C.text_map(sample, ["k", "y", "t"], make, "k string, y int, n long, x binary"), "passages")
    size = coded.select("k", "n", F.xxhash64("k", F.lit(1)).alias("o")).toArrow().sort_by([("o", "ascending"), ("k", "ascending")]).to_pylist()  # sample_rows rows at most
    left, out = SAMPLE_PASSAGES, []
    for r in size:
        if r["n"] <= left:
            left -= r["n"]
        else:
            out.append(r["k"])
    rows = (coded.where(~F.col("k").isin(out)) if out else coded).toArrow().sort_by("k").to_pylist()  # SAMPLE_PASSAGES passages at most
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in rows]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, N_FEATURES))
    return fit(x, np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(int), np.array([r["y"] for r in rows], float))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, score (0 to 1), n_passages, top_passage (the one with the largest attention)."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def step(part: pa.RecordBatch):
            x, first = passages(C.texts_of(part.column(1).fill_null("")))
            o = m.forward(x.astype(np.float64), first)
            top = np.array([int(np.argmax(o["weight"][first[i] : first[i + 1]])) for i in range(len(first) - 1)], dtype=np.int64)
            return [part.column(0), pa.array(o["score"].astype(np.float64)), pa.array(np.diff(first).astype(np.int64)), pa.array(top, pa.int64())]

        return step

    return C.text_map(df, [key, text], make, f"{key} {C.type_of(df, key)}, score double, n_passages long, top_passage long")


def keep_good(df: DataFrame, model: Model, at: float = 0.3, text: str = "text") -> DataFrame:
    """The rows that score `at` or more, all columns unchanged."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def keep(column: pa.Array) -> np.ndarray:
            x, first = passages(C.texts_of(column.fill_null("")))
            return m.forward(x.astype(np.float64), first)["score"] >= at

        return keep

    return C.filter_rows(df, text, make)
