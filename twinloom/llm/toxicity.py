"""Toxicity: weighted finite-state pattern grammar.

A lexical transducer reads the letters of a word and writes its class with a weight: I for insults (learned words and
word beginnings), T for threats, G for targets (second and third persons), N for negations, R for words of report, O for
others. Five small transducers read a clause's classes: insults (one right after another weighs more), threats (full
weight against a target), targets (raise what they meet), negation (lowers the next words) and reported speech (lowers
the rest of the clause). All are composed into one machine whose paths carry the product of the weights. Clauses are
scored, and a logistic curve fitted on labelled rows turns a text's clause scores into 0 to 1.

Null, empty and letterless texts have no clause and get the score of a text without matches. Texts are read whole,
words of any length. Equal texts have equal scores, so repeated rows stay rows and ties are equal. In the fit a key
counts once, with the largest of its labels; without labelled rows, or with one label alone, all scores are equal. An
empty table gives an empty result. Columns beside key and text don't matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C

#: Bound of the labelled sample: rows, taken whole.
SAMPLE_ROWS = 4000
#: A lexicon entry is in so many toxic sampled rows at least, so that the lexicon is no larger than their words over it.
SEEN = 4
CACHE_WORDS, KEPT_LETTERS = 300_000, 40

# Closed word classes of the grammar.
TARGETS = set("you your yours yourself they them their he him his she her du dich dir dein deine ihr euch tu te toi vous votre usted ustedes ti tú".split())
NEGATIONS = set("not no never neither nor without isn't aren't kein keine niemals jamais aucun nunca jamás sin".split())
REPORTS = set("said says say claimed claims quoted quotes wrote writes reported alleged called sagte sagt behauptete dit affirme déclaré dijo dice afirma".split())
THREATS = set("kill killed hurt destroy burn attack beat shoot stab töten umbringen schlagen tuer frapper détruire matar golpear destruir".split())

_WORD = regex.compile(r"[\p{L}\p{M}']+")
_CLAUSE = regex.compile(r"[.;:!?\n,()]+")
_LETTERS = regex.compile(r"[^\p{L}\p{M}']+")

_SPACED = bytes(b if b >= 128 or chr(b).isalpha() or b == 39 else 32 for b in range(256))

#: What each transducer multiplies the weight of a match by, and for how many words it holds.
NEGATED, REPORTED, TARGETED, PILED, REACH = 0.4, 0.5, 1.3, 1.2, 3
FEATURES = 6
#: Log odds of a lexicon entry, at least.
LEAST_ODDS = 2.0


class Transducer:
    """delta[state][class] -> (state, factor); a missing class keeps the state with factor 1."""

    def __init__(self, delta: dict[int, dict[str, tuple[int, float]]]):
        self.delta = delta

    def step(self, state: int, symbol: str) -> tuple[int, float]:
        row = self.delta.get(state, {})
        return row.get(symbol) or row.get("*") or (state, 1.0)


def _window(trigger: str, factor: float) -> Transducer:
    """After `trigger`, matches within REACH words get `factor`."""
    delta: dict = {0: {trigger: (REACH, 1.0), "*": (0, 1.0)}}
    for s in range(1, REACH + 1):
        delta[s] = {trigger: (REACH, 1.0), "I": (s - 1, factor), "T": (s - 1, factor), "*": (s - 1, 1.0)}
    return Transducer(delta)


def grammar() -> list[Transducer]:
    insult = Transducer({0: {"I": (1, 1.0)}, 1: {"I": (1, PILED), "*": (0, 1.0)}})  # "stupid idiot" weighs more than both apart
    threat = Transducer({0: {"T": (0, 0.5), "G": (1, 1.0)}, 1: {"T": (1, 2.0)}})  # a threat counts fully against a target
    report = Transducer({0: {"R": (1, 1.0)}, 1: {"I": (1, REPORTED), "T": (1, REPORTED)}})
    return [insult, threat, _window("G", TARGETED), _window("N", NEGATED), report]


def compose(parts: list[Transducer], symbols: str = "ITGNRO") -> tuple[list[dict[str, int]], list[dict[str, float]]]:
    """The reachable product machine: next state and factor by class."""
    start = (0,) * len(parts)
    index, queue, nxt, factor = {start: 0}, [start], [], []
    for states in queue:
        to, by = {}, {}
        for x in symbols:
            moved = [p.step(s, x) for p, s in zip(parts, states, strict=True)]
            new = tuple(m[0] for m in moved)
            if new not in index:
                index[new] = len(queue)
                queue.append(new)
            to[x], by[x] = index[new], float(np.prod([m[1] for m in moved]))
        nxt.append(to)
        factor.append(by)
    return nxt, factor


class Letters:
    """The lexical transducer: a path of letters per entry; a word's end writes its class and weight.

    A beginning writes I at every word that goes on from its state; a whole word only if the word ends there. Of
    several insults the heaviest counts, and an insult comes before the closed classes.
    """

    def __init__(self, lexicon: dict[str, float], stems: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.whole: list[tuple[str, float] | None] = [None]
        self.going: list[float] = [0.0]
        for symbol, words in (("R", REPORTS), ("N", NEGATIONS), ("G", TARGETS), ("T", THREATS)):
            for w in words:
                self.whole[self._path(w)] = (symbol, 1.0 if symbol == "T" else 0.0)
        for w, weight in lexicon.items():
            self.whole[self._path(w)] = ("I", weight)
        for w, weight in stems.items():
            self.going[self._path(w)] = weight

    def _path(self, word: str) -> int:
        v = 0
        for ch in word:
            v = self.next[v].setdefault(ch, len(self.next))
            if v == len(self.next):
                self.next.append({})
                self.whole.append(None)
                self.going.append(0.0)
        return v

    def read(self, word: str) -> tuple[str, float]:
        """Class and weight of a word."""
        v, best = 0, 0.0
        for ch in word:
            v = self.next[v].get(ch, -1)
            if v < 0:
                return ("I", best) if best else ("O", 0.0)
            best = max(best, self.going[v])
        end = self.whole[v] or ("O", 0.0)
        best = max(best, end[1] if end[0] == "I" else 0.0)
        return ("I", best) if best else end


class _Weights(dict):
    """What the lexical transducer writes, by word."""

    def __init__(self, letters: Letters):
        super().__init__()
        self.read = letters.read

    def __missing__(self, word: str) -> tuple[str, float]:
        got = self.read(word)
        if len(word) <= KEPT_LETTERS:
            self[word] = got
        return got


class _Kinds(dict):
    """Of a white-spaced stretch of letters: whether it holds a word that matches."""

    def __init__(self, weights: _Weights):
        super().__init__()
        self.weights = weights

    def __missing__(self, raw: bytes) -> bool:
        got = any(self.weights[w][0] in "IT" for w in _WORD.findall(raw.decode("utf-8", "replace")))
        if len(raw) <= KEPT_LETTERS:
            self[raw] = got
        return got


class Scorer:
    def __init__(self, lexicon: dict[str, float], stems: dict[str, float]):
        self.weights = _Weights(Letters(lexicon, stems))
        self.kinds, self.met = _Kinds(self.weights), {True}
        self.next, self.factor = compose(grammar())

    def clauses(self, text: str) -> list[tuple[float, int]]:
        """(score, matches) of each clause with a match."""
        if len(self.weights) > CACHE_WORDS:
            self.weights.clear()
            self.kinds.clear()
        low, look = text.lower(), self.weights.__getitem__
        if self.met.isdisjoint(map(self.kinds.__getitem__, set(low.encode("utf-8", "surrogatepass").translate(_SPACED).split()))):
            return []
        out = []
        for clause in _CLAUSE.split(low):
            state, score, hits = 0, 0.0, 0
            for word in _WORD.findall(clause):
                x, w = look(word)
                if x in "IT":
                    score += w * self.factor[state][x]
                    hits += 1
                state = self.next[state][x]
            if hits:
                out.append((score, hits))
        return out

    def features(self, text: str) -> np.ndarray:
        got = self.clauses(text)
        n = max(20, text.count(" ") + 1)
        s = np.array([c[0] for c in got] or [0.0])
        total = s.sum()
        return np.array([np.log1p(total), np.log1p(s.max()), np.log1p(100 * total / n), len(got) > 0, len(got) > 1, np.log1p(np.sort(s)[-3:].sum())])


@dataclass
class Model:
    lexicon: dict[str, float]
    stems: dict[str, float]
    weights: np.ndarray
    bias: float


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 800) -> tuple[np.ndarray, float]:
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), (3.0 if len(y) and y.max() else -3.0)
    w, b, mw, vw = np.zeros(x.shape[1] + 1), 0, np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    xs = np.hstack([x, np.ones((len(x), 1))])
    for i in range(1, steps + 1):
        g = xs.T @ (1 / (1 + np.exp(-np.clip(xs @ w, -40, 40))) - y) / len(y) + 1e-3 * np.append(w[:-1], 0)
        mw, vw = 0.9 * mw + 0.1 * g, 0.99 * vw + 0.01 * g * g
        w -= 0.1 * (mw / (1 - 0.9**i)) / (np.sqrt(vw / (1 - 0.99**i)) + 1e-8)
    return w[:-1], float(w[-1])


def train(df: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and curve from at most `sample_rows` labelled rows, chosen by a hash of the key.

    A word, or a beginning of 3 to 9 letters, enters the lexicon by its smoothed log odds between toxic and other
    sampled texts, if SEEN toxic ones have it and it is likelier in these. Rows are counted on the executors. The curve is fitted on scores from
    lexicons of the sample's other half.
    """
    half = F.pmod(F.xxhash64("k", F.lit(5)), F.lit(2)).cast("int").alias("h")
    sample = C.labelled_sample(df, labels, learn, key, text, label, sample_rows, 2).select("k", "y", half, "t")
    n = Counter({(r.y, r.h): r.n for r in sample.groupBy("y", "h").agg(F.count("*").alias("n")).collect()})  # four rows
    parts = C.text_map(sample, ["y", "h", "t"], _counted, "form int, x string, y int, h int, n long", 1 << 23)
    of = lambda y, h: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("h") == h), F.col("n"))), F.lit(0)).alias(f"n{y}{h}")
    counts = parts.groupBy("form", "x").agg(*(of(y, h) for y in (0, 1) for h in (0, 1))).where(F.col("n10") + F.col("n11") >= SEEN)
    odds = F.log((F.col("n10") + F.col("n11") + 0.1) / (n[1, 0] + n[1, 1] + 1)) - F.log((F.col("n00") + F.col("n01") + 0.5) / (n[0, 0] + n[0, 1] + 1))
    likely = counts.where(odds > 0).toArrow().sort_by([("form", "ascending"), ("x", "ascending")]).to_pylist()

    def lexicon(halves: tuple[int, ...]) -> tuple[dict[str, float], dict[str, float]]:
        pos, neg = (sum(n[y, h] for h in halves) for y in (1, 0))
        out: tuple[dict[str, float], dict[str, float]] = ({}, {})
        for c in likely:
            a, b = (sum(c[f"n{y}{h}"] for h in halves) for y in (1, 0))
            o = np.log((a + 0.1) / (pos + 1)) - np.log((b + 0.5) / (neg + 1))
            if a >= 2 * len(halves) and o > LEAST_ODDS:
                out[c["form"]][c["x"]] = float(o)
        return out

    rows = C.text_map(sample, ["k", "y", "h", "t"], lambda: _featured([lexicon((1,)), lexicon((0,))]), "k string, y int, x array<double>").toArrow().sort_by("k").to_pylist()
    x, y = np.array([r["x"] for r in rows]).reshape(len(rows), FEATURES), np.array([r["y"] for r in rows], float)
    w, b = _logistic(x, y)
    return Model(*lexicon((0, 1)), w, b)


def _parts(word: str) -> Iterator[tuple[int, str]]:
    """(0, word) and (1, beginning) for beginnings of 3 to 9 letters that are shorter than the word."""
    yield 0, word
    for n in range(3, min(10, len(word))):
        yield 1, word[:n]


def _counted():
    """Of a slice of rows: how many of each label and half have each part."""

    def step(part: pa.RecordBatch):
        n: Counter = Counter()
        for y, h, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), C.text_bytes(part.column(2)), strict=True):
            n.update({(*p, y, h) for w in set(_LETTERS.split(raw.decode("utf-8", "replace").lower())) if w for p in _parts(w)})
        cols = list(zip(*n, strict=True)) or [[]] * 4
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32())
        return [*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array(list(n.values()), pa.int64())]

    return step


def _featured(lexicons):
    scorers = [Scorer(*x) for x in lexicons]

    def step(part: pa.RecordBatch):
        rows = zip(part.column(2).to_pylist(), C.text_bytes(part.column(3)), strict=True)
        return [part.column(0), part.column(1), pa.array([scorers[h].features(t.decode("utf-8", "replace")).tolist() for h, t in rows], pa.list_(pa.float64()))]

    return step


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, score (0 to 1), n_clauses with a match, worst (the highest clause score)."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a lexicon from SAMPLE_ROWS rows

    def make():
        m = shared.value
        scorer = Scorer(m.lexicon, m.stems)

        def step(part: pa.RecordBatch):
            scores, n, worst = [], [], []
            for raw in C.text_bytes(part.column(1)):
                text_ = raw.decode("utf-8", "replace")
                got = scorer.clauses(text_)
                z = float(scorer.features(text_) @ m.weights + m.bias) if got else m.bias
                scores.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
                n.append(len(got))
                worst.append(max((c[0] for c in got), default=0.0))
            return [part.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64()), pa.array(worst, pa.float64())]

        return step

    return C.text_map(df, [key, text], make, f"{key} {C.type_of(df, key)}, score double, n_clauses long, worst double")
