"""Token counts: linear longest-match automaton over a public vocabulary.

A trie of the pieces gets failure links and, with each link, the number of tokens that taking it pops, so that a
word's greedy longest-match length comes from one pass over its characters without building a piece.

Words are runs of other than ASCII white space; each gets the mark U+2581 in front. A character that no piece
covers counts as one token a UTF-8 byte (byte fallback). Null and empty texts have 0 words and 0 tokens. Words of any
length are read whole; of equal pieces one counts, and the longest match leaves no ties. Repeated rows stay rows with
equal counts. An empty table gives an empty result. Columns beside key and text don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinloom.llm import common as C

MARK = "▁"
#: Distinct words that a task remembers; then it starts again.
CACHE_WORDS = 300_000


def pieces_of(path: str) -> list[str]:
    """The text pieces of a SentencePiece model, on the driver; the mark only at a piece's start."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    return [p for p in map(sp.id_to_piece, (i for i in ids if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)))) if MARK not in p[1:]]


class LongestMatch:
    """The automaton. next[v]: children by character; fail[v], pops[v]: where a mismatch leads and what it pops."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        ends: dict[int, int] = {}
        for piece in pieces:
            v = 0
            for ch in piece:
                v = self.next[v].setdefault(ch, len(self.next))
                if v == len(self.next):
                    self.next.append({})
            ends[v] = 1
        for ch, v in self.next[0].items():  # a lone character without a piece falls back to its bytes
            ends.setdefault(v, len(ch.encode()))
        self.fail, self.pops = [0] * len(self.next), [0] * len(self.next)
        queue = [(0, ch, v) for ch, v in self.next[0].items()]
        for u, ch, v in queue:
            if v in ends:
                self.fail[v], self.pops[v] = 0, ends[v]
            else:
                z, n = self.fail[u], self.pops[u]
                while ch not in self.next[z] and z:
                    n += self.pops[z]
                    z = self.fail[z]
                if ch in self.next[z]:
                    self.fail[v], self.pops[v] = self.next[z][ch], n
                else:
                    self.fail[v], self.pops[v] = 0, n + len(ch.encode())
            queue.extend((v, c, w) for c, w in self.next[v].items())

    def count(self, word: str) -> int:
        nxt, fail, pops = self.next, self.fail, self.pops
        v = n = 0
        for ch in word:
            while (w := nxt[v].get(ch)) is None:
                if not v:
                    n += len(ch.encode("utf-8", "surrogatepass"))
                    w = 0
                    break
                n += pops[v]
                v = fail[v]
            v = w
        while v:
            n += pops[v]
            v = fail[v]
        return n


class _Counts(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(MARK + word.decode("utf-8", "replace"))
        if len(word) <= 64:
            self[word] = n
        return n


def token_counts(df: DataFrame, pieces: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_words, n_tokens, max_word_tokens (0 if there is no word), all long."""
    vocabulary = df.sparkSession.sparkContext.broadcast("\n".join(p for p in pieces if "\n" not in p))  # the vocabulary's size, not the data's

    def make():
        counts = _Counts(LongestMatch(vocabulary.value.split("\n")))

        def step(part: pa.RecordBatch):
            if len(counts) > CACHE_WORDS:
                counts.clear()
            n_words, n_tokens, most = [], [], []
            for raw in C.text_bytes(part.column(1)):
                got = np.fromiter(map(counts.__getitem__, raw.split()), np.int64)
                n_words.append(len(got))
                n_tokens.append(int(got.sum()))
                most.append(int(got.max()) if len(got) else 0)
            return [part.column(0), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(most, pa.int64())]

        return step

    return C.text_map(df, [key, text], make, f"{key} {C.type_of(df, key)}, n_words long, n_tokens long, max_word_tokens long")


def summary(counts: DataFrame) -> DataFrame:
    """Totals for planning: texts, words and tokens."""
    return counts.agg(F.count("*").alias("n_texts"), F.sum("n_words").alias("n_words"), F.sum("n_tokens").alias("n_tokens"))
