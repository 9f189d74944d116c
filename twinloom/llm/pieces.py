"""SentencePiece encoding and decoding: forward-filtering backward-sampling over the piece lattice.

A text is cut before runs of spaces and at line ends into units; a unit's lattice has an edge for every piece that
matches inside it, and no piece of the model reaches over its ends. Forward filtering sums the weights of all
segmentations up to each place, as a number and a power of two, for units of any length; backward sampling then draws one
segmentation from its end, each draw from a counter-based generator seeded by the row's key and the unit's place. The
same key and text always give the same pieces, on any partitioning.

Spaces become the mark U+2581 and a mark is put in front of the text, as the public models expect. Characters without a
piece (line ends and a literal U+2581 too) are spelled in byte pieces, so decoding gives back every text exactly.
Null texts count as empty; an empty text has no pieces. Rows
with the same key and text get the same pieces.

All of a chunk's lattices are built and sampled together in numpy, over its distinct units; the trie is a double array.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from twinloom.llm import common as C

MARK, FALLBACK = "▁", 1e-6
#: Bytes of text whose lattices are held at once; texts of any length are done whole, and their ids don't depend on it.
CHUNK = 1 << 19

_UNITS = re.compile(r" +[^ \n]*|[^ \n]+|\n")
_GOLDEN, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


@dataclass
class Model:
    """Bytes and weight of each id, the first byte piece, and the double-array trie over characters."""

    spell: list[bytes]
    weight: np.ndarray
    bytes_at: int
    code: np.ndarray  # of a code point; 0: no piece has it
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int


def load(path: str, alpha: float = 1.0) -> Model:
    """From a SentencePiece model with byte fallback, on the driver. Weights fall with the piece's rank: (rank + 10)^-alpha."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and MARK not in pieces[i].lstrip(MARK)]
    rank = {i: r for r, i in enumerate(sorted(plain, key=lambda i: (-sp.get_score(i), i)))}
    weight = np.zeros(n)
    weight[list(rank)] = (np.array(list(rank.values())) + 10.0) ** -alpha
    weight /= weight.sum()
    at = next(i for i in range(n) if sp.is_byte(i))
    spell = [bytes([i - at]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else pieces[i].replace(MARK, " ").encode() for i in range(n)]
    return Model(spell, weight, at, *double_array([(pieces[i], i) for i in plain]))


def double_array(pieces: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Codes of characters, base, check, value: the child of state s by code c is base[s] + c if check of that is s."""
    chars: dict[str, int] = {}
    trie: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for piece, i in pieces:
        v = 0
        for ch in piece:
            c = chars.setdefault(ch, len(chars) + 1)
            v = trie[v].setdefault(c, len(trie))
            if v == len(trie):
                trie.append({})
        ends[v] = i
    size = 4 * len(trie) + 2 * len(chars) + 4096
    free = np.ones(size, bool)
    free[0] = False
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    start, low = np.zeros(len(trie), np.int64), 1
    for v in sorted((v for v in range(len(trie)) if trie[v]), key=lambda v: (-len(trie[v]), v)):  # wide states first
        kids = np.array(sorted(trie[v]), np.int64)
        while not free[low]:
            low += 1
        at = low
        while True:
            b = at + np.flatnonzero(free[at : at + 2048]) - kids[0]
            b = b[b >= 0]
            fits = free[b[:, None] + kids].all(1)
            if fits.any():
                break
            at += 2048
        start[v] = b[np.argmax(fits)]
        free[start[v] + kids] = False
    place = np.zeros(len(trie), np.int64)
    for v, kids in enumerate(trie):  # parents come before their children
        s = place[v]
        if v in ends:
            value[s] = ends[v]
        base[s] = start[v]
        for c, w in kids.items():
            place[w] = start[v] + c
            check[place[w]] = s
    code = np.zeros(0x110000, np.int32)
    for ch, c in chars.items():
        code[ord(ch)] = c
    return code, base, check, value, max((len(p) for p, _ in pieces), default=1)


class _Ids(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        return n


class Sampler:
    """Segmentations of many texts at once."""

    def __init__(self, model: Model):
        self.m = model
        self.mark = int(model.code[ord(MARK)])

    def lattice(self, units: list[str]) -> dict[str, np.ndarray]:
        """Of distinct units: nodes (one more than characters), their incoming edges, and the filtered sums, each node's over a power of two of its own."""
        m = self.m
        cp = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        length = np.fromiter(map(len, units), np.int64, len(units))
        first = np.cumsum(length) - length
        code = m.code[cp]
        code[cp == ord(MARK)] = 0
        spaces = cp == 32
        code[spaces] = self.mark
        unit = np.repeat(np.arange(len(units)), length)
        node = np.arange(len(cp)) + unit  # of the place before each character
        end = first + length
        n_nodes = len(cp) + len(units)
        degree = np.zeros(n_nodes, np.int64)
        to, rank, piece, back = [], [], [], []
        at, state = np.arange(len(cp)), np.zeros(len(cp), np.int64)
        last = end[unit]
        alone = np.ones(len(cp), bool)  # no piece is this character
        for k in range(m.longest):
            here = at + k
            ok = here < last[at]
            at, state, here = at[ok], state[ok], here[ok]
            if not len(at):
                break
            c = code[here]
            t = m.base[state] + c
            ok = (c > 0) & (m.check[t] == state)
            at, state = at[ok], t[ok]
            v = m.value[state]
            hit = v >= 0
            e = node[at[hit]] + k + 1
            if k == 0:
                alone[at[hit]] = False
            to.append(e)
            rank.append(degree[e])
            piece.append(v[hit])
            back.append(np.full(len(e), k + 1))
            degree[e] += 1
        lone = np.flatnonzero(alone)
        e = node[lone] + 1
        to.append(e)
        rank.append(degree[e])
        piece.append(-1 - cp[lone])  # a character's bytes
        back.append(np.ones(len(e), np.int64))
        degree[e] += 1
        to, rank, piece, back = (np.concatenate(x) for x in (to, rank, piece, back))
        start = np.concatenate([[0], np.cumsum(degree)])
        slot = start[to] + rank
        pieces, source = np.empty(len(to), np.int64), np.empty(len(to), np.int64)
        pieces[slot] = piece
        source[slot] = to - back
        weight = np.where(pieces >= 0, m.weight[np.maximum(pieces, 0)], FALLBACK)
        total, running = np.zeros(n_nodes), np.empty(len(to))
        part, power = np.zeros(n_nodes), np.zeros(n_nodes, np.int64)  # the sums of all segmentations are part * 2 ** power
        head = first + np.arange(len(units))
        part[head] = 1.0
        longest_first = np.argsort(-length, kind="stable")
        heads, lengths = head[longest_first], length[longest_first]
        for p in range(1, int(length.max(initial=0)) + 1):
            nodes = heads[: int(np.searchsorted(-lengths, -p, side="right"))] + p
            d, s = degree[nodes], start[nodes]
            sums = np.zeros(len(nodes))
            edges = [(more, s[more] + r) for r in range(int(d.max(initial=0))) for more in (np.flatnonzero(d > r),)]
            top = power[source[s]]
            for more, edge in edges[1:]:
                top[more] = np.maximum(top[more], power[source[edge]])
            for more, edge in edges:
                sums[more] += np.ldexp(part[source[edge]], power[source[edge]] - top[more]) * weight[edge]
                running[edge] = sums[more]
            total[nodes] = sums
            part[nodes], shift = np.frexp(sums)
            power[nodes] = top + shift
        return {"head": head, "tail": head + length, "start": start, "piece": pieces, "source": source, "running": running, "total": total}

    def sample(self, texts: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and per text the index of its first id (n+1 values)."""
        ids = _Ids()
        occ, per = [], np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            got = _UNITS.findall(" " + t) if t else []
            occ.append(np.fromiter(map(ids.__getitem__, got), np.int64, len(got)))
            per[i + 1] = per[i] + len(got)
        unit = np.concatenate(occ) if occ else np.zeros(0, np.int64)
        if not len(unit):
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        g = self.lattice(list(ids))
        text = np.repeat(np.arange(len(texts)), np.diff(per))
        with np.errstate(over="ignore"):
            seed = C.mix(seeds[text] + (np.arange(len(unit)) - per[text]).astype(np.uint64) * _GOLDEN)
        node, head, who = g["tail"][unit], g["head"][unit], np.arange(len(unit))
        count = np.zeros(len(unit), np.int64)
        drawn = []
        step = 0
        while len(who):
            with np.errstate(over="ignore"):
                u = (C.mix(seed[who] + np.uint64(step) * _ODD) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * g["total"][node]
            edge, stop = g["start"][node], g["start"][node + 1] - 1
            while True:
                on = (g["running"][edge] <= u) & (edge < stop)
                if not on.any():
                    break
                edge = edge + on
            drawn.append((who, g["piece"][edge]))
            count[who] += 1
            node = g["source"][edge]
            going = node > head
            node, head, who = node[going], head[going], who[going]
            step += 1
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int64)
        for k, (who, piece) in enumerate(drawn):
            out[begin[who] + count[who] - 1 - k] = piece
        bounds = begin[per]
        spelled = np.flatnonzero(out < 0)
        if len(spelled):
            cps, which = np.unique(-1 - out[spelled], return_inverse=True)
            raws = [chr(c).encode("utf-8", "surrogateescape") for c in cps.tolist()]
            size = np.ones(len(out), np.int64)
            size[spelled] = np.fromiter(map(len, raws), np.int64, len(raws))[which]
            place = np.concatenate([[0], np.cumsum(size)])
            wide = np.empty(place[-1], np.int64)
            wide[place[:-1]] = out
            for c, raw in enumerate(raws):
                at = place[spelled[which == c]]
                for j, b in enumerate(raw):
                    wide[at + j] = self.m.bytes_at + b
            out, bounds = wide, place[bounds]
        return out, bounds


def decode_ids(model: Model, ids: list[int]) -> bytes:
    """The text of ids: pieces in a row, without the mark in front."""
    return b"".join(map(model.spell.__getitem__, ids))[1:]


def seeds_of(keys: list) -> np.ndarray:
    """One seed a row key; null keys share one."""
    return np.array([xxhash.xxh64_intdigest(str(k).encode() if k is not None else b"", 1) for k in keys], np.uint64)


def _encoder(shared) -> Callable:
    sampler = Sampler(shared.value)

    def encode(keys: pa.Array, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        raws = C.text_bytes(texts)
        ids, bounds = sampler.sample([r.decode("utf-8", "surrogateescape") for r in raws], seeds_of(keys.to_pylist()))
        return raws, ids, bounds

    return encode


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text", name: str = "piece_ids") -> DataFrame:
    """All columns of df, then `name`: the sampled ids (array of int). A column of that name is replaced."""
    df = C.without(df, name)
    shared = df.sparkSession.sparkContext.broadcast(model)  # the vocabulary's size
    at, by = df.columns.index(text), df.columns.index(key)

    def make():
        run = _encoder(shared)

        def step(part: pa.RecordBatch):
            _, ids, bounds = run(part.column(by), part.column(at))
            return [_lists(ids, bounds)]

        return step

    return C.with_columns(df, text, make, f"{name} array<int>", CHUNK)


def decode(df: DataFrame, model: Model, name: str = "piece_ids", to: str = "decoded") -> DataFrame:
    """All columns of df, then `to`: the text of the ids. A null list gives null. A column of that name is replaced."""
    df = C.without(df, to)
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(name)

    def make():
        m = shared.value
        return lambda part: [pa.array([None if x is None else decode_ids(m, x).decode("utf-8", "replace") for x in part.column(at).to_pylist()], pa.string())]

    return C.with_columns(df, None, make, f"{to} string", 1000)


def digests(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode in one pass: key, n_pieces, n_bytes, ids_hash (XXH64 of the ids as 32-bit little-endian), decoded_sha256, lossless."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        run, m = _encoder(shared), shared.value

        def step(part: pa.RecordBatch):
            raws, ids, bounds = run(part.column(0), part.column(1))
            small, as_list = ids.astype("<i4"), ids.tolist()
            back = [decode_ids(m, as_list[bounds[i] : bounds[i + 1]]) for i in range(len(raws))]
            hashes = [xxhash.xxh64_hexdigest(small[bounds[i] : bounds[i + 1]].tobytes()) for i in range(len(raws))]
            return [
                part.column(0), pa.array(np.diff(bounds).astype(np.int64)), pa.array([len(r) for r in raws], pa.int64()), pa.array(hashes, pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()), pa.array([a == b for a, b in zip(raws, back, strict=True)], pa.bool_()),
            ]

        return step

    return C.text_map(df, [key, text], make, f"{key} {C.type_of(df, key)}, n_pieces long, n_bytes long, ids_hash string, decoded_sha256 string, lossless boolean", CHUNK)
