"""The operators against plain versions of what they compute."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinloom.llm import common, components, decontaminate, language, licenses, lines, pieces, quality, simhash, spotsigs, toxicity, wordpiece
from twinloom.llm.queries import PIECES, QUERIES

SF = "/root/testdata/sf0.001"
SF_LEARN = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return common.documents(spark, SF)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def union_find(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# ---------------------------------------------------------------- words and components


def test_word_hashes_are_of_words_alone():
    data = "the The\tcat é\x00x cat  the".encode()
    t = common.Texts(np.frombuffer(data + b"cat", np.uint8), np.array([0, len(data), len(data) + 3]))
    _, h, per = common.words(t, common.word_table("any"))
    assert per.tolist() == [0, 6, 7] and h[0] == h[1] == h[5] and h[2] == h[4] == h[6] and len(set(h.tolist())) == 3


def test_chunks_of_long_words():
    raw = b"a" * (3 << 20) + b" b"
    _, h, per = common.words(common.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), common.word_table("any"))
    assert per.tolist() == [0, 2] and h[1] == common.hash_words(["b"], common.word_table("any"))[0]


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(150)] + [(500, x) for x in range(501, 700)]
    want = {n: r for n, r in union_find(pairs, {x for p in pairs for x in p}).items() if any(n in p and p[0] != p[1] for p in pairs)}
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want


# ---------------------------------------------------------------- simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op4_simhash"](spark, SF).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: f"{p:016x}" for i, p in prints.items()} == {i: g[0] for i, g in got.items()}
    ids = sorted(prints)
    want = union_find([(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], ids)
    assert want == {i: g[1] for i, g in got.items()}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("cell", [2, 256])
def test_links_of_crowded_fingerprints(spark, monkeypatch, cell):
    """Many fingerprints around a few centres, in large cells that are split again and again, and in small ones."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(5)
    fps = {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in (0, 0x123456789ABCDEF, (1 << 64) - 1) for _ in range(40)} | {rng.getrandbits(64) for _ in range(100)}
    fps = [signed(f) for f in fps]
    got = {(min(r), max(r)) for r in simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == {(a, b) for a in fps for b in fps if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}


def test_pivot_table():
    """A block's coordinates tell its contents apart and depend on them alone; neighbours have a common cell; the table discards."""
    rng = np.random.default_rng(3)
    references = simhash.pivots()
    assert len(references) == 64
    fps = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
    t = simhash.table(fps, references)
    own = (t[:, 1:49] - t[:, :1]).reshape(len(fps), 16, 3)
    for b in range(16):
        content = fps & np.uint64(sum(1 << (b + 16 * i) for i in range(4)))
        assert len({tuple(x) for x in own[:, b].tolist()}) == 16
        assert len(set(zip(content.tolist(), map(tuple, own[:, b].tolist()), strict=True))) == 16
    paths = [4 * i + j for i in (1, 2, 3) for j in (1, 2, 3)]
    for _ in range(200):
        i, j = rng.integers(0, 64, 2)
        pair = np.array([fps[0], fps[0] ^ np.uint64(1 << int(i)) ^ np.uint64(1 << int(j))], np.uint64)
        assert any(len(set(simhash._cells(pair, p, references).tolist())) == 1 for p in paths)
        assert np.abs(np.diff(simhash.table(pair, references).astype(int), axis=0)).max() <= 2
    apart = np.abs(t[:200].astype(int) - t[200:]).max(1)
    assert (apart > 2).all()


def test_keep_first_of_rows_that_share_a_key(spark):
    a, b, c = "the first text has these words in it", "quite another text with words of its own", "and a third one that is unlike both of the others"
    rows = [(1, a, "x"), (2, a, "y"), (2, b, "z"), (3, b, "u"), (4, c, "v"), (4, c, "v"), (None, c, "w"), (None, None, "n"), (5, "", "e"), (5, "", "f")]
    got = [tuple(r) for r in simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, more string").repartition(4)).collect()]
    assert sorted((r[0], r[1]) for r in got) == [(1, a), (2, b), (4, c), (5, "")]


# ---------------------------------------------------------------- line dedup


def plain_gone(texts):
    gone, first, index = set(), set(), {}
    for place, w in sorted(((i, n), frozenset(x.encode().lower().split())) for i, t in texts.items() for n, x in enumerate(t.split("\n"))):
        if not w:
            continue
        if w in first:
            gone.add(place)
            continue
        for q in set().union(*(index.get(x, ()) for x in w)):
            both = len(w & q)
            if both / (len(w) + len(q) - both) >= 0.8 - 1e-12:
                gone.add(place)
                break
        first.add(w)
        for x in w:
            index.setdefault(x, []).append(w)
    return gone


@pytest.mark.parametrize(("group", "chunk"), [(1, 3), (8, 512)])
def test_line_dedup(docs, texts, monkeypatch, group, chunk):
    monkeypatch.setattr(lines, "GROUP", group)
    monkeypatch.setattr(lines, "CHUNK", chunk)
    assert {(r.k, r.line) for r in lines.gone_lines(docs).collect()} == plain_gone(texts)


def test_ranks_of_ranges(spark):
    """Keys that span ranges, keys within one and a range of one key alone."""
    rng = random.Random(2)
    rows = [(key, 1000 * key + i, rng.randrange(10**6), i, 5, 0, 0) for key, size in ((1, 1), (2, 400), (3, 2), (4, 3), (7, 90)) for i in range(size)]
    df = spark.createDataFrame(rows, "key long, s long, k long, line long, n long, even long, odd long").repartition(3)
    want = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[3])):
        want[r[1]] = 1 + sum(x[0] == r[0] and (x[2], x[3]) < (r[2], r[3]) for x in rows)
    for n in ("2", "7", "40"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            assert {r.s: r["rank"] for r in lines._ranked(df).collect()} == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old)


def test_order_of_words():
    """Ranks and sorting against plain ones, with words of one slot, equal upper bits and more lines than a number holds."""
    rng = np.random.default_rng(5)
    frequent = rng.integers(0, 1 << 64, 3000, np.uint64)
    frequent[:4] = np.arange(4, dtype=np.uint64) + (np.uint64(1) << np.uint64(63))
    frequent[4:6] = np.array([(1 << 64) - 1, (1 << 64) - 2], np.uint64)
    h = np.concatenate([frequent, frequent + np.uint64(1), rng.integers(0, 1 << 64, 5000, np.uint64), np.arange(10, dtype=np.uint64)])
    place = {int(f): i for i, f in enumerate(frequent)}
    r = lines.Order(frequent).of(h)
    assert r.tolist() == [(1 << 63) + len(frequent) - place[x] if x in place else x >> 1 for x in h.tolist()]
    assert lines.Order(frequent[:0]).of(h).tolist() == (h >> np.uint64(1)).tolist()
    for near in (h[-10:], h[:-10]):
        r = np.repeat(lines.Order(frequent).of(near), 2)
        for most in (50, 1 << 20):
            line = np.sort(rng.integers(0, most, len(r)))
            by = lines.Order.sort(line, r)
            assert list(zip(line[by].tolist(), r[by].tolist(), strict=True)) == sorted(zip(line.tolist(), r.tolist(), strict=True))
    assert len(lines.Order.sort(line[:0], r[:0])) == 0


def test_members_of_keys_crowded_in_a_batch():
    """A crowded key leaves GROUP + 1 rows and has all its sets as members; the rows of other keys stay."""
    full = np.array([7 << 40] * 40 + [9 << 40] * lines.GROUP + [11 << 40], np.uint64)
    rows = np.zeros(len(full), lines._KEY)
    rows["low"], rows["high"], rows["s"] = full >> np.uint64(32), (full >> np.uint64(16)) & np.uint64(0xFFFF), np.arange(len(full))
    by = np.random.default_rng(3).permutation(len(full))
    keys, hashes, members = lines._parted(rows[by], full[by])
    assert Counter(hashes.tolist()) == {7 << 40: lines.GROUP + 1, 9 << 40: lines.GROUP, 11 << 40: 1}
    assert sorted(members["s"].tolist()) == list(range(40)) and len(set(members["key"].tolist())) == 1
    assert lines._distinct(np.concatenate([members, members])).tolist() == sorted(members.tolist())
    large = [b for b in lines._meet(keys) if b.column(0)[0].as_py() == "large"]
    assert {x.as_py() for b in large for x in b.column(1)} == set(members["key"].view(np.int64).tolist())


def test_taken_rows():
    rows = np.zeros(50, lines._KEY)
    rows["low"], rows["s"], rows["at"] = np.arange(50), np.arange(50) << 40, np.arange(50) % 7
    by = np.random.default_rng(1).integers(0, 50, 90)
    assert lines._taken(rows, by).tolist() == rows[by].tolist() and lines._taken(rows[:0], by[:0]).dtype == lines._KEY


def test_similar_sets(spark):
    """At the threshold, above and below it; the filter has the intersection once."""
    rows = [(list(range(9)), list(range(1, 9))), (list(range(5)), list(range(4))), (list(range(10)), list(range(7))), (list(range(4)), list(range(1, 5))), (list(range(9)), list(range(1, 10)))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a array<bigint>, b array<bigint>").where(lines._similar("a", "b"))
    want = {i for i, (a, b) in enumerate(rows) if len({*a} & {*b}) / len({*a} | {*b}) >= 0.8 - 1e-12}
    assert {r.i for r in df.collect()} == want == {0, 1, 4}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1


def test_places_of_lines():
    texts = ["", "a b\n\nc", "\n", " \n b a ", "x", "", "\ny\n"]
    raw = [t.encode() for t in texts]
    t = common.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    of, line, bounds, _, sets = lines.Order(np.zeros(0, np.uint64)).lines(t)
    assert list(zip(of.tolist(), line.tolist(), np.diff(bounds).tolist(), strict=True)) == [(1, 0, 2), (1, 2, 1), (3, 1, 2), (4, 0, 1), (6, 1, 1)] and sets[0] == sets[2]


def test_frequent_words_of_one_row_in_eight(spark):
    """Only some rows are counted, the same ones however the rows are dealt."""
    df = spark.range(400).selectExpr("id AS doc_id", "concat('each each w', id, ' w', id) AS text")
    got = [set(lines.frequent_words(d, "doc_id", "text").tolist()) for d in (df.coalesce(1), df.repartition(7))]
    own = {int(h) for h in common.hash_words([f"w{i}" for i in range(400)], common.word_table("any"))}
    each = int(common.hash_words(["each"], common.word_table("any"))[0])
    assert got[0] == got[1] and each in got[0] and 10 < len(got[0] & own) < 100


def test_sets_are_shuffled_once_for_both_sides(spark):
    pairs = spark.range(200).selectExpr("id AS a", "id + 1 AS b").repartition(3)
    first = spark.range(201).selectExpr("id AS s", "id AS k", "id AS line", "10L AS n", "shiftleft(1L, cast(id % 8 AS int)) - 1 AS even", "0L AS odd").repartition(3)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = lines._possible(pairs, first)
        got = {(r.a, r.b) for r in left.collect()}
        assert "ReusedExchange" in left._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {(i, i + 1) for i in range(200) if i % 8 < 7}


def test_bytes_of_words_count(spark):
    """A zero byte is a byte of its own; equal sets in any order of words are one."""
    rows = [(1, "a \x00 b c d"), (2, "a \x01 b c d"), (3, "d c b \x00 A"), (4, "a A b c"), (5, "c b a")]
    got = {r.doc_id: r.n_gone for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1}


def test_crowded_lines(spark):
    """Near copies of one line, sets of every small size, and a copy in every row."""
    rng = random.Random(6)
    base = [f"w{i}" for i in range(20)]
    rows = {}
    for i in range(120):
        near = base.copy()
        for _ in range(rng.randrange(4)):
            near[rng.randrange(20)] = f"x{rng.randrange(400)}"
        rows[i] = "\n".join(["the same line in every row", " ".join(near), " ".join(rng.sample(base, rng.randrange(1, 8))), "", " ".join(rng.sample(base, 9))])
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    want = plain_gone(rows)
    got = {r.doc_id: (r.text, r.n_lines, r.n_gone) for r in lines.dedup_lines(df, counts=True).collect()}
    for i, t in rows.items():
        kept = [x for n, x in enumerate(t.split("\n")) if (i, n) not in want]
        assert got[i] == ("\n".join(kept), 5, 5 - len(kept))


def test_rounds_write_few_files(spark, monkeypatch):
    """Small frames of the rounds of crowded keys are a file each, however many shuffle partitions there are; the lines that go are the same."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(20)]
    rows = {i: " ".join([*(w if rng.random() < 0.93 else f"x{rng.randrange(400)}" for w in base)]) for i in range(60)}
    parts, real = [], common.checkpoint

    def counted(df, *rows):
        done = real(df, *rows)
        parts.append(done.rdd.getNumPartitions())
        return done

    monkeypatch.setattr(common, "checkpoint", counted)
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = {(r.k, r.line) for r in lines.gone_lines(spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)).collect()}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == plain_gone(rows) and len(got) > 5
    assert len(parts) > 8 and sum(n > 1 for n in parts) <= 2


def test_files_of_a_checkpoint(spark):
    df = spark.range(common.FILE_ROWS + 1).repartition(30)
    assert [common.checkpoint(df, n).rdd.getNumPartitions() for n in (None, 0, common.FILE_ROWS, common.FILE_ROWS + 1, 1 << 40)] == [30, 1, 1, 2, 30]
    assert common.checkpoint(df, 0).count() == common.FILE_ROWS + 1


def test_lines_of_rows_that_share_a_key(spark):
    """Unlike texts of one key are told apart: a line goes from the row that it repeats in, and from no other."""
    rows = [(1, "one two three four\nfive six"), (2, "one two three four\nseven eight"), (2, "nine ten eleven\ntwelve"), (2, "nine ten eleven\ntwelve"), (2, "five six\nnine ten eleven"), (2, None), (None, "five six"), (-3, "twelve")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, __number int").repartition(3)
    order = {r.doc_id: {} for r in df.collect()}
    for r in df.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("h")).collect():
        order[r.doc_id][r.text] = r.h
    want = plain_gone({(i, h): t for i, of in order.items() if i is not None for t, h in of.items()})
    got = {r["__number"]: (r.text, r.n_gone) for r in lines.dedup_lines(df, counts=True).collect()}
    for at, (i, t) in enumerate(rows):
        go = [n for n in range(2) if t is not None and i is not None and ((i, order[i][t]), n) in want]
        assert got[at] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in go), len(go))


# ---------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def model():
    return pieces.load(PIECES)


def test_pieces_lossless_and_reproducible(spark, docs, texts, model):
    one = {r.doc_id: (r.ids_hash, r.lossless, r.decoded_sha256) for r in pieces.digests(docs.repartition(7), model).collect()}
    assert all(v[1] for v in one.values())
    assert {i: v[2] for i, v in one.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert one == {r.doc_id: (r.ids_hash, r.lossless, r.decoded_sha256) for r in pieces.digests(docs.coalesce(1), model).collect()}


def test_a_block_of_unlike_words_is_light(model):
    """Two workers of an executor hold a block's lattices each; ids don't depend on the block."""
    rng = random.Random(3)
    texts = [" ".join(f"{rng.choice('bdfgklmn')}{rng.getrandbits(40):x}" for _ in range(400)) for _ in range(pieces.CHUNK // 4600)]
    sampler, seeds = pieces.Sampler(model), pieces.seeds_of(list(range(len(texts))))
    tracemalloc.start()
    try:
        ids, bounds = sampler.sample(texts, seeds)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(bounds) == len(texts) + 1 and peak < 200 << 20
    one, _ = sampler.sample(texts[5:6], seeds[5:6])
    assert (ids[bounds[5] : bounds[6]] == one).all()


def test_samples_follow_the_lattice(model):
    """Frequencies of sampled segmentations against all segmentations' weights."""
    word = "there"
    ids = {p: i for i, p in enumerate(model.spell)}

    def all_of(rest, first=True):
        if not rest:
            yield (), 1.0
        for n in range(1, len(rest) + 1):
            i = ids.get((" " if first else "").encode() + rest[:n].encode())
            if i is not None and model.weight[i] > 0:
                for tail, w in all_of(rest[n:], False):
                    yield (i, *tail), w * model.weight[i]
        if first and (i := ids.get(b" ")) is not None:
            for tail, w in all_of(rest, False):
                yield (i, *tail), w * model.weight[i]

    weights: Counter = Counter()
    for seg, w in all_of(word):
        weights[seg] += w
    total, n = sum(weights.values()), 20_000
    out, bounds = pieces.Sampler(model).sample([word] * n, pieces.seeds_of(list(range(n))))
    seen = Counter(tuple(out[bounds[i] : bounds[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(weights)
    for seg, w in weights.most_common(6):
        p = w / total
        assert abs(seen[seg] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_trie_has_all_pieces(model):
    def find(text):
        s = 0
        for ch in text:
            c = int(model.code[ord(ch)])
            t = model.base[s] + c
            if not c or model.check[t] != s:
                return None
            s = t
        return int(model.value[s])

    rng = random.Random(1)
    some = rng.sample([i for i, w in enumerate(model.weight) if w > 0], 500)
    assert all(find(model.spell[i].decode().replace(" ", pieces.MARK)) == i for i in some) and find("zzqqzz") is None


# ---------------------------------------------------------------- word pieces


def test_token_counts_are_greedy(spark, texts):
    vocabulary = set(wordpiece.pieces_of(PIECES))
    longest = max(map(len, vocabulary))

    def greedy(word):
        n, i = 0, 0
        while i < len(word):
            for j in range(min(len(word), i + longest), i, -1):
                if word[i:j] in vocabulary:
                    n, i = n + 1, j
                    break
            else:
                n, i = n + len(word[i].encode()), i + 1
        return n

    got = {r.doc_id: (r.n_words, r.n_tokens) for r in QUERIES["op7_token_counts"](spark, SF).collect()}
    for i, t in texts.items():
        words = [w.decode() for w in t.encode().split()]
        assert got[i] == (len(words), sum(greedy("▁" + w) for w in words))


def test_automaton_on_odd_vocabularies():
    rng = random.Random(3)
    for _ in range(60):
        vocabulary = sorted({"".join(rng.choices("abé", k=rng.randrange(1, 5))) for _ in range(rng.randrange(1, 9))})
        a = wordpiece.LongestMatch(vocabulary)
        for _ in range(40):
            w = "".join(rng.choices("abéz", k=rng.randrange(0, 9)))
            n, i = 0, 0
            while i < len(w):
                m = max((p for p in vocabulary if w.startswith(p, i)), key=len, default="")
                n, i = (n + 1, i + len(m)) if m else (n + len(w[i].encode()), i + 1)
            assert a.count(w) == n


# ---------------------------------------------------------------- licences


def test_base_places(spark, docs):
    notes = [
        (10_001, "x Licensed under CC-BY 4.0; cc  by! CC_BY ALL rights\nreserved. All Rights Reserved"), (10_002, "GNU General Public License v3, the general public licence, general-public-license"),
        (10_003, "cc" * 5 + " by"), (10_004, "all rights all rights reserved cc by cc"), (10_005, licenses.TEMPLATES["mit"][0].upper()), (10_006, "Released under the MIT License."),
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(notes, "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.digest(licenses.scan_licenses(df)).collect()}
    for r in df.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        places = [(i, lab) for p, lab in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        g = got[r.doc_id]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert g.base_labels == ",".join(sorted({lab for _, lab in places})) and set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(",")))
    assert got[10_005].labels == "mit" and got[10_006].labels == "mit" and got[10_005].score == 1.0 and got[10_003].labels == ""


def test_matching_statistics():
    rng = random.Random(2)
    for _ in range(30):
        seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        a = licenses.SuffixAutomaton(seqs)
        text = [rng.randrange(5) for _ in range(25)]
        inside = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for end, (_, n) in enumerate(a.statistics(text)):
            assert n == max((m for m in range(1, end + 2) if tuple(text[end + 1 - m : end + 1]) in inside), default=0)


# ---------------------------------------------------------------- SpotSigs


def test_edited_texts(spark):
    got = {r.doc_id: r for r in QUERIES["op8_fingerprints"](spark, SF).collect()}
    sql = f"""with o as (select doc_id, text, length(text) as n, coalesce(lead(text) over (order by doc_id desc), first_value(text) over (order by doc_id desc)) as x from '{SF}/documents.parquet')
      select doc_id, n, sha256(substr(text, 1, n - n // 3) || substr(x, 1, n // 3)), text, x, substr(text, 1, n - n // 3) || substr(x, 1, n // 3) from o"""
    anchors = set(spotsigs.ANCHORS)

    def signatures(text):
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        out = set()
        for i, x in enumerate(w):
            chain = [y for y in w[i + 1 :] if y not in anchors][:3]
            if x in anchors and len(chain) == 3:
                out.add((x, *chain))
        return out or ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) > 3 else {tuple(w)} if w else {text})

    rows = duckdb.sql(sql).fetchall()
    assert len(rows) == len(got)
    for i, n, sha, text, nxt, edited in rows:
        g, (a, b, c) = got[i], map(signatures, (text, edited, nxt))
        assert (g.n_chars, g.edited_sha256) == (n, sha)
        for near, other in ((g.near_edited, b), (g.near_next, c)):
            j = len(a & other) / len(a | other)
            assert near == pytest.approx(j if j >= spotsigs.FLOOR else 0.0)
        assert (g.fingerprint == g.edited_fingerprint) == (a == b)


def test_pruned_likeness():
    """Pruning by parts, lengths and prefixes never loses a likeness that is wanted."""
    rng = np.random.default_rng(9)
    for _ in range(2000):
        one = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
        two = np.unique(np.concatenate([one[rng.random(len(one)) < rng.random()], rng.integers(0, 60, rng.integers(1, 20)).astype(np.uint64)]))
        j = len(set(one.tolist()) & set(two.tolist())) / len(set(one.tolist()) | set(two.tolist()))
        for at_least in (0.1, 0.5, 0.8):
            assert spotsigs.likeness(one, two, at_least) == pytest.approx(j if j >= at_least else 0.0)


def test_alike(spark, docs):
    some = docs.select("doc_id", "text").where("doc_id < 60")
    extra = some.select(F.col("doc_id") + 1000, F.concat("text", F.lit(" and some more words at the end")))
    df = some.unionAll(extra)
    sets = {r.doc_id: set(r.signatures) for r in spotsigs.fingerprints(df).collect()}
    least = {}
    for i, s in sorted(sets.items()):
        least.setdefault(frozenset(s), i)
    ids = sorted(least.values())
    want = {(a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in spotsigs.alike(df).collect()} == want and want


# ---------------------------------------------------------------- decontamination


def test_wand_finds_all_above_the_threshold(texts):
    items = [(i, *decontaminate.split_item(t)) for i, (t,) in enumerate(duckdb.sql(f"select text from '{SF}/benchmark.parquet' order by item_id").fetchall())]
    index = decontaminate.Index(items)
    n = len(items)
    bags = [Counter(w.tolist()) for w in index.words]
    df = Counter(t for b in bags for t in b)
    mean = sum(map(len, index.words)) / n

    def bm25(query, bag, size):
        return sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * 2.2 / (bag[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in query & set(bag))

    for t in list(texts.values())[:40]:
        raw = np.frombuffer(t.encode(), np.uint8)
        h = common.words(common.Texts(raw, np.array([0, len(raw)])), decontaminate._TABLE)[1]
        want = set()
        for lo in range(0, max(1, len(h) - 48), 16):
            q = set(h[lo : lo + 64].tolist())
            want |= {i for i, b in enumerate(bags) if b and bm25(q, b, len(index.words[i])) >= 0.6 * bm25(set(b), b, len(index.words[i])) * min(1, 48 / len(index.words[i])) - 1e-9}
        assert set(index.retrieved(h)) == want


def test_leaks_are_the_planted_items(spark, texts):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontamination"](spark, SF).collect()}
    items = dict(duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall())
    words = lambda t: " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.lower())) + " "
    flat = {i: words(t) for i, t in texts.items()}
    assert {(i, k) for k, t in items.items() for i in texts if words(t) in flat[i]} <= got
    for i, k in got:
        w, d = words(items[k]).split(), flat[i].split()
        grams = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        assert len(grams & {tuple(d[j : j + 5]) for j in range(len(d) - 4)}) >= 0.8 * len(grams)


def test_index_blocks_give_the_same(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    whole = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} == whole


# ---------------------------------------------------------------- quality, plainly

SPACE = b"\t\n\x0b\x0c\r "


def plain_features(text):
    """Of each passage of a text, by loops over its bytes and words."""
    raw, spans, i = text.encode(), [], 0
    while i < len(raw):
        j = i
        while j < len(raw) and raw[j] not in SPACE:
            j += 1
        if j > i:
            spans.append((i, j))
        i = max(j, i + 1)
    n = max(1, -(-len(spans) // 64))
    out = []
    for k in range(n):
        own = spans[64 * k : 64 * k + 64]
        lo, hi = (0 if k == 0 else own[0][0]), (spans[64 * k + 64][0] if 64 * k + 64 < len(spans) else len(raw))
        part, words = raw[lo:hi], [raw[a:b] for a, b in own]
        x = np.zeros(quality.N_FEATURES)
        for b in part:
            x[quality._CLASS[b]] += 1
        x[:13] = np.sqrt(x[:13] / max(len(part), 1))
        if words:
            sizes = [len(w) for w in words]
            low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
            hashes = common.hash_words([w.decode("utf-8", "surrogateescape") for w in low], quality._TABLE).tolist()
            first, second = [quality._CLASS[w[0]] for w in words], [quality._CLASS[w[1]] if len(w) > 1 else -1 for w in words]
            x[13], x[14] = np.mean(sizes) / 10, np.std(sizes) / 10
            x[15] = sum(a == b for a, b in zip(low, low[1:])) / len(words)
            x[16], x[17], x[18] = sum(f == 1 for f in first) / len(words), sum(f == s == 1 for f, s in zip(first, second)) / len(words), sum(f > 4 for f in first) / len(words)
            x[19], x[20] = len(set(low)) / len(words), len(words) / 64
            for h in hashes:
                x[22 + h % quality.HASHED] += 1 / len(words)
        x[21] = min(math.log1p(n) / 5, 2)
        out.append(x)
    return out


def plain_score(model, text):
    p, encoded, weights = model.p, [], []
    for x in plain_features(text):
        h = np.tanh((x - p["mean"]) / p["sd"] @ p["w"] + p["b"])
        encoded.append(h)
        weights.append(math.exp(min(30, max(-30, float((np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))) @ p["g"])))))
    z = sum(w * h for w, h in zip(weights, encoded)) / sum(weights)
    return 1 / (1 + math.exp(-float(z @ p["c"] + p["d"][0])))


ODD = ["hello wide World A", "  \t starts with space", "A\nB c", "", " \n", "x" * 5000, "é ü 漢字 \U0001f600", "W " * 200, "end.", "UP UP Up up 12 $%"]


@pytest.fixture(scope="module")
def judge(spark):
    docs = common.documents(spark, SF)
    return quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~common.fold(F.col("doc_id"), 5, 0))


def test_quality_of_each_text_alone(spark, judge, texts):
    """Scores are those of a plain forward pass of the text, however rows share batches."""
    rows = [(i, t) for i, t in enumerate([*ODD, *list(texts.values())[:60]])]
    want = {i: plain_score(judge, t) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for shape in (df.coalesce(1), df.repartition(7), df.repartition(50)):
        got = {r.doc_id: r.score for r in quality.score(shape, judge).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-6  # features are 32-bit
    alone = {}
    for i, t in rows[:20]:
        raw = np.frombuffer(t.encode(), np.uint8)
        x, first = quality.passages(common.Texts(raw, np.array([0, len(raw)])))
        alone[i] = float(judge.forward(x.astype(float), first)["score"][0])
    assert max(abs(alone[i] - got[i]) for i in alone) < 1e-12


def test_quality_query_scores_all_texts(spark, judge, texts):
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in QUERIES["op1_quality"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        assert abs(got[i][0] - plain_score(judge, t)) < 1e-6 and got[i][1] == int(got[i][0] >= 0.3) and got[i][2] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_sample_is_one_row_a_key(spark):
    docs = spark.createDataFrame([(1, "a b")] * 50 + [(1, "c d"), (2, None), (3, "e")], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    rows = [common.labelled_sample(d, labels, F.lit(True), "doc_id", "text", "quality", 10, 1).collect() for d in (docs, docs.coalesce(1))]
    assert [sorted(map(tuple, r)) for r in rows][0] == sorted(map(tuple, rows[1])) and sorted((r.k, r.y) for r in rows[0]) == [("1", 1), ("2", 0)]


def test_sample_is_a_few_files(spark):
    settings = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(5)
    labels = spark.range(300).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sample = common.labelled_sample(docs, labels, F.lit(True), "doc_id", "text", "quality", 200, 1)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(sample.inputFiles()) <= 24 and sample.distinct().count() == 200


# ---------------------------------------------------------------- toxicity, plainly


def test_grammar_against_its_rules():
    """The composed machine's clause scores are those of the rules, word by word."""
    rng = random.Random(7)
    words = ["idiot", "stupidity", "kill", "you", "not", "said", "tree", "stupid"]
    s = toxicity.Scorer({"idiot": 2.0}, {"stup": 1.5})
    for _ in range(500):
        clause = rng.choices(words, k=rng.randrange(1, 12))
        total, target, negated, reported, threatened, piled, hits = 0.0, 0, 0, False, False, False, 0
        for w in clause:
            insult = {"idiot": 2.0, "stupid": 1.5, "stupidity": 1.5}.get(w)
            if insult or w == "kill":
                x = insult * (toxicity.PILED if piled else 1.0) if insult else (2.0 if threatened else 0.5)
                total += x * (toxicity.TARGETED if target else 1) * (toxicity.NEGATED if negated else 1) * (toxicity.REPORTED if reported else 1)
                hits += 1
            piled = bool(insult)
            threatened = threatened or w == "you"
            target, negated = (3 if w == "you" else max(0, target - 1)), (3 if w == "not" else max(0, negated - 1))
            reported = reported or w == "said"
        assert s.clauses(" ".join(clause)) == ([(pytest.approx(total), hits)] if hits else [])


def test_letters_against_lookup():
    rng = random.Random(8)
    draw = lambda n: "".join(rng.choices("abc", k=rng.randrange(1, n)))
    for _ in range(50):
        lexicon, stems = {draw(6): rng.random() + 0.1 for _ in range(6)}, {draw(4): rng.random() + 0.1 for _ in range(4)}
        letters = toxicity.Letters(lexicon, stems)
        for _ in range(60):
            w = draw(9)
            best = max([lexicon.get(w, 0.0), *(x for p, x in stems.items() if w.startswith(p))])
            assert letters.read(w) == (("I", best) if best else ("O", 0.0))
    assert toxicity.Letters({}, {}).read("kill") == ("T", 1.0) and toxicity.Letters({"x" * 100: 1.0}, {}).read("x" * 100) == ("I", 1.0)


def test_toxicity_scores_follow_the_model(spark, texts):
    docs = common.documents(spark, SF)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), ~common.fold(F.col("doc_id"), 5, 0))
    scorer = toxicity.Scorer(model.lexicon, model.stems)
    for r in QUERIES["op2_toxicity"](spark, SF).collect():
        z = float(scorer.features(texts[r.doc_id]) @ model.weights + model.bias) if scorer.clauses(texts[r.doc_id]) else model.bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-z))) and r.predicted == int(r.score >= 0.5)


# ---------------------------------------------------------------- language, plainly


def test_language_is_the_nearest_codeword(spark, texts):
    docs = common.documents(spark, SF)
    model = language.train(docs, ~common.fold(F.col("doc_id"), 3, 1))
    for r in language.predict(docs, model).collect():
        loss = []
        for word in model.code:
            margins = language.histogram(texts[r.doc_id].encode()) @ model.weights + model.bias
            loss.append(sum(t * math.log1p(math.exp(-m * c)) for t, m, c in zip(model.trust, margins, word)) / sum(model.trust))
        if not re.search(r"[^\W\d_]", texts[r.doc_id]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == model.languages[int(np.argmin(loss))] and r.score == pytest.approx(1 / sum(math.exp(-4 * (x - min(loss))) for x in loss), rel=1e-4)


def test_language_sample_has_whole_texts_of_all_languages(spark):
    """A rare language among many, told by what stands at a long text's end; copies of a row count once."""
    rows = [(i, "0 " * 30_000 + f"abc{'xyzw'[i % 4]} " * 40, f"l{i % 250:03d}") for i in range(260)] + [(1, "0 " * 30_000 + "abcy " * 40, "l001")] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    model = language.train(df, F.lit(True), sample_rows=3)
    assert len(model.languages) == 250 and model.weights.any()


# ---------------------------------------------------------------- classifiers on held-out rows


def test_quality_held_out(spark):
    r = QUERIES["op1_quality"](spark, SF_LEARN).join(spark.read.parquet(f"{SF_LEARN}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.quality for x in r) >= 0.95 * len(r) and len(r) > 50


def test_toxicity_held_out(spark):
    r = QUERIES["op2_toxicity"](spark, SF_LEARN).join(spark.read.parquet(f"{SF_LEARN}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(x.predicted == x.toxic for x in r) >= 0.9 * len(r) and sum(x.predicted and x.toxic for x in r) > 0


def test_language_held_out(spark):
    r = QUERIES["op9_language"](spark, SF_LEARN).join(common.documents(spark, SF_LEARN), "doc_id").where("held_out").collect()
    assert sum(x.lang_pred == x.lang for x in r) >= 0.98 * len(r) and len(r) > 200


def test_grammar():
    s = toxicity.Scorer({"idiot": 2.0}, {"stup": 1.0})
    score = lambda t: sum(c[0] for c in s.clauses(t))
    assert score("an idiot") == 2.0 and score("stupid") == 1.0 and score("nothing here") == 0
    assert score("not an idiot") == pytest.approx(0.8) and score("he said what an idiot") == pytest.approx(2.0 * toxicity.REPORTED)
    assert score("you idiot") == pytest.approx(2.0 * toxicity.TARGETED) and score("kill") < score("you kill")
    assert score("not here. an idiot") == 2.0  # a clause's end clears the state


def test_codewords():
    for k in (2, 3, 4, 9, 30):
        c = language.codewords(k)
        assert len({tuple(r) for r in c.tolist()}) == k
    assert ((language.codewords(4)[:, None] != language.codewords(4)[None]).sum(-1) + 99 * np.eye(4) >= 4).all()


def test_passages_cover_texts():
    rows = ["", "one", "w " * 64, "w " * 65, "long word " * 500]
    raw = [x.encode() for x in rows]
    t = common.Texts(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    x, first = quality.passages(t)
    assert np.diff(first).tolist() == [1, 1, 1, 2, 16] and np.isfinite(x).all() and len(x) == first[-1]
