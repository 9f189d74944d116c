"""What must not depend on the size of a block, the length of a unit or the words that follow."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from twinloom.llm import common, decontaminate, licenses, pieces
from twinloom.llm.queries import PIECES

SF = "/root/testdata/sf0.001"


def test_index_blocks_give_the_same_scores(spark, monkeypatch):
    docs, items = common.documents(spark, SF), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = lambda: {tuple(r) for r in decontaminate.leaks(docs, items).collect()}
    kept = lambda: {r.doc_id for r in decontaminate.clean_rows(docs, items).collect()}
    whole, left = found(), kept()
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    assert len(list(decontaminate.item_blocks(items))) > 1
    assert found() == whole and kept() == left


def test_passes_give_the_same(spark, monkeypatch):
    docs, items = common.documents(spark, SF), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = lambda: {tuple(r) for r in decontaminate.leaks(docs, items).collect()}
    whole, left = found(), {r.doc_id for r in decontaminate.clean_rows(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    monkeypatch.setattr(decontaminate, "AT_ONCE", 2)
    assert found() == whole and {r.doc_id for r in decontaminate.clean_rows(docs, items).collect()} == left


def words_of(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return common.words(common.Texts(raw, np.array([0, len(raw)])), decontaminate._TABLE)[1]


def test_runs_are_verified_one_by_one(monkeypatch):
    """Parts of an item that stand far apart don't add up; a whole copy after a part is found, in blocks of any size."""
    item = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(1, " ".join(item[:40]), " ".join(item[40:])), (2, "another item", "of five")])
    other = [f"o{i}" for i in range(3000)]
    apart = " ".join([*item[:42], *other, *item[18:]])
    whole = " ".join([*item[:42], *other, *item, *other])
    for passages in (4096, 3):
        monkeypatch.setattr(decontaminate, "PASSAGES", passages)
        assert len(index.retrieved(words_of(apart))[0]) == 2 and list(index.leaks(words_of(apart))) == []
        assert [(x[0], x[2]) for x in index.leaks(words_of(whole))] == [(1, 1.0)]


def test_repeated_items_and_rows(spark):
    text = "the quick brown fox jumps over the lazy dog and then sleeps for a long while"
    docs = spark.createDataFrame([(1, text), (1, text), (2, None), (3, "")], "doc_id long, text string")
    items = spark.createDataFrame([(7, text), (7, text), (None, text), (8, None)], "item_id long, text string")
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()), key=str) == [(1, 7)] * 4 + [(1, None)] * 2
    assert sorted(r.doc_id for r in decontaminate.clean_rows(docs, items).collect()) == [2, 3]


def test_statistics_of_blocks():
    items = [(1, "one two two", "three"), (2, "two", ""), (3, "", "")]
    whole = decontaminate.statistics([items])
    blocks = decontaminate.statistics([items[:1], items[1:]])
    assert whole[0] == 3 and whole[1] == 5 / 3 and sorted(whole[3].tolist()) == [1, 1, 2]
    assert all(np.array_equal(a, b) for a, b in zip(whole, blocks, strict=True))


def scanned(scanner, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return scanner.scan(scanner.lookup(common.words(common.Texts(raw, np.array([0, len(raw)])), licenses._TABLE)[1]))


def test_short_template_within_a_longer_match():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES)
    notice = 'Licensed under the Apache License, Version 2.0 (the "License"). See LICENSE'
    for text, first in ((notice, 0), ("zz licensed under the apache license version 2 0 the zz", 1)):
        assert [(scanner.names[k], a, b, c) for k, a, b, c in scanned(scanner, text)[1]] == [("apache-2.0", first, first + 7, 1.0)]


def test_whole_templates_are_found():
    """All templates that stand whole in random texts, however the others go on."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        templates = {str(i): [" ".join(rng.choice(list("abc"), rng.integers(1, 9)))] for i in range(5)}
        scanner = licenses.Scanner(templates, {})
        text = " ".join(rng.choice(list("abcz"), 40, p=[0.32, 0.32, 0.32, 0.04]))
        found = {scanner.names[k] for k, *_, share in scanned(scanner, text)[1] if share == 1.0}
        assert found >= {i for i, (t,) in templates.items() if f" {t} " in f" {text} "}


def test_every_copy_has_its_span():
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.BASE_PHRASES)
    grant = licenses.TEMPLATES["mit"][0]
    words = len(licenses._tokens(grant))
    other = " ".join(f"other{i}" for i in range(50))
    spans = lambda t: [(scanner.names[k], a, b, c) for k, a, b, c in scanned(scanner, t)[1]]
    assert spans(f"{grant} {other} {grant}") == [("mit", 0, words - 1, 1.0), ("mit", words + 50, 2 * words + 49, 1.0)]
    short = licenses.TEMPLATES["cc-by-sa"][0]
    assert [x[1:] for x in spans(f"{short} " * 2000) if x[0] == "cc-by-sa"] == [(7 * i, 7 * i + 6, 1.0) for i in range(2000)]


def test_chains_against_all_chains():
    """The largest cover of a template that any chain has, and no span without one."""
    rng = np.random.default_rng(8)
    for _ in range(150):
        size = int(rng.integers(5, 12))
        hits = sorted({(int(rng.integers(0, 25)), int(p := rng.integers(0, size)), int(rng.integers(1, size - p + 1))) for _ in range(int(rng.integers(1, 7)))})

        def covers(chain):
            """Covered tokens, or None if it isn't a chain."""
            total = chain[0][2]
            for (s, p, m), (start, place, n) in zip(chain, chain[1:]):
                cut = max(s + m - start, p + m - place, 0)
                if not (s < start and p < place and cut < n and start + cut - s - m <= size):
                    return None
                total += n - cut
            return total

        every = [c for k in range(1, len(hits) + 1) for c in itertools.combinations(hits, k)]
        most = max(c for x in every if (c := covers(x)) is not None)
        got = licenses.spans_of(hits, size)
        if most >= licenses.COVERED * size:
            assert max(c for *_, c in got) == most / size
        else:
            assert got == []
        assert all(a[1] < b[0] for a, b in zip(got, got[1:]))
        possible = {(x[0][0], x[-1][0] + x[-1][2] - 1, c / size) for x in every if (c := covers(x)) is not None}
        assert set(got) <= possible


def segmentations(model, text, ids):
    """All of a unit's segmentations into pieces, with their weights; text has a mark for each space."""
    if not text:
        yield (), 1.0
    for n in range(1, min(len(text), model.longest) + 1):
        if (i := ids.get(text[:n])) is not None:
            for tail, w in segmentations(model, text[n:], ids):
                yield (i, *tail), w * model.weight[i]


def agree(model, text, n=20_000):
    """Frequencies of sampled segmentations against all segmentations' weights."""
    ids = {s.decode().replace(" ", pieces.MARK): i for i, s in enumerate(model.spell) if model.weight[i] > 0}
    weights = Counter()
    for seg, w in segmentations(model, (" " + text).replace(" ", pieces.MARK), ids):
        weights[seg] += w
    total = sum(weights.values())
    out, bounds = pieces.Sampler(model).sample([text] * n, pieces.seeds_of(list(range(n))))
    seen = Counter(tuple(out[bounds[i] : bounds[i + 1]].tolist()) for i in range(n))
    assert set(seen) <= set(weights)
    for seg, w in weights.most_common(8):
        p = w / total
        assert abs(seen[seg] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
    return weights


def small_model(words):
    names = [pieces.MARK, *words]
    weight = np.full(len(names), 1e-3)
    weight[[len(w) > 1 for w in names]] = 1e-12  # as much as the single characters
    return pieces.Model([w.replace(pieces.MARK, " ").encode() for w in names], weight, len(names), *pieces.double_array([(w, i) for i, w in enumerate(names)]))


def test_long_unit_against_all_segmentations():
    unit = "".join(chr(0x4E00 + i) for i in range(45))
    model = small_model([*unit, unit[8:12], unit[29:33], unit[31:35]])  # two of them reach over the 32nd character
    weights = agree(model, unit)
    assert len(weights) == 6 and max(weights.values()) < 0.9 * sum(weights.values())


def test_unit_of_any_length():
    unit = "".join(chr(0x4E00 + i) for i in range(3000))
    model = small_model([*unit, unit[2000:2004]])
    n = 2000
    out, bounds = pieces.Sampler(model).sample([unit] * n, pieces.seeds_of(list(range(n))))
    sizes = np.diff(bounds)
    one, four = model.weight[1] ** 4, model.weight[-1]
    p = four / (one + four)
    assert set(sizes.tolist()) <= {2998, 3001} and abs((sizes == 2998).mean() - p) < 5 * math.sqrt(p * (1 - p) / n)


@pytest.mark.parametrize("text", ["a  b", "  it", "the   "])
def test_runs_of_spaces_against_all_segmentations(text):
    model = pieces.load(PIECES)
    weights = agree(model, text)
    two = next(i for i, s in enumerate(model.spell) if s == b"  " and model.weight[i] > 0)
    assert any(two in seg for seg in weights)
