"""The n-gram join against all pairs."""

import random
from collections import defaultdict

import pytest
from helpers import ODD, no_docs, odd_docs, sample_texts

from cinderlog.llm import ngram_join, queries


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def all_pairs(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)].append(doc_id)
    ids = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(s), ids[top(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_join_of_a_table(spark, sf_dir):
    assert got(queries.QUERIES["op10_ngram_join"](spark, sf_dir)) == all_pairs(sample_texts(sf_dir))


def test_join_of_odd_rows(spark):
    assert got(ngram_join.link_documents(odd_docs(spark))) == all_pairs(ODD)
    assert ngram_join.link_documents(no_docs(spark)).collect() == []


def families(seed, n=320):
    """Copies with a few edits around the threshold, many tiny texts, and shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = rng.choices(words, k=18)
    rows, roots = [], []
    for i in range(n):
        kind = rng.random()
        if roots and kind < 0.55:
            text = list(rng.choice(roots))
            for _ in range(rng.choice([1, 1, 2, 3, max(1, len(text) // 40)])):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1]))
        elif kind < 0.7:
            text = rng.choices(words[:3], k=rng.randint(1, 14))
        else:
            text = rng.choices(words, k=rng.choice([6, 9, 12, 20, 40, 90, 200, 500]))
            if rng.random() < 0.5:
                at = rng.randrange(len(text))
                text[at:at] = passage
        if text:
            roots.append(text)
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("seed,small", [(1, 12), (2, 2), (3, 1)])
def test_join_of_families(spark, seed, small):
    rows = families(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.link_documents(docs, small)) == all_pairs(rows)


def test_signatures_meet(spark):
    """Similar sets share as many signatures as the reserve promises, unless both are odd."""
    import numpy as np

    rng = np.random.default_rng(7)
    for n in [*range(1, 60), 100, 300, 900]:
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        h = ngram_join.difference(n, n)
        for cut in {0, h // 2, h}:
            b = np.concatenate([a[cut:], rng.integers(0, 2**63, h - cut, dtype=np.uint64)])
            if not len(b) or 100 * (n - cut) < 80 * (n + h - cut):
                continue
            (x, odd_a), (y, odd_b) = ngram_join.signatures(np.sort(a)), ngram_join.signatures(np.sort(b))
            least = ngram_join.reserve(ngram_join.difference(n, len(b)))
            assert (odd_a and odd_b) or len(np.intersect1d(x, y)) > (0 if odd_a or odd_b else least)


@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
def test_shared_groups_are_whole_however_batches_are_cut(cut, monkeypatch):
    from itertools import groupby
    from types import SimpleNamespace

    import pyarrow as pa

    monkeypatch.setattr(ngram_join, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 2)))
    draw = random.Random(cut)
    rows = sorted((sig, draw.randrange(12)) for sig in range(-40, 40) for _ in range(draw.choice([1, 2, 3, 4, 5, 30])))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a:a + cut]], pa.int64()) for i in (0, 1)], names=["sig", "h1"])
               for a in range(0, len(rows), cut)]
    out = [tuple(r.values()) for b in ngram_join._shared(4)(iter(batches)) for r in b.to_pylist()]
    got = [(sorted(h for _, h, _ in g), {x for _, _, x in g}) for _, r in groupby(out, lambda r: r[0]) for g in [list(r)]]
    want = [sorted(s) for _, g in groupby(rows, lambda r: r[0]) for s in [{h for _, h in g}] if len(s) > 1]
    assert got == [(s, {len(s) > 4}) for s in want]
    assert len({sig for sig, _, _ in out}) == len(want) and all(sig >> 40 == 2 for sig, _, _ in out)


def test_sketches_never_part_similar_sets():
    """The bound of two sketches is at most the true difference, and parts unlike sets."""
    import numpy as np

    rng = np.random.default_rng(3)
    for n in [*range(1, 40), 64, 65, 127, 129, 500, 1025]:
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for cut in {0, n // 9, n // 2, n}:
            for added in {0, n // 9, n // 5, n}:
                b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**63, added, dtype=np.uint64)]))
                true = len(np.setxor1d(a, b))
                if len(b):
                    least = ngram_join.least_difference(ngram_join.sketch(a), ngram_join.sketch(b))
                    assert least == ngram_join.least_difference(ngram_join.sketch(b), ngram_join.sketch(a)) <= true
        other = ngram_join.sketch(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert n < 30 or ngram_join.least_difference(ngram_join.sketch(a), other) > ngram_join.difference(n, n)
    # Counts are capped at 3, so these look equal.
    equal = np.arange(8, dtype=np.uint64) << np.uint64(32)
    assert ngram_join.least_difference(ngram_join.sketch(equal), ngram_join.sketch(equal[:6])) == 0


def test_sets_of_unlike_candidates_stay_where_they_are(spark, monkeypatch):
    """Texts with a passage in common are candidates; the sets of pairs that can't link are not fetched."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    passage = rng.choices(words, k=60)
    rows = [(i, " ".join(rng.choices(words, k=60) + passage + rng.choices(words, k=20))) for i in range(60)]
    rows += [(60 + i, text + " end") for i, text in rows[:4]]
    counts = {"candidates": 0, "sets": 0}
    real = ngram_join.settle

    def settle(df, label):
        out = real(df, label)
        if label == "candidates":
            counts["candidates"] += out.count()
        elif "shingles" in out.columns:
            counts["sets"] += out.count()
        return out

    monkeypatch.setattr(ngram_join, "settle", settle)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.link_documents(docs)) == all_pairs(rows)
    assert counts["candidates"] > 50 and 8 <= counts["sets"] <= 12
