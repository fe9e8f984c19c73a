"""Language-model scores against a plain count of everything."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, no_docs, odd_docs, sample_texts

from cinderlog.llm import lm_score, queries


def tokens(text):
    return [w for w in (text or "").encode().lower().split()] + [b"\0end"]


def fold(doc_id):
    return 0 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 10


class Plain:
    """The same model with dictionaries over all n-grams."""

    def __init__(self, rows, order, without=None):
        self.order, self.counts, self.docs = order, [Counter() for _ in range(order + 1)], 0
        for doc_id, text in rows:
            if fold(doc_id) in (0, without):
                continue
            self.docs += 1
            seq = [b"\0begin", *tokens(text)]
            for k in range(1, order + 1):
                self.counts[k].update(tuple(seq[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(seq)))
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])

    def base(self, w):
        return (self.counts[1][(w,)] + 0.1) / (self.n + 0.1 * (self.v + 1))

    def walk(self, text, weights, upto):
        """For each token: p, last estimate, lower p, context count."""
        seq = [b"\0begin", *tokens(text)]
        for i in range(1, len(seq)):
            p, ml, low, context = self.base(seq[i]), 0.0, self.base(seq[i]), 0
            for k in range(2, upto + 1):
                low, ml, context = p, 0.0, 0
                if i >= k - 1:
                    h = tuple(seq[i - k + 1 : i])
                    context = self.docs if h == (b"\0begin",) else self.counts[k - 1][h]
                    ml = self.counts[k][(*h, seq[i])] / context if context else 0.0
                if k in weights and context:
                    a = weights[k][min(int(math.frexp(context)[1]), lm_score.BUCKETS - 1)]
                    p = a * ml + (1 - a) * low
            yield p, ml, low, context


def plain_scores(rows, order=3):
    deleted, model, weights = Plain(rows, order, without=1), Plain(rows, order), {}
    for k in range(2, order + 1):
        cells = Counter()
        for doc_id, text in rows:
            if fold(doc_id) == 1:
                for _, ml, low, context in deleted.walk(text, weights, k):
                    if context:
                        step = lambda x: int(np.round(np.log10(x) * lm_score.FINE)) if x > 0 else 1
                        cells[min(int(math.frexp(context)[1]), lm_score.BUCKETS - 1), step(ml), step(low)] += 1
        Row = type("Row", (), {})
        stats = []
        for (b, ml, low), n in cells.items():
            stats.append(Row())
            stats[-1].__dict__.update(bucket=b, ml=ml, low=low, n=n)
        weights[k] = lm_score.expectation_maximisation(stats)
    out = defaultdict(list)
    for doc_id, text in rows:
        seq = tokens(text)
        out[doc_id].append((
            fold(doc_id) == 0, len(seq), sum(model.counts[1][(w,)] > 0 for w in seq), model.n,
            sum(math.log10(model.base(w)) for w in seq), sum(math.log10(x[0]) for x in model.walk(text, weights, order)),
        ))
    return out


def same(got, want):
    seen = defaultdict(list)
    for r in got:
        seen[r[0]].append(tuple(r)[1:])
    assert set(seen) == set(want)
    for k in want:
        for a, b in zip(sorted(seen[k]), sorted(want[k]), strict=True):
            assert a[:4] == b[:4]
            assert a[4:] == pytest.approx(b[4:], rel=1e-7)


def test_scores_of_a_table(spark, sf_dir):
    rows = queries.QUERIES["op3_lm_score"](spark, sf_dir).collect()
    same(rows, plain_scores(sample_texts(sf_dir)))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_of_odd_rows(spark, order):
    same(lm_score.score(odd_docs(spark), order).collect(), plain_scores(ODD, order))


def test_scores_of_nothing(spark):
    assert lm_score.score(no_docs(spark)).collect() == []
    lone = spark.createDataFrame([(None, "all held out")], "doc_id long, text string")
    row = lm_score.score(lone).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens) == (True, 4, 0, 0)


def test_weights_find_the_better_estimate():
    rows = [type("R", (), {"bucket": b, "ml": ml, "low": low, "n": 100}) for b, ml, low in ((3, -8, -60), (5, 1, -20))]
    weights = lm_score.expectation_maximisation(rows)
    assert weights[3] > 0.99 and weights[5] < 0.01 and weights[7] == 0.5
