"""Operators on texts against plain versions of them."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from helpers import ODD, by_id, no_docs, odd_docs, sample_texts

from cinderlog.llm import queries, suffix_dedup


def plain_repeats(rows, length, keep_first=False):
    """For each row: the removed stretches."""
    texts = [(t or "").encode() for _, t in rows]
    places = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, first = Counter(), {}
    for i in places:
        for at in range(len(texts[i]) - length + 1):
            s = texts[i][at : at + length]
            seen[s] += 1
            first.setdefault(s, (i, at))
    out = []
    for i, t in enumerate(texts):
        spans = []
        for at in range(len(t) - length + 1):
            s = t[at : at + length]
            if seen[s] > 1 and not (keep_first and first[s] == (i, at)):
                if spans and at <= spans[-1][1]:
                    spans[-1][1] = at + length
                else:
                    spans.append([at, at + length])
        out.append([tuple(s) for s in spans])
    return out


def cut(text, spans):
    at, kept = 0, b""
    for a, b in spans:
        kept += text[at:a]
        at = b
    return kept + text[at:]


def spans_of(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(([tuple(s) for s in r.spans], bytes(r.kept)))
    return {k: sorted(v) for k, v in out.items()}


def expected_spans(rows, length, keep_first=False):
    out = defaultdict(list)
    for (doc_id, text), spans in zip(rows, plain_repeats(rows, length, keep_first), strict=True):
        out[doc_id].append((spans, cut((text or "").encode(), spans)))
    return {k: sorted(v) for k, v in out.items()}


def test_repeats_of_a_table(spark, sf_dir):
    rows = sample_texts(sf_dir)
    want = {}
    for (doc_id, text), spans in zip(rows, plain_repeats(rows, 200), strict=True):
        raw = text.encode()
        kept = cut(raw, spans)
        want[doc_id] = [(len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())]
    assert by_id(queries.QUERIES["op2_suffix_dedup"](spark, sf_dir).collect()) == want


def tangled(seed, n=60):
    """Texts made of shared pieces with edits, periods and zero bytes."""
    rng = random.Random(seed)
    letters = "ab\0é"
    shared = ["".join(rng.choices(letters, k=rng.randint(15, 60))) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            kind = rng.random()
            piece = rng.choice(shared) if kind < 0.6 else "".join(rng.choices("abcdefgh", k=rng.randint(1, 30)))
            if kind < 0.1:
                piece = rng.choice(["a", "ab", "xyz"]) * rng.randint(5, 30)
            at = rng.randrange(len(piece))
            parts.append(piece if rng.random() < 0.5 else piece[:at] + rng.choice("xyz") + piece[at:])
        rows.append((i, "".join(parts)))
    return rows


@pytest.mark.parametrize("seed,length,keep_first,hot", [
    (1, 20, False, 2000), (2, 21, True, 2000), (3, 16, False, 3), (4, 16, True, 3), (5, 40, False, 1),
])
def test_repeats_of_tangled_texts(spark, seed, length, keep_first, hot):
    rows = tangled(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(suffix_dedup.remove_repeats(docs, length, keep_first, hot)) == expected_spans(rows, length, keep_first)


def test_repeats_of_odd_rows(spark):
    rows = [(i, t if t is None or len(t) < 9000 else t[:9000]) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert spans_of(suffix_dedup.remove_repeats(docs, 20)) == expected_spans(rows, 20)
    assert len(suffix_dedup.remove_repeats(odd_docs(spark)).collect()) == len(ODD)
    assert suffix_dedup.remove_repeats(no_docs(spark)).collect() == []
