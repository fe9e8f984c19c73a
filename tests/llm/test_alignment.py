"""Alignment of two vocabularies against all pairs of byte ranges."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from helpers import ODD, no_docs, odd_docs, sample_texts
from tokenizers import Tokenizer

from cinderlog.llm import alignment, queries
from cinderlog.llm.bytebpe import byte_letters
from cinderlog.llm.common import tokenizer_path

LETTERS = {c: i for i, c in byte_letters().items()}
MORE = [
    (50, " "), (51, "  two  leading"), (52, "▁ x"), (53, "<s> </s> <0x41> <|endoftext|>"), (54, "ﬁ Å é 　wide\xa0hard"),
    (55, "tail "), (56, "\U0001F600" * 9), (57, "tab\tand\r\nline \n end"),
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def plain(libraries, text):
    """(ids of A, ids of B, groups, links) by comparing every range with every range near it."""
    a, b = libraries
    if not text:
        return [], [], [], []
    got = a.encode(" " + text, add_special_tokens=False)
    a_ids = got.ids
    a_bytes = [bytes(LETTERS[c] for c in t) for t in got.tokens]
    b_ids = b.encode(text)
    b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
    want = (" " + text).encode()
    if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return [], [], [], []
    owner = [[i for i, x in enumerate(side) for _ in x] for side in (a_bytes, b_bytes)]
    pairs = sorted(set(zip(*owner, strict=True)))
    ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (a_bytes, b_bytes)]
    groups, low = [], 0
    for cut in sorted(ends[0] & ends[1]):
        groups.append([list(dict.fromkeys(side[low:cut])) for side in owner])
        low = cut
    return a_ids, b_ids, [([a_ids[i] for i in x], [b_ids[j] for j in y]) for x, y in groups], [(a_ids[i], b_ids[j]) for i, j in pairs]


def plain_rows(libraries, rows):
    made = [(doc_id, *plain(libraries, text)) for doc_id, text in rows]
    count = Counter(pair for m in made for pair in m[4])
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, a, b, groups, links in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(text.encode()).hexdigest() if a else "",
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_odd_texts(spark, libraries):
    docs = odd_docs(spark).select("doc_id", "text", "key", "ord", "block").unionByName(
        spark.createDataFrame(MORE, "doc_id long, text string"), allowMissingColumns=True)
    assert got(alignment.align_documents(docs)) == plain_rows(libraries, ODD + MORE)


def test_whole_query_and_small_blocks(spark, sf_dir, libraries):
    want = plain_rows(libraries, sample_texts(sf_dir))
    out = queries.QUERIES["op13_lockstep_alignment"](spark, sf_dir)
    assert got(out) == want
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got(alignment.align_documents(docs, block_bytes=4000)) == want


@pytest.mark.parametrize("lane", [1, 7, 64, 1 << 20])
def test_lanes_do_not_change_links(lane, libraries, sf_dir):
    texts = [t for _, t in sample_texts(sf_dir)[:40]] + [t for _, t in MORE] + ["x" * 3000, "a b " * 900]
    both = alignment.shared(alignment.A_VOCABULARY, alignment.B_VOCABULARY)
    made, at = alignment.align(both, texts, lane), 0
    for i, text in enumerate(texts):
        a, b, groups, links = plain(libraries, text)
        n = int(made["n_links"][i])
        keys = made["keys"][at : at + n]
        assert (int(made["n_a"][i]), int(made["n_b"][i]), int(made["n_groups"][i])) == (len(a), len(b), len(groups))
        assert sorted(zip((keys >> 32).tolist(), (keys & 0xFFFFFFFF).tolist(), strict=True)) == sorted(links)
        at += n


def test_no_rows(spark):
    assert alignment.align_documents(no_docs(spark)).collect() == []


def test_a_full_block_takes_bounded_memory(sf_dir):
    import tracemalloc

    both = alignment.shared(alignment.A_VOCABULARY, alignment.B_VOCABULARY)
    texts = [t for _, t in sample_texts(sf_dir) if t]
    texts *= 1 + alignment.BLOCK_BYTES // sum(len(t.encode()) for t in texts)
    alignment.align(both, texts[:50])
    tracemalloc.start()
    try:
        alignment.align(both, texts)
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
