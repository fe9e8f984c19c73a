"""Tokenising operators against the library, file format and splices."""

import hashlib
import zlib

import numpy as np
import pytest
from helpers import LONG, ODD, by_id, no_docs, odd_docs, sample_texts

from cinderlog.llm import bytebpe, direct_codes, queries, token_counts, word_table


@pytest.fixture(scope="module")
def byte_ids():
    library = bytebpe.ByteBPE().tokenizer
    return lambda text: library.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_the_library(byte_ids, sf_dir):
    bpe = bytebpe.ByteBPE(most=500)
    for _, text in [*sample_texts(sf_dir), *ODD]:
        assert np.frombuffer(bpe.encode(text or ""), "<u2").tolist() == byte_ids(text)


def test_direct_codes_read_any_id():
    rng = np.random.default_rng(3)
    for ids in ([], [0], [255, 256, 65535, 65536, 2**32 - 1], rng.integers(0, 50257, 5000), rng.integers(0, 2**31, 3000)):
        codes = direct_codes.DirectCodes.from_bytes(direct_codes.DirectCodes.of(np.array(ids)).to_bytes())
        assert codes.decode().tolist() == [int(i) for i in ids]
        assert [codes[i] for i in range(codes.n)] == [int(i) for i in ids]
        with pytest.raises(IndexError):
            codes[codes.n]
    with pytest.raises(ValueError):
        direct_codes.DirectCodes.from_bytes(b"nothing of the kind")


def expected_file(rows, byte_ids):
    start, out = 0, {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*byte_ids(text), 0], "<u4")
        out.setdefault(doc_id, []).append((start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_file_of_a_table(spark, sf_dir, byte_ids):
    got = by_id(queries.QUERIES["op8_direct_codes"](spark, sf_dir).collect())
    assert got == expected_file(sample_texts(sf_dir), byte_ids)


def test_token_file_of_odd_rows(spark, byte_ids, tmp_path, monkeypatch):
    path = str(tmp_path / "codes")
    direct_codes.write_tokens(odd_docs(spark), path)
    rows = direct_codes.read_tokens(spark, path).collect()
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, _ in ODD), key=lambda i: (i is not None, i or 0))
    assert sum(r.n_tokens for r in rows) == sum(len(byte_ids(t)) + 1 for _, t in ODD)
    texts = {i: t for i, t in ODD if i}
    one = next(r for r in rows if r.doc_id == 9)
    assert one.ids_crc32 == zlib.crc32(np.array([*byte_ids(texts[9]), 0], "<u4").tobytes())
    assert direct_codes.token_at(spark, path, one.part, one.seq, one.place + 100) == byte_ids(texts[9])[100]
    assert direct_codes.write_and_read(no_docs(spark)).collect() == []


def test_counts_of_a_table(spark, sf_dir, byte_ids):
    got = by_id(queries.QUERIES["op9_token_counts"](spark, sf_dir).collect())
    for doc_id, text in sample_texts(sf_dir):
        n = len(byte_ids(text))
        assert got[doc_id] == [(len(text.encode()), n, n > 1024)]


@pytest.mark.parametrize("chunk,overlap", [(32_768, 256), (400, 40), (64, 20)])
def test_counts_do_not_depend_on_chunks(spark, byte_ids, chunk, overlap):
    got = token_counts.count_tokens(odd_docs(spark), chunk=chunk, overlap=overlap).collect()
    want = [(i, len((t or "").encode()), len(byte_ids(t))) for i, t in ODD]
    assert sorted([tuple(r)[:3] for r in got], key=repr) == sorted(want, key=repr)
    assert token_counts.count_tokens(no_docs(spark)).collect() == []


def test_splices_of_hard_texts(spark, byte_ids):
    """Texts without a place to splice are done again with wider overlaps."""
    rng = np.random.default_rng(5)
    texts = ["a" * 3000, " " * 2000 + "x", "<|endoftext|>" * 200, "'ll" * 900, "".join(map(chr, rng.integers(32, 0x2FF, 4000)))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, chunk=100, overlap=20).collect()}
    assert got == {i: len(byte_ids(t)) for i, t in enumerate(texts)}


def word_rows(rows):
    library = word_table.library(word_table.VOCABULARY)
    out = {}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        out.setdefault(doc_id, []).append((len(ids), *digests))
    return {k: sorted(v) for k, v in out.items()}


def test_word_table_of_a_table(spark, sf_dir):
    got = queries.QUERIES["op4_word_table"](spark, sf_dir).collect()
    assert by_id(got) == word_rows(sample_texts(sf_dir))


def test_word_table_of_odd_rows(spark):
    assert by_id(word_table.encode_and_decode(odd_docs(spark), digest=True).collect()) == word_rows(ODD)
    real = {r.doc_id: r for r in word_table.encode_and_decode(odd_docs(spark)).collect()}
    library = word_table.library(word_table.VOCABULARY)
    assert real[9].ids == library.encode(LONG, add_special_tokens=False).ids
    assert real[9].decoded == library.decode(real[9].ids, skip_special_tokens=False)
    assert word_table.encode_and_decode(no_docs(spark)).collect() == []
