"""Exact dedup, line chunks, benchmark search, toxicity and the pipeline."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, no_docs, odd_docs, sample_texts

import corpus_pipeline
from cinderlog.llm import line_chunks, queries, radix_dedup, spaced_seeds, toxicity


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# Exact dedup

def plain_groups(rows):
    bodies = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    best, size = {}, Counter(bodies)
    for i, ((doc_id, text), body) in enumerate(zip(rows, bodies, strict=True)):
        rank = (len(text or ""), doc_id is not None, -(doc_id or 0), -i)
        if body not in best or rank > best[body][0]:
            best[body] = (rank, i)
    return sorted(((d, rows[best[b][1]][0], size[b], best[b][1] == i, hashlib.sha256(b.encode()).hexdigest())
                   for i, ((d, _), b) in enumerate(zip(rows, bodies, strict=True))), key=repr)


def test_groups_of_a_table(spark, sf_dir):
    assert rows_of(queries.QUERIES["op6_radix_dedup"](spark, sf_dir)) == plain_groups(sample_texts(sf_dir))


@pytest.mark.parametrize("head,growth", [(64, 8), (1, 2), (3, 4)])
def test_groups_of_odd_rows(spark, head, growth):
    rng = random.Random(head)
    rows = [*ODD, *((100 + i, "".join(rng.choices("ab é\n", k=rng.randint(0, 9)))) for i in range(150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(radix_dedup.exact_groups(docs, head, growth)) == plain_groups(rows)


def test_groups_carry_rows(spark):
    kept = radix_dedup.exact_groups(odd_docs(spark), carry=True).where("kept").select("whole.*")
    assert kept.columns == odd_docs(spark).columns
    assert kept.count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ODD})
    assert radix_dedup.exact_groups(no_docs(spark)).collect() == []


# Line chunks

def test_chunks_of_repeated_blocks(spark):
    """A block of lines that several texts share goes from all but the first, edits around it or not."""
    rng = random.Random(4)
    line = lambda: " ".join(rng.choices(["red", "oak", "sun", "map", "tin"], k=6))
    block = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(i)] + block + [line() for _ in range(5)])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_chunks.dedup_lines(docs).collect()}
    for i, text in rows:
        lines = text.split("\n")
        assert got[i].n_lines == len(lines)
        assert len(got[i].text.split("\n")) == len(lines) - got[i].n_removed_lines or not got[i].text
    assert got[0].text == rows[0][1] and got[0].n_removed_chunks == 0
    # Only chunks that touch the block's ends can stay, and most of the block goes.
    assert all(got[i].n_removed_lines >= 25 for i in range(1, 8))


def plain_chunks(spark, docs):
    """Remaining texts by dictionaries over the operator's own boundaries."""
    base = line_chunks._with_chunks(docs, line_chunks.WINDOW, line_chunks.MEAN).collect()
    chunks = [(r.doc_id, r.key, r.ord, [(s.lines, "\n".join(r.lines[s.start : s.start + s.lines])) for s in r.spans]) for r in base]
    chunks.sort(key=lambda c: (c[0] is not None, c[0] or 0, c[1], c[2]))
    seen, out = set(), []
    for doc_id, _, _, pieces in chunks:
        kept = []
        for n, piece in pieces:
            if n < line_chunks.LEAST or piece not in seen:
                kept.append(piece)
            if n >= line_chunks.LEAST:
                seen.add(piece)
        out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=repr)


def test_chunks_against_dictionaries(spark, sf_dir):
    from cinderlog.llm.common import id_and_text

    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs(spark)):
        got = line_chunks.dedup_lines(docs).select("doc_id", "text")
        assert rows_of(got) == plain_chunks(spark, id_and_text(docs))
    assert line_chunks.dedup_lines(no_docs(spark)).collect() == []
    assert queries.QUERIES["op5_line_chunks"](spark, sf_dir).count() == len(sample_texts(sf_dir))


def plain_passages(rows):
    """(doc_id, kept text) where lines of any pair of neighbours seen before, in order of rows, are gone."""
    seen, out = set(), []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        gone = set()
        for i, pair in enumerate(itertools.pairwise(lines)):
            if pair in seen:
                gone |= {i, i + 1}
            seen.add(pair)
        out.append((doc_id, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return sorted(out, key=repr)


def test_passages_go_whole(spark):
    """Passages of 2 to 10 lines that two otherwise different texts share: all of them go, at any place."""
    rng = random.Random(8)
    line = lambda: " ".join(rng.choices([f"w{i}" for i in range(500)], k=8))
    rows, lost = [], {}
    for n in range(2, 11):
        for k in range(12):
            passage = [line() for _ in range(n)]
            for place in range(2):
                edges = [[line() for _ in range(rng.choice([0, 1, 4]))] for _ in range(2)]
                rows.append((len(rows), "\n".join(edges[0] + passage + edges[1])))
            lost[rows[-1][0]] = n
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_chunks.dedup_passages(docs).collect()
    assert {r.doc_id: r.n_removed_lines for r in got if r.n_removed_lines} == lost
    assert {r.n_removed_chunks for r in got} == {0, 1}
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == plain_passages(rows)


def test_passages_against_plain_pairs(spark, sf_dir):
    rng = random.Random(3)
    mixed = [(i, "\n".join(rng.choices(["a", "b", "", "c d", "é"], k=rng.randint(0, 12)))) for i in range(120)]
    for rows in (sample_texts(sf_dir), mixed, [x for x in ODD if x[0] is not None]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = line_chunks.dedup_passages(docs).collect()
        assert sorted(((r.doc_id, r.text) for r in got), key=repr) == plain_passages(rows)
        assert all(r.n_lines - r.n_removed_lines == (r.text.count("\n") + 1 if r.n_chunks > r.n_removed_chunks else 0) for r in got)
    assert line_chunks.dedup_passages(odd_docs(spark)).count() == len(ODD)
    assert line_chunks.dedup_passages(no_docs(spark)).collect() == []


# Benchmark search

def plain_leaks(rows, items, window=spaced_seeds.WINDOW, share=spaced_seeds.SHARE):
    """Every document at every shift against every item."""
    out = {}
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        found = []
        for item_id, item in items:
            own = (item or "").encode().lower().split()
            size = min(window, len(own))
            for shift in range(-len(own) + size, len(words) - size + 1) if own else ():
                a, b = max(shift, 0), min(shift + len(own), len(words))
                same = [words[k] == own[k - shift] for k in range(a, b)]
                if any(sum(same[k : k + size]) >= share * size for k in range(len(same) - size + 1)):
                    found.append(item_id)
                    break
        out[doc_id] = sorted(found)
    return out


def test_leaks_of_a_table(spark, sf_dir):
    import duckdb

    items = duckdb.sql(f"SELECT item_id, text FROM '{sf_dir}/benchmark.parquet'").fetchall()
    rows = sample_texts(sf_dir)
    whole = {d: sorted(i for i, t in items if t in text) for d, text in rows}
    got = {r.doc_id: r for r in queries.QUERIES["op7_spaced_seeds"](spark, sf_dir).collect()}
    assert {d: r.contaminated for d, r in got.items()} == {d: bool(w) for d, w in whole.items()}
    assert all(set(whole[d]) <= set(got[d].item_ids) for d in got)
    some = rows[::5]
    assert {d: got[d].item_ids for d, _ in some} == plain_leaks(some, items)


def test_leaks_with_substitutions(spark):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([20, 30, 40, 13, 5, 1, 9, 25])] + [(50, None), (None, "x y z"), (51, "")]
    rows = []
    for i in range(60):
        own = items[i % 8][1].split()
        for at in rng.sample(range(len(own)), len(own) // 13):
            own[at] = "changed"
        rows.append((i, " ".join(rng.choices(words, k=30) + own + rng.choices(words, k=30)).title()))
    rows += [(100, ""), (101, None), (102, " ".join(rng.choices(words, k=400)))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = plain_leaks(rows, [x for x in items if None not in x])
    for most in (20_000, 3):
        got = {r.doc_id: r.item_ids for r in spaced_seeds.find_leaks(docs, bench, block_items=most).collect()}
        assert got == want
    assert sum(bool(v) for v in want.values()) > 50
    clean = spaced_seeds.find_leaks(odd_docs(spark), bench.limit(0)).collect()
    assert len(clean) == len(ODD) and not any(r.contaminated for r in clean)
    assert spaced_seeds.find_leaks(no_docs(spark), bench).collect() == []


def test_leaks_of_all_placings(spark):
    """Every way to put the allowed substitutions into a stretch of each size, and every fifth word of a long passage."""
    rng = random.Random(12)
    words = [f"u{i}" for i in range(5000)]
    items = [(n, " ".join(rng.sample(words, n))) for n in [*range(1, 14), 40]]
    texts = []
    for n, item in items:
        own = item.split()[-13:]
        wrong = max(k for k in range(3) if len(own) - k >= spaced_seeds.SHARE * len(own))
        for placing in itertools.combinations(range(len(own)), wrong):
            changed = [f"other{i}" if i in placing else w for i, w in enumerate(own)]
            texts.append(" ".join(["before"] * 3 + changed + ["behind"] * 3))
    for first in range(5):
        texts.append(" ".join(f"other{i}" if i % 5 == first else w for i, w in enumerate(items[-1][1].split())))
    rows = list(enumerate(texts))
    assert len(rows) == 4 + sum([5, 6, 7, 8, 9, 45, 55, 66, 78, 78]) + 5
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in spaced_seeds.find_leaks(docs, bench).collect()}
    assert got == plain_leaks(rows, items)
    assert all(got.values())


@pytest.mark.parametrize("window,share", [(13, 0.7), (8, 0.5), (20, 0.8)])
def test_masks_of_other_limits(window, share):
    for size in range(1, window + 1):
        wrong = spaced_seeds.misses(size, share)
        assert size - wrong >= share * size > size - wrong - 1
        masks = [{p + by for p in m} for m in spaced_seeds.masks_for(size, wrong) for by in range(size - m[-1])]
        assert all(any(m.isdisjoint(p) for m in masks) for p in itertools.combinations(range(size), wrong))


# Toxicity

def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    texts = [b"one two three four", b"bad word here", b"", b"a b c " * 30]
    words = toxicity.read_words(*toxicity._flat(texts))
    net = {k: v.astype(np.float64) + rng.normal(0, 0.05, v.shape) for k, v in toxicity.fresh().items()}
    lane, at = toxicity.windows_of(words)
    own, wanted = np.linspace(0, len(lane) - 1, 6).astype(int), np.array([0.0, 1.0, 0.0, 1.0, 1.0, 0.0])
    chosen, place = lane[own], at[own]

    def loss():
        logits = toxicity.window_logits(net, words)[0][own]
        return np.mean(np.log1p(np.exp(logits)) - wanted * logits)

    slope = toxicity.gradients(net, words, chosen, place, wanted)
    for name, g in slope.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = net[name][at]
        net[name][at] = before + 1e-3
        up = loss()
        net[name][at] = before - 1e-3
        down = loss()
        net[name][at] = before
        assert (up - down) / 2e-3 == pytest.approx(g[at], rel=1e-2, abs=1e-5), name


def test_every_window_is_there(monkeypatch):
    texts = [" ".join(f"w{i}!" for i in range(n)).encode() for n in (100, 0, 1, 31, 32, 33, 63, 64, 65, 96)] + [b" \n"]
    words = toxicity.read_words(*toxicity._flat(texts))
    lane, at = toxicity.windows_of(words)
    seen = defaultdict(list)
    for i, o in zip(lane, at, strict=True):
        seen[int(words.owner[i])].append(tuple(words.lanes[i, o : o + 32]))
    sizes = [100, 0, 1, 31, 32, 33, 63, 64, 65, 96, 0]
    assert [len(seen[i]) for i in range(11)] == [max(1, n - 31) for n in sizes]
    assert all(len(set(w)) == len(w) for i, w in seen.items())
    monkeypatch.setattr(toxicity, "READ", 150)
    lots = toxicity.read_texts(texts)
    assert lots.owner.tolist() == words.owner.tolist() and lots.starts.tolist() == words.starts.tolist()
    assert (lots.letters[lots.lanes] == words.letters[words.lanes]).all() and (lots.buckets[lots.lanes] == words.buckets[words.lanes]).all()


def plain_score(model, text):
    """Word by word and window by window in plain loops; words here have at most twelve bytes and no marks."""
    net, said = model.net, text.lower().split()
    tokens = [w for i, w in enumerate(said) if i == 0 or w != said[i - 1]]

    def vector(word):
        raw = word.encode()
        data = np.frombuffer(raw, np.uint8)
        hashed = toxicity.hashing.stretch(toxicity.hashing.running(data), np.array([0]), np.array([len(data)]))[0]
        shape = net["letter_bias"].astype(np.float64)
        places = [raw[i] if i < len(raw) else None for i in range(8)] + [raw[len(raw) - 4 + i] if len(raw) - 4 + i >= 0 else None for i in range(4)]
        for i, byte in enumerate(places):
            shape = shape + net["letter"][i * 257 + (0 if byte is None else byte + 1)]
        return np.concatenate([net["word"][int(hashed) >> (64 - toxicity.BUCKET_BITS)], np.tanh(shape)])

    def states(way, vectors):
        state, out = np.zeros(8), []
        for x in vectors if way == "ahead" else vectors[::-1]:
            own, past = x @ net[f"{way}_in"] + net[f"{way}_bias"], state @ net[f"{way}_state"]
            z, r = (1 / (1 + np.exp(-(own[a:b] + past[a:b]))) for a, b in ((0, 8), (8, 16)))
            state = state + z * (np.tanh(own[16:] + r * past[16:]) - state)
            out.append(state)
        return out if way == "ahead" else out[::-1]

    logits = []
    for begin in range(max(1, len(tokens) - 31)):
        lane = begin // 32 * 32
        vectors = [vector(w) for w in tokens[lane : lane + 64]]
        both = [np.concatenate(x) for x in zip(states("ahead", vectors), states("back", vectors), strict=True)]
        both = both[begin - lane : begin - lane + 32]
        energy = np.array([np.tanh(b @ net["attend"] + net["attend_bias"]) @ net["focus"] for b in both])
        weight = np.exp(energy - energy.max()) if both else energy
        pool = sum(w * b for w, b in zip(weight, both, strict=True)) / weight.sum() if both else np.zeros(16)
        logits.append(pool @ net["out"] + net["out_bias"][0])
    chance = [1 / (1 + np.exp(-x)) for x in logits]
    top = sorted(logits, reverse=True)[:3]
    top += top[-1:] * (3 - len(top))
    x = np.array([top[0], np.mean(top), np.log1p(sum(chance)), sum(chance) / len(chance), np.log(len(chance))])
    return 1 / (1 + np.exp(-(np.append((x - model.mean) / model.scale, 1) @ model.weights)))


def test_scores_against_plain_loops(spark, insults):
    rng = random.Random(8)
    docs = spark.createDataFrame(insults, "doc_id long, text string, toxic int")
    model = toxicity.trained(toxicity.id_and_text(docs), docs, steps=60)
    texts = ["", "solo", "same same same"] + [t for _, t, _ in insults[:12]] + [" ".join(rng.choices("ab cé dog Nasty dreadful".split(), k=k)) for k in (33, 64, 90, 300)]
    got = toxicity.score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), docs.limit(0)).collect()
    assert len(got) == len(texts)
    scored = model.scores(toxicity.read_words(*toxicity._flat([t.encode() for t in texts])), len(texts))
    assert scored == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)
    # The query's rows are these scores, rounded.
    rows = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, docs, steps=60).collect()}
    for i, text, _ in insults[:8]:
        assert rows[i] == pytest.approx(plain_score(model, text), abs=2e-4)


def test_every_byte_of_long_words_is_read():
    rng = random.Random(6)
    texts = ["".join(rng.choices("日本語で書かれた文章", k=k)) for k in (4, 5, 60)] + [
        "one/two,three;four", "x" * 12 + "middle" + "y" * 12, "-" * 40, "ab" * 40, "short words, only", "", "averylongword" * 9 + "."]
    for text in texts:
        data, rows = toxicity._flat([text.encode()])
        first = np.flatnonzero(~toxicity.hashing.IS_BLANK[data] & np.append(True, toxicity.hashing.IS_BLANK[data[:-1]])) if len(data) else np.zeros(0, int)
        last = first + [len(w) for w in text.encode().split()] if len(data) else first
        start, end = toxicity.pieces(data, first.astype(np.int64), np.array(last, np.int64))
        assert all(b - a <= toxicity.HEAD + toxicity.TAIL for a, b in zip(start, end, strict=True))
        read = {i for a, b in zip(start, end, strict=True) for i in range(a, b)}
        words = {i for a, b in zip(first, last, strict=True) for i in range(a, b)}
        assert {i for i in words - read if not toxicity.IS_MARK[data[i]]} == set()
    for middle in ("文", "語"):
        text = ("日本語で書かれた" * 3 + middle + "日本語で書かれた" * 3).encode()
        other = text.replace(middle.encode(), "章".encode())
        letters = [toxicity.read_words(*toxicity._flat([x])) for x in (text, other)]
        assert letters[0].letters.tolist() != letters[1].letters.tolist()
        assert len(letters[0].letters) > 2


@pytest.fixture(scope="module")
def insults():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    out = []
    for i in range(240):
        text, toxic = rng.choices(words, k=rng.randint(20, 160)), int(i % 4 == 0)
        if toxic:
            for _ in range(max(2, len(text) // 12)):
                text[rng.randrange(len(text))] = rng.choice(["dreadful", "nasty", f"grim{rng.randint(0, 999)}"])
        out.append((i, " ".join(text), toxic))
    return out


def test_scores_find_toxic_texts(spark, insults):
    docs = spark.createDataFrame(insults, "doc_id long, text string, toxic int")
    out = toxicity.score_toxicity(docs, docs, steps=250).collect()
    label = {i: t for i, _, t in insults}
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.9 * len(held) > 20
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    # Labels of held-out rows change nothing.
    other = spark.createDataFrame([(i, x, 1 - t if toxicity.is_held_out(i) else t) for i, x, t in insults], "doc_id long, text string, toxic int")
    assert rows_of(toxicity.score_toxicity(docs, other, steps=250)) == sorted((tuple(r) for r in out), key=repr)


def test_scores_of_odd_rows(spark, insults):
    labels = spark.createDataFrame([(i, t) for i, _, t in insults] + [(None, 1), (5, None), (1, 0), (1, 1)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(odd_docs(spark), labels, steps=5, carry=True).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    by_text = defaultdict(set)
    for r in out:
        by_text[r.whole.text or ""].add(r.score)
    assert all(max(s) - min(s) < 1e-4 for s in by_text.values())
    assert all(r.held_out for r in out if r.doc_id is None)
    none = toxicity.score_toxicity(odd_docs(spark), labels.limit(0)).collect()
    assert len(none) == len(ODD)
    assert toxicity.score_toxicity(no_docs(spark), labels.limit(0)).collect() == []


# Pipeline

def test_pipeline_stages(spark, sf_dir):
    """Each stage keeps just the rows its operator's decisions allow, and all columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]
    clean = stages["toxicity"](spark, docs, sf_dir)
    scored = queries.QUERIES["op1_toxicity"](spark, sf_dir).where("predicted = 0")
    clean = corpus_pipeline.settle(clean, "test")
    assert clean.columns == columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in scored.collect())
    kept = corpus_pipeline.settle(stages["exact dedup"](spark, clean, sf_dir), "test")
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in plain_groups(rows) if g[3])
    from test_joins import all_pairs

    apart = corpus_pipeline.settle(stages["n-gram Jaccard join"](spark, kept, sf_dir), "test")
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, n, c in all_pairs(rows) if n} | {d for d, n, _ in all_pairs(rows) if not n})
    safe = corpus_pipeline.settle(stages["benchmark decontamination"](spark, apart, sf_dir), "test")
    import duckdb

    items = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    assert sorted(r.doc_id for r in safe.collect()) == sorted(r.doc_id for r in apart.collect() if not any(t in r.text for t in items))
    assert safe.columns == columns and dict(safe.dtypes) == dict(docs.dtypes)
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in final) == sorted(r.doc_id for r in safe.collect())


def test_stages_take_odd_rows(spark, sf_dir):
    docs = corpus_pipeline.settle(odd_docs(spark).withColumnRenamed("score", "whole"), "odd")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.settle(stage(spark, docs, sf_dir), "odd")
        assert docs.columns == ["doc_id", "text", "key", "ord", "block", "whole"]
        assert docs.count() > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs(spark), sf_dir).collect() == []
