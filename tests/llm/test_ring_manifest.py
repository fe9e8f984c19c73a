"""The hash ring and the manifest against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from helpers import ODD, no_docs, odd_docs, sample_texts

from cinderlog.llm import hash_ring, merkle, queries


def chained(*values):
    """Spark's xxhash64 of integers: each value's hash seeds the next, NULL changes nothing."""
    seed = 42
    for value, width in values:
        if value is not None:
            seed = xxhash.xxh64_intdigest((value % (1 << 8 * width)).to_bytes(width, "little"), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def plain_shards(rows, shards, nodes, points):
    """Row by row: home first, then the overflow in one queue clockwise. Multiset of (id, size, crc, home, shard)."""
    stand = {}
    for s in range(shards):
        for v in range(nodes):
            at = chained((s, 4), (v, 4)) % points
            stand[at] = min(s, stand.get(at, s))
    copies = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    at_point = defaultdict(list)
    for (i, size, crc), n in copies.items():
        for lot in range(-(-n // hash_ring.LOT)):
            own = min(hash_ring.LOT, n - lot * hash_ring.LOT)
            at_point[chained((i, 8), (size, 8), (crc, 8), (lot, 8)) % points] += [(i, size, crc, lot)] * own
    total = len(rows)
    free = [total // shards + (s < total % shards) for s in range(shards)]
    where, queues = [], {}
    wrap = stand[min(stand)]
    for p in range(points):
        home = stand.get(p) if p in stand else next((stand[q] for q in range(p, points) if q in stand), wrap) if at_point[p] else None
        for row in sorted(at_point[p], key=lambda r: (r[0] is not None, r)):
            if free[home]:
                free[home] -= 1
                where.append((*row[:3], home, home))
            else:
                queues.setdefault(p, []).append((*row[:3], home))
    line = []
    for lap in range(2):
        for p in range(points):
            line += queues.pop(p, [])
            while p in stand and line and free[stand[p]]:
                free[stand[p]] -= 1
                where.append((*line.pop(0), stand[p]))
    assert not line
    return Counter(where)


@pytest.mark.parametrize("shards,nodes,points", [(24, 128, 1 << 16), (5, 3, 64), (1, 1, 4)])
def test_ring_against_a_walk_row_by_row(spark, sf_dir, shards, nodes, points):
    rows = sample_texts(sf_dir) + ODD
    docs = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame(sample_texts(sf_dir), "doc_id long, text string"))
    got = hash_ring.shard_rows(docs, shards, nodes, points).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.home, r.shard) for r in got) == plain_shards(rows, shards, nodes, points)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_ring_spreads_one_row_that_fills_the_table(spark):
    rows = [(7, "same")] * 9000 + [(i, str(i)) for i in range(300)]
    got = hash_ring.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), 6, 8, 256).collect()
    assert sorted(Counter(r.shard for r in got).values()) == [1550] * 6
    assert len({(r.shard, r.slot) for r in got}) == 9300


def test_ring_moves_few_rows_when_some_come(spark):
    rows = [(i, f"text {i}") for i in range(4000)]
    place = lambda n: {r.doc_id: r.shard for r in hash_ring.shard_rows(
        spark.createDataFrame(rows[:n], "doc_id long, text string")).collect()}
    few, many = place(3900), place(4000)
    assert sum(few[i] != many[i] for i in few) < 0.2 * len(few)


def test_ring_edges(spark):
    assert hash_ring.shard_rows(no_docs(spark)).count() == 0
    one = hash_ring.shard_rows(spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()
    assert [(r["size"], r.text_crc32, r.shard, r.slot, r.law, r.grown_shard) for r in one] == [(8, 0, 0, 0, "rows", None)]
    with pytest.raises(ValueError):
        hash_ring.shard_rows(no_docs(spark), 100, 1000)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_manifest(rows):
    """Recursive trees and a fold per leaf."""
    lower = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    leaf = lambda r, t: H(*map(field, [r[0], r[3], r[2], r[4], t]))
    groups = defaultdict(list)
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups[r[2]].append((r[0], leaf(r, r[1]), leaf(r, lower(r[1])) if hit else leaf(r, r[1])))

    def tree(nodes):
        """The root, and each node's steps of (left, right)."""
        steps, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(at):
                lo = p - p % 8
                steps[k].append(("".join(nodes[lo:p]), "".join(nodes[p + 1 : lo + 8])))
            nodes, at = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], steps

    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in langs:
        groups[g].sort(key=lambda x: (x[0] is not None, x))
        made[g] = tree([x[1] for x in groups[g]])
    root, upper = tree([made[g][0] for g in langs])
    out = []
    for g, up in zip(langs, upper, strict=True):
        subroot, steps = made[g]
        for (doc_id, own, changed), path in zip(groups[g], steps, strict=True):
            folded = changed
            for left, right in path + up:
                folded = H(left, folded, right)
            proof = H(*[x for step in path + up for x in step])
            out.append((doc_id, own, subroot, root, proof, folded, folded == root))
    return sorted(out, key=repr)


def manifest_rows(df):
    return sorted((tuple(r) for r in df.drop("lang").collect()), key=repr)


DDL = "doc_id long, text string, lang string, source string, n_chars long, slot int, parent string"


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 600])
def test_manifest_against_plain_trees(spark, size):
    rng = random.Random(size)
    langs = [None, "", "a", "B", "é", "\U0001F600", *map(str, range(5))]
    rows = [
        (rng.choice([i, i, None, 3]), rng.choice([None, "", f"Text {i % 7} ÄB"]), rng.choice(langs[: 1 + size // 3]),
         rng.choice([None, "s", "S:"]), rng.choice([None, 5, -1]), 1, "x") for i in range(size)
    ]
    assert manifest_rows(merkle.manifest(spark.createDataFrame(rows, DDL))) == plain_manifest(rows)


def test_manifest_of_one_group_of_equal_rows(spark):
    rows = [(5, "Aa", "en", "s", 2, 1, "x")] * 300
    got = manifest_rows(merkle.manifest(spark.createDataFrame(rows, DDL)))
    assert got == plain_manifest(rows)


def test_manifest_edges(spark):
    assert merkle.manifest(spark.createDataFrame([], DDL)).count() == 0
    one = merkle.manifest(spark.createDataFrame([(None, None, None, None, None, 1, "x")], DDL)).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root == H("-----") and one.proof_sha256 == H("")


def test_queries(spark, sf_dir):
    out = queries.QUERIES["op11_hash_ring"](spark, sf_dir)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    texts = dict(sample_texts(sf_dir))
    for r in out.collect():
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
    got = queries.QUERIES["op12_merkle_manifest"](spark, sf_dir).collect()
    assert {r.verified for r in got} == {True, False} and len({r.root for r in got}) == 1
