"""Jaccard join, fingerprints, sharding, pipeline: brute force and awkward rows."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_tables import docs, empty, odd  # noqa: F401

from mailsift.llm import fingerprints, jaccard_join, queries, sharding
from mailsift.llm.components import components

SF001 = "/root/testdata/sf0.001"


def word_shingles(text):
    words = (text or "").encode().split()
    if not words:
        return set()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))}


def brute_classes(rows, threshold=0.8):
    """{(id, text): (class id, links, copies)}"""
    texts = sorted({t or "" for _, t in rows})
    ids, copies = defaultdict(list), Counter()
    for i, t in rows:
        ids[t or ""].append(i)
        copies[t or ""] += 1
    sets = {t: word_shingles(t) for t in texts}
    root, links = {t: t for t in texts}, Counter()

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    classes = defaultdict(list)
    for t in texts:
        classes[find(t)] += [i for i in ids[t] if i is not None]
    return {(i, t or ""): (min(classes[find(t or "")], default=None), links[t or ""], copies[t or ""]) for i, t in rows}


def near_copies(n, seed, words=60):
    """Texts of one group: each changes a few words of the same base."""
    rnd = random.Random(seed)
    base = [f"w{rnd.randint(0, 5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rnd.randint(0, 3)):
            t[rnd.randrange(words)] = f"x{rnd.randint(0, 9999)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("block", [256, 8])
def test_join_matches_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", block)
    extra = [t for s in range(3) for t in near_copies(25, s)] + ["same text here"] * 40 + ["a b", "a  b", "c"]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(100000 + i, t) for i, t in enumerate(extra)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute_classes(rows)
    texts = dict(rows)
    got = {(r.doc_id, texts[r.doc_id]): (r.class_id, r.n_links, r.copies) for r in jaccard_join.jaccard_join(df).collect()}
    assert got == want


def test_join_of_awkward_tables(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = brute_classes(rows)
    got = jaccard_join.jaccard_join(odd).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links, r.copies) for r in got) == Counter((i, *want[i, t or ""]) for i, t in rows)
    assert jaccard_join.jaccard_join(empty).collect() == []


def test_one_row_of_each_class_stays(spark, odd, empty):
    kept = jaccard_join.keep_first(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    classes = Counter(r.text or "" for r in rows)
    assert max(classes.values()) == 1
    assert {r.doc_id for r in rows if r.text and r.text.startswith("The cat")} == {1}
    assert jaccard_join.keep_first(empty).collect() == []


def test_pruning_loses_no_link_in_a_large_group():
    texts = near_copies(300, 9)
    make = jaccard_join.shingler()
    sets = [make(t) for t in texts]
    sigs = np.stack([np.frombuffer(jaccard_join.signature(s), np.uint16) for s in sets])
    i, j = jaccard_join.linked(sets, sigs, sets, sigs, True)
    want = {(a, b) for a, b in itertools.combinations(range(300), 2)
            if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b])) - 1e-9}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) > jaccard_join.MANY_PAIRS


def test_posterior_table():
    rounds = jaccard_join.least_matches(0.8, 1e-6)
    assert [n for n, _ in rounds] == list(range(jaccard_join.ROUND, jaccard_join.VALUES + 1, jaccard_join.ROUND))
    # by the Beta density itself
    for n, m in rounds[:4]:
        grid = (np.arange(200000) + 0.5) / 200000
        for k, above in ((m, True), (m - 1, False)):
            if k >= 0:
                density = grid ** k * (1 - grid) ** (n - k)
                assert (density[grid >= 0.8].sum() / density.sum() >= 1e-6) == above


def test_components(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)]
    edges += [(5000, i) for i in range(5001, 5500)]
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_edited_texts_and_likeness(spark, docs):
    rows = {r.doc_id: r for r in queries.op6_order_minhash(spark, SF001).collect()}
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = {}
    for n, (i, t) in enumerate(texts):
        q = len(t) // 4
        edited = t[:len(t) - q] + texts[(n + 1) % len(texts)][1][:q]
        r = rows[i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
        parts = [[p[k:k + 4] for k in range(0, len(p), 4)] for p in (r.fingerprint, r.edited_fingerprint)]
        some = [(a, b) for a, b in zip(*parts, strict=True) if "----" not in (a, b) or a != b]
        assert r.near_edited == pytest.approx(sum(a == b for a, b in some) / len(some) if some else 1.0)
    long = [r for r in rows.values() if r.n_chars > 400]
    assert np.mean([r.near_edited > 0.2 for r in long]) > 0.98 and np.mean([r.near_next < 0.1 for r in long]) > 0.95


def test_fingerprint_selects_orders_and_numbers(spark):
    base = " ".join(f"w{i}" for i in range(200))
    texts = {"base": base, "space": base.replace(" ", "  \n"), "change": base.replace("w100 ", "zz "),
             "swapped": " ".join([*base.split()[100:], *base.split()[:100]]),
             "twice": base + " " + base, "reversed": " ".join(reversed(base.split())), "empty": "", "one": "word"}
    df = spark.createDataFrame([(k, v) for k, v in texts.items()], "k string, text string")
    f = {r.k: r.f for r in df.select("k", fingerprints.fingerprint("text").alias("f")).collect()}
    pairs = spark.createDataFrame([(k, f["base"], v) for k, v in f.items()], "k string, a string, b string")
    like = {r.k: r.n for r in pairs.select("k", fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    assert like["base"] == like["space"] == 1 and 0.85 < like["change"] < 1
    # the same words in another order have nearly the same bag of k-mers but other tuples where order was kept
    assert like["swapped"] < 0.9 and like["reversed"] < 0.1 and 0.1 < like["twice"] < 0.9
    assert set(f["empty"]) == {"-"} and f["one"].count("----") == fingerprints.BINS - 1


def test_fingerprints_of_awkward_tables(spark, odd, empty):
    rows = fingerprints.fingerprints(odd).collect()
    assert len(rows) == odd.count()
    assert fingerprints.fingerprints(empty).collect() == []
    alone = fingerprints.fingerprints(spark.createDataFrame([(5, "abcd efgh")], "doc_id bigint, text string")).collect()
    assert alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()


def test_next_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "SLICE_BYTES", 50)
    ids = random.Random(1).sample(range(-5000, 100000), 700)
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "k bigint, v string")
    order = sorted(ids)
    want = {a: f"text {b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}
    got = fingerprints.with_next(df, "k", ["v"]).select("k", F.col("__next_v").alias("nxt")).collect()
    assert {r.k: r.nxt for r in got} == want


def check_shards(rows, shards, spread):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / shards
    assert all(abs(sizes[k] - mean) <= spread for k in range(shards))


def test_shards(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op9_histogram_shards(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    largest = max(len(t.encode()) + 16 for t in texts.values())
    check_shards(rows, 40, largest + 0.01 * sum(r.size for r in rows) / 40)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 39


def test_a_hot_text_is_split(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot text', concat('text ', id)) as text")
    rows = sharding.shard(df, 10).selectExpr("doc_id", "shard_size as size", "shard", "shard_slot as slot").collect()
    check_shards(rows, 10, 0.012 * sum(r.size for r in rows) / 10 + 64)


def test_slots_follow_the_key_and_no_cell_is_hot(spark):
    """A third of the texts empty: cells stay small, and shards and slots are those of one plain sort."""
    df = spark.range(30000).selectExpr("id as doc_id", "if(id % 3 = 0, '', concat('some text ', id)) as text")
    rows = df.select(sharding.key_of("doc_id", "text").alias("key"), (F.length("text") + 16).cast("bigint").alias("size")).cache()
    cells = sharding.refine(rows, 1)
    parts = sharding.lighter(rows, cells, 1000)
    assert max(c.rows for c in cells) > 5000 and parts
    flat = [p for c in cells for p in parts.get(c.prefix, [c])]
    assert max(p.rows for p in flat) <= 1000 and len(flat) < 10_000
    assert [p.prefix for p in flat] == sorted(p.prefix for p in flat) and sum(p.rows for p in flat) == 30000
    key = {r.doc_id: r.key for r in df.select("doc_id", sharding.key_of("doc_id", "text").alias("key")).collect()}
    for shards in (1, 8):
        order = sorted(sharding.shard(df, shards).collect(), key=lambda r: key[r.doc_id])
        assert [r.shard for r in order] == sorted(r.shard for r in order)
        want, last = 0, -1
        for r in order:
            want = want + 1 if r.shard == last else 0
            last = r.shard
            assert r.shard_slot == want


def test_shards_with_clashing_columns(spark):
    df = spark.createDataFrame([(i, f"t{i % 4}", i, i, i) for i in range(9)],
                               "doc_id bigint, text string, shard_key int, `shard_cell` int, __at int")
    found = sharding.shard(df, 2)
    assert found.columns == [*df.columns, "shard_size", "shard", "shard_slot"]
    assert sorted(tuple(r)[:5] for r in found.collect()) == sorted(tuple(r) for r in df.collect())


def test_shards_of_awkward_tables(spark, odd, empty, tmp_path):
    found = sharding.shard(odd, 3)
    rows = found.collect()
    assert found.columns == [*odd.columns, "shard_size", "shard", "shard_slot"] and len(rows) == odd.count()
    check_shards([r for r in found.selectExpr("shard_size as size", "shard", "shard_slot as slot").collect()], 3, 1e9)
    assert sharding.shard(empty).collect() == []
    with pytest.raises(ValueError):
        sharding.shard(odd.withColumn("shard", F.lit(1)))
    sharding.write_shards(found, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == odd.count()


def test_borders_by_hand():
    cells = [sharding.Cell(p, s, 1) for p, s in (("0", 10), ("1", 30), ("2", 5), ("3", 15))]
    assert sharding.borders(cells, 2)[0] == [2]
    assert sharding.borders(cells, 4)[0] == [1, 2, 3]
    assert sharding.borders([], 1)[0] == []
