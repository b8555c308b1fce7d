"""Near-duplicates, components and lines against brute force."""

import random

import numpy as np
import pytest
import xxhash
from helpers import agree, rows
from pyspark.sql import functions as F

from framewalk.llm import line_dedup, registry, simhash
from framewalk.llm.common import Workspace, release, shared_dir
from framewalk.llm.components import connected_components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, fp string, component_id int"


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("links", [[(k, k + 1) for k in range(300)], [(0, k) for k in range(1, 200)], [(9, 9)], [(-5, 3), (3, -5), (7, 3), (100, 101)], []])
def test_components(spark, links):
    made = connected_components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "test"))
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert {(r["node"], r["root"]) for r in made.collect()} == {(n, r) for n, r in roots(ids, [x for x in links if x[0] != x[1]]).items() if n != r}


def test_random_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    made = connected_components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "test"))
    ids = {x for a, b in links if a != b for x in (a, b)}
    assert {(r["node"], r["root"]) for r in made.collect()} == {(n, r) for n, r in roots(ids, [x for x in links if x[0] != x[1]]).items() if n != r}


def slow_fingerprint(text, n=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").replace("\t", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join(rng.choice(["a", "B", "été", "x\tY", "ı", "Straße", "z\n"]) for _ in range(rng.randrange(12)))
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    long = " ".join(str(rng.randrange(50)) for _ in range(3 * simhash.BLOCK))
    assert simhash.fingerprint(long) == slow_fingerprint(long)


def test_tile_links():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    a = np.unique(np.concatenate([base, *(base ^ np.uint64(1 << k) for k in range(0, 60, 7)), base ^ np.uint64(0b11111)]))
    for x, y in ((a, a), (a[:200], a[200:])):
        u, v = simhash.tile_links(x, y, 4)
        every = [(int(p), int(q)) for p in x for q in y if int(p ^ q).bit_count() <= 4]
        ids = {int(p) for p in np.concatenate([x, y])}
        assert roots(ids, every) == roots(ids, list(zip(u.tolist(), v.tolist())))
        assert len(u) < len(ids)


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_near_duplicates(spark, tile):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for _ in range(25):
        t = [rng.choice(words) for _ in range(120)]
        texts.append(" ".join(t))
        for _ in range(3):
            t[rng.randrange(120)] = rng.choice(words)
            texts.append(" ".join(t))
    texts += [None, "", " \n", "one", "One", "one two three", texts[0], texts[0]]
    data = [(k, t, "clash", 5) for k, t in enumerate(texts)] + [(0, texts[0], "clash", 5), (None, texts[5], "clash", 5), (None, "alone and without a number", "clash", 5)]
    made = simhash.near_duplicates(spark.createDataFrame(data, SCHEMA), tile=tile).collect()
    assert len(made) == len(data)
    fps = [slow_fingerprint(t) for _, t, *_ in data]
    links = [(i, j) for i in range(len(data)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    group = roots(range(len(data)), links)
    least = {}
    for k, (d, *_) in enumerate(data):
        if d is not None:
            least[group[k]] = min(least.get(group[k], d), d)
    wanted = sorted(((d, fps[k], least.get(group[k])) for k, (d, *_) in enumerate(data)), key=repr)
    assert sorted(((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"]) for r in made), key=repr) == wanted


def test_keep_one(spark):
    data = [(3, "same text here", "x", 1), (1, "same text here", "y", 2), (2, "another one entirely different", "z", 3), (None, "same text here", "n", 4)]
    docs = spark.createDataFrame(data, SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert simhash.near_duplicates(docs).count() == 0
    assert line_dedup.dedup_lines(docs).count() == 0


def plain_dedup(data, least):
    def norm(x):
        return " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in x).split())

    seen = {}
    for d, t, s, *_ in data:
        for x in (t or "").split("\n"):
            if norm(x) and s is not None:
                seen.setdefault(norm(x), set()).add(s)
    wide = {x for x, s in seen.items() if len(s) >= least}
    order = sorted((d, t) for d, t, *_ in data if d is not None)
    out, first = {}, set()
    for d, t in order:
        kept = []
        for x in (t or "").split("\n"):
            if norm(x) in wide:
                if norm(x) in first:
                    continue
                first.add(norm(x))
            kept.append(x)
        out[d] = t if t is None else "\n".join(kept)
    return out


def test_dedup_lines(spark):
    rng = random.Random(3)
    lines = [f"Line  number {k}" for k in range(30)] + ["", "  "]
    data = [(k, "\n".join(rng.choice(lines[: rng.choice([6, 32])]).replace("L", rng.choice("lL")) for _ in range(rng.randrange(9))), f"s{rng.randrange(9)}", "k", 1) for k in range(120)]
    data += [(120, None, "s1", "k", 1), (121, "", None, "k", 1), (122, "Line number 3\nown line", None, "k", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, key string, gone int")  # names that the operator uses itself
    for least in (3, 8):
        made = line_dedup.dedup_lines(docs, min_sites=least)
        assert made.columns == docs.columns
        assert {r["doc_id"]: r["text"] for r in made.collect()} == plain_dedup(data, least)


def test_spread_is_exact_near_the_threshold(spark):
    data = [(h, f"site{s}") for h in range(40) for s in range(h)]
    lines = spark.createDataFrame(data, "h long, site string")
    assert {r["h"] for r in line_dedup.spread_lines(lines, 20, Workspace(spark, "test")).collect()} == set(range(20, 40))


def test_lines_are_sketched_where_they_are_read(spark, monkeypatch):
    """No distinct of all lines: the sketches are made before the shuffle, and only lines near the threshold are compared exactly."""
    plans = []
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, frame, name: (plans.append((name, frame._jdf.queryExecution().executedPlan().toString())), keep(self, frame, name))[1])
    data = [(k, f"line {k % 40}\nother {k}", f"s{k % 25}") for k in range(200)]
    line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string, source string")).count()
    plan = dict(plans)["estimated"]
    above, below = plan.split("Exchange hashpartitioning")  # one shuffle, of sketches
    assert "partial_hll_sketch_agg" in below and "keys=[h#" in below


def test_null_ids_and_repeats(spark):
    text = "boiler plate\nrest"
    data = [(None, text, f"s{k}") for k in range(5)] + [(1, text, "s0"), (1, text, "s9"), (1, "boiler plate\nother", "s9")]
    made = line_dedup.dedup_lines(spark.createDataFrame(data, "doc_id long, text string, source string"), min_sites=3).collect()
    assert len(made) == len(data)
    assert sorted(r["text"] for r in made if r["doc_id"] == 1) == ["", "", "other"]
    assert {r["text"] for r in made if r["doc_id"] is None} == {text}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, duck, name):
    agree(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], duck)


def test_op3_columns(spark):
    made = registry.QUERIES["op3_simhash"](spark, SF)
    assert made.columns == ["doc_id", "fingerprint", "component_id"]
    assert made.where(~F.col("fingerprint").rlike("^[0-9a-f]{16}$")).count() == 0
    assert len(rows(made)) == 200


def test_tables_are_dropped(spark):
    """What nothing reads any more is dropped at once, the rest by release()."""
    import os

    docs = spark.createDataFrame([(k, f"some text {k % 3} of words", f"s{k}") for k in range(30)], "doc_id long, text string, source string")
    mine = Workspace(spark, "mine")
    mine.keep(docs, "docs")
    made = simhash.near_duplicates(docs)
    folder = Workspace.made[-1].path.removeprefix("file://").removeprefix("file:")
    assert made.count() == 30 and set(os.listdir(folder)) & {"tiles", "distinct", "links0", "stars"} == set()
    release(mine)
    assert not os.path.exists(folder) and mine in Workspace.made
    assert spark.read.parquet(f"{mine.path}/docs").count() == 30
    release()


def test_a_shared_folder_is_needed_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Cluster)


def test_bounds_that_the_user_set_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, "77")
    Workspace(spark, "test")
    assert spark.conf.get(key) == "77"
    spark.conf.set(key, was)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_hub_components(spark, monkeypatch, most):
    """A hub with many links, minima broadcast or not."""
    from framewalk.llm import common

    monkeypatch.setattr(common, "BROADCAST_NUMBERS", most)
    links = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(40)] + [(2999, 5000)]
    made = connected_components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "test")).collect()
    assert {r["root"] for r in made} == {0} and len(made) == 2999 + 41
