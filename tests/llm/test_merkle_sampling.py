"""Merkle manifests, resampling and places in an order, against plain versions."""

import math
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from framewalk.llm import common, merkle, ordering, resampling


def H(text):
    return sha256(text.encode()).hexdigest()


def leaf(row):
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[k] for k in merkle.FIELDS)))


def plain_levels(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][k : k + fanout])) for k in range(0, len(levels[-1]), fanout)])
    return levels


def plain_way(levels, place, fanout):
    way = []
    for level in levels[:-1]:
        start = place // fanout * fanout
        way.append(("".join(level[start:place]), "".join(level[place + 1 : start + fanout])))
        place //= fanout
    return way


def plain_manifest(rows, fanout=2):
    trees = {}
    for r in rows:
        trees.setdefault("" if r["lang"] is None else "=" + r["lang"], []).append(r)
    made = {}
    for t, members in trees.items():
        members.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        made[t] = plain_levels([leaf(r) for r in members], fanout)
    order = sorted(trees, key=lambda t: t.encode())
    top = plain_levels([made[t][-1][0] for t in order], fanout)
    out = []
    for t in order:
        for place, r in enumerate(trees[t]):
            way = plain_way(made[t], place, fanout) + plain_way(top, order.index(t), fanout)
            now = leaf(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0:
                now = leaf(r | {"n_chars": None if r["n_chars"] is None else r["n_chars"] + 1})
            for a, b in way:
                now = H(a + now + b)
            out.append((r["doc_id"], leaf(r), made[t][-1][0], top[-1][0], H("".join(a + b for a, b in way)), now, now == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, place int, tree string, digest string, block int"


def documents(spark, rows):
    return spark.createDataFrame([(*(r[k] for k in ("doc_id", "text", "lang", "source", "n_chars")), 7, "x", "y", 3) for r in rows], SCHEMA)


def row(doc_id, lang="en", text="some text", source="s", n_chars=5):
    return {"doc_id": doc_id, "text": text, "lang": lang, "source": source, "n_chars": n_chars}


def changed():
    other = merkle.leaf_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS))
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, other)


@pytest.mark.parametrize("fanout, block", [(2, 4096), (2, 4), (3, 9)])
def test_manifest(spark, fanout, block):
    rows = [row(k, lang=["en", "de", "ß", "zz"][k % 4 if k % 3 else 0], text="täxt " * (k % 9)) for k in range(60)]
    rows += [row(100, lang=None), row(101, lang=""), row(None), row(None), row(None, text=None, source=None, n_chars=None), row(7, lang="zz", text="other"), row(2**60, text="x" * 200_000), row(11), row(11), row(-5), row(500, lang="alone")]
    made = merkle.manifest(documents(spark, rows), fanout=fanout, block=block, changed=changed())
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got == plain_manifest(rows, fanout)
    bad = {r[0] for r in got if not r[6]}
    assert bad and all(zlib.crc32(str(d).encode()) % 7 == 0 for d in bad)


@pytest.mark.parametrize("ids", [[], [3], [3, 3], list(range(9))])
def test_small_manifests(spark, ids):
    rows = [row(k) for k in ids]
    made = merkle.manifest(documents(spark, rows), block=4, changed=changed())
    assert sorted(map(tuple, made.collect()), key=repr) == plain_manifest(rows)
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_many_trees(spark):
    rows = [row(k, lang=f"l{k // 2}") for k in range(41)]
    made = merkle.manifest(documents(spark, rows), block=4, changed=changed())
    assert sorted(map(tuple, made.collect()), key=repr) == plain_manifest(rows)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_places(spark, monkeypatch, most):
    monkeypatch.setattr(common, "BROADCAST_NUMBERS", most)
    rows = [("a", k % 7) for k in range(300)] + [("b", None), ("b", 1)] + [("hot", 1)] * 500
    frame = spark.createDataFrame(rows, "g string, v int").repartition(5)
    made = ordering.placed(frame, ["g"], ["v"], common.Workspace(spark, "places"), "rows").collect()
    for g in ("a", "b", "hot"):
        mine = sorted((r["place"], r["v"]) for r in made if r["g"] == g)
        assert [p for p, _ in mine] == list(range(len(mine)))
        values = [v for _, v in mine]
        assert values == sorted(values, key=lambda v: (v is not None, v or 0))


def test_equal_rows_do_not_pile_up(spark):
    frame = spark.range(0, 8000, 1, 8).select(F.lit("g").alias("g"), F.lit(1).alias("v"))
    work = common.Workspace(spark, "places")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ordering.placed(frame, ["g"], ["v"], work, "rows").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    kept = spark.read.parquet(f"{work.path}/rows")
    sizes = [r["count"] for r in kept.groupBy(F.shiftright("_at", 33).alias("p")).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 4000


# ---- resampling


def plain_scores(docs, target, n, buckets, least, percent, seed):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    def grams(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + g]).encode()) % buckets for g in range(1, n + 1) for i in range(len(w) - g + 1)]

    s, t = [0] * buckets, [0] * buckets
    for _, text in docs:
        for b in grams(text):
            s[b] += 1
    for text in target:
        for b in grams(text):
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for d, text in docs:
        g = grams(text)
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


TEXTS = [None, "", "  \n\t ", "ÄÖ ä İ ſ 日本語 text-with-dashes e.g. 12", "A b C " * 40, "word " * 300, " ".join(f"w{k % 31}x{k % 7}" for k in range(500)), "." * 5000, "a", "one two three", "\x00\x7f{}", "é" * 90_000, "same same"]


@pytest.mark.parametrize("n, chunk", [(1, 1 << 16), (1, 7), (3, 5), (2, 1)])
def test_scores(spark, monkeypatch, n, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    monkeypatch.setattr(resampling.chunks_of, "__defaults__", (chunk,))
    docs = [(k, f"{t or ''} doc {k % 5} " * (1 + k % 4) if k % 6 else t) for k, t in enumerate(TEXTS * 5)]
    docs += [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")]
    target = ["word two three", "A b c w3x1 é", None, ""]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, row int, rank int, chunk string")
    made = resampling.scored(frame, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=100, least_words=5, percent=30, seed=7)
    got = sorted(map(tuple, made.collect()), key=repr)
    assert got == plain_scores(docs, target, n, 100, 5, 30, 7)


def test_chunks_own_every_start():
    text = " ".join(f"w{k}" for k in range(23))
    for n in (1, 2, 4):
        for owned in (1, 3, 22, 23, 24):
            found = [g for c, o in resampling.chunks_of(text, n, owned) for g in resampling.features(c, o, n)]
            assert sorted(found) == sorted(resampling.features(text.encode(), None, n))


def test_resample(spark):
    rows = [(k, "target words here " * 9 if k % 4 == 0 else f"other stuff {k} " * 9) for k in range(200)]
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, score string")
    target = spark.createDataFrame([("target words here",)], "text string")
    kept = resampling.resample(docs, target, percent=10).collect()
    assert {(r["doc_id"], r["score"]) for r in kept} == {(r[0], "extra") for r in plain_scores(rows, ["target words here"], 1, 10_000, 20, 10, 2024) if r[4]}
    assert len(kept) == 20
    assert resampling.scored(docs.limit(0), target).collect() == []
    assert resampling.scored(docs, target.limit(0)).count() == 200
