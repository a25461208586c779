"""Merkle proofs, fill-in-the-middle cuts and exact dedup against plain versions and on edge cases."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from scholarspark.llm import exact_dedup, fill_middle, merkle

DOC = "doc_id long, text string, n string, form string, row string, digest string, hot string, keep_id string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * 6 for r in rows], DOC)


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifest --------------------------------------------------------------------------------------------------


def levels_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([hexed("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def siblings_of(levels, i):
    found = ""
    for level in levels[:-1]:
        pair = level[i - i % 2 : i - i % 2 + 2]
        found += "".join(h for k, h in enumerate(pair) if k != i % 2)
        i //= 2
    return found


def plain_proofs(leaves):
    """{(key, hash at its place): (subroot, root, siblings)} of {key: [hash, ...]}."""
    trees = {k: levels_of(v) for k, v in leaves.items()}
    keys = sorted(trees, key=lambda k: k.encode())
    top = levels_of([trees[k][-1][0] for k in keys])
    return {(k, i): (trees[k][-1][0], top[-1][0], siblings_of(trees[k], i) + siblings_of(top, keys.index(k))) for k in keys for i in range(len(leaves[k]))}


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_proofs_against_plain_trees(spark, levels):
    sizes = {"-": 1, "=a": 2, "=b": 3, "=é": 37, "=Z": 64, "=zz": 5, "=": 16}
    leaves = {k: [hexed(f"{k}{i}") for i in range(n)] for k, n in sizes.items()}
    rows = [(k, i, h, (i,)) for k, hs in leaves.items() for i, h in enumerate(hs)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "key string, doc_id long, hash string, row struct<i: long>")
    got = merkle.prove(df, ["doc_id"], levels).withColumn("beside", merkle.siblings(F.col("path"))).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    want = plain_proofs(leaves)
    key = {h: k for k, hs in leaves.items() for h in hs}
    assert len(got) == len(rows)
    for r in got:
        subroot, root, beside = want[key[r.leaf], r.row.i]
        assert (r.subroot, r.root, r.beside, r.folded) == (subroot, root, beside, root)


def test_tampering_shows(spark):
    df = spark.createDataFrame([("=k", i, hexed(str(i)), (hexed("other") if i == 3 else hexed(str(i)),)) for i in range(9)], "key string, doc_id long, hash string, row struct<found: string>")
    rows = merkle.prove(df, ["doc_id"], 2).select("leaf", (merkle.fold(F.col("row.found"), F.col("path")) == F.col("root")).alias("ok")).collect()
    assert {r.leaf for r in rows if not r.ok} == {hexed("3")} and len(rows) == 9


def test_merkle_cases(spark):
    schema = "key string, doc_id long, hash string, row struct<x: long>"
    assert merkle.prove(spark.createDataFrame([], schema), ["doc_id"]).count() == 0
    (one,) = merkle.prove(spark.createDataFrame([("=", None, hexed("a"), (1,))], schema), ["doc_id"]).collect()
    assert (one.leaf, one.subroot, one.root, one.path) == (hexed("a"),) * 3 + ([],)
    # repeated rows are leaves of their own; ties of the order go by hash
    low, high = sorted([hexed("a"), hexed("b")])
    rows = merkle.prove(spark.createDataFrame([("=", 1, high, (1,)), ("=", 1, low, (2,)), ("=", 1, high, (3,))], schema), ["doc_id"]).collect()
    assert {r.root for r in rows} == {levels_of([low, high, high])[-1][0]} and len(rows) == 3


def test_leaf_hash(spark):
    (r,) = spark.createDataFrame([(7, "né", None, "")], "a long, b string, c int, d string").select(merkle.leaf_hash(*map(F.col, "abcd")).alias("h")).collect()
    assert r.h == hexed("1:73:né-0:")


# fill in the middle -----------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_example(doc_id, text):
    text, units = text or "", TOKEN.findall(text or "")
    h = hexed(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("chunk", [1, 2, 7, 4096])
def test_examples_against_plain_cuts(spark, chunk):
    rng = random.Random(chunk)
    letters = ["a", "é", "𝄞", " ", "\t", "\n", "\x0b", "\x1f", "\x85", " ", "<", "P>", "word"]
    texts = [None, "", " ", "\n\n", "one", " one", "one ", "a b", "x<P>y", "<S>", "ends <M>", "𝄞 𝄞", "<P", "<<", "< P>"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    if chunk > 7:
        texts += [" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(3000, 9000))) for _ in range(8)] + ["z" * 50_000, " " * 20_000, "q " * 30_000 + " "]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a null id"), (3, "a repeated id"), (3, "a repeated id")]
    out = fill_middle.fill_in_middle(frame(spark, rows), chunk=chunk).withColumn("back", fill_middle.restore(F.col("output"), F.col("form")))
    assert set(out.columns) == {c.split()[0] for c in DOC.split(", ")} | {"prefix_chars", "middle_chars", "output", "back"}
    got = out.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got) == sorted((i is None, i or 0, t or "") for i, t in rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_example(r.doc_id, r.text) and r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_only_owning_chunks_hold_cuts(spark):
    rows = spark.createDataFrame([([0, 2, 0, 3], k) for k in range(1, 6)], "counts array<int>, rank long")
    got = [tuple(r.o) for r in rows.select(fill_middle.owning_chunk(F.col("counts"), F.col("rank")).alias("o")).collect()]
    assert got == [(1, 1), (1, 2), (3, 1), (3, 2), (3, 3)]


def test_middle_of_no_rows(spark):
    assert fill_middle.fill_in_middle(frame(spark, [])).count() == 0


# exact dedup ------------------------------------------------------------------------------------------------------


def plain_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = max(known, default=None), True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            out.append((i, keep, len(ids), i == keep and first, t))
            first = first and i != keep
    return sorted(out, key=repr)


def weak(text):
    return F.substring(F.md5(text), 1, 1).cast("binary")


@pytest.mark.parametrize("digest, share", [(exact_dedup.sha256, 1024), (exact_dedup.sha256, 3), (weak, 4)])
def test_groups_against_plain_groups(spark, digest, share):
    rng = random.Random(share)
    rows = [(i, "hot passage " * 30) for i in range(400)] + [(400 + i, f"text {rng.randrange(150)}") for i in range(500)] + [(-5, None), (2000, ""), (2001, "Case"), (2002, "case"), (2003, "case "), (2004, "x" * 200_000), (2005, "x" * 200_000), (None, "only null"), (None, "only null"), (None, "case"), (3000, "again"), (3000, "again"), (3000, "other")]
    rng.shuffle(rows)
    out = exact_dedup.exact_groups(frame(spark, rows).repartition(5), digest=digest, salts=4, hot_share=share).join(spark.createDataFrame([(t,) for t in {t or "" for _, t in rows}], "t string").withColumn("h", digest(F.col("t"))), F.col("digest") == F.col("h"))
    if digest is weak:  # the digest does not tell the text: ids and sizes do
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.drop("t", "h").dropDuplicates().collect()), key=repr)
        want = sorted({x[:4] for x in plain_groups(rows)}, key=repr)
    else:
        got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.t) for r in out.collect()), key=repr)
        want = plain_groups(rows)
    assert got == want


def test_local_merge_comes_before_the_shuffle(spark):
    plan = frame(spark, [(1, "a")]).groupBy("text").agg(F.max("doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2  # Spark combines in tasks what is grouped by a text


def test_dropped_copies(spark):
    rows = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "b"), (None, "b"), (2, "c")]
    got = exact_dedup.drop_exact_copies(frame(spark, rows))
    assert got.columns == [c.split()[0] for c in DOC.split(", ")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(2, "a"), (4, ""), (None, "b"), (2, "c")], key=repr)
    assert exact_dedup.drop_exact_copies(frame(spark, [])).count() == 0
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
