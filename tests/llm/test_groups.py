"""Line dedup, vector dedup, shards, archives and SimHash components on edge cases and against brute force."""

import glob
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from scholarspark.llm import line_dedup, sharding, simhash_dedup, vector_dedup, warc_chunks
from scholarspark.llm.common import scratch_dir

from ..conftest import DATA

DOC = "doc_id long, text string, n_chars int, component string, fp string, shard string, removed_lines string"


def frame(spark, rows, schema=DOC):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


# SimHash ----------------------------------------------------------------------------------------------------------


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "One TWO", "a b c", "É Z z", "x " * 3000] + [" ".join(rng.choice(["The", "of", "é", "x1"]) + rng.choice(["", "\t", "\x85"]) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    for t in texts:
        assert simhash_dedup.fingerprint(t) == brute_print(t)


def test_popcounts_bound_hamming(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(64) - (1 << 63), rng.getrandbits(64) - (1 << 63)) for _ in range(200)] + [(-1, 0), (-(1 << 63), (1 << 63) - 1)]
    u = simhash_dedup.unary_popcounts
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.bit_count(u(F.col("a")).bitwiseXOR(u(F.col("b")))).alias("m")).collect()
    for r in rows:
        a, b = r.a & (1 << 64) - 1, r.b & (1 << 64) - 1
        want = sum(abs((a >> s & 3).bit_count() - (b >> s & 3).bit_count()) for s in range(0, 64, 2))
        assert r.m == want <= (a ^ b).bit_count()


def test_links_against_brute_force(spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(40):
        p = rng.getrandbits(64)
        prints |= {p} | {p ^ sum(1 << rng.randrange(64) for _ in range(k)) & (1 << 64) - 1 for k in (1, 2, 2, 3, 4)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {(r.a, r.b) for r in simhash_dedup.hamming_links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert want and got == want


def test_simhash_cases(spark):
    rows = [(5, None), (4, ""), (9, "a b c d"), (8, "A b C d"), (7, "quite another text here"), (7, "quite another text here"), (None, "a b c d"), (None, "alone without any id"), (1, "w " * 30_000)]
    got = simhash_dedup.simhash_components(frame(spark, rows)).collect()
    comp = {(r.doc_id, r.component) for r in got}
    assert len(got) == len(rows) and {(5, 4), (4, 4), (9, 8), (8, 8), (7, 7), (None, 8), (None, None), (1, 1)} == comp
    kept = simhash_dedup.drop_near_duplicates(frame(spark, rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "7", "8", "None", "None"] and kept.columns == frame(spark, rows).columns
    assert simhash_dedup.simhash_components(frame(spark, [])).count() == 0 == simhash_dedup.drop_near_duplicates(frame(spark, [])).count()


def test_dropping_keeps_unlike_rows_of_one_id(spark):
    """Of a component one row stays; rows that share an id without being alike, and rows without an id, stay too."""
    rows = [(1, "alpha beta gamma delta", 1), (1, "something else that is quite different", 2), (2, "alpha beta gamma delta", 3), (2, "a third text of some words here", 4), (2, "a third text of some words here", 4), (3, None, 5), (4, "", 6), (None, "alpha beta gamma delta", 7)]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in simhash_dedup.drop_near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[5], rows[7]], key=str)


def test_simhash_components_on_documents(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = simhash_dedup.simhash_components(d).collect()
    fps = np.array([r.fp for r in rows], np.int64).view(np.uint64)
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 2):
            a, b = find(parent, i), find(parent, int(j))
            parent[max(a, b)] = min(a, b)
    least: dict = {}
    for i, r in enumerate(rows):
        least[find(parent, i)] = min(least.get(find(parent, i), r.doc_id), r.doc_id)
    assert all(r.component == least[find(parent, i)] for i, r in enumerate(rows)) and len(least) < len(rows)


# lines ------------------------------------------------------------------------------------------------------------


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        cur = [i]
        for j, e in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != e)))
        prev = cur
    return prev[-1]


def norm(line):
    return " ".join(re.sub(r"[\W_]+", " ", line.lower()).split())


def brute_simhash(line):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split(" ")]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def after_dedup(texts, alike):
    """Texts after dedup, with the lines of ``alike (a, b)`` linked; ``None`` stays."""
    names = list(dict.fromkeys(n for t in texts.values() for x in (t or "").split("\n") if (n := norm(x))))
    at, parent = {n: k for k, n in enumerate(names)}, list(range(len(names)))
    for a, b in alike(names):
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    seen, out = set(), {}
    for i in sorted(texts):
        kept = []
        for x in (texts[i] or "").split("\n"):
            root = find(parent, at[norm(x)]) if norm(x) else None
            if root is None or root not in seen:
                kept.append(x)
            seen |= set() if root is None else {root}
        out[i] = None if texts[i] is None else "\n".join(kept)
    return out


def similar(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and distance(a, b) <= most


def met_and_similar(spark, d):
    """Pairs that share a bucket key, are near by SimHashes computed here, and similar; over all pairs of lines.

    Similar is what the operator's word-wise count of edits says, which must never say more than the plain distance.
    """
    rows = line_dedup.distinct_lines(line_dedup.materialize(line_dedup.lines_of(d, "doc_id", "text"), "t")).collect()
    texts = {r.doc_id: r.text for r in d.collect()}
    keys: dict = {}
    for r in rows:
        keys[norm(texts[r.id].split("\n")[r["sub"] % (1 << 31)])] = {r[k] for k in line_dedup.KEYS}

    def alike(names):
        prints = [brute_simhash(n) for n in names]
        near = [(i, j, names[i], names[j]) for i, j in combinations(range(len(names)), 2) if keys[names[i]] & keys[names[j]] and (prints[i] ^ prints[j]).bit_count() <= line_dedup.MAX_BITS]
        found = [(r.a, r.b) for r in line_dedup.edit_tested(spark.createDataFrame(near, "a long, b long, s string, t string"), 0.8).where("ok").collect()]
        assert all(similar(names[i], names[j]) for i, j in found)
        return found

    return alike


def assert_nearly(deduped, texts, alike):
    """All lines go that equal an earlier one, only lines that links between all pairs take out, and 19 in 20 of these."""
    split = lambda t: Counter((t or "").split("\n"))
    got = {r.doc_id: r.text for r in deduped.collect()}
    want, exact = after_dedup(texts, alike), after_dedup(texts, lambda names: [])
    assert all(split(want[i]) <= split(got[i]) <= split(exact[i]) | Counter([""]) for i in texts)
    gone = lambda out: sum((split(texts[i]) - split(out[i])).total() for i in texts)
    assert gone(want) > 0 and gone(got) >= 0.95 * gone(want)


def test_line_prints_against_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    texts = ["one", "a b a", "é ß 中文 x9", "the the the cat", long, long + " more", "Repeated line", "repeated LINE!"] + ["w" + " w".join(map(str, range(n))) for n in (16_000, 16_001, 32_000)]
    d = frame(spark, list(enumerate(texts)))
    rows = line_dedup.distinct_lines(line_dedup.materialize(line_dedup.lines_of(d, "doc_id", "text"), "t")).collect()
    assert sorted(r.id for r in rows) == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10] and {r.id: r.n for r in rows}[6] == 2
    for r in rows:
        words = norm(texts[r.id])
        assert r.fp & (1 << 64) - 1 == brute_simhash(words) and r.len == len(words)


def test_line_dedup_against_brute_force(spark):
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert_nearly(line_dedup.dedup_lines(d), texts, met_and_similar(spark, d))


def test_line_dedup_recall_on_documents(spark):
    """Of the lines that all-pairs edit distance would take out, nine in ten go, and no other."""
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    pairs: set = set()

    def alike(names):
        grams = [Counter(n[i : i + 3] for i in range(len(n) - 2)) for n in names]
        sizes = np.array([len(n) for n in names])
        for i in range(len(names)):
            for j in np.flatnonzero(np.abs(sizes - sizes[i]) <= 0.2 * np.maximum(sizes, sizes[i])):
                most = 0.2 * max(sizes[i], sizes[j])  # an edit changes three 3-grams at most
                if i < j and sizes[i] <= 400 and sizes[j] <= 400 and (grams[i] & grams[j]).total() >= max(sizes[i], sizes[j]) - 2 - 3 * most and similar(names[i], names[j]):
                    pairs.add((i, int(j)))
        return pairs

    exact = after_dedup(texts, lambda names: [])
    want = after_dedup(texts, alike)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(d.where("true")).collect()}
    count = lambda out: sum(len((t or "").split("\n")) for t in out.values())
    near, missed = count(exact) - count(want), 0
    for i, t in texts.items():
        if t is not None:
            extra = Counter(got[i].split("\n")) - Counter(want[i].split("\n"))
            missed += sum(n for x, n in extra.items() if len(norm(x)) <= 400 and norm(x))
    print("pairs", len(pairs), "lines to go", near, "missed", missed)
    assert near >= 10 and missed <= 0.1 * near


def test_line_dedup_finds_near_copies(spark):
    """Recall against the edit distance of all line pairs: lines of 14 to 140 words, of which some are changed."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(2000)]
    lines = []
    for n, times in ((14, 24), (20, 16), (30, 8), (60, 4), (140, 2)):
        for _ in range(times):
            words = rng.choices(vocabulary, k=n)
            copy = list(words)
            for at in rng.sample(range(n), max(1, n // 14)):
                copy[at] = rng.choice(vocabulary)
            lines += [" ".join(words), " ".join(copy)]
    alike = {j for i, j in combinations(range(len(lines)), 2) if similar(lines[i], lines[j])}
    got = {r.doc_id for r in line_dedup.dedup_lines(frame(spark, list(enumerate(lines)))).collect() if r.text == ""}
    assert len(alike) >= 50 and got <= alike and len(got) >= 0.95 * len(alike)


def near_copies(n, seed=4):
    """Copies of one line of 30 words, each with two words changed: most are similar, some pairs only through others."""
    rng = random.Random(seed)
    words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{k}x" for k in range(30)]
    out = []
    for k in range(n):
        copy = list(words)
        for at in rng.sample(range(30), 2):
            copy[at] = f"other{k}{at}"
        out.append(" ".join(copy))
    return out


def test_line_groups_of_unlike_firsts(spark):
    """Lines unlike the first of their buckets still find each other."""
    words = [f"word{k}" for k in range(24)]
    change = lambda at: " ".join(f"fresh{k}" if k in at else w for k, w in enumerate(words))
    lines = [change(range(0, 6)), change(range(12, 18)), change(range(12, 17)), change(range(1, 6)), " ".join(reversed(words)), *near_copies(40)]
    d = frame(spark, list(enumerate(lines)))
    texts = {r.doc_id: r.text for r in d.collect()}
    assert_nearly(line_dedup.dedup_lines(d), texts, met_and_similar(spark, d))


def test_tested_pairs_grow_with_the_group(spark, monkeypatch):
    """A group of near copies four times as large has about four times the pairs to verify, not sixteen times."""
    seen = []
    plain = line_dedup.tested
    monkeypatch.setattr(line_dedup, "tested", lambda pairs, *rest: seen.append(pairs.count()) or plain(pairs, *rest))
    counts = []
    for n in (50, 200):
        seen.clear()
        out = line_dedup.dedup_lines(frame(spark, list(enumerate(near_copies(n)))))
        assert sum(r.text != "" for r in out.collect()) == 1
        counts.append(sum(seen))
    assert counts[1] <= 6 * counts[0] and counts[1] < 200 * 199 // 8


def test_edit_test_is_nearly_the_distance(spark):
    rng = random.Random(1)
    words = ["a", "bb", "ccc", "dog", "é", "word", "x"]
    rows = []
    for k in range(1500):
        w = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        v = list(w)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(v) + 1)
            v[at : at + rng.randint(0, 1)] = [rng.choice(words) for _ in range(rng.randint(0, 1))]
        rows.append((k, k, " ".join(w), " ".join(v or ["z"])))
    got = {r.a: r.ok for r in line_dedup.edit_tested(spark.createDataFrame(rows, "a long, b long, s string, t string"), 0.8).collect()}
    want = {k: distance(s, t) <= int(0.2 * max(len(s), len(t)) + 1e-9) for k, _, s, t in rows}
    assert all(want[k] for k in want if got[k]) and len(set(got.values())) == 2
    assert sum(got.values()) >= 0.97 * sum(want.values())


def test_anchored_distance_bounds_the_distance(spark):
    rng = random.Random(2)
    words = ["a", "bb", "ccc", "dog", "é", "word", "x"]
    rows = [(k, [rng.choice(words) for _ in range(rng.randint(1, 9))], [rng.choice(words) for _ in range(rng.randint(1, 9))]) for k in range(800)] + [(900, ["w"] * 60, ["v"] * 50), (901, ["same"], ["same"])]
    got = {r.k: r.d for r in spark.createDataFrame(rows, "k long, x array<string>, y array<string>").select("k", line_dedup.anchored_distance(F.col("x"), F.col("y")).alias("d")).collect()}
    assert all(got[k] >= distance(" ".join(x), " ".join(y)) for k, x, y in rows) and got[901] == 0
    assert sum(got[k] == distance(" ".join(x), " ".join(y)) for k, x, y in rows) > 200


def test_line_of_very_many_words(spark):
    words = [f"w{k}" for k in range(40_000)]
    d = frame(spark, [(1, " ".join(words)), (2, " ".join(words[:-3])), (3, " ".join(reversed(words)))])
    assert {r.doc_id: len(r.text) > 0 for r in line_dedup.dedup_lines(d).collect()} == {1: True, 2: False, 3: True}


def test_line_dedup_cases(spark):
    rows = [(3, "Same line here.\nOther text", 25), (1, "SAME   line, here\n***\n\n***", 25), (2, None, 7), (4, "", 0), (None, "Same line here.", 15), (5, "Same line here!", 15), (6, "long " * 9000 + "a\nlong " + "long " * 9000 + "a"), (7, "twin\nline"), (7, "twin\nline"), (7, "twin\nelse")]
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in line_dedup.dedup_lines(frame(spark, rows)).collect()), key=str)
    texts: dict = {}
    for i, t, n in got:
        texts.setdefault(i, []).append(t)
    assert len(got) == len(rows)
    assert texts[1] == [rows[1][1]] and texts[3] == ["Other text"] and texts[2] == [None] and texts[4] == [""] and texts[None] == ["Same line here."] and texts[5] == [""]
    assert [(t, n) for i, t, n in got if i == 5] == [("", 0)]
    assert sorted(texts[7]) in (["else", "twin\nline", "twin\nline"], ["line", "line", "twin\nelse"])
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert out.columns == frame(spark, rows).columns
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_is_native(spark):
    plan = line_dedup.dedup_lines(frame(spark, [(1, "a b c")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# vectors ----------------------------------------------------------------------------------------------------------

VEC = "vec_id long, embedding array<float>, label int, node string, n string"


def brute_vectors(rows, limit=0.98):
    ok = [v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    units = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for (_, v, _), g in zip(rows, ok, strict=True)]
    parent, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= limit:
                links[i] += 1
                links[j] += 1
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    ids: dict = {}
    for i, r in enumerate(rows):
        ids.setdefault(find(parent, i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return sorted((str(r[0]), links[i], str(least[find(parent, i)])) for i, r in enumerate(rows))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=16)
        for m in range(int(rng.integers(1, 7))):
            rows.append((len(rows), [float(np.float32(x)) for x in base * rng.uniform(0.5, 2) + rng.normal(size=16) * 0.12 * (m > 1)], int(k % 3)))
    nan, inf = float("nan"), float("inf")
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [nan] + [1.0] * 15, 1), (903, [inf] + [1.0] * 15, 1), (904, [None] + [1.0] * 15, 1), (905, [1.0] * 16, None), (906, [], 1), (907, [1.0] * 3, 1), (907, [1.0] * 3, 1), (None, [1.0] * 3, 1), (None, [5.0, -1.0], 2), (908, [1e30] * 5, 2), (909, [1e-30] * 5, 2)]
    got = vector_dedup.vector_components(frame(spark, rows, VEC), block=8).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert vector_dedup.vector_components(frame(spark, [], VEC)).count() == 0


def test_collision_counts_and_calibration():
    rng = np.random.default_rng(5)
    q, o = rng.normal(size=(20, 6)), rng.normal(size=(50, 6))
    want = (np.abs(q[:, None, :] - o[None, :, :]) <= 0.4).sum(axis=2)
    assert (vector_dedup.collisions(q, o, 0.4) == want).all()
    bound = vector_dedup.least_collisions()
    hits = (np.abs(rng.normal(size=(200_000, vector_dedup.DIRECTIONS))) <= vector_dedup.HALF_WIDTH).sum(axis=1)
    assert (hits >= bound).mean() > 0.9999 and bound > vector_dedup.DIRECTIONS // 2


def test_meetings_grow_nearly_linearly_and_true_pairs_meet():
    """Unrelated meetings in a label that grows eightfold, and pairs at the very threshold that share a cell."""
    rng = np.random.default_rng(6)
    sigma = np.sqrt(0.04)
    met, moved = {}, {}
    for n in (3000, 24_000):
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k, tables = vector_dedup.tables_for(n, sigma)
        cells = vector_dedup.cells_of(x, k, tables, vector_dedup.CELL * sigma)
        sizes = [np.unique(cells[:, t], return_counts=True)[1] for t in range(tables)]
        met[n], moved[n] = sum(int((c * (c - 1) // 2).sum()) for c in sizes), sum(int(c[c > 1].sum()) for c in sizes)
        assert met[n] < 0.01 * n * (n - 1) / 2
        off = rng.normal(size=(2000, 64))
        y = x[:2000]
        off -= np.einsum("nd,nd->n", off, y)[:, None] * y
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        other = vector_dedup.cells_of(0.98 * y + np.sqrt(1 - 0.98**2) * off, k, tables, vector_dedup.CELL * sigma)
        assert (other == cells[:2000]).any(axis=1).mean() > 0.999
    assert met[24_000] < 8**1.35 * met[3000] and moved[24_000] < 8**1.35 * moved[3000]


def test_units_give_each_pair_once():
    """Meetings in several tables, of small and large cells and pairs of blocks, against all pairs."""
    rng = np.random.default_rng(7)
    base = rng.normal(size=(12, 16))
    v = np.repeat(base, 25, axis=0) + rng.normal(size=(300, 16)) * 0.05
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    shadow = (v @ np.random.default_rng(1).normal(size=(16, vector_dedup.DIRECTIONS))).astype("f4")
    cells = vector_dedup.cells_of(v, 2, 30, 1.2)
    rows = []  # (vector, bucket, i, j, side, table)
    for t in range(30):
        for c in np.unique(cells[:, t]):
            who = np.flatnonzero(cells[:, t] == c)
            blocks = -(-len(who) // 90)
            for w in who:
                for k in range(blocks):
                    b = int(w) % blocks
                    rows.append((w, hash((t, int(c))), min(b, k), max(b, k), int(b > k), t))
    who, bucket, i, j, side, table = (np.array(c) for c in zip(*rows, strict=True))
    a, b = vector_dedup.meet_in_units(bucket, i, j, side, table, v[who], shadow[who], cells[who], 0.98, 0.5, vector_dedup.least_collisions())
    got = sorted(tuple(sorted(p)) for p in zip(who[a].tolist(), who[b].tolist(), strict=True))
    want = sorted((x, y) for x, y in combinations(range(300), 2) if v[x] @ v[y] >= 0.98)
    assert len(want) > 500 and got == want


# shards -----------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rows = [(i, "é" * (i % 17), 0) for i in range(300)] + [(None, None, 0), (None, "x", 0), (5, "same", 0), (5, "same", 0)]
    got = sharding.shard_by_bytes(frame(spark, rows), 8).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    parts: dict = {}
    for r in got:
        parts.setdefault(r.shard, []).append(r)
    assert set(parts) == set(range(8))
    sums = [sum(r.size for r in parts[k]) for k in range(8)]
    assert max(sums) - min(sums) <= 2 * max(r.size for r in got)
    for rows_ in parts.values():
        assert sorted(r.slot for r in rows_) == list(range(len(rows_)))
    order = [r.doc_id for k in range(8) for r in sorted(parts[k], key=lambda r: r.slot)]
    assert order[:2] == [None, None] and order[2:] == sorted(order[2:])
    assert sharding.shard_by_bytes(frame(spark, []), 8).count() == 0
    assert {r.shard for r in sharding.shard_by_bytes(frame(spark, [(1, "a"), (2, "b" * 5000), (3, "c")]), 3).collect()} <= {0, 1, 2}
    plan = sharding.shard_by_bytes(frame(spark, rows), 8)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_shards_against_plain_prefix_sums(spark):
    """Shard and slot of every row against one running sum over the sorted rows."""
    rng = random.Random(9)
    rows = [(rng.randrange(80), "é" * rng.choice([0, 3, 40, 900]), 0) for _ in range(250)] + [(None, None, 0), (500, "z" * 20_000, 0)]
    for shards in (1, 7, 40):
        size = lambda t: len((t or "").encode()) + 16
        order = sorted(((i if i is not None else -1, zlib.crc32((t or "").encode()), size(t)) for i, t, _ in rows))
        total, up_to, slots, want = sum(s for *_, s in order), 0, Counter(), []
        for i, crc, s in order:
            shard = min(shards - 1, (2 * up_to + s) * shards // (2 * total))
            want.append((i, crc, s, shard, slots[shard]))
            up_to += s
            slots[shard] += 1
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in sharding.shard_by_bytes(frame(spark, rows), shards).collect())
        assert got == sorted(want)


# archives ---------------------------------------------------------------------------------------------------------

PAGE = "page_id long, url string, html string, digest string, bytes string"


def test_archives_round_trip(spark):
    big = "ü<p>" * 700_000
    html = ["x" * 99, "x" * 99, "y" * 100, "y" * 100, "y" * 100, big, big, None, "", "é" * 50, "tail\r\n\r\nWARC/1.1\r\n"]
    rows = [(10 + i, None if i == 1 else f"http://e/{i} ü\r\n", h) for i, h in enumerate(html)] + [(None, "u", "y" * 100), (12, "again", "y" * 100)]
    df = frame(spark, rows, PAGE)
    chunks = warc_chunks.archive_pages(df, with_data=True)
    table = chunks.collect()
    got = sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_chunks.record_summary(chunks).collect()), key=str)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min(j for j, _, g in rows if g == h and j is not None) if len(raw) >= 100 else i
        revisit = len(raw) >= 100 and i != first
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    parts = sorted((r for r in table if r.page == 15), key=lambda r: r.chunk_no)
    assert len(parts) == 4 and b"".join(bytes(r.data) for r in parts) == big.encode()
    running = hashlib.sha256()
    for r in parts:
        running.update(bytes(r.data))
        assert r.digest == running.hexdigest() and r.last == (r.chunk_no == 3)
    assert not glob.glob(scratch_dir(spark).replace("file:", "") + "/warc-*/*.part")
    assert warc_chunks.record_summary(warc_chunks.archive_pages(frame(spark, [], PAGE))).count() == 0


def test_archive_reader_is_bounded_and_strict():
    import io

    head = warc_chunks._head(7, "u", 3_000_000, hashlib.sha256(b"a" * 3_000_000).hexdigest(), None)
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    raw = packer.compress(head + b"a" * 3_000_000 + b"\r\n\r\n") + packer.flush()
    rows = list(warc_chunks.read_chunks(io.BytesIO(raw + raw), 1 << 20))
    assert [r["chunk_no"] for r in rows] == [0, 1, 2] * 2 and max(len(r["data"]) for r in rows) == 1 << 20
    try:
        list(warc_chunks.read_chunks(io.BytesIO(raw[: len(raw) // 2])))
        raise AssertionError("a cut archive was accepted")
    except (EOFError, zlib.error):
        pass
    other = packer_of(head + b"a" * 2_999_999 + b"b" + b"\r\n\r\n")
    try:
        list(warc_chunks.read_chunks(io.BytesIO(other)))
        raise AssertionError("a payload unlike its digest was accepted")
    except ValueError:
        pass


def packer_of(raw):
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def test_archive_folder_without_scheme(spark, tmp_path):
    """A folder without a scheme is the one that Spark itself would take it for."""
    df = frame(spark, [(1, "u", "x" * 200), (2, "u", "x" * 200)], PAGE)
    rows = warc_chunks.record_summary(warc_chunks.archive_pages(df, folder=str(tmp_path / "a"))).collect()
    assert {(r.page_id, r.refers_to) for r in rows} == {(1, None), (2, 1)} and glob.glob(f"{tmp_path}/a/*.warc.gz")
