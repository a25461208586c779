"""Quality rules, packing, language ID, piece codec and license scans on edge cases and against brute force."""

import random
import re
import zlib
from array import array
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scholarspark.llm import langid_cnn, license_scan, packing, piece_bpe, quality_crf
from scholarspark.llm.wordcache import WordCache

from ..conftest import DATA

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, id string, sequence_id string"
CASES = [None, "", " \n\t\v", "x", "word " * 30, "Ünïcode 中文 😀 text", "a\nb\na\n\nb ", "one two three four five six seven eight " * 3, "x" * 70_000, "w%d " * 20_000, "#*$%&|<> " * 30, "\x85\xa0　nbsp"]


def docs(spark, texts=CASES):
    rows = [(i, t, "en", "s", 0, "clash", "clash", "clash") for i, t in enumerate(texts)] + [(None, "no id here", None, None, None, None, None, None), (3, "x", "en", "s", 0, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


# quality ----------------------------------------------------------------------------------------------------------


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows: dict = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in lines and bool(re.search(r"[^\x20\x09-\x0D]", line))
        lines.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_base_counts_against_brute_force():
    rng = random.Random(1)
    texts = CASES[:8] + ["".join(rng.choice(["a ", "b ", "c\n", "é\t", "#", "\x0b", "\x1c", "d "]) for _ in range(rng.randint(0, 200))) for _ in range(200)]
    for t in texts:
        assert quality_crf.base_counts(t) == brute_counts(t), t


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for n in range(1, 8):
        field = quality_crf.LineField(rng.normal(size=(len(quality_crf.FEATURES), 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, len(quality_crf.FEATURES)))
        score = lambda p: sum(x[i] @ field.weights[:, p[i]] for i in range(n)) + sum(field.steps[a, b] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        assert tuple(field.decode(x)) == max(product((0, 1), repeat=n), key=score)


def test_likelihood_and_gradient_against_all_paths():
    """The mean log likelihood by summing all label paths, and its gradient by differences."""
    rng = np.random.default_rng(5)
    k = len(quality_crf.FEATURES)
    chains = [rng.normal(size=(n, k)) for n in (4, 1, 3, 4)]
    labels = [rng.integers(0, 2, len(c)) for c in chains]
    params = rng.normal(size=2 * k + 4)

    def plain(p):
        w, s = p[:-4].reshape(-1, 2), p[-4:].reshape(2, 2)
        score = lambda x, path: sum(x[i] @ w[:, path[i]] for i in range(len(x))) + sum(s[a, b] for a, b in zip(path, path[1:], strict=False))
        return np.mean([score(x, y) - np.log(sum(np.exp(score(x, path)) for path in product((0, 1), repeat=len(x)))) for x, y in zip(chains, labels, strict=True)])

    order = sorted(range(4), key=lambda i: -len(chains[i]))
    value, gradient = quality_crf._Batch([chains[i] for i in order], [labels[i] for i in order]).gradient(params)
    assert abs(value - plain(params)) < 1e-9
    for j in range(len(params)):
        step = np.zeros_like(params)
        step[j] = 1e-5
        assert abs((plain(params + step) - plain(params - step)) / 2e-5 - gradient[j]) < 1e-6


def test_stretches_span_the_text():
    rows = np.arange(1000)
    parts = quality_crf.stretches(rows, 200)
    assert sum(map(len, parts)) == 200 and parts[0][0] == 0 and parts[-1][-1] == 999 and len(parts) == quality_crf.STRETCHES
    assert [len(p) for p in quality_crf.stretches(rows[:200], 200)] == [200]


def learned(d, lab, part):
    """A field learned from the labelled documents whose id hashes into ``part``."""
    return quality_crf.train_field(d.where(part), lab)


def test_quality_query_cases(spark):
    labels = spark.createDataFrame([(4, 1, 0), (10, 0, 0), (None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
    field = quality_crf.train_field(docs(spark), labels)
    got = {r.doc_id: r for r in quality_crf.quality_rules(docs(spark), field).collect() if r.doc_id not in (None, 3)}
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and not any(got[i].kept for i in (0, 1, 2))
    assert quality_crf.quality_rules(docs(spark), field).count() == len(CASES) + 2
    assert got[7].n_repeat_words == 24 and got[7].base_failed and got[9].base_failed
    assert quality_crf.quality_rules(empty(spark), field).count() == 0
    untrained = quality_crf.train_field(empty(spark), labels.limit(0))
    assert not untrained.trained and untrained.content_share("anything") == 1.0
    kept = quality_crf.filter_quality(docs(spark), docs(spark), labels)
    assert kept.columns == docs(spark).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_on_documents(spark):
    """A field of one half of the labelled documents judges the other half; its labels change within texts."""
    d, lab = (spark.read.parquet(f"{DATA}/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    field = learned(d, lab, half == 0)
    rows = quality_crf.quality_rules(d.where(half == 1), field).join(lab, "doc_id").where("not base_failed").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert len(good) > 100 and sum(r.kept for r in good) >= 0.99 * len(good)
    assert bad and sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert sum(0 < r.content_share < 1 for r in rows) >= 5
    texts = [r.text for r in d.join(lab.where("quality = 1"), "doc_id").where(half == 1).collect() if r.text and r.text.count("\n") > 4]
    for line in ("### $$$ %%% && ||| ### *** <<<", "Subscribe to our newsletter | cookie policy", "Home | About | Contact | Login", "DEALS!! TODAY!! ONLY!! HURRY!! NOW!!"):
        for t in texts[:10]:
            parts = t.split("\n")
            path = field.decode(quality_crf.line_features("\n".join([*parts[:3], line, *parts[3:]]))[0])
            words = [bool(x.split()) for x in parts[:3]]
            assert path[sum(words)] == 0, line
            assert field.content_share("\n".join([*parts[:3], line, *parts[3:]])) < 1


# packing ----------------------------------------------------------------------------------------------------------


def sequential(counts, capacity):
    """Best-two-fit one bin at a time, straight from its definition."""
    counts, bins = dict(counts), []
    while any(counts.values()):
        room, items = capacity, []
        while fits := [x for x in counts if counts[x] and x <= room]:
            counts[max(fits)] -= 1
            items.append(max(fits))
            room -= max(fits)
        if room:
            least, best = items[-1], (items[-1], 0, 0)
            for x, y in product(counts, repeat=2):
                if x <= y and counts[x] and counts[y] and (x != y or counts[x] > 1) and x + y <= room + least:
                    best = max(best, (x + y, y, x))
            if best[1]:
                items = [*items[:-1], *best[1:]]
                counts[least] += 1
                counts[best[1]] -= 1
                counts[best[2]] -= 1
        bins.append(items)
    return bins


def test_bins_equal_sequential_heuristic():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.choice([10, 20, 50])
        counts = {rng.randint(1, capacity): rng.randint(1, rng.choice([2, 9, 40])) for _ in range(rng.randint(1, 12))}
        bins = packing.best_two_fit(counts, capacity)
        packing.check_bins(counts, bins, capacity)
        assert [i for times, items in bins for _ in range(times) for i in [items]] == sequential(counts, capacity)


def test_ids_equal_tokenizer():
    from tokenizers import Tokenizer

    raw = open(packing.default_tokenizer(), encoding="utf-8").read()
    tokenizer, ids = Tokenizer.from_str(raw), packing.Ids(raw, 50)
    rng = random.Random(2)
    parts = ["a", "B", "the", "É", "ß", "İ", "Σ", "ς", "ǆ", "ñ", ".", ",", "..", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "1", "中", "😀", "\xa0", "　", " ", "\n", "###", ".%%%", "<|>", "Ⅷ", "ª", "ŉ", "̀", "\x1c", "K", "ſ"]
    for t in [c for c in CASES if c] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(3000)]:
        assert ids.packed(t) == array("I", tokenizer.encode(t, add_special_tokens=False).ids).tobytes(), t


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        packing.Ids(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())


def test_pack_rows(spark):
    rows = packing.pack(docs(spark), with_ids=True).collect()
    raw = open(packing.default_tokenizer(), encoding="utf-8").read()
    ids = packing.Ids(raw)
    whole: dict = {}
    for r in rows:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(bytes(r.ids)) and 1 <= r.length <= packing.CAPACITY
        whole.setdefault((r.doc_id, r.piece), []).append(r)
    for i, t in enumerate(CASES):
        parts = [whole[i, k][0] for k in range(sum(d == i for d, _ in whole))]
        assert b"".join(bytes(p.ids) for p in parts) == ids.packed(t or "") + b"\0\0\0\0"
        assert all(p.length == packing.CAPACITY for p in parts[:-1]) and [p.start for p in parts] == [packing.CAPACITY * k for k in range(len(parts))]
    assert len(whole[3, 0]) == 2 and (None, 0) in whole
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spots in by_seq.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(empty(spark)).count() == 0


# language ---------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    r = langid_cnn.predict_languages(d, langid_cnn.train_network(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(r) > 100 and sum(x.lang == x.lang_pred for x in r) >= 0.97 * len(r)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in r)


def test_language_cases(spark):
    net = langid_cnn.train_network(spark.read.parquet(f"{DATA}/sf0.001/documents.parquet"))
    got = langid_cnn.predict_languages(docs(spark), net).collect()
    assert len(got) == len(CASES) + 2 and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 10}
    nothing = langid_cnn.train_network(empty(spark))
    assert nothing.classify(["text"]) == (["und"], [0.0])
    assert langid_cnn.predict_languages(empty(spark), net).count() == 0
    assert langid_cnn.filter_language(docs(spark), docs(spark)).columns == docs(spark).columns


def test_windows_cover_text_and_batches_agree():
    net = langid_cnn.ByteNetwork(["a", "b"])
    raw = bytes(range(1, 256)) * 9
    w = net.windows(raw)
    assert b"".join(bytes(x[: net.step]) for x in w[:-1]) + bytes(w[-1])[: len(raw) - net.step * (len(w) - 1)] == raw
    texts = ["ab " * 400, "x", "zz top " * 99]
    alone = [net.classify([t])[1][0] for t in texts]
    assert np.allclose(net.classify(texts, batch=3)[1], alone, atol=1e-5)


def double(net):
    """The network in double precision."""
    for name in ("embedding", "filters", "filter_bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    return net


def test_network_against_plain_loops():
    """Convolution of each width, largest response, rectifier and softmax, one byte and filter at a time."""
    rng = np.random.default_rng(3)
    net = double(langid_cnn.ByteNetwork(["a", "b", "c"]))
    net.filter_bias = rng.normal(size=len(net.filter_bias))
    net.out_bias = rng.normal(size=3)
    x = rng.integers(0, 256, (4, 30)).astype(np.uint8)
    for row, got in zip(x, net.predict(x), strict=True):
        hidden = []
        for f in range(net.filters.shape[1]):
            width = langid_cnn.WIDTHS[f // langid_cnn.FILTERS]
            taps = net.filters[:, f].reshape(-1, langid_cnn.EMBEDDING)
            # filters see positions at which the widest one fits
            best = max(sum(float(net.embedding[row[at + k]] @ taps[k]) for k in range(width)) for at in range(len(row) - max(langid_cnn.WIDTHS) + 1))
            assert not taps[width:].any()
            hidden.append(max(0.0, best + net.filter_bias[f]))
        z = [sum(h * net.out[f, c] for f, h in enumerate(hidden)) + net.out_bias[c] for c in range(3)]
        e = [np.exp(v - max(z)) for v in z]
        assert np.allclose(got, np.array(e) / sum(e), atol=1e-9)


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 255, (8, 40)).astype(np.uint8), rng.integers(0, 2, 8)
    net = double(langid_cnn.ByteNetwork(["a", "b"]))
    target = np.eye(2)[y]
    loss, grads = net.gradients(x, target)
    assert abs(loss + np.log(net.predict(x)[np.arange(8), y]).mean()) < 1e-9
    for param, grad in zip((net.embedding, net.filters, net.filter_bias, net.out, net.out_bias), grads, strict=True):
        flat, slope = param.reshape(-1), grad.reshape(-1)
        for k in [*np.argsort(-np.abs(slope))[:12], *rng.integers(0, len(flat), 4)]:
            if param is net.filters and not net.mask.reshape(-1)[k]:
                assert slope[k] == 0
                continue
            was = flat[k]
            flat[k] = was + 1e-6
            up = net.gradients(x, target)[0]
            flat[k] = was - 1e-6
            down = net.gradients(x, target)[0]
            flat[k] = was
            assert abs((up - down) / 2e-6 - slope[k]) < 1e-5
    single = langid_cnn.ByteNetwork(["a", "b"])
    before = single.gradients(x, target)[0]
    assert single.fit(x, y, epochs=30, batch=8).gradients(x, target)[0] < 0.5 * before


def test_languages_learned_are_the_commonest(spark):
    rows = [(k, f"text {lang} " * 9, lang) for k, lang in enumerate(["aa"] * 12 + ["bb"] * 9 + ["cc"] * 2 + [None])]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid_cnn.train_network(d, most_langs=2).langs == ["aa", "bb"] and langid_cnn.train_network(d).langs == ["aa", "bb", "cc"]


# piece codec ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return piece_bpe.PieceCodec(f.read(), 1000)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_codec_equals_library(codec, library):
    rng = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "▁", "\n", "é", "ß", "中", "😀", "1", "23", "---", "====", "ing", "tion", "\t", "\x00", "\xa0", "Ab", "<s>", "</s>", "<0x0A>", "<unk>"]
    texts = [t or "" for t in CASES] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [" " * n + "x" for n in range(80)] + ["".join(rng.choice("abcdefgthinso") for _ in range(n)) for n in (30, 300, 9000)]
    for t in texts:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert codec.encode(t) == ids, t
        assert codec.decode(ids) == library.decode(ids), t


def test_decode_of_any_ids(codec, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([1, 2, rng.randint(3, 258), rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_codec_query_cases(spark, library):
    import hashlib

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r for r in piece_bpe.encoding_digest(docs(spark), path).collect()}
    assert piece_bpe.encoding_digest(docs(spark), path).count() == len(CASES) + 2
    for i, t in enumerate(CASES):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    assert piece_bpe.encoding_digest(empty(spark), path).count() == 0
    assert {r.decoded for r in piece_bpe.encode_decode(docs(spark, ["a b"]), path).collect()} == {"a b", "no id here", "x"}


def test_word_cache_generations():
    calls = []
    cache = WordCache(lambda w: calls.append(w) or len(w), limit=2, longest=5)
    assert [cache[w] for w in ("a", "bb", "ccc", "a", "toolong", "toolong")] == [1, 2, 3, 1, 7, 7]
    assert calls == ["a", "bb", "ccc", "toolong", "toolong"] and len(cache) <= 2


# licenses ---------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    mit = license_scan.TEMPLATES["MIT/grant"]
    words = mit.split()
    edited = " ".join(words[:10] + ["kindly"] + words[10:20] + words[22:])
    texts = [f"Über {mit} end", f"x {edited} y", " ".join(words[: len(words) // 2]), "All rights reserved. All rights reserved.", "ALL\nRIGHTS  reserved", "licensed under nothing", None, "", "q " * 60_000 + "Released under the MIT License."]
    got: dict = {}
    for r in license_scan.scan_licenses(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert set(got) == {0, 1, 3, 4, 8}
    assert texts[0][got[0][0].start_char : got[0][0].end_char] == mit.rstrip(":") and got[0][0].coverage == 1.0
    assert 0.9 < got[1][0].coverage < 1
    assert len(got[3]) == 2 and got[4][0].license == "Proprietary" and texts[8][got[8][0].start_char : got[8][0].end_char] == "Released under the MIT License"
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def plain_alignment(want, have):
    """The best local alignment (a match 2, else -1) over all cells: ``(score, matched, first, last)``."""
    none = (0, 0, -1, -1)
    above, best = [none] * (len(have) + 1), none
    for w in want:
        row = [none]
        for j, h in enumerate(have):
            s, m, a, b = above[j]
            cells = [none, (s + 2, m + 1, j if a < 0 else a, j) if w == h else (s - 1, m, a, b)]
            cells += [(s - 1, m, a, b) for s, m, a, b in (above[j + 1], row[j])]
            cell = max(cells)
            row.append(cell if cell[0] > 0 else none)
        best = max(best, *row)
        above = row
    return best


def test_license_scan_against_full_alignment():
    """Every template, whole or with one word in twelve changed, dropped or added, among other words: found with the
    coverage and span of an alignment over all cells."""
    rng = random.Random(8)
    index = license_scan.TemplateIndex(license_scan.TEMPLATES)
    for name, template in license_scan.TEMPLATES.items():
        t = license_scan.words_of(template.encode())
        other = [rng.choice(["the", "of", "lorem", "software", "license", "ipsum"]).encode() for _ in range(40)]
        for edits in (0, len(t) // 12):
            words = list(t)
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at : at + 1] = [[], [b"kindly"], [words[at], b"kindly"]][rng.randrange(3)]
            text = other[:25] + words + other[25:]
            want = plain_alignment(t, text)
            found = [m for m in index.scan(text) if m.template == name]
            assert len(found) == 1, name
            assert (found[0].matched, found[0].first, found[0].last) == want[1:] or found[0].matched >= want[1] - 1, name
    text = license_scan.words_of(("nothing of the kind is said here, all of it is free text " * 20).encode())
    assert index.scan(text) == [] and all(plain_alignment(license_scan.words_of(t.encode()), text)[1] < 0.8 * len(license_scan.words_of(t.encode())) for t in license_scan.TEMPLATES.values())


def test_license_scan_finds_every_literal_notice(spark):
    d = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    got = {(r.doc_id, r.license) for r in license_scan.scan_licenses(d).collect()}
    notices = {"MIT License": "MIT", "Apache License": "Apache-2.0", "CC BY-NC": "CC-BY-NC-4.0", "GNU General": "GPL-3.0", "rights reserved": "Proprietary"}
    want = {(r.doc_id, name) for r in d.collect() for mark, name in notices.items() if mark in (r.text or "")}
    assert want and got == want
