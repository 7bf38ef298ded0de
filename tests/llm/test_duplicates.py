import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from quernstone.llm import chroma, common, components, simhash, substring_recompression, suffix_dedup

random.seed(11)
VOCABULARY = [f"w{i}" for i in range(40)]


def corpus():
    docs = []
    for t in range(60):
        w = [random.choice(VOCABULARY) if random.random() < 0.8 else "w0" for _ in range(random.randint(0, 90))]
        if t > 5 and random.random() < 0.8:
            o = docs[random.randrange(len(docs))]
            a = random.randrange(len(o) + 1)
            w = w[:30] + o[a : a + 45] + w[30:]
        if t % 13 == 0:
            w = ["a"] * 50 + w
        docs.append(w)
    texts = [" ".join(w) for w in docs]
    return [*texts, texts[7], texts[7], "", None, "  ", "w1"]


TEXTS = corpus()


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def brute_words(width):
    seen, out = set(), {}
    for i, text in enumerate(TEXTS):
        w = re.findall(r"[^\x20\t-\r]+", text or "")
        gone = [0] * len(w)
        for k in range(len(w) - width + 1):
            q = " ".join(w[k : k + width])
            if q in seen:
                gone[k : k + width] = [1] * width
            seen.add(q)
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def brute_bytes(width):
    data = [(t or "").encode() for t in TEXTS]
    count = Counter(d[i : i + width] for d in data for i in range(len(d) - width + 1))
    out = {}
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for k in range(len(d) - width + 1):
            if count[d[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(a for a, g in zip(d, gone) if not g)
        out[i] = (len(d), sum(gone), sum(1 for k in range(len(d)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1 << 20, 2])
def test_repeated_words(spark, folder, monkeypatch, hot):
    monkeypatch.setattr(substring_recompression.WordCutter, "hot", hot)
    got = substring_recompression.remove_repeats(docs(spark), folder).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(20)


@pytest.mark.parametrize("hot", [1 << 20, 2])
def test_repeated_bytes(spark, folder, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup.ByteCutter, "hot", hot)
    got = suffix_dedup.remove_repeats(docs(spark), folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(200)


def test_repeats_of_odd_rows(spark, odd, nothing, folder):
    words = {r.doc_id: r for r in substring_recompression.remove_repeats(odd, f"{folder}/a").collect()}
    data = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd, f"{folder}/b").collect()}
    assert len(words) == len(data) == 11 and words[5].n_removed == words[5].n_words and words[3].n_words == data[3].n_bytes == 0
    assert words[1].n_removed < words[1].n_words and data[1].n_removed == data[5].n_removed == data[1].n_bytes
    assert substring_recompression.remove_repeats(nothing, f"{folder}/c").count() == 0 == suffix_dedup.remove_repeats(nothing, f"{folder}/d").count()
    null_ids = spark.createDataFrame([(None, TEXTS[7]), (1, TEXTS[7]), (None, TEXTS[7])], "doc_id long, text string")
    assert [r.n_removed for r in substring_recompression.remove_repeats(null_ids, f"{folder}/e").collect()].count(0) >= 2


def test_repeats_of_repeated_rows(spark, folder):
    t, u = " ".join(f"word{i}" for i in range(46)), " ".join(f"vocal{i}" for i in range(50))
    rows = [(1, t), (1, t), (2, u + " end"), (3, t), (4, u), (4, t + " more"), (4, t + " more")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for k, hot in enumerate((1 << 20, 2)):
        substring_recompression.WordCutter.hot, before = hot, substring_recompression.WordCutter.hot
        suffix_dedup.ByteCutter.hot, bytes_before = hot, suffix_dedup.ByteCutter.hot
        try:
            words = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_recompression.remove_repeats(table, f"{folder}/a{k}").collect())
            data = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(table, f"{folder}/b{k}").collect())
        finally:
            substring_recompression.WordCutter.hot, suffix_dedup.ByteCutter.hot = before, bytes_before
        assert words == [(1, 46, 0), (1, 46, 0), (2, 51, 0), (3, 46, 46), (4, 47, 46), (4, 47, 46), (4, 50, 50)]
        n, m = len(t), len(u)
        gone = lambda x, width=200: x if x >= width else 0
        assert data == sorted([(1, n, 0 if n < 200 else n)] * 2 + [(2, m + 4, gone(m)), (3, n, gone(n)), (4, m, gone(m)), *[(4, n + 5, gone(n))] * 2])


def test_symbols_depend_on_content_alone():
    cutter, owner = substring_recompression.WordCutter(), {}
    texts = [(t or "").encode() for t in TEXTS]
    for size in (1, 66):
        for k in range(0, len(texts), size):
            for i, start, n, name, _ in zip(*cutter.runs(texts[k : k + size]), strict=True):
                w = texts[k + i].split()
                for p in range(start, start + n):
                    assert owner.setdefault(b" ".join(w[p : p + 20]), name) == name


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, prints):
    parent = dict(zip(ids, ids))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in zip(ids, prints):
        for j, b in zip(ids, prints):
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("heavy", [64, 0])
def test_fingerprints_and_links(spark, heavy):
    centre = random.getrandbits(64)
    prints = sorted({centre ^ (1 << random.randrange(64)) ^ (1 << random.randrange(64)) for _ in range(60)} | {random.getrandbits(64) for _ in range(60)})
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)]
    found = simhash.links(spark.createDataFrame(rows, "fp long, id long"), heavy).collect()
    parent = {i: i for i in range(len(prints))}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        assert (prints[a] ^ prints[b]).bit_count() <= 2
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    assert {i: root(i) for i in parent} == brute_components(list(range(len(prints))), prints)


def test_near_duplicates_of_odd_rows(odd, nothing, folder):
    got = {r.doc_id: r for r in simhash.near_duplicates(odd, folder).collect()}
    prints = {r.doc_id: brute_fingerprint(r.text) for r in odd.collect()}
    assert {i: int(r.fingerprint, 16) for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == brute_components(list(prints), list(prints.values()))
    assert simhash.near_duplicates(nothing, folder + "-e").count() == 0


@pytest.mark.parametrize("most", [0, 10_000])
def test_components(spark, folder, monkeypatch, most):
    monkeypatch.setattr(components, "ONE_TASK", most)
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, i) for i in range(51, 80)] + [(80, 79), (7, 7), (90, 91), (91, 90)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), folder).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 50 for i in range(50, 81)}, 90: 90, 91: 90}


def test_recordings_align(spark, folder):
    t, rng = np.arange(80000) / 8000, np.random.default_rng(1)
    tune = lambda seed: np.concatenate([np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t[:800]) for k in np.random.default_rng(seed).integers(0, 24, 60)])
    pcm = lambda y: np.clip(128 + 100 * y, 0, 255).astype(np.uint8).tobytes()
    x = tune(1)
    rows = [(50, pcm(x)), (51, pcm(x[6400:] + 0.01 * rng.normal(size=len(x) - 6400))), (52, pcm(tune(2))), (53, pcm(x)), (54, b""), (55, None), (None, pcm(x)), (56, b"ab")]
    got = chroma.align(spark.createDataFrame(rows, "doc_id long, samples binary"), folder, chroma.F.col("doc_id") % 50 == 0).collect()
    copies = {r.doc_id: r.match_id for r in got if r.relation == "copy"}
    assert copies == {50: 50, 51: 51, 52: 52, 53: 50, 54: 54, 55: 54, 56: 56}
    longest = max((r for r in got if r.relation == "aligned"), key=lambda r: r.overlap)  # two tunes may share a phrase
    assert (longest.doc_id, longest.match_id, longest.offset) == (50, 51, -100) and longest.overlap > 500
    assert chroma.align(spark.createDataFrame([], "doc_id long, samples binary, fp long, rec string"), f"{folder}-e", chroma.F.col("doc_id") % 50 == 0).count() == 0


def test_alignments_against_brute_force(spark, folder):
    rng, base = np.random.default_rng(4), np.random.default_rng(5).integers(0, 256, 12_000)
    rows = []
    for i in range(40):  # noise, with stretches of one recording under more noise
        y = rng.integers(0, 256, 6_000 + 64 * int(rng.integers(0, 60)))
        if i % 3 == 0:
            at, to = 64 * int(rng.integers(0, 40)), 64 * int(rng.integers(0, 10))
            y[to : to + 4_000] = np.clip(base[at : at + 4_000] + rng.normal(0, 12, 4_000), 0, 255)
        rows.append((i, y.astype(np.uint8).tobytes()))
    prints = {i: chroma.fingerprint(np.frombuffer(x, dtype=np.uint8)) for i, x in rows}
    want = {(q, r) for q in range(0, 40, 3) for r in range(40) if q != r and any(chroma.stretch(prints[q], prints[r], o, chroma.MAX_ERROR) for o in range(-len(prints[q]), len(prints[r])))}
    got = {(r.doc_id, r.match_id) for r in chroma.align(spark.createDataFrame(rows, "doc_id long, samples binary"), folder, chroma.F.col("doc_id") % 3 == 0).filter("relation = 'aligned'").collect()}
    assert len(want) > 20 and got <= want and len(got) >= 0.9 * len(want)


def test_a_sound_that_all_share_is_not_given_by_pairs(spark, folder, monkeypatch):
    monkeypatch.setattr(chroma, "COMMON", 8)
    rng, theme = np.random.default_rng(6), np.random.default_rng(7).integers(0, 256, 5_000)
    rows = [(i, np.concatenate((theme, rng.integers(0, 256, 3_000))).astype(np.uint8).tobytes()) for i in range(30)]
    got = chroma.align(spark.createDataFrame(rows, "doc_id long, samples binary"), folder, chroma.F.col("doc_id") % 2 == 0).filter("relation <> 'copy'").collect()
    assert {(r.doc_id, r.match_id) for r in got if r.relation == "common"} >= {(i, 0) for i in range(1, 30)}
    assert len(got) < 30 * 8


def test_common_landmarks_lose_no_pair_that_their_hub_does_not_align_with(spark, folder, monkeypatch):
    rng = np.random.default_rng(8)
    numbers = lambda n: rng.integers(-(1 << 31), 1 << 31, n)
    shared = numbers(34)
    piece = lambda k: shared[[0, 6, 12, 18, 23][k % 5] :][:11]  # noqa: E731  # too few to align
    fps = {i: np.concatenate((numbers(10), piece(i), numbers(30), piece(i + 2), numbers(10))) for i in range(25)}
    fps |= {i: np.concatenate((numbers(20), shared, numbers(20))) for i in (40, 45)}
    monkeypatch.setattr(chroma, "COMMON", 8)
    monkeypatch.setattr(chroma, "fingerprints", lambda *_: spark.createDataFrame([(i, x.tolist()) for i, x in fps.items()], "rec long, fp array<int>"))
    media = spark.createDataFrame([(i, bytes([i])) for i in fps], "doc_id long, samples binary")
    got = chroma.align(media, folder, chroma.F.col("doc_id") % 2 == 0).filter("relation <> 'copy'").collect()
    assert [(r.doc_id, r.relation, r.match_id, r.offset) for r in got] == [(40, "aligned", 45, 0)]


def test_stretches_on_arrays_are_those_of_single_pairs(monkeypatch):
    monkeypatch.setattr(chroma, "LOOK", 100)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 32, 90, dtype=np.uint32)
    noisy = lambda x: x ^ np.bitwise_or.reduce(np.uint32(1) << rng.integers(0, 32, (len(x), 8)).astype(np.uint32), axis=1)
    start = rng.integers(0, 40, 40)
    some = [noisy(base[a : a + n]) for a, n in zip(start.tolist(), rng.integers(8, 50, 40).tolist(), strict=True)]
    flat, size = np.concatenate(some), np.array([len(x) for x in some])
    i, j, offset = rng.integers(0, 40, 600), rng.integers(0, 40, 600), rng.integers(-45, 45, 600)
    offset[::2] = (start[i] - start[j])[::2]
    got = chroma._stretches(*((flat, (np.cumsum(size) - size)[k], size[k]) for k in (i, j)), offset, 0.4).tolist()
    want = [chroma.stretch(some[a], some[b], o, 0.4) is not None for a, b, o in zip(i.tolist(), j.tolist(), offset.tolist(), strict=True)]
    assert got == want and 5 < sum(want) < 595


@pytest.mark.parametrize("slots", [1, 1 << 20])
def test_rows_without_partners_are_told_apart(spark, monkeypatch, slots):
    monkeypatch.setattr(common, "SLOTS", slots)
    rows = spark.createDataFrame([(i % 50, i, str(i)) for i in range(100)] + [(None, 1, "n")], "doc_id int, part long, text string")
    keys = spark.createDataFrame([(i, i) for i in range(0, 40, 4)] + [(3, 4), (None, 1)], "doc_id long, part int")
    on = ["doc_id", "part"]
    free, rest = common.apart(rows, keys, on)
    assert free.columns == rest.columns == rows.columns
    assert sorted(r.text for r in free.unionByName(rest).collect()) == sorted(r.text for r in rows.collect())
    gone = {str(i) for i in range(0, 40, 4)}
    assert gone <= {r.text for r in rest.collect()} and (slots > 1 or free.isEmpty())
    assert {r.text for r in common.without(rows, keys, on).collect()} == {r.text for r in rows.collect()} - gone


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    rng, cutter = random.Random(3), substring_recompression.WordCutter(3)
    n = [rng.randint(1, 9) for _ in range(30)]
    pieces = [b" ".join(rng.choice([b"a", b"bb", b"\xc3\xa9"]) for _ in range(k + 2)) for k in n]
    group = np.sort([rng.randint(-3, 3) for _ in n])
    seen, want = set(), []
    for g, piece, k in zip(group.tolist(), pieces, n, strict=True):
        words = piece.split(b" ")
        for i in range(k):
            window = g, *words[i : i + 3]
            want.append(window in seen)
            seen.add(window)
    assert cutter.repeated(group, pieces, np.array(n)).tolist() == want
    monkeypatch.setattr(substring_recompression, "mix", lambda x: x & np.uint64(3))
    assert cutter.repeated(group, pieces, np.array(n)).tolist() == want
