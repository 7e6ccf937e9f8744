"""Fingerprints, the conversation trie and whitening against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import collected, frame, lower, rows, spaced

from geoalbums.llm import fingerprints as fp
from geoalbums.llm.conversation_trie import TrieConfig, conversation_trie
from geoalbums.llm.spectrum import count_above, leading_eigenpairs
from geoalbums.llm.whitening import WhitenConfig, whiten

# --- fingerprints -----------------------------------------------------------------------------------


def shingle_set(text, k=5):
    w = spaced(lower(text))
    return set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_rows(data):
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5((r[1] or "").encode()).hexdigest()))
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        yield r[0], text, following, text[: len(text) - half] + following[:half]


@pytest.mark.parametrize("one_in", [1, 8])
def test_sketch_with_next(spark, one_in):
    data = rows()
    found = fp.sketch_with_next(frame(spark, data), fp.SketchConfig(one_in=one_in, chunk=7)).collect()
    expected = list(edited_rows(data))
    ours = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found), key=repr)
    assert ours == sorted(((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, _, e in expected), key=repr)
    truth = {
        (d, len(t), hashlib.sha256(e.encode()).hexdigest()): (
            jaccard(shingle_set(t), shingle_set(e)), jaccard(shingle_set(t), shingle_set(n)), t)
        for d, t, n, e in expected
    }
    near = []
    for r in found:
        edited, following, text = truth[r.doc_id, r.n_chars, r.edited_sha256]
        assert (r.fingerprint == "") == (not spaced(text))
        if one_in == 1:  # all hashes are kept: nothing is estimated
            assert math.isclose(r.near_edited, edited) and math.isclose(r.near_next, following)
        near.append((r.near_edited - edited, len(spaced(text))))
    assert np.mean([abs(e) for e, n in near if n > 60]) < 0.12
    by_text = {}
    for r in found:
        text = truth[r.doc_id, r.n_chars, r.edited_sha256][2]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint


def test_sketch_of_hot_id_and_small_tables(spark):
    schema = "doc_id long, text string, fingerprint string"
    assert fp.sketch_with_next(spark.createDataFrame([], schema)).count() == 0
    one = fp.sketch_with_next(spark.createDataFrame([(3, "abcdef", "x")], schema)).collect()
    assert [(r.doc_id, r.n_chars, r.near_next) for r in one] == [(3, 6, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    data = [(7, "the same row many times", None)] * 9000 + [(i, f"text {i} ü", None) for i in range(20)]
    data += [(None, f"no id {i % 50}", None) for i in range(100)]
    found = fp.sketch_with_next(spark.createDataFrame(data, schema).repartition(6))
    ours = sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in found.collect()), key=repr)
    assert ours == sorted(((d, len(t), hashlib.sha256(e.encode()).hexdigest()) for d, t, _, e in edited_rows(data)), key=repr)


def test_fingerprints_merge_and_contain(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    small = " ".join(word() for _ in range(400))
    large = " ".join(word() for _ in range(4000)) + " " + small
    data = [("small", small), ("large", large), ("both", large + "\n" + small), ("word", "one"), ("none", " "), ("null", None)]
    found = fp.fingerprints(spark.createDataFrame(data, "name string, text string"))
    prints = {r.name: r.fingerprint for r in found.collect()}
    assert prints["none"] == prints["null"] == ""
    pairs = [(a, b) for a in prints for b in prints]
    table = spark.createDataFrame([(a, b, prints[a], prints[b]) for a, b in pairs], "x string, y string, a string, b string")
    a, b = F.col("a"), F.col("b")
    got = table.select("x", "y", fp.merge(a, b).alias("m"), fp.likeness(a, b).alias("l"), fp.containment(a, b).alias("c"))
    got = {(r.x, r.y): r for r in got.collect()}
    assert got["small", "large"].c == 1.0 and got["large", "small"].c < 0.2 and got["small", "large"].l < 0.2
    assert got["word", "large"].m == prints["large"] and got["word", "none"].m == prints["word"]
    union = set(fp_hashes(prints["small"])) | set(fp_hashes(prints["large"]))
    assert fp_hashes(got["large", "small"].m) == sorted(union)
    assert got["none", "null"].l == 1.0 and got["none", "small"].l == 0.0


def fp_hashes(text):
    return [text[i : i + 12] for i in range(0, len(text), 12)]


# --- the trie of conversations ----------------------------------------------------------------------


def expected_trie(data):
    own = {}
    for conv, turn, role, text, *_ in data:
        if conv is not None:
            mark = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, mark), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        leaves, saved = int(path not in children), (len(members[path]) - 1) * (len(spaced(path[-1][1])) if path else 0)
        for child in children.get(path, []):
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for path, own_members in members.items():
        ends = sorted(c for c in own_members if built[c] == path)
        out.append((
            min(own_members), len(path), min(members[path[:-1]]) if path else None, len(own_members),
            len(children.get(path, [])), *below(path), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def talks(seed, convs=60):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("a bb ccc ü".split()) for _ in range(rng.randrange(1, 4)))
    data = []
    for c in range(convs):
        for t in range(rng.randrange(1, 40 if c % 9 == 0 else 7)):
            data.append((c, t, "user" if t % 2 else "bot", line() if rng.random() < 0.4 else "fixed"))
    data += [(c + 500, t, r, x) for c, t, r, x in data if c < 20]  # whole copies
    data += [(900 + c, t, "user", f"turn {t}") for c in range(30) for t in range(3 + 17 * (c == 4))]
    data += [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "user", None), (7, 2, "user", "tie"), (7, 2, "user", "tie")]
    data += [(-3, 1, "user", "below zero"), (-45, 0, "user", "x"), (2001, 1, "user", "short"), (2020, 5, None, "")]
    return [(*row, 1, "k", "d") for row in data]


TALKS = "conv_id long, turn long, role string, text string, depth int, key string, digest string"
TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("cfg", [TrieConfig(), TrieConfig(block=2, bounded_ends=3, broadcast_rows=0, hot_rows=5)])
def test_conversation_trie(spark, cfg):
    data = talks(3)
    found = conversation_trie(spark.createDataFrame(data, TALKS).repartition(5), cfg)
    assert collected(found, *TRIE) == expected_trie(data)


def test_conversation_trie_small(spark):
    assert conversation_trie(spark.createDataFrame([], TALKS)).count() == 0
    data = [(1, 0, "user", "a b", 1, "", "")]
    assert collected(conversation_trie(spark.createDataFrame(data, TALKS)), *TRIE) == expected_trie(data)


# --- whitening --------------------------------------------------------------------------------------


def test_count_above():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        a = rng.standard_normal((n, n))
        a += a.T
        values = np.linalg.eigvalsh(a)
        for shift in [*(values[:-1] + values[1:]) / 2, values[0] - 1, values[-1] + 1, 0.0]:
            assert count_above(a, shift) == (values > shift).sum()


@pytest.mark.parametrize(
    "spectrum",
    [
        np.arange(1, 41.0), np.r_[5.0, 5.0, 5.0, 4.0, 4.0, np.ones(30)], np.r_[1e6, 1.0, 1.0 - 1e-12, 1e-3, 0.0, 0.0],
        np.ones(6), np.r_[2.0, 2.0 - 3e-10, 1.0], 2.0 ** -np.arange(30), np.array([3.0]),
    ],
)
def test_leading_eigenpairs(spectrum):
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((len(spectrum),) * 2))[0]
    matrix = q @ np.diag(spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, vectors = leading_eigenpairs(matrix, 32)
    expected = np.sort(spectrum)[::-1][:32]
    expected = expected[expected > 1e-10 * expected[0]]
    assert np.allclose(values, expected, rtol=0, atol=1e-13 * len(spectrum) * expected[0])
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-6
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-12 * len(spectrum) * expected[0]


def whitened_by_numpy(data, components=32):
    usable = [(i, v) for i, v, *_ in data if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in usable])
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return usable, ((n * x - sums) ** 2).sum(axis=1), centred @ vectors / np.sqrt(values), values / np.trace(covariance)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 40)) @ rng.standard_normal((40, 40)) / 5
    data = [(int(i), [float(np.float32(c)) for c in v], 1.0) for i, v in enumerate(base)]
    data += [data[0]] * 60 + [(None, data[1][1], 1.0), (5, data[2][1], 1.0)]
    bad = [(900, None, 1.0), (901, [], 1.0), (902, [None] * 40, 1.0), (903, [float("nan")] + [0.1] * 39, 1.0), (904, [float("inf")] * 40, 1.0)]
    schema = "vec_id long, embedding array<float>, n double"
    found = whiten(spark.createDataFrame(data + bad + [(905, [0.5, 0.5], 1.0)], schema).repartition(5)).collect()
    usable, deviation, whitened, explained = whitened_by_numpy(data)
    assert len(found) == 32 * len(usable)
    assert {r.n for r in found} == {len(usable)} and {r.identity_error for r in found} == {found[0].identity_error}
    assert found[0].identity_error < 1e-9
    ours = {}
    for r in found:
        ours.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    signs = {}
    for (vec_id, _), d, w in zip(usable, deviation, whitened):
        for k in range(32):
            r = ours[vec_id, int(d)][k + 1][0]
            assert math.isclose(r.explained, explained[k], rel_tol=1e-9)
            assert math.isclose(abs(r.whitened), abs(w[k]), rel_tol=1e-6, abs_tol=1e-7)
            if abs(w[k]) > 1e-3:
                assert signs.setdefault(k, r.whitened * w[k] > 0) == (r.whitened * w[k] > 0)


def test_whiten_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    far = spark.createDataFrame([(1, [1e9, 0.0]), (2, [-1e9, 0.0]), (3, [0.0, 1.0])], schema)
    found = whiten(far, WhitenConfig(components=1)).collect()
    assert [r.deviation is None for r in found] == [True, True, False] and found[0].identity_error < 1e-6
