"""Near duplicates, line dedup, passages, repeated bytes and benchmark windows against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from samples import collected, frame, lower, rows, spaced

from geoalbums.llm.components import components
from geoalbums.llm.decontaminate import decontaminate
from geoalbums.llm.line_dedup import _all_candidates, _candidates, _entries, _lists, _rarity, _sets, cut_lines, dedup_lines
from geoalbums.llm.near_duplicates import NearDuplicateConfig, _counted_parts, _families, _parts, near_duplicates, sketches
from geoalbums.llm.passages import PassageConfig, alike, compact_windows, near_duplicate_passages
from geoalbums.llm.repeated_bytes import remove_repeats


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def shingle_sets(k):
    out = []
    for r in rows():
        w = spaced(lower(r[1]))
        out.append(set(zip(*[w[i:] for i in range(k)])) if len(w) >= k else ({tuple(w)} if w else set()))
    return out


def expected_components(k, percent):
    ids, sets = [r[0] for r in rows()], shingle_sets(k)
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if ids[i] is None or ids[j] is None:
                continue
            both = len(sets[i] & sets[j])
            linked = sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j])
            if linked or ids[i] == ids[j]:
                parent[find(i)] = find(j)
    lowest = collections.defaultdict(list)
    for i, doc in enumerate(ids):
        lowest[find(i)].append(doc)
    out = []
    for i, doc in enumerate(ids):
        found = None if doc is None else min(lowest[find(i)])
        out.append((doc, len(sets[i]), found, doc == found if doc is not None else True))
    return sorted(out, key=repr)


def test_near_duplicates(docs):
    cfg = NearDuplicateConfig(shingle=3, percent=85)
    found = collected(near_duplicates(docs, cfg), "doc_id", "n_shingles", "component_id", "kept")
    assert found == expected_components(cfg.shingle, cfg.percent)
    assert sum(not r[3] for r in found) >= 20


def test_near_duplicates_branched(docs):
    """With nodes of a few documents at most all groups are branched: no false link, few missed."""
    cfg = NearDuplicateConfig(node_rows=3, group_shingles=400, group_least=3)
    found = collected(near_duplicates(docs, cfg), "doc_id", "n_shingles", "component_id", "kept")
    expected = expected_components(cfg.shingle, cfg.percent)
    lowest = {r[0]: r[2] for r in expected}
    assert all(lowest[r[0]] == lowest[r[2]] for r in found if r[0] is not None)
    assert sum(x == y for x, y in zip(found, expected)) >= 0.9 * len(expected)


def test_near_duplicates_star(spark):
    """One original with copies, each linked with it and, in general, with no other copy: all are found
    though the group is branched deeply."""
    rng = random.Random(7)
    original = [f"w{i}" for i in range(304)]
    data = [(0, " ".join(original))]
    for doc in range(1, 241):
        copy = list(original)
        for at in rng.sample(range(3, 300, 11), 5):
            copy[at] = f"x{doc}_{at}"
        data.append((doc, " ".join(copy)))
    cfg = NearDuplicateConfig(percent=84, group_shingles=1500)
    found = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), cfg).collect()
    assert len(found) == len(data) and all(r["component_id"] == 0 for r in found)


def test_near_duplicates_beyond_the_limits(spark):
    """A chain whose neighbours alone are alike: no link is lost, however small nodes and groups are."""
    words = [f"w{i}" for i in range(600)]
    data = [(doc, " ".join(words[4 * doc : 4 * doc + 56])) for doc in range(120)]  # 50 of 58 shingles: 0.862 alike
    cfg = NearDuplicateConfig(shingle=3, percent=85, node_rows=1, group_shingles=120, group_least=2)
    found = near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), cfg).collect()
    assert len(found) == 120 and all(r["component_id"] == 0 for r in found)


def test_parts_of_linked_sets():
    """Sets of the threshold's similarity have a part in common, at sizes around those of all classes."""
    rng = np.random.default_rng(3)
    for percent in (60, 85):
        cfg = NearDuplicateConfig(percent=percent)
        for size in [*range(1, 60), 99, 100, 101, 333, 1000]:
            for left in {size * percent // 100 + (size * percent % 100 > 0), (size * percent // 100 + size) // 2 + 1}:
                whole = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
                part = np.sort(rng.choice(whole, min(left, size), replace=False))
                grown = np.unique(np.append(part, rng.integers(0, 1 << 64, (100 * left - percent * size) // percent, dtype=np.uint64)))
                for other in (part, grown):
                    if len(other) == size and (other == whole).all():
                        continue
                    text, signature = _parts(np.concatenate([whole, other]), np.array([0, size, size + len(other)]), cfg)
                    assert set(signature[text == 0]) & set(signature[text == 1])


def test_linked_sets_share_as_many_parts_as_counted():
    """In a class that both have parts in, and that the search for families relies on."""
    rng = np.random.default_rng(4)
    for percent in (60, 80, 85):
        cfg = NearDuplicateConfig(percent=percent)
        for size in [*range(2, 60, 3), 99, 100, 333, 1000]:
            left = size * percent // 100 + (size * percent % 100 > 0)
            whole = np.unique(rng.integers(0, 1 << 64, size, dtype=np.uint64))
            other = np.sort(rng.choice(whole, left, replace=False))
            if left == size:
                continue
            text, signature, cls, least = _counted_parts(np.concatenate([whole, other]), np.array([0, size, size + left]), cfg)
            of = [{c: set(signature[(text == t) & (cls == c)]) for c in set(cls)} for t in (0, 1)]
            need = {c: max(least[cls == c]) for c in set(cls)}
            assert any(len(of[0][c] & of[1][c]) >= need[c] for c in need)


def test_common_passage_makes_no_family(spark):
    """Half of each text is the same: some parts are, but not as many as linked texts share."""
    same = " ".join(f"w{i}" for i in range(52))
    data = [(doc, same + " " + " ".join(f"x{doc}_{i}" for i in range(50))) for doc in range(40)]
    docs, cfg = spark.createDataFrame(data, "doc_id long, text string"), NearDuplicateConfig(shingle=3, percent=85)
    classes = sketches(docs, cfg).withColumnRenamed("doc_id", "rep")
    assert _families(docs, classes, spark.createDataFrame([], "node long, label long"), cfg).count() == 0


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 4), (10, 11), (11, 10), (7, 7), (30, 20), (25, 20)] + [(100 + i, 101 + i) for i in range(40)]
    found = dict(collected(components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 20: 20, 25: 20, 30: 20} | {100 + i: 100 for i in range(41)}


@pytest.mark.parametrize("links_of_a_task", [1 << 16, 50, 3])
def test_components_contracted(spark, monkeypatch, links_of_a_task):
    monkeypatch.setitem(components.__globals__, "TASK_LINKS", links_of_a_task)
    order = list(range(200))
    random.Random(5).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(199) if i % 20 != 19] * 2 + [(7, 7), (None, 3)]
    sc = spark.sparkContext
    sc.setJobGroup("contracted", "contracted")
    found = dict(collected(components(spark.createDataFrame(links, "a long, b long")), "node", "label"))
    jobs = len(sc.statusTracker().getJobIdsForGroup("contracted"))
    sc._jsc.clearJobGroup()
    assert found == {node: min(order[i : i + 20]) for i in range(0, 200, 20) for node in order[i : i + 20]}
    if links_of_a_task > len(links):
        assert jobs <= 8  # rounds over the links take more


def expected_lines():
    data = {(r[0], r[1]) for r in rows()}
    order = sorted(data, key=lambda r: (r[0] is None, r[0] or 0))
    first, seen = {}, []
    for doc, text in order:
        for number, line in enumerate((text or "").split("\n")):
            w = frozenset(spaced(lower(line)))
            if w:
                seen.append(((doc, text), number, w))
                first.setdefault(w, len(seen) - 1)
    classes = sorted(first, key=first.get)
    gone = set()
    for i, y in enumerate(classes):
        if any(10 * len(x & y) >= 8 * len(x | y) for x in classes[:i]):
            gone.add(y)
    removed = collections.defaultdict(list)
    count = collections.Counter()
    for i, (doc, number, w) in enumerate(seen):
        count[doc] += 1
        if first[w] != i or w in gone:
            removed[doc].append(number)
    return removed, count


def test_line_dedup(docs):
    # where different texts have one doc_id, which of them is first isn't told
    removed, count = expected_lines()
    found = {(r["doc_id"], r["n_lines"], r["n_removed"], tuple(sorted(r["removed_lines"]))) for r in dedup_lines(docs).collect()}
    expected = {(d[0], count[d], len(removed[d]), tuple(removed[d])) for d in {(r[0], r[1]) for r in rows()}}
    assert {x for x in found if x[0] != 1004} == {x for x in expected if x[0] != 1004}
    assert dedup_lines(docs).count() == len(rows())


def test_cut_lines(docs):
    removed, count = expected_lines()
    found = {(r["doc_id"], r["text"]) for r in cut_lines(docs).collect() if r["doc_id"] != 1004}
    expected = set()
    for doc in {(r[0], r[1]) for r in rows()}:
        if doc[0] != 1004 and (not count[doc] or len(removed[doc]) < count[doc]):
            lines = (doc[1] or "").split("\n")
            expected.add((doc[0], doc[1] and "\n".join(x for i, x in enumerate(lines) if i not in removed[doc])))
    assert found == expected
    assert cut_lines(docs).columns == docs.columns


def long_lines(seed=5):
    """Lines of 20 to 250 words of one small vocabulary, some of them with variants."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(900)]
    out = []
    for i in range(90):
        line = rng.sample(vocabulary, (20, 39, 40, 41, 60, 90, 150, 200, 250)[i % 9])
        out.append(line)
        for kept in rng.sample((70, 80, 90, 95), 2) if i % 3 == 0 else ():
            n = len(line) * kept // 100
            out.append(rng.sample(line, n) + rng.sample(vocabulary, rng.randrange(1, 3)))
    rng.shuffle(out)
    return out


def test_long_unlike_lines_are_no_candidates(spark):
    lines = long_lines()
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(lines)], "doc_id long, text string").repartition(3)
    sets = [set(w) for w in lines]

    def likeness(i, j):
        return len(sets[i] & sets[j]) / len(sets[i] | sets[j])

    rarity = _rarity(docs)
    numbered = {r["lines"][0]["cls"]: r["doc_id"] for r in _lists(docs).collect()}
    met = [(numbered[r["cls"]], numbered[r["x_cls"]]) for r in _candidates(_entries(docs, rarity, 80), 80).collect()]
    assert met and all(likeness(i, j) > 0.5 for i, j in met)
    every = docs.select("doc_id").join(spark.createDataFrame([(d, c) for c, d in numbered.items()], "doc_id long, cls long"), "doc_id")
    spots = {r["cls"]: r["spot"] for r in _sets(docs, np.full(1 << 15, -1, np.int64).astype(np.uint32)).collect()}
    spots = spark.createDataFrame(list(spots.items()), "cls long, spot long")
    more = _all_candidates(every.join(spots, "cls").select("cls", "spot"), docs, rarity, 80).collect()
    pairs = {(numbered[r["cls"]], numbered[r["x_cls"]]) for r in more}
    alike_ones = {(i, j) for i in range(len(sets)) for j in range(i) if likeness(i, j) >= 0.8}
    assert alike_ones <= pairs and all(likeness(i, j) > 0.5 for i, j in pairs)
    gone = {r["doc_id"] for r in dedup_lines(docs).collect() if r["n_removed"]}
    assert gone == {i for i, _ in alike_ones}


def test_repeated_bytes(docs):
    length = 150
    data = [(r[0], (r[1] or "").encode()) for r in rows()]
    count = collections.Counter(t[s : s + length] for _, t in data for s in range(len(t) - length + 1))
    expected = []
    for doc, t in data:
        covered = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - length + 1):
            if count[t[s : s + length]] > 1:
                covered[s : s + length] = True
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = np.frombuffer(t, dtype=np.uint8)[~covered].tobytes()
        expected.append((doc, len(t), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
    out = remove_repeats(docs, length, with_bytes=True)
    found = [(*r[:5], bytes(r[5])) for r in collected(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "bytes")]
    assert found == sorted(expected, key=repr)
    assert sum(r[2] for r in found) > 5000


def test_constant_and_periodic_bytes(spark):
    data = [(1, "a" * 3000), (2, "a" * 900 + "b"), (3, "xyz" * 500), (4, "b" + "c" * 399), (5, "c" * 400)]
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(data, "doc_id int, text string")).collect()}
    assert found == {1: (3000, 3000), 2: (901, 900), 3: (1500, 1500), 4: (400, 0), 5: (400, 0)}


def test_decontamination(spark, docs):
    first = spaced(rows()[2][1])
    items = [
        (1, " ".join(first[3:25])), (2, "nothing of this is there at all in any of the texts"), (3, " ".join(first[8:12])), (4, "thethe"),
        (10, " ".join(first[3:25])), (5, None), (6, ""), (None, " ".join(spaced(rows()[5][1])[:12])), (7, "Buy now"), (8, "!!"),
    ]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows, lengths = collections.defaultdict(set), set()
    for item, text in items:
        w = re.findall(pattern, lower(text))
        n = min(10, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(item)
            lengths.add(n)
    expected = []
    for r in rows():
        w, hit, names = re.findall(pattern, lower(r[1])), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    names |= windows[tuple(w[s : s + n])]
        names = sorted(str(x) for x in names if x is not None)
        expected.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = collected(decontaminate(docs, bench), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == sorted(expected, key=repr)
    assert sum(r[5] for r in found) > 3


def test_compact_windows():
    rng = np.random.default_rng(3)
    hashed = rng.integers(0, 30, 200).astype(np.uint64) << np.uint64(40)
    first = np.array([0, 70, 70, 75, 200])
    low, centre, high, owner = compact_windows(hashed, first, 12)
    less = [(int(h), -i) for i, h in enumerate(hashed)]
    expected = set()
    for a, b in zip(first[:-1], first[1:]):
        for c in range(a, b):
            x = y = c
            while x > a and less[x - 1] > less[c]:
                x -= 1
            while y < b and less[y] >= less[c]:
                y += 1
            if y - x >= 12:
                expected.add((x, c, y))
    assert set(zip(low.tolist(), centre.tolist(), high.tolist())) == expected
    for s in range(200):
        inside = any(a <= s and s + 12 <= b for a, b in zip(first[:-1], first[1:]))
        assert (owner[s] >= 0) == inside
        if inside:
            assert centre[owner[s]] == min(range(s, s + 12), key=lambda i: less[i])


def test_alike():
    x = np.arange(100, dtype=np.int32)
    y = np.concatenate([np.arange(1000, 1010), np.arange(20, 90)]).astype(np.int32)
    assert alike(x, y, 50, 40, 46, 80) == [(12, 90)]
    y[40:60] = -1
    assert alike(x, y, 30, 20, 46, 80) == []


def test_passages(docs):
    """Words of any 50-word sequence that another text has too are all marked; unlike texts aren't."""
    found = collections.defaultdict(list)
    for r in near_duplicate_passages(docs).collect():
        found[r["doc_id"]].append(r)
    data = [(r[0], tuple(spaced(lower(r[1])))) for r in rows()]
    where = collections.defaultdict(set)
    for i, (_, w) in enumerate(data):
        for s in range(len(w) - 49):
            where[w[s : s + 50]].add(i)
    for i, (doc, w) in enumerate(data):
        covered = np.zeros(len(w), dtype=bool)
        for s in range(len(w) - 49):
            if len(where[w[s : s + 50]]) > 1:
                covered[s : s + 50] = True
        options = []
        for r in found[doc]:
            marked = np.zeros(max(r["n_words"], len(w)), dtype=bool)
            for span in r["spans"]:
                marked[span["low"] : span["high"]] = True
            if r["n_words"] == len(w):
                assert r["n_alike"] == marked.sum()
                options.append(bool(marked[: len(w)][covered].all()))
        assert any(options), doc
    assert all(r["n_alike"] == 0 for r in found[1000] + found[1001] + found[1002] + found[-5])


def test_near_passages_are_found(spark):
    from samples import prose, words

    import random

    rng = random.Random(4)
    data, planted = [], 0
    for i in range(30):
        w = words(rng, "en", 120)
        edited = list(w)
        edited[60] = "edited"
        data.append((2 * i, prose(rng, "de", 60) + "\n" + " ".join(w) + "\n" + prose(rng, "fr", 40)))
        data.append((2 * i + 1, prose(rng, "fr", 50) + "\n" + " ".join(edited)))
        planted += 2
    out = near_duplicate_passages(spark.createDataFrame(data, "doc_id long, text string"), PassageConfig()).collect()
    assert sum(r["n_alike"] >= 110 for r in out) >= 0.9 * planted


def alike_by_hand(data, cfg, longest):
    """Per text, the words inside passages that are alike in another text, by looking at all of them up to a length."""
    names = collections.defaultdict(lambda: len(names))
    tokens = [np.array([names[t] for t in zip(*[w[i:] for i in range(cfg.shingle)])]) for w in data]
    marked = [np.zeros(len(w), dtype=bool) for w in data]
    for a, x in enumerate(tokens):
        for b, y in enumerate(tokens):
            if data[a] == data[b]:
                continue
            for move in range(cfg.tokens - len(x), len(y) - cfg.tokens + 1):
                low, high = max(0, -move), min(len(x), len(y) - move)
                same = x[low:high] == y[low + move : high + move]
                if (100 + cfg.percent) * same.sum() < 2 * cfg.percent * cfg.tokens:
                    continue
                total = np.concatenate([[0], np.cumsum(same)])
                for n in range(cfg.tokens, min(longest, len(same)) + 1):
                    m = total[n:] - total[:-n]
                    for s in np.flatnonzero(100 * m >= cfg.percent * (2 * n - m)):
                        marked[a][low + s : low + s + n + cfg.shingle - 1] = True
    return [int(m.sum()) for m in marked]


@pytest.mark.parametrize("group_rows", [2048, 2])
def test_no_alike_passage_is_left_out(spark, group_rows):
    """One to three changed words, wherever they are, in passages of 50 to 140 words; cells of one seed in one part
    or in many."""
    from samples import words

    rng = random.Random(11)
    data = []
    for size in (50, 50, 50, 60, 70, 95, 140):
        passage = words(rng, "en", size)
        for copy in range(4):
            edited = list(passage)
            for _ in range(rng.randrange(1, 2 + size // 50)):
                edited[rng.randrange(size)] = f"edited{copy}"
            data.append(words(rng, "de", rng.randrange(5, 40)) + edited + words(rng, "fr", rng.randrange(5, 40)))
    halves = words(rng, "en", 120)
    for at in range(1, 120, 17):  # the same line before, behind and between others
        data.append(words(rng, "de", at % 30) + halves[:at] + words(rng, "fr", 3) + halves[at:])
    middle = words(rng, "en", 50)
    for changed in (None, 25):
        data.append([w if i != changed else "changed" for i, w in enumerate(middle)])
    cfg = PassageConfig(group_rows=group_rows)
    rows_of = [(i, " ".join(w)) for i, w in enumerate(data)]
    found = near_duplicate_passages(spark.createDataFrame(rows_of, "doc_id long, text string"), cfg).collect()
    least, most = alike_by_hand(data, cfg, cfg.longest), alike_by_hand(data, cfg, 1000)
    n_alike = {r["doc_id"]: r["n_alike"] for r in found}
    assert len(n_alike) == len(data) and all(least[i] <= n <= most[i] for i, n in n_alike.items())
    assert n_alike[len(data) - 2] == n_alike[len(data) - 1] == 50
    assert sum(x == y for x, y in zip(least, most)) > len(data) / 2


def test_passages_of_many_blocks(spark):
    """Cells that have some 300 blocks in common are compared like those that have few."""
    from samples import words

    rng = random.Random(12)
    text = words(rng, "en", 1500)
    cfg = PassageConfig(words=700)
    data = [(i, " ".join(text[:750] + changed + text[751:])) for i, changed in enumerate((["one"], ["two"]))]
    found = near_duplicate_passages(spark.createDataFrame(data, "doc_id long, text string"), cfg).collect()
    assert cfg.blocks > 300 - 256 and {(r["doc_id"], r["n_alike"]) for r in found} == {(0, 1500), (1, 1500)}


def test_runs_of_alike_passages():
    """Any passage at the threshold whose unlike tokens come from changed words has a run."""
    cfg = PassageConfig()
    assert cfg.run == 21
    rng = random.Random(2)
    for _ in range(20000):
        n = rng.randrange(cfg.tokens, cfg.longest + 1)
        same = np.ones(n, dtype=bool)
        for _ in range(rng.randrange(1, 5)):
            word = rng.randrange(n + cfg.shingle - 1)
            same[max(0, word - cfg.shingle + 1) : word + 1] = False
        if (100 + cfg.percent) * same.sum() >= 2 * cfg.percent * n:
            edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(int), [0]])))
            assert max(edges[1::2] - edges[::2]) >= cfg.run


@pytest.mark.parametrize("apply", [
    near_duplicates, dedup_lines, cut_lines, remove_repeats, near_duplicate_passages,
    lambda d: decontaminate(d, d.selectExpr("doc_id AS item_id", "text")),
])
def test_empty_tables(spark, apply):
    assert apply(frame(spark, [])).collect() == []
