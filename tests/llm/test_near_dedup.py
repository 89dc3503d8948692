import math
import pathlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import near_dedup as nd
from tidewater.llm.base import scratch_root

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def shingle_set(text):
    return set(shingles(text))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes_of(n, pairs):
    top = list(range(n))

    def find(i):
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    return [find(i) for i in range(n)]


def weighted(texts):
    """Brute force: the weights of each text's shingles, by the formula in the module's docstring."""
    sets = [shingles(t) for t in texts]
    df = Counter(x for s in sets for x in s)
    idf = {x: 0.5 + 0.5 * min(1, math.log(len(texts) / d) / math.log(100)) for x, d in df.items()}
    return [{x: (1.25 - 0.25 / n) * idf[x] for x, n in s.items()} for s in sets]


def weighted_jaccard(a, b):
    if not a or not b:
        return float(not a and not b)
    shared = sum(min(w, b[x]) for x, w in a.items() if x in b)
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def all_pairs(texts):
    """The similarity of every two texts that share a shingle or have none."""
    sets, where, seen = weighted(texts), defaultdict(list), set()
    for i, s in enumerate(sets):
        for x in s or [()]:
            where[x].append(i)
    for ids in where.values():
        seen.update((a, b) for k, a in enumerate(ids) for b in ids[k + 1 :])
    return {(a, b): weighted_jaccard(sets[a], sets[b]) for a, b in seen}


def test_query_on_whole_table_has_all_links_and_no_others(spark):
    got = nd.op6_near_dedup(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert Counter(r.doc_id for r in got) == Counter(list(docs))
    of = {r.doc_id: r.class_id for r in got}
    ids = sorted(docs)
    pairs = all_pairs([docs[i] for i in ids])
    near = [p for p, x in pairs.items() if x >= 0.8]
    assert len(near) > 50 and [ids[c] for c in classes_of(len(ids), near)] == [of[i] for i in ids]
    size = Counter(of.values())
    assert all(r.class_size == size[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_shingles_like_dictionaries(docs):
    texts = ["", "a", "a b", "A B c D", "a b c d e", "a b c d e f a b c d e", "\u00c9 \u00e9", "a  b\nc d e", "  x\n"] + [r.text or "" for r in docs.limit(80).collect()]
    h, tf, bounds, nodes = nd.shingle_sets(pa.array(["zz"] + texts)[1:])
    hash_of = {}
    for i, t in enumerate(texts):
        own = dict(zip(h[bounds[i] : bounds[i + 1]].tolist(), tf[bounds[i] : bounds[i + 1]].tolist()))
        assert list(own) == sorted(own) and sorted(own.values()) == sorted(shingles(t).values())
        if len(own) == 1:
            assert hash_of.setdefault(next(iter(shingles(t))), next(iter(own))) == next(iter(own))
    assert nodes[4] == nodes[7] and len({nodes[i] for i in range(7)}) == 7
    some, often, at = nd._unpacked(pa.array([nd._packed(h[:5]), b"", nd._packed(h[5:7])], pa.binary()), pa.array([b"", b"", np.array([3, 1], "<u4").tobytes()], pa.binary()))
    assert some.tolist() == h[:7].tolist() and often.tolist() == [1] * 5 + [3, 1] and at.tolist() == [0, 5, 5, 7]


@pytest.mark.parametrize("choice", [[1.0], [1.0, 0.5, 0.7, 1.25], [0.5, 0.6]])
def test_sampling_estimates_weighted_jaccard(choice):
    rng = np.random.default_rng(0)
    off = []
    for _ in range(40):
        h = np.unique(rng.integers(0, 2**48, 1000).astype(np.uint64) << np.uint64(16))
        wa = rng.choice(choice, len(h)).astype(np.float32)
        wb = np.where(rng.random(len(h)) < 0.2, rng.choice(choice, len(h)), wa).astype(np.float32)
        wa[:100], wb[-100:] = 0, 0
        sides = [(h[w > 0], w[w > 0]) for w in (wa, wb)]
        # Both sets at once, and in parts.
        a, b = nd.samples(*(np.concatenate(x) for x in zip(*sides)), np.array([0, len(sides[0][0]), len(sides[0][0]) + len(sides[1][0])]))
        off.append((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_samples_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    h, w = rng.integers(0, 2**63, 5000).astype(np.uint64), rng.choice([1, 0.6, 1.2], 5000).astype(np.float32)
    bounds = np.array([0, 1, 900, 901, 4000, 5000])
    whole = nd.samples(h, w, bounds)
    monkeypatch.setattr(nd, "PART", 700)
    assert (nd.samples(h, w, bounds) == whole).all()
    assert (nd.samples(h[1:900], w[1:900], np.array([0, 899])) == whole[1]).all()


def test_blocks_are_compared_as_pairs_are():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(12)]
    sets = [(h, rng.choice([0.5, 1, 1.25], len(h)).astype(np.float32)) for h in sets]
    assert np.allclose(nd.block_similarity(sets[:5], sets[5:]), [[nd.similarity(a, b) for b in sets[5:]] for a in sets[:5]])


@pytest.mark.parametrize("block,share", [(256, 4 << 20), (7, 3000)])
def test_graded_group_and_copies(spark, monkeypatch, block, share):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "SHARE_BYTES", share)
    monkeypatch.setattr(nd, "HELD_BYTES", share)
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(5000)}" for _ in range(300)]
    texts = []
    for i in range(60):
        own = list(base)
        for _ in range(i // 6):
            own[rnd.randrange(300)] = f"x{i}_{rnd.randrange(9)}"
        texts.append(" ".join(own))
    texts += [texts[0], texts[0].replace(" ", "\n"), texts[5], "", None, " \t", "a b", "a b", "a c"] + [" ".join(f"v{rnd.randrange(9000)}" for _ in range(80)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in nd.near_classes(df).collect()}
    want = classes_of(len(texts), [p for p, x in all_pairs(texts).items() if x >= 0.8])
    assert [got[i] for i in range(len(texts))] == want and len(set(want[:60])) > 5


def test_edges_and_empty(spark, edges, empty):
    got = nd.near_classes(edges, row_col="n").collect()
    assert len(got) == edges.count() and {r.row_id for r in got} == {1}
    by = {r.doc_id: r.class_id for r in got}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[None] is None
    got = nd.near_classes(edges).collect()
    assert Counter(r.class_id for r in got if r.kept) == Counter({r.class_id for r in got}) and len({r.row_id for r in got}) == len(got)
    assert nd.near_classes(empty).count() == 0


def test_nothing_is_left_behind(spark, edges):
    root = pathlib.Path(scratch_root(spark).removeprefix("file://"))
    before = set(root.iterdir())
    nd.near_classes(edges).collect()
    assert {p.name.rsplit("-", 1)[0] for p in set(root.iterdir()) - before} == {"near-rows", "near-outcome", "near-kept"}


def edited(words, places, name):
    own = list(words)
    for p in places:
        own[p] = f"{name}_{p}"
    return own


def hubs(groups, satellites=6):
    """Texts of 319 words around a hub that is the head of their buckets: only the first two are alike, at 0.8 exactly, the hub is at 0.775 at most to all."""
    rnd, texts = random.Random(11), []
    for g in range(groups):
        hub = [f"h{g}_{i}" for i in range(319)]
        places = [8 + 12 * i for i in range(25)]
        rnd.shuffle(places)
        common = edited(hub, places[:5], f"c{g}")
        texts += [edited(common, places[5:9], f"a{g}"), edited(common, places[9:12], f"b{g}"), hub]
        texts += [edited(hub, rnd.sample(places[12:], 8), f"s{g}_{k}") for k in range(satellites)]
    return [" ".join(t) for t in texts]


def test_members_that_no_head_joins_are_all_compared(spark):
    groups, each = 150, 9
    texts = hubs(groups)
    sets = [shingle_set(t) for t in texts[:each]]
    assert [(a, b) for b in range(each) for a in range(b) if jaccard(sets[a], sets[b]) >= 0.8] == [(0, 1)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[each * g] == got[each * g + 1] for g in range(groups))
    assert len(set(got.values())) == groups * (each - 1)


def test_texts_alike_but_for_repetition_are_linked(spark):
    rnd, texts = random.Random(5), []
    for g in range(60):
        words = [f"d{g}_{rnd.randrange(10**6)}" for _ in range(200)]
        line = words[40:60]
        texts += [" ".join(words), " ".join(words * 2), " ".join(words + line * 30)]
    sets = [shingle_set(t) for t in texts]
    assert all(jaccard(sets[g], sets[g + k]) >= 0.8 for g in range(0, len(texts), 3) for k in (1, 2))
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == [i - i % 3 for i in range(len(texts))]


def test_recall_just_above_the_threshold(spark):
    rnd, texts = random.Random(13), []
    for g in range(300):
        words = [f"r{g}_{i}" for i in range(319)]
        texts += [" ".join(words), " ".join(edited(words, rnd.sample(range(8, 312, 9), 6), f"e{g}"))]
    pairs = all_pairs(texts)
    assert len(pairs) == 300 and all(0.8 < x < 0.85 for x in pairs.values())
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert np.mean([got[a] == got[b] for a, b in pairs]) > 0.99


def test_a_pair_that_only_its_ends_can_join(spark):
    """x is alike to h and to y, which are not alike; h is the head of all buckets that they share."""
    rnd = random.Random(7)
    x = [f"x{i}" for i in range(400)]
    places = [20 + 24 * i for i in range(15)]
    common, own_h, own_y = places[:7], places[7], places[8]
    # h and y change eight words of x, seven of them in the same places, each in its own way.
    h, y = edited(x, [*common, own_h], "h"), edited(x, [*common, own_y], "y")
    texts = [" ".join(t) for t in (h, x, y)] + [" ".join(f"v{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(400)]
    pairs = {p: v for p, v in all_pairs(texts[:3] + texts[3:]).items() if max(p) < 3}
    assert pairs[0, 1] >= 0.8 and pairs[1, 2] >= 0.8 and pairs[0, 2] < 0.8
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[1] == got[2] == 0 and len(set(got.values())) == 401


def test_near_copies_of_a_third_of_all_rows(spark):
    """A group that a third of all rows are in: its texts are light, and near copies with a few edits are still linked."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(edited(base, rnd.sample(range(200), 2), f"e{i}")) for i in range(150)] + [" ".join(base)] * 20
    texts += [" ".join(f"v{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(330)]
    got = {r.doc_id: r.class_id for r in nd.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[i] == 0 for i in range(170)) and len(set(got.values())) == 331
