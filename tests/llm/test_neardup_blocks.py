"""Groups in which the members of unsettled buckets meet."""

import random
from collections import Counter, defaultdict
from itertools import combinations

from corpusctx.llm import neardup


def test_loose_members_meet_everyone_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    buckets = {
        1: [(i, 1) for i in range(1, 301)] + [(i, i) for i in range(301, 307)],  # a large component and six others
        2: [(i, i % 2) for i in range(5)],
        3: [(i, 1) for i in range(50)],  # settled
        4: [(i, i) for i in range(40)],
        5: [(i, 1 + i % 2) for i in range(60)],  # two components of the same size
    }
    rows = [(b, i, len(members) - 1, members[0][0], label) for b, members in buckets.items() for i, label in members]
    df = spark.createDataFrame(rows, "bucket long, doc_id long, mates long, hub long, label long")
    placed = neardup.unsettled_blocks(df).collect()
    groups = defaultdict(list)
    for r in placed:
        groups[r.bucket, r.low, r.high].append(r)
        assert r.block in (r.low, r.high) and r.is_hub == (r.doc_id == buckets[r.bucket][0][0]) and (r.doc_id, r.label) in buckets[r.bucket]
    for bucket, members in buckets.items():
        met = Counter()
        for (b, low, high), group in groups.items():
            if b == bucket:
                left, right = ([r for r in group if r.block == side] for side in (low, high))
                pairs = combinations(left, 2) if low == high else ((x, y) for x in left for y in right)
                met.update(tuple(sorted((x.doc_id, y.doc_id))) for x, y in pairs if x.label != y.label)
        different = [(a, b) for (a, x), (b, y) in combinations(members, 2) if x != y]
        assert met == Counter({tuple(sorted(p)): 1 for p in different})
    sizes = Counter(r.bucket for r in placed)
    assert sizes[1] <= 300 + 6 * 40 and sizes[2] == 5 and 3 not in sizes
    assert max(len(g) for g in groups.values()) <= 6 * 8


def test_links_across_blocks(spark, monkeypatch):
    """Members whose only link is to a document of another block."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for _ in range(160):
        body = list(base)
        for _ in range(rng.randrange(9)):
            body[rng.randrange(len(body))] = f"x{rng.randrange(10**6)}"
        texts.append(body)
    sets = [{tuple(b[i : i + 4]) for i in range(len(b) - 3)} for b in texts]
    label = list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            x, y = sorted((label[a], label[b]))
            label = [x if v == y else v for v in label]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(df, 4).collect()} == dict(enumerate(label))
