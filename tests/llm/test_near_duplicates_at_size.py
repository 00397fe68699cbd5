"""A large group of near copies: what its blocks say of a text is combined in a task."""

import numpy as np

from tessera.llm import near_duplicates as N


def bucket(spark, n):
    rows = [(k, 1, n, 100, bytearray(128)) for k in range(n)]
    return spark.createDataFrame(rows, "id bigint, node bigint, n bigint, size int, sketch binary")


def test_rows_of_a_large_bucket_do_not_grow_with_its_blocks(spark):
    got = N.compared(N.in_blocks(bucket(spark, 200), 8), 8, 0.8).collect()  # 25 blocks, 4 tasks
    assert {r.id for r in got} == set(range(200))
    assert len(got) <= 200 * 4
    assert abs(sum(r["all"] for r in got) - 200 * 199 / N.TREES) < 1e-6
    reach = np.arange(200)
    for _ in range(200):
        for r in got:
            reach[r.id] = reach[r.root] = min(reach[r.id], reach[r.root])
    assert not reach.any()


def test_combined_keeps_components_and_sums():
    ids, root = np.array([5, 7, 7, 9, 3]), np.array([5, 5, 2, 7, 3])
    got = N.combined(ids, root, np.arange(5.0), np.ones(5))
    assert [x.tolist() for x in got] == [[3, 5, 7, 9], [3, 2, 2, 2], [4.0, 0.0, 3.0, 3.0], [1.0, 1.0, 2.0, 1.0]]


def clusters(spark, sizes, strays, seed=1):
    """Texts (id, size, path, sketch) of a few groups of near copies and some that look like nothing, and their members in
    nodes, as (id, node, n)."""
    rng = np.random.default_rng(seed)
    texts, kind = [], []
    for c, n in enumerate(sizes):
        base = rng.integers(0, 256, 128, dtype=np.uint8)
        for _ in range(n):
            own = np.where(rng.random(128) < 0.12, rng.integers(0, 256, 128), base).astype(np.uint8)
            texts.append(own.tobytes())
            kind.append(c)
    texts += [rng.integers(0, 256, 128, dtype=np.uint8).tobytes() for _ in range(strays)]
    ids = rng.permutation(len(texts)) * 7 + 3
    rows = [(int(i), 100, bytearray(640), bytearray(t)) for i, t in zip(ids, texts, strict=True)]
    members = []
    for node in range(4):
        at = ids[rng.random(len(ids)) < 0.8]
        members += [(int(i), node, len(at)) for i in at]
    texts = spark.createDataFrame(rows, "id bigint, size int, path binary, sketch binary")
    return texts, spark.createDataFrame(members, "id bigint, node bigint, n bigint")


def parts(rows):
    reach = {}
    find = lambda x: x if reach.setdefault(x, x) == x else find(reach[x])
    for r in rows:
        a, b = find(r.id), find(r.root)
        reach[max(a, b)] = min(a, b)
    return {x: find(x) for x in reach}


def test_large_buckets_are_joined_as_by_all_pairs(spark):
    for sizes, strays in (((90,), 0), ((60, 40, 30), 12), ((3, 2), 60)):
        texts, members = clusters(spark, sizes, strays)
        every = N.compared(N.in_blocks(members.join(texts, "id"), 8), 8, 0.8).collect()
        got = N.of_large(members.join(texts, "id"), 8, 0.8, 8).collect()
        linked = lambda rows: {x: r for x, r in parts(rows).items() if list(parts(rows).values()).count(r) > 1}
        assert linked(got) == linked(every)
        share = lambda rows: sum(r.seen for r in rows) / sum(r["all"] for r in rows)
        assert abs(share(got) - share(every)) < 0.01
        assert 0.8 < sum(r["all"] for r in got) / sum(r["all"] for r in every) < 1.25


def test_pairs_of_equal_texts_are_estimated(spark):
    got = N.of_large(bucket(spark, 200), 8, 0.8, 8).collect()
    assert parts(got) == dict.fromkeys(range(200), 0)
    assert abs(sum(r["all"] for r in got) * N.TREES / (200 * 199) - 1) < 0.15  # blocks of 8 are dealt by hash


def test_rows_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    given, compared = [], N.compared
    monkeypatch.setattr(N, "compared", lambda rows, *a: given.append(rows) or compared(rows, *a))
    texts = spark.createDataFrame([(k, 100, bytearray(640), bytearray(128)) for k in range(300)], "id bigint, size int, path binary, sketch binary")
    assert parts(N.forest(texts, block=8).collect()) == dict.fromkeys(range(300), 0)
    assert sum(rows.count() for rows in given) <= 300 * N.TREES  # 38 times as many before, a row for each of a text's blocks
