import zlib
from collections import defaultdict

from palimpsa.llm import sharding


def shards(frame, n=16):
    out = defaultdict(list)
    for r in frame.collect():
        out[r.shard].append(r)
    assert set(out) <= set(range(n))
    for rows in out.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return out


def test_even_bytes_and_whole_groups(docs, prose):
    rows = [(i, prose(i // 2, 5 + i % 60)) for i in range(6000)]
    got = shards(sharding.assign_shards(docs(rows)))
    sizes = [sum(r.size for r in g) for g in got.values()]
    largest = max(len(t) + 1 for _, t in rows)
    assert len(got) == 16 and max(sizes) - min(sizes) <= 4 * largest
    texts = dict(rows)
    homes = defaultdict(set)
    for shard, group in got.items():
        for r in group:
            assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
            homes[texts[r.doc_id]].add(shard)
    assert all(len(h) == 1 for h in homes.values())


def test_hot_text_is_divided(docs, prose):
    hot = prose(1, 100)
    rows = [(i, hot if i % 3 == 0 else prose(i, 50)) for i in range(3000)]
    sizes = [sum(r.size for r in g) for g in shards(sharding.assign_shards(docs(rows))).values()]
    assert len(sizes) == 16 and max(sizes) < 1.05 * min(sizes)


def test_repeated_rows_and_missing_values(docs):
    rows = [(1, "same")] * 500 + [(None, "x"), (None, None), (2, None), (3, ""), (4, "long " * 20_000)]
    got = shards(sharding.assign_shards(docs(rows)))
    assert sum(map(len, got.values())) == len(rows)
    assert all(r.size == 1 and r.text_crc32 == 0 for g in got.values() for r in g if r.doc_id in (2, 3))


def test_same_shards_whatever_the_partitions(docs, prose):
    rows = [(i, prose(i, 20)) for i in range(500)]
    one, two = (
        {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(docs(rows, n)).collect()} for n in (1, 7)
    )
    assert one == two


def test_empty_and_single(docs):
    assert sharding.assign_shards(docs([])).collect() == []
    assert len(sharding.assign_shards(docs([(1, "a")])).collect()) == 1
