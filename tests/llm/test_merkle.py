import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsa.llm import merkle
from palimpsa.llm.common import ranked

FIELDS = ["doc_id", "source", "text"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text=None):
    return sha(*[written(v) for v in (row[0], row[1], row[2] if text is None else text)])


def tree(nodes, fan):
    """All levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i : i + fan]) for i in range(0, len(last), fan)])
    return levels


def steps(levels, at, fan):
    out = []
    for level in levels[:-1]:
        start = at - at % fan
        out.append((at % fan, level[start : start + fan]))
        at //= fan
    return out


def expected(rows, changed, fan=16):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for group in by_source.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [tree([leaf(r) for r in by_source[s]], fan) for s in sources]
    top = tree([t[-1][0] for t in trees], fan)
    out = []
    for i, source in enumerate(sources):
        for at, row in enumerate(by_source[source]):
            way = steps(trees[i], at, fan) + steps(top, i, fan)
            proof = sha(*[n for place, run in way for k, n in enumerate(run) if k != place])
            node = leaf(row, row[2].lower()) if changed(row) and row[2] is not None else leaf(row)
            for place, run in way:
                node = sha(*run[:place], node, *run[place + 1 :])
            out.append((row[0], leaf(row), trees[i][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=repr)


def frame(spark, rows, partitions=3):
    schema = "doc_id long, source string, text string, _tree string, _at string, leaf string, _row string"
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema).repartition(partitions)


def audited(spark, rows, partitions=3):
    lowered = {"text": F.lower("text")}
    got = merkle.audit(frame(spark, rows, partitions), "doc_id", "source", FIELDS, lowered, F.col("doc_id") % 5 == 0)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def divided(row):
    return row[0] is not None and row[0] % 5 == 0


def test_roots_proofs_and_tampering(spark):
    rows = [(i, f"s{i % 3}" if i % 2 else "hot", f"Text {i} É") for i in range(400)]
    rows += [(7, "s1", "Again"), (7, "s1", "Again"), (None, "s1", "no id"), (None, None, None), (900, None, ""), (905, "é", "x")]
    got = audited(spark, rows)
    assert got == expected(rows, divided)
    assert {r[-1] for r in got} == {True, False}
    assert got == audited(spark, rows, 1)


def test_lone_leaf_and_empty_table(spark):
    assert audited(spark, []) == []
    ((_, own, subroot, root, proof, folded, verified),) = audited(spark, [(1, "a", "X" * 300_000)])
    assert own == subroot == root == folded and proof == sha() and verified


@pytest.mark.parametrize("n", [1, 16, 65, 300])
def test_blocks_of_blocks(spark, n):
    """Trees of many blocks: two levels of four to a block."""
    rows = spark.range(n).select(F.col("id").alias("k"), F.lit("t").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    manifest = merkle.build_manifest(rows, "tree", ["k"], "h", fan=4, levels=2)
    levels = tree([sha(str(i)) for i in range(n)], 4)
    assert manifest.subroots().first()["subroot"] == levels[-1][0] == manifest.root

    def finish(row, witness, subroot):
        return {"k": row["k"], "proof": merkle.siblings(witness), "top": merkle.fold(row["h"], witness)}

    got = {r.k: (r.proof, r.top) for r in manifest.witnessed(finish, "k long, proof string, top string").collect()}
    for i in range(n):
        way = steps(levels, i, 4)
        assert got[i] == ("".join(x for p, run in way for j, x in enumerate(run) if j != p), manifest.root)


def test_ranked_deals_a_hot_group(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, (F.col("id") % 50).cast("string")).alias("g"),
        (F.col("id") % 10).alias("o"), F.col("id").alias("r"),
    )
    got = ranked(rows.repartition(5), "g", ["o", "r"], "test").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    for group in groups.values():
        group.sort(key=lambda r: (r.o, r.r))
        assert [r._at for r in group] == list(range(len(group))) and {r._n for r in group} == {len(group)}
