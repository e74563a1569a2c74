"""Hash trees against plain lists, and the layout of blocks."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quorate.llm import veb_manifest as vm

FIELDS = ("doc_id", "lang", "text")
ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType()), T.StructField("leaf", T.StringType()), T.StructField("place", T.IntegerType())])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:3]))


def plain_tree(leaves):
    """(root, siblings of each leaf, lowest first)."""
    level, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, i in enumerate(at):
            if i ^ 1 < len(level):
                proofs[k].append(level[i ^ 1])
        level = [sha("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
        at = [i // 2 for i in at]
    return level[0], proofs


def plain(rows):
    """{(doc_id, lang, leaf): [proofs]} with subroot, and the root."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(groups[g])]) for g in names]
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for g, (sub, proofs), above in zip(names, trees, upper):
        for x, p in zip(sorted(groups[g]), proofs):
            out.append((x[3], x[2], sub, sha("".join(p + above))))
    return root, sorted(out, key=str)


def ours(spark, rows):
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], ROWS)
    made = vm.manifest(table, FIELDS)
    proofs = made.proofs().withColumn("end", vm.folded(F.col("leaf"))).withColumn("proof", F.sha2(vm.proof_text(), 256)).collect()
    assert all(r.end == made.root for r in proofs)
    return made.root, sorted(((r.doc_id, r.leaf, r.subroot, r.proof) for r in proofs), key=str)


@pytest.mark.parametrize("height", range(1, 14))
def test_addresses_are_a_layout_of_the_tree(height):
    by_depth = vm.addresses(height)
    assert [len(a) for a in by_depth] == [1 << d for d in range(height)]
    assert sorted(np.concatenate(by_depth).tolist()) == list(range((1 << height) - 1)) and by_depth[0][0] == 0
    top = height // 2
    for i in range(1 << top if height > 1 else 0):
        # Each bottom tree is one stretch.
        own = np.concatenate([by_depth[d][i << (d - top) : (i + 1) << (d - top)] for d in range(top, height)])
        assert own.max() - own.min() + 1 == len(own) == (1 << (height - top)) - 1


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 7, 8])
def test_blocks(count):
    leaves = [sha(str(i)) for i in range(count)]
    levels = (count - 1).bit_length()
    nodes = vm.build_block(np.array([list(bytes.fromhex(x)) for x in leaves], np.uint8), levels)
    root, proofs = plain_tree(leaves)
    assert nodes[0].tobytes().hex() == root
    assert [[s[1:] for s in p if s] for p in vm.block_paths(nodes, count, levels)] == proofs


@pytest.mark.parametrize("levels", [2, 12])
def test_trees_of_many_sizes(spark, monkeypatch, levels):
    monkeypatch.setattr(vm, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(rng.randrange(100), rng.choice(["en", "en", "en", "dé", "zz", None, "one"][: 6]), rng.choice([None, "", "x", "é" * 5])) for _ in range(150)]
    rows += [(None, "en", "x"), (None, None, None), (1, "one", "t")] + [(5, "en", "same")] * 40
    rows += [(i, f"group{i}", "t") for i in range(20)]
    assert ours(spark, rows) == plain(rows)


def test_one_row_one_group_and_none(spark):
    assert ours(spark, [(1, "a", "text")]) == plain([(1, "a", "text")])
    assert ours(spark, [(1, "a", "text"), (2, "a", "x" * 300_000)]) == plain([(1, "a", "text"), (2, "a", "x" * 300_000)])
    made = vm.manifest(spark.createDataFrame([], ROWS), FIELDS)
    assert made.root is None and made.proofs().count() == 0
    with pytest.raises(ValueError):
        vm.manifest(spark.createDataFrame([], ROWS), FIELDS, carry={"leaf": F.col("leaf")})


def test_a_changed_row_is_found(spark):
    rows = [(i, "en" if i % 3 else "fr", f"text {i}") for i in range(50)]
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], ROWS)
    changed = F.when(F.col("doc_id") == 7, F.lower(F.hex(vm.digest("doc_id", "lang", F.concat("text", F.lit("!"))))))
    made = vm.manifest(table, FIELDS, carry={"doc_id": F.col("doc_id"), "changed": changed})
    ends = made.proofs().withColumn("end", vm.folded(F.coalesce("changed", "leaf"))).collect()
    assert [r.doc_id for r in ends if r.end != made.root] == [7]
