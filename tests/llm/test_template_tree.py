"""Line templates against plain Python."""

from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import types as T

from quorate.llm import template_tree as tt

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("line", T.StringType()), T.StructField("h", T.StringType())])


def leaves(line):
    t = ["<*>" if re.search("[0-9]", x) else x for x in re.split(r"[ \t-\r]+", line) if x]
    if len(t) < 6:
        return []
    rest = len(t) - 3
    edge = [3 + rest * i // 4 for i in range(5)]
    return [(i, len(t), *t[: edge[i]], None, *t[edge[i + 1] :]) for i in range(4)]


def plain(rows):
    docs = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n") if text is not None else []:
            for leaf in leaves(line):
                docs[leaf].add(d)
    out = []
    for d, text in rows:
        if text is None:
            out.append((d, None))
            continue
        gone = lambda line: any((named := [x for x in docs[leaf] if x is not None]) and (d is None or min(named) < d) for leaf in leaves(line))
        out.append((d, "\n".join(line for line in text.split("\n") if not gone(line))))
    return out


def test_repeated_templates_go_once(spark):
    rng = random.Random(7)
    vocabulary = "the of and to in is it you that he was for on are as with his they".split()
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = [line(n) for n in (6, 7, 9, 20, 60)]
    rows = []
    for d in range(60):
        lines = [line(rng.randrange(30)) for _ in range(rng.randrange(6))]
        for s in rng.sample(shared, rng.randrange(4)):
            words = s.split(" ")
            kind = rng.randrange(3)
            if kind == 1:
                words[rng.randrange(len(words))] = f"id{rng.randrange(10**6)}"
            if kind == 2:
                words[-1] = rng.choice(vocabulary)
            lines.insert(rng.randrange(len(lines) + 1), "  ".join(words) if kind else s)
        rows.append((d, "\n".join(lines)))
    rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[3][1]), (None, line(40)), (61, None), (62, ""), (63, "\n\n"), (64, "user 17 logged in from 10.0.0.1 today"), (65, "user 99 logged in from 10.0.0.7 today"), (66, "x " * 50_000)]
    table = spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS)
    out, n_lines, dropped = tt.without_repeats(table)
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(plain(rows), key=str)
    assert all(r[n_lines] == (0 if r.text is None else r.text.count("\n") + 1 + r[dropped]) for r in got if r.text is None or r.text or not r[dropped])
    assert {r.text for r in got if r.doc_id in (64, 65)} == {"user 17 logged in from 10.0.0.1 today", ""}


def test_documents_emptied_go_and_others_stay(spark):
    same = "one two three four five six seven eight"
    rows = [(1, same), (2, same), (3, f"own\n{same}"), (4, ""), (5, None), (6, "short"), (7, "short")]
    kept = tt.dedup_lines(spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS))
    assert kept.columns == DOCS.names
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, same), (3, "own"), (4, ""), (5, None), (6, "short"), (7, "short")]
    assert tt.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_a_line_in_a_third_of_all_documents(spark):
    hot = "this very line is in a third of all documents"
    rows = [(d, f"line number {d} of its own kind\n{hot}" if d % 3 == 0 else f"alpha{'x' * (d % 50)} beta{'y' * (d // 50)} c d e f g") for d in range(3000)]
    out, _, dropped = tt.without_repeats(spark.createDataFrame([(*r, "a", "b") for r in rows], DOCS))
    assert out.where(f"{dropped} > 0 and text like '%third%'").count() == 0
    assert out.where("text like '%third%'").count() == 1
