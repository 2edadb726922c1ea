"""Manifest trees against plain hashing."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cellgrid.llm import merkle_manifest as mm

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def tree(level, fanout):
    """Root, and per leaf the (before, after) of every level."""
    paths, where = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for k, at in enumerate(where):
            low = at - at % fanout
            paths[k].append(("".join(level[low:at]), "".join(level[at + 1:low + fanout])))
        level = [h(*level[i:i + fanout]) for i in range(0, len(level), fanout)]
        where = [at // fanout for at in where]
    return level[0], paths


def plain(rows, fanout):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf(row), row))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        groups[name].sort(key=lambda g: g[:3])
    trees = {name: tree([g[2] for g in groups[name]], fanout) for name in names}
    root, tops = tree([trees[name][0] for name in names], fanout)
    out = Counter()
    for name, top in zip(names, tops):
        for (_, _, digest, row), path in zip(groups[name], trees[name][1]):
            seen = digest
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0 and row["n_chars"] is not None:
                seen = leaf(row | {"n_chars": row["n_chars"] + 1})
            for before, after in path + top:
                seen = h(before, seen, after)
            out[row["doc_id"], digest, trees[name][0], root, h(*[b + a for b, a in path + top]), seen, seen == root] += 1
    return out


def audited(df, fanout=2):
    return mm.audit(df, COLUMNS, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1},
                    F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, fanout)


@pytest.mark.parametrize("fanout, run_rows", [(2, 1024), (3, 9)])
def test_odd_rows(odd, fanout, run_rows, monkeypatch):
    monkeypatch.setattr(mm, "RUN_ROWS", run_rows)
    df = odd.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, F.length("text")).cast("long"))
    got = audited(df, fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain([r.asDict() for r in df.collect()], fanout)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(k[-1] for k in want) and not all(k[-1] for k in want)


def test_hot_group_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(mm, "RUN_ROWS", 32)
    df = spark.range(700).selectExpr("id * 3 as doc_id", "'s' as source", "case when id % 5 = 0 then concat('l', id % 70) else 'hot' end as lang",
                                     "id as n_chars", "cast(id as string) as text")
    assert Counter(tuple(r) for r in audited(df).collect()) == plain([r.asDict() for r in df.collect()], 2)


def test_single_row_and_no_rows(odd, none):
    one = odd.where("doc_id = 9")
    assert Counter(tuple(r) for r in audited(one).collect()) == plain([r.asDict() for r in one.collect()], 2)
    assert audited(none).count() == 0


def test_any_change_moves_the_root(odd):
    root = lambda df: audited(df).select("root").distinct().first().root
    base = root(odd)
    assert root(odd.repartition(7)) == base
    assert root(odd.where("doc_id is null or doc_id <> 13")) != base
    assert root(odd.withColumn("text", F.when(F.col("doc_id") == 13, "One").otherwise(F.col("text")))) != base
