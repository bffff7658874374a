"""Manifest, multiproofs and tampered documents against a plain version."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import manifest as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    values = [str(v) if v is not None else None for v in row]
    if lower and values[4] is not None:
        values[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in values[4])
    return h(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def plain(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
        return out

    def path(tree, i):
        for nodes in tree[:-1]:
            start = i // 16 * 16
            yield nodes[start:i], nodes[i + 1 : start + 16]
            i //= 16

    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in names}
    grown = {s: levels([leaf(r) for r in trees[s]]) for s in names}
    top = levels([grown[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(trees[s]):
            steps = [*path(grown[s], i), *path(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf(r, tampered)
            for a, b in steps:
                folded = h(*a, folded, *b)
            out.append((r[0], leaf(r), grown[s][-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), folded, folded == top[-1][0]))
    return out


SHAPE = "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int, size int, presented string, _block int"


def rows_of_all_kinds():
    rng = random.Random(3)
    sources = ["hot"] * 6 + ["b", "é", "Z", "", None]
    rows = [(i, rng.choice(sources), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["Text A", "lower", "", None, "Été À"]) ) for i in range(700)]
    rows += [(None, "b", "en", 1, "No Id")] * 3 + [(9, "hot", "en", 1, "Same Id"), (9, "hot", "de", 1, "same id")] + [(800, "hot", "en", 1, "Copy")] * 300
    return rows + [(5000, "alone", None, None, None), (5001, None, None, None, "long " * 200_000)]


@pytest.mark.parametrize("block", [m.BLOCK, 16, 50])
def test_all_leaves(spark, block, monkeypatch):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame([(*r, "x", 1, 2, "p", 3) for r in rows], SHAPE).repartition(6)
    monkeypatch.setattr(m, "proofs", lambda t, w, f=m.proofs: f(t, w, block=block))
    got = m.audited(df, F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    cols = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain(rows)
    assert sorted(map(tuple, got.select(*cols).collect()), key=str) == sorted(want, key=str)
    assert 0 < sum(not w[-1] for w in want) < len(want)


def test_some_leaves_and_their_siblings(spark):
    rows = rows_of_all_kinds()
    df = spark.createDataFrame([(*r, "x", 1, 2, "p", 3) for r in rows], SHAPE)
    tree = m.manifest(df.select("doc_id", "source", m.digest_of([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf")))
    wanted = tree.leaves.where("doc_id % 37 = 0").withColumn("presented", F.when(F.col("doc_id") == 37, F.lit("0" * 64)))
    got = m.proofs(tree, wanted, siblings=True).collect()
    assert sorted(r.doc_id for r in got) == sorted(r[0] for r in rows if r[0] is not None and r[0] % 37 == 0)
    want = {(w[0], w[1]): w for w in plain(rows)}
    for r in got:
        assert (r.subroot, r.root, r.proof_sha256) == want[r.doc_id, r.leaf][2:5]
        assert m.joined(r.siblings) == r.proof_sha256 and r.verified == (r.doc_id != 37)


def test_no_rows_one_row_and_what_is_missing(spark):
    df = spark.createDataFrame([], SHAPE)
    assert m.audited(df, F.lit(True)).count() == 0
    one = spark.createDataFrame([(1, "s", None, None, "A", "x", 1, 2, "p", 3)], SHAPE)
    got = m.audited(one, F.lit(True)).first()
    assert got.leaf == got.subroot == got.root and got.proof_sha256 == h() and not got.verified
    rng = np.random.default_rng(1)
    for size in (1, 2, 16, 17, 300, 5000):
        chosen = rng.choice(size, min(size, 7), replace=False)
        known, k, n = set(chosen.tolist()), 0, size
        for need in m.missing(chosen, size):
            family = {i for c in known for i in range(c // 16 * 16, min(n, c // 16 * 16 + 16))}
            assert set(need.tolist()) == family - known
            known, n = {c // 16 for c in known}, -(-n // 16)
        assert n == 1
