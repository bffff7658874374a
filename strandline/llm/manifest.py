"""Merkle manifest of a data set, and proofs of its documents by octopus multiproofs.

Every document is a leaf. The leaves of a source make a tree, and the roots of the sources' trees, ordered by
source, are the leaves of one more tree, whose root stands for the whole data set. A digest is a lower-case hex
SHA-256; an inner node is the digest of the hex digests of its up to ``FAN`` children, one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from strandline.llm.common import written
from strandline.scale import running_rank

FAN = 16
BLOCK = FAN**3  # leaves that are proved together in one call
TOP = -1  # the tree over the sources' roots


def digest_of(values: Sequence[Column]) -> Column:
    """Digest of a record: each value is its UTF-8 byte count, a colon and itself; null is ``-``."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def joined(digests: Sequence[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


@dataclass
class Manifest:
    """``leaves``: the given columns with ``tree`` and ``position``; ``nodes``: (tree, level, index, digest) of
    all trees, ``TOP`` among them; ``trees``: (tree, source, size); ``root``: null where there is no leaf."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    sources: int
    root: str | None


def _positions(leaves: DataFrame, source: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """``leaves`` with ``tree`` and ``position``, and the trees.

    Rows are range-sliced by source, id and digest, so a hot source lies in many slices; equal rows are told apart by
    where they were read, which changes nothing that they say, so thousands of them part as well.
    """
    order = [F.col(doc_id), F.col("leaf"), F.col("_tie")]
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(source), *order)
    sliced, _ = written(ranged.withColumn("_slice", F.spark_partition_id()), "leaf-slices")
    counted = sliced.groupBy(source, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = counted.groupBy(source).agg(F.sum("_rows").alias("size"))
    trees, _ = written(
        running_rank(sizes, [], [F.col(source).asc_nulls_first()], "tree").select((F.col("tree") - 1).alias("tree"), source, "size"), "trees"
    )
    earlier = Window.partitionBy(source).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select(F.col(source).alias("_source"), F.col("_slice").alias("_s"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    known = trees.select("tree", F.col(source).alias("_source2"))
    offsets = offsets.join(known, F.col("_source").eqNullSafe(F.col("_source2"))).drop("_source2")
    within = Window.partitionBy(source, "_slice").orderBy(*order)
    placed = (
        sliced.withColumn("_n", F.row_number().over(within))
        .join(offsets, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_s")))
        .withColumn("position", F.col("_before") + F.col("_n") - 1)
        .drop("_tie", "_slice", "_n", "_source", "_s", "_before")
    )
    return placed, trees


def _grown(level: DataFrame, size: int) -> tuple[list[DataFrame], DataFrame]:
    """All levels above the leaves (tree, index, n, digest) of the given trees, and (tree, digest) of their roots.

    A round groups at most ``FAN`` children under a parent; there are as many rounds as the largest tree has levels.
    """
    levels, roots, k = [], None, 0
    while True:
        levels.append(level.select("tree", F.lit(k).alias("level"), "index", "digest"))
        done = level.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        if size <= 1:
            return levels, roots
        run = F.sort_array(F.collect_list(F.struct("index", "digest")))  # at most FAN children
        above = level.where("n > 1").groupBy("tree", F.floor(F.col("index") / FAN).alias("index")).agg(run.alias("run"), F.min("n").alias("n"))
        level, _ = written(
            above.select("tree", "index", F.ceil(F.col("n") / FAN).alias("n"), F.sha2(F.array_join("run.digest", ""), 256).alias("digest")), "merkle-level"
        )
        size, k = -(-size // FAN), k + 1


def manifest(leaves: DataFrame, source: str = "source", doc_id: str = "doc_id") -> Manifest:
    """The trees over ``leaves``, which has a ``leaf`` digest for every document.

    Leaves of a source ascend by id (nulls first), then by digest; sources ascend bytewise, null first. A tree
    with one leaf is that leaf. Only sizes and the root reach the driver.

    Defined cases: null sources are one source; null and repeated ids keep their places by digest; equal rows
    are as many leaves; no rows give no root. Columns named ``tree`` or ``position`` are overwritten.
    """
    placed, trees = _positions(leaves.drop("tree", "position"), source, doc_id)
    placed, _ = written(placed, "leaves")
    sources, largest = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    if not sources:
        return Manifest(placed, placed.select("tree", F.lit(0).alias("level"), F.col("position").alias("index"), F.col("leaf").alias("digest")), trees, 0, None)
    sized = trees.select("tree", F.col("size").alias("n"))
    bottom = placed.select("tree", F.col("position").alias("index"), F.col("leaf").alias("digest")).join(sized, "tree")
    levels, roots = _grown(bottom, largest)
    subroots, _ = written(roots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(sources).cast("long").alias("n"), "digest"), "subroots")
    upper, root = _grown(subroots, sources)
    nodes = None
    for level in [*levels, *upper]:
        nodes = level if nodes is None else nodes.unionByName(level)
    return Manifest(placed, nodes, trees, sources, root.first().digest)


def missing(leaves: np.ndarray, size: int) -> list[np.ndarray]:
    """For each level below the root, the indices that the given leaves of a tree need and cannot derive."""
    known, out = np.unique(leaves), []
    while size > 1:
        parents = np.unique(known // FAN)
        family = (parents[:, None] * FAN + np.arange(FAN)).ravel()
        out.append(np.setdiff1d(family[family < size], known, assume_unique=True))
        known, size = parents, -(-size // FAN)
    return out


class _Paths:
    """Nodes of one tree that are derived from some leaves and the fetched nodes: shared by all their proofs."""

    def __init__(self, leaves: dict[int, str], fetched: dict[tuple[int, int], str], size: int):
        self.runs: list[dict[int, list[str]]] = []
        known, level = leaves, 0
        while size > 1:
            runs = {}
            for p in {i // FAN for i in known}:
                places = range(p * FAN, min(size, (p + 1) * FAN))
                runs[p] = [known[i] if i in known else fetched[level, i] for i in places]
            self.runs.append(runs)
            known, size, level = {p: joined(run) for p, run in runs.items()}, -(-size // FAN), level + 1
        self.root = next(iter(known.values()))

    def siblings(self, index: int) -> list[str]:
        out = []
        for runs in self.runs:
            index, own = divmod(index, FAN)
            run = runs[index]
            out += run[:own] + run[own + 1 :]
        return out

    def fold(self, index: int, digest: str) -> str:
        """The root that ``digest`` in the place of a leaf and the true siblings give."""
        for runs in self.runs:
            index, own = divmod(index, FAN)
            run = runs[index]
            digest = joined([*run[:own], digest, *run[own + 1 :]])
        return digest


def proofs(tree: Manifest, wanted: DataFrame, presented: str = "presented", siblings: bool = False, block: int = BLOCK) -> DataFrame:
    """``wanted`` (leaves of the manifest, any part of them) with what a proof of ``presented`` gives.

    New columns: ``subroot``, ``root``, ``proof_sha256`` (digest of the siblings from the leaf up, left to right),
    ``folded_root`` (the root that ``presented`` and these siblings give), ``verified``; with ``siblings`` also the
    siblings themselves. Each block of up to ``block`` neighbouring leaves works out the least set of nodes that its
    proofs need and cannot derive from its own leaves, fetches each once by a join, derives the nodes that
    its proofs share, and expands the proofs. A block fetches at most ``FAN - 1`` nodes a level and leaf, and as good as none
    below its own root where all its leaves are wanted.

    Defined cases: a null ``presented`` stands for the leaf itself; repeated rows get equal proofs; no rows
    give no rows. Columns of the new names are overwritten, as are ``size`` and those beginning with ``_block``.
    """
    new = ["subroot", "root", "proof_sha256", "folded_root", "verified", "siblings", "size", "_block"]
    held = wanted.drop(*new).join(tree.trees.select("tree", "size"), "tree").withColumn("_block", F.floor(F.col("position") / block))
    sources, root = tree.sources, tree.root

    def needs(key: tuple, rows: pa.Table) -> pa.Table:
        own, size = rows["tree"][0].as_py(), rows["size"][0].as_py()
        lists = [(own, k, m) for k, m in enumerate(missing(rows["position"].to_numpy(), size))]
        lists += [(TOP, k, m) for k, m in enumerate(missing(np.array([own]), sources))]
        count = [len(m) for *_, m in lists]
        return pa.table({
            "tree": np.repeat(np.array([t for t, _, _ in lists], np.int64), count),
            "level": np.repeat(np.array([k for _, k, _ in lists], np.int32), count),
            "index": np.concatenate([m for *_, m in lists] or [np.empty(0)]).astype(np.int64),
            "_own": pa.array([own] * sum(count), pa.int64()),
            "_block": pa.array([rows["_block"][0].as_py()] * sum(count), pa.int64()),
        })

    asked = held.select("tree", "size", "position", "_block").groupBy("tree", "_block").applyInArrow(
        needs, "tree long, level int, index long, _own long, _block long"
    )
    fetched = asked.join(tree.nodes, ["tree", "level", "index"]).select(
        F.col("_own").alias("tree"), "_block", (F.col("tree") == TOP).alias("top"), "level", "index", "digest"
    )
    kept = [c for c in held.columns if c not in ("size", "_block")]

    def expand(key: tuple, rows: pa.Table, nodes: pa.Table) -> pa.Table:
        inside, above = {}, {}
        for n in nodes.select(["top", "level", "index", "digest"]).to_pylist():
            (above if n["top"] else inside)[n["level"], n["index"]] = n["digest"]
        own, places, leaves = rows["tree"][0].as_py(), rows["position"].to_pylist(), rows["leaf"].to_pylist()
        low = _Paths(dict(zip(places, leaves)), inside, rows["size"][0].as_py())
        high = _Paths({own: low.root}, above, sources)
        over, out = high.siblings(own), []
        for place, leaf, shown in zip(places, leaves, rows[presented].to_pylist()):
            path = low.siblings(place) + over
            # What is shown as it was leads over the derived nodes; anything else is folded anew.
            end = high.root if shown is None or shown == leaf else high.fold(own, low.fold(place, shown))
            out.append((joined(path), end, path))
        made = rows.select(kept)
        made = made.append_column("subroot", pa.array([low.root] * len(out), pa.string()))
        made = made.append_column("root", pa.array([root] * len(out), pa.string()))
        made = made.append_column("proof_sha256", pa.array([o[0] for o in out], pa.string()))
        made = made.append_column("folded_root", pa.array([o[1] for o in out], pa.string()))
        made = made.append_column("verified", pa.array([o[1] == root for o in out], pa.bool_()))
        return made.append_column("siblings", pa.array([o[2] for o in out], pa.list_(pa.string()))) if siblings else made

    shape = held.select(*kept).schema
    for name, kind in (("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")):
        shape = shape.add(name, kind)
    if siblings:
        shape = shape.add("siblings", ArrayType(StringType()))
    by = ["tree", "_block"]
    return held.groupBy(*by).cogroup(fetched.groupBy(*by)).applyInArrow(expand, shape)


def audited(docs: DataFrame, tampered: Column, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
            doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """Leaves of ``docs`` with the proofs of what is found in place of them: where ``tampered``, a text without capitals A-Z.

    Texts are read once and never shuffled. Where ``tampered`` is null nothing is tampered with. Null fields count as
    ``manifest.digest_of`` says; other columns of ``docs`` are left out, so none can clash.
    """
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves, _ = written(
        docs.select(
            F.col(doc_id), F.col(source), digest_of([F.col(c) for c in fields]).alias("leaf"),
            F.when(tampered, digest_of([lower if c == text else F.col(c) for c in fields])).alias("presented"),
        ),
        "found-leaves",
    )
    tree = manifest(leaves, source, doc_id)
    return proofs(tree, tree.leaves)
