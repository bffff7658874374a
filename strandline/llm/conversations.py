"""Repair of conversations whose turns are missing, blank, repeated, cut off or in the wrong role.

The cheapest edits that bring a conversation into the shape ``(s?(ua)+)?`` (role initials: system, user,
assistant) are found by a Viterbi pass over its rows in order. The pass holds no more of a conversation than what
its survivors do not yet agree on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written
from strandline.scale import running_rank

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
CUT = 5  # what an undeleted truncated row adds
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)

# States: nothing yet, a system row, a user row, an assistant row. A conversation may end in START or A.
START, S, U, A = range(4)
ENDS = (START, A)
KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
TURNED = (U, U, A, U)  # where a re-roled or inserted row leads
ROLE = {U: "user", A: "assistant"}
# EXTRA[x][y]: what it costs at most to go on from x as from y, so that y can be given up where it is dearer by
# more. From A, a system row that START would keep is deleted; missing rows are inserted.
EXTRA = ((0, 0, 5, 0), (10, 0, 5, 10), (7, 5, 0, 5), (2, 0, 5, 0))
LEGAL = {"su", "ua", "au"}


class _Branch:
    """A run of edits that survivors share, below the run of ``above``; ``below`` counts the references to it."""

    __slots__ = ("above", "below", "edits")

    def __init__(self, above: _Branch | None, edits: str):
        self.above, self.edits, self.below = above, bytearray(edits, "ascii"), []


class Repair:
    """One conversation: rows go in with ``add``, edits come out of ``add`` and ``end`` as soon as they are certain.

    Survivors (a state, its cost) end in branches of a tree. A branch that no survivor refers to is cut off, one that
    is left alone below another is joined to it, so the tree has at most as many leaves as states; what is
    left at its root is shared by all survivors and is given out. Survivors of equal cost are told
    apart by all their edits that are still open: no branch's edits begin another's, so their order is
    kept as ranks, and is carried over from row to row instead of being read again.
    """

    def __init__(self):
        self.root = _Branch(None, "")
        self.tips, self.survivors = [self.root], {}  # tips in the order of their edits
        self.open = bytearray()  # role initials of the rows whose edits are open
        self.given, self.at, self.illegal, self.cost, self.last = 0, START, 0, 0, None
        self._insert({START: (0, 0, 0)})

    def _insert(self, found: dict[int, tuple[int, int, int]]) -> None:
        """Survivors from ``found`` (state to cost, tip and number of inserts behind it) and further inserts."""
        changed = True
        while changed:
            changed = False
            for s, (cost, tip, n) in list(found.items()):
                more = (cost + COST[INSERT], tip, n + 1)
                if TURNED[s] not in found or more < found[TURNED[s]]:
                    found[TURNED[s]], changed = more, True
        self.survivors = {y: f for y, f in found.items() if all(found[x][0] + EXTRA[x][y] >= f[0] for x in found)}

    def add(self, initial: str, fault: int) -> list[tuple]:
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        self.open.append(ord(initial) if initial in ("s", "u", "a") else ord("-"))
        more = CUT if fault == TRUNCATED else 0
        best: dict[int, tuple] = {}

        def offer(state: int, *way) -> None:
            if state not in best or way < best[state]:
                best[state] = way

        for s, (cost, tip, n) in self.survivors.items():
            before = INSERT * n
            offer(s, cost + COST[DELETE], tip, before + DELETE)
            if fault in (SOUND, TRUNCATED):
                offer(TURNED[s], cost + COST[REROLE] + more, tip, before + REROLE)
                if (s, initial) in KEPT:
                    offer(KEPT[s, initial], cost + COST[KEEP] + more, tip, before + KEEP)
        ways = sorted({w[1:] for w in best.values()})
        self._insert({s: (w[0], ways.index(w[1:]), 0) for s, w in best.items()})
        used = sorted({tip for _, tip, _ in self.survivors.values()})
        self._grow([ways[k] for k in used])
        self.survivors = {s: (cost, used.index(tip), n) for s, (cost, tip, n) in self.survivors.items()}
        return self._certain()

    def _grow(self, ways: list[tuple[int, str]]) -> None:
        alive = [t for t, _ in ways]
        for t in set(range(len(self.tips))) - set(alive):
            self._cut(self.tips[t])
        if len(self.root.below) == 1:
            self._join(self.root)
        tips = []
        for t, edits in ways:
            branch = self.tips[t]
            if alive.count(t) > 1:
                branch.below.append(branch := _Branch(branch, edits))
            else:
                branch.edits += edits.encode()
            tips.append(branch)
        self.tips = tips

    def _cut(self, branch: _Branch) -> None:
        above = branch.above
        above.below.remove(branch)
        if len(above.below) == 1 and above is not self.root:
            self._join(above)

    def _join(self, branch: _Branch) -> None:
        """Take the only branch below into ``branch``."""
        lone = branch.below[0]
        branch.edits += lone.edits
        branch.below = lone.below
        for b in branch.below:
            b.above = branch
        self.tips = [branch if t is lone else t for t in self.tips]

    def _certain(self) -> list[tuple]:
        out = self._told(self.root.edits)
        self.root.edits = bytearray()
        return out

    def _told(self, edits: bytearray) -> list[tuple]:
        """(position or None, edit, new role or None) of edits, as the states that they lead through say."""
        out, row = [], 0
        for e in map(chr, edits):
            role = ROLE[TURNED[self.at]] if e in (REROLE, INSERT) else None
            if e == KEEP:
                self.at = KEPT[self.at, chr(self.open[row])]
            elif role:
                self.at = TURNED[self.at]
            if e != INSERT:
                row += 1
            out.append((self.given + row if e != INSERT else None, e, role))
        self.given += row
        del self.open[:row]
        return out

    def end(self) -> list[tuple]:
        cost, tip, n = min(self.survivors[s] for s in ENDS if s in self.survivors)
        self.cost, branch, edits = cost, self.tips[tip], bytearray(INSERT * n, "ascii")
        while branch is not None:
            edits = branch.edits + edits
            branch = branch.above
        return self._told(edits)


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` (_conv, position, role, text, …) with ``fault``: the first that holds of blank, duplicate, truncated.

    Equal rows of a conversation are folded to the place of the first before they meet its rows again.
    """
    same = F.sha2(F.concat(F.octet_length("role"), F.lit(":"), "role", "text"), 256)
    known, _ = written(rows.withColumn("_same", same), "conversation-rows")
    first = known.groupBy("_conv", "_same").agg(F.min("position").alias("_first"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(bare == "", BLANK).when(F.col("position") > F.col("_first"), DUPLICATE)
        .when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    return known.join(first, ["_conv", "_same"]).withColumn("fault", fault).drop("_same", "_first")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_conv", "seq", "position", "edit", "new_role", "illegal", "cost"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    conv, work, seq, out = None, None, 0, []

    def put(edits: list[tuple]) -> None:
        nonlocal seq
        for e in edits:
            seq += 1
            out.append((conv, seq, *e, None, None))

    def finish() -> None:
        put(work.end())
        out.append((conv, None, None, None, None, work.illegal, work.cost))

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)
        out.clear()
        return batch

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("_conv", "initial", "fault")]
        for c, initial, fault in zip(*columns):
            if c != conv:
                if work is not None:
                    finish()
                conv, work, seq = c, Repair(), 0
            put(work.add(initial, fault))
            if len(out) >= 10_000:
                yield flushed()
    if work is not None:
        finish()
    if out:
        yield flushed()


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The repaired rows of all conversations, and one row of figures for each.

    Rows: ``conv_id``, ``seq`` (place among the edits), ``turn`` (null for inserted rows), ``role``, ``text``, ``edit``
    (``K`` kept, ``R`` re-roled, ``I`` inserted, ``D``: deleted, listed with what it was). Of the cheapest edits the ASCII-least are taken.
    Figures: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``.

    Rows are taken by turn (nulls first), then role and text. Places and faults are found on range slices and by
    digests, so a conversation of any size stays split; only its role initials and faults, two small
    values a row, pass in order through one task, which gives out edits as they become certain.

    Defined cases: null roles and texts are one space; null ids are one conversation; other columns are not read;
    no rows give no rows.
    """
    space = F.lit(" ")
    plain = conversations.select(
        F.concat(F.when(F.col(conv_id).isNull(), "-").otherwise("="), F.coalesce(F.col(conv_id).cast("string"), F.lit(""))).alias("_conv"),
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), space).alias("role"), F.coalesce(F.col(text), space).alias("text"),
        F.monotonically_increasing_id().alias("_tie"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_tie")]
    rows, _ = written(faults(running_rank(plain, ["_conv"], order, "position").drop("_tie")), "conversations")
    stream = rows.select("_conv", "position", _initial(F.col("role")).alias("initial"), "fault").repartition("_conv").sortWithinPartitions("_conv", "position")
    found, _ = written(
        stream.mapInArrow(_repaired, "_conv string, seq long, position long, edit string, new_role string, illegal long, cost long"), "edits"
    )
    names = rows.groupBy("_conv").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)).cast("long").alias("_span"),
        *[F.count_if(F.col("fault") == k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))],
    )
    turns = rows.where("turn is not null").select("_conv", "turn").distinct().groupBy("_conv").agg(F.count(F.lit(1)).alias("_turns"))
    ended = found.where("edit is null").select("_conv", "illegal", "cost")
    figures = names.join(turns, "_conv", "left").join(ended, "_conv").select(
        "conv_id", (F.col("_span") - F.coalesce("_turns", F.lit(0))).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost"
    )
    edits = found.where("edit is not null").select("_conv", "seq", "position", "edit", "new_role")
    at_row = edits.where("position is not null").join(rows, ["_conv", "position"]).select(
        "conv_id", "seq", "turn", F.coalesce("new_role", "role").alias("role"), "text", "edit"
    )
    inserted = edits.where("position is null").join(names.select("_conv", "conv_id"), "_conv").select(
        "conv_id", "seq", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.col("new_role").alias("role"), F.lit("").alias("text"), "edit"
    )
    return at_row.unionByName(inserted), figures


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id``, ``audit`` (its edits in order) and ``repaired_sha256`` (its ``role:text`` rows, one a line).

    The digest of a conversation can only be made from its first row to its last: rows are sorted by the
    shuffle and pass through one at a time.
    """
    kind = repaired.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, audit, lines, done, shape = None, None, None, 0, [], None

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(done, schema=shape)
            done.clear()
            return batch

        def finish() -> None:
            done.append({"conv_id": conv[0], "audit": audit.decode(), "repaired_sha256": sha.hexdigest()})

        for batch in batches:
            shape = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("audit", pa.string()), ("repaired_sha256", pa.string())])
            for c, role, text, edit in zip(*[batch.column(n).to_pylist() for n in ("conv_id", "role", "text", "edit")]):
                if conv != (c,):
                    if conv is not None:
                        finish()
                    conv, sha, audit, lines = (c,), hashlib.sha256(), bytearray(), 0
                audit += edit.encode()
                if edit != DELETE:
                    sha.update((("\n" if lines else "") + role + ":" + text).encode())
                    lines += 1
            if len(done) >= 1000:
                yield flushed()
        if conv is not None:
            finish()
        if done:
            yield flushed()

    ordered = repaired.select("conv_id", "seq", "role", "text", "edit").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return ordered.mapInArrow(run, f"conv_id {kind}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with rows dropped, emptied, cut, repeated and re-roled by crc32 of ``conv_id:turn``."""
    space = F.lit(" ")
    key = F.concat(*[p for c in ("conv_id", "turn") for p in (F.coalesce(F.col(c).cast("string"), space), F.lit(":"))][:-1])
    kind = F.crc32(key) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(copies).alias("_copy"),
    ).drop("_copy")


def repaired_damage(conversations: DataFrame) -> DataFrame:
    """For every ``conv_id`` the figures and digests of its repair after ``damaged``; one without a row left has zeros."""
    rows, figures = repair(damaged(conversations))
    rows, _ = written(rows, "repaired")
    found = figures.join(digests(rows).withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    every = conversations.select(F.col("conv_id").alias("_id")).distinct()
    long = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in long],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
