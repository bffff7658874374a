"""Token ids in files of fixed-width packed bits."""

from __future__ import annotations

import gc
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import pretokens
from strandline.llm.common import qualified, scratch_folder, store, written

MAGIC = b"STRBITS1"
FOOT = struct.Struct("<8sIIQQQQ")  # magic, bits of an id, ids of a block, blocks, documents, ids, place of the index
DOCUMENT = np.dtype([("start", "<i8"), ("count", "<i8"), ("id", "<i8"), ("none", "u1")])
BLOCK = 1 << 16  # ids; a multiple of 8, so that blocks start at whole bytes
KEPT = 1_000_000  # pre-tokens whose ids a worker keeps between batches
LONGEST = 64


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids one after the other in ``width`` bits each, the highest bit first."""
    if width in (8, 16, 32):
        return ids.astype(f">u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    return np.packbits(bits).tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f">u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width).reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - width :] = bits
    return np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)


class Writer:
    """One file: blocks as they fill up, then the offsets of blocks and the documents, then the foot."""

    def __init__(self, sink, width: int, block: int = BLOCK):
        self.sink, self.width, self.block = sink, width, block
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.place = 0
        self.offsets: list[int] = []
        self.documents: list[np.ndarray] = []

    def add(self, keys: Sequence[int | None], counts: np.ndarray, ids: np.ndarray) -> None:
        """Documents with their numbers of ids, and all those ids in order."""
        rows = np.zeros(len(counts), DOCUMENT)
        rows["start"] = self.ids + np.cumsum(counts) - counts
        rows["count"] = counts
        rows["none"] = [k is None for k in keys]
        rows["id"] = [k or 0 for k in keys]
        self.documents.append(rows)
        self.ids += ids.size
        self.waiting.append(ids)
        self.held += ids.size
        if self.held >= self.block:
            joined = np.concatenate(self.waiting)
            full = joined.size // self.block * self.block
            for i in range(0, full, self.block):
                self._put(joined[i : i + self.block])
            self.waiting, self.held = [joined[full:]], joined.size - full

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.offsets.append(self.place)
        self.sink.write(data)
        self.place += len(data)

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        documents = np.concatenate(self.documents) if self.documents else np.zeros(0, DOCUMENT)
        self.sink.write(np.array([*self.offsets, self.place], "<i8").tobytes())
        self.sink.write(documents.tobytes())
        self.sink.write(FOOT.pack(MAGIC, self.width, self.block, len(self.offsets), len(documents), self.ids, self.place))


class TokenFile:
    """Random access to one file: any run of ids is read from the blocks that hold it."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - FOOT.size)
        magic, self.width, self.block, blocks, documents, self.ids, index = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(index)
        self.offsets = np.frombuffer(source.read(8 * (blocks + 1)), "<i8")
        self.documents = np.frombuffer(source.read(DOCUMENT.itemsize * documents), DOCUMENT)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        data = self.source.read(int(self.offsets[last + 1] - self.offsets[first]))
        count = min(self.ids, (last + 1) * self.block) - first * self.block
        return unpack(data, self.width, count)[start - first * self.block : stop - first * self.block]


class _Ids:
    """Ids of known pre-tokens in one array, gathered for many texts at once."""

    def __init__(self, path: str, end_id: int):
        self.vocabulary, self.end_id = pretokens.load(path), end_id
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.array([self.end_id], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text with its end id, and all ids."""
        gc.disable()  # a batch makes millions of strings and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        groups = [self.vocabulary.groups(t) for t in texts]
        flat = list(chain.from_iterable(groups))
        found = np.fromiter(map(self.index.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(found < 0).tolist()
        new = {flat[i] for i in missing}
        if len(self.index) + len(new) > KEPT:
            self.clear()
            new, missing = set(flat), range(len(flat))
        new = sorted(new, key=len)  # the long ones last, to be dropped after the batch
        encoded = self.vocabulary.encode(new)
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        base, before = len(self.sizes), self.flat.size
        added = np.fromiter(chain.from_iterable(encoded), np.uint32, int(sizes.sum()))
        self.flat = np.concatenate([self.flat, added])
        self.starts = np.concatenate([self.starts, before + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.index.update(zip(new, range(base, base + len(new))))
        found[missing] = np.fromiter((self.index[flat[i]] for i in missing), np.int64, len(missing))

        counts = np.array([len(g) + 1 for g in groups], np.int64)
        ends = np.cumsum(counts)
        at = np.zeros(int(counts.sum()), np.int64)  # 0 is the end of a document
        inside = np.ones(at.size, bool)
        inside[ends - 1] = False
        at[inside] = found
        n = self.sizes[at]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[at] - upto + n, n) + np.arange(int(upto[-1]))] if at.size else self.flat[:0]
        totals = np.add.reduceat(n, ends - counts) if counts.size else counts

        long = sum(len(g) > LONGEST for g in new)
        if long:
            for g in new[len(new) - long :]:
                del self.index[g]
            keep = len(self.sizes) - long
            self.flat = self.flat[: int(self.starts[keep])]
            self.starts, self.sizes = self.starts[:keep], self.sizes[:keep]
        return totals, ids


_ids: dict[tuple[str, int], _Ids] = {}


def _loaded(path: str, end_id: int) -> _Ids:
    """Kept by the Python worker from task to task."""
    if (path, end_id) not in _ids:
        _ids[path, end_id] = _Ids(path, end_id)
    return _ids[path, end_id]


def write_token_files(docs: DataFrame, path: str, end_id: int, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs`` into files under ``folder`` (shared by all executors); returns the list of files.

    Documents are ordered by id, null ids first, and for equal ids by text. The list has ``position``,
    ``file``, ``ids``, ``documents`` and ``start`` (ids in all files before). A file belongs to the
    table only if it is listed: a task that is run again leaves at most an unlisted file behind.
    """
    ordered = (
        docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
        .repartitionByRange("id", "h")
        .sortWithinPartitions("id", "h", "text")
        .select("id", "text")
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _loaded(path, end_id)
        position = TaskContext.get().partitionId()
        name = f"{folder}/part-{position:06d}-{uuid.uuid4().hex}.bits"
        fs, place = store(name)
        fs.create_dir(place.rpartition("/")[0])
        with fs.open_output_stream(place) as sink:
            out = Writer(sink, max(1, (ids.vocabulary.size - 1).bit_length()))
            for batch in batches:
                texts = batch.column("text").to_pylist()
                out.add(batch.column("id").to_pylist(), *ids.encode(texts))
            out.close()
        rows = sum(len(d) for d in out.documents)
        yield pa.RecordBatch.from_pydict({"position": [position], "file": [name], "ids": [out.ids], "documents": [rows]})

    files, _ = written(ordered.mapInArrow(encode, "position long, file string, ids long, documents long"), "token-files")
    earlier = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))


def read_token_files(files: DataFrame, columns: Sequence[str] = ("ids",), at_once: int = 1 << 20) -> DataFrame:
    """Documents of the listed files: ``doc_id``, ``start``, ``n_tokens`` and, if asked for, ``ids`` and ``ids_crc32``.

    A file is read in runs of documents with about ``at_once`` ids together.
    """
    kinds = {"ids": pa.list_(pa.int32()), "ids_crc32": pa.int64()}
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), *[(c, kinds[c]) for c in columns]])
    text = {"ids": "array<int>", "ids_crc32": "long"}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for listed in (row for b in batches for row in b.to_pylist()):
            fs, place = store(listed["file"])
            with fs.open_input_file(place) as source:
                opened = TokenFile(source)
                d = opened.documents
                runs = np.flatnonzero(np.diff(d["start"] // at_once, prepend=-1))
                for a, b in zip(runs, [*runs[1:], len(d)]):
                    part = d[a:b]
                    base = int(part["start"][0])
                    ids = opened.read(base, int(part["start"][-1] + part["count"][-1]))
                    ends = np.cumsum(part["count"])
                    made = {
                        "doc_id": pa.array(part["id"], mask=part["none"].astype(bool)),
                        "start": pa.array(part["start"] + listed["start"]),
                        "n_tokens": pa.array(part["count"]),
                    }
                    if "ids" in columns:
                        made["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), ids.astype(np.int32))
                    if "ids_crc32" in columns:
                        raw, edge = ids.astype("<u4"), [0, *ends.tolist()]
                        made["ids_crc32"] = pa.array([zlib.crc32(raw[x:y].tobytes()) for x, y in zip(edge, edge[1:])], pa.int64())
                    yield pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema)

    count = max(1, files.count())
    return files.select("file", "start").repartition(count).mapInArrow(
        decode, "doc_id long, start long, n_tokens long" + "".join(f", {c} {text[c]}" for c in columns)
    )


def token_files(docs: DataFrame, path: str, end_id: int = 1, columns: Sequence[str] = ("ids_crc32",), **names: str) -> DataFrame:
    """Write ``docs`` to token files in the shared scratch folder and read the documents back from them.

    Defined cases: null and empty texts hold the end id alone; repeated rows are documents of their own;
    null ids come first and stay null; no rows give no rows. Other columns are not stored.
    """
    spark = docs.sparkSession
    folder = qualified(spark, scratch_folder(spark, "tokens"))
    return read_token_files(write_token_files(docs, path, end_id, folder, **names), columns)
