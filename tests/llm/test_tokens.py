"""Token counts and token files against the library on whole texts, and exact round trips."""

import io
import random
import zlib

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from strandline.llm import token_files as tf
from strandline.llm.pretokens import PreTokens
from strandline.llm.token_counts import token_counts

BYTES, WORDS = path("byte_bpe_50k.json"), path("word_bpe_49k.json")
PARTS = [
    "Hello", "world's", "they'll", "'s", "ΣΊΣΥΦΟΣ", "İstanbul", "été", "́", "漢字かな", "١٢٣", "12345", "...", "!?", " ", "  ", "   ", "\n", "\n\n",
    "\t", "\r\n", "\x0b", "\x1c", "\x1d ", "\x1f", "\x85", "\xa0", " ", "　", "​", " ", "\x00", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
    "<|endoftext", "😀👍🏽", "ß", "ﬁ", "﻿", "a" * 300, "_", "ͅ", "ǅ", "K",
]


def texts(n=400, seed=1):
    rng = random.Random(seed)
    out = ["", " ", "\n", "a", " a ", "<|endoftext|>", "a<|endoftext|>b", "x" * 50_000, "word " * 40_000]
    for _ in range(n):
        joint = rng.choice(["", " ", " ", "\n"])
        out.append(joint.join(rng.choice(PARTS) for _ in range(rng.randint(1, 25))))
    for _ in range(n):
        out.append("".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0x1F300, 0x1FAFF), 32, 32])) for _ in range(rng.randint(1, 40))))
    return out


@pytest.mark.parametrize("file", [BYTES, WORDS])
def test_groups_encode_as_the_whole_text(file):
    own, library = PreTokens(file), Tokenizer.from_file(file)
    for t in texts(3000, seed=7):
        groups = own.groups(t)
        assert [i for e in own.encode(groups) for i in e] == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_every_character_between_others():
    for file in (BYTES, WORDS):
        own, library = PreTokens(file), Tokenizer.from_file(file)
        cases = [f"ab{chr(c)}.{chr(c)} c{chr(c)}{chr(c)}" for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 17 == 0)]
        want = [e.ids for e in library.encode_batch_fast(cases, add_special_tokens=False)]
        for t, w in zip(cases, want):
            assert [i for e in own.encode(own.groups(t)) for i in e] == w, repr(t)


def test_counts(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(-1, None, 1), (None, "null id", None), (3, "a", 1)]
    got = token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int"), BYTES, limit=20).collect()
    want = []
    for i, t, _ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 20))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 31, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    data = tf.pack(ids, width)
    assert len(data) == -(-1001 * width // 8)
    assert (tf.unpack(data, width, 1001) == ids).all()


@pytest.mark.parametrize("width,block", [(16, 8), (13, 64), (16, 1 << 16)])
def test_random_access(width, block):
    import pyarrow as pa

    rng = np.random.default_rng(0)
    sink, everything = io.BytesIO(), []
    out = tf.Writer(sink, width, block)
    for _ in range(30):
        counts = rng.integers(1, 40, rng.integers(0, 5))
        ids = rng.integers(0, 1 << width, int(counts.sum())).astype(np.uint32)
        out.add([None] * len(counts), counts, ids)
        everything.append(ids)
    out.close()
    file = tf.TokenFile(pa.BufferReader(sink.getvalue()))
    whole = np.concatenate(everything)
    assert file.ids == whole.size and (file.read(0, whole.size) == whole).all()
    for a, b in rng.integers(0, whole.size, (50, 2)):
        assert (file.read(int(a), int(b)) == whole[int(a) : int(b)]).all()


def test_files(spark):
    library = Tokenizer.from_file(WORDS)
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(None, "no id", "x"), (7, None, "x"), (7, "again", None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = sorted(map(tuple, tf.token_files(df, WORDS, columns=("ids", "ids_crc32")).collect()), key=lambda r: r[1])
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r[0] for r in got] == [r[0] for r in ordered]
    start = 0
    wanted = {}
    for i, t, _ in ordered:
        wanted.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    for i, at, n, ids, crc in got:
        assert at == start and n == len(ids) and ids in wanted[i]
        wanted[i].remove(ids)
        assert crc == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += n
    assert not any(wanted.values())
    assert tf.token_files(df.limit(0), WORDS).count() == 0
