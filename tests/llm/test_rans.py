import zlib
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitrina.llm import rans
from vitrina.llm.common import tokenizer_path
from vitrina.session import scratch_dir

TEXTS = [
    None, "", " \n", "Hello WORLD, it's", "e\u0301 \u0301x İstanbul ΣΑΣ", "<|endoftext|> a<|startoftext|>b", "x" * 3000,
    "你好 世界😀 a  b\n\n", "12,345 ...!!! don't WE'LL", "a\x1cb c\u200bq \x85 \u3000 z",
    "Ends. here, (so) 3.14; x'. a\"», <|ENDOFTEXT|>", "A'S'T don't''ve x'll.'s '' ~!@#'re #1's <|endoftext|", "ÀÖØÞßÿ ÉCOLE's ÷× naïve\u0301 «Straße» ª² Ÿ", "".join(map(chr, range(1, 300))), " ".join(map(chr, range(33, 400))),
]


@lru_cache(maxsize=1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def library_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_ids_equal_those_of_the_library():
    words = rans.Words(tokenizer_path("word_bpe_49k.json"))
    for _ in range(2):
        ids, ends = words.encode(pa.array(TEXTS, pa.string()), 2)
        for i, text in enumerate(TEXTS):
            assert ids[ends[i]:ends[i + 1]].tolist() == [*library_ids(text), 2]
        # Without an added token in the batch.
        for text in TEXTS:
            assert words.encode(pa.array([text], pa.string()), 2)[0].tolist() == [*library_ids(text), 2]


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 131_072, 400_001])
def test_round_trip_of_a_block(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n), 49_000).astype("<u2")
    table = rans.Table.of(np.bincount(ids, minlength=49_408))
    assert int(table.shares.sum()) == 1 << table.bits
    data = rans.Block.packed(3, 1, 77, [None, 5], [n // 2, n - n // 2], ids, table)
    block = rans.Block(data)
    assert (block.ids(table) == ids).all() and (block.part, block.number, block.first) == (3, 1, 77)
    assert (block.between(n // 3, n // 2, table) == ids[n // 3:n // 2]).all()
    # A decoder may begin at any checkpoint.
    if n > rans.LANES * rans.STEPS:
        assert (block.piece(1, table) == ids[131_072:262_144]).all()
        shares = np.bincount(ids) / n
        assert 8 * len(data) / n < 1.1 * -(shares[shares > 0] * np.log2(shares[shares > 0])).sum() + 0.5


def test_damage_is_found():
    ids = np.arange(5000, dtype="<u2") % 77
    table = rans.Table.of(np.bincount(ids, minlength=100))
    data = bytearray(rans.Block.packed(0, 0, 0, [1], [5000], ids, table))
    data[len(data) // 2] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.Block(bytes(data))
    other = rans.Table.of(np.arange(1, 101))
    with pytest.raises(ValueError, match="another table"):
        rans.Block(rans.Block.packed(0, 0, 0, [1], [5000], ids, table)).ids(other)


def test_a_table_of_one_id_and_of_none():
    only = rans.Table.of(np.bincount([4] * 9, minlength=10))
    ids = np.full(1000, 4, "<u2")
    assert (rans.Block(rans.Block.packed(0, 0, 0, [1], [1000], ids, only)).ids(only) == ids).all()
    assert int(rans.Table.of(np.zeros(10, np.int64)).shares.sum()) == 1 << 16


def test_files_round_trip(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(9)
    texts = TEXTS + [" ".join(f"w{x}" for x in rng.integers(0, 500, rng.integers(1, 400))) for _ in range(80)]
    rows = [(i * 7 - 30, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None), (40, "twice"), (40, "twice"), (40, "other")]
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 2000)
    path = scratch_dir(spark, "files")
    rans.write(docs_of(rows), path)
    assert [p for p in Path(path, "blocks").iterdir() if p.name.startswith("part-")]
    found = [tuple(r) for r in rans.read(spark, path).withColumn("crc", F.crc32("ids")).orderBy("start").collect()]
    assert sorted((r[0] is not None, r[0] or 0) for r in found) == [(r[0] is not None, r[0] or 0) for r in found]
    at = 0
    left = [(i, np.array([*library_ids(t), 2], "<u4").tobytes()) for i, t in rows]
    for doc_id, start, n, ids, crc in found:
        assert start == at and len(ids) == 4 * n and crc == zlib.crc32(ids)
        left.remove((doc_id, bytes(ids)))
        at += n
    assert not left


def test_no_rows(spark, docs_of):
    path = scratch_dir(spark, "files")
    rans.write(docs_of([]), path)
    assert rans.read(spark, path).count() == 0
