import zlib

import numpy as np
import pytest

from vitrina.llm import packing
from vitrina.llm.common import byte_bpe, tokenizer_path


def tokens_of(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", [
    "", " ", "a  b\n\n c\t", "it's I'LL we're", "naïve café ½ ⅷ １２", "你好 世界", "😀👩‍👩‍👧", "<|endoftext|> x", "a  <|endoftext|><|endoftext|>\n\nb <|endoftext|", " \u0085\xa0 x", "x" * 300,
])
def test_ids_equal_those_of_the_library(text):
    encode, sizes = byte_bpe(tokenizer_path("byte_bpe_50k.json"))
    ids = encode(text)
    assert ids == tokens_of(text)
    assert sum(int(sizes[i]) for i in ids) == len(text.encode())


def test_runs_of_white_space_that_overflow_the_fast_splitter():
    encode, _ = byte_bpe(tokenizer_path("byte_bpe_50k.json"))
    assert len(encode("\n" * 1_000_000)) == 500_000


def test_differencing_levels_windows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 500, 400)
    window = packing.differencing(sizes, 20)
    sums = np.bincount(window, sizes, 20)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 5
    # The published example: 8 7 6 5 4 into two sets differ by 2.
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]


def test_windows_rise_when_capacity_is_exceeded():
    window, windows = packing.pack(np.array([6, 6, 6]), 10)
    assert windows == 3 and sorted(window) == [0, 1, 2]
    assert packing.pack(np.array([5, 5, 5, 5]), 10)[1] == 2


def test_pieces_round_trip(docs_of):
    rng = np.random.default_rng(2)
    texts = [None, "", "one", "one", "tie tie", " ".join(f"word{i}" for i in range(6000))]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 999, rng.integers(1, 700))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")]
    found = packing.packed(docs_of(rows).coalesce(1)).toPandas()
    assert list(found.columns) == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    for doc_id, text in rows:
        own = found[found.doc_id == doc_id] if doc_id is not None else found[found.doc_id.isna()]
        ids = np.array([*tokens_of(text), 1], "<u4")
        at = 0
        for piece in own.sort_values("start").itertuples():
            assert piece.start == at and piece.doc_tokens == len(ids)
            assert piece.ids_crc32 == zlib.crc32(ids[at:at + piece.length].tobytes())
            at += piece.length
        assert at == len(ids)
    for _, sequence in found.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert list(sequence.offset) == [0, *np.cumsum(sequence.length)[:-1]]
        assert sequence.length.sum() <= packing.WINDOW
    used = found.sequence_id.nunique() * packing.WINDOW
    assert found.length.sum() / used > 0.95


def test_no_rows(docs_of):
    assert packing.packed(docs_of([])).count() == 0
