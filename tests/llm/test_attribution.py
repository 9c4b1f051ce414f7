import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrina.llm import attribution
from vitrina.llm.common import tokenizer_path


def token_offsets(text):
    """(first, last + 1) characters of each token, from the library's byte-level offsets."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).offsets


def brute_force(text, spans, rule):
    count, outside = [0.0] * len(spans), 0.0
    for first, stop in token_offsets(text):
        shares = [max(0, min(stop, b) - max(first, a)) for a, b in spans]
        size, covered = stop - first, sum(shares)
        if rule == "split":
            count = [c + s / size for c, s in zip(count, shares)]
            outside += (size - covered) / size
            continue
        if rule == "first":
            chosen = next((i for i, (a, b) in enumerate(spans) if a <= first < b), None)
        else:
            best = max(range(len(spans)), key=lambda i: (shares[i], -i)) if spans else None
            chosen = best if spans and shares[best] and shares[best] >= size - covered else None
        if chosen is None:
            outside += 1
        else:
            count[chosen] += 1
    return count, outside


TEXTS = [
    "one line", "first\nsecond line\n\n\nlast\n", "    indented\n\t\ttabs\n", "naïve café\n😀 grin\n你好，世界", "\n", "a\r\nb", "word " * 3000 + "\n" + "end",
]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_lines_equal_brute_force(docs_of, rule):
    rows = [*enumerate(TEXTS), (100, None), (101, ""), (102, TEXTS[1]), (102, TEXTS[1]), (None, "x")]
    found = attribution.attributed(docs_of(rows), rule=rule).toPandas()
    for i, text in enumerate(TEXTS):
        own = found[(found.doc_id == i) & (found.section >= 0)].sort_values("section")
        spans = [tuple(s) for s in attribution.line_spans(text)]
        assert "".join(text[a:b] for a, b in spans) == text
        count, outside = brute_force(text, spans, rule)
        assert np.allclose(own.n_tokens, count) and list(own.start) == [a for a, _ in spans] and outside == 0
    empty = found[found.doc_id.isin([100, 101])]
    assert list(empty.n_tokens) == [0, 0] and list(empty.n_chars) == [0, 0]
    assert len(found[found.doc_id == 102]) == 2 * len(attribution.line_spans(TEXTS[1]))
    assert found.doc_id.isna().sum() == 1


@pytest.mark.parametrize("rule", attribution.RULES)
def test_given_sections_with_gaps(spark, rule):
    text, spans = "some heading and its body text, 😀 done", [(2, 7), (7, 15), (20, 33)]
    frame = spark.createDataFrame([(1, text, spans + [None]), (2, text, None), (3, None, [(0, 5)])], "doc_id long, text string, s array<struct<start:int,stop:int>>")
    found = attribution.attributed(frame, "s", rule).toPandas().sort_values(["doc_id", "section"])
    count, outside = brute_force(text, spans, rule)
    own = found[found.doc_id == 1]
    assert np.allclose(own[own.section >= 0].n_tokens, count)
    assert np.allclose(own[own.section == attribution.OUTSIDE].n_tokens.sum(), outside)
    assert np.isclose(found[found.doc_id == 2].n_tokens.sum(), len(token_offsets(text)))
    assert list(found[found.doc_id == 3].n_chars) == [0]


def test_fields(spark):
    frame = spark.createDataFrame([(1, "tïtle", None, "body text")], "doc_id long, a string, b string, c string")
    text, sections = attribution.joined_fields(["a", "b", "c"])
    found = attribution.attributed(frame.select("doc_id", text.alias("text"), sections.alias("s")), "s", "first").orderBy("section").collect()
    assert [(r.section, r.start, r.n_chars) for r in found if r.section >= 0] == [(0, 0, 5), (1, 6, 0), (2, 7, 9)]
    assert sum(r.n_tokens for r in found) == len(token_offsets("tïtle\n\nbody text"))


def test_empty_and_wrong_rule(docs_of):
    assert attribution.attributed(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        attribution.attributed(docs_of([]), rule="any")
    assert attribution.attributed(docs_of([])).columns == ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"]
