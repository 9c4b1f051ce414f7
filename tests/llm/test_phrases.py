import hashlib

from vitrina.llm import phrases


def plain_parse(text):
    """The parse as a set of phrases, symbol by symbol."""
    found, phrase = set(), ""
    for symbol in phrases._SYMBOL.findall(text):
        phrase += symbol
        if phrase not in found:
            found.add(phrase)
            phrase = ""
    return found


def fingerprint(text):
    import xxhash

    return phrases.encoded(phrases.smallest([xxhash.xxh32_intdigest(p) for p in plain_parse(text)]))


def brute_force(rows):
    ordered = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else phrases._NO_ID), r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, other = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + other[:half]
        a, b, c = fingerprint(text), fingerprint(edited), fingerprint(other)
        near = lambda x, y: phrases.likeness(phrases.decoded(x), phrases.decoded(y))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, near(a, b), near(a, c)))
    return out


def words(n, step=7):
    return " ".join(f"w{i * i % (n + step)}" for i in range(n))


def test_equals_brute_force(docs_of):
    rows = [(i, words(5 * i + 1, i)) for i in range(90)] + [
        (100, None), (101, ""), (102, "  \n\t "), (103, "あいうえお" * 9), (104, words(9000)), (105, words(300)), (106, words(300)),
        (107, "x" * 5000), (108, "x"), (108, "y"), (None, "no id"), (-5, "negative"),
    ]
    found = [tuple(r) for r in phrases.compared(docs_of(rows)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(found, key=key) == sorted(brute_force(rows), key=key)
    by_id = {r[0]: r for r in found}
    assert by_id[105][3] == by_id[106][3] and by_id[106][6] == 1.0


def test_one_document_and_none(docs_of):
    (row,) = phrases.compared(docs_of([(1, "a b c d")])).collect()
    assert row.near_next == 1.0 and row.n_chars == 7
    assert phrases.compared(docs_of([])).count() == 0


def test_repeated_rows(docs_of):
    found = phrases.compared(docs_of([(1, "a b c")] * 50 + [(2, "d e f")] * 3)).collect()
    assert len(found) == 53 and sum(r.near_next == 1.0 for r in found) == 51


def test_likeness_and_column(docs_of):
    a, b = phrases.Parsed(words(2000)), phrases.Parsed(words(2000).replace("w4 ", "zz "))
    assert 0.8 < phrases.likeness(a.smallest, b.smallest) < 1
    assert phrases.likeness(a.smallest, phrases.Parsed("other text entirely").smallest) == 0
    assert phrases.likeness(phrases.Parsed("").smallest, phrases.Parsed("").smallest) == 1
    out = phrases.fingerprints(docs_of([(1, None), (2, "a b")])).select("doc_id", "fingerprint").collect()
    assert {r.doc_id: r.fingerprint for r in out} == {1: "", 2: fingerprint("a b")}
