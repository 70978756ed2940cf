import math
import random
from collections import Counter

import numpy as np
import pytest

from clipmill.llm import pieces

ODD = ["", None, "a  b", "▁x ▁", "日本語テキスト", "\n\n a", "🎉🎉", " ▁", "a" * 5000, " ", "   lead  ", "tab\tx\r\n", "é́ \x00", " ▁ ", "ab " * 30_000, "<0x41> <s> </s>"]


@pytest.fixture(scope="module")
def table():
    return pieces.Lattices(pieces.load(), 1.0)


def split(ids, counts):
    at = 0
    for n in counts.tolist():
        yield ids[at : at + n].tolist()
        at += n


def test_decoding_is_lossless(table):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abc é▁\n日🎉 the") for _ in range(rng.randint(0, 200))) for _ in range(200)]
    assert [table.decode(x) for x in split(*table.encode(texts, list(range(len(texts)))))] == [t or "" for t in texts]


def test_samples_do_not_depend_on_batches(table):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(60)]
    together = list(split(*table.encode(texts, list(range(60)))))
    fresh = pieces.Lattices(pieces.load(), 1.0)
    apart = [fresh.encode([t], [i])[0].tolist() for i, t in reversed(list(enumerate(texts)))][::-1]
    assert together == apart
    assert together != list(split(*table.encode(texts, [f"other{i}" for i in range(60)])))


def test_distribution_is_that_of_the_lattice(table):
    def every(s):
        if not s:
            yield (), 0.0
        for j in range(1, len(s) + 1):
            found = table.weight.get(s[:j])
            if found:
                for rest, w in every(s[j:]):
                    yield (found[0], *rest), found[1] + w

    exact = dict(every("▁there"))
    total = sum(map(math.exp, exact.values()))
    n = 30_000
    seen = Counter(map(tuple, split(*table.encode(["there"] * n, list(range(n))))))
    assert set(seen) <= set(exact)
    assert all(abs(seen[k] / n - math.exp(w) / total) < 0.015 for k, w in exact.items())


def test_both_ways_of_building_agree(table):
    one, many = pieces.Lattices(pieces.load(), 1.0), pieces.Lattices(pieces.load(), 1.0)
    chunks = [f"▁wörd{i:02d}ing" for i in range(20)]
    for c in chunks:
        one.add(c)
    many.add_all(set(chunks))
    for c in chunks:
        def walk(t, state):
            out = []
            stack = [state]
            while stack:
                s = stack.pop()
                e = int(t.start.view[s])
                while True:
                    out.append((round(float(t.upto.view[e]), 6), int(t.piece.view[e])))
                    if t.before.view[e] >= 0:
                        stack.append(int(t.before.view[e]))
                    if t.upto.view[e] >= 1:
                        break
                    e += 1
            return sorted(set(out))

        assert walk(one, one.end[c]) == walk(many, many.end[c])


def edges(t, state):
    """(place's share, piece, state before) of the pieces that end at a state, the longest first."""
    out, e = [], int(t.start.view[state])
    while True:
        out.append((t.upto.view[e], int(t.piece.view[e]), int(t.before.view[e])))
        if t.upto.view[e] >= 1:
            return out
        e += 1


def test_chunks_of_all_lengths_go_side_by_side(monkeypatch):
    """Each call handles chunks of many lengths at once, with the same tables as one by one."""
    rng = random.Random(4)
    one, many = pieces.Lattices(pieces.load(), 1.0), pieces.Lattices(pieces.load(), 1.0)
    letters = "theinrsaoé.日🎉\x01" + pieces.LITERAL
    chunks = {"▁" * rng.randint(0, 2) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(600)} | {"a" * 200, "▁" + "the" * 40}
    calls, side = [], many.add_side_by_side
    monkeypatch.setattr(many, "add_side_by_side", lambda *a: calls.append(1) or side(*a))
    many.add_all(chunks)
    assert len(calls) == 1
    assert len(many.end) == len(chunks)
    spelled = lambda t, code: code if code < t.size else tuple(t.rows[code - t.size])
    for c in chunks:
        one.add(c)
        todo = {(one.end[c], many.end[c])}
        while todo:
            a, b = todo.pop()
            x, y = edges(one, a), edges(many, b)
            assert [spelled(one, e[1]) for e in x] == [spelled(many, e[1]) for e in y]
            assert [e[0] for e in x] == pytest.approx([e[0] for e in y], abs=1e-6)
            assert [e[2] < 0 for e in x] == [e[2] < 0 for e in y]
            todo |= {(e[2], f[2]) for e, f in zip(x, y, strict=True) if e[2] >= 0}


def test_every_piece_is_found_by_its_characters(table):
    for name, (piece, weight) in list(table.weight.items())[::16]:
        node = table.first[ord(name[0])]
        for c in name[1:]:
            node = table.child(np.array([node]), np.array([ord(c)]))[0]
        assert node > 0 and table.node_piece[node] == piece and table.node_weight[node] == weight
    assert table.child(np.array([table.first[ord("a")]]), np.array([0x10FFFF])).tolist() == [0]


def test_operator(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(1, None, "x"), (None, "no key", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    both = pieces.round_trip(df).selectExpr("row.doc_id", "row.text", "ids", "n_pieces", "lossless").collect()
    assert len(both) == len(rows) and all(r.lossless and len(r.ids) == r.n_pieces for r in both)
    encoded = pieces.encode(df)
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.selectExpr("row.doc_id", "ids").collect()} == {(r.doc_id, tuple(r.ids)) for r in both}
    back = pieces.decode(encoded).selectExpr("row.row.text AS text", "text AS back").collect()
    assert all(r.back == (r.text or "") for r in back)
    assert pieces.round_trip(df.limit(0)).count() == 0
