import itertools
import zlib

import numpy as np
from pyspark.sql import functions as F

from clipmill.llm import quality_crf as q
from clipmill.llm.common import table


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(0)
    counts = np.array([3, 1, 5, 2])
    emit, move = rng.normal(size=(counts.sum(), 2)), rng.normal(size=(2, 2))
    marginal, pair, whole = q.forward_backward(emit, counts, move)
    at, total, moves = 0, 0.0, np.zeros((2, 2))
    for n in counts:
        paths = list(itertools.product((0, 1), repeat=int(n)))
        weight = np.array([np.exp(sum(emit[at + t, s] for t, s in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        total += np.log(weight.sum())
        for t in range(n):
            assert np.isclose(marginal[at + t, 1], sum(w for w, p in zip(weight, paths) if p[t]) / weight.sum())
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                moves[a, b] += w / weight.sum()
        at += n
    assert np.isclose(whole, total) and np.allclose(pair, moves)


def test_features_do_not_depend_on_the_batch():
    texts = ["One two.\nTHREE FOUR!!\n\nfive five five", "", "é Ñ\n", "x" * 1000, "a | b | c\na | b | c"]
    x, counts, chars = q.line_features([t.encode() for t in texts])
    at = 0
    for t, n in zip(texts, counts):
        assert n == t.count("\n") + 1
        assert np.allclose(x[at : at + n], q.line_features([t.encode()])[0])
        assert chars[at : at + n].tolist() == [len(line) for line in t.split("\n")]
        at += n


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = q.train(docs, labels)
    scored = q.score(docs, model).select("row.doc_id", "score").join(labels, "doc_id").filter(q.held_out(F.col("doc_id"))).collect()
    right = [(r.score >= q.CUTOFF) == (r.quality == 1) for r in scored]
    assert len(right) > 50 and sum(right) / len(right) > 0.97


def test_held_out_rule(spark):
    df = spark.range(200).withColumn("h", q.held_out(F.col("id")))
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in df.collect())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "A fine line.", 2.0), (3, "\n\n \n", 2.0), (4, "word " * 40_000, 2.0), (4, "word " * 40_000, 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    for model in (q.train(docs, labels), q.train(docs, labels.limit(0))):
        rows = q.score(docs, model).selectExpr("row.doc_id", "row.text", "score").collect()
        assert all(0 <= r.score <= 1 for r in rows) and all(r.score == 0 for r in rows if not (r.text or "").strip())
        assert len({r.score for r in rows if r.doc_id == 4}) == 1
    assert q.score(docs.limit(0), model).count() == 0


def test_expectation_keeps_the_share_and_the_chain():
    rng = np.random.default_rng(2)
    counts, labels = np.array([4, 6, 1, 5]), np.array([1, 0, 0, 1])
    emit, move = rng.normal(size=(16, 2)), rng.normal(size=(2, 2))
    weight = rng.integers(1, 50, 16).astype(float)
    marginal, pair = q.within_share(emit, counts, move, weight, labels)
    starts = np.cumsum(counts) - counts
    share = np.add.reduceat(weight * marginal[:, 1], starts) / np.add.reduceat(weight, starts)
    assert (share[labels == 1] >= q.SHARE_GOOD - 1e-6).all() and (share[labels == 0] <= q.SHARE_BAD + 1e-6).all()
    assert np.isclose(pair.sum(), (counts - 1).sum())
    free, _, _ = q.forward_backward(emit, counts, move)
    easy = q.within_share(np.stack([np.zeros(16), np.repeat(np.where(labels > 0, 20.0, -20.0), counts)], 1), counts, move, weight, labels)[0]
    assert not np.allclose(marginal, free) and np.allclose(easy[:, 1], np.repeat(labels, counts), atol=1e-3)  # a bound that holds changes nothing


def test_lines_of_a_half_junk_document(spark):
    """Held-out clean and junk lines put together: the lines get their own labels, the document a score between."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = q.train(docs, labels)
    known = docs.join(labels, "doc_id").filter(q.held_out(F.col("doc_id"))).select("text", "quality").collect()
    lines = {k: sorted({x for r in known if r.quality == k for x in r.text.split("\n") if len(x) > 80})[:400] for k in (0, 1)}
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        halves = [[str(x) for x in rng.choice(lines[k], 6, replace=False)] for k in (1, 0)]
        rows.append((i, "\n".join(halves[0] + halves[1])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = np.array([r.lines for r in q.label_lines(df, model).orderBy("row.doc_id").collect()])
    assert told.shape == (40, 12)
    assert ((told[:, :6] > 0.5).mean() + (told[:, 6:] < 0.5).mean()) / 2 > 0.85
    scores = [r.score for r in q.score(df, model).collect()]
    assert 0.25 < np.mean(scores) < 0.75
    assert np.linalg.norm(model.move) > 0
    empty = q.label_lines(spark.createDataFrame([(1, None), (2, "a\n\nb")], "doc_id long, text string"), model).collect()
    assert [len(r.lines) for r in empty] == [1, 3]
