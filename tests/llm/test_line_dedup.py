import random
import re

from clipmill.llm.line_dedup import line_dedup

SCHEMA = "doc_id long, text string, gone string"


def brute(rows, min_words):
    """Deletes line by line whatever lies in a run that has an earlier copy, by trying all runs."""
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    docs = {}
    for doc_id, text, _ in rows:
        if text is not None:
            docs[(doc_id is None, doc_id or 0, text)] = [x for x in text.split("\n") if words(x)]
    first, gone = {}, set()
    for key in sorted(docs, key=lambda k: k[:2]):
        lines = docs[key]
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                if sum(map(words, lines[i:j])) >= min_words:
                    first.setdefault(tuple(lines[i:j]), (key[:2], i))
    for key, lines in docs.items():
        for i in range(len(lines)):
            for j in range(i + 1, len(lines) + 1):
                run = tuple(lines[i:j])
                if run in first and first[run] < (key[:2], i):
                    gone |= {(key, p) for p in range(i, j)}
    out = {}
    for doc_id, text, _ in rows:
        key, p, kept = (doc_id is None, doc_id or 0, text), -1, []
        for line in text.split("\n") if text is not None else []:
            p += bool(words(line))
            if not words(line) or (key, p) not in gone:
                kept.append(line)
        out[(doc_id, text)] = "\n".join(kept) if text is not None else None
    return out


def check(spark, rows, min_words):
    found = line_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3), min_words=min_words)
    got = {(r.doc_id, r.before): r.text for r in found.selectExpr("row.doc_id", "row.text AS before", "text").collect()}
    assert got == brute(rows, min_words)


def test_random_runs_match_brute_force(spark):
    rng = random.Random(1)
    line = lambda: rng.choice(["a", "b b", "c c c", "d", "", "  ", "e e e e e", f"u{rng.randint(0, 99)} v"])
    for min_words in (1, 4, 9):
        rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 14))), "x") for i in range(40)]
        check(spark, rows, min_words)


def test_passage_of_over_fifty_words(spark):
    passage = "\n".join(" ".join(f"w{i}_{j}" for j in range(9)) for i in range(6))
    rows = [(1, f"one\n{passage}\ntwo", ""), (2, f"three\n\n{passage}\nfour", ""), (3, "clean text\nof its own\nwith a few lines", ""), (4, "short\nshared", ""), (5, "short\nshared", "")]
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, SCHEMA)).selectExpr("row.doc_id", "text").collect()}
    assert got == {1: rows[0][1], 2: "three\n\nfour", 3: rows[2][1], 4: rows[3][1], 5: rows[4][1]}


def test_edges(spark):
    assert line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "same line\n" * 200, ""), (None, "same line\n" * 60, ""), (2, None, ""), (3, "", ""), (4, "\n\n", ""), (1, "same line\n" * 200, "")]
    check(spark, rows[:2] + rows[2:5], 50)
    found = line_dedup(spark.createDataFrame(rows, SCHEMA)).selectExpr("row.doc_id", "n_lines", "n_deleted").collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_deleted) for r in found) == [(0, 60, 60), (1, 200, 199), (1, 200, 199), (2, 0, 0), (3, 0, 0), (4, 0, 0)]


def test_long_text(spark):
    text = "\n".join(f"line number {i % 3000} of a long text" for i in range(6000))
    r = line_dedup(spark.createDataFrame([(1, text, "")], SCHEMA)).first()
    assert r.n_deleted == 3000 and r.text == "\n".join(text.split("\n")[:3000])
