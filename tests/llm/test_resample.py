import hashlib
import math
import random
import re
import zlib
from collections import Counter

from clipmill.llm import resample

SCHEMA = "doc_id long, text string, rank string"  # a column name that clashes with an output
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(rows, target, min_words=20, percent=10, grams=1):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, text, _ in rows:
        s.update(features(text))
    for (text,) in target:
        t.update(features(text))
    all_s, all_t, out = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + 10000.0)) / ((s[b] + 1.0) * (all_t + 10000.0))))
    for i, text, _ in rows:
        f = features(text)
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    fit = sorted((r for r in out if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def some_rows(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Été", "ÉTÉ", "naïve", "日本", "x y", "a_b", "A1"]
    text = lambda: rng.choice([" ", "\n", "--"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))
    rows = [(rng.choice([None, *range(n)]), text(), "x") for _ in range(n)] + [(1, None, "x"), (2, "", None), (None, "!?", "x")]
    return rows + [rows[0]] * 40, [(text(),) for _ in range(20)] + [(None,)]


def test_digest_against_brute_force(spark):
    rows, target = some_rows(400)
    found = resample.digest(spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(target, "text string")).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows, target))


def test_long_text_and_hot_rows(spark):
    rows = [(5, "hot words " * 15, "x")] * 600 + [(i, f"plain {i} " * 12, "x") for i in range(300)] + [(9, "long " * 200_000, "x")]
    target = [("hot words",)]
    found = resample.digest(spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(target, "text string")).collect()
    assert Counter(map(tuple, found)) == Counter(brute(rows, target))
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 91))


def test_runs_of_several_words(spark):
    rows, target = some_rows(120, 3)
    weighed = resample.weigh(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(target, "text string"), grams=3)
    assert Counter((r.row.doc_id, r.n_features, r.weight, r.score) for r in weighed.collect()) == Counter(r[:4] for r in brute(rows, target, grams=3))


def test_drawn_rows_come_whole(spark):
    rows, target = some_rows(500, 7)
    drawn = resample.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(target, "text string"), percent=30).collect()
    taken = Counter(r[:4] for r in brute(rows, target, percent=30) if r[4])
    told = {r: t for r, t in zip(brute(rows, target, percent=30), rows, strict=True)}
    assert Counter(r.doc_id for r in drawn) == Counter({i: sum(n for r, n in taken.items() if r[0] == i) for i in {r[0] for r in taken}})
    assert all((r.doc_id, r.text, r.rank) in set(told.values()) for r in drawn)


def test_empty_tables(spark):
    empty, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert resample.digest(empty, target).count() == 0
    assert resample.resample(empty, target).count() == 0
    one = resample.digest(spark.createDataFrame([(1, "a", "x")], SCHEMA), target).collect()
    assert [tuple(r) for r in one] == brute([(1, "a", "x")], [])


def test_target_words_score_higher(spark):
    rows = [(i, ("cat dog " if i % 2 else "sun moon ") * 20, "x") for i in range(200)]
    drawn = resample.resample(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("cat dog cat",)], "text string"), percent=20).collect()
    assert len(drawn) == 40 and all("cat" in r.text for r in drawn)
