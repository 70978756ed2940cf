import hashlib

import __spark_entry__ as e


def test_all_lanes_match_brute_force(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join(words[:37] + ["x", "y", "z"]), " ".join(words[:30] + ["q"] * 3 + words[33:]), "one two"]
    sf = f"file://{tmp_path}"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    sets = [{" ".join(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else set(w) for w in map(str.split, texts)]
    low = {(i, k): min(hashlib.md5(f"{k}:{s}".encode()).hexdigest() for s in x) for i, x in enumerate(sets) for k in range(128)}
    assert {(r.doc_id, r.lane): r.low for r in e.queries()["minhash_md5_signature"](spark, sf).collect()} == low
    found = {(r.a, r.b): r.estimate for r in e.queries()["minhash_jaccard"](spark, sf).collect()}
    near = [(a, b) for b in range(4) for a in range(b) if len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b])]
    assert near and found == {(a, b): sum(low[a, k] == low[b, k] for k in range(128)) / 128 for a, b in near}
