from collections import defaultdict

import __spark_entry__ as e


def test_single_author_over_all_turns(spark, sf):
    roles = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        roles[r.conv_id].add(r.role)
    expected = {i: min(x) if len(x) == 1 else None for i, x in roles.items()}
    assert {r.document_id: r.author for r in e.queries()["single_author"](spark, sf).collect()} == expected


def test_decisions_follow_the_signatures(spark, sf):
    cases = defaultdict(lambda: defaultdict(list))
    for r in e.queries()["signature_cascade"](spark, sf).collect():
        cases[r.new_id][r.verdict].append(r.old_id)
    expected = {(new, old, "superseded") for new, x in cases.items() for old in x["auto"]}
    expected |= {(new, max(x["gray"]), "review") for new, x in cases.items() if x["gray"] and not x["auto"]}
    found = [tuple(r) for r in e.queries()["gray_predecessor"](spark, sf).collect()]
    assert expected and sorted(found) == sorted(expected)


def test_claims_of_whole_turns(spark, sf):
    expected = set()
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        text = r.text.replace("\n", " ")
        claims = [c for c in (text.strip(), f"[x] {text}".strip(), "told", "[only]", "1234. kept") if c]
        expected |= {(r.conv_id, r.turn, n, c) for n, c in enumerate(claims)}
    assert any(len(x[3]) > 100 for x in expected)
    assert {tuple(r) for r in e.queries()["claim_lines"](spark, sf).collect()} == expected


def test_a_long_block_is_asked_for_by_its_length(spark):
    """Pairs that may share a long block wait for review only if one run of 300 words is shared."""
    from clipmill.operators import neardup

    run = [f"w{i}" for i in range(320)]
    apart = [x for i in range(0, 320, 40) for x in [*run[i : i + 40], f"gap{i}"]]
    own = lambda n: [f"o{n}_{i}" for i in range(400)]
    texts = [" ".join(x) for x in (own(1) + run, own(2) + run, own(3) + apart)]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "id long, text string")
    pairs = spark.createDataFrame([(1, 2, "prompt_if_block", 0.3), (1, 3, "prompt_if_block", 0.3), (2, 3, "prompt", 0.5)], "a long, b long, verdict string, jaccard double")
    none = spark.createDataFrame([], "from_document_id long, to_document_id long, resolution string")
    assert sorted((r.a, r.b) for r in neardup.scan_links(pairs, docs, none)[1].collect()) == [(1, 2), (2, 3)]
