import hashlib
import random
import re

from clipmill.llm import pii

PIECES = ["a", "b@c.d", "@", ".", "..", "%", "+", "1", "12", "255", "256", "1.2.3.4", "01.002.3.4", "+1 ", "(555)", "4111 1111 1111 1111", "4111111111111111", "-", " ", "é", "\U0001d518", "\n", "x@y.z", "a@b.co%q@d.e", "DE89370400440532013000", "00", "tel 555-123-4567", "999999999999"]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += [None, "", "1 " * 20000, "a" * 50000, "a@b.c " * 5000, ".1" * 20000, "+1" * 20000, "x@" + "a." * 20000 + "b"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(4)
    for r in pii.digest(pii.find_pii(df)).collect():
        found = brute(texts[r.doc_id] or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert hashlib.sha256(told.encode()).hexdigest() == r.base_sha256, texts[r.doc_id][:200]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(f[0] == k for f in found) for k in pii.BASE]
        assert r.spans.startswith(told)


def test_checksums_and_context(spark):
    texts = ["iban DE89 3704 0044 0532 0130 00 ok", "iban DE89 3704 0044 0532 0130 01 no", "call 555-123-4567", "item 555-123-4567", "ssn: 123-45-6789", "part 123-45-6789"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kinds = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_pii(df).selectExpr("row.doc_id", "spans").collect()}
    assert kinds == {0: ["iban"], 1: [], 2: ["tel"], 3: [], 4: ["ssn"], 5: []}


def test_redaction_and_empty_table(spark):
    df = spark.createDataFrame([(1, "to a@b.c or +1 555 123 4567!"), (2, None)], "doc_id long, text string")
    out = {r[0]: r[1] for r in pii.redact(pii.find_pii(df)).selectExpr("row.doc_id", "redacted").collect()}
    assert out == {1: "to [EMAIL] or [PHONE]!", 2: ""}
    assert pii.find_pii(df.limit(0)).count() == 0


def kinds(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r.doc_id: [(s.kind, t[s.start : s.end], s.score) for s in r.spans] for r in pii.find_pii(df).selectExpr("row.doc_id", "spans").collect() for t in [texts[r.doc_id]]}


def test_secrets_by_entropy_and_words(spark):
    token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    got = kinds(spark, [f'é token = "{token}" x', f"{token} alone", f"commit {token} of the key", "token " + "ab1" * 14, "a secret: " + "Donaudampfschifffahrtsgesellschaft",
                        "postgres://ann:pw123@db/x", "AKIA" + "ABCD1234EFGH5678", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a1" * 18, f"{token} <- api_key"])
    assert got[0] == [("secret", token, 0.7)] and got[9] == [("secret", token, 0.7)]
    assert got[1] == got[2] == got[3] == got[4] == []
    assert [[s[0] for s in got[i]] for i in (5, 6, 7, 8)] == [["login"], ["key"], ["key"], ["key"]]


def test_words_on_both_sides_and_past_other_matches(spark):
    got = kinds(spark, ["Phones: 212-555-0100, 212-555-0101", "212-555-0100 (phone)", "212-555-0100", "serial 212-555-0100 call", "x" * 5000 + " 212-555-0100 " + "y " * 15 + "tel", "host 10.0.0.1", "version 10.0.0.1"])
    assert [len(got[i]) for i in range(5)] == [2, 1, 0, 0, 1]
    assert [got[i][0][2] for i in (5, 6)] == [0.9, 0.3]  # a base kind stays, whatever its score


def test_planted_secrets_of_the_sample_table(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    planted = {r.doc_id for r in docs.collect() if re.search(r'(?i)token = "[0-9a-f]{40}"', r.text or "")}
    found = {r.doc_id for r in pii.find_pii(docs).filter("exists(spans, s -> s.kind = 'secret')").select("row.doc_id").collect()}
    assert planted and planted <= found and len(found - planted) <= 1
