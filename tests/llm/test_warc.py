import pytest
import base64
import gzip
import hashlib
import random

from clipmill.llm import warc
from clipmill.llm.common import work_dir

SCHEMA = "page_id long, url string, html string, payload string"


def sample(n, rng):
    return [warc.record(i, f"http://h/{i}", (p := rng.randbytes(rng.randint(0, 400)) + b"\r\n\r\nWARC/1.1 \x1f\x8b"), len(p), warc.base32_sha1(p), None) for i in range(n)]


def test_round_trip_matches_brute_force(spark):
    rows = [(3, "u", "same", "c"), (1, None, "same", "c"), (2, "a b\r\nX: y", "é" * 5000, "c"), (4, "u", None, "c"), (5, "u", "", "c"), (6, "u", "WARC/1.0\r\n\r\n", "c"), (None, "u", "same", "c"), (None, "u", "lonely", "c"), (3, "u", "same", "c")]
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    expected = []
    for page_id, _, html, _ in rows:
        ids = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first, data = min(ids, default=None), (html or "").encode()
        answer = page_id == first
        expected.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if answer else "revisit", None if answer else first))
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcdef", ""), (4, "u", "abcdef", "")], SCHEMA)
    rows = warc.to_records(df, least=3).selectExpr("page_id", "payload IS NULL AS revisit", "first").collect()
    assert sorted((r.page_id, r.revisit, r.first) for r in rows) == [(1, False, None), (2, False, None), (3, False, None), (4, True, 3)]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def covered(data, found):
    assert sum(x["length"] for x in {(x["offset"], x["length"]): x for x in found}.values()) == len(data)


def test_salvage_of_plain_and_compressed_files():
    rng = random.Random(3)
    records = sample(30, rng)
    for make in (lambda r: r, lambda r: gzip.compress(r, mtime=0)):
        parts = [make(r) for r in records]
        whole = b"".join(parts)
        assert [x["page_id"] for x in warc.salvage(whole)] == list(range(30))
        starts = [sum(map(len, parts[:i])) for i in range(31)]
        for _ in range(25):
            hit = rng.randrange(30)
            data = bytearray(whole)
            for at in range(starts[hit + 1] - 24, starts[hit + 1] - 10):
                data[at] ^= 0x5A
            found = list(warc.salvage(bytes(data)))
            assert [x["page_id"] for x in found if x["kind"] == "record"] == [i for i in range(30) if i != hit]
            gaps = [x for x in found if x["kind"] == "gap"]
            assert len(gaps) == 1 and gaps[0]["reason"] and (gaps[0]["offset"], gaps[0]["length"]) == (starts[hit], len(parts[hit]))
            covered(data, found)


def test_salvage_of_cut_and_foreign_bytes():
    records = [gzip.compress(r, mtime=0) for r in sample(6, random.Random(1))]
    data = b"junk" * 10 + records[0] + b"\x1f\x8b\x08garbage" + b"".join(records[1:5]) + records[5][:-9]
    found = list(warc.salvage(data))
    assert [x["page_id"] for x in found if x["kind"] == "record"] == [0, 1, 2, 3, 4]
    assert [x["kind"] for x in found][0] == "gap" and [x["kind"] for x in found][-1] == "gap"
    covered(data, found)
    assert list(warc.salvage(b"")) == []
    assert [x["kind"] for x in warc.salvage(b"no archive at all")] == ["gap"]
    mixed = records[0] + sample(1, random.Random(9))[0] + records[1]
    assert len([x for x in warc.salvage(mixed) if x["kind"] == "record"]) >= 2


def test_damage_inside_a_sound_member():
    inside = bytearray(sample(1, random.Random(2))[0])
    inside[-20] ^= 1
    found = list(warc.salvage(gzip.compress(bytes(inside)) + gzip.compress(sample(1, random.Random(4))[0])))
    assert [x["kind"] for x in found] == ["gap", "record"] and "digest" in found[0]["reason"]


def test_reader_logs_gaps(spark, tmp_path):
    records = [gzip.compress(r, mtime=0) for r in sample(4, random.Random(6))]
    broken = bytearray(b"".join(records))
    broken[len(records[0]) + 40] ^= 0xFF
    (tmp_path / "x.warc.gz").write_bytes(bytes(broken))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = warc.read_archives(spark, f"file://{tmp_path}").orderBy("offset").collect()
    assert [(r.kind, r.page_id) for r in rows] == [("record", 0), ("gap", None), ("record", 2), ("record", 3)]
    assert rows[1].length == len(records[1])


def test_lost_attempts_leave_no_rows(spark):
    path = work_dir(spark, "warc-test")
    df = spark.createDataFrame([(1, "u", "x", "")], SCHEMA)
    manifest = warc.write_archives(warc.to_records(df), path)
    assert manifest.selectExpr("sum(records)").first()[0] == 1
    assert warc.read_archives(spark, f"{path}/*.warc.gz").count() == 1
    warc.remove(spark, path)


PAGES = "page_id long, url string, html string"


def test_lost_records_are_an_error(spark, tmp_path):
    """A byte turned in an archive: its record goes to quarantine, the others come back, the round trip refuses."""
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 30) for i in range(20)], PAGES)
    path = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.to_records(df.coalesce(1)), path)
    found = warc.read_archives(spark, f"{path}/*.warc.gz")
    assert warc.checked(found, manifest).count() == 20
    name = next((tmp_path / "w").glob("*.gz"))
    data = bytearray(name.read_bytes())
    data[len(data) // 2] ^= 0xFF
    name.write_bytes(bytes(data))
    assert found.filter("kind = 'record'").count() == 19 and found.filter("kind <> 'record'").count() >= 1
    with pytest.raises(warc.Incomplete, match="gaps"):
        warc.checked(found, manifest)


def test_revisits_name_the_address_of_their_response(spark, tmp_path):
    rows = [(3, "http://h/three", "same"), (1, "http://h/o ne", "same"), (1, "http://h/o ne", "same"), (2, None, "same")]
    manifest = warc.write_archives(warc.to_records(spark.createDataFrame(rows, PAGES)), f"file://{tmp_path}/w")
    assert manifest.selectExpr("sum(records)").first()[0] == 4
    heads = [gzip.decompress(b"\x1f\x8b\x08" + m).decode() for f in (tmp_path / "w").glob("*.gz") for m in f.read_bytes().split(b"\x1f\x8b\x08")[1:]]
    told = [h for h in heads if "WARC-Type: revisit" in h]
    assert len(told) == 2 and all("WARC-Refers-To-Target-URI: http://h/o%20ne\r\n" in h and "WARC-Refers-To-Date: " in h for h in told)
    assert len({line for h in heads for line in h.split("\r\n") if line.startswith("WARC-Record-ID")}) == 4


def test_long_payload(spark):
    rows = [(1, "u", "é" * 3_000_000), (2, "u", "é" * 3_000_000), (3, "u", "")]
    found = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, PAGES)).collect()}
    assert found == {1: (6_000_000, "response", None), 2: (6_000_000, "revisit", 1), 3: (0, "response", None)}
