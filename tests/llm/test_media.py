import hashlib
import io
import random
import zlib

import numpy as np
import pytest

from clipmill.llm import media


def image(h, w, *rest, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, *rest)).astype(np.uint8)


def test_formats_round_trip():
    for h, w in ((1, 1), (3, 5), (7, 2), (16, 33)):
        rgb, grey = image(h, w, 3), image(h, w)
        assert (media.decode(media.encode_ppm(rgb)) == rgb).all() and (media.decode(media.encode_ppm(grey)) == grey).all()
        assert (media.decode(media.encode_bmp(rgb)) == rgb).all()


def test_other_netpbm_kinds():
    assert media.decode(b"P1 # note\n3 2\n1 0 1\n0 1 1\n").tolist() == [[1, 0, 1], [0, 1, 1]]
    assert media.decode(b"P1\n3 2\n101011").tolist() == [[1, 0, 1], [0, 1, 1]]
    assert media.decode(b"P2\n2 1\n255\n7 250").tolist() == [[7, 250]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n10 1\n\xa0\x40").tolist() == [[1, 0, 1, 0, 0, 0, 0, 0, 0, 1]]
    assert media.decode(b"P5\n1 2\n65535\n\x01\x00\x00\x02").tolist() == [[256], [2]]


def test_palette_bmp():
    head = lambda bits, colours, size: b"BM" + np.array([0, 0, 54 + 4 * colours], "<i4").tobytes() + np.array([40, 2, 1], "<i4").tobytes() + np.array([1, bits], "<i2").tobytes() + np.array([0, size, 0, 0, colours, 0], "<i4").tobytes()
    palette = bytes([0, 0, 255, 0, 255, 0, 0, 0])  # red, then blue
    for bits, row in ((8, b"\x01\x00\x00\x00"), (4, b"\x10\x00\x00\x00"), (1, b"\x80\x00\x00\x00")):
        assert media.decode(head(bits, 2, 4) + palette + row).tolist() == [[[0, 0, 255], [255, 0, 0]]]


@pytest.mark.parametrize("data", [None, b"", b"P6", b"P6\n2 2\n255\nxx", b"P7\n", b"BM", b"BM" + b"\0" * 60, b"P5\n0 1\n255\n", b"GIF89a"])
def test_damage_is_an_error(data):
    with pytest.raises(media.BadMedia):
        media.decode(data)


def test_area_resize_is_the_exact_mean():
    x = image(12, 18, 3)
    assert np.allclose(media.area_resize(x, 3, 6), x.reshape(3, 4, 6, 3, 3).mean((1, 3)))
    y = image(5, 7).astype(float)
    fine = np.repeat(np.repeat(y, 3, 0), 4, 1)  # 15 x 28 sub-pixels
    assert np.allclose(media.area_resize(y, 3, 4), fine.reshape(3, 5, 4, 7).mean((1, 3)))
    assert np.allclose(media.area_resize(y, 10, 14), np.repeat(np.repeat(y, 2, 0), 2, 1))


def test_tiles_and_hashes(spark):
    x = image(70, 90)
    found = media.tiles(x, 32)
    assert [(r, c) for r, c, *_ in found] == [(r, c) for r in range(3) for c in range(3)]
    back = np.block([[np.load(io.BytesIO(found[3 * r + c][2])) for c in range(3)] for r in range(3)])
    assert (back == x).all() and all(len(f[3]) == 16 for f in found)
    ramp = np.tile(np.arange(90), (20, 1))
    assert media.dhash(ramp) == "f" * 16 and media.dhash(ramp[:, ::-1]) == "0" * 16
    df = spark.createDataFrame([(1, media.encode_bmp(image(9, 9, 3)), "x"), (2, None, "x"), (3, b"P6 9", "x")], "id int, media binary, image string")
    rows = {r.id: r.image for r in media.to_tiles(df).selectExpr("row.id", "image").collect()}
    assert rows[1].error is None and len(rows[1].tiles) == 4 and rows[2].error and rows[3].error and media.to_tiles(df.limit(0)).count() == 0


def test_texts_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "a", "é" * 96, "x" * 192, "y" * 193, "z" * 300_000, "  ", "\x00\n"] + ["".join(rng.choice("aé𝔘\n ") for _ in range(rng.randint(0, 900))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature long").repartition(3)
    for r in media.text_media(df).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        stored = f"P6\n64 {len(payload) // 192}\n255\n".encode() + payload
        assert (r.n_bytes, r.payload_bytes, r.media_bytes) == (len(raw), len(payload), len(stored))
        assert (r.payload_sha256, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and len(r.feature) == 16
    assert media.text_media(df.limit(0)).count() == 0


def test_tiles_of_texts_are_kept(spark):
    texts = ["", "héllo " * 700, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.text_media(df).collect():
        arrays = [np.load(io.BytesIO(t.npy)) for t in r.tiles]
        assert [(t.row, t.col) for t in r.tiles] == [(0, 0), (0, 1), (1, 0), (1, 1)] and all(a.shape == (32, 32, 3) for a in arrays)
        assert [media.dhash(a) for a in arrays] == [t.dhash for t in r.tiles]
        assert r.n_tiles == 4 and r.tiles_sha256 == hashlib.sha256(b"".join(t.npy for t in r.tiles)).hexdigest()


def test_bands_change_nothing(monkeypatch):
    x = image(700, 9, 3)
    whole = [media.area_resize(x, 64, 64), media.area_resize(x, 3, 5), media.area_resize(x, 900, 20)]
    monkeypatch.setattr(media, "BAND", 64)
    assert all((a == b).all() for a, b in zip(whole, [media.area_resize(x, 64, 64), media.area_resize(x, 3, 5), media.area_resize(x, 900, 20)], strict=True))
