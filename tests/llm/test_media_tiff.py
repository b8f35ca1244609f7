import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tesserae.llm import media_tiff as m


@pytest.mark.parametrize("data", [b"", b"a", b"aaaa", b"abcabc" * 50, bytes(range(256)) * 40, b"\0" * 9000, np.random.default_rng(1).integers(0, 4, 30000, np.uint8).tobytes(), np.random.default_rng(2).integers(0, 256, 30000, np.uint8).tobytes()])
def test_codecs_round_trip(data):
    assert m.unpack_bits(m.pack_bits(data)) == data
    assert m.unpack_lzw(m.pack_lzw(data)) == data


def test_known_packbits_and_lzw_streams():
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert m.unpack_bits(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    # codes 256 7 258 8 8 258 6 6 257 of nine bits each, for the samples 7 7 7 8 8 7 7 6 6
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    bits += "0" * (-len(bits) % 8)
    assert m.unpack_lzw(int(bits, 2).to_bytes(len(bits) // 8, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", [m.NONE, m.LZW, m.DEFLATE, m.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 16])
def test_pages_come_back(compression, predictor, tile):
    rng = np.random.default_rng(7)
    pages = [rng.integers(0, 256, (h, w, s), np.uint8) for h, w, s in ((1, 64, 1), (70, 33, 3), (40, 16, 1))]
    read = list(m.read_tiff(m.write_tiff(pages, compression, predictor, rows_per_strip=9, tile=tile)))
    assert [p["tiled"] for p in read] == [bool(tile)] * 3
    for a, b in zip(pages, read, strict=True):
        assert np.array_equal(a, b["pixels"])


def test_big_endian_sixteen_bit_planar():
    planes = np.arange(12, dtype=">u2").reshape(2, 2, 3)  # plane, row, column
    diff = np.concatenate([planes[:, :, :1], planes[:, :, 1:] - planes[:, :, :-1]], axis=2).astype(">u2")
    strips = [zlib.compress(p.tobytes()) for p in diff]
    out = bytearray(b"MM\0*\0\0\0\0")
    at = []
    for s in strips:
        at.append(len(out))
        out += s
    arrays = len(out)
    out += struct.pack(">II", *at) + struct.pack(">II", *map(len, strips))
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 8), (273, 4, 2, arrays), (277, 3, 1, 2), (278, 3, 1, 2), (279, 4, 2, arrays + 8), (284, 3, 1, 2), (317, 3, 1, 2)]
    out[4:8] = struct.pack(">I", len(out))
    out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">I", v) if n > 1 else struct.pack(">HH", v, 0)) for t, k, n, v in tags) + b"\0\0\0\0"
    (page,) = m.read_tiff(bytes(out))
    assert np.array_equal(page["pixels"], planes.transpose(1, 2, 0))


def test_floating_point_predictor():
    values = np.linspace(-3, 9, 24, dtype=np.float32).reshape(4, 6)
    raw = values.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, 24)
    raw = np.concatenate([raw[:, :1], raw[:, 1:] - raw[:, :-1]], axis=1).astype(np.uint8).tobytes()
    tags = [(256, 3, 1, 6), (257, 3, 1, 4), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 4), (279, 4, 1, len(raw)), (317, 3, 1, 3), (339, 3, 1, 3)]
    out = b"II*\0" + struct.pack("<I", 8 + len(raw)) + raw + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, k, n, v) for t, k, n, v in tags) + b"\0\0\0\0"
    (page,) = m.read_tiff(out)
    assert np.array_equal(page["pixels"][:, :, 0], values)


def test_texts_round_trip_and_edge_rows(spark):
    texts = ["", None, "a", "x" * 64, "y" * 65, "é" * 70000, "a"]
    df = spark.createDataFrame([(i if i < 6 else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {(r.doc_id, r.n_bytes): r for r in m.text_media(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        r = rows[(i if i < 6 else None, len(raw))]
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert rows[(2, 1)].media_sha256 == rows[(None, 1)].media_sha256
    assert m.text_media(df.limit(0)).count() == 0


def test_unreadable_media_give_a_reason(spark):
    good = m.write_tiff([np.zeros((2, 3), np.uint8), np.ones((1, 1), np.uint8)])
    df = spark.createDataFrame([(1, good, "p"), (2, None, "p"), (3, b"no tiff at all", "p"), (4, good[:40], "p")], "id int, media binary, page string")
    rows = m.read_pages(df).collect()
    assert [(r.page, r.width, r.error) for r in rows if r.id == 1] == [(0, 3, None), (1, 1, None)]
    assert all(r.page is None and r.error for r in rows if r.id != 1)
    assert "media" in m.read_pages(df).columns and m.read_pages(df).columns.count("page") == 1


def plain_tiff(tags, body=b""):
    """Little-endian, one directory of fields with one LONG each (or the kind that is given), after the body."""
    fields = [(t, *(v if isinstance(v, tuple) else (4, v))) for t, v in sorted(tags.items())]
    out = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(fields))
    return out + b"".join(struct.pack("<HHII", t, kind, 1, v) for t, kind, v in fields) + b"\0\0\0\0"


GOOD = {256: 6, 257: 2, 258: 8, 259: 1, 273: 8, 277: 1, 278: 2, 279: 12}


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_small_samples(bits):
    values = np.random.default_rng(5).integers(0, 1 << bits, (5, 7))
    rows = ["".join(f"{v:0{bits}b}" for v in row) for row in values]
    body = b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8), "big") for r in rows)
    (page,) = m.read_tiff(plain_tiff(GOOD | {256: 7, 257: 5, 258: bits, 278: 5, 279: len(body)}, body))
    assert np.array_equal(page["pixels"][:, :, 0], values)


@pytest.mark.parametrize("change", [
    {322: 0, 323: 16, 324: 8, 325: 12}, {322: 16, 323: 0, 324: 8, 325: 12}, {339: 3}, {317: 3}, {317: 2, 258: 4}, {317: 9}, {256: 4_000_000_000, 257: 4_000_000_000},
    {256: 4_000_000_000}, {257: 0}, {256: 0}, {277: 0}, {277: 4_000_000_000}, {284: 7}, {278: 0}, {273: 4_000_000_000}, {258: (2, 8)}, {257: (11, 2)}, {273: (2, 8)}, {258: 13}, {259: 8},
    {259: 5}, {279: 0}, {257: 60_000, 278: 60_000, 259: 32773},
])
def test_malformed_headers_are_errors(change):
    list(m.read_tiff(plain_tiff(GOOD, bytes(range(12)))))
    with pytest.raises(m.TiffError):
        list(m.read_tiff(plain_tiff(GOOD | change, bytes(range(12)))))


def test_a_small_strip_cannot_blow_up():
    bomb = zlib.compress(b"\0" * 50_000_000)
    with pytest.raises(m.TiffError):
        list(m.read_tiff(plain_tiff(GOOD | {256: 60_000, 257: 60_000, 278: 60_000, 259: 8, 279: len(bomb)}, bomb)))
    (page,) = m.read_tiff(plain_tiff(GOOD | {259: 8, 279: len(bomb)}, bomb))
    assert page["pixels"].nbytes == 12


def test_broken_bytes_never_raise_anything_else():
    rng = random.Random(11)
    pages = [np.random.default_rng(3).integers(0, 256, (20, 30, 3), np.uint8), np.zeros((9, 5), np.uint8)]
    for compression in (m.NONE, m.LZW, m.DEFLATE, m.PACKBITS):
        good = m.write_tiff(pages, compression, tile=16)
        for _ in range(400):
            bad = bytearray(good)
            for _ in range(rng.randint(1, 6)):
                bad[rng.randrange(len(bad) - 300, len(bad)) if rng.random() < 0.8 else rng.randrange(len(bad))] = rng.choice((0, 1, 255, rng.randrange(256)))
            try:
                for page in m.read_tiff(bytes(bad[: rng.randrange(len(bad))] if rng.random() < 0.1 else bad)):
                    m.feature(page["pixels"])
            except m.TiffError:
                pass


def test_many_pages(spark):
    media = m.write_tiff([np.full((50, 64), k, np.uint8) for k in range(40)])
    rows = m.read_pages(spark.createDataFrame([(1, media), (2, media[:99]), (3, media)], "id int, media binary")).collect()
    assert [(r.id, r.page) for r in rows if r.error is None] == [(i, k) for i in (1, 3) for k in range(40)]
    assert len([r for r in rows if r.error]) == 1


def test_feature_of_any_float_page():
    pages = [[1.0, np.nextafter(1.0, 2)], [1e308, -1e308], [1e20] * 4, [np.nan, np.inf, -np.inf], [5e-324, 0.0], [1.7e308] * 70, list(np.linspace(-1, 1, 300) * 1e308)]
    for values in pages:
        for kind in (np.float32, np.float64):
            with np.errstate(over="ignore"):
                page = np.array(values, np.float64).astype(kind).reshape(1, -1, 1)
            assert m.feature(page).startswith(f"{len(values)}x1x1:")
    assert m.feature(np.array([2**63 - 1, -(2**63)], np.int64).reshape(1, 2, 1)).split(":")[3] == "1.0000"


def test_too_large_a_page_is_an_error(monkeypatch):
    monkeypatch.setattr(m, "MOST_PAGE", 50)
    data = m.write_tiff([np.zeros((3, 10), np.uint8), np.zeros((9, 10), np.uint8)])
    pages = m.read_tiff(data)
    assert next(pages)["height"] == 3
    with pytest.raises(m.TiffError, match="more than 50 bytes"):
        next(pages)


def test_bound_of_lzw():
    for raw in (b"a" * 100_000, b"ab" * 5000, bytes(range(256)) * 40, b"x"):
        packed = m.pack_lzw(raw)
        assert len(raw) <= m.most_bytes(m.LZW, len(packed))
    assert m.most_bytes(m.LZW, 1 << 20) < 1500 << 20
