"""Round trips, known files, disposal and transparency."""

import base64
import hashlib
import random
import zlib

import numpy as np

from maskloom.llm import gif



def test_known_file():
    media = bytes.fromhex("474946383961" "0A000A00910000FFFFFFFF00000000FF000000" "21F90400000000002C000000000A000A0000" "02168C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B".replace(" ", ""))
    ((delay, canvas),) = [(d, c.copy()) for d, c in gif.read_gif(media)]
    top = [tuple(x) for x in canvas[0, :, :3].tolist()]
    assert delay == 0 and top == [(255, 0, 0)] * 5 + [(0, 0, 255)] * 5
    assert tuple(canvas[5, 4, :3]) == (255, 255, 255) or tuple(canvas[3, 4, :3]) == (255, 255, 255)
    tiny = base64.b64decode("R0lGODlhAQABAIAAAAAAAP///yH5BAEAAAAALAAAAAABAAEAAAIBRAA7")
    ((_, canvas),) = list(gif.read_gif(tiny))
    assert canvas.shape == (1, 1, 4) and canvas[0, 0, 3] == 0


def test_lzw_round_trip():
    rnd = random.Random(1)
    for n, letters in ((1, 256), (2, 1), (576, 4), (576, 256), (5000, 1), (30_000, 3), (30_000, 256), (70_000, 20)):
        data = bytes(rnd.randrange(letters) for _ in range(n))
        codes = np.array(gif.lzw_codes(data, 8))
        (packed,) = gif.pack_codes(codes, np.array([len(codes)]), 8)
        assert gif.lzw_pixels(packed, 8, n) == gif.lzw_pixels_of_all([(packed, 8, n)])[0] == data, (n, letters)


def test_many_images_at_once():
    rnd = random.Random(2)
    rows = [bytes(rnd.randrange(letters) for _ in range(576)) for letters in (1, 2, 3, 20, 256) for _ in range(8)] + [bytes(k % 256 for k in range(576)), b"ab" * 288, bytes((k * k) % 251 for k in range(576))]
    codes, lengths = gif.lzw_codes_of_all(np.array([list(r) for r in rows], np.uint8), 8)
    assert codes.tolist() == [c for r in rows for c in gif.lzw_codes(r, 8)]
    packed = gif.pack_codes(codes, lengths, 8)
    assert gif.lzw_pixels_of_all([(d, 8, 576) for d in packed]) == rows == [gif.lzw_pixels(d, 8, 576) for d in packed]
    two = gif.pack_codes(np.array([256, *rows[0][:300], 256, *rows[0][300:], 257]), np.array([579]), 8)  # cleared on the way
    assert gif.lzw_pixels_of_all([(two[0], 8, 576)]) == [rows[0]]
    for bad in (b"", packed[0][:3], b"\x00" * 40):
        try:
            gif.lzw_pixels_of_all([(bad, 8, 576)])
            raise AssertionError
        except (ValueError, IndexError):
            pass


def test_disposal_transparency_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    frames = [
        {"pixels": bytes([1] * 16), "delay_cs": 5},
        {"pixels": bytes([2, 0, 0, 2]), "x": 1, "y": 1, "width": 2, "height": 2, "transparent": 0, "disposal": 3},
        {"pixels": bytes([3] * 4), "x": 0, "y": 0, "width": 2, "height": 2, "disposal": 2},
        {"pixels": bytes(range(4)) * 4, "interlaced": True, "transparent": 0},
    ]
    got = [(d, c.copy()) for d, c in gif.read_gif(gif.write_gif(4, 4, palette, frames))]
    assert [d for d, _ in got] == [50, 100, 100, 100]
    rgb = [c[..., :3] for _, c in got]
    assert (rgb[0] == [255, 0, 0]).all()
    assert tuple(rgb[1][1, 1]) == (0, 255, 0) and tuple(rgb[1][1, 2]) == (255, 0, 0)
    assert tuple(rgb[2][1, 1]) == (0, 0, 255) and tuple(rgb[2][2, 2]) == (255, 0, 0)
    assert got[3][1][0, 0, 3] == 0 and tuple(rgb[3][3, 3]) == (0, 0, 255) and tuple(rgb[3][3, 0]) == (255, 0, 0)
    assert (rgb[3][:, 2] == [0, 255, 0]).all()


def test_query(spark):
    texts = [None, "", "a", "é" * 288, "é" * 289, "\x00" * 5000, "word " * 40_000, "a"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in gif.digest(docs).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = got[k]
        (media,) = gif.store_samples([payload])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert got[2][1:] == got[7][1:]
    assert gif.digest(docs.limit(0)).count() == 0


def test_frames_table(spark):
    table = spark.createDataFrame([(1, bytearray(gif.store_samples([bytes(1152)])[0])), (2, None), (3, bytearray(b"GIF89a")), (4, bytearray(gif.store_samples([bytes(576)])[0][:-40]))], "id long, media binary")
    rows = gif.frames_of(table).select("id", "frame.*").collect()
    assert [(r.id, r.frame_no, r.delay_ms, len(r.pixels), r.histogram[0]) for r in rows] == [(1, 0, 100, 1728, 576), (1, 1, 100, 1728, 576)]
    assert np.frombuffer(rows[0].pixels, np.uint8).sum() == 0
