"""Operator 6: GIF media columns.

A media column holds whole GIF files. decode_gif() reads the blocks of each file, expands the LZW
code streams, applies palettes, transparency and disposal and gives a column of timed frames with a
colour histogram for each; encode_samples() stores 8-bit samples as a grey GIF without loss. Both
work row by row inside Arrow batches, so a file needs no shuffle and no neighbour.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A stored frame of samples is SIDE x SIDE pixels.
SIDE = 24
FRAME = SIDE * SIDE
#: Frames that are coded together.
LANES = 2000
#: Fixed values of the format.
CLEAR_AT_FULL = 4096
INTERLACE = ((0, 8), (4, 8), (2, 4), (1, 2))

FRAMES_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("frame_no", T.IntegerType()),
            T.StructField("delay_ms", T.IntegerType()),
            T.StructField("width", T.IntegerType()),
            T.StructField("height", T.IntegerType()),
            T.StructField("pixels", T.BinaryType()),
            T.StructField("histogram", T.ArrayType(T.IntegerType())),
        ]
    )
)
_FRAMES = pa.list_(pa.struct([("frame_no", pa.int32()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int32()))]))


def lzw_codes(pixels: bytes, bits: int) -> list[int]:
    """The code stream of one image, from its clear code to its end code."""
    clear, table, following = 1 << bits, {}, (1 << bits) + 2
    out, last = [clear], pixels[0]
    known = table.get
    for c in memoryview(pixels)[1:]:
        pair = last << 8 | c
        longer = known(pair)
        if longer is not None:
            last = longer
            continue
        out.append(last)
        last = c
        if following < CLEAR_AT_FULL:
            table[pair] = following
            following += 1
        else:
            out.append(clear)
            table.clear()
            following = clear + 2
    out += (last, clear + 1)
    return out


def lzw_codes_of_all(pixels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """lzw_codes() of many images of equal size, a row each, too small to fill the table: (all codes in turn,
    number of codes of each). Each step takes the next pixel of all images; an image's pairs lie in a hash
    region of its own."""
    n, size = pixels.shape
    region = 1 << (4 * size).bit_length()
    keys, values = np.zeros(n * region, np.int32), np.zeros(n * region, np.int16)
    lane = np.arange(n) * region
    clear = 1 << bits
    out = np.zeros((n, size + 2), np.int16)
    out[:, 0] = clear
    count, following = np.ones(n, np.int64), np.full(n, clear + 2, np.int16)
    columns = np.ascontiguousarray(pixels.T).astype(np.int32)
    last = columns[0].copy()
    for c in columns[1:]:
        pair = (last << 8 | c) + 1
        slot = (pair.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(8)).astype(np.int64) & region - 1
        there = keys[lane + slot]
        left = np.flatnonzero((there != pair) & (there != 0))
        while len(left):
            slot[left] = slot[left] + 1 & region - 1
            there[left] = again = keys[lane[left] + slot[left]]
            left = left[(again != pair[left]) & (again != 0)]
        at = lane + slot
        last_before, last = last, np.where(there != 0, values[at], c)
        new = np.flatnonzero(there == 0)
        out[new, count[new]] = last_before[new]
        count[new] += 1
        keys[at[new]] = pair[new]
        values[at[new]] = following[new]
        following[new] += 1
    rows = np.arange(n)
    out[rows, count] = last
    out[rows, np.minimum(count + 1, size + 1)] = clear + 1
    if (count == size + 1).any():  # no pair occurred twice: a row is full before its end code
        out = np.concatenate([out, np.full((n, 1), clear + 1, np.int16)], axis=1)
        out[rows, count], out[rows, count + 1] = last, clear + 1
    total = count + 2
    return out[np.arange(out.shape[1]) < total[:, None]].astype(np.int64), total


def pack_codes(codes: np.ndarray, lengths: np.ndarray, bits: int) -> list[bytes]:
    """Code streams, which lie in turn in codes, as bytes each."""
    ends = np.cumsum(lengths)
    clear = 1 << bits
    at = np.arange(len(codes))
    since = at - np.maximum.accumulate(np.where(codes == clear, at, 0))  # codes since the last clear code

    def width(entries: np.ndarray) -> np.ndarray:
        """Bits of a code that is read when the reader's table has so many entries."""
        return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, bits + 1, 12)

    wide = width(clear + 2 + np.maximum(since - 2, 0))
    again = np.flatnonzero((codes == clear) & (at > 0))  # a clear code is as wide as any code in its place
    wide[again] = width(np.minimum(clear + 2 + np.maximum(since[again - 1] - 1, 0), CLEAR_AT_FULL))
    first = ends - lengths
    wide[first] = bits + 1
    total = np.cumsum(wide)
    before = total - wide
    starts = before[first]
    sizes = (total[ends - 1] - starts + 7) // 8
    bases = np.cumsum(sizes) - sizes
    place = before + np.repeat(8 * bases - starts, lengths)
    value = codes << (place & 7)
    out = np.zeros(int(sizes.sum()) + 3, np.int64)
    for k in range(3):
        np.add.at(out, (place >> 3) + k, value >> (8 * k) & 255)
    flat = out.astype(np.uint8).tobytes()
    return [flat[b : b + n] for b, n in zip(bases.tolist(), sizes.tolist(), strict=True)]


def lzw_pixels(data: bytes, bits: int, n: int) -> bytes:
    """The first n pixels of a packed code stream."""
    b = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int32)
    window = (b[:-2] | b[1:-1] << 8 | b[2:] << 16).tolist()
    clear, end = 1 << bits, (1 << bits) + 1
    base = [bytes((k,)) for k in range(clear)] + [b"", b""]
    table, width, limit, last, at, stop = base[:], bits + 1, 2 << bits, None, 0, 8 * len(data)
    out: list[bytes] = []
    while at + width <= stop:
        code = window[at >> 3] >> (at & 7) & (limit - 1)
        at += width
        if code == clear:
            table, width, limit, last = base[:], bits + 1, 2 << bits, None
            continue
        if code == end:
            break
        if last is None:
            entry = table[code]
        else:
            size = len(table)
            if code < size:
                entry = table[code]
            elif code == size:
                entry = last + last[:1]
            else:
                raise ValueError("code beyond the table")
            if size < CLEAR_AT_FULL:
                table.append(last + entry[:1])
                if size + 1 == limit and width < 12:
                    width += 1
                    limit *= 2
        out.append(entry)
        last = entry
    pixels = b"".join(out)
    if len(pixels) < n:
        raise ValueError("too few pixels")
    return pixels[:n]


def lzw_pixels_of_all(images: list[tuple[bytes, int, int]]) -> list[bytes]:
    """lzw_pixels() of many (data, bits, n). Images of 8 bits and equal n whose table can't fill are expanded
    together: the width of each code then follows from its place alone."""
    out: list = [None] * len(images)
    together: dict[int, list[int]] = {}
    for k, (data, bits, n) in enumerate(images):
        if bits == 8 and 0 < n <= 2048 and len(data) <= 2 * n + 16:
            together.setdefault(n, []).append(k)
        else:
            out[k] = lzw_pixels(data, bits, n)
    for n, ks in together.items():
        step = max(1, (1 << 20) // n)
        for i in range(0, len(ks), step):
            part = ks[i : i + step]
            for k, pixels in zip(part, _expanded([images[k][0] for k in part], n), strict=True):
                out[k] = pixels if pixels is not None else lzw_pixels(*images[k])
    return out


def _expanded(data: list[bytes], n: int) -> list[bytes | None]:
    """Pixels of code streams of 8 bits, None where a stream is not one clear code, codes and an end code."""
    most = n + 2
    k = np.arange(most)
    wide = np.where(k < 2, 9, np.floor(np.log2(258 + np.maximum(k - 2, 0))).astype(np.int64) + 1)
    offset = np.cumsum(wide) - wide
    row = int(offset[-1] + 12) // 8 + 4
    flat = np.frombuffer(b"".join(d[:row].ljust(row, b"\0") for d in data), np.uint8).reshape(len(data), row).astype(np.int32)
    window = flat[:, :-2] | flat[:, 1:-1] << 8 | flat[:, 2:] << 16
    codes = window[:, offset >> 3] >> (offset & 7) & (1 << wide) - 1
    lanes = np.arange(len(data))
    stop = (codes == 257).argmax(axis=1)
    lengths = np.zeros((len(data), most), np.int64)
    good = (codes[:, 0] == 256) & (stop > 1) & (8 * np.fromiter(map(len, data), np.int64) >= offset[stop] + wide[stop])
    source = codes - 257  # of a longer code: the place of the code that begins the same string
    columns, places = np.ascontiguousarray(codes.T), np.ascontiguousarray(source.T)
    steps = np.zeros((most, len(data)), np.int64)
    for j in range(1, int(stop.max()) if len(stop) else 0):
        c = columns[j]
        longer = c > 257
        good &= ~((j < stop) & ((c == 256) | (longer & (places[j] >= j))))
        steps[j] = np.where(longer, steps[np.clip(places[j], 0, most - 1), lanes] + 1, 1)
    lengths = np.where((k >= 1) & (k < stop[:, None]), steps.T, 0)
    good &= lengths.sum(axis=1) >= n
    lengths[~good] = 0
    ends = np.cumsum(lengths, axis=1)
    begin = ends - lengths
    total = ends[:, -1]
    base = np.cumsum(total) - total  # where a stream's pixels start
    count = lengths.ravel()
    where = np.repeat(begin.ravel() + np.repeat(base, most), count)  # start of the string that a pixel is in
    place = np.arange(len(where))
    code = np.repeat(codes.ravel(), count)
    first = np.repeat(base, total) + begin.ravel()[np.repeat(lanes, total) * most + np.clip(np.repeat(source.ravel(), count), 0, most - 1)] if len(where) else place
    pointer = np.where(code < 256, place, first + place - where)
    while True:
        further = pointer[pointer]
        if (further == pointer).all():
            break
        pointer = further
    pixels = code[pointer].astype(np.uint8).tobytes()
    return [pixels[b : b + n] if g else None for b, g in zip(base.tolist(), good.tolist(), strict=True)]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(p),)) + p for p in (data[k : k + 255] for k in range(0, len(data), 255))) + b"\0"


def write_gif(width: int, height: int, palette: bytes, frames: list[dict], packed: list[bytes] | None = None) -> bytes:
    """A GIF of frames {pixels: indices, and any of x, y, width, height, delay_cs, disposal, transparent,
    interlaced, palette}; the global palette has 2 to 256 entries, a power of two. packed: the frames' code
    streams, where they are known already."""
    bits = max(2, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (len(palette) // 3 - 1).bit_length() - 1, 0, 0), palette]
    if packed is None:
        packed = []
        for f in frames:
            w, h, rows = f.get("width", width), f.get("height", height), f["pixels"]
            if f.get("interlaced"):
                rows = b"".join(rows[y * w : y * w + w] for a, step in INTERLACE for y in range(a, h, step))
            codes = np.array(lzw_codes(rows, bits), np.int64)
            packed += pack_codes(codes, np.array([len(codes)]), bits)
    for f, data in zip(frames, packed, strict=True):
        clear = f.get("transparent")
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.get("disposal", 1) << 2 | (clear is not None), f.get("delay_cs", 10), clear or 0, 0))
        own = f.get("palette", b"")
        flags = (0x40 if f.get("interlaced") else 0) | (0x80 | (len(own) // 3 - 1).bit_length() - 1 if own else 0)
        out.append(struct.pack("<BHHHHB", 0x2C, f.get("x", 0), f.get("y", 0), f.get("width", width), f.get("height", height), flags))
        out += (own, bytes((bits,)), _blocks(data))
    return b"".join(out) + b"\x3b"


def _joined(media: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := media[at]:
        parts.append(media[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(parts), at + 1


def _parsed(media: bytes) -> tuple[int, int, list[tuple]]:
    """(width, height, images): of each image (delay in ms, transparent index, disposal, x, y, w, h, interlaced,
    palette, code bits, code stream). ValueError, IndexError or struct.error for what is no GIF."""
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags = struct.unpack_from("<HHB", media, 6)
    at = 13

    def colours(flags: int, at: int) -> tuple[np.ndarray | None, int]:
        if not flags & 0x80:
            return None, at
        n = 2 << (flags & 7)
        table = np.full((256, 4), 255, np.uint8)
        table[n:, :3] = 0
        table[:n, :3] = np.frombuffer(media, np.uint8, 3 * n, at).reshape(n, 3)
        return table, at + 3 * n

    everywhere, at = colours(flags, at)
    delay, clear, disposal = 0, None, 0
    images = []
    while (kind := media[at]) != 0x3B:
        if kind == 0x21:
            if media[at + 1] == 0xF9:
                packed, hundredths, index = struct.unpack_from("<BHB", media, at + 3)
                delay, clear, disposal = hundredths * 10, index if packed & 1 else None, packed >> 2 & 7
            at = _joined(media, at + 2)[1]
            continue
        if kind != 0x2C:
            raise ValueError("unknown block")
        x, y, w, h, flags = struct.unpack_from("<HHHHB", media, at + 1)
        table, at = colours(flags, at + 10)
        table = everywhere if table is None else table
        if table is None:
            raise ValueError("no palette")
        bits = media[at]
        data, at = _joined(media, at + 1)
        images.append((delay, clear, disposal, x, y, w, h, bool(flags & 0x40), table, bits, data))
        delay, clear, disposal = 0, None, 0
    return width, height, images


def _shown(width: int, height: int, images: list[tuple], streams: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(delay in ms, canvas of height x width x RGBA) of each frame in turn."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for (delay, clear, disposal, x, y, w, h, interlaced, table, _, _), stream in zip(images, streams, strict=True):
        pixels = np.frombuffer(stream, np.uint8).reshape(h, w)
        if interlaced:
            order = [r for a, step in INTERLACE for r in range(a, h, step)]
            turned = np.empty_like(pixels)
            turned[order] = pixels
            pixels = turned
        h, w = min(h, height - y), min(w, width - x)
        pixels = pixels[:h, :w]
        before = canvas.copy() if disposal == 3 else None
        area = canvas[y : y + h, x : x + w]
        drawn = table[pixels]
        if clear is None:
            area[:] = drawn
        else:
            np.copyto(area, drawn, where=(pixels != clear)[..., None])
        yield delay, canvas
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def read_gif(media: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(delay in ms, canvas of height x width x RGBA) of each frame in turn. A frame's canvas is the picture
    shown for its time; ValueError, IndexError or struct.error for what is no GIF."""
    width, height, images = _parsed(media)
    return _shown(width, height, images, lzw_pixels_of_all([(x[10], x[9], x[5] * x[6]) for x in images]))


def colour_bins(rgb: np.ndarray) -> list[int]:
    """Counts of 4 x 4 x 4 colours: two leading bits of red, green and blue."""
    bins = (rgb[..., 0] >> 6).astype(np.intp) << 4 | rgb[..., 1] >> 6 << 2 | rgb[..., 2] >> 6
    return np.bincount(bins.ravel(), minlength=64).tolist()


def _frames(media: list[bytes | None], grey: bool) -> list[list[dict] | None]:
    """The frames of several files; their code streams are expanded together."""
    parsed: list = []
    for x in media:
        try:
            parsed.append(None if x is None else _parsed(x))
        except (ValueError, IndexError, struct.error):
            parsed.append(None)
    wanted = [(k, (x[10], x[9], x[5] * x[6])) for k, p in enumerate(parsed) if p for x in p[2]]
    try:
        streams = lzw_pixels_of_all([x for _, x in wanted])
    except (ValueError, IndexError):
        if len(media) == 1:
            return [None]
        return [y for x in media for y in _frames([x], grey)]
    own: list[list[bytes]] = [[] for _ in media]
    for (k, _), stream in zip(wanted, streams, strict=True):
        own[k].append(stream)
    out: list = []
    for p, pixels in zip(parsed, own, strict=True):
        if p is None:
            out.append(None)
            continue
        out.append([])
        for n, (delay, canvas) in enumerate(_shown(*p, pixels)):
            rgb = canvas[..., :3]
            out[-1].append({"frame_no": n, "delay_ms": delay, "width": canvas.shape[1], "height": canvas.shape[0], "pixels": canvas[..., 0].tobytes() if grey else rgb.tobytes(), "histogram": colour_bins(rgb)})
    return out


def _in_parts(rows: list, size: int = 4 << 20) -> Iterator[list]:
    """rows, some MB at a time."""
    part, n = [], 0
    for x in rows:
        part.append(x)
        n += len(x or b"")
        if n >= size:
            yield part
            part, n = [], 0
    if part:
        yield part


@F.arrow_udf(FRAMES_TYPE)
def _decode_rgb(media: pa.Array) -> pa.Array:
    return pa.array([y for part in _in_parts(media.to_pylist()) for y in _frames(part, False)], _FRAMES)


@F.arrow_udf(FRAMES_TYPE)
def _decode_grey(media: pa.Array) -> pa.Array:
    return pa.array([y for part in _in_parts(media.to_pylist()) for y in _frames(part, True)], _FRAMES)


def decode_gif(media: Column, grey: bool = False) -> Column:
    """Frames of a media column: frame_no, delay_ms, width, height, pixels (RGB, or one sample for each pixel of
    grey media) and a histogram of 64 colours. Null for null and for what is no whole GIF."""
    return _decode_grey(media) if grey else _decode_rgb(media)


def frames_of(table: DataFrame, media: str = "media", grey: bool = False) -> DataFrame:
    """A row for each frame: the other columns of table and those of the frame."""
    others = [c for c in table.columns if c != media]
    return table.select(*others, F.explode(decode_gif(F.col(media), grey)).alias("frame"))


_GREY = bytes(v for k in range(256) for v in (k, k, k))


def store_samples(payloads: list[bytes]) -> list[bytes]:
    """8-bit samples, a whole number of frames each, as grey GIFs of SIDE x SIDE pixels, a tenth of a second a frame."""
    if not payloads:
        return []
    pixels = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME)
    packed: list[bytes] = []
    for k in range(0, len(pixels), LANES):
        packed += pack_codes(*lzw_codes_of_all(pixels[k : k + LANES], 8), 8)
    out, at = [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(write_gif(SIDE, SIDE, _GREY, [{}] * n, packed[at : at + n]))
        at += n
    return out


@F.arrow_udf(T.BinaryType())
def encode_samples(text: pa.Array) -> pa.Array:
    """The UTF-8 of each text (null: empty), padded with 255 to a positive number of whole frames, as a GIF."""
    rows = (x or b"" for x in text.cast(pa.large_binary()).to_pylist())
    padded = [raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME) for raw in rows]
    return pa.array([y for part in _in_parts(padded) for y in store_samples(part)], pa.binary())


_DIGEST = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("feature", T.StringType())])


@F.arrow_udf(_DIGEST)
def samples_digest(frames: pa.Array) -> pa.Array:
    """Of grey frames: the size and hash of all samples in turn, the checksum of the last 32, and as the
    feature the number of frames with the summed histogram of the four grey levels that occur in it."""
    out = []
    cells, ends = frames.flatten(), np.concatenate([[0], np.cumsum(frames.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
    pixels = cells.field("pixels").to_pylist()
    bins = cells.field("histogram").flatten().to_numpy(zero_copy_only=False).reshape(-1, 64)
    for a, b in zip(ends, ends[1:], strict=False):
        payload = b"".join(pixels[a:b])
        levels = bins[a:b].sum(axis=0)[[0, 21, 42, 63]]
        out.append({"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "feature": f"{b - a};" + ",".join(map(str, levels.tolist()))})
    return pa.array(out, pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("feature", pa.string())]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of
    docs(doc_id, text), a row for each row."""
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), encode_samples(F.col("text")).alias("media"))
    read = stored.select(
        "doc_id",
        "n_bytes",
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        samples_digest(decode_gif(F.col("media"), grey=True)).alias("d"),
    )
    return read.select("doc_id", "n_bytes", "d.payload_bytes", "d.payload_sha256", "d.tail_crc32", "media_bytes", "media_sha256", "d.feature")
