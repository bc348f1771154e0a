"""Media columns: baseline JPEG, written and read in numpy.

``encode`` stores any bytes, without loss, as the DC coefficients of a grey image: one 8 x 8 block for each byte, one row
of blocks for each restart interval (quantiser 8, so a block's mean luminance is its byte).  Rows have 24 blocks, more
only where the image would be too high for the format; data beyond the largest image goes on in further images, one
after the other.

``decode`` reads baseline JPEG in general: it parses the markers (DQT, SOF0, DHT, DRI, SOS), takes the scan apart at its
restart markers, and Huffman-decodes the intervals of all images of a batch in step with one another, a symbol of each at
a time.  It gives the dimensions and the DC-only luminance thumbnail.  The thumbnail's hash tells for each cell of an
8 x 8 grid whether it is lighter than the mean.

A null text is an empty one, which has one payload unit of bytes 255.  Equal texts, and so repeated rows, have equal
values, long texts go on in further images, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from densigrid.llm.ship import map_texts, ship

#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576
WIDTHS = (24, 48, 96, 192, 576)
MOST_ROWS = 65535 // 8
#: Code lengths of the DC categories 0 to 8 that are written (the AC table holds the end of block alone, one bit).
DC_BITS = (3, 4, 4, 3, 3, 3, 3, 3, 5)


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, length, code) in a DHT segment's order."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            out.append((symbol, length, code))
            code += 1
        k += n
        code <<= 1
    return out


def dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(v == n for v in lengths.values()) for n in range(1, 17)]
    return b"\xff\xc4" + struct.pack(">HB", 19 + len(order), kind) + bytes(counts) + bytes(order)


_DC = dht(0x00, dict(enumerate(DC_BITS)))
_AC = dht(0x10, {0: 1})
_CODES = {s: (n, c) for s, n, c in canonical(list(_DC[5:21]), list(_DC[21:]))}
_LEN = np.array([_CODES[s][0] for s in range(9)])
_CODE = np.array([_CODES[s][1] for s in range(9)])
_CATEGORY = np.array([abs(d).bit_length() for d in range(-255, 256)])


def head(width: int, rows: int) -> bytes:
    """All that stands before the scan's data."""
    return (
        b"\xff\xd8"
        + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8] * 64)
        + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, rows * 8, width * 8, 1, 1, 0x11, 0)
        + _DC + _AC
        + b"\xff\xdd" + struct.pack(">HH", 4, width)
        + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 0, 63, 0)
    )


def pieces(size: int) -> list[tuple[int, int, int]]:
    """(start, width, rows in blocks) of the images that hold so many bytes."""
    out, start = [], 0
    while start < size:
        left = min(size - start, WIDTHS[-1] * MOST_ROWS)
        width = next(w for w in WIDTHS if left <= w * MOST_ROWS)
        out.append((start, width, left // width))
        start += left
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload (a positive multiple of UNIT bytes) as one or more JPEG images."""
    if not payloads:
        return []
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int32)
    images, base = [], 0
    for k, p in enumerate(payloads):
        images += [(k, base + s, w, r) for s, w, r in pieces(len(p))]
        base += len(p)
    starts = np.concatenate([s + np.arange(r) * w for _, s, w, r in images])
    diff = np.empty(len(data), np.int32)
    diff[1:] = data[1:] - data[:-1]
    diff[starts] = data[starts] - 128
    size = _CATEGORY[diff + 255]
    amplitude = np.where(diff < 0, diff + (1 << size) - 1, diff)
    word = ((_CODE[size] << size) | amplitude) << 1  # the last bit, 0, ends the block
    bits = _LEN[size] + size + 1
    end = np.cumsum(bits)
    before = end - bits
    first = before[starts]  # bits before each interval, without padding
    row_bits = np.diff(np.append(first, end[-1]))
    row_bytes = (row_bits + 7) // 8
    row_at = np.cumsum(row_bytes) - row_bytes
    at = before + np.repeat(row_at * 8 - first, np.diff(np.append(starts, len(data))))
    total = int(row_bytes.sum())
    spread = word.astype(np.int64) << (24 - (at & 7) - bits)  # bits never overlap, so sums put them together
    stream = np.zeros(total + 2, np.uint8)
    for k in range(3):
        stream += np.bincount((at >> 3) + k, (spread >> (16 - 8 * k)) & 255, total + 2).astype(np.uint8)
    stream = stream[:total]
    stream[row_at + row_bytes - 1] |= ((1 << (-row_bits & 7)) - 1).astype(np.uint8)
    full = stream == 255
    # Each byte moves on by the stuffed zeros and the restart markers before it.
    number = np.concatenate([np.arange(r) for *_, r in images])
    image_first = np.cumsum([0] + [r for *_, r in images])[:-1]
    restart = np.ones(len(starts), np.int64) * 2
    restart[image_first] = 0
    stuffed = np.cumsum(full) - full
    moved = np.arange(total) + stuffed + np.repeat(np.cumsum(restart), row_bytes)
    out = np.zeros(int(total + full.sum() + restart.sum()), np.uint8)
    out[moved] = stream
    marks = np.flatnonzero(restart)
    out[moved[row_at[marks]] - 2] = 255
    out[moved[row_at[marks]] - 1] = 0xD0 + (number[marks] - 1) % 8
    cuts = np.append(moved[row_at[image_first]], len(out))
    media = [b""] * len(payloads)
    for i, (k, _, w, r) in enumerate(images):
        media[k] += head(w, r) + out[cuts[i] : cuts[i + 1]].tobytes() + b"\xff\xd9"
    return media


_tables: dict[bytes, np.ndarray] = {}


def lookup(segment: bytes) -> np.ndarray:
    """For each 16 bits ahead: length of the code there * 256 + its symbol."""
    if segment not in _tables:
        table = np.zeros(1 << 16, np.int32)
        for symbol, n, code in canonical(list(segment[:16]), list(segment[16:])):
            table[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | symbol
        _tables[segment] = table
    return _tables[segment]


class Image:
    """Dimensions, tables and scan of one image; ``at`` is where the next one may start."""

    def __init__(self, data: bytes, at: int):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG image here")
        tables: dict[int, bytes] = {}
        quant: dict[int, int] = {}
        self.restart, at = 0, at + 2
        while True:
            marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                self.height, self.width = struct.unpack_from(">HH", body, 1)
                frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline JPEG is read")
            elif marker == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    tables[body[0]] = body[1:n]
                    body = body[n:]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                use = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
                break
        alone = len(frame) == 1
        most_h, most_v = max(f[1] for f in frame), max(f[2] for f in frame)
        self.scale = (quant[frame[0][3]], 1 if alone else frame[0][1], 1 if alone else frame[0][2])
        self.mcus = (-(-self.width // (8 if alone else 8 * most_h)), -(-self.height // (8 if alone else 8 * most_v)))
        #: For each block of an MCU: component, DC table, AC table.
        self.blocks = [(c, tables[use[f[0]] >> 4], tables[0x10 | use[f[0]] & 15]) for c, f in enumerate(frame) for _ in range(1 if alone else f[1] * f[2])]
        # The scan ends at the first marker that is neither a stuffed byte nor a restart.
        scan = np.frombuffer(data, np.uint8, offset=at)
        marks = np.flatnonzero(scan[:-1] == 255)
        after = scan[marks + 1]
        rst = (after & 0xF8) == 0xD0
        stop = marks[(after != 0) & ~rst][0]
        self.at = at + int(stop) + 2
        inner = marks < stop
        gone = np.ones(stop, bool)
        gone[marks[inner] + 1] = False
        cuts = marks[inner & rst]
        gone[cuts] = False
        kept = np.cumsum(gone)
        self.scan = scan[:stop][gone]
        self.starts = np.append(0, kept[cuts])


def decode(media: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each item its images: width, height and thumbnail, the mean luminance (0 to 255) of each block."""
    images: list[Image] = []
    owner = []
    for k, data in enumerate(media):
        at = 0
        while at < len(data):
            images.append(Image(data, at))
            owner.append(k)
            at = images[-1].at
    out: list[list] = [[] for _ in media]
    kinds: dict[tuple, list[int]] = {}
    for i, im in enumerate(images):
        kinds.setdefault(tuple(im.blocks), []).append(i)
    thumbs: dict[int, np.ndarray] = {}
    for blocks, group in kinds.items():
        thumbs |= zip(group, thumbnails([images[i] for i in group], blocks))
    for i, im in enumerate(images):
        out[owner[i]].append((im.width, im.height, thumbs[i]))
    return out


def thumbnails(images: list[Image], blocks: tuple) -> list[np.ndarray]:
    """Thumbnails of images whose MCUs have the same blocks and tables: their intervals are decoded in step."""
    each, luma = len(blocks), sum(c == 0 for c, *_ in blocks)
    data = np.concatenate([*[im.scan for im in images], np.zeros(8, np.uint8)]).astype(np.int64)
    ahead = data[:-4] << 32 | data[1:-3] << 24 | data[2:-2] << 16 | data[3:-1] << 8 | data[4:]
    table = np.stack([lookup(t) for b in blocks for t in b[1:]])  # of block b: 2 * b for DC, 2 * b + 1 for AC
    component = np.array([b[0] for b in blocks])
    bit, count, spot, base, place = [], [], [], 0, 0
    for im in images:
        mcus = im.mcus[0] * im.mcus[1]
        step = im.restart or mcus
        first = np.arange(0, mcus, step)
        bit.append((base + im.starts[: len(first)]) * 8)
        count.append(np.minimum(step, mcus - first))
        spot.append(place + first * luma)
        base, place = base + len(im.scan), place + mcus * luma
    bit, count, spot = np.concatenate(bit), np.concatenate(count) * each, np.concatenate(spot)
    dc = np.zeros(place, np.int32)
    before = np.zeros((len(bit), int(component.max()) + 1), np.int64)
    block, k, row = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64), np.arange(len(bit))
    while len(row):
        word, free = ahead[bit >> 3], 40 - (bit & 7)
        kind = block % each if each > 1 else np.zeros(len(row), np.int64)
        found = table[2 * kind + (k > 0), (word >> (free - 16)) & 0xFFFF]
        length, symbol = found >> 8, found & 255
        if not length.all():
            raise ValueError("a scan has a code that its tables lack")
        size = symbol & 15
        value = (word >> (free - length - size)) & ((1 << size) - 1)
        bit = bit + length + size
        start = k == 0
        if start.any():
            value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
            c = component[kind[start]]
            before[row[start], c] += value[start]
            grey = np.flatnonzero(start)[c == 0]
            dc[spot[grey]] = before[row[grey], 0]
            spot[grey] += 1
        k = np.where(start, 1, np.where(symbol == 0, 64, k + (symbol >> 4) + 1))
        done = k >= 64
        if done.any():
            block, k = block + done, np.where(done, 0, k)
            if (ended := block >= count).any():
                bit, count, spot, block, k, row = (x[~ended] for x in (bit, count, spot, block, k, row))
    out, place = [], 0
    for im in images:
        q, h, v = im.scale
        wide, high = im.mcus
        part = dc[place : place + wide * high * luma].reshape(high, wide, v, h).transpose(0, 2, 1, 3).reshape(high * v, wide * h)
        place += wide * high * luma
        out.append(np.clip(np.rint(part * q / 8 + 128), 0, 255).astype(np.uint8)[: -(-im.height // 8), : -(-im.width // 8)])
    return out


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: is each cell of an 8 x 8 grid lighter than the mean of the cells?"""
    rows, cols = (np.arange(9) * n // 8 for n in thumb.shape)
    sums = np.pad(thumb.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    area = np.maximum(np.diff(rows)[:, None] * np.diff(cols)[None, :], 1)
    cells = (sums[rows[1:]][:, cols[1:]] - sums[rows[:-1]][:, cols[1:]] - sums[rows[1:]][:, cols[:-1]] + sums[rows[:-1]][:, cols[:-1]]) / area
    return np.packbits(cells > cells.mean()).tobytes().hex()


def store(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, n_bytes and media: the text's UTF-8 bytes (null: none), padded, as JPEG.  Equal texts, equal media."""

    def work(texts: list[str]) -> dict:
        raw = [t.encode() for t in texts]
        padded = [b + b"\xff" * (-len(b) % UNIT if b else UNIT) for b in raw]
        return {"n_bytes": pa.array([len(b) for b in raw], pa.int64()), "media": pa.array(encode(padded), pa.binary())}

    return map_texts(docs, lambda: work, "n_bytes long, media binary", keep)


def features(media: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and what the column ``media`` holds: payload and stored sizes and hashes, and ``feature``,
    ``width x height : thumbnail hash`` of each image.  Null media give nulls."""
    ship(media.sparkSession)
    source = media.select(*keep, "media")
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + ", " + fields
    names = [*keep, *[f.split()[0] for f in fields.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                stored = batch.column(len(keep)).to_pylist()
                images = iter(decode([m for m in stored if m is not None]))
                rows = []
                for m in stored:
                    if m is None:
                        rows.append((None,) * 6)
                        continue
                    found = next(images)
                    payload = b"".join(t.tobytes() for *_, t in found)
                    feature = ";".join(f"{w}x{h}:{thumbnail_hash(t)}" for w, h, t in found)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

    return source.mapInArrow(run, schema)
