"""Media columns: baseline JPEG, parsed in numpy down to the DC coefficients of the luminance.

The decoder reads markers, builds the Huffman tables, decodes the entropy-coded scan and keeps one value per 8 x 8 block:
the DC-only thumbnail. It follows the bit streams of all restart intervals (of all images of a batch with equal tables) in
step, one block position at a time, so that files with restart markers decode at array speed.

The encoder stores bytes losslessly: every byte is the DC value of one block of a grey image (quantiser 8, no AC), a row of
64 blocks is one restart interval, and an image has at most 8191 rows; longer payloads become several images in a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbor.llm import textbytes as tb
from arbor.llm.common import fresh, quoted, ship

ROW = 64
MOST_ROWS = 65535 // 8
#: Lengths of the codes for DC categories 0 to 11, as counts by length, and the categories in order (ITU T.81, table K.3).
DC_COUNTS, DC_VALUES = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12))
#: The only AC symbol of our images is the end of a block: one bit.
AC_COUNTS, AC_VALUES = (1, *[0] * 15), (0,)


def _codes(counts: tuple[int, ...], values: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol (canonical Huffman)."""
    code, at, codes, lengths = 0, 0, np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for length, n in enumerate(counts, start=1):
        for _ in range(n):
            codes[values[at]], lengths[values[at]] = code, length
            code, at = code + 1, at + 1
        code <<= 1
    return codes, lengths


@lru_cache(maxsize=64)
def _lookup(counts: tuple[int, ...], values: tuple[int, ...]) -> np.ndarray:
    """By the next 16 bits: symbol * 32 + code length, or -1."""
    table = np.full(1 << 16, -1, dtype=np.int64)
    codes, lengths = _codes(counts, values)
    for v in values:
        lo = int(codes[v]) << (16 - int(lengths[v]))
        table[lo : lo + (1 << (16 - int(lengths[v])))] = v * 32 + lengths[v]
    return table


_DC_CODE, _DC_LENGTH = _codes(DC_COUNTS, DC_VALUES)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=MOST_ROWS)
def _header(rows: int) -> bytes:
    return b"".join((
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, bytes([0, 8]) + bytes([1]) * 63),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + b"\1\x11\0"),
        _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES])),
        _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES])),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def _entropy_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stuffed bytes of every row of 64 samples in turn, and how many bytes each row has."""
    rows = len(samples) // ROW
    value = samples.reshape(rows, ROW).astype(np.int32) - 128
    diff = value.copy()
    diff[:, 1:] -= value[:, :-1]
    diff = diff.ravel()
    size = np.zeros(len(diff), dtype=np.int64)
    for bit in range(9):
        size += np.abs(diff) >= (1 << bit)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    length = _DC_LENGTH[size] + size + 1
    word = ((_DC_CODE[size] << size) | extra) << 1  # the end of the block is a single 0
    row_bits = length.reshape(rows, ROW).sum(axis=1)
    pad = -row_bits % 8
    word = np.concatenate([word.reshape(rows, ROW), ((1 << pad) - 1)[:, None]], axis=1).ravel()
    length = np.concatenate([length.reshape(rows, ROW), pad[:, None]], axis=1).ravel()
    at = np.cumsum(length) - length
    byte, value = at >> 3, word << (32 - length - (at & 7))  # at most 18 bits from any bit of a byte: 4 bytes hold them
    new = np.flatnonzero(np.diff(byte, prepend=-1))
    value, byte = np.add.reduceat(value, new), byte[new]
    raw = np.zeros(int(at[-1] + length[-1]) // 8 + 4, dtype=np.uint8)
    for k in range(4):
        raw[byte + k] |= (value >> (24 - 8 * k) & 255).astype(np.uint8)
    raw = raw[:-4]
    bytes_of = (row_bits + pad) // 8
    stuffed = np.flatnonzero(raw == 0xFF)
    if len(stuffed):
        row_end = np.cumsum(bytes_of)
        bytes_of = bytes_of + np.bincount(np.searchsorted(row_end, stuffed, side="right"), minlength=rows)
        raw = np.insert(raw, stuffed + 1, 0)
    return raw, bytes_of


def encode_all(payloads: list[bytes]) -> list[bytes]:
    """For each payload, whose length is a positive multiple of 64, baseline JPEG images that hold it, one after the other."""
    if any(not len(p) or len(p) % ROW for p in payloads):
        raise ValueError("the payload must have a positive multiple of 64 bytes")
    if not payloads:
        return []
    raw, sizes = _entropy_rows(np.frombuffer(b"".join(payloads), dtype=np.uint8))
    per_image = [(min(MOST_ROWS, len(p) // ROW - lo)) for p in payloads for lo in range(0, len(p) // ROW, MOST_ROWS)]
    ends = np.cumsum(per_image)
    nth = np.arange(len(sizes)) - np.repeat(ends - per_image, per_image)
    marks = np.empty(len(sizes) * 2, dtype=np.uint8)
    marks[0::2], marks[1::2] = 0xFF, 0xD0 + nth % 8
    marks[ends * 2 - 1] = 0xD9
    row_end = np.cumsum(sizes)
    stream = np.insert(raw, np.repeat(row_end, 2), marks).tobytes()
    bounds = np.concatenate([[0], (row_end + 2 * np.arange(1, len(sizes) + 1))[ends - 1]]).tolist()
    images = iter([_header(rows) + stream[lo:hi] for rows, lo, hi in zip(per_image, bounds, bounds[1:], strict=False)])
    return [b"".join(next(images) for _ in range(0, len(p) // ROW, MOST_ROWS)) for p in payloads]


def encode(payload: bytes) -> bytes:
    """:func:`encode_all` of one payload."""
    return encode_all([bytes(payload)])[0]


@dataclass
class _Image:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical sampling, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple[tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)
    restart: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component index, DC table, AC table
    clean: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint8))  # entropy-coded bytes, unstuffed
    bounds: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))  # of the restart intervals in them


def parse(data: bytes | np.ndarray, at: int = 0) -> tuple[_Image, int]:
    """The image that starts at a byte, and where it ends. Raises ValueError for what isn't baseline JPEG."""
    raw = np.frombuffer(data, dtype=np.uint8) if not isinstance(data, np.ndarray) else data
    if raw[at : at + 2].tobytes() != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = _Image(), at + 2
    while True:
        if at + 2 > len(raw) or raw[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker = int(raw[at + 1])
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return image, at + 2
        if at + 4 > len(raw):
            raise ValueError("the file is cut short")
        size = int(raw[at + 2]) << 8 | int(raw[at + 3])
        body = raw[at + 4 : at + 2 + size].tobytes()
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], dtype=">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            bits, image.height, image.width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("samples must have 8 bits")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline images are read")
        elif marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                n = sum(counts)
                image.tables[body[0]] = counts, tuple(body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            image.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            ids = [c[0] for c in image.components]
            image.scan = [(ids.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, 16 + (body[2 + 2 * i] & 15)) for i in range(body[0])]
            marks = np.flatnonzero(raw[at:-1] == 0xFF) + at
            after = raw[marks + 1]
            stop = marks[(after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7))]
            end = int(stop[0]) if len(stop) else len(raw)
            cuts = marks[(after >= 0xD0) & (after <= 0xD7) & (marks < end)]
            stuffing = marks[(after == 0) & (marks < end)] + 1
            keep = np.ones(end - at, dtype=bool)
            keep[stuffing - at] = False
            keep[np.concatenate([cuts, cuts + 1]) - at] = False
            kept = np.concatenate([[0], np.cumsum(keep)])
            clean = raw[at:end][keep]
            image.clean, image.bounds = clean, np.concatenate([[0], kept[cuts - at], [len(clean)]])
            at = end


def _layout(image: _Image) -> tuple:
    """What images must share to be decoded in step: the blocks of a unit with their tables, and the units in a row."""
    if not image.scan:
        raise ValueError("no scan")
    tables = lambda s: (s[0], image.tables[s[1]], image.tables[s[2]])
    if len(image.scan) == 1:
        return ((*tables(image.scan[0]), 0, 0),), -(-image.width // 8), 1, 1
    top_h = max(c[1] for c in image.components)
    blocks = tuple((*tables(s), x, y) for s in image.scan for y in range(image.components[s[0]][2]) for x in range(image.components[s[0]][1]))
    return blocks, -(-image.width // (8 * top_h)), image.components[0][1], image.components[0][2]


def _thumbnails(images: list[_Image]) -> list[np.ndarray]:
    """DC-only luminance of images of one layout: a sample in 0 to 255 for each 8 x 8 block of the first component."""
    blocks, mcus_x, h, v = _layout(images[0])
    clean = np.concatenate([*(i.clean for i in images), np.zeros(8, dtype=np.uint8)])
    shift = np.cumsum([0, *(len(i.clean) for i in images)])
    mcus_y = [-(-i.height // (8 * (1 if len(i.scan) == 1 else max(c[2] for c in i.components)))) for i in images]
    starts, stops, sizes, first, base = [], [], [], [], np.cumsum([0, *(y * v * mcus_x * h for y in mcus_y)])
    for i, y, lo, place in zip(images, mcus_y, shift, base, strict=False):
        total = mcus_x * y
        each = i.restart or total
        n = -(-total // each)
        if len(i.bounds) - 1 != n:
            raise ValueError("restart markers are missing")
        starts.append(i.bounds[:-1] + lo)
        stops.append(i.bounds[1:] + lo)
        sizes.append(np.minimum(each, total - each * np.arange(n)))
        first.append(np.stack([np.arange(n) * each, np.full(n, place)]))
    at, stop, size_of = np.concatenate(starts) * 8, np.concatenate(stops) * 8, np.concatenate(sizes)
    mcu0, place = np.concatenate(first, axis=1)
    word = clean.astype(np.int64)
    window = word[:-4] << 32 | word[1:-3] << 24 | word[2:-2] << 16 | word[3:-1] << 8 | word[4:]
    limit = int(shift[-1])
    luts = {id(t): _lookup(*t) for b in blocks for t in b[1:3]}
    predicted = np.zeros((max(b[0] for b in blocks) + 1, len(at)), dtype=np.int64)
    out = np.zeros(int(base[-1]), dtype=np.int64)
    for m in range(int(size_of.max(initial=0))):
        everyone = bool((size_of > m).all())
        live = slice(None) if everyone else np.flatnonzero(size_of > m)
        p = at[live]
        mcu = mcu0[live] + m
        for comp, dc, ac, bx, by in blocks:
            low = p & 7
            near = window[np.minimum(p >> 3, limit)]
            entry = luts[id(dc)][(near >> (24 - low)) & 0xFFFF]
            if entry.min() < 0:
                raise ValueError("a code that the table doesn't have")
            size = entry >> 5
            used = (entry & 31) + size
            value = (near >> (40 - low - used)) & ((1 << size) - 1)
            value += np.where(value < (1 << size) >> 1, 1 - (1 << size), 0)
            p = p + used
            value += predicted[comp, live]
            predicted[comp, live] = value
            entry = luts[id(ac)][(window[np.minimum(p >> 3, limit)] >> (24 - (p & 7))) & 0xFFFF]
            todo, left = np.zeros(0, dtype=np.int64), p
            if (entry >> 5).any():
                todo, left = np.arange(len(p)), np.full(len(p), 63)
            else:  # every block ends at once
                p += entry
            while len(todo):
                q = p[todo]
                entry = luts[id(ac)][(window[np.minimum(q >> 3, limit)] >> (24 - (q & 7))) & 0xFFFF]
                if (entry < 0).any():
                    raise ValueError("a code that the table doesn't have")
                symbol = entry >> 5
                p[todo] = q + (entry & 31) + (symbol & 15)
                left[todo] -= np.where(symbol == 0, 64, (symbol >> 4) + 1)
                todo = todo[left[todo] > 0]
            if comp == 0:
                y, x = np.divmod(mcu, mcus_x)
                out[place[live] + (y * v + by) * (mcus_x * h) + x * h + bx] = value
        at[live] = p
    if (at > stop).any():
        raise ValueError("the scan is cut short")
    thumbs = []
    for i, lo, hi in zip(images, base, base[1:], strict=False):
        q = int(i.quantisers[i.components[0][3]][0])
        grid = np.clip((out[lo:hi] * q + 1028) >> 3, 0, 255).astype(np.uint8).reshape(-1, mcus_x * h)
        thumbs.append(grid[: -(-i.height // 8), : -(-i.width // 8)])
    return thumbs


def thumbnails_all(files: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each file, (width, height, DC-only luminance thumbnail) of every image in it."""
    images, layouts = [], {}
    for f, media in enumerate(files):
        raw, at = np.frombuffer(media, dtype=np.uint8), 0
        while at < len(raw):
            image, at = parse(raw, at)
            layouts.setdefault(_layout(image), []).append(len(images))
            images.append((f, image))
    thumbs: dict[int, np.ndarray] = {}
    for which in layouts.values():
        thumbs.update(zip(which, _thumbnails([images[i][1] for i in which]), strict=True))
    out: list[list] = [[] for _ in files]
    for i, (f, image) in enumerate(images):
        out[f].append((image.width, image.height, thumbs[i]))
    return out


def thumbnails(media: bytes) -> list[tuple[int, int, np.ndarray]]:
    """:func:`thumbnails_all` of one file."""
    return thumbnails_all([media])[0]


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 areas is brighter than their mean, in 16 hexadecimal digits."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 9).astype(int)
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), dtype=np.int64)
    sums[1:, 1:] = thumb.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    lo_r, lo_c = np.minimum(rows[:-1], thumb.shape[0] - 1), np.minimum(cols[:-1], thumb.shape[1] - 1)
    hi_r, hi_c = np.maximum(rows[1:], lo_r + 1), np.maximum(cols[1:], lo_c + 1)
    area = sums[np.ix_(hi_r, hi_c)] - sums[np.ix_(lo_r, hi_c)] - sums[np.ix_(hi_r, lo_c)] + sums[np.ix_(lo_r, lo_c)]
    mean = area / ((hi_r - lo_r)[:, None] * (hi_c - lo_c)[None, :])
    return f"{int(''.join('1' if x else '0' for x in (mean > mean.mean()).ravel()), 2):016x}"


def pad(text: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return text + bytes(-len(text) % ROW or (ROW if not text else 0))


def describe_all(files: list[bytes]) -> list[tuple[bytes, str]]:
    """The payloads read back from stored bytes, and their features: width x height : hash of every image, joined by ``+``."""
    return [(b"".join(t.tobytes() for _, _, t in found), "+".join(f"{w}x{h}:{average_hash(t)}" for w, h, t in found)) for found in thumbnails_all(files)]


def describe(media: bytes) -> tuple[bytes, str]:
    """:func:`describe_all` of one file."""
    return describe_all([media])[0]


FIELDS = (("n_bytes", "long"), ("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string"))


def store_long(text: bytes, with_media: bool = True) -> tuple[tuple, bytes]:
    """The values of FIELDS for one text and its media bytes, image by image, so that memory is a few times the text."""
    payload = memoryview(pad(text))
    media, seen, kept, features, size = hashlib.sha256(), hashlib.sha256(), [], [], 0
    for lo in range(0, len(payload), MOST_ROWS * ROW):
        image = encode(payload[lo : lo + MOST_ROWS * ROW])
        back, feature = describe(image)
        media.update(image)
        seen.update(back)
        features.append(feature)
        size += len(image)
        tail = back[-ROW:]
        if with_media:
            kept.append(image)
    return (len(text), len(payload), seen.hexdigest(), zlib.crc32(tail), size, media.hexdigest(), "+".join(features)), b"".join(kept)


def _storing(with_media: bool):
    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tb.buffers(batch.column(batch.num_columns - 1))
            for lo, hi in tb.spans(offs):
                texts = [data[offs[i] : offs[i + 1]].tobytes() for i in range(lo, hi)]
                different = list(dict.fromkeys(t for t in texts if len(t) <= MOST_ROWS * ROW))
                media = encode_all([pad(t) for t in different])
                known = {t: store_long(t, with_media) for t in texts if len(t) > MOST_ROWS * ROW} | {
                    t: ((len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature), m)
                    for t, m, (payload, feature) in zip(different, media, describe_all(media), strict=True)
                }
                rows, files = [known[t][0] for t in texts], [known[t][1] for t in texts]
                columns = [pa.array(c, pa.string() if kind == "string" else pa.int64()) for c, (_, kind) in zip(zip(*rows, strict=True), FIELDS, strict=True)]
                more = [pa.array(files, pa.binary())] if with_media else []
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), *columns, *more], names=[*batch.schema.names[:-1], *(n for n, _ in FIELDS), *["media"] * with_media])

    return store


def media_columns(docs: DataFrame, text_col: str = "text", with_media: bool = True) -> DataFrame:
    """``docs``, all columns but those of these names, with the stored JPEG bytes (media) and what is read back from them.

    A null text counts as empty: 64 zero bytes are stored, so every row has a file. Equal texts have equal values.
    """
    ship(docs.sparkSession)
    new = {n for n, _ in FIELDS} | {"media"}
    kept = [c for c in docs.columns if c.lower() not in new]
    text = fresh(docs, "media_text")
    inner = docs.select(*map(quoted, kept), F.coalesce(quoted(text_col).cast("string"), F.lit("")).cast("binary").alias(text))
    schema = type(inner.schema)([f for f in inner.schema if f.name != text])
    for n, kind in (*FIELDS, *[("media", "binary")] * with_media):
        schema = schema.add(n, kind)
    return inner.mapInArrow(_storing(with_media), schema)
