"""Media columns: baseline JPEG with DC-only luminance thumbnails.

A payload is stored as an image whose samples, at an eighth of its size, are the
payload's bytes: each byte is the DC coefficient of one 8x8 block, the 63 AC
coefficients are zero, and the DC quantiser step is 8, so that the block's mean
is exactly the byte. The format's unit that holds the payload is therefore the
DC coefficient, and the DC-only thumbnail gives the bytes back without loss. A
row of the image is one restart interval of ``WIDTH`` blocks, and an image has at
most ``MOST_ROWS`` rows; a longer payload is a sequence of images.

The reader parses markers (SOI, APPn, COM, DQT, SOF0, DHT, DRI, SOS, RSTn, EOI)
and Huffman-decodes scans of any baseline JPEG, with any sampling factors and
AC coefficients, of which it keeps the luminance DC. Restart intervals are
independent of each other, so they are decoded side by side: one numpy step
takes one symbol of every interval, over all images of a block of rows.

Working memory is bounded by ``BLOCK_BYTES`` of payload at a time; of a longer text only its bytes are held.

Defined results: a null text is the empty payload, which is padded like any other;
equal texts have equal bytes and features; repeated rows are stored one by one; an
empty table gives an empty result; extra columns are left out. Bytes that aren't
a baseline JPEG raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import blocks, table

#: Payloads are padded to a positive multiple of this, which is an image's width in blocks.
WIDTH = 192
#: An image is at most 65,535 pixels high.
MOST_ROWS = 8000
BLOCK_BYTES = 3 << 20
#: Cells of a thumbnail hash, a row and a column.
HASH_CELLS = 8

# Fixed: the standard luminance tables of DC and AC code lengths; the AC table here has only the end of block.
DC_COUNTS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]
DC_VALUES = list(range(12))
AC_COUNTS = [1] + [0] * 15
AC_VALUES = [0]
STEP = 8


def huffman_codes(counts: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """value -> (code, bits), the canonical code of the lists in a DHT segment."""
    codes, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for value in values[at : at + n]:
            codes[value] = code, bits
            code += 1
        at += n
        code <<= 1
    return codes


def huffman_lookup(counts: list[int], values: list[int]) -> np.ndarray:
    """By the next 16 bits: bits of the code << 8 | value; 0 where no code begins."""
    lookup = np.zeros(1 << 16, dtype=np.int32)
    for value, (code, bits) in huffman_codes(counts, values).items():
        lookup[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | value
    return lookup


# ---------------------------------------------------------------- writing


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of a block with that DC difference and no AC, and their number."""
    dc, ac = huffman_codes(DC_COUNTS, DC_VALUES), huffman_codes(AC_COUNTS, AC_VALUES)
    bits, sizes = [], []
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = dc[size]
        low = diff if diff >= 0 else diff + (1 << size) - 1
        end, m = ac[0]
        bits.append((code << size | low) << m | end)
        sizes.append(n + size + m)
    return np.array(bits, dtype=np.uint64), np.array(sizes, dtype=np.int64)


_BITS, _SIZES = _symbols()


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _header(rows: int) -> bytes:
    height, width = rows * 8, WIDTH * 8
    return (
        b"\xff\xd8"
        + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
        + _segment(0xDB, bytes([0] + [STEP] * 64))
        + _segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _segment(0xC4, bytes([0x00, *DC_COUNTS, *DC_VALUES]))
        + _segment(0xC4, bytes([0x10, *AC_COUNTS, *AC_VALUES]))
        + _segment(0xDD, WIDTH.to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload; each is a positive multiple of ``WIDTH`` long. Images are written a block at a time."""
    most = WIDTH * MOST_ROWS
    images = [p[i : i + most] for p in payloads for i in range(0, len(p), most)]
    stored: list[bytes] = []
    start = size = 0
    for k, image in enumerate(images):
        if size and size + len(image) > BLOCK_BYTES:
            stored += _encode_images(images[start:k])
            start, size = k, 0
        size += len(image)
    stored += _encode_images(images[start:])
    done = iter(stored)
    return [b"".join(next(done) for _ in range(0, len(p), most)) for p in payloads]


def _encode_images(payloads: list[bytes]) -> list[bytes]:
    samples = np.frombuffer(b"".join(payloads), dtype=np.uint8).reshape(-1, WIDTH).astype(np.int64)
    diff = samples.copy()
    diff[:, 1:] -= samples[:, :-1]
    diff[:, 0] -= 128  # DC is predicted from 0, the middle of the range
    diff += 255
    size = _SIZES[diff]
    at = np.cumsum(size, axis=1)
    bits_of_row = at[:, -1]
    bytes_of_row = (bits_of_row + 7) // 8
    first = np.concatenate(([0], np.cumsum(bytes_of_row)))
    # each code goes to the 32-bit words at its bit position; codes don't overlap, so that sums are unions
    place = ((at - size) + 8 * first[:-1, None]).ravel()
    word, room = place >> 5, 64 - (place & 31) - size.ravel()
    shifted = _BITS[diff].ravel() << room.astype(np.uint64)
    stream = np.zeros(int(first[-1] // 4 + 3), dtype=np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    stream[word[starts]] += np.add.reduceat(shifted >> np.uint64(32), starts)
    stream[word[starts] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), starts)
    data = stream.astype(">u4").view(np.uint8)[: first[-1]].copy()
    spare = bytes_of_row * 8 - bits_of_row
    data[first[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)  # rows end with ones
    stuffed = np.flatnonzero(data == 0xFF)
    out, row = [], 0
    data = np.insert(data, stuffed + 1, 0)
    first = first + np.searchsorted(stuffed, first, side="left")
    plain = data.tobytes()
    for payload in payloads:
        n = len(payload) // WIDTH
        parts = [_header(n)]
        for k in range(n):
            if k:
                parts.append(bytes([0xFF, 0xD0 + (k - 1) % 8]))
            parts.append(plain[first[row + k] : first[row + k + 1]])
        out.append(b"".join([*parts, b"\xff\xd9"]))
        row += n
    return out


# ---------------------------------------------------------------- reading


@dataclass
class Frame:
    """An image as its markers describe it. A plan has one (component, is luminance, DC table, AC table) for each block of an MCU."""

    height: int = 0
    width: int = 0
    components: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    steps: dict[int, int] = field(default_factory=dict)
    tables: dict[int, bytes] = field(default_factory=dict)
    restart: int = 0
    plan: tuple[tuple[int, bool, bytes, bytes], ...] = ()
    mcus: int = 0
    across: int = 0
    intervals: list[tuple[int, int, int]] = field(default_factory=list)  # start, end, MCUs


def parse_images(data: bytes) -> list[Frame]:
    """The frames of one or more baseline JPEG images in a row, with the places of their restart intervals."""
    frames, at = [], 0
    while at < len(data):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no JPEG image")
        frame, at = Frame(), at + 2
        while True:
            if data[at : at + 1] != b"\xff" or at + 2 > len(data):
                raise ValueError("no marker where one is due")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            if marker == 0xD9:
                at += 2
                break
            length = int.from_bytes(data[at + 2 : at + 4], "big")
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xDB:
                i = 0
                while i < len(body):
                    wide = body[i] >> 4
                    frame.steps[body[i] & 15] = int.from_bytes(body[i + 1 : i + 2 + wide], "big")
                    i += 1 + 64 * (1 + wide)
            elif marker == 0xC0:
                frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                if body[0] != 8 or not frame.height or not frame.width:
                    raise ValueError("only images of 8-bit samples and a given size")
                for i in range(body[5]):
                    c, sampling, q = body[6 + 3 * i : 9 + 3 * i]
                    frame.components[c] = sampling >> 4, sampling & 15, q
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("only baseline images")
            elif marker == 0xC4:
                i = 0
                while i < len(body):
                    n = sum(body[i + 1 : i + 17])
                    frame.tables[body[i]] = body[i + 1 : i + 17 + n]
                    i += 17 + n
            elif marker == 0xDD:
                frame.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                at = _scan(frame, data, body, at)
        frames.append(frame)
    return frames


def _scan(frame: Frame, data: bytes, body: bytes, at: int) -> int:
    listed = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
    luma = next(iter(frame.components))
    ends, i = [], at
    starts = [at]
    while True:
        i = data.find(b"\xff", i)
        if i < 0 or i + 1 >= len(data):
            raise ValueError("a scan without an end")
        marker = data[i + 1]
        if marker == 0:
            i += 2
        elif 0xD0 <= marker <= 0xD7:
            ends.append(i)
            i += 2
            starts.append(i)
        elif marker == 0xFF:
            i += 1
        else:
            ends.append(i)
            break
    if luma not in [c for c, _ in listed]:
        return i
    largest_h = max(h for h, _, _ in frame.components.values())
    largest_v = max(v for _, v, _ in frame.components.values())
    if len(listed) == 1:  # not interleaved: a block is an MCU
        h, v, _ = frame.components[luma]
        frame.across = -(-(-(-frame.width * h // largest_h)) // 8)
        down = -(-(-(-frame.height * v // largest_v)) // 8)
    else:
        frame.across = -(-frame.width // (8 * largest_h))
        down = -(-frame.height // (8 * largest_v))
    plan = []
    for c, which in listed:
        h, v, _ = frame.components[c]
        plan += [(c, c == luma, frame.tables[which >> 4], frame.tables[0x10 | which & 15])] * (1 if len(listed) == 1 else h * v)
    frame.plan, frame.mcus = tuple(plan), frame.across * down
    per = frame.restart or frame.mcus
    todo = frame.mcus
    for start, end in zip(starts, ends, strict=True):
        frame.intervals.append((start, end, max(0, min(per, todo))))
        todo -= per
    if todo > 0:
        raise ValueError("a scan that ends early")
    return i


def _decode_in_blocks(plan: tuple, data: bytes, intervals: list[tuple[int, int, int]]) -> Iterator[np.ndarray]:
    """Of each interval in order, with about ``BLOCK_BYTES`` of scan data at a time."""
    start = 0
    for k in range(1, len(intervals) + 1):
        if k == len(intervals) or intervals[k][1] - intervals[start][0] > 2 * BLOCK_BYTES:
            low, high = intervals[start][0], intervals[k - 1][1]
            yield from _decode_intervals(plan, data[low:high], [(s - low, e - low, m) for s, e, m in intervals[start:k]])
            start = k


def _decode_intervals(plan: tuple, data: bytes, intervals: list[tuple[int, int, int]]) -> list[np.ndarray]:
    """The luminance DC coefficients of each interval, in the order of their blocks."""
    raw = np.frombuffer(data, dtype=np.uint8)
    mark = np.zeros(len(raw) + 1, dtype=np.int8)
    for s, e, _ in intervals:
        mark[s] += 1
        mark[e] -= 1
    inside = np.cumsum(mark[:-1]) > 0
    stuffing = np.zeros(len(raw), dtype=bool)
    stuffing[1:] = (raw[1:] == 0) & (raw[:-1] == 0xFF)
    keep = inside & ~stuffing
    kept = np.concatenate(([0], np.cumsum(keep)))
    starts = np.array([kept[s] for s, _, _ in intervals], dtype=np.int64)
    clean = np.concatenate((raw[keep], np.full(16, 0xFF, dtype=np.uint8))).astype(np.int64)
    window = np.zeros(len(clean) - 6, dtype=np.int64)  # the 48 bits from each byte on
    for i in range(6):
        window |= clean[i : i + len(window)] << (40 - 8 * i)
    mask = (1 << 48) - 1
    tables: dict[bytes, int] = {}
    for _, _, dc, ac in plan:
        tables.setdefault(dc, len(tables))
        tables.setdefault(ac, len(tables))
    lookups = [huffman_lookup(list(t[:16]), list(t[16:])).astype(np.int64) for t in tables]
    lookup = np.concatenate(lookups)
    dc_of = np.array([tables[p[2]] << 16 for p in plan])
    ac_of = np.array([tables[p[3]] << 16 for p in plan])
    names = sorted({p[0] for p in plan})
    component = np.array([names.index(p[0]) for p in plan])
    luma = np.array([p[1] for p in plan])
    n, per_mcu = len(intervals), len(plan)
    todo = np.array([m for _, _, m in intervals], dtype=np.int64)
    found_dc = np.zeros((int(todo.max(initial=0) * luma.sum()), n), dtype=np.int32)
    # of the intervals that go on: number, bit position, block of the MCU, coefficient, blocks to come, luminance blocks so far, DC predictions
    lane = np.flatnonzero(todo > 0)
    bit, left = starts[lane] * 8, todo[lane] * per_mcu
    unit, k, n_luma = np.zeros_like(lane), np.zeros_like(lane), np.zeros_like(lane)
    previous = np.zeros((len(names), len(lane)), dtype=np.int64)

    def symbol(ix, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length and value of the next code, and the bits from its end on."""
        at = bit[ix]
        bits = np.take(window, at >> 3, mode="clip") << (at & 7)
        code = lookup[(table[unit[ix]] if per_mcu > 1 else table[0]) + (bits >> 32 & 0xFFFF)]
        length = code >> 8
        if not length.all():
            raise ValueError("no such Huffman code")
        return length, code & 255, bits << length & mask

    def dc_step(ix) -> None:
        length, size, rest = symbol(ix, dc_of)
        x = rest >> (48 - size)
        bit[ix] += length + size
        c = component[unit[ix]] if per_mcu > 1 else 0
        column = np.arange(len(bit))[ix]
        total = previous[c, column] + np.where(x < (1 << size) >> 1, x - (1 << size) + 1, x)
        previous[c, column] = total
        if per_mcu == 1:
            found_dc[n_luma[ix], lane[ix]] = total
            n_luma[ix] += 1
        else:
            own = luma[unit[ix]]
            column, total = column[own], total[own]
            found_dc[n_luma[column], lane[column]] = total
            n_luma[column] += 1
        k[ix] = 1

    def ac_step(ix) -> bool:
        length, value, _ = symbol(ix, ac_of)
        size, run = value & 15, value >> 4
        bit[ix] += length + size
        k[ix] = np.where((size == 0) & (run < 15), 64, k[ix] + run + 1)
        ended = np.flatnonzero(k >= 64)
        if len(ended) == len(k):
            ended = slice(None)
        k[ended] = 0
        left[ended] -= 1
        if per_mcu > 1:
            unit[ended] = (unit[ended] + 1) % per_mcu
        return bool((left == 0).any())

    while len(lane):
        begins = k == 0
        if begins.all():
            dc_step(slice(None))
        elif not begins.any():
            if ac_step(slice(None)):
                on = left > 0
                lane, bit, unit, k, left, n_luma, previous = lane[on], bit[on], unit[on], k[on], left[on], n_luma[on], previous[:, on]
        else:
            dc_step(np.flatnonzero(begins))
    return [found_dc[: int(m * luma.sum()), i] for i, m in enumerate(todo)]


def dc_thumbnails(stored: list[bytes]) -> list[list[np.ndarray]]:
    """For each stored form the DC-only luminance thumbnails of its images: one sample for each 8x8 block."""
    frames = [parse_images(s) for s in stored]
    offsets = np.concatenate(([0], np.cumsum([len(s) for s in stored]))).tolist()
    data = b"".join(stored)
    by_plan: dict[tuple, list[tuple[int, int, int]]] = {}
    for k, images in enumerate(frames):
        for f in images:
            by_plan.setdefault(f.plan, []).extend((s + offsets[k], e + offsets[k], m) for s, e, m in f.intervals)
    coefficients = {plan: _decode_in_blocks(plan, data, iv) for plan, iv in by_plan.items()}
    out = []
    for images in frames:
        thumbs = []
        for f in images:
            dc = np.concatenate([next(coefficients[f.plan]) for _ in f.intervals])
            luma = next(iter(f.components))
            h, v, q = f.components[luma]
            samples = np.clip(128 + np.floor_divide(dc * f.steps[q] + 4, 8), 0, 255).astype(np.uint8)
            if len(f.plan) > 1:
                down = f.mcus // f.across
                samples = samples.reshape(down, f.across, v, h).transpose(0, 2, 1, 3).reshape(down * v, f.across * h)
            else:
                samples = samples.reshape(-1, f.across)
            thumbs.append(samples)
        out.append(thumbs)
    return out


def feature(thumbs: list[np.ndarray]) -> str:
    """Dimensions and hash of a thumbnail: a bit for each pair of neighbouring cell means, in a grid of 8 by 9, rising or not."""
    image = np.concatenate(thumbs) if len(thumbs) > 1 else thumbs[0]
    rows = np.linspace(0, image.shape[0], HASH_CELLS + 1).astype(int)[:-1]
    columns = np.linspace(0, image.shape[1], HASH_CELLS + 2).astype(int)[:-1]
    if image.shape[0] < HASH_CELLS:
        rows = np.arange(image.shape[0])
    sums = np.add.reduceat(np.add.reduceat(image, rows, axis=0, dtype=np.int64), columns, axis=1)
    area = np.diff([*rows, image.shape[0]])[:, None] * np.diff([*columns, image.shape[1]])[None, :]
    means = sums / area
    bits = np.zeros((HASH_CELLS, HASH_CELLS), dtype=bool)
    bits[: len(rows)] = means[:, 1:] > means[:, :-1]
    return f"{image.shape[1] * 8}x{image.shape[0] * 8}:{np.packbits(bits).tobytes().hex()}"


def store_documents(docs: DataFrame, keep_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, the digests of the payload as it is read back, media_bytes, media_sha256, the feature, and media itself if kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch, "text", BLOCK_BYTES):
                plain = [t.encode() for t in block.column(1).to_pylist()]
                media = encode_payloads([p.ljust(max(1, -(-len(p) // WIDTH)) * WIDTH) for p in plain])
                thumbs = dc_thumbnails(media)
                back = [b"".join(t.tobytes() for t in x) for x in thumbs]
                columns = [
                    block.column(0),
                    pa.array([len(p) for p in plain], pa.int64()),
                    pa.array([len(p) for p in back], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in back], pa.string()),
                    pa.array([zlib.crc32(p[-16:]) for p in back], pa.int64()),
                    pa.array([len(m) for m in media], pa.int64()),
                    pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                    pa.array([feature(t) for t in thumbs], pa.string()),
                ]
                if keep_media:
                    columns.append(pa.array(media, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * keep_media
    plain_docs = docs.select("doc_id", "text")
    schema = f"doc_id {dict(plain_docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return plain_docs.mapInArrow(run, schema + ", media binary" * keep_media)


def media_features(media: DataFrame, column: str = "media") -> DataFrame:
    """``media`` with width, height and thumbnail hash of a column of baseline JPEG images, and why there are none (media_error): a null value or an image that can't be read costs its own row only."""

    def read(values: list[bytes | None]) -> list[tuple[str | None, str | None]]:
        """(feature, error) of each value; together if all can be read, else one by one."""
        try:
            if None not in values:
                return [(feature(t), None) for t in dc_thumbnails(values)]
        except (ValueError, KeyError, IndexError) as e:
            if len(values) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
        if len(values) == 1:
            return [(None, "no media")]
        return [read([v])[0] for v in values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                found = read(part.column(part.schema.get_field_index(column)).to_pylist())
                size = [f.split(":")[0].split("x") if f else (None, None) for f, _ in found]
                width, height = (pa.array([int(x[k]) if x[k] else None for x in size], pa.int32()) for k in (0, 1))
                hashes, errors = pa.array([f and f.split(":")[1] for f, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, width, height, hashes, errors], [*part.schema.names, "thumb_width", "thumb_height", "thumb_hash", "media_error"])

    schema = ", ".join(f"`{n}` {t}" for n, t in media.dtypes)
    return media.mapInArrow(run, f"{schema}, thumb_width int, thumb_height int, thumb_hash string, media_error string")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(table(spark, sf_dir, "documents"), keep_media=False)
