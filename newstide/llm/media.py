"""Media columns: baseline JPEG in numpy.

``encode`` stores a payload losslessly as the quantised coefficients of a
greyscale baseline JPEG, the format's own units: each block of 64 bytes is one
8 x 8 block, byte b the coefficient b - 128 (b - 127 from 128 up, so that none
is zero) at its zigzag place. Restart markers divide the scan into intervals.
``Image`` parses any baseline JPEG; its scans are Huffman-decoded with all
restart intervals, of all images of a batch, in step with each other.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import parquet
from .text import column_bytes, slices

#: Blocks of a restart interval that ``encode`` writes.
INTERVAL = 4
#: Segment that keeps the payload's length.
TAG = b"payload\0"
STORED = "doc_id long, n_bytes long, media binary"
RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_hash string"


def canonical(counts: list[int], symbols: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, code, length) of a Huffman table from its counts by length 1 to 16."""
    code, out, k = 0, [], 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


# Counts by code length and symbols (categories), shorter codes for what letters need; the longest all-ones code is free.
_DC = ([0, 1, 2, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0], [5, 4, 6, 0, 3, 7, 2, 1, 8, 9])
_AC = ([1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0], [5, 4, 7, 3, 6, 2, 1, 8])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _magnitude(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG category of each value, and its appended bits."""
    size = np.zeros(len(values), np.int64)
    rest = np.abs(values)
    while rest.any():
        size += rest > 0
        rest = rest >> 1
    return size, np.where(values < 0, values + (1 << size) - 1, values)


def _code_table(table, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Code with appended bits, and total length, for every value from low to high."""
    codes = {s: (c, n) for s, c, n in canonical(*table)}
    size, bits = _magnitude(np.arange(low, high + 1))
    pair = np.array([codes.get(int(s), (0, 0)) for s in size], np.int64)
    return (pair[:, 0] << size) | bits, np.where(pair[:, 1] > 0, pair[:, 1] + size, 0)


_AC_CODE, _AC_LEN = _code_table(_AC, -128, 128)
_DC_CODE, _DC_LEN = _code_table(_DC, -256, 256)
_VALUE = np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127)
_BYTE_CODE, _BYTE_LEN = _AC_CODE[_VALUE + 128], _AC_LEN[_VALUE + 128]


def shape(blocks: int) -> tuple[int, int]:
    """Blocks across and down for so many blocks: near a square, the last row padded."""
    across = max(1, int(np.ceil(np.sqrt(blocks))))
    return across, -(-blocks // across)


def encode(payload: np.ndarray, blocks: np.ndarray, n_bytes: np.ndarray) -> list[bytes]:
    """JPEG files of payloads that lie one after another: ``blocks`` 64-byte blocks each, ``n_bytes`` of them text."""
    grid = [shape(int(b)) for b in blocks]
    full = np.array([a * d for a, d in grid])
    first = np.cumsum(full) - full
    rows = np.full((int(full.sum()), 64), 0x61, np.uint8)  # blocks that only fill the last row cost little
    at = np.repeat(first - (np.cumsum(blocks) - blocks), blocks) + np.arange(int(blocks.sum()))
    rows[at] = payload.reshape(-1, 64)
    nth = np.arange(len(rows)) - np.repeat(first, full)
    code, length = _BYTE_CODE[rows], _BYTE_LEN[rows]
    dc = _VALUE[rows[:, 0]]
    jump = np.diff(dc, prepend=0)
    jump[nth % INTERVAL == 0] = dc[nth % INTERVAL == 0]
    code[:, 0], length[:, 0] = _DC_CODE[jump + 256], _DC_LEN[jump + 256]
    lead = np.flatnonzero(nth % INTERVAL == 0)
    bits = np.add.reduceat(length.sum(1), lead)
    size = -(-bits // 8)
    begin = (np.cumsum(size) - size) * 8
    run = np.cumsum(length.ravel()) - length.ravel()
    interval = np.searchsorted(lead, np.arange(len(rows)), "right") - 1
    pos = run.reshape(-1, 64) + (begin - run[lead * 64])[interval][:, None]
    pos, code, length = pos.ravel(), code.ravel(), length.ravel()
    total = int(size.sum())
    words = total // 4 + 2
    word, shift = pos >> 5, 64 - (pos & 31) - length
    wide = code << shift
    packed = np.bincount(word, wide >> 32, words) + np.bincount(word + 1, wide & 0xFFFFFFFF, words + 1)[:words]
    scan = packed.astype(np.uint64).astype(">u4").view(np.uint8)[:total].copy()
    scan[(begin // 8 + size - 1)[bits % 8 > 0]] |= ((1 << (-bits[bits % 8 > 0] % 8)) - 1).astype(np.uint8)
    # stuffing after 0xFF, and a marker after each interval but an image's last
    stuffed = scan == 0xFF
    marked = np.zeros(total, np.int64)
    ends = begin // 8 + size
    within = nth[lead] // INTERVAL
    last = np.append(within[1:] == 0, True)
    marked[ends[~last] - 1] = 2
    place = np.arange(total) + np.cumsum(stuffed + marked) - (stuffed + marked)
    out = np.zeros(total + int(stuffed.sum() + marked.sum()), np.uint8)
    out[place] = scan
    after = (place + 1 + stuffed)[ends[~last] - 1]
    out[after], out[after + 1] = 0xFF, 0xD0 + within[~last] % 8
    stop = np.append((place + 1 + stuffed)[ends[last] - 1], len(out))[:-1]
    files, a = [], 0
    for (across, down), n, z in zip(grid, n_bytes.tolist(), stop.tolist(), strict=True):
        head = b"\xff\xd8" + _segment(0xED, TAG + struct.pack(">Q", n)) + _segment(0xDB, b"\0" + b"\1" * 64) + _segment(0xC0, struct.pack(">BHHBBBB", 8, down * 8, across * 8, 1, 1, 0x11, 0))
        head += _segment(0xC4, b"\0" + bytes(_DC[0]) + bytes(_DC[1])) + _segment(0xC4, b"\x10" + bytes(_AC[0]) + bytes(_AC[1])) + _segment(0xDD, struct.pack(">H", INTERVAL)) + _segment(0xDA, b"\1\1\0\0\x3f\0")
        files.append(head + out[a:z].tobytes() + b"\xff\xd9")
        a = z
    return files


@dataclass
class Image:
    """A parsed baseline JPEG: its markers' contents and its scan's bytes without stuffing."""

    width: int = 0
    height: int = 0
    n_bytes: int | None = None
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantiser
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, tuple] = field(default_factory=dict)  # class << 4 | id: counts, symbols
    order: list[tuple[int, int, int]] = field(default_factory=list)  # component, its DC and AC tables
    interval: int = 0
    scan: np.ndarray | None = None
    bounds: np.ndarray | None = None  # of restart intervals in scan

    @property
    def mcus(self) -> int:
        across, down = self.mcu_grid
        return across * down

    @property
    def mcu_grid(self) -> tuple[int, int]:
        if len(self.order) == 1:  # a scan of one component has its blocks row by row
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(c[1] for c in self.components), max(c[2] for c in self.components)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def slots(self) -> list[tuple[int, int, int]]:
        """(component, DC table, AC table) of each block of an MCU."""
        if len(self.order) == 1:
            return [self.order[0]]
        return [o for o in self.order for _ in range(self.components[o[0]][1] * self.components[o[0]][2])]


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG with one scan. Raises ValueError for anything else."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    image, at = Image(), 2
    while True:
        while at + 1 < len(data) and data[at] == 0xFF and data[at + 1] == 0xFF:
            at += 1
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xC0:
            bits, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not image.height or not image.width:
                raise ValueError("not 8-bit baseline")
            image.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                image.tables[body[0]] = (tuple(counts), tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDD:
            image.interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xED and body.startswith(TAG):
            image.n_bytes = struct.unpack_from(">Q", body, len(TAG))[0]
        elif marker == 0xDA:
            names = [c[0] for c in image.components]
            image.order = [(names.index(body[1 + 2 * i]), body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    if len(image.order) != len(image.components):
        raise ValueError("more than one scan")
    raw = np.frombuffer(data, np.uint8)[at:]
    mark = np.flatnonzero(raw[:-1] == 0xFF)
    follow = raw[mark + 1]
    end = mark[(follow != 0) & ((follow < 0xD0) | (follow > 0xD7)) & (follow != 0xFF)]
    stop = int(end[0]) if len(end) else len(raw)
    mark, follow = mark[mark < stop], follow[mark < stop]
    keep = np.ones(stop, bool)
    restart = mark[(follow >= 0xD0) & (follow <= 0xD7)]
    keep[mark[follow == 0] + 1] = False
    keep[restart] = False
    keep[restart + 1] = False
    kept = np.concatenate([[0], np.cumsum(keep)])
    image.scan, image.bounds = raw[:stop][keep], np.concatenate([[0], kept[restart], [kept[stop]]])
    return image


_lookups: dict[tuple, np.ndarray] = {}


def _lookup(counts: tuple, symbols: tuple) -> np.ndarray:
    """By the next 16 bits: code length | run << 8 | size << 16, and where code and value fit, their length << 24 | the value, biased, << 32. Zero: no code."""
    key = (counts, symbols)
    if key not in _lookups:
        table, window = np.zeros(1 << 16, np.int64), np.arange(1 << 16)
        for symbol, code, n in canonical(list(counts), list(symbols)):
            rows = slice(code << (16 - n), (code + 1) << (16 - n))
            size = symbol & 15
            table[rows] = n | (symbol >> 4) << 8 | size << 16
            if n + size <= 16:
                bits = window[rows] >> (16 - n - size) & ((1 << size) - 1)
                value = np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits) if size else bits * 0
                table[rows] |= (n + size) << 24 | (value + 32768) << 32
        _lookups[key] = table
    return _lookups[key]


def _windows(scan: np.ndarray) -> np.ndarray:
    """The 32 bits from each byte on."""
    x = np.concatenate([scan, np.zeros(8, np.uint8)]).astype(np.int64)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def decode(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients, in zigzag order, of each image's blocks (MCU by MCU). Raises ValueError for a broken scan."""
    out = [np.zeros((m.mcus * len(m.slots), 64), np.int16) for m in images]
    alike: dict[tuple, list[int]] = {}
    for i, m in enumerate(images):
        alike.setdefault((tuple(m.slots), tuple(sorted(m.tables.items()))), []).append(i)
    for (slots, _), members in alike.items():
        group = [images[i] for i in members]
        scan = _windows(np.concatenate([m.scan for m in group]))
        base = np.cumsum([0] + [len(m.scan) for m in group])
        store = np.zeros((sum(m.mcus for m in group) * len(slots), 64), np.int16)
        start, limit, first, todo, block = [], [], [], [], 0
        for m, b in zip(group, base, strict=False):
            per = m.interval or m.mcus
            n = -(-m.mcus // per)
            if len(m.bounds) - 1 < n:
                raise ValueError("restart intervals are missing")
            lead = np.arange(n) * per
            start.append(b + m.bounds[:n])
            limit.append(b + m.bounds[1 : n + 1])
            first.append(block + lead * len(slots))
            todo.append(np.minimum(per, m.mcus - lead))
            block += m.mcus * len(slots)
        start, limit, first, todo = map(np.concatenate, (start, limit, first, todo))
        order = np.argsort(-todo, kind="stable")
        pos, limit, first, todo = start[order] * 8, limit[order] * 8, first[order], todo[order]
        past = {c: np.zeros(len(pos), np.int64) for c, _, _ in slots}
        tables = group[0].tables
        for t in range(int(todo[0]) if len(todo) else 0):
            live = int(np.searchsorted(-todo, -t, "left"))
            for s, (c, dc, ac) in enumerate(slots):
                row = first[:live] + t * len(slots) + s
                value, size, _, pos[:live] = _symbol(scan, pos[:live], _lookup(*tables[dc]))
                past[c][:live] += value
                store[row, 0] = past[c][:live]
                table, k, on = _lookup(*tables[0x10 | ac]), np.ones(live, np.int64), None
                while True:
                    here = pos[:live] if on is None else pos[on]
                    value, size, run, here = _symbol(scan, here, table)
                    at = (k if on is None else k[on]) + run
                    if (at[size > 0] > 63).any():
                        raise ValueError("coefficients overflow")
                    if on is None and size.all():
                        store[row, at] = value
                        pos[:live], k = here, at + 1
                        if (k > 63).any():
                            on = np.flatnonzero(k < 64)
                    else:
                        lane = np.arange(live) if on is None else on
                        full = size > 0
                        store[row[lane[full]], at[full]] = value[full]
                        pos[lane], k[lane] = here, np.where(full | (run == 15), at + 1, 64)
                        on = np.flatnonzero(k < 64)
                    if on is not None and not len(on):
                        break
                if (pos[:live] > limit[:live]).any():
                    raise ValueError("the scan ends early")
        at = 0
        for i, m in zip(members, group, strict=True):
            n = m.mcus * len(slots)
            out[i], at = store[at : at + n], at + n
    return out


def _symbol(scan: np.ndarray, pos: np.ndarray, table: np.ndarray):
    """Value, size and run at each bit position, and the position after."""
    byte = pos >> 3
    if len(byte) and int(byte.max()) >= len(scan):
        raise ValueError("the scan ends early")
    window = scan[byte]
    entry = table[(window >> (16 - (pos & 7))) & 0xFFFF]
    if not entry.all():
        raise ValueError("no such code")
    size, run, whole = entry >> 16 & 255, entry >> 8 & 255, entry >> 24 & 255
    value, after = (entry >> 32) - 32768, pos + whole
    far = np.flatnonzero(whole == 0)
    if len(far):  # code and value are longer than the window
        n, s, p = entry[far] & 255, size[far], pos[far] + (entry[far] & 255)
        wide = scan[np.minimum(p >> 3, len(scan) - 1)]
        bits = wide >> (32 - (p & 7) - s) & ((1 << s) - 1)
        value[far] = np.where(bits < (1 << s >> 1), bits - (1 << s) + 1, bits)
        after[far] = pos[far] + n + s
    return value, size, run, after


def thumbnail(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from DC alone: one sample per 8 x 8 block of the first component."""
    slots, (across, down) = image.slots, image.mcu_grid
    own = [i for i, s in enumerate(slots) if s[0] == image.order[0][0]]
    step = image.quantisers.get(image.components[image.order[0][0]][3], np.ones(64, np.int64))[0]
    dc = coefficients[:, 0].reshape(-1, len(slots))[:, own].astype(np.int64) * step
    h, v = (1, 1) if len(slots) == 1 else image.components[image.order[0][0]][1:3]
    grid = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
    grid = grid[: -(-image.height // 8), : -(-image.width // 8)]
    return np.clip((grid + 4) // 8 + 128, 0, 255).astype(np.uint8)


def average_hash(picture: np.ndarray) -> str:
    """64 bits: which cells of the picture, sampled to 8 x 8, are above their mean."""
    h, w = picture.shape
    small = picture[np.arange(8) * h // 8][:, np.arange(8) * w // 8].astype(np.int64)
    return np.packbits(small * 64 > small.sum()).tobytes().hex()


def payload_of(image: Image, coefficients: np.ndarray) -> bytes:
    """The stored payload, with its padding to a positive multiple of 64."""
    value = coefficients.astype(np.int64)
    size = max(64, -(-image.n_bytes // 64) * 64)
    return (value + 127 + (value < 0)).astype(np.uint8).tobytes()[:size]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a JPEG."""

    def run(batches):
        for batch in batches:
            buf, bounds = column_bytes(batch.column("text"))
            ids = batch.column("doc_id").cast(pa.int64())
            for i, j in slices(bounds):
                size = np.diff(bounds[i : j + 1])
                blocks = np.maximum(1, -(-size // 64))
                padded = np.zeros(int(blocks.sum()) * 64, np.uint8)
                to = np.repeat((np.cumsum(blocks) - blocks) * 64 - (bounds[i:j] - bounds[i]), size) + np.arange(int(size.sum()))
                padded[to] = buf[bounds[i] : bounds[j]]
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(size, pa.int64()), pa.array(encode(padded, blocks, size), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, STORED)


def features(media: DataFrame) -> DataFrame:
    """Decode stored media: dimensions, thumbnail hashes and the payload's digests."""

    def run(batches):
        for batch in batches:
            files = batch.column("media").to_pylist()
            bounds = np.cumsum([0, *map(len, files)])
            for i, j in slices(bounds):
                images = [parse(x) for x in files[i:j]]
                rows: dict[str, list] = {n: [] for n in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "thumbnail_hash")}
                for x, image, found in zip(files[i:j], images, decode(images), strict=True):
                    body, small = payload_of(image, found), thumbnail(image, found)
                    mark = average_hash(small)
                    for name, value in zip(rows, (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(x), hashlib.sha256(x).hexdigest(), f"{image.width}x{image.height}:{mark}:{hashlib.sha256(small.tobytes()).hexdigest()[:16]}", image.width, image.height, mark), strict=True):
                        rows[name].append(value)
                kinds = {"payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "width": pa.int32(), "height": pa.int32()}
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")[i:j], "n_bytes": batch.column("n_bytes")[i:j]} | {k: pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()})

    return media.mapInArrow(run, RESULT)


def media_features(docs: DataFrame) -> DataFrame:
    """Every text stored as a JPEG and read back.

    ``docs`` needs doc_id and text; other columns are ignored. Null and empty
    texts are 64 zero bytes. Equal texts give equal values, so do repeated rows,
    each of which gets its own. Rows without doc_id keep null. An empty table
    gives no rows.
    """
    return features(store(docs))


def op1_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(parquet(spark, sf_dir, "documents"))
