"""TIFF as a media column: pages of a TIFF file as rows, and texts stored losslessly as TIFF samples.

The reader walks the chain of image directories in either byte order; strips or tiles; no compression, PackBits, LZW
or deflate; chunky or planar samples of 1, 2, 4, 8, 16, 32 or 64 bits; undoes horizontal differencing and the
floating-point predictor; and gives one row per page. Headers are checked before anything is allocated, a page must
be one that its compressed bytes can hold, and a strip is decoded up to the bytes its size needs.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WIDTH, ROWS_PER_STRIP = 64, 1024
FLUSH = 16 << 20
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Bytes and struct codes of the TIFF field types.
_TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}


class TiffError(ValueError):
    """The bytes are no TIFF that this reader knows."""


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
                at += 1
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n:
        run = 1
        while run < 128 and at + run < n and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[at]))
            at += run
            continue
        to = at + 1
        while to < n and to - at < 128 and (to + 1 >= n or data[to] != data[to + 1]):
            to += 1
        out.append(to - at - 1)
        out += data[at:to]
        at = to
    return bytes(out)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            if code >= len(table):
                raise TiffError("an LZW strip must begin with a clear code")
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            if len(table) < 4096:
                table.append(last + entry[:1])
        out += entry
        if most is not None and len(out) >= most:
            break
        last = entry
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    held, bits, out, width = 0, 0, bytearray(), 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    def clear() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes((i,)): i for i in range(256)}, 9

    clear()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        size = len(table) + 2
        word = data[i : i + 1]
        if size > 4093:
            put(table[word])
            word = b""
            clear()
        elif size >= 1 << width:
            width += 1
    if word:
        put(table[word])
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most)


_DECODE = {NONE: lambda data, most: data[:most], LZW: unpack_lzw, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
#: Most bytes that a byte of each compression can stand for; a page that is larger than MOST_PAGE bytes is an error.
_MOST = {NONE: 1, DEFLATE: 1040, OLD_DEFLATE: 1040, PACKBITS: 64}
MOST_PAGE = 1 << 28
#: Codes that an LZW table takes, each a byte longer at most than the one before, and their bits; then it is cleared.
_LZW_CODES, _LZW_BITS = 254 + 512 + 1024 + 2048, 254 * 9 + 512 * 10 + 1024 * 11 + 2048 * 12


def most_bytes(compression: int, n: int) -> int:
    """Most bytes that n bytes of a compression can stand for."""
    if compression != LZW:
        return _MOST[compression] * n
    tables, bits = divmod(8 * n, _LZW_BITS)
    rest = min(_LZW_CODES, bits // 9 + 1)
    return tables * (_LZW_CODES * (_LZW_CODES + 1) // 2) + rest * (rest + 1) // 2

_ENCODE = {NONE: bytes, LZW: pack_lzw, DEFLATE: lambda d: zlib.compress(d, 1), PACKBITS: pack_bits}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = ROWS_PER_STRIP, tile: int = 0) -> bytes:
    """Little-endian TIFF of 8-bit pages (height, width) or (height, width, samples), in strips or square tiles."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        height, width, samples = page.shape
        across = tile or width
        step = tile or rows_per_strip
        offsets, counts = [], []
        for top in range(0, height, step):
            for left in range(0, width, across):
                part = page[top : top + step, left : left + across]
                if tile:
                    part = np.pad(part, ((0, tile - part.shape[0]), (0, tile - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], axis=1)
                packed = _ENCODE[compression](np.ascontiguousarray(part).tobytes())
                offsets.append(len(out))
                counts.append(len(packed))
                out += packed
        out += b"\0" * (len(out) % 2)
        where = (324, 325) if tile else (273, 279)
        tags = {256: (4, [width]), 257: (4, [height]), 258: (3, [8] * samples), 259: (3, [compression]), 262: (3, [1 if samples < 3 else 2]), where[0]: (4, offsets), 277: (3, [samples]), where[1]: (4, counts), 284: (3, [1]), 317: (3, [predictor])}
        tags |= {322: (4, [tile]), 323: (4, [tile])} if tile else {278: (4, [rows_per_strip])}
        entries = bytearray()
        for tag in sorted(tags):
            kind, values = tags[tag]
            body = struct.pack(f"<{len(values)}{_TYPES[kind][1]}", *values)
            if len(body) > 4:
                entries += struct.pack("<HHII", tag, kind, len(values), len(out))
                out += body + b"\0" * (len(body) % 2)
            else:
                entries += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        out[link : link + 4] = struct.pack("<I", len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        place = at + 10 + 12 * i
        if size * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + size * count > len(data):
            raise TiffError("a field lies beyond the end")
        tags[tag] = struct.unpack_from(f"{order}{count * len(code)}{code[0]}", data, place)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _unpredict(part: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """part: (rows, columns, samples)."""
    if predictor == 2:
        return np.cumsum(part, axis=1, dtype=part.dtype)
    if predictor == 3:
        rows, columns, samples = part.shape
        size = part.dtype.itemsize
        raw = part.view(np.uint8).reshape(rows, columns * size, samples) if samples == 1 else part.reshape(rows, columns * samples).view(np.uint8).reshape(rows, columns * size, samples)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        whole = np.ascontiguousarray(raw.transpose(0, 2, 1))
        return whole.view(">f4" if size == 4 else ">f2" if size == 2 else ">f8").reshape(rows, columns, samples)
    return part


def _number(tags: dict[int, tuple], tag: int, default: int | None = None) -> int:
    """A tag's value, which has to be one whole number (or several equal ones)."""
    values = tags.get(tag, () if default is None else (default,))
    if not values or not isinstance(values[0], int) or values[0] < 0 or len(set(values)) > 1:
        raise TiffError(f"field {tag} is missing or no number")
    return values[0]


@dataclass
class _Layout:
    """A page's header, checked."""

    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    form: int
    planar: int
    tiled: bool
    across: int
    down: int
    offsets: tuple
    counts: tuple

    @classmethod
    def of(cls, tags: dict[int, tuple]) -> _Layout:
        get = lambda tag, default=None: _number(tags, tag, default)
        tiled = 324 in tags
        width, height = get(256), get(257)
        across, down = (get(322), get(323)) if tiled else (width, min(get(278, height), height))
        offsets, counts = (tags.get(324, ()), tags.get(325, ())) if tiled else (tags.get(273, ()), tags.get(279, ()))
        p = cls(width, height, get(277, 1), get(258, 1), get(259, 1), get(317, 1), get(339, 1), get(284, 1), tiled, across, down, offsets, counts)
        if not (width and height and p.samples and across and down):
            raise TiffError("a page, tile or strip without samples")
        if p.bits not in (1, 2, 4, 8, 16, 32, 64) or p.compression not in _DECODE or p.planar not in (1, 2):
            raise TiffError(f"{p.bits} bits, compression {p.compression}, layout {p.planar}")
        if p.form == 3 and p.bits < 16 or p.predictor not in (1, 2, 3) or p.predictor == 2 and p.bits < 8 or p.predictor == 3 and p.form != 3:
            raise TiffError(f"predictor {p.predictor} of {p.bits} bits of kind {p.form}")
        if not all(isinstance(x, int) for x in (*offsets, *counts)):
            raise TiffError("places of strips or tiles are no numbers")
        parts = p.columns * p.rows * p.planes
        if min(len(offsets), len(counts)) < parts:
            raise TiffError("fewer strips or tiles than the size needs")
        return p

    @property
    def columns(self) -> int:
        return -(-self.width // self.across)

    @property
    def rows(self) -> int:
        return -(-self.height // self.down)

    @property
    def planes(self) -> int:
        return self.samples if self.planar == 2 else 1

    @property
    def inside(self) -> int:
        """Samples of a pixel that lie together."""
        return 1 if self.planar == 2 else self.samples

    def high(self, i: int) -> int:
        """Rows of the i-th strip or tile."""
        return self.down if self.tiled else min(self.down, self.height - i % (self.columns * self.rows) // self.columns * self.down)

    def need(self, i: int) -> int:
        return self.high(i) * -(-self.across * self.inside * self.bits // 8)


def _page(data: bytes, tags: dict[int, tuple], order: str) -> dict:
    p = _Layout.of(tags)
    parts = p.columns * p.rows * p.planes
    if max(p.height * p.width * p.samples * max(8, p.bits) // 8, sum(map(p.need, range(parts)))) > MOST_PAGE:
        raise TiffError(f"a page of more than {MOST_PAGE} bytes")
    if sum(map(p.need, range(parts))) > most_bytes(p.compression, len(data)) + 64 * parts:
        raise TiffError("a page larger than its bytes can hold")
    for i in range(parts):
        if p.need(i) > most_bytes(p.compression, max(0, min(p.counts[i], len(data) - p.offsets[i]))) + 64:
            raise TiffError("a strip or tile is too short")
    kind = np.dtype(f"{order}{'f' if p.form == 3 else 'i' if p.form == 2 else 'u'}{max(1, p.bits // 8)}")
    page = np.zeros((p.height, p.width, p.samples), kind.newbyteorder("="))
    for i in range(parts):
        plane, at = divmod(i, p.columns * p.rows)
        top, left, high = at // p.columns * p.down, at % p.columns * p.across, p.high(i)
        raw = _DECODE[p.compression](data[p.offsets[i] : p.offsets[i] + p.counts[i]], p.need(i))[: p.need(i)]
        if len(raw) < p.need(i):
            raise TiffError("a strip or tile is too short")
        if p.bits < 8:
            bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(high, -1), axis=1)[:, : p.across * p.inside * p.bits].reshape(high, p.across, p.inside, p.bits)
            part = (bits << np.arange(p.bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3).astype(kind)
        else:
            part = _unpredict(np.frombuffer(raw, kind).reshape(high, p.across, p.inside), p.predictor, order)
        page[top : top + high, left : left + p.across, plane : plane + p.inside] = part[: p.height - top, : p.width - left]
    return {"width": p.width, "height": p.height, "samples": p.samples, "bits": p.bits, "compression": p.compression, "predictor": p.predictor, "tiled": p.tiled, "pixels": page}


def read_tiff(data: bytes):
    """Yields a dict per page in the order of the directories; TiffError where the bytes can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("no TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        try:
            tags, following = _directory(data, at, order)
            page = _page(data, tags, order)
        except (struct.error, zlib.error, MemoryError) as e:
            raise TiffError(str(e)) from e
        yield page
        at = following


def _shares(flat: np.ndarray) -> np.ndarray:
    """Shares of the samples in 256 bins: bytes by value, others between the least and the largest."""
    if flat.dtype == np.uint8:
        return np.bincount(flat, minlength=256) / max(1, flat.size)
    low, high = (float(flat.min()), float(flat.max())) if flat.size else (0.0, 0.0)
    span = high / 2 - low / 2  # halves, so that no difference is beyond what a double holds
    place = (flat.astype(np.float64) / 2 - low / 2) / span * 256 if span > 0 else np.zeros(flat.size)
    return np.bincount(np.clip(place, 0, 255).astype(np.int64), minlength=256) / max(1, flat.size)


def feature(pixels: np.ndarray) -> str:
    """Size, mean, deviation, entropy of the samples and a hash of 64 means compared with the whole mean. Samples that are
    no finite numbers are passed over; means beyond what a double holds are inf."""
    flat = pixels.reshape(-1)
    flat = flat[np.isfinite(flat)] if flat.dtype.kind == "f" else flat
    wide = flat if flat.dtype == np.uint8 else flat.astype(np.float64)
    p = _shares(flat)
    some = p[p > 0]
    cuts = np.linspace(0, flat.size, 65).astype(np.int64)[:-1]
    with np.errstate(all="ignore"):
        mean, deviation = (wide.mean(), wide.std()) if flat.size else (0, 0)
        means = np.add.reduceat(flat.astype(np.float64), cuts) / np.maximum(1, np.diff(np.append(cuts, flat.size))) if flat.size >= 64 else np.zeros(64)
        code = int("".join("1" if m > mean else "0" for m in means), 2) if flat.size else 0
    return f"{pixels.shape[1]}x{pixels.shape[0]}x{pixels.shape[2]}:{mean:.4f}:{deviation:.4f}:{abs(float(-(some * np.log2(some)).sum())):.4f}:{code:016x}"


def store_texts(documents: DataFrame) -> DataFrame:
    """documents (doc_id, text) -> doc_id, n_bytes, media: each whole text's UTF-8 bytes, zero-padded to a positive
    multiple of 64, as a one-page TIFF 64 samples wide (deflate, horizontal differencing). Null counts as empty."""

    def make():
        def one(batch):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            padded = [np.frombuffer(r + b"\0" * (-len(r) % WIDTH or (0 if r else WIDTH)), np.uint8).reshape(-1, WIDTH) for r in raw]
            return {"doc_id": batch.column("doc_id"), "n_bytes": [len(r) for r in raw], "media": [write_tiff([p]) for p in padded]}

        return one

    return map_texts(documents.select("doc_id", "text"), make, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes bigint, media binary")


def read_pages(df: DataFrame, media: str = "media") -> DataFrame:
    """df with one row per page of its media column: df's columns (but those named alike), then page, width, height,
    samples, bits, pixels (row by row, chunky, native order), feature and error. Bytes that can't be read, and null,
    give one row with a null page and the reason (after the pages read before it). Memory: a batch of files, a page and
    FLUSH bytes of pages before it."""
    import pyarrow as pa

    added = "page int, width int, height int, samples int, bits int, pixels binary, feature string, error string"
    names = [x.split()[0] for x in added.split(", ")]
    source = df.select(*[c for c in df.columns if c not in names])

    def make():
        def pages(data):
            n = 0
            try:
                if data is None:
                    raise TiffError("null")
                for n, p in enumerate(read_tiff(data), 1):
                    yield [n - 1, p["width"], p["height"], p["samples"], p["bits"], p["pixels"].tobytes(), feature(p["pixels"]), None]
            except (TiffError, ValueError, ArithmeticError, MemoryError) as e:  # whatever a page does, it is that page's error
                yield [None] * 7 + [str(e) or type(e).__name__]

        def one(batch):
            of, rows, held = [], [], 0

            def made():
                same = batch.take(pa.array(of, pa.int64()))
                return dict(zip(same.schema.names, same.columns, strict=True)) | dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

            for i, data in enumerate(batch.column(media).to_pylist()):
                for row in pages(data):
                    of.append(i)
                    rows.append(row)
                    held += len(row[5] or b"")
                    if held >= FLUSH:
                        yield made()
                        of, rows, held = [], [], 0
            if rows:
                yield made()

        return one

    return map_texts(source, make, f"{', '.join(f'`{c}` {t}' for c, t in source.dtypes)}, {added}", text=media)


def text_media(documents: DataFrame) -> DataFrame:
    """Stores each text as TIFF, reads the stored bytes back and digests both; one row per document."""
    pages = read_pages(store_texts(documents))
    return pages.select(
        "doc_id", "n_bytes", F.length("pixels").cast("bigint").alias("payload_bytes"), F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -WIDTH, WIDTH)).alias("tail_crc32"), F.length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
