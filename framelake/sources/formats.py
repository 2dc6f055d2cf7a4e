"""Files of image stacks as bytes: TIFF, NPY and MAT level 5, without further libraries."""

from __future__ import annotations

import io
import re
import struct
import zlib

import numpy as np

# Fixed values of the public TIFF 6.0 and MAT-file level 5 formats.
_TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 16: 8}
_TIFF_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}
_KINDS = {1: "u", 2: "i", 3: "f"}
_MAT_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_MAT_CLASSES = {"float64": 6, "float32": 7, "int8": 8, "uint8": 9, "int16": 10, "uint16": 11, "int32": 12, "uint32": 13}
_MAT_STORED = {"float64": 9, "float32": 7, "int8": 1, "uint8": 2, "int16": 3, "uint16": 4, "int32": 5, "uint32": 6}


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n if n > 128 else 0)
            at += 2 if n > 128 else 1
    return bytes(out)


def _lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, one bit wider as soon as the next entry would be the last of a width."""
    out, table, before = bytearray(), [], None
    bits, held, n = 9, 0, 0
    for byte in data:
        held, n = held << 8 | byte, n + 8
        if n < bits:
            continue
        n -= bits
        code, held = held >> n, held & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, before, bits = [bytes([k]) for k in range(256)] + [b"", b""], None, 9
            continue
        entry = table[code] if code < len(table) else before + before[:1]
        if before is not None:
            table.append(before + entry[:1])
            bits = min(12, max(9, (len(table) + 1).bit_length()))
        out += entry
        before = entry
    return bytes(out)


_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32773: _packbits, 32946: zlib.decompress}
_IMAGES = re.compile(rb"ImageJ=.*?^images=(\d+)", re.S | re.M)


class TiffFile:
    """The pages of an open TIFF or BigTIFF file; a page's place is its directory's, and only what is asked for is read.

    Strips and tiles; plain, deflated, LZW or PackBits; differences of neighbours as
    predictor. A lone directory of ImageJ that counts more images stands for pages
    that follow each other: their places are (directory, number).
    """

    def __init__(self, file):
        self.file = file
        head = self._read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or len(head) < 8:
            raise ValueError("not a TIFF file")
        self.big = struct.unpack(self.order + "H", head[2:4])[0] == 43
        self.word = "Q" if self.big else "I"
        self.first = struct.unpack(self.order + self.word, head[8:16] if self.big else head[4:8])[0]

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def directory(self, at: int) -> tuple[dict[int, tuple], int]:
        """Tags as (type, number of values, bytes of the values or of their place), and the place of the next directory."""
        head, entry = (8, 20) if self.big else (2, 12)
        data = self._read(at, head + entry * 40)
        n = struct.unpack_from(self.order + ("Q" if self.big else "H"), data)[0]
        size = head + n * entry + struct.calcsize(self.word)
        if size > len(data):
            data = self._read(at, size)
        tags = {}
        for spot in range(head, head + n * entry, entry):
            tag, kind, count = struct.unpack_from(self.order + ("HHQ" if self.big else "HHI"), data, spot)
            tags[tag] = (kind, count, data[spot + (12 if self.big else 8) : spot + entry])
        return tags, struct.unpack_from(self.order + self.word, data, head + n * entry)[0]

    def values(self, tags: dict[int, tuple], tag: int, default=()) -> tuple:
        if tag not in tags:
            return default
        kind, count, held = tags[tag]
        size = _TIFF_SIZES.get(kind, 1) * count
        if size > len(held):
            held = self._read(struct.unpack(self.order + self.word, held)[0], size)
        return (held[:size],) if kind == 2 else struct.unpack_from(f"{self.order}{count}{_TIFF_CODES[kind]}", held)

    def places(self) -> list:
        """The places of all pages, in order."""
        found, at = [], self.first
        while at:
            found.append(at)
            at = self.directory(at)[1]
        if len(found) == 1 and (m := _IMAGES.match(self.values(self.directory(found[0])[0], 270, (b"",))[0])):
            return [(found[0], k) for k in range(int(m[1]))]
        return found

    def shape(self, place) -> tuple[int, int, int]:
        tags, one = self._tags(place)
        return one(257, 0), one(256, 0), one(277, 1)

    def _tags(self, place):
        tags = self.directory(place[0] if isinstance(place, tuple) else place)[0]
        return tags, lambda tag, default: self.values(tags, tag, (default,))[0]

    def page(self, place) -> np.ndarray:
        """(h, w, c) in the machine's byte order."""
        tags, one = self._tags(place)
        width, height, samples, packed = one(256, 0), one(257, 0), one(277, 1), one(259, 1)
        if packed not in _UNPACK:
            raise ValueError(f"TIFF compression {packed} is not supported")
        if one(317, 1) not in (1, 2):
            raise ValueError(f"TIFF predictor {one(317, 1)} is not supported")
        kind = np.dtype(f"{self.order}{_KINDS[one(339, 1)]}{one(258, 8) // 8}")
        if isinstance(place, tuple):
            size = height * width * samples * kind.itemsize
            if packed != 1 or 324 in tags:
                raise ValueError("pages that follow each other are plain")
            data = self._read(self.values(tags, 273)[0] + place[1] * size, size)
            return np.frombuffer(data, kind).reshape(height, width, samples).astype(kind.newbyteorder("="))
        planes, each = (samples, 1) if one(284, 1) == 2 else (1, samples)
        tiled = 324 in tags
        tall, wide = (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height), width)
        down, across = -(-height // tall), -(-width // wide)
        out = np.empty((planes, height, width, each), kind.newbyteorder("="))
        for k, (at, size) in enumerate(zip(self.values(tags, 324 if tiled else 273), self.values(tags, 325 if tiled else 279), strict=True)):
            plane, (y, x) = k // (down * across), divmod(k % (down * across), across)
            rows = tall if tiled else min(tall, height - y * tall)
            block = np.frombuffer(_UNPACK[packed](self._read(at, size)), kind, rows * wide * each).reshape(rows, wide, each).astype(out.dtype)
            if one(317, 1) == 2:
                block = np.cumsum(block, 1, dtype=block.dtype)
            part = out[plane, y * tall : y * tall + rows, x * wide : (x + 1) * wide]
            part[:] = block[: part.shape[0], : part.shape[1]]
        return out.transpose(1, 2, 0, 3).reshape(height, width, samples)


def read_tiff(data: bytes) -> np.ndarray:
    """All pages (t, h, w, c); pages of another shape than the first are an error."""
    file = TiffFile(io.BytesIO(data))
    pages = [file.page(place) for place in file.places()]
    if len({p.shape for p in pages}) > 1:
        raise ValueError("the pages of a stack have one shape")
    return np.stack(pages)


class TiffWriter:
    """Appends pages to a stream, plain or deflated; BigTIFF, so that a stack may exceed 4 GiB."""

    def __init__(self, out, deflate: bool = False):
        self.out, self.at, self.held, self.deflate = out, 16, None, deflate
        out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16))

    def add(self, page: np.ndarray) -> None:
        page = np.ascontiguousarray(page)
        page = page[..., None] if page.ndim == 2 else page
        h, w, c = page.shape
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        bits = page.dtype.itemsize * 8
        body = page.astype(page.dtype.newbyteorder("<")).tobytes()
        body = zlib.compress(body) if self.deflate else body
        entries = 11
        ifd = 8 + 20 * entries + 8
        extra = 2 * c
        start = self.at + ifd + 2 * extra
        tags = [
            (256, 4, 1, w), (257, 4, 1, h), (258, 3, c, None), (259, 3, 1, 8 if self.deflate else 1), (262, 3, 1, 1), (273, 16, 1, start), (277, 3, 1, c),
            (278, 4, 1, h), (279, 16, 1, len(body)), (284, 3, 1, 1), (339, 3, c, None),
        ]
        head, lists = struct.pack("<Q", entries), b""
        for tag, code, count, value in tags:
            head += struct.pack("<HHQ", tag, code, count)
            if value is not None:
                head += struct.pack("<Q", value)
            else:
                values = struct.pack(f"<{c}H", *[bits if tag == 258 else kind] * c)
                if c <= 4:
                    head += values.ljust(8, b"\0")
                else:
                    head += struct.pack("<Q", self.at + ifd + len(lists))
                lists += values
        self._flush(self.at)
        self.held = (head, lists + body)
        self.at = start + len(body)

    def _flush(self, following: int) -> None:
        if self.held:
            self.out.write(self.held[0] + struct.pack("<Q", following) + self.held[1])

    def close(self) -> None:
        self._flush(0)


def read_npy(data: bytes) -> np.ndarray:
    loaded = np.load(io.BytesIO(data), allow_pickle=False)
    if not isinstance(loaded, np.ndarray):
        loaded = loaded[pick_dataset({k: loaded[k].shape for k in loaded.files})[0]]
    return loaded


_CHANNEL = re.compile(r"(?:channel|chan|ch)[_.\s]*(\d+)", re.I)
_GENERIC = ("mov", "data", "dataset")  # fixed values


def pick_dataset(shapes: dict[str, tuple[int, ...]]) -> list[str]:
    """Which datasets of a file make the recording.

    Numbered channels (ch, chan or channel and a number, anywhere in the name) with
    the same text before and one shape: the largest such group, by number. Else the
    first one called mov, data or dataset, in any case. Else all of three or four axes
    that have the shape with most values.
    """
    groups: dict[str, dict[str, int]] = {}
    for name in shapes:
        if m := _CHANNEL.search(name):
            groups.setdefault(name[: m.start()], {})[name] = int(m[1])
    even = [g for g in groups.values() if len({shapes[n] for n in g}) == 1]
    if even:
        best = max(even, key=len)
        return sorted(best, key=best.get)
    if named := [n for n in shapes if n.lstrip("/").lower() in _GENERIC]:
        return named[:1]
    stacks = [s for s in shapes.values() if len(s) in (3, 4)]
    if not stacks:
        raise ValueError("the file has no dataset of three or four axes")
    most = max(stacks, key=np.prod)
    return [n for n, s in shapes.items() if s == most]


def _mat_elements(data: bytes):
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != 15 else 0)


def read_mat(data: bytes) -> dict[str, np.ndarray]:
    """The numeric arrays of a MAT file of level 5, in their own (column-major) shapes."""
    if data[124:128] != b"\0\1IM":
        raise ValueError("not a little-endian MAT file of level 5")
    out = {}
    for kind, body in _mat_elements(data[128:]):
        if kind == 15:
            kind, body = next(_mat_elements(zlib.decompress(body)))
        if kind != 14:
            continue
        flags, dims, name, real = (x for x, _ in zip(_mat_elements(body), range(4), strict=False))
        shape = np.frombuffer(dims[1], "<i4")
        if flags[1][0] in _MAT_CLASSES.values():
            dtype = next(k for k, v in _MAT_CLASSES.items() if v == flags[1][0])
            out[name[1].decode()] = np.frombuffer(real[1], "<" + _MAT_TYPES[real[0]]).reshape(shape, order="F").astype(dtype)
    return out


def _mat_element(kind: int, body: bytes) -> bytes:
    return struct.pack("<II", kind, len(body)) + body + b"\0" * (-len(body) % 8)


def write_mat(arrays: dict[str, np.ndarray]) -> bytes:
    out = b"MATLAB 5.0 MAT-file".ljust(124, b" ") + b"\0\1IM"
    for name, a in arrays.items():
        flags = _mat_element(6, struct.pack("<II", _MAT_CLASSES[str(a.dtype)], 0))
        dims = _mat_element(5, np.array(a.shape, "<i4").tobytes())
        body = _mat_element(_MAT_STORED[str(a.dtype)], a.astype(a.dtype.newbyteorder("<")).tobytes(order="F"))
        out += _mat_element(14, flags + dims + _mat_element(1, name.encode()) + body)
    return out
