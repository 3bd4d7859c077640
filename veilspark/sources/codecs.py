"""Image and video files as bytes, in numpy: PNG, JPEG, BMP and TIFF are written, uncompressed AVI is read and written.

Images are decoded by Spark's image source.  Decoders and encoders of other
video containers can be registered by extension.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

#: Quality of JPEG files, and frames a second of a video that doesn't tell.
QUALITY, FPS = 95, 25.0


def png(bgr: np.ndarray) -> bytes:
    rgb = np.ascontiguousarray(bgr[:, :, ::-1])
    rows = np.concatenate([np.zeros((rgb.shape[0], 1), np.uint8), rgb.reshape(rgb.shape[0], -1)], axis=1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def dib(bgr: np.ndarray) -> bytes:
    """Rows from the bottom, each filled up to four bytes."""
    h, w = bgr.shape[:2]
    out = np.zeros((h, (3 * w + 3) // 4 * 4), np.uint8)
    out[:, : 3 * w] = bgr[::-1].reshape(h, -1)
    return out.tobytes()


def from_dib(data: bytes, width: int, height: int) -> np.ndarray:
    rows = np.frombuffer(data, np.uint8, (3 * width + 3) // 4 * 4 * abs(height)).reshape(abs(height), -1)[:, : 3 * width].reshape(abs(height), width, 3)
    return rows[::-1] if height > 0 else rows


def dib_head(width: int, height: int, size: int) -> bytes:
    return struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, size, 2835, 2835, 0, 0)


def bmp(bgr: np.ndarray) -> bytes:
    data = dib(bgr)
    return struct.pack("<2sIHHI", b"BM", 54 + len(data), 0, 0, 54) + dib_head(bgr.shape[1], bgr.shape[0], len(data)) + data


def tiff(bgr: np.ndarray) -> bytes:
    """Little-endian, one uncompressed strip of RGB."""
    h, w = bgr.shape[:2]
    data = np.ascontiguousarray(bgr[:, :, ::-1]).tobytes()
    at = 8 + len(data) + len(data) % 2
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, at + 2 + 10 * 12 + 4), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, len(data)), (284, 3, 1, 1)]
    return struct.pack("<2sHI", b"II", 42, at) + data + b"\0" * (len(data) % 2) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<IHHH", 0, 8, 8, 8)


# ---- JPEG --------------------------------------------------------------------------------------------------------

#: Fixed values of the format: quantisation of luma and chroma at quality 50, by rows.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32


def zigzag() -> np.ndarray:
    """Places of an 8 x 8 block along its diagonals, in turn up and down."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def quantiser(base: list[int], quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray, most: int = 16) -> np.ndarray:
    """Lengths of a prefix code for symbols by their counts, none above most and none all ones: package-merge."""
    used = np.flatnonzero(counts)
    coins = [(int(counts[s]), (int(s),)) for s in used] + [(0, ())]  # the last takes the code of ones
    coins.sort(key=lambda c: c[0])
    row = coins
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]
        row = sorted(coins + pairs, key=lambda c: c[0])
    out = np.zeros(len(counts), int)
    for _, symbols in row[: 2 * len(coins) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def codes(lengths: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Canonical codes; the number of codes of each length; the symbols in order."""
    order = sorted(np.flatnonzero(lengths), key=lambda s: (lengths[s], s))
    out, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for s in order:
        code <<= int(lengths[s]) - last
        last = int(lengths[s])
        out[s] = code
        code += 1
    return out, [int((lengths == n).sum()) for n in range(1, 17)], [int(s) for s in order]


def bits_of(v: np.ndarray) -> np.ndarray:
    """The number of bits of whole numbers' sizes."""
    return np.where(v == 0, 0, np.floor(np.log2(np.maximum(np.abs(v), 1))).astype(np.int64) + 1)


def symbols_of(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of quantised blocks (n x 64, zigzag): block, place, symbol, extra value and its bits; place 0 is the difference of means, 64 the end."""
    n = len(blocks)
    dc = np.diff(blocks[:, 0], prepend=0)
    b, p = np.nonzero(blocks[:, 1:])
    p = p + 1
    v = blocks[b, p]
    first = np.diff(b, prepend=-1) != 0
    gap = p - np.where(first, 0, np.concatenate([[0], p[:-1]])) - 1
    size = bits_of(v)
    long = np.repeat(np.arange(len(b)), gap // 16)  # each sixteen zeros are a symbol of their own
    last = np.zeros(n, int)
    np.maximum.at(last, b, p)
    end = np.flatnonzero(last < 63)
    size0 = bits_of(dc)
    block = np.concatenate([np.arange(n), b[long], b, end])
    place = np.concatenate([np.zeros(n, int), p[long], p, np.full(len(end), 64)])
    rank = np.concatenate([np.zeros(n, int), np.zeros(len(long), int), np.ones(len(b), int), np.zeros(len(end), int)])
    symbol = np.concatenate([size0, np.full(len(long), 0xF0), (gap % 16) * 16 + size, np.zeros(len(end), int)])
    extra = np.concatenate([dc, np.zeros(len(long), int), v, np.zeros(len(end), int)])
    size = np.concatenate([size0, np.zeros(len(long), int), size, np.zeros(len(end), int)])
    order = np.lexsort((rank, place, block))
    return block[order], place[order], symbol[order], np.where(extra < 0, extra + (1 << size) - 1, extra)[order], size[order]


def jpeg(bgr: np.ndarray, quality: int = QUALITY) -> bytes:
    """Baseline, colours at full size, codes fitted to the image."""
    h, w = bgr.shape[:2]
    b, g, r = (bgr[:, :, i].astype(np.float64) for i in range(3))
    planes = [0.299 * r + 0.587 * g + 0.114 * b, -0.168735892 * r - 0.331264108 * g + 0.5 * b + 128, 0.5 * r - 0.418687589 * g - 0.081312411 * b + 128]
    u = np.arange(8)
    dct = np.sqrt(np.where(u == 0, 1, 2) / 8)[:, None] * np.cos((2 * u + 1) * u[:, None] * np.pi / 16)
    tables, zig = [quantiser(LUMA, quality), quantiser(CHROMA, quality)], zigzag()
    found = []
    for i, plane in enumerate(planes):
        full = np.pad(plane - 128, ((0, -h % 8), (0, -w % 8)), mode="edge")
        blocks = full.reshape(full.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        coded = np.rint((dct @ blocks @ dct.T).reshape(-1, 64) / tables[i > 0]).astype(np.int64)[:, zig]
        found.append(symbols_of(coded))
    out = [b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"]
    for i, t in enumerate(tables):
        out.append(b"\xff\xdb" + struct.pack(">HB", 67, i) + bytes(t[zig].tolist()))
    out.append(b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1]))
    code = {}
    for kind in (0, 1):
        for colour in (0, 1):
            counts = np.zeros(256, np.int64)
            for i, (_, place, symbol, _, _) in enumerate(found):
                if (i > 0) == bool(colour):
                    counts += np.bincount(symbol[(place > 0) == bool(kind)], minlength=256)
            lengths = code_lengths(counts)
            value, sizes, order = codes(lengths)
            code[kind, colour] = (value, lengths)
            out.append(b"\xff\xc4" + struct.pack(">HB", 19 + len(order), kind * 16 + colour) + bytes(sizes) + bytes(order))
    out.append(b"\xff\xda" + struct.pack(">HB", 12, 3) + bytes([1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0]))
    # all symbols by block and component: a code of up to 16 bits and up to 11 of the value
    rows = []
    for i, (block, place, symbol, extra, size) in enumerate(found):
        ac, colour = place > 0, int(i > 0)
        pick = lambda j: np.where(ac, code[1, colour][j][symbol], code[0, colour][j][symbol])  # noqa: B023, E731
        rows.append((block * 3 + i, (pick(0) << size) | extra, pick(1) + size))
    key = np.concatenate([x[0] for x in rows])
    order = np.argsort(key, kind="stable")
    value, size = (np.concatenate([x[j] for x in rows])[order] for j in (1, 2))
    ends = np.cumsum(size)
    which = np.repeat(np.arange(len(size)), size)
    bits = (value[which] >> (ends[which] - 1 - np.arange(ends[-1]))) & 1
    data = np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.int64)]).astype(np.uint8)).tobytes()
    return b"".join(out) + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {".png": png, ".jpg": jpeg, ".jpeg": jpeg, ".bmp": bmp, ".tif": tiff, ".tiff": tiff}


# ---- AVI ---------------------------------------------------------------------------------------------------------


@dataclass
class Video:
    """fps (none if unknown), the number of frames (none if unknown), and what an encoder of the same container may keep of the sound."""

    fps: float | None
    count: int | None
    frames: Iterable[np.ndarray]
    sound: list[tuple[bytes, bytes, list[bytes]]] = field(default_factory=list)


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield kind, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> Video:
    """Uncompressed 24-bit frames; anything else raises ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    streams, body = [], (0, 0)
    for kind, a, b in chunks(data, 12, len(data)):
        if kind == b"LIST" and data[a : a + 4] == b"hdrl":
            for kind2, c, d in chunks(data, a + 4, b):
                if kind2 == b"LIST" and data[c : c + 4] == b"strl":
                    streams.append({k: data[e:f] for k, e, f in chunks(data, c + 4, d)})
        elif kind == b"LIST" and data[a : a + 4] == b"movi":
            body = (a + 4, b)
    picture = next((i for i, s in enumerate(streams) if s.get(b"strh", b"")[:4] == b"vids"), None)
    if picture is None:
        raise ValueError("no video in the file")
    _, width, height, _, depth, packing = struct.unpack_from("<IiiHHI", streams[picture][b"strf"])
    scale, rate = struct.unpack_from("<II", streams[picture][b"strh"], 20)
    if depth != 24 or packing:
        raise ValueError("only uncompressed 24-bit frames can be read")

    def of(i: int) -> Iterator[bytes]:
        for kind, a, b in chunks(data, *body):
            if kind[:2] == b"%02d" % i and b > a:
                yield data[a:b]

    sound = [(s[b"strh"], s[b"strf"], list(of(i))) for i, s in enumerate(streams) if s.get(b"strh", b"")[:4] == b"auds"]
    count = sum(1 for kind, a, b in chunks(data, *body) if kind[:2] == b"%02d" % picture and b > a)
    return Video(rate / scale if scale and rate else None, count, (from_dib(x, width, height) for x in of(picture)), sound)


def write_avi(out: io.BufferedIOBase, video: Video, width: int, height: int) -> int:
    """Writes the frames as they come and returns how many; sizes are filled in at the end, so out must allow to go back."""
    size = (3 * width + 3) // 4 * 4 * height
    fps = video.fps or FPS

    def chunk(kind: bytes, data: bytes) -> bytes:
        return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)

    def head(n: int) -> bytes:
        main = struct.pack("<14I", round(1e6 / fps), round(size * fps), 0, 0x10, n, 0, 1 + len(video.sound), size, width, height, 0, 0, 0, 0)
        strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"DIB ", 0, 0, 0, 0, 1000, round(fps * 1000), 0, n, size, 0xFFFFFFFF, 0, 0, 0, width, height)
        lists = [chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", dib_head(width, height, size)))]
        lists += [chunk(b"LIST", b"strl" + chunk(b"strh", h) + chunk(b"strf", f)) for h, f, _ in video.sound]
        return chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + b"".join(lists))

    empty = head(0)
    out.write(b"RIFF\0\0\0\0AVI " + empty + b"LIST\0\0\0\0movi")
    n, body = 0, 4
    for frame in video.frames:
        body += out.write(chunk(b"00db", dib(frame)))
        n += 1
    for i, (_, _, parts) in enumerate(video.sound, start=1):
        for part in parts:
            body += out.write(chunk(b"%02dwb" % i, part))
    out.seek(4)
    out.write(struct.pack("<I", 4 + len(empty) + 8 + body))
    out.seek(12)
    out.write(head(n) + b"LIST" + struct.pack("<I", body))
    return n


#: By extension: bytes of a file -> Video; (file, Video, width, height) -> frames written.
DECODERS: dict[str, Callable[[bytes], Video]] = {".avi": read_avi}
VIDEO_ENCODERS: dict[str, Callable[[io.BufferedIOBase, Video, int, int], int]] = {".avi": write_avi}


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[1].lower() if "." in name[1:] else ""
