"""Raster images with numpy: PNG in and out, TIFF in, crop, resize, images on PDF pages.

Colour types grey, RGB, palette and their alphas at 8 bits, not interlaced; others raise
ValueError. JPEG bytes are placed on PDF pages as they are; nothing here encodes JPEG.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from burin.functions.media import jpeg_segments, png_chunks

_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode_png(data: bytes) -> np.ndarray:
    """(height, width, channels) of 8-bit samples; palettes become RGB or RGBA."""
    chunks = png_chunks(data)
    if not chunks or chunks[0][0] != b"IHDR":
        raise ValueError("La imagen no es un PNG válido")
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", data[16:29])
    if depth != 8 or interlaced or kind not in _CHANNELS:
        raise ValueError("PNG no admitido")
    part = lambda name: b"".join(data[a + 8 : b - 4] for k, a, b in chunks if k == name)
    try:
        raw = zlib.decompress(part(b"IDAT"))
    except zlib.error:
        raise ValueError("La imagen no es un PNG válido") from None
    n = _CHANNELS[kind]
    stride = width * n
    if len(raw) < height * (stride + 1):
        raise ValueError("La imagen no es un PNG válido")
    rows = np.frombuffer(raw, np.uint8, height * (stride + 1)).reshape(height, stride + 1)
    out = np.zeros((height + 1, stride + n), np.uint8)  # a row above and a pixel to the left of zeros
    for y in range(height):
        method, line, above = rows[y, 0], rows[y, 1:], out[y]
        now = out[y + 1]
        if method == 0:
            now[n:] = line
        elif method == 2:
            now[n:] = line + above[n:]
        elif method == 1:
            now[n:] = np.cumsum(line.reshape(width, n), 0, dtype=np.uint8).ravel()
        else:
            for x in range(width):
                left, up, corner = (a[x * n : x * n + n].astype(int) for a in (now, above[n:], above))
                if method == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                now[n + x * n : 2 * n + x * n] = (line[x * n : x * n + n] + guess) & 255
    pixels = out[1:, n:].reshape(height, width, n)
    if kind == 3:
        palette = np.frombuffer(part(b"PLTE"), np.uint8).reshape(-1, 3)
        alpha = np.frombuffer(part(b"tRNS"), np.uint8)
        index = np.minimum(pixels[:, :, 0], len(palette) - 1)
        pixels = palette[index]
        if len(alpha):
            full = np.concatenate([alpha, np.full(max(0, len(palette) - len(alpha)), 255, np.uint8)])
            pixels = np.concatenate([pixels, full[index][:, :, None]], 2)
    return pixels


def encode_png(pixels: np.ndarray) -> bytes:
    height, width, n = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * n)], 1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, sampled at pixel centres."""
    h, w, _ = pixels.shape
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = pixels.astype(float)
    top, low = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx, p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def resize_png(data: bytes, width: int, height: int) -> bytes:
    return encode_png(resized(decode_png(data), max(1, width), max(1, height)))


def crop_png(data: bytes, x: int, y: int, width: int, height: int) -> bytes:
    """A part of the image; size first, then origin are moved inside it."""
    pixels = decode_png(data)
    h, w, _ = pixels.shape
    cw, ch = max(1, min(width, w)), max(1, min(height, h))
    cx, cy = max(0, min(x, w - cw)), max(0, min(y, h - ch))
    return encode_png(pixels[cy : cy + ch, cx : cx + cw])


def decode_tiff(data: bytes) -> np.ndarray:
    """The first image of a TIFF: 8 bits, strips that are raw or deflated."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("La imagen no es un TIFF válido")
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, list[int]] = {}
    try:
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            e = at + 2 + 12 * k
            tag, kind, count = struct.unpack_from(order + "HHI", data, e)
            code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("", 0))
            if code and count <= 1 << 20:
                place = e + 8 if size * count <= 4 else struct.unpack_from(order + "I", data, e + 8)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{count}{code}", data, place))
        width, height, packing = tags[256][0], tags[257][0], tags.get(259, [1])[0]
        n = tags.get(277, [1])[0]
        if packing not in (1, 8, 32946) or set(tags.get(258, [8])) != {8} or n not in (1, 2, 3, 4):
            raise ValueError("TIFF no admitido")
        strips = [data[a : a + b] for a, b in zip(tags[273], tags[279], strict=True)]
        raw = b"".join(strips if packing == 1 else map(zlib.decompress, strips))
        pixels = np.frombuffer(raw, np.uint8, width * height * n).reshape(height, width, n)
    except (struct.error, KeyError, IndexError, zlib.error):
        raise ValueError("La imagen no es un TIFF válido") from None
    return 255 - pixels if n == 1 and tags.get(262, [1])[0] == 0 else pixels


def tiff_to_png(data: bytes) -> bytes:
    return encode_png(decode_tiff(data))


def png_to_png(data: bytes) -> bytes:
    return encode_png(decode_png(data))


def image_to_pdf(data: bytes) -> bytes:
    """A PNG or JPEG centred on an A4 page, margin 40, never enlarged."""
    from burin.functions.pdf import Name, Stream, Writer

    out = Writer()
    info = {"Type": Name("XObject"), "Subtype": Name("Image"), "BitsPerComponent": 8}
    if data.startswith(b"\xff\xd8"):
        frame = next((data[a + 4 : b] for m, a, b in jpeg_segments(data) if 0xC0 <= m <= 0xCF and m not in (0xC4, 0xC8, 0xCC)), b"")
        if len(frame) < 6:
            raise ValueError("La imagen no es un JPEG válido")
        height, width = struct.unpack(">HH", frame[1:5])
        image = Stream(info | {"Width": width, "Height": height, "ColorSpace": Name({1: "DeviceGray", 4: "DeviceCMYK"}.get(frame[5], "DeviceRGB")), "Filter": Name("DCTDecode")}, data)
    else:
        pixels = decode_png(data)
        height, width, n = pixels.shape
        own = info | {"Width": width, "Height": height, "Filter": Name("FlateDecode")}
        if n in (2, 4):
            own["SMask"] = out.add(Stream(own | {"ColorSpace": Name("DeviceGray")}, zlib.compress(pixels[:, :, -1].tobytes())))
            pixels = pixels[:, :, :-1]
        image = Stream(own | {"ColorSpace": Name("DeviceGray" if n < 3 else "DeviceRGB")}, zlib.compress(pixels.tobytes()))
    scale = min(1.0, (595.28 - 80) / max(1, width), (841.89 - 80) / max(1, height))
    w, h = width * scale, height * scale
    body = b"q %.2f 0 0 %.2f %.2f %.2f cm /Im Do Q" % (w, h, (595.28 - w) / 2, (841.89 - h) / 2)
    page = {"Type": Name("Page"), "MediaBox": [0, 0, 595.28, 841.89], "Resources": {"XObject": {"Im": out.add(image)}}, "Contents": out.add(Stream({}, body))}
    from burin.functions.pdf import Ref

    out.kids.append(out.add(page | {"Parent": Ref(2)}))
    return out.bytes()
