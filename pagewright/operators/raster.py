"""Pixels in NumPy: what no column expression can do. Half-pixel bilinear resizing; images as stored."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from pagewright.operators.boxes import half_up


def rgb(image) -> np.ndarray:
    """Spark's image struct (gray, BGR or BGRA) as height x width x 3, in RGB."""
    h, w, n = image["height"], image["width"], image["nChannels"]
    if h <= 0 or w <= 0 or n not in (1, 3, 4):
        raise ValueError("the image could not be decoded")
    px = np.frombuffer(image["data"], np.uint8).reshape(h, w, n)
    return np.repeat(px, 3, axis=2) if n == 1 else px[:, :, 2::-1]


def resize(px: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = px.shape[:2]
    if (w, h) == (width, height):
        return px
    y, x = (np.clip((np.arange(n) + 0.5) * old / n - 0.5, 0, old - 1) for n, old in ((height, h), (width, w)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    px = px.astype(float)
    top = px[y0][:, x0] * (1 - fx) + px[y0][:, x1] * fx
    low = px[y1][:, x0] * (1 - fx) + px[y1][:, x1] * fx
    return np.floor(top * (1 - fy) + low * fy + 0.5).astype(np.uint8)


def round_half_up(x: float) -> int:
    return int(half_up(x))


def model_size(width: int, height: int, max_side: int):
    """(resized width and height, ratio, padded width and height)."""
    side = max(width, height)
    ratio = max_side / side if side > max_side else 1.0
    w, h = (round_half_up(v * ratio) for v in (width, height))
    return w, h, ratio, -(-w // 32) * 32, -(-h // 32) * 32


def detection_tensor(px: np.ndarray, options):
    """Shrunk, padded by zeros at the right and below, normalised: 1 x 3 x H x W."""
    w, h, ratio, W, H = model_size(px.shape[1], px.shape[0], options.max_side)
    if not w or not h:
        raise ValueError("the image is too narrow to be resized")
    wide = np.zeros((H, W, 3), np.uint8)
    wide[:h, :w] = resize(px, w, h)
    x = (wide / 255.0 - np.array(options.mean)) / np.array(options.std)
    return np.ascontiguousarray(x.transpose(2, 0, 1)[None], np.float32), ratio, W, H


def gray_map(p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(np.nan_to_num(p.astype(float), nan=0.0) * 255 + 0.5), 0, 255).astype(np.uint8)


def crop(px: np.ndarray, b: dict) -> np.ndarray:
    return px[b["y"] : b["y"] + b["height"], b["x"] : b["x"] + b["width"]]


def recognition_tensor(px: np.ndarray, image_height: int) -> np.ndarray:
    """Fixed height, the red channel alone, copied to all three planes."""
    if not px.size:
        raise ValueError("the crop has no pixels")
    w = max(8, round_half_up(image_height * px.shape[1] / px.shape[0]))
    plane = (resize(px, w, image_height)[:, :, 0] / 255.0 - 0.5) / 0.5
    return np.ascontiguousarray(np.broadcast_to(plane, (1, 3, image_height, w)), np.float32)


def decode_steps(out: np.ndarray, dictionary) -> tuple[str, float]:
    """The NumPy twin of the CTC functions, for one crop: T x C."""
    clean = np.where(np.isnan(out), -np.inf, out)
    k = clean.argmax(axis=1)
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
    last = len(dictionary) - 1
    text, total, n = [], 0.0, 0
    for t in np.flatnonzero(new & (k != 0) & (k <= last)).tolist():
        if k[t] == last and dictionary[last] == "<unk>":
            continue
        text.append(" " if k[t] == last else dictionary[k[t]])
        total += float(clean[t, k[t]])
        n += 1
    return "".join(text), total / n if n else 0.0


def png(px: np.ndarray) -> bytes:
    """8-bit gray or RGB pixels as a PNG file."""
    px = np.ascontiguousarray(px, np.uint8)
    h, w = px.shape[:2]
    raw = b"".join(b"\0" + row.tobytes() for row in px)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if px.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def read_png(data: bytes) -> dict:
    """An 8-bit, non-interlaced PNG file as the fields of an image struct; for streams, whose source has no decoder."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, packed, head = 8, b"", None
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in (0, 2, 6) or head[6]:
        raise ValueError("only 8-bit gray, RGB and RGBA PNG files without interlacing are read")
    w, h, n = head[0], head[1], {0: 1, 2: 3, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * n)
    out, above = np.zeros((h, w * n), np.uint8), np.zeros(w * n, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 1:
            line = np.cumsum(line.reshape(w, n), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            line += above
        elif kind in (3, 4):
            for i in range(w * n):
                left, up, corner = (int(line[i - n]) if i >= n else 0), int(above[i]), (int(above[i - n]) if i >= n else 0)
                guess = (left + up) // 2 if kind == 3 else min((left, up, corner), key=lambda v, p=left + up - corner: abs(p - v))
                line[i] = (int(line[i]) + guess) & 255
        out[y] = above = line
    px = out.reshape(h, w, n)
    order = {1: [0], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[n]
    return {"origin": "", "height": h, "width": w, "nChannels": n, "mode": {1: 0, 3: 16, 4: 24}[n], "data": np.ascontiguousarray(px[:, :, order]).tobytes()}


def outlined(px: np.ndarray, boxes) -> np.ndarray:
    """A copy with the boxes drawn in red."""
    px = px.copy()
    for b in boxes:
        x0, y0, x1, y1 = b["x"], b["y"], b["x"] + b["width"] - 1, b["y"] + b["height"] - 1
        for part in (np.s_[y0 : y1 + 1, x0], np.s_[y0 : y1 + 1, x1], np.s_[y0, x0 : x1 + 1], np.s_[y1, x0 : x1 + 1]):
            px[part] = (255, 0, 0)
    return px
