"""Raw pixels to PNG: sample unpacking, palettes, soft masks."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def samples(data: bytes, bits: int, width: int, height: int, components: int) -> np.ndarray:
    """(height, width, components) samples of 1, 2, 4, 8 or 16 bits; rows begin on a byte, what is missing is 0."""
    row = (width * components * bits + 7) // 8
    raw = np.zeros(row * height, np.uint8)
    given = np.frombuffer(data[: row * height], np.uint8)
    raw[: len(given)] = given
    rows = raw.reshape(height, row)
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        parts = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = (parts * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return rows[:, : width * components].reshape(height, width, components)


def scaled(values: np.ndarray, bits: int) -> np.ndarray:
    """Samples on the range of a byte."""
    return values if bits >= 8 else (values.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)


def cmyk_to_rgb(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.int32)
    return (255 - np.minimum(255, v[..., :3] + v[..., 3:])).astype(np.uint8)


def indexed(values: np.ndarray, palette: bytes, components: int = 3) -> np.ndarray:
    """Palette colours of indexes; an index past the end gives the last colour."""
    table = np.frombuffer(palette[: len(palette) // components * components], np.uint8).reshape(-1, components)
    return table[np.minimum(values[..., 0], len(table) - 1)] if len(table) else np.zeros((*values.shape[:2], 3), np.uint8)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(pixels: np.ndarray, alpha: np.ndarray | None = None) -> bytes:
    """A PNG of gray (…, 1) or colour (…, 3) bytes, with an alpha plane if given."""
    if alpha is not None:
        colour = np.repeat(pixels, 3, axis=2) if pixels.shape[2] == 1 else pixels
        # The mask is brought to the picture's size by its nearest samples.
        ys, xs = (np.arange(n) * m // n for n, m in zip(pixels.shape[:2], alpha.shape[:2], strict=True))
        pixels = np.concatenate((colour, alpha[ys][:, xs].reshape(*pixels.shape[:2], 1)), axis=2)
    height, width, n = pixels.shape
    lines = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1)
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.astype(np.uint8).tobytes())) + _chunk(b"IEND", b"")


def raw_image(data: bytes, width: int, height: int, bits: int, space: str, palette: bytes = b"", mask: tuple[bytes, int, int, int] | None = None) -> bytes | None:
    """PNG of a decoded image; None for a colour space that is not read. mask: data, width, height, bits."""
    n = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "Indexed": 1}.get(space)
    if n is None or width < 1 or height < 1 or bits not in (1, 2, 4, 8, 16):
        return None
    values = samples(data, bits, width, height, n)
    values = indexed(values, palette) if space == "Indexed" else scaled(values, bits)
    alpha = scaled(samples(mask[0], mask[3], mask[1], mask[2], 1), mask[3])[..., 0] if mask else None
    return png(cmyk_to_rgb(values) if n == 4 else values, alpha)
