"""Bytes of image files to header and array, and back: FITS, XISF and 32-bit TIFF, by struct and NumPy alone.

Arrays are (channels, height, width) on the file's side; the frame tables are (height, width, channels).
"""

from __future__ import annotations

import struct
import xml.etree.ElementTree as ET
from xml.sax.saxutils import quoteattr

import numpy as np

BLOCK = 2880


class FormatError(ValueError):
    """A file that isn't of the format it should be."""


# -- FITS

def _card_value(text: str):
    text = text.strip()
    if text.startswith("'"):
        end, out = 1, []
        while end < len(text):
            if text[end] == "'":
                if text[end + 1 : end + 2] != "'":
                    break
                end += 1
            out.append(text[end])
            end += 1
        return "".join(out).rstrip()
    text = text.split("/")[0].strip()
    if text in ("T", "F"):
        return text == "T"
    if not text:
        return None
    try:
        return int(text)
    except ValueError:
        try:
            return float(text.replace("D", "E"))
        except ValueError:
            return text


def fits_header(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The cards of the header at ``at`` and where its data starts."""
    cards: dict = {}
    if at == 0 and data[:9] != b"SIMPLE  =":
        raise FormatError("not a FITS file")
    while True:
        block = data[at : at + BLOCK]
        if len(block) < BLOCK:
            raise FormatError("a FITS header has no END")
        at += BLOCK
        for k in range(0, BLOCK, 80):
            card = block[k : k + 80].decode("ascii", "replace")
            key = card[:8].strip()
            if key == "END":
                return cards, at
            if card[8:10] == "= " and key not in cards:
                cards[key] = _card_value(card[10:])


_FITS_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def fits_decode(data: bytes) -> tuple[dict, np.ndarray]:
    cards, at = fits_header(data)
    shape = tuple(int(cards[f"NAXIS{k}"]) for k in range(int(cards.get("NAXIS", 0)), 0, -1))
    kind = np.dtype(_FITS_TYPES[int(cards["BITPIX"])])
    n = int(np.prod(shape)) if shape else 0
    if len(data) < at + n * kind.itemsize:
        raise FormatError("FITS data is cut short")
    a = np.frombuffer(data, kind, n, at).reshape(shape or (0, 0)).astype(np.float64)
    scale, zero = float(cards.get("BSCALE", 1)), float(cards.get("BZERO", 0))
    a = a * scale + zero if (scale, zero) != (1.0, 0.0) else a
    return cards, (a if a.ndim == 3 else a.reshape(1, *a.shape[-2:])).astype(np.float32)


def _card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, np.integer)):
        text = f"{int(value):>20}"
    elif isinstance(value, (float, np.floating)):
        text = f"{float(value)!r:>20}".replace("e", "E")
    else:
        text = "'" + str(value).replace("'", "''")[:66].ljust(8) + "'"
    return f"{key.upper()[:8]:<8}= {text}"[:80].ljust(80).encode("ascii", "replace")


def _cards_block(cards: list[tuple[str, object]]) -> bytes:
    out = b"".join(_card(k, v) for k, v in cards) + b"END".ljust(80)
    return out.ljust(-(-len(out) // BLOCK) * BLOCK)


def fits_encode(a: np.ndarray, extra: dict | None = None) -> bytes:
    """A primary image of 32-bit floats; ``extra`` cards follow the structural ones."""
    a = a[0] if a.ndim == 3 and a.shape[0] == 1 else a
    cards: list[tuple[str, object]] = [("SIMPLE", True), ("BITPIX", -32), ("NAXIS", a.ndim)] + [(f"NAXIS{k + 1}", n) for k, n in enumerate(a.shape[::-1])]
    taken = {k for k, _ in cards}
    cards += [(k, v) for k, v in (extra or {}).items() if v is not None and k.upper() not in taken]
    body = np.ascontiguousarray(a, ">f4").tobytes()
    return _cards_block(cards) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def fits_table_encode(columns: list[tuple[str, np.ndarray]], extra: dict | None = None) -> bytes:
    """A binary table: integers as 32 bits (J), others as 64-bit floats (D)."""
    kinds = [(n, ">i4", "J") if np.issubdtype(v.dtype, np.integer) else (n, ">f8", "D") for n, v in columns]
    rows = np.zeros(len(columns[0][1]) if columns else 0, [(n, k) for n, k, _ in kinds])
    for n, v in columns:
        rows[n] = v
    cards: list[tuple[str, object]] = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", rows.dtype.itemsize), ("NAXIS2", len(rows)), ("PCOUNT", 0), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for k, (n, _, code) in enumerate(kinds, 1):
        cards += [(f"TTYPE{k}", n), (f"TFORM{k}", code)]
    cards += list((extra or {}).items())
    body = rows.tobytes()
    return _cards_block([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)]) + _cards_block(cards) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def fits_table_decode(data: bytes) -> tuple[dict, dict[str, np.ndarray]]:
    _, at = fits_header(data)
    cards, at = fits_header(data, at)
    kinds = [(cards[f"TTYPE{k}"], {"J": ">i4", "D": ">f8"}[cards[f"TFORM{k}"].strip()]) for k in range(1, int(cards["TFIELDS"]) + 1)]
    rows = np.frombuffer(data, np.dtype(kinds), int(cards["NAXIS2"]), at)
    return cards, {n: rows[n] for n, _ in kinds}


# -- XISF

XISF_MAGIC = b"XISF0100"
_XISF_TYPES = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8"}


def xisf_header(data: bytes) -> ET.Element:
    if data[:8] != XISF_MAGIC:
        raise FormatError("not an XISF file")
    n = struct.unpack_from("<I", data, 8)[0]
    return ET.fromstring(data[16 : 16 + n].rstrip(b"\0"))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def xisf_cards(root: ET.Element) -> dict:
    """Keywords in FITS terms; instrument properties come first and keywords fill the gaps."""
    out: dict = {}
    props = {"Instrument:ExposureTime": "EXPTIME", "Instrument:Camera:Gain": "GAIN", "Instrument:Sensor:Temperature": "CCD-TEMP", "Observation:Time:Start": "DATE-OBS"}
    for e in root.iter():
        if _tag(e) == "Property":
            for name, key in props.items():
                if name.split(":")[-1].lower() in e.get("id", "").lower():
                    out.setdefault(key, e.get("value", e.text))
    for e in root.iter():
        if _tag(e) == "FITSKeyword" and e.get("name"):
            out.setdefault(e.get("name"), _card_value(e.get("value", "")))
    return out


def xisf_decode(data: bytes) -> tuple[dict, np.ndarray]:
    root = xisf_header(data)
    image = next((e for e in root.iter() if _tag(e) == "Image"), None)
    if image is None:
        raise FormatError("an XISF file has no image")
    w, h, c = (int(v) for v in image.get("geometry").split(":"))
    kind, offset, size = image.get("location").split(":")
    if kind != "attachment":
        raise FormatError(f"XISF location {kind} isn't read")
    a = np.frombuffer(data, _XISF_TYPES[image.get("sampleFormat")], w * h * c, int(offset))
    if len(data) < int(offset) + int(size):
        raise FormatError("XISF data is cut short")
    return xisf_cards(root), a.reshape(c, h, w).astype(np.float32)


def xisf_encode(a: np.ndarray, extra: dict | None = None) -> bytes:
    a = np.ascontiguousarray(a if a.ndim == 3 else a[None], "<f4")
    c, h, w = a.shape
    keys = "".join(f"<FITSKeyword name={quoteattr(str(k))} value={quoteattr(str(v))} comment=\"\"/>" for k, v in (extra or {}).items() if v is not None)
    offset = 0
    while True:  # the header's length depends on the offset that it names
        xml = f'<?xml version="1.0" encoding="UTF-8"?><xisf version="1.0" xmlns="http://www.pixinsight.com/xisf"><Image geometry="{w}:{h}:{c}" sampleFormat="Float32" colorSpace="{"RGB" if c == 3 else "Gray"}" location="attachment:{offset}:{a.nbytes}">{keys}</Image></xisf>'.encode()
        need = -(-(16 + len(xml)) // 128) * 128
        if need == offset:
            break
        offset = need
    return (XISF_MAGIC + struct.pack("<II", len(xml), 0) + xml).ljust(offset, b"\0") + a.tobytes()


# -- TIFF, uncompressed strips

def tiff_encode(a: np.ndarray) -> bytes:
    """32-bit floats, one or three channels."""
    a = a if a.ndim == 3 else a[None]
    if a.shape[0] not in (1, 3):
        raise FormatError("a TIFF has one or three channels")
    c, h, w = a.shape
    body = np.ascontiguousarray(np.moveaxis(a, 0, 2), "<f4").tobytes()
    n_tags = 11
    extra_at = 8 + 2 + 12 * n_tags + 4
    data_at = extra_at + 4 * c
    many = lambda tag, v: (tag, 3, c, v | (v << 16) if c == 2 else v) if c == 1 else None
    bits = many(258, 32) or (258, 3, c, extra_at)
    sample = many(339, 3) or (339, 3, c, extra_at + 2 * c)
    tags = [(256, 4, 1, w), (257, 4, 1, h), bits, (259, 3, 1, 1), (262, 3, 1, 2 if c == 3 else 1), (273, 4, 1, data_at), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(body)), (284, 3, 1, 1), sample]
    out = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", n_tags) + b"".join(struct.pack("<HHII", *t) for t in sorted(tags)) + struct.pack("<I", 0)
    return out + struct.pack(f"<{2 * c}H", *[32] * c, *[3] * c) + body


def tiff_decode(data: bytes) -> tuple[dict, np.ndarray]:
    """Unsigned integers or floats in uncompressed chunky strips, either byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise FormatError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    sizes, tags = {1: "B", 3: "H", 4: "I"}, {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        p = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", data, p)
        if kind in sizes:
            size = struct.calcsize(sizes[kind]) * n
            p = p + 8 if size <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
            tags[tag] = struct.unpack_from(f"{order}{n}{sizes[kind]}", data, p)
    if tags.get(259, (1,))[0] != 1 or tags.get(284, (1,))[0] != 1:
        raise FormatError("only uncompressed chunky TIFFs are read")
    w, h, c = tags[256][0], tags[257][0], tags.get(277, (1,))[0]
    code = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (3, 32): "f4", (3, 64): "f8"}.get((tags.get(339, (1,))[0], tags.get(258, (1,))[0]))
    if code is None:
        raise FormatError("a TIFF sample format isn't read")
    body = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279]))
    return {}, np.moveaxis(np.frombuffer(body, order + code, w * h * c).reshape(h, w, c), 2, 0).astype(np.float32)


DECODERS = {".fits": fits_decode, ".fit": fits_decode, ".fts": fits_decode, ".xisf": xisf_decode, ".tif": tiff_decode, ".tiff": tiff_decode}
ENCODERS = {"fits": fits_encode, "xisf": xisf_encode, "tiff32": lambda a, extra=None: tiff_encode(a)}
SUFFIX = {"fits": ".fits", "xisf": ".xisf", "tiff32": ".tif"}


def header_of(data: bytes, suffix: str) -> dict:
    """Cards without decoding pixels, with NAXIS cards for any format."""
    if suffix in (".fits", ".fit", ".fts"):
        return fits_header(data)[0]
    if suffix == ".xisf":
        root = xisf_header(data)
        image = next((e for e in root.iter() if _tag(e) == "Image"), None)
        w, h, c = image.get("geometry").split(":") if image is not None else ("0", "0", "0")
        return xisf_cards(root) | {"NAXIS": 3, "NAXIS1": w, "NAXIS2": h, "NAXIS3": c}
    a = DECODERS[suffix](data)[1]
    return {"NAXIS": 3, "NAXIS1": a.shape[2], "NAXIS2": a.shape[1], "NAXIS3": a.shape[0]}
