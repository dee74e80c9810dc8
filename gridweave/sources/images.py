"""Image files in pure Python: PPM/PGM, PNG and TIFF, read by extension, written by format.

Reading is a map over whole files (`binaryFile`), writing a map to file contents; neither shuffles. Samples are arrays
row by row, channels interleaved.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

SCHEMA = "path string, format string, width int, height int, channels int, bits int, samples array<float>, error string"


def read_pnm(data: bytes) -> tuple[np.ndarray, int]:
    """Binary PGM and PPM, 8 or 16 bits; (height, width, channels) and bits."""
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    channels = {b"P5": 1, b"P6": 3}[data[:2]]
    kind = ">u2" if most > 255 else "u1"
    return np.frombuffer(data, kind, width * height * channels, at + 1).reshape(height, width, channels), 16 if most > 255 else 8


def write_pnm(a: np.ndarray, bits: int) -> bytes:
    kind = b"P5" if a.shape[2] == 1 else b"P6"
    return b"%s\n%d %d\n%d\n" % (kind, a.shape[1], a.shape[0], (1 << bits) - 1) + a.astype(">u2" if bits == 16 else "u1").tobytes()


#: PNG colour types by channels.
PNG_TYPES = {1: 0, 2: 4, 3: 2, 4: 6}


def write_png(a: np.ndarray, bits: int, level: int = 6) -> bytes:
    """PNG with the up filter on every row but the first."""
    raw = np.ascontiguousarray(a.astype(">u2" if bits == 16 else "u1")).view("u1").reshape(a.shape[0], -1)
    rows = raw.copy()
    rows[1:] = raw[1:] - raw[:-1]
    body = np.concatenate([np.where(np.arange(len(rows)) == 0, 0, 2).astype("u1")[:, None], rows], axis=1).tobytes()
    chunk = lambda kind, x: struct.pack(">I", len(x)) + kind + x + struct.pack(">I", zlib.crc32(kind + x))
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], bits, PNG_TYPES[a.shape[2]], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body, level)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[np.ndarray, int]:
    """PNG of 8 or 16 bits, without palette or interlacing; all five row filters."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    width, height, bits, kind, _, _, interlaced = head
    channels = {v: k for k, v in PNG_TYPES.items()}.get(kind)
    if channels is None or bits not in (8, 16) or interlaced:
        raise ValueError("a PNG of this kind is not supported")
    step = channels * bits // 8
    rows = np.frombuffer(zlib.decompress(b"".join(body)), "u1").reshape(height, width * step + 1)
    out = np.zeros((height + 1, width * step), dtype="u1")
    for y in range(height):
        out[y + 1] = _unfilter(int(rows[y, 0]), rows[y, 1:], out[y], step)
    a = out[1:].reshape(-1)
    return (a.view(">u2") if bits == 16 else a).reshape(height, width, channels), bits


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, step), axis=0, dtype="u1").reshape(-1)
    out = row.astype(np.int64)
    for i in range(len(out)):
        left = out[i - step] if i >= step else 0
        up, corner = int(above[i]), int(above[i - step]) if i >= step else 0
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
        out[i] = (out[i] + guess) & 255
    return out.astype("u1")


def write_tiff(a: np.ndarray, bits: int, is_float: bool = False, compressed: bool = False) -> bytes:
    """A TIFF of one strip, little endian: 8, 16 or 32 bits, whole or float, plain or deflated."""
    kind = "<f4" if is_float else {8: "u1", 16: "<u2", 32: "<u4"}[bits]
    body = a.astype(kind).tobytes()
    body = zlib.compress(body) if compressed else body
    channels = a.shape[2]
    tags = [
        (256, 4, 1, a.shape[1]), (257, 4, 1, a.shape[0]), (258, 3, channels, bits), (259, 3, 1, 8 if compressed else 1), (262, 3, 1, 1 if channels == 1 else 2), (273, 4, 1, 0), (277, 3, 1, channels),
        (278, 4, 1, a.shape[0]), (279, 4, 1, len(body)), (284, 3, 1, 1), (339, 3, channels, 3 if is_float else 1),
    ]
    extra_at = 8 + 2 + 12 * len(tags) + 4
    extra, rows = b"", []
    for tag, form, count, value in tags:
        if form == 3 and count > 2:
            place, more = extra_at + len(extra), struct.pack(f"<{count}H", *[value] * count)
            extra += more
            rows.append(struct.pack("<HHII", tag, form, count, place))
        elif form == 3:
            rows.append(struct.pack("<HHIHH", tag, form, count, value, value if count == 2 else 0))
        else:
            rows.append([tag, form, count, value])
    start = extra_at + len(extra)
    packed = b"".join(r if isinstance(r, bytes) else struct.pack("<HHII", *r[:3], start if r[0] == 273 else r[3]) for r in rows)
    return b"II*\0" + struct.pack("<IH", 8, len(tags)) + packed + bytes(4) + extra + body


def read_tiff(data: bytes) -> tuple[np.ndarray, int]:
    """Strips of 8, 16, 24 or 32 bits, whole or float, chunky or planar, plain or deflated, either byte order."""
    e = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack_from(e + "I", data, 4)
    (count,) = struct.unpack_from(e + "H", data, at)
    tags: dict[int, tuple] = {}
    for k in range(count):
        tag, form, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * k)
        code, size = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(form, ("", 0))
        if code:
            place = at + 2 + 12 * k + 8
            place = place if n * size <= 4 else struct.unpack_from(e + "I", data, place)[0]
            tags[tag] = struct.unpack_from(f"{e}{n}{code}", data, place)
    width, height, bits, channels = tags[256][0], tags[257][0], tags[258][0], tags.get(277, (1,))[0]
    packed, planar, is_float = tags.get(259, (1,))[0], tags.get(284, (1,))[0] == 2, tags.get(339, (1,))[0] == 3
    strips = [data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    if packed in (8, 32946):
        strips = [zlib.decompress(s) for s in strips]
    elif packed != 1:
        raise ValueError(f"TIFF compression {packed} is not supported")
    raw = b"".join(strips)
    if bits == 24 and is_float:
        a = _float24(np.frombuffer(raw, "u1").reshape(-1, 3), e == "<")
    else:
        kind = {(8, False): "u1", (16, False): "u2", (32, False): "u4", (16, True): "f2", (32, True): "f4"}[bits, is_float]
        a = np.frombuffer(raw, e + kind)
    shape = (channels, height, width) if planar else (height, width, channels)
    a = a[: width * height * channels].reshape(shape)
    return (a.transpose(1, 2, 0) if planar else a), bits


def _float24(b: np.ndarray, little: bool) -> np.ndarray:
    """A sign, 7 bits of exponent, 16 of mantissa."""
    b = b.astype(np.int64)
    v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16 if little else b[:, 2] | b[:, 1] << 8 | b[:, 0] << 16
    sign, power, rest = v >> 23, v >> 16 & 127, v & 65535
    value = np.where(power == 0, rest / 65536 * 2.0**-62, (1 + rest / 65536) * 2.0 ** (power - 63.0))
    return np.where(sign == 1, -value, value)


READERS: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] = {"png": read_png, "ppm": read_pnm, "pgm": read_pnm, "tif": read_tiff, "tiff": read_tiff}


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """All image files below `path`, decoded by extension. A file of another kind, or a broken one, keeps its row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = {"path": name, "format": kind, "width": None, "height": None, "channels": None, "bits": None, "samples": None, "error": None}
                reader = READERS.get(kind)
                if reader is None:
                    row["error"] = "unknown file type"
                else:
                    try:
                        a, bits = reader(data)
                        row |= {"width": a.shape[1], "height": a.shape[0], "channels": a.shape[2], "bits": bits, "samples": a.astype(np.float32).ravel()}
                    except (ValueError, KeyError, IndexError, TypeError, struct.error, zlib.error) as e:
                        row["error"] = f"{type(e).__name__}: {e}"[:200]
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.lower(text.extension(F.col("path"))).alias("format"), "content").mapInArrow(run, SCHEMA)


_ARROW = pa.schema([("path", pa.string()), ("format", pa.string()), *((n, pa.int32()) for n in ("width", "height", "channels", "bits")), ("samples", pa.list_(pa.float32())), ("error", pa.string())])


def encode_images(df: DataFrame, kind: str, bits: int = 8, is_float: bool = False, compressed: bool = False) -> DataFrame:
    """(path, content) of (path, width, height, channels, samples): whole samples are rounded and kept within range."""
    if kind not in ("png", "ppm", "pgm", "tif", "tiff"):
        raise ValueError(f"no writer for {kind}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, w, h, c, samples in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                a = np.array(samples, dtype=np.float64).reshape(h, w, c)
                a = a if is_float else np.clip(np.floor(a + 0.5), 0, (1 << bits) - 1)
                data = write_tiff(a, 32 if is_float else bits, is_float, compressed) if kind.startswith("tif") else write_png(a, bits) if kind == "png" else write_pnm(a, bits)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["path", "content"])

    return df.select("path", "width", "height", "channels", "samples").mapInArrow(run, "path string, content binary")


def save_images(df: DataFrame, folder: str, kind: str, bits: int = 8, is_float: bool = False, compressed: bool = False) -> DataFrame:
    """Write images as files of `folder`, a URI of a store that all executors reach; (path, bytes) of what was written.

    A file is named after its image, so a task that runs again writes the same files; each is complete under another name
    before it gets its own. Nothing is written until the result is used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        for batch in batches:
            out = []
            for name, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                stem = name.replace("\\", "/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
                path = f"{root}/{stem}.{kind}"
                with store.open_output_stream(f"{root}/.{stem}.{kind}.part") as f:
                    f.write(data)
                store.move(f"{root}/.{stem}.{kind}.part", path)
                out.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.compute.cast(pa.compute.binary_length(batch.column(1)), pa.int64())], ["path", "bytes"])

    import pyarrow.compute  # noqa: F401

    return encode_images(df, kind, bits, is_float, compressed).mapInArrow(run, "path string, bytes long")
