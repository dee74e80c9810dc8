"""ISO media containers: boxes, sample tables and keyframe byte ranges, without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples a second, samples a chunk, and every so many a keyframe, of the containers that are written here.
RATE, CHUNK, KEY_EVERY = 8000, 4096, 64
#: Boxes that hold boxes, and the bytes before the first of them.
HOLDS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"stsd": 8, b"dref": 8}
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes) -> bytes:
    return box(kind, bytes(4), *parts)


def write(payload: bytes) -> bytes:
    """An ISO container whose one sound track has each byte of `payload` as an unsigned 8-bit sample."""
    n = len(payload)
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK)] * (chunks > 1) + [(chunks, last)] * (chunks == 1 or last != CHUNK)
    keys = range(1, n + 1, KEY_EVERY)
    # sound sample entry: data reference 1, 1 channel, 8 bits, the rate as 16.16
    entry = box(b"raw ", struct.pack(">6xH8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    wide = n >= 1 << 31
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def movie(start: int) -> bytes:
        offsets = [start + i * CHUNK for i in range(chunks)]
        tables = (
            full(b"stsd", struct.pack(">I", 1), entry)
            + full(b"stts", struct.pack(">III", 1, n, 1))
            + full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))
            + full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, size, 1) for first, size in runs))
            + full(b"stsz", struct.pack(">II", 1, n))
            + full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets))
        )
        info = full(b"smhd", bytes(4)) + box(b"dinf", full(b"dref", struct.pack(">I", 1), box(b"url ", b"\0\0\0\1"))) + box(b"stbl", tables)
        media = full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)) + full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0") + box(b"minf", info)
        track = box(b"tkhd", b"\0\0\0\7", struct.pack(">IIIIIQhhHH", 0, 0, 1, 0, n, 0, 0, 0, 0x100, 0), MATRIX, bytes(8)) + box(b"mdia", media)
        top = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", top, box(b"trak", track))

    size = len(movie(0))
    before = 16 if n + 8 >= 1 << 32 else 8
    return head + movie(len(head) + size + before) + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of box kinds, first byte of the body, end) for every box, outer ones first. A box that overruns its parent ends the walk there."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            return
        yield (*path, kind), body, start + size
        if kind in HOLDS:
            yield from walk(data, body + HOLDS[kind], start + size, (*path, kind))
        start += size


def track_tables(data: bytes) -> list[dict]:
    """Per track: codec, timescale, duration, and the sample tables as they stand in the container."""
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": "", "timescale": 0, "duration": 0, "stts": [], "stsc": [], "sizes": [], "offsets": [], "keys": None})
        if not tracks:
            continue
        t = tracks[-1]
        words = lambda skip, count, each=1: struct.unpack_from(f">{count * each}I", data, at + skip)  # noqa: E731, B023
        if len(path) > 1 and path[-2] == b"stsd":
            t["codec"] = t["codec"] or kind.decode("latin-1").strip()
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        elif kind == b"stts":
            flat = words(8, words(4, 1)[0], 2)
            t["stts"] = list(zip(flat[::2], flat[1::2], strict=True))
        elif kind == b"stsc":
            flat = words(8, words(4, 1)[0], 3)
            t["stsc"] = list(zip(flat[::3], flat[1::3], strict=True))
        elif kind == b"stsz":
            each, count = words(4, 2)
            t["sizes"] = (each, count) if each else list(words(12, count))
        elif kind == b"stco":
            t["offsets"] = list(words(8, words(4, 1)[0]))
        elif kind == b"co64":
            t["offsets"] = list(struct.unpack_from(f">{words(4, 1)[0]}Q", data, at + 8))
        elif kind == b"stss":
            t["keys"] = list(words(8, words(4, 1)[0]))
    return tracks


def chunk_ranges(track: dict) -> Iterator[tuple[int, int, int, int]]:
    """(first sample from 0, samples, first byte, bytes) of each chunk, from the sample tables."""
    sizes = track["sizes"]
    fixed = sizes[0] if isinstance(sizes, tuple) else 0
    sums = None if fixed else [0, *accumulate(sizes)]
    runs, sample, run = track["stsc"], 0, 0
    for i, offset in enumerate(track["offsets"], 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= i:
            run += 1
        count = runs[run][1]
        yield sample, count, offset, fixed * count if fixed else sums[sample + count] - sums[sample]
        sample += count


def describe(data: bytes) -> list[dict]:
    """Per track: codec, duration in seconds, samples, and (first byte, end) of the keyframes; runs that touch are one range.

    Only the tables are read, never the payload. A track without a sync table has keyframes only.
    """
    out = []
    for t in track_tables(data):
        sizes = t["sizes"]
        fixed = sizes[0] if isinstance(sizes, tuple) else 0
        sums = None if fixed else [0, *accumulate(sizes)]
        count = sizes[1] if fixed else len(sizes)
        keys = range(1, count + 1) if t["keys"] is None else t["keys"]
        ranges: list[list[int]] = []
        chunks = chunk_ranges(t)
        first, held, offset, _ = next(chunks, (0, 0, 0, 0))
        for key in keys:
            while key - 1 >= first + held:
                first, held, offset, _ = next(chunks)
            at = offset + (fixed * (key - 1 - first) if fixed else sums[key - 1] - sums[first])
            end = at + (fixed or sizes[key - 1])
            if ranges and ranges[-1][1] == at:
                ranges[-1][1] = end
            else:
                ranges.append([at, end])
        out.append({"codec": t["codec"], "duration": t["duration"] / t["timescale"] if t["timescale"] else 0.0, "samples": count, "keyframes": ranges})
    return out


def try_describe(data: bytes) -> tuple[list[dict], str | None]:
    """`describe`, and None; or no tracks and what is wrong, where tables are cut short or contradict each other."""
    try:
        return describe(data), None
    except (struct.error, IndexError, StopIteration) as e:
        return [], f"malformed tables: {type(e).__name__}"


def read(data: bytes) -> bytes:
    """The stored bytes of the first track, by its sample tables."""
    tracks = track_tables(data)
    return b"".join(data[at : at + size] for _, _, at, size in chunk_ranges(tracks[0])) if tracks else b""


def pad(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0))


def feature_of(track: dict) -> str:
    """Codec, duration, samples, keyframe count and a digest of the keyframe ranges."""
    ranges = track["keyframes"]
    digest = zlib.crc32(struct.pack(f">{2 * len(ranges)}Q", *(x for r in ranges for x in r)))
    return f"{track['codec']}|{track['duration']:.6f}|{track['samples']}|{len(ranges)}|{digest:08x}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_column(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, media): each text, padded, as a container. Null and empty texts give 64 zero bytes."""

    def make() -> Callable:
        return lambda b: {"doc_id": b.column(0), "media": [write(pad(t.encode("utf-8", "surrogatepass"))) for t in common.texts_of(b)]}

    return common.map_texts(docs, [common.doc_id(), F.col(text).alias("text")], "doc_id long, media binary", make)


def media_features(docs: DataFrame) -> DataFrame:
    """Store each text as a container, read it back by its tables, and describe it.

    A null text is the empty text; an empty text is stored as 64 zero bytes. Repeated rows give repeated rows, an
    empty table an empty result, and further columns of `docs` are not read.
    """

    def make() -> Callable:
        def rows(batch):
            out: dict[str, list] = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for text in common.texts_of(batch):
                raw = text.encode("utf-8", "surrogatepass")
                media = write(pad(raw))
                back = read(media)
                for name, value in zip(out, (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(describe(media)[0])), strict=True):
                    out[name].append(value)
            return {"doc_id": batch.column(0)} | out

        return rows

    return common.map_texts(docs, [common.doc_id(), "text"], SCHEMA, make)
