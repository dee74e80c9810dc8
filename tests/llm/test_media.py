import hashlib
import struct
import zlib
from collections import Counter

import pytest

from gridweave.llm import media


@pytest.mark.parametrize("n", [64, 128, 4096, 4160, 3 * 4096, 70_016])
def test_round_trip_by_the_sample_tables(n):
    payload = bytes((i * 7) % 256 for i in range(n))
    data = media.write(payload)
    assert media.read(data) == payload
    (track,) = media.describe(data)
    assert track["codec"] == "raw" and track["duration"] == n / media.RATE and track["samples"] == n
    assert b"".join(data[a:b] for a, b in track["keyframes"]) == payload[:: media.KEY_EVERY]


def test_tables_with_own_sizes_and_no_sync_table():
    sizes = [3, 5, 2, 4]
    table = (
        media.full(b"stsd", struct.pack(">I", 1), media.box(b"avc1", bytes(70)))
        + media.full(b"stts", struct.pack(">III", 1, 4, 500))
        + media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 3, 1, 2, 1, 1))
        + media.full(b"stsz", struct.pack(">II4I", 0, 4, *sizes))
        + media.full(b"stco", struct.pack(">III", 2, 1000, 2000))
    )
    inner = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 2000, 0, 0)) + media.box(b"minf", media.box(b"stbl", table))
    data = media.box(b"moov", media.box(b"trak", media.box(b"mdia", inner)))
    (track,) = media.describe(data)
    assert track == {"codec": "avc1", "duration": 2.0, "samples": 4, "keyframes": [[1000, 1010], [2000, 2004]]}


def test_walk_stops_at_a_broken_box():
    assert [p for p, _, _ in media.walk(media.box(b"free", b"ab") + b"\0\0\1\0oops")] == [(b"free",)]
    assert media.describe(b"") == [] and media.read(b"") == b""


def test_media_features(hard_docs, no_docs):
    rows = media.media_features(hard_docs).collect()
    want = Counter()
    for r in hard_docs.collect():
        raw = (r.text or "").encode()
        stored = raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)
        want[r.doc_id, len(raw), len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    files = {r.doc_id: r.media for r in media.media_column(hard_docs).collect()}
    assert all(r.media_sha256 == hashlib.sha256(files[r.doc_id]).hexdigest() and r.media_bytes == len(files[r.doc_id]) for r in rows)
    assert media.media_features(no_docs).collect() == []


def test_malformed_tables_give_an_error():
    good = media.write(media.pad(b"some payload of bytes" * 40))
    assert media.try_describe(good) == (media.describe(good), None)
    at = good.index(b"stts")
    cut = good[: at + 8] + b"\xff\xff\xff\xff" + good[at + 12 :]  # more entries than the file has bytes
    late = good.index(b"stss")
    beyond = good[: late + 12] + b"\x00\x10\x00\x00" + good[late + 16 :]  # a sync sample beyond the end
    no_runs = good.replace(b"stsc", b"free")
    for data in (cut, beyond, no_runs):
        tracks, error = media.try_describe(data)
        assert tracks == [] and error.startswith("malformed")
    assert media.try_describe(b"") == ([], None)
