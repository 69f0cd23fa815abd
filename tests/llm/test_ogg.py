import hashlib
import random
import zlib

import pytest

from sparkdem.llm import ogg, registry


def plain_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc >> 31 else 0)) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 27, 300):
        data = rng.randbytes(n)
        assert ogg.page_checksum(data) == plain_checksum(data)


@pytest.mark.parametrize("n", [64, 255, 510, 4000, 64_000, 1_000_000])
def test_round_trip_and_streams(n):
    data = random.Random(n).randbytes(n)
    streams = ogg.read_ogg(ogg.write_ogg(data, n))
    assert set(streams) == {ogg.SAMPLES, ogg.NOTES}
    assert b"".join(p for p, _ in streams[ogg.SAMPLES][1:]) == data and streams[ogg.SAMPLES][-1][1] == n
    assert [p for p, _ in streams[ogg.NOTES][1:]] == [b"second %d" % i for i in range(-(-n // ogg.RATE))]


def test_packets_over_pages_and_exact_multiples_of_255():
    packets = [(b"head", 0), (b"x" * 255 * 300, 5), (b"", 5), (b"y" * 510, 9), (b"z" * 70_000, 11)]
    assert [p for p, _ in ogg.read_ogg(b"".join(p for _, p in ogg.pages_of(packets, 3)))[3]] == [p for p, _ in packets]


def test_damage_is_told(spark):
    whole = ogg.write_ogg(b"abcd" * 16_000, 64_000)
    bad = bytearray(whole)
    bad[500] ^= 1
    second = whole.index(b"OggS", 10)
    third = whole.index(b"OggS", second + 1)
    rows = [(1, whole), (2, bytes(bad)), (3, whole[:-100]), (4, None), (5, b"RIFF" + whole), (6, whole[:second] + whole[third:]), (7, b"")]
    got = {r.id: r for r in ogg.from_media(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert got[1].error is None and got[1].seconds == 8.0 and got[1].stamps[:2] == [0.5, 1.0]
    assert all(got[i].error and got[i].payload is None for i in (2, 3, 4, 5, 6, 7))


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = registry.op7_ogg(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == set(docs)
    for r in rows:
        data = docs[r.doc_id].encode()
        full = data + bytes(max(1, -(-len(data) // 64)) * 64 - len(data))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
        assert r.media_sha256 == hashlib.sha256(ogg.write_ogg(full, len(data))).hexdigest() and r.error is None


def test_edge_rows(docs, no_docs):
    rows = ogg.from_media(ogg.to_media(docs)).collect()
    assert len(rows) == docs.count() and all(r.error is None for r in rows)
    assert {len(r.payload) for r in rows if r.n_bytes == 0} == {64}
    assert ogg.from_media(ogg.to_media(no_docs)).collect() == []


def test_stamps_come_from_granule_positions():
    data = bytes(range(256)) * 800
    whole = ogg.write_ogg(data, len(data))
    stamps = ogg.parsed(whole)[4]
    assert stamps == [min(i + ogg.PACKET, len(data)) / ogg.RATE for i in range(0, len(data), ogg.PACKET)]
    pages, at = [], 0
    while at >= 0:
        after = whole.find(b"OggS", at + 1)
        pages.append(whole[at : after if after >= 0 else None])
        at = after
    for serial in (ogg.SAMPLES, ogg.NOTES):  # a page with another granule position and a checksum that fits
        k = max(i for i, p in enumerate(pages) if int.from_bytes(p[14:18], "little") == serial)
        page = pages[k][:6] + (int.from_bytes(pages[k][6:14], "little") - 8000).to_bytes(8, "little") + pages[k][14:]
        page = page[:22] + ogg.page_checksum(page[:22] + bytes(4) + page[26:]).to_bytes(4, "little") + page[26:]
        assert ogg.parsed(b"".join(pages[:k] + [page] + pages[k + 1 :]))[6].startswith("ValueError")
