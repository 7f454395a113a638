import hashlib
import random
import struct
import zlib

import pytest

from lodestar.llm import matroska as m
from tests.llm.conftest import ODD


@pytest.mark.parametrize("lacing", ["xiph", "fixed", "ebml"])
@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 400_000])
def test_round_trip(lacing, n):
    payload, length = m.payload_of("é" * n)
    assert length == 2 * n and len(payload) % 192 == 0 and len(payload) >= 192
    data = m.mux(payload, lacing)
    movie = m.demux(data)
    assert m.read_payload(data, movie) == payload
    assert [c[2] for c in movie.cues] == [c[1] for c in movie.clusters]
    assert [c[0] for c in movie.cues] == [c[0] for c in movie.clusters]
    assert [p[1] for p in movie.packets] == [k * 24_000_000 for k in range(len(payload) // 192)]
    assert movie.duration == len(payload) / 8


@pytest.mark.parametrize("lacing", ["xiph", "ebml"])
def test_lacing_of_unequal_frames(lacing):
    dice = random.Random(1)
    for _ in range(30):
        frames = [dice.randbytes(dice.choice((0, 1, 126, 127, 128, 254, 255, 256, 510, 70_000))) for _ in range(dice.randrange(2, 10))]
        body = m.block(1, 0, frames, lacing)
        assert [body[s : s + n] for s, n in m.laces(body, 4, len(body), m.LACINGS[lacing])] == frames


def file_of(clusters, tracks=b""):
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))
    return head, tracks + clusters


def test_block_groups_unknown_sizes_and_other_elements():
    group = m.element(m.BLOCK_GROUP, m.element(m.BLOCK, m.block(300, -5, [b"ab", b"cde", b""], "xiph", 0)) + m._uint(m.BLOCK_DURATION, 30) + m.element(0xFB, b"\xff"))
    body = m._uint(m.TIMESTAMP, 100) + m.element(0xEC, b"void") + group + m.element(m.SIMPLE_BLOCK, m.block(2, 7, [b"xyz"]))
    unknown = m.CLUSTER.to_bytes(4, "big") + b"\x01" + b"\xff" * 7
    head = m.element(m.EBML, m.element(m.DOC_TYPE, b"webm"))
    data = head + m.SEGMENT.to_bytes(4, "big") + b"\xff" + m.element(m.INFO, m._uint(m.TIMESTAMP_SCALE, 1000) + m.element(m.DURATION, struct.pack(">f", 2.5))) + unknown + body + unknown + m._uint(m.TIMESTAMP, 200) + m.element(m.SIMPLE_BLOCK, m.block(2, 0, [b"q"]))
    movie = m.demux(data)
    assert [(t, ns, data[s : s + n], key, c) for t, ns, s, n, _, key, c in movie.packets] == [
        (300, 95_000, b"ab", False, 0), (300, 105_000, b"cde", False, 0), (300, 115_000, b"", False, 0), (2, 107_000, b"xyz", True, 0), (2, 200_000, b"q", True, 1),
    ]
    assert movie.duration == 2.5


def test_damaged_files_raise():
    data = m.mux(m.payload_of("text")[0])
    for cut in range(1, len(data) - 1, 7):
        with pytest.raises(m.MatroskaError):
            m.demux(data[:cut])
    for bad in (b"", b"\x00" * 40, b"\x1a\x45\xdf\xa3\x80"):
        with pytest.raises(m.MatroskaError):
            m.demux(bad)


def test_columns(spark, make):
    rows = list(enumerate(ODD))
    got = {r["doc_id"]: r for r in m.digest(make(rows, extra=True)).collect()}
    media = m.store(make(rows))
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.collect()}
    packets = m.packet_table(media).groupBy("doc_id").count().collect()
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:]) and r["media_sha256"] == hashlib.sha256(stored[i]).hexdigest() and r["media_bytes"] == len(stored[i])
    assert {r["doc_id"]: r["count"] for r in packets} == {i: got[i]["payload_bytes"] // 192 for i, _ in rows}
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [(r["doc_id"], r["error"] is not None) for r in m.packet_table(bad).collect()] == [(1, True)]
    assert m.digest(make([])).count() == 0
