import gzip
import hashlib
import random
import zlib

import pytest

from tramline.llm import warc
from tramline.store import scratch


def archive(n=6, plain=False):
    raws = [warc.record(i, f"http://x/{i}", (f"<p>{i}</p>" * (i * 40 + 1)).encode(), hashlib.sha1((f"<p>{i}</p>" * (i * 40 + 1)).encode()).hexdigest(), None) for i in range(n)]
    return raws if plain else [warc.member(r) for r in raws]


def keys(found):
    return [f.header["warc-record-id"].rpartition(":")[2].rstrip(">") for f in found if f.reason is None]


@pytest.mark.parametrize("plain", [False, True])
def test_salvage(plain):
    parts = archive(plain=plain)
    data = b"".join(parts)
    assert keys(warc.salvage(data)) == list("012345")
    # A damaged record is lost alone, and exactly its bytes are quarantined.
    at = len(parts[0]) + len(parts[1])
    for k in (0, 20, len(parts[2]) // 2, len(parts[2]) - 6):
        broken = bytearray(data)
        broken[at + k] ^= 0x5A
        found = list(warc.salvage(bytes(broken)))
        # Where only the member's checksum is wrong, the record's own digest proves it whole.
        assert keys(found) == list("012345" if not plain and k == len(parts[2]) - 6 else "01345"), k
        gap = [f for f in found if f.reason]
        assert [(g.offset, g.length) for g in gap] == [(at, len(parts[2]))]
    # Bytes put between records, in front and behind, and a cut end.
    noisy = b"junk" + parts[0] + b"\x1f\x8b\x08 no member WARC/1.0\r\nnor record" + parts[1] + parts[2][:-5]
    found = list(warc.salvage(noisy))
    assert keys(found) == ["0", "1"] and sum(f.reason is not None for f in found) == 3
    covered = {(f.offset, f.offset + f.length) for f in found}
    assert sum(b - a for a, b in covered) == len(noisy)
    assert list(warc.salvage(b"")) == []


def test_random_damage_never_raises():
    data = b"".join(archive())
    rng = random.Random(4)
    for _ in range(200):
        broken = bytearray(data)
        for _ in range(rng.randrange(1, 4)):
            broken[rng.randrange(len(broken))] = rng.randrange(256)
        cut = bytes(broken[: rng.randrange(len(broken))])
        assert sum(f.length for f in {f.offset: f for f in warc.salvage(cut)}.values()) == len(cut)


def test_members_end_in_zero():
    for raw in (b"", b"x" * 10, bytes(1 << 24), b"y" * ((1 << 24) + 5)):
        data = warc.member(raw)
        assert data[-1] == 0 and gzip.decompress(data) == raw
    assert zlib.decompress(warc._EMPTY, 31) == b""


def test_write_and_read(spark):
    big, small = "ü" * 600, "s" * 999
    rows = [(1, "http://a b\r\n", big), (2, None, big), (9, "u", big), (3, "u", small), (4, "u", small), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "x" * 2_000_000), (8, "u", "tie" * 400), (8, "u", "tie" * 400), (10, "u", "WARC/1.1\r\n" * 200)]
    df = spark.createDataFrame([(*r, "q") for r in rows], "page_id long, url string, html string, payload_bytes string").repartition(3)
    path = scratch(spark, "warc")
    warc.write(df, path, "page_id", records=4)
    got = warc.read(spark, path, with_payload=True).collect()
    assert len(got) == len(rows) and all(r.gap is None for r in got)
    want = []
    for k, _, html in rows:
        raw = (html or "").encode()
        top = max(i for i, _, h in rows if h == html and i is not None)
        revisit = len(raw) >= 1000 and k != top
        want.append((k or -1, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else -1, b"" if revisit else raw))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1, bytes(r.payload)) for r in got) == sorted(want)
    empty = scratch(spark, "warc")
    warc.write(df.limit(0), empty, "page_id")
    assert warc.read(spark, empty).count() == 0


def test_salvage_within_members():
    raws = archive(6, plain=True)
    # One member of six records; in its content the third is damaged, so the stream itself is sound.
    bad = bytearray(raws[2])
    bad[len(bad) // 2] ^= 1
    whole = [*raws[:2], bytes(bad), *raws[3:]]
    data = zlib.compress(b"".join(whole), 6, 31) + warc.member(warc.record(9, None, b"z", hashlib.sha1(b"z").hexdigest(), None))
    found = list(warc.salvage(data))
    assert keys(found) == list("013459")
    gap = [f for f in found if f.reason]
    assert [(g.inner_offset, g.inner_length) for g in gap] == [(len(raws[0]) + len(raws[1]), len(raws[2]))] and gap[0].offset == 0
    # A stream that breaks off, or breaks, keeps the records that lie before.
    one = zlib.compressobj(0, zlib.DEFLATED, 31)
    stored = one.compress(b"".join(raws)) + one.flush()
    for cut, before in ((stored[: len(stored) - len(raws[5]) // 2 - 8], 5), (stored[: len(raws[0]) + 40], 1)):
        assert keys(warc.salvage(cut + data)) == [*list("012345")[:before], *"013459"]
    broken = bytearray(stored)
    broken[-3] ^= 0xFF
    found = list(warc.salvage(bytes(broken)))
    assert keys(found) == list("012345") and [(f.offset, f.length) for f in found if f.reason] == [(0, len(stored))]
    # Without a digest a record of a damaged member is not taken.
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len([f for f in warc.salvage(zlib.compress(bare, 6, 31)) if f.reason is None]) == 1
    assert not [f for f in warc.salvage(zlib.compress(bare, 6, 31)[:-4] + b"xxxx") if f.reason is None]


def test_archives_are_bounded_by_bytes(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, None, rng.randbytes(60_000 if i % 4 else 400_000).hex()) for i in range(40)]
    monkeypatch.setattr(warc, "ARCHIVE", 1 << 20)
    path = scratch(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, "page_id", records=64)
    sizes = [r.n for r in warc.archives(spark, path).selectExpr("length(content) AS n").collect()]
    assert len(sizes) > 5 and max(sizes) < (1 << 20) + 600_000
    assert sorted(r.page_id for r in warc.read(spark, path).collect()) == list(range(40))


def test_damaged_headers_are_not_taken():
    # A header is under no digest: where its bytes change and the record still reads, only the member's checksum tells.
    rng = random.Random(1)
    for i in range(300):
        payload = " ".join(rng.choices(["a", "bb", "ccc"], k=rng.randrange(60))).encode()
        raw = warc.record(7 * i, f"http://example.com/{rng.randrange(10**9)}", payload, hashlib.sha1(payload).hexdigest(), rng.choice([None, 5]))
        data = bytearray(warc.member(raw))
        data[len(data) // 2] ^= 0xFF
        found = list(warc.salvage(bytes(data)))
        assert keys(found) == [] and [(f.offset, f.length) for f in found] == [(0, len(data))], i
    # Where another record of the member shows the damage, the rest stay.
    raws = archive(4, plain=True)
    bad = b"".join(raws).replace(b"<p>2</p>", b"<p>x</p>", 1)
    stream = zlib.compress(bad, 6, 31)[:-8] + zlib.compress(b"".join(raws), 6, 31)[-8:]
    assert keys(warc.salvage(stream)) == list("013")
