"""Capture files cut into splits, against one pass over each file."""

import io
import random
import struct
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from millrace.sources import pcap


def frame(r: random.Random, payload: bytes) -> bytes:
    ip = bytes.fromhex("45000000000000004011ffff") + bytes([10, 1, r.randrange(4), 7, 10, 2, 0, r.randrange(1, 9)])
    return bytes(12) + b"\x08\x00" + ip + struct.pack(">HHHH", r.randrange(1024, 60000), 53, 8 + len(payload), 0) + payload


def classic(r: random.Random, n: int, order: str = "<", unit: int = 1, inner: bytes = b"") -> bytes:
    """n packets, among them some of 3,000 bytes, whole captures as payload, and frames that hold no IP."""
    magic = {1: 0xA1B2C3D4, 1000: 0xA1B23C4D}[unit]
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i in range(n):
        kind = r.random()
        payload = inner[24:] if inner and kind < 0.05 else bytes(3000) if kind < 0.15 else r.randbytes(r.randrange(60))
        f = r.randbytes(9) if kind > 0.95 else frame(r, payload)
        out += struct.pack(order + "IIII", 1_700_000_000 + i, r.randrange(1_000_000) * unit, len(f), len(f) + 4) + f
    return out


def block(order: str, kind: int, body: bytes) -> bytes:
    body += bytes(-len(body) % 4)
    return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)


def sections(r: random.Random, n: int) -> bytes:
    """Three sections of either byte order, each with an interface at its head and one of other units in its midst."""
    out = b""
    for order in "<><":
        face = lambda unit, order=order: block(order, 1, struct.pack(order + "HHIHHB3xHH", 1, 0, 0, 9, 1, unit, 0, 0))
        out += block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + face(6)
        for i in range(n):
            out += face(3) if i == n // 2 else b""
            f, which = frame(r, r.randbytes(r.randrange(90))), int(i >= n // 2 and i % 3 == 0)
            out += block(order, 6, struct.pack(order + "IIIII", which, 0, 1000 * i, len(f), len(f)) + f)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    r, where = random.Random(12), tmp_path_factory.mktemp("captures")
    small = classic(r, 9)
    made = {"little": classic(r, 400, inner=small), "big": classic(r, 300, ">", 1000, inner=small), "cut": classic(r, 200)[:-5], "bare": classic(r, 0), "ng": sections(r, 120)}
    broken = bytearray(classic(r, 200))
    broken[24 + 8 : 24 + 12] = struct.pack("<I", 30)  # the second header stands within the first frame
    at = 24
    for _ in range(60):
        at += 16 + struct.unpack_from("<I", made["cut"], at + 8)[0]
    stop = bytearray(made["cut"])
    stop[at + 8 : at + 12] = b"\xff\xff\xff\x7f"  # a record longer than the file, in its midst
    for name, data in (made | {"broken": bytes(broken), "stop": bytes(stop)}).items():
        (where / f"{name}.pcap").write_bytes(data)
    return where


def one_pass(path: Path) -> list[tuple]:
    data = path.read_bytes()
    return list(pcap.packet_rows(path.stem, io.BytesIO(data), len(data)))


@pytest.mark.parametrize("size", [4_000, 1 << 20])
def test_splits_equal_one_pass(spark, folder, size):
    want = sorted(x for p in folder.iterdir() for x in one_pass(p))
    assert {x[0] for x in want} >= {"little", "big", "cut", "ng", "stop"} and sum(x[0] == "stop" for x in want) < 100
    got = pcap.read_captures(spark, str(folder), size)
    assert sorted((*r[:-1], bytes(r[-1])) for r in got.collect()) == want
    dropped = {Path(r.path).stem: r.dropped for r in pcap.tails(spark, str(folder), size).collect()}
    assert dropped == {p.stem: pcap.ranges(str(p), size)[1] for p in folder.iterdir()} and dropped["cut"] == dropped["stop"] == 1 and dropped["little"] == 0


def test_most_guesses_hold(folder):
    """Starts are guessed right for nearly all splits, so few are followed twice."""
    for name in ("little", "big", "ng"):
        data = (folder / f"{name}.pcap").read_bytes()
        f, size = io.BytesIO(data), len(data)
        starts = [x[0] for x in pcap.scan(f, size, content=False)]
        right = total = 0
        for lo in range(6000, size, 6000):
            true = next((s for s in starts if lo <= s < lo + 6000), None)
            if true is not None:
                total, right = total + 1, right + (pcap.scan_split(f, size, lo, lo + 6000)["start"] == true)
        assert total > 3 and right >= 0.7 * total


def test_files_of_another_store(spark, folder):
    """Files are opened through the function given, as those of any store are."""
    store = fs.SubTreeFileSystem(str(folder), fs.LocalFileSystem())

    def opened(uri):
        f = store.open_input_file(uri.rsplit("/", 1)[-1])
        return io.BufferedReader(f, 4096), f.size()

    got = pcap.read_captures(spark, str(folder / "ng.pcap"), 2_000, opened)
    assert got.count() == len(one_pass(folder / "ng.pcap")) == 360 and got.agg(F.max("frame_no")).first()[0] == 359
    prints = pcap.fingerprints(spark, str(folder), 100, opened)
    assert prints.select("fingerprint").distinct().count() == 7


def test_a_file_that_is_no_capture(spark, tmp_path):
    (tmp_path / "x.pcap").write_bytes(b"no capture at all" * 9)
    with pytest.raises(Exception, match="no packet capture"):
        pcap.read_captures(spark, str(tmp_path), 50).count()
