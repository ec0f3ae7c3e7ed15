import random

import pytest

from trunkline.schema import MAX_TRUNK_RECORDS
from trunkline.sources import codec as C
from trunkline.sources.trunklog import scan_bytes

RECORDS = [(10_000, 2, "alpha"), (10_030, 3, "beta\nsecond line"), (10_050, 4, "ünï😀")]


@pytest.mark.parametrize("name", C.CODECS)
def test_round_trip(name):
    assert scan_bytes(C.encode_file(RECORDS, name)) == RECORDS


def test_random_round_trips():
    rng = random.Random(3)
    for _ in range(20):
        t, rows = 0, []
        for _ in range(rng.randrange(60)):
            t += rng.randrange(50)
            rows.append((t, rng.randrange(5), "x" * rng.randrange(900)))
        assert scan_bytes(C.encode_file(rows, rng.choice(C.CODECS), rng.randrange(1, 9))) == rows


def test_trunks_split_by_size_and_count():
    data = C.encode_file([(1_777_672_860_253 + i, 2, "m" * 700) for i in range(3)], "gzip", 1)
    head = C.read_header(data)
    assert (head["trunks"], head["records"], head["version"], head["base"]) == (3, 3, "0.1.0", 1_777_672_860_253)
    counts = [n for n, _ in C.pack_trunks((C.encode_line(0, 0, b"") for _ in range(MAX_TRUNK_RECORDS + 1)), 65_535)]
    assert counts == [MAX_TRUNK_RECORDS, 1]


def test_errors():
    with pytest.raises(ValueError, match="truncated"):
        C.read_header(b"\0\1\2")
    with pytest.raises(ValueError, match="back in time"):
        C.encode_file([(5, 0, "a"), (4, 0, "b")])
    with pytest.raises(ValueError, match="out of range"):
        C.encode_file([(0, 0, "a"), (1 << 32, 0, "b")])
    with pytest.raises(ValueError, match="level"):
        list(C.decode_lines(C.LINE.pack(0, 9, 0)))
    with pytest.raises(ValueError, match="trailing"):
        list(C.decode_lines(C.encode_line(0, 1, b"x") + b"zz", 1))


def test_zlib_wrapped_deflate_is_read():
    import zlib

    assert C.decompress(zlib.compress(b"abc" * 50), "deflate") == b"abc" * 50
