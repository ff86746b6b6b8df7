"""Archives are inflated in bounded steps."""

import gzip
import io
import random

from colprov.llm import warc


def test_well_packed_archive_is_held_in_chunks():
    big = b"a" * 50_000_000
    source = warc.Inflated(io.BytesIO(gzip.compress(b"head\r\n\r\n" + big)))
    assert source.until(b"\r\n\r\n") == b"head"
    got, most = 0, 0
    while got < len(big):
        got += len(source.some(1000))
        most = max(most, len(source.held))
    assert got == len(big) and most <= 2 * warc.CHUNK and source.until(b"x") is None


def test_members_of_any_size_come_back():
    rng = random.Random(1)
    sizes = [0, 1, warc.CHUNK - 1, warc.CHUNK, warc.CHUNK + 1, 300_000, 0, 5]
    parts = [rng.choice((rng.randbytes(n), b"z" * n)) for n in sizes]
    for level in (0, 1, 9):
        source = warc.Inflated(io.BytesIO(b"".join(gzip.compress(p, level) for p in parts)))
        out = b""
        while sum(map(len, parts)) > len(out):
            out += source.some(70_000)
        assert out == b"".join(parts) and not source.more()
