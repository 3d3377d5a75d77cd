import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftframe import errors
from driftframe.sources import wire

BODY = bytes.fromhex("a4bbf45c94032ff635244838ff4824d7902021e323c154032011433e91620ff85d11a7019088c1952af6801f89060c")
LOG = wire.make_header() + BODY


def test_golden_frames():
    got = [(f.decoded_offset, f.compressed_byte_offset, f.header, f.record_class, f.timestamp_us, f.dlc, f.payload_delta.hex(), f.payload.hex()) for f in wire.Reader(LOG).frames()]
    assert got == [
        (0, 80, 0x6004F9BF, 3, 955890, 0, "", ""),
        (10, 88, 0xE1101001, 7, 1, 1, "78", "78"),
        (21, 95, 0xE2101001, 7, 1, 1, "56", "56"),
        (32, 102, 0xE0108001, 7, 937511, 8, "000000000000f03f", "000000000000f03f"),
        (50, 114, 0xE0108001, 7, 968018, 8, "0000000000001001", "0000000000000040"),
    ]


def test_every_cut_fails_strictly_and_is_repaired():
    for n in range(len(BODY)):
        cut = LOG[: 80 + n]
        with pytest.raises((errors.MissingEndMarker, errors.TruncatedRecord)):
            list(wire.Reader(cut, "strict").frames())
        reader = wire.Reader(cut, "lenient")
        frames = list(reader.frames())
        assert reader.tail is not None and reader.tail.missing_end_marker
        fixed = wire.repair_tail(cut)
        assert fixed.changed and len(list(wire.Reader(fixed.data).frames())) == len(frames) == fixed.frames
    assert wire.repair_tail(LOG) == (LOG, False, 5, 0)


def test_header_gates():
    for n in range(80):
        with pytest.raises(errors.TruncatedHeader):
            wire.parse_header(bytes(n))
    h = bytearray(LOG)
    h[70] = 18
    with pytest.raises(errors.UnsupportedCompliancy):
        wire.Reader(bytes(h))
    h[70], h[71] = 19, 2
    with pytest.raises(errors.UnsupportedFormatFlags):
        wire.Reader(bytes(h))


def test_code_round_trip():
    book = wire.codebook()
    data = bytes(range(256)) * 2
    d = wire.Decoder(book.encode(data), book)
    assert not d.fill(1 << 20) and bytes(d.out) == data and d.ended
    for i in (0, 1, 100, 511):  # code words stand one after the other
        assert d.bit_of(i) == sum(len(book.words[x]) for x in data[:i])


def test_size_limit():
    book = wire.codebook()
    raw = wire.make_header() + book.encode(bytes(1000))
    assert wire.decode_body(raw, 1000) == bytes(1000)
    with pytest.raises(errors.DecodedSizeLimit):
        wire.decode_body(raw, 999)


def test_long_logs_are_read_in_pieces(monkeypatch):
    rng, out = random.Random(1), b""
    for i in range(3000):
        n = rng.choice(wire.DLC_LENGTHS[:9])
        out += (0x100 + i % 7).to_bytes(4, "little") + i.to_bytes(5, "little") + bytes([wire.DLC_LENGTHS.index(n) << 4]) + rng.randbytes(n)
    raw = wire.make_header() + wire.codebook().encode(out)
    whole = list(wire.Reader(raw).frames())
    monkeypatch.setattr(wire, "PIECE", 50)
    assert list(wire.Reader(raw).frames()) == whole and len(whole) == 3000 and whole[-1].timestamp_us == 3000
    assert [f.compressed_byte_offset for f in whole] == sorted(f.compressed_byte_offset for f in whole)


def test_end_marker_inside_a_record():
    raw = wire.make_header() + wire.codebook().encode(bytes(15))
    with pytest.raises(errors.TruncatedRecord):
        list(wire.Reader(raw).frames())
    reader = wire.Reader(raw, "lenient")
    assert len(list(reader.frames())) == 1 and reader.tail[:4] == (10, 5, 10, False)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.sampled_from(["strict", "lenient"]))
def test_any_body_is_read_or_refused(body, tail):
    try:
        list(wire.Reader(wire.make_header() + body, tail).frames())
    except errors.TelemetryError:
        pass


def test_values():
    assert wire.decode_value(0x28, b"\x05\0\0\0alpha\0\0\0\0\x05\0\0\0omega") == ("string_array", ["alpha", "", "omega"])
    for code, raw in ((0x1C, bytes(9)), (0x04, b""), (0x14, b"\xff"), (0x28, b"\x05\0\0\0a")):
        with pytest.raises(errors.InvalidCustomPayload):
            wire.decode_value(code, raw)
    with pytest.raises(errors.UnsupportedCustomType):
        wire.decode_value(0x2C, b"")
    assert wire.parse_id(" 0x1F ") == 31 and wire.parse_id("12") == 12
    with pytest.raises(errors.InvalidArgument):
        wire.parse_id("0x1ffffffff")
