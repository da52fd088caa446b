"""Streams as the standard allows them, and broken ones."""

import random

import pytest

from tests.llm import brute
from verdigris.llm import transport_stream as ts

PAY = bytes(range(256)) * 700


def packets(data):
    return [data[i : i + ts.SIZE] for i in range(0, len(data), ts.SIZE)]


@pytest.mark.parametrize("n", [*range(0, 700), 32_767, 32_768, 32_769, len(PAY)])
def test_round_trip(n):
    data = ts.write_stream(PAY[:n])
    s = ts.read_stream(data)
    assert data == brute.transport_stream(PAY[:n])[0]
    assert s.payload == PAY[:n] and s.continuity_errors == s.damaged == s.duplicates == 0 and s.programs == {1: ts.PMT_PID}
    assert [(u.pts, u.pcr, u.random_access, u.whole) for u in s.units] == [((i + 1) * ts.TICKS, i * ts.TICKS, i % ts.GAP == 0, True) for i in range(-(-n // ts.UNIT))]


def test_long_stream_marks_access_points():
    s = ts.read_stream(ts.write_stream(bytes(ts.UNIT * 17 + 5)))
    assert [i for i, u in enumerate(s.units) if u.random_access] == [0, 8, 16] and s.units[-1].size == 5
    assert ts.feature(s).startswith("programs=1;streams=1;packets=") and ";pes=18;access=3;errors=0;last_pts=64800;" in ts.feature(s)


def test_duplicates_count_once():
    p = packets(ts.write_stream(PAY))
    for i in (0, 1, 2, 5, 190, len(p) - 1):
        s = ts.read_stream(b"".join([*p[: i + 1], *p[i:]]))
        assert s.payload == PAY and s.duplicates == 1 and s.continuity_errors == 0 and all(u.whole for u in s.units)
    three = ts.read_stream(b"".join([*p[:6], p[5], p[5], *p[6:]]))
    assert three.payload == PAY and three.duplicates == 2 and three.continuity_errors == 1


def test_a_repetition_may_tell_another_clock():
    p = packets(ts.write_stream(PAY))
    other = bytearray(p[2])
    other[9] ^= 1
    s = ts.read_stream(b"".join([*p[:3], bytes(other), *p[3:]]))
    assert s.payload == PAY and s.duplicates == 1 and s.continuity_errors == 0


def test_lost_and_damaged_packets():
    p = packets(ts.write_stream(PAY))
    lost = ts.read_stream(b"".join(p[:10] + p[11:]))
    assert lost.continuity_errors == 1 and len(lost.payload) == len(PAY) - 184 and [u.whole for u in lost.units] == [False] + [True] * 5
    bad = ts.read_stream(b"".join([*p[:10], b"x" + p[10][1:], *p[11:]]))
    assert bad.damaged == 1 and bad.payload == lost.payload
    assert ts.read_stream(b"").payload == b"" and ts.read_stream(b"G" * 100).damaged == 1


@pytest.mark.parametrize("junk", [1, 50, 187, 188, 400, 70_000])
def test_bytes_out_of_step_are_passed_over(junk):
    data, noise = ts.write_stream(PAY), bytes(random.Random(junk).choice(b"abcdef") for _ in range(junk))
    s = ts.read_stream(noise + data)
    assert s.payload == PAY and s.damaged >= 1
    cut = 188 * 40
    s = ts.read_stream(data[:cut] + noise + data[cut:])
    assert s.payload == PAY and s.continuity_errors == 0


def test_a_unit_without_a_time_stamp_has_a_null():
    p = packets(ts.write_stream(PAY))
    second = next(i for i in range(3, len(p)) if p[i][1] & 0x40)
    q = bytearray(p[second])
    at = q.index(b"\0\0\1\xbd") + 7
    q[at] = 0
    s = ts.read_stream(b"".join([*p[:second], bytes(q), *p[second + 1 :]]))
    assert [u.pts for u in s.units] == [3600, None, 10800, 14400, 18000, 21600] and s.payload == PAY


def test_tables_over_many_packets():
    pids = list(range(0x200, 0x200 + 150))
    maps = {n: 0x20 + n for n in range(1, 90)}
    streams = [(6, pid) for pid in pids]
    data = ts.table_packets(0, ts.program_association(maps)) + ts.table_packets(maps[7], ts.program_map(7, 0x200, streams))
    s = ts.read_stream(data)
    assert s.programs == maps and list(s.streams) == pids and s.damaged == 0
    # two sections in one packet, the second one going on in the next
    both = ts.table_packets(0, ts.program_association({1: 0x30}) + ts.program_association({n: n + 0x40 for n in range(2, 60)}))
    assert ts.read_stream(both).programs == {1: 0x30, **{n: n + 0x40 for n in range(2, 60)}}
    broken = bytearray(data)
    broken[60] ^= 1
    s = ts.read_stream(bytes(broken))
    assert s.programs == {} and s.damaged == 1


def test_two_streams():
    a, b = b"a" * 1000, b"b" * 900
    one, two = (packets(ts.write_stream(x))[2:] for x in (a, b))
    two = [bytes([x[0], x[1] | 0x02, x[2], *x[3:]]) for x in two]
    tables = ts.table_packets(0, ts.program_association({1: 0x30})) + ts.table_packets(0x30, ts.program_map(1, 0x100, [(6, 0x100), (6, 0x300)]))
    mixed = [x for pair in zip(one, two) for x in pair] + one[len(two) :] + two[len(one) :]
    s = ts.read_stream(tables + b"".join(mixed))
    assert s.payload == a + b and s.continuity_errors == 0 and s.streams == {0x100: 6, 0x300: 6}
