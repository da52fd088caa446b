"""Media columns: MPEG transport streams (ISO/IEC 13818-1), written and read with numpy.

A payload becomes one private data stream: a program association table, a program map table, then packetised elementary
streams' packets (PES) of at most UNIT bytes, each with a presentation time stamp, in transport packets of 188 bytes
with continuity counters.  The first packet of a PES carries the program's clock (PCR), every GAP units a random access
point too; the last one is stuffed by its adaptation field.  Reading parses the tables, whose sections may go on over
packets, follows the programs' packet ids, checks the continuity counters, reassembles the PES and stores for each its
time stamp, clock, size, random access point and whether it is whole.

A null or empty text is a payload of 64 zero bytes.  Broken streams are read as far as they go and errors are counted:
bytes out of step are passed over up to the next place where packets follow each other, and so are those before the
first packet of a PES; a packet that comes twice in a row, which the standard allows, counts once; a PES without a time
stamp has a null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

SIZE, SYNC = 188, 0x47
PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x1000, 0x0100, 0x06, 0xBD
#: Payload bytes of a PES, its distance on the 90 kHz clock, PES between random access points.
UNIT, TICKS, GAP = 32_768, 3600, 8
_POLY = 0x04C11DB7


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ _POLY if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def section(table: int, number: int, body: bytes) -> bytes:
    """A section of a table, with its checksum."""
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + bytes([0xC1, 0, 0])
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def table_packets(pid: int, sections: bytes, count: int = 0) -> bytes:
    """Packets that carry sections, which follow each other from the start of the first packet on."""
    rest, out = b"\0" + sections, []
    for i in range(0, len(rest), 184):
        out.append(bytes([SYNC, (0x40 if i == 0 else 0) | pid >> 8, pid & 0xFF, 0x10 | count + i // 184 & 15]) + rest[i : i + 184].ljust(184, b"\xff"))
    return b"".join(out)


def program_map(number: int, clock: int, streams: list[tuple[int, int]]) -> bytes:
    """streams: (type, packet id)."""
    body = (0xE000 | clock).to_bytes(2, "big") + b"\xf0\x00"
    return section(2, number, body + b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\x00" for kind, pid in streams))


def program_association(programs: dict[int, int]) -> bytes:
    return section(0, 1, b"".join(n.to_bytes(2, "big") + (0xE000 | pid).to_bytes(2, "big") for n, pid in programs.items()))


_TABLES = table_packets(0, program_association({1: PMT_PID})) + table_packets(PMT_PID, program_map(1, DATA_PID, [(STREAM_TYPE, DATA_PID)]))


def _time(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def write_stream(payload: bytes) -> bytes:
    parts = [_TABLES]
    count = 0
    for i, lo in enumerate(range(0, len(payload), UNIT)):
        unit = payload[lo : lo + UNIT]
        clock = i * TICKS & 0x1FFFFFFFF
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _time(clock + TICKS & 0x1FFFFFFFF) + unit
        # an adaptation field of eight bytes: its length, flags and the clock
        first = min(184 - 8, len(pes))
        n = 1 + -(-(len(pes) - first) // 184)
        out = np.full((n, SIZE), 0xFF, np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        out[0, 1] |= 0x40
        out[:, 3] = 0x10 | (count + np.arange(n)) & 15
        count += n
        out[0, 3] |= 0x20
        out[0, 4:6] = 183 - first, 0x10 | (0x40 if i % GAP == 0 else 0)
        out[0, 6:12] = np.frombuffer((clock << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        body = np.frombuffer(pes, np.uint8)
        out[0, SIZE - first :] = body[:first]
        if n > 1:
            out[1 : n - 1, 4:] = body[first : first + (n - 2) * 184].reshape(n - 2, 184)
            tail = body[first + (n - 2) * 184 :]
            room = 184 - len(tail)
            if room:
                out[-1, 3] |= 0x20
                out[-1, 4] = room - 1
                out[-1, 5 : 5 + (room > 1)] = 0
            out[-1, SIZE - len(tail) :] = tail
        parts.append(out.tobytes())
    return b"".join(parts)


@dataclass
class Unit:
    """A PES: time stamp and clock (null where it has none), bytes read, random access point, whether it is whole."""

    pts: int | None
    pcr: int | None
    size: int
    random_access: bool
    whole: bool


@dataclass
class Stream:
    """What reading found: payload of all PES, stream by stream in the order of the tables, and each PES."""

    payload: bytes = b""
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[Unit] = field(default_factory=list)
    packets: int = 0
    continuity_errors: int = 0
    duplicates: int = 0
    damaged: int = 0


#: Stream ids whose PES have no further header; padding has no payload at all.
_BARE, _PADDING = (0xBC, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF), 0xBE
#: Bytes that are looked through at once for the next packet.
_LOOK = 1 << 16


def _next_packet(a: np.ndarray, lo: int) -> int:
    """The first place from lo on where a packet begins and the next one follows it, or the end comes; else the end."""
    while lo + SIZE <= len(a):
        at = np.flatnonzero(a[lo : min(lo + _LOOK, len(a) - SIZE + 1)] == SYNC) + lo
        follows = at + SIZE
        good = at[(follows >= len(a)) | (a[np.minimum(follows, len(a) - 1)] == SYNC)]
        if len(good):
            return int(good[0])
        lo += _LOOK
    return len(a)


def _packets(data: bytes, s: Stream) -> np.ndarray:
    """Whole packets as rows.  A single one without its sync byte is passed over; after two, the next place counts."""
    a = np.frombuffer(data, np.uint8)
    found, at = [np.empty((0, SIZE), np.uint8)], 0
    while at < len(a):
        n = (len(a) - at) // SIZE
        p = a[at : at + n * SIZE].reshape(n, SIZE)
        good = p[:, 0] == SYNC
        lost = np.flatnonzero(~good & ~np.r_[good[1:], False][:n])
        k = int(lost[0]) if len(lost) else n
        s.damaged += int((~good[:k]).sum())
        found.append(p[:k][good[:k]])
        at += k * SIZE
        if at < len(a):
            s.damaged += 1
            at = _next_packet(a, at + 1)
    return np.concatenate(found)


def _sections(bodies: list[bytes], begins: list[bool]) -> Iterator[bytes]:
    """Sections that the packets of one packet id carry, one after another and over packets."""
    held: bytes | None = None
    for body, begin in zip(bodies, begins, strict=True):
        if begin:
            start = 1 + body[0] if body else 1
            if held is not None:
                yield from _whole(held + body[1:start])[0]
            held = body[start:]
        elif held is not None:
            held += body
        if held is not None:
            done, held = _whole(held)
            yield from done


def _whole(held: bytes) -> tuple[list[bytes], bytes | None]:
    """(whole sections at the start, what is left of another one; null after stuffing)."""
    out = []
    while len(held) >= 3 and held[0] != 0xFF:
        size = 3 + (int.from_bytes(held[1:3], "big") & 0x0FFF)
        if len(held) < size:
            return out, held
        out.append(held[:size])
        held = held[size:]
    return out, (None if held[:1] == b"\xff" else held)


class _Flow:
    """The packets of one packet id that carry payload, without repetitions."""

    def __init__(self, q: np.ndarray, s: Stream):
        q = q[(q[:, 3] & 0x10) > 0]
        extra = np.where(q[:, 3] & 0x20, q[:, 4].astype(np.int64) + 1, 0)
        used = np.arange(SIZE)[None, :] >= (4 + extra)[:, None]
        flags = np.where((q[:, 3] & 0x20 > 0) & (q[:, 4] > 0), q[:, 5], 0)
        step = np.diff(q[:, 3].astype(np.int64)) & 15
        n = len(q)
        again = np.r_[False, (step == 0) & (((q[1:] == q[:-1]) | ~used[1:]).all(1)) & (used[1:] == used[:-1]).all(1)][:n]
        # one repetition is allowed; a jump is, where it is announced
        wrong = np.r_[False, (step != 1) & (flags[1:] & 0x80 == 0)][:n] & ~(again & ~np.r_[False, again[:-1]][:n])
        s.duplicates += int(again.sum())
        s.continuity_errors += int(wrong.sum())
        keep = ~again
        self.rows, self.used, self.flags = q[keep], used[keep], flags[keep]
        self.begins = (self.rows[:, 1] & 0x40) > 0
        # whether a packet is missing before this one
        self.gap = wrong[keep]
        self.size = self.used.sum(1)
        self.body = self.rows[self.used]
        self.at = np.r_[0, np.cumsum(self.size)]

    def tables(self) -> Iterator[bytes]:
        bodies = [self.body[a:b].tobytes() for a, b in zip(self.at[:-1], self.at[1:], strict=True)]
        return _sections(bodies, self.begins.tolist())

    def clock(self, i: int) -> int | None:
        if not self.flags[i] & 0x10:
            return None
        return int.from_bytes(self.rows[i, 6:12].tobytes(), "big") >> 15


def _good_tables(p: np.ndarray, pid: np.ndarray, which: int, s: Stream) -> Iterator[bytes]:
    mine = p[pid == which]
    if len(mine):
        for x in _Flow(mine, s).tables():
            if len(x) >= 12 and crc32_mpeg(x) == 0:
                yield x
            else:
                s.damaged += 1


def read_stream(data: bytes) -> Stream:
    s = Stream()
    p = _packets(data, s)
    s.packets = len(p)
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    for x in _good_tables(p, pid, 0, s):
        for at in range(8, len(x) - 7, 4):
            if x[0] == 0 and (number := int.from_bytes(x[at : at + 2], "big")):
                s.programs[number] = int.from_bytes(x[at + 2 : at + 4], "big") & 0x1FFF
    for which in dict.fromkeys(s.programs.values()):
        for x in _good_tables(p, pid, which, s):
            at = 12 + (int.from_bytes(x[10:12], "big") & 0x0FFF)
            while x[0] == 2 and at + 5 <= len(x) - 4:
                s.streams[int.from_bytes(x[at + 1 : at + 3], "big") & 0x1FFF] = x[at]
                at += 5 + (int.from_bytes(x[at + 3 : at + 5], "big") & 0x0FFF)
    payload = []
    for stream in s.streams:
        flow = _Flow(p[pid == stream], s)
        begin = np.flatnonzero(flow.begins)
        for i, j in zip(begin.tolist(), np.r_[begin[1:], len(flow.rows)].tolist()):
            pes = flow.body[flow.at[i] : flow.at[j]]
            bare = len(pes) > 3 and pes[3] in _BARE
            if len(pes) < (6 if bare else 9) or pes[0] or pes[1] or pes[2] != 1:
                s.damaged += 1
                continue
            if pes[3] == _PADDING:
                continue
            head = 6 if bare else 9 + int(pes[8])
            size = int(pes[4]) << 8 | int(pes[5])
            unit = pes[head : 6 + size] if size else pes[head:]
            pts = None
            if not bare and pes[7] & 0x80 and len(pes) >= 14:
                t = [int(x) for x in pes[9:14]]
                pts = (t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1
            whole = not flow.gap[i + 1 : j].any() and len(pes) >= (6 + size if size else head)
            s.units.append(Unit(pts, flow.clock(i), len(unit), bool(flow.flags[i] & 0x40), bool(whole)))
            payload.append(unit.tobytes())
    s.payload = b"".join(payload)
    return s


def text_payload(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, these with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature(s: Stream) -> str:
    """Counts of programs, streams, packets, PES, random access points and errors, last time stamp, payload bytes."""
    access, last = sum(u.random_access for u in s.units), max((u.pts for u in s.units if u.pts is not None), default=0)
    return f"programs={len(s.programs)};streams={len(s.streams)};packets={s.packets};pes={len(s.units)};access={access};errors={s.continuity_errors + s.damaged};last_pts={last};bytes={len(s.payload)}"
