"""MPEG transport streams in binary columns: tables, continuity, elementary packets, timestamps and random-access points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SIZE, SYNC = 188, 0x47
#: Bytes in one elementary packet, and the distance of two in ticks of the 90 kHz clock, as ``mux`` writes them.
UNIT, TICKS = 2048, 3600
_STREAMS = ((0x101, 0x1B, 0xE0), (0x102, 0x0F, 0xC0))  # pid, stream type, stream id
_PMT_PID = 0x1000
_COLUMNS = [("program", T.IntegerType()), ("pid", T.IntegerType()), ("stream_type", T.IntegerType()), ("seq", T.IntegerType()), ("pts", T.LongType()), ("dts", T.LongType()), ("random_access", T.BooleanType())]
_COLUMNS += [("discontinuities", T.IntegerType()), ("complete", T.BooleanType()), ("n_bytes", T.LongType()), ("data", T.BinaryType())]

_CRC = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = ((_c << 1) ^ 0x04C11DB7 if _c & 0x80000000 else _c << 1) & 0xFFFFFFFF
    _CRC.append(_c)


def crc32(data: bytes) -> int:
    c = 0xFFFFFFFF
    for x in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ x]
    return c


def _section(table: int, ident: int, body: bytes) -> bytes:
    head = bytes([table, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, ident >> 8, ident & 255, 0xC1, 0, 0]) + body
    return head + crc32(head).to_bytes(4, "big")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 30 & 7) << 1 | 1, t >> 22 & 255, (t >> 15 & 127) << 1 | 1, t >> 7 & 255, (t & 127) << 1 | 1])


def _packets(pid: int, payload: bytes, counter: int, random_access: bool = False) -> list[bytes]:
    """The transport packets of one unit, the last of them stuffed to full size."""
    out, at, first = [], 0, True
    while at < len(payload) or first:
        flagged = first and random_access
        room = 182 if flagged else 184
        part = payload[at : at + room]
        short = room - len(part)
        if flagged:
            field = b"\x40" + b"\xff" * short
            adaptation = bytes([len(field)]) + field
        elif short:
            adaptation = bytes([short - 1]) + (b"\x00" + b"\xff" * (short - 2) if short > 1 else b"")
        else:
            adaptation = b""
        head = bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 255, (0x30 if adaptation else 0x10) | (counter + len(out)) & 15])
        out.append(head + adaptation + part)
        at, first = at + len(part), False
    return out


@lru_cache(maxsize=1)
def _tables() -> bytes:
    pat = _section(0, 1, bytes([0, 1, 0xE0 | _PMT_PID >> 8, _PMT_PID & 255]))
    streams = b"".join(bytes([kind, 0xE0 | pid >> 8, pid & 255, 0xF0, 0]) for pid, kind, _ in _STREAMS)
    pmt = _section(2, 1, bytes([0xE0 | _STREAMS[0][0] >> 8, _STREAMS[0][0] & 255, 0xF0, 0]) + streams)
    return b"".join(_packets(0, b"\x00" + pat, 0) + _packets(_PMT_PID, b"\x00" + pmt, 0))


def mux(content: bytes, unit: int = UNIT) -> bytes:
    """A transport stream of ``content``: units in turn on two elementary streams, every fourth of a stream a random-access point."""
    out, counters = [_tables()], [0, 0]
    for n in range(0, -(-len(content) // unit)):
        which = n & 1
        pid, _, stream = _STREAMS[which]
        pts, part = (90000 + n * TICKS) & (1 << 33) - 1, content[n * unit : (n + 1) * unit]
        stamps = _stamp(3, pts) + _stamp(1, pts - 1800) if which == 0 else _stamp(2, pts)
        head = bytes([0x80, 0xC0 if which == 0 else 0x80, len(stamps)]) + stamps
        length = len(head) + len(part)
        pes = b"\x00\x00\x01" + bytes([stream]) + (length if length < 65536 else 0).to_bytes(2, "big") + head + part
        packets = _packets(pid, pes, counters[which], n // 2 % 4 == 0)
        counters[which] += len(packets)
        out += packets
    return b"".join(out)


def _aligned(data: np.ndarray) -> np.ndarray:
    """Rows of SIZE bytes that begin with the sync byte; bytes between packets are skipped, a cut-off last packet too."""
    n = len(data) // SIZE
    rows = data[: n * SIZE].reshape(-1, SIZE)
    if len(data) == n * SIZE and (rows[:, 0] == SYNC).all():
        return rows
    starts, at, end = [], 0, len(data) - SIZE
    syncs = np.flatnonzero(data == SYNC)
    while at <= end:
        i = int(np.searchsorted(syncs, at))
        if i == len(syncs):
            break
        at = int(syncs[i])
        if at <= end and (at + SIZE == len(data) or data[min(at + SIZE, len(data) - 1)] == SYNC or at + 2 * SIZE > len(data)):
            starts.append(at)
            at += SIZE
        else:
            at += 1
    return data[np.array(starts, np.int64)[:, None] + np.arange(SIZE)] if starts else rows[:0]


@lru_cache(maxsize=4096)
def _parsed(section: bytes) -> tuple:
    """('pat', ((program, pid), ...)) or ('pmt', program, ((pid, stream type), ...)); () if it is neither, damaged, or not in force yet."""
    if len(section) < 12 or crc32(section) or not section[5] & 1:
        return ()
    if section[0] == 0:
        body = section[8:-4]
        return ("pat", tuple((body[i] << 8 | body[i + 1], (body[i + 2] & 31) << 8 | body[i + 3]) for i in range(0, len(body) - 3, 4) if body[i] << 8 | body[i + 1]))
    if section[0] == 2:
        at, streams = 12 + ((section[10] & 15) << 8 | section[11]), []
        while at + 5 <= len(section) - 4:
            streams.append(((section[at + 1] & 31) << 8 | section[at + 2], section[at]))
            at += 5 + ((section[at + 3] & 15) << 8 | section[at + 4])
        return ("pmt", section[3] << 8 | section[4], tuple(streams))
    return ()


def _sections(rows: np.ndarray, begins: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The table sections of one pid, assembled over packets."""
    out, buffer = [], None
    for row, start, unit in zip(rows, begins.tolist(), starts.tolist()):
        part = row[start:].tobytes()
        if unit and part:
            before, part = part[1 : 1 + part[0]], part[1 + part[0] :]
            if buffer is not None:
                out.append(buffer + before)
            buffer = part
        elif buffer is not None:
            buffer += part
        while buffer is not None and len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + ((buffer[1] & 15) << 8 | buffer[2])
            if len(buffer) < size:
                break
            out.append(buffer[:size])
            buffer = buffer[size:]
    if buffer:
        out.append(buffer)
    return out


def _time(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def demux(blob: bytes | memoryview) -> list[tuple]:
    """(program, pid, stream type, seq, pts, dts, random access, discontinuities, complete, payload) of each elementary packet."""
    rows = _aligned(np.frombuffer(blob, np.uint8))
    if not len(rows):
        return []
    rows = rows[(rows[:, 1] & 0x80) == 0]  # packets that the sender marks as damaged
    pid = (rows[:, 1] & 31).astype(np.int32) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    begins = np.where(control & 2, 5 + rows[:, 4].astype(np.int32), 4)
    ok = (control & 1 == 1) & (begins <= SIZE)
    flags = np.where((control & 2 == 2) & (rows[:, 4] > 0), rows[:, 5], 0)
    unit = (rows[:, 1] & 0x40) != 0

    def tables(p: int) -> list[tuple]:
        at = np.flatnonzero((pid == p) & ok)
        return [x for s in _sections(rows[at], begins[at], unit[at]) if (x := _parsed(s))]

    programs = {x for kind, *rest in tables(0) if kind == "pat" for x in rest[0]}
    streams = sorted({(program, es, kind) for number, p in programs for t, *rest in tables(p) if t == "pmt" and rest[0] == number for program in (rest[0],) for es, kind in rest[1]})
    out = []
    for program, p, kind in streams:
        at = np.flatnonzero((pid == p) & ok)
        if not len(at):
            continue
        mine, counter = rows[at], rows[at, 3] & 15
        step = np.r_[1, (counter[1:].astype(np.int8) - counter[:-1]) & 15]
        again = step == 0
        again[1:] &= (mine[1:, 4:] == mine[:-1, 4:]).all(1)  # a packet may be sent twice
        broken = (step != 1) & ~again & (flags[at] & 0x80 == 0)
        keep = ~again
        at, mine, broken = at[keep], mine[keep], broken[keep]
        first = begins[at]
        payload = mine[np.arange(SIZE) >= first[:, None]].tobytes()
        ends = np.cumsum(SIZE - first)
        heads = np.flatnonzero(unit[at])
        bounds = np.r_[heads, len(at)]
        offset = np.r_[0, ends]
        gaps = np.r_[0, np.cumsum(broken)]
        for seq, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            pes = payload[offset[a] : offset[b]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < 9:
                continue
            size, mark, skip = pes[4] << 8 | pes[5], pes[7] >> 6, 9 + pes[8]
            pts = _time(pes[9:14]) if mark & 2 and len(pes) >= 14 and pes[8] >= 5 else None
            dts = _time(pes[14:19]) if mark == 3 and len(pes) >= 19 and pes[8] >= 10 else pts
            data = pes[skip : 6 + size] if size else pes[skip:]
            lost = int(gaps[b] - gaps[a + 1]) + int(broken[a])
            inner = int(gaps[b] - gaps[a + 1])
            out.append((program, p, kind, seq, pts, dts, bool(flags[at[a]] & 0x40), lost, inner == 0 and (not size or len(pes) >= 6 + size), data))
    return out


def _demux_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size = [], 0
        for doc, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            for *x, data in demux(memoryview(blob.as_buffer())):
                held.append((doc, *x, len(data), data))
                size += len(data)
            if size > 8 << 20:
                yield _batch(held, batch.column(0).type)
                held, size = [], 0
        if held:
            yield _batch(held, batch.column(0).type)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *(to_arrow_type(k) for _, k in _COLUMNS)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", *(n for n, _ in _COLUMNS)])


def elementary_packets(media: DataFrame) -> DataFrame:
    """A row for each elementary packet of (doc_id, media): program, pid, stream_type, seq, pts, dts, random_access, data and its state.

    Program tables say which pids are streams; a table whose checksum is wrong or that isn't in force yet is ignored, and of tables that
    follow each other in several versions all count. Of two equal packets in a row with one
    counter the second is dropped; any other jump of the counter counts in ``discontinuities`` of the packet that it falls in or
    before, unless the stream announces it. ``complete`` is false if data are missing inside. dts is pts where none is sent; both are null
    without a stamp. Bytes that aren't packets are skipped. Null and empty columns, and streams without tables, give no row. Rows
    that share a doc_id, null ids too, are columns of their own. doc_id keeps its type; other columns are not read, whatever their names.
    Blobs are read whole. An empty table gives an empty result.
    """
    schema = T.StructType([T.StructField("doc_id", media.schema["doc_id"].dataType), *(T.StructField(*c) for c in _COLUMNS)])
    return media.where("media is not null").select("doc_id", "media").mapInArrow(_demux_batches, schema)


def _mux_batches(lose: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            blobs = []
            for text in batch.column(1):
                blob = mux(bytes(text.as_buffer()))
                n = len(blob) // SIZE
                blobs.append(blob[: (n - 2) * SIZE] + blob[(n - 1) * SIZE :] if lose and n % lose == 0 and n > 4 else blob)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.large_binary())], ["doc_id", "media"])

    return batches


def media_table(docs: DataFrame, lose: int = 0) -> DataFrame:
    """(doc_id, media): the bytes of each text as a transport stream. ``lose``: streams whose number of packets it divides lack the last but one, as after a bad transmission; 0 for none."""
    rows = docs.where("text is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_mux_batches(lose), T.StructType([rows.schema["doc_id"], T.StructField("media", T.BinaryType())]))
