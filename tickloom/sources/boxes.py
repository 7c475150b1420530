"""Media containers as bytes: box walk, sample tables and fragments, read and written.

A box is a 32-bit length, a four-character name and its payload; length 1 means that 64 bits of
length follow the name, length 0 that the box reaches to the end.  All lengths are checked before
anything is read.  The readers are numpy over one file's metadata (never its media), and run in
``mapInArrow``, a file a row; BoxError is raised for bytes that break a rule.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# fixed values: boxes that hold boxes
CONTAINERS = ("moov", "trak", "mdia", "minf", "stbl", "mvex", "moof", "traf", "edts", "dinf")
# fixed values: which optional fields a track fragment header and a run have
BASE_OFFSET, DESCRIPTION, DEFAULT_DURATION, DEFAULT_SIZE, DEFAULT_FLAGS, BASE_IS_MOOF = 0x1, 0x2, 0x8, 0x10, 0x20, 0x20000
DATA_OFFSET, FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_COMPOSITION = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
# fixed values: sample flags of one that depends on no other, and of one that does
SYNC_FLAGS, NON_SYNC_FLAGS, NON_SYNC = 0x02000000, 0x01010000, 0x00010000

MAX_DEPTH, MAX_SAMPLES = 16, 50_000_000


class BoxError(ValueError):
    """Bytes that break the container's rules."""


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[str, int, int, int]]:
    """(name, offset, payload offset, end) of the boxes side by side in data[start:end]."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise BoxError(f"{end - start} bytes are left where a box should start")
        size, name = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise BoxError("a 64-bit length is cut")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or size > end - start:
            raise BoxError(f"the box at {start} has length {size} of {end - start}")
        yield "".join(chr(c) if 32 <= c < 127 else "?" for c in name), start, start + head, start + size
        start += size


def walk(data: bytes, start: int = 0, end: int | None = None, path: str = "", depth: int = 0) -> Iterator[tuple[str, int, int, int]]:
    """(path, offset, payload offset, end) of every box, parents first."""
    if depth > MAX_DEPTH:
        raise BoxError("boxes are nested too deep")
    for name, at, body, stop in boxes(data, start, end):
        own = f"{path}/{name}" if path else name
        yield own, at, body, stop
        if name in CONTAINERS:
            yield from walk(data, body, stop, own, depth + 1)


def keep_header(data: bytes) -> tuple[bytes, list[tuple[int, bytes]]]:
    """The movie box and (offset, bytes) of each fragment box; media is skipped.  A cut tail drops the fragment it cuts."""
    moov, moofs, at = b"", [], 0
    while at < len(data):
        try:
            name, _, _, stop = next(boxes(data, at))
        except BoxError:
            # a fragment whose media is cut goes as well
            if moofs and at == moofs[-1][0] + len(moofs[-1][1]):
                moofs.pop()
            break
        if name == "moov":
            moov = data[at:stop]
        elif name == "moof":
            moofs.append((at, data[at:stop]))
        at = stop
    return moov, moofs


def _entries(data: bytes, at: int, end: int, dtype: str, width: int, head: int = 4) -> np.ndarray:
    """The table after a full box's version, flags and entry count."""
    if end - at < head + 4:
        raise BoxError("a table has no count")
    n = struct.unpack_from(">I", data, at + head)[0]
    one = np.dtype(dtype)
    if n * width * one.itemsize > end - at - head - 4:
        raise BoxError(f"{n} entries don't fit into the table")
    return np.frombuffer(data, one, n * width, at + head + 4).astype(np.int64).reshape(n, width)


def sample_tables(data: bytes, start: int = 0, end: int | None = None) -> dict[str, np.ndarray | None]:
    """The tables in the payload of one stbl box; stco is taken before co64, stsz before stz2."""
    found: dict[str, tuple[int, int]] = {}
    for name, _, body, stop in boxes(data, start, end):
        found.setdefault(name, (body, stop))

    def read(name, dtype, width):
        return _entries(data, *found[name], dtype, width) if name in found else None

    out = {"stts": read("stts", ">u4", 2), "stsc": read("stsc", ">u4", 3), "stss": read("stss", ">u4", 1)}
    if "ctts" in found:
        signed = data[found["ctts"][0]] == 1
        out["ctts"] = read("ctts", ">i4" if signed else ">u4", 2)
        if not signed and len(out["ctts"]) and out["ctts"][:, 1].max() > 2**31 - 1:
            raise BoxError("a composition offset is out of range")
    else:
        out["ctts"] = None
    out["offsets"] = read("stco", ">u4", 1) if "stco" in found else read("co64", ">u8", 1)
    if "stsz" in found:
        at, stop = found["stsz"]
        if stop - at < 12:
            raise BoxError("stsz is cut")
        size, n = struct.unpack_from(">II", data, at + 4)
        if n > MAX_SAMPLES:
            raise BoxError("too many samples")
        out["sizes"] = np.full(n, size, np.int64) if size else _entries(data, at, stop, ">u4", 1, 8)[:, 0]
    elif "stz2" in found:
        at, stop = found["stz2"]
        if stop - at < 12:
            raise BoxError("stz2 is cut")
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits not in (4, 8, 16) or (n * bits + 7) // 8 > stop - at - 12:
            raise BoxError("packed sizes don't fit")
        raw = np.frombuffer(data, np.uint8, (n * bits + 7) // 8, at + 12)
        if bits == 4:
            out["sizes"] = np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
        else:
            out["sizes"] = raw.astype(np.int64) if bits == 8 else raw.view(">u2").astype(np.int64)
    missing = [k for k in ("stts", "stsc", "offsets", "sizes") if out.get(k) is None]
    if missing:
        raise BoxError(f"no table {missing[0]}")
    return out


def sample_rows(t: dict, source_len: int | None = None, max_samples: int = MAX_SAMPLES) -> dict[str, np.ndarray]:
    """The tables side by side, a row a sample.  Checked in this order: count, chunks, times, composition, byte range."""
    sizes, n = t["sizes"], len(t["sizes"])
    if n > max_samples:
        raise BoxError("too many samples")
    chunks, runs = t["offsets"][:, 0], t["stsc"]
    if n and (not len(runs) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any() or (runs[:, 1] == 0).any()):
        raise BoxError("chunk runs are not in order")
    per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks))).clip(min=0)) if len(runs) else np.zeros(0, np.int64)
    if per_chunk.sum() != n or len(per_chunk) != len(chunks):
        raise BoxError(f"chunks hold {per_chunk.sum()} of {n} samples")

    def spread(table, what):
        if table[:, 0].sum() != n:
            raise BoxError(f"{what} cover {table[:, 0].sum()} of {n} samples")
        return np.repeat(table[:, 1], table[:, 0])

    duration = spread(t["stts"], "durations")
    composition = np.zeros(n, np.int64) if t["ctts"] is None else spread(t["ctts"], "composition offsets")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per_chunk) - per_chunk
    offset = np.repeat(chunks - before[first] if n else chunks, per_chunk) + before
    if source_len is not None and n and (offset + sizes).max() > source_len:
        raise BoxError("a sample lies beyond the source")
    sync = np.ones(n, bool)
    if t["stss"] is not None:
        sync[:] = False
        listed = np.unique(t["stss"][:, 0])
        sync[listed[(listed >= 1) & (listed <= n)] - 1] = True
    return {"offset": offset, "size": sizes, "decode_time": np.cumsum(duration) - duration, "duration": duration, "composition_offset": composition, "is_sync": sync}


def box(name: str, *payload: bytes) -> bytes:
    body = b"".join(payload)
    return struct.pack(">I4s", len(body) + 8, name.encode()) + body


def full_box(name: str, *payload: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(name, struct.pack(">I", version << 24 | flags), *payload)


def _runs(values: np.ndarray) -> np.ndarray:
    """(length, value) of the runs of equal values."""
    if not len(values):
        return np.zeros((0, 2), np.int64)
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    return np.stack([np.diff(np.append(at, len(values))), values[at]], 1)


def _packed(rows: np.ndarray, dtype: str) -> bytes:
    return struct.pack(">I", len(rows)) + rows.astype(dtype).tobytes()


def write_sample_tables(offset, size, duration, composition, sync) -> bytes:
    """A stbl box of a series.  Samples that lie side by side share a chunk; stss and ctts are left out where they say nothing."""
    n = len(size)
    new = np.append(True, offset[1:] != offset[:-1] + size[:-1])[:n]
    at = np.flatnonzero(new)
    per = np.diff(np.append(at, n))
    change = np.flatnonzero(np.append(True, per[1:] != per[:-1])[: len(per)])
    stsc = np.stack([change + 1, per[change], np.ones(len(change), np.int64)], 1)
    wide = n and offset.max() >= 2**32
    parts = [full_box("stts", _packed(_runs(duration), ">u4"))]
    if composition.any():
        parts.append(full_box("ctts", _packed(_runs(composition), ">i4"), version=1))
    if not sync.all():
        parts.append(full_box("stss", _packed(np.flatnonzero(sync)[:, None] + 1, ">u4")))
    parts += [full_box("stsc", _packed(stsc, ">u4")), full_box("stsz", struct.pack(">I", 0), _packed(size, ">u4"))]
    return box("stbl", *parts, full_box("co64" if wide else "stco", _packed(offset[at], ">u8" if wide else ">u4")))


def write_fragment(track: int, decode_time: int, duration, size, composition, sync) -> bytes:
    """A moof box of one run whose data follows it; the fields of each sample are written out."""
    fields = np.stack([duration, size, np.where(sync, SYNC_FLAGS, NON_SYNC_FLAGS), composition & 0xFFFFFFFF], 1)
    own = DATA_OFFSET | RUN_DURATION | RUN_SIZE | RUN_FLAGS | RUN_COMPOSITION

    def whole(data_at: int) -> bytes:
        run = full_box("trun", struct.pack(">Ii", len(fields), data_at), fields.astype(">u4").tobytes(), version=1, flags=own)
        return box("moof", box("traf", full_box("tfhd", struct.pack(">I", track), flags=BASE_IS_MOOF), full_box("tfdt", struct.pack(">Q", decode_time), version=1), run))

    return whole(len(whole(0)) + 8)


def fragment_rows(moof: bytes, moof_offset: int, track: int, next_time: int = 0, defaults=(0, 0, 0), source_len: int | None = None) -> tuple[list[tuple], int]:
    """(offset, size, decode_time, duration, composition_offset, is_sync) of a track's samples in one fragment, and the time at which they end.

    A field a sample lacks comes from the fragment header, then from the movie's defaults
    (duration, size, flags).  A fragment that starts before the last one ended is an error.
    """
    out: list[tuple] = []
    (_, _, body, stop), *_ = boxes(moof)
    previous_end = moof_offset
    for name, _, at, end in boxes(moof, body, stop):
        if name != "traf":
            continue
        parts = [(n, b, e) for n, _, b, e in boxes(moof, at, end)]
        head = next(((b, e) for n, b, e in parts if n == "tfhd"), None)
        if head is None:
            raise BoxError("a fragment has no header")
        flags, own = struct.unpack_from(">II", moof, head[0])
        flags, pos = flags & 0xFFFFFF, head[0] + 8
        got = {}
        for bit, form in ((BASE_OFFSET, ">Q"), (DESCRIPTION, ">I"), (DEFAULT_DURATION, ">I"), (DEFAULT_SIZE, ">I"), (DEFAULT_FLAGS, ">I")):
            if flags & bit:
                if pos + struct.calcsize(form) > head[1]:
                    raise BoxError("a fragment header is cut")
                got[bit] = struct.unpack_from(form, moof, pos)[0]
                pos += struct.calcsize(form)
        wanted = own == track
        given = defaults if wanted else (0, 0, 0)
        d0, s0, f0 = got.get(DEFAULT_DURATION, given[0]), got.get(DEFAULT_SIZE, given[1]), got.get(DEFAULT_FLAGS, given[2])
        base = got.get(BASE_OFFSET, moof_offset if flags & BASE_IS_MOOF else previous_end)
        time = next_time
        tfdt = next((b for n, b, _ in parts if n == "tfdt"), None)
        if wanted and tfdt is not None:
            time = struct.unpack_from(">Q" if moof[tfdt] else ">I", moof, tfdt + 4)[0]
            if time < next_time:
                raise BoxError("a fragment starts before the last one ended")
        cursor = base
        for n, b, e in parts:
            if n != "trun":
                continue
            word, count = struct.unpack_from(">II", moof, b)
            version, bits, pos, first = word >> 24, word & 0xFFFFFF, b + 8, None
            if bits & DATA_OFFSET:
                cursor = base + struct.unpack_from(">i", moof, pos)[0]
                pos += 4
            if bits & FIRST_FLAGS:
                first = struct.unpack_from(">I", moof, pos)[0]
                pos += 4
            columns = [k for k in (RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_COMPOSITION) if bits & k]
            if count * 4 * len(columns) > e - pos or count > MAX_SAMPLES:
                raise BoxError("a run is cut")
            if not wanted and not bits & RUN_SIZE:
                # another track's run is measured, not read
                cursor += count * s0
                continue
            table = np.frombuffer(moof, ">u4", count * len(columns), pos).reshape(count, len(columns)).astype(np.int64)
            at_bit = {k: table[:, i] for i, k in enumerate(columns)}
            duration, size = at_bit.get(RUN_DURATION, np.full(count, d0)), at_bit.get(RUN_SIZE, np.full(count, s0))
            if wanted:
                marks = at_bit.get(RUN_FLAGS, np.full(count, f0)).copy()
                if first is not None and not bits & RUN_FLAGS and count:
                    marks[0] = first
                shift = at_bit.get(RUN_COMPOSITION, np.zeros(count, np.int64))
                if version == 0 and count and shift.max() > 2**31 - 1:
                    raise BoxError("a composition offset is out of range")
                shift = np.where(shift > 2**31 - 1, shift - 2**32, shift)
                ends = cursor + np.cumsum(size)
                if source_len is not None and count and ends[-1] > source_len:
                    raise BoxError("a sample lies beyond the source")
                times = time + np.cumsum(duration) - duration
                out += zip((ends - size).tolist(), size.tolist(), times.tolist(), duration.tolist(), shift.tolist(), ((marks & NON_SYNC) == 0).tolist(), strict=True)
                time += int(duration.sum())
            cursor += int(size.sum())
        if wanted:
            next_time = time
        previous_end = cursor
    return out, next_time


_ROW = "sample_index long, offset long, size long, decode_time long, duration long, composition_offset long, is_sync boolean"
_SCHEMA = pa.schema([("sample_index", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("decode_time", pa.int64()), ("duration", pa.int64()), ("composition_offset", pa.int64()), ("is_sync", pa.bool_())])


def box_walk(files: DataFrame, content: str = "content") -> DataFrame:
    """A row a box of each file: the file's other columns, path, offset and size."""
    keys = [f for f in files.schema if f.name != content]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(content).to_pylist()):
                found = list(walk(data or b""))
                kept = pa.table({k.name: batch.column(k.name).take(pa.array([i] * len(found), pa.int32())) for k in keys})
                kept = kept.append_column("path", pa.array([f[0] for f in found], pa.string()))
                kept = kept.append_column("box_offset", pa.array([f[1] for f in found], pa.int64()))
                yield from kept.append_column("box_size", pa.array([f[3] - f[1] for f in found], pa.int64())).to_batches()

    return files.mapInArrow(run, ", ".join([f"`{k.name}` {k.dataType.simpleString()}" for k in keys] + ["path string, box_offset long, box_size long"]))


def decode_tables(files: DataFrame, content: str = "content") -> DataFrame:
    """The samples in the stbl box of each file, with the file's other columns."""
    keys = [f for f in files.schema if f.name != content]

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(content).to_pylist()):
                at = next(((b, e) for path, _, b, e in walk(data or b"") if path.endswith("stbl")), None)
                if at is None:
                    continue
                rows = sample_rows(sample_tables(data, *at))
                n = len(rows["size"])
                own = {k.name: batch.column(k.name).take(pa.array(np.full(n, i, np.int32))) for k in keys}
                yield from pa.table({**own, "sample_index": np.arange(n), **rows}).to_batches()

    return files.mapInArrow(run, ", ".join([f"`{k.name}` {k.dataType.simpleString()}" for k in keys] + [_ROW]))
