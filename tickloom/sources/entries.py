"""What a movie box says of its tracks: headers, edit lists, sample entries and codecs; and the movie box of a stream's start.

Every reader is a bounds-checked cursor: bytes that end too early are a BoxError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from tickloom.sources.boxes import BoxError, box, boxes, full_box

# fixed values: descriptor tags, and what says that audio is MPEG-4
ES, DECODER, SPECIFIC, MPEG4_AUDIO = 3, 4, 5, 0x40
#: Subsegments that an index has to list at least, and at most, to be read by it.
LEAST_REFERENCES, MOST_REFERENCES = 4, 4096


class Cursor:
    """Big-endian numbers from bytes, in order."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def take(self, n: int) -> bytes:
        if n < 0 or self.end - self.at < n:
            raise BoxError(f"{n} bytes are asked for where {self.end - self.at} are left")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, n: int, signed: bool = False) -> int:
        return int.from_bytes(self.take(n), "big", signed=signed)

    def left(self) -> int:
        return self.end - self.at

    def rest(self) -> bytes:
        return self.take(self.left())

    def full(self) -> int:
        """The version of a full box; its flags are passed over."""
        return self.number(4) >> 24


def child(data: bytes, *path: str) -> bytes | None:
    """The payload of the first box of that path, or None."""
    for name in path:
        found = next(((body, end) for n, _, body, end in boxes(data) if n == name), None)
        if found is None:
            return None
        data = data[found[0] : found[1]]
    return data


def need(data: bytes, *path: str) -> bytes:
    found = child(data, *path)
    if found is None:
        raise BoxError(f"no {'/'.join(path)}")
    return found


# --- sample entries ---


def visual(payload: bytes) -> tuple[int, int, bytes]:
    """Width, height and child boxes of a visual sample entry."""
    c = Cursor(payload)
    c.take(24)
    width, height = c.number(2), c.number(2)
    c.take(50)
    return width, height, c.rest()


def audible(payload: bytes) -> tuple[int, int, bytes]:
    """Rate, channels and child boxes of an audio sample entry, of the first QuickTime version, too."""
    c = Cursor(payload)
    c.take(8)
    version = c.number(2)
    c.take(6)
    channels = c.number(2)
    c.take(6)
    rate = c.number(4) >> 16
    if version > 1:
        raise BoxError(f"sound description version {version}")
    c.take(16 * version)
    return rate, channels, c.rest()


def descriptor(c: Cursor, wanted: int) -> Cursor:
    """The body of the next descriptor of a tag; its length is up to four groups of seven bits."""
    while c.left():
        tag, length = c.number(1), 0
        for _ in range(4):
            byte = c.number(1)
            length = length << 7 | byte & 0x7F
            if byte < 0x80:
                break
        body = c.take(length)
        if tag == wanted:
            return Cursor(body)
    raise BoxError(f"no descriptor {wanted}")


def aac_object_type(esds: bytes) -> int:
    c = Cursor(esds)
    c.full()
    es = descriptor(c, ES)
    es.take(2)
    flags = es.number(1)
    if flags & 0x80:
        es.take(2)
    if flags & 0x40:
        es.take(es.number(1))
    if flags & 0x20:
        es.take(2)
    decoder = descriptor(es, DECODER)
    if decoder.number(1) != MPEG4_AUDIO:
        raise BoxError("not MPEG-4 audio")
    decoder.take(12)
    bits = Bits(descriptor(decoder, SPECIFIC).rest())
    first = bits.take(5)
    return 32 + bits.take(6) if first == 31 else first


def _hevc(config: bytes, name: str) -> str:
    c = Cursor(config)
    c.take(1)
    profile, flags, constraints, level = c.number(1), c.number(4), c.take(6), c.number(1)
    space = ("", "A", "B", "C")[profile >> 6]
    turned = int(f"{flags:032b}"[::-1], 2)
    parts = [name, f"{space}{profile & 31}", f"{turned:X}", f"{'H' if profile & 32 else 'L'}{level}"]
    return ".".join(parts + [f"{b:X}" for b in constraints.rstrip(b"\0")])


def _av1(config: bytes) -> str:
    c = Cursor(config)
    if c.number(1) != 0x81:
        raise BoxError("AV1 configuration version")
    level, flags = c.number(1), c.number(1)
    depth = 8 if not flags & 0x40 else 12 if flags & 0x20 else 10
    return f"av01.{level >> 5}.{level & 31:02}{'H' if flags & 0x80 else 'M'}.{depth:02}"


def entry_codec(name: str, payload: bytes) -> dict:
    """codec string with width and height, or rate and channels, of a sample entry."""
    if name in ("avc1", "hvc1", "hev1", "vp09", "av01"):
        width, height, inner = visual(payload)
        if name == "avc1":
            config = need(inner, "avcC")
            codec = f"avc1.{Cursor(config, 1).take(3).hex()}"
        elif name in ("hvc1", "hev1"):
            codec = _hevc(need(inner, "hvcC"), name)
        elif name == "vp09":
            c = Cursor(need(inner, "vpcC"))
            c.full()
            codec = f"vp09.{c.number(1):02}.{c.number(1):02}.{c.number(1) >> 4:02}"
        else:
            codec = _av1(need(inner, "av1C"))
        return {"codec": codec, "width": width, "height": height, "rate": None, "channels": None}
    rate, channels, inner = audible(payload)
    if name == "mp4a":
        kind = aac_object_type(child(inner, "esds") or need(inner, "wave", "esds"))
        if kind not in (2, 5, 29):
            raise BoxError(f"audio object type {kind}")
        codec = f"mp4a.40.{kind}"
    elif name == "Opus":
        # the entry's own channel count and rate don't hold
        codec, rate, channels = "opus", 48_000, Cursor(need(inner, "dOps"), 1).number(1)
    elif name == "fLaC":
        c = Cursor(need(inner, "dfLa"))
        c.full()
        if c.number(1) & 0x7F:
            raise BoxError("no stream information")
        c.take(13)
        packed = c.number(3)
        codec, rate, channels = "fLaC", packed >> 4, (packed >> 1 & 7) + 1
    elif name in ("ac-3", "ec-3"):
        need(inner, "dac3" if name == "ac-3" else "dec3")
        codec = name
    else:
        raise BoxError(f"sample entry {name}")
    return {"codec": codec, "width": None, "height": None, "rate": rate, "channels": channels}


def plain_audio(payload: bytes) -> bytes:
    """A QuickTime audio entry in the layout of the standard: the same channels and rate, and the esds box alone."""
    c = Cursor(payload)
    head = c.take(8)
    if c.number(2) == 0:
        return payload
    rate, channels, inner = audible(payload)
    esds = child(inner, "esds") or need(inner, "wave", "esds")
    return head + bytes(8) + struct.pack(">HHII", channels, 16, 0, rate << 16) + box("esds", esds)


def video_entry(name: str, width: int, height: int, *config: bytes) -> bytes:
    return box(name, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", width, height, 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 24, -1), *config)


def audio_entry(name: str, rate: int, channels: int, *config: bytes) -> bytes:
    return box(name, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHI", channels, 16, 0), struct.pack(">I", rate << 16), *config)


def aac_config(kind: int) -> bytes:
    """An esds box of an audio object type below 31."""
    specific = bytes([SPECIFIC, 2]) + (kind << 11 | 0x190).to_bytes(2, "big")
    decoder = bytes([DECODER, 13 + len(specific), MPEG4_AUDIO, 0x15]) + bytes(11) + specific
    return full_box("esds", bytes([ES, 3 + len(decoder), 0, 1, 0]) + decoder)


# --- movie boxes ---


def _language(text: str) -> int:
    return sum((ord(c) - 0x60) << 5 * (2 - i) for i, c in enumerate(text))


def edit_box(version: int, entries: list[tuple[int, int, int, int]]) -> bytes:
    """(duration, media time, rate, fraction) an entry; a media time of all ones is an empty edit."""
    form, mask = (">QQHH", (1 << 64) - 1) if version else (">IIHH", (1 << 32) - 1)
    return box("edts", full_box("elst", struct.pack(">I", len(entries)), *[struct.pack(form, d & mask, m & mask, r, f) for d, m, r, f in entries], version=version))


def read_edits(elst: bytes) -> tuple[int, list[tuple[int, int, int, int]]]:
    """Version and entries; the media time of version 1 is signed, as all ones are its -1."""
    c = Cursor(elst)
    version, out = c.full(), []
    for _ in range(c.number(4)):
        n = 8 if version else 4
        out.append((c.number(n), c.number(n, signed=bool(version)), c.number(2), c.number(2)))
    return version, out


def track_box(track: int, handler: str, timescale: int, duration: int, language: str, entry: bytes, edits: bytes = b"", tables: bytes | None = None) -> bytes:
    """A trak box; tables: the boxes of its sample table after the sample description, or None for empty ones."""
    empty = b"".join((full_box("stts", bytes(4)), full_box("stsc", bytes(4)), full_box("stsz", bytes(8)), full_box("stco", bytes(4))))
    media_header = full_box("vmhd", bytes(8), flags=1) if handler == "vide" else full_box("smhd", bytes(4))
    reference = box("dinf", full_box("dref", struct.pack(">I", 1), full_box("url ", flags=1)))
    stbl = box("stbl", full_box("stsd", struct.pack(">I", 1), entry), empty if tables is None else tables)
    header = full_box("tkhd", struct.pack(">QQIIQ", 0, 0, track, 0, duration), bytes(52), struct.pack(">II", 0, 0), version=1, flags=7)
    info = full_box("mdhd", struct.pack(">QQIQHH", 0, 0, timescale, duration, _language(language), 0), version=1)
    named = full_box("hdlr", bytes(4), handler.encode(), bytes(13))
    return box("trak", header, edits, box("mdia", info, named, box("minf", media_header, reference, stbl)))


def movie_box(timescale: int, duration: int, *tracks: bytes) -> bytes:
    return box("moov", full_box("mvhd", struct.pack(">QQIQ", 0, 0, timescale, duration), bytes(80), version=1), *tracks)


def _times(c: Cursor) -> tuple[int, int]:
    """Timescale and duration of a movie or media header."""
    wide = c.full() == 1
    c.take(16 if wide else 8)
    return c.number(4), c.number(8 if wide else 4)


def read_tracks(moov: bytes) -> Iterator[dict]:
    """A row a track of a movie box's payload, in file order."""
    scale, length = _times(Cursor(need(moov, "mvhd")))
    if not scale:
        raise BoxError("the movie's timescale is zero")
    seen = set()
    extends = {Cursor(moov[a:b], 4).number(4) for n, _, a, b in boxes(moov) if n == "mvex" for n2, _, a, b in _inside(moov, a, b) if n2 == "trex"}
    for name, _, body, end in boxes(moov):
        if name != "trak":
            continue
        trak = moov[body:end]
        c = Cursor(need(trak, "tkhd"))
        c.take(16 if c.full() == 1 else 8)
        track = c.number(4)
        if track in seen:
            raise BoxError("two tracks share one id")
        seen.add(track)
        head = Cursor(need(trak, "mdia", "mdhd"))
        timescale, duration = _times(head)
        packed = head.number(2)
        handler = need(trak, "mdia", "hdlr")[8:12].decode("latin-1")
        stbl = need(trak, "mdia", "minf", "stbl")
        c = Cursor(need(stbl, "stsd"))
        c.full()
        if c.number(4) != 1:
            raise BoxError("not one sample description")
        entry, _, a, b = next(boxes(c.data, c.at))
        sizes = Cursor(need(stbl, "stsz"), 8)
        elst = child(trak, "edts", "elst")
        version, edits = read_edits(elst) if elst is not None else (0, [])
        yield {
            "track": track, "handler": handler, "timescale": timescale, "duration": duration, "language": "".join(chr((packed >> s & 31) + 0x60) for s in (10, 5, 0)), "entry": entry,
            **entry_codec(entry, c.data[a:b]), "samples": sizes.number(4), "edit_version": version, "edits": len(edits), "first_media_time": edits[0][1] if edits else None,
            "movie_timescale": scale, "movie_duration": length, "extended": track in extends,
        }


def _inside(data: bytes, start: int, end: int):
    return boxes(data, start, end)


def start_of_stream(moov: bytes, wanted: list[int]) -> bytes:
    """The bytes that a stream of some of a movie's tracks begins with: their descriptions without samples, lengths or edits, and a trex each."""
    rows = {r["track"]: r for r in read_tracks(moov)}
    if missing := [t for t in wanted if t not in rows]:
        raise BoxError(f"no track {missing[0]}")
    tracks, extends = [], []
    for t in wanted:
        own = next(moov[a:b] for n, _, a, b in boxes(moov) if n == "trak" and Cursor(need(moov[a:b], "tkhd"), 20).number(4) == t)
        description = need(own, "mdia", "minf", "stbl", "stsd")
        name, _, a, b = next(boxes(description, 8))
        entry = box(name, plain_audio(description[a:b]) if name == "mp4a" else description[a:b])
        r = rows[t]
        tracks.append(track_box(t, r["handler"], r["timescale"], 0, r["language"], entry))
        extends.append(full_box("trex", struct.pack(">IIIII", t, 1, 0, 0, 0)))
    brand = box("ftyp", b"iso6", bytes(4), b"iso6", b"cmfc", b"mp41")
    head = movie_box(next(iter(rows.values()))["movie_timescale"], 0, *tracks, box("mvex", *extends))
    return brand + head


# --- the protection of samples ---

#: Flag of a table with a map of clear and protected parts.
MAPPED = 2


def read_protection(senc: bytes, iv_size: int, samples: int) -> tuple[list[bytes], list[int], list[tuple[int, int]]]:
    """Vectors, where each sample's parts start (one more than samples), and all parts (clear, protected) in a row; as many entries as the fragment has samples."""
    if iv_size not in (0, 8, 16):
        raise BoxError(f"vectors of {iv_size} bytes")
    c = Cursor(senc)
    mapped = c.number(4) & MAPPED
    if c.number(4) != samples:
        raise BoxError("not a vector a sample")
    vectors, starts, parts = [], [0], []
    for _ in range(samples):
        vectors.append(c.take(iv_size))
        if mapped:
            parts += [(c.number(2), c.number(4)) for _ in range(c.number(2))]
        starts.append(len(parts))
    if c.left():
        raise BoxError("bytes are left over")
    return vectors, starts, parts


# --- segment indexes ---


def index_box(first_offset: int, sizes: list[int], version: int = 0) -> bytes:
    form = ">IIQQHH" if version else ">IIIIHH"
    return full_box("sidx", struct.pack(form, 1, 90_000, 0, first_offset, 0, len(sizes)), *[struct.pack(">III", n, 0, 0x90000000) for n in sizes], version=version)


def index_ranges(payload: bytes, end: int) -> list[tuple[int, int]] | None:
    """(start, end) of the subsegments that an index lists, or None if it isn't one to read by: too few or too many, nested, or empty ones."""
    c = Cursor(payload)
    wide = 8 if c.full() else 4
    c.take(8 + wide)
    at = end + c.number(wide)
    c.take(2)
    n = c.number(2)
    if not LEAST_REFERENCES <= n <= MOST_REFERENCES:
        return None
    out = []
    for _ in range(n):
        size = c.number(4)
        c.take(8)
        if size >> 31 or not size:
            return None
        out.append((at, at + size))
        at += size
    return out


def subsegment_fragments(data: bytes, start: int, end: int) -> list[int] | None:
    """Offsets of the fragment boxes in a subsegment, or None if it isn't a whole number of boxes with one at least."""
    try:
        found = [at for name, at, _, _ in boxes(data, start, end) if name == "moof"] if end <= len(data) else []
    except BoxError:
        return None
    return found or None


# --- bits ---


class Bits:
    """Bits from bytes, the highest first."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def take(self, n: int) -> int:
        if n > self.left:
            raise BoxError("bits end too early")
        self.left -= n
        return self.value >> self.left & (1 << n) - 1

    def unsigned(self) -> int:
        """An exponential Golomb code: as many zeros as bits follow the one."""
        zeros = 0
        while not self.take(1):
            zeros += 1
            if zeros > 32:
                raise BoxError("a code of over 32 bits")
        return (1 << zeros) - 1 + self.take(zeros)

    def signed(self) -> int:
        n = self.unsigned()
        return (n + 1) // 2 if n % 2 else -(n // 2)


def golomb(numbers: list[int]) -> bytes:
    """Unsigned numbers as exponential Golomb codes, ended by a one and zeros to a whole byte."""
    text = "".join("0" * (len(b) - 1) + b for b in (f"{n + 1:b}" for n in numbers)) + "1"
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


def unescaped(nal: bytes) -> bytes:
    """Without the threes that keep two zeros from looking like a start."""
    out, zeros = bytearray(), 0
    for b in nal:
        if zeros >= 2 and b == 3:
            zeros = 0
            continue
        zeros = zeros + 1 if b == 0 else 0
        out.append(b)
    return bytes(out)


def escaped(raw: bytes) -> bytes:
    out, zeros = bytearray(), 0
    for b in raw:
        if zeros >= 2 and b <= 3:
            out.append(3)
            zeros = 0
        zeros = zeros + 1 if b == 0 else 0
        out.append(b)
    return bytes(out)


def units_tile(sample: bytes, width: int) -> bool:
    """Whether units with their lengths before them cover a sample exactly, none of them empty."""
    at = 0
    while at < len(sample):
        size = int.from_bytes(sample[at : at + width], "big") if at + width <= len(sample) else 0
        if not size:
            return False
        at += width + size
    return at == len(sample)
