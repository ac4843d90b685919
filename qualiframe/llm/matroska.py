"""Media columns: a Matroska (EBML) writer and parser for one audio track of 8-bit PCM.

The parser walks the file by element ids and sizes of variable length, reads segment information,
tracks, clusters, simple blocks and block groups with no, Xiph, fixed or EBML lacing, and cues,
and gives one packet per laced frame with its track, timestamp in nanoseconds, key flag and byte
range.  Unknown elements are skipped by their size; a master of unknown size ends with its parent
or at the first element that cannot be its child.

Broken files raise ``MatroskaError``.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

# Element ids of the format (RFC 8794, RFC 9559).
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1
DEFAULT_DURATION, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, 0x1941A469, 0x1043A770, 0x1254C367}

NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
RATE, FRAME = 48_000, 192
FRAME_NS = FRAME * 1_000_000_000 // RATE


class MatroskaError(ValueError):
    pass


# ---- EBML ------------------------------------------------------------------------------------


def vint(value: int) -> bytes:
    """A size of variable length; all ones are kept for unknown sizes."""
    for width in range(1, 9):
        if value < (1 << 7 * width) - 1:
            return (value | 1 << 7 * width).to_bytes(width, "big")
    raise MatroskaError("size is too large")


def element(kind: int, payload: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(payload)) + payload


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def real(kind: int, value: float) -> bytes:
    return element(kind, struct.pack(">d", value))


def read_vint(data, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """Value (None: unknown size) and the place behind it."""
    if at >= end or not (first := data[at]):
        raise MatroskaError(f"no variable-length number at {at}")
    width = 9 - first.bit_length()
    if at + width > end:
        raise MatroskaError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def children(data, at: int, end: int, allowed: set[int] | None = None):
    """(id, start of the element, start and end of its content) of each child."""
    while at < end:
        kind, body = read_vint(data, at, end, keep_marker=True)
        if allowed is not None and kind in allowed:
            return
        length, body = read_vint(data, body, end)
        stop = end if length is None else body + length
        if stop > end:
            raise MatroskaError(f"element {kind:#x} at {at} is longer than its parent")
        if length is None and kind == CLUSTER:
            stop = _unknown_end(data, body, end)
        yield kind, at, body, stop
        at = stop


def _unknown_end(data, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: at the next top-level element."""
    while at < end:
        kind, body = read_vint(data, at, end, keep_marker=True)
        if kind in TOP_LEVEL:
            return at
        length, body = read_vint(data, body, end)
        if length is None:
            raise MatroskaError(f"unknown size inside a cluster at {at}")
        at = body + length
    return at


def number(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def floating(data, at: int, end: int) -> float:
    if end - at not in (0, 4, 8):
        raise MatroskaError(f"a floating-point number of {end - at} bytes at {at}")
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end > at else 0.0


# ---- writing ---------------------------------------------------------------------------------


def lace(frames: list[bytes], kind: int) -> bytes:
    """What follows a block's flags: lacing head and frames."""
    if kind == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif kind == EBML_LACING and sizes:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif kind == FIXED and len({len(f) for f in frames}) > 1:
        raise MatroskaError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def write(payload: bytes, frame: int = FRAME, laced: int = 8, blocks: int = 32) -> bytes:
    """A file that holds ``payload`` as 8-bit mono PCM: ``frame`` samples a frame, up to ``laced`` frames a block, ``blocks`` blocks a cluster.

    Blocks use fixed, Xiph and EBML lacing in turn; a lone frame is not laced.
    """
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    scale = 1_000_000
    head = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_VERSION, 4) + uint(DOC_READ_VERSION, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, scale) + real(DURATION, len(payload) * 1000 / RATE) + element(MUXING_APP, b"qualiframe") + element(WRITING_APP, b"qualiframe"))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    track = element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + uint(DEFAULT_DURATION, frame * 1_000_000_000 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio)
    parts = [info, element(TRACKS, track)]
    at, cues = sum(map(len, parts)), []
    per_cluster = laced * blocks
    for c in range(0, len(frames), per_cluster):
        begin = c * frame * 1000 // RATE
        body = [uint(TIMESTAMP, begin)]
        for k, b in enumerate(range(c, min(c + per_cluster, len(frames)), laced)):
            group = frames[b : min(b + laced, c + per_cluster)]
            kind = NO_LACING if len(group) == 1 else (FIXED, XIPH, EBML_LACING)[k % 3]
            if kind == FIXED and len(group[-1]) != len(group[0]):
                kind = EBML_LACING
            offset = b * frame * 1000 // RATE - begin
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", offset, 0x80 | kind << 1) + lace(group, kind)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, begin) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# ---- reading ---------------------------------------------------------------------------------


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0
    frame_ns: int = 0


@dataclass
class Movie:
    scale: int = 1_000_000
    duration: float = 0.0
    doc_type: str = "matroska"
    tracks: dict[int, Track] = field(default_factory=dict)
    #: (track, timestamp ns, key, start, end) by place in the file
    packets: list[tuple[int, int, bool, int, int]] = field(default_factory=list)
    #: (time, track, position of the cluster in the file)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    laced: list[int] = field(default_factory=lambda: [0, 0, 0, 0])


def frame_ranges(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; ``at`` is behind the flags."""
    if lacing == NO_LACING:
        return [(at, end)]
    if at >= end:
        raise MatroskaError(f"no lacing head at {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        size, rest = divmod(end - at, n)
        if rest:
            raise MatroskaError(f"frames of fixed lacing do not fill the block at {at}")
        return [(at + i * size, at + (i + 1) * size) for i in range(n)]
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError(f"cut off at {at}")
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, at = read_vint(data, at, end)
        sizes.append(size or 0)
        for _ in range(n - 2):
            before = at
            delta, at = read_vint(data, at, end, keep_marker=True)
            width = at - before
            sizes.append(sizes[-1] + (delta - (1 << 7 * width)) - ((1 << 7 * width - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError(f"frames are longer than their block at {at}")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def _track(data, at: int, end: int) -> Track:
    t = Track()
    for kind, _, a, b in children(data, at, end):
        if kind == TRACK_NUMBER:
            t.number = number(data, a, b)
        elif kind == TRACK_TYPE:
            t.kind = number(data, a, b)
        elif kind == CODEC_ID:
            t.codec = bytes(data[a:b]).decode("ascii", "replace")
        elif kind == DEFAULT_DURATION:
            t.frame_ns = number(data, a, b)
        elif kind == AUDIO:
            for k, _, x, y in children(data, a, b):
                if k == SAMPLING_FREQUENCY:
                    t.rate = floating(data, x, y)
                elif k == CHANNELS:
                    t.channels = number(data, x, y)
                elif k == BIT_DEPTH:
                    t.bits = number(data, x, y)
    return t


def _block(movie: Movie, data, at: int, end: int, base: int, key: bool | None) -> None:
    track, at = read_vint(data, at, end)
    if at + 3 > end:
        raise MatroskaError(f"cut off at {at}")
    offset, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
    lacing = flags >> 1 & 3
    movie.laced[lacing] += 1
    begin = (base + offset) * movie.scale
    step = movie.tracks[track].frame_ns if track in movie.tracks else 0
    whole = bool(flags & 0x80) if key is None else key
    movie.packets += [(track, begin + i * step, whole, a, b) for i, (a, b) in enumerate(frame_ranges(data, at + 3, end, lacing))]


def parse(data: bytes) -> Movie:
    """Tracks, packets and cues of a file."""
    movie, seen = Movie(), False
    for top, _, a, b in children(data, 0, len(data)):
        if top == EBML:
            for kind, _, x, y in children(data, a, b):
                if kind == DOC_TYPE:
                    movie.doc_type = bytes(data[x:y]).decode("ascii", "replace")
        if top != SEGMENT:
            continue
        seen = True
        for kind, start, x, y in children(data, a, b):
            if kind == INFO:
                for k, _, p, q in children(data, x, y):
                    if k == TIMESTAMP_SCALE:
                        movie.scale = number(data, p, q)
                    elif k == DURATION:
                        movie.duration = floating(data, p, q)
            elif kind == TRACKS:
                for k, _, p, q in children(data, x, y):
                    if k == TRACK_ENTRY:
                        t = _track(data, p, q)
                        movie.tracks[t.number] = t
            elif kind == CLUSTER:
                movie.clusters.append(start)
                base = 0
                for k, _, p, q in children(data, x, y):
                    if k == TIMESTAMP:
                        base = number(data, p, q)
                    elif k == SIMPLE_BLOCK:
                        _block(movie, data, p, q, base, None)
                    elif k == BLOCK_GROUP:
                        inner = list(children(data, p, q))
                        key = all(i[0] != REFERENCE_BLOCK for i in inner)
                        for i, _, m, n in inner:
                            if i == BLOCK:
                                _block(movie, data, m, n, base, key)
            elif kind == CUES:
                for k, _, p, q in children(data, x, y):
                    if k == CUE_POINT:
                        time = track = position = 0
                        for i, _, m, n in children(data, p, q):
                            if i == CUE_TIME:
                                time = number(data, m, n)
                            elif i == CUE_TRACK_POSITIONS:
                                for j, _, e, f in children(data, m, n):
                                    if j == CUE_TRACK:
                                        track = number(data, e, f)
                                    elif j == CUE_CLUSTER_POSITION:
                                        position = number(data, e, f) + a
                        movie.cues.append((time, track, position))
    if not seen:
        raise MatroskaError("no segment")
    return movie


def payload_of(data: bytes, movie: Movie, track: int = 1) -> bytes:
    return b"".join([data[a:b] for t, _, _, a, b in movie.packets if t == track])
