"""Matroska: writes samples as a file of EBML elements and parses such files into packet tables.

The parser knows variable-length ids and sizes (unknown sizes included), segments, tracks,
clusters, block groups and simple blocks, the four lacings and cues. A packet is one frame:
(track, time_ns, start, size, keyframe, lace), start and size being its byte range in the file. The
frames of a lace follow each other by the track's default duration, else by the block's share of its own
duration; without either all have the block's time. A frame of a block group is a key frame unless the
group refers to another. Cues must lead to a cluster of the cue's time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Ids of the elements.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIME_SCALE, MUXER, WRITER = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, RATE, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION, REFERENCE, BLOCK_DURATION = 0x23E383, 0xFB, 0x9B
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = frozenset((EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE, CUE_PLACE))
#: Elements that end a cluster or segment of unknown size.
TOP = frozenset((CLUSTER, CUES, INFO, TRACKS))

#: Samples a second, samples a frame, frames a block, blocks a cluster (times in a cluster must fit 16 bits of ms).
SAMPLE_RATE, FRAME, LACED, BLOCKS = 8000, 2048, 8, 15
NO_LACING, XIPH, FIXED, EBML_LACED = 0, 1, 2, 3


def write_id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def write_vint(value: int, least: int = 1) -> bytes:
    """A number with its length marked by leading zero bits; the all-ones value is reserved."""
    width = least
    while value >= (1 << (7 * width)) - 1:
        width += 1
    return (value | 1 << (7 * width)).to_bytes(width, "big")


def element(i: int, body: bytes) -> bytes:
    return write_id(i) + write_vint(len(body)) + body


def number(i: int, value: int) -> bytes:
    return element(i, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Lacing kind and block body: none for one frame, fixed for equal sizes, else EBML differences."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    count, sizes = bytes([len(frames) - 1]), [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return FIXED, count + b"".join(frames)
    head = write_vint(sizes[0])
    for before, now in zip(sizes, sizes[1:-1], strict=False):
        width = 1
        while not -(1 << (7 * width - 1)) < now - before < (1 << (7 * width - 1)):
            width += 1
        head += write_vint(now - before + (1 << (7 * width - 1)) - 1, width)
    return EBML_LACED, count + head + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """A file with one track of 8-bit PCM samples."""
    head = element(EBML, number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    info = element(INFO, number(TIME_SCALE, 1_000_000) + element(MUXER, b"wardlight") + element(WRITER, b"wardlight"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING, 1) + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    parts, place, cues = [info, tracks], len(info) + len(tracks), []
    step = FRAME * LACED
    for start in range(0, len(samples), step * BLOCKS):
        time = start * 1000 // SAMPLE_RATE
        body = [number(CLUSTER_TIME, time)]
        for at in range(start, min(start + step * BLOCKS, len(samples)), step):
            frames = [samples[i : min(i + FRAME, at + step)] for i in range(at, min(at + step, len(samples)), FRAME)]
            kind, laced = lace(frames)
            body.append(element(SIMPLE_BLOCK, write_vint(1) + struct.pack(">hB", at * 1000 // SAMPLE_RATE - time, 0x80 | kind << 1) + laced))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE, number(CUE_TIME, time) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        parts.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def read_vint(data: bytes, at: int, keep_mark: bool = False) -> tuple[int | None, int]:
    """(value, place after it); None is the reserved unknown size. Raises ValueError where data ends or no mark is found."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_mark:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start of its body, end of its body) of the elements from at to end."""
    while at < end:
        i, body = read_vint(data, at, keep_mark=True)
        size, body = read_vint(data, body)
        if size is None:
            stop = body
            if i == CLUSTER:  # up to the next element of the segment's own level
                for j, _, _, after in elements(data, body, end, CLUSTER):
                    if j in TOP:
                        break
                    stop = after
            else:
                stop = end
        else:
            stop = body + size
            if stop > end:
                raise ValueError(f"element {i:x} at {at} runs over its parent")
        yield i, at, body, stop
        if inside == CLUSTER and i in TOP:
            return
        at = stop


@dataclass
class Parsed:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, time_ns, start, size, keyframe, lace)
    packets: list[tuple[int, int, int, int, bool, int]] = field(default_factory=list)
    #: of each packet, the place of its cluster in the segment
    inside: list[int] = field(default_factory=list)
    #: (time_ns, track, place of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    #: place -> time_ns
    clusters: dict[int, int] = field(default_factory=dict)

    def cued(self) -> list[int | None]:
        """Of each packet the time of the latest cue of its track that leads to its cluster and isn't later than it."""
        by: dict[tuple[int, int], list[int]] = {}
        for time, track, place in self.cues:
            by.setdefault((track, place), []).append(time)
        return [max((c for c in by.get((p[0], place), ()) if c <= p[1]), default=None) for p, place in zip(self.packets, self.inside, strict=True)]


def unsigned(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first one starts."""
    if kind == NO_LACING:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // count] * count, at
    for k in range(count - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            before = at
            value, at = read_vint(data, at)
            value = (1 << 7 * (at - before)) - 1 if value is None else value
            size = value if not k else sizes[-1] + value - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run over their block")
    return sizes, at


def parse(data: bytes) -> Parsed:
    """The packet table of a file; ValueError where it isn't well formed or a cue leads astray."""
    out = Parsed()

    def block(start: int, end: int, cluster: dict, key: bool | None, lasting: int | None) -> None:
        track, at = read_vint(data, start)
        relative, flags = struct.unpack(">hB", data[at : at + 3])
        sizes, at = frame_sizes(data, at + 3, end, flags >> 1 & 3)
        step = out.tracks.get(track, {}).get("duration") or (lasting * out.scale // len(sizes) if lasting else 0)
        for k, size in enumerate(sizes):
            out.packets.append((track, (cluster["time"] + relative) * out.scale + k * step, at, size, bool(flags & 0x80) if key is None else key, k))
            out.inside.append(cluster["place"])
            at += size

    def walk(start: int, end: int, state: dict) -> None:
        for i, head, a, b in elements(data, start, end):
            if i == CLUSTER:
                walk(a, b, now := {"time": 0, "place": head - state.get("segment", 0)})
                out.clusters[now["place"]] = now["time"] * out.scale
            elif i == BLOCK_GROUP:
                inner = {j: (x, y) for j, _, x, y in elements(data, a, b)}
                if BLOCK in inner:
                    lasting = unsigned(data, *inner[BLOCK_DURATION]) if BLOCK_DURATION in inner else None
                    block(*inner[BLOCK], state, REFERENCE not in inner, lasting)
            elif i == SIMPLE_BLOCK:
                block(a, b, state, None, None)
            elif i == TRACK:
                walk(a, b, now := {})
                out.tracks[now.get("number", 0)] = now
            elif i == CUE:
                walk(a, b, now := {})
                out.cues.append((now.get("cue_time", 0) * out.scale, now.get("cue_track", 0), now.get("cue_cluster", 0)))
            elif i == SEGMENT:
                walk(a, b, {"segment": a, "time": 0, "place": 0})
            elif i in MASTERS:
                walk(a, b, state)
            elif i == TIME_SCALE:
                out.scale = unsigned(data, a, b)
            elif i == CODEC:
                state["codec"] = data[a:b].decode("ascii", "replace")
            elif i == RATE:
                state["rate"] = struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0]
            elif i in NUMBERS:
                state[NUMBERS[i]] = unsigned(data, a, b)

    walk(0, len(data), {"time": 0, "place": 0})
    for time, _, place in out.cues:
        if out.clusters.get(place, time + 1) > time:
            raise ValueError(f"the cue of {time} ns leads to no cluster of its time")
    return out


NUMBERS = {CLUSTER_TIME: "time", TRACK_NUMBER: "number", DEFAULT_DURATION: "duration", TRACK_TYPE: "type", CHANNELS: "channels", DEPTH: "depth", CUE_TIME: "cue_time", CUE_TRACK: "cue_track", CUE_CLUSTER: "cue_cluster"}


def payload(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    return b"".join([data[start : start + size] for t, _, start, size, _, _ in parsed.packets if t == track])


def feature(samples: bytes, parsed: Parsed) -> str:
    """Packets, clusters, cues, last time in ms, then mean, spread and sign changes of the samples, in integers."""
    values = np.frombuffer(samples, np.uint8).astype(np.int64)
    total, squares = int(values.sum()), int((values * values).sum())
    turns = int(np.count_nonzero(np.diff(values >= 128)))
    last = parsed.packets[-1][1] // 1_000_000 if parsed.packets else 0
    n = max(1, len(values))
    return f"{len(parsed.packets)}:{len(parsed.clusters)}:{len(parsed.cues)}:{last}:{1000 * total // n}:{1000 * (squares * n - total * total) // (n * n)}:{turns}"


def pad(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(unit - len(data) if len(data) < unit else -len(data) % unit)


PACKETS = "array<struct<track:long,time_ns:long,start:long,size:long,keyframe:boolean,lace:int,cue_ns:long>>"


def packet_table(df: DataFrame, media_col: str, keep: list[str]) -> DataFrame:
    """A row per packet of each file: keep, track, time_ns, start, size, keyframe, lace, cue_ns (see Parsed.cued), error.

    A file that isn't well formed, or null, gives one row of nulls with the reason in error, an empty
    table an empty one. Columns of keep with those names are replaced. Repeated rows repeat.
    """

    def fn(media: bytes | None) -> tuple:
        try:
            found = parse(media or b"")
        except (ValueError, IndexError, struct.error) as e:
            return None, str(e)
        names = ("track", "time_ns", "start", "size", "keyframe", "lace", "cue_ns")
        return [dict(zip(names, (*p, cue), strict=True)) for p, cue in zip(found.packets, found.cued(), strict=True)], None if media is not None else "null"

    made = ["track", "time_ns", "start", "size", "keyframe", "lace", "cue_ns", "error"]
    keep = [c for c in keep if c not in made]
    inner = [f"kept_{k}" for k in range(len(keep))]
    named = df.select(*[F.col(c).alias(i) for c, i in zip(keep, inner, strict=True)], F.col(media_col).cast("binary").alias("media"))
    rows = map_texts(named, "media", inner, f"packets {PACKETS}, error string", fn, "binary")
    return rows.select(*inner, F.explode_outer("packets").alias("p"), "error").select(*inner, "p.*", "error").toDF(*keep, *made)


def media_column(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """keep and media (binary): each text's padded bytes as a file."""
    return map_texts(df, text_col, keep, "media binary", lambda text: (mux(pad((text or "").encode())),))


def media_digest(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Stores each whole text in a file, parses it and reports what was read back.

    Null text counts as empty: 64 zero bytes. Rows are independent; repeated rows repeat.
    Result: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature.
    """

    def fn(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = mux(pad(raw))
        parsed = parse(media)
        back = payload(media, parsed)
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, parsed)

    return map_texts(df, text_col, [id_col], "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", fn)
