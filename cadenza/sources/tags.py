"""Binary tags of audio files: ID3, FLAC, Ogg, MP4, RIFF, AIFF and ASF.

Each reader takes the bytes of a file (or what reads them by pieces, as files.Bytes does) and returns a dictionary of what it found; whatever is broken ends
it, and what it had found so far counts. Text is trimmed, and the first value that is not empty wins.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import GENRES
from ..operators.rawtags import V22

FIELDS = ["title", "artist", "album_artist", "album", "genre", "composer", "comment", "title_sort", "artist_sort", "album_sort", "album_artist_sort", "composer_sort", "mb_artist_id", "mb_album_artist_id"]
NUMBERS = ["year", "track_no", "track_total", "disc", "disc_total", "duration_ms", "bitrate", "sample_rate", "channels"]
SCHEMA = ", ".join([f"{f} string" for f in FIELDS] + [f"{n} int" for n in NUMBERS] + ["format string", "has_art boolean", "compilation boolean"])

#: Where containers keep the fields (ID3v2 frames; Vorbis comments, in order; MP4 atoms; RIFF; ASF).
ID3 = {"TIT2": "title", "TPE1": "artist", "TPE2": "album_artist", "TALB": "album", "TCON": "genre", "TCOM": "composer", "TSOT": "title_sort", "TSOP": "artist_sort", "TSOA": "album_sort", "TSO2": "album_artist_sort", "TSOC": "composer_sort", "TDRC": "year", "TDRL": "year", "TYER": "year", "TDAT": "year", "TRCK": "track", "TPOS": "disc", "TCMP": "compilation"}
VORBIS = {"title": ["TITLE"], "artist": ["ARTIST", "PERFORMER"], "album_artist": ["ALBUMARTIST", "ALBUM ARTIST", "ENSEMBLE"], "album": ["ALBUM"], "genre": ["GENRE"], "composer": ["COMPOSER"], "comment": ["COMMENT", "DESCRIPTION"], "title_sort": ["TITLESORT"], "artist_sort": ["ARTISTSORT"], "album_sort": ["ALBUMSORT"], "album_artist_sort": ["ALBUMARTISTSORT", "ALBUM ARTIST SORT"], "composer_sort": ["COMPOSERSORT"], "year": ["DATE", "YEAR", "RELEASEDATE", "ORIGINALDATE"], "track": ["TRACKNUMBER"], "track_total": ["TRACKTOTAL", "TOTALTRACKS"], "disc": ["DISCNUMBER", "DISC"], "disc_total": ["DISCTOTAL", "TOTALDISCS"], "compilation": ["COMPILATION"], "mb_artist_id": ["MUSICBRAINZ_ARTISTID"], "mb_album_artist_id": ["MUSICBRAINZ_ALBUMARTISTID"]}
MP4 = {"©nam": "title", "©ART": "artist", "aART": "album_artist", "©alb": "album", "©gen": "genre", "©wrt": "composer", "©cmt": "comment", "sonm": "title_sort", "soar": "artist_sort", "soal": "album_sort", "soaa": "album_artist_sort", "soco": "composer_sort", "©day": "year"}
RIFF = {"INAM": "title", "TITL": "title", "IART": "artist", "IPRD": "album", "IALB": "album", "IGNR": "genre", "IMUS": "composer", "IENG": "composer", "ICMT": "comment", "ICRD": "year", "IYER": "year", "ITRK": "track", "IPRT": "track"}
ASF = {"WM/ALBUMARTIST": "album_artist", "WM/ALBUMTITLE": "album", "WM/GENRE": "genre", "WM/COMPOSER": "composer", "WM/YEAR": "year", "WM/ORIGINALRELEASEYEAR": "year", "WM/TRACKNUMBER": "track", "WM/TRACK": "track", "WM/PARTOFSET": "disc"}
AIFF = {b"NAME": "title", b"AUTH": "artist", b"ANNO": "comment"}
#: MPEG bit rates (kbit/s) of version 1 and of 2 and 2.5, by layer; sample rates.
RATES = {(1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
SAMPLES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def sniff(data: bytes, fallback: str) -> str:
    """The format by the first bytes, else by ending."""
    if data[:3] == b"ID3" or (len(data) > 1 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0):
        return "mp3"
    if data[:4] == b"OggS":
        return "opus" if b"OpusHead" in data[:128] else "ogg"
    if data[4:8] == b"ftyp":
        return "mp4"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "wav"
    if data[:4] == b"FORM" and data[8:12] in (b"AIFF", b"AIFC"):
        return "aiff"
    if data[:4] == b"fLaC":
        return "flac"
    return "wma" if data[:4] == bytes.fromhex("3026B275") else fallback


def put(out: dict, field: str | None, text: str) -> None:
    """Keep a text if the field has none; numbers and pairs are taken apart."""
    text = text.strip().strip("\0").strip()
    if not field or not text:
        return
    if field == "year":
        found = [int(y) for y in re.findall(r"(?<![0-9])[0-9]{4}(?![0-9])", text) if 1000 <= int(y) <= 3000]
        if found:
            out.setdefault("year", found[0])
    elif field in ("track", "disc"):
        number, _, total = text.replace("-", "/").partition("/")
        for name, x in ((("track_no", "disc")[field == "disc"], number), (f"{field}_total", total)):
            if (m := re.match(r"\s*\+?([0-9]{1,9})", x)) and int(m[1]):
                out.setdefault(name, int(m[1]))
    elif field.endswith("_total"):
        if (m := re.match(r"[0-9]{1,9}", text)) and int(m[0]):
            out[field] = int(m[0])
    elif field == "compilation":
        out["compilation"] |= text.lower() not in ("0", "false", "no")
    else:
        out.setdefault(field, text)


def genre(text: str) -> str:
    """A genre with its number resolved."""
    text = text.strip()
    m = re.match(r"\(([^)]*)\)\s*(.*)", text, re.S)
    if m and m[1] and m[2]:
        return m[2].strip()
    code = m[1] if m and m[1] else text
    if code.isdigit() and int(code) < len(GENRES):
        return GENRES[int(code)]
    return {"RX": "Remix", "CR": "Cover"}.get(code, code) if code != text else text


def id3_text(raw: bytes) -> str:
    """Text of a frame: an encoding byte, then values parted by NUL, which become one text."""
    if not raw:
        return ""
    code, body = raw[0], raw[1:]
    if code == 1 and body[:2] not in (b"\xff\xfe", b"\xfe\xff"):
        body = b"\xff\xfe" + body
    name = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(code)
    text = (body if name else raw).decode(name or "latin-1", "replace")
    return "; ".join(x.strip("﻿ \t\r\n") for x in text.split("\0") if x.strip("﻿ \t\r\n"))


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3_frames(data: bytes) -> Iterator[tuple[str, bytes]]:
    """(frame id, content) of an ID3v2 tag, with ids of version 2.2 as their successors."""
    if data[:3] != b"ID3" or len(data) < 10:
        return
    version, flags, size = data[3], data[5], _syncsafe(data[6:10])
    body = data[10 : 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    if flags & 0x40 and len(body) >= 4:
        body = body[_syncsafe(body[:4]) if version == 4 else 4 + struct.unpack(">I", body[:4])[0] :]
    head = 6 if version == 2 else 10
    while len(body) > head and body[0]:
        if version == 2:
            name, n = body[:3].decode("latin-1"), int.from_bytes(body[3:6])
        else:
            name, n = body[:4].decode("latin-1"), _syncsafe(body[4:8]) if version == 4 else int.from_bytes(body[4:8])
        content, body = body[head : head + n], body[head + n :]
        yield V22.get(name, name) if version == 2 else name, content


def read_id3(data: bytes, out: dict) -> None:
    for name, content in id3_frames(data):
        if name == "APIC":
            out["has_art"] = True
        elif name == "COMM":
            wide = content[:1] in (b"\1", b"\2")
            about, _, text = content[4:].partition(b"\0\0" if wide else b"\0")
            if not id3_text(content[:1] + about) or id3_text(content[:1] + about).lower() == "comment":
                put(out, "comment", id3_text(content[:1] + text))
        elif name == "TXXX":
            key, _, text = id3_text(content).partition("; ")
            known = {"MUSICBRAINZARTISTID": "mb_artist_id", "MUSICBRAINZALBUMARTISTID": "mb_album_artist_id", "COMPILATION": "compilation"}
            put(out, known.get(re.sub("[^A-Z]", "", key.upper())), text)
        elif name in ID3:
            text = id3_text(content)
            put(out, ID3[name], genre(text) if name == "TCON" else text)


def read_id3v1(data: bytes, out: dict) -> None:
    tail = data[-128:]
    if tail[:3] != b"TAG" or any(out.get(f) for f in ("title", "artist", "album")):
        return
    for field, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127)):
        put(out, field, tail[a:b].split(b"\0")[0].decode("latin-1"))
    if tail[125] == 0 and tail[126]:
        out.setdefault("track_no", tail[126])
    if tail[127] < len(GENRES):
        out.setdefault("genre", GENRES[tail[127]])


def read_mp3(data: bytes, out: dict) -> None:
    read_id3(data, out)
    read_id3v1(data, out)
    at = 10 + _syncsafe(data[6:10]) if data[:3] == b"ID3" else 0
    while at + 4 <= len(data):
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            return
        h = int.from_bytes(data[at : at + 4])
        version, layer, rate, sample = h >> 19 & 3, 4 - (h >> 17 & 3), h >> 12 & 15, h >> 10 & 3
        if h >> 21 == 0x7FF and version != 1 and layer < 4 and 0 < rate < 15 and sample < 3:
            break
        at += 1
    else:
        return
    kbps, hertz = RATES[1 if version == 3 else 2, layer][rate - 1], SAMPLES[version][sample]
    mono = h >> 6 & 3 == 3
    out |= {"sample_rate": hertz, "channels": 1 if mono else 2, "bitrate": kbps}
    per_frame = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    xing, size = data[at + 4 + side : at + 4 + side + 16], len(data) - at
    frames = 0
    if xing[:4] in (b"Xing", b"Info") and len(xing) >= 12 and xing[7] & 1:
        frames = int.from_bytes(xing[8:12])
    elif data[at + 36 : at + 40] == b"VBRI":
        frames = int.from_bytes(data[at + 50 : at + 54])
    if frames:
        out["duration_ms"] = frames * per_frame * 1000 // hertz
        out["bitrate"] = size * 8 // max(out["duration_ms"], 1)
    else:
        out["duration_ms"] = size * 8 // kbps


def read_vorbis(data: bytes, out: dict) -> None:
    """A comment block: vendor, count, then KEY=value."""
    n = int.from_bytes(data[:4], "little")
    at, count = 8 + n, int.from_bytes(data[4 + n : 8 + n], "little")
    found: dict[str, list[str]] = {}
    for _ in range(min(count, 100_000)):
        size = int.from_bytes(data[at : at + 4], "little")
        key, eq, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        at += 4 + size
        if eq and value.strip():
            found.setdefault(key.upper(), []).append(value.strip())
        if at >= len(data):
            break
    if "METADATA_BLOCK_PICTURE" in found:
        out["has_art"] = True
    for field, keys in VORBIS.items():
        values = next((found[k] for k in keys if k in found), [])
        put(out, field, "; ".join(values) if field not in ("year", "track", "disc", "track_total", "disc_total", "compilation") else (values or [""])[0])


def read_flac(data: bytes, out: dict) -> None:
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
        block = data[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0 and len(block) >= 18:
            bits = int.from_bytes(block[10:18])
            hertz, samples = bits >> 44, bits & (1 << 36) - 1
            out |= {"sample_rate": hertz, "channels": (bits >> 41 & 7) + 1, "duration_ms": samples * 1000 // hertz if hertz else 0}
        elif kind == 4:
            read_vorbis(block, out)
        elif kind == 6:
            out["has_art"] = True
    _rate(data, out)


def _rate(data: bytes, out: dict) -> None:
    if out.get("duration_ms") and not out.get("bitrate"):
        out["bitrate"] = len(data) * 8 // out["duration_ms"]


def read_ogg(data: bytes, out: dict) -> None:
    packets, held, at, granule = [], b"", 0, 0
    while len(packets) < 2 and data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        sizes = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(sizes)
        for n in sizes:
            if len(packets) < 2:
                held += data[at : at + n]
                if n < 255:
                    packets.append(held)
                    held = b""
            at += n
    tail = data[-65536:]
    for m in re.finditer(b"OggS", tail):  # the length stands in the last page
        granule = max(granule, int.from_bytes(tail[m.start() + 6 : m.start() + 14], "little", signed=True))
    head = packets[0] if packets else b""
    hertz = 0
    if head[:8] == b"OpusHead":
        hertz, out["channels"] = 48000, head[9]
        granule -= int.from_bytes(head[10:12], "little")
        comments = packets[1][8:] if len(packets) > 1 else b""
    elif head[1:7] == b"vorbis":
        out["channels"], hertz = head[11], int.from_bytes(head[12:16], "little")
        comments = packets[1][7:] if len(packets) > 1 else b""
    else:
        return
    out |= {"sample_rate": hertz, "duration_ms": max(granule, 0) * 1000 // hertz if hertz else 0}
    if len(comments) >= 8:
        read_vorbis(comments, out)
    _rate(data, out)


def atoms(data: bytes) -> Iterator[tuple[str, bytes]]:
    at = 0
    while at + 8 <= len(data):
        size, name, head = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16]), 16
        size = size or len(data) - at
        if size < head:
            return
        yield name, data[at + head : at + size]
        at += size


def read_mp4(data: bytes, out: dict) -> None:
    moov = next((b for n, b in atoms(data) if n == "moov"), b"")
    for name, body in atoms(moov):
        if name == "mvhd" and len(body) >= 32:
            wide = body[0] == 1
            scale, length = (int.from_bytes(body[20:24]), int.from_bytes(body[24:32])) if wide else (int.from_bytes(body[12:16]), int.from_bytes(body[16:20]))
            out["duration_ms"] = length * 1000 // scale if scale else 0
        elif name == "trak":
            for stsd in _inside(body, "mdia", "minf", "stbl", "stsd"):
                if len(stsd) >= 44:
                    out |= {"channels": int.from_bytes(stsd[32:34]), "sample_rate": int.from_bytes(stsd[40:42])}
        elif name == "udta":
            for meta in _inside(body, "meta"):
                for ilst in _inside(meta[4:], "ilst"):
                    for key, item in atoms(ilst):
                        _mp4_item(key, item, out)
    _rate(data, out)


def _inside(data: bytes, *names: str) -> Iterator[bytes]:
    for name, body in atoms(data):
        if name == names[0]:
            if len(names) == 1:
                yield body
            else:
                yield from _inside(body, *names[1:])


def _mp4_item(key: str, item: bytes, out: dict) -> None:
    parts = list(atoms(item))
    value = next((b[8:] for n, b in parts if n == "data"), b"")
    if key == "covr":
        out["has_art"] = True
    elif key in ("trkn", "disk"):
        put(out, "track" if key == "trkn" else "disc", f"{int.from_bytes(value[2:4])}/{int.from_bytes(value[4:6])}")
    elif key == "cpil":
        out["compilation"] |= any(value)
    elif key == "gnre" and 0 < int.from_bytes(value) <= len(GENRES):
        out.setdefault("genre", GENRES[int.from_bytes(value) - 1])
    elif key == "----":
        name = next((b[4:] for n, b in parts if n == "name"), b"").decode("utf-8", "replace")
        put(out, {"MUSICBRAINZARTISTID": "mb_artist_id", "MUSICBRAINZALBUMARTISTID": "mb_album_artist_id"}.get(re.sub("[^A-Z]", "", name.upper())), value.decode("utf-8", "replace"))
    elif key in MP4:
        text = value.decode("utf-8", "replace")
        put(out, MP4[key], genre(text) if key == "©gen" else text)


def chunks(data: bytes, order: str) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], order)
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def read_wav(data: bytes, out: dict) -> None:
    per_second = 0
    for name, body in chunks(data, "little"):
        if name == b"fmt " and len(body) >= 16:
            _, channels, hertz, per_second = struct.unpack("<HHII", body[:12])
            out |= {"channels": channels, "sample_rate": hertz, "bitrate": per_second * 8 // 1000}
        elif name == b"data" and per_second:
            out["duration_ms"] = len(body) * 1000 // per_second
        elif name == b"LIST" and body[:4] == b"INFO":
            for key, text in chunks(b"\0" * 8 + body, "little"):
                field = RIFF.get(key.decode("latin-1"))
                text = text.split(b"\0")[0].decode("utf-8", "replace")
                put(out, field, genre(text) if field == "genre" else text)
        elif name.lower() == b"id3 ":
            read_id3(body, out)


def read_aiff(data: bytes, out: dict) -> None:
    for name, body in chunks(data, "big"):
        if name == b"COMM" and len(body) >= 18:
            channels, frames, _ = struct.unpack(">HIH", body[:8])
            power, mantissa = struct.unpack(">HQ", body[8:18])
            hertz = int(mantissa * 2.0 ** ((power & 0x7FFF) - 16383 - 63))
            out |= {"channels": channels, "sample_rate": hertz, "duration_ms": frames * 1000 // hertz if hertz else 0}
        elif name in AIFF:
            put(out, AIFF[name], body.decode("utf-8", "replace"))
        elif name.lower() == b"id3 ":
            read_id3(body, out)
    _rate(data, out)


def read_wma(data: bytes, out: dict) -> None:
    wide = lambda b: b.decode("utf-16-le", "replace").strip("\0")
    at = 30
    while at + 24 <= min(len(data), int.from_bytes(data[16:24], "little")):
        kind, size = data[at : at + 16].hex().upper(), int.from_bytes(data[at + 16 : at + 24], "little")
        body = data[at + 24 : at + size]
        at += max(size, 24)
        if kind.startswith("3326B275"):  # content description
            sizes, place = struct.unpack("<5H", body[:10]), 10
            for field, n in zip(("title", "artist", None, "comment", None), sizes, strict=True):
                put(out, field, wide(body[place : place + n]))
                place += n
        elif kind.startswith("40A4D0D2"):  # extended content description
            place = 2
            for _ in range(int.from_bytes(body[:2], "little")):
                n = int.from_bytes(body[place : place + 2], "little")
                name = wide(body[place + 2 : place + 2 + n]).upper()
                place += 2 + n
                type_, n = struct.unpack("<HH", body[place : place + 4])
                raw = body[place + 4 : place + 4 + n]
                place += 4 + n
                text = wide(raw) if type_ == 0 else str(int.from_bytes(raw, "little"))
                if name == "WM/PICTURE":
                    out["has_art"] = True
                else:
                    put(out, ASF.get(name), genre(text) if name == "WM/GENRE" else text)
        elif kind.startswith("A1DCAB8C") and len(body) >= 64:  # file properties
            out["duration_ms"] = max(int.from_bytes(body[40:48], "little") // 10_000 - int.from_bytes(body[56:64], "little"), 0)
    _rate(data, out)


READERS = {"mp3": read_mp3, "flac": read_flac, "ogg": read_ogg, "opus": read_ogg, "mp4": read_mp4, "wav": read_wav, "aiff": read_aiff, "wma": read_wma}


#: What decode() gives, with types and what stands for nothing.
TYPES = [(f, pa.string(), "") for f in FIELDS] + [(n, pa.int32(), 0) for n in NUMBERS] + [("format", pa.string(), "unknown"), ("has_art", pa.bool_(), False), ("compilation", pa.bool_(), False)]


def as_batch(rows: list[dict], types: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n, empty) for r in rows], t) for n, t, empty in types], names=[n for n, _, _ in types])


def decode(data: bytes, fallback: str) -> dict:
    """Everything that can be read from a file's bytes."""
    kind = sniff(data, fallback)
    out: dict = {"format": kind, "has_art": False, "compilation": False}
    try:
        READERS.get(kind, lambda *_: None)(data, out)
    except (IndexError, struct.error, ValueError):
        pass  # a broken file keeps what was read before the fault
    return out


def decoded(content: Column, fallback: Column) -> Column:
    """Struct of a file's tags."""
    @F.arrow_udf(SCHEMA)
    def run(contents: pa.Array, fallbacks: pa.Array) -> pa.Array:
        rows = [decode(c or b"", f) for c, f in zip(contents.to_pylist(), fallbacks.to_pylist(), strict=True)]
        return as_batch(rows, TYPES).to_struct_array()

    return run(content, fallback)


#: How pictures begin.
IMAGES = {b"\xff\xd8\xff": "image/jpeg", b"\x89PNG\r\n\x1a\n": "image/png", b"GIF87a": "image/gif", b"GIF89a": "image/gif", b"BM": "image/bmp"}


def image_kind(data: bytes) -> str:
    """The MIME type of a picture by its first bytes, else ''."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return next((kind for head, kind in IMAGES.items() if data[: len(head)] == head), "")


def _terminated(b: bytes, code: int) -> tuple[bytes, bytes] | None:
    """What stands before and after the end mark of a text in this encoding; None without one."""
    if code not in (1, 2):
        head, mark, rest = b.partition(b"\0")
        return (head, rest) if mark else None
    for k in range(0, len(b) - 1, 2):
        if b[k : k + 2] == b"\0\0":
            return b[:k], b[k + 2 :]
    return None


def _as_text(code: int, raw: bytes) -> str:
    return id3_text(bytes([code]) + raw)


def _described(content: bytes, skip: int) -> tuple[str, str]:
    """(description, text) of a frame that has both, after its encoding and `skip` bytes more; both empty if it is broken."""
    parts = _terminated(bytes(content[1 + skip :]), content[0]) if len(content) > 1 + skip else None
    return (_as_text(content[0], parts[0]), _as_text(content[0], parts[1])) if parts else ("", "")


def id3_picture(c: bytes) -> tuple[int, str, bytes] | None:
    """(kind, MIME, bytes) of an APIC frame."""
    mime, mark, rest = bytes(c[1:]).partition(b"\0")
    parts = _terminated(rest[1:], c[0]) if mark and len(rest) > 1 else None
    if not parts:
        return None
    kind = mime.decode("latin-1").strip()
    return rest[0], kind if "/" in kind else image_kind(parts[1]) or kind, parts[1]


def flac_picture(b: bytes) -> tuple[int, str, bytes] | None:
    """(kind, MIME, bytes) of a FLAC picture block, also where a Vorbis comment holds one."""
    b = bytes(b)
    n = int.from_bytes(b[4:8])
    at = 12 + n + int.from_bytes(b[8 + n : 12 + n]) + 20
    size = int.from_bytes(b[at - 4 : at])
    if len(b) < at or size > len(b) - at:
        return None
    return int.from_bytes(b[:4]), b[8 : 8 + n].decode("latin-1"), b[at : at + size]


def mp4_picture(item: bytes) -> tuple[int, str, bytes] | None:
    """(kind, MIME, bytes) of a covr atom's first picture."""
    for name, b in atoms(item):
        if name == "data" and len(b) >= 8:
            image = bytes(b[8:])
            return 3, {13: "image/jpeg", 14: "image/png", 27: "image/bmp"}.get(int.from_bytes(b[1:4])) or image_kind(image), image
    return None


def _vorbis_fields(data: bytes) -> Iterator[tuple[str, str, int]]:
    """(key, value, bytes on disk) of a comment block."""
    n = int.from_bytes(data[:4], "little")
    at, count = 8 + n, int.from_bytes(data[4 + n : 8 + n], "little")
    for _ in range(count):
        if at + 4 > len(data):
            return
        size = int.from_bytes(data[at : at + 4], "little")
        key, eq, value = bytes(data[at + 4 : at + 4 + size]).decode("utf-8", "replace").partition("=")
        at += 4 + size
        if eq:
            yield key, value, 4 + size


def flac_blocks(data: bytes) -> Iterator[tuple[int, bytes]]:
    at, last = 4, False
    while not last and at + 4 <= len(data):
        last, kind, size = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4])
        yield kind, data[at + 4 : at + 4 + size]
        at += 4 + size


def _items(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Metadata atoms of an MP4 file."""
    for ilst in (i for udta in _inside(data, "moov", "udta") for meta in _inside(udta, "meta") for i in _inside(meta[4:], "ilst")):
        yield from atoms(ilst)


def _clip(text: str) -> str:
    text = text.replace("\n", " ").strip()
    return text if len(text) <= 32 else text[:32] + "…"


def _shown(text: str, size: int) -> str:
    return _clip(text) or f"{size} bytes"


def _id3_raw(data: bytes) -> Iterator[dict]:
    old = data[3] < 3
    for name, content in id3_frames(data):
        content = _as_apic(bytes(content)) if old and name == "APIC" else bytes(content)
        row = {"key": name, "bytes": len(content) + 10, "v22": old, "text": "", "editable": False}
        about, told = _described(content, {"TXXX": 0, "COMM": 3}[name]) if name in ("TXXX", "COMM") else ("", "")
        if name == "TXXX":
            row |= {"text": told, "editable": True, "value": _clip(f"{about}={told}" if about else told)}
        elif name == "COMM":
            row |= {"text": told, "editable": len(content) >= 4, "value": _clip(f"{about}: {told}" if about else told)}
        elif name in ("PRIV", "UFID"):
            row["value"] = _shown(content.partition(b"\0")[0].decode("utf-8", "replace") if b"\0" in content else "", len(content))
        elif name[0] == "T":
            text = id3_text(content)
            row |= {"text": text, "editable": True, "value": _clip(text)}
        elif name[0] == "W":
            text = content.rstrip(b"\0").decode("utf-8", "replace")
            row |= {"text": "" if name == "WXXX" else text, "editable": name != "WXXX", "value": _clip(text)}
        else:
            row["value"] = f"{len(content)} bytes"
        if about:
            row["key"] = f"{name}:{about}"
        if name == "APIC":
            row["picture"] = id3_picture(content)
        yield row


def _as_apic(c: bytes) -> bytes:
    """A PIC frame of version 2.2, whose three letters name the kind of picture, as an APIC frame."""
    kind = c[1:4].upper()
    mime = {b"JPG": b"image/jpeg", b"JPE": b"image/jpeg", b"-->": b"-->"}.get(kind, b"image/" + kind.lower())
    return c[:1] + mime + b"\0" + c[4:]


def _vorbis_raw(block: bytes) -> Iterator[dict]:
    for key, value, size in _vorbis_fields(block):
        row = {"key": key, "bytes": size, "value": _clip(value), "text": value, "editable": key.upper() != "METADATA_BLOCK_PICTURE"}
        if key == "METADATA_BLOCK_PICTURE":
            try:
                row["picture"] = flac_picture(base64.b64decode(value, validate=True))
            except ValueError:
                pass
        yield row


def _ogg_comments(data: bytes) -> bytes:
    packets, held, at = [], [], 0
    while len(packets) < 2 and data[at : at + 4] == b"OggS" and at + 27 <= len(data):
        sizes = data[at + 27 : at + 27 + data[at + 26]]
        at += 27 + len(sizes)
        for n in sizes:
            if len(packets) < 2:
                held.append(bytes(data[at : at + n]))
                if n < 255:
                    packets.append(b"".join(held))
                    held = []
            at += n
    second = packets[1] if len(packets) > 1 else b""
    return second[8:] if second[:8] == b"OpusTags" else second[7:] if second[1:7] == b"vorbis" else b""


def raw_tags(data: bytes, fallback: str) -> tuple[str, list[dict]]:
    """(format, rows) of everything that a file holds as metadata, in its own keys: key, mean, bytes, value, text, editable, v22, picture.

    value is for reading and clipped, text whole; mean is the namespace of a freeform atom. Of WAV and AIFF files only the pictures
    of an ID3 chunk are looked for; WMA has none. A broken file has what stands before the fault.
    """
    kind, out = sniff(data, fallback), []
    try:
        if kind == "mp3":
            out += _id3_raw(data) if data[:3] == b"ID3" else ()
        elif kind in ("wav", "aiff"):
            for name, body in chunks(data, "little" if kind == "wav" else "big"):
                if name.lower() == b"id3 ":
                    out += (r for r in _id3_raw(body) if r.get("picture"))
        elif kind == "flac":
            for number, block in flac_blocks(data):
                if number == 4:
                    out += _vorbis_raw(block)
                elif number == 6:
                    out.append({"key": "PICTURE", "bytes": len(block) + 4, "value": f"{len(block)} bytes", "text": "", "editable": False, "picture": flac_picture(block)})
        elif kind in ("ogg", "opus"):
            out += _vorbis_raw(_ogg_comments(data))
        elif kind == "mp4":
            for key, item in _items(data):
                parts = [(n, bytes(b)) for n, b in atoms(item)]
                name, mean = (next((b[4:].rstrip(b"\0").decode("utf-8", "replace") for n, b in parts if n == want and len(b) >= 4), "") if key == "----" else "" for want in ("name", "mean"))
                first = next((b for n, b in parts if n == "data" and len(b) >= 8), b"")
                is_text = int.from_bytes(first[1:4]) == 1 and len(first) >= 8
                text = first[8:].decode("utf-8", "replace").strip("\0").strip() if is_text else ""
                out.append({"key": f"----:{name}" if name else key, "mean": mean, "bytes": len(item) + 8, "value": _shown(text, len(first[8:]) or len(item)), "text": text, "editable": is_text, "picture": mp4_picture(item) if key == "covr" else None})
    except (IndexError, struct.error, ValueError):
        pass
    return kind, out


def pictures(data: bytes, fallback: str = "unknown") -> list[tuple[int, str, bytes]]:
    """(kind, MIME, bytes) of the pictures of a file of any format."""
    return [r["picture"] for r in raw_tags(data, fallback)[1] if r.get("picture")]


def cover(found: list[tuple[int, str, bytes]]) -> tuple[int, str, bytes] | None:
    """The front cover, else the first picture."""
    return next((p for p in found if p[0] == 3), found[0] if found else None)
