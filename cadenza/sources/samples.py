"""Small audio files made from rows by tasks, to try scans on: a head with tags, and a moment of silence."""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import dirname
from .files import dealt, place

#: What a file is made of; art is PNG bytes, or null.
SAMPLE = "path string, format string, title string, artist string, genre string, year int, track int, mood string, gapless string, art binary"
#: An MPEG frame of 128 kbit/s at 44.1 kHz.
SILENCE = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)


def _id3(r: dict) -> bytes:
    text = lambda x: b"\3" + x.encode()
    frames = [("TIT2", text(r["title"])), ("TPE1", text(r["artist"])), ("TCON", text(r["genre"])), ("TYER", text(str(r["year"]))), ("TRCK", text(str(r["track"])))]
    frames += [("TXXX", text(f"Mood\0{r['mood']}")), ("COMM", b"\3eng" + f"iTunSMPB\0{r['gapless']}".encode())]
    if r["art"] is not None:
        frames.append(("APIC", b"\0image/png\0\3\0" + r["art"]))
    body = b"".join(k.encode() + len(v).to_bytes(4) + b"\0\0" + v for k, v in frames)
    return b"ID3\3\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body


def _block(r: dict) -> bytes:
    """A picture as FLAC has it."""
    return (3).to_bytes(4) + (9).to_bytes(4) + b"image/png" + bytes(20) + len(r["art"]).to_bytes(4) + r["art"]


def _comments(r: dict, more: list[tuple[str, str]] = ()) -> bytes:
    fields = [("TITLE", r["title"]), ("ARTIST", r["artist"]), ("GENRE", r["genre"]), ("DATE", str(r["year"])), ("TRACKNUMBER", str(r["track"])), ("MOOD", r["mood"]), ("ITUNSMPB", r["gapless"]), *more]
    items = [f"{k}={v}".encode() for k, v in fields]
    return bytes(4) + struct.pack("<I", len(items)) + b"".join(struct.pack("<I", len(x)) + x for x in items)


def _flac(r: dict) -> bytes:
    info = bytes(10) + (44100 << 44 | 1 << 41 | 15 << 36 | 88200).to_bytes(8) + bytes(16)
    blocks = [(0, info), (4, _comments(r))] + ([(6, _block(r))] if r["art"] is not None else [])
    return b"fLaC" + b"".join(bytes([kind | 128 * (n == len(blocks) - 1)]) + len(b).to_bytes(3) + b for n, (kind, b) in enumerate(blocks))


def _opus(r: dict) -> bytes:
    packets = [b"OpusHead\1\2" + bytes(9), b"OpusTags" + _comments(r, [("METADATA_BLOCK_PICTURE", base64.b64encode(_block(r)).decode())] if r["art"] is not None else [])]
    out = []
    for n, p in enumerate(packets):  # pages of up to 255 segments
        sizes = [255] * (len(p) // 255) + [len(p) % 255]
        for k in range(0, len(sizes), 255):
            own = sizes[k : k + 255]
            out.append(b"OggS\0\0" + struct.pack("<q", n * 96000) + bytes(12) + bytes([len(own)]) + bytes(own) + p[255 * k : 255 * k + sum(own)])
    return b"".join(out)


def _atom(name: bytes, *body: bytes) -> bytes:
    return (8 + sum(map(len, body))).to_bytes(4) + name + b"".join(body)


def _mp4(r: dict) -> bytes:
    data = lambda kind, v: _atom(b"data", kind.to_bytes(4), bytes(4), v)
    items = [_atom(k, data(1, v.encode())) for k, v in ((b"\xa9nam", r["title"]), (b"\xa9ART", r["artist"]), (b"\xa9gen", r["genre"]), (b"\xa9day", str(r["year"])))]
    items += [_atom(b"trkn", data(0, bytes(2) + r["track"].to_bytes(2) + bytes(4))), _atom(b"----", _atom(b"mean", bytes(4), b"com.apple.iTunes"), _atom(b"name", bytes(4), b"iTunSMPB"), data(1, r["gapless"].encode()))]
    items += [_atom(b"covr", data(14, r["art"]))] if r["art"] is not None else []
    head = _atom(b"mvhd", bytes(12), (1000).to_bytes(4), (2000).to_bytes(4), bytes(80))
    return _atom(b"ftyp", b"M4A ") + _atom(b"moov", head, _atom(b"udta", _atom(b"meta", bytes(4), _atom(b"ilst", *items))))


_MAKE = {"mp3": lambda r: _id3(r) + SILENCE * 3, "flac": _flac, "opus": _opus, "mp4": _mp4}


def write_files(rows: DataFrame) -> int:
    """Write the file of each row (SAMPLE) under its path; how many there are. A task that is run again writes the same bytes again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, made = 0, set()
        for batch in batches:
            for r in batch.to_pylist():
                fs, path = place(r["path"])
                folder = path.rpartition("/")[0]
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(path) as f:
                    f.write(_MAKE[r["format"]](r))
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    names = [x.split()[0] for x in SAMPLE.split(", ")]
    return dealt(rows.select(*names)).mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first().n or 0


def remove_files(rows: DataFrame) -> int:
    """Delete the folders that hold the files of rows (path), by tasks, with all that is in them; how many there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                fs, path = place(folder)
                if fs.get_file_info(path).type == pyarrow.fs.FileType.Directory:
                    fs.delete_dir(path)
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    folders = rows.select(dirname(F.col("path")).alias("folder")).distinct()
    return dealt(folders, "folder").mapInArrow(run, "n long").agg(F.sum("n").alias("n")).first().n or 0
