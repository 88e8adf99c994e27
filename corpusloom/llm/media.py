"""MPEG audio as media columns: framing, tags, variable-bitrate tables, checksums, exact durations and seek offsets.

`scan` reads one file's bytes. It skips an ID3v2 tag, walks frame headers of MPEG 1, 2 and 2.5, layers I to III, and after a
bad header resynchronises at the next one that is followed by another (or by the end). It checks the CRC-16 of protected
frames, reads a Xing, Info or VBRI table in the first frame, and notes an APEv2 or ID3v1 tag at the end; what looks like one in
frames that reach the end is payload. Durations are whole numbers of samples over the sampling rate, so no rounding builds up
over long files.

`carry` stores a payload losslessly in frames that the walker reads back: MPEG-1 layer III, mono, 48 kHz, 80 kbit/s, 240 bytes
a frame, CRC protected; each frame's main data is one unit of 192 payload bytes (two granules of 768 bits). A first frame
holds the Info table, an ID3v2 tag in front holds the payload's length. The frames are a container, not music.

Null bytes give zero frames and duration; null text is empty text. Bytes without a single frame are counted as `junk_bytes`. Every row
stands for itself: repeated rows give equal results, ties do not occur, very long texts are one file, an empty table gives no rows,
and extra columns, whatever their names, are not read. Frames of free format (bitrate index 0) are junk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import doc_bytes, parts

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index, Hz by index.
KBITS = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
RATES = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}

UNIT = 192  # payload bytes a frame
SEEK_EVERY = 100  # frames between stored seek offsets


def _crc_table() -> np.ndarray:
    table = np.zeros(256, np.uint16)
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = ((value << 1) ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
        table[byte] = value
    return table


CRC = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """The CRC-16 (0x8005, start 0xFFFF) of each row of bytes."""
    value = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        value = (value << np.uint16(8)) ^ CRC[(value >> np.uint16(8)) ^ column]
    return value


def header(word: int) -> tuple[int, int, int, int, int, int, int] | None:
    """(frame bytes, samples, rate, kbit/s, layer, mono, protected) of a 32-bit frame header, or None."""
    if word >> 21 != 0x7FF:
        return None
    version, layer = word >> 19 & 3, 4 - (word >> 17 & 3)
    bits, rate = word >> 12 & 15, word >> 10 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3 or word & 3 == 2:
        return None
    first = version == 3
    kbits = KBITS[(1, layer) if first else (2, min(layer, 2))][bits]
    hz, pad = RATES[version][rate], word >> 9 & 1
    if layer == 1:
        size, samples = (12000 * kbits // hz + pad) * 4, 384
    else:
        samples = 1152 if first or layer == 2 else 576
        size = samples * 125 * kbits // hz + pad
    return size, samples, hz, kbits, layer, int(word >> 6 & 3 == 3), int(not word >> 16 & 1)


def _side_bytes(version_one: bool, mono: int) -> int:
    return (17 if mono else 32) if version_one else (9 if mono else 17)


def _synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def _table(data: bytes, start: int, size: int, side: int) -> dict | None:
    """The Xing, Info or VBRI table of a first frame."""
    frame = data[start : start + size]
    for at in (4 + side, 6 + side):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, at2 = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
            out = {"kind": frame[at : at + 4].decode(), "frames": None, "bytes": None, "toc": None}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], at2 = int.from_bytes(frame[at2 : at2 + 4], "big"), at2 + 4
            if flags & 4:
                out["toc"] = list(frame[at2 : at2 + 100])
            return out
    if frame[36:40] == b"VBRI":
        total, frames, entries, scale, width, _ = (int.from_bytes(frame[a:b], "big") for a, b in ((46, 50), (50, 54), (54, 56), (56, 58), (58, 60), (60, 62)))
        toc = [int.from_bytes(frame[62 + k * width : 62 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": total, "toc": toc}
    return None


def _walk(data: bytes, at: int, end: int) -> tuple:
    """What `scan` gathers from the frames between two offsets; at last, where the frames start that follow each other up to the end."""
    starts, sizes, kinds = [], [], []
    junk = resyncs = samples = 0
    rate, table, table_bytes = None, None, 0
    synced, run = False, end
    while at + 4 <= end:
        found = header(int.from_bytes(data[at : at + 4], "big"))
        size = found[0] if found else 0
        good = found is not None and (rate is None or found[2] == rate) and at + size <= end
        if good and not synced:  # a lone header inside other bytes is no frame
            after = at + size
            good = after + 4 > end or ((x := header(int.from_bytes(data[after : after + 4], "big"))) is not None and x[2] == found[2])
        if not good:
            resyncs += synced
            synced = False
            jump = data.find(b"\xff", at + 1, end)
            jump = end if jump < 0 else jump
            junk, at = junk + jump - at, jump
            continue
        run = run if synced else at
        synced = True
        if rate is None:
            rate = found[2]
            side = _side_bytes(data[at + 1] >> 3 & 3 == 3, found[5])
            table = _table(data, at, size, side)
            if table is not None:
                table_bytes, at = size, at + size
                continue
        starts.append(at)
        sizes.append(size)
        kinds.append(found)
        samples += found[1]
        at += size
    junk += end - at
    return starts, sizes, kinds, samples, rate, table, table_bytes, junk, resyncs, run if synced and at == end else end


def _covered(data: bytes, at: int, end: int, start: int) -> bool:
    """Whether frames that reach the end cover the tag that seems to start here."""
    return _walk(data, at, end)[-1] < start


def scan(data: bytes | None, seek_every: int = SEEK_EVERY) -> dict:
    """Everything the media columns hold about one file; see the module's head."""
    data = b"" if data is None else bytes(data)
    n, at, tags = len(data), 0, []
    while data[at : at + 3] == b"ID3" and at + 10 <= n:
        tags.append(f"ID3v2.{data[at + 3]}")
        at += 10 + _synchsafe(data[at + 6 : at + 10]) + 10 * (data[at + 5] >> 4 & 1)
    end = n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" and not _covered(data, at, end, end - 128):
        tags.append("ID3v1")
        end -= 128
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        flags = int.from_bytes(data[end - 12 : end - 8], "little")
        start = max(at, end - int.from_bytes(data[end - 20 : end - 16], "little") - (32 if flags >> 31 else 0))
        if not _covered(data, at, end, end - 32):
            tags.append("APEv2")
            end = start
    first = min(at, end)
    starts, sizes, kinds, samples, rate, table, table_bytes, junk, resyncs, _ = _walk(data, first, end)
    duration = Fraction(samples, rate) if rate else Fraction(0)
    bad, protected = _verify(data, starts, kinds)
    bitrates = {x[3] for x in kinds}
    return {
        "frames": len(starts),
        "samples": samples,
        "rate": rate or 0,
        "duration_num": duration.numerator,
        "duration_den": duration.denominator,
        "variable": len(bitrates) > 1,
        "protected": protected,
        "bad_crc": bad,
        "junk_bytes": junk,
        "resyncs": int(resyncs),
        "tags": tags,
        "table": table["kind"] if table else None,
        "table_frames": table["frames"] if table else None,
        "toc": table["toc"] if table else None,
        "table_agrees": None if table is None else table["frames"] in (None, len(starts)) and table["bytes"] in (None, sum(sizes) + table_bytes),
        "seek": starts[::seek_every],
        "first": first,
        "starts": starts,
    }


def _verify(data: bytes, starts: list[int], kinds: list[tuple]) -> tuple[int, int]:
    """(frames with a wrong CRC, frames of layers I and III with one). In layer II the protected field's length depends on allocation tables, so it is not judged."""
    where: dict[int, list[int]] = {}
    for start, kind in zip(starts, kinds, strict=True):
        if kind[6] and kind[4] != 2:
            if kind[4] == 3:
                side = _side_bytes(data[start + 1] >> 3 & 3 == 3, kind[5])
            else:  # four bits for each subband and channel; above a bound, joint stereo has one channel
                mode, more = data[start + 3] >> 6, data[start + 3] >> 4 & 3
                side = 16 if mode == 3 else (32 + (4 * (more + 1) if mode == 1 else 32)) // 2
            where.setdefault(side, []).append(start)
    raw, bad = np.frombuffer(data, np.uint8), 0
    for side, at in where.items():
        begin = np.array(at)[:, None]
        rows = raw[np.minimum(np.concatenate([begin + [2, 3], begin + 6 + np.arange(side)], axis=1), len(raw) - 1)]
        stored = raw[begin[:, 0] + 4].astype(np.uint16) << np.uint16(8) | raw[begin[:, 0] + 5]
        bad += int((crc16(rows) != stored).sum())
    return bad, sum(map(len, where.values()))


def _blank_frame() -> np.ndarray:
    """A frame of 240 bytes: header, CRC, side information of two granules with 768 bits each, empty main data."""
    frame = np.zeros(240, np.uint8)
    frame[:4] = [0xFF, 0xFA, 0x64, 0xC0]  # MPEG-1, layer III, protected; 80 kbit/s, 48 kHz; mono
    bits = "0" * 9 + "0" * 5 + "0" * 4  # main_data_begin, private bits, scfsi
    for _ in range(2):
        bits += format(UNIT * 4, "012b") + "0" * 47  # part2_3_length, then the rest of a granule
    frame[6:23] = np.frombuffer(int(bits, 2).to_bytes(17, "big"), np.uint8)
    value = int(crc16(frame[None, np.r_[2:4, 6:23]])[0])
    frame[4:6] = [value >> 8, value & 255]
    return frame


BLANK = _blank_frame()


def carry(payload: bytes) -> bytes:
    """The payload, a positive multiple of 192 bytes, as an MPEG file."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    frames = np.tile(BLANK, (len(units) + 1, 1))
    frames[1:, 23 : 23 + UNIT] = units
    total = frames.size
    table = b"Info" + (7).to_bytes(4, "big") + len(units).to_bytes(4, "big") + total.to_bytes(4, "big")
    table += bytes(min(255, 256 * (240 + (k * len(units) // 100) * 240) // total) for k in range(100))
    frames[0, 23 : 23 + len(table)] = np.frombuffer(table, np.uint8)
    body = b"TXXX" + (12).to_bytes(4, "big") + b"\0\0" + b"\0len\0" + len(payload).to_bytes(7, "big")
    size = len(body)
    head = b"ID3\x03\0\0" + bytes(size >> shift & 127 for shift in (21, 14, 7, 0))
    return head + body + frames.tobytes()


def recover(data: bytes, found: dict) -> bytes:
    """The payload of a file made by `carry`, from the frames that the walker found."""
    raw = np.frombuffer(data, np.uint8)
    starts = np.array(found["starts"], np.int64)
    return raw[starts[:, None] + 23 + np.arange(UNIT)].tobytes() if len(starts) else b""


def pad(text: bytes) -> bytes:
    """Spaces up to a positive multiple of 192 bytes."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Its id column, n_bytes of the text, and media: the padded text in MPEG frames."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [doc_bytes(x.as_py()) for x in batch.column(1)]
            lengths, media = pa.array(map(len, texts), pa.int64()), pa.array([carry(pad(x)) for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, media], [id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_bytes long, media binary")


COLUMNS = (
    "frames long, samples long, rate int, duration_num long, duration_den long, variable boolean, protected long, bad_crc long, junk_bytes long, "
    "resyncs int, tags array<string>, table string, table_frames long, table_agrees boolean, toc array<long>, seek array<long>, payload binary"
)


def probe(files: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",), payload: bool = False, seek_every: int = SEEK_EVERY) -> DataFrame:
    """The kept columns and those of COLUMNS for every media value; payload is null unless asked for."""
    fields = [x.split() for x in COLUMNS.split(", ")]
    arrow = {
        "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
        "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
    }
    kinds = dict(files.dtypes)
    schema = ", ".join([f"`{name}` {kinds[name]}" for name in keep] + [COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            rows = []
            for value in batch.column(len(keep)):
                data = value.as_py()
                found = scan(data, seek_every)
                rows.append(found | {"payload": recover(data or b"", found) if payload else None})
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([row[name] for row in rows], arrow[kind]) for name, kind in fields]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *(name for name, _ in fields)])

    return files.select(*keep, media_col).mapInArrow(run, schema)


def feature_text() -> Column:
    """One line of what the walker found."""
    return F.concat_ws(
        ";",
        F.format_string("frames=%d", "frames"),
        F.format_string("samples=%d", "samples"),
        F.format_string("duration=%d/%d", "duration_num", "duration_den"),
        F.format_string("crc=%d/%d", F.col("protected") - F.col("bad_crc"), F.col("protected")),
        F.concat(F.lit("table="), F.coalesce("table", F.lit("none")), F.when(F.col("table_agrees"), ":agrees").otherwise(":differs")),
        F.format_string("seek=%s", F.array_join(F.transform("seek", lambda x: x.cast("string")), ",")),
    )


def media_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text, reads it back and digests what came back; see the query's contract."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sizes, sums, crcs = [], [], []
            for value in batch.column("payload"):
                data = value.as_py()
                sizes.append(len(data))
                sums.append(hashlib.sha256(data).hexdigest())
                crcs.append(zlib.crc32(data[-16:]))
            kept = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.array(crcs, pa.int64())],
                [*batch.schema.names[:5], "payload_bytes", "payload_sha256", "tail_crc32"],
            )

    kind = dict(docs.select(id_col).dtypes)[id_col]
    media = store(docs, id_col, text_col).select(
        id_col, "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media"
    )
    read = probe(media, keep=(id_col, "n_bytes", "media_bytes", "media_sha256"), payload=True)
    read = read.select(id_col, "n_bytes", "media_bytes", "media_sha256", feature_text().alias("feature"), "payload")
    schema = f"{id_col} {kind}, n_bytes long, media_bytes long, media_sha256 string, feature string, payload_bytes long, payload_sha256 string, tail_crc32 long"
    return read.mapInArrow(digests, schema).select(
        id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )
