"""Packet captures, read in byte ranges: one row per IPv4 packet."""

from __future__ import annotations

import re
import struct
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_spark import policy, schemas
from evidence_spark.operators.joins import attach_labels
from evidence_spark.operators.ordered import arrival_rate
from evidence_spark.session import scratch_table
from evidence_spark.sources import ranges
from evidence_spark.sources.files import FILE_SCHEME, source_path

# fixed values: file magics (byte order, time unit), link and protocol numbers
MAGICS = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e6),
    b"\xa1\xb2\xc3\xd4": (">", 1e6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e9),
    b"\xa1\xb2\x3c\x4d": (">", 1e9),
}
ETHERNET, RAW_IP, ALT_RAW_IP, LINUX_COOKED = 1, 101, 12, 113
IPV4, VLAN_TAGS = 0x0800, (0x8100, 0x88A8)
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP"}


def _network_start(link: int, frame: bytes) -> int | None:
    """Offset of the IPv4 header, None when the frame carries something else."""
    if link in (RAW_IP, ALT_RAW_IP):
        at = 0
    elif link == LINUX_COOKED:
        if len(frame) < 16 or struct.unpack_from(">H", frame, 14)[0] != IPV4:
            return None
        at = 16
    elif link == ETHERNET:
        at, kind = 14, struct.unpack_from(">H", frame, 12)[0] if len(frame) >= 14 else 0
        while kind in VLAN_TAGS and len(frame) >= at + 4:
            kind = struct.unpack_from(">H", frame, at + 2)[0]
            at += 4
        if kind != IPV4:
            return None
    else:
        return None
    return at if len(frame) >= at + 20 and frame[at] >> 4 == 4 else None


def _packet(link: int, frame: bytes):
    """(src, dst, payload bytes, protocol, destination port) of an IPv4 frame."""
    at = _network_start(link, frame)
    if at is None:
        return None
    header = (frame[at] & 0x0F) * 4
    total = struct.unpack_from(">H", frame, at + 2)[0] or len(frame) - at
    fragment = struct.unpack_from(">H", frame, at + 6)[0] & 0x1FFF
    src, dst = (".".join(str(b) for b in frame[at + i:at + i + 4]) for i in (12, 16))
    body = frame[at + header:at + total]
    protocol = PROTOCOLS.get(frame[at + 9], "OTHER") if fragment == 0 else "OTHER"
    port, skip = 0, 0
    if protocol == "TCP" and len(body) >= 20:
        port, skip = struct.unpack_from(">H", body, 2)[0], (body[12] >> 4) * 4
    elif protocol == "UDP" and len(body) >= 8:
        port, skip = struct.unpack_from(">H", body, 2)[0], 8
    elif protocol == "ICMP" and len(body) >= 8:
        skip = 8
    return src, dst, max(len(body) - skip, 0), protocol, port


def decode_capture(content: bytes):
    """Packets of one capture as (index, time, src, dst, size, protocol, port)."""
    if content[:4] not in MAGICS or len(content) < 24:
        return
    order, unit = MAGICS[content[:4]]
    link = struct.unpack_from(order + "I", content, 20)[0] & 0x0FFFFFFF
    at, index = 24, 0
    while at + 16 <= len(content):
        seconds, fraction, kept, _ = struct.unpack_from(order + "IIII", content, at)
        frame = content[at + 16:at + 16 + kept]
        if len(frame) < kept:
            return
        found = _packet(link, frame)
        if found is not None:
            yield (index, seconds + fraction / unit, *found)
        at += 16 + kept
        index += 1


def _decode_batches(batches):
    names = schemas.PACKET.names
    for files in batches:
        for path, content in zip(files["source_file"], files["content"]):
            packets = ((path, *packet) for packet in decode_capture(bytes(content)))
            # a long capture leaves in pieces, so its rows are never held all at once
            while rows := list(islice(packets, 50_000)):
                yield pd.DataFrame(rows, columns=names)


def read_captures(spark: SparkSession, path: str, domain: str | None = None, glob: str = "*.pcap", range_bytes: int | None = ranges.RANGE_BYTES) -> DataFrame:
    """One row per IPv4 packet of every capture below ``path``. Packets that carry no
    IPv4 are skipped but still counted in ``packet_index``.

    A capture is read in ranges of ``range_bytes``, so its size is no limit and one long file
    is the work of many tasks. ``range_bytes=None`` takes each file (below 2 GiB) as one row,
    for stores that only Spark can open. Both give the same rows.
    """
    if range_bytes is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
        packets = files.select(source_path(F.col("path")).alias("source_file"), "content").mapInPandas(_decode_batches, schemas.PACKET)
    else:
        packets = _decode_ranges(_bounded_ranges(ranges.file_ranges(spark, path, range_bytes, glob)))
    return packets.withColumn("domain", F.lit(domain).cast("string"))


# --- byte ranges ----------------------------------------------------------------------------------

HEADER, RECORD = 24, 16
#: Record headers in a row that must be plausible where a range looks for its first record, and
#: the longest record that is plausible.
CHAIN, LONGEST = 8, 1 << 18
_SCAN = "path string, length long, range int, start long, stop long, first long, after long, records long"


def _file_header(source) -> tuple[str, float, int] | None:
    """(byte order, time unit, link type) of an open capture; None when it is none."""
    source.seek(0)
    head = source.read(HEADER)
    if head[:4] not in MAGICS or len(head) < HEADER:
        return None
    order, unit = MAGICS[head[:4]]
    return order, unit, struct.unpack_from(order + "I", head, 20)[0] & 0x0FFFFFFF


def _plausible(block: np.ndarray, order: str, unit: float) -> np.ndarray:
    """Offsets in ``block`` at which a record header may stand."""
    n = len(block) - RECORD + 1
    if n <= 0:
        return np.zeros(0, int)
    weights = (0, 8, 16, 24) if order == "<" else (24, 16, 8, 0)
    number = lambda at: sum(block[at + i:at + i + n].astype(np.uint32) << np.uint32(w) for i, w in enumerate(weights))
    kept = number(8)
    return np.flatnonzero((number(4) < unit) & (kept <= LONGEST) & (kept <= number(12)))


def _first_record(source, start: int, stop: int, length: int, order: str, unit: float) -> int | None:
    """Where in [start, stop) a chain of plausible headers begins that reaches ``CHAIN`` records or
    the end of the file."""
    for at in range(start, stop, 1 << 20):
        source.seek(at)
        block = np.frombuffer(source.read(min(1 << 20, stop - at) + RECORD - 1), np.uint8)
        for offset in _plausible(block, order, unit).tolist():
            here = at + offset
            for _ in range(CHAIN):
                source.seek(here)
                head = source.read(RECORD)
                if len(head) < RECORD:
                    break
                _, fraction, kept, whole = struct.unpack(order + "IIII", head)
                if fraction >= unit or kept > LONGEST or kept > whole:
                    here = -1
                    break
                here += RECORD + kept
            if here >= 0 and at + offset < stop:
                return at + offset
    return None


class _Blocks:
    """Bytes of an open file from front to back, fetched in blocks."""

    def __init__(self, source, block: int = 1 << 20):
        self.source, self.block, self.at, self.held = source, block, 0, b""

    def bytes(self, at: int, size: int) -> bytes:
        if not self.at <= at or at + size > self.at + len(self.held):
            self.source.seek(at)
            self.at, self.held = at, self.source.read(max(size, self.block))
        return self.held[at - self.at:at - self.at + size]


def _scan_ranges(batches):
    """For each range its first record, where the first record after it stands, and how many
    records begin in it. A range with ``first`` given starts there, others look for it."""
    for rows in batches:
        out = []
        for path, length, number, start, stop, first in rows[["path", "length", "range", "start", "stop", "first"]].itertuples(index=False):
            with ranges.opened(path) as source:
                header = _file_header(source)
                if header is None:
                    out.append((path, length, number, start, stop, start, length, 0))
                    continue
                order, unit, _ = header
                at = HEADER if number == 0 else _first_record(source, start, stop, length, order, unit) if pd.isna(first) else int(first)
                begin, count, blocks = at, 0, _Blocks(source)
                while at is not None and at < stop:
                    head = blocks.bytes(at, RECORD)
                    if len(head) < RECORD or at + RECORD + (kept := struct.unpack_from(order + "I", head, 8)[0]) > length:
                        at = length  # a record cut short ends the capture
                        break
                    at += RECORD + kept
                    count += 1
                out.append((path, length, number, start, stop, begin, at, count))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _SCAN.split(", ")])


def _checked(key, scanned: pd.DataFrame) -> pd.DataFrame:
    """Ranges of one file: each must begin where the one before it ended. ``wrong`` ones are to be
    scanned again from ``first``; the first range of a file is always right."""
    scanned = scanned.sort_values("range", ignore_index=True)
    expected, wrong = HEADER, []
    for i, row in enumerate(scanned.itertuples()):
        if row.range == 0:
            expected = max(row.after, HEADER)
            wrong.append(False)
        elif expected >= row.stop:  # no record begins in this range
            scanned.loc[i, ["first", "after", "records"]] = expected, expected, 0
            wrong.append(False)
        else:
            wrong.append(pd.isna(row.first) or row.first != expected)
            scanned.loc[i, "first"] = expected
            expected = expected if pd.isna(row.after) else int(row.after)
    return scanned.assign(wrong=wrong, before=scanned["records"].cumsum() - scanned["records"]).astype({"first": "Int64", "after": "Int64"})


def _bounded_ranges(planned: DataFrame) -> DataFrame:
    """(path, length, range, start, stop, first, after, records, before) with true record
    boundaries; ``before`` counts the records of the file in front of the range.

    A boundary found inside a file may be a record of a capture that some packet carries. So it
    must be where the range before it ends; ranges for which it is not are scanned again from
    there, until all fit. What is grouped by file is one row for each range.
    """
    schema = f"{_SCAN}, wrong boolean, before long"
    scan = lambda rows: ranges.one_task_each(rows).mapInPandas(_scan_ranges, _SCAN)
    scanned = scratch_table(scan(planned.withColumn("first", F.lit(None).cast("long"))), "capture-scan")
    while True:
        checked = scratch_table(scanned.groupBy("path").applyInPandas(_checked, schema), "capture-ranges")
        wrong = checked.filter("wrong")
        if wrong.isEmpty():
            return checked.drop("wrong")
        again = scan(wrong.select("path", "length", "range", "start", "stop", "first"))
        scanned = scratch_table(checked.filter("NOT wrong").drop("wrong", "before").unionByName(again), "capture-scan")


def _packets_of(path: str, first: int, after: int, index: int):
    with ranges.opened(path) as source:
        order, unit, link = _file_header(source)
        blocks, at = _Blocks(source), first
        while at < after:
            head = blocks.bytes(at, RECORD)
            if len(head) < RECORD:
                return
            seconds, fraction, kept, _ = struct.unpack(order + "IIII", head)
            frame = blocks.bytes(at + RECORD, kept)
            if len(frame) < kept:
                return
            found = _packet(link, frame)
            if found is not None:
                yield (index, seconds + fraction / unit, *found)
            at += RECORD + kept
            index += 1


def _decode_ranges(bounded: DataFrame) -> DataFrame:
    names = schemas.PACKET.names

    def run(batches):
        for rows in batches:
            for path, first, after, before in rows[["path", "first", "after", "before"]].itertuples(index=False):
                shown = re.sub(FILE_SCHEME, "/", path)
                packets = ((shown, *packet) for packet in _packets_of(path, int(first), int(after), int(before)))
                while rows_ := list(islice(packets, 50_000)):
                    yield pd.DataFrame(rows_, columns=names)

    return ranges.one_task_each(bounded.filter("records > 0").select("path", "range", "first", "after", "before")).mapInPandas(run, schemas.PACKET)


def captures_to_unified(packets: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled packets in the unified shape with their arrival rate per domain."""
    labelled = attach_labels(packets, labels)
    timed = labelled.withColumns(
        {"_us": F.round(F.col("timestamp") * 1e6).cast("bigint"), "_tie": F.concat_ws("#", "source_file", F.lpad(F.col("packet_index").cast("string"), 12, "0"))}
    )
    rated = arrival_rate(timed, "domain", "_us", "_tie")
    return rated.withColumns({"data_format": F.lit(policy.PACKET_FORMAT), "frequency": F.col("frequency").cast("bigint")}).select(*schemas.BASE_EVENT_COLUMNS)
