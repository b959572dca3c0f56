import json
import struct

from pyspark.sql import functions as F

from evidence_spark import schemas
from evidence_spark.operators import joins
from evidence_spark.sources import captures, files, sinks


def ip_frame(protocol, body, src=(192, 168, 1, 5), dst=(10, 0, 0, 9)):
    header = struct.pack(">BBHHHBBH4B4B", 0x45, 0, 20 + len(body), 1, 0, 64, protocol, 0, *src, *dst)
    return b"\xaa" * 12 + b"\x08\x00" + header + body


def capture(frames, order="<"):
    magic = 0xA1B2C3D4
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 1)
    for i, frame in enumerate(frames):
        out += struct.pack(order + "IIII", 1704067200 + i, 250000, len(frame), len(frame)) + frame
    return out


TCP = struct.pack(">HHIIBBHHH", 1234, 443, 0, 0, 5 << 4, 0, 0, 0, 0)
UDP = struct.pack(">HHHH", 999, 7100, 13, 0)


def test_captures_decode(spark, tmp_path):
    arp = b"\xbb" * 12 + b"\x08\x06" + b"\x00" * 28
    frames = [ip_frame(6, TCP + b"hello"), arp, ip_frame(17, UDP + b"12345"), ip_frame(1, b"\x08\x00" + b"\x00" * 6 + b"ping")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.pcap").write_bytes(capture(frames))
    (tmp_path / "y.pcap").write_bytes(capture(frames[:1], ">") + b"\x01")
    packets = captures.read_captures(spark, str(tmp_path), "cabin")
    got = sorted((r.source_file.rsplit("/", 1)[1], r.packet_index, r.src, r.dst, r.packet_size, r.protocol, r.port) for r in packets.collect())
    a, b = "192.168.1.5", "10.0.0.9"
    assert got == [("x.pcap", 0, a, b, 5, "TCP", 443), ("x.pcap", 2, a, b, 5, "UDP", 7100), ("x.pcap", 3, a, b, 4, "ICMP", 0), ("y.pcap", 0, a, b, 5, "TCP", 443)]
    (tmp_path / "a" / "x_labels.csv").write_text("packet_index,is_anomaly,anomaly_type\n2,1,scan\n2,0,none\n")
    (tmp_path / "y_labels.csv").write_text("packet_index,is_anomaly,anomaly_type\n0,1,scan\n")
    labels = files.read_labels(spark, [str(tmp_path / "a" / "x_labels.csv"), str(tmp_path / "y_labels.csv")])
    both = joins.attach_labels(packets, labels)
    assert sorted((r.source_file[-6:], r.packet_index) for r in both.filter("is_anomaly = 1").collect()) == [("x.pcap", 2), ("y.pcap", 0)] and both.count() == 4
    unified = captures.captures_to_unified(packets.filter(F.col("source_file").endswith("x.pcap")), labels)
    assert sorted((r.protocol, r.is_anomaly, r.frequency) for r in unified.collect()) == [("ICMP", 0, 1), ("TCP", 0, 0), ("UDP", 1, 0)]


def test_word_log(spark, tmp_path):
    lines = ["timestamp,label_octal,ssm_bits,data_bits,parity_bit,raw_hex,is_anomaly"]
    lines += [f"{1704067200 + i * 0.4:.1f},206,11,{i:019b},1,0x{i:08X},0" for i in range(10)]
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n")
    words = files.read_word_log(spark, str(tmp_path / "w.csv")).orderBy("source_offset").collect()
    assert [r.source_offset for r in words] == list(range(10)) and words[3].ssm_bits == "11"
    unified = files.read_words_unified(spark, str(tmp_path / "w.csv")).orderBy("timestamp").collect()
    assert [r.frequency for r in unified] == [1, 2] + [3] * 8 and unified[0].packet_size == 3 and unified[0].dst == "BUS_A"


def test_row_events_and_chunks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("b,a\nx,1\ny,\n")
    (tmp_path / "blob.bin").write_bytes(bytes(range(256)) * 3)
    rows = files.read_row_events(spark, str(tmp_path)).orderBy("source_offset").collect()
    assert [json.loads(bytes(r.payload)) for r in rows] == [{"a": "1", "b": "x"}, {"a": "", "b": "y"}]
    assert json.loads(rows[1].metadata_json) == {"columns": ["b", "a"], "ingest_mode": "csv_row", "row_index": 1}
    chunks = files.read_chunks(spark, str(tmp_path / "blob.bin"), 500).orderBy("source_offset").collect()
    assert [len(r.payload) for r in chunks] == [500, 268] and chunks[0].source_type == "BIN"
    assert files.read_raw_events(spark, str(tmp_path)).count() == 3
    assert files.list_files(spark, str(tmp_path)).count() == 2


def test_files_keep_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("p,q,r\n3,4,5\n6,7,8\n")
    (tmp_path / "c.csv").write_text("y,x\n9,0\n")
    (tmp_path / "empty.csv").write_text("")
    rows = files.read_row_events(spark, str(tmp_path))
    got = sorted((r.source_file[-5:], r.source_offset, bytes(r.payload).decode()) for r in rows.collect())
    assert got == [("a.csv", 0, '{"x":"1","y":"2"}'), ("b.csv", 0, '{"p":"3","q":"4","r":"5"}'), ("b.csv", 1, '{"p":"6","q":"7","r":"8"}'), ("c.csv", 0, '{"x":"0","y":"9"}')]
    (tmp_path / "d.csv").write_text('x,y\n"a\nb",2\n')
    whole = files.read_row_events(spark, str(tmp_path / "d.csv"), multiline=True).collect()
    assert [json.loads(bytes(r.payload)) for r in whole] == [{"x": "a\nb", "y": "2"}]


def test_offsets_across_splits(spark, tmp_path):
    (tmp_path / "big.csv").write_text("n\n" + "".join(f"{i:06d}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_row_events(spark, str(tmp_path / "big.csv"))
        assert all(int(json.loads(bytes(r.payload))["n"]) == r.source_offset for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ledger_roundtrip_and_documents(spark, tmp_path):
    ledger = spark.createDataFrame([(1, None, "h")], "sequence long, created_at string, anchor_hash string")
    sinks.append_ledger(ledger, str(tmp_path / "ledger"))
    sinks.append_ledger(ledger, str(tmp_path / "ledger"))
    assert files.read_ledger(spark, str(tmp_path / "ledger"), schemas.ANCHOR).filter("anchor_hash = 'h'").count() == 2
    (tmp_path / "docs").mkdir()
    words = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(60))
    (tmp_path / "docs" / "good.txt").write_text(words)
    (tmp_path / "docs" / "bad.txt").write_text("%PDF-1.4 obj")
    got = {r.name: (r.text_available, r.context_status) for r in files.read_documents(spark, str(tmp_path / "docs")).collect()}
    assert got["good.txt"][0] and not got["bad.txt"][0]


def nested_capture(r, packets, order="<"):
    """Packets of any size, some of which carry captures themselves."""
    frames = []
    for _ in range(packets):
        kind = r.random()
        if kind < 0.3:
            body = capture([ip_frame(17, UDP + bytes(r.randrange(9))) for _ in range(r.randint(1, 30))], order)
        else:
            body = bytes(r.randrange(256) for _ in range(r.choice([0, 5, 40, 3000])))
        frames.append(ip_frame(6, TCP + body) if kind < 0.8 else b"\xbb" * 12 + b"\x08\x06" + body)
    return capture(frames, order)


def test_capture_ranges_give_the_rows_of_whole_files(spark, tmp_path):
    import random

    r = random.Random(2)
    (tmp_path / "plain.pcap").write_bytes(nested_capture(r, 60))
    (tmp_path / "swapped.pcap").write_bytes(nested_capture(r, 40, ">"))
    (tmp_path / "cut.pcap").write_bytes(nested_capture(r, 30)[:-7])
    broken = bytearray(nested_capture(r, 20))
    broken[24 + 8:24 + 12] = b"\xff\xff\x00\x00"  # a length that leads out of step
    (tmp_path / "broken.pcap").write_bytes(broken)
    (tmp_path / "none.pcap").write_bytes(b"no capture at all" * 200)
    (tmp_path / "empty.pcap").write_bytes(b"")
    (tmp_path / "short.pcap").write_bytes(capture([])[:20])
    whole = sorted(map(tuple, captures.read_captures(spark, str(tmp_path), range_bytes=None).collect()))
    for size in (500, 4096):
        assert sorted(map(tuple, captures.read_captures(spark, str(tmp_path), range_bytes=size).collect())) == whole
    assert len(whole) > 80


def test_large_files_are_planned_in_ranges(spark, tmp_path):
    from evidence_spark.sources import ranges

    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(3 << 30)
    planned = ranges.file_ranges(spark, str(tmp_path)).collect()
    assert len(planned) == 48 and sum(p.stop - p.start for p in planned) == 3 << 30
    chunks = files.read_chunks(spark, str(tmp_path / "large.bin"), 1 << 20)
    assert chunks.filter("source_offset = 3071").select(F.octet_length("payload")).first()[0] == 1 << 20


def test_chunks_of_any_length(spark, tmp_path):
    for n in (0, 1, 499, 500, 501, 5000, 7777):
        (tmp_path / f"f{n}").write_bytes(bytes(i * 7 % 251 for i in range(n)))
    rows = files.read_chunks(spark, str(tmp_path), 500, range_bytes=1200).collect()
    parts = {}
    for row in sorted(rows, key=lambda x: (x.source_file, x.source_offset)):
        assert json.loads(row.metadata_json) == {"chunk_index": row.source_offset, "chunk_size": len(row.payload), "ingest_mode": "binary_chunk"}
        parts[row.source_file.rsplit("/", 1)[1]] = parts.get(row.source_file.rsplit("/", 1)[1], b"") + bytes(row.payload)
    assert parts == {f"f{n}": bytes(i * 7 % 251 for i in range(n)) for n in (1, 499, 500, 501, 5000, 7777)}
