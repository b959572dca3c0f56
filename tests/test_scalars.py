from pyspark.sql import functions as F

from evidence_spark.functions import crypto, scalars, text


def one(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("r")).collect()]


def test_severity_bounds_are_strict(spark):
    rows = [(-0.1001,), (-0.1,), (-0.0001,), (0.0,), (0.0499,), (0.05,), (None,)]
    got = one(spark, rows, "s double", scalars.severity_band(F.col("s")))
    assert got == ["HIGH", "MEDIUM", "MEDIUM", "LOW", "LOW", "NONE", None]


def test_parity_counts_all_32_bits(spark):
    words = [("00000000",), ("80000000",), ("0x80000001",), ("FFFFFFFF",), ("0x1FFFFFFFF",)]
    assert one(spark, words, "w string", scalars.parity_valid(F.col("w"))) == [0, 1, 0, 0, 0]


def test_port_policy_precedence(spark):
    rows = [("maintenance", 22), ("cabin", 22), ("afdx", 6999), ("afdx", 7000), ("afdx", 8000), ("afdx", 8001), ("elsewhere", 80)]
    assert one(spark, rows, "d string, p int", scalars.port_flag(F.col("d"), F.col("p"))) == [0, 1, 1, 0, 0, 1, 1]


def test_bad_addresses_have_no_domain(spark):
    rows = [("",), ("999.1.1.1",), ("10.0.1",), ("::1",), (None,), ("010.0.0.1",), ("10.0.255.1",), ("10.1.0.1",), ("192.168.2.7",)]
    assert one(spark, rows, "a string", scalars.ip_domain(F.col("a"))) == [None] * 6 + ["afdx", None, "maintenance"]


def test_flags_are_zero_for_words(spark):
    df = spark.createDataFrame([("PCAP", "192.168.1.1", "10.0.0.1", "cabin", 22, "ICMP"), ("ARINC429", "203", "BUS_A", "avionics", 0, "ARINC429")],
                               "data_format string, src string, dst string, domain string, port int, protocol string")
    got = scalars.security_flags(df).select("cross_domain_flag", "port_anomaly_flag", "protocol_anomaly_flag").collect()
    assert [tuple(r) for r in got] == [(1, 1, 1), (0, 0, 0)]


def test_missing_score_lifts_risk(spark):
    rows = [(None, "NORMAL"), (0.05, "NONE"), (0.5, "LOW"), (2.0, "INFO"), (-0.3, None), (None, "CRITICAL")]
    assert one(spark, rows, "s double, v string", scalars.risk_score(F.col("s"), F.col("v"))) == [0.55, 0.35, 0.5, 0.25, 1.0, 1.0]


def test_text_rules(spark):
    rows = [("tcp/ip scan_now",)]
    assert one(spark, rows, "t string", scalars.title_case(F.col("t"))) == ["Tcp/Ip Scan_Now"]
    assert one(spark, [("  Ab__c! ",), ("!!",), (None,)], "t string", scalars.slug("node", F.col("t"))) == ["node-ab-c", "node-unknown", "node-unknown"]
    assert one(spark, [("x" * 24,), ("x" * 25,)], "t string", scalars.short_label(F.col("t"))) == ["x" * 24, "x" * 23 + "."]
    assert one(spark, [("see [10.0.7.9]; ok",), ("1.2.3",)], "t string", scalars.ip_from_text(F.col("t"))) == ["10.0.7.9", None]
    assert one(spark, [("a/./b/../c.csv",), ("/x//y",), ("live://z",)], "t string", scalars.canonical_source(F.col("t"), "/Root")) == ["/root/a/c.csv", "/x/y", "live://z"]


def test_times(spark):
    rows = [("2024-01-01T00:00:01Z",), ("2024-01-01T00:00:01",), ("2024-01-01T02:00:01+02:00",), ("soon",)]
    got = one(spark, rows, "t string", F.unix_micros(scalars.parse_time(F.col("t"))))
    assert got == [1704067201000000] * 3 + [None]
    assert one(spark, [("1704067201",), ("1704067201000",), ("2024-01-01T00:00:01Z",)], "t string", scalars.epoch_millis(F.col("t"))) == [1704067201000.0] * 3


def test_questions(spark):
    rows = [("Show seq #12 and sequence 7, #12",), ("rows 44 and 5 and 1234567",), ("",)]
    got = one(spark, rows, "t string", F.transform(text.extract_sequences(F.col("t")), lambda v: v.cast("int")))
    assert got == [[12, 7], [44], []]
    rows = [("hello bb",), ("Which attack path?",), ("thanks, you ok",), ("is the chain fine",), ("weather",), ("  ",), ("seq 4",)]
    assert one(spark, rows, "t string", text.route_question(F.col("t"))) == ["small_talk", "attack_path", "small_talk", "guidance", "other", "empty", "sequence"]


def test_redaction(spark):
    rows = [({"payload_sha256": "x", "api_key": "y", "keyboard": "z", "note": "a" * 32},)]
    assert one(spark, rows, "m map<string,string>", text.redact_map(F.col("m"))) == [{"keyboard": "z", "note": "[redacted]"}]


def test_payload_text_falls_back_to_hex(spark):
    rows = [(bytearray(b"ok"),), (bytearray(b"\xff\xfe"),)]
    assert one(spark, rows, "b binary", crypto.payload_text(F.col("b"))) == ["ok", "fffe"]


def _is_prime(n):
    return all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7, 11, 13))


def test_signatures(spark):
    import base64
    import hashlib

    def prime(start):
        n = start | 1
        while not _is_prime(n):
            n += 2
        return n

    p, q, e = prime(1 << 600), prime((1 << 601) + 12345), 65537
    n, d = p * q, pow(e, -1, (p - 1) * (q - 1))
    width = (n.bit_length() + 7) // 8
    digest = hashlib.sha256(b"row").hexdigest()
    info = crypto.DIGEST_INFO_PREFIX + bytes.fromhex(digest)
    block = b"\x00\x01" + b"\xff" * (width - len(info) - 3) + b"\x00" + info
    good = base64.b64encode(pow(int.from_bytes(block, "big"), d, n).to_bytes(width, "big")).decode()
    old = base64.b64encode(pow(int(digest, 16), d, n).to_bytes(width, "big")).decode()
    other = hashlib.sha256(b"other").hexdigest()
    rows = [(digest, good), (other, good), (digest, old), (digest, "###"), (None, good), ("zz", good)]
    df = spark.createDataFrame(rows, "h string, s string")
    got = [r[0] for r in df.select(crypto.signature_valid(F.col("h"), F.col("s"), n, e)).collect()]
    assert got == [True, False, True, False, False, False]
    strict = [r[0] for r in df.select(crypto.signature_valid(F.col("h"), F.col("s"), n, e, accept_textbook=False)).collect()]
    assert strict == [True, False, False, False, False, False]
