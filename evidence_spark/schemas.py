"""Declared schemas of the tables the operators exchange."""

from pyspark.sql.types import (
    ArrayType,
    BinaryType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _struct(**fields):
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


UNIFIED = _struct(
    timestamp=DoubleType(), domain=StringType(), data_format=StringType(), src=StringType(),
    dst=StringType(), packet_size=LongType(), frequency=LongType(), protocol=StringType(),
    port=LongType(), is_anomaly=LongType(), cross_domain_flag=LongType(),
    port_anomaly_flag=LongType(), protocol_anomaly_flag=LongType(),
)
BASE_EVENT_COLUMNS = UNIFIED.names[:10]

WORD_LOG = _struct(
    timestamp=DoubleType(), label_octal=StringType(), ssm_bits=StringType(), data_bits=StringType(),
    parity_bit=IntegerType(), raw_hex=StringType(), is_anomaly=IntegerType(),
)

PACKET = _struct(
    source_file=StringType(), packet_index=LongType(), timestamp=DoubleType(), src=StringType(),
    dst=StringType(), packet_size=LongType(), protocol=StringType(), port=LongType(),
)

PACKET_LABELS = _struct(packet_index=LongType(), is_anomaly=IntegerType(), anomaly_type=StringType())

RAW_EVENT = _struct(
    source_file=StringType(), source_type=StringType(), source_offset=LongType(),
    payload=BinaryType(), metadata_json=StringType(),
)

LOG_ENTRY = _struct(
    sequence=LongType(), created_at=StringType(), source_file=StringType(), source_type=StringType(),
    source_offset=LongType(), metadata_json=StringType(), payload=BinaryType(),
    payload_sha256=StringType(), previous_hash=StringType(), entry_hash=StringType(),
    rsa_key_id=StringType(), rsa_signature=StringType(), entry_material_json=StringType(),
)

EVIDENCE = _struct(
    evidence_id=LongType(), recorded_at=StringType(), source_file=StringType(),
    source_offset=LongType(), sequence=LongType(), entry_hash=StringType(),
    ai_artifact_path=StringType(), ai_artifact_row_index=LongType(), ai_result_sha256=StringType(),
    verdict_json=StringType(), model_used=StringType(), anomaly_score=DoubleType(),
    predicted_anomaly=LongType(), severity=StringType(),
)

VERDICT = _struct(
    anomaly_score=DoubleType(), predicted_anomaly=LongType(), severity=StringType(),
    model_used=StringType(), occurred_at=StringType(), data_format=StringType(),
    domain=StringType(), protocol=StringType(), src=StringType(), dst=StringType(),
    src_ip=StringType(), dst_ip=StringType(), label_octal=StringType(),
    anomaly_type=StringType(), port=StringType(), dst_port=StringType(),
    shap_top_features=ArrayType(StringType()), explanation_text=StringType(),
)

ANCHOR = _struct(
    version=LongType(), created_at=StringType(), db_path=StringType(), sequence=LongType(),
    entry_count=LongType(), head_hash=StringType(), recovery_ledger_path=StringType(),
    recovery_ledger_hash=StringType(), previous_anchor_hash=StringType(), rsa_key_id=StringType(),
    signer_provider=StringType(), anchor_hash=StringType(), rsa_signature=StringType(),
)

LIVE_RECORD = _struct(
    source_file=StringType(), source_type=StringType(), source_offset=LongType(),
    payload=StringType(), verdict=StringType(), scenario=StringType(), recorded_at=StringType(),
)

TREE_NODE = StructType(
    [
        StructField("model_group", StringType()),
        StructField("tree", IntegerType()),
        StructField("node", IntegerType()),
        StructField("feature", IntegerType()),
        StructField("threshold", DoubleType()),
        StructField("left", IntegerType()),
        StructField("right", IntegerType()),
        StructField("depth", IntegerType()),
        StructField("n_rows", IntegerType()),
        StructField("sample_rows", IntegerType()),
    ]
)
