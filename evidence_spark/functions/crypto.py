"""Hashing, encoding, payload encryption and signature checks."""

from __future__ import annotations

import base64
import binascii
from hashlib import sha256 as _sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from evidence_spark import policy

# fixed value: DER prefix of a SHA-256 digest in a PKCS#1 v1.5 signature
DIGEST_INFO_PREFIX = bytes.fromhex("3031300d060960864801650304020105000420")


def canonical(fields: dict[str, Column]) -> Column:
    """Compact JSON of the given fields, keys in sorted order, nulls kept."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def digest(column: Column) -> Column:
    """SHA-256 as lower-case hex, of text or bytes."""
    return F.sha2(column, 256)


def b64(column: Column) -> Column:
    return F.replace(F.replace(F.base64(column), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))


def unb64(column: Column) -> Column:
    return F.unbase64(column)


def payload_text(column: Column) -> Column:
    """UTF-8 text when the bytes are valid, lower-case hex otherwise."""
    return F.coalesce(F.try_validate_utf8(column.cast("string")), F.lower(F.hex(column)))


def associated_data(source_file: Column, source_type: Column, source_offset: Column, metadata: Column) -> Column:
    """Text that is authenticated together with the ciphertext. ``metadata`` is JSON
    text and is embedded as it is."""
    head = F.to_json(F.struct(source_file.alias("source_file"), source_offset.alias("source_offset"), source_type.alias("source_type")))
    return F.concat(F.lit('{"metadata":'), metadata, F.lit(","), head.substr(F.lit(2), F.length(head)))


def user_metadata(column: Column, reserved=policy.RESERVED_METADATA_KEYS) -> Column:
    """Metadata map without the keys the log itself adds."""
    return F.map_filter(column, lambda key, _: ~key.isin(reserved))


def encrypt_payloads(df: DataFrame, key: Column, aad: Column, payload: str = "payload", nonce: Column | None = None) -> DataFrame:
    """Replace the payload by nonce, body and tag (AES-GCM), keeping both hashes.

    Without ``nonce`` every row draws a random one; a caller that passes its own
    must never repeat a value under one key.
    """
    args = [F.col(payload), key, F.lit("GCM"), F.lit("DEFAULT")]
    if nonce is None:
        sealed = F.aes_encrypt(*args, F.lit(b""), aad)
    else:
        sealed = F.aes_encrypt(*args, nonce, aad)
    return (
        df.withColumn("plaintext_sha256", digest(F.col(payload)))
        .withColumn(payload, sealed)
        .withColumn("ciphertext_sha256", digest(F.col(payload)))
        .withColumn("nonce_b64", b64(F.substring(F.col(payload), 1, 12)))
        .withColumn("tag_b64", b64(F.expr(f"right({payload}, 16)")))
        .withColumn("algorithm", F.lit("AES-256-GCM"))
    )


def decrypt_payloads(df: DataFrame, key: Column, aad: Column, payload: str = "payload") -> DataFrame:
    """Add ``plaintext`` (null when any check fails) and ``payload_auth_valid``."""
    plain = F.try_aes_decrypt(F.col(payload), key, F.lit("GCM"), F.lit("DEFAULT"), aad)
    framed = (
        (digest(F.col(payload)) == F.col("ciphertext_sha256"))
        & (b64(F.substring(F.col(payload), 1, 12)) == F.col("nonce_b64"))
        & (b64(F.expr(f"right({payload}, 16)")) == F.col("tag_b64"))
    )
    return (
        df.withColumn("plaintext", F.when(framed, plain))
        .withColumn("payload_auth_valid", F.coalesce(digest(F.col("plaintext")) == F.col("plaintext_sha256"), F.lit(False)))
        .withColumn("plaintext", F.when(F.col("payload_auth_valid"), F.col("plaintext")))
    )


def key_fingerprint(modulus: int, exponent: int) -> str:
    return _sha256(f"{modulus}:{exponent}".encode("ascii")).hexdigest()


def _signature_ok(digest_hex, signature, modulus: int, exponent: int, accept_textbook: bool) -> bool:
    width = (modulus.bit_length() + 7) // 8
    try:
        raw_digest = bytes.fromhex(digest_hex)
        raw = base64.b64decode(signature, validate=True)
    except (TypeError, ValueError, binascii.Error):
        return False
    value = int.from_bytes(raw, "big")
    padding = width - len(DIGEST_INFO_PREFIX) - 32 - 3
    if len(raw_digest) != 32 or len(raw) != width or value >= modulus or padding < 8:
        return False
    opened = pow(value, exponent, modulus).to_bytes(width, "big")
    if opened == b"\x00\x01" + b"\xff" * padding + b"\x00" + DIGEST_INFO_PREFIX + raw_digest:
        return True
    return accept_textbook and int.from_bytes(opened, "big") == int(digest_hex, 16)


def signature_valid(digest_hex: Column, signature: Column, modulus: int, exponent: int, accept_textbook: bool = True) -> Column:
    """RSA signature check (PKCS#1 v1.5, SHA-256), Arrow batches in and out."""

    @F.pandas_udf(BooleanType())
    def check(digests: pd.Series, signatures: pd.Series) -> pd.Series:
        return pd.Series(
            [_signature_ok(d, s, modulus, exponent, accept_textbook) for d, s in zip(digests, signatures)],
            dtype=bool,
        )

    return check(digest_hex, signature)
