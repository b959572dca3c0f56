"""Reference SQL fragments for the registered queries (DuckDB dialect).

They restate the evidence view and the shared rules independently of the DataFrame
code, so that both sides of a comparison are written on their own.
"""

EV = """
ev0 AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CAST(floor(value * CAST(100 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT) AS cents,
         CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS d
  FROM events),
ev1 AS (
  SELECT *,
         ['cabin','maintenance','afdx','avionics','integrity'][d + 1] AS domain,
         CASE WHEN k % 10 = 0 THEN ['cabin','maintenance','afdx','avionics','integrity'][(d + 1) % 5 + 1]
              ELSE ['cabin','maintenance','afdx','avionics','integrity'][d + 1] END AS dst_domain,
         CAST(6000 - cents AS DOUBLE) / CAST(40000 AS DOUBLE) AS anomaly_score
  FROM ev0),
ev AS (
  SELECT event_id, ts, user_id, k, cents,
         event_id + 1 AS sequence, event_id + 1 AS evidence_id,
         'events/' || event_type || '.csv' AS source_file,
         CASE WHEN domain = 'integrity' THEN 'SECURITY_EVENT' ELSE 'CSV' END AS source_type,
         event_id AS source_offset,
         epoch_us(ts) AS occurred_us,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS occurred_at,
         domain,
         CASE domain WHEN 'avionics' THEN 'ARINC429' WHEN 'integrity' THEN 'LOG' ELSE 'PCAP' END AS data_format,
         CASE domain WHEN 'cabin' THEN '192.168.1.' || (user_id % 254 + 1)
                     WHEN 'maintenance' THEN '192.168.2.' || (user_id % 254 + 1)
                     ELSE '10.0.' || (user_id % 256) || '.' || (user_id % 254 + 1) END AS src,
         CASE dst_domain WHEN 'cabin' THEN '192.168.1.' || (user_id * 7 % 254 + 1)
                     WHEN 'maintenance' THEN '192.168.2.' || (user_id * 7 % 254 + 1)
                     ELSE '10.0.' || (user_id * 7 % 256) || '.' || (user_id * 7 % 254 + 1) END AS dst,
         CAST([80, 443, 8080, 22, 102, 502, 7100, 161][k % 8 + 1] AS BIGINT) AS port,
         CASE WHEN k % 20 = 0 THEN 'ICMP' WHEN k % 2 = 0 THEN 'TCP' ELSE 'UDP' END AS protocol,
         cents // 10 AS packet_size,
         20 + (k * 13 + user_id * 7) % 480 AS frequency,
         anomaly_score,
         CAST(anomaly_score < 0 AS BIGINT) AS predicted_anomaly,
         CASE WHEN anomaly_score < CAST(-0.1 AS DOUBLE) THEN 'HIGH' WHEN anomaly_score < 0 THEN 'MEDIUM'
              WHEN anomaly_score < CAST(0.05 AS DOUBLE) THEN 'LOW' ELSE 'NONE' END AS severity,
         CAST(cents > 15000 OR k % 25 = 0 AS BIGINT) AS is_anomaly,
         CASE WHEN cents > 15000 OR k % 25 = 0
              THEN ['port_scan','command_injection','replay','data_exfiltration'][k % 4 + 1] ELSE 'none' END AS anomaly_type,
         ['203','206','360'][k % 3 + 1] AS label_octal,
         lpad(bin(k % 4), 2, '0') AS ssm_bits,
         lpad(bin((event_id * 31 + k * 977) % 524288), 19, '0') AS data_bits,
         '0x' || lpad(hex((event_id * 2654435761 + k) % 4294967296), 8, '0') AS raw_hex,
         CASE k % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['packet_size_zscore', 'port_anomaly_flag']
              ELSE ['frequency', 'cross_domain_flag'] END AS top_features,
         CASE WHEN k % 5 = 0 THEN '' ELSE 'Unusual traffic on port ' || (k % 8) || '. Review the sender.' END AS explanation
  FROM ev1),
logsrc AS (
  SELECT *, occurred_at AS created_at,
         '{"ingest_mode":"csv_row","row_index":' || source_offset || '}' AS metadata_json,
         '{"anomaly_type":"' || anomaly_type || '","data_format":"' || data_format || '","domain":"' || domain
           || '","dst":"' || dst || '","label_octal":"' || label_octal || '","packet_size":' || packet_size
           || ',"port":' || port || ',"protocol":"' || protocol || '","sequence":' || sequence || ',"src":"' || src || '"}' AS payload
  FROM ev),
sec AS (
  SELECT sequence, 'security_event' AS kind, occurred_at AS created_at, occurred_us, source_file, source_offset,
         'SECURITY_EVENT' AS source_type,
         ['tamper_attempt_blocked','tamper_attempt_no_effect','recovery_ledger_restore','integrity_check_failed'][k % 4 + 1] AS event,
         ['HIGH','MEDIUM','INFO'][k % 3 + 1] AS severity,
         CASE WHEN k % 4 < 2 THEN ['update','delete'][k % 2 + 1] END AS details_operation,
         CASE WHEN k % 4 < 2 THEN event_id % 5000 + 1 END AS details_target_sequence,
         CASE WHEN k % 4 < 2 THEN event_id END AS attempt_id,
         CASE WHEN k % 3 = 0 THEN 'analyst' ELSE 'host [10.0.7.' || k || '];' END AS details_actor
  FROM ev WHERE domain = 'integrity'),
att AS (
  SELECT event_id AS attempt_id, occurred_at AS detected_at, occurred_us,
         ['UPDATE','DELETE'][k % 2 + 1] AS operation, event_id % 5000 + 1 AS target_sequence, 'blocked' AS sqlite_action,
         CASE WHEN k % 2 = 0 THEN '10.0.9.' || k END AS attacker_ip,
         CASE WHEN k % 3 = 0 THEN 'log_entries' END AS table_name,
         CASE WHEN k % 4 = 0 THEN sha256(CAST(event_id AS VARCHAR)) END AS chain_entry_hash
  FROM ev WHERE domain = 'integrity' AND k < 8)
"""


def with_ev(body: str, *extra: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join([EV.strip(), *(e.strip() for e in extra)]) + "\n" + body


def half_up(x: str, digits: int) -> str:
    s = f"CAST({10**digits} AS DOUBLE)"
    return f"(floor(({x}) * {s} + CAST(0.5 AS DOUBLE)) / {s})"


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def canonical_severity(x: str) -> str:
    return (
        f"CASE upper(coalesce(nullif({x}, ''), 'NORMAL')) WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'HIGH' "
        "WHEN 'WARNING' THEN 'MEDIUM' WHEN 'MEDIUM' THEN 'MEDIUM' WHEN 'ANOMALY' THEN 'MEDIUM' "
        "WHEN 'LOW' THEN 'LOW' WHEN 'INFO' THEN 'LOW' ELSE 'NORMAL' END"
    )


def severity_rank(x: str) -> str:
    return f"CASE upper({x}) WHEN 'CRITICAL' THEN 3 WHEN 'HIGH' THEN 3 WHEN 'WARNING' THEN 2 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"


def severity_bucket(x: str) -> str:
    return (
        f"CASE WHEN lower({x}) LIKE '%critical%' OR lower({x}) LIKE '%high%' THEN 'high' "
        f"WHEN lower({x}) LIKE '%warning%' OR lower({x}) LIKE '%medium%' THEN 'medium' "
        f"WHEN lower({x}) LIKE '%low%' THEN 'low' ELSE 'normal' END"
    )


def risk(score: str, severity: str) -> str:
    weight = (
        f"CAST(CASE upper({severity}) WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.85 WHEN 'WARNING' THEN 0.7 "
        "WHEN 'MEDIUM' THEN 0.65 WHEN 'ANOMALY' THEN 0.6 WHEN 'LOW' THEN 0.4 WHEN 'INFO' THEN 0.15 "
        "WHEN 'NORMAL' THEN 0.0 WHEN 'NONE' THEN 0.0 ELSE 0.6 END AS DOUBLE)"
    )
    s = f"coalesce({score}, {dbl(0)})"
    by_score = (
        f"CASE WHEN {s} < 0 THEN least({dbl(1)}, {dbl(0.55)} + abs({s}) * {dbl(2)}) "
        f"WHEN {s} <= {dbl(0.05)} THEN greatest({dbl(0.25)}, {dbl(0.55)} - {s} * {dbl(4)}) "
        f"WHEN {s} <= 1 THEN {s} ELSE {dbl(0.25)} END"
    )
    return half_up(f"greatest({weight}, {by_score})", 4)


def title(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({x}), '[a-z]+|[^a-z]+'), lambda w: upper(w[1]) || w[2:]), '')"


def slug(kind: str, x: str) -> str:
    safe = f"regexp_replace(regexp_replace(lower(trim({x})), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"('{kind}-' || coalesce(nullif({safe}, ''), 'unknown'))"


def flags() -> str:
    """Select list for the three policy flags over ``ev``."""
    def zone(x: str) -> str:
        return (
            f"CASE WHEN {x} LIKE '192.168.1.%' THEN 'cabin' WHEN {x} LIKE '192.168.2.%' THEN 'maintenance' "
            f"WHEN {x} LIKE '10.0.%' THEN 'afdx' END"
        )

    expected = (
        "(domain = 'cabin' AND port IN (80, 443, 8080, 8443)) OR (domain = 'maintenance' AND port IN (22, 102, 443, 8080, 8443)) "
        "OR (domain = 'afdx' AND (port IN (80, 443) OR port BETWEEN 7000 AND 8000))"
    )
    known = "(domain IN ('cabin', 'maintenance') AND protocol IN ('TCP', 'UDP')) OR (domain = 'afdx' AND protocol IN ('TCP', 'UDP', 'ICMP'))"
    pcap = "data_format = 'PCAP'"
    return (
        f"CASE WHEN {pcap} THEN coalesce(CAST({zone('src')} <> {zone('dst')} AS BIGINT), 0) ELSE 0 END AS cross_domain_flag, "
        f"CASE WHEN {pcap} AND NOT ({expected}) THEN 1 ELSE 0 END AS port_anomaly_flag, "
        f"CASE WHEN {pcap} AND NOT ({known}) THEN 1 ELSE 0 END AS protocol_anomaly_flag"
    )
