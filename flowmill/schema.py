"""The unified flow table: column groups, types, aliases and vocabularies."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Fixed values.  These lists define the table layout and the label vocabulary;
# results depend on them word for word, so they are kept as plain text.
# --------------------------------------------------------------------------

META_COLUMNS = [
    "dataset_source", "source_file", "environment_type",
    "attack_category", "attack_subcategory", "label",
]

STRING_FEATURES = ["protocol", "service"]

NUMERIC_FEATURES = [
    "duration", "src_port", "dst_port", "src_bytes", "dst_bytes",
    "total_packets_fwd", "total_packets_bwd",
    "packet_length_mean", "packet_length_std", "packet_length_min", "packet_length_max",
    "flow_bytes_per_sec", "flow_packets_per_sec",
    "fwd_iat_mean", "bwd_iat_mean", "fwd_iat_std", "bwd_iat_std",
    "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
    "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count",
    "fwd_header_length", "bwd_header_length",
    "active_mean", "active_std", "idle_mean", "idle_std",
    "bytes_per_packet_ratio", "down_up_ratio",
    "avg_fwd_segment_size", "avg_bwd_segment_size",
    "subflow_fwd_bytes", "subflow_bwd_bytes", "bulk_rate_fwd", "bulk_rate_bwd",
]

# Columns rounded to whole numbers when values are generated.
INTEGER_LIKE = [
    "src_port", "dst_port", "total_packets_fwd", "total_packets_bwd",
    "fin_flag_count", "syn_flag_count", "rst_flag_count", "psh_flag_count",
    "ack_flag_count", "urg_flag_count", "cwe_flag_count", "ece_flag_count",
    "fwd_header_length", "bwd_header_length",
]

PORT_COLUMNS = ["src_port", "dst_port"]
PORT_MAX = 65535

QUASI_IDENTIFIERS = ["protocol", "service", "dst_port", "attack_category"]

# Canonical feature -> names under which raw sources carry it, first match wins.
ALIASES = {
    "duration": ["duration", "dur", "flow duration", "flow_duration", "tcp.time_delta"],
    "protocol": ["protocol", "proto", "protocol_type", "mqtt.protoname"],
    "service": ["service"],
    "src_port": ["src_port", "sport", "src port", "source port", "originp", "srcport"],
    "dst_port": ["dst_port", "dport", "dst port", "destination port", "responp", "dstport"],
    "src_bytes": ["src_bytes", "sbytes", "fwd packets length total", "totlen fwd pkts",
                  "total length of fwd packets", "fwd_bytes", "tcp.len"],
    "dst_bytes": ["dst_bytes", "dbytes", "bwd packets length total", "totlen bwd pkts",
                  "total length of bwd packets", "bwd_bytes"],
    "total_packets_fwd": ["total fwd packets", "tot fwd pkts", "spkts", "fwd_pkts_tot", "fwd packets"],
    "total_packets_bwd": ["total backward packets", "tot bwd pkts", "dpkts", "bwd_pkts_tot", "bwd packets"],
    "packet_length_mean": ["packet length mean", "pkt_len_avg", "flow pktl avg"],
    "packet_length_std": ["packet length std", "pkt_len_std", "flow pktl std"],
    "packet_length_min": ["packet length min", "pkt_len_min", "flow pktl min"],
    "packet_length_max": ["packet length max", "pkt_len_max", "flow pktl max"],
    "flow_bytes_per_sec": ["flow bytes/s", "flow byts/s", "sload", "dload", "rate"],
    "flow_packets_per_sec": ["flow packets/s", "flow pkts/s"],
    "fwd_iat_mean": ["fwd iat mean", "fwd_iat_mean"],
    "bwd_iat_mean": ["bwd iat mean", "bwd_iat_mean"],
    "fwd_iat_std": ["fwd iat std", "fwd_iat_std"],
    "bwd_iat_std": ["bwd iat std", "bwd_iat_std"],
    "fin_flag_count": ["fin flag count", "fin_flag_cnt"],
    "syn_flag_count": ["syn flag count", "syn_flag_cnt"],
    "rst_flag_count": ["rst flag count", "rst_flag_cnt"],
    "psh_flag_count": ["psh flag count", "psh_flag_cnt"],
    "ack_flag_count": ["ack flag count", "ack_flag_cnt"],
    "urg_flag_count": ["urg flag count", "urg_flag_cnt"],
    "cwe_flag_count": ["cwe flag count", "cwe_flag_count"],
    "ece_flag_count": ["ece flag count", "ece_flag_count"],
    "fwd_header_length": ["fwd header length", "fwd header len", "fwd_header_size"],
    "bwd_header_length": ["bwd header length", "bwd header len", "bwd_header_size"],
    "active_mean": ["active mean", "active.avg", "active_mean"],
    "active_std": ["active std", "active.std", "active_std"],
    "idle_mean": ["idle mean", "idle.avg", "idle_mean"],
    "idle_std": ["idle std", "idle.std", "idle_std"],
    "bytes_per_packet_ratio": ["bytes_per_packet_ratio"],
    "down_up_ratio": ["down/up ratio", "down_up_ratio"],
    "avg_fwd_segment_size": ["avg fwd segment size", "fwd seg size avg"],
    "avg_bwd_segment_size": ["avg bwd segment size", "bwd seg size avg"],
    "subflow_fwd_bytes": ["subflow fwd bytes"],
    "subflow_bwd_bytes": ["subflow bwd bytes"],
    "bulk_rate_fwd": ["fwd bulk rate avg", "bulk_rate_fwd"],
    "bulk_rate_bwd": ["bwd bulk rate avg", "bulk_rate_bwd"],
}

# Column names of the two headerless public connection-record formats.
KDD_COLUMNS = [
    "duration", "protocol_type", "service", "flag", "src_bytes", "dst_bytes", "land",
    "wrong_fragment", "urgent", "hot", "num_failed_logins", "logged_in", "num_compromised",
    "root_shell", "su_attempted", "num_root", "num_file_creations", "num_shells",
    "num_access_files", "num_outbound_cmds", "is_host_login", "is_guest_login", "count",
    "srv_count", "serror_rate", "srv_serror_rate", "rerror_rate", "srv_rerror_rate",
    "same_srv_rate", "diff_srv_rate", "srv_diff_host_rate", "dst_host_count",
    "dst_host_srv_count", "dst_host_same_srv_rate", "dst_host_diff_srv_rate",
    "dst_host_same_src_port_rate", "dst_host_srv_diff_host_rate", "dst_host_serror_rate",
    "dst_host_srv_serror_rate", "dst_host_rerror_rate", "dst_host_srv_rerror_rate",
]

# Words that mean "no attack", compared in lower case.
NORMAL_WORDS = ["0", "benign", "normal", "legitimate", "background", "none", "no", "false"]

# Attack name -> family, exact match in lower case.
FAMILY_BY_NAME = {
    "back": "DoS", "land": "DoS", "neptune": "DoS", "pod": "DoS", "smurf": "DoS", "teardrop": "DoS",
    "ipsweep": "Probe", "nmap": "Probe", "portsweep": "Probe", "satan": "Probe",
    "ftp_write": "R2L", "guess_passwd": "R2L", "imap": "R2L", "multihop": "R2L", "phf": "R2L",
    "spy": "R2L", "warezclient": "R2L", "warezmaster": "R2L",
    "buffer_overflow": "U2R", "loadmodule": "U2R", "perl": "U2R", "rootkit": "U2R",
}

# Reflection protocols that name a distributed flood, exact match in lower case.
FLOOD_PROTOCOLS = ["dns", "ldap", "mssql", "netbios", "ntp", "portmap", "snmp",
                   "syn", "tftp", "udp", "udplag", "udp-lag"]

# Substring rules, tried from top to bottom after the exact matches.
FAMILY_RULES = [
    (["ddos", "drdos"], "DDoS"),
    (["dos"], "DoS"),
    (["brute"], "BruteForce"),
    (["bot", "mirai", "gafgyt", "bashlite"], "Botnet"),
    (["scan", "recon", "probe"], "Reconnaissance"),
    (["infil"], "Infiltration"),
    (["web", "xss", "sql", "injection"], "WebAttack"),
    (["ransom"], "Ransomware"),
    (["backdoor"], "Backdoor"),
    (["mitm"], "MITM"),
    (["malware", "evil", "sus"], "Anomaly"),
]
# One short name that is a brute-force label only as a whole word.
BRUTE_FORCE_NAMES = ["bfa"]

# Cells a CSV reader treats as missing.
NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
               "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

# --------------------------------------------------------------------------

FLOW_COLUMNS = META_COLUMNS + STRING_FEATURES + NUMERIC_FEATURES
FEATURE_COLUMNS = STRING_FEATURES + NUMERIC_FEATURES
NON_NEGATIVE = list(NUMERIC_FEATURES)
# Columns that identify where a row came from rather than what it is.
LINEAGE_COLUMNS = ["dataset_source", "source_file"]


def _type_of(name: str) -> T.DataType:
    if name == "label":
        return T.ByteType()
    return T.DoubleType() if name in NUMERIC_FEATURES else T.StringType()


FLOW_SCHEMA = T.StructType([T.StructField(c, _type_of(c)) for c in FLOW_COLUMNS])
