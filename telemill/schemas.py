"""Schemas of raw logs and of the tables that the operators keep."""

from pyspark.sql import types as T


_KINDS = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType(), "date": T.DateType(),
    "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(text: str) -> T.StructType:
    """Schema of ``name kind`` pairs; works without a session."""
    return T.StructType([T.StructField(*[(n, _KINDS[k]) for n, k in [pair.split(" ")]][0]) for pair in text.split(", ")])


EVENT = _struct(
    "record_id string, event_time timestamp, ingested_at timestamp, source_ip string, source_port int, dest_port int, honeypot string, protocol string, event_type string, "
    "session_id string, username string, password string, command_str string, download_url string, file_hash string, hassh string, user_agent string, http_path string, "
    "pipeline_run_id string, raw_file_path string, raw_line_number int, raw_data string"
)
SSH_LINE = _struct("eventid string, timestamp string, src_ip string, src_port int, dst_port int, session string, username string, password string, input string, url string, shasum string, hassh string, hasshAlgorithms string")
CANARY_LINE = _struct(
    "logtype int, local_time string, src_host string, dst_host string, node_id string, src_port string, dst_port string"
)
TCP_LINE = _struct("time string, level string, msg string, sensorID string, handler string, dest_port string, src_port string, src_ip string, payload_hash string")
IOC = _struct("ioc_type string, ioc_value string, first_seen timestamp, last_seen timestamp, occurrence_count bigint, batch_count bigint, source_honeypots array<string>")
CREDENTIAL = _struct("username string, password string, first_seen timestamp, last_seen timestamp, attempt_count bigint, success_count bigint, source_ip_count bigint")
FEED = _struct("source string, ioc_type string, ioc_value string, ip string, port int, malware_family string, confidence int, tags array<string>, first_seen timestamp, last_seen timestamp, snapshot_date date, raw_data string")
DEVICE = _struct(
    "source string, snapshot_week date, snapshot_date date, ip string, port int, transport string, protocol string, product string, version string, cpe array<string>, cve_ids array<string>, "
    "country_code string, asn bigint, org string, isp string, device_type string, hostnames array<string>, domains array<string>, tags array<string>, http_title string, http_server string, "
    "http_headers map<string,string>, ssl_cert string, vulns string, query_ids array<string>, query_category string, raw_banner string, raw_data string"
)
ACTIVITY = _struct("day date, source_ip string, honeypot string, event_count bigint, login_attempts bigint, unique_sessions bigint, first_event timestamp, last_event timestamp")
RUN = _struct("run_id string, task_name string, started_at timestamp, completed_at timestamp, status string, records_in bigint, records_out bigint, source_files array<string>, parameters string, error string")
BULK_SCAN = _struct("ip string, port int, proto string, timestamp string, asn string, country_code string, value string, data string, banner string")
