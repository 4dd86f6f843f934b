"""Table schemas."""

REQUESTS = """
id long, timestamp timestamp, provider string, model string, stream boolean, method string, path string,
client_ip string, request_body string, response_body string, status_code int, duration_ms double,
input_tokens int, output_tokens int, total_tokens int, success boolean, error_msg string, status string
"""

TRACK = "role string, content string, timestamp_ms long, metadata map<string,string>, session_id string, seq long"

SSE = "stream_id long, seq long, line string"

REPLACEMENTS = "array<struct<original:string,tag:string>>"

# one row of `sources.tracks.ingest`
MESSAGE = """
session_id string, seq long, role string, full_text string, clean_text string, placeholder string,
timestamp_ms long, metadata string
"""
