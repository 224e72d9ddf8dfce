"""Row types of the tables the operators exchange, as DDL."""

ENTRIES = (
    "snapshot_id string, path string, name string, is_dir boolean, mode int, "
    "owner string, `group` string, mtime double, size bigint, content string"
)
OPS = (
    "session string, seq bigint, operation string, path string, ts timestamp, "
    "parameters map<string,string>"
)
LOG_LINE = "operation string, path string, timestamp double, parameters map<string,string>"
PAIRS = "example_id string, prompt string, completion string"
PAIR_LINE = "prompt string, completion string"

ENTRY_COLUMNS = ["snapshot_id", "path", "name", "is_dir", "mode", "owner", "group", "mtime", "size", "content"]
ATTRIBUTES = [c for c in ENTRY_COLUMNS if c not in ("snapshot_id", "path")]
