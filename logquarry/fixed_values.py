"""Fixed values that decide results: patterns, word lists, key lists, limits.

They are the observable contract of the log formats this package reads, so they
are stated here as plain text and used everywhere else by name.
"""

# --- line patterns (unanchored text; `functions.patterns` adds the flags) ---
CLF_STRICT = (r'(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+'
              r'"(\S+)\s+(\S+)\s+[^"]*"\s+(\d{3})\s+(\d+|-)')
CLF_LOOSE = (r'(\S+)\s+\S+(?:\s+\S+)?\s+\[([^\]]+)\]\s+'
             r'"(\S+)\s+([^\s"]+)(?:\s+[^"]*)?"\s*(\d{3})?(?:\s+(\d+|-))?')
CLF_OPEN_QUOTE = (r'(\S+)\s+\S+(?:\s+\S+)?\s+\[([^\]]+)\]\s+'
                  r'"(\S+)\s+(\S+)\s+(\d{3})\s+(\d+|-)\s*$')
LEVELLED = (r'(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)'
            r'(?:\([^)]*\))?(?:\[[^\]]*\])?'
            r'\s+(INF|WRN|ERR|DBG|CRIT|FATAL|INFO|WARN|WARNING|ERROR|DEBUG|TRACE)'
            r'\s+(.*)')
SYSLOG = (r'(?:<\d+>)?\d+\s+'
          r'(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s+'
          r'(\S+)\s+(\S+?)(?:\[(\d+)\])?:?\s+(.*)')
IPV4 = r'(\d{1,3}(?:\.\d{1,3}){3})'
CLF_TIME = (r'(\d{1,2})/([A-Za-z]{3})[A-Za-z]?/(\d{4}):(\d{2}):(\d{2}):(\d{2})'
            r'(?:\s*([+-]\d{2})(\d{2}))?')

# --- message template: what is replaced by '*' ---
TEMPLATE_IP = r'(?:\d{1,3}\.){3}\d{1,3}'
TEMPLATE_HEX = r'[0-9a-fA-F]{8,}'
TEMPLATE_NUMBER = r'\d+'

# --- levels ---
LEVEL_NAMES = {
    "INF": "INF", "INFO": "INF",
    "WRN": "WRN", "WARN": "WRN", "WARNING": "WRN",
    "ERR": "ERR", "ERROR": "ERR", "CRIT": "CRIT", "FATAL": "CRIT",
    "DBG": "DBG", "DEBUG": "DBG", "TRACE": "DBG",
}
LEVEL_ORDER = ("INF", "WRN", "ERR", "CRIT", "DBG", "RAW")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun",
          "jul", "aug", "sep", "oct", "nov", "dec")

# --- JSON lines: first non-empty key wins ---
JSON_TIME_KEYS = ("ts", "time", "timestamp", "@timestamp", "datetime", "date")
JSON_LEVEL_KEYS = ("level", "lvl", "log_level", "severity")
JSON_MESSAGE_KEYS = ("msg", "message", "text", "log", "msg_text")
JSON_IP_KEYS = ("ip", "client_ip", "ip_addr", "src_ip", "remote_addr", "source_ip")
RESULT_IP_KEYS = ("src_ip", "ip", "src", "clientip", "source_ip")

# --- files ---
SUPPORTED_EXTENSIONS = (".log", ".txt", ".csv", ".json", ".gz", ".bz2", ".xz", ".zip")
ZIP_MEMBER_EXTENSIONS = (".log", ".txt", ".csv", ".json")
MAX_FILE_BYTES = 500 * 1024 * 1024
MAX_BATCH_BYTES = 1024 * 1024 * 1024
MAX_DECOMPRESSED_BYTES = 2 * 1024 ** 3
MAGIC_GZIP = b"\x1f\x8b"
MAGIC_BZIP2 = b"BZh"
MAGIC_XZ = b"\xfd7zXZ\x00"
MAGIC_ZIP = b"PK\x03\x04"
# Bytes without a meaning in code page 1252.
CP1252_UNDEFINED = "\u0081\u008d\u008f\u0090\u009d"

# --- limits ---
TRUNCATE_AT = 600
TRUNCATE_MARK = " ..."
DETECT_SAMPLE = 100
DETECT_SHARE = 0.7
META_LINES = 20
PAGE_SIZE = 500
PAGE_MAX = 5000
TOP_DEFAULT = 30
TOP_MAX = 100
TEMPLATE_LIMIT = 200
CONTEXT_DEFAULT = 5
CONTEXT_MAX = 50
IMPORT_DEFAULT = 1000
IMPORT_MAX = 5000
AUDIT_KEPT = 500
DIAGNOSE_PER_CALL = 50
DIAGNOSE_TOP = 10

# --- columns ---
SEARCH_FIELDS = ("ts", "level", "ip", "host", "app", "pid",
                 "method", "path", "code", "bytes", "msg")
EXPORT_FIELDS = SEARCH_FIELDS
TOP_FIELDS = ("ip", "path", "code", "level", "method", "host", "app")
KPI_BY_FORMAT = {
    "apache": ("ips", "paths", "codes"),
    "w3c": ("ips", "paths", "codes"),
    "json": ("ips", "levels"),
    "syslog": ("ips",),
    "generic": ("ips", "levels"),
    "raw": ("levels",),
}
DASHBOARD_TOPS = {
    "apache": {"ip": 30, "path": 40, "code": 100},
    "w3c": {"ip": 30, "path": 40, "code": 100},
    "syslog": {"level": 100, "ip": 30, "host": 30, "app": 30},
    "other": {"level": 100, "ip": 30},
}
DISPLAY_COLUMNS = {
    "apache": ("ts", "ip", "method", "path", "code", "bytes"),
    "w3c": ("ts", "ip", "method", "path", "code", "bytes"),
    "syslog": ("ts", "host", "app", "pid", "msg"),
    "other": ("ts", "level", "msg"),
}
CSV_RISKY_STARTS = ("=", "+", "-", "@", "\t", "\r", "\n")

# --- diagnosis: part of the answer key, so the text is fixed ---
TEMPLATE_ITEM = "PLANTILLA (%d ocurrencias):\n%s\nEjemplo: %s"
ANSWER_LANGUAGES = ("auto", "es", "en")
