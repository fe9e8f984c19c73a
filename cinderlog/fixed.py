"""Fixed values.

These limits, names, messages and word lists decide results, so they are kept
together and spelled out. Nothing else in the package repeats them.
"""

# Severity levels in rising order, and the alias accepted on parsing.
SEVERITIES = ["debug", "info", "warn", "error", "fatal"]
SEVERITY_ALIASES = {"warning": "warn"}
SEVERITY_FALLBACK = "info"

# Ingest limits.
MAX_PAYLOAD_BYTES = 5 * 1024 * 1024
MAX_BATCH_EVENTS = 1000
MAX_BODY_BYTES = 32768
MAX_SERVICE_BYTES = 255
MAX_ENTRY_ATTRIBUTES = 100
ESTIMATED_PROCESSING_MS = 500

# Attribute sanitising limits and the namespaces reserved for resources.
MAX_ATTR_DEPTH = 5
MAX_ATTR_KEYS = 200
MAX_ATTR_KEY_BYTES = 255
MAX_ATTR_VALUE_BYTES = 32768
RESERVED_PREFIXES = ["host.", "service.", "process."]

# Batch level problems.
PROBLEM_TOO_LARGE = "payload-too-large"
PROBLEM_ENCODING = "invalid-encoding"
PROBLEM_JSON = "invalid-json"
PROBLEM_VALIDATION = "validation-failed"

# Violation messages.
MSG_NO_EVENTS = "must contain at least one event"
MSG_BATCH_SIZE = "batch size %d exceeds maximum of %d"
MSG_TIMESTAMP = "required; must be a valid RFC3339 timestamp"
MSG_SEVERITY = "must be one of: debug, info, warn, error, fatal"
MSG_EMPTY = "required; must be non-empty"
MSG_BODY_LONG = "must not exceed 32,768 characters"
MSG_SERVICE_LONG = "must not exceed 255 characters"
MSG_ATTR_COUNT = "must not contain more than 100 keys"

# Search parameter limits and messages.
DEFAULT_PAGE = 100
MAX_PAGE = 1000
MAX_RANGE_DAYS = 7
MAX_KEYWORD_BYTES = 256
ERR_TIMES_REQUIRED = "start_time and end_time are required"
ERR_START_FORMAT = "start_time: must be RFC3339 format"
ERR_END_FORMAT = "end_time: must be RFC3339 format"
ERR_ORDER = "end_time must be after start_time"
ERR_RANGE = "time range must not exceed %d days"
ERR_LEVEL = "level: must be one of debug, info, warn, error, fatal"
ERR_KEYWORD = "keyword: must not exceed 256 characters"
ERR_CURSOR = "cursor: invalid cursor"
ERR_LIMIT = "limit: must be an integer between 1 and 1000"

# Columns of a log row as a search returns them.
LOG_COLUMNS = [
    "id", "timestamp", "received_at", "service_name", "severity", "severity_text",
    "body", "trace_id", "span_id", "resource_attributes", "log_attributes", "schema_url",
]

# RFC 3339 date-time.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"

# Producer side defaults.
PACK_MAX_EVENTS = 500
PACK_MAX_BYTES = 1024 * 1024
PACK_INTERVAL_SECONDS = 2.0
SIZE_ENVELOPE = 128
SIZE_PER_FIELD = 8
RESOURCE_KEYS = ["service.name", "service.version", "deployment.environment", "host.name", "process.pid"]

# Retention in days.
LOG_RETENTION_DAYS = 14
ROLLUP_RETENTION_DAYS = 30

# Preset look-back windows in minutes, and which one applies by default.
PRESET_MINUTES = {"15m": 15, "1h": 60, "3h": 180, "6h": 360, "24h": 1440}
PRESET_DEFAULT = "1h"

# Refresh intervals in seconds; 0 means off.
REFRESH_SECONDS = [0, 10, 30, 60, 300]

# Service level objectives: p95 in milliseconds below, error rate below.
SLO_P95_MS = {"ingest": 500, "query": 200}
SLO_ERROR_RATE = 0.01

# English stop words of the public Snowball/PostgreSQL list.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those am is are
was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out
on off over under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don should now
""".split()

# Published English Snowball ("Porter2") tables.
STEM_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
STEM_KEPT_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
STEM_R1_PREFIX = "gener|commun|arsen"
STEM_STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEM_STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic",
    "ful": "", "ness": "", "ative": "",
}
STEM_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti",
    "ous", "ive", "ize", "ion",
]
