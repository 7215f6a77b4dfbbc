"""Fixed values the scoring rules depend on.

These must stay equal to the behaviour being reproduced: thresholds, weights,
word lists and identifiers. They are kept together, in natural order, so that the
rule modules read as plain DataFrame code.
"""

# ---------------------------------------------------------------------------
# SSH edge scoring
# ---------------------------------------------------------------------------
BRUTE_FORCE_MIN_ATTEMPTS = 5          # strictly more than this many attempts
BRUTE_FORCE_FAIL_RATIO = 0.5          # and at least this failure share
PRIVILEGED_USERS = ["root", "admin", "administrator", "wheel", "sudo"]
MULTI_USER_PIVOT_THRESHOLD = 2        # distinct users from one source
HIGH_FREQ_COLLAPSED_THRESHOLD = 100   # all-success, single-user, this many hits

SSH_BASE_RISK = 1.0
SSH_BRUTE_WEIGHT = 3.5
SSH_PRIV_WEIGHT = 2.5
SSH_MULTI_WEIGHT = 2.0
SSH_COLLAPSED_PENALTY = 2.0

# ---------------------------------------------------------------------------
# HTTP edge scoring
# ---------------------------------------------------------------------------
STATIC_EXTENSIONS = [
    "png", "jpg", "jpeg", "gif", "ico", "svg", "webp", "bmp", "tiff",
    "woff", "woff2", "ttf", "eot", "otf",
    "css", "js", "mjs", "map",
    "mp3", "mp4", "wav", "ogg", "webm", "avi", "flv", "swf",
    "pdf", "doc", "docx", "xls", "xlsx", "zip", "gz", "tar",
    "txt", "xml", "json", "rss", "atom", "manifest",
]
HTTP_SCAN_MIN_DISTINCT_PATHS = 5      # distinct 4xx paths that make a scanner
HTTP_COLLAPSE_REPEATED_MIN = 20       # clean GET repeats dropped from this count
WRITE_VERBS = ["DELETE", "PUT", "PATCH"]

HTTP_BASE_RISK = 1.0
HTTP_POST_WEIGHT = 2.5
HTTP_WRITE_WEIGHT = 1.5
HTTP_4XX_WEIGHT = 1.5
HTTP_5XX_WEIGHT = 2.0

# ---------------------------------------------------------------------------
# Graph construction
# ---------------------------------------------------------------------------
CHAIN_SOURCE_RISK = 2.0               # HTTP source risk above this marks a chain
CHAIN_RISK_BONUS = 3.0
DEST_RISK_FACTOR = 1.2                # SSH destination inherits 1.2 x edge risk
SIGNAL_RISK_THRESHOLD = 3.0
CRITICAL_RISK_THRESHOLD = 5.0
SUPER_NOISE_RISK = 0.5

SUPER_EXTERNAL_NOISE = "super:external_noise"
SUPER_WEB_SURFACE = "super:web_surface"
SUPER_INTERNAL_BASELINE = "super:internal_baseline"

# ---------------------------------------------------------------------------
# Cluster overview
# ---------------------------------------------------------------------------
SUPER_EXTERNAL_THREATS = "super:external_threats"
SUPER_WEB_URLS = "super:web_urls"
SUPER_SUBNET_PREFIX = "super:subnet:"
SUPER_UNKNOWN = "super:unknown"
EXTERNAL_THREATS_RISK = 7.0
SUBNET_RISK = 2.0
WEB_URLS_RISK = 3.0
UNKNOWN_CLUSTER_RISK = 1.0
SUPER_EDGE_ANOMALY_EVENTS = 10        # more events than this is anomalous
SUPER_EDGE_WEIGHT_DIVISOR = 50.0
SUPER_EDGE_WEIGHT_CAP = 10.0
EXPAND_MAX_NODES = 75
CLIENT_MAX_NODES = 60

# ---------------------------------------------------------------------------
# Anomaly flags, in severity order (most severe first)
# ---------------------------------------------------------------------------
FLAG_SEVERITY = [
    "FULL_ATTACK_CHAIN",
    "SSH_PRIVILEGE_PIVOT",
    "PRIVILEGE_PIVOT",
    "BRUTE_FORCE_BURST",
    "WEB_EXPLOIT_POST",
    "RARE_PIVOT_PATH",
    "HTTP_4XX_SCAN",
    "OFF_HOURS_ACCESS",
    "HIGH_FREQUENCY_COLLAPSED",
]
SCAN_FLAGS = ["WEB_EXPLOIT_POST", "HTTP_4XX_SCAN", "OFF_HOURS_ACCESS", "HIGH_FREQUENCY_COLLAPSED"]

# ---------------------------------------------------------------------------
# Format keys and detection keywords
# ---------------------------------------------------------------------------
FORMAT_SSH = "SYSLOG_SSH"
FORMAT_HTTP = "NCSA_SQUID_HTTP"
FORMAT_ZEEK = "ZEEK_TSV"
FORMAT_UNKNOWN = "UNKNOWN"
SNIFF_SAMPLE_LINES = 100
