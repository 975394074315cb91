"""Fixed values that results depend on: names, patterns, limits and formats."""

# Kinds of personal data and their categories.
PII_TYPES = ("account_number", "private_address", "private_date", "private_email", "private_person", "private_phone", "private_url", "secret")
PII_CATEGORIES = {
    "FINANCIAL": ("account_number",),
    "CONTACT": ("private_address", "private_email", "private_phone"),
    "PERSONAL": ("private_person", "private_date"),
    "DIGITAL": ("private_url", "secret"),
}
# Labels that stand for what was redacted.
LABEL_MARK = "<<REDACTED_"
LABEL_PATTERN = r"<<REDACTED_(?:PII|REGEX|KEYWORD)_\d+>>"
LABEL_CLASSES = ("PII", "REGEX", "KEYWORD")
# Boundary letters of token labels, and scores that stand for "not allowed".
BOUNDARIES = "BIES"
NOT_ALLOWED = -1e9
# Token windows.
CHUNK_TOKENS, CHUNK_OVERLAP = 128_000, 128
# Rings and previews.
MATCH_RING, LOG_RING, PREVIEW_CHARS = 200, 1000, 50_000
# Settings.
SETTINGS_VERSION = 2
DEFAULT_PORT, DEFAULT_THRESHOLD = 8080, 0.9
# Languages written from right to left.
RTL_LANGUAGES = ("ar", "he", "ur", "fa", "ps", "sd", "ug", "dv", "yi")
# Headers that end at a proxy, for requests and for responses.
REQUEST_HOP_HEADERS = ("host", "proxy-authorization", "connection", "keep-alive", "proxy-connection", "content-length", "accept-encoding")
RESPONSE_HOP_HEADERS = ("content-length", "transfer-encoding", "content-encoding", "keep-alive", "proxy-connection")
CREDENTIAL_HEADERS = ("authorization", "x-api-key", "api-key")
# Endpoint suffixes; the first that fits counts.
ENDPOINTS = ("/v1/messages", "/v1/chat/completions", "/v1/models", "/messages", "/chat/completions", "/models")
# Files and channels that the update feed serves.
UPDATE_CHANNEL = r"^(win|win-arm64)$"
UPDATE_FILE = r"^(releases\.[a-z0-9-]+\.json|[^/\\]+\.nupkg|[^/\\]+-Setup\.exe|[^/\\]+-Portable\.zip)$"
# White space that trimming removes.
TRIMMED = " \t\n\r\f\v"
