"""Limits, word lists, patterns and names that results depend on."""

# --- enumerations -----------------------------------------------------------
MEMORY_KINDS = ["knowledge", "preference", "solution", "entity", "event"]
MEMORY_SCOPES = ["session", "project", "user", "organization"]
MEMORY_STATUSES = ["candidate", "active", "superseded", "rejected", "expired", "deleted"]
PROJECTED_SCOPES = ["session", "project"]
LIVE_STATUSES = ["candidate", "active"]
RELATIONSHIP_TYPES = ["related", "contradiction", "superseded_by"]
RECONCILIATION_OUTCOMES = ["new", "duplicate", "update", "related", "uncertain"]
PROJECTION_TARGETS = ["vector", "graph"]
EVIDENCE_MODALITIES = ["text", "table", "image", "video", "audio"]
LAYOUT_ITEM_TYPES = ["TextItem", "SectionHeaderItem", "ListItem", "TableItem"]

# --- file types -------------------------------------------------------------
PARSER_BY_EXTENSION = {
    "pdf": "pdf", "docx": "docx", "pptx": "docx", "xlsx": "table", "csv": "table",
    "jpg": "image", "jpeg": "image", "png": "image", "webp": "image", "gif": "image",
    "mp4": "video", "mov": "video", "avi": "video", "webm": "video", "youtube": "captions",
}
UPLOAD_EXTENSIONS = [extension for extension in PARSER_BY_EXTENSION if extension != "youtube"]

# --- retrieval --------------------------------------------------------------
RRF_K = 60
HYBRID_CANDIDATES = 20
RERANK_TOP_N = 6
COLLECTIONS = ["text", "table", "image", "video_segment"]
COLLECTION_WEIGHTS = {"text": 1.0, "table": 1.0, "image": 0.8, "video_segment": 0.7, "audio_segment": 0.7}
MEMORY_TOP_K = 5
EXACT_CANDIDATES = 5
SEMANTIC_CANDIDATES = 5
EXACT_FALLBACK_CONFIDENCE = 0.80
MAX_PLANNED = 10
PLAN_RELATIONS = ["supports", "updates", "duplicates", "related", "uncertain"]
GRAPH_SEEDS = 50
GRAPH_NEIGHBOURS = 4
RECENT_MESSAGES = 10
MAX_SUBQUERIES = 3
MIN_SUBQUERY_CHARS = 8
COMPOUND_MIN_CHARS = 80
COMPOUND_MARKERS = [" compare ", " versus ", " vs. ", " and then ", " followed by "]
UPDATE_CONFIDENCE = 0.90
STAGE_EXACT, STAGE_PREVIOUS, STAGE_SEMANTIC, STAGE_GRAPH = (
    "exact_identifier", "previous_response", "semantic", "graph_related")

# --- chunking and routing ---------------------------------------------------
CHUNK_TOKENS = 512
OVERLAP_TOKENS = 50
TABLE_ROWS = 50
SECTION_CHARS = 1500
TOP_HEADING_CHARS = 30
SEGMENT_WORDS = 120
SEGMENT_SECONDS = 60.0
NATIVE_MIN_CHARS = 80
NATIVE_MIN_WORDS = 15
NATIVE_MIN_ALNUM = 0.50
NATIVE_MAX_BAD = 0.01
OCR_MIN_CHARS = 20
OCR_MIN_ALNUM = 0.40
OCR_LINE_CONFIDENCE = 0.60
BLANK_VISUAL_RATIO = 0.005
FALLBACK_PAGE_RATIO = 0.70
QUALITY_MIN_CHARS = 40

# --- lifecycle --------------------------------------------------------------
EVENT_AUTO_CONFIDENCE = 0.75
PREFERENCE_AUTO_CONFIDENCE = 0.90
EVENT_REVIEW_DAYS = 30
EVENT_GRACE_DAYS = 7
LEASE_SECONDS = 300
EXPIRY_SWEEP_SECONDS = 300
EXPIRY_SWEEP_MIN_SECONDS = 30
MAX_EXTRACTED = 20

# --- titles -----------------------------------------------------------------
DEFAULT_TITLE = "New chat"
TITLE_WORDS = 7
TITLE_CHARS = 48
STORED_TITLE_CHARS = 56

# --- text patterns ----------------------------------------------------------
# Whitespace as the union of ASCII blanks and Unicode separators.
BLANKS = r"[\s\p{Z}]+"
# Default token rule: a run of letters/digits or one other mark, with its leading blanks.
TOKEN = r"\s*[\p{L}\p{N}]+|\s*[^\s\p{L}\p{N}]|\s+"
SEARCH_TERM = r"[\p{L}\p{N}]+"
URL = r"https?://\S+"
IDENTIFIER_TOKEN = r"\b[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*\b"
STABLE_IDENTIFIER = r"\b(?:[a-z]+[-_ ]?\d+[a-z\d]*|\d+[a-z]+|\d{2,})\b"
RELATIVE_DURATION = r"\bin\s+(\d+)\s+(hour|day|week|month)s?\b"
CUE_TIMES = r"(\d+):(\d{2}):(\d{2})\.(\d{3})\s+-->\s+(\d+):(\d{2}):(\d{2})\.(\d{3})"
SUBJECT_TERM = r"[a-z][a-z0-9]{1,}"
SUBJECT_STOP_TERMS = [
    "a", "an", "and", "at", "by", "for", "from", "has", "have", "i", "in", "is", "it",
    "my", "of", "on", "the", "their", "this", "to", "user", "with",
]

# --- identity ---------------------------------------------------------------
UUID_NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
UNIT_SEPARATOR = "\x1f"
CLAIM_CHANGE_COMMAND = "propose_event_claim_change"
CLAIM_CHANGE_VERSION = "v1"
