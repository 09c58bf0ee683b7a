"""Constants, patterns and texts that results must reproduce exactly."""

# -- time and size limits --------------------------------------------------
ANCHOR_DELAY_WARN_MS = 60_000
TIME_GAP_WARN_MS = 2_000
LEDGER_RETENTION_DAYS = 30
CACHE_MAX_SEGMENTS = 400
CACHE_RETENTION_MS = 180_000
INCIDENT_BEFORE_MS = 30_000
INCIDENT_AFTER_MS = 30_000
BACKOFF_FIRST_MS = 1_000
BACKOFF_MAX_MS = 30_000
MANIFEST_MAX_HASHES = 2_000
MANIFEST_MAX_BYTES = 1_000_000
FEED_NEWEST = 300
PICKER_NEWEST = 500

# -- patterns and text formats ---------------------------------------------
GENESIS_PREFIX = "GENESIS|"
HEX64_PATTERN = "^[0-9a-f]{64}$"
UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
VIDEO_NAME_PATTERN = r"(?i)\.(webm|mp4|mkv|mov)$"
# every blank that a Unicode-aware trim removes, plus the byte order mark (Java class)
BLANKS = r"\s\p{Z}\x{FEFF}"
MANIFEST_LINE_PATTERN = r"(?i)^([a-f0-9]{64})(?:[ \t]+\*?.+)?$"
# defaults of parameters: a deployment passes its own tag and file prefix
DEFAULT_PROTOCOL = "segment-v1"
DEFAULT_FILE_PREFIX = "clip"

# -- texts of file verdicts --------------------------------------------------
FILE_HASH_CHANGED = "Server record for this segment no longer matches its original hash."
FILE_SIZE_CHANGED = "Size differs from the size recorded at capture."
FILE_BAD_SIGNATURE = "Record signature is invalid (not produced by the registered device)."
FILE_BAD_CHAIN = "Record content does not match its chain hash (record altered)."
FILE_BAD_LINK = "Hash-chain link to the previous segment is broken."
FILE_RENAMED = "File name says seq %d but content is seq %d — file renamed or reordered."
FILE_LATE_ANCHOR = "Hash anchored %s after capture (buffered while offline)."
FILE_REPEATED = "Same segment submitted more than once."
FILE_CONTENT_DIFFERS = "Content hash does not match the hash registered at capture time."
FILE_SIZE_DIFFERS = "Size %s B ≠ recorded %s B."
FILE_NO_RECORD = "No server record for this segment (never registered, or expired and purged)."
FILE_NO_HINT = "Hash not registered on the server and file name carries no segment id."

# -- texts of record and session audits --------------------------------------
RECORD_BAD_CHAIN = "Record fields do not match chain_hash."
RECORD_BAD_SIGNATURE = "Invalid device signature."
RECORD_OTHER_DEVICE = "Record signed by a different device."
RECORD_BAD_LINK = "prev_chain_hash does not link to the previous record."
RECORD_REPEATED_SEQ = "Duplicate sequence number."
SESSION_TIME_GAP = "Time gap of %s before seq %d."
SESSION_NO_KEY = "Device public key not found — signatures cannot be verified."
SESSION_EMPTY = "No server records for this session (expired or never transmitted)."
SESSION_HEAD_EXPIRED = (
    "Records before seq %d are no longer on the server (expired) — chain verified from seq %d."
)
SESSION_MISSING = "Server chain has missing record(s): %s."
SESSION_BAD = "%d server record(s) fail integrity checks: seq %s."
SESSION_EVIDENCE_GAP = "Evidence is missing segment(s) %s inside the submitted time range."
SUMMARY_FILES = (
    "%d file(s) checked: %d authentic, %d modified, %d forged, %d unknown, %d duplicate."
)
SUMMARY_SESSION = (
    "Session %s: %d server record(s), %d valid signature(s), %d broken link(s), "
    "%d segment(s) missing from evidence."
)
PLACEHOLDER_NOTE = "Synthetic placeholder (video not available locally or in the cloud)"

# -- texts of hash lists and the live feed -----------------------------------
MANIFEST_BAD_LINE = "Line %d must start with a 64-character SHA-256 hash."
MANIFEST_TOO_LONG = "Use no more than 2,000 hashes per list."
MANIFEST_EMPTY = "Add at least one SHA-256 hash."
LIVE_BAD_CHAIN = "chain hash mismatch"
LIVE_BAD_SIGNATURE = "bad signature"
LIVE_BAD_LINK = "broken chain link"

# -- similarity ---------------------------------------------------------------
MAX_HAMMING = 10
MIN_FUZZY_SCORE = 50
MAX_LOCALITY_DISTANCE = 30
MAX_COSINE_DISTANCE = 0.15
MAX_EUCLIDEAN = 2.5
SWEEP_THRESHOLDS = (5, 8, 10, 12, 15, 20, 25)
FUZZY_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
FUZZY_MIN_BLOCK = 3
FUZZY_BLOCKS = 64
FUZZY_WINDOW = 7
FUZZY_MULTIPLIER = 1756695921
FUZZY_SEED = 5381
FUZZY_FACTOR = 33
LOCALITY_WINDOW = 5
LOCALITY_FACTOR = 31
GREY_WEIGHTS = (0.299, 0.587, 0.114)

# -- NIST P-256 domain parameters (FIPS 186-4) --------------------------------
P256_P = 0xFFFFFFFF00000001000000000000000000000000FFFFFFFFFFFFFFFFFFFFFFFF
P256_N = 0xFFFFFFFF00000000FFFFFFFFFFFFFFFFBCE6FAADA7179E84F3B9CAC2FC632551
P256_B = 0x5AC635D8AA3A93E7B3EBBD55769886BC651D06B0CC53B0F63BCE3C3E27D2604B
P256_GX = 0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296
P256_GY = 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5
