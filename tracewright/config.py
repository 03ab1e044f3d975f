"""Parameters of the hash-chain format and of ingestion.

Everything here is plain data that travels into tasks with the plan.
"""
from __future__ import annotations

from dataclasses import dataclass, field

SCHEMA_VERSION = 1
MAX_SEQUENCE = 1 << 53
ZERO_HASH = "0" * 64
# Findings of a kind that a report lists per chain; None: all of them.
DEFAULT_MAX_FAILURES = None
DEFAULT_CLOCK_SKEW_SECONDS = 300
# Rows of one stream that one ordered task handles (see operators/ordered.py).
BUCKET_ROWS = 10_000

# Patterns of the record format.
ID_PATTERN = r"^[a-z]{2,8}_[0-9A-Za-z]{10,64}\z"
STREAM_PATTERN = r"^[a-z0-9][a-z0-9._-]{0,63}\z"
KEY_ID_PATTERN = r"^ed25519:[0-9a-f]{32}\z"
HASH_PATTERN = r"^[0-9a-f]{64}\z"
TYPE_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,63}\z"
ACTION_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}\z"
TIME_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}Z\z"


@dataclass(frozen=True)
class Tags:
    """Domain-separation tags. A chain verifies only under its writer's tags."""

    payload: str = "audit:v1:payload"
    event: str = "audit:v1:event"
    event_signature: str = "audit:v1:event-signature"
    checkpoint: str = "audit:v1:checkpoint"
    checkpoint_signature: str = "audit:v1:checkpoint-signature"
    manifest: str = "audit:v1:manifest"
    manifest_signature: str = "audit:v1:manifest-signature"

    @classmethod
    def with_prefix(cls, prefix: str) -> "Tags":
        return cls(*(f"{prefix}:{suffix}" for suffix in (
            "payload", "event", "event-signature", "checkpoint",
            "checkpoint-signature", "manifest", "manifest-signature")))


@dataclass(frozen=True)
class JsonProfile:
    """How strictly JSON is read before it is put into canonical form."""

    max_depth: int = 128
    safe_numbers: bool = False
    disallow_nul: bool = False


STORED = JsonProfile()
INGEST = JsonProfile(max_depth=40, safe_numbers=True, disallow_nul=True)

# Member names that are always redacted (compared in lower case,
# letters and digits only) and the endings of compound names.
DENY_KEYS = (
    "password", "passwd", "pwd", "passphrase", "secret", "clientsecret",
    "token", "accesstoken", "refreshtoken", "idtoken", "sessiontoken",
    "csrftoken", "apikey", "xapikey", "authorization", "proxyauthorization",
    "cookie", "setcookie", "privatekey", "creditcard", "creditcardnumber",
    "cardnumber", "cvv", "cvc", "ssn", "otp", "mfacode", "totp", "pin",
)
DENY_SUFFIXES = ("password", "passwd", "secret", "token", "apikey", "privatekey")
REDACTED_VALUE = "[REDACTED]"


@dataclass(frozen=True)
class Settings:
    """Ingestion settings of a project."""

    redact_keys: tuple[str, ...] = ()
    redact_paths: tuple[str, ...] = ()
    redact_mode: str = "redact"          # redact | remove | mask
    disable_defaults: bool = False
    retain_states: str = "full"          # full | diff
    max_event_bytes: int = 0             # 0: the job's limit applies
    reserved_stream_prefix: str = "audit."


@dataclass(frozen=True)
class VerifyOptions:
    tags: Tags = field(default_factory=Tags)
    require_content: bool = True
    require_canonical: bool = True
    check_index: bool = True
    clock_skew_seconds: int = DEFAULT_CLOCK_SKEW_SECONDS
    max_failures: int | None = DEFAULT_MAX_FAILURES
    explain_links: bool = True
    bucket_rows: int = BUCKET_ROWS
    # Records are read in this column's order; line ordinals show duplicates and
    # reordering that a table sorted by sequence cannot.
    order_col: str = "sequence"
    batch_rows: int = 0                  # >0: findings are batched (evidence)
    signatures: bool = True
