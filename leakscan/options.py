"""Settings shared by every scan builder."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values, for callers who want such limits: version size above which
# history reports a blob instead of scanning it, largest env file, deepest
# env-file directory. Without them everything is scanned.
MAX_BLOB_BYTES = 10 * 1024 * 1024
MAX_ENV_FILE_BYTES = 1024 * 1024
MAX_ENV_FILE_DEPTH = 5


@dataclass(frozen=True)
class ScanOptions:
    """How to scan.

    ``inline_markers`` are the tool names whose ``<name>:allow`` comment
    silences a line. ``broadcast_limit_bytes`` bounds what a scan may broadcast
    (measured before it is used). Beyond it, and for keys that own more than
    ``hot_rows`` rows, joins spread a key over ``salt_buckets`` tasks.
    Allowlists of up to ``joined_entries`` entries become one expression.
    ``max_blob_bytes`` leaves larger versions of a history unscanned and counts
    them as oversized; by default there is no limit.
    """

    entropy: bool = True
    generic: bool = True
    ignore_inline_allow: bool = False
    default_excludes: bool = True
    inline_markers: tuple[str, ...] = ("leakscan", "gitleaks")
    max_blob_bytes: int | None = None
    broadcast_limit_bytes: int = 32 * 1024 * 1024
    salt_buckets: int = 64
    hot_rows: int = 100_000
    joined_entries: int = 200
