"""Constants that give results their meaning (fixed values)."""

TOOLS = ("claude", "codex", "trae")
IDLE_GAP_S = 90
MIN_INTERVAL_S = 15
HISTORY_RETENTION_DAYS = 30
#: Range label, span and step of the trend windows, in seconds.
TREND_SPECS = (("1D", 86_400, 1_800), ("3D", 259_200, 5_400), ("7D", 604_800, 10_800), ("15D", 1_296_000, 21_600), ("30D", 2_592_000, 43_200))
#: How strongly a source of a project name counts, and the confidence it carries.
SOURCE_RANK = {"transcript_project": 5, "transcript_cwd": 4, "transcript_path": 3, "config_root_parent": 2, "unassigned": 1}
SOURCE_CONFIDENCE = {"transcript_project": "high", "transcript_cwd": "high", "transcript_path": "medium", "config_root_parent": "low", "unassigned": "low"}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1}
FRESHNESS_RANK = {"active": 0, "idle": 1, "stale": 2}
PROVENANCE = ("transcript_path", "transcript_activity", "command_hint", "fallback_session_id")
#: Words of a command line that stay in its redacted form.
IDENTITY_WORDS = ("apply", "auth", "chat", "diff", "doctor", "exec", "help", "login", "logout", "mcp", "resume", "review", "run", "serve", "server", "status", "update", "version")
GENERIC_DIRECTORIES = ("sessions", "archived_sessions", "projects", "tmp", "unknown", "unassigned")
HOME_DIRECTORIES = ("users", "home", "profiles")
TEMPORARY_PREFIXES = ("/tmp", "/private/tmp", "/var/tmp", "/var/folders", "/private/var/folders")


def stale_after(gap_s: int) -> int:
    """Seconds without an event after which a session is stale."""
    return max(3 * (gap_s if gap_s > 0 else IDLE_GAP_S), 300)


def recent_window(gap_s: int) -> int:
    """Seconds within which a session counts as newly started."""
    return min(max(10 * (gap_s if gap_s > 0 else IDLE_GAP_S), 900), 3600)


def foreground_lookback(gap_s: int) -> int:
    return min(max(80 * gap_s, 7200), 21_600)


def refresh_interval(seconds: int) -> int:
    """0 means paused; anything shorter than 30 s becomes 30 s."""
    return 0 if seconds <= 0 else max(seconds, 30)
