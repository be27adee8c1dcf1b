"""Fixed values and table layouts of the distiller, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Thresholds in UTF-8 bytes, counts in lines, rows or columns.
BODY_FLOOR = 256
BLOCK_FLOOR = 64
USER_FLOOR = 40
DEDUP_FLOOR = 512
DIFF_FLOOR = 512
LOCKFILE_LINES = 20
CONTEXT_SECTION, CONTEXT_RUN = 15, 8
FOLD_RUN = 3
JSON_FLOOR = 64
TABLE_SAVING = 0.35
TABLE_ROWS, TABLE_COLUMNS = 3, 12
CELL_BYTES, ENVELOPE_BYTES, ENVELOPE_FIELDS = 80, 60, 8
HEAD_TAIL_FLOOR = 0.9
REF_HEX = 12
PROBE_BYTES, WINDOW_BYTES, WINDOWS = 8192, 32 * 1024, 3
OPENER_LINES = 12
DECISION_CAPACITY = 4096
BODY_TOO_LARGE = "body_too_large"

# Patterns that mark a failure line, in upper case.
FAILURES = [
    "--- FAIL", "FAIL:", "FAILED", "PANIC:", "FATAL", "ERROR", "EXCEPTION", "ASSERTIONERROR", "TRACEBACK", "BUILD FAILED", "✗",
    "EXIT STATUS", "NON-ZERO EXIT", "UNDEFINED:", "SYNTAXERROR", "SEGMENTATION FAULT", "SIGSEGV", "NULLPOINTEREXCEPTION",
]
# Tokens of test output, anywhere and at the start of a line.
TEST_TOKENS = ["--- FAIL", "--- PASS", "--- SKIP", "=== RUN", "=== CONT", "=== PAUSE", "go test", "testing:", "pytest", "PASSED", "FAILED", "vitest", "jest", "✓ ", "✗ ", "assert ", "AssertionError", "unittest"]
CRASH_STARTS = [
    "panic:", "goroutine ", "exit status ", "signal: ", "FAIL", "ok  ", "PASS", "--- FAIL", "--- PASS", "--- SKIP",
    "Traceback (most recent call last):", "E   ", "OK (", "Caused by:", "at java.", "Error: ", "AssertionError",
]
# Log levels and marks.
LOG_LEVELS = ["INFO", "WARN", "ERROR", "DEBUG", "TRACE", "FATAL"]
LOG_MARKS = ["[", "level=", "lvl="]
# How lines of source code and comments start.
CODE_OPENERS = [
    "package ", "import ", "from ", "func ", "type ", "const ", "var ", "def ", "async def ", "class ", "struct ", "impl ", "trait ",
    "enum ", "interface ", "namespace ", "using ", "module ", "export ", "fn ", "pub ", "#include", "#!", "@interface", "<?php",
]
CODE_STARTS = ["func ", "def ", "class ", "type ", "const ", "var ", "let ", "import ", "from ", "return ", "fn ", "pub ", "impl ", "struct ", "public ", "private ", "static ", "}"]
COMMENT_STARTS = ["//", "/*", "*", "#", "--", ";"]
# JSON members that carry no content, in lower case.
METADATA_KEYS = ["__typename", "_links", "trace_id", "request_id", "etag", "schema_version"]
# Names of lock files, and endings of generated files, in lower case.
LOCKFILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.sum", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock", "flake.lock"]
GENERATED = [".map", ".min.js", ".min.css"]
# Wrappers of tool output inside user text, and starts of such text as a whole.
WRAPPER_TAGS = ["tool_output", "tool_result", "command_output", "command_result", "file_content"]
WRAPPER_FENCES = ["```terminal", "```output", "```diff"]
WHOLE_STARTS = ["diff --git", "============================= test session starts", "=== RUN   "]
# Substrings of a body without which there is nothing to do.
CANDIDATES = ["tool", "```", "diff --git"]


@dataclass(frozen=True)
class Family:
    """Elision parameters of a model family."""

    min_bytes: int
    head: int
    tail: int
    max_kept: int = 50
    context_after: int = 2


# Model families, and the substrings of a model name that tell them, in order.
FAMILIES = {"claude": Family(4096, 30, 30), "generic": Family(2048, 20, 20), "gpt": Family(2048, 20, 20), "deepseek": Family(1024, 12, 12)}
FAMILY_MARKS = [("claude", ["claude"]), ("deepseek", ["deepseek"]), ("gpt", ["gpt", "o1", "o3"])]

#: Name in the markers that the distiller leaves in a text.
TAG = "distilled"
# The wording of markers.
ELIDED = "[... {tag}: {lines} middle lines elided · full text kept locally as {ref} {note}...]"
MORE_FAILURES = "· {dropped} more failure lines over cap={cap}, see local copy "
REPEATED = "[... {tag}: identical to the copy in turn {turn} above ({size} bytes) · ref {ref} ...]"


@dataclass(frozen=True)
class Limits:
    """Bounds in bytes; zero is no bound (for min_block: the floor of 64)."""

    max_body: int = 0
    max_block: int = 0
    min_block: int = 0

    @property
    def block_floor(self) -> int:
        return max(BLOCK_FLOOR, self.min_block)


REQUEST_LOG = "ts string, method string, path string, status int, format string, original_bytes long, sent_bytes long, saved_pct double, blocks int, memo_hits int, duration_ms double"
ORIGINALS = "ref string, text string"
DECISIONS = "family string, is_user boolean, content_sha string, out string, pass string, used long"
