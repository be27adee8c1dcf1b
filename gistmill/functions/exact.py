"""The exact text operators in Python, for what Spark's functions cannot say.

Used inside Arrow UDFs, and by the tests as the yardstick of the native expressions.  All
lengths are bytes of UTF-8.  Nothing here raises on bad input: what cannot be parsed is left
as it is.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from bisect import bisect_right
from itertools import accumulate

from gistmill import schema as S

SPACES = "\t\n\v\f\r \x85\xa0                　"


def size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def ref(text: str) -> str:
    return sha(text)[: S.REF_HEX]


def _alternatives(words: list[str], flags: int = 0) -> re.Pattern:
    return re.compile("|".join(map(re.escape, words)), flags)


_FAILURE = _alternatives(S.FAILURES, re.IGNORECASE | re.ASCII)
_TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2}")
_DIAGNOSTIC = re.compile(r"[^:]+:[0-9]+:")
_DIGITS = re.compile(r"[0-9]+:")


def must_keep(line: str) -> bool:
    return bool(_FAILURE.search(line))


def is_diagnostic(line: str) -> bool:
    return bool(_DIAGNOSTIC.match(line)) and not _TIME.match(line) and not _DIGITS.match(line)


# ---------------------------------------------------------------- JSON values


class Number(float):
    """A JSON number that remembers how it was written."""

    raw: str

    def __new__(cls, raw: str):
        self = super().__new__(cls, raw)
        self.raw = raw
        return self


def _constant(name: str):
    raise ValueError(name)


def parse(text: str):
    """A strict JSON value with numbers as Number, members in document order; ValueError if it isn't one."""
    try:
        return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=_constant)
    except RecursionError:
        raise ValueError("nested too deeply") from None


def is_json(text: str) -> bool:
    try:
        parse(text)
    except ValueError:
        return False
    return True


def _digits(value: float) -> tuple[str, str, int]:
    """Sign, shortest digits d1d2... and the point p of value = 0.d1d2... * 10^p."""
    mantissa, _, power = repr(abs(float(value))).partition("e")
    whole, _, part = mantissa.partition(".")
    both = whole + part
    digits = both.lstrip("0")
    point = int(power or 0) + len(whole) - (len(both) - len(digits))
    digits = digits.rstrip("0")
    return "-" if math.copysign(1, value) < 0 else "", digits or "0", point if digits else 1


def _plain(digits: str, point: int) -> str:
    if point <= 0:
        return "0." + "0" * -point + digits
    if point >= len(digits):
        return digits + "0" * (point - len(digits))
    return digits[:point] + "." + digits[point:]


def _scientific(digits: str, point: int, width: int) -> str:
    power = point - 1
    return digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + f"e{'-' if power < 0 else '+'}{abs(power):0{width}d}"


def number_cell(value: float) -> str:
    """A number as a table cell: its shortest digits, with an exponent below 1e-4 and from 1e6."""
    sign, digits, point = _digits(value)
    if digits == "0":
        return sign + "0"
    return sign + (_plain(digits, point) if -4 <= point - 1 < 6 else _scientific(digits, point, 2))


def number_json(value: float) -> str:
    """A number in dense JSON: its shortest digits, with an exponent below 1e-6 and from 1e21."""
    sign, digits, point = _digits(value)
    if digits == "0":
        return sign + "0"
    return sign + (_plain(digits, point) if -6 <= point - 1 < 21 else _scientific(digits, point, 1 if point < 1 else 2))


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
_ESCAPED = re.compile('[\x00-\x1f"\\\\<>&\u2028\u2029\ud800-\udfff]')


def json_string(text: str) -> str:
    """A JSON string literal that is also safe inside HTML and scripts."""

    def one(m: re.Match) -> str:
        c = m[0]
        return _ESCAPES.get(c) or ("\\ufffd" if "\ud800" <= c <= "\udfff" else f"\\u{ord(c):04x}")

    return '"' + _ESCAPED.sub(one, text) + '"'


def dense(value) -> str:
    """Compact JSON with members in order of their names."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if math.isinf(value):
            raise ValueError("a number out of range")
        return number_json(value)
    if isinstance(value, str):
        return json_string(value)
    if isinstance(value, list):
        return "[" + ",".join(map(dense, value)) + "]"
    return "{" + ",".join(f"{json_string(k)}:{dense(v)}" for k, v in sorted(value.items())) + "}"


def cell(value) -> str:
    """A JSON value as text in a table cell; nested values as dense JSON."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return number_cell(value)
    return value if isinstance(value, str) else dense(value)


def written(value) -> str:
    """A JSON value in a column of a table: integers digit by digit, as ids must stay what they are, if they fit a cell; all else as in ``cell``."""
    if isinstance(value, Number) and len(value.raw) <= S.CELL_BYTES and value.raw.lstrip("-").isdigit():
        return value.raw
    return cell(value)


def shared_cell(value) -> str:
    """A value that all rows share: as in ``cell``, but for integers that a float cannot hold."""
    short, full = cell(value), written(value)
    return short if short == full or int(full) == int(float(full)) else full


# ---------------------------------------------------------------- J1-J11: JSON distilling


def is_metadata(key: str) -> bool:
    return key.lower() in S.METADATA_KEYS


def _rows_of_objects(value) -> bool:
    return isinstance(value, list) and len(value) >= S.TABLE_ROWS and isinstance(value[0], dict)


def _covers(parent: dict, array_key: str, budget: int) -> bool:
    """Whether a headline with ``budget`` scalar fields loses nothing of the array's siblings."""
    scalars = 0
    for key, value in parent.items():
        if key == array_key or is_metadata(key) or value is None or value in ({}, []):
            continue
        if isinstance(value, (dict, list)):
            return False
        scalars += 1
    return scalars <= budget


def liftable(root) -> tuple[str, ...] | None:
    """The path of the array that can become a table without loss; None if there is none."""
    if isinstance(root, list):
        return () if _rows_of_objects(root) else None
    if not isinstance(root, dict):
        return None
    path: tuple[str, ...] | None = next(((k,) for k, v in root.items() if _rows_of_objects(v)), None)
    if path is None:
        inner = ((k, n) for k, v in root.items() if isinstance(v, dict) for n, w in v.items() if _rows_of_objects(w))
        path = next(inner, None)
    if path is None:
        return None
    if len(path) == 1:
        return path if _covers(root, path[0], S.ENVELOPE_FIELDS) else None
    return path if _covers(root, path[0], 0) and _covers(root[path[0]], path[1], S.ENVELOPE_FIELDS) else None


def cut_bytes(text: str, most: int) -> tuple[str, bool]:
    """At most ``most`` bytes: a longer text keeps three less and gets an ellipsis; a character that is cut becomes U+FFFD."""
    if size(text) <= most:
        return text, False
    raw = text.encode("utf-8", "surrogatepass")[: most - 3]
    kept = raw.decode("utf-8", "ignore")
    return kept + "\ufffd" * (len(raw) - size(kept)) + "...", True


def table_cell(text: str) -> tuple[str, bool]:
    """J8."""
    return cut_bytes(text.replace("|", "\\|").replace("\n", " "), S.CELL_BYTES)


def envelope(parent: dict, array_key: str) -> list[tuple[str, str]]:
    """Scalar siblings of the array, as text."""
    out = []
    for key, value in parent.items():
        if key == array_key or is_metadata(key) or value is None or isinstance(value, (dict, list)):
            continue
        if isinstance(value, Number):
            plain = value.raw.lstrip("-").isdigit() or math.isinf(value)
            sign, digits, point = ("", "0", 1) if plain else _digits(value)
            text = value.raw if plain else sign + _plain(digits, point)
        else:
            text = cell(value)
        out.append((key, cut_bytes(table_cell(text)[0], S.ENVELOPE_BYTES)[0]))
        if len(out) == S.ENVELOPE_FIELDS:
            break
    return out


def table(root, path: tuple[str, ...], tag: str) -> str | None:
    """The array at ``path`` as a headline and a table."""
    parent, items = None, root
    for key in path:
        parent, items = items, items[key]
    if not all(isinstance(i, dict) and i for i in items):
        return None
    columns = [k for k in items[0] if not is_metadata(k)]
    if not 0 < len(columns) <= S.TABLE_COLUMNS or not all(any(k in item for k in columns) for item in items[1:]):
        return None
    shown = {c: [None if item.get(c) is None else table_cell(written(item[c])) for item in items] for c in columns}
    constant = []
    for c in columns:
        first = shown[c][0]
        if first and not first[1] and first[0] not in ("", "-") and all(v == first for v in shown[c]):
            constant.append((c, table_cell(shared_cell(items[0][c]))[0]))
    varying = [c for c in columns if c not in dict(constant)]
    truncated = sum(v is not None and v[1] for c in varying for v in shown[c])
    head = f"[... {tag} table: {len(items)} rows"
    if path:
        head += f" · from {json.dumps('.'.join(path), ensure_ascii=False)}"
    head += "".join(f" · {k}={v}" for k, v in (envelope(parent, path[-1]) if path else []))
    head += "".join(f" · all rows: {k}={v}" for k, v in constant)
    if truncated:
        head += f" · {truncated} cells truncated to {S.CELL_BYTES} chars"
    head += " ...]\n"
    if not varying:
        return head
    rows = ["| " + " | ".join(varying) + " |", "|" + "---|" * len(varying)]
    rows += ["| " + " | ".join("-" if shown[c][i] is None else shown[c][i][0] for c in varying) + " |" for i in range(len(items))]
    return head + "\n".join(rows) + "\n"


def lift(text: str) -> tuple[str, int, list[str]] | None:
    """The path, rows and dropped keys of the array that would become a table: keys that later rows have and the first, which names the columns, has not."""
    try:
        root = parse(text.strip(SPACES))
        path = liftable(root)
    except ValueError:
        return None
    if path is None:
        return None
    items = root
    for key in path:
        items = items[key]
    dropped = {k for item in items if isinstance(item, dict) for k in item if k not in items[0] and not is_metadata(k)}
    return ".".join(path), len(items), sorted(dropped)


def pruned(value) -> tuple[object, bool]:
    """Without null and metadata members, null elements and members that are or become empty; and whether that changed it."""
    if isinstance(value, dict):
        out, changed = {}, False
        for key, item in value.items():
            if item is None or is_metadata(key):
                changed = True
                continue
            kept, sub = pruned(item)
            changed |= sub
            if kept in ({}, []) and isinstance(kept, (dict, list)):
                changed = True
                continue
            out[key] = kept
        return out, changed
    if isinstance(value, list):
        results = [pruned(item) for item in value if item is not None]
        return [r[0] for r in results], len(results) < len(value) or any(r[1] for r in results)
    return value, False


_PRUNABLE = re.compile(r"(?:null|etag|trace_id|request_id|schema_version|_links|__typename)|\{[ \t\n\r]*\}|\[[ \t\n\r]*\]|\\u00", re.IGNORECASE | re.ASCII)


def is_prunable(text: str) -> bool:
    """P17."""
    return any(m[0] != "\\U00" for m in _PRUNABLE.finditer(text))


def bracketed(text: str) -> bool:
    return text.lstrip(SPACES)[:1] in ("{", "[")


def distill_json(text: str, tag: str = S.TAG) -> tuple[str, str] | None:
    """(pass, result) of table lifting, else of pruning; None if neither saves enough."""
    trimmed = text.strip(SPACES)
    if size(trimmed) < S.JSON_FLOOR or trimmed[0] not in "{[":
        return None
    try:
        root = parse(trimmed)
        path = liftable(root)
        if path is None and not is_prunable(trimmed):
            return None
        if path is not None and (out := table(root, path, tag)) is not None and size(out) <= size(text) * (1 - S.TABLE_SAVING):
            return "table", out
        value, changed = pruned(root)
        if changed and size(out := dense(value)) < size(text) * 9 // 10:
            return "prune", out
    except (ValueError, RecursionError):
        pass
    return None


# ---------------------------------------------------------------- T5-T8: terminal text

_ANSI = re.compile("\x1b\\[[^\x40-\x7e]*[\x40-\x7e]|\x1b\\](?:(?!\x1b\\\\)[^\x07])*(?:\x07|\x1b\\\\)")


def strip_ansi(text: str) -> str:
    return _ANSI.sub("", text) if "\x1b" in text else text


def clean_returns(text: str) -> str:
    text = text.replace("\r\n", "\n")
    if "\r" not in text:
        return text

    def last(line: str) -> str:
        return next((p for p in reversed(line.split("\r")) if p.strip(SPACES)), "") if "\r" in line else line

    return "\n".join(map(last, text.split("\n")))


def fold_repeats(text: str) -> str:
    lines = text.split("\n")
    if len(lines) <= S.FOLD_RUN:
        return text
    out: list[str] = []
    at = 0
    while at < len(lines):
        end = at + 1
        while end < len(lines) and lines[end] == lines[at] and lines[at].strip(SPACES):
            end += 1
        out += [lines[at], f"    [... line repeated {end - at - 1} times ...]"] if end - at > S.FOLD_RUN else lines[at:end]
        at = end
    return "\n".join(out)


def sanitize(text: str) -> str:
    return fold_repeats(clean_returns(strip_ansi(text))) if size(text) >= S.BLOCK_FLOOR else text


# ---------------------------------------------------------------- T9-T11: diffs


def is_diff(text: str) -> bool:
    return "diff --git " in text or ("--- a/" in text and "+++ b/" in text) or ("--- " in text and "+++ " in text and "@@ -" in text)


def is_generated(path: str) -> bool:
    base = path.rstrip("/").rpartition("/")[2].lower()
    return base in S.LOCKFILES or base.endswith(tuple(S.GENERATED))


def compact_context(lines: list[str], tag: str) -> list[str]:
    """Long runs of unchanged lines keep two at either end."""
    if len(lines) < S.CONTEXT_SECTION:
        return lines
    out: list[str] = []
    at = 0
    while at < len(lines):
        end = at
        while end < len(lines) and lines[end].startswith(" "):
            end += 1
        run = lines[at:end]
        out += [*run[:2], f"    [... {tag}: {len(run) - 4} unchanged context lines elided ...]", *run[-2:]] if len(run) > S.CONTEXT_RUN else run
        if end < len(lines):
            out.append(lines[end])
        at = end + 1
    return out


def sections(text: str) -> list[tuple[str, list[str]]]:
    """(path, lines) of each file of a diff; lines before the first header are a section too."""
    found: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            fields = line.split()
            found.append((fields[3].removeprefix("b/") if len(fields) >= 4 else "", [line]))
            continue
        path, lines = found[-1]
        if line.startswith("+++ b/") and not path:
            found[-1] = (line.removeprefix("+++ b/"), lines)
        lines.append(line)
    return [s for s in found if s[1]]


def distill_diff(text: str, tag: str = S.TAG) -> str | None:
    """Lock files become one line, long context is compacted; None if nothing changes."""
    if not is_diff(text) or size(text) < S.DIFF_FLOOR:
        return None
    out, changed = [], False
    for path, lines in sections(text):
        if path and is_generated(path) and len(lines) > S.LOCKFILE_LINES:
            added = sum(s.startswith("+") and not s.startswith("+++") for s in lines)
            removed = sum(s.startswith("-") and not s.startswith("---") for s in lines)
            fresh = [f"[... {tag}: {len(lines)} lines of {path} diff elided (+{added}/-{removed}) · ref {ref(chr(10).join(lines))} ...]"]
            changed = True
        else:
            fresh = compact_context(lines, tag)
            changed |= len(fresh) != len(lines)
        out += fresh
    return "\n".join(out) if changed else None


# ---------------------------------------------------------------- T1-T3: elision


_FAILURE_BYTES = [p.encode() for p in S.FAILURES if not any(q != p and q in p for q in S.FAILURES)]


def failing(lines: list[str]) -> set[int]:
    """Indexes of failure lines: each pattern is looked for in all lines at once, then from the next line on."""
    raw = "\n".join(lines).encode("utf-8", "surrogatepass").upper()
    ends = list(accumulate(len(part) + 1 for part in raw.split(b"\n")))
    found = set()
    for pattern in _FAILURE_BYTES:
        at = raw.find(pattern)
        while at >= 0:
            line = bisect_right(ends, at)
            found.add(line)
            at = raw.find(pattern, ends[line])
    return found


def elide(text: str, family: str, tag: str = S.TAG) -> str | None:
    p = S.FAMILIES[family]
    lines = text.split("\n")
    if size(text) < p.min_bytes or f"[... {tag}:" in text or len(lines) <= p.head + p.tail + 2:
        return None
    middle = lines[p.head : len(lines) - p.tail]
    kept: list[str] = []
    dropped, after = 0, 0
    for i in sorted(failing(middle)):
        if i < after:  # context of the failure before, kept or over the cap with it
            continue
        if len(kept) < p.max_kept:
            after = i + 1 + p.context_after
            kept += middle[i:after][: p.max_kept - len(kept)]
        else:
            dropped += 1
    note = S.MORE_FAILURES.format(dropped=dropped, cap=p.max_kept) if dropped else ""
    marker = S.ELIDED.format(tag=tag, lines=len(middle) - len(kept), ref=ref(text), note=note)
    out = "\n".join([*lines[: p.head], marker, *kept, *lines[len(lines) - p.tail :]])
    return out if size(out) <= size(text) * S.HEAD_TAIL_FLOOR else None


# ---------------------------------------------------------------- P7-P11: kinds


def _windows(raw: bytes) -> list[bytes]:
    w = S.WINDOW_BYTES
    if len(raw) <= S.WINDOWS * w:
        return [raw]
    middle = len(raw) // 2
    return [raw[:w], raw[middle - w // 2 : middle + w // 2], raw[-w:]]


def _lines(raw: bytes) -> list[str]:
    lines = raw.decode("utf-8", "replace").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _opens_code(head: bytes) -> bool:
    seen = 0
    for line in _lines(head):
        if line.startswith(tuple(S.CODE_OPENERS)):
            return True
        bare = line.strip(SPACES)
        if not bare or bare.startswith(tuple(S.COMMENT_STARTS)):
            continue
        seen += 1
        if seen >= S.OPENER_LINES:
            return False
    return False


def _dated(raw: bytes) -> int:
    """Dated lines, up to three."""
    n = 0
    for line in raw.split(b"\n"):
        n += len(line) > 20 and (line[4:5] == line[7:8] == b"-" or line[2:3] == line[5:6] == b":")
        if n == 3:
            break
    return n


def classify(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    head = raw[: S.PROBE_BYTES]
    bare = head.decode("utf-8", "replace").strip(SPACES)
    if bare and bare[0] + bare[-1] in ("{}", "[]") and len(bare) > 1 and is_json(bare):
        return "json"
    windows = _windows(raw)
    lines = [line.strip(SPACES) for w in windows for line in _lines(w)]
    if _opens_code(head) and sum(s.startswith(tuple(S.CODE_STARTS)) for s in lines) >= 2:
        return "code"
    count = lambda tokens: sum(w.count(t.encode()) for w in windows for t in tokens)
    if count(S.TEST_TOKENS) + sum(s.startswith(tuple(S.CRASH_STARTS)) + is_diagnostic(s) for s in lines) >= 3:
        return "test_output"
    dated = sum(map(_dated, windows))
    if count(S.LOG_LEVELS) + dated >= 3 and (dated >= 3 or any(m.encode() in head for m in S.LOG_MARKS)):
        return "log_output"
    return "prose"


# ---------------------------------------------------------------- P15, P16, T12, T13: the cascade


MACHINE = ("test_output", "log_output")


def has_structure(text: str) -> bool:
    """The part of the gate that does not classify: JSON that could change, a diff, escape sequences or carriage returns."""
    if "\x1b" in text or "\r" in text or is_diff(text):
        return True
    if not bracketed(text):
        return False
    bare = text.strip(SPACES)
    if is_prunable(bare):
        return True
    try:
        return liftable(parse(bare)) is not None
    except ValueError:
        return False


def gate(text: str) -> bool:
    """Whether any pass could change the text."""
    return has_structure(text) or classify(text) in MACHINE


def distill(text: str, family: str, limits: S.Limits = S.Limits(), tag: str = S.TAG, fold_ungated: bool = False) -> tuple[str, str]:
    """(result, pass) of one block; the text itself and ``none`` where no pass applies."""
    n = size(text)
    if n < limits.block_floor or (limits.max_block and n > limits.max_block):
        return text, "none"
    kind = None
    if not has_structure(text):
        kind = classify(text)
        if kind not in MACHINE and not fold_ungated:
            return text, "none"
    if (out := distill_diff(text, tag)) is not None:
        return out, "diff"
    if bracketed(text) and (found := distill_json(text, tag)):
        return found[1], found[0]
    kind = kind or classify(text)
    if kind in MACHINE:
        out = elide(clean_returns(strip_ansi(text)), family, tag)
        return (out, "elide") if out is not None else (text, "none")
    if kind != "code" and size(out := sanitize(text)) < n * 9 // 10:
        return out, "terminal"
    return text, "none"


def distill_user(text: str, family: str, limits: S.Limits = S.Limits(), tag: str = S.TAG) -> tuple[str, str]:
    """User text: only what stands in wrappers of tool output, or a text that is tool output as a whole."""
    if size(text) < S.USER_FLOOR:
        return text, "none"
    out = text
    for opening, inside, closing in _wrappers():
        at = 0
        while (start := out.find(opening, at)) >= 0:
            begin = out.find(inside, start)
            end = out.find(closing, begin + 1) if begin >= 0 else -1
            if begin < 0 or end < 0:
                break
            inner = out[begin + 1 : end]
            fresh = distill(inner, family, limits, tag)[0]
            out = out[: begin + 1] + fresh + out[end:]
            at = begin + 1 + len(fresh) + len(closing)
    if out == text and text.strip(SPACES).startswith(tuple(S.WHOLE_STARTS)):
        out = distill(text, family, limits, tag)[0]
    return out, "none" if out == text else "user"


def could_change(text: str, family: str, is_user: bool) -> bool:
    """Whether a block would be rewritten under some tag and limits: under none and the shortest tag, or but for a marker that is in it already."""
    if size(text) < S.USER_FLOOR:
        return False
    marked = "[... " in text and (is_user or gate(text))
    return marked or (distill_user if is_user else distill)(text, family, tag="")[0] != text


def _wrappers() -> list[tuple[str, str, str]]:
    """(opening, what ends the opening, closing) of each wrapper."""
    return [(f"<{t}", ">", f"</{t}>") for t in S.WRAPPER_TAGS] + [(f, "\n", "\n```") for f in S.WRAPPER_FENCES]
