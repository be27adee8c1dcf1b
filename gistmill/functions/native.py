"""Column expressions: everything that Spark's own functions say exactly.

Lengths are UTF-8 bytes (octet_length), patterns are literal alternations, so plans stay
inside whole-stage code generation as far as Spark's expressions allow.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill import schema as S


def any_of(literals: list[str], flags: str = "") -> str:
    """A regular expression that matches any of the literals."""
    return flags + "(" + "|".join(re.sub(r"([\\.^$|?*+()\[\]{}\-])", r"\\\1", x) for x in literals) + ")"


#: Of the patterns those that hold no other one: a line that holds any holds one of these.
FAILURE = any_of([p for p in S.FAILURES if not any(q != p and q in p for q in S.FAILURES)], "(?i)")
#: White space inside a line, at its start; and what is left of a line that goes on.
_INDENT, _GOES_ON = r"(?dmU)^[\s&&[^\n]]*+", r"(?=.*\S)"
TIME_PREFIX = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}:[0-9]{2}:[0-9]{2})"
DIAGNOSTIC = r"^[^:]+:[0-9]+:"
ALL_DIGITS = r"^[0-9]+:"
_CRASH_LINE = _INDENT + "(?:" + "|".join(any_of([x]) + (_GOES_ON if x.endswith(" ") else "") for x in S.CRASH_STARTS) + ")"
_DIAGNOSTIC_LINE = _INDENT + rf"(?!{TIME_PREFIX[1:]}|{ALL_DIGITS[1:]})[^:\n]+:[0-9]+:"
PRUNABLE = r"(?i)(null|etag|trace_id|request_id|schema_version|_links|__typename)|\{[ \t\n\r]*\}|\[[ \t\n\r]*\]"
CSI = "\x1b\\[[^\x40-\x7e]*[\x40-\x7e]"
OSC = "\x1b\\](?:(?!\x1b\\\\)[^\x07])*(?:\x07|\x1b\\\\)"


def worded(template: str, **values: Column) -> Column:
    """A marker: the template with its names replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def family(model: Column) -> Column:
    """The model family of a model name."""
    low = F.lower(F.coalesce(model, F.lit("")))
    out = None
    for name, marks in S.FAMILY_MARKS:
        test = low.rlike(any_of(marks))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("generic")


def family_value(name: Column, field: str) -> Column:
    """T4: a parameter of a family, as a CASE over the four of them."""
    out = None
    for key, params in S.FAMILIES.items():
        value = F.lit(getattr(params, field))
        out = F.when(name == key, value) if out is None else out.when(name == key, value)
    return out


def in_bounds(text: Column, limits: S.Limits = S.Limits()) -> Column:
    """P5: whether a block is long and short enough to be distilled."""
    size = F.octet_length(text)
    inside = size >= limits.block_floor
    return inside & (size <= limits.max_block) if limits.max_block else inside


def body_too_large(body: Column, limits: S.Limits = S.Limits()) -> Column:
    """P1."""
    return F.octet_length(body) > limits.max_body if limits.max_body else F.lit(False)


def bails_out(body: Column) -> Column:
    """Too short, or without any sign of tool output."""
    signs = [F.contains(body, F.lit(x)) for x in S.CANDIDATES]
    return (F.octet_length(body) < S.BODY_FLOOR) | ~(signs[0] | signs[1] | signs[2])


def ref(text: Column) -> Column:
    """the first twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, S.REF_HEX)


def must_keep(line: Column) -> Column:
    """P12."""
    return line.rlike(FAILURE)


def time_prefixed(line: Column) -> Column:
    """P10."""
    return line.rlike(TIME_PREFIX)


def diagnostic(line: Column) -> Column:
    """``path:digits:`` at the start, where path is not a time nor all digits."""
    return line.rlike(DIAGNOSTIC) & ~line.rlike(TIME_PREFIX) & ~line.rlike(ALL_DIGITS)


def unified_diff(text: Column) -> Column:
    """P13."""
    has = lambda x: F.contains(text, F.lit(x))
    return has("diff --git ") | (has("--- a/") & has("+++ b/")) | (has("--- ") & has("+++ ") & has("@@ -"))


def generated_path(path: Column) -> Column:
    """Lock files and generated files, by the last part of the path."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    return base.isin(*S.LOCKFILES) | base.rlike(any_of(S.GENERATED) + "$")


def prunable(text: Column) -> Column:
    """Whether pruning could change a JSON text at all."""
    return text.rlike(PRUNABLE) | F.contains(text, F.lit("\\u00"))


def strip_ansi(text: Column) -> Column:
    """T5: without CSI and OSC sequences; unfinished ones stay."""
    return F.regexp_replace(text, CSI + "|" + OSC, "")


def clean_returns(text: Column) -> Column:
    """CRLF is LF; of what else carriage returns overwrite, the last non-blank part of a line stays."""
    flat = F.replace(text, F.lit("\r\n"), F.lit("\n"))

    def last(line: Column) -> Column:
        parts = F.filter(F.split(line, "\r"), lambda p: p.rlike(r"(?U)\S"))
        return F.when(F.contains(line, F.lit("\r")), F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))).otherwise(line)

    return F.when(F.contains(flat, F.lit("\r")), F.array_join(F.transform(F.split(flat, "\n"), last), "\n")).otherwise(flat)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often, and in whatever loop, it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold_repeats(text: Column) -> Column:
    """More than three equal non-blank lines in a row become one and a note; linear in the lines, as runs are told by their starts."""

    def folded(lines: Column) -> Column:
        fresh = lambda x, i: (i == 0) | (x != F.get(lines, i - 1)) | ~x.rlike(r"(?U)\S")
        starts = F.array_compact(F.transform(lines, lambda x, i: F.when(fresh(x, i), i)))

        def run(at: Column, n: Column) -> Column:
            line = F.get(lines, at)
            note = F.concat(line, F.lit("\n    [... line repeated "), (n - 1).cast("string"), F.lit(" times ...]"))
            return F.when(n == 1, line).when(n > S.FOLD_RUN, note).otherwise(F.array_join(F.array_repeat(line, n), "\n"))

        parts = _let(starts, lambda s: F.transform(s, lambda at, k: run(at, F.coalesce(F.get(s, k + 1), F.size(lines)) - at)))
        return F.array_join(parts, "\n")

    return _let(F.split(text, "\n"), lambda lines: F.when(F.size(lines) <= S.FOLD_RUN, F.array_join(lines, "\n")).otherwise(folded(lines)))


def _rescued(lines: Column, family_name: Column) -> Column:
    """(kept lines, place after the context of the last failure kept, failures over the cap) of the middle lines; a fold over failures only."""
    value = lambda field: family_value(family_name, field)
    head, n = value("head"), F.greatest(F.lit(0), F.size(lines) - value("head") - value("tail"))
    failures = F.array_compact(F.transform(F.slice(lines, head + 1, n), lambda line, i: F.when(must_keep(line), i)))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("after"), F.lit(0).alias("dropped"))

    def step(state: Column, i: Column) -> Column:
        free, past = value("max_kept") - F.size(state["kept"]), i < state["after"]
        take = ~past & (free > 0)
        block = F.slice(lines, head + i + 1, F.least(value("context_after") + 1, free, n - i))
        return F.struct(
            F.when(take, F.concat(state["kept"], block)).otherwise(state["kept"]).alias("kept"),
            F.when(take, i + 1 + value("context_after")).otherwise(state["after"]).alias("after"),
            F.when(past | take, state["dropped"]).otherwise(state["dropped"] + 1).alias("dropped"),
        )

    return F.aggregate(failures, start, step)


def _assembled(text: Column, lines: Column, done: Column, family_name: Column, tag: str) -> Column:
    """Head, marker, rescued lines and tail."""
    value = lambda field: family_value(family_name, field)
    head, tail = value("head"), value("tail")
    count = F.greatest(F.lit(0), F.size(lines) - head - tail) - F.size(done["kept"])
    note = F.when(done["dropped"] > 0, worded(S.MORE_FAILURES, dropped=done["dropped"], cap=value("max_kept"))).otherwise("")
    marker = worded(S.ELIDED, tag=F.lit(tag), lines=count, ref=ref(text), note=note)
    parts = F.concat(F.slice(lines, F.lit(1), head), F.array(marker), done["kept"], F.slice(lines, F.greatest(F.lit(1), F.size(lines) - tail + 1), tail))
    return F.array_join(parts, "\n")


def _accepted(text: Column, lines: Column, made: Column, family_name: Column, tag: str) -> Column:
    """``made`` where elision applies and saves a tenth, else the text."""
    value = lambda field: family_value(family_name, field)
    applies = (F.octet_length(text) >= value("min_bytes")) & ~F.contains(text, F.lit(f"[... {tag}:")) & (F.size(lines) > value("head") + value("tail") + 2)
    return F.when(applies & (F.octet_length(made) <= F.octet_length(text) * S.HEAD_TAIL_FLOOR), made).otherwise(text)


def elided(text: Column, family_name: Column, tag: str = S.TAG) -> Column:
    """T1-T3 as one expression."""
    made = lambda lines: _let(_rescued(lines, family_name), lambda done: _assembled(text, lines, done, family_name, tag))
    return _let(F.split(text, "\n"), lambda lines: _let(made(lines), lambda out: _accepted(text, lines, out, family_name, tag)))


def with_elision(df: DataFrame, text: str, family_name: Column, out: str, tag: str = S.TAG) -> DataFrame:
    """T1-T3 as column ``out``, a projection a step, so that Spark folds a text once however often the fold is used."""
    steps = df.withColumn("gm_lines", F.split(text, "\n"))
    lines = F.col("gm_lines")
    steps = steps.withColumn("gm_done", _rescued(lines, family_name))
    steps = steps.withColumn("gm_made", _assembled(F.col(text), lines, F.col("gm_done"), family_name, tag))
    return steps.withColumn(out, _accepted(F.col(text), lines, F.col("gm_made"), family_name, tag)).drop("gm_lines", "gm_done", "gm_made")


def token_count(text: Column, tokens: list[str]) -> Column:
    """non-overlapping occurrences, summed over the tokens.

    Where no token starts another, and none ends as it starts, that is the number of places where any token starts, found in one pass.
    """
    if any(a != b and b.startswith(a) or a == b and any(a.startswith(a[i:]) for i in range(1, len(a))) for a in tokens for b in tokens):
        gone = [(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(t), F.lit("")))) / F.lit(len(t.encode())) for t in tokens]
        return reduce(lambda a, b: a + b, [g.cast("int") for g in gone])
    first = "".join(re.sub(r"([\\\]\[^&-])", r"\\\1", c) for c in sorted({t[0] for t in tokens}))
    return F.regexp_count(text, F.lit(f"(?=[{first}]){any_of(tokens).replace('(', '(?=', 1)}"))


def router_lines(text: Column) -> Column:
    """lines, without the empty one after a last line end."""
    lines = F.split(text, "\n")
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)


def timestamped(text: Column) -> Column:
    """Lines of over 20 bytes that look dated, up to three."""
    at = lambda s, i, mark: F.substring(s, i, 1) == mark
    looks = lambda s: (at(s, 5, "-") & at(s, 8, "-")) | (at(s, 3, ":") & at(s, 6, ":"))
    return F.least(F.size(F.filter(F.split(text, "\n"), lambda s: (F.octet_length(s) > 20) & looks(s))), F.lit(3))


def log_score(text: Column, dated: Column | None = None) -> Column:
    """P7, step 4, of texts of up to three windows."""
    return token_count(text, S.LOG_LEVELS) + (timestamped(text) if dated is None else dated)


def test_score(text: Column) -> Column:
    """P7, step 3, of texts of up to three windows: tokens anywhere, and lines that start as a crash or a diagnostic does, each in one pass over the text."""
    return token_count(text, S.TEST_TOKENS) + F.regexp_count(text, F.lit(_CRASH_LINE)) + F.regexp_count(text, F.lit(_DIAGNOSTIC_LINE))


def _machine_kind(text: Column, tests: Column, logs: Column, dated: Column) -> Column:
    marks = F.substring(text, 1, S.PROBE_BYTES).rlike(any_of(S.LOG_MARKS))
    return F.when(tests >= 3, "test_output").when((logs >= 3) & (marks | (dated >= 3)), "log_output").otherwise("prose")


def machine_kind(text: Column) -> Column:
    """P7, steps 3 to 5, for texts that are neither JSON nor code and have up to three windows."""
    return _machine_kind(text, test_score(text), log_score(text), timestamped(text))


def with_kind(df: DataFrame, text: str, out: str, scores: bool = False) -> DataFrame:
    """``machine_kind`` as column ``out``, and with ``scores`` what it rests on, each counted once."""
    dated = df.withColumn("gm_dated", timestamped(F.col(text)))
    scored = dated.withColumn("test_score", test_score(F.col(text)).cast("long")).withColumn("log_score", log_score(F.col(text), F.col("gm_dated")).cast("long"))
    kinds = scored.withColumn(out, _machine_kind(F.col(text), F.col("test_score"), F.col("log_score"), F.col("gm_dated")))
    return kinds.drop("gm_dated") if scores else kinds.drop("gm_dated", "test_score", "log_score")


def saved_pct(original: Column, sent: Column) -> Column:
    """Saved percent, to one decimal, where something was saved."""
    return F.when(original > sent, F.round(100 * (original - sent) / original, 1)).otherwise(F.lit(0.0))


def without_bom(text: Column) -> Column:
    """without a byte order mark at the start."""
    return F.regexp_replace(text, "^\ufeff", "")


def ascii_lower(text: Column) -> Column:
    """F8: lower case of ASCII letters only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
