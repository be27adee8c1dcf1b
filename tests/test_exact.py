"""The exact operators, shape by shape."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from gistmill import schema as S
from gistmill.functions import bodies as B
from gistmill.functions import exact as E


def log(n: int, every: int = 97) -> str:
    return "\n".join(f"2026-01-02T10:{i // 60 % 60:02d}:{i % 60:02d}Z {'ERROR' if i % every == 0 else 'INFO'} request {i} handled" for i in range(n))


def suite(n: int = 400) -> str:
    return "".join(f"--- FAIL: TestX{i} (0.0s)\n    x_test.go:{i}: want 1 got 2\n" if i % 50 == 0 else f"=== RUN   TestX{i}\n" for i in range(n))


def diff(files: int, path: str = "src/f{}.py") -> str:
    out = []
    for i in range(files):
        p = path.format(i)
        out += [f"diff --git a/{p} b/{p}", f"--- a/{p}", f"+++ b/{p}", "@@ -1,41 +1,41 @@", *[f" same {j}" for j in range(20)], "-old", "+new", *[f" same {j}" for j in range(20)]]
    return "\n".join(out)


GO = "package main\n\nimport \"fmt\"\n\n" + "".join(f"func f{i}() int {{\n\treturn {i} // FAIL PASS FAILED\n}}\n\n" for i in range(80))


@pytest.mark.parametrize(
    "text,kind",
    [
        (log(50), "log_output"), (suite(), "test_output"), (GO, "code"), ("Words in a row. " * 40, "prose"), (json.dumps({"a": [1, 2]}), "json"), ("", "prose"), ('{"a": 1} x', "prose"),
        ("src/a.py:1:2: bad\nsrc/b.py:3: worse\nlib/c.c:9:1: no\n", "test_output"), ("panic: boom\n\ngoroutine 1 [running]:\nmain.main()\nexit status 2\n", "test_output"),
        ("    def test_thing():\n>       assert add(1, 2) == 4\nE       assert 3 == 4\nE   +  where 3\n", "test_output"), ("# licence\n" * 9 + GO, "code"), ('{"a": NaN}', "prose"),
        (json.dumps([{"k": "x" * 90} for _ in range(200)]), "prose"),
    ],
)
def test_kinds(text, kind):
    assert E.classify(text) == kind


def test_long_texts_are_sampled_at_three_places():
    filler = "plain words only " * 20_000
    marks = "INFO a [x]\nWARN b\nERROR c\n"
    middle = len(filler) // 2
    assert E.classify(filler[:middle] + marks + filler[middle:]) in ("prose", "log_output")
    assert E.classify(marks + filler) == "log_output"
    quarter = len(filler) // 4
    assert E.classify(filler[:quarter] + marks + filler[quarter:]) == "prose"


def test_elision_keeps_failures_and_counts_the_rest():
    text = "\n".join(["start"] * 60 + [x for i in range(200) for x in (f"ERROR {i}", f"detail {i}", f"more {i}")] + ["stop"] * 60)
    out = E.elide(text, "gpt")
    kept = [line for line in out.split("\n") if line.startswith("ERROR")]
    assert kept[:3] == ["ERROR 0", "ERROR 1", "ERROR 2"] and len(kept) == 17
    assert "183 more failure lines over cap=50" in out and E.ref(text) in out
    assert E.elide(out, "gpt") is None
    assert E.elide("x\n" * 30, "gpt") is None


def test_terminal():
    assert E.strip_ansi("\x1b[1;31mred\x1b[0m \x1b]0;t\x07a\x1b]8;;u\x1b\\b \x1b[12 \x1b]open") == "red ab open"
    assert E.clean_returns("1%\r50%\r100%\r  \na\r\nb") == "100%\na\nb"
    assert E.fold_repeats("a\na\na\na\n\n\n\n\nb\nb\nb") == "a\n    [... line repeated 3 times ...]\n\n\n\n\nb\nb\nb"
    assert E.fold_repeats("a\na\na") == "a\na\na"


def test_diffs():
    out = E.distill_diff(diff(3))
    assert out.count("unchanged context lines elided") == 6 and "-old" in out and "+new" in out
    lock = E.distill_diff(diff(1, "go.sum") + "\n" + diff(1))
    assert "46 lines of go.sum diff elided (+1/-1)" in lock
    assert E.distill_diff(diff(1)[:400]) is None and E.distill_diff("word " * 200) is None
    assert [E.is_generated(p) for p in ("a/Yarn.lock", "x.min.js", "b.js.map", "map", "go.sum/x")] == [True, True, True, False, False]


def rows(n: int, **more) -> list[dict]:
    return [{"id": i, "name": f"n|{i}", "note": "same", **more} for i in range(n)]


def test_tables():
    text = json.dumps({"object": "list", "has_more": False, "next": None, "data": rows(40)})
    how, out = E.distill_json(text)
    assert how == "table" and out.startswith('[... distilled table: 40 rows · from "data" · object=list · has_more=false · all rows: note=same ...]\n| id | name |\n|---|---|\n| 0 | n\\|0 |')
    assert E.distill_json(json.dumps({"keep": {"x": 1}, "data": rows(40)})) is None
    inner = json.dumps({"outer": {"total": 40, "items": rows(40)}, "etag": "x"})
    assert 'from "outer.items" · total=40' in E.distill_json(inner)[1]
    assert E.distill_json(json.dumps([{"a": i} if i else {"b": 0, "c": "x" * 40} for i in range(9)])) is None
    cut = E.distill_json(json.dumps(rows(30, long="y" * 200)))[1]
    assert "30 cells truncated to 80 chars" in cut
    assert E.distill_json(json.dumps(rows(2))) is None


def test_ids_in_columns_keep_their_digits():
    """Integers of a column are written as they stand, also beyond a million and beyond what a float holds; those that all rows share too, if a float loses them."""
    ids, big = [999_999, 1_000_000, 6_000_001, 2**53 + 1], 12345678
    how, out = E.distill_json(json.dumps([{"id": i, "part": i / 2, "big": big, "huge": 2**53 + 1, "origin": "a warehouse far to the north"} for i in ids]))
    assert how == "table" and out.endswith("| id | part |\n|---|---|\n| 999999 | 499999.5 |\n| 1000000 | 500000 |\n| 6000001 | 3.0000005e+06 |\n| 9007199254740993 | 4.503599627370496e+15 |\n")
    assert "big=1.2345678e+07 · all rows: huge=9007199254740993 ·" in out
    near = E.distill_json(json.dumps([{"id": 2**53 + i % 2, "origin": "a warehouse far to the north, where it is cold"} for i in range(4)]))[1]
    assert near.endswith("| id |\n|---|\n| 9007199254740992 |\n| 9007199254740993 |\n| 9007199254740992 |\n| 9007199254740993 |\n")


def test_ids_in_deep_tables_keep_their_digits():
    items = [{"event_id": 5_999_990 + i, "type": "view", "k": i, "source": "web"} for i in range(20)]
    how, out = E.distill_json(json.dumps({"response": {"total": 1_000_000, "data": items}, "next": None}))
    assert how == "table" and out.startswith('[... distilled table: 20 rows · from "response.data" · total=1000000 · all rows: type=view · all rows: source=web ...]\n| event_id | k |\n')
    assert out.endswith("".join(f"| {i['event_id']} | {i['k']} |\n" for i in items))


def test_cells_and_numbers():
    assert [E.cell(E.parse(x)) for x in ("1000000", "12", "1.50", "1e-7", "true", '{"b":1,"a":[null,"x"]}')] == ["1e+06", "12", "1.5", "1e-07", "true", '{"a":[null,"x"],"b":1}']
    assert E.table_cell("é" * 60)[0] == "é" * 38 + "\ufffd..."
    assert E.json_string("<a>&\u2028\x01\"") == '"\\u003ca\\u003e\\u0026\\u2028\\u0001\\""'


def test_pruning():
    text = json.dumps({"z": 1, "a": None, "e": {}, "l": [None, {}, {"x": None}], "ETag": "v", "deep": {"trace_id": 1}, "pad": "p" * 40})
    assert E.distill_json(text) == ("prune", '{"l":[{},{}],"pad":"' + "p" * 40 + '","z":1}')
    assert E.distill_json(json.dumps({"a": "b" * 100, "n": None})) is None


def test_user_text():
    inner = log(600)
    text = f"please look <tool_output id=1>{inner}</tool_output> and ```output\n{inner}\n``` thanks"
    out, how = E.distill_user(text, "gpt")
    assert how == "user" and out.startswith("please look <tool_output id=1>2026") and out.endswith("\n``` thanks") and out.count("middle lines elided") == 2
    assert E.distill_user("nothing here, " * 20, "gpt") == ("nothing here, " * 20, "none")
    assert E.distill_user(diff(4), "gpt")[1] == "user"
    assert E.distill_user("<tool_output>" + inner, "gpt")[1] == "none"


def test_gate_changes_nothing_but_folding():
    for text in (log(600), suite(), GO, diff(4), json.dumps(rows(50)), "prose " * 100, "\x1b[31mx\x1b[0m\n" * 90):
        assert E.distill(text, "gpt") == E.distill(text, "gpt", fold_ungated=True)
    repeated = "same line of prose\n" * 60
    assert E.distill(repeated, "gpt")[1] == "none" and E.distill(repeated, "gpt", fold_ungated=True)[1] == "terminal"


def test_limits():
    text = log(600)
    assert E.distill(text, "gpt", S.Limits(max_block=100))[1] == "none"
    assert E.distill(text, "gpt", S.Limits(min_block=10**6))[1] == "none"
    assert B.apply("{}" * 900, S.Limits(max_body=100))["skip_reason"] == "body_too_large"


@pytest.mark.parametrize(
    "body,wire",
    [
        ('{"instructions":"i"}', "openai_responses"), ('{"input":null,"messages":[]}', "openai_chat"), ('{"system":"s","messages":[]}', "anthropic_messages"), ('{"messages":[{"tool_use_id":1}]}', "anthropic_messages"),
        ("{oops", "unknown"), ("", "unknown"), ("null", "unknown"), ("[]", "unknown"), ('{"messages":[]} x', "unknown"), (None, "unknown"), ("[" * 100_000, "unknown"),
    ],
)
def test_wire_formats(body, wire):
    assert B.detect(body) == wire


def chat(*turns: tuple[str, str], model: str = "gpt-5") -> str:
    return json.dumps({"model": model, "messages": [{"role": r, "content": c} for r, c in turns]}, ensure_ascii=False)


def anthropic(text: str) -> str:
    part = {"type": "tool_result", "tool_use_id": "t", "content": [{"type": "text", "text": text}, {"type": "image"}]}
    return json.dumps({"model": "claude-x", "system": "s", "messages": [{"role": "user", "content": [part, {**part, "content": text}]}]})


def test_contracts():
    for body in ("{oops", "", "null", "[]", '{"model":m"}', chat(("tool", "short"))):
        assert B.apply(body)["body"] == body
    for body in (chat(("user", "hi é"), ("tool", log(600)), ("assistant", "ok <b>")), anthropic(suite())):
        out = B.apply(body)
        assert out["error"] is None and out["saved_bytes"] > 0 and out["sent_bytes"] == E.size(out["body"])
        assert B.apply(out["body"])["body"] == out["body"]
        assert json.loads(out["body"]).keys() == json.loads(body).keys()
        for d in out["decisions"]:
            assert d["text"] in json.dumps(json.loads(body), ensure_ascii=False) or json.dumps(d["text"])[1:-1] in body
    head = chat(("user", "hi"), ("tool", log(600)))
    longer = chat(("user", "hi"), ("tool", log(600)), ("assistant", "x"), ("tool", suite()))
    assert json.loads(B.apply(longer)["body"])["messages"][:2] == json.loads(B.apply(head)["body"])["messages"]


def test_repeats_refer_to_the_first_turn():
    body = chat(("tool", GO), ("assistant", "a"), ("tool", GO), ("user", GO))
    out = json.loads(B.apply(body)["body"])["messages"]
    assert out[0]["content"] == GO and "identical to the copy in turn 1 above" in out[2]["content"] and out[3]["content"] == GO
    same = anthropic(GO)
    assert B.apply(same)["blocks"] == 0


@given(st.recursive(st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20))
def test_dense_json_is_json(value):
    text = json.dumps(value)
    assert json.loads(E.dense(E.parse(text)), parse_int=float) == value
    node = B.scan("  " + text + " ")
    assert (node.start, node.end) == (2, 2 + len(text))


@given(st.lists(st.sampled_from(["a", "b", "", " ", "ERROR x", "\x1b[1mz\x1b[0m", "1\r2", "{", "]", "é✗"]), max_size=60))
def test_distilling_twice_is_distilling_once(lines):
    text = "\n".join(lines * 4)
    once = E.distill(text, "deepseek")[0]
    assert E.distill(once, "deepseek")[0] == once
