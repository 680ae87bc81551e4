"""Answers in which forms mix: headed blocks, declarations, and what Spark makes of them."""

import pytest

from loomlog.functions.shellcode import block_declares, code_declares, headed_blocks
from loomlog.operators import responses

F3 = "```"


@pytest.mark.parametrize(
    "text, blocks",
    [
        (f"### Alias: `gs`\n{F3}bash\nalias gs='git status'\n{F3}\n", [("gs", "alias gs='git status'")]),
        (f"**Suggestion 2:** do it\n\n{F3}\nx\ny\n{F3}", [("do it", "x\ny")]),
        (f"intro\n\n**Function:** do it\n{F3}\nx\n{F3}", [("Function:** do it", "x")]),  # below other text the head word stays
        (f"a\n{F3}\n1\n{F3}\nb\n \n\n{F3}sh\n2{F3} c\n{F3}\n3\n{F3}", [("a", "1"), ("b", "2"), ("c", "3")]),
        (f"say `x` or \"y\"\n{F3}\n1\n{F3}", [("y", "1")]),
        (f"call `x` now\n{F3}\n1\n{F3}", [("now", "1")]),
        (f"odd``\n{F3}\n1\n{F3}\n{F3}\n2\n{F3}", [("1", "")]),  # no heading: the block's code heads the next one
        (f"a\n{F3} sh\n1\n{F3}\n2\n{F3}", [("1", "2")]),  # a fence with a blank opens nothing
        (f"a\n{F3}sh\nnever closed\n", []),
        (f"{F3}\nno heading\n{F3}\n", []),
        ("", []),
        (None, []),
    ],
)
def test_headed_blocks(text, blocks):
    assert headed_blocks(text) == blocks


@pytest.mark.parametrize(
    "code, in_block, alone",
    [
        ("alias gs='git status'", ("alias", "gs"), ("alias", "gs")),
        ("# note\nalias  a-b = x", ("alias", None), ("alias", "a-b")),
        ("function go-up {\n cd ..\n}", ("function", "go-up"), ("function", "go-up")),
        ("go_up () {\n cd ..\n}", ("function", None), ("function", "go_up")),
        ("function run() { x; }\nalias r=run", ("alias", "r"), ("alias", "r")),
        ("Set-Alias -Name gg -Value git", ("alias", None), ("alias", "gg")),
        ("x; set-alias  -name gg -Value git", ("function", None), ("alias", "gg")),
        ("#!/bin/sh\necho", ("script", None), ("script", None)),
        ("#!/bin/sh\nmain() { x; }", ("script", None), ("function", "main")),
        ("ls -la", ("function", None), ("function", None)),
        ("", ("function", None), ("function", None)),
    ],
)
def test_declarations(code, in_block, alone):
    assert block_declares(code) == in_block and code_declares(code) == alone


MIXED = [
    # JSON in the second fence only: the first fence is no JSON, the brackets reach over both
    (1, f'{F3}\nalias a=b\n{F3}\n{F3}json\n[{{"pattern":"p","code":"c"}}]\n{F3}', [("p", "function", "c", "", None)]),
    (2, f'{F3}json\n{{"suggestions":[{{"pattern":"p","code":"[x]","type":"alias"}}]}}\n{F3} and [more]', [("p", "alias", "[x]", "", None)]),
    (3, 'see [1] and {"a": [{"b": 1}]}', []),
    (4, f"Alias: `x`\n{F3}\nalias x=y\n{F3}\nwith [brackets] after", [("x", "alias", "alias x=y", "x", None)]),
    (5, f'use\n{F3}\nf() {{ x; }}\n{F3}\n\ntwo words\n{F3}zsh\nfunction g {{ y; }}\n{F3}', [("use", "function", "f() { x; }", "use", None), ("two words", "function", "function g { y; }", "g", None)]),
    (6, '[[{"pattern":"in a list"}], {"pattern":"p","safety":"danger","extra":{"deep":[1]}}]', [("p", "function", "", "", "danger")]),
    (7, "", []),
    (8, None, []),
]


def test_mixed_answers(spark):
    raw = spark.createDataFrame([(i, t) for i, t, _ in MIXED], "id int, raw string")
    got = {}
    for r in responses.parse_suggestions(raw).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.pattern, r.type, r.code, r.name, r.safety))
    assert got == {i: want for i, _, want in MIXED if want}
