import pytest

from corpuskit.llm import lexers, syntax
from corpuskit.llm.jsparse import SyntaxFault, parse

VALID_JS = [
    "", "let a=1\nlet b=2", "for(const x of y){}", "for(var i=0,j=1;i<3;i++)j[i]=x(i,'a');", "x=a?b:c?d:e", "`a${b+`c${d}`}e`", "a=/[/]x/g.test(b)/2",
    "const f=async({a,b=2},[c,...d])=>{await a;return b}", "if(a)/x/.test(b)", "x=>({a:1})", "({a,b}=c)", "[a,b]=[b,a]", "!function(){}()", "a?.b?.[c]?.(d)",
    "class A extends B{static #x=1;get y(){return this.#x} static{a()} async *z(){yield* q} constructor(){super()}}", "export default class{}",
    "import a,{b as c} from 'x';import * as q from \"y\"", "label:for(;;){break label}", "do x++;while(x<5)\ny", "switch(a){case 1:b;break;default:c}",
    "({get a(){return 1},set b(v){},async c(){},*d(){},'e':1,[f]:2,3:4})", "new a.b(c)", "new Foo", "async function f(){for await(const x of y);}", "a\n++b",
    "let yield_rate=1", "1..toString()", "x=.5+1e3+0x1F+10n", "for(let k in o);", "tag`x${1}`", "a??=b", "({a=1})=>a", "export {a as default}", "// <<<<<<< HEAD\nx",
    "const s = `\n<<<<<<< ours\n`", "#!/usr/bin/env node\nx()",
]
BROKEN_JS = [
    "let a=1 let b=2", "return 1", "a b", "(a", "const", "const x", "function(){}", '"abc', "'abc\n'", "`abc", "x=", "if a:", "def f(x):", "<html>", "import math",
    "from x import y", "a = {", "}", "<<<<<<< HEAD\na", "a\n=======\n", "class A:", "# c", '"""doc"""', "1a", "else{}", "a=“b”", "{a:1,b:2}", "()", "catch(e){}", "try{}",
    "a+b=c", "if(a){b}}", "/* open", "function do(x){}", "break", "x = [1,,2", "5 = a", "let [a b] = c",
]


@pytest.mark.parametrize("text", VALID_JS)
def test_valid_javascript(text):
    parse(text)


@pytest.mark.parametrize("text", BROKEN_JS)
def test_broken_javascript(text):
    with pytest.raises(SyntaxFault):
        parse(text)


@pytest.mark.parametrize(
    "text, lang, want",
    [
        ("x = 1\n", "python", None),
        ("", "python", None),
        ("\ufeffx = 1\n", "python", None),
        ("s = '''\n<<<<<<< ours\n'''\n", "python", None),
        ("x = f\"{d[\"k\"]}\"\n", "python", None),
        ("<<<<<<< HEAD\nx = 1\n", "python", "merge conflict"),
        ("x = (1,\n", "python", "premature end"),
        ("def f():\n", "python", "premature end"),
        ("x = 'abc\n", "python", "unterminated literal"),
        ("x = 1)\n", "python", "unbalanced delimiter"),
        ("print 'x'\n", "python", "grammar"),
        ("return 1\n", "python", "grammar"),
        ("x = 1\x00", "python", "grammar"),
        ('{"a": [1, 2.5e3, null]}', "json", None),
        ('{"a": NaN}', "json", "grammar"),
        ("", "json", "grammar"),
        ('{"a": 1,}', "json", "grammar"),
        ('{"a": "x', "json", "unterminated literal"),
        ('{"a": [1', "json", "premature end"),
        ("a = 1\n[b.c]\nd = [1, 2]\n", "toml", None),
        ("a = \n", "toml", "grammar"),
        ('a = "x\n', "toml", "unterminated literal"),
        ("function f() {", "javascript", "premature end"),
        ("a = 'c:\\'\nb = \"\"\"x\"\"\"\"\"\n", "toml", None),
        ("a = 'x\n", "toml", "unterminated literal"),
        ("a = [1, 2\nb = 3\n", "toml", "premature end"),
        ("=======\na = 1\n", "toml", "merge conflict"),
        ("x = f'{a!r:>{width:d}} {{}} {f\"{b}\"} {c[\"d\"]:%H:%M}'\n", "python", None),
        ("x = rf'\\{a}' f\"\"\"{\n b # }\n}\"\"\"\n", "python", None),
        ("x = f'{a'\n", "python", "unterminated literal"),
        ("x = f'{(a}'\n", "python", "unbalanced delimiter"),
        ("x = f" + "'" * 3 + "{a\n", "python", "premature end"),
        ("x = 'a' # it's (\n", "python", None),
        ("if x: # y:\n", "python", "premature end"),
        ("x = [1,\n=======\n2]\n", "python", "merge conflict"),
        (None, "python", None),
        ("x", None, None),
    ],
)
def test_faults(text, lang, want):
    assert syntax.fault(text, lang) == want


def test_language():
    cases = {("a\\b.py", ""): "python", ("a.mjs", ""): "javascript", ("bin/x", "#!/bin/sh\n"): "python", ("bin/x", "y"): None, (None, "#!"): None, ("a.txt", "#!"): None, ("x.JSON", ""): "json", ("a.b/c", ""): None}
    for (path, text), want in cases.items():
        assert syntax.language(path, text) == want


def test_table(spark):
    rows = [(1, "R", "a.py", "x = (", "z"), (2, "r ", "b\\c.js", "x = 1;", "z"), (3, None, "d.py", None, "z"), (4, "r", None, "x", "z"), (1, "R", "a.py", "x = (", "z"), (5, "r", "bin/run", "#!x\ny = 1", "z")]
    df = spark.createDataFrame(rows, "record_id bigint, repo string, path string, text string, fault string")
    got = syntax.with_faults(df, ["record_id"]).collect()
    assert sorted((r["record_id"], r["language"], r["fault"]) for r in got if r["fault"]) == [(1, "python", "premature end")] * 2
    for r in got:  # the column expression and the function agree
        text = next(x for x in rows if x[0] == r["record_id"])
        assert syntax.language(text[2], text[3]) == r["language"]
    assert len(got) == 4
    rate = {r["language"]: (r["files"], r["invalid"], r["rate"]) for r in syntax.rates(syntax.with_faults(df, ["repo"]), ["language"]).collect()}
    assert rate["python"] == (3, 2, 2 / 3) and rate["javascript"] == (1, 0, 0.0)
    assert syntax.with_faults(df.limit(0), ["record_id"]).count() == 0
    deep = spark.createDataFrame([(1, "r", "a.json", "[" * 50_000 + "]" * 50_000, ""), (2, "r", "a.js", "(" * 5_000 + "1" + ")" * 5_000, "")], df.schema)
    assert [r["fault"] for r in syntax.with_faults(deep, ["record_id"]).collect()] == [None, None]


def test_depth_is_no_limit():
    deep = "[" * 200_000 + "]" * 200_000
    assert syntax.fault(deep, "json") is None
    assert syntax.fault(deep[:-1], "json") == "premature end"
    assert syntax.fault("[" * 200_000 + "1 2" + "]" * 200_000, "json") == "grammar"
    assert syntax.fault('{"a":' * 50_000 + "01" + "}" * 50_000, "json") == "grammar"
    assert syntax.fault("a = " + "[" * 5_000 + "]" * 5_000, "toml") is None
    assert syntax.fault("a = " + "[" * 5_000 + "]" * 4_999, "toml") == "premature end"
    assert syntax.fault("(" * 40_000 + "1" + ")" * 40_000, "javascript") is None
    assert syntax.fault("(" * 40_000 + "1 2" + ")" * 40_000, "javascript") == "unexpected token"
    chain = "if(a){b()}" + "else if(a){b()}" * 20_000
    assert syntax.fault(chain, "javascript") is None and syntax.fault(chain + "else", "javascript") == "premature end"
    assert len(parse("(" * 9_000 + "function f(a){}" + ")" * 9_000 + ";function g(){}")[1]) == 2


def test_lexer_never_refuses_what_python_accepts():
    """Over valid texts and random edits of them: a fault of the lexer is always one of the parser."""
    import inspect
    import random
    import textwrap
    import tokenize

    r = random.Random(4)
    for module in (inspect, textwrap, tokenize, random):
        text = inspect.getsource(module)
        assert lexers.lexical_fault(text, "python") is None
        for _ in range(60):
            at = r.randrange(len(text))
            edited = text[:at] + r.choice(["", '"', "'", "{", "}", "(", ")", "\\", 'f"', "#", ":", '"""']) + text[at + r.randrange(3) :]
            if lexers.lexical_fault(edited, "python"):
                with pytest.raises((SyntaxError, ValueError)):
                    compile(edited, "edited", "exec", 0, True)


@pytest.mark.parametrize("text", ["[]", "{}", "1", '"a"', '{"a":[1,{"b":null}]}', " [ 1 , 2 ] ", "[1,]", "{,}", '{"a"}', "[1 2]", "01", "-", "nul", '"\\x"', "[]]", "", '{"a":1,}', "1e5", '{"a":1 "b":2}'])
def test_json_automaton_agrees_with_the_parser(text):
    import json

    try:
        json.loads(text)
        valid = True
    except ValueError:
        valid = False
    assert lexers.json_grammar(text) == valid
