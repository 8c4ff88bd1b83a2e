from corpuskit.llm import docpairs

PY = '''import os

# Reads the next value from the given source.
@cache
def plain(a, b):
    return a

class Box:
    """A box that holds things for you."""

    # TODO write this down some day
    def todo(self):
        pass

    def said(self):
        "Gives back what the box holds."

        # Doubles a number and hands it back.
        async def inner(x):
            return x
        return inner

    def empty(self):
        """"""

    # An older note that is far away from it.

    def far(self):
        pass

def sort_items(items):
    """Sort the items of this."""

if os:
    # Übersetzt den Text in eine andere Form.
    def nested(): ...
'''

JS = """/** Opens the door for every guest. */
export const openDoor = async (guest) => {
  // Closes what was opened before it.
  function inner() {}
};

class Door extends Wall {
  /**
   * Paints the door in a colour.
   * @param {string} colour
   */
  static paint(colour) {}

  // fixed once
  // Turns the key two times around.
  async turn() {}

  /* An old comment that stands alone. */

  lonely() {}
}
x(); // Not a comment for the next one.
function after() {}
"""


def test_python_pairs():
    got = [p[0] for p in docpairs.pairs(PY, "python")]
    assert sorted(got) == sorted(["plain", "Box.said", "Box.said.inner", "nested"])
    plain = next(p for p in docpairs.pairs(PY, "python") if p[0] == "plain")
    assert plain[1:3] == ("Reads the next value from the given source.", "comment") and plain[3].startswith("@cache\ndef plain")
    crlf = docpairs.pairs(PY.replace("\n", "\r\n"), "python")
    assert [p[0] for p in crlf] == [p[0] for p in docpairs.pairs(PY, "python")]


def test_javascript_pairs():
    got = {p[0]: p[1] for p in docpairs.pairs(JS, "javascript")}
    assert set(got) == {"openDoor", "openDoor.inner", "Door.paint", "Door.turn"}
    assert got["Door.turn"] == "fixed once\nTurns the key two times around."


def test_trivial():
    assert docpairs.trivial("Sort the items of this.", "sortItems")
    assert docpairs.trivial("one two three", "f") and docpairs.trivial("TODO write it all down", "f")
    assert not docpairs.trivial("Sort the items by age.", "sortItems")
    assert docpairs.trivial(" ... 12 34 56 ", "f")
    assert docpairs.trivial("todo: describe what this does", "f") and not docpairs.trivial("Todos are read one by one.", "f")


def _greedy(functions, comments):
    names, edges, taken, got = {f.name for f in functions}, [], set(), {}
    for i, f in enumerate(functions):
        for j, c in enumerate(comments):
            if 0 <= f.first - 1 - c.end <= docpairs.REACH and (w := docpairs._weight(f, c, names)) >= docpairs.LEAST:
                edges.append((-w, i, j))
    for _, i, j in sorted(edges):
        if i not in got and j not in taken:
            got[i] = j
            taken.add(j)
    return got


def _weight_of(got, functions, comments):
    names = {f.name for f in functions}
    return sum(docpairs._weight(functions[i], comments[j], names) for i, j in got.items())


def test_tags_win_over_nearness():
    js = "// Scales what it gets.\n// @param factor  how much\nconst one = () => 1;\nconst scale = (factor) => factor * 2;\n"
    assert [p[0] for p in docpairs.pairs(js, "javascript")] == ["scale"]
    assert [p[0] for p in docpairs.pairs(js, "javascript", 0)] == ["one"]
    apart = "# The old notes of all this stand here.\n\n\ndef first(x):\n    pass\n"
    assert docpairs.pairs(apart, "python") == []  # implausible: far off, and nothing tells of the function
    assert [p[0] for p in docpairs.pairs(apart.replace("all this", "first()"), "python")] == ["first"]


def test_comments_end_where_their_block_ends_and_lie_in_no_string():
    text = "# Tells of first() in more\n# than one line of its own.\n\ndef first():\n    pass\n"
    assert [p[1] for p in docpairs.pairs(text, "python")] == ["Tells of first() in more\nthan one line of its own."]
    held = 'X = """\n# Says what first() does here."""\ndef first():\n    pass\n\nY = """\n# Says what second() does here.\n"""\ndef second():\n    pass\n'
    assert docpairs.pairs(held, "python") == docpairs.pairs(held, "python", 0) == []
    quoted = "# Says that it's \"first\" here.\ndef first():\n    pass\n"
    assert [p[0] for p in docpairs.pairs(quoted, "python", 0)] == ["first"]
    assert docpairs.pairs(text, "python", 9) == docpairs.pairs(text, "python")


def test_assignment_is_not_greedy():
    """The best single link would leave the other function without its only candidate."""
    fs = [docpairs.Function("load_rows", "load_rows", 4, 4, ("path",), None), docpairs.Function("keep", "keep", 6, 7, ("path",), None)]
    cs = [docpairs.Comment("Does load_rows. :param path: where", 2), docpairs.Comment("Serves load_rows and keep(). :param path: where from", 3)]
    got = docpairs.assign(fs, cs)
    assert got == {0: 0, 1: 1} and _greedy(fs, cs) == {0: 1, 1: 0}
    assert _weight_of(got, fs, cs) > _weight_of(_greedy(fs, cs), fs, cs)
    assert docpairs.assign([], cs) == {} and docpairs.assign(fs, []) == {}


def test_assignment_is_the_heaviest():
    """Against all assignments of small random files, and in bounded time on a dense large one."""
    import itertools
    import random
    import time

    r = random.Random(8)
    words = ["load", "keep", "scan", "sort"]
    for _ in range(150):
        fs = [docpairs.Function(w, w, first, first, (r.choice("ab"),), None) for first, w in ((r.randrange(9), r.choice(words)) for _ in range(4))]
        cs = [docpairs.Comment(f"{r.choice(words)} {r.choice(words)} @param {r.choice('abc')}" if r.random() < 0.7 else "tells of it", r.randrange(9)) for _ in range(4)]
        got = docpairs.assign(fs, cs)
        best = 0.0
        names = {f.name for f in fs}
        ok = {(i, j): docpairs._weight(f, c, names) for i, f in enumerate(fs) for j, c in enumerate(cs) if 0 <= f.first - 1 - c.end <= docpairs.REACH and docpairs._weight(f, c, names) >= docpairs.LEAST}
        for to in itertools.product([None, 0, 1, 2, 3], repeat=4):
            used = [j for j in to if j is not None]
            links = [(i, j) for i, j in enumerate(to) if j is not None]
            if len(used) == len(set(used)) and all(x in ok for x in links):
                best = max(best, sum(ok[x] for x in links))
        assert abs(_weight_of(got, fs, cs) - best) < 1e-6
    n = 3_000
    fs = [docpairs.Function(f"f{i}", f"f{i}", i, i, ("a",), None) for i in range(1, n)]
    cs = [docpairs.Comment("tells @param a", i) for i in range(n)]
    began = time.time()
    assert len(docpairs.assign(fs, cs)) == n - 1 and time.time() - began < 20


def test_too_deep_for_a_tree():
    body = PY + "\n\nDEEP = " + "-" * 100_000 + "1\n"
    got, want = docpairs.pairs(body, "python"), docpairs.pairs(PY, "python")
    assert [p[:5] for p in got] == [p[:5] for p in want] and got


def test_invalid_texts_give_nothing():
    for text in ("def f(:", 'def f():\n    """Says what it does here."""\nreturn 1\n', "for x in y:\n    def g():\n        '''Says what it does here.'''\n        break\n"):
        assert docpairs.pairs(text, "python") == []
    assert docpairs.pairs("// Says what it does here.\nfunction f( {}", "javascript") == []


def test_table(spark):
    rows = [(1, "a.py", PY, "s"), (2, "b.js", JS, "s"), (3, None, PY, "s"), (4, "c.json", "{}", "s"), (5, "d.py", None, "s"), (1, "a.py", PY, "s"), (6, "e.py", "", "s")]
    df = spark.createDataFrame(rows, "record_id bigint, path string, text string, symbol string")
    got = docpairs.documented(df, ["record_id"])
    assert {r["record_id"]: r["n"] for r in got.groupBy("record_id").count().withColumnRenamed("count", "n").collect()} == {1: 8, 2: 4}
    assert docpairs.documented(df.limit(0), ["record_id"]).count() == 0
