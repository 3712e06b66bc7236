"""Quotation marks and junctions against plain Python."""

import random

import pytest

from lexiloom.operators import junctions, quotes
from lexiloom.plans import registry


def roles_of(text):
    """The stack, mark by mark."""
    marks = [(p, ch) for p, ch in enumerate(text) if ch in "“‘”’\"'"]
    stack, role, partner = [], {}, {}
    for i, (p, ch) in enumerate(marks):
        before, after = text[p - 1 : p] if p else "", text[p + 1 : p + 2]
        if before and before in "“‘”’\"'":
            before = ""
        if after and after in "“‘”’\"'":
            after = ""
        double = ch in "“”\""
        if not double and ch != "‘" and before.isalpha() and after.isalpha():
            role[i] = "apostrophe"
        elif ch in "“‘" or (ch in "\"'" and (before == "" or before in " ([{=") and after.strip()):
            stack.append((i, double))
        elif stack and stack[-1][1] == double:
            o = stack.pop()[0]
            role[o], role[i], partner[o], partner[i] = "open", "close", i, o
        else:
            role[i] = "close_orphan"
    for i, _ in stack:
        role[i] = "open_orphan"
    return [(i, p, ch, role[i], partner.get(i)) for i, (p, ch) in enumerate(marks)]


def test_roles_match_a_stack(spark):
    rng = random.Random(5)
    texts = ['say "hello" to it\'s “big” ‘x’', "a” b", "‘a “b’ c”", None, "", "none", '=”q“ .“x', "word“in” x"] + ["".join(rng.choice("ab  .(“”‘’\"'") for _ in range(rng.randint(1, 24))) for _ in range(300)]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, line_no int, text string")
    got = {}
    for r in quotes.quote_roles(df).orderBy("doc_id", "i").collect():
        got.setdefault(r.doc_id, []).append((r.i, r.pos, r.mark, r.role, r.partner))
    assert got == {k: roles_of(t) for k, t in enumerate(texts) if t and roles_of(t)}


def test_findings_of_quotes(spark):
    texts = ["he said big word” now", "”turned“ here", "end.“next” one", "see “ x” y", "word“in” x", "clean “one” two"]
    df = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "doc_id long, line_no int, text string")
    roles = quotes.quote_roles(df)
    pick = lambda found: sorted((r.doc_id, r.original, r.corrected) for r in found.collect())
    assert pick(quotes.unpaired_quotes(roles, df)) == [(0, "he said big word”", "“he said big word”")]
    assert pick(quotes.reversed_quotes(roles, df)) == [(1, "”turned“", "“turned”")]
    assert pick(quotes.quote_punct_spacing(roles)) == [(2, ".“", ". “"), (3, "“ ", "“")]
    assert pick(quotes.quote_spacing(roles, df)) == [(4, "d“", "d “")]


def test_junctions(spark):
    pairs = spark.createDataFrame([("data base", "database file"), ("data base", "database x"), ("ab cd", "abcd e")], "short string, longer string")
    support = spark.createDataFrame([("data base", 5), ("database file", 2), ("database x", 9), ("ab cd", 1), ("abcd e", 1)], "form string, n long")
    got = {(r.weak, r.strong): r.corrected for r in junctions.junction_harmonise(pairs, support).collect()}
    assert got == {("database file", "data base"): "data base file", ("data base", "database x"): "database", ("abcd e", "ab cd"): "ab cd e"}
    groups = junctions.junction_groups(pairs)
    assert {(r.form, r.junction, r.members) for r in groups.collect()} == {("data base", "data base", 3), ("database file", "data base", 3), ("database x", "data base", 3), ("ab cd", "ab cd", 2), ("abcd e", "ab cd", 2)}
    cards = spark.createDataFrame([("database", "data base"), ("data basefile", "database file"), ("abcde", "abcd e")], "original string, corrected string")
    got = {(r.original, r.corrected, r.action) for r in junctions.junction_propagate(pairs, groups, cards, support).collect()}
    assert got == {("database", "database", "rejected"), ("abcde", "ab cd e", "changed")}


@pytest.mark.parametrize("word, model, want", [("ab cdef", "abc d", "abc def"), ("abcd", "ab cd", "ab cd"), ("ab cd", "abcdef", "abcd"), ("abcd ef", "ab cd", "ab cd ef")])
def test_respaced(spark, word, model, want):
    assert spark.createDataFrame([(word, model)], "w string, m string").select(junctions.respaced("w", "m")).first()[0] == want


def test_spacing_judged_in_rows_equals_that_of_roles(spark, sf):
    rng = random.Random(11)
    pieces = ["word", "7", " ", "(", "“", "”", "‘", "’", '"', "'", ".", "말", "x" * 39, "é", "\U0001D41A"]
    rows = [(n, 0, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for n in range(3000)] + [(-1, 0, None), (-2, 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, line_no int, text string")
    want = sorted(map(tuple, quotes.quote_spacing(quotes.quote_roles(df), df).collect()))
    assert sorted(map(tuple, quotes.quote_spacing_in(df).collect())) == want and len(want) > 50
    # Each row by itself, also where ids repeat or are missing.
    again = spark.createDataFrame([(1, 0, "a“b” c"), (1, 0, "none"), (1, 0, "word d“e”"), (None, 0, "f“g”")], "doc_id long, line_no int, text string")
    assert sorted((r.doc_id or 0, r.pos) for r in quotes.quote_spacing_in(again).collect()) == [(0, 1), (1, 1), (1, 6)]
    plan = registry.QUERIES["quote_spacing"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
