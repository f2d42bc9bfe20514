"""Lexer, parser and time bounds."""

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracemill.errors import LexError, ParseError
from tracemill.plans import syntax as s
from tracemill.plans.bounds import bounds
from tracemill.plans.lexer import tokenize
from tracemill.plans.parser import interval_ns, parse


def kinds(text):
    return [(t.kind, t.value) for t in tokenize(text)[:-1]]


def test_operators():
    assert [v for _, v in kinds("<= >= != <> =")] == ["<=", ">=", "!=", "!=", "="]


def test_strings_names_and_comments():
    assert kinds("'it''s' \"a \"\"b\" -- gone\nSELECT x_1 'größe'") == [("string", "it's"), ("quoted", 'a "b'), ("keyword", "select"), ("name", "x_1"), ("string", "größe")]


def test_numbers():
    assert kinds("1 2.5 1h 30s") == [("int", "1"), ("float", "2.5"), ("duration", "1h"), ("duration", "30s")]


@pytest.mark.parametrize("text", ["'open", '"open', "a ? b", "1e5", "12abc", "#"])
def test_no_tokens(text):
    with pytest.raises(LexError):
        tokenize(text)


@given(st.text(max_size=30))
def test_any_string_survives_quoting(x):
    assert kinds("'" + x.replace("'", "''") + "'") == [("string", x)]


@pytest.mark.parametrize("text,ns", [("5 minutes", 300 * 10**9), ("1h", 3600 * 10**9), ("30s", 30 * 10**9), ("2 DAYS", 172800 * 10**9), ("7us", 7000), ("8 ms", 8 * 10**6), ("1 min", 60 * 10**9)])
def test_intervals(text, ns):
    assert interval_ns(text) == ns


@pytest.mark.parametrize("text", ["1 fortnight", "x", "", "1.5 hours", "-1 h"])
def test_no_intervals(text):
    with pytest.raises(ParseError):
        interval_ns(text)


def test_precedence():
    where = parse("SELECT a FROM t WHERE NOT a = 1 + 2 * -3 OR b AND c").where
    product = s.Binary("*", s.Literal(2), s.Unary("-", s.Literal(3)))
    assert where == s.Binary("or", s.Unary("not", s.Binary("=", s.Name("a"), s.Binary("+", s.Literal(1), product))), s.Binary("and", s.Name("b"), s.Name("c")))


def test_left_associative():
    assert parse("SELECT a - b - c FROM t").items[0].expr == s.Binary("-", s.Binary("-", s.Name("a"), s.Name("b")), s.Name("c"))


def test_statement():
    q = parse("select distinct a.x as y, count(*) n from t as a left join u on a.k = u.k where x between 1 and 2 group by y having n > 1 order by n desc, y limit 3 offset 4;")
    assert (q.distinct, q.limit, q.offset) == (True, 3, 4)
    assert q.source == s.Source("t", "a") and q.joins[0].how == "left" and q.joins[0].source.name == "u"
    assert [i.alias for i in q.items] == ["y", "n"] and q.items[1].expr == s.Call("count", (s.Star(),))
    assert [o.descending for o in q.order] == [True, False]


@pytest.mark.parametrize("text,how", [("join", "inner"), ("inner join", "inner"), ("left join", "left"), ("left outer join", "left"), ("right join", "right")])
def test_joins(text, how):
    assert parse(f"select * from a {text} b on a.x = b.x").joins[0].how == how


def test_negations():
    w = parse("select * from t where a not between 1 and 2 and b not in (1) and c not like 'x' and d is not null").where
    assert str(w).count("op='not'") == 4


def test_filter():
    assert parse("select count(*) filter (where a > 1) from t").items[0].expr.where == s.Binary(">", s.Name("a"), s.Literal(1))


def test_soft_words_are_names_elsewhere():
    q = parse("select filter, count(*) outer, count(*) filter from t filter left outer join u outer on filter.a = outer.a")
    assert [i.alias for i in q.items] == [None, "outer", "filter"] and q.items[0].expr == s.Name("filter")
    assert q.source.name == "filter" and q.joins[0].source.name == "outer"


@pytest.mark.parametrize("text", [
    "", "select", "select a", "select a from", "select a from t where", "select a from t limit x", "select a from t a b", "select a, from t", "select a from t group a", "select a from t;;", "insert into t", "select a = b = c from t",
    "select a from t where a like b", "select a from t where a not 5", "select a from t join u", "select count(distinct a) from t", "select interval 5 from t", "select a from t order by", "select from from t", "select f(a from t",
])
def test_no_statements(text):
    with pytest.raises(ParseError):
        parse(text)


@pytest.mark.parametrize("where,want", [
    ("t >= 5", (5, None)), ("t > 5", (6, None)), ("5 < t", (6, None)), ("t < 5", (None, 4)), ("t <= 5 and t >= 1", (1, 5)), ("t = 3", (3, 3)), ("t between 2 and 9", (2, 9)), ("t in (4, 7)", (4, 7)),
    ("t >= now() - 1us", (99_000, None)), ("t >= 5 or t = 2", (2, None)), ("t >= 5 or x = 2", (None, None)), ("t >= 5 and x = 2", (5, None)), ("not t >= 5", (None, None)), ("t >= x", (None, None)), ("t >= 2 * 3 + 1", (7, None)), ("t is null", (None, None)), ("t > 5 and (t < 9 or t < 7)", (6, 8)),
])
def test_bounds(where, want):
    assert bounds(parse(f"select * from a where {where}").where, lambda e: e == s.Name("t"), 100_000) == want


@given(st.integers(-50, 50), st.lists(st.tuples(st.sampled_from(["<", "<=", ">", ">=", "="]), st.integers(-50, 50), st.sampled_from(["and", "or"])), min_size=1, max_size=5))
def test_bounds_hold_every_row_that_passes(t, parts):
    text = " ".join((f"{j} " if k else "") + f"t {op} {v}" for k, (op, v, j) in enumerate(parts))
    low, high = bounds(parse(f"select * from a where {text}").where, lambda e: e == s.Name("t"), 0)
    if eval(text.replace("= ", "== ").replace("<==", "<=").replace(">==", ">="), {"t": t}):
        assert (low is None or low <= t) and (high is None or t <= high)
