import pytest

from newsloom.plans.search import Group, QueryError, Term, parse
from newsloom.plans.serving import code_list


def test_parse():
    assert parse("") == [] and parse(None) == []
    assert parse('"a b" c') == [Group((Term(None, "a b"),), False), Group((Term(None, "c"),), False)]
    assert parse("a OR b -domainis:x") == [Group((Term(None, "a"), Term(None, "b")), False), Group((Term("domainis", "x"),), True)]
    assert parse('(a b "c d") location:"New Zealand"') == [Group((Term(None, "a"), Term(None, "b"), Term(None, "c d")), False), Group((Term("location", "New Zealand"),), False)]
    # the first term's sign is the group's
    assert parse("-a OR b") == [Group((Term(None, "a"), Term(None, "b")), True)] and parse("a OR -b") == [Group((Term(None, "a"), Term(None, "b")), False)]
    assert parse("http://x.y") == [Group((Term(None, "http://x.y"),), False)]
    for bad in ("tone>5", "sentiment:happy", "OR a", '""', "theme:"):
        with pytest.raises(QueryError):
            parse(bad)


def test_code_list():
    assert code_list(["us,uk", "US", " fr "]) == ["US", "UK", "FR"] and code_list(None) == []
