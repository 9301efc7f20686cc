"""Every dealt operator is registered once, and some test of this folder names it."""

from pathlib import Path

from salesprism.llm import queries


def test_each_operator_is_registered_and_tested():
    names = queries.all_queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert [n for n in names if n not in tests] == []
