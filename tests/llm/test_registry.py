from lodestone.llm import registry


def test_a_query_for_each_operator_and_text_for_sql():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert all(n in names and isinstance(x, str) for n, x in registry.oracle_sql().items())
