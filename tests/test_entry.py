import __spark_entry__ as entry


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].eligible_posting_count >= 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_alone():
    """Nothing outside the llm subpackage imports it, but for the entry."""
    import pathlib

    root = pathlib.Path(entry.__file__).parent
    for path in root.glob("demandlens/**/*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path
