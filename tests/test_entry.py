import __spark_entry__ as entry


def test_contract(spark):
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert len(names) > 60
    found = entry.entry(spark)
    assert found.columns == ["query_id", "doc_key", "rank", "methods"]


def test_library_stands_without_the_training_data_folder():
    """Nothing but the entry module names the subpackage."""
    from pathlib import Path

    root = Path(entry.__file__).parent
    for path in (root / "quirework").rglob("*.py"):
        if "llm" not in path.parts:
            assert "quirework.llm" not in path.read_text() and ".llm" not in path.read_text(), path
