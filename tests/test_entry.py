import __spark_entry__ as entry


def test_every_oracle_has_a_query_and_llm_is_optional(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    df = entry.entry(spark)
    assert df.count() > 0


def test_core_does_not_import_the_text_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "quillspark"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "quillspark.llm" not in p.read_text(), p
