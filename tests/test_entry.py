import subprocess
import sys
import textwrap


def test_entry_without_the_subpackage():
    """As after both folders and the pipeline are deleted."""
    code = textwrap.dedent("""
        import sys
        class Gone:
            def find_spec(self, name, *_):
                if name == "corpus_pipeline" or name.startswith("quernstone.llm"):
                    raise ModuleNotFoundError(name)
        sys.meta_path.insert(0, Gone())
        import __spark_entry__ as e
        q = e.queries()
        assert "search_near" in q and not any(n.startswith("op") or n == "pipeline" for n in q)
        assert set(e.oracle_sql()) <= set(q)
    """)
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["space", "id", "rank"] and df.count() >= 0
