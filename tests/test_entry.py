"""Driver contract: entry runs on sf0.001, registry shapes are consistent."""

import __spark_entry__ as E


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0]["method"] == "DiD (OLS)"


def test_registry_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 100
    for name, sql in s.items():
        assert "SELECT" in sql.upper(), name


def test_contract_works_without_the_optional_modules(tmp_path):
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "causeway"), tmp_path / "causeway", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(E.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 100 and not any(n.startswith('op1') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_contract_works_without_the_vocabulary(tmp_path):
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(E.__file__))
    code = ("import sys; sys.modules['public_tokenizers'] = None; import __spark_entry__ as e; q = e.queries(); "
            "assert len(q) >= 100 and not any(n.startswith('op1') or n == 'pipeline' for n in q); e.oracle_sql()")
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
