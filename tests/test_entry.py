"""Structure of the driver contract and the package sources."""

import ast
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parent.parent


def test_every_table_query_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    q, o = set(E._table_queries()), set(E._table_oracle_sql())
    assert q == o


def test_no_duplicate_top_level_definitions():
    files = [ROOT / "__spark_entry__.py", ROOT / "bench.py", *sorted((ROOT / "framescope").rglob("*.py"))]
    for path in files:
        tree = ast.parse(path.read_text())
        names = [n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.ClassDef))]
        dups = {n for n in names if names.count(n) > 1}
        assert not dups, f"{path.name}: {dups}"
        for node in ast.walk(tree):
            if isinstance(node, ast.Dict):
                keys = [k.value for k in node.keys if isinstance(k, ast.Constant)]
                assert len(keys) == len(set(keys)), f"{path.name}: duplicate dict keys"
