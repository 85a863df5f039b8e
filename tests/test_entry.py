"""The driver contract, and that nothing outside of the training-data subpackage needs it."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_engine_does_not_import_the_subpackage():
    for path in (ROOT / "neurofold").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"^\s*(from|import)\s.*\bllm\b", path.read_text(), re.M), path
