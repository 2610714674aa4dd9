"""The driver's contract, with and without the removable part."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_and_queries(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert "vsm_topk" in entry.queries()


def _without(tmp_path, names, code, left_out=()):
    """Run ``code`` where only ``names`` of the repository and the parts of the package not left out stand."""
    for name in names:
        (tmp_path / name).symlink_to(ROOT / name)
    package = tmp_path / "lexsift"
    package.mkdir()
    for part in (ROOT / "lexsift").iterdir():
        if part.name not in ("__pycache__", *left_out):
            (package / part.name).symlink_to(part)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True)


SEARCH_ONLY = "import __spark_entry__ as e; q = e.queries(); assert 'vsm_topk' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"


def test_entry_without_the_removable_part(tmp_path):
    _without(tmp_path, ["__spark_entry__.py"], SEARCH_ONLY, ["llm"])


def test_entry_where_only_the_folder_is_gone(tmp_path):
    if (ROOT / "corpus_pipeline.py").exists():
        _without(tmp_path, ["__spark_entry__.py", "corpus_pipeline.py"], SEARCH_ONLY, ["llm"])


def test_entry_where_a_package_of_the_removable_part_is_missing(tmp_path):
    hide = "import sys; sys.modules['public_tokenizers'] = None; "
    _without(tmp_path, [n for n in ("__spark_entry__.py", "corpus_pipeline.py") if (ROOT / n).exists()], hide + SEARCH_ONLY)
