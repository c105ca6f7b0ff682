"""The driver's contract holds with and without the optional training-data part."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
PROBE = """
import sys
{block}
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert "label_stats" in q and set(o) <= set(q), set(o) - set(q)
print(len(q), any(k.startswith("op") and k[2].isdigit() for k in q))
"""


def _run(block: str) -> list[str]:
    return subprocess.run([sys.executable, "-c", PROBE.format(block=block)], cwd=ROOT, check=True, capture_output=True,
                          text=True).stdout.split()


def test_entry_without_the_optional_part():
    n, found = _run('sys.modules["driftlens.llm"] = sys.modules["corpus_pipeline"] = None')
    assert int(n) >= 50 and found == "False"


@pytest.mark.parametrize("module", ["pyarrow", "sentencepiece"])
def test_a_library_that_is_missing_is_an_error(module):
    if not (ROOT / "driftlens/llm").is_dir():
        pytest.skip("needs the optional part")
    with pytest.raises(subprocess.CalledProcessError):
        _run(f'sys.modules["{module}"] = None; import driftlens.llm.pieces as p; p.load_vocabulary()')


def test_a_broken_import_inside_the_optional_part_is_an_error(tmp_path):
    """A copy whose optional part names a module that does not exist."""
    for f in ("__spark_entry__.py", "driftlens"):
        (shutil.copytree if (ROOT / f).is_dir() else shutil.copy)(ROOT / f, tmp_path / f)
    part = tmp_path / "driftlens/llm"
    part.mkdir(exist_ok=True)
    (part / "__init__.py").write_text("")
    (part / "queries.py").write_text("import no_such_library\nQUERIES = {}\n")
    (part / "oracle.py").write_text("ORACLE = {}\n")
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode and "no_such_library" in run.stderr


def test_every_oracle_has_a_query():
    n, _ = _run("")
    assert int(n) >= 50
