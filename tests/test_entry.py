"""The entry points with the corpus operators, and without them."""

import subprocess
import sys

from conftest import ROOT

BLOCKED = """
import sys

class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()), "pipeline" in entry.queries(), any(k.startswith("op") for k in entry.queries()))
"""


def _without(*names):
    return subprocess.run([sys.executable, "-c", BLOCKED.format(names=names, root=ROOT)], capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_what_cannot_be_imported():
    import __spark_entry__ as entry
    from plumbline.plans import queries as geometry

    n = str(len(geometry.QUERIES))
    assert set(geometry.ORACLES) == set(geometry.QUERIES) <= set(entry.queries())
    assert _without("plumbline.llm", "corpus_pipeline") == [n, n, "False", "False"]
    assert _without("zstandard") == [n, n, "False", "False"]


def test_nothing_else_imports_the_corpus_operators():
    code = f"import sys; sys.path.insert(0, {ROOT!r}); import plumbline.plans.queries, plumbline.streaming.boxes, plumbline.sources.columns; print([m for m in sys.modules if m.startswith('plumbline.llm')])"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.strip() == "[]"
