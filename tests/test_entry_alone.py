import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]
COPIED = ["__spark_entry__.py", "lodestone"]


def _listed(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=True).stdout.split()


def _copy(to, leave_out):
    for p in (f for name in [*COPIED, "corpus_pipeline.py"] for f in ([ROOT / name] if name.endswith(".py") else sorted((ROOT / name).rglob("*.py")))):
        rel = p.relative_to(ROOT)
        if p.exists() and not any(str(rel).startswith(x) for x in leave_out):
            (to / rel).parent.mkdir(parents=True, exist_ok=True)
            (to / rel).write_text(p.read_text())


def test_without_the_training_data_operators(tmp_path):
    for k, gone in enumerate((["lodestone/llm", "corpus_pipeline.py"], ["lodestone/llm"])):
        _copy(tmp_path / str(k), gone)
        n, m, has = _listed(tmp_path / str(k))
        # three queries have no SQL twin
        assert int(n) >= 150 and int(n) == int(m) + 3 and has == "False"
