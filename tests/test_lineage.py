import subprocess
import sys
from pathlib import Path

from recordkeep.plans import lineage

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from recordkeep.plans import lineage
from recordkeep.plans.session import session
spark = session("gone", "local[1]", spark__checkpoint__dir="file://" + sys.argv[2])
kept = lineage.cut(spark.range(5), "kept")
again = lineage.cut(kept.where("id > 1"), "again")
print("there", again.count(), len(list(__import__("pathlib").Path(sys.argv[2]).glob("recordkeep/*/again-*/*.parquet"))) > 0)
"""


def test_what_a_session_has_cut_ends_with_its_driver(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", SCRIPT, root, str(tmp_path)], capture_output=True, text=True, timeout=240)
    assert "there 3 True" in run.stdout, run.stderr[-2000:]
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_release_and_scratch(spark):
    here = lineage.session_dir(spark)
    assert here == lineage.session_dir(spark) and here.startswith(spark.conf.get("spark.checkpoint.dir"))
    folder = Path(here.removeprefix("file://"))
    with lineage.scratch(spark):
        one = lineage.cut(spark.range(3), "scratch-test")
        assert one.count() == 3 and len(list(folder.glob("scratch-test-*"))) == 1
    assert not list(folder.glob("scratch-test-*"))
    two = lineage.cut(spark.range(3), "discard-test")
    lineage.discard(two)
    assert not list(folder.glob("discard-test-*"))
