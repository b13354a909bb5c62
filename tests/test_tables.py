"""Table access: what is kept about a folder follows its state."""

import subprocess
import sys

from ledgerlens.tables import Tables


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(3).write.parquet(f"{folder}/region.parquet")
    first = Tables(spark, folder)
    assert first.region.columns == ["id"] and Tables(spark, folder).state == first.state
    spark.range(5).selectExpr("id", "id AS other").write.mode("overwrite").parquet(f"{folder}/region.parquet")
    again = Tables(spark, folder)
    assert again.state != first.state and again.region.columns == ["id", "other"] and again.region.count() == 5


def test_entry_tells_a_missing_library_from_a_missing_package():
    """Without the llm folders the entry imports; a library that is not there is an error."""
    for gone, fine in (("ledgerlens.llm", True), ("corpus_pipeline", True), ("xxhash", False)):
        code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r} or name.startswith({gone!r} + '.'):
            raise ModuleNotFoundError(f'No module named {{name!r}}', name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert 'r05_greedy_diversity_top_k' in e.queries() and not any(q.startswith('op') for q in e.queries())
"""
        root = __file__.rsplit("/tests/", 1)[0]
        ran = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
        assert (ran.returncode == 0) == fine, ran.stderr
