"""Static checks of the library source against the scale rules."""
import pathlib
import re

SRC = pathlib.Path(__file__).resolve().parents[1] / "ratelens"
FORBIDDEN = {
    r"localCheckpoint": "lineage must be cut with a written table or reliable checkpoint",
    r"\.crossJoin\(|how=\"cross\"|, \"cross\"\)": "no cross joins",
    r"@F\.udf|F\.udf\(|@udf|pandas_udf|mapInPandas|applyInPandas": "no Python in the data path",
    r"toPandas\(": "no row-level data through the driver",
    r"\.rdd\.map|mapPartitions": "DataFrame operators only",
}


def _library_files():
    return [p for p in SRC.rglob("*.py") if p.name != "verify.py"]


def test_forbidden_patterns_absent():
    for path in _library_files():
        text = path.read_text()
        for pattern, why in FORBIDDEN.items():
            assert not re.search(pattern, text), f"{path.name}: {pattern} ({why})"


def test_temp_folders_only_as_unset_fallback():
    for path in _library_files():
        text = path.read_text()
        if "tempfile" in text:
            assert path.name == "session.py", path
            assert 'spark.conf.get("spark.checkpoint.dir", None)' in text
