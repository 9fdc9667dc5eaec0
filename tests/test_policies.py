"""Source-level guards for the execution policies the library follows."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parents[1] / "fleetkit"
SOURCES = {p.relative_to(ROOT).as_posix(): p.read_text() for p in ROOT.rglob("*.py")}


# the optional subpackage states its own bounds
CORE = {n: t for n, t in SOURCES.items() if not n.startswith("llm/")}


def test_no_local_checkpoint_or_cross_join():
    for name, text in SOURCES.items():
        assert "localCheckpoint" not in text, name
        assert "crossJoin" not in text, name


def test_machine_local_temp_only_as_unset_fallback():
    users = [n for n, t in CORE.items() if re.search(r"\btempfile\b", t)]
    assert users == ["session.py"]               # only when spark.checkpoint.dir is unset


def test_explicit_broadcasts_are_the_bounded_ones():
    found = sorted(n for n, t in CORE.items() if "F.broadcast(" in t)
    # the hot-key list (<= max_hot keys) and its cuts (about 2 x max_hot), one summary row per bucket of
    # a hot tool (as many), the label-dictionary offsets (partitions x columns rows); the node table
    # goes by sc.broadcast
    assert found == ["operators/encode.py", "operators/ledger.py", "operators/sequence.py"]


def test_no_row_at_a_time_python_udfs():
    for name, text in SOURCES.items():
        assert not re.search(r"F\.udf\(|@udf\b|\.rdd\.map\(", text), name
