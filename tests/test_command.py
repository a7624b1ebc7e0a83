"""The command line: usage, stdout and files, what it logs, exit codes; and inputs named twice."""

from __future__ import annotations

import io
import json

import pytest

from docpipe import __main__ as command
from docpipe.plans import api


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.txt").write_text("first\n\nsecond")
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "blank.txt").write_text(" \n")
    (tmp_path / "odd.bin").write_bytes(b"\x00\x01")
    return tmp_path


def call(spark, *argv):
    out, err = io.StringIO(), io.StringIO()
    code = command.run(spark, command.usage([str(a) for a in argv]), out, err)
    return code, out.getvalue(), err.getvalue()


@pytest.mark.parametrize("argv", [[], ["a", "--format", "pdf"], ["a", "--pages", "0"], ["a", "--chunk-overlap", "3"], ["a", "-q", "-v"], ["a", "--chunk", "-5"], ["a", "--ocr"], ["a", "--unknown"], ["a", "--rec"]])
def test_wrong_usage_is_two(argv):
    with pytest.raises(SystemExit) as stopped:
        command.usage(argv)
    assert stopped.value.code == 2


def test_levels_and_defaults():
    said = command.usage(["a", "--chunk"])
    assert (said.chunk, said.level, said.format) == (800, command.NORMAL, "md")
    assert command.usage(["--chunk", "0", "--chunk-overlap", "7", "a"]).chunk_overlap == 7
    assert [command.usage(["a", *v]).level for v in (["-q"], ["-v"], ["-vv"], ["-vvv"])] == [command.QUIET, command.VERBOSE, command.DEBUG, command.DEBUG]


def test_stdout_has_documents_alone(spark, folder):
    code, out, err = call(spark, folder / "a.txt")
    assert (code, out, err) == (0, "first\n\nsecond\n", "")
    code, out, err = call(spark, folder / "b.csv", folder / "a.txt", folder / "blank.txt", "-v")
    # Inputs are read in the order of their paths.
    assert out == "first\n\nsecond\n| x   | y   |\n| --- | --- |\n| 1   | 2   |\n"
    assert code == 4 and f"error: {folder / 'blank.txt'}: no extractable text\n" in err and "2 extracted, 0 skipped, 1 failed" in err and "stdout" in err


def test_files_log_and_manifest(spark, folder):
    to, report = folder / "out", folder / "report" / "m.json"
    (folder / "in").mkdir()
    for name in ("a.txt", "b.csv", "blank.txt", "odd.bin"):
        (folder / name).rename(folder / "in" / name)
    code, out, err = call(spark, folder / "in", "--recursive", "-o", to, "--manifest", report, "--chunk", "5")
    assert code == 0 and out == "" and "2 extracted, 2 skipped" in err and f"{folder / 'in' / 'a.txt'} -> {to / 'a.md'}" in err and "warning: skipped" in err
    assert (to / "a.md").read_text().startswith("<!-- chunk 1/3 | ")
    assert [r["status"] for r in json.loads(report.read_text())] == ["extracted", "extracted", "skipped", "skipped"]
    code, out, err = call(spark, folder / "in" / "odd.bin", folder / "lost", "-q")
    assert code == 1 and err.count("error: ") == 2 and len(err.splitlines()) == 2
    (folder / "wall").write_text("a file where a folder should be")
    code, _, err = call(spark, folder / "in" / "a.txt", "-o", folder / "wall" / "x.md")
    assert code == 1 and err.startswith(f"error: {folder / 'in' / 'a.txt'}: ")


def test_an_input_named_twice_is_two_jobs(spark, folder):
    name = str(folder / "a.txt")
    done = api.run_batch(spark, [name, name], output=str(folder / "twice"), manifest=str(folder / "m.json"))
    assert (done.extracted, done.skipped, done.failed, done.exit_code) == (2, 0, 0, 0)
    assert [r["output"] for r in json.loads((folder / "m.json").read_text())] == [str(folder / "twice" / "a.txt.md")] * 2
    assert (folder / "twice" / "a.txt.md").read_text() == "first\n\nsecond\n"
    assert api.run_batch(spark, [name, name], chunk_size=5, printed=(out := io.StringIO())).extracted == 2
    assert out.getvalue().count("chunk 1/3") == 2
