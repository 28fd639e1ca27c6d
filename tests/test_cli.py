"""Command line on a triangle."""

import pytest

from groundwalk.cli import main


@pytest.fixture
def triangle(tmp_path):
    path = tmp_path / "edges.csv"
    path.write_text("from,to\n0,1\n1,2\n2,0\n")
    return path


def test_help(capsys):
    assert main([]) == 0 and "usage" in capsys.readouterr().out
    for option in ("--help", "--version"):
        with pytest.raises(SystemExit) as stop:
            main([option])
        assert stop.value.code == 0


def test_rank_prints_all(spark, triangle, capsys):
    assert main(["rank", str(triangle), "--engine", "PARALLEL"]) == 0
    said = capsys.readouterr().out
    assert "ranks:" in said and "  0\t1.000000" in said and "(converged)" in said and "vertices: 3" in said


def test_rank_writes(spark, triangle, tmp_path, capsys):
    out = tmp_path / "ranks.csv"
    main(["rank", str(triangle), str(out), "--graph", "in-memory", "--repeat", "2"])
    said = capsys.readouterr().out
    assert out.read_text().splitlines()[0] == "vertex,rank" and len(out.read_text().splitlines()) == 4
    assert "ranks:" not in said and "compute[1]" in said
    main(["rank", str(triangle), str(out), "--print-top", "1"])
    assert "top 1 leaders:" in capsys.readouterr().out


def test_cap_and_verify(spark, triangle, capsys):
    main(["rank", str(triangle), "--max-iterations", "1"])
    assert "(max reached)" in capsys.readouterr().out
    main(["verify", str(triangle), "--max-iterations", "3"])
    assert "max abs difference: " in capsys.readouterr().out


def test_generate(spark, tmp_path):
    out = tmp_path / "made.csv"
    main(["generate", str(out), "--scale", "4", "--edges", "50", "--seed", "7"])
    lines = out.read_text().splitlines()
    assert lines[0] == "from,to" and len(lines) == 51


@pytest.mark.parametrize("arguments", [["rank", "x", "--engine", "magic"], ["rank", "x", "--repeat", "0"], ["rank", "x", "--print-top", "-1"], ["rank", "x", "--threads", "0"], ["rank", "x", "--engine", "common", "--graph", "in-memory", "--threads", "2"], ["generate", "x", "--scale", "0", "--edges", "1"], ["generate", "x", "--edges", "1"]])
def test_bad_options(arguments):
    with pytest.raises(SystemExit) as stop:
        main(arguments)
    assert stop.value.code
