"""The command line."""

import io

import pytest

from logstrata import cli
from logstrata.schema import InvalidInput


@pytest.fixture(autouse=True)
def same_session(spark, monkeypatch):
    monkeypatch.setattr(cli, "get_spark", lambda: spark)


def test_generate_ingest_query_stats(spark, tmp_path, capsys, monkeypatch):
    out, store = str(tmp_path / "lines"), str(tmp_path / "store")
    assert cli.main(["generate", "18", out, "svc"]) == 0
    text = "".join(r.value + "\n" for r in spark.read.text(out).collect()) + "plain WARN line\n\n"
    monkeypatch.setattr("sys.stdin", io.StringIO(text))
    assert cli.main(["agent", store, "app", "-"]) == 0
    capsys.readouterr()
    assert cli.main(["query", store, "0", "9999999999999", "ERROR", "5"]) == 0
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 2 and all("[svc] E: ERROR: null pointer" in x for x in lines)
    assert cli.main(["stats", store]) == 0
    assert "line_count: 19" in capsys.readouterr().out


def test_bad_arguments(capsys):
    assert cli.main([]) == 1 and cli.main(["query", "x"]) == 1 and cli.main(["other"]) == 1
    with pytest.raises(InvalidInput):
        cli.main(["query", "x", "zero", "1"])
