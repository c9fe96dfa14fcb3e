"""The command line: arguments, batch and stream."""

import json

import pytest

from wardlight.__main__ import arguments, main


def test_arguments():
    assert arguments(["a", "b"], {}).languages is None
    assert arguments(["a", "b"], {"WARDLIGHT_LANGUAGES": "en, fr"}).languages == ["en", "fr"]
    assert arguments(["a", "b", "--languages", "de"], {"WARDLIGHT_LANGUAGES": "en"}).languages == ["de"]
    with pytest.raises(SystemExit):
        arguments(["-v"], {})


@pytest.mark.parametrize("more", [[], ["--stream"]])
def test_main(spark, tmp_path, more):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(json.dumps({"jsonrpc": "2.0", "id": 1, "method": "check_text", "params": {"text": "a frobnicate"}}) + "\n\nbad\n")
    main([str(tmp_path / "in"), str(tmp_path / "out"), "--languages", "en", *more], spark)
    rows = spark.read.json(str(tmp_path / "out")).collect()
    assert {(r.id, r.error) for r in rows} == {("1", None), (None, -32700)}
    assert json.loads(next(r.result for r in rows if r.id == "1"))["maxSeverity"] == 3
    with pytest.raises(ValueError):
        main([str(tmp_path / "in"), str(tmp_path / "other"), "--languages", "xx"], spark)
