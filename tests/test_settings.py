import pytest

from quarryline.settings import Settings, read_settings


def test_the_session_comes_before_the_environment_and_the_file(spark, tmp_path, monkeypatch):
    file = tmp_path / ".env"
    file.write_text("# a comment\nGITHUB_TOKEN='from file'\nEVIDENCE_LINES=7\nMODEL_TEMPERATURE=0.5\nOTHER=1\n")
    monkeypatch.setenv("EVIDENCE_LINES", "8")
    spark.conf.set("spark.quarryline.evidence_lines", "9")
    try:
        got = read_settings(spark, str(file))
    finally:
        spark.conf.unset("spark.quarryline.evidence_lines")
    assert (got.github_token, got.evidence_lines, got.model_temperature, got.model_output_tokens) == ("from file", 9, 0.5, 20_000)
    assert read_settings(None, str(file)).evidence_lines == 8 and "from file" not in repr(got)
    assert read_settings(None, str(tmp_path / "none")) == Settings(evidence_lines=8)


@pytest.mark.parametrize("bad", [{"model_temperature": 3.0}, {"evidence_chars": 0}])
def test_bad_values_are_refused(bad):
    with pytest.raises(ValueError):
        Settings(**bad)
