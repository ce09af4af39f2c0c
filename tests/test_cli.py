import pytest

from loam.__main__ import main, parser


def test_arguments(tmp_path):
    sample = tmp_path / "a"
    sample.write_text("import pickle")
    args = parser().parse_args(["focused", "carnavalheist", str(sample), "--store", str(tmp_path)])
    assert (args.mode, args.family, args.files) == ("focused", "carnavalheist", [str(sample)])
    for bad in (["focused", "unknown", str(sample)], ["focused", "coper", str(tmp_path)], ["general", str(tmp_path / "none")], []):
        with pytest.raises(SystemExit):
            parser().parse_args(bad)


def test_focused_reports_errors(spark, tmp_path, capsys):
    good, bad = tmp_path / "good", tmp_path / "bad"
    good.write_text("import pickle")
    bad.write_text("nothing known")
    assert main(["focused", "carnavalheist", str(good), str(bad), "--store", f"file://{tmp_path}/g"]) == 0
    assert "bad: classify" in capsys.readouterr().err
    assert (tmp_path / "g" / "focused_corpus" / "focused_corpus_graph" / "vertices").is_dir()
    with pytest.raises(SystemExit):
        main(["focused", "dark-watchmen", str(good)])


def test_session_comes_from_outside(spark):
    from loam.session import outer_session

    assert outer_session() is spark or outer_session().sparkContext is spark.sparkContext
    assert parser().parse_args(["general", __file__, "--master", "spark://host:7077"]).master == "spark://host:7077"
