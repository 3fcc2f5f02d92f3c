"""The command line, on small tables."""

import pytest

from glossmill.__main__ import main, parser
from glossmill.plans.scoring import scored
from glossmill.sources.files import read_csv

BODY = "We will not rest. " + "The flood of words goes on and on and on here. " * 8


def model():
    return lambda texts: [(0.5,) for _ in texts]


def test_clean_and_features(spark, tmp_path, capsys):
    rows = [("Daily Express", f"u{i}", f"{BODY}\nREAD MORE: x y z", i / 10) for i in range(10)]
    given, done, made = (str(tmp_path / n) for n in ("a.csv", "b.csv", "c"))
    spark.createDataFrame(rows, "outlet string, url string, body string, immigration_score double").write.options(header=True, quote='"', escape='"').csv(given)
    main(["clean", given, done, "--dry-run"])
    assert "50 removed" in capsys.readouterr().out and not (tmp_path / "b.csv").exists()
    main(["clean", given, done])
    assert read_csv(spark, done, None).where("body like '%READ MORE%'").count() == 0
    for more, n in ((["--threshold", "0.65"], 3), (["--no-filter"], 10)):
        main(["features", done, made, *more])
        assert spark.read.parquet(made).count() == n
    main(["score", done, str(tmp_path / "s"), "topic", "--model", "tests.test_commands:model"])
    main(["score", done, str(tmp_path / "s"), "topic", "--model", "tests.test_commands:model", "--resume"])
    assert "0 batches scored, 10 rows" in capsys.readouterr().out
    assert scored(spark, str(tmp_path / "s"), "tests.test_commands:model").count() == 10


def test_correlate(spark, tmp_path):
    days = [(o, f"{2010 + m // 12}-{m % 12 + 1:02d}-05", float(m * m % 17)) for o in ("a", "b") for m in range(60) for _ in range(2)]
    spark.createDataFrame(days, "outlet string, date string, x double").write.parquet(str(tmp_path / "in"))
    quarters = [(2011 + q // 4, q % 4 * 3 + 3, float(q * 7 % 11)) for q in range(14)]
    spark.createDataFrame(quarters, "quarter_end_year int, quarter_end_month int, racial double").write.parquet(str(tmp_path / "series"))
    main(["correlate", str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "series"), "--feature", "x", "--hatecrime-col", "racial"])
    found = spark.read.parquet(str(tmp_path / "out" / "spearman")).collect()
    assert {(r.outlet, r.feature, r.outcome, r.n) for r in found} == {("a", "x", "racial", 14), ("b", "x", "racial", 14)}
    assert spark.read.parquet(str(tmp_path / "out" / "anova")).count() == 2


def test_wrong_words():
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])
