"""CSV and TSF files, malformed ones too, and the command line."""

import io
import json
import math
import zipfile

import numpy as np
import pytest

from augurline import cli
from augurline.sources import returns_csv, tsf

GOOD = "date, a ,b,m\n" + "".join(f"2024-01-{d:02d},{d * 0.01},{(d % 3) * 0.1},{0.5}\n" for d in range(1, 13))


def test_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes(b"\xef\xbb\xbf" + GOOD.encode())
    got = returns_csv.read_returns_csv(spark, f"file://{path}").orderBy("t", "col").collect()
    assert len(got) == 36 and [r["name"] for r in got[:3]] == ["a", "b", "m"] and got[3]["date"] == "2024-01-02" and got[3]["value"] == 0.02
    less = returns_csv.read_returns_csv(spark, f"file://{path}", benchmark="m").orderBy("t", "col").collect()
    assert len(less) == 24 and less[0]["value"] == pytest.approx(0.01 - 0.5) and less[0]["date"] == "2024-01-01"


@pytest.mark.parametrize(
    "text",
    ["", "\n1,2\n", "a,a\n1,2\n", "a,\n1,2\n", "a,b\n1\n", "a,b\n1,2,3\n", "a,b\n1,x\n", "a,b\n1,2\n\n3,4\n", "date\n2024-01-01\n", "a,b\n", 'a,b\n"1,2\n', "date,a\n2024-01-02,1\n2024-01-01,1\n", "date,a\n2024-01-02,1\n2024-01-02,1\n", "date,a\n2024-13-02,1\n", "date,a\n2024-01-01,1\n2024-01-02T00:00:00+01:00,1\n"],
)
def test_malformed_csv(text):
    with pytest.raises((ValueError, TypeError, Exception)):
        returns_csv.parse(text.encode())


TEXT = """# a comment
@relation sample
@attribute series_name string
@attribute start_timestamp date
@frequency daily
@missing true
@equallength true
@horizon 2
@data
price:2010-07-17 00-00-00:1,?,3
cost:2010-07-18 00-00-00:?,2.5e0,-3
"""


def test_tsf(spark, tmp_path):
    (tmp_path / "a.tsf").write_text(TEXT, encoding="cp1252")
    with zipfile.ZipFile(tmp_path / "bitcoin.zip", "w") as z:
        z.writestr("x/a.tsf", TEXT)
    for rows in (tsf.read_tsf(spark, f"file://{tmp_path}/a.tsf"), tsf.load_dataset(spark, "bitcoin", cache_dir=str(tmp_path))):
        got = rows.orderBy("ordinal").collect()
        assert [r["name"] for r in got] == ["price", "cost"] and got[0]["y"] == [1, None, 3] and got[0]["horizon"] == 2
        assert str(got[1]["start_timestamp"]) == "2010-07-18 00:00:00" and got[0]["attributes"]["series_name"] == "price"
        long = {(r["series_id"], r["t"]): r["y"] for r in tsf.observations(rows).collect()}
        assert long == {("price", 0): 1, ("price", 1): None, ("price", 2): 3, ("cost", 0): 2.5, ("cost", 1): -3}
    assert tsf.available_datasets() == ("fred_md", "bitcoin", "oikolab_weather")
    with pytest.raises(FileNotFoundError):
        tsf.load_dataset(spark, "fred_md", cache_dir=str(tmp_path))
    with pytest.raises(ValueError):
        tsf.load_dataset(spark, "bitcoin", cache_dir=str(tmp_path), sha256="0")
    with pytest.raises(ValueError):
        tsf.load_dataset(spark, "other", cache_dir=str(tmp_path))


@pytest.mark.parametrize(
    ("old", "new"),
    [("@missing true", "@missing false"), ("3\ncost", "3,4\ncost"), ("cost", "price"), ("@data", ""), ("1,?,3", "1,inf,3"), ("1,?,3", "1,nan,3"), ("@horizon 2", "@horizon 0"), ("@horizon 2", "@horizon 2\n@horizon 3"), ("@frequency daily", "@colour red"), ("date", "time"), ("2010-07-17 00-00-00", "2010-07-17"), ("price:", "")],
)
def test_malformed_tsf(old, new):
    with pytest.raises(ValueError):
        tsf.parse(TEXT.replace(old, new, 1).encode())
    assert tsf.parse(TEXT.encode())


def test_archives_must_hold_one_file():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.tsf", TEXT)
        z.writestr("b.tsf", TEXT)
    with pytest.raises(ValueError):
        tsf.unpacked(buffer.getvalue())


def test_command_line(spark, tmp_path, capsys):
    rng = np.random.default_rng(1)
    path = tmp_path / "r.csv"
    path.write_text("a,b\n" + "".join(f"{x},{y}\n" for x, y in rng.normal(size=(40, 2)) + [0, 1]))
    out = tmp_path / "out.json"
    assert cli.run(["test", str(path), "--output", str(out), "--resamples", "99"]) == 0
    rows = json.loads(out.read_text())["rows"]
    assert [r["name"] for r in rows] == ["a", "b"] and rows[1]["reject"] and not math.isnan(rows[0]["adjusted_pvalue"])
    assert cli.run(["audit", str(path), "--output", str(out), "--resamples", "49", "--report", str(tmp_path / "r.html")]) == 0
    assert "<td>b</td>" in (tmp_path / "r.html").read_text()
    assert cli.run(["test", str(path), "--output", str(tmp_path / "o.csv"), "--method", "gaussian_ar", "--format", "csv"]) == 0
    assert (tmp_path / "o.csv").read_text().startswith("col,")
    assert cli.run(["test", str(path), "--output", str(path)]) == 2 and "error" in capsys.readouterr().err
    assert cli.run(["test", str(tmp_path / "none.csv"), "--output", str(out)]) == 2
    assert cli.run(["test", str(path), "--method", "gaussian_ar", "--lags", "3"]) == 2 and "lags" in capsys.readouterr().err
    assert cli.run(["test", str(path), "--resamples", "49", "--studentization", "fixed"]) == 0 and '"rows"' in capsys.readouterr().out
    assert cli.run(["audit", str(path), "--output", str(out), "--resamples", "49", "--complete-search", "--studentization", "resampled"]) == 0
    assert "not stated" not in out.read_text()
