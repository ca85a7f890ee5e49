import json

from pointlake.__main__ import main


def said(capsys, spark, *args):
    main(args, spark)
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_bitmap(capsys):
    assert said(capsys, None, "bitmap", "0", "1", "0.25", "0.5") == {"mask": "0x0001ff00", "bins": list(range(8, 17)), "width": 1 / 32}


def test_generate_inspect_query_convert(capsys, spark, tmp_path):
    path = str(tmp_path / "t")
    made = said(capsys, spark, "generate", "uniform", "5000", path, "--attributes", "2", "--seed", "3", "--option", "bytesPerSubfile=20000")
    assert made["rows"] == 5000 and made["subfiles"] > 3
    seen = said(capsys, spark, "inspect", path)
    assert seen["num_points"] == 5000 and [a["name"] for a in seen["attributes"]] == ["non-spatial-normal0", "non-spatial-normal1"] and seen["index"]["subfiles"] == made["subfiles"]
    request = json.dumps({"attributes": [{"name": "non-spatial-normal0", "range": [[-1e9, 1e9]]}], "bounds": [[0, 0, 0], [0.5, 1, 1]]})
    (tmp_path / "q.json").write_text(request)
    whole = said(capsys, spark, "query", path, "--json", request)
    steps = said(capsys, spark, "query", path, "--file", str(tmp_path / "q.json"), "--quality", "0.3", "--quality", "1", "-n", "2", "--disable-bitmap")
    assert whole["runs"][0]["rows"] == whole["pruning"]["rows_returned"] == sum(r["rows"] for r in steps["runs"][:2]) and len(steps["runs"]) == 4
    assert 2300 < whole["runs"][0]["rows"] < 2700 and whole["pruning"]["subfiles_kept"] < made["subfiles"]
    (tmp_path / "a.xyz").write_text("2\ntitle\nFe 1 2 3\nC 4 5 6\n")
    assert said(capsys, spark, "convert", str(tmp_path / "a.xyz"), str(tmp_path / "u"))["rows"] == 2
