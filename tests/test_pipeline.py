import json
import random

import pytest

from weftlink.cli import main
from weftlink.plans.pipeline import Options, Pipeline


def write(folder, name, rows, header):
    (folder / name).write_text("\n".join(["\t".join(header), *("\t".join(r) for r in rows)]) + "\n")


def data(folder, n=120):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)).title()
    header = ("entity_id", "business_name", "business_address", "country")
    for split in ("train", "test"):
        s1, s2, s3, links = [], [], [], []
        for i in range(n):
            name, address = f"{word()} {word()} Ltd", f"{rng.randrange(1, 999)} {word()} Road {rng.randrange(10000, 99999)}"
            s1.append((f"S1-{i}", name, address, "US"))
            s2.append((f"S2-{i}", name.replace("Ltd", "Limited"), address.replace("Road", "Rd"), "US"))
            s3.append((f"S3-{i}", f"{word()} {word()} Inc", f"{rng.randrange(1, 999)} {word()} Lane", "US"))
            links.append((f"S1-{i}", f"S2-{i}"))
        for k, rows in enumerate((s1, s2, s3), 1):
            write(folder, f"{split}_source{k}.tsv", rows, header)
        if split == "train":
            write(folder, "train_matches.tsv", links, ("source1_entity_id", "matched_entity_ids"))


def test_run_and_resume(spark, tmp_path, capsys):
    (tmp_path / "data").mkdir()
    data(tmp_path / "data")
    options = Options(classical_k=5, ann_k=3, rounds=2)
    report = Pipeline(spark, str(tmp_path / "data"), str(tmp_path / "work"), options).run()
    assert report["holdout"]["macro_fbeta"] > 0.9 and report["candidate_recall"] == 1.0
    lines = (tmp_path / "work" / "matches.tsv").read_text().splitlines()
    assert lines[0] == "source1_entity_id\tmatched_entity_ids" and lines[1:] == sorted(lines[1:])
    assert (tmp_path / "work" / "importance.csv").read_text().startswith("feature,importance\n") and (tmp_path / "work" / "ann_summary.json").exists()
    assert sum(line.endswith(line.split("\t")[0].replace("S1", "S2")) for line in lines if line.startswith("S1-")) > 100
    before = {k: v["all"]["at"] for k, v in json.load(open(tmp_path / "work" / "manifest.json"))["stages"].items()}
    Pipeline(spark, str(tmp_path / "data"), str(tmp_path / "work"), options).run()
    after = {k: v["all"]["at"] for k, v in json.load(open(tmp_path / "work" / "manifest.json"))["stages"].items()}
    assert before == after


def test_cli_shows_a_query(spark, capsys):
    assert main(["query", "audit_source", "--data", "/root/testdata/sf0.001", "--rows", "3"]) == 0
    assert "unique_ids" in capsys.readouterr().out


@pytest.mark.parametrize("report", ["audit", "exact", "tokens", "qgrams", "ranking", "neighbours"])
def test_reports_on_raw_files(spark, tmp_path, capsys, report):
    (tmp_path / "deep" / "data").mkdir(parents=True)
    data(tmp_path / "deep" / "data", 1020)
    assert main(["find", str(tmp_path)]) == 0
    folder = capsys.readouterr().out.strip().splitlines()[-1]
    sampled = ["--per-mille", "10"] if report not in ("audit", "exact") else []
    assert main([report, "--data", folder, "--out", str(tmp_path / "out"), *sampled]) == 0
    got = json.load(open(tmp_path / "out" / "summary.json"))
    if report == "audit":
        assert got["sources"][0]["n_rows"] == 1020 and got["truth"][0]["links"] == 1020
    elif report == "exact":
        assert [r["links"] for r in got["recall"] if r["is_total"]] == [100]
    elif report in ("tokens", "qgrams"):
        assert got["recall"][-1]["combined_recall"] == 1.0 and got["volumes"]
    elif report == "ranking":
        assert got["evidence_totals"][0]["recall"] == 1.0 and got["likeness_totals"][0]["uncut_recall"] == 1.0
    else:
        assert got["union_totals"][0]["recall"] == 1.0 and got["marginal"][0]["either_recall"] == 1.0


def test_a_wrong_header_is_an_error(spark, tmp_path):
    data(tmp_path, 5)
    (tmp_path / "train_source2.tsv").write_text("entity_id\tname\n")
    with pytest.raises(Exception):
        main(["audit", "--data", str(tmp_path)])
