"""The commands end to end on small files, and the views."""

import json

from test_reports import MINI, A, B

from shalework.__main__ import main
from shalework.plans import views
from shalework.sources import reports as R
from shalework.sources import specs


def test_explode_snapshot_verify_assign(spark, tmp_path, capsys):
    raw, out = tmp_path / "raw", tmp_path / "out"
    raw.mkdir()
    (raw / "m.xml").write_bytes(("\n" + MINI).encode("utf-16"))
    assert main(["explode", str(raw), str(out)], spark) == 0
    assert (out / "Mini.fmp12/scripts/1-Open.txt").read_text().startswith("# script 1: Open\n") and (out / "LEGEND.md").exists()
    assert main(["explode", str(raw), str(out)], spark) == 1 and "not empty" in capsys.readouterr().err
    cat = str(tmp_path / "cat")
    common = ["--index", str(out / "index")]
    assert main(["snapshot", *common, "--kind", "scripts", "--output", cat], spark) == 0
    entries = spark.read.parquet(f"{cat}/entries").collect()
    assert {e.source_id for e in entries} == {"Mini.fmp12/scripts/1-Open.txt", "Mini.fmp12/scripts/21-Cast_off.txt"}
    csv = tmp_path / "csv"
    for e in entries:
        at = csv / e.output_file
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"source_id,source_hash\n{e.source_id},{e.source_hash}\n")
    assert main(["verify", *common, "--catalog", cat, "--csv-root", str(csv)], spark) == 0 and "2 objects exactly once" in capsys.readouterr().out
    at.write_text(f"source_id,source_hash\n{e.source_id},zz\n")
    assert main(["verify", *common, "--catalog", cat, "--csv-root", str(csv)], spark) == 1 and "wrong_hash=1" in capsys.readouterr().err
    assert main(["assign", "--catalog", cat, "--agents", "2", "--output", str(tmp_path / "shares")], spark) == 0
    unresolved = spark.read.option("header", "true").option("sep", "\t").csv(str(out / "unresolved"))
    assert {(r.tag, r.status) for r in unresolved.collect()} >= {("Script", "missing"), ("RightTable", "missing")} and unresolved.where("path is null").count() == 0


def test_duplicate_sources_stop_a_run(spark, tmp_path, capsys):
    for n in ("a.xml", "b.xml"):
        (tmp_path / n).write_bytes(MINI.encode("utf-16"))
    assert main(["specs", str(tmp_path), str(tmp_path / "specs")], spark) == 1 and "Mini.fmp12" in capsys.readouterr().err


def test_specs(spark):
    n = R.shred(spark.createDataFrame([("a", A), ("b", B), ("c", MINI)], "doc string, text string")).cache()
    made = {k: [json.loads(r.value) for r in v.collect()] for k, v in specs.specs(n).items()}
    assert len(made) == 11
    moorings = next(t for t in made["01_tables"] if t["name"] == "Moorings")
    assert [f["name"] for f in moorings["fields"]] == ["ID", "rope_no"] and moorings["fields"][0]["validation"] == {"not_empty": True, "unique": True} and "comment" not in moorings["fields"][1]
    assert next(o for o in made["02_table_occurrences"] if o["name"] == "Ropes")["resolved_source_file"] == "Bilge.fmp12"
    detail = next(x for x in made["04_layouts"] if x["name"] == "Deck")
    assert len(detail["buttons"]) == 2 and "group" not in detail
    assert [s["step_text"] for s in next(s for s in made["05_scripts"] if s["name"] == "Open")["steps"]][0].startswith("Perform Script")
    assert {r["reference"] for r in made["00_topology"] if r.get("unresolved")} == {"Gone"} and len(made["07_security"]) == 2 and made["10_hide_object_when"][0]["layout"] == "Deck"
    n.unpersist()


def test_views(spark):
    n = R.shred(spark.createDataFrame([("c", MINI)], "doc string, text string")).cache()
    assert "d_script_steps" in views.register(n, "d_")
    assert spark.sql("SELECT of_script, count(*) AS n FROM d_script_steps GROUP BY of_script ORDER BY 1").collect()[0].n == 3
    n.unpersist()
