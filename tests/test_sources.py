"""Readers and writers, through files."""

import datetime as dt

import pytest
from conftest import DAY, rows

from tierflow.operators import audit
from tierflow.sources import registry, sinks, uploads


def write_text(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_upload_reader_normalises(spark, tmp_path):
    path = write_text(
        tmp_path / "u.csv",
        ' jda_item ,JDA_LOC,Proposed Velocity ,Note\n 0012 , 007,A,"say ""hi"", all"\n13,P1,,\n',
    )
    df = uploads.read_upload(spark, path)
    assert set(t for _, t in df.dtypes) == {"string"}
    got = rows(df.select("JDA_ITEM", "JDA_LOC", "PROPOSED_VELOCITY", "PROPOSED_VELOCITY_", "SAP_VELOCITY", "Note"))
    assert got == [("0012", "007", "A", "A", "", 'say "hi", all'), ("13", "P1", "", "", "", None)]


def test_missing_keys_are_an_error(spark, tmp_path):
    path = write_text(tmp_path / "u.csv", "ITEM,JDA_LOC,PROPOSED_VELOCITY\n1,2,A\n")
    with pytest.raises(ValueError, match="JDA_ITEM"):
        uploads.read_upload(spark, path)


@pytest.mark.parametrize(
    "columns, found",
    [
        (["x", "proposed_velocity_", "PROPOSED_VELOCITY"], "PROPOSED_VELOCITY"),
        (["proposed velocity_", "Proposed_Velocity__"], "Proposed_Velocity__"),
        (["Velocity", "my proposed veloc."], "my proposed veloc."),
    ],
)
def test_proposed_column(columns, found):
    assert uploads.find_proposed_column(columns) == found


def test_no_proposed_column():
    with pytest.raises(ValueError):
        uploads.find_proposed_column(["VELOCITY", "PROPOSED"])


def test_segmented_reader(spark, tmp_path):
    paths = {
        t: write_text(tmp_path / f"{t}.csv", f"JDA_ITEM,JDA_LOC,PROPOSED_VELOCITY{',X' if t == 'A' else ''}\n{t}1,L,{t}{',z' if t == 'A' else ''}\n")
        for t in "ABCDE"
    }
    assert rows(uploads.read_segmented(spark, paths).select("JDA_ITEM", "X")) == [
        ("A1", "z"), ("B1", None), ("C1", None), ("D1", None), ("E1", None),
    ]
    alone = uploads.read_segmented(spark, {t: paths[t] for t in "BD"})
    assert rows(alone.select("JDA_ITEM")) == [("B1",), ("D1",)]


def test_tiers_without_rows(spark, tmp_path):
    frame = spark.createDataFrame([("1", "L", "B"), ("2", "L", "d "), ("3", "L", "Missing Data")], "JDA_ITEM string, JDA_LOC string, proposed_velocity string")
    sinks.write_by_tier(frame, str(tmp_path / "out"))
    got = uploads.read_by_tier(spark, str(tmp_path / "out"))
    assert rows(got.select("JDA_ITEM")) == [("1",), ("2",)] and "tier" not in got.columns


def test_state_sheet(spark, tmp_path):
    write_text(tmp_path / "TW Data" / "part.csv", " Item,Dc Number,velocity,MCAT,seq\n 1 , 2 , A ,m,1\n")
    got = uploads.read_state(spark, str(tmp_path))
    assert rows(got.select("ITEM", "`DC NUMBER`", "VELOCITY", "MCAT")) == [("1", "2", "A", "m")]
    with pytest.raises(ValueError):
        uploads.as_state(got.drop("VELOCITY"))


def test_tables_registry(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "k int, old string").write.parquet(str(tmp_path / "t"))
    t = registry.tables(spark, {"t": {"path": str(tmp_path / "t"), "rename": {"old": "new"}}})
    assert t["t"].columns == ["k", "new"] and list(t) == ["t"]
    with pytest.raises(KeyError, match="nothing"):
        t["nothing"]
    got = registry.profile(t["t"]).first()
    assert tuple(got)[:3] == (1, 2, "k,new") and registry.head(t["t"]).count() == 1


def test_catalog_table_overwrite_and_preview(spark):
    df = spark.createDataFrame([(DAY, 1), (DAY - dt.timedelta(days=1), 2), (None, 3)], "table_created_date date, x int")
    spark.sql("drop table if exists tierflow_out")
    sinks.write_table(df, "tierflow_out")
    sinks.write_table(df, "tierflow_out")
    back = registry.tables(spark, {"o": "tierflow_out"})["o"]
    assert tuple(sinks.preview(back, DAY).first()) == (3, DAY, 2)
    spark.sql("drop table tierflow_out")


def test_export_by_tier_and_reload(spark, tmp_path):
    df = spark.createDataFrame(
        [("1", "L", "A"), ("2", "L", " b"), ("3", "L", "Missing Data"), ("4", "L", None)],
        "jda_item string, jda_loc string, proposed_velocity string",
    )
    sinks.write_by_tier(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("tier=*")) == ["tier=A", "tier=B"]
    got = uploads.read_upload(spark, str(tmp_path / "out" / "tier=B"))
    assert rows(got.select("JDA_ITEM", "PROPOSED_VELOCITY")) == [("2", "b")]


def test_delta_reload_equals_template(spark, tmp_path):
    up = uploads.as_upload(
        spark.createDataFrame([("1", "x", "A", "B"), ("2", "y", "C", None)],
                              "JDA_ITEM string, JDA_LOC string, PROPOSED_VELOCITY string, SAP_VELOCITY string")
    )
    state = spark.createDataFrame([("1", "x", "D")], "ITEM string, `DC NUMBER` string, VELOCITY string")
    status = audit.apply_status(up, state)
    sinks.write_report({"not_updated": audit.not_updated(status)}, str(tmp_path))
    again = uploads.upload_from_delta(uploads.read_sheet(spark, str(tmp_path), "not_updated"))
    assert rows(again) == rows(audit.to_template(audit.apply_subset(status)))


def test_stage_writes_to_the_session_folder(spark, tmp_path, monkeypatch):
    df = spark.range(5).toDF("k")
    monkeypatch.setattr(registry, "staging_dir", lambda s: str(tmp_path))
    staged = registry.stage(df, "x")
    assert rows(staged) == rows(df) and list(tmp_path.glob("*/x-*"))
