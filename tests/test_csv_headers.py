"""Files of many headers are told apart in one job."""

from citeloom.sources import exports


def test_files_by_header(spark, tmp_path):
    for k in range(12):
        header = "Title,Year" if k % 3 else "Year,Title"
        row = f'"a, ""quoted""\nline {k}",2001' if k % 3 else f"2002,b {k}"
        (tmp_path / f"part {k}+x.csv").write_text(f"{header}\n{row}\n")
    (tmp_path / "broken.csv").write_text('Title,"Ye\nar"\nc,2003\n')
    (tmp_path / "broken2.csv").write_text('Title,"Ye\nars"\nd,2003\n')
    (tmp_path / "empty.csv").write_text("")
    found = exports.csv_files(spark, f"{tmp_path}/*.csv", multiLine=True, escape='"', quote='"')
    assert {tuple(names): len(files) for names, files in found} == {("Title", "Year"): 8, ("Year", "Title"): 4, ("Title", "Ye\nar"): 1, ("Title", "Ye\nars"): 1}
    rows = exports.read_csv(spark, f"{tmp_path}/part*.csv").collect()
    assert len(rows) == 12 and {r["title"] for r in rows if r["year"] == 2002} == {f"b {k}" for k in range(0, 12, 3)}
    assert any(r["title"].endswith("line 1") for r in rows)
