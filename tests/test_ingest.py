"""Import of raw files into a bank: statuses, points, index rows, and a second run that adds nothing."""

from corvida.sources import ingest

KEY = "AAAQKTZKLRYKHR-UHFFFAOYSA-N"
OTHER = "BSYNRYMUTXBXSQ-UHFFFAOYSA-N"
RECORD = '{"id":"r","compound":[{"inchiKey":"%s","names":[{"name":"b"}],"metaData":[]}],"spectrum":"10:1 20:5 20:7","splash":{"splash":"splash10-x"}}' % OTHER


def test_import_twice(spark, tmp_path):
    raw, bank = tmp_path / "raw", str(tmp_path / "bank")
    (raw / "deep").mkdir(parents=True)
    texts = {f"{KEY}.csv": "wavenumber,intensity\n1,2\n2,4.5e1\n2,9\n", f"copy_{KEY}.csv": "1,2\n2,45\n", "noname.csv": "1,2\n", "words.txt": "plain words", "empty.jdx": "\n", "deep/rec.json": RECORD,
             f"deep/{OTHER}.jdx": "##TITLE=t\n##STATE=liquid\n##YUNITS=ABSORBANCE\n##XYDATA=(X++(Y..Y))\n100 .5 -1.E-1\n##END=\n", "hinted.csv": "5,6\n7,8\n"}
    for n, t in texts.items():
        (raw / n).write_text(t)
    hints = spark.createDataFrame([(f"file:{raw}/hinted.csv", KEY, "acid"), (f"file://{raw}/hinted.csv", KEY, "acid"), (f"file:///{str(raw)[1:]}/hinted.csv", KEY, "acid")], "path string, inchikey string, name string")
    want = {f"{KEY}.csv": "imported_local", f"copy_{KEY}.csv": "already_registered", "noname.csv": "unmatched_compound", "words.txt": "unsupported_format", "empty.jdx": "unsupported_format",
            "rec.json": "imported_local", f"{OTHER}.jdx": "imported_local", "hinted.csv": "imported_local"}
    status = {r["path"].rsplit("/", 1)[1]: r["status"] for r in ingest.import_folder(spark, str(raw), bank, hints).collect()}
    assert status == want
    index = {r["raw_file"].rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{bank}/index").collect()}
    points = {}
    for r in spark.read.parquet(f"{bank}/points").collect():
        points.setdefault(r["spectrum_id"], []).append((r["x"], r["y"]))
    got = {n: sorted(points[r["spectrum_id"]]) for n, r in index.items()}
    assert got == {f"{KEY}.csv": [(1.0, 2.0), (2.0, 45.0)], "rec.json": [(10.0, 1.0), (20.0, 7.0)], f"{OTHER}.jdx": [(100.0, 0.5), (101.0, -0.1)], "hinted.csv": [(5.0, 6.0), (7.0, 8.0)]}
    row = index[f"{OTHER}.jdx"]
    assert (row["inchikey"], row["phase"], row["intensity_type"], row["spectrum_type"], row["wavenumber_min"], row["wavenumber_max"], row["n_points_raw"]) == (OTHER, "liquid", "ABSORBANCE", "IR", 100.0, 101.0, 2)
    assert index["rec.json"]["spectrum_type"] == "Mass" and index["hinted.csv"]["name"] == "acid"
    again = {r["path"].rsplit("/", 1)[1]: r["status"] for r in ingest.import_folder(spark, str(raw), bank, hints).collect()}
    assert again == {n: "already_registered" if s == "imported_local" else s for n, s in want.items()}
    (raw / f"new_{OTHER}.csv").write_text("1 1\n3,3\n")  # the next file joins a partition that exists
    third = {r["path"].rsplit("/", 1)[1]: r["status"] for r in ingest.import_folder(spark, str(raw), bank, hints).collect()}
    assert third[f"new_{OTHER}.csv"] == "imported_local"
    assert spark.read.parquet(f"{bank}/index").count() == 5 and spark.read.parquet(f"{bank}/points").count() == 10


def test_a_lost_index_write_is_made_up_for(spark, tmp_path):
    """Points without index rows, as after a run that died between the two, are replaced and not doubled."""
    raw, bank = tmp_path / "raw", str(tmp_path / "bank")
    raw.mkdir()
    (raw / f"{KEY}.csv").write_text("1,2\n2,4\n")
    status, points, _ = ingest.import_files(ingest.read_files(spark, str(raw)), spark.createDataFrame([], ingest.INDEX_SCHEMA))
    from pyspark.sql import functions as F

    ingest.append_new(points, f"{bank}/points", ["spectrum_id"], F.lit("AA"))
    ingest.import_folder(spark, str(raw), bank)
    assert spark.read.parquet(f"{bank}/points").count() == 2 and spark.read.parquet(f"{bank}/index").count() == 1
