"""Files as tables: samples, names, points, spectra, columns pasted by row number, layers split by an attribute."""

from fieldgrid.sources import files


def put(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)
    return str(path / name)


def test_samples_without_header(spark, tmp_path):
    path = put(tmp_path, "s.csv", "1.5,2,7\n-3,,8\n\nx,1,9\n")
    rows = [tuple(r) for r in files.csv_samples(spark, path, 2).collect()]
    assert rows == [(1.5, 2.0, 7), (-3.0, None, 8), (None, 1.0, 9)]


def test_label_names_without_blanks(spark, tmp_path):
    path = put(tmp_path, "names.txt", "water,1\n\n ,2\nforest,3\nbare,\n")
    assert [tuple(r) for r in files.label_names(spark, path).collect()] == [("water", 1), ("forest", 3)]


def test_points_of_a_table(spark, tmp_path):
    path = put(tmp_path, "p.csv", "id,lon,lat\n1,100.5,20\n2,bad,3\n3,,\n4,-7,-8.25\n")
    assert [(r.id, r.x, r.y) for r in files.csv_points(spark, path, "lon", "lat").collect()] == [("1", 100.5, 20.0), ("4", -7.0, -8.25)]


def test_spectra_are_means_of_repeats(spark, tmp_path):
    put(tmp_path / "asd", "a.txt", "Wavelength  a\n350 0.1\n351\t0.2\n")
    put(tmp_path / "asd", "b.txt", "350, 0.3\n352 x\n")
    got = {r.wavelength: round(r.value, 9) for r in files.spectra(spark, str(tmp_path / "asd")).collect()}
    assert got == {350.0: 0.2, 351.0: 0.2}


def test_paste_by_row_number(spark, tmp_path):
    a = put(tmp_path / "a", "1.csv", "".join(f"{i},x{i}\n" for i in range(3000)))
    put(tmp_path / "a", "2.csv", "".join(f"{i},x{i}\n" for i in range(3000, 3500)))
    b = put(tmp_path / "b", "1.csv", "".join(f"{i * i}\n" for i in range(3400)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = files.paste(spark, [str(tmp_path / "a"), b]).orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert a and len(rows) == 3500
    assert all(tuple(r) == (k, str(k), f"x{k}", str(k * k) if k < 3400 else None) for k, r in enumerate(rows))


def test_layer_split_by_attribute(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, kind string")
    files.split_layer(df, str(tmp_path / "out"), "kind")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out" / "kind=a")).collect()) == [1, 3]
