import pytest

from strokeforge.errors import EngineError
from strokeforge.sources import files


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "name string, svg string")


def test_files_are_named_by_documents_and_read_whole(spark, tmp_path):
    docs = [(f"d{i}", "<svg>\n" + "ü" * i + "\r\n</svg>") for i in range(40)] + [("empty", "")]
    files.write_files(rows(spark, *docs).repartition(5), str(tmp_path / "o"), "name")
    assert sorted(p.name for p in (tmp_path / "o").glob("*.svg")) == sorted(f"{n}.svg" for n, _ in docs)
    assert not [p for p in (tmp_path / "o").iterdir() if p.name.startswith(".")]
    got = files.read_files(spark, str(tmp_path / "o")).collect()
    assert sorted((r.name, r.svg) for r in got) == sorted(docs)
    # Writing again replaces by name, as a task that runs twice does.
    files.write_files(rows(spark, ("d1", "new")), str(tmp_path / "o"), "name")
    assert files.read_files(spark, str(tmp_path / "o")).filter("name = 'd1'").first().svg == "new"


def test_partitions_hold_files_by_bytes(spark, tmp_path):
    for i in range(10):
        (tmp_path / f"{i}.svg").write_text("x" * 1000)
    (tmp_path / "note.txt").write_text("not a drawing")
    few = files.SvgReader(str(tmp_path), files.PARTITION_BYTES).partitions()
    many = files.SvgReader(str(tmp_path), 2 * (1000 + files.OPEN_COST)).partitions()
    assert [len(p.paths) for p in few] == [10] and [len(p.paths) for p in many] == [2] * 5
    assert files.read_files(spark, str(tmp_path), 1).rdd.getNumPartitions() == 10


def test_bad_names_and_equal_names_are_refused(spark, tmp_path):
    with pytest.raises(EngineError):
        files.write_files(rows(spark, ("a", "1"), ("a", "2")), str(tmp_path / "o"), "name")
    assert not (tmp_path / "o").exists()
    for name, svg in ((None, "x"), ("", "x"), ("../a", "x"), (".a", "x"), ("a" * 300, "x"), ("a", None)):
        with pytest.raises(Exception, match="named|drawing"):
            files.write_files(rows(spark, (name, svg)), str(tmp_path / "o"), "name")
    assert not list((tmp_path / "o").glob("*.svg"))


def test_an_empty_table_gives_an_empty_folder(spark, tmp_path):
    files.write_files(rows(spark, ("a", "1")).filter("false"), str(tmp_path / "o"), "name")
    assert files.read_files(spark, str(tmp_path / "o")).count() == 0


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    for names in ("ab", "bc"):
        rows(spark, *[(n, n + names) for n in names]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("name string, svg string").parquet(str(tmp_path / "in"))
        files.stream_files(stream, str(tmp_path / "o"), "name", str(tmp_path / "state")).awaitTermination()
    assert {r.name: r.svg for r in files.read_files(spark, str(tmp_path / "o")).collect()} == {"a": "aab", "b": "bbc", "c": "cbc"}


def test_more_documents_are_more_tasks(spark, tmp_path, monkeypatch):
    """A task writes FILES files whatever their number, where it wrote all that its part of the input held."""
    monkeypatch.setattr(files, "FILES", 10)
    docs = spark.range(0, 35, 1, 1).selectExpr("cast(id AS STRING) AS name", "'<svg/>' AS svg")
    sizes = [len(p) for p in files.dealt(docs, 35).rdd.glom().collect()]
    assert len(sizes) == 4 and max(sizes) <= 10
    assert files.dealt(docs, 10).rdd.getNumPartitions() == 1
    files.write_files(docs, str(tmp_path / "o"), "name")
    assert len(list((tmp_path / "o").glob("*.svg"))) == 35


def leaves(df):
    """Names of the sources that a plan reads."""
    found = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(i).nodeName() + found.apply(i).toString() for i in range(found.size())]


def test_the_driver_holds_no_path_of_a_folder(spark, tmp_path):
    """All paths were in the plan that the driver made: a source's parts, or an index of files."""
    for i in range(30):
        (tmp_path / f"{i:02}.svg").write_text("<svg/>")
    few = files.read_files(spark, str(tmp_path), 3 * (6 + files.OPEN_COST))
    assert few.rdd.getNumPartitions() == 10 and not any("svg_files" in x for x in leaves(few))
    assert len(few.inputFiles()) == 1  # the table of names
    assert [r.name for r in few.collect()] == [f"{i:02}" for i in range(30)]
    assert [r.path for r in few.collect()] == [f"{tmp_path}/{i:02}.svg" for i in range(30)]


def test_the_folder_of_a_stream_is_listed_by_a_task(spark):
    from strokeforge.plans import catalog

    df = catalog.QUERIES["s12_named_files"](spark, "/root/testdata/sf0.001")
    assert df.count() == 200 and not df.inputFiles()


def test_a_folder_is_listed_without_being_held(spark, tmp_path):
    import tracemalloc

    for i in range(5000):
        (tmp_path / f"{'x' * 150}{i}.svg").touch()
    (tmp_path / "folder.svg").mkdir()
    tracemalloc.start()
    try:
        assert sum(1 for _ in files._entries(str(tmp_path))) == 5000
        assert tracemalloc.get_traced_memory()[1] < 500_000
    finally:
        tracemalloc.stop()
    assert files.list_files(spark, f"file://{tmp_path}").count() == 5000


def test_many_parts_are_few_tasks(spark, tmp_path, monkeypatch):
    """Tasks of the smallest parts grow in number to TASKS, and then in size to PARTS parts."""
    monkeypatch.setattr(files, "TASKS", 4)
    for i in range(30):
        (tmp_path / f"{i:02}.svg").write_text(str(i))
    df = files.read_files(spark, str(tmp_path), 1)
    assert df.rdd.getNumPartitions() == 4  # of 8 parts each
    assert [(r.name, r.svg) for r in df.collect()] == [(f"{i:02}", str(i)) for i in range(30)]
    monkeypatch.setattr(files, "PARTS", 2)
    assert files.read_files(spark, str(tmp_path), 1).rdd.getNumPartitions() == 15
