"""Archives, CSV files, sinks, the build, the resumable stream and the command line."""

import io
import os
import subprocess
import sys
import tarfile
import zipfile

import pytest

from bibspan import schemas
from bibspan.fixtures import archives
from bibspan.operators import linkage
from bibspan.plans import datasets
from bibspan.sources import archive, sinks, tables
from bibspan.streaming import resume
from tests.conftest import rows

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CSV_1 = b'id,title,type,pub_date,extra\n"doi:10.1/a omid:br/1","A ""quoted""\nline",,"2020",x\nomid:br/2,"","",,y\n'
CSV_2 = b"pub_date,id,title\nn/a,NULL,nan\n"
EXPECTED = sorted(
    [
        ("doi:10.1/a omid:br/1", 'A "quoted"\nline', None, "2020"),
        ("omid:br/2", "", "", None),
        ("NULL", "nan", None, "n/a"),
    ],
    key=repr,
)


def read(spark, path, **options):
    df = tables.read_archive(spark, str(path), schemas.META, **options)
    return sorted((tuple(r) for r in df.collect()), key=repr), df.rdd.getNumPartitions()


def make_zip(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)


def make_tar(path, members, mode):
    with tarfile.open(path, mode) as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


MEMBERS = {"csv/1.csv": CSV_1, "csv/2.csv": CSV_2, "csv/empty.csv": b"", "readme.txt": b"no"}


def test_zip_members_are_partitions(spark, tmp_path):
    make_zip(tmp_path / "dump.zip", MEMBERS)
    assert read(spark, tmp_path / "dump.zip") == (EXPECTED, 3)
    assert read(spark, f"file:{tmp_path}/dump.zip")[0] == EXPECTED
    assert len(read(spark, tmp_path / "dump.zip", member="2.csv")[0]) == 1
    assert len(read(spark, tmp_path / "dump.zip", member="csv/1.csv")[0]) == 2


@pytest.mark.parametrize("name, mode, parts", [("d.tar", "w", 3), ("d.tar.gz", "w:gz", 1), ("z.tar", "w:gz", 1), ("d.tar.xz", "w:xz", 1)])
def test_tar_members(spark, tmp_path, name, mode, parts):
    make_tar(tmp_path / name, MEMBERS, mode)
    assert read(spark, tmp_path / name) == (EXPECTED, parts)


def test_folder_of_archives_and_outer_archive(spark, tmp_path):
    inner = tmp_path / "inner"
    inner.mkdir()
    make_zip(inner / "a.zip", {"1.csv": CSV_1})
    make_zip(inner / "b.zip", {"2.csv": CSV_2})
    make_zip(inner / "none.zip", {})
    assert read(spark, inner) == (EXPECTED, 2)
    make_zip(tmp_path / "outer.zip", {p.name: p.read_bytes() for p in inner.iterdir()})
    folder = tables.unpack_archives(spark, str(tmp_path / "outer.zip"), str(tmp_path / "unpacked"))
    assert sorted(n.partition("-")[2] for n in os.listdir(folder)) == ["a.zip", "b.zip", "none.zip"]
    assert read(spark, folder) == (EXPECTED, 2)


def test_inner_archives_of_equal_name_stay_apart(spark, tmp_path):
    """Also read as a citation dump directly."""
    shard = b"id,citing,cited\n%d,omid:br/1,omid:br/2\n"
    for k in (1, 2):
        make_zip(tmp_path / f"{k}.zip", {"a.csv": shard % k})
    inner = {f"p{k}/d.zip": (tmp_path / f"{k}.zip").read_bytes() for k in (1, 2)}
    make_zip(tmp_path / "outer.zip", inner | {"readme.txt": b"no"})
    assert [r["id"] for r in tables.read_index(spark, str(tmp_path / "outer.zip")).orderBy("id").collect()] == ["1", "2"]
    make_zip(tmp_path / "plain.zip", {"a.csv": shard % 3})
    assert tables.read_index(spark, str(tmp_path / "plain.zip")).first()["id"] == "3"
    with pytest.raises(ValueError, match="no archive"):
        tables.unpack_archives(spark, str(tmp_path / "plain.zip"), str(tmp_path / "none"))


def test_stored_inner_archives_are_read_in_place(spark, tmp_path, monkeypatch):
    """Stored and compressed inner archives side by side, one with bytes before it; only compressed ones are copied."""
    copied = []
    monkeypatch.setattr(tables, "_copied", lambda *given, made=tables._copied: copied.extend(n for _, n in given[2]) or made(*given))
    rows = {n: "".join(f"{n}-{k},omid:br/{k},omid:br/2\n" for k in range(2_000)) for n in "abcd"}
    for n, text in rows.items():
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("x.csv", "id,citing,cited\n" + text[: len(text) // 2].rpartition("\n")[0] + "\n")
            z.writestr("y.csv", "id,citing,cited\n" + text[len(text[: len(text) // 2].rpartition("\n")[0]) + 1 :])
    with zipfile.ZipFile(tmp_path / "none.zip", "w"):
        pass
    kinds = {"a": zipfile.ZIP_STORED, "b": zipfile.ZIP_STORED, "c": zipfile.ZIP_DEFLATED, "d": zipfile.ZIP_STORED, "none": zipfile.ZIP_STORED}

    def read(names, outer):
        copied.clear()
        with zipfile.ZipFile(tmp_path / outer, "w") as z:
            z.writestr("readme.txt", "no")
            for n in names:
                z.writestr(f"deep/{n}.zip", (b"before" if n == "d" else b"") + (tmp_path / f"{n}.zip").read_bytes(), kinds[n])
        found = tables.read_index(spark, str(tmp_path / outer))
        return sorted(r["id"] for r in found.collect()), list(copied), found.rdd.getNumPartitions()

    want = lambda names: sorted(f"{n}-{k}" for n in names for k in range(2_000))
    assert read(["a", "none", "b", "d"], "stored.zip") == (want("abd"), [], 6)
    assert read(["a", "b", "c"], "both.zip") == (want("abc"), ["deep/c.zip"], 6)
    assert read(["c", "none"], "compressed.zip") == (want("c"), ["deep/c.zip"], 2)


def test_repository_table_is_one_member_only(spark, tmp_path):
    text = b"ITEM_ID,LAN_ISO\n%d,ita\n"
    name = "ODS_L1_IR_ITEM_LANGUAGE.csv"
    make_zip(tmp_path / "repository.zip", {name: text % 1, f"old/{name}": text % 2})
    assert [tuple(r) for r in tables.repository_table(spark, str(tmp_path / "repository.zip"), "language").collect()] == [(1, "ita")]


def test_files_of_a_folder_have_their_own_headers(spark, tmp_path):
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text("iris_type,meta_type\n1,x\n")
    (folder / "b.csv").write_text("meta_type,iris_type\ny,2\n")
    (folder / "c.csv").write_text("\ufeffmeta_type,more,iris_type\nz,,3\n")
    (folder / "d.csv").write_text("iris_type,meta_type\n4,w\n")
    (folder / "_SUCCESS").write_text("")
    assert rows(tables.read_lookup(spark, str(folder))) == [("1", "x"), ("2", "y"), ("3", "z"), ("4", "w")]


def test_archive_becomes_a_table(spark, tmp_path):
    make_tar(tmp_path / "d.tar.gz", MEMBERS, "w:gz")
    df = tables.archive_to_parquet(spark, str(tmp_path / "d.tar.gz"), schemas.META, str(tmp_path / "table"))
    assert sorted((tuple(r) for r in df.collect()), key=repr) == EXPECTED
    assert tables.read_meta(spark, str(tmp_path / "table")).count() == 3


def test_missing_and_unknown_inputs_are_errors(spark, tmp_path):
    for reader in (tables.read_parquet, tables.read_meta, tables.read_index, tables.read_lookup):
        with pytest.raises(FileNotFoundError):
            reader(spark, str(tmp_path / "missing.zip"))
    with pytest.raises(FileNotFoundError):
        tables.repository_table(spark, str(tmp_path / "missing"), "master")
    (tmp_path / "dump.rar").write_bytes(b"x")
    with pytest.raises(ValueError, match="unknown archive type"):
        tables.read_archive(spark, str(tmp_path / "dump.rar"), schemas.META)


def test_long_members_are_streamed(spark, tmp_path):
    """A member of several blocks, with line breaks inside values."""
    line = b'"id %d","a\nb",book,2020\n'
    data = b"id,title,type,pub_date\n" + b"".join(line % i for i in range(1_000_000))
    assert len(data) > archive.BLOCK_BYTES
    make_zip(tmp_path / "big.zip", {"a.csv": data})
    make_tar(tmp_path / "big.tar", {"a.csv": data}, "w")
    for name in ("big.zip", "big.tar"):
        df = tables.read_archive(spark, str(tmp_path / name), schemas.META)
        assert df.where("title = 'a\nb' and type = 'book'").select("id").distinct().count() == 1_000_000


def test_csv_by_name_with_bad_values(spark, tmp_path):
    text = 'TITLE,ITEM_ID,EXTRA,OWNING_COLLECTION,DATE_ISSUED_YEAR,OWNING_COLLECTION_DES\n"a\nb",1,z,35,x,""\n,bad,z,,2020,\n'
    (tmp_path / "m.csv").write_text(text)
    found = [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "m.csv"), schemas.ITEM_MASTER).collect()]
    assert found == [(1, 35, "", None, "a\nb"), (None, None, None, 2020, None)]


def test_lookup_keeps_blank_and_missing_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text('iris_type,meta_type\n3.02 Curatela,book\n,""\n')
    found = [tuple(r) for r in tables.read_lookup(spark, str(tmp_path / "t.csv")).collect()]
    assert found == [("3.02 Curatela", "book"), (None, "")]


def test_release_subfolder(spark, tmp_path):
    folder = tmp_path / "data-2025-05-30"
    inside = folder / "POSTPROCESS-iris-data-2025-05-27"
    inside.mkdir(parents=True)
    text = "ITEM_ID,LAN_ISO\n1,ita\n"
    (inside / "ODS_L1_IR_ITEM_LANGUAGE.csv").write_text(text)
    assert tables.repository_table(spark, str(folder), "language").collect() == [(1, "ita")]
    make_zip(f"{folder}.zip", {f"{inside.name}/ODS_L1_IR_ITEM_LANGUAGE.csv": text})
    assert tables.repository_table(spark, f"{folder}.zip", "language").collect() == [(1, "ita")]


@pytest.fixture(scope="module")
def dumps(spark, data, tmp_path_factory):
    """The derived tables as a repository folder and as archived dumps."""
    root = tmp_path_factory.mktemp("dumps")
    for name, (file, _) in tables.REPOSITORY_TABLES.items():
        if name != "relation":
            sinks.write_csv(data.inputs[name], f"{root}/repository/{file}")
    archives.pack(data.inputs["meta"].repartition(4, "id"), f"{root}/meta", "tar")
    archives.pack(data.inputs["index"].repartition(4, "id"), f"{root}/index", "zip")
    return root


def test_archives_equal_the_plain_tables(spark, data, dumps):
    for name in ("master", "identifier", "description", "publisher", "language"):
        read_back = tables.repository_table(spark, f"{dumps}/repository", name)
        assert rows(read_back) == rows(data.inputs[name])
    assert rows(tables.read_archive(spark, f"{dumps}/meta", schemas.META)) == rows(data.inputs["meta"])
    assert rows(tables.read_index(spark, f"{dumps}/index")) == rows(data.inputs["index"])


def test_build_from_dumps_twice(spark, data, dumps, tmp_path):
    """From archives to datasets; a second run changes nothing and file order does not matter."""
    inputs = datasets.open_inputs(spark, f"{dumps}/repository", f"{dumps}/meta", f"{dumps}/index")
    out = str(tmp_path / "out")
    expected = {step: rows(getattr(data, step)) for step in datasets.STEPS}
    for _ in range(2):
        built = datasets.build(spark, inputs, out)
        assert {step: rows(df) for step, df in built.items()} == expected
    assert {step: rows(tables.read_parquet(spark, f"{out}/{step}")) for step in datasets.STEPS} == expected
    with pytest.raises(ValueError, match="unknown datasets"):
        datasets.build(spark, inputs, out, ("nothing",))


def test_resumed_stream_adds_nothing_twice(spark, tmp_path):
    schema = "ITEM_ID bigint, TITLE string"
    source, out = str(tmp_path / "items"), str(tmp_path / "results")
    corpus = spark.createDataFrame([(1, "a rare title"), (2, "more words here")], "doc_id bigint, text string")

    def match(items):
        asked = items.selectExpr("ITEM_ID as item_id", "TITLE as text")
        return linkage.best_match(asked, corpus).select("item_id", "doc_id")

    def run(checkpoint):
        items = spark.readStream.schema(schema).parquet(source)
        resume.match_new_items(items, match, out, str(tmp_path / checkpoint)).awaitTermination(120)
        return rows(spark.read.parquet(out))

    spark.createDataFrame([(10, "A rare title"), (11, "x")], schema).write.parquet(source)
    assert run("one") == [(1, 10)]
    spark.createDataFrame([(12, "more words here")], schema).write.mode("append").parquet(source)
    assert run("one") == [(1, 10), (2, 12)]
    assert run("two") == [(1, 10), (2, 12)]


def test_command_line(dumps, tmp_path):
    import pathlib

    merged = {}
    for path in sorted(pathlib.Path(f"{dumps}/meta").glob("*.tar")):
        with tarfile.open(path) as tar:
            merged.update({f"{path.stem}/{m.name}": tar.extractfile(m).read() for m in tar})
    make_tar(tmp_path / "meta.tar", merged, "w")
    shared = {**os.environ, "PYTHONPATH": REPO}

    def run(*args):
        command = [sys.executable, "-m", "bibspan", *args]
        return subprocess.run(command, env=shared, cwd=tmp_path, capture_output=True, text=True, timeout=300)

    built = run(
        "build", "--repository", f"{dumps}/repository", "--meta", str(tmp_path / "meta.tar"),
        "--index", f"{dumps}/index", "--out", str(tmp_path / "out"), "--steps", "in_meta", "citations",
    )
    assert built.returncode == 0, built.stderr[-2000:]
    answered = run("answer", "--data", str(tmp_path / "out"), "--question", "3")
    assert "Question 3" in answered.stdout and "len" in answered.stdout
    refused = run("build", "--repository", "r", "--meta", "m", "--out", "o")
    assert refused.returncode != 0 and "--index" in refused.stderr
