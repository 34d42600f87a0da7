import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.session import materialize, scratch_path, shared_dir
from gradeflow.sources import inventory as inv
from gradeflow.sources import readers as rd
from gradeflow.sources import writers as wr

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def put(tmp_path, name, text):
    path = tmp_path / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_every_suffix(spark, tmp_path):
    rows = [(1, "x"), (2, 'q "z", é\nnew')]
    put(tmp_path, "d.json", json.dumps([{"a": a, "b": b} for a, b in rows]))
    put(tmp_path, "d.jsonl", "\n".join(json.dumps({"a": a, "b": b}) for a, b in rows))
    put(tmp_path, "d.csv", 'a,b\n1,x\n2,"q ""z"", é\nnew"\n')
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "d.parquet"))
    for kind in ("json", "jsonl", "csv", "parquet"):
        got = rd.read_dataset(spark, str(tmp_path / f"d.{kind}"), SCHEMA, multi_line=True).orderBy("a").collect()
        assert [tuple(r) for r in got] == rows, kind
    put(tmp_path, "d.tsv", "a\tb\n1\tx\n")
    assert rd.read_dataset(spark, str(tmp_path / "d.tsv"), SCHEMA, accept=rd.CATALOG_SUFFIXES).count() == 1
    for bad in ("d.tsv", "d.xml"):
        with pytest.raises(ValueError, match="unsupported"):
            rd.read_dataset(spark, str(tmp_path / bad))
    with pytest.raises(PySparkException):
        rd.read_dataset(spark, str(tmp_path / "absent.parquet"))


def test_csv_files_are_split_by_default(spark, tmp_path):
    put(tmp_path, "big.csv", "a,b\n" + "".join(f"{i},row {i}\n" for i in range(3000)))
    put(tmp_path, "big.tsv", "a\tb\n" + "".join(f"{i}\trow {i}\n" for i in range(3000)))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        for name in ("big.csv", "big.tsv"):
            path = str(tmp_path / name)
            split = rd.read_dataset(spark, path, SCHEMA, accept=rd.CATALOG_SUFFIXES)
            assert split.rdd.getNumPartitions() > 3 and split.count() == 3000
            assert rd.read_dataset(spark, path, SCHEMA, accept=rd.CATALOG_SUFFIXES, multi_line=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_json_lines_tolerant_and_strict(spark, tmp_path):
    path = put(tmp_path, "x.jsonl", '{"a": 1, "b": "u"}\n\n   \n{"a": 2\n{"a": 3} tail\n{"b": null}\n')
    good, bad = rd.read_jsonl_tolerant(spark, path, SCHEMA)
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "u"), (None, None)]
    assert sorted(r.line for r in bad.collect()) == ['{"a": 2', '{"a": 3} tail']
    assert rd.count_jsonl(spark, path).first().records == 4
    tail = put(tmp_path, "tail.jsonl", '{"a": 3} tail\n')
    for broken in (path, tail):
        with pytest.raises(Exception, match="malformed JSON line"):
            rd.read_jsonl_strict(spark, broken, SCHEMA).count()
    fine = put(tmp_path, "fine.jsonl", '{"a": 1}\n \n{"b": "z"}\n')
    assert rd.read_jsonl_strict(spark, fine, SCHEMA).count() == 2


def test_file_position(spark, tmp_path):
    lines = [f"row {i}" for i in range(5000)]
    put(tmp_path, "in/one.txt", "\n".join(lines))
    put(tmp_path, "in/two.txt", "\n".join(lines[:7]))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")  # many splits per file
        scan = spark.read.text(str(tmp_path / "in")).select("value", F.col("_metadata.file_name").alias("f"), "_metadata")
        got = rd.indexed_scan(scan).select("f", "id", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    assert sorted((r.f, r.id, r.value) for r in got) == sorted(
        [("one.txt", i, t) for i, t in enumerate(lines)] + [("two.txt", i, t) for i, t in enumerate(lines[:7])])


def test_parquet_position(spark, tmp_path):
    spark.range(50).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert rd.parquet_indexed_scan(spark, str(tmp_path / "p"), "pos").where("id <> pos").count() == 0


def test_null_fields_are_written(spark, tmp_path):
    path = wr.write_jsonl(spark.createDataFrame([(1, None), (2, "é")], SCHEMA).coalesce(1), str(tmp_path / "o"))
    lines = sorted(r.value for r in spark.read.text(path).collect())
    assert lines == ['{"a":1,"b":null}', '{"a":2,"b":"é"}']


def test_manifest_and_inventory(spark, tmp_path):
    df = spark.range(30).withColumn("split", F.when(F.col("id") < 3, "eval").otherwise("train"))
    wr.write_split_dataset(df, str(tmp_path / "v1"))
    row = inv.dataset_manifest(spark, str(tmp_path / "v1"), "v1", "here").first()
    assert {k: f.records for k, f in row.files.items()} == {"train": 27, "eval": 3}
    assert row.total_records == 30 and row.weakness_target == "general"
    put(tmp_path, "m/a/x.bin", "1" * 2_000_000)
    put(tmp_path, "m/a/y.bin", "1")
    put(tmp_path, "m/z.bin", "1")
    got = {r.dir.split("/m")[-1]: (r.n_files, r.total_mb) for r in inv.artifact_inventory(spark, str(tmp_path / "m")).collect()}
    assert got == {"/a": (2, 1.91), "": (1, 0.0)}


def test_status_of_results(spark, tmp_path):
    put(tmp_path, "r/one/report.yaml", "x: 1\nrecommendation: REJECT\nrecommendation: APPROVE\n")
    put(tmp_path, "r/two/eval_metrics.json", '{"f1": 1}')
    put(tmp_path, "r/three/other.txt", "recommendation: APPROVE")
    put(tmp_path, "r/four/report.yaml", "nothing")
    put(tmp_path, "r/one/eval_metrics.json", "{}")
    got = {r.result: r.status for r in inv.result_status(spark, str(tmp_path / "r")).collect()}
    assert got == {"one": "REJECT", "two": "metrics available (no report)", "four": ""}


def test_status_of_bundled_results(spark, tmp_path):
    lines = [("one", "report.yaml", 3, "recommendation: APPROVE"), ("one", "report.yaml", 2, " recommendation:  REJECT now"),
             ("one", "report.yaml", 1, "x: 1"), ("one", "eval_metrics.json", 1, "{}"), ("two", "eval_metrics.json", 1, '{"f1": 1}'),
             ("three", "other.txt", 1, "recommendation: APPROVE"), ("four", "report.yaml", 1, "nothing"), ("five", "report.yaml", 1, None)]
    many = spark.range(1, 3001).selectExpr("concat('m', id) result", "'report.yaml' file", "id line_no", "'recommendation: GO' line").coalesce(2)
    path = wr.write_result_bundle(many.unionByName(spark.createDataFrame(lines, wr.BUNDLE).repartition(3)), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("part-*"))) <= 5
    got = {r.result: r.status for r in inv.result_status(spark, path, bundled=True).collect()}
    assert {k: v for k, v in got.items() if not k.startswith("m")} == {
        "one": "REJECT", "two": "metrics available (no report)", "four": "", "five": ""}
    assert len(got) == 3004 and got["m7"] == "GO"


def test_catalog_entry(spark):
    df = spark.createDataFrame([(i, f"math {i}") for i in range(5)], SCHEMA)
    entry = inv.profile_table(df, "quiz.jsonl", ".jsonl", ["a"], 3 << 20)
    row = entry.first()
    assert (row.record_count, row["columns"], row.size_mb) == (5, "a,b", 3.0)
    assert [json.loads(s)["a"] for s in row.samples.split("\n")] == [0, 1, 2]
    failed = inv.failed_profile(spark, "bad.json", ".json", ValueError("no"))
    both = inv.profile_relevance(entry.unionByName(failed), "math quiz math")
    ranked = inv.rank_by_relevance(both).collect()
    assert [(r.name, r.relevance) for r in ranked] == [("quiz.jsonl", 3), ("bad.json", 0)]
    assert [r.name for r in inv.relevant_only(both).collect()] == ["quiz.jsonl"]


def test_shared_folder_is_the_configured_one(spark, tmp_path):
    usual = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark)
    if usual:
        assert scratch_path(spark, "x").startswith(usual)
    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and df.columns == ["id"]


def test_catalog_of_a_folder(spark, tmp_path):
    put(tmp_path, "c/math_quiz.jsonl", '{"q": "one"}\n{"q": "two"}\n\n{"q": "three"}\n{"q": "four"}\n')
    put(tmp_path, "c/sub/list.json", json.dumps([{"a": i} for i in range(5)]))
    put(tmp_path, "c/sub/t.csv", 'math,b\n1,"x\ny"\n2,z\n')
    put(tmp_path, "c/sub/u.tsv", "k\tv\n1\t2\n")
    put(tmp_path, "c/notes.txt", "first\nsecond\n")
    put(tmp_path, "c/broken.json", "{not json")
    put(tmp_path, "c/.hidden/x.jsonl", "{}")
    put(tmp_path, "c/readme.md", "math")
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "c" / "p"))
    rows = inv.scan_catalog(spark, str(tmp_path / "c"), "math quiz").collect()
    # the records of a table file with a header are its lines after that
    got = {r.name if not r.name.startswith("part-") else "part": (r.record_count, r["columns"], r.relevance) for r in rows}
    assert got == {
        "math_quiz.jsonl": (4, "q", 2), "list.json": (5, "a", 0), "t.csv": (3, "math,b", 1), "u.tsv": (1, "k,v", 0),
        "notes.txt": (2, "text", 0), "broken.json": (None, None, 0), "part": (7, "id", 0),
    }
    assert rows[0].name == "math_quiz.jsonl" and rows[-1].name == "broken.json" and rows[-1].error
    assert [json.loads(t)["q"] for t in rows[0].samples.split("\n")] == ["one", "two", "three"]
