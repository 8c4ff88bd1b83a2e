import base64
import hashlib

from pyspark.sql import functions as F

from corpuskit.operators import sft, validate, windows
from corpuskit.plans import instructions, merged
from corpuskit.sources import readers, sinks

sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


def body(k):
    return f"import os\n\n\ndef f{k}(a, b):\n    # says {k}\n    if a < b:\n        return os.getcwd() + str({k})\n    return [x for x in range({k}, a)]\n"


def test_merged_build(spark, tmp_path):
    texts = {1: body(1), 2: body(1), 3: body(1).replace("# says 1", "# other"), 4: body(4), 5: body(5) + "(", 6: "tiny", 7: body(7)}
    source = lambda t, i: (i, t)
    rows = [(i, f"p/{i}.py", sha(t), source("local" if i < 4 else "git", "s")) for i, t in texts.items()]
    rows += [(7, "p/7.py", sha(texts[7]), source("git", "s")), (8, "p/8.py", sha("x"), source("git", "s"))]
    m = spark.createDataFrame(rows, "record_id bigint, stored_path string, content_sha256 string, source struct<id: string, type: string>")
    r = spark.createDataFrame(list(texts.items()), "record_id bigint, text string")
    (tmp_path / "v.tiktoken").write_bytes(b"".join(base64.b64encode(bytes([b])) + b" %d\n" % b for b in range(256)))
    stages, counts, sequences = merged.build(m, r, str(tmp_path / "v.tiktoken"), length=50, most_tokens=150, pad_final=True)
    got = {x["record_id"]: (x["reason"], x["duplicate_of"]) for x in stages.collect()}
    place = {x["record_id"]: x["position"] for x in stages.collect()}
    assert sorted(place.values()) == list(range(8)) and place[4] < place[1]  # git comes before local
    assert got == {
        1: ("accepted", None), 2: ("exact_sha256_duplicate", place[1]), 3: ("normalized_duplicate", place[1]), 4: ("accepted", None), 5: ("invalid_python_syntax", None),
        6: ("too_small", None), 7: ("accepted", None), 8: ("missing_file", None),
    }
    stream = b"".join(texts[i].encode() + b"\0" for i in (4, 7, 1))
    rows = sorted(sequences.collect(), key=lambda x: x["sequence"])
    assert bytes(x for s in rows for x in s["ids"]).rstrip(b"\0") == stream.rstrip(b"\0") and [s["shard"] for s in rows] == [k // 3 for k in range(len(rows))]
    assert sum(x["tokens"] for x in counts.collect()) == len(stream)
    written = sinks.write_packed(sequences.withColumn("name", F.format_string("s%03d", "shard")), str(tmp_path / "out"), "name", "sequence", "ids").persist()
    sinks.write_index(written.withColumnRenamed("name", "shard"), str(tmp_path / "out"), 50)
    assert readers.shard_problems(str(tmp_path / "out")) == [] and readers.read_indexed(spark, str(tmp_path / "out")).count() == len(rows)
    (tmp_path / "out" / "s001.bin").write_bytes(b"\0" * 300)
    (tmp_path / "out" / "extra.bin").write_bytes(b"")
    assert readers.shard_problems(str(tmp_path / "out")) == ["s001 has another digest", "extra.bin is not in the index"]
    assert readers.shard_problems(str(tmp_path)) == ["index.json is missing"]


def test_instruction_dataset(spark):
    rows = [(i, f"r{i % 9}" if i % 10 else None, body(i % 17)) for i in range(40)] + [(90, "r1", "x = (" + " " * 30), (91, "r1", None), (92, "r1", "x = 1\n" * 9)]
    df = spark.createDataFrame(rows, "record_id bigint, repo string, text string")
    sources, records = instructions.build(df, group="repo", most=5)
    assert {x["record_id"]: x["reason"] for x in sources.collect() if x["record_id"] >= 90} == {90: "invalid_python_syntax", 91: "missing_content", 92: "no_python_definitions"}
    got = records.toPandas()
    assert got["pair_id"].is_unique and set(got["split"]) == {"train", "validation", "test"} and got["problems"].map(len).eq(0).all()
    assert got.groupby(got["repo"].fillna(""))["split"].nunique().max() == 1
    assert got.groupby("record_id").size().max() <= 5
    for _, part in got.groupby("split"):
        assert sorted(part["place"]) == list(range(len(part)))
    assert instructions.build(df.limit(0), group="repo")[1].count() == 0


def test_small_additions(spark):
    df = spark.createDataFrame([(1, " a ", "", "x"), (2, "a", None, "x "), (3, "", "", "x"), (4, "b", "", None)], "id bigint, i string, g string, o string")
    assert [tuple(x) for x in sft.converted(df, "id", "i", "g", "o").collect()] == [(1, "a", "", "x")]
    ids = spark.createDataFrame([(1, [4, 5])], "id bigint, ids array<int>")
    assert windows.sliding_windows(ids, "ids", 3, 1, "pad", 0, -100).first()["targets"] == [5, -100, -100]
    one = spark.createDataFrame([(1, "a.py", "x = 1  # of many lines"), (2, "b.py", "y = 1  # of many lines")], "id bigint, path string, text string")
    got = validate.collection_reasons(one, "id", "path", "text", (".py",), extra=(("named_x", F.col("text").startswith("x")),)).collect()
    assert {r["id"]: r["reason"] for r in got} == {1: "named_x", 2: "accepted"}
