import pytest
from pyspark.sql import functions as F

from corpuskit.sources import readers, sinks
from corpuskit.streaming import ingest


def test_scan_tree(spark, tmp_path):
    files = {"pkg/a.py": b"def a(): pass\n", "build/x.py": b"x", "docs/b.md": "\ufeffhé".encode(), "c.bin": b"\x00\x01", "big.txt": b"x" * 5000, "bad.txt": b"ok \xff\xfe text"}
    for name, content in files.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    df = readers.scan_tree(spark, str(tmp_path), "s", include=["**/*.py", "*.md", "**/*.txt"], most_bytes=1000)
    got = {r["relative_path"]: r["t"] for r in df.select("relative_path", readers.decoded(F.col("content")).alias("t")).collect()}
    assert got == {"pkg/a.py": "def a(): pass\n", "docs/b.md": "hé", "bad.txt": None}


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"instruction": "a", "response": "r"}\n\nnot json\n{"instruction": "b", "output": " "}\n')
    path = str(tmp_path / "x.jsonl")
    lenient = readers.read_jsonl_lenient(spark, path, "instruction string").collect()
    assert sorted((r["instruction"], r["broken"]) for r in lenient if r["instruction"]) == [("a", None), ("b", None)]
    assert [r["broken"] for r in lenient if r["broken"]] == ["not json"]
    assert [tuple(r) for r in readers.read_examples(spark, path).collect()] == [("a", "", "r")]
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, path, "instruction string").collect()
    sinks.write_jsonl(spark.range(3), str(tmp_path / "out"), compress=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_packed_round_trip(spark, tmp_path):
    rows = [("s0", i, [i, 65535, 7]) for i in range(5)] + [("s1", 9, [1, 2, 3])]
    df = spark.createDataFrame(rows, "shard string, seq bigint, ids array<int>")
    out = str(tmp_path / "packed")
    assert {r["shard"]: r["sequences"] for r in sinks.write_packed(df, out, "shard", "seq", "ids").collect()} == {"s0": 5, "s1": 1}
    back = {(r["shard"], r["sequence"]): r["ids"] for r in readers.read_packed(spark, out, 3).collect()}
    assert back[("s0.bin", 4)] == [4, 65535, 7] and len(back) == 6
    with pytest.raises(Exception):
        readers.read_packed(spark, out, 4).collect()
    report = sinks.write_report(df.agg(F.count("*").alias("n")), str(tmp_path / "r.json"))
    assert report == {"n": 6}


def test_ingest_takes_each_content_once(spark, tmp_path):
    body = "import os\n\n\ndef f():\n    return os.name\n" * 10
    cols = "record_id bigint, text string, repo_name string, path string, license string"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.createDataFrame([(1, body, "r", "a.py", "MIT"), (2, body, "r", "b.py", "MIT"), (3, "x", "r", "c.py", "MIT")], cols).write.parquet(src + "/one")
    schema = spark.read.parquet(src + "/one").schema
    ingest.ingest(spark, src + "/*", schema, out, state).awaitTermination()
    spark.createDataFrame([(4, body, "r", "d.py", "MIT"), (5, body + "# more\n", "r", "e.py", None)], cols).write.parquet(src + "/two")
    ingest.ingest(spark, src + "/*", schema, out, state).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.select("content_hash").distinct().count() == 2
    batch = ingest.accepted(spark.read.parquet(src + "/one", src + "/two")).select("content_hash").distinct()
    assert {r[0] for r in batch.collect()} == {r[0] for r in got.select("content_hash").collect()}


def test_archives(spark, tmp_path):
    import stat
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in {"p/a.py": "def a(): pass  # enough\n", "../up.py": "x" * 50, "b.exe": "x" * 50, "c.py": "x", "big.py": "y" * 3000, "m_pb2.py": "z" * 50, "d/": ""}.items():
            z.writestr(name, data)
        link = zipfile.ZipInfo("l.py")
        link.external_attr = (stat.S_IFLNK | 0o777) << 16
        z.writestr(link, "a.py")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    got = {(r["archive"][-5:], r["member"]): (r["reason"], r["content"] is not None) for r in readers.zip_candidates(spark, str(tmp_path), most=1000).collect()}
    want = {"p/a.py": None, "../up.py": "unsafe_archive_path", "b.exe": "unsupported_extension", "c.py": "too_small", "big.py": "too_large", "m_pb2.py": "generated_file", "l.py": "archive_symlink"}
    assert got == {("a.zip", k): (v, v is None) for k, v in want.items()} | {("b.zip", None): ("archive_read_error", False)}
    (tmp_path / "dir").mkdir()
    assert [(x["source_id"], x["type"]) for x in readers.discover_imports(str(tmp_path))] == [("a", "zip"), ("b", "zip"), ("dir", "directory")]


def test_numbered_lines_and_containers(spark, tmp_path):
    import gzip
    import json

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n[1]\nbroken\n{"a": 2}\n')
    rows = [(r["line"], r["record"], r["error"]) for r in readers.read_jsonl_numbered(spark, str(tmp_path / "x.jsonl")).collect()]
    assert rows == [(1, '{"a": 1}', None), (3, None, "no_object"), (4, None, "invalid_json"), (5, '{"a": 2}', None)]
    with pytest.raises(Exception, match="x.jsonl:3"):
        readers.read_jsonl_numbered(spark, str(tmp_path / "x.jsonl"), strict=True).collect()
    (tmp_path / "z.jsonl.gz").write_bytes(gzip.compress(b'{"t": "\xc3\xa9"}\n'))
    assert readers.read_jsonl_numbered(spark, str(tmp_path / "z.jsonl.gz")).first()["record"] == '{"t": "é"}'
    folder = tmp_path / "json"
    folder.mkdir()
    for n, data in enumerate(([{"instruction": "a", "output": "b"}], {"data": [{"text": "c"}, {"output": " "}]}, {"instruction": "d", "input": "e", "response": "f"})):
        (folder / f"{n}.json").write_text(json.dumps(data))
    assert sorted(tuple(r) for r in readers.read_example_files(spark, str(folder)).collect()) == [("", "", "c"), ("a", "", "b"), ("d", "e", "f")]
    df = spark.createDataFrame([("t", None, None), (" ", "i", " r ")], "text string, instruction string, response string")
    assert [r["text"] for r in readers.marker_texts(df).collect()] == ["t", "<|user|>\ni\n<|assistant|>\nr"]
    with pytest.raises(Exception):
        readers.marker_texts(spark.createDataFrame([("t", "i", "r")], df.schema)).collect()
    assert readers.full_pairs(df).count() == 1
    strings = spark.createDataFrame([('{"a": ["x", {"b": "y"}], "c": 1, "d": "z"}',), ("broken",), (None,)], "j string").select(readers.strings_of_json(F.col("j")).alias("s"))
    assert [r["s"] for r in strings.collect()][:2] == [["x", "y", "z"], []]


def test_byte_budget_never_cuts_a_character(spark):
    texts = ["aé€😀b" * 3, "xyz", "ééé", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    raw = "".join(texts).encode()
    for budget in range(len(raw) + 2):
        if budget % 5 and budget > 14:
            continue
        got = {r["id"]: r["text"] for r in readers.within_bytes(df, "id", "text", budget).collect()}
        assert "".join(got[i] for i in sorted(got)) == raw[:budget].decode(errors="ignore")


def test_shards_with_an_index_and_numbering_that_goes_on(spark, tmp_path):
    import gzip
    import json
    import os

    rows = [(f"s{i // 3}", i, [i, 7]) for i in range(5)]
    df = spark.createDataFrame(rows, "shard string, seq bigint, ids array<int>")
    out = str(tmp_path / "p")
    written = sinks.write_packed(df, out, "shard", "seq", "ids")
    index = sinks.write_index(written.persist(), out, 2)
    assert index["sequences"] == 5 and index["tokens"] == 10 and [s["shard"] for s in index["shards"]] == ["s0", "s1"]
    assert sorted((r["sequence"], r["ids"]) for r in readers.read_indexed(spark, out).collect()) == [(i, [i, 7]) for i in range(5)]
    with pytest.raises(FileExistsError):
        sinks.write_packed(df, out, "shard", "seq", "ids")
    os.truncate(os.path.join(out, "s1.bin"), 4)
    with pytest.raises(ValueError):
        readers.read_indexed(spark, out)
    texts = spark.createDataFrame([(i, "x" * 20) for i in range(7)], "id bigint, text string")
    folder = str(tmp_path / "j")
    size = len(json.dumps({"id": 0, "text": "x" * 20}, separators=(",", ":"))) + 1
    first = sinks.write_jsonl_shards(texts, folder, "id", 3 * size).collect()
    assert sorted((r["shard"], r["records"], r["bytes"]) for r in first) == [("shard-000000.jsonl.gz", 3, 3 * size), ("shard-000001.jsonl.gz", 3, 3 * size), ("shard-000002.jsonl.gz", 1, size)]
    sinks.write_jsonl_shards(texts.filter("id = 0"), folder, "id", 3 * size).collect()
    with gzip.open(os.path.join(folder, "shard-000003.jsonl.gz"), "rt") as f:
        assert json.loads(f.read()) == {"id": 0, "text": "x" * 20}


def test_tokens_are_carried_over_and_streams_stop_at_their_target(spark, tmp_path):
    schema = "s string, at bigint, ids array<int>, n bigint"
    for k, rows in enumerate(([("a", 1, [1, 2, 3], 3), ("b", 1, [9], 1)], [("a", 2, [4, 5], 2), ("a", 3, None, 0)], [("a", 4, [6, 7, 8], 3), ("b", 2, [10, 11, 12], 3)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    raw = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def run(df, name):
        df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(tmp_path / name))

    packed = run(ingest.packed_stream(raw(), "s", "at", 2), "packed")
    assert sorted((r["s"], r["sequence"], r["ids"]) for r in packed.collect()) == [("a", 0, [1, 2]), ("a", 1, [3, 4]), ("a", 2, [5, 6]), ("a", 3, [7, 8]), ("b", 0, [9, 10]), ("b", 1, [11, 12])]
    kept = run(ingest.until_bytes(raw().select("s", "at", "n"), "s", "at", "n", 4), "kept")
    assert sorted((r["s"], r["at"]) for r in kept.collect()) == [("a", 1), ("a", 2), ("b", 1), ("b", 2)]


def test_stages_resume_by_fingerprint(spark, tmp_path):
    from corpuskit.plans import resume

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id bigint, t string")
    same, other = resume.content_fingerprint(df.repartition(3), "id", "t"), resume.content_fingerprint(df.distinct(), "id", "t")
    assert same == resume.content_fingerprint(df, "id", "t") != other
    made = []

    def make():
        made.append(1)
        return df

    for fingerprint, settings, anew in ((same, {"k": 1}, True), (same, {"k": 1}, False), (other, {"k": 1}, True), (other, {"k": 2}, True)):
        table, fresh = resume.stage(spark, str(tmp_path / "s"), fingerprint, settings, make)
        assert fresh == anew and table.count() == 3
    assert len(made) == 3


def test_public_bpe(spark, tmp_path):
    import base64

    from corpuskit.operators import bpe

    ranks = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    (tmp_path / "v.tiktoken").write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % n for n, t in enumerate(ranks)))
    df = spark.createDataFrame([(1, "abcab"), (2, "e\u0301<|x|>"), (3, ""), (4, None)], "id bigint, text string")
    ids = bpe.encode(df, "id", "text", str(tmp_path / "v.tiktoken"))
    got = {r["id"]: r["ids"] for r in ids.collect()}
    assert got[1] == [257, 256] and got[3] == [] and 4 not in got and len(got[2]) == 2 + 5
    assert {r["id"]: r["text"] for r in bpe.decode(ids, "id", "ids", str(tmp_path / "v.tiktoken")).collect()} == {1: "abcab", 2: "\u00e9<|x|>", 3: ""}


def test_source_index(spark):
    import hashlib

    from corpuskit.operators import index

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    a, b = "class A:\n    def f(self): pass\n", "import json\n\n\ndef g(): pass\n"
    m = spark.createDataFrame([(1, "a.py", sha(a), "MIT", ("s",)), (1, "a.py", sha(a), "MIT", ("s",)), (2, "b.py", sha(b), " ", ("s",)), (3, "c.py", sha(a), None, ("s",))], "record_id bigint, stored_path string, content_sha256 string, license string, source struct<id: string>")
    r = spark.createDataFrame([(1, a), (2, b), (3, a)], "record_id bigint, text string")
    files, categories, symbols = index.build_index(m, r)
    assert {x["record_id"]: x["estimated_pairs"] for x in files.collect()} == {1: 2, 2: 1}
    assert {x["license"]: x["files"] for x in index.population_report(files).collect()} == {"MIT": 1, "<unspecified>": 1}
    assert {x["stored_path"]: (x["categories"], x["primary"]) for x in index.reloaded(files, categories).collect()} == {"a.py": (["OOP"], "OOP"), "b.py": (["Standard Library"], "Standard Library")}
    turns = spark.createDataFrame([(1, 0, "T", "Hello", 5), (1, 1, "T", "world", 6), (2, 0, "World news", "x", 9), (3, 0, None, "y", 1)], "c int, t int, title string, text string, at int")
    assert [x["c"] for x in index.search_conversations(turns, "c", "t", "title", "text", "at", " WORLD ").collect()] == [2, 1]
