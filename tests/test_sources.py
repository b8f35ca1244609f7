import io
import json
import tarfile
import zlib

import pytest

from tesserae.functions import text as T
from tesserae.operators import judging
from tesserae.sources import archives, jsonl, runs


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


GOOD = {"query": "q", "query_type": "howto", "expected_symbols": ["a"], "expected_urls": []}


def test_eval_sets(spark, tmp_path):
    rows = jsonl.eval_set(spark, lines(tmp_path / "a", GOOD, "", GOOD | {"query": "r", "match_policy": "all"})).collect()
    assert [(r.match_policy, r.url_match) for r in sorted(rows, key=lambda r: r.query)] == [("any", "strip_anchor"), ("all", "strip_anchor")]
    assert len({r.query_id for r in rows}) == 2


@pytest.mark.parametrize("bad", ["{", GOOD | {"query": " "}, GOOD | {"query_type": "x"}, {k: v for k, v in GOOD.items() if k != "expected_urls"}, GOOD | {"url_match": "x"}])
def test_bad_rows_are_named(spark, tmp_path, bad):
    with pytest.raises(jsonl.SourceError):
        jsonl.eval_set(spark, lines(tmp_path / "a", GOOD, bad))


def test_scores_and_chunks(spark, tmp_path):
    ok = {"query": "q", "tier": "correct"}
    assert jsonl.human_scores(spark, lines(tmp_path / "a", ok)).count() == 1
    for bad in (ok, {"query": "x", "tier": "good"}):
        with pytest.raises(jsonl.SourceError):
            jsonl.human_scores(spark, lines(tmp_path / "b", ok, bad))
    with pytest.raises(jsonl.SourceError):
        jsonl.judge_records(spark, lines(tmp_path / "c", ok))
    chunk = {"chunk_id": "c", "chunk_type": "symbol", "text": "t", "symbols": ["s"]}
    assert jsonl.chunks(spark, lines(tmp_path / "d", chunk)).first().symbols == ["s"]
    with pytest.raises(jsonl.SourceError):
        jsonl.chunks(spark, lines(tmp_path / "e", chunk, chunk))


def test_runs_are_not_overwritten(spark, tmp_path):
    folder = runs.run_folder(str(tmp_path), "tag")
    one = spark.range(1)
    runs.write_run(folder, one, one, retriever="bm25")
    assert spark.read.json(f"{folder}/results").first().retriever == "bm25"
    with pytest.raises(Exception, match="(?i)exists"):
        runs.write_run(folder, one, one)


def test_ingest_by_content(spark, tmp_path):
    frame = lambda text: spark.createDataFrame([("a.html", bytearray(text))], "path string, content binary")
    root = str(tmp_path)
    short, new = runs.ingest(spark, frame(b"one"), "3.12", root)
    assert new and runs.ingest(spark, frame(b"one"), "3.12", root) == (short, False)
    with pytest.raises(runs.VersionConflict):
        runs.ingest(spark, frame(b"two"), "3.12", root)
    assert runs.ingest(spark, frame(b"two"), "3.12", root, force=True)[1] and runs.ingest(spark, frame(b"two"), "3.13", root)[1]


def test_fingerprints_tell_paths_and_swapped_files_apart(spark, tmp_path):
    frame = lambda *files: spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary")
    prints = [runs.ingest(spark, frame(*files), "3.12", str(tmp_path / str(k)))[0] for k, files in enumerate(([("a", b"1"), ("b", b"2")], [("b", b"2"), ("a", b"1")], [("a", b"2"), ("b", b"1")], [("a", b"1"), ("c", b"2")], [("a", b"1")]))]
    assert prints[0] == prints[1] and len(set(prints)) == 4


def test_shared_tables(spark):
    from tesserae import tables

    tables.clean_up(spark)
    before, df = tables.generation(), tables.materialize(spark.range(5), "t")
    assert df.count() == 5 and tables.shared_folder(spark).split("/")[-1] in df.inputFiles()[0]
    assert tables.clean_up(spark) == 1 and tables.clean_up(spark) == 0 and tables.generation() == before + 2


def test_archives(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, data in (("top/a/b.html", b"x"), ("top/c.txt", b"yy")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    df = spark.createDataFrame([(bytearray(out.getvalue()),)], "content binary")
    assert sorted((r.path, bytes(r.content)) for r in archives.tar_members(df).collect()) == [("a/b.html", b"x"), ("c.txt", b"yy")]
    body = "pathlib.Path py:class 1 library/pathlib.html#$ -\nopen py:function 1 f.html#open -\nlabel std:label -1 x.html Some title\n"
    inv = b"# Sphinx inventory version 2\n# Project: p\n# Version: 1\n# zlib\n" + zlib.compress(body.encode())
    rows = archives.inventory(spark.createDataFrame([(bytearray(inv),)], "content binary")).collect()
    assert sorted(tuple(r) for r in rows if r.module) == [("pathlib.Path", "py:class", "library/pathlib.html#pathlib.Path", "pathlib")]
    assert sorted(r.name for r in rows) == ["open", "pathlib.Path"]


def test_models_are_plugged_in(spark):
    df = spark.createDataFrame([(1, "[1] a title\nbody"), (2, "")], "i int, prompt string")
    got = {r.i: r.a for r in df.select("i", judging.text_model(judging.extract_answer)("prompt").alias("a")).collect()}
    assert got == {1: "a title [1]", 2: T.REFUSAL_MARKER}
    score = judging.pair_scorer(lambda a, b: a.str.len() + b.str.len())
    assert [r.s for r in df.select(score("prompt", "prompt").alias("s")).collect()] == [32.0, 0.0]


def test_errors_name_file_and_line(spark, tmp_path):
    good = '{"query": "q%d", "tier": "good"}'
    first = [good % i for i in range(3000)]
    second = [good % i for i in range(3000, 6000)]
    second[1234] = '{"query": " ", "tier": "good"}'
    second[2500] = '{"query": "x", "tier": "unheard of"}'
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.jsonl").write_text("\n\n" + "\n".join(first) + "\n")
    (tmp_path / "t/b.jsonl").write_text("\n".join([*second[:100], "", "  ", *second[100:]]))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # files are read in parts
    tier = jsonl.TIERS[0]
    for name in ("a", "b"):
        path = tmp_path / f"t/{name}.jsonl"
        path.write_text(path.read_text().replace('"good"', f'"{tier}"'))
    try:
        with pytest.raises(jsonl.SourceError, match=r"b\.jsonl, line 1237 .*query is filled"):
            jsonl.human_scores(spark, str(tmp_path / "t"))
        rows = jsonl.read_lines(spark, str(tmp_path / "t"), jsonl.HUMAN_SCORE)
        assert rows.rdd.getNumPartitions() > 5
        numbered = jsonl.line_numbers(spark, str(tmp_path / "t"), rows).filter("file LIKE '%a.jsonl'").select("query", "line").collect()
        assert {r.query: r.line for r in numbered} == {f"q{i}": i + 3 for i in range(3000)}
        (tmp_path / "c.jsonl").write_text("\n".join([good.replace("good", tier) % 1, "", "{not json", good % 2]))
        with pytest.raises(jsonl.SourceError, match=r"c\.jsonl, line 3 .*valid JSON"):
            jsonl.human_scores(spark, str(tmp_path / "c.jsonl"))
        (tmp_path / "d.jsonl").write_text("\n".join(good.replace("good", tier) % i for i in (1, 2, 1)))
        with pytest.raises(jsonl.SourceError, match=r"d\.jsonl, line 3 .*more than once"):
            jsonl.human_scores(spark, str(tmp_path / "d.jsonl"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_one_of_several_writers_claims_a_version(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        held = list(pool.map(lambda i: runs.claim(spark, f"file://{tmp_path}/claims/v", f"writer {i}"), range(16)))
    assert len(set(held)) == 1

    def ingest(i):
        try:
            return runs.ingest(spark, spark.createDataFrame([("a", bytearray(b"%d" % i))], "path string, content binary"), "3.12", str(tmp_path / "root"))
        except runs.VersionConflict:
            return None

    with ThreadPoolExecutor(3) as pool:
        done = [x for x in pool.map(ingest, range(3)) if x]
    assert len(done) == 1 and done[0][1]
    kept = spark.read.json(f"{tmp_path}/root/manifest/*").collect()
    assert [r.sha_short for r in kept] == [done[0][0]]


def test_download_tries_again(tmp_path, monkeypatch):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(503 if len(asked) < 3 else 200)
            self.end_headers()
            if len(asked) >= 3:
                self.wfile.write(b"x" * 3_000_000)

        def log_message(self, *_):
            pass

    waits = []
    monkeypatch.setattr(runs.time, "sleep", waits.append)
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/archive"
    assert runs.download(url, str(tmp_path / "a")) == str(tmp_path / "a")
    assert (tmp_path / "a").stat().st_size == 3_000_000 and waits == [1, 2] and not (tmp_path / "a.part").exists()
    asked.clear()
    with pytest.raises(OSError):
        runs.download(url, str(tmp_path / "b"), retries=2)
    assert not (tmp_path / "b").exists()
    server.shutdown()
