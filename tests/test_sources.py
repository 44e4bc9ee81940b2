import concurrent.futures
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from dossia.functions.answers import answer_schema, extraction, prompt
from dossia.operators import linking, metrics
from dossia.sources import engines, fill, generate, labels, store
from dossia.streaming import runs


def test_items_and_records(spark, tmp_path):
    item = {"id": "a", "vehicle_id": "v", "doc_type": "pts", "split": "test", "image": "i", "photo": "p", "width": 1, "height": 2, "fields": {"vin": "Я"}, "boxes": {"vin": [1, 2, 3, 4]}}
    (tmp_path / "l.jsonl").write_text(json.dumps(item, ensure_ascii=False) + "\n" + json.dumps(item | {"id": "b", "split": "dev"}) + "\n", encoding="utf-8")
    assert labels.read_items(spark, str(tmp_path / "l.jsonl"), "test").count() == 1
    items = labels.read_items(spark, str(tmp_path / "l.jsonl"), "all")
    assert items.count() == 2
    labels.write_jsonl(items, str(tmp_path / "out"))
    assert any("Я" in f.read_text(encoding="utf-8") for f in (tmp_path / "out").glob("*.json"))
    assert labels.read_records(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    with pytest.raises(Exception):
        labels.read_items(spark, str(tmp_path / "bad.jsonl")).collect()
    got = {(r.id, tuple(r.bbox), r.area, r.value) for r in labels.annotations(items, spark).collect()}
    assert got == {(1, (1, 2, 2, 2), 4, "Я"), (2, (1, 2, 2, 2), 4, "Я")}
    labels.write_coco(items, str(tmp_path / "coco"))
    assert spark.read.json(str(tmp_path / "coco/categories")).count() == 29


def test_answers(spark):
    rows = [("a", '{"doc_type": "pts", "fields": {"vin": "xta211700k1234567", "zzz": "1", "year": null}}'), ("b", "<think>{</think>```json\n{\"plate\": \"a123bc164\"}\n``` ok"), ("c", "no"), ("d", None), ("e", "[1]")]
    got = {r.id: r for r in extraction(spark.createDataFrame(rows, "id string, answer string")).collect()}
    assert got["a"].doc_type == "pts" and got["a"].fields == {"vin": "XTA211700K1234567"}
    assert got["b"].doc_type == "sts_front" and got["b"].fields == {"plate": "А123ВС164"}
    assert all(got[k].error and got[k].fields == {} for k in "cde")
    assert "vin" in prompt() and answer_schema()["required"] == ["doc_type", "fields"]


def test_generated_documents_make_one_card_each(spark):
    cars = generate.vehicles(spark, 12, seed=3)
    docs = generate.documents(cars)
    assert docs.count() == 36 and generate.vehicles(spark, 12, seed=3).exceptAll(cars).count() == 0
    assert docs.groupBy("vehicle_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    rows = docs.withColumn("seq", F.monotonically_increasing_id()).select("seq", "vehicle_id", *linking.card_values(F.col("doc_type"), F.col("fields")))
    cards = linking.folded_cards(linking.link_documents(rows.drop("vehicle_id")))
    assert sorted(r.doc_count for r in cards.collect()) == [3] * 12


def test_engine_and_scores(spark):
    docs = spark.createDataFrame([("a", b"1"), ("b", b"bad")], "id string, content binary")

    def engine():
        def ask(content):
            if content == b"bad":
                raise ValueError("unreadable")
            return '{"plate": "a123bc164"}'

        return ask

    got = {r.id: r for r in labels.extract_with(docs, engine).collect()}
    assert got["a"].answer and got["a"].error is None and got["b"].error == "ValueError: unreadable"
    truth = spark.createDataFrame([("a", "pts", {"vin": "X", "year": "2015"}), ("z", "pts", {})], "id string, doc_type string, fields map<string,string>")
    records = spark.createDataFrame(
        [("a", "clean", "pts", {"vin": "x", "year": "2015 г."}, 1.0, None), ("a", "blur:4", None, {}, None, "e"), ("q", "clean", "pts", {}, 1.0, None), ("z", "clean", "pts", {}, 3.0, "")],
        "id string, variant string, pred_doc_type string, fields map<string,string>, seconds double, error string",
    )
    fields = metrics.scored_fields(records, truth)
    score = {r.variant: r for r in metrics.score(fields).collect()}
    assert (score["clean"].documents, score["clean"].fields, score["clean"].field_accuracy, score["clean"].document_accuracy, score["clean"].median_seconds) == (2, 2, 1, 1, 2)
    assert (score["blur:4"].field_accuracy, score["blur:4"].doc_type_accuracy, score["blur:4"].errors, score["blur:4"].mean_cer) == (0, 0, 1, 1)
    assert {(r.level, r.accuracy) for r in metrics.robustness(fields).collect()} == {(0, 1.0), (4, 0.0)}
    print_of = metrics.fingerprint(truth, "id", F.col("doc_type"))
    assert metrics.check_fingerprint(print_of, print_of)
    with pytest.raises(metrics.DataMismatch):
        metrics.check_fingerprint(print_of, metrics.fingerprint(truth.limit(1), "id", F.col("doc_type")))


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text(json.dumps({"id": str(n), "answer": '{"plate": "a123bc164"}'}) + "\n")
        runs.extract_stream(spark, str(src), str(out), str(tmp_path / "c1")).awaitTermination(60)
        assert spark.read.parquet(str(out)).count() == n + 1
    docs = tmp_path / "docs"
    schema = "seq long, vin string, sts_number string, pts_number string"
    for n, rows in enumerate([[(1, "A", None, None), (2, "B", None, None)], [(3, "A", "1", None), (4, "B", "1", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(docs))
        stream = spark.readStream.schema(schema).parquet(str(docs))
        runs.link_stream(stream, str(tmp_path / "cards"), str(tmp_path / "c2")).awaitTermination(120)
        got = {r.component for r in store.read_table(spark, str(tmp_path / "cards"), "members").collect()}
        assert got == ({1, 2} if n == 0 else {1})


def record(n, variant, year):
    return json.dumps({"id": n, "variant": variant, "doc_type": "pts", "pred_doc_type": "pts", "fields": {"year": year}, "seconds": 1.0})


def test_the_last_record_in_the_files_wins(spark, tmp_path):
    """Several files and splits of a few hundred bytes: order is that of the files' lines, not of tasks."""
    path = tmp_path / "r"
    path.mkdir()
    for f in range(3):
        rows = [record(f"d{n % 7}", "clean", str(1000 * f + n)) + ("\n\n" if n % 5 == 0 else "\n") for n in range(60)]
        (path / f"part-{f}.json").write_text("".join(rows), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        records = labels.read_records(spark, str(path))
        assert records.count() == 180 and records.rdd.getNumPartitions() > 3
        last = {r.id: r.fields["year"] for r in metrics.latest(records.repartition(5), "seq").collect()}
        want = {f"d{n % 7}": str(2000 + n) for n in range(60)}
        assert last == want
        order = [r.fields["year"] for r in records.repartition(9).orderBy("seq").collect()]
        assert order == [str(1000 * f + n) for f in range(3) for n in range(60)]
        truth = spark.createDataFrame([(i, "pts", {"year": y}) for i, y in want.items()], "id string, doc_type string, fields map<string,string>")
        stress = records.withColumn("variant", F.lit("blur:1"))
        assert {(r.level, r.accuracy) for r in metrics.robustness(metrics.scored_fields(stress, truth)).collect()} == {(1, 1.0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_appended_records_come_last(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in range(12):
        rows = spark.createDataFrame([(f"d{k}", "clean", {"year": str(100 * n + k)}) for k in range(n % 3, 6)], "id string, variant string, fields map<string,string>")
        labels.write_jsonl(rows.repartition(3), path, append=True)
    records = labels.read_records(spark, path)
    assert records.count() == 60
    got = {r.id: r.fields["year"] for r in metrics.latest(records, "seq").collect()}
    assert got == {"d0": "900", "d1": "1001", **{f"d{k}": str(1100 + k) for k in range(2, 6)}}
    with pytest.raises(Exception, match="EXISTS"):
        labels.write_jsonl(rows, path)


def test_strict_items(spark, tmp_path):
    item = {"id": "a", "vehicle_id": "v", "doc_type": "pts", "split": "test", "image": "i", "photo": "p", "width": 1, "height": 2, "fields": {}, "boxes": {}}
    good, path = json.dumps(item), tmp_path / "i.jsonl"
    path.write_text(good + "\n\n" + good + "\n")
    assert labels.audit_items(spark, str(path)).collect() == [] and labels.read_items(spark, str(path), strict=True).count() == 2
    lacking = json.dumps({k: v for k, v in item.items() if k != "boxes"})
    path.write_text("\n".join([good, json.dumps(item | {"more": 1}), lacking, good[:-1] + ', "id": "b"}', "[1]", "{broken"]) + "\n")
    got = [(r.problem, r.key) for r in labels.audit_items(spark, str(path)).orderBy("seq", "problem").collect()]
    assert got == [("unknown", "more"), ("missing", "boxes"), ("repeated", "id"), ("json", None), ("json", None)]
    with pytest.raises(labels.StrictSchema, match="unknown more"):
        labels.read_items(spark, str(path), strict=True)


def test_coco_in_one_object(spark, tmp_path):
    rows = [("b", {"vin": "X"}, {"vin": [1, 2, 4, 6]}), ("a", {}, {"vin": [0, 0, 2, 2], "color": [1, 1, 2, 3]}), ("c", {}, {})]
    items = spark.createDataFrame([(i, f"{i}.jpg", 5, 6, "pts", "dev", f, b) for i, f, b in rows], "id string, image string, width int, height int, doc_type string, split string, fields map<string,string>, boxes map<string,array<int>>")
    labels.write_coco(items, str(tmp_path / "c"), "things", "2.0")
    whole = json.loads(labels.coco_json(str(tmp_path / "c"), spark))
    assert whole["info"] == {"description": "things", "version": "2.0"} and [i["file_name"] for i in whole["images"]] == ["a.jpg", "b.jpg", "c.jpg"]
    assert [(a["id"], a["image_id"], a["bbox"], a["iscrowd"], a["attributes"]["value"]) for a in whole["annotations"]] == [(1, 1, [1, 1, 1, 2], 0, ""), (2, 1, [0, 0, 2, 2], 0, ""), (3, 2, [1, 2, 3, 4], 0, "X")]
    assert {c["supercategory"] for c in whole["categories"]} == {"field"}


class Service(http.server.BaseHTTPRequestHandler):
    """Lists two models; refuses schemas; is busy every other time; breaks on the content ``bad``."""

    busy = {"n": 0}

    def log_message(self, *_):
        pass

    def answer(self, code, body, **headers):
        self.send_response(code)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        self.answer(200, {"data": [{"id": "maker/Model-7b"}, {"id": "other"}]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.busy["n"] += 1
        image = body["messages"][0]["content"][1]["image_url"]["url"]
        if self.busy["n"] % 2:
            self.answer(429, {}, Retry_After="0")
        elif "response_format" in body:
            self.answer(400, {})
        elif image.endswith("YmFk"):
            self.answer(500, {})
        else:
            self.answer(200, {"choices": [{"message": {"content": body["model"]}}]})


@pytest.fixture
def service():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_engine_behind_a_service(spark, service):
    engine = engines.get_engine("vlm", url=service, model="model7b", prompt="read", schema={"type": "object"}, wait=0.01)
    assert engine.available() == (True, "")
    docs = spark.createDataFrame([("a", b"good"), ("b", b"bad"), ("c", b"good")], "id string, content binary").coalesce(1)
    got = {r.id: r for r in labels.extract_with(docs, engine.open).collect()}
    assert got["a"].answer == got["c"].answer == "maker/Model-7b" and "HTTPError" in got["b"].error
    silent = engines.http_engine("http://127.0.0.1:9", "m", wait=0.01, tries=2, timeout=1)
    lost = engines.http_engine(service, "nothing like it")
    told = {r.engine: (r.ok, r.reason) for r in engines.doctor(spark, [engine, silent, lost], probes=2).where("probe = 1").collect()}
    assert told["vlm:model7b"] == (True, "") and not told["vlm:m"][0] and told["vlm:nothing like it"][1].startswith("no model")
    assert "ConnectionError" in labels.extract_with(docs.limit(1), silent.open).first().error
    with pytest.raises(ValueError):
        engines.get_engine("none such")
    assert engines.resolve_model("m", []) == ("m", "") and engines.resolve_model("a", ["xa", "ya"])[0] is None


def test_filling_a_store(spark, tmp_path):
    items = spark.createDataFrame([(f"i{n}", f"v{n // 2}", "pts", {"vin": f"XTA211290B{n // 2:07d}"}) for n in range(8)], "id string, vehicle_id string, doc_type string, fields map<string,string>")
    assert fill.choose_documents(spark, items, least=4).count() == 8
    assert fill.choose_documents(spark, items, least=5).where("id like 'i%'").count() == 0
    assert fill.choose_documents(spark).count() == 3 * fill.GENERATED_VEHICLES
    records = spark.createDataFrame([("i0", "clean", "", {"vin": "XTA211290B0000000"}), ("i1", "clean", "epts", {"vin": "XTA211290B0000000"}), ("i2", "photo", "pts", {})], "id string, variant string, pred_doc_type string, fields map<string,string>").coalesce(1)
    docs = fill.choose_documents(spark, items, records)
    assert {(r.id, r.doc_type) for r in docs.collect()} == {("i0", "pts"), ("i1", "epts")}
    assert fill.fill_store(spark, str(tmp_path / "s"), fill.choose_documents(spark, items, least=4)) == 8
    assert store.read_table(spark, str(tmp_path / "s"), "cards").count() == 4


def test_a_mark_is_written_once(spark, tmp_path):
    path = str(tmp_path / "results" / "meta.json")
    with concurrent.futures.ThreadPoolExecutor(8) as pool:
        tried = [pool.submit(fill.stamp, spark, path, f"f{n % 2}") for n in range(8)]
    errors = [e for t in tried if (e := t.exception()) is not None]
    held = {t.result() for t in tried if t.exception() is None}
    assert len(held) == 1 and len(errors) == 4 and all(isinstance(e, metrics.DataMismatch) or "Unexpected" in str(e) or "Expecting" in str(e) for e in errors)
    assert fill.stamp(spark, path, held.pop())
