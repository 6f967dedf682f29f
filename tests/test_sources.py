"""Chat exports and uploaded records."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from caseloom.operators import calibration
from caseloom.sources import chat, labels, objects

CHAT = """Exported on request
3/9/2031, 7:41 - Boiler group was created
3/9/2031, 7:42 - Ottoline: valve: stuck again
since last night
and still dripping

[28/11/2031, 11:09:02 PM] +44 20: plan-7.png (file attached)
cellar, north wall
[28/11/2031, 11:10:40 PM] +44 20: <Media omitted>
30/11/2031, 00:15 - Ottoline: <attached: drip.opus>
30/11/2031, 00:16 - no colon here"""


def test_chat_lines(spark):
    df = spark.createDataFrame([(1, CHAT), (2, None), (3, ""), (4, "no header")], "id long, text string")
    got = chat.parse_lines(df, "id", "text").orderBy("line_no").collect()
    assert [(r.line_no, r.sender, r.body) for r in got] == [(3, "Ottoline", "valve: stuck again\nsince last night\nand still dripping"), (7, "+44 20", "plan-7.png (file attached)\ncellar, north wall"), (9, "+44 20", "<Media omitted>"), (10, "Ottoline", "<attached: drip.opus>")]
    stamped = {r.line_no: str(r.sent_at) for r in chat.parsed_stamps(chat.parse_lines(df, "id", "text"), "id").collect()}
    assert stamped == {3: "2031-09-03 07:42:00", 7: "2031-11-28 23:09:02", 9: "2031-11-28 23:10:40", 10: "2031-11-30 00:15:00"}
    files = spark.createDataFrame([("drip.opus",)], "filename string")
    att = {r.line_no: (r.attachment, r.body) for r in chat.with_attachment(chat.parse_lines(df, "id", "text"), files).collect()}
    assert att[3][0] is None and tuple(att[7][0]) == ("plan-7.png", "image/png", True) and att[7][1] == "cellar, north wall"
    assert tuple(att[9][0]) == ("<omitted>", "application/octet-stream", True) and tuple(att[10][0]) == ("drip.opus", "audio/ogg", False)


def test_a_long_chat_takes_time_in_proportion(spark):
    lines = [f"4/5/2030, 9:{i % 60:02} - K{i % 7}: m{i}" if i % 50 == 0 else f"more {i}" for i in range(20_000)]
    got = chat.parse_lines(spark.createDataFrame([(1, "\n".join(lines))], "id long, text string"), "id", "text")
    assert got.agg(F.count("*"), F.sum(F.size(F.split("body", "\n")))).first() == (400, 20_000)


def test_month_first_file(spark):
    df = spark.createDataFrame([(1, "11/22/30, 6:31 AM - Q: left\n4/5/30, 9:00 PM - Q: back")], "id long, text string")
    assert [str(r.sent_at) for r in chat.parsed_stamps(chat.parse_lines(df, "id", "text"), "id").orderBy("line_no").collect()] == ["2030-11-22 06:31:00", "2030-04-05 21:00:00"]


def test_zip(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("x/_chat.txt", CHAT)
        z.writestr("other/plan-7.png", "12345")
        z.writestr("x/plan-7.png", "1")
    (tmp_path / "a.zip").write_bytes(b.getvalue())
    (tmp_path / "b.zip").write_bytes(b"no zip")
    got = sorted(chat.unzip(spark, str(tmp_path)).collect(), key=lambda r: r.path)
    assert got[0].transcript == CHAT and [tuple(f) for f in got[0].files] == [("plan-7.png", 1, b"1")] and got[1].transcript is None


def records(df):
    return sorted(json.dumps(r.attributes, sort_keys=True) for r in df.collect())


def test_objects(spark, tmp_path):
    rows = [{"id": "1", "name": "a"}, {"id": "2", "name": ""}]
    want = sorted(json.dumps(r, sort_keys=True) for r in rows)
    files = {
        "a.csv": "﻿id,name\n 1 , a \n2,\n,\n", "b.json": json.dumps(rows), "c.json": json.dumps({"data": rows}), "d.jsonl": "\n".join(map(json.dumps, rows)), "e": json.dumps(rows), "f": "\n".join(map(json.dumps, rows)), "g": "id,name\n1,a\n2,\n",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content, encoding="utf-8")
        assert records(objects.read_objects(spark, str(tmp_path / name))) == want, name
    (tmp_path / "one.json").write_text('{"id": "7"}')
    assert records(objects.read_objects(spark, str(tmp_path / "one.json"))) == ['{"id": "7"}']
    (tmp_path / "bad.jsonl").write_text('{"id": "7"}\n{broken')
    with pytest.raises(Exception, match="no JSON object"):
        objects.read_objects(spark, str(tmp_path / "bad.jsonl")).collect()
    assert [(r.line_no, r.line) for r in objects.bad_lines(spark, str(tmp_path / "bad.jsonl")).collect()] == [(2, "{broken")]
    with pytest.raises(ValueError, match="no records"):
        objects.read_objects(spark, str(tmp_path / "sheet.xlsx"))


def test_gold_and_predictions(spark, tmp_path):
    (tmp_path / "gold.csv").write_text("id,gold_a,gold_b\n1, x ,\n2,y,z\n3,y,q\n")
    (tmp_path / "pred.jsonl").write_text('{"id": "1", "governed": {"a": "x"}, "facts": ["f"]}\n{"id": "2", "governed": {}}\n')
    x = labels.judged(labels.read_gold(spark, str(tmp_path / "gold.csv"), {"a": "gold_a", "b": "gold_b"}), labels.read_predictions(spark, str(tmp_path / "pred.jsonl")))
    got = sorted(((r.id, r.field), r.gold, r.predicted, r.status) for r in x.collect())
    assert got == [(("1", "a"), "x", "x", "read"), (("1", "b"), None, None, "read"), (("2", "a"), "y", None, "failed"), (("2", "b"), "z", None, "failed"), (("3", "a"), "y", None, "missing"), (("3", "b"), "q", None, "missing")]


def test_a_lost_calibration_is_never_certain(spark, tmp_path):
    good = {"tau": 0.9, "fields": {"a": {"default": 0.5, "reliability": {"x": 0.75}}}}
    (tmp_path / "c.json").write_text(json.dumps(good, indent=1))
    cells, defaults, tau = calibration.load_artifact(spark, str(tmp_path / "c.json"))
    assert tau == 0.9 and [tuple(r) for r in cells.collect()] == [("a", "x", 0.75)] and [tuple(r) for r in defaults.collect()] == [("a", 0.5)]
    (tmp_path / "broken.json").write_text("{")
    for name in ("absent.json", "broken.json"):
        cells, defaults, tau = calibration.load_artifact(spark, str(tmp_path / name))
        assert tau > 1 and cells.count() == 0 and defaults.count() == 0
    one = spark.range(1).select(*[calibration.confidence(F.lit("x"), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(1.0), fitted).alias(n) for n, fitted in (("lost", False), ("other", True))]).first()
    assert (one.lost, one.other) == (0.4, 1.0)


def test_webhook_files_and_generator(spark, tmp_path):
    payload = json.dumps({"entry": [{"changes": [{"value": {"messages": [{"from": "1", "type": "text", "text": {"body": "hi"}}, {"from": "2", "type": "image"}]}}]}]})
    df = spark.createDataFrame([(payload,), ("{}",), (None,), ("broken",)], "p string")
    assert [tuple(r) for r in objects.webhook_messages(df, "p").collect()] == [("1", "hi")]
    (tmp_path / "n.txt").write_text("hello")
    (tmp_path / "n.pdf").write_bytes(b"%PDF")
    assert sorted((r.mime, r.text) for r in objects.read_files(spark, str(tmp_path)).collect() if r.mime == "text/plain") == [("text/plain", "hello")]
    a = objects.synthetic_orders(spark, 2000)
    assert a.exceptAll(objects.synthetic_orders(spark, 2000)).count() == 0
    assert 0.14 < a.where("shared").count() / 2000 < 0.22 and objects.synthetic_orders(spark, 0).count() == 0
    assert a.select(F.count_distinct("order_id")).first()[0] == 2000


def test_multipart(spark, tmp_path):
    body = b"--edge\r\nContent-Disposition: form-data; name=\"text\"\r\n\r\nthe tap drips\r\n--edge\r\nContent-Disposition: form-data; name=\"file\"; filename=\"tap.png\"\r\nContent-Type: image/png\r\n\r\n\x89PNG\x00\r\n--edge--\r\n"
    df = spark.createDataFrame([(1, "multipart/form-data; boundary=edge", bytearray(body)), (2, "text/plain", bytearray(b"x")), (3, None, None)], "id long, content_type string, body binary")
    got = [(r.id, r.name, r.filename, r.mime, bytes(r.content)) for r in objects.multipart(df, "id", "content_type", "body").collect()]
    assert got == [(1, "text", None, "text/plain", b"the tap drips"), (1, "file", "tap.png", "image/png", b"\x89PNG\x00")]
