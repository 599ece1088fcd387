import hashlib
import io
import zipfile

import pytest

from cinderbark.llm import archives as op

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    big = "<p>" + "x" * 1500
    table = [(1, "http://a/1", big), (2, "http://a/2", big), (7, None, big), (7, "http://a/7b", big), (3, "http://a/3", "small"), (4, "http://a/ 4\n", "small"), (5, "http://a/5", None), (6, "u", ""), (None, "n", big), (8, "http://ü/", "ü" * 600), (9, "x", "y" * 100_000)]
    return spark.createDataFrame(table, PAGES).selectExpr("*", "1 AS row_id", "2 AS payload"), table


def test_own_packages_are_zip_files_and_foreign_ones_can_be_read():
    data = op.write_package([("a/b.warc", b"hello" * 10), ("ü", b"")])
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and z.read("a/b.warc") == b"hello" * 10 and z.namelist() == ["a/b.warc", "ü"]
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as w:
        w.writestr("one", b"111")
        with w.open("two", "w", force_zip64=True) as f:
            f.write(b"22")
        w.writestr("packed", b"3" * 100, zipfile.ZIP_DEFLATED)
        w.comment = b"PK with a comment"
    for buffer, names in ((raw, ["one", "two", "packed"]), (io.BytesIO(data), ["a/b.warc", "ü"])):
        found = op.read_directory(buffer, len(buffer.getvalue()))
        assert [m.name for m in found] == names
    found = op.read_directory(raw, len(raw.getvalue()))
    assert op._at(raw, op.data_start(raw, found[1]), found[1].size) == b"22"
    with pytest.raises(ValueError):
        op.data_start(raw, found[2])
    with pytest.raises(ValueError):
        op.read_directory(io.BytesIO(b"nothing"), 7)


@pytest.mark.parametrize("package_bytes", [op.PACKAGE_BYTES, 2000])
def test_round_trip(spark, package_bytes):
    df, table = pages(spark)
    out = op.read(op.write(df, package_bytes=package_bytes), with_payload=True).collect()
    assert len(out) == len(table)
    payloads = sorted((str(i), hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in table)
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes) for r in out) == payloads
    responses = [r for r in out if r.record_type == "response"]
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest and r.refers_to is None for r in responses)
    big = [r for r in out if r.payload_bytes == 1503]
    assert sorted(str(r.page_id) for r in big if r.record_type == "response") == ["7"]
    assert {r.refers_to for r in big if r.record_type == "revisit"} == {7}
    assert all(r.record_type == "response" for r in out if r.payload_bytes < 1000)


def test_empty(spark):
    assert op.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_damage_is_seen():
    row = {"payload": b"abc", "record_type": "response", "key": "k", "url": None, "payload_digest": hashlib.sha1(b"abc").hexdigest(), "page_id": 1, "refers_to": None}
    raw = op.record(row)
    assert op.parse(raw)[1] == b"abc"
    with pytest.raises(ValueError):
        op.parse(raw.replace(b"abc", b"abd"))


def test_smallest_ids_and_references(spark):
    """The smallest long has no negative; revisits name the response's record and address."""
    big = "z" * 2000
    least = -(1 << 63)
    df = spark.createDataFrame([(least, "http://a/1", big), (least + 1, "http://a/2", big), ((1 << 63) - 1, "http://a/3", big * 2)], PAGES)
    out = sorted((r.page_id, r.record_type, r.refers_to) for r in op.round_trip(df).collect())
    assert out == [(least, "revisit", least + 1), (least + 1, "response", None), ((1 << 63) - 1, "response", None)]
    row = {"payload": b"abc", "record_type": "revisit", "key": "k", "url": "u", "payload_digest": "0", "page_id": 1, "refers_to": 2, "first_key": "first", "first_url": "http://a/ 2"}
    headers, _ = op.parse(op.record(row))
    first = op.parse(op.record(row | {"record_type": "response", "key": "first", "payload_digest": hashlib.sha1(b"abc").hexdigest()}))[0]
    assert headers["WARC-Refers-To"] == first["WARC-Record-ID"] and headers["WARC-Refers-To-Target-URI"] == "http://a/%202"


def test_schemes(tmp_path):
    system, path = op.open_system(f"file://{tmp_path}")
    assert path == str(tmp_path) and system.type_name == "local"
    with pytest.raises(ValueError, match="dbfs"):
        op.open_system("dbfs:/shared/x")
