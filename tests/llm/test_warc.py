import base64
import hashlib

import pytest

from llm.warc import parse, read_records, record, write_archives


def test_records():
    data = record(7, "http://a/ b\n", "é<p>".encode(), None, "2024-01-01T00:00:00Z")
    got = parse(data)
    assert (got["page_id"], got["url"], got["payload"], got["record_type"]) == (7, "http://a/%20b%0A", "é<p>".encode(), "response")
    got = parse(record(None, None, b"x", 3, "d"))
    assert (got["page_id"], got["url"], got["payload"], got["payload_bytes"], got["refers_to"]) == (None, None, None, 1, 3)
    import zlib

    broken = zlib.decompress(data, 31).replace(b"<p>", b"<q>")
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    with pytest.raises(ValueError):
        parse(press.compress(broken) + press.flush())


def test_round_trip(spark, tmp_path):
    rows = [(k, f"http://h{k % 3}.example/{k}", f"<p>{k % 40}</p>" * (k % 7)) for k in range(150)] + [(500, None, None), (501, "u", ""), (502, "v", "z" * 3_000_000), (None, "w", "odd")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for least in (0, 20):
        index = write_archives(df, least_bytes=least)
        got = sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_records(index, False).collect())
        last = {}
        for i, _, html in rows:
            last[html or ""] = max(last.get(html or "", -1), -1 if i is None else i)
        want = []
        for i, _, html in rows:
            data, i = (html or "").encode(), -1 if i is None else i
            again = len(data) >= least and last[html or ""] != i
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", last[html or ""] if again else None))
        assert got == sorted(want, key=lambda x: x[0])
    full = {r.page_id: r for r in read_records(index.filter("page_id in (3, 502)")).collect()}
    assert bytes(full[502].payload) == b"z" * 3_000_000 and bytes(full[3].payload) == b"<p>3</p>" * 3 and full[3].url == "http://h0.example/3"
    assert read_records(write_archives(df.limit(0))).count() == 0
