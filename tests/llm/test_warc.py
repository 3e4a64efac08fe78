"""Archives written and read back in ranges of every size, against a plain reading from the start."""

import base64
import gzip
import hashlib
import random
import zlib

import pytest

from callbrook.llm import warc

SCHEMA = "page_id long, url string, html string, headers string, file string, payload string, row string, same string, first string, type string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, *["x"] * 7) for i, u, h in rows], SCHEMA)


def fixture():
    r = random.Random(2)
    words = ["alpha", "<p>", "beta é", "\r\n\r\n", "WARC/1.1", "日本", "😀"]
    rows = [(k, f"http://h{k % 7}.example/é?q={k}", "".join(r.choice(words) for _ in range(r.choice((1, 5, 60, 900))))) for k in range(60)]
    rows += [(k, "http://x/", "copies of one page " * 9) for k in range(100, 160)]
    return rows + [(200, None, None), (201, "http://b/", ""), (None, "http://c/\r\nWARC-Type: x", "no id"), (None, "http://c/", "no id"), (202, " ", "same"),
                   (202, " ", "same"), (203, "http://long/", "long " * 400000)]


def want(rows, least=0):
    out, groups = [], {}
    for i, _, h in rows:
        groups.setdefault((h or "").encode(), []).append(i)
    for body, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        for k, i in enumerate(ids):
            again = k > 0 and len(body) >= least
            out.append((i, len(body), digest, "revisit" if again else "response", ids[0] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, tmp_path, least):
    rows, path = fixture(), f"file://{tmp_path}/w"
    warc.write_archives(pages(spark, rows), path, least)
    for split in (64 << 20, 997):  # ranges smaller than a record too
        records = warc.read_archives(spark, path, split)
        assert got(warc.pages_of(records)) == want(rows, least), split
        assert warc.untiled(records, path).count() == 0
    texts = {h or "" for _, _, h in rows}
    assert {r.payload.decode() for r in records.filter("headers['warc-type'] = 'response'").collect()} == texts
    ids = {r.i for r in records.selectExpr("headers['warc-record-id'] as i").collect()}
    refers = records.filter("headers['warc-type'] = 'revisit'").selectExpr("headers['warc-refers-to'] as i").collect()
    assert len(ids) == len(rows) and {r.i for r in refers} <= ids and len(refers) > 55
    assert any((r.u or "").endswith("%0D%0AWARC-Type:%20x") for r in records.selectExpr("headers['warc-target-uri'] as u").collect())


def raw_record(k, body):
    return gzip.compress(warc.record_bytes({"type": "response", "record_id": f"<urn:{k}>", "uri": "http://a/", "page_id": str(k), "digest": "-",
                                            "payload": body, "payload_bytes": len(body)}, "2020-01-01T00:00:00Z"), mtime=0)


def read(data, split):
    import io
    size = len(data)
    return [r for start in range(0, size, split) for r in warc.Ranged(io.BytesIO(data), size).records(start, min(size, start + split))]


def test_false_magic_and_archives_inside_payloads(monkeypatch):
    monkeypatch.setattr(warc, "READ", 50)
    inner = raw_record(900, b"inside") + raw_record(901, b"inside too")
    stored = zlib.compressobj(0, zlib.DEFLATED, 31)  # an incompressible payload keeps its bytes
    outer = stored.compress(warc.record_bytes({"type": "response", "record_id": "<urn:1>", "uri": "u", "page_id": "1", "digest": "-", "payload": raw_record(900, b"inside") + b"end" + b"\x1f\x8b\x08" * 9,
                                               "payload_bytes": 0}, "d")) + stored.flush()
    data = raw_record(0, b"first") + outer + raw_record(2, b"second " * 30) + b"".join(raw_record(k, b"x" * k) for k in range(3, 30))
    for split in (10 ** 9, 300, 77, 13, 1):
        found = read(data, split)
        assert [r[3]["warc-page-id"] for r in found] == [str(k) for k in range(30)], split
        assert sum(r[1] for r in found) == len(data)
    assert len(read(inner, 5)) == 2


def test_damage_is_passed_over():
    whole = [raw_record(k, b"body %d " % k * 20) for k in range(12)]
    whole[4] = whole[4][:40] + b"\0\0\0" + whole[4][43:]
    whole[11] = whole[11][:-9]  # cut off
    for split in (10 ** 9, 200, 50):
        assert [r[3]["warc-page-id"] for r in read(b"".join(whole), split)] == [str(k) for k in range(11) if k != 4]


def test_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    assert warc.read_archives(spark, path).collect() == []
    warc.write_archives(pages(spark, []), path)
    assert warc.read_archives(spark, path).collect() == []
