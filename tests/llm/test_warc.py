"""The WARC source and sink: ranges, foreign members, revisits, and failed tasks."""

import collections
import gzip
import hashlib
import io
import os
import random
import zlib
from base64 import b32encode

import pytest

from kinelattice.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, digest string, id long, keep string"


def plain(kind, name, block, extra=()):
    return warc.record([("WARC-Type", kind), ("WARC-Record-ID", name), *extra], block)


def archive(rng):
    """Records of many sizes with other gzip members, stray magic and stored (incompressible) blocks between them."""
    data, want = b"", []
    for k in range(60):
        size = rng.choice([0, 1, 50, 3000, 70000])
        block = rng.randbytes(size) if k % 3 else b"text " * (size // 5)
        if k % 4 == 1:
            block = warc.MAGIC * 9 + block
        member = plain("resource", f"<urn:x:{k}>", block)
        want.append((len(data), f"<urn:x:{k}>", block))
        data += member
        if k % 5 == 0:
            data += gzip.compress(b"some other member" * 40)
        if k % 7 == 0:
            data += plain("resource", "<urn:x:bad>", b"cut off")[:-9]  # a member that doesn't decode to its end
    return data, want


@pytest.mark.parametrize("split", [1, 17, 1000, 4096, 100000, 1 << 30])
def test_each_record_has_one_owner(split):
    data, want = archive(random.Random(4))
    got = []
    step = split if split > 100 else 200  # many ranges, some without a record
    starts = range(0, len(data), step) if split != 1 else [0, 1, 2, 3, *range(4, len(data), 997)]
    for a, b in zip(starts, [*list(starts)[1:], len(data)]):
        got += [(at, f["WARC-Record-ID"], block) for at, _, f, block in warc.scan(io.BytesIO(data), len(data), a, b)]
    assert got == want


def test_files_of_others(spark, tmp_path):
    data, want = archive(random.Random(9))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.warc.gz").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"")
    (tmp_path / "note.txt").write_bytes(data)
    for where in (str(tmp_path), f"file://{tmp_path}"):
        rows = warc.read_warc(spark, where, 3000).collect()
        assert sorted((r["offset"], r["headers"]["WARC-Record-ID"], bytes(r["payload"])) for r in rows) == want
        assert all(r["http"] is None and r["path"].endswith("a.warc.gz") for r in rows)
    with pytest.raises(Exception, match="no archives"):
        warc.read_warc(spark, f"{tmp_path}/absent", 3000).count()


def brute(rows, least=1000):
    body = [(i, (h or "").encode()) for i, h in rows]
    keep = {}
    for i, b in body:
        if len(b) >= least:
            keep[b] = max((x for x in (keep.get(b), i) if x is not None), default=None)
    out, done = collections.Counter(), set()
    for i, b in body:
        first = len(b) < least or (i == keep[b] and b not in done)
        if first and len(b) >= least:
            done.add(b)
        out[(i, len(b), hashlib.sha1(b).hexdigest(), "response" if first else "revisit", None if first else keep[b])] += 1
    return out


def pages(rng):
    long = [("é<p>" * 400), "a" * 1000, "b" * 999, "c" * 1001]
    rows = [(k, rng.choice([*long, f"own {k}" * 200, "short", "", None])) for k in range(120)]
    rows += [(500, long[0]), (500, long[0]), (500, long[1]), (501, long[3]), (None, long[1]), (None, "n" * 2000), (None, "n" * 2000), (None, None), (7, "again " * 300), (7, "again " * 300)]
    rows += [(900, "w " * 600000)]
    return rows


def frame(spark, rows):
    url = lambda k: None if k % 9 == 0 else f"http://x/{k} y\r\nEvil: 1"
    return spark.createDataFrame([(i, url(k), h, "p", "d", 1, "k") for k, (i, h) in enumerate(rows)], SCHEMA).repartition(4)


def test_pages(spark, tmp_path):
    rows = pages(random.Random(1))
    path = str(tmp_path / "out")
    warc.write_warc(frame(spark, rows), path)
    records = warc.read_warc(spark, path, 2000)
    got = collections.Counter(tuple(r) for r in warc.pages_of(records).collect())
    assert got == brute(rows)
    kept = records.collect()
    names = [r["headers"]["WARC-Record-ID"] for r in kept]
    assert len(set(names)) == len(names)
    responses = {r["headers"]["WARC-Record-ID"]: bytes(r["payload"]) for r in kept if r["headers"]["WARC-Type"] == "response"}
    for r in kept:
        assert "Evil" not in r["headers"] and "Evil" not in r["http"]
        if r["headers"]["WARC-Type"] == "revisit":
            assert r["payload"] == b"" and len(responses[r["headers"]["WARC-Refers-To"]]) == int(r["http"]["Content-Length"])
            assert r["headers"]["WARC-Payload-Digest"] == "sha1:" + b32encode(hashlib.sha1(responses[r["headers"]["WARC-Refers-To"]]).digest()).decode()
    files = [f for f in os.listdir(path) if f.endswith(".warc.gz")]
    assert files and not os.path.exists(f"{path}/_temporary")
    for f in files:  # one member per record, and a plain gzip reader takes the whole file
        assert gzip.decompress(open(f"{path}/{f}", "rb").read()).count(b"WARC/1.1\r\n") >= 1


def test_hot_payload_and_empty_table(spark, tmp_path):
    rows = [(k, "hot " * 300) for k in range(200)] + [(1000 + k, f"{k} " * 400) for k in range(20)]
    warc.write_warc(frame(spark, rows), str(tmp_path / "hot"))
    assert collections.Counter(tuple(r) for r in warc.pages_of(warc.read_warc(spark, str(tmp_path / "hot"))).collect()) == brute(rows)
    warc.write_warc(frame(spark, rows).limit(0), str(tmp_path / "none"))
    assert warc.pages_of(warc.read_warc(spark, str(tmp_path / "none"))).count() == 0


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.dataSource.register(warc.WarcDataSource)
    bad = spark.range(0, 40, 1, 4).selectExpr("case when id = 35 then cast(raise_error('stop') as binary) else cast(cast(id as string) as binary) end as member")
    with pytest.raises(Exception, match="stop"):
        bad.write.format("warc").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_damaged_payloads_are_reported(spark, tmp_path):
    path = tmp_path / "out"
    warc.write_warc(frame(spark, [(1, "x" * 50)]), str(path))
    (name,) = [p for p in path.iterdir() if p.name.endswith(".warc.gz")]
    raw = gzip.decompress(name.read_bytes()).replace(b"x" * 50, b"y" * 50)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    name.write_bytes(packer.compress(raw) + packer.flush())
    with pytest.raises(Exception, match="differs from its digest"):
        warc.pages_of(warc.read_warc(spark, str(path))).collect()
