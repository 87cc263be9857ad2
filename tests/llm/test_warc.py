"""Archives that are damaged, and pages whose own headers look like ours."""

import gzip

import numpy as np

from quarry.llm import warc

LINE = warc.ARC_FIELDS[1]


def arc(*records):
    about = f"1 0 t\n{LINE}\n"
    out = f"filedesc://x 0.0.0.0 20200101000000 text/plain {len(about)}\n{about}\n".encode()
    for url, body in records:
        out += f"{url} 192.0.2.1 20200102030405 text/html {len(body)}\n".encode() + body + b"\n"
    return out


def test_bad_records_are_rows(spark, tmp_path):
    http = lambda x: b"HTTP/1.1 200 OK\r\nX-Key: abc\r\n\r\n" + x
    good = arc(("http://a/", http(b"one")), ("http://b/", http(b"two")))
    files = {"good": good, "cut": good[:-4], "head": good + b"only three fields\n", "length": good + b"http://c/ 1.2.3.4 2020 text/html many\nx\n", "zip": gzip.compress(good)[:-9], "empty": b""}
    for name, data in files.items():
        (tmp_path / f"{name}.arc").write_bytes(data)
    records = warc.read_arc(spark, f"file://{tmp_path}")
    rows = records.collect()
    by = {n: sorted(r.kind for r in rows if r.archive.endswith(f"/{n}.arc")) for n in files}
    assert by["good"] == ["response", "response", "warcinfo"] and by["empty"] == []
    assert by["cut"] == ["bad", "response", "warcinfo"] and by["head"] == by["length"] == ["bad", "response", "response", "warcinfo"] and "bad" in by["zip"]
    assert all(r.key is None and bytes(r.payload) in (b"one", b"two") for r in rows if r.kind == "response")
    warc.write_warc(records, f"file://{tmp_path}/out")
    back = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert len(back) == sum(r.kind != "bad" for r in rows) and all(r.intact for r in back)


def test_damaged_warc_and_digests(spark, tmp_path):
    block = b"HTTP/1.1 200 OK\r\n\r\nabc"
    record = lambda digest: b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    right = b"VGMT4NSHA2AWVOR6EVYXQUGCNSONBWE5"
    (tmp_path / "a.warc").write_bytes(record(right) + record(b"A" * 32) + record(right)[:-20])
    (tmp_path / "b.warc").write_bytes(b"no archive at all")
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert sorted((r.kind, r.intact) for r in rows) == [("bad", False), ("bad", False), ("response", False), ("response", True)]


def test_version_blocks_that_tell_too_little(spark, tmp_path):
    line = "filedesc://x 0.0.0.0 20200101000000 text/plain"
    bodies = {"none": "", "one": "1 0 t\n", "blank": "\n\n", "word": f"one 0 t\n{LINE}\n", "fields": "1 0 t\nURL Archive-length\n", "order": "1 0 t\nArchive-length URL IP-address Archive-date Content-type\n"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.arc").write_bytes(f"{line} {len(body)}\n{body}\n".encode() + arc(("http://a/", b"x")))
    rows = warc.read_arc(spark, f"file://{tmp_path}").collect()
    assert {r.archive.rpartition("/")[2][:-4] for r in rows if r.kind == "bad"} == set(bodies) and all(r.kind == "bad" for r in rows)


def test_digests_that_are_none(spark, tmp_path):
    record = lambda digest: b"WARC/1.0\r\nWARC-Type: revisit\r\n" + digest + b"Content-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(b"".join(record(b"WARC-Payload-Digest: " + d + b"\r\n") for d in (b"", b"sha1", b"sha1:", b"sha1:abc", b"md5:" + b"A" * 32, b"sha1:" + b"1" * 32, b"SHA1:" + b"a" * 32)) + record(b""))
    rows = warc.read_warc(spark, f"file://{tmp_path}").collect()
    assert [(r.digest, r.intact) for r in rows] == [(None, False)] * 6 + [("00" * 20, True), (None, False)]


def test_mutated_bytes_are_told(spark, tmp_path):
    """Archives with bytes changed, cut and put in: every reader ends with rows."""
    rng = np.random.default_rng(1)
    http = lambda x: b"HTTP/1.1 200 OK\r\nX-Quarry-Key: 7\r\n\r\n" + x
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "0.arc").write_bytes(arc(("http://a/", http(b"one")), ("http://b/", http(b"two"))))
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    whole = {"arc": (tmp_path / "arc" / "0.arc").read_bytes(), "warc": b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "warc").glob("part-*"))}
    for kind, data in whole.items():
        (folder := tmp_path / f"{kind}-changed").mkdir()
        for i in range(250):
            changed = bytearray(data)
            for _ in range(rng.integers(1, 4)):
                at = int(rng.integers(0, len(changed)))
                changed[at : at + int(rng.integers(0, 3))] = bytes(rng.choice(list(b" \r\n:019aZ\x00\xff"), rng.integers(0, 3)).tolist())
            packed = gzip.compress(bytes(changed)) if i % 5 == 0 else bytes(changed)
            (folder / f"{i}.gz").write_bytes(packed[: rng.integers(1, len(packed))] if i % 3 == 0 else packed)
        rows = (warc.read_arc if kind == "arc" else warc.read_warc)(spark, f"file://{folder}").collect()
        assert any(r.kind == "bad" for r in rows) and any(r.kind == "response" for r in rows)
    warc.write_warc(warc.read_arc(spark, f"file://{tmp_path}/arc-changed"), f"file://{tmp_path}/again")
    assert warc.read_warc(spark, f"file://{tmp_path}/again").count() > 0
