import hashlib
import io
import zipfile
from collections import Counter, defaultdict

import pytest

from querymill.llm import warc as W
from querymill.session import Scratch
from tests.llm.helpers import LONG, multiset

BIG = "<p>" + "x" * 200


def expected(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        ids = [i for i in groups[html or ""] if i is not None]
        first = min(ids) if len(data) >= 100 and len(groups[html or ""]) > 1 and ids else None
        first = None if first == page_id else first
        out.append((page_id, "response" if first is None else "revisit", first, len(data), hashlib.sha256(data).hexdigest()))
    return multiset(out)


def test_written_archives_read_back(spark):
    rows = [(5, "http://a/", BIG), (3, "http://b/\r\nX: y", BIG), (9, None, BIG), (None, "u", BIG), (7, "u", "short"), (8, "u", "short"), (1, "u", None), (2, "u", ""), (4, "u", "é漢" * 60), (6, "u", LONG), (10, "u", LONG), (3, "again", BIG)]
    rows += [(None, "n", "y" * 300)] * 2
    df = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    with Scratch(spark) as scratch:
        got = W.archive_and_read(scratch, df).collect()
        assert W.archive_and_read(scratch, df.limit(0)).count() == 0
    assert multiset((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got) == expected(rows)
    texts = Counter((r[2] or "").encode() for r in rows)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) in texts) for r in got)
    assert {r["target_uri"] for r in got if r["page_id"] == 3} == {"http://b/%0D%0AX:%20y", "again"}


def archive(members, wide=False):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as made:
        for name, data, kind in members:
            info = zipfile.ZipInfo(name)
            info.compress_type, info.extra = kind, b"\x99\x99\x02\x00hi"
            with made.open(info, "w", force_zip64=wide) as member:
                member.write(data)
        made.comment = b"PK\x05 a comment"
    return held.getvalue()


class Opened(io.BytesIO):
    def size(self):
        return len(self.getvalue())


@pytest.mark.parametrize("wide", [False, True])
def test_members_are_found_by_their_directory(wide):
    data = archive([("a", b"first", zipfile.ZIP_STORED), ("squeezed", b"x" * 99, zipfile.ZIP_DEFLATED), ("dir/é", b"", zipfile.ZIP_STORED), ("b", b"last one", zipfile.ZIP_STORED)], wide)
    found = W.members(Opened(data))
    assert {n: data[m.start:m.start + m.size] for n, m in found.items()} == {"a": b"first", "dir/é": b"", "b": b"last one"}


def test_zip64_directory(monkeypatch):
    """More members than 16 bits count, and sizes and places beyond 32 bits as the ZIP64 fields give them."""
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 40)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    data = archive([(f"m{i}", b"%d" % i * 50, zipfile.ZIP_STORED) for i in range(5)], True)
    assert b"PK\x06\x06" in data and b"PK\x06\x07" in data
    found = W.members(Opened(data))
    assert {n: data[m.start:m.start + m.size] for n, m in found.items()} == {f"m{i}": b"%d" % i * 50 for i in range(5)}


def test_what_is_no_archive_or_damaged_is_an_error():
    with pytest.raises(ValueError):
        W.members(Opened(b"nothing here" * 10))
    import zlib

    record = zlib.decompress(W.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None), 31)
    assert W.parse(record)["payload"] == b"payload"
    with pytest.raises(ValueError):
        W.parse(record.replace(b"payload\r\n\r\n", b"pay1oad\r\n\r\n"))
