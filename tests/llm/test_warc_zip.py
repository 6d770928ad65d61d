import io
import zipfile
from collections import Counter, defaultdict

import duckdb
import pytest

from lineweave.llm import warc_zip as Z
from lineweave.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, digest string, refers_to string, path string"
ROWS = [(5, "http://a", "same", "", "", ""), (2, "http://b", "same", "", "", ""), (9, "u\r\nWARC-Type: x", "same", "", "", ""), (None, "n", "same", "", "", ""), (1, None, None, "", "", ""), (3, "e", "", "", "", ""), (4, "long", "é\r\n\r\n" * 200_000, "", "", ""), (6, "x", "twice", None, None, None), (6, "x", "twice", None, None, None), (6, "x", "other", None, None, None), (None, "y", "lone", None, None, None), (7, "z", "twice", None, None, None), (None, "y", "lone", None, None, None)]


def expected(rows, min_bytes=0):
    first = defaultdict(list)
    for page_id, _, html, *_ in rows:
        first[(html or "").encode()].append(page_id)
    out = []
    for page_id, _, html, *_ in rows:
        payload = (html or "").encode()
        known = [x for x in first[payload] if x is not None]
        least = min(known) if known and len(payload) >= min_bytes else None
        again = least is not None and page_id != least
        out.append((page_id, len(payload), Z.base32_sha1(payload), "revisit" if again else "response", least if again else None))
    return Counter(out)


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_round_trip(spark, min_bytes):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    packages = Z.write_packages(pages, f"{shared_dir(spark)}/w", min_bytes, package_bytes=200)
    rows = Z.read_packages(packages).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected(ROWS, min_bytes)
    want = Counter(((h or "").encode(), (u or "").replace("\r", "%0D").replace("\n", "%0A")) for _, u, h, *_ in ROWS)
    assert all((bytes(r.payload), r.url) in want for r in rows if r.record_type == "response")
    assert all(r.payload is None for r in rows if r.record_type == "revisit")


def test_packages_are_ordinary_zip_files(spark):
    packages = Z.write_packages(spark.createDataFrame(ROWS, SCHEMA), f"{shared_dir(spark)}/w")
    path = packages.first().path.removeprefix("file:")
    import gzip

    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [Z.DATA, Z.INDEX]
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
        assert gzip.decompress(z.read(Z.DATA)).count(b"WARC/1.1\r\n") == len(z.read(Z.INDEX).splitlines())


def test_directories():
    for n, comment in ((0, b""), (3, b"a comment"), (70_000, b"")):  # the last has a ZIP64 directory
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for i in range(n):
                z.writestr(f"é{i}", b"x" * (i % 5))
            z.comment = comment
        data = raw.getvalue()
        found = Z.directory(lambda k, at: data[at : at + k], len(data))
        with zipfile.ZipFile(raw) as z:
            assert found == {i.filename: (i.header_offset, i.compress_size, 0) for i in z.infolist()}


def test_zip64_sizes():
    """Sizes and places over 4 GB are in the ZIP64 field of an entry."""
    import struct

    name, big = b"m", 5 << 32
    entry = Z.ENTRY + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 28, 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HHQQQ", 1, 24, big, big + 1, big + 2)
    end64 = Z.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), 0)
    data = entry + end64 + Z.LOCATOR + struct.pack("<IQI", 0, len(entry), 1) + Z.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert Z.directory(lambda k, at: data[at : at + k], len(data)) == {"m": (big + 2, big + 1, 0)}
    with pytest.raises(ValueError):
        Z.directory(lambda k, at: b"x" * k, 100)


def test_query_and_sql(spark):
    found = Counter(tuple(r) for r in Z.op7_warc_zip(spark, "/root/testdata/sf0.01").collect())
    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.01/pages.parquet')")
    assert found == Counter(con.execute(Z.OP7_SQL).fetchall())


def test_no_pages(spark):
    assert Z.read_packages(Z.write_packages(spark.createDataFrame([], SCHEMA), f"{shared_dir(spark)}/w")).collect() == []
