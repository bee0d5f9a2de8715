import hashlib
import random

from tests.conftest import duck_rows, rows_of
from trefoil.llm import queries, sql, warc

SCHEMA = "page_id bigint, url string, html string, segment string, bytes int, digest string"


def expected(rows):
    first = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page is not None:
            first[data] = min(first.get(data, page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = first.get(data)
        again = to is not None and page is not None and page != to
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=repr)


def round_trip(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    found = warc.round_trip(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(map(tuple, found.collect()), key=repr)


def fake(page, body):
    """A whole record as text, to hide in a payload."""
    return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"


def nasty():
    rng = random.Random(3)
    rows = [(i, f"http://x/{i}\r\ny é", "é" * rng.randint(0, 400)) for i in range(40)]
    rows += [(100 + i, None, "x" + fake(i, "hidden " * 30) * rng.randint(1, 4) + "tail") for i in range(6)]
    rows += [(200, "", "WARC/1.1\r\n" * 50), (201, "u", "WARC/1.1\r\nContent-Length: 999999\r\n\r\n" + "z" * 500), (202, "u", "\r\n\r\n"), (203, "u", fake(5, "") + "\r\n"), (204, "u", "a\nb\rc" * 100)]
    rows += [(300, "u", "same " * 40), (301, "v", "same " * 40), (299, "w", "same " * 40), (302, "u", "short"), (303, "u", "short"), (304, "u", None), (305, None, ""), (300, "u", "same " * 40)]
    rows += [(400, "u", ("filler " + fake(7, "q" * 90)) * 400)]
    return rows


def test_hidden_magic_revisits_and_nulls(spark):
    assert round_trip(spark, nasty()) == expected(nasty())


def test_blocks_smaller_than_records(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("512", "4099"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            assert round_trip(spark, nasty()) == expected(nasty())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_null_id_and_empty_table(spark):
    rows = [(None, "u", "n" * 200), (None, "u", "n" * 200), (4, "u", "m" * 200)]
    assert round_trip(spark, rows) == expected(rows)
    assert round_trip(spark, []) == []


def test_garbage_after_the_chain_is_not_reached(spark, tmp_path):
    text = fake(1, "one") + fake(2, "two") + "junk" + fake(3, "three")
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(text.encode())
    (tmp_path / "a" / "y.warc").write_bytes(("lead" + fake(9, "nine")).encode())
    found = warc.read_archives(spark, str(tmp_path / "a")).select("record_id", "length").collect()
    assert sorted(map(tuple, found)) == [("1", 3), ("2", 3)]


def test_query_against_sql(spark):
    from tests.conftest import SF

    assert rows_of(queries.op4_warc_round_trip(spark, SF)) == duck_rows(sql.WARC)[1]
