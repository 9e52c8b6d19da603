"""The source and sink of block-compressed, indexed text."""

from __future__ import annotations

import gzip
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from genolake.sources import indexed

SCHEMA = "chr string, pos int, refnt string, n long, share double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for c, n in (("1", 6000), ("10", 300), ("X", 40)):
        for p in sorted(rng.choices(range(1, 3_000_000 if c == "1" else 200_000), k=n)):
            out.append((c, p, rng.choice(["A", "GATTACA", "T" * 40, None]), rng.choice([None, 5, -7, 10**12]), rng.choice([0.25, None])))
    return out


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("indexed") / "table")
    indexed.write(spark.createDataFrame(rows, SCHEMA).repartition(7), path)
    return path


def sort(rows):
    return sorted(map(tuple, rows), key=str)


def test_whole_scan_in_any_pieces(spark, rows, folder):
    for split in (None, 3000, 1):
        df = indexed.read(spark, folder, SCHEMA, split_bytes=split)
        assert sort(df.collect()) == sort(rows)
        parts = df.select(F.spark_partition_id()).distinct().count()
    assert parts > 4  # pieces of a byte: a task for each place that the index names
    loose = indexed.read(spark, folder)
    assert loose.dtypes[:3] == [("chr", "string"), ("pos", "int"), ("refnt", "string")] and loose.where("n is null").count() == sum(r[3] is None for r in rows)


@pytest.mark.parametrize("region", [("1", 1, 3_000_000), ("1", 16_384, 16_385), ("1", 500_000, 900_000), ("1", 2_999_990, 5_000_000_000), ("10", 1, 1), ("X", 150_000, 180_000), ("1", 900, 800), ("Y", 1, 10**6)])
def test_regions(spark, rows, folder, region):
    got = indexed.read(spark, folder, SCHEMA, region)
    assert got.columns == ["chr", "pos", "refnt", "n", "share"]
    assert sort(got.collect()) == sort(r for r in rows if r[0] == region[0] and region[1] <= r[1] <= region[2])


def test_a_region_reads_its_blocks_alone(folder):
    """Bytes named by the index for a small region are a small part of the file's."""
    for path in indexed.files(folder):
        index = indexed.load_index(path)
        whole = sum((b >> 16) - (a >> 16) + 1 for a, b in index.places())
        for name in index.names:
            part = index.region(name, 1, 20_000)
            assert all(a < b for a, b in part) and sum((b >> 16) - (a >> 16) + 1 for a, b in part) <= whole
    assert index.region("nothing", 1, 10) == []


def test_columns_and_filters(spark, rows, folder):
    some = indexed.read(spark, folder, "share double, chr string", "10:1-100000")
    assert sort(some.collect()) == sort((r[4], r[0]) for r in rows if r[0] == "10" and r[1] <= 100_000)
    with pytest.raises(Exception, match="no column nothing"):
        indexed.read(spark, folder, "chr string, nothing int").collect()
    with pytest.raises(ValueError, match="a region is"):
        indexed.parse_region("1:5")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = indexed.read(spark, folder, SCHEMA).where("chr = '1' and pos > 100000 and pos <= 200000 and n is not null")
        assert sort(got.collect()) == sort(r for r in rows if r[0] == "1" and 100_000 < r[1] <= 200_000 and r[3] is not None)
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_are_plain_gzip_and_bins_agree(spark, rows, folder):
    """Any gzip reader reads the files; each line lies in the place that its bin names."""
    lines = []
    for path in indexed.files(folder):
        with gzip.open(path, "rt") as f:
            head, *body = f.read().splitlines()
        assert head == "#chr\tpos\trefnt\tn\tshare"
        lines += body
        index = indexed.load_index(path)
        again = indexed.Index.of_bytes(index.to_bytes())
        assert (again.names, again.bins, again.linear) == (index.names, index.bins, index.linear)
    assert len(lines) == len(rows)
    start, end = np.array([0]), np.array([1 << 14])
    assert indexed.bin_of(start, end).tolist() == [4681] and indexed.bin_of(start, end + 1).tolist() == [585]
    assert {0, 1, 9, 73, 585, 4681} == indexed.bins_over(0, 1) and 4682 in indexed.bins_over(100, 20_000)


def test_lines_that_span_a_boundary_come_once(spark, tmp_path):
    """An index made from both ends of a deletion names its line for two regions; it belongs to that of its position."""
    text = "##about\n#chr\tpos\trefnt\n5\t119999998\tGAAAAC\n5\t120000003\tT\n"
    blocks = [indexed.member(text[k : k + 20].encode()) for k in range(0, len(text), 20)]
    places = [sum(map(len, blocks[:k])) for k in range(len(blocks) + 1)]
    at = lambda u: places[u // 20] << 16 | u % 20
    one, two, end = text.index("5\t119"), text.index("5\t12"), len(text)
    index = indexed.Index(["5"], [{}], [[0] * 7324 + [at(one), at(one)]], (1, 2, 0), 2)
    for start, stop, a, b in ((119_999_997, 120_000_003, one, two), (120_000_002, 120_000_003, two, end)):
        number = int(indexed.bin_of(*np.array([[start], [stop]]))[0])
        index.bins[0].setdefault(number, []).append((at(a), at(b)))
    path = str(tmp_path / "sites.tab.gz")
    with open(path, "wb") as f:
        f.write(b"".join(blocks) + indexed.END)
    with open(path + ".tbi", "wb") as f:
        f.write(indexed.member(index.to_bytes()[:100]) + indexed.member(index.to_bytes()[100:]) + indexed.END)
    found = [r["pos"] for region in ("5:110000001-120000000", "5:120000001-130000000") for r in indexed.read(spark, path, "chr string, pos int, refnt string", region).collect()]
    assert found == [119_999_998, 120_000_003]
    assert indexed.read(spark, path).count() == 2 and indexed.read(spark, path, region="5").count() == 2


def test_sink_refuses_disorder_and_keeps_files(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 5, 1), ("a", 3, 2)], "chr string, pos int, v int").coalesce(1)
    spark.dataSource.register(indexed.IndexedText)
    with pytest.raises(Exception, match="sorted"):
        df.write.format("indexed_text").mode("append").save(path)
    indexed.write(df, path)
    indexed.write(spark.createDataFrame([("b", 7, 3)], df.schema), path)
    assert sort(indexed.read(spark, path, df.schema).collect()) == [("a", 3, 2), ("a", 5, 1), ("b", 7, 3)]
    with pytest.raises(Exception, match="position"):
        indexed.write(spark.createDataFrame([("b", None, 3)], df.schema), path)
    with pytest.raises(Exception, match="only added"):
        df.write.format("indexed_text").mode("overwrite").save(path)


def test_extra_fields_of_a_block():
    """A block may carry fields besides its size."""
    text = b"hello\n"
    plain = indexed.member(text)
    extra = struct.pack("<2BH4s", 65, 66, 4, b"more")
    size = len(plain) + len(extra)
    other = plain[:10] + struct.pack("<H", 6 + len(extra)) + extra + plain[12:16] + struct.pack("<H", size - 1) + plain[18:]
    import io

    assert [t for _, t in indexed.members(io.BytesIO(other + plain), 0)] == [text, text]


def test_tables_of_samples_are_read_through_their_index(spark, tmp_path):
    """A wide depth table: names by place, two samples' columns, a region; the same rows as plain text gives."""
    from genolake.sources import inputs, tabular

    df = spark.createDataFrame([("1", p, p % 7, p % 5, p % 3) for p in range(1, 500)], "chr string, pos int, bulk int, a int, b int")
    indexed.write(df, str(tmp_path / "deep"))
    (path,) = indexed.files(str(tmp_path / "deep"))
    assert tabular.header(spark, path) == ["chr", "pos", "bulk", "a", "b"]
    got = inputs.depths(spark, path, "b", "bulk", coordinates=True, region=("1", 100, 119))
    assert sort(got.collect()) == sort((("1", p, p % 3, p % 7) for p in range(100, 120)))
    plain = str(tmp_path / "plain.tab")
    with gzip.open(path, "rt") as f, open(plain, "w") as g:
        g.write(f.read())
    assert sort(inputs.depths(spark, plain, "b", "bulk", coordinates=True, region=("1", 100, 119)).collect()) == sort(got.collect())
