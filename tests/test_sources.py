"""Readers of range sets and reference tables."""

import gzip
import io
import tarfile
import zipfile

import numpy as np
import pytest

from rangeloom.operators import intervals as iv
from rangeloom.operators import ipv6
from rangeloom.sources import binary, reference, text

#: line, kind, first and last address; the first four follow the base rules of C number literals.
LINES = [("10", "range", 10, 10), ("0x0A.1", "range", (10 << 24) + 1, (10 << 24) + 1), ("012.0.0.1", "range", (10 << 24) + 1, (10 << 24) + 1), ("10.0.256", "range", (10 << 24) + 256, (10 << 24) + 256),
         ("1.2.3.4/24", "range", 0x01020300, 0x010203FF), ("1.2.3.4/255.255.0.0", "range", 0x01020000, 0x0102FFFF), ("1.2.3.4/255.0.255.0", "rejected", None, None), ("1.2.3.4/33", "rejected", None, None),
         ("1.2.3.4 - 1.2.3.9 # note", "range", 0x01020304, 0x01020309), ("1.2.3.0/30-1.2.4.0/30", "range", 0x01020300, 0x01020403), ("1.2.3.9-1.2.3.4", "reversed", 0x01020309, 0x01020304),
         ("0.0.0.0/0", "range", 0, 0xFFFFFFFF), ("256.1.1.1", "hostname", None, None), ("host.example.org", "hostname", None, None), ("dashed-host.example.org", "rejected", None, None),
         ("; only a note", "blank", None, None), ("\r", "blank", None, None), ("4294967296", "rejected", None, None), ("1.2.3.4.5", "hostname", None, None), ("-1.2.3.4", "hostname", None, None), ("089.1.1.1", "hostname", None, None)]


def test_lines_are_parsed(spark):
    body = "﻿" + "\n".join(x for x, *_ in LINES)
    found = text.parsed(text.lines(spark.createDataFrame([("f", body)], "key string, body string"))).collect()
    assert [(r["kind"], r["lo"], r["hi"]) for r in found] == [tuple(x[1:]) for x in LINES]
    literal = text.ranges(spark.createDataFrame([("f", "1.2.3.4/24")], "key string, line string"), mask_cidr=False).first()
    assert (literal["lo"], literal["hi"]) == (0x01020304, 0x010203FF)
    wide = text.ranges(spark.createDataFrame([("f", "1.2.3.4")], "key string, line string"), default_prefix=24).first()
    assert (wide["lo"], wide["hi"]) == (0x01020300, 0x010203FF)
    with pytest.raises(Exception, match="reversed range"):
        text.parsed(spark.createDataFrame([("f", "1.2.3.9-1.2.3.4")], "key string, line string"), strict=True).collect()


def test_files_lists_and_gzip_are_read(spark, tmp_path):
    (tmp_path / "one.netset").write_text("1.0.0.0/8\n")
    with gzip.open(tmp_path / "two.txt.gz", "wt") as f:
        f.write("2.2.2.2\n")
    (tmp_path / "list").write_text(f"# feeds\n{tmp_path}/one.netset\n{tmp_path}/two.txt.gz\n")
    got = sorted((r["feed"], r["lo"]) for r in text.read_list(spark, str(tmp_path / "list")).collect())
    assert got == [("one", 1 << 24), ("two", 0x02020202)]


def test_reference_tables(spark):
    lines = lambda *rows: spark.createDataFrame([(x,) for x in rows], "line string")
    asn = reference.iptoasn(lines("1.0.0.0\t1.0.0.255\t13335\tUS\tNAME", "2.0.0.0\t2.0.0.9\t0\tNone\tNot routed", "2001::\t2001::1\t5\tUS\tx"))
    assert [tuple(r) for r in asn.collect()] == [(1 << 24, (1 << 24) + 255, 13335, "US", "NAME")]
    with pytest.raises(Exception, match="bad line"):
        reference.iptoasn(lines("1.0.0.0\t1.0.0.255")).collect()
    assert sorted(tuple(r) for r in reference.caida(lines("1.0.0.0\t24\t13335_4", "1.0.1.0\t24\t7,8", "1.0.2.0\t24\t0", "2001::\t32\t9")).collect()) == [(1 << 24, (1 << 24) + 255, 13335), ((1 << 24) + 256, (1 << 24) + 511, 7)]
    assert [tuple(r) for r in reference.geo_csv(lines('"16777216","16777471","au"', '"0","16777215","-"', "1.2.3.4,1.2.3.5,DE,x")).orderBy("lo").collect()] == [("AU", 1 << 24, (1 << 24) + 255), ("DE", 0x01020304, 0x01020305)]
    blocks = spark.createDataFrame([("1.0.0.0/24", "1", "", "0", "0"), ("2.0.0.0/24", "", "2", "0", "0"), ("3.0.0.0/24", "1", "", "1", "0"), ("4.0.0.0/24", "1", "", "0", "1")],
                                   "network string, geoname_id string, registered_country_geoname_id string, is_anonymous_proxy string, is_satellite_provider string")
    places = spark.createDataFrame([("1", "DE"), ("2", "FR")], "geoname_id string, country_iso_code string")
    assert sorted(r["code"] for r in reference.geolite(blocks, places).collect()) == ["ANONYMOUS", "DE", "FR", "SATELLITE"]


def test_archives_of_zones(spark, tmp_path):
    with tarfile.open(tmp_path / "zones.tar.gz", "w:gz") as t:
        for name, body in (("de.zone", b"1.0.0.0/24\n1.0.1.0/24\n"), ("readme", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.writestr("fr.zone", "2.0.0.0/24\n")
    got = sorted(tuple(r) for r in reference.country_zones(spark, str(tmp_path)).collect())
    assert got == [("DE", 1 << 24, (1 << 24) + 255), ("DE", (1 << 24) + 256, (1 << 24) + 511), ("FR", 2 << 24, (2 << 24) + 255)]


def test_prefixes_are_given_up_by_price():
    # 4 blocks of /24 become 8 of /25, which is cheaper than 1 block of /16 cut into 256 of /24.
    assert iv.reduced_prefixes({16: 1, 24: 4, 25: 2}, 200, 0) == [16, 25]
    assert iv.reduced_prefixes({32: 5}, 1000, 0) == [32]


def test_binary_files_go_round(spark, tmp_path):
    rows = [("a", 5, 9), ("a", 20, 20), ("b", 0, 0xFFFFFFFF)] + [("c", 10 * i, 10 * i + i % 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "feed string, lo long, hi long").repartition(5)
    assert binary.write(df, f"file://{tmp_path}/sets", "own format v1").count() == 3
    assert sorted(p.name for p in (tmp_path / "sets").iterdir() if p.suffix == ".bin") == ["a.bin", "b.bin", "c.bin"]
    got = binary.read(spark, f"{tmp_path}/sets", "own format v1", records=130)
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows)
    assert got.rdd.getNumPartitions() == 1 + 1 + 8  # a file is read by several tasks
    about = binary.metadata(spark, f"{tmp_path}/sets", "own format v1")
    assert sorted((r["feed"], r["records"], int(r["unique_ips"])) for r in about.collect() if r["feed"] < "c") == [("a", 2, 6), ("b", 1, 1 << 32)]
    assert binary.verified(got, about).count() == 0
    (tmp_path / "sets" / "empty.bin").write_bytes(b"")
    assert binary.read(spark, f"{tmp_path}/sets", "own format v1").count() == len(rows)


def test_metadata_reads_the_header_only(spark, tmp_path):
    """The payload is missing, and nobody notices; reading the ranges fails."""
    (tmp_path / "cut.bin").write_bytes(binary.head_of("m", 4, 1_000_000, 1_000_000, 2_000_000)[:-4])
    assert [r["records"] for r in binary.metadata(spark, str(tmp_path), "m").collect()] == [1_000_000]
    with pytest.raises(Exception, match="payload is cut short"):
        binary.read(spark, str(tmp_path), "m").count()


def test_binary_files_of_both_byte_orders_and_broken_ones(spark, tmp_path):
    good = binary.head_of("m", 4, 1, 1, 5) + np.array([5, 9], "<u4").tobytes()
    broken = [good[:-1], good + b"x", good.replace(b"optimized", b"sorted", 1), b"x" + good, good.replace(b"record size 8", b"record size 9"), good[:-8] + np.array([9, 5], "<u4").tobytes(), good[:-12] + b"abcd" + good[-8:], b"m\nipv6" + good[1:]]
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "f.bin").write_bytes(good[:-12] + np.array([binary.MARK, 5, 9], ">u4").tobytes())
    assert [tuple(r) for r in binary.read(spark, f"{tmp_path}/big", "m").collect()] == [("f", 5, 9)]
    for i, bad in enumerate(broken):
        (tmp_path / f"bad{i}").mkdir()
        (tmp_path / f"bad{i}" / "f.bin").write_bytes(bad)
        with pytest.raises(Exception):
            binary.read(spark, f"{tmp_path}/bad{i}", "m").collect()
    (tmp_path / "sum").mkdir()
    (tmp_path / "sum" / "f.bin").write_bytes(good.replace(b"unique ips 5", b"unique ips 6"))
    found = binary.verified(binary.read(spark, f"{tmp_path}/sum", "m"), binary.metadata(spark, f"{tmp_path}/sum", "m")).collect()
    assert [tuple(r) for r in found] == [("f", "unique ips")]


def test_binary_files_of_ipv6_ranges(spark, tmp_path):
    lines = [("s", "2001:db8::1-2001:db8::9"), ("s", "fe80::/10"), ("t", "::/0"), ("t", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff")]
    ranges = ipv6.optimize(ipv6.ranges(spark.createDataFrame(lines[:3], "key string, line string")))
    binary.write(ranges, f"file://{tmp_path}/six", "own format v2", family=6).count()
    got = binary.read(spark, f"{tmp_path}/six", "own format v2", family=6, records=1)
    shown = lambda df: sorted((r["feed"], r["line"]) for r in df.select("feed", ipv6.range_text().alias("line")).collect())
    assert shown(got) == shown(ranges)
    head = (tmp_path / "six" / "s.bin").read_bytes()
    assert head.startswith(b"own format v2\nipv6\noptimized\nrecord size 32\nrecords 2\nbytes 68\n")
    with pytest.raises(Exception, match="IPv6 ranges where IPv4"):
        binary.read(spark, f"{tmp_path}/six", "own format v2").count()
