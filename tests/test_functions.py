import hashlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import encodings as E
from cairn.functions import hashing as H
from cairn.functions import scalars as S
from cairn.operators import activity as A
from cairn.operators import diagnostics as G


def one(spark, *cols):
    return spark.range(1).select(*cols).head()


def layout(data: bytes) -> str:
    return hashlib.md5(data).hexdigest() + hashlib.sha1(data).hexdigest() + hashlib.sha256(data).hexdigest() + f"{len(data):016x}"


@pytest.mark.parametrize("text, pad", [("", None), ("abc", None), ("Iechä", None), ("abc", "pad")])
def test_content_hash_layout(spark, text, pad):
    got = one(spark, H.content_hash(F.lit(text), F.lit(pad) if pad else None))[0]
    assert got == layout((text + (pad or "")).encode())
    assert one(spark, H.part(F.lit(got), "length"))[0] == len((text + (pad or "")).encode())


def test_signed_order(spark):
    hashes = [H.bound(b) for b in (0x7F, 0x00, 0xFF, 0x80)] + [H.bound(0x80, True)]
    df = spark.createDataFrame([(h,) for h in hashes], "h string").orderBy(H.order_key(F.col("h")))
    assert [r[0][:4] for r in df.collect()] == ["8080", "807f", "ff80", "0080", "7f80"]


def test_next_and_previous(spark):
    h = "00" * 75 + "ff"
    a, b = one(spark, H.next_hash(F.lit(h)), H.previous_hash(F.lit("00" * 76)))
    assert a == "00" * 74 + "0100" and b == "ff" * 76


def test_text_forms(spark):
    h = layout(b"x")
    b64 = one(spark, H.to_base64(F.lit(h)))[0]
    assert len(b64) == 104 and "\n" not in b64
    got = one(spark, *[H.parse_hash(F.lit(x)) for x in (f" {h.upper()} ", b64, "zz", h[:-1])])
    assert list(got) == [h, h, None, None]


def test_encodings_round_trip(spark):
    data = "some text, " * 50
    for kind in ("gzip", "bzip2", "lzma"):
        packed = E.compress(F.lit(data), kind)
        back, bad = one(spark, E.decompress(packed, kind).cast("string"), E.decompress(F.lit("junk"), kind))
        assert back == data and bad is None
    chain = E.encode_chain(F.lit(data), True, F.lit("secret"))
    good, wrong = one(spark, E.decode_chain(chain, True, F.lit("secret")).cast("string"), E.decrypt(E.encrypt(F.lit(data), F.lit("a")), F.lit("b")))
    assert good == data and wrong is None


def test_scalars(spark):
    u = S.url_parts(F.lit("https://Host.org:8443/x?y"))
    assert one(spark, *u.values()) == ("https", "Host.org", 8443, True)
    assert one(spark, S.ip_to_number(F.lit("1.2.3.4")), S.number_to_ip(F.lit(16909060)), S.ip_to_number(F.lit("300.1.1.1"))) == (16909060, "1.2.3.4", None)
    assert one(spark, S.sanitise_name(F.lit('a:b*c?"d<e>f|g')))[0] == "a-b-c--d-e-f-g"
    assert one(spark, S.xor_checksum(F.lit("0f01")), S.xor_checksum(F.lit("")))[:] == (14, 0)
    assert one(spark, S.percent_done(F.lit(5), F.lit(0)), S.percent_done(F.lit(7), F.lit(5)))[:] == (0, 100)
    assert one(spark, S.newline_tag(S.newline_tag(F.lit("a\nb")), decode=True), S.common_name(F.lit("O=x, CN=Ann Other")))[:] == ("a\nb", "Ann Other")
    assert one(spark, S.file_kind(F.lit("x.TAR")), S.file_kind(F.lit("noend")))[:] == ("archive", "other")


def test_masks(spark):
    """REPLACE has the SET bit; 16 matches everything."""
    codes = (33, 34, 65, 66, 50)
    hits = {m: [c for c in codes if one(spark, S.mask_matches(F.lit(c), m))[0]] for m in (32, 64, 2, 34, 16)}
    assert hits == {32: [33, 34, 50], 64: [65, 66], 2: [34, 66, 50], 34: [34, 50], 16: list(codes)}


def test_activity_range(spark):
    log = spark.createDataFrame([(i, i * 10, 33, "h") for i in range(1, 6)], "event_id long, ts long, action int, hash string")
    assert A.between(log, 20, 40).count() == 3 and A.between(log, -5, 10).count() == 1
    assert [r.ts for r in A.read(log, 0, 99, 2).collect()] == [10, 20]
    with pytest.raises(ValueError):
        A.between(log, 2, 1)


def test_extremes_first_wins_and_batches(spark):
    rows = spark.createDataFrame([("h", "a", 5, 1), ("h", "b", 5, 2), ("h", "c", 1, 3)], "host string, description string, millis long, seq long")
    assert tuple(G.host_extremes(rows).head()) == ("h", 5, "a", 1, "c")
    items = spark.createDataFrame([("h", i, s) for i, s in enumerate([60, 60, 10, 10, 200, 1])], "host string, seq long, size long")
    got = sorted((r.batch, r.n, r.bytes) for r in G.batches(items, "host", ["seq"], "size", 100, 3).collect())
    assert got == [(0, 2, 120), (1, 3, 220), (2, 1, 1)]


def test_ipv6(spark):
    cases = {"2001:db8::1": "20010db8000000000000000000000001", "::": "0" * 32, "1:2:3:4:5:6:7:8": "00010002000300040005000600070008", "fe80::1:": None, "1:2:3": None, "::g": None, "1.2.3.4": None}
    for text, want in cases.items():
        assert one(spark, S.ipv6_hex(F.lit(text)))[0] == want
    assert one(spark, S.ipv6_text(S.ipv6_hex(F.lit("2001:DB8::1"))))[0] == "2001:db8:0:0:0:0:0:1"


def test_tags(spark):
    from cairn.operators import access

    back = access.tag_values(access.tag_text(F.create_map(F.lit("b"), F.lit("x\ny"), F.lit("a"), F.lit("1: 2"))))
    assert one(spark, back)[0] == {"a": "1: 2", "b": "x\ny"}
    assert one(spark, access.tag_values(F.lit("no tag\nk: 1\nk: 2")))[0] == {"k": "2"}


def test_file_kinds(spark):
    for name, kind in {"a.csv": "spreadsheet", "A.XML": "html", "b.tar.gz": "archive", "c.gz": "other", "d.rtf": "text", "e.ppt": "presentation"}.items():
        assert one(spark, S.file_kind(F.lit(name)))[0] == kind


def test_coordinates(spark):
    want = {0: "80" * 76, 1: "8080" + "7f" * 74, 256: "807f" + "7f" * 74, 257: "8180" + "7f" * 74, 65536: "7f" * 76, 65537: None}
    for k, x in want.items():
        assert one(spark, H.coordinate_hash(F.lit(k)))[0] == x


def test_order_key_of_every_byte(spark):
    """Signed order at every byte, in upper case too, without a function called for each byte."""
    hashes = [f"{b:02x}" * 76 for b in range(256)] + [("80" * 75 + f"{b:02x}") for b in range(1, 256)]
    df = spark.createDataFrame([(h,) for h in hashes], "h string").orderBy(H.order_key(F.col("h")))
    assert [r.h for r in df.collect()] == sorted(hashes, key=lambda h: [(b ^ 128) for b in bytes.fromhex(h)])
    assert one(spark, H.order_key(F.lit("AB" * 76)) == H.order_key(F.lit("ab" * 76)))[0]
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString() and one(spark, H.order_key(F.lit(None).cast("string")))[0] is None
