"""Small column functions: URLs, addresses, names, checksums, flags, times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of files by extension.
KINDS = [
    ("text", "txt|rtf|rtx|inf|ini"),
    ("archive", "zip|tgz|tar|tar[.]gz|gzip"),
    ("audio", "mp3|wav|midi"),
    ("image", "gif|jpeg|jpg|png|tif|tiff|bmp"),
    ("video", "wmv|asf|mov|mp4|mpeg|qt|avi"),
    ("html", "htm|html|php|asp|jsp|css|xml|shtml"),
    ("pdf", "pdf"),
    ("document", "odt|doc"),
    ("presentation", "odp|ppt"),
    ("spreadsheet", "ods|xls|csv"),
]
# Bits of a server's and of a catalogue row's flags.
SERVER_FLAGS = {"core": 1, "online": 2, "readable": 4, "writable": 8, "ssl": 16}
META_FLAGS = {"project_file": 2, "sticky_data": 4, "sticky_meta": 8, "gzip": 16, "limited_life": 32}


def url_parts(url: Column) -> dict[str, Column]:
    """protocol, host, port and secure (s at the protocol's end)."""
    protocol = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^:/?#]*)", 1)
    port = F.regexp_extract(rest, r"^[^:/?#]*:([0-9]+)", 1)
    default = F.when(protocol == "https", 443).when(protocol == "http", 80)
    return {"protocol": protocol, "host": host, "port": F.coalesce(F.when(port != "", port).cast("int"), default.cast("int")), "secure": protocol.endswith("s") & (protocol != "")}


def make_url(host: Column, port: Column, secure: Column) -> Column:
    return F.concat(F.when(secure, "https").otherwise("http"), F.lit("://"), host, F.lit(":"), port.cast("string"))


def ip_to_number(ip: Column) -> Column:
    """A dotted address as a number; null if it is none."""
    p = F.split(ip, "[.]")
    value = p[0].cast("long") * 16777216 + p[1].cast("long") * 65536 + p[2].cast("long") * 256 + p[3].cast("long")
    return F.when(ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"), value)


def number_to_ip(n: Column) -> Column:
    byte = lambda k: F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string")
    return F.concat_ws(".", byte(24), byte(16), byte(8), byte(0))


def ipv6_hex(ip: Column) -> Column:
    """The 16 bytes of an IPv6 address, as hex; null if it is none."""
    halves = F.split(F.lower(ip), "::")
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    left, right = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
    lack = F.lit(8) - F.size(left) - F.size(right)
    fits = F.when(F.size(halves) == 1, lack == 0).otherwise((F.size(halves) == 2) & (lack >= 1))
    every = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(lack, F.lit(0))), right)
    good = fits & F.forall(every, lambda g: g.rlike("^[0-9a-f]{1,4}$")) & ~ip.rlike("^:[^:]|[^:]:$|:::")
    return F.when(good, F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), ""))


def ipv6_text(data_hex: Column) -> Column:
    """16 bytes as eight groups without leading zeros."""
    group = lambda i: F.lower(F.conv(F.substring(data_hex, i * 4 + 1, F.lit(4)), 16, 16))
    return F.when(F.length(data_hex) == 32, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), group), ":"))


def long_bytes(n: Column) -> Column:
    """A long as 8 bytes, the highest first, as hex."""
    return F.lower(F.lpad(F.hex(n.cast("long")), 16, "0"))


def bytes_long(data_hex: Column) -> Column:
    """Eight bytes in hex as a signed long."""
    return F.conv(data_hex, 16, -10).cast("long")


def ip_version(ip: Column) -> Column:
    return F.when(ip.contains(":"), 6).when(ip.contains("."), 4)


def xor_checksum(data_hex: Column) -> Column:
    """All bytes of a hex string exclusive-ored."""
    n = (F.length(data_hex) / 2).cast("int")
    each = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substring(data_hex, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return F.aggregate(each, F.lit(0), lambda a, x: a.bitwiseXOR(x))


def sanitise_name(name: Column) -> Column:
    """File names without characters that some systems forbid."""
    return F.regexp_replace(name, r'[\\:*?"<>|]', "-")


def file_kind(name: Column) -> Column:
    kind = F.lit("other")
    for label, ends in reversed(KINDS):
        kind = F.when(F.lower(name).rlike(rf"\.({ends})$"), label).otherwise(kind)
    return kind


def has_flag(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit)) == bit


def mask_matches(action: Column, mask: int, any_mask: int = 16) -> Column:
    """All bits of mask are set; the any mask matches everything."""
    return F.lit(True) if mask == any_mask else action.bitwiseAND(F.lit(mask)) == mask


def time_split(millis: Column) -> dict[str, Column]:
    s = F.floor(millis / 1000)
    return {"hours": F.floor(s / 3600), "minutes": F.floor(F.pmod(s, F.lit(3600)) / 60), "seconds": F.pmod(s, F.lit(60))}


def percent_done(done: Column, total: Column) -> Column:
    """Whole percents, 0 to 100; 0 where nothing is to do."""
    return F.when(total <= 0, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(done * 100 / total)))).cast("int")


def map_put(values: Column, key: str, value: Column) -> Column:
    """A map with a key set, whether it had it or not."""
    return F.map_concat(map_without(values, [key]), F.create_map(F.lit(key), value))


def map_without(values: Column, keys: list[str]) -> Column:
    return F.map_filter(values, lambda k, v: ~k.isin(keys))


def newline_tag(text: Column, decode: bool = False) -> Column:
    """Values on one line: line ends as a tag, and back."""
    return F.replace(text, F.lit("<<NL>>"), F.lit("\n")) if decode else F.replace(text, F.lit("\n"), F.lit("<<NL>>"))


def common_name(subject: Column) -> Column:
    """CN of a certificate's subject."""
    return F.trim(F.regexp_extract(subject, r"(?:^|,)\s*CN=([^,]*)", 1))
