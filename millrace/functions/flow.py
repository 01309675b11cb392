"""Column functions on flows and packets: protocols, keys, addresses, times, byte arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IANA protocol numbers by short name.
PROTOCOLS = {"icmp": 1, "igmp": 2, "tcp": 6, "udp": 17, "gre": 47, "esp": 50, "ah": 51, "ipv6-icmp": 58, "icmp6": 58, "ospf": 89, "sctp": 132}
#: TCP flag masks in the order of the contract's counters.
FLAGS = {"syn": 2, "fin": 1, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def protocol_number(c: Column) -> Column:
    """IANA number of a number, a digit text ("6", "6.0") or a name; else null."""
    text = F.lower(F.trim(c.cast("string")))
    number = F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), text.try_cast("double").try_cast("int"))
    return F.coalesce(number, F.try_element_at(_map(PROTOCOLS), text)).cast("smallint")


def protocol_name(c: Column) -> Column:
    """Short name of a number, else the number as text; ``unknown`` for null."""
    names = {v: k for k, v in reversed(PROTOCOLS.items())}
    return F.coalesce(F.try_element_at(_map(names), c.cast("int")), c.cast("string"), F.lit("unknown"))


def directed_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port", proto="proto") -> Column:
    """The 5-tuple as seen from the initiator."""
    return F.struct(src_ip, src_port, dst_ip, dst_port, proto)


def endpoint_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port", proto="proto") -> Column:
    """P5: a key equal for both directions; null ports and protocols count as -1."""

    def end(ip: str, port: str) -> Column:
        return F.struct(F.col(ip).alias("ip"), F.coalesce(F.col(port).cast("int"), F.lit(-1)).alias("port"))

    a, b = end(src_ip, src_port), end(dst_ip, dst_port)
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.coalesce(F.col(proto).cast("int"), F.lit(-1)).alias("proto"))


def text_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port", proto="proto") -> Column:
    """The same as text, ``lo|hi|proto``; a null address is ``?``."""

    def end(ip: str, port: str) -> Column:
        return F.concat_ws(":", F.coalesce(F.col(ip), F.lit("?")), F.coalesce(F.col(port).cast("int"), F.lit(-1)).cast("string"))

    a, b = end(src_ip, src_port), end(dst_ip, dst_port)
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b), F.coalesce(F.col(proto).cast("int"), F.lit(-1)).cast("string"))


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def relative_error(a: Column, b: Column) -> Column:
    """(b - a) / (|a| + 1), null unless both are finite."""
    return (finite(b) - finite(a)) / (F.abs(finite(a)) + 1)


def ipv4_number(ip: Column) -> Column:
    """Dotted address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^((25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")
    return F.when(ok, sum(parts[i].cast("long") * 256 ** (3 - i) for i in range(4)))


def cidr_range(cidr: str) -> tuple[int, int]:
    """First and last number of an IPv4 network; host bits are ignored."""
    base, _, bits = cidr.partition("/")
    n = 0
    for x in base.split("."):
        n = n * 256 + int(x)
    free = 32 - int(bits or 32)
    lo = n >> free << free
    return lo, lo + (1 << free) - 1


def ipv6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hex digits, ``::`` and a dotted tail filled in; null if it is none."""
    tail = ipv4_number(F.regexp_extract(ip, r":([0-9.]+)$", 1))
    dotted = F.contains(ip, F.lit(".")) & tail.isNotNull()
    hex_tail = F.concat(F.lit(":"), F.hex(F.shiftright(tail, 16)), F.lit(":"), F.hex(tail.bitwiseAND(0xFFFF)))
    ip = F.when(dotted, F.concat(F.regexp_replace(ip, r":[0-9.]+$", ""), hex_tail)).otherwise(ip)
    halves = F.split(ip, "::")

    def groups(c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, ":"))

    a, b = groups(halves[0]), F.when(F.size(halves) > 1, groups(F.try_element_at(halves, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    fill = F.lit(8) - F.size(a) - F.size(b)
    full = F.concat(a, F.array_repeat(F.lit("0"), F.greatest(fill, F.lit(0))), b)
    ok = ip.rlike(r"^[0-9A-Fa-f:]+$") & ip.contains(":") & (F.size(halves) <= 2) & ((F.size(halves) == 2) | (fill == 0)) & (fill >= 0) & F.forall(full, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    return F.when(ok, F.lower(F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), "")))


def in_cidrs(ip: Column, cidrs: list[str]) -> Column:
    """Membership in any network, IPv4 or IPv6; text that is no address is in none."""
    number, digits, hit = ipv4_number(ip), ipv6_hex(ip), F.lit(False)
    for c in cidrs:
        if ":" in c:
            base, _, bits = c.partition("/")
            n = int(bits or 128)
            whole, part = divmod(n, 4)
            net = ipv6_hex(F.lit(base))
            same = F.substring(digits, 1, whole) == F.substring(net, 1, whole) if whole else digits.isNotNull()
            if part:
                nibble = lambda x: F.conv(F.substring(x, whole + 1, 1), 16, 10).cast("int")
                same = same & (F.shiftright(nibble(digits), 4 - part) == F.shiftright(nibble(net), 4 - part))
            hit = hit | same
        else:
            hit = hit | number.between(*cidr_range(c))
    return F.coalesce(hit, F.lit(False))


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def iso_epoch(c: Column) -> Column:
    """ISO text as UTC epoch seconds, null if it can't be read."""
    return epoch(F.try_to_timestamp(c))


def mixed_epoch(c: Column) -> Column:
    """ISO or day-first (12 or 24 hours) text as epoch seconds, decided row by row."""
    day_first = F.coalesce(F.try_to_timestamp(c, F.lit("dd/MM/yyyy hh:mm:ss a")), F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH:mm:ss")), F.try_to_timestamp(c, F.lit("d/M/yyyy H:mm")))
    return epoch(F.when(c.rlike(r"^\s*\d{4}-"), F.try_to_timestamp(F.trim(c))).otherwise(day_first))


def local_epoch(day: Column, clock: Column, zone: Column | str) -> Column:
    """Local date and time in a named zone or at a fixed offset, as epoch seconds."""
    return epoch(F.to_utc_timestamp(F.try_to_timestamp(F.concat_ws(" ", day, clock)), zone))


def shifted_epoch(c: Column, hours: Column) -> Column:
    """P10: day-first local time in 12 or 24 hours plus an offset in hours."""
    t = F.coalesce(F.try_to_timestamp(c, F.lit("dd/MM/yyyy hh:mm:ss a")), F.try_to_timestamp(c, F.lit("dd/MM/yyyy HH:mm:ss")))
    return epoch(t) + hours * 3600


def fold_benign(c: Column) -> Column:
    """BENIGN and NORMAL in any case are BENIGN; other labels lose the blanks around them."""
    return F.when(F.upper(F.trim(c)).isin("BENIGN", "NORMAL"), "BENIGN").otherwise(F.trim(c))


def is_host(ip: Column) -> Column:
    """No multicast, broadcast or unspecified address."""
    number = ipv4_number(ip)
    return F.coalesce(ip.isNotNull() & ~ip.isin("0.0.0.0", "255.255.255.255", "::", "") & ~F.coalesce(number.between(224 << 24, (240 << 24) - 1), F.lit(False)) & ~F.startswith(F.lower(ip), F.lit("ff")), F.lit(False))


def int_or_minus(c: Column) -> Column:
    return F.coalesce(c.try_cast("double").try_cast("int"), F.lit(-1))


def array_stats(xs: Column) -> Column:
    """N, mean, population deviation, least and greatest of an array; all null for an empty one."""
    n = F.size(xs)
    some = n > 0
    mean = F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    std = F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.nullif(n, F.lit(0)))
    return F.struct(F.when(some, n).alias("n"), F.when(some, mean).alias("mean"), F.when(some, std).alias("std"), F.array_min(xs).alias("min"), F.array_max(xs).alias("max"))


def hex_bigrams(packet: Column, skip: int = 24, most: int = 127) -> Column:
    """Overlapping two-byte tokens of a packet after its header, without trailing zeros; none for an all-zero rest."""
    body = F.regexp_replace(F.lower(F.hex(F.substring(packet.cast("binary"), skip + 1, 1 << 30))), "(00)+$", "")

    def tokens(h: Column) -> Column:
        n = F.floor(F.length(h) / 2).cast("int")
        return F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.substring(h, 2 * i + 1, F.lit(4)))).otherwise(F.array().cast("array<string>"))

    # The body is made once, as the only element of an array, and cut to what the tokens need.
    return F.transform(F.array(F.substring(body, 1, 2 * (most + 1))), tokens)[0]


def padded(xs: Column, length: int, fill) -> Column:
    """An array cut or filled to a length, and its mask."""
    full = F.slice(F.concat(xs, F.array_repeat(F.lit(fill), length)), 1, length)
    used = F.least(F.size(xs), F.lit(length))
    mask = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i <= used, 1).otherwise(0))
    return F.struct(full.alias("values"), mask.alias("mask"))


def byte_at(b: Column, i: Column | int) -> Column:
    """The i-th byte (from 0) as a number, null beyond the end."""
    at = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.nullif(F.hex(F.substring(b, at + 1, F.lit(1))), F.lit("")), 16, 10).cast("int")


def header_layout(packet: Column, header: int = 80, payload: int = 240) -> Column:
    """P20: header bytes and payload bytes of an IPv4 packet, each cut or zero-filled to its length, as hex.

    The header ends after the TCP data offset or the 8 bytes of UDP; other protocols are all header.
    """
    b = packet.cast("binary")
    ip = byte_at(b, 0).bitwiseAND(15) * 4
    proto = byte_at(b, 9)
    tcp = F.shiftright(byte_at(b, ip + 12), 4) * 4
    end = F.when(proto == 6, ip + F.coalesce(tcp, F.lit(20))).when(proto == 17, ip + 8).otherwise(F.octet_length(b))
    end = F.coalesce(end, F.lit(0)).cast("int")

    def fit(x: Column, n: int) -> Column:
        return F.rpad(F.substring(F.lower(F.hex(x)), 1, 2 * n), 2 * n, "0")

    return F.struct(fit(F.substring(b, F.lit(1), end), header).alias("header"), fit(F.substring(b, end + 1, F.lit(1 << 30)), payload).alias("payload"))


def ip_fields(packet: Column, payload_tokens: int = 6) -> Column:
    """IPv4 and transport header fields and 16-bit big-endian payload tokens; transport fields of a cut packet are 0."""
    b = packet.cast("binary")
    start = byte_at(b, 0).bitwiseAND(15) * 4

    def two(i: Column | int) -> Column:
        return byte_at(b, i) * 256 + byte_at(b, (F.lit(i) if isinstance(i, int) else i) + 1)

    proto = byte_at(b, 9)
    here = proto.isin(6, 17)
    data = start + F.when(proto == 6, F.coalesce(F.shiftright(byte_at(b, start + 12), 4) * 4, F.lit(20))).when(proto == 17, 8).otherwise(8)
    zero = F.lit(0)
    return F.struct(
        two(2).alias("total_length"), byte_at(b, 8).alias("ttl"), byte_at(b, 1).alias("tos"), proto.alias("proto"),
        F.coalesce(F.when(here, two(start)), zero).alias("src_port"), F.coalesce(F.when(here, two(start + 2)), zero).alias("dst_port"),
        F.coalesce(F.when(proto == 6, byte_at(b, start + 13)), zero).alias("flags"), F.coalesce(F.when(proto == 6, two(start + 14)), zero).alias("window"),
        F.transform(F.sequence(F.lit(0), F.lit(payload_tokens - 1)), lambda k: F.coalesce(two(data + 2 * k), byte_at(b, data + 2 * k) * 256, F.lit(0))).alias("payload"),
    )


def unit_bytes(packet: Column, length: int) -> Column:
    """The first bytes as shares of 255, zero-filled."""
    b = packet.cast("binary")
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(byte_at(b, i), F.lit(0)) / 255.0)


def flow_bigrams(packets: Column, skip: int = 24, most: int = 127) -> Column:
    """P18 of a flow: the first tokens over an array of its packets."""
    return F.slice(F.flatten(F.transform(packets, lambda p: hex_bigrams(p, skip, most))), 1, most)


def flow_layout(packets: Column, count: int = 5, header: int = 80, payload: int = 240) -> Column:
    """P20 of a flow: header and payload slots of its first packets as hex, zero-filled for missing ones."""

    def slots(p: Column) -> Column:
        one = header_layout(p, header, payload)
        return F.concat(one["header"], one["payload"])

    size = 2 * count * (header + payload)
    return F.rpad(F.array_join(F.transform(F.slice(packets, 1, count), slots), ""), size, "0")


def flow_image(packets: Column, count: int = 32, length: int = 128) -> Column:
    """The bytes of a flow's first packets, each cut or zero-filled to ``length``, as one binary: what ``embed`` takes."""
    rows = F.transform(F.slice(packets, 1, count), lambda p: F.rpad(F.hex(F.substring(p, 1, length)), 2 * length, "0"))
    return F.unhex(F.rpad(F.array_join(rows, ""), 2 * count * length, "0"))


def unidirectional_rows(pkts_bwd: Column) -> Column:
    """P25: how many one-way flows a flow stands for."""
    return F.when(F.coalesce(pkts_bwd, F.lit(0)) > 0, 2).otherwise(1)
