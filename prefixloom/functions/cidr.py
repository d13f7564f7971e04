"""Addresses and blocks.  IPv4 is column arithmetic on longs; IPv6 stays in binary, is masked and printed by column functions on its
hexadecimal digits, and only parsed, bounded and emitted in Arrow-batched functions.

Ranges are half open, [lo, end).  For IPv6 both ends are 17-byte big-endian binaries, so that 2**128 exists
and Spark's unsigned byte order is the order of addresses.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

V4_TOP = 1 << 32
# types as objects: this module is also imported where there is no session that could parse their names
PARSED = T.StructType().add("fam", T.ByteType()).add("pfx", T.ShortType()).add("ip", T.BinaryType())
BOUNDS = T.StructType().add("lo", T.BinaryType()).add("end", T.BinaryType())
BLOCKS = T.ArrayType(T.StructType().add("ip", T.BinaryType()).add("pfx", T.ShortType()))
_DEC = re.compile(r"[0-9]{1,3}\Z")
_HEXTET = re.compile(r"[0-9a-fA-F]{1,4}\Z")
#: White space as the text form trims it: ASCII, no-break and Unicode spaces, line separators and the BOM.
TRIM = " \t\n\v\f\r                 　﻿"


# IPv4, as columns


def shl(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n.cast("int"))


def shr(x: Column, n: Column) -> Column:
    return F.call_function("shiftright", x, n.cast("int"))


def v4_num(ip: Column) -> Column:
    return F.conv(F.hex(ip), 16, 10).cast("long")


def v4_bytes(num: Column) -> Column:
    return F.unhex(F.lpad(F.hex(num), 8, "0"))


def v4_text(num: Column) -> Column:
    return F.concat_ws(".", *(F.shiftright(num, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)))


def size_of(pfx: Column, bits: int = 32) -> Column:
    """Addresses in a block: 2**(bits - pfx), as a long (IPv4)."""
    return shl(F.lit(1).cast("long"), F.lit(bits) - pfx)


def v4_lo(num: Column, pfx: Column) -> Column:
    return num - F.pmod(num, size_of(pfx))


def v4_end(num: Column, pfx: Column) -> Column:
    return v4_lo(num, pfx) + size_of(pfx)


def is_valid(fam: Column, pfx: Column) -> Column:
    return ((fam == 4) & (pfx <= 32)) | ((fam == 6) & (pfx <= 128))


def parse_v4(text: Column) -> Column:
    """IPv4 address or block as struct(num, pfx), null if it is none; leading zeros are allowed."""
    shape = r"^\d{1,3}(?:\.\d{1,3}){3}(?:/\d{1,3})?$"
    part = F.split(F.when(text.rlike(shape), text), "[./]")
    octets = [F.get(part, F.lit(i)).try_cast("int") for i in range(4)]
    pfx = F.coalesce(F.get(part, F.lit(4)).try_cast("int"), F.lit(32))
    num = sum((o.cast("long") * (1 << s) for o, s in zip(octets, (24, 16, 8, 0), strict=True)), F.lit(0).cast("long"))
    fits = F.greatest(*octets) <= 255  # null where the shape isn't a block's
    return F.when(fits & (pfx <= 32), F.struct(num.alias("num"), pfx.alias("pfx")))


def octet_prefix(num: Column, query: str) -> Column:
    """Does the dotted text begin as the query does?  Earlier parts are whole octets, the last is the beginning of one, and a
    trailing dot ends it.  An empty part elsewhere matches nothing; so does a fifth octet."""
    parts = query.split(".")
    if any(not p for p in parts[:-1]) or (len(parts) == 5 and parts[-1]) or len(parts) > 5:
        return F.lit(False)
    if len(parts) == 5:
        return v4_text(num) == query[:-1]
    if len(parts) == 4 and parts[-1]:
        head = ".".join(parts[:-1]) + "."
        return v4_text(num).startswith(head + parts[-1])
    return v4_text(num).startswith(query)


def block_text(fam: Column, pfx: Column) -> Column:
    """host, N addrs, 2^N addrs, or why an entry is invalid."""
    bits = F.when(fam == 4, 32).otherwise(128) - pfx
    plain = F.concat(shl(F.lit(1).cast("long"), F.least(bits, F.lit(30))).cast("string"), F.lit(" addrs"))
    valid = F.when(bits == 0, F.lit("host")).when(bits <= 20, plain).otherwise(F.concat(F.lit("2^"), bits.cast("string"), F.lit(" addrs")))
    return F.when(is_valid(fam, pfx), valid).when(fam == 0, F.lit("bad address")).otherwise(F.lit("bad prefix"))


# the closed form of a minimal cover of [lo, end) by aligned blocks


def _split(lo: Column, end: Column) -> tuple[Column, Column, Column]:
    """(middle, left, right): the multiple of the highest differing bit's power between both ends, and how far either
    side reaches; every set bit of left and right is one block."""
    top = F.length(F.bin(lo.bitwiseXOR(end))) - 1
    middle = shl(shr(end, top), top)
    return middle, middle - lo, end - middle


def block_count(lo: Column, end: Column) -> Column:
    _, left, right = _split(lo, end)
    return (F.bit_count(left) + F.bit_count(right)).cast("long")


def blocks(lo: Column, end: Column) -> Column:
    """array<struct<num, pfx>> of the minimal aligned IPv4 blocks of [lo, end), in order."""
    middle, left, right = _split(lo, end)
    one = F.lit(1).cast("long")
    bit = lambda x, i: shr(x, i).bitwiseAND(1) == 1
    ups = F.filter(F.sequence(F.lit(0), F.lit(32)), lambda i: bit(left, i))
    downs = F.filter(F.sequence(F.lit(32), F.lit(0), F.lit(-1)), lambda i: bit(right, i))
    up = F.transform(ups, lambda i: F.struct((lo + left.bitwiseAND(shl(one, i) - 1)).alias("num"), (F.lit(32) - i).alias("pfx")))
    down = F.transform(downs, lambda i: F.struct((middle + shl(shr(right, i + 1), i + 1)).alias("num"), (F.lit(32) - i).alias("pfx")))
    return F.concat(up, down)


# IPv6, in Arrow batches


def v6_string(ip: bytes) -> str:
    """Lower-case hextets; the first longest run of two or more zero hextets is `::`; no dotted tail."""
    words = [int.from_bytes(ip[i : i + 2], "big") for i in range(0, 16, 2)]
    best, best_at, run = 1, -1, 0
    for i, w in enumerate(words):
        run = 0 if w else run + 1
        if run > best:
            best, best_at = run, i - run + 1
    text = [f"{w:x}" for w in words]
    if best_at < 0:
        return ":".join(text)
    return ":".join(text[:best_at]) + "::" + ":".join(text[best_at + best :])


def v4_parsed(text: str) -> bytes | None:
    parts = text.split(".")
    if len(parts) != 4 or not all(_DEC.match(p) and int(p) < 256 for p in parts):
        return None
    return bytes(map(int, parts))


def v6_parsed(text: str) -> bytes | None:
    """One `::` for one group or more, hextets of one to four digits, a dotted tail at the end only."""
    halves = text.split("::")
    if len(halves) > 2 or ":::" in text:
        return None
    out = []
    for k, half in enumerate(halves):
        parts = half.split(":") if half else []
        raw = b""
        for i, p in enumerate(parts):
            if "." in p and k == len(halves) - 1 and i == len(parts) - 1:
                tail = v4_parsed(p)
                if tail is None:
                    return None
                raw += tail
            elif _HEXTET.match(p):
                raw += int(p, 16).to_bytes(2, "big")
            else:
                return None
        out.append(raw)
    if len(halves) == 1:
        return out[0] if len(out[0]) == 16 else None
    gap = 16 - len(out[0]) - len(out[1])
    return out[0] + bytes(gap) + out[1] if gap >= 2 else None


def parsed(text: str | None) -> tuple[int, int, bytes] | None:
    """(family, prefix, address) of an address or block, None if it is neither."""
    if text is None:
        return None
    addr, slash, tail = text.strip(TRIM).partition("/")
    fam, ip = (6, v6_parsed(addr)) if ":" in addr else (4, v4_parsed(addr))
    top = 32 if fam == 4 else 128
    if ip is None or (slash and not _DEC.match(tail)):
        return None
    pfx = int(tail) if slash else top
    return (fam, pfx, ip) if pfx <= top else None


def v6_bounds(ip: bytes, pfx: int) -> tuple[bytes, bytes]:
    size = 1 << (128 - pfx)
    lo = int.from_bytes(ip, "big") // size * size
    return lo.to_bytes(17, "big"), (lo + size).to_bytes(17, "big")


def cover(lo: int, end: int, bits: int) -> list[tuple[int, int]]:
    """Minimal aligned blocks (start, prefix) of [lo, end), by the closed form above."""
    if lo >= end:
        return []
    top = (lo ^ end).bit_length() - 1
    middle = end >> top << top
    left, right = middle - lo, end - middle
    out = [(lo + (left & ((1 << i) - 1)), bits - i) for i in range(bits + 1) if left >> i & 1]
    return out + [(middle + (right >> (i + 1) << (i + 1)), bits - i) for i in range(bits, -1, -1) if right >> i & 1]


@F.pandas_udf(PARSED)
def parse_cidr(text: pd.Series) -> pd.DataFrame:
    rows = [parsed(t) or (None, None, None) for t in text]
    return pd.DataFrame(rows, columns=["fam", "pfx", "ip"]).astype({"fam": "Int8", "pfx": "Int16"})


def v6_text(ip: Column) -> Column:
    """v6_string() as columns; null for an address of another length."""
    groups = F.regexp_replace(F.lower(F.hex(ip)), "(.{4})(?=.)", "$1:")
    padded = F.concat(F.lit(":"), F.regexp_replace(groups, "(^|:)0{1,3}(?=[0-9a-f])", "$1"), F.lit(":"))

    def shortened(p: Column) -> Column:
        runs = F.transform(F.regexp_extract_all(p, F.lit("((?::0){2,})(?=:)")), lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r")))
        best = F.array_max(runs)  # the longest, the first of those
        at = F.instr(p, F.concat(best["r"], F.lit(":")))
        head, tail = F.substr(p, F.lit(2), at - 2), F.substr(p, at + best["n"] + 1, F.length(p) - at - best["n"] - 1)
        return F.when(F.size(runs) > 0, F.concat(F.when(at > 1, head).otherwise(""), F.lit("::"), tail)).otherwise(F.substr(p, F.lit(2), F.length(p) - 2))

    # an array of one binds the text, which would else be written out at every use
    return F.when(F.length(ip) == 16, F.get(F.transform(F.array(padded), shortened), F.lit(0)))


def v6_net(ip: Column, pfx: Column) -> Column:
    """The address with the bits behind the prefix cleared."""
    digits, whole, part = F.hex(ip), F.floor(pfx / 4).cast("int"), pfx % 4
    head = F.substr(digits, F.lit(1), whole)
    nibble = F.conv(F.substr(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    step = F.when(part == 1, 8).when(part == 2, 4).otherwise(2)
    kept = F.when(part == 0, head).otherwise(F.concat(head, F.hex(nibble - nibble % step)))
    return F.when((F.length(ip) == 16) & (pfx <= 128), F.unhex(F.rpad(kept, 32, "0")))


@F.pandas_udf(BOUNDS)
def v6_range(ip: pd.Series, pfx: pd.Series) -> pd.DataFrame:
    ok = [v6_bounds(a, int(p)) if a is not None and len(a) == 16 and p <= 128 else (None, None) for a, p in zip(ip, pfx, strict=True)]
    return pd.DataFrame(ok, columns=["lo", "end"])


@F.pandas_udf(BLOCKS)
def v6_blocks(lo: pd.Series, end: pd.Series) -> pd.Series:
    def one(a: bytes, b: bytes) -> Iterable[dict]:
        return [{"ip": s.to_bytes(16, "big"), "pfx": p} for s, p in cover(int.from_bytes(a, "big"), int.from_bytes(b, "big"), 128)]

    return pd.Series([one(a, b) for a, b in zip(lo, end, strict=True)], dtype=object)


@F.pandas_udf(T.LongType())
def v6_block_count(lo: pd.Series, end: pd.Series) -> pd.Series:
    return pd.Series([len(cover(int.from_bytes(a, "big"), int.from_bytes(b, "big"), 128)) for a, b in zip(lo, end, strict=True)])


def entry_text(fam: Column, pfx: Column, ip: Column) -> Column:
    """address/prefix; an address of another length prints its bytes, and one without bytes says so."""
    raw = F.concat(F.lit("0x"), F.lower(F.array_join(F.regexp_extract_all(F.hex(ip), F.lit("(..)")), ":")))
    bad = F.when(ip.isNull() | (F.length(ip) == 0), F.lit("<invalid>")).otherwise(raw)
    addr = F.when(fam == 4, v4_text(v4_num(F.when(fam == 4, ip)))).when(fam == 6, v6_text(F.when(fam == 6, ip))).otherwise(bad)
    return F.concat(addr, F.lit("/"), pfx.cast("string"))


def entry_key(fam: Column, pfx: Column, ip: Column) -> Column:
    """Normalised key: valid entries by network and prefix, others by their very bytes."""
    v4 = F.when((fam == 4) & (pfx <= 32), v4_lo(v4_num(F.when(fam == 4, ip)), F.least(pfx, F.lit(32))))
    v6 = F.when((fam == 6) & (pfx <= 128), v6_net(ip, pfx))
    net = F.when(v4.isNotNull(), v4_bytes(v4)).when(v6.isNotNull(), v6).otherwise(F.coalesce(ip, F.lit(b"")))
    return F.struct(fam.alias("fam"), pfx.alias("pfx"), net.alias("net"))
