"""Scan policy (U21-U26): address guard, proofs, limits, allow list."""

from __future__ import annotations

import ipaddress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lucerna.operators.skew import join_on_hot_key

# Address ranges that must not be reached.
V4_BLOCKED = [
    ("0.0.0.0", 8, "this network"),
    ("10.0.0.0", 8, "private"),
    ("100.64.0.0", 10, "carrier nat"),
    ("127.0.0.0", 8, "loopback"),
    ("169.254.0.0", 16, "link-local"),
    ("172.16.0.0", 12, "private"),
    ("192.0.0.0", 24, "protocol assignments"),
    ("192.0.2.0", 24, "documentation"),
    ("192.88.99.0", 24, "6to4 relay"),
    ("192.168.0.0", 16, "private"),
    ("198.18.0.0", 15, "benchmarking"),
    ("198.51.100.0", 24, "documentation"),
    ("203.0.113.0", 24, "documentation"),
    ("224.0.0.0", 4, "multicast"),
    ("240.0.0.0", 4, "reserved"),
]
V6_BLOCKED = [
    ("::", 128, "unspecified"),
    ("::1", 128, "loopback"),
    ("fe80::", 10, "link-local"),
    ("fc00::", 7, "unique local"),
    ("ff00::", 8, "multicast"),
    ("2001:db8::", 32, "documentation"),
    ("64:ff9b::", 32, "nat64"),
    ("100::", 32, "discard"),
]
V4_MAPPED = "00000000000000000000ffff"  # the first 96 bits of an IPv4 address in IPv6 form
SHALLOW_PAGES = 5
PROOF_DAYS = 180


def v4_number(ip: str) -> str:
    """An IPv4 address as a number, NULL when it is not one."""
    p = f"split({ip}, '[.]')"
    octets = [f"try_cast(get({p}, {i}) as bigint)" for i in range(4)]
    ok = rf"{ip} rlike r'^\d{{1,3}}([.]\d{{1,3}}){{3}}$' and " + " and ".join(f"{o} <= 255" for o in octets)
    return f"if({ok}, {octets[0]} * 16777216 + {octets[1]} * 65536 + {octets[2]} * 256 + {octets[3]}, null)"


def v4_ranges() -> list[tuple[int, int, str]]:
    """First and last number of each blocked range, and why."""
    out = []
    for base, bits, why in V4_BLOCKED:
        lo = int.from_bytes(bytes(int(x) for x in base.split(".")), "big")
        out.append((lo, lo + (1 << (32 - bits)) - 1, why))
    return out


def host_number(host: str) -> str:
    """The IPv4 address a URL's host stands for, as a number; -1 when it must be one and is not, NULL for names.

    A host whose last label is a number is an address, as URLs are read: up to four parts, each decimal, octal (leading 0)
    or hexadecimal (0x), the last of which fills all bytes that are left. ``127.1``, ``0x7f.1`` and ``2130706433`` are 127.0.0.1.
    """
    part = (
        "case when p rlike '^0x[0-9a-f]*$' then if(char_length(p) > 18, 1e30, cast(coalesce(conv(nullif(substring(p, 3), ''), 16, 10), '0') as double))"
        " when p rlike '^0[0-7]+$' then if(char_length(p) > 21, 1e30, cast(conv(p, 8, 10) as double)) when p rlike '^(0|[1-9][0-9]*)$' then cast(p as double) end"
    )
    value = (
        "if(size(n) > 4 or exists(n, x -> x is null) or exists(slice(n, 1, size(n) - 1), x -> x > 255) or element_at(n, -1) >= pow(256, 5 - size(n)), -1L,"
        " cast(element_at(n, -1) as bigint) + cast(aggregate(transform(slice(n, 1, size(n) - 1), (x, i) -> x * pow(256, 3 - i)), 0D, (t, x) -> t + x) as bigint))"
    )
    labels = f"split(regexp_replace(lower({host}), '[.]$', ''), '[.]')"
    return f"get(transform(array({labels}), l -> if(instr({host}, ':') = 0 and element_at(l, -1) rlike '^([0-9]+|0x[0-9a-f]*)$', get(transform(array(transform(l, p -> {part})), n -> {value}), 0), null)), 0)"


def v6_number(ip: str) -> str:
    """A lower-case IPv6 address as 32 hexadecimal digits, so that addresses compare like numbers; NULL when it is not one.

    Eight groups, or fewer with one gap; the last two may be written as an IPv4 address.
    """
    group = "[0-9a-f]{1,4}"
    some = f"({group}(:{group})*)?"
    tail = rf"regexp_extract(s, r'^.*:(\d+[.]\d+[.]\d+[.]\d+)$', 1)"
    plain = (
        f"get(transform(array({v4_number('t')}), q -> if(t = '', s, concat(left(s, char_length(s) - char_length(t)), lower(hex(shiftright(q, 16))), ':', lower(hex(q & 65535)))))"
        ", 0)"
    )
    ok = f"(s rlike '^({group}:){{7}}{group}$' or (s rlike '^{some}::{some}$' and size(filter(split(s, ':'), g -> g <> '')) <= 7))"
    digits = "array_join(transform(filter(split(coalesce(get(split(s, '::'), {i}), ''), ':'), g -> g <> ''), g -> lpad(g, 4, '0')), '')"
    whole = f"get(transform(array(struct({digits.format(i=0)} as a, {digits.format(i=1)} as b)), h -> concat(h.a, repeat('0', 32 - char_length(h.a) - char_length(h.b)), h.b)), 0)"
    without_tail = f"get(transform(array({tail}), t -> {plain}), 0)"
    return f"get(transform(transform(array({ip}), s -> {without_tail}), s -> if({ok}, {whole}, null)), 0)"


def v6_ranges() -> list[tuple[str, str, str]]:
    """First and last address of each blocked prefix as 32 hexadecimal digits, and why."""
    out = []
    for base, bits, why in V6_BLOCKED:
        lo = int(ipaddress.IPv6Address(base)) >> (128 - bits) << (128 - bits)
        out.append((f"{lo:032x}", f"{lo + (1 << (128 - bits)) - 1:032x}", why))
    return out


def v6_reason(number: str) -> str:
    """Why an address of 32 digits is blocked, NULL when it is public."""
    return "case " + " ".join(f"when {number} between '{lo}' and '{hi}' then '{why}'" for lo, hi, why in v6_ranges()) + " end"


def v4_reason(number: str) -> str:
    return "case " + " ".join(f"when {number} between {lo} and {hi} then '{why}'" for lo, hi, why in v4_ranges()) + " end"


def mapped_v4(number: str) -> str:
    """The IPv4 number inside an IPv6 one of 32 digits, NULL where it has none."""
    return f"if({number} like '{V4_MAPPED}%', cast(conv(right({number}, 8), 16, 10) as bigint), null)"


def literal_reason(host: str) -> str:
    """Why a host that is itself an address is blocked, however it is written; NULL for names and public addresses."""
    n4, n6 = "x.n4", "x.n6"
    judged = (
        f"case when {n4} < 0 then 'invalid' when {n4} is not null then {v4_reason(n4)} when instr(x.h, ':') = 0 then null when {n6} is null then 'not an address'"
        f" when {mapped_v4(n6)} is not null then {v4_reason(mapped_v4(n6))} else {v6_reason(n6)} end"
    )
    return f"get(transform(array(named_struct('h', {host}, 'n4', {host_number(host)}, 'n6', {v6_number(host)})), x -> {judged}), 0)"


def ranges_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(v4_ranges(), "lo bigint, hi bigint, range_reason string")


def guard_addresses(resolved: DataFrame) -> DataFrame:
    """U21 per address: ``host, address`` -> the reason it is blocked, NULL when it is public.

    A range join against fifteen fixed rows; an address lies in at most one range, so rows never multiply.
    """
    raw = r"regexp_replace(lower(trim(address)), r'^\[|\]$', '')"
    df = resolved.withColumn("_ip", F.expr(raw)).withColumn("_v6", F.expr(v6_number("_ip"))).withColumn("_n", F.expr(f"coalesce({v4_number('_ip')}, {mapped_v4('_v6')})"))
    hit = df.join(F.broadcast(ranges_df(resolved.sparkSession)), F.expr("_n between lo and hi"), "left")
    judged = f"case when _n is not null then range_reason when _v6 is null then 'not an address' else {v6_reason('_v6')} end"
    return hit.withColumn("blocked", F.expr(judged)).drop("_ip", "_v6", "_n", "lo", "hi", "range_reason")


def guard_hosts(resolved: DataFrame) -> DataFrame:
    """A host passes only when every address it resolves to passes."""
    return guard_addresses(resolved).groupBy("host").agg(
        F.expr("bool_and(blocked is null)").alias("allowed"), F.expr("min(blocked)").alias("blocked"), F.count(F.lit(1)).alias("addresses")
    )


def _suffixes(host: str) -> str:
    labels = f"split(regexp_replace(lower(trim({host})), '[.]$', ''), '[.]')"
    return f"transform({labels}, (l, i) -> array_join(slice({labels}, i + 1, size({labels}) - i), '.'))"


def covering_proofs(hosts: DataFrame, proofs: DataFrame, keys: list[str]) -> DataFrame:
    """Proofs whose domain equals the host or a dot-bounded suffix of it.

    The host is cut into its few suffixes and joined by equality, so ``example.org.evil.test`` never matches
    and no ``endswith`` pair test is needed.
    """
    cut = hosts.select("*", F.explode(F.expr(_suffixes("host"))).alias("suffix")).where("suffix <> ''")
    p = proofs.withColumn("suffix", F.expr("regexp_replace(lower(trim(domain)), '[.]$', '')"))
    return cut.join(p, "suffix").drop("suffix")


def domain_standing(hosts: DataFrame, proofs: DataFrame, keys: list[str], now: str) -> DataFrame:
    """The first covering, dated proof by creation decides; older than 180 days it is stale.

    A domain keeps its first dated proof and every distinct host meets the few of its suffixes, so no row meets all proofs
    of a domain; rows then take their host's.
    """
    dated = proofs.where("verified_at is not null").groupBy("domain").agg(F.min(F.struct("created_at", "verified_at")).alias("_first")).select("domain", "_first.*")
    names = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("_rows"))
    first = covering_proofs(names, dated, ["host"]).groupBy("host", "_rows").agg(F.expr("min_by(struct(domain, verified_at), struct(created_at, domain))").alias("p"))
    # a host may hold a large share of the rows
    out = join_on_hot_key(hosts, first, ["host"], "_rows", keys[0], "left")
    fresh = f"p.verified_at >= {now} - interval {PROOF_DAYS} days"
    return out.selectExpr(*hosts.columns, f"coalesce({fresh}, false) as verified", f"if({fresh}, null, p.verified_at) as stale_since", "p.domain as matched_domain")


def page_limit(verified: str, requested: str) -> str:
    """Pages a request may cover."""
    return f"if({verified} or {requested} <= {SHALLOW_PAGES}, {requested}, {SHALLOW_PAGES})"


def capped_reason(verified: str, requested: str) -> str:
    return f"if({verified} or {requested} <= {SHALLOW_PAGES}, null, 'ownership not verified; first {SHALLOW_PAGES} pages only')"


def allow_listed(hosts: DataFrame, allowed: DataFrame, keys: list[str]) -> DataFrame:
    """Hosts covered by an allow list (``domain``); an empty list is handled by the caller."""
    names = hosts.select("host").distinct()
    hit = covering_proofs(names, allowed.distinct(), ["host"]).groupBy("host").agg(F.lit(1).alias("_listed"))
    rows = hosts.groupBy("host").agg(F.count(F.lit(1)).alias("_rows"))
    return join_on_hot_key(hosts, hit.join(rows, "host"), ["host"], "_rows", keys[0], "inner").select(*hosts.columns)
