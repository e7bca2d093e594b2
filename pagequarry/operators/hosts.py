"""Which hosts and addresses a crawl may contact, and registrable domains."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.binding import let
from pagequarry.functions.urls import hostname_of, scheme_of

# Names that never count as public hosts, and address ranges that
# are private, local, reserved or multicast.
BLOCKED_HOSTNAMES = (
    "localhost", "localhost.localdomain", "localhost4", "localhost6",
    "metadata.google.internal", "metadata.azure.internal", "metadata.internal",
    "instance-data", "instance-data.ec2.internal",
)
PRIVATE_SUFFIXES = (".internal", ".local", ".localhost", ".lan", ".home.arpa")
PRIVATE_NAMES = ("local", "internal", "home", "lan", "corp", "intranet", "office")
REFUSED_IPV4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)
PUBLIC_EXCEPTIONS = ("192.0.0.9", "192.0.0.10")
REFUSED_IPV6 = (
    "::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "4000::/3",
    "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fc00::/7", "fe00::/9", "fe80::/10", "ff00::/8",
)
PUBLIC_EXCEPTIONS_IPV6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")


def registrable_domains(hosts: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """Adds ``domain`` (registrable domain) and ``name`` (its own label) to distinct hosts.

    ``suffixes`` is a public-suffix table with one rule per row in column ``suffix``;
    ``*.`` and ``!`` rules are understood. A host that no rule covers, or that is
    itself a suffix, is returned whole and has no name.
    """
    labels = F.split(F.col(host), r"\.")
    tails = F.transform(
        F.sequence(F.lit(1), F.size("labels")),
        lambda i: F.struct(i.alias("i"), F.array_join(F.slice("labels", i, F.size("labels") - i + 1), ".").alias("tail")),
    )
    distinct = hosts.select(host).distinct()
    exploded = distinct.select(host, labels.alias("labels")).select(host, F.size("labels").alias("n"), F.explode(tails).alias("t"))
    # The form each tail would have in the rule table: itself, or '*' for its first label.
    forms = exploded.select(
        host, "n", F.col("t.i").alias("i"),
        F.explode(F.array(
            F.struct(F.lit("plain").alias("kind"), F.col("t.tail").alias("suffix")),
            F.struct(F.lit("wild").alias("kind"), F.concat(F.lit("*."), F.regexp_replace("t.tail", r"^[^.]+\.?", "")).alias("suffix")),
            F.struct(F.lit("exception").alias("kind"), F.concat(F.lit("!"), "t.tail").alias("suffix")),
        )).alias("f"),
    ).select(host, "n", "i", "f.*")
    matched = forms.join(suffixes.select("suffix").distinct(), "suffix")
    # Labels in the public suffix: an exception rule drops its first label and beats the others.
    length = F.col("n") - F.col("i") + 1 - (F.col("kind") == "exception").cast("int")
    best = matched.groupBy(host, "n").agg(
        F.max_by(length, F.struct((F.col("kind") == "exception").alias("e"), length.alias("l"))).alias("public")
    )
    joined = distinct.join(best, host, "left")
    keep = F.col("public") + 1
    parts = F.split(F.col(host), r"\.")
    has_name = F.col("public").isNotNull() & (F.col("public") < F.col("n"))
    return joined.select(
        host,
        F.when(has_name, F.array_join(F.slice(parts, F.col("n") - keep + 1, keep), ".")).otherwise(F.col(host)).alias("domain"),
        F.when(has_name, F.get(parts, F.col("n") - keep)).otherwise(
            F.when(F.col("public").isNull(), F.element_at(parts, -1))
        ).alias("name"),
    )


def _host_refusal(host: Column, name: Column) -> Column:
    ends_private = F.lit(False)
    for suffix in PRIVATE_SUFFIXES:
        ends_private = ends_private | F.endswith(host, F.lit(suffix))
    return (
        F.when(host == "", "no hostname")
        .when(host.isin(*BLOCKED_HOSTNAMES), "blocked name")
        .when(~F.contains(host, F.lit(".")), "single label")
        .when(F.coalesce(name, F.lit("")) == "", "no domain")
        .when(ends_private, "private suffix")
        .when(name.isin(*PRIVATE_NAMES), "private name")
    )


def target_policy(urls: DataFrame, suffixes: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``allowed`` and ``reason`` to URLs, judged by scheme and host name."""
    staged = urls.withColumn("host", hostname_of(F.col(url)))
    known = registrable_domains(staged.where(F.col("host") != ""), suffixes)
    reason = F.when(~scheme_of(F.col(url)).isin("http", "https"), "scheme").otherwise(_host_refusal(F.col("host"), F.col("name")))
    return staged.join(known, "host", "left").withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull()).select(
        *urls.columns, "host", "allowed", "reason"
    )


def ipv4_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null for anything else."""
    def number(parts: Column) -> Column:
        value = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.try_cast("bigint"))
        in_range = F.forall(parts, lambda p: p.rlike(r"^(0|[1-9][0-9]{0,2})$") & (p.try_cast("int") <= 255))
        return F.when((F.size(parts) == 4) & in_range, value)

    return let(F.split(ip, r"\."), number)


def _half(text: Column) -> Column:
    """The groups of an address before or after its ``::``."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))


def ipv6_numbers(ip: Column) -> Column:
    """An IPv6 address, perhaps with a zone or a dotted end, as struct (high, low) of 64 bits each; null for anything else."""
    def number(groups: Column) -> Column:
        return F.aggregate(groups, F.lit(0).cast("bigint"), lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")))

    def of_groups(groups: Column) -> Column:
        valid = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
        return F.when(valid, F.struct(number(F.slice(groups, 1, 4)).alias("high"), number(F.slice(groups, 5, 4)).alias("low")))

    def of_halves(halves: Column) -> Column:
        def joined(sides: Column) -> Column:
            left, right = sides["left"], sides["right"]
            zeros = F.array_repeat(F.lit("0"), F.lit(8) - F.size(left) - F.size(right))
            # Two colons stand for one group at least.
            return F.when(F.size(left) + F.size(right) < 8, F.concat(left, zeros, right))

        two = let(F.struct(_half(F.get(halves, F.lit(0))).alias("left"), _half(F.get(halves, F.lit(1))).alias("right")), joined)
        return let(F.when(F.size(halves) == 1, F.split(F.get(halves, F.lit(0)), ":")).when(F.size(halves) == 2, two), of_groups)

    def undotted(text: Column) -> Column:
        tail = F.substring_index(text, ":", -1)
        start = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
        hexed = let(ipv4_number(tail), lambda n: F.concat(start, F.hex(F.shiftright(n, 16)), F.lit(":"), F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(F.contains(tail, F.lit(".")), hexed).otherwise(text)

    return let(undotted(F.regexp_replace(ip, "%[^%]+$", "")), lambda text: let(F.split(text, "::"), of_halves))


def _signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


def _within(numbers: Column, network: str) -> Column:
    net = ipaddress.IPv6Network(network)
    high, low = int(net.network_address) >> 64, int(net.network_address) & ((1 << 64) - 1)
    if net.prefixlen == 128:
        return (numbers["high"] == _signed(high)) & (numbers["low"] == _signed(low))
    rest = 64 - net.prefixlen
    return F.shiftrightunsigned(numbers["high"], rest) == F.lit(high >> rest)


def _ipv6_is_public(numbers: Column) -> Column:
    """By the leading bits; addresses that wrap IPv4 ones are reserved."""
    refused, excepted = F.lit(False), F.lit(False)
    for network in REFUSED_IPV6:
        refused = refused | _within(numbers, network)
    for network in PUBLIC_EXCEPTIONS_IPV6:
        excepted = excepted | _within(numbers, network)
    return F.coalesce(~refused | excepted, F.lit(False))


def _ipv4_is_public(number: Column) -> Column:
    refused = F.lit(False)
    for network in map(ipaddress.ip_network, REFUSED_IPV4):
        refused = refused | number.between(int(network.network_address), int(network.broadcast_address))
    exception = number.isin(*[int(ipaddress.ip_address(a)) for a in PUBLIC_EXCEPTIONS])
    return F.coalesce(~refused | exception, F.lit(False))


def address_policy(hosts: DataFrame, resolved: DataFrame, host: str = "host") -> DataFrame:
    """Whether every address of a host is public; a host without addresses is refused. All of it is arithmetic on columns."""
    ip = F.col("ip")
    public = F.when(F.contains(ip, F.lit(":")), let(ipv6_numbers(ip), _ipv6_is_public)).otherwise(let(ipv4_number(ip), _ipv4_is_public))
    per_host = resolved.select(host, F.coalesce(public, F.lit(False)).alias("public")).groupBy(host).agg(
        F.bool_and("public").alias("public"), F.count(F.lit(1)).alias("addresses"))
    return hosts.join(per_host, host, "left").select(
        *hosts.columns, F.coalesce("addresses", F.lit(0)).cast("bigint").alias("addresses"),
        F.coalesce("public", F.lit(False)).alias("allowed"),
    )
