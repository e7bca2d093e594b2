"""Addresses as columns against the standard library."""

import ipaddress
import random

from pagequarry.operators import hosts


def addresses() -> list[str]:
    draw = random.Random(9)
    leads = ["2001:", "2001:1:", "2001:3:", "2001:4:112:", "2001:20:", "2001:db8:", "2002:", "2606:4700:", "fe80:", "fec0:", "fd00:", "ff02:", "::", "::ffff:", "64:ff9b:", ""]
    out = ["::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2:3:4:5:6:7:8", "2001:1::1", "2001:1::2", "2001:1::3",
           "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::ffff:808:808", "2606:4700::1.2.3.4", "2606:4700::1.2.3", "2606:4700::01.2.3.4", "fe80::1%eth0", "2606:4700::1%x",
           "2606:4700::1%", "2606:4700::12345", "2606:4700::g", "2606:4700::1:", ":2606:4700::1", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "3ffe::1", "::%1", "1:"]
    for _ in range(1500):
        groups = [f"{draw.getrandbits(draw.choice([1, 4, 16])):x}" for _ in range(draw.randrange(0, 9))]
        if len(groups) > 1 and draw.random() < 0.6:
            groups[draw.randrange(len(groups))] = ""
        out.append(draw.choice(leads) + ":".join(groups))
    out += [str(ipaddress.IPv6Address(draw.getrandbits(128))) for _ in range(500)]
    out += [str(ipaddress.IPv6Address(0x2 << 124 | draw.getrandbits(125))) for _ in range(500)]
    return sorted({a for a in out if ":" in a})


def plain(text: str) -> tuple[int | None, bool]:
    try:
        ip = ipaddress.IPv6Address(text)
    except ValueError:
        return None, False
    refused = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified
    # Documentation prefix of 2024, which older standard libraries don't know.
    return int(ip), not refused and ip not in ipaddress.IPv6Network("3fff::/20")


def test_ipv6_against_the_standard_library(spark):
    rows = spark.createDataFrame([(a, a) for a in addresses()], "host string, ip string")
    parsed = {r.ip: r.n for r in rows.select("ip", hosts.ipv6_numbers(hosts.F.col("ip")).alias("n")).collect()}
    numbers = {ip: None if n is None else (n.high % (1 << 64)) << 64 | n.low % (1 << 64) for ip, n in parsed.items()}
    assert numbers == {a: plain(a)[0] for a in numbers}
    policy = hosts.address_policy(rows.select("host"), rows)
    got = {r.host: r.allowed for r in policy.collect()}
    assert got == {a: plain(a)[1] for a in got} and 100 < sum(got.values()) < len(got) - 100
    assert "Python" not in policy._jdf.queryExecution().executedPlan().toString()


def test_null_addresses_refuse_their_host(spark):
    rows = spark.createDataFrame([("a", None), ("a", "1.1.1.1"), ("b", "2606:4700::1")], "host string, ip string")
    got = {r.host: (r.addresses, r.allowed) for r in hosts.address_policy(rows.select("host").distinct(), rows).collect()}
    assert got == {"a": (2, False), "b": (1, True)}
