"""Intake, domains and lexical rules on small tables."""

import base64
import hashlib
import itertools
import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lurelens.functions.url import resolve
from lurelens.operators import domains, intake, lexical
from lurelens.operators.overrides import with_domain_key, with_url_key
from lurelens.sources.brands import brands
from lurelens.sources.suffixes import parse_rules, suffix_rules


def rows(spark, values, schema="target_id long, input_url string"):
    return spark.createDataFrame(list(enumerate(values)), schema)


def test_refang_and_idempotence(spark):
    cases = {
        "hxxps://evil[.]com": "https://evil.com", "HXXP://evil(.)com": "http://evil.com", "http[:]//a{.}b": "http://a.b",
        "hxxp[://]x[.]y": "http://x.y", "user[at]x.y": "user@x.y", "wxw.a.b": "www.a.b", "h t t p : / / a dot b slash c": "http://a.b/c",
        "  https://ok.example/ ": "https://ok.example/", "https://ok.example/hxxpfoo": "https://ok.example/hxxpfoo",
    }
    once = intake.with_refanged(rows(spark, cases), "input_url", "once")
    twice = intake.with_refanged(once, "once", "twice").orderBy("target_id").collect()
    assert [r.once for r in twice] == list(cases.values())
    assert all(r.once == r.twice for r in twice)


def test_canonical_forms(spark):
    cases = {
        "HTTPS://Example.COM": "https://example.com/",
        "http://h.com:80/a": "http://h.com/a",
        "http://h.com:8080/a": "http://h.com:8080/a",
        "https://u:p@h.com/p;x=1?b=2&a=1#f": "https://h.com/p?a=1&b=2#f",
        "https://h.com/%2561": "https://h.com/a",
        "https://h.com/?b=1&a=2&b=0": "https://h.com/?a=2&b=1&b=0",
        "https://h.com/?q=a+b%2Fc": "https://h.com/?q=a%20b%2Fc",
        "https://h.com/%zz+": "https://h.com/%zz+",
        "mailto:a@b.c": "mailto:a@b.c",
        "https://xn--mnchen-3ya.de/": "https://münchen.de/",
        "http://h.com:99999/": None, "http://[::1/": None, "http://h.com:x/": None,
    }
    out = intake.with_canonical(rows(spark, cases), "input_url").orderBy("target_id").collect()
    assert [r.canonical_url for r in out] == list(cases.values())
    assert all((r.url_error is None) == (r.canonical_url is not None) for r in out)
    assert out[0].url_hash == hashlib.sha256(b"https://example.com/").hexdigest()


def test_unwrap_hops_payloads_and_rejects(spark):
    def nest(n, url="http://end.com/"):
        from urllib.parse import quote
        for i in range(n):
            url = f"https://r{i}.com/?next={quote(url, safe='')}"
        return url

    email = base64.b64encode(b"someone@mail.example.com").decode().rstrip("=")
    link = base64.b64encode(b" https://inner.example.com/x").decode()
    urls = [
        nest(1), nest(5), nest(6), "https://mimecast.com/x", "https://a.com/?next=/local&u=https://b.com/",
        f"https://a.com/?e={email}&e2={email}", f"https://a.com/#{link}", "https://a.com/?x=short", "http://bad:port/",
    ]
    done = intake.intake(rows(spark, urls))
    hops = {r.target_id: r.n for r in done.unwrap_steps.groupBy("target_id").agg(F.count("*").alias("n")).collect()}
    assert hops == {0: 1, 1: 5, 2: 5, 4: 1}
    found = {(r.target_id, r.kind, r.decoded) for r in done.payloads.collect()}
    assert found == {(5, "email", "someone@mail.example.com"), (6, "url", "https://inner.example.com/x")}
    assert [(r.target_id, r.reason) for r in done.rejects.collect()] == [(8, "invalid port")]
    assert done.urls.count() == len(urls) - 1


def test_relative_references(spark):
    base = "http://h.com/a/b/c?q=1#f"
    refs = ["", "d", "./d", "../d", "../../../d", "/x/../y", "?z=1", "#g", "//o.com/p", "https://o.com/", "d/", ".", "..", "/a/./b/"]
    df = spark.createDataFrame([(i, base, r) for i, r in enumerate(refs)], "i int, base string, ref string")
    got = [r[0] for r in df.orderBy("i").select(F.expr(resolve("base", "ref"))).collect()]
    assert got[1:] == [urljoin(base, r) for r in refs[1:]]


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            best = min(best, d[i - 2, j - 2] + 1)
        d[i, j] = best
    return d[len(a), len(b)]


def test_lookalikes_equal_brute_force_by_every_route(spark):
    rnd = random.Random(7)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(120)]
    known = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(12)]
    expected = {}
    for name in set(names):
        near = [(osa(name, k), i, k) for i, k in enumerate(known) if k != name and osa(name, k) <= 2]
        if near:
            expected[name] = min(near)
    df = spark.createDataFrame([(n,) for n in names], "domain string")
    table = spark.createDataFrame([(f"B{i}", k, i) for i, k in enumerate(known)], "brand string, domain string, ord long")
    for by_deletion in (False, True):
        got = domains.typosquat(df, table, by_deletion=by_deletion).collect()
        assert {r.domain: (r.distance, int(r.brand[1:]), r.matched_domain) for r in got} == expected
    narrow = domains.with_lookalike(df.withColumnRenamed("domain", "registrable_domain").distinct(), table).filter("typosquat is not null")
    assert {r[0]: (r[1].distance, int(r[1].brand[1:]), r[1].matched_domain) for r in narrow.collect()} == expected


def test_registrable_domains(spark):
    cases = {
        "evil.example.com": "example.com", "login.inps.gov.it": "inps.gov.it", "phish.example.co.uk": "example.co.uk",
        "www.example.com.mx": "example.com.mx", "a.b.workers.dev": "b.workers.dev", "10.0.0.1": "10.0.0.1",
        "host.unknowntld": "host.unknowntld", "x.y.z.ck": "y.z.ck", "a.www.ck": "www.ck", ".Example.COM.": "example.com",
    }
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, host string")
    for rules in (suffix_rules(spark), parse_rules(spark.createDataFrame(
        [(r,) for r in ("// comment", "", "com", "it", "gov.it", "co.uk", "uk", "com.mx", "dev", "workers.dev", "*.ck", "!www.ck")], "rule string"
    ))):
        out = domains.with_registrable_domain(df, rules).orderBy("i").collect()
        assert [r.registrable_domain for r in out] == list(cases.values())


def test_rules_of_many_labels(spark):
    cases = {"a.b.s3.dualstack.x-1.amazonaws.com.cn": "b.s3.dualstack.x-1.amazonaws.com.cn", "a.x-1.eb.amazonaws.com.cn": "a.x-1.eb.amazonaws.com.cn", "a.amazonaws.com.cn": "amazonaws.com.cn"}
    rules = parse_rules(spark.createDataFrame([("com.cn",), ("x-1.eb.amazonaws.com.cn",), ("s3.dualstack.x-1.amazonaws.com.cn",)], "rule string"))
    df = spark.createDataFrame([(i, h) for i, h in enumerate(cases)], "i int, host string")
    assert [r.registrable_domain for r in domains.with_registrable_domain(df, rules).orderBy("i").collect()] == list(cases.values())
    none = domains.with_registrable_domain(df, rules.limit(0)).orderBy("i").collect()
    assert [r.registrable_domain for r in none] == list(cases)


def test_lexical_signals_score_is_clamped_sum(spark):
    urls = ["https://paypla.com/", "https://x9k2q7z5v8b3n1.workers.dev/", "http://192.168.0.1/", "https://pаypal.com/", "https://example.com/"]
    df = spark.createDataFrame(list(enumerate(urls)), "target_id long, canonical_url string")
    out = lexical.lexical_signals(df, brands(spark), suffix_rules(spark)).orderBy("target_id").collect()
    keys = [sorted(s.key for s in r.lexical_signals) for r in out]
    assert keys[0] == ["typosquat"] and keys[2] == ["ip_literal"] and keys[4] == []
    assert "abuse_prone_infra" in keys[1] and "mixed_script" in keys[3]
    for r in out:
        assert r.lexical_risk_score == pytest.approx(min(1.0, sum(s.weight for s in r.lexical_signals)))


@pytest.mark.parametrize("host,expected", [
    ("1.2.3.4", True), ("01.2.3.4", False), ("::1", True), ("2001:db8::1", True), ("1:2:3", False), ("1::2::3", False),
    ("::ffff:1.2.3.4", True), ("fe80::1%eth0", True), ("a.com", False), ("1:2:3:4:5:6:7:8", True),
])
def test_ip_literals(spark, host, expected):
    assert spark.createDataFrame([(host,)], "h string").select(lexical.is_ip_literal(F.col("h"))).first()[0] is expected


def test_override_keys(spark):
    df = rows(spark, ["HTTPS://Login.Example.com/x?q=1#f", "ftp://a.b/", "Example.COM."])
    keyed = with_url_key(df, "input_url").orderBy("target_id").collect()
    assert [r.url_key for r in keyed] == ["https://login.example.com/x", None, None]
    named = with_domain_key(df, "input_url", suffix_rules(spark)).orderBy("target_id").collect()
    assert [r.domain_key for r in named] == ["example.com", "a.b", "example.com"]
