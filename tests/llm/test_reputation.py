import random
from collections import Counter, defaultdict
from math import sqrt

import pytest
from compare import compare, connect

from hunkledger.llm import reputation
from hunkledger.llm.reputation import Rule, judge

SF = "/root/testdata/sf0.01"
PAGES = "page_id long, url string"
KEEP = ["page_id", "host", "path", "rule", "verdict"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = lambda text, marks: min([text.index(m) for m in marks if m in text], default=len(text))
    host = rest[: ends(rest, "/?#")]
    path = rest[len(host) :]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[: ends(path, "?#")]


def ruled(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: (len(r.host + r.path), len(r.path)), default=None)


def weight(members):
    pairs = sum(n * (n - 1) * p * (1 - p) for n, g, p in members)
    if not pairs:
        return 10.0
    like = (sum((g - n * p) ** 2 for n, g, p in members) - sum(n * p * (1 - p) for n, g, p in members)) / pairs
    return min(max(1 / like - 1, 1.0), 1000.0) if like > 0 else 1000.0


def parents(host):
    labels = host.split("@")[-1].split(":")[0].rstrip(".").split(".")
    if len(labels) == 4 and all(x.isdigit() for x in labels):
        return ".".join(labels), ""
    own = 2 if len(labels[-1]) == 2 and len(labels) > 1 and labels[-2] in reputation.SECOND_LEVEL else 1
    return ".".join(labels[-own - 1 :]), ".".join(labels[-own:])


def brute(rows, rules=reputation.RULES, outcomes=None):
    told = []
    for number, (page, url) in enumerate(rows):
        host, path = split(url)
        rule = ruled(host, path, rules)
        good = (None if rule is None else rule.verdict == "allow") if outcomes is None else outcomes[number]
        told.append((page, host, path, rule, good))
    hosts, domains, suffixes = (defaultdict(lambda: [0, 0]) for _ in range(3))
    for _, host, _, _, good in told:
        domain, suffix = parents(host)
        for table, key in ((hosts, host), (domains, domain), (suffixes, suffix)):
            table[key][0] += good is not None
            table[key][1] += good is True
    n, g = (sum(c[i] for c in hosts.values()) for i in (0, 1))
    prior = {s: (g + 1) / (n + 2) for s in suffixes}

    def shares(table, prior):
        w = weight([(n, g, prior[k]) for k, (n, g) in table.items()])
        return {k: (g + w * prior[k]) / (n + w) for k, (n, g) in table.items()}, w

    suffix_share = shares(suffixes, prior)[0]
    domain_share = shares(domains, {d: suffix_share[s] for d, s in {parents(h) for h in hosts}})[0]
    share, w = shares(hosts, {h: domain_share[parents(h)[0]] for h in hosts})
    out = Counter()
    for page, host, path, rule, _ in told:
        m = share[host]
        high = m + reputation.Z * sqrt(m * (1 - m) / (hosts[host][0] + w + 1))
        out[page, host, path, rule and rule.name, rule.verdict if rule else "block" if high < 0.5 else "allow"] += 1
    return out


def found(df, **options):
    return Counter(tuple(r) for r in judge(df, **options).select(KEEP).collect())


def chance_pages(seed, n=400):
    chance = random.Random(seed)
    hosts = ["a.example.org", "example.org", "notexample.org", "x.com", "b.x.com", "y.com", "z.co.uk", "w.z.co.uk", "q.net", "R.NET", "10.0.0.7", "bad.fr.com", "x.com:8080", "me@y.com"]
    paths = ["/fr/1", "/de/2", "/en/1", "/en/2", "/es/", "/es", "", "/", "/fr/?a=://", "#/fr/", "?/de/"]
    skew = {h: chance.random() for h in hosts}
    rows = []
    for i in range(n):
        host = chance.choice(hosts)
        path = ("/fr/" if chance.random() < skew[host] else "/de/") + str(i) if chance.random() < 0.6 else chance.choice(paths)
        rows.append((i, f"https://{host}{path}"))
    return rows


ODD = [
    (900, None), (901, ""), (902, "no scheme"), (903, "://"), (904, "://COM/fr/"), (905, "a://b://com/fr/"), (906, "https://org"), (907, "https://org/"),
    (908, "https://.org/"), (909, "https://example.org/es/x?y#z"), (910, "https://xexample.org/es/x"), (911, "https://example.org/en/12"), (912, "https://\u00c9.com/de/\n"),
    (913, "https://example.org/" + "a" * 200_000), (914, "x" * 100_000), (None, "https://com/fr/"), (907, "https://org/"), (915, "https://com./fr/"), (916, "https://[::1]/x"),
]


def test_oracle(spark):
    ok, n, message = compare(reputation.op13_url_filter(spark, SF), connect(SF), reputation.ORACLE)
    assert ok and n == 250, message


def test_rules_reputation_and_odd_urls(spark):
    rows = chance_pages(3) + [r for r in ODD if r[0] != 916]
    want = brute(rows)
    assert {"block", "allow"} == {v[4] for v in want if v[3] is None}
    assert found(spark.createDataFrame(rows, PAGES)) == want
    assert sum(found(spark.createDataFrame(ODD, PAGES)).values()) == len(ODD)


@pytest.mark.parametrize("shares", [2, 1_000_000])
def test_hot_keys_and_rare_keys_join_alike(spark, monkeypatch, shares):
    rows = chance_pages(5) + [(i, "https://hot.x.com/en/") for i in range(1000, 1300)] + [(None, None)] * 200
    monkeypatch.setattr(reputation, "SHARES", shares)
    assert found(spark.createDataFrame(rows, PAGES)) == brute(rows)


def test_given_outcomes_and_rules(spark):
    chance = random.Random(9)
    rows = [(i, f"http://{'ab'[i % 2]}.site.net/{i}") for i in range(200)]
    good = [None if chance.random() < 0.3 else chance.random() < (0.9, 0.1)[i % 2] for i in range(200)]
    rules = (Rule("block", "site.net", "/1"), Rule("allow", "a.site.net", "/1"))
    df = spark.createDataFrame([(*r, None if g is None else int(g)) for r, g in zip(rows, good)], PAGES + ", label int")
    got = found(df, rules=rules, label="label")
    assert got == brute(rows, rules, good) and {"allow", "block"} == {v[4] for v in got if v[3] is None}


def test_nothing_labelled_empty_table_and_clashing_columns(spark):
    rows = [(1, "https://a.net/"), (1, "https://a.net/"), (2, None)]
    assert found(spark.createDataFrame(rows, PAGES)) == brute(rows)
    empty = judge(spark.createDataFrame([], PAGES))
    assert empty.count() == 0 and set(KEEP) <= set(empty.columns)
    clashing = spark.createDataFrame([(*r, "old", "old", 5.0, 1, "kept") for r in rows], PAGES + ", host string, verdict string, share double, held int, suffix string")
    assert found(clashing) == brute(rows)
    assert {r["suffix"] for r in judge(clashing).collect()} == {"kept"}
