import math
import random
import re
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import url_templates as U
from sparkloom.llm.queries import URL_RULES, op3_template_tree

LABELS = "id long, bad double"


def brute_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, what) for what, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


ODD = [None, "", "no scheme/com/en/", "http://", "HTTP://COM/en/x", "x://y://z/en/", "http://İx.Com?/en/", "http://a.com#f/en/", "http://acom/en/", "http://example.com/en/71?q", "https://a.example.net/de/8/", "http://net/de/", "http://org/es", "http://a\nb.org/es/\n?x"]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(ODD)], "page_id long, url string")
    got = {r["page_id"]: r for r in U.url_verdicts(df, spark.createDataFrame([], LABELS), URL_RULES).collect()}
    assert len(got) == len(ODD)
    for i, u in enumerate(ODD):
        host, path = brute_host_path(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (verdict or "allow")


def test_query_on_the_table(spark, sf_dir):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op3_template_tree(spark, sf_dir).collect()
    assert sorted(r["page_id"] for r in got) == sorted(urls)
    for r in got:
        host, path = brute_host_path(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, brute_rule(host, path)[0])
        assert r["verdict"] == (brute_rule(host, path)[1] or ("block" if r["bad_share"] >= 0.5 else "allow"))


@pytest.fixture(scope="module")
def site(spark):
    """A host with variable item names, a bad branch and a good one; a hot host of one path."""
    urls = [f"http://shop.x/items/{quote('name' + chr(97 + i % 26) + chr(97 + i // 26))}/view" for i in range(200)]
    urls += [f"http://shop.x/spam/{i}" for i in range(60)] + [f"http://shop.x/blog/{i}" for i in range(60)] + ["http://hot.x/a"] * 400
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, template string")
    labels = spark.createDataFrame([(i, 1.0 if "/spam/" in u else 0.0) for i, u in enumerate(urls) if i % 3 == 0] + [(None, 1.0), (1, None)], LABELS)
    return pages, labels


def test_variable_segments_become_wildcards_and_bad_branches_stay_apart(site):
    pages, labels = site
    rows = U.url_verdicts(pages, labels, []).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].split("/")[1], set()).add((r["template"], r["verdict"]))
    assert by["spam"] == {("/spam/{n}", "block")}
    assert all(v == "allow" for k in ("items", "blog", "a") for _, v in by[k])
    assert {t for t, _ in by["items"]} <= {"/items/*/view", "/*/*/view"}
    assert len(rows) == 720


def brute_ratio(ga, ba, gb, bb):
    def part(o, n, p):
        return o * math.log(o / (n * p)) if o else 0.0

    na, nb = ga + ba, gb + bb
    if not na or not nb:
        return 0.0
    p = (ba + bb) / (na + nb)
    return 2 * (part(ba, na, p) + part(ga, na, 1 - p) + part(bb, nb, p) + part(gb, nb, 1 - p))


def brute_critical(df):
    return df * (1 - 2 / (9 * df) + 1.645 * math.sqrt(2 / (9 * df))) ** 3


def brute_templates(paths):
    """{(host, path): template} for {(host, path): (parts, n, good, bad)}, node by node from the leaves."""

    def merge(rows):
        """rows: (key, parts, n, good, bad) below one node; {key: template}."""
        out = {key: "" for key, parts, *_ in rows if not parts}
        children = {}
        for key, parts, n, good, bad in rows:
            if parts:
                children.setdefault(parts[0], []).append((key, parts[1:], n, good, bad))
        if not children:
            return out
        all_n = sum(r[2] for c in children.values() for r in c)
        below = {s: merge(c) for s, c in children.items()}
        branches = {}
        for s, c in children.items():
            rare = len(children) > 8 and sum(r[2] for r in c) < 0.02 * all_n
            for key, _, n, good, bad in c:
                b = branches.setdefault("*" if rare else s, {"cells": {}, "keys": [], "n": 0, "good": 0.0, "bad": 0.0})
                cell = b["cells"].setdefault(below[s][key], [0.0, 0.0])
                cell[0], cell[1] = cell[0] + good, cell[1] + bad
                b["keys"].append((key, below[s][key]))
                b["n"], b["good"], b["bad"] = b["n"] + n, b["good"] + good, b["bad"] + bad
        marked = sorted(((b["bad"] + 1) / (b["good"] + b["bad"] + 2), s) for s, b in branches.items() if b["good"] + b["bad"] > 0)
        groups, good, bad, before = {}, 0.0, 0.0, None
        for _, s in marked:
            b = branches[s]
            apart = False
            if before is not None:
                both = [(x, branches[before]["cells"][t]) for t, x in b["cells"].items() if t in branches[before]["cells"]]
                both = [(x, y) for x, y in both if sum(x) > 0 and sum(y) > 0]
                apart = bool(both) and sum(brute_ratio(*x, *y) for x, y in both) > brute_critical(len(both))
            if before is not None and not apart and brute_ratio(good, bad, b["good"], b["bad"]) <= brute_critical(1):
                groups[s] = groups[before]
                good, bad = good + b["good"], bad + b["bad"]
            else:
                groups[s] = s
                good, bad = b["good"], b["bad"]
            before = s
        for s, b in branches.items():
            if b["good"] + b["bad"] == 0:
                like = {groups[x] for _, x in marked if set(branches[x]["cells"]) == set(b["cells"])}
                kind = ("kind", frozenset(b["cells"]))
                groups[s] = like.pop() if len(like) == 1 else ("alone", s) if like else kind
        members = {}
        for s, g in groups.items():
            members.setdefault(g, []).append(s)
        wild = [m for m in members.values() if "*" in m] or sorted((m for m in members.values() if len(m) > 1), key=lambda m: -sum(branches[s]["n"] for s in m))
        for m in members.values():
            label = m[0] if len(m) == 1 else "*" if m is wild[0] else "(" + "|".join(sorted(m)) + ")"
            for s in m:
                out.update((key, f"/{label}{t}") for key, t in branches[s]["keys"])
        return out

    hosts = {}
    for (host, path), row in paths.items():
        hosts.setdefault(host, []).append(((host, path), *row))
    return {k: t for rows in hosts.values() for k, t in merge(rows).items()}


def test_merges_against_brute_force(spark):
    rng = random.Random(5)
    paths = {}
    for host in ("a", "b", "c", "d"):
        for k in range(150):
            parts = [rng.choice("pqrs") + str(rng.randrange(2)) for _ in range(rng.randrange(0, 5))]
            if k % 3 == 0:
                parts = ["items", f"v{k}x", *parts[:2]]
            bad = "p1" in parts or "q0" in parts[1:2]
            marks = rng.choice([0, 0, 1, 5, 30])
            wrong = min(marks, rng.randrange(2))
            # counts that differ, so that no two groups tie for the wildcard
            paths[(host, "/".join(parts))] = (parts, 1 + rng.randrange(10**6), float(marks - wrong if not bad else wrong), float(marks - wrong if bad else wrong))
    df = spark.createDataFrame([(h, p, *row) for (h, p), row in paths.items()], "host string, path string, parts array<string>, n long, good double, bad double")
    got = {(r["host"], r["path"]): r["template"] for r in U.template_tree(df).collect()}
    assert got == brute_templates(paths)
    assert len(set(got.values())) > 20


def test_good_and_bad_branches_at_depths_three_to_seven(spark):
    """Each page's verdict follows from its own branch, also without a label of its own."""
    urls, truth = [], []
    for depth in range(3, 8):
        above = [f"d{depth}", *(f"l{i}" for i in range(depth - 3))]
        for i in range(60):
            for kind in ("good", "bad"):
                urls.append(f"http://deep.x/{'/'.join(above)}/{kind}/{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}")
                truth.append(kind == "bad")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, float(b)) for i, b in enumerate(truth) if i // 2 % 2], LABELS)
    got = {r["page_id"]: r["verdict"] for r in U.url_verdicts(pages, labels, []).collect()}
    assert [got[i] == "block" for i in range(len(urls))] == truth


def test_purity_equals_plain_counting(site):
    pages, labels = site
    rows = U.url_verdicts(pages, labels, []).collect()
    bad = {r["id"]: r["bad"] for r in labels.collect() if r["id"] is not None and r["bad"] is not None}
    host, template = {}, {}
    for r in rows:
        for table, key in ((host, r["host"]), (template, (r["host"], r["template"]))):
            n, b = table.get(key, (0, 0.0))
            table[key] = (n + (r["page_id"] in bad), b + bad.get(r["page_id"], 0.0))
    base = sum(b for _, b in host.values()) / sum(n for n, _ in host.values())
    for r in rows:
        n, b = host[r["host"]]
        share = (b + 4 * base) / (n + 4)
        n, b = template[(r["host"], r["template"])]
        assert r["bad_share"] == pytest.approx((b + 4 * share) / (n + 4), abs=1e-8)


def test_nulls_deep_and_long_paths(spark):
    deep = "http://h.x/" + "/".join(f"s{i}" for i in range(5000))
    df = spark.createDataFrame([(1, deep), (None, None), (None, "http://h.x"), (2, "http://h.x/" + "y" * 200_000)], "page_id long, url string")
    got = U.url_verdicts(df, spark.createDataFrame([(2, 1.0)], LABELS), []).collect()
    assert len(got) == 4 and {len(r["path"]) for r in got if r["page_id"] == 2} == {200_001}
    assert U.url_verdicts(df.where("false"), spark.createDataFrame([], LABELS), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        U.rule_of(F.lit("a"), F.lit("b"), [("block", "a", "/")] * 501)


def test_labels_from_table(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 1), (4, None, None), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {r["id"]: r["bad"] for r in U.labels_from(df).collect()} == {1: 1.0, 2: 0.0, 3: 1.0, 4: None, 5: 1.0}
