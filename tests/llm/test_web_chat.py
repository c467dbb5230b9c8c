import base64
import gzip
import hashlib
import math
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import queries, warc
from tidewell.llm.chat_format import END, MIDDLE, START, format_pairs, sibling_pairs
from tidewell.llm.common import fresh_path, table
from tidewell.llm.url_filter import RULES, beta_below, beta_quantile, judge, reputations, site_of, with_domains

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 3}.example.com/en/{i}", f"<p>{i % 4}</p>") for i in range(60)]
    rows += [(100, None, None), (101, "no scheme", ""), (102, "HTTP://A.Example.COM/en/7?x#y", "é" * 300000), (103, "x://\r\nevil: 1", "a\r\n\r\nb")]
    rows += [(104, "a://b", "\x1f\x8b\x08 not a member"), (105, "a://b?c://d/e", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("host", F.lit("x")).repartition(3)


def expected_warc(rows, least=0):
    last, out = {}, {}
    for i, h in rows:
        last[h or ""] = max(last.get(h or "", i), i)
    for i, h in rows:
        raw = (h or "").encode()
        again = last[h or ""] != i and len(raw) >= least
        out[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", last[h or ""] if again else None)
    return out


@pytest.mark.parametrize("split", [700, 16 << 20])
def test_warc(spark, pages, split):
    rows = [(r.page_id, r.html) for r in pages.collect()]
    for least in (0, 5):
        got = warc.archive(pages, least=least, split_bytes=split).collect()
        assert len(got) == len(rows)
        found = {int(r.record_id): (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got}
        assert found == expected_warc(rows, least)
        html = dict(rows)
        assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
        assert all(bytes(r.payload).decode() == (html[int(r.record_id)] or "") for r in got if r.payload is not None)
    assert warc.archive(pages.limit(0)).collect() == []


def test_warc_attempts(spark, pages):
    """Each attempt has files of its own; what an unlisted one of the run left is removed, and nothing else."""
    import os

    path = fresh_path(spark, "attempts")
    here = path.removeprefix("file://")
    os.makedirs(here)
    open(f"{here}/notes.txt", "w").close()
    other = warc.write_archives(warc.records_of(pages), path).collect()
    records = warc.records_of(pages)
    lost, won = (warc.write_archives(records, path, "run").collect() for _ in range(2))
    assert not {r.archive for r in lost} & {r.archive for r in won}
    warc.tidy(path, "run", [r.archive for r in won])
    left = {x for x in os.listdir(here) if not x.endswith(".crc")}
    assert left == {r.archive for r in won} | {r.archive for r in other} | {"notes.txt"}
    assert all(os.path.getsize(f"{here}/{r.archive}") == r.bytes for r in won)
    got = warc.read_archives(spark, [(f"{path}/{r.archive}", r.bytes) for r in won if r.bytes])
    assert sorted(int(r.record_id) for r in got.select("record_id").collect()) == sorted(r.page_id for r in pages.select("page_id").collect())
    warc.archive(pages, path)
    assert "notes.txt" in os.listdir(here)


def _archive_of(spark, data):
    import os

    path = fresh_path(spark, "own").removeprefix("file://")
    os.makedirs(path)
    with open(f"{path}/a.warc.gz", "wb") as f:
        f.write(data)
    return f"{path}/a.warc.gz", len(data)


def _one(i, payload=b"hi", url="a://b"):
    return warc.record(i, url, warc.payload_digest(payload), len(payload), payload, None, "2024-01-01T00:00:00Z")


def test_warc_reads_past_junk(spark):
    junk = b"\x1f\x8b\x08junk" + gzip.compress(b"not a header") + _one(1)[:30]
    where = _archive_of(spark, junk + _one(1) + b"xx" + junk + _one(2))
    for split in (1, 7, 64, where[1]):  # every range alone, as a task reads it
        found, gap = [], [0]
        for start in range(0, where[1], split):
            with open(where[0], "rb") as f:
                found += [head["warc-record-id"] for head, _ in warc._scan(warc._Window(f, where[1]), start, min(start + split, where[1]), gap)]
        assert found == ["<urn:page:1>", "<urn:page:2>"] and gap == [2 * len(junk) + 2]
    got = warc.read_archives(spark, [where], 100)
    assert sorted(int(r.record_id) for r in got.collect()) == [1, 2]
    assert warc.skipped_bytes(spark, [where], 100) == 2 * len(junk) + 2
    with pytest.raises(Exception, match="belong to no valid member"):
        warc.read_archives(spark, [where], 100, strict=True).collect()


def test_warc_members_and_headers(spark):
    """Several records in a member, folded and odd header lines, and other kinds of records."""
    whole = gzip.compress(gzip.decompress(_one(1)) + gzip.decompress(_one(2, b"x" * 500000)) + gzip.decompress(_one(3)))
    folded = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: a://\r\n b\r\nodd\r\nWARC-Record-ID: <urn:page:4>\r\nContent-Length: 6\r\n\r\n\r\n\r\nok\r\n\r\n")
    info = gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n")
    where = _archive_of(spark, info + whole + folded + _one(5))
    for split in (150, 1 << 20):
        got = warc.read_archives(spark, [where], split, strict=True).collect()
        assert sorted((r.record_id or "", r.record_type, r.payload_bytes) for r in got) == [
            ("", "warcinfo", None), ("1", "response", 2), ("2", "response", 500000), ("3", "response", 2), ("4", "response", 2), ("5", "response", 2),
        ]
        assert [r.target_uri for r in got if r.record_id == "4"] == ["a:// b"]
    with pytest.raises(Exception, match="isn't compressed"):
        warc.read_archives(spark, [_archive_of(spark, gzip.decompress(_one(1)))]).collect()
    cut = _archive_of(spark, _one(1) + _one(2)[:-5])
    assert [r.record_id for r in warc.read_archives(spark, [cut]).collect()] == ["1"] and warc.skipped_bytes(spark, [cut]) == len(_one(2)) - 5
    with pytest.raises(Exception, match="1 records read of 2 written"):
        warc.read_archives(spark, [(*cut, [2])]).collect()


def test_warc_long_urls_and_null_ids(spark):
    own = __import__("random").Random(8)
    url = "h://" + "".join(own.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=2_000_000))
    rows = [(1, url, "p"), (None, url, "p"), (None, None, "q"), (None, None, "q"), (2, "", None), (3, "a b%\r\nc", "p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = sorted(((r.record_id, r.record_type, r.refers_to, r.target_uri) for r in warc.archive(df).collect()), key=str)
    assert got == sorted(
        [("1", "revisit", "3", url), (None, "revisit", "3", url), (None, "response", None, None), (None, "revisit", None, None), ("2", "response", None, ""), ("3", "response", None, "a%20b%%0D%0Ac")],
        key=str,
    )
    named = df.select(F.col("page_id").cast("string"), "url", "html").unionByName(spark.createDataFrame([("", "u", "p"), ("x>\n%", "u", "z")], df.select(F.col("page_id").cast("string"), "url", "html").schema))
    assert sorted(str(r.record_id) for r in warc.archive(named).collect()) == ["", "1", "2", "3", "None", "None", "None", "x>\n%"]


def test_warc_query(spark):
    rows = [(r.page_id, r.html) for r in table(spark, SF, "pages").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op2_warc(spark, SF).collect()}
    assert got == expected_warc(rows)


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2])


def plain_rule(host, path):
    best = None
    for verdict, name, start in RULES:
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
            best = (name + start, verdict)
    return best


def plain_below(x, a, b, steps=20000):
    """The incomplete beta function by the midpoint rule over the a-th power of its variable."""
    top = a * math.log(x) - math.log(a) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    at = (np.arange(steps) + 0.5) / steps
    return float(np.exp(top + (b - 1) * np.log1p(-x * at ** (1 / a))).mean())


def plain_reputation(hosts):
    """The hierarchy in plain Python: {host: (n, bad)} to {host: (rate, a, b)}."""
    two = lambda h: ".".join(h.split(".")[-2:])
    one = lambda h: h.split(".")[-1]

    def shrink(level, prior):
        top = sum((b - n * prior[k]) ** 2 - n * prior[k] * (1 - prior[k]) for k, (n, b) in level.items() if n > 1)
        room = sum(n * (n - 1) * prior[k] * (1 - prior[k]) for k, (n, b) in level.items() if n > 1)
        low = 1 / 1001
        rho = min(max(top / room if room > 0 else low, low), 0.5)
        s = 1 / rho - 1
        return {k: (b + s * prior[k]) / (n + s) for k, (n, b) in level.items()}, s

    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (n, b) in hosts.items():
        for level, k in ((domains, two(h)), (suffixes, one(h))):
            level[k][0] += n
            level[k][1] += b
    overall = (sum(b for _, b in suffixes.values()) + 1) / (sum(n for n, _ in suffixes.values()) + 2)
    up, _ = shrink(suffixes, dict.fromkeys(suffixes, overall))
    mid, _ = shrink(domains, {d: up[one(d)] for d in domains})
    rate, s = shrink(hosts, {h: mid[two(h)] for h in hosts})
    return {h: (rate[h], b + s * mid[two(h)], n - b + s * (1 - mid[two(h)])) for h, (n, b) in hosts.items()}


def test_url_filter(spark, pages):
    labels = pages.select("page_id", (F.col("page_id") % 3 == 1).alias("bad")).where("page_id < 60")
    got = judge(pages, labels).collect()
    assert len(got) == pages.count()
    urls = {r.page_id: r.url for r in pages.collect()}
    hosts = defaultdict(lambda: [0, 0])
    for i, u in urls.items():
        h = hosts[plain_url(u)[0]]
        h[0] += i < 60
        h[1] += i < 60 and i % 3 == 1
    want = plain_reputation(hosts)
    for r in got:
        host, path = plain_url(urls[r.page_id])
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        rate, a, b = want[host]
        doubt = plain_below(0.5, a, b)
        assert r.host_rate == pytest.approx(rate, abs=1e-8) and r.host_doubt == pytest.approx(doubt, abs=1e-5)
        assert plain_below(r.host_bound, a, b) == pytest.approx(0.05, abs=1e-4) or r.host_bound < 1e-6
        assert r.verdict == (rule[1] if rule else "block" if doubt <= 0.05 else "allow")
    assert any(r.verdict == "block" and r.host == "h1.example.com" for r in judge(pages, labels, rules=()).collect())
    assert judge(pages.limit(0), labels).collect() == []
    assert judge(pages, labels.limit(0)).count() == pages.count()


def test_url_query(spark):
    urls = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    got = queries.op6_url_filter(spark, SF).collect()
    assert {r.page_id for r in got} == set(urls) and len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == plain_url(urls[r.page_id])
        rule = plain_rule(r.host, r.path)
        assert r.rule == (rule and rule[0]) and (rule is None or r.verdict == rule[1])


def test_beta_functions():
    """Against closed forms and the midpoint rule, skewed ones included."""
    x = [0.01, 0.2, 0.5, 0.9, 0.999]
    for a, b in ((1, 1), (3, 1), (1, 5), (0.05, 2.5), (0.3, 0.2), (40, 3), (6, 9)):
        got = beta_below(x, [a] * 5, [b] * 5)
        if b == 1:
            assert got == pytest.approx([v**a for v in x], abs=1e-12)
        elif a == 1:
            assert got == pytest.approx([1 - (1 - v) ** b for v in x], abs=1e-12)
        else:
            assert got == pytest.approx([plain_below(v, a, b) for v in x], abs=5e-3)
    q = beta_quantile(0.05, [3.0, 1.0, 40.0], [1.0, 5.0, 3.0])
    assert q[:2] == pytest.approx([0.05 ** (1 / 3), 1 - 0.95**0.2], abs=1e-9) and plain_below(q[2], 40, 3) == pytest.approx(0.05, abs=1e-4)


def test_sites_and_domains(spark):
    hosts = ["a.b.co.uk", "x.org", "localhost", "", "a.com.sg", "me.github.io", "www.ck", "a.b.ck", "b.ck", "10.0.0.1", "[::1]", "co.uk"]
    df = spark.createDataFrame([(h,) for h in hosts], "site string")
    own = {r.site: (r.domain, r.suffix) for r in with_domains(df).collect()}
    assert own["a.b.co.uk"] == ("b.co.uk", "co.uk") and own["x.org"] == ("x.org", "org") and own["localhost"] == ("localhost", "localhost") and own[""] == ("", "")
    assert own["a.com.sg"] == ("a.com.sg", "com.sg") and own["me.github.io"] == ("github.io", "io") and own["co.uk"] == ("co.uk", "co.uk")
    assert own["10.0.0.1"] == ("10.0.0.1", "") and own["[::1]"] == ("[::1]", "")
    rules = spark.createDataFrame([("com.sg",), ("*.ck",), ("!www.ck",), ("github.io",), ("co.uk",), ("uk",), ("",)], "rule string")
    listed = {r.site: (r.domain, r.suffix) for r in with_domains(df, rules).collect()}
    assert listed["me.github.io"] == ("me.github.io", "github.io") and listed["www.ck"] == ("www.ck", "ck") and listed["a.b.ck"] == ("a.b.ck", "b.ck")
    assert listed["b.ck"] == ("b.ck", "b.ck") and listed["a.b.co.uk"] == ("b.co.uk", "co.uk") and listed["x.org"] == ("x.org", "org")
    raw = spark.createDataFrame([("u:p@h.org:8080",), ("h.org.",), ("[::1]:80",), ("h.org",), ("",)], "host string")
    assert [r[0] for r in raw.select(site_of(F.col("host"))).collect()] == ["h.org", "h.org", "[::1]", "h.org", ""]
    assert reputations(spark.createDataFrame([], "site string, n long, bad long")).collect() == []


def test_url_edges(spark):
    """Ports and addresses, null ids and urls, repeated rows and labels; hosts count by name."""
    rows = [(i, f"http://h.org:{80 + i % 2}/x/{i}", 1) for i in range(40)] + [(None, f"http://h.org/{i}", 1) for i in range(30)] + [(None, None, 1), (50, "http://10.0.0.1/a", 1), (50, "http://10.0.0.1/a", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict int").repartition(3)
    labels = spark.createDataFrame([(i, True) for i in range(40)] + [(1, False), (999, True), (None, True), (50, None)], "page_id long, bad boolean")
    got = judge(df, labels, rules=()).collect()
    assert len(got) == len(rows)
    assert {(r.host_labelled, r.host_bad) for r in got if r.host.startswith("h.org")} == {(41, 40)}
    assert {r.verdict for r in got if r.host.startswith("h.org")} == {"block"}
    assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i, *_ in rows)


def test_chat_format(spark):
    rows = [
        (1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "yes é"), (1, "rejected", 1, "assistant", "no"),
        (1, "chosen", 2, "user", "ok"), (1, "chosen", 3, "assistant", ""),
        (2, "chosen", 0, None, None), (2, "rejected", 0, "", ""),
        (3, "chosen", 0, "user", "alone"), (4, "rejected", None, "user", "x"), (None, "chosen", 0, "user", "x"), (5, "other", 0, "user", "x"),
        (6, "chosen", 0, "user", "a"), (6, "chosen", 0, "user", "a"), (6, "rejected", 0, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("chosen", F.lit(1)).withColumn("rejected", F.lit(1))
    got = {r.pair_id: r for r in format_pairs(df).collect()}
    turn = lambda role, text: START + role + MIDDLE + text + END
    assert set(got) == {1, 2, 3, 4, 6}
    assert got[1].prompt == turn("user", "hi") and got[1].prompt_turns == 1
    assert got[1].chosen == turn("assistant", "yes é") + turn("user", "ok") + turn("assistant", "")
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_mask] == ["yes é" + END, END]
    assert [got[1].rejected[s.start : s.end] for s in got[1].rejected_mask] == ["no" + END]
    assert got[2].prompt == turn("", "") and got[2].chosen == got[2].rejected == ""
    assert got[3].prompt == "" and got[3].chosen == turn("user", "alone") and got[3].rejected == "" and got[3].chosen_mask == []
    assert got[6].prompt_turns == 1 and got[6].chosen == turn("user", "a")
    assert format_pairs(df.limit(0)).collect() == []


def test_sibling_pairs(spark):
    talks = {
        1: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")],
        2: [("user", "a"), ("assistant", "b"), ("user", "z"), ("assistant", "y"), ("user", "x"), ("assistant", "w")],
        3: [("user", "x")],
        4: [("assistant", None)],
        5: [("user", "a")],
        6: [("user", "a"), ("assistant", "b"), ("user", "c")],
    }
    rows = [(i, n, role, text) for i, t in talks.items() for n, (role, text) in enumerate(t)] + [(None, 0, "user", ""), (7, None, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("x")).repartition(3)
    for chain, follows in ((10, {1: 2, 2: 5, 5: 6}), (2, {1: 5, 2: 6})):
        got = {r.pair_id: r for r in format_pairs(sibling_pairs(df, chain)).collect()}
        assert set(got) == set(talks)
        for i, talk in talks.items():
            mine = [(r or "", t or "") for r, t in talk]
            other = [(r or "", t or "") for r, t in talks[follows[i]]] if i in follows else list(mine)
            if i not in follows and (replies := [n for n, x in enumerate(mine) if x[0] == "assistant"]):
                other[replies[-1]] = ("assistant", mine[replies[-2]][1] if len(replies) > 1 else "")
            same = 0
            while same < min(len(mine), len(other)) and mine[same] == other[same]:
                same += 1
            turn = lambda x: START + x[0] + MIDDLE + x[1] + END
            assert got[i].prompt_turns == same and got[i].prompt == "".join(map(turn, mine[:same]))
            for side, turns in (("chosen", mine[same:]), ("rejected", other[same:])):
                assert got[i][side] == "".join(map(turn, turns))
                assert [got[i][side][s.start : s.end] for s in got[i][f"{side}_mask"]] == [x[1] + END for x in turns if x[0] == "assistant"]
    assert sibling_pairs(df.limit(0)).collect() == []


def test_long_conversations(spark):
    rows = [(i, n, "assistant" if n % 2 else "user", f"t{n}" if n < 2990 + i else f"{i}-{n}") for i in (1, 2) for n in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = {r.pair_id: r for r in format_pairs(sibling_pairs(df)).collect()}
    assert got[1].prompt_turns == 2991 and len(got[1].chosen_mask) == len(got[1].rejected_mask) == 5
