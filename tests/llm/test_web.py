"""WARC archives and URL verdicts."""

import base64
import gzip
import hashlib
import io
import random
from collections import Counter, defaultdict
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from bidscope.llm import url_filter, warc

PAGES = [
    (1, "http://a.example.com/fr/1", "<p>same</p>"), (2, "http://b.example.com/de/2?x#y", "<p>same</p>"), (3, None, None), (4, "no scheme", ""), (5, "ftp://Example.ORG", "x" * 300_000), (6, "https://example.org/es/1", "é日本"),
    (7, "https://www.example.org/en/12?q=://z", "<a href='http://good.org/x'>g</a>"), (8, "https://notexample.org/es/", "<p>same</p>"), (None, "http://c.net/", "<p>same</p>"), (9, "http://c.net/a\nb", "<a href=\"//a.example.com/de/\">b</a>"),
    (9, "http://c.net/a\nb", "<a href=\"//a.example.com/de/\">b</a>"), (10, "http://d.org#frag", "1"), (11, "x://y://z/fr/", "2"), (12, "http://COM/fr/1", "3"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    cols = list(zip(*PAGES, strict=True))
    pq.write_table(pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([1] * len(PAGES))], names=["page_id", "url", "html", "digest"]), path / "pages.parquet")
    return str(path)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip_and_revisits(spark, folder):
    got = sorted(map(tuple, warc.op1_warc(spark, folder).collect()), key=str)
    first = {}
    for i, _, h in sorted((p for p in PAGES if p[0] is not None), key=lambda p: p[0]):
        first.setdefault(digest(h), i)
    want = [(i, len((h or "").encode()), digest(h), "response" if i == first[digest(h)] else "revisit", None if i == first[digest(h)] else first[digest(h)], True) for i, _, h in PAGES]
    assert got == sorted(want, key=str)


def test_small_payloads_stay_responses(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    back = warc.read_archives(spark, warc.write_archives(pages, least_revisit_bytes=1000, file_bytes=2000), with_payload=True).collect()
    assert {r.record_type for r in back} == {"response"}
    assert sorted((str(r.page_id), bytes(r.payload)) for r in back) == sorted((str(i), (h or "").encode()) for i, _, h in PAGES)


class Slow(io.BytesIO):
    """Gives out a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else n)


def test_reader_frames_and_verifies():
    records = [warc._record(i, "http://h/", bytes([65 + i]) * (i * 1000), None, False, "2024-01-01T00:00:00Z") for i in range(4)]
    archive = b"".join(map(warc._member, records))
    got = list(warc.read_records(Slow(archive), with_payload=True))
    assert [r["payload"] for r in got] == [bytes([65 + i]) * (i * 1000) for i in range(4)] and all(r["verified"] for r in got)
    assert [gzip.decompress(warc._member(r)) for r in records] == records
    broken = records[2].replace(b"CCCC", b"CCCD", 1)
    assert not next(iter(warc.read_records(io.BytesIO(warc._member(broken)))))["verified"]
    for bad in (archive[:-5], warc._member(records[1][:-4]), warc._member(b"HTTP/1.1 200 OK\r\n\r\n"), b"not gzip at all", warc._member(re.sub(rb"Content-Length: \d+", b"Content-Length: 3", records[1]))):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def plain_parts(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_rules_and_parts(spark, folder):
    got = {(r.page_id, r.host): r for r in url_filter.op5_url_filter(spark, folder).collect()}
    for i, url, _ in PAGES:
        host, path = plain_parts(url)
        r = got[(i, host)]
        fits = [(len(h) + len(p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert r.path == path and r.rule == (max(fits)[1] if fits else None)
        assert r.verdict == max(fits)[2] if fits else r.verdict in ("allow", "block")


def test_links_carry_trust_and_distrust(spark):
    page = lambda i, host, path, *links: (i, f"http://{host}{path}", "".join(f'<a href="http://{x}/">' for x in links))
    rows = [page(1, "seed.org", "/", "near.net"), page(2, "near.net", "/", "far.net"), page(3, "far.net", "/"), page(4, "bad.com", "/de/1"), page(5, "fan.net", "/", "bad.com"), page(6, "fans.net", "/", "fan.net"), page(7, "alone.net", "/")]
    got = {r.host: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got["near.net"].trust > got["far.net"].trust > 0 and got["fan.net"].distrust > got["fans.net"].distrust > 0
    assert got["fan.net"].verdict == "block" and got["near.net"].verdict == got["alone.net"].verdict == "allow"
    d = 0.85
    assert got["seed.org"].trust == pytest.approx(0.15) and got["near.net"].trust == pytest.approx(0.15 * d) and got["far.net"].trust == pytest.approx(0.15 * d * d)


def test_walk_reaches_the_fixed_point_of_a_cyclic_graph(spark):
    """Against plain PageRank over some hundred hosts with cycles, parallel links, dangling hosts and thresholds."""
    rng = random.Random(4)
    hosts = [f"h{i}.{'org' if i % 9 == 0 else 'com' if i % 4 == 0 else 'net'}" for i in range(120)]
    rows, links = [], defaultdict(Counter)
    for n, h in enumerate(hosts):
        for k in range(rng.randint(1, 3)):
            out = [hosts[(n + 1) % 60]] * (n < 60) + rng.sample(hosts, rng.randint(0, 4)) * (n % 7 > 0)
            rows.append((len(rows), f"http://{h}{rng.choice(['/', '/de/x', '/fr/y'])}", "".join(f'<a href="//{x}/">' for x in out)))
            for x in set(out) - {h}:
                links[h][x] += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.judge_urls(pages).collect()}
    rule = {i: next((v for v, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2])) if (plain_parts(u)[0] == h or plain_parts(u)[0].endswith("." + h)) and plain_parts(u)[1].startswith(p)), None) for i, u, _ in rows}
    host_of = {i: plain_parts(u)[0] for i, u, _ in rows}
    seed = {w: {h: sum(rule[i] == w for i in rule if host_of[i] == h) / sum(host_of[i] == h for i in rule) for h in hosts} for w in ("allow", "block")}
    back = defaultdict(Counter)
    for a in links:
        for b, n in links[a].items():
            back[b][a] += n

    def walk(seeds, edges):
        score = {h: 0.15 * s for h, s in seeds.items()}
        for _ in range(400):
            flow = Counter()
            for a in edges:
                for b, n in edges[a].items():
                    flow[b] += score[a] * n / sum(edges[a].values())
            score = {h: 0.15 * seeds[h] + 0.85 * flow[h] for h in seeds}
        return score

    trust, distrust = walk(seed["allow"], links), walk(seed["block"], back)
    for i in rule:
        h, r = host_of[i], got[i]
        assert r.trust == pytest.approx(trust[h], abs=2e-6) and r.distrust == pytest.approx(distrust[h], abs=2e-6)
        if abs(distrust[h] - 2 * trust[h]) > 1e-4 and abs(distrust[h] - 0.02) > 1e-4:
            assert r.verdict == (rule[i] or ("block" if distrust[h] >= 0.02 and distrust[h] >= 2 * trust[h] else "allow"))
    edges = url_filter.host_edges(spark.createDataFrame([("a", '<a href="//b/">'), ("b", '<a href="//a/">')], "host string, html string"))
    with pytest.raises(RuntimeError):
        url_filter.propagate(spark.createDataFrame([("a", 1.0)], "host string, seed double"), edges, rounds=3)
