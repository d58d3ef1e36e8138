import hashlib

import pytest
from pyspark.sql import functions as F

from dialspan.llm import urlfilter as U
from dialspan.llm import warc as R
from dialspan.llm.queries import URL_RULES


def test_archives(spark):
    big = "x" * 5000 + "é"
    rows = [(1, "http://a/", big), (7, None, big), (3, "u\r\nv", big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", "y" * 300_000), (None, "u", "z" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = R.write(R.with_revisits(pages), chunk_bytes=1000)
    chunks = spark.read.parquet(path)
    assert chunks.where("chunk_no > 0").count() > 300 and chunks.agg(F.max(F.length("data"))).first()[0] < 2000
    got = sorted(map(tuple, R.read(spark, path).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = [(p, len((h or "").encode()), sha(h), "revisit" if h == big and p != 7 else "response", 7 if h == big and p != 7 else None) for p, _, h in rows]
    assert got == sorted(want, key=str)
    empty = R.write(R.with_revisits(pages.limit(0)))
    assert R.read(spark, empty).count() == 0


def test_damage_is_found(spark):
    pages = spark.createDataFrame([(1, "u", "a" * 5000)], "page_id long, url string, html string")
    chunks = R.chunk_rows(R.with_revisits(pages), 1000)
    bad = chunks.withColumn("data", F.when(F.col("chunk_no") == 2, F.expr("cast(repeat('b', 1000) as binary)")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="differs from its digest"):
        R.parse(bad.coalesce(1).sortWithinPartitions("record_id", "chunk_no")).collect()


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/x", "https://a.example.com/en/", "http://x.com", "http://x.com/", "http://com/", "http://net/es/a?b", "http://n.net/fr/#t", "http://xnet/es/", "net/es/", None, "://n.net/es/", "http://n.net?/es/", "ftp://u@h.com:80/a://b"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit(1), "host": F.lit("h")})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, URL_RULES).collect()}

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
        return host, path, *best

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    assert U.judge(pages.limit(0), URL_RULES).count() == 0 and U.judge(pages, []).where("verdict = 'block'").count() == 0


def test_equal_keys_are_told_apart(spark, tmp_path):
    files = U.write_array([("block", "a.test", "/"), ("allow", "b.test", "/")], str(tmp_path))
    digests = U.Digests(files)
    digests.keys = digests.keys.copy()
    import xxhash

    digests.keys[:] = xxhash.xxh64_intdigest(b"c.test/")
    assert digests.judge(["c.test"], ["/"]) == ([None], [None])
