"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm_ranks, jaccard, knn_quality, media, minhash, packing, pieces, pii, quotes, signature_join, urlfilter, warc, whitening
from .shared import cut, table


def tokenizer_path(name: str) -> str:
    """A vocabulary file outside the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.token_pieces(docs, tokenizer_path("word_bpe_49k.json")))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.encode_texts(table(spark, sf_dir, "documents")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.read(spark, warc.write(warc.with_revisits(pages)))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_components(table(spark, sf_dir, "documents"), words=4, percent=85)


#: The key of the surrogates; a caller's own in production.
PII_KEY = b"an example key of the queries"


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.anonymise(docs, PII_KEY)


#: (verdict, host, path): fixed values of the contract.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compare_neighbours(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as they are, and with quotes of the turns before, whose links are to be found again."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = given.withColumn("quoting", F.lit(False)).unionByName(quotes.with_quotes(given).withColumn("quoting", F.lit(True)))
    return quotes.ordered(cut(both), ["quoting", "conv_id"])  # written once, read for the links and for the texts


def op11_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm_ranks.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_media": op2_media,
    "op3_warc": op3_warc,
    "op4_jaccard": op4_jaccard,
    "op5_pii": op5_pii,
    "op6_url_filter": op6_url_filter,
    "op7_fingerprint": op7_fingerprint,
    "op8_quality": op8_quality,
    "op9_quotes": op9_quotes,
    "op10_pieces": op10_pieces,
    "op11_signature_join": op11_signature_join,
    "op12_ranked_search": op12_ranked_search,
    "op13_whitening": op13_whitening,
}
ORACLE_SQL: dict[str, str] = {
    "op3_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS kept FROM p)
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND kept <> page_id THEN kept END AS refers_to
        FROM q""",
    "op4_jaccard": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.d = e.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op6_url_filter": """
        WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        r(verdict, h, f) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fit AS (SELECT page_id, arg_max(h || f, length(h || f)) AS rule, arg_max(r.verdict, length(h || f)) AS verdict
                FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(fit.verdict, 'allow') AS verdict FROM p LEFT JOIN fit USING (page_id)""",
    "op11_signature_join": """
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        i AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM w WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS sh FROM i),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
        l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(d, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON r.d = e.x)
        SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, d.doc_id = min(r.c) AS kept FROM documents d JOIN r ON r.d = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op12_ranked_search": """
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        qn AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        g AS (SELECT count(DISTINCT doc_id) AS N, count(*) AS L FROM t),
        d AS (SELECT doc_id, 75 + (25 * count(*) * (SELECT N FROM g)) // (SELECT L FROM g) AS m FROM t GROUP BY doc_id),
        f AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM qn) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT N FROM g) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM f GROUP BY term),
        s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM f JOIN qn USING (term) JOIN w USING (term) JOIN d USING (doc_id) GROUP BY ALL)
        SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20""",
}
