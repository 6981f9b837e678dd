"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapgrid.llm import embeddings, fingerprints, lexical, mixing, pii, prefix_trie, quality, secrets, sentencepiece, sharding, simhash, toxicity, urls
from snapgrid.llm.common import read_table, remainder

#: A public model file that every machine has; its path is a parameter of the operator.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

#: Verdict, host and path of each rule.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != secrets.KINDS[-1])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in secrets.KINDS[:-1]],
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        count(secrets.KINDS[-1]),
    )


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return sentencepiece.encode(docs, sentencepiece.load_model(PIECES), check=True)


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    scored = toxicity.with_scores(docs, model, "score", ["doc_id"])
    return scored.select(
        "doc_id",
        (remainder("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pieces = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixing.taken_words(rows, pieces).select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "last_slot")


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.digits("fingerprint").alias("fingerprint"), "component_id")


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.assign(read_table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprints.with_next(read_table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprints.edited("text", "next_text"))
    rows = rows.withColumn("edited_sketch", fingerprints.sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.printed(F.col("sketch")).alias("fingerprint"),
        fingerprints.printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprints.distinct_shingles(F.col("sketch")).alias("distinct_shingles"),
        fingerprints.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
    )


@query
def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read_table(spark, sf_dir, "pages"), URL_RULES)


@query
def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.98)


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality.with_scores(docs, model).select(
        "doc_id",
        (remainder("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= quality.GOOD).cast("int").alias("predicted"),
    )


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.numbered(read_table(spark, sf_dir, "conversations"))
    rebuilt, convs = prefix_trie.with_openings(turns, group=20, openings=4)
    return prefix_trie.nodes(rebuilt, convs)


@query
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


@query
def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.find_private(docs, pii.disclosing_terms(docs))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in pii.BASE],
        F.sha2(pii.joined(base), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        *[count(k) for k in (pii.GENERALISE, pii.REMOVE)],
    )


def _url_oracle() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""WITH page AS (SELECT row_number() OVER () AS k, page_id, {host} AS host, {path} AS path FROM pages),
      rules(verdict, h, p) AS (VALUES {rules}),
      fits AS (SELECT k, h || p AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC) AS rk
        FROM page JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
      SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
      FROM page LEFT JOIN (SELECT * FROM fits WHERE rk = 1) USING (k)"""


ORACLES["op4_url_filters"] = _url_oracle()


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLES["op12_lexical"] = rf"""
    WITH held AS (SELECT row_number() OVER () AS k, doc_id,
        regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
      doc AS (SELECT k, doc_id, t, len(t) AS n FROM held WHERE len(t) > 0),
      total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc),
      tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM doc) GROUP BY k, term),
      weighed AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
      asked AS (SELECT DISTINCT q, item_id, unnest(t) AS term FROM (SELECT row_number() OVER () AS q, item_id,
        regexp_extract_all(translate(text, {_LOWER}), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL)),
      sized AS (SELECT k, doc_id, 50 + (50 * n * docs) // terms AS m FROM doc, total),
      scored AS (SELECT q, item_id, k, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
        FROM asked JOIN tf USING (term) JOIN weighed USING (term) JOIN sized USING (k) GROUP BY q, item_id, k, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored WHERE score > 0) WHERE rank <= 50"""

# One byte after the other through the eight shifts of the CRC-32 polynomial.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(conv_id::VARCHAR) + 1),
    lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""

ORACLES["op11_prefix_trie"] = rf"""
    WITH turns AS (SELECT conv_id, key, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) - 1 AS pos FROM (
        SELECT conv_id, turn, md5(length(r) || ':' || r || t) AS key, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS words
        FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL))),
      convs AS (SELECT conv_id AS c, conv_id - conv_id % 20 AS b, {_CRC} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
      rebuilt AS (SELECT c, pos, key, words FROM convs JOIN turns ON conv_id = b AND pos < h
        UNION ALL SELECT c, pos, key, words FROM convs JOIN turns ON conv_id = c AND pos >= h),
      seqs AS (SELECT c, coalesce(s, []) AS s, coalesce(w, []) AS w FROM convs LEFT JOIN
        (SELECT c, list(key ORDER BY pos) AS s, list(words ORDER BY pos) AS w FROM rebuilt GROUP BY c) USING (c)),
      paths AS (SELECT c, s, w, unnest(range(0, len(s) + 1)) AS d FROM seqs),
      node AS (SELECT s[1:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs,
          (count(*) - 1) * coalesce(CAST(max(w[d]) AS BIGINT), 0) AS saved,
          sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256
        FROM paths GROUP BY s[1:d], d),
      kids AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY p[1:d - 1]),
      own AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN kids USING (p)),
      sums AS (SELECT p[1:a] AS p, CAST(sum(CAST(n_children = 0 AS INTEGER)) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
        FROM (SELECT p, n_children, saved, unnest(range(0, d + 1)) AS a FROM own) GROUP BY p[1:a])
    SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
    FROM own JOIN sums USING (p) LEFT JOIN node AS up ON own.d > 0 AND up.d = own.d - 1 AND up.p = own.p[1:own.d - 1]"""

ORACLES["op6_embeddings"] = """
    WITH RECURSIVE vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
      links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
      reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x)
    LEFT JOIN (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x) USING (vec_id)"""


def _sharding_oracle() -> str:
    # The primes of XXH64, and the multiplier of the jump hash's generator.
    p1, p2, p3, p4, p5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
    times = lambda x, p: f"(({x})::UHUGEINT * {p}::UHUGEINT) % 18446744073709551616::UHUGEINT"
    turned = lambda x, r: f"({times(x, 2**r)}) + {x} // {2 ** (64 - r)}::UHUGEINT"
    mixed = lambda x, r: f"xor({x}, {x} // {2**r}::UHUGEINT)"
    steps = [
        times("h", p2), turned("h", 31), times("h", p1), f"xor({(42 + p5 + 8) % 2**64}::UHUGEINT, h)", turned("h", 27),
        f"({times('h', p1)} + {p4}::UHUGEINT) % 18446744073709551616::UHUGEINT", mixed("h", 33), times("h", p2), mixed("h", 29), times("h", p3), mixed("h", 32),
    ]
    hashed = "SELECT k, u::UHUGEINT AS h FROM doc WHERE doc_id IS NOT NULL"
    for step in steps:
        hashed = f"SELECT k, {step} AS h FROM ({hashed})"
    return rf"""
    WITH RECURSIVE crc AS (SELECT list(t ORDER BY b) AS tab FROM (SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: xor(x >> 1, 3988292384 * (x & 1))) AS t FROM range(256) AS r(b))),
      doc AS (SELECT row_number() OVER () AS k, doc_id, strlen(coalesce(text, '')) + 16 AS size,
        CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END AS u,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
          lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS text_crc32
        FROM documents, crc),
      jump AS (SELECT k, u AS key, -1::BIGINT AS b, 0::BIGINT AS j FROM doc
        UNION ALL SELECT k, key, j, CAST(floor((j + 1) * (2147483648::DOUBLE / CAST(key // 8589934592::HUGEINT + 1 AS DOUBLE))) AS BIGINT)
        FROM (SELECT k, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS key, j FROM jump WHERE j < 41)),
      placed AS (SELECT k, max(b) FILTER (b < 40) AS shard, max(b) AS grown FROM jump GROUP BY k),
      hashed AS ({hashed}),
      dealt AS (SELECT doc_id, size, text_crc32, shard, grown, coalesce(h, 42::UHUGEINT)::HUGEINT AS h,
        greatest(1, least(65536, count(*) OVER () // 20000)) AS buckets FROM doc JOIN placed USING (k) LEFT JOIN hashed USING (k))
    SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard, grown::INTEGER AS grown_shard,
      row_number() OVER (PARTITION BY shard ORDER BY (h // 281474976710656::HUGEINT * buckets) // 65536 * 16 + text_crc32 % 16,
        CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot
    FROM dealt"""


ORACLES["op9_sharding"] = _sharding_oracle()
