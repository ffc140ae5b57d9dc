"""Registered queries of the training-data operators, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chatloom.llm import bpe, centroids, exact_dedup, html_extract, line_dedup, lm_score, minhash, mixing, phrases, quality_rules, table_bpe, token_output, url_filter
from chatloom.llm.common import scratch, tokenizer_file
from chatloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


@query()
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and its source's target."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")


#: The rules of the URL query.
URL_RULES = [url_filter.parse_rule(x) for x in ("block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/")]


@query()
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL; URLs without a rule are judged by the models."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)


@query()
def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


#: A line without blanks at its ends, A-Z in lower case.
_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_ALPHABET})"


@query(f"""
    WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM s),
    k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
    c AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
    j AS (SELECT k.*, c.top IS NOT NULL AND k.doc_id <> c.top AS gone FROM k LEFT JOIN c USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM j GROUP BY doc_id
""")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, dropped lines and the digest of what stays."""
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.apply(docs, line_dedup.bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and the digests of its ids and of the text decoded from them."""
    path = tokenizer_file("word_bpe_49k.json")
    tokens = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return tokens.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


@query()
def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network and unigram scores of every document, learned from the documents that are not held out."""
    return lm_score.score(table(spark, sf_dir, "documents"))


@query(f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_ALPHABET}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
            ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
    c AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN c USING (doc_id) LEFT JOIN n ON n.doc_id = d.doc_id
""")
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: two-word shingles, similarity 0.8 or more."""
    return minhash.groups(table(spark, sf_dir, "documents"), shingle=2)


@query("""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
""")
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of equal texts; the largest id stays."""
    return exact_dedup.classes(table(spark, sf_dir, "documents"), keep="largest")


@query()
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, base rule and learned verdict of every document."""
    judged, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets, lengths and checksums of all documents' ids, from the ORC files written."""
    out = scratch(spark)
    token_output.write(table(spark, sf_dir, "documents"), out, tokenizer_file("byte_bpe_50k.json"))
    return token_output.with_crc32(token_output.read(spark, out))


@query()
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and the digests of its ids and of the bytes decoded from them."""
    import public_tokenizers

    path, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    tokens = table_bpe.decode(table_bpe.encode(table(spark, sf_dir, "documents"), path, pattern), path, pattern)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(f"""
    WITH w AS (
        SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), {_ALPHABET}), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents),
    p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM w),
    g AS (
        SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
        FROM p, (SELECT unnest([1, 2, 3]) AS m) WHERE len(ws) >= m),
    c AS (SELECT lang, m, phrase, count(*) AS n FROM g GROUP BY ALL),
    t AS (SELECT lang, sum(n)::BIGINT AS n FROM c WHERE m = 1 GROUP BY lang),
    f AS (SELECT lang, m, phrase, n, string_split(phrase, ' ') AS ws FROM c WHERE n >= 10),
    k AS (SELECT lang, m, phrase, n AS a, ws, unnest(range(1, m)) AS k FROM f WHERE m > 1),
    s AS (
        SELECT k.lang, k.m, k.phrase, k.a, k.ws, k.k, x.n AS l, y.n AS r, (1000000::HUGEINT * k.a * k.a // (x.n::HUGEINT * y.n))::BIGINT AS score
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.ws[1:k.k], ' ')
            JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    o AS (
        SELECT lang, phrase, max(a) AS a
        FROM (SELECT lang, n AS a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase FROM f WHERE m = 3) GROUP BY ALL),
    z AS (
        SELECT b.* FROM b LEFT JOIN o USING (lang, phrase) WHERE o.a IS NULL OR 100 * o.a < 50 * b.a
        QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) <= 2000)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score FROM z JOIN t USING (lang)
""")
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of two and three words of each language."""
    return phrases.mine(table(spark, sf_dir, "documents"))


def _clusters_sql(rounds: int = 10) -> str:
    """Every round as two steps: vectors to centroids, then centroids to the means."""
    near = """
        a{k} AS MATERIALIZED (
            SELECT vec_id, min({{'d': d, 'k': k}}) AS near
            FROM (SELECT q.vec_id, c.k, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d FROM q JOIN c{k} c USING (i) GROUP BY ALL) GROUP BY vec_id)"""
    move = """
        c{n} AS MATERIALIZED (
            SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
                SELECT near.k AS k, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x
                FROM q JOIN a{k} USING (vec_id) GROUP BY ALL) m ON m.k = c.k AND m.i = c.i)"""
    steps = ", ".join(near.format(k=k) + "," + move.format(k=k, n=k + 1) for k in range(rounds)) + "," + near.format(k=rounds)
    return f"""
        WITH e AS (
            SELECT vec_id, embedding AS v FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
        q AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS i, floor(1024 * unnest(v)::DOUBLE)::BIGINT AS x FROM e),
        s AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM e QUALIFY k < 8),
        c0 AS MATERIALIZED (SELECT k, i, x FROM q JOIN s USING (vec_id)), {steps},
        h AS (SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
        SELECT vec_id, near.k::INT AS cluster, near.d AS distance, (sum(near.d) OVER (PARTITION BY near.k))::BIGINT AS cluster_inertia,
            (sum(near.d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN h ON h.k = near.k
    """


@query(_clusters_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and exact distance of every vector, after ten rounds from eight vectors chosen by digest."""
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroids.digest(F.col("centroid")).alias("centroid_sha256"))
