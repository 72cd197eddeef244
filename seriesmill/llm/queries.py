"""One query per operator, over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .html_text import extract_main_text, learn_weights
from .pieces import round_trip
from .quality import quality_scores
from .resampling import resample
from .sharding import histogram_shards
from .simhash import simhash_components
from .token_files import id_checksums, write_ids
from .top_products import top_products
from .toxicity import learn_lexicon, toxicity
from .url_filter import judge_urls
from .vector_codes import books_digest, compress, with_label_error

WORDS = public_tokenizers.path("word_bpe_49k.json")
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's toxicity, with a lexicon learnt from labels that are not held out."""
    docs = table(spark, sf, "documents")
    lexicon = learn_lexicon(docs, table(spark, sf, "labels").where(~held_out()), sample=20000)
    return toxicity(docs, lexicon, threshold=0.3).select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "hits")


def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that holds a benchmark item, with the items."""
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=5, share=0.8)


def op3_html_text(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's main text."""
    pages = table(spark, sf, "pages")
    weights = learn_weights(pages, sample=2000)
    return extract_main_text(pages, weights, keep=("url",)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return round_trip(table(spark, sf, "documents"), PIECES).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 24 shards of near-equal bytes."""
    return histogram_shards(table(spark, sf, "documents"), shards=24)


def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    return simhash_components(table(spark, sf, "documents"), shingle=4, distance=4)


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's URL judged by rules and aliases."""
    return judge_urls(table(spark, sf, "pages"), RULES)


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's quality by two views."""
    return quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"), threshold=0.5)


def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """All ids written in order, and every document's read back from the files."""
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(table(spark, sf, "documents"), path, WORDS, end_id=2)
    return id_checksums(spark, path)


def op10_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with the row that stands for its text."""
    return exact_groups(table(spark, sf, "documents"))


def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's weight towards the benchmark texts, and the drawn tenth ranked."""
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"), percent=10, least_words=20, seed=2024)


def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as four bytes, with its error and that of its label."""
    coded, books = compress(table(spark, sf, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    return with_label_error(coded).select(
        "vec_id", F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def op13_top_products(spark: SparkSession, sf: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    return top_products(table(spark, sf, "embeddings"), every=50, k=5, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_text": op3_html_text,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_sharding": op5_sharding,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_quality": op8_quality,
    "op9_token_files": op9_token_files,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_resampling": op11_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_top_products": op13_top_products,
}


def resampling_sql(percent: int = 10, least: int = 20, seed: int = 2024, size: int = 10000) -> str:
    """crc32 is written out: one step per bit of every distinct word's bytes."""
    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, {words} AS words FROM documents),
        items AS (SELECT {words} AS words FROM benchmark),
        used AS (SELECT r, unnest(words) AS w FROM docs),
        aimed AS (SELECT unnest(words) AS w FROM items),
        steps AS (
            SELECT w, hex(encode(w)) AS bytes, 0 AS bit, 4294967295::BIGINT AS c
            FROM (SELECT w FROM used UNION SELECT w FROM aimed)
            UNION ALL
            SELECT w, bytes, bit + 1, CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384::BIGINT) ELSE d >> 1 END
            FROM (
                SELECT *, CASE WHEN bit % 8 = 0 THEN xor(c, ('0x' || bytes[bit // 4 + 1:bit // 4 + 2])::BIGINT)
                               ELSE c END AS d
                FROM steps WHERE bit < 4 * length(bytes))),
        buckets AS (
            SELECT w, xor(c, 4294967295::BIGINT) % {size} AS bucket FROM steps WHERE bit = 4 * length(bytes)),
        s AS (SELECT bucket, count(*) AS s FROM used JOIN buckets USING (w) GROUP BY 1),
        t AS (SELECT bucket, count(*) AS t FROM aimed JOIN buckets USING (w) GROUP BY 1),
        sums AS (SELECT (SELECT count(*) FROM used) AS ss, (SELECT count(*) FROM aimed) AS ts),
        gains AS (
            SELECT bucket, CAST(floor(1000 * ln(
                (coalesce(t, 0) + 1)::DOUBLE * (ss + {size}) / ((s + 1)::DOUBLE * (ts + {size})))) AS BIGINT) AS gain
            FROM s LEFT JOIN t USING (bucket), sums),
        sizes AS (
            SELECT r, doc_id, len(words) AS n_features,
                   ('0x' || sha256('{seed}:' || doc_id)[1:8])::BIGINT AS h FROM docs),
        weights AS (SELECT r, sum(gain) AS weight FROM used JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY 1),
        scored AS (
            SELECT doc_id, n_features, coalesce(weight, 0)::BIGINT AS weight, coalesce(weight, 0)::BIGINT
                   + CAST(floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296))) AS BIGINT) AS score
            FROM sizes LEFT JOIN weights USING (r)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= {least} ORDER BY score DESC, doc_id) AS place,
                   (SELECT count(*) FROM scored WHERE n_features >= {least}) * {percent} // 100 AS k
            FROM scored)
        SELECT doc_id, n_features, weight, score,
               CASE WHEN n_features >= {least} AND place <= k THEN place END AS rank
        FROM ranked"""


def codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Every distance of every round, in doubles that hold them exactly."""
    def nearest(r: int) -> str:
        return f"""
        near{r} AS MATERIALIZED (
            SELECT id, part, arg_min(entry, far * 1024 + entry) AS entry, CAST(min(far) AS BIGINT) AS far FROM (
                SELECT c.id, c.part, b.entry, list_dot_product(c.x, c.x) - 2 * list_dot_product(c.x, b.x)
                       + list_dot_product(b.x, b.x) AS far
                FROM cuts c JOIN books{r} b USING (part))
            GROUP BY 1, 2)"""

    def moved(r: int) -> str:
        return f"""
        means{r} AS (
            SELECT part, entry, list(mean ORDER BY pos) AS x FROM (
                SELECT c.part, entry, pos, floor(sum(x[pos]) / count(*)) AS mean
                FROM near{r - 1} JOIN cuts c USING (id, part), places GROUP BY 1, 2, 3) GROUP BY 1, 2),
        books{r} AS MATERIALIZED (
            SELECT part, entry, coalesce(m.x, b.x) AS x FROM books{r - 1} b LEFT JOIN means{r} m USING (part, entry))"""

    steps = ["""
        books0 AS MATERIALIZED (
            SELECT part, id - 1 AS entry, x FROM cuts WHERE id <= %d)""" % entries]
    for r in range(rounds):
        steps += [nearest(r), moved(r + 1)]
    steps.append(nearest(rounds))
    return f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS id, vec_id, label,
                   [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        cuts AS MATERIALIZED (
            SELECT id, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x
            FROM kept, (SELECT unnest(range({parts})) AS part)),
        places AS (SELECT unnest(range(1, len(x) + 1)) AS pos FROM (SELECT x FROM cuts LIMIT 1)),
        {",".join(steps)},
        coded AS (
            SELECT id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error
            FROM near{rounds} GROUP BY 1),
        digest AS (
            SELECT sha256(string_agg(CAST(CAST(x[pos] AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos)) AS d
            FROM books{rounds}, places)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               d AS codebooks_sha256
        FROM coded JOIN kept USING (id), digest"""


ORACLES: dict[str, str] = {
    "op11_resampling": resampling_sql(),
    "op12_vector_codes": codes_sql(),
    "op13_top_products": """
        WITH kept AS MATERIALIZED (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
            FROM embeddings WHERE embedding IS NOT NULL
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM kept q JOIN kept c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY rank <= 5""",
    # No page of the tables has a canonical link or a redirect, so aliases change no verdict there.
    "op7_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        rules (verdict, rule_host, rule_path) AS (
            VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
                   ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
        fits AS (
            SELECT page_id, p.host, p.path, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC) AS nth
            FROM parts p LEFT JOIN rules
              ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE nth = 1""",
    "op10_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
            FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY content) AS group_size,
               row_number() OVER w = 1 AS kept, sha256(content) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY content ORDER BY len DESC, doc_id)""",
}
