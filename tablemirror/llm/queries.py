"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemirror.llm import (
    alignment, bpe, collocations, exact_dedup, fingerprints, html_extract, minhash, mixing, repeats, sharding, token_counts, token_store, toxicity
)
from tablemirror.llm.common import documents, shared_dir, small_batches, written

N_SHARDS = 24
MAX_REPEATS = 2.0
TOKEN_LIMIT = 2048
TOXIC_SCORE = 0.7
PHRASE_COUNT, TOP_PHRASES = 100, 2000


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the package that holds them is asked for it when a query runs."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards under the ``key`` law."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    slots = sharding.number_slots(sharding.assign_shards(rows, "doc_id", N_SHARDS), "doc_id")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every scheduled reading of a document, with no source read more than twice over."""
    docs = documents(spark, sf_dir, "doc_id", "source", "text")
    rows = docs.select("doc_id", "source", mixing.word_tokens(F.col("text")).alias("words"))
    plan = mixing.plan_mix(rows, "source", F.col("words"), max_repeats=MAX_REPEATS)
    return mixing.mix_schedule(rows, "doc_id", "source", F.col("words"), plan).drop("order_hash")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of similarity 0.85."""
    return minhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from the counts of its prefixes."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    rows = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = token_counts.prefix_counts(rows, vocabulary("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", token_counts.total_tokens().alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > TOKEN_LIMIT
    )


def held_out() -> Column:
    """Whether a document's label is never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    return toxicity.fit(docs, labels)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    scored = toxicity_model(spark, docs, sf_dir).score(docs)
    return scored.select(
        "doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= TOXIC_SCORE).cast("int").alias("predicted"),
    )


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document as read back from the shard files."""
    path = f"{shared_dir(spark)}/llm/token-shards-{uuid.uuid4().hex}"
    token_store.write_shards(documents(spark, sf_dir, "doc_id", "text"), path, vocabulary("byte_bpe_50k.json"))
    docs = token_store.read_shards(spark.read.parquet(path))
    return docs.select(
        "doc_id", "start", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.crc32("token_ids").alias("ids_crc32")
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, and whether it is the one that stays."""
    return exact_dedup.mark_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = html_extract.extract_text(pages)
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    found = fingerprints.fingerprint_with_edit(documents(spark, sf_dir, "doc_id", "text"))
    return found.withColumn("edited_sha256", F.sha2("edited_text", 256)).drop("edited_text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the transducer, and the text they decode to."""
    return bpe_digests(documents(spark, sf_dir, "doc_id", "text"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "text")
    done = bpe.encode_texts(rows, vocabulary("byte_bpe_50k.tiktoken"), split_pattern(), decode=True)
    return done.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 most telling phrases of each language."""
    phrases = collocations.frequent_phrases(documents(spark, sf_dir, "lang", "text"), PHRASE_COUNT)
    return collocations.collocations(phrases, TOP_PHRASES)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated passages, as digests."""
    found = repeats.repeated_spans(documents(spark, sf_dir, "text")).select(
        "key",
        F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)").alias("removed"),
        F.size("spans").cast("long").alias("spans"),
        F.sha2("kept", 256).alias("kept"),
    )
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("own"), repeats.text_key(F.col("text")).alias("key")
    )
    return docs.join(found, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "own").alias("kept_sha256"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of every document's tokens under two tokenizers."""
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    with small_batches(spark):
        aligned, _ = written(alignment.align_texts(docs, *paths), "aligned")  # the numbers of rows are fixed from here on
        counts, _ = written(alignment.pair_counts(aligned, *paths), "pair-counts")
        scores = alignment.link_scores(aligned, counts, "row", *paths)
    size = lambda c: F.size(c).cast("long")
    sizes = aligned.select("row", "doc_id", size("a_ids").alias("n_a"), size("b_ids").alias("n_b"), size("a_group").alias("n_groups"), "groups_sha256")
    sums = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    return sizes.join(scores, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", *sums, "groups_sha256")


ORACLE: dict[str, str] = {
    # the checksum is worked out byte by byte, because DuckDB has no function for it
    "op1_shards": """
        WITH RECURSIVE j(doc_id, k, j, shard, grown) AS (
            SELECT doc_id, doc_id::HUGEINT, 0::BIGINT, 0, 0 FROM documents
            UNION ALL
            SELECT doc_id, k2, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)))::BIGINT, CASE WHEN j < 24 THEN j ELSE shard END, j
            FROM (SELECT *, (k * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS k2 FROM j WHERE j <= 24)),
        s AS (SELECT doc_id, max(shard)::INTEGER AS shard, max(grown)::INTEGER AS grown_shard FROM j GROUP BY 1),
        bits AS (SELECT i, i::BIGINT AS c, 0 AS n FROM range(256) t(i)
            UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM bits WHERE n < 8),
        tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE n = 8),
        crc AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, t FROM documents, tab)
        SELECT doc_id, (length(h) // 2 + 8)::BIGINT AS size,
            xor(list_reduce(list_transform(range(length(h) // 2), lambda p: ('0x' || h[2 * p + 1:2 * p + 2])::BIGINT),
                lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32,
            'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard
        FROM crc JOIN s USING (doc_id)""",
    "op2_mix": r"""
        WITH RECURSIVE w AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n FROM documents),
        t AS (SELECT source, sum(n)::BIGINT AS tokens, count(*) AS rows FROM w GROUP BY 1),
        s AS (SELECT *, tokens / sum(tokens) OVER () AS share, sum(tokens) OVER () AS whole FROM t),
        r AS (SELECT max(share) / min(share) AS r FROM s),
        b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
            SELECT i + 1, CASE WHEN pow(r, 1 - (lo + hi) / 2) <= 2.0 * (1 + 1e-9) THEN lo ELSE (lo + hi) / 2 END,
                CASE WHEN pow(r, 1 - (lo + hi) / 2) <= 2.0 * (1 + 1e-9) THEN (lo + hi) / 2 ELSE hi END FROM b, r WHERE i < 32),
        a AS (SELECT CASE WHEN r <= 2.0 * (1 + 1e-9) THEN 0.0 ELSE round(hi, 9) END AS a FROM b, r WHERE i = 32),
        z AS (SELECT sum(pow(share, a)) AS z, max(share / pow(share, a)) * sum(pow(share, a)) * any_value(whole) AS budget FROM s, a),
        p AS (SELECT source, tokens, ceil(sqrt(rows)) AS blocks, round(pow(share, a) / z, 9) AS weight,
            round(round(pow(share, a) / z, 9) * budget)::BIGINT AS budget FROM s, a, z),
        q AS (SELECT *, floor(round(budget / tokens, 6))::INTEGER AS passes,
            CASE WHEN round(budget / tokens, 6) > floor(round(budget / tokens, 6)) THEN greatest(budget - floor(round(budget / tokens, 6))::BIGINT * tokens, 0) ELSE 0 END AS rest FROM p),
        e AS (SELECT w.*, tokens, weight, passes, rest, blocks, unnest(range(0, passes + CASE WHEN rest > 0 THEN 1 ELSE 0 END))::INTEGER AS pass
            FROM w JOIN q ON w.source IS NOT DISTINCT FROM q.source),
        h AS (SELECT *, ('0x' || substr(md5('0:' || pass || ':' || doc_id), 1, 15))::BIGINT AS h FROM e),
        c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source, pass ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM h)
        SELECT doc_id, source, n AS n_tokens, weight, pass, floor(h / (1152921504606846976 / blocks))::BIGINT AS block,
            (pass * tokens + before)::BIGINT AS tokens_before,
            round((pass * tokens + before + n / 2) / greatest(passes * tokens + rest, 1), 9) AS mix_position
        FROM c WHERE pass < passes OR before < rest""",
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        x AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM s),
        l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.sh = b.sh AND a.doc_id <> b.doc_id
            GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.doc_id)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept FROM c JOIN s USING (doc_id) GROUP BY doc_id, s""",
    "op7_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_collocations": r"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
        g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k)),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
        c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
        s AS (SELECT c.lang, c.phrase, c.k, c.a, c.w, cut, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
            FROM c JOIN t ON t.lang = c.lang JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
        b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        d AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
            FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM b))),
        o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.phrase = b.phrase AND 100 * d.a >= 100 * b.a))
        SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o)
        WHERE rank <= 2000""",
    "op12_repeats": """
        WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
        w AS MATERIALIZED (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT *, unnest(range(n - 399)) AS p FROM d WHERE n >= 400)),
        r AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY 1 HAVING count(*) > 1)),
        s AS (SELECT doc_id, p, CASE WHEN p > lag(p, 1, -1000) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 1 ELSE 0 END AS new FROM r),
        g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM s),
        x AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, run),
        c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, list({'a': a, 'b': b} ORDER BY a) AS l FROM x GROUP BY 1)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
            sha256(unhex(CASE WHEN l IS NULL THEN h ELSE array_to_string(list_transform(range(0, len(l) + 1), lambda i: substr(h,
                1 + 2 * CASE WHEN i = 0 THEN 0 ELSE l[i].b END,
                2 * (CASE WHEN i = len(l) THEN d.n ELSE l[i + 1].a END - CASE WHEN i = 0 THEN 0 ELSE l[i].b END))), '') END)) AS kept_sha256
        FROM d LEFT JOIN c USING (doc_id)""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_shards, op2_mix, op3_near_dedup, op4_token_counts, op5_toxicity, op6_token_store, op7_exact_dedup, op8_html_text, op9_fingerprints, op10_bpe, op11_collocations, op12_repeats, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
