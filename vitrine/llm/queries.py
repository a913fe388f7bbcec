"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.session import table

from . import bytepairs, chat, classifier, decontaminate, divergence, minhash, packing, rules, sharding, suffixes, tokens, vectorcodes, warc
from .shared import scratch_path


def tokenizer(name: str) -> str:
    """The place of a public vocabulary file, the same on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2, window=4096)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens"
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder, min_revisit_bytes=0)
    return warc.read_archives(spark, folder, archives, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judged(docs, rules.trained(docs, table(spark, sf_dir, "labels")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(tricky).alias("text"),
    )
    return chat.digests(chat.format_conversations(given.unionByName(own)))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"), least=0.8)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards, seed = 16, 20240601
    folder = sharding.write_shards(spark, table(spark, sf_dir, "documents"), shards=shards, seed=seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    shown = {"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(F.encode(text, "UTF-8"))}
    return sharding.read_shards(spark, folder, shown).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", sharding.shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard")
    )


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return suffixes.repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", shown("repeated").alias("repeated"), shown("cut").alias("cut"), words("repeated").alias("repeated_words"), words("cut").alias("cut_words")
    )


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.trained(docs, table(spark, sf_dir, "labels"), "quality")
    return classifier.scored(docs, model, least=0.3).select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), limit=1024)


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compressed(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    digest = F.lit(vectorcodes.books_sha256(books))
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"), min_docs=30, top=50).select("lang", "source", "part", "item", "value", "rank")


def op13_bytepairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = tokenizer("byte_bpe_50k.tiktoken")
    coded = bytepairs.decoded(bytepairs.encoded(table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_rules": op3_rules,
    "op4_chat": op4_chat,
    "op5_minhash": op5_minhash,
    "op6_decontaminate": op6_decontaminate,
    "op7_sharding": op7_sharding,
    "op8_suffixes": op8_suffixes,
    "op9_classifier": op9_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_vectorcodes": op11_vectorcodes,
    "op12_divergence": op12_divergence,
    "op13_bytepairs": op13_bytepairs,
}

SQL = {
    "op8_suffixes": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+') AS t FROM documents
        ), win AS (
            SELECT doc_id, i, hash(list_slice(t, i + 1, i + 50)) AS h FROM (SELECT doc_id, t, unnest(range(len(t) - 49)) AS i FROM w WHERE len(t) >= 50)
        ), grp AS (
            SELECT h, min(doc_id) AS low FROM win GROUP BY 1 HAVING min(doc_id) <> max(doc_id)
        ), hit AS (
            SELECT 'repeated' AS kind, doc_id, i FROM win JOIN grp USING (h) UNION ALL SELECT 'cut', doc_id, i FROM win JOIN grp USING (h) WHERE doc_id > low
        ), isl AS (
            SELECT kind, doc_id, i, sum(fresh) OVER (PARTITION BY kind, doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS n
            FROM (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY kind, doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit)
        ), span AS (
            SELECT kind, doc_id, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY kind, doc_id, n
        ), doc AS (
            SELECT kind, doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS list, CAST(sum(b - a) AS BIGINT) AS words FROM span GROUP BY 1, 2
        )
        SELECT r.doc_id, r.list AS repeated, coalesce(c.list, '') AS cut, r.words AS repeated_words, coalesce(c.words, 0) AS cut_words
        FROM (SELECT * FROM doc WHERE kind = 'repeated') r LEFT JOIN (SELECT * FROM doc WHERE kind = 'cut') c ON r.doc_id = c.doc_id
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages
        ), r AS (
            SELECT *, max(page_id) OVER (PARTITION BY d) AS response_id, count(*) OVER (PARTITION BY d) AS n FROM p
        )
        SELECT page_id,
               CAST(strlen(html) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((CAST('0x' || substr(d, CAST(i // 4 AS INT) * 5 + 1, 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN n > 1 AND page_id <> response_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n > 1 AND page_id <> response_id THEN response_id END AS refers_to
        FROM r
    """,
    "op4_chat": r"""
        WITH source AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL
            SELECT -1, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)
        ), turns AS (
            SELECT *, regexp_matches(text || role, '[<\[]~*(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/?TEXT\])') AS risky,
                   regexp_replace(text, '([<\[])(~*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/?TEXT\])', '\1~\2\3', 'g') AS safe,
                   regexp_replace(role, '([<\[])(~*)(/?s>|<SYS>>|</SYS>>|/?INST\]|/?ROLE\]|/?TEXT\])', '\1~\2\3', 'g') AS safe_role
            FROM source
        ), marked AS (
            SELECT *, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE length(safe_role) + 26 END AS marks FROM turns
        )
        SELECT conv_id,
               count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(marks + length(safe)) AS BIGINT) AS formatted_chars,
               bool_or(risky) AS escaped
        FROM marked GROUP BY conv_id
    """,
    "op11_vectorcodes": """
        WITH v AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 256) AS BIGINT)) AS x
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), part AS (
            SELECT k, vec_id, label, p, list_slice(x, p * (len(x) // 16) + 1, (p + 1) * (len(x) // 16)) AS x FROM v, (SELECT unnest(range(16)) AS p)
        ), book0 AS (
            SELECT p, k - 1 AS e, x FROM part WHERE k <= 64
        ), near0 AS (
            SELECT part.k, part.p, arg_min(book0.e, (list_sum(list_transform(list_zip(part.x, book0.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), book0.e)) AS e FROM part JOIN book0 USING (p) GROUP BY 1, 2
        ), flat AS (
            SELECT k, p, unnest(x) AS c, generate_subscripts(x, 1) AS j FROM part
        ), mean0 AS (
            SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT near0.p, e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m FROM near0 JOIN flat USING (k, p) GROUP BY 1, 2, 3) GROUP BY 1, 2
        ), book1 AS (
            SELECT p, e, coalesce(mean0.x, book0.x) AS x FROM book0 LEFT JOIN mean0 USING (p, e)
        ), near1 AS (
            SELECT part.k, part.p, arg_min(book1.e, (list_sum(list_transform(list_zip(part.x, book1.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), book1.e)) AS e FROM part JOIN book1 USING (p) GROUP BY 1, 2
        ), mean1 AS (
            SELECT p, e, list(m ORDER BY j) AS x FROM (SELECT near1.p, e, j, CAST(floor(sum(c) / count(*)) AS BIGINT) AS m FROM near1 JOIN flat USING (k, p) GROUP BY 1, 2, 3) GROUP BY 1, 2
        ), book2 AS (
            SELECT p, e, coalesce(mean1.x, book1.x) AS x FROM book1 LEFT JOIN mean1 USING (p, e)
        ), near2 AS (
            SELECT part.k, part.p, min((list_sum(list_transform(list_zip(part.x, book2.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), book2.e)) AS best FROM part JOIN book2 USING (p) GROUP BY 1, 2
        ), coded AS (
            SELECT k, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near2 GROUP BY 1
        ), digest AS (
            SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM v JOIN coded USING (k), digest
    """,
    "op12_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
            FROM documents
        ), w AS (SELECT row_id, lang, source, unnest(found) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT row_id) >= 30),
        n AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
        g AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS total FROM kept GROUP BY 1),
        gn AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM n GROUP BY 1, 2),
        p AS (
            SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n,
                   1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(gn.total, 0) + 5 * v.v) AS p,
                   1 + (1000000000::HUGEINT * (kept.total + 5)) // (v.total + 5 * v.v) AS q
            FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
            LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = kept.term
        ), pair AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN (SELECT x.lang, x.source AS x, y.source AS y, sum(abs(x.p - y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY 1, 2, 3) s
            ON s.lang = a.lang AND s.x = a.source AND s.y = b.source
        ), top AS (
            SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM top)
        )
        SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
}
