"""One query per operator over the supplied tables, with the DuckDB twin where SQL can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoalcount.llm import ann, bpe, chat, exact_dedup, hard_negatives, langid, lexical, mixing, pii, quality_lm, sharding, simhash, url_filter


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_lm(spark, sf_dir):
    return quality_lm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_sharding(spark, sf_dir):
    placed = sharding.assign(_table(spark, sf_dir, "documents"), sharding.uniform_tree())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op3_bpe(spark, sf_dir):
    return bpe.encode(_table(spark, sf_dir, "documents"), bpe.production_file())


def op4_langid(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    away = langid.held_out(F.col("doc_id"))
    return langid.predict(docs, langid.train(docs.where(~away)), held_out=away)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.decide(_table(spark, sf_dir, "documents"), exact_dedup.fresh_index(spark))


def op6_url_filter(spark, sf_dir):
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.RULES)


def op7_mixing(spark, sf_dir):
    plan = mixing.schedule(_table(spark, sf_dir, "documents"), power=0.5, block_rows=32, slots=1000)
    return plan.select("doc_id", "source", "weight", "block", "slot", "position")


def op8_ann(spark, sf_dir):
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return pii.find(docs, pii.train(docs)).drop("found")


def op10_simhash(spark, sf_dir):
    rows = simhash.classify(_table(spark, sf_dir, "documents"), words=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark, sf_dir):
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").withColumn("label", noisy), F.col("vec_id") % 50 == 0)


def op12_chat(spark, sf_dir):
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.digests(_table(spark, sf_dir, "conversations").select(*added.columns).unionByName(added))


def op13_lexical(spark, sf_dir):
    return lexical.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (op1_quality_lm, op2_sharding, op3_bpe, op4_langid, op5_exact_dedup, op6_url_filter, op7_mixing, op8_ann, op9_pii, op10_simhash, op11_hard_negatives, op12_chat, op13_lexical)}

ORACLE = {
    "op7_mixing": """
    WITH RECURSIVE sized AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
    weighted AS (
        SELECT source, greatest(1, CAST(floor(1000 * sqrt(n) / (SELECT sum(sqrt(n)) FROM sized) + 0.5) AS BIGINT)) AS weight,
               row_number() OVER (ORDER BY source) AS i
        FROM sized
    ), w AS (SELECT list(weight ORDER BY i) AS ws, list(source ORDER BY i) AS names, CAST(sum(weight) AS BIGINT) AS total, count(*) AS m FROM weighted),
    run AS (
        SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS pick, list_transform(ws, lambda x: CAST(0 AS BIGINT)) AS done FROM w
        UNION ALL
        SELECT t + 1, best, list_transform(done, lambda d, i: d + CASE WHEN i = best THEN 1 ELSE 0 END)
        FROM (
            SELECT t, done, total, list_min(list_filter(list_transform(done, lambda d, i: CASE
                       WHEN d < ws[i] AND (d * total) // ws[i] <= t + 1 THEN (((d + 1) * total + ws[i] - 1) // ws[i]) * 10000 + i ELSE NULL END),
                       lambda x: x IS NOT NULL)) % 10000 AS best
            FROM run, w WHERE t + 1 < total
        )
    ), pattern AS (
        SELECT t AS place, names[pick] AS source, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn, ws[pick] AS weight, total
        FROM run, w WHERE t >= 0
    ), ranked AS (
        SELECT doc_id, coalesce(source, '') AS source,
               row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT), doc_id) - 1 AS r
        FROM documents
    ), placed AS (
        SELECT r.doc_id, r.source, p.weight, r.r // 32 AS block, ((r.r // 32) // p.weight) * p.total + p.place AS slot, r.r % 32 AS inside
        FROM ranked r JOIN pattern p ON p.source = r.source AND p.turn = (r.r // 32) % p.weight
    )
    SELECT doc_id, source, weight, block, slot, row_number() OVER (ORDER BY slot, inside) - 1 AS position FROM placed""",
    "op12_chat": r"""
    WITH t AS (
        SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), e AS (
        SELECT *, length(regexp_replace(text, '(<(\\*)(/?s>))|(\[(\\*)(/?(INST|SYS|OUT|ROLE)\]|SAYS\]))', '_\0', 'g'))
                  + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 18 WHEN 'assistant' THEN 17 ELSE length(coalesce(role, '')) + 23 END AS shown
        FROM t
    )
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(shown) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id""",
    "op13_lexical": r"""
    WITH words AS (
        SELECT row_number() OVER () AS r, doc_id,
               regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
        FROM documents
    ), d AS (SELECT r, doc_id, len(ws) AS n, ws FROM words WHERE len(ws) > 0),
    totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM d),
    asked AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ), tf AS (
        SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(ws) AS term FROM d)
        WHERE term IN (SELECT term FROM asked) GROUP BY ALL
    ), w AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, big_n),
    part AS (
        SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))) AS part FROM tf JOIN w USING (term), totals
    ), scored AS (
        SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM part JOIN asked USING (term) GROUP BY item_id, r, doc_id HAVING sum(part) > 0
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
    "op5_exact_dedup": """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
        FROM documents
    )
    SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
    FROM d""",
    "op2_sharding": """
    WITH shards AS (
        SELECT s, 'r' || (s // 12) AS region, 'r' || (s // 12) || 'k' || ((s // 4) % 3) AS rack, 's' || s AS leaf, 'both' AS tree
        FROM range(24) t(s)
        UNION ALL SELECT 24, 'r+24', 'r+24k0', 's24', 'grown'
    ), nodes AS (
        SELECT tree, '' AS parent, region AS child, count(*) AS w FROM shards GROUP BY ALL
        UNION ALL SELECT tree, region, rack, count(*) FROM shards GROUP BY ALL
        UNION ALL SELECT tree, rack, leaf, count(*) FROM shards GROUP BY ALL
    ), d AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS key, encode(coalesce(text, '')) AS b
        FROM documents
    ), scored AS (
        SELECT key, tree, parent, child,
               -ln((CAST('0x' || substr(md5('0:' || child || ':' || key), 1, 12) AS BIGINT) + 0.5) / 281474976710656) / w AS s
        FROM (SELECT DISTINCT key FROM d), nodes
    ), best AS (
        SELECT key, parent, arg_min(child, s) AS child FROM scored WHERE tree = 'both' GROUP BY key, parent
    ), wide AS (
        SELECT key, parent, arg_min(child, s) AS child FROM scored GROUP BY key, parent
    ), now AS (
        SELECT a.key, CAST(substr(c.child, 2) AS INTEGER) AS shard
        FROM best a JOIN best b ON b.key = a.key AND b.parent = a.child JOIN best c ON c.key = b.key AND c.parent = b.child
        WHERE a.parent = ''
    ), later AS (
        SELECT a.key, CAST(substr(c.child, 2) AS INTEGER) AS grown_shard
        FROM wide a JOIN wide b ON b.key = a.key AND b.parent = a.child JOIN wide c ON c.key = b.key AND c.parent = b.child
        WHERE a.parent = ''
    ), nibble AS (
        SELECT n, CAST(list_reduce([n] || range(4), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS BIGINT) AS t FROM range(16) r(n)
    ), tab AS (SELECT list(t ORDER BY n) AS ts FROM nibble),
    sums AS (
        SELECT d.*, xor(CAST(4294967295 AS BIGINT), list_reduce([CAST(4294967295 AS BIGINT)]
               || list_transform(range(2 * (size - 8)), lambda i: CAST('0x' || hx[i + 2 - 2 * (i % 2)] AS BIGINT)),
               lambda c, x: xor(c >> 4, ts[1 + (xor(c, x) & 15)]))) AS text_crc32
        FROM (SELECT *, hex(b) AS hx FROM d) d, tab
    )
    SELECT doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5('slot:' || key), 1, 8) AS BIGINT), doc_id, text_crc32, size) - 1 AS slot, grown_shard
    FROM sums JOIN now USING (key) JOIN later USING (key)""",
}
