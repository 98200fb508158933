"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import counting, decontamination, embeddings, language_model, packing, quality, sharding, simhash, spelling, suffixes, tokens, trie, warc
from lumora.llm.shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose SimHash of 4-word shingles differs in at most 4 bits."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, seed=42, distance=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without bytes in strings of 200 bytes that occur again."""
    found = suffixes.deduplicated(_table(spark, sf_dir, "documents"), length=200)
    lengths = F.transform("spans", lambda x: x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("left", 256).alias("kept_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document by a model of labels.quality outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.checked(packing.pack(_table(spark, sf_dir, "documents"), tokenizer=_vocabulary(), capacity=1024))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean stupid-backoff log score of each document's words by all bigrams of all other documents."""
    found = language_model.score(_table(spark, sf_dir, "documents"), order=2, alpha=0.4)
    mean = F.when(F.col("n_words") > 0, F.round(F.col("log_score") / F.col("n_words"), 6))
    return found.select("doc_id", "n_words", "n_backoff", "n_unseen", mean.alias("mean_log_score"))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of at least 0.9."""
    found = embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Parquet lists and read back."""
    path = new_path(spark, "tokens")
    tokens.write(_table(spark, sf_dir, "documents"), path, tokenizer=_vocabulary())
    return tokens.checked(tokens.read(spark, path))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents inside 10-word windows of benchmark items."""
    found = decontamination.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), window=10)
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, equal payloads once, read back from the archives."""
    path = new_path(spark, "warc")
    warc.write(warc.resolve(_table(spark, sf_dir, "pages"), least_bytes=0), path)
    return warc.restored(warc.read(spark, path)).drop("record_id")


#: Bytes of text in a shard of op10_sharding.
SHARD_BYTES = 2 << 20


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard, read back from the shards' files, and the shard's size in the directory."""
    path = new_path(spark, "shards")
    shards = sharding.write(_table(spark, sf_dir, "documents"), path, limit=SHARD_BYTES)
    rows = spark.read.schema("doc_id long, text string, depth int, shard string").parquet(path)
    rows = rows.select("doc_id", "shard", "depth", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    sizes = shards.select("shard", F.col("n_docs").alias("shard_docs"), F.col("n_bytes").alias("shard_bytes"))
    return rows.join(sizes, "shard").select("doc_id", "shard", "depth", "n_bytes", "shard_docs", "shard_bytes")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at least 7 letters, each with the ten times as frequent word one letter away that it is a variant of."""
    words = spelling.words(_table(spark, sf_dir, "documents"), length=7, least=2, noise=31)
    return spelling.variants(words, ratio=10)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of conversations, each rebuilt with the first turns of the twentieth before it."""
    turns, convs = trie.with_heads(trie.ordered(_table(spark, sf_dir, "conversations")), every=20, most=4)
    return trie.nodes(turns, convs)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by a vocabulary of lower-case words, and whether there are over 2,048."""
    import public_tokenizers

    found = counting.count(_table(spark, sf_dir, "documents"), tokenizer=public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_suffixes": op2_suffixes,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_language_model": op5_language_model,
    "op6_embeddings": op6_embeddings,
    "op7_tokens": op7_tokens,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
    "op11_spelling": op11_spelling,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op5_language_model": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
        p AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM w),
        du AS (SELECT doc_id, w, count(*) AS n FROM w GROUP BY doc_id, w),
        db AS (SELECT doc_id, v, w, count(*) AS n FROM p WHERE v IS NOT NULL GROUP BY doc_id, v, w),
        dt AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
        u AS (SELECT w, sum(n) AS n FROM du GROUP BY w),
        b AS (SELECT v, w, sum(n) AS n FROM db GROUP BY v, w),
        t AS (SELECT sum(n) AS n FROM dt),
        c AS (SELECT p.doc_id, p.v, uw.n - ow.n AS w1, uv.n - ov.n AS v1, b.n - ob.n AS w2, greatest(t.n - dt.n, 1) AS t
              FROM p CROSS JOIN t JOIN dt ON p.doc_id = dt.doc_id JOIN u AS uw ON p.w = uw.w JOIN du AS ow ON p.doc_id = ow.doc_id AND p.w = ow.w
              LEFT JOIN u AS uv ON p.v = uv.w LEFT JOIN du AS ov ON p.doc_id = ov.doc_id AND p.v = ov.w
              LEFT JOIN b ON p.v = b.v AND p.w = b.w LEFT JOIN db AS ob ON p.doc_id = ob.doc_id AND p.v = ob.v AND p.w = ob.w),
        s AS (SELECT doc_id, w1, CASE WHEN v IS NOT NULL AND w2 >= 1 THEN ln(w2) - ln(v1)
                                      ELSE ln(greatest(w1, 1)) - ln(t) + ln(0.4) * (CASE WHEN v IS NULL THEN 0 ELSE 1 END + CASE WHEN w1 < 1 THEN 1 ELSE 0 END) END AS s,
                     CASE WHEN v IS NULL AND w1 >= 1 OR v IS NOT NULL AND w2 >= 1 THEN 0 ELSE 1 END AS k FROM c)
        SELECT d.doc_id, CAST(count(s.s) AS BIGINT) AS n_words, CAST(coalesce(sum(s.k), 0) AS BIGINT) AS n_backoff,
               CAST(count(s.s) FILTER (s.w1 < 1) AS BIGINT) AS n_unseen, round(sum(s.s) / count(s.s), 6) AS mean_log_score
        FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
    "op6_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                             WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
        r AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)""",
    "op8_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        x AS (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM b WHERE len(ws) > 0),
        p AS (SELECT DISTINCT item_id, len(list_slice(ws, k, k + 9)) AS n, array_to_string(list_slice(ws, k, k + 9), ' ') AS s FROM x),
        o AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM p)),
        q AS (SELECT doc_id, n, k, array_to_string(list_slice(ws, k, k + n - 1), ' ') AS s FROM o),
        h AS (SELECT doc_id, item_id, k, n FROM q JOIN p USING (n, s)),
        c AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM h) GROUP BY doc_id),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        f AS (SELECT d, min(page_id) AS m FROM p GROUP BY d)
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   ((('0x' || substr(d, CAST((5 * i) // 4 + 1 AS INT), 2))::INT >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
        FROM p JOIN f USING (d)""",
    "op10_sharding": f"""
        WITH d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
                          ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT AS h FROM documents),
        v AS (SELECT doc_id, n_bytes, CAST(k AS INT) AS k, h >> CAST(48 - k AS BIGINT) AS p FROM d, range(0, 31) AS r(k)),
        s AS (SELECT k, p, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n FROM v GROUP BY k, p),
        l AS (SELECT doc_id, n_bytes, min(v.k) AS k FROM v JOIN s USING (k, p) WHERE b <= {SHARD_BYTES} OR n = 1 GROUP BY ALL)
        SELECT doc_id, 's' || CASE WHEN l.k = 0 THEN '' ELSE lpad(bin(s.p), l.k, '0') END AS shard, l.k AS depth, l.n_bytes,
               s.n AS shard_docs, s.b AS shard_bytes
        FROM l JOIN v USING (doc_id, k) JOIN s USING (k, p)""",
    "op11_spelling": r"""
        WITH RECURSIVE t AS (SELECT list(list_reduce([i] || range(8), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
                             FROM range(256) AS r(i)),
        o AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
              FROM documents),
        g AS (SELECT doc_id, w, count(*) AS n, string_split(concat(doc_id, ':', w), '') AS s FROM o WHERE length(w) >= 7 GROUP BY doc_id, w),
        b AS (SELECT w, n, flatten(list_transform(s, lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x) - 64] END)) AS b FROM g),
        h AS (SELECT w, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM b, t),
        v AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
        w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
        p AS (SELECT x.word, y.word AS other, y.n FROM d AS x JOIN d AS y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
              UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.d = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.d = w.word),
        k AS (SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM p),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN k.n >= 10 * w.n THEN other END AS form, CASE WHEN k.n >= 10 * w.n THEN k.n END AS form_n
              FROM w LEFT JOIN k ON w.word = k.word AND k = 1),
        r AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON r.up = f.word)
        SELECT f.word, f.n, f.form, r.root, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word AND r.up IS NULL""",
    "op12_conversation_trie": r"""
        WITH RECURSIVE crc AS (SELECT list(list_reduce([i] || range(8), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t
                               FROM range(256) AS r(i)),
        o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p,
                     {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT DISTINCT conv_id, [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT) AS b FROM o),
        h AS (SELECT conv_id, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM s, crc),
        b AS (SELECT conv_id, p, x FROM o JOIN h USING (conv_id) WHERE p > h
              UNION ALL SELECT h.conv_id, p, x FROM h JOIN o ON o.conv_id = h.conv_id - h.conv_id % 20 AND p <= h),
        m AS (SELECT conv_id, row_number() OVER w AS depth, x, sha256(CAST(to_json(list(x) OVER w) AS VARCHAR)) AS k FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
        a AS (SELECT conv_id, depth, len(regexp_extract_all(x.t, '[^\x20\x09-\x0D]+')) AS words, k, coalesce(lag(k) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM m
              UNION ALL SELECT conv_id, 0, 0, '', NULL FROM h),
        n AS MATERIALIZED (SELECT k, min(up) AS up, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved FROM a GROUP BY k),
        c AS MATERIALIZED (SELECT n.*, (SELECT count(*) FROM n AS q WHERE q.up = n.k) AS n_children FROM n),
        r AS (SELECT k AS top, k, saved, n_children FROM c UNION ALL SELECT r.top, c.k, c.saved, c.n_children FROM r JOIN c ON c.up = r.k),
        t AS (SELECT top AS k, CAST(sum(saved) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM r GROUP BY top),
        e AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM a
              WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.conv_id = a.conv_id AND m.depth > a.depth) GROUP BY k)
        SELECT c.conv_id, c.depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM c JOIN t ON c.k = t.k LEFT JOIN e ON c.k = e.k LEFT JOIN n AS p ON c.up = p.k""",
}
