"""The operators as queries over the test tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import best_fit, bpe, html_text, kneser_ney, merkle, middle, packing, pii, quality, secrets, simhash, top_k, url_lists
from tablewright.llm.shared import stored, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


_START = 1_704_067_200  # 2024-01-01 in seconds
_DAY = 86_400


def _draw(text: str) -> str:
    return f"cast(conv(substr(md5({text}), 1, 6), 16, 10) as bigint)"


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries on hosts, domains and prefixes of the pages, drawn by hash: added, removed, added again."""
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    labels = "split(host, '[.]')"
    kinds = (
        ("spam", "host", "host", 2, 4),
        ("adult", "domain", f"array_join(slice({labels}, greatest(size({labels}) - 1, 1), 2), '.')", 5, 1),
        ("adult", "domain", f"array_join(slice({labels}, 2, size({labels})), '.')", 4, 2),
        ("malware", "prefix", "concat(host, '/en')", 3, 3),
    )
    structs = ", ".join(
        f"named_struct('list', '{name}', 'kind', '{kind}', 'pattern', {pattern}, 'n', {_draw('host')}, 'every', {every}, 'times', {times})"
        for name, kind, pattern, every, times in kinds
    )
    parts = hosts.selectExpr(f"inline(array({structs}))")
    drawn = parts.filter("n % every = 0 AND pattern <> ''").selectExpr("*", "explode(sequence(0, times - 1)) as k")
    return drawn.selectExpr(
        "list", "kind", "pattern", "if(k % 2 = 0, 'add', 'remove') as action",
        f"{_START} + (n % 150 + 60 * k) * {_DAY} as at")


def op3_url_lists(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    fetched = F.expr(f"{_START} + (page_id * 104729 % 360) * {_DAY} + page_id % {_DAY}")
    return url_lists.evaluate(pages.withColumn("fetched_at", fetched), list_entries(pages))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"))


def _is(kind: str) -> Callable[[Column], Column]:
    return lambda span: span.kind == kind


def op5_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return top_k.top_k(table(spark, folder, "embeddings"))


def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(table(spark, folder, "documents"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, pii.written(F.col("spans")).alias("spans"))


def op7_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = kneser_ney.train(docs.filter(~kneser_ney.held_out()))
    scored = kneser_ney.score(docs, model, flag=kneser_ney.held_out())
    return scored.select(
        "doc_id", F.col("flag").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_html(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(table(spark, folder, "documents"))
    counts = [F.size(F.filter("spans", _is(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    base = F.sha2(secrets.written(F.filter("spans", lambda s: s.kind.isin(*secrets.BASE))), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op11_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit.pack(table(spark, folder, "documents"), tokenizer_file("word_bpe_49k.json"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    frames = stored(middle.store(table(spark, folder, "documents")), "frames")
    return middle.digests(middle.transform(frames))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    bent = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    # a decimal, as the largest long has no successor
    n_chars = F.col("n_chars").cast("decimal(38,0)") + F.when(bent, 1).otherwise(0)
    return merkle.verified(merkle.manifest(docs, claimed={"n_chars": n_chars}))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_url_lists": op3_url_lists,
    "op4_packing": op4_packing,
    "op5_top_k": op5_top_k,
    "op6_pii": op6_pii,
    "op7_kneser_ney": op7_kneser_ney,
    "op8_quality": op8_quality,
    "op9_html": op9_html,
    "op10_secrets": op10_secrets,
    "op11_best_fit": op11_best_fit,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op3_url_lists": """
        WITH c AS (
          SELECT page_id, url, 1704067200 + (page_id * 104729 % 360) * 86400 + page_id % 86400 AS fetched_at,
            rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.') AS host,
            regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1) AS path
          FROM pages
        ), h AS (
          SELECT host, string_split(host, '.') AS labels, CAST(CAST('0x' || substr(md5(host), 1, 6) AS INTEGER) AS BIGINT) AS n
          FROM (SELECT DISTINCT host FROM c WHERE host <> '')
        ), d AS (
          SELECT 'spam' AS list, 'host' AS kind, host AS pattern, n, 2 AS every, 4 AS times FROM h
          UNION ALL SELECT 'adult', 'domain', array_to_string(labels[-2:], '.'), n, 5, 1 FROM h
          UNION ALL SELECT 'adult', 'domain', array_to_string(labels[2:], '.'), n, 4, 2 FROM h
          UNION ALL SELECT 'malware', 'prefix', host || '/en', n, 3, 3 FROM h
        ), e AS (
          SELECT list, kind, pattern, 1704067200 + (n % 150 + 60 * k) * 86400 AS "at",
            max(CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END) AS action
          FROM d, range(4) AS r(k) WHERE n % every = 0 AND pattern <> '' AND k < times GROUP BY ALL
        ), i AS (
          SELECT list, kind, pattern, action, "at" AS valid_from,
            lead("at") OVER (PARTITION BY list, kind, pattern ORDER BY "at") AS valid_to FROM e
        ), m AS (
          SELECT u.url, u.fetched_at, i.list, i.valid_from
          FROM (SELECT DISTINCT url, fetched_at, host, path FROM c) u JOIN i ON i.action = 'add'
            AND i.valid_from <= u.fetched_at AND (i.valid_to IS NULL OR u.fetched_at < i.valid_to)
            AND CASE i.kind WHEN 'host' THEN u.host = i.pattern
              WHEN 'domain' THEN u.host = i.pattern OR ends_with(u.host, '.' || i.pattern)
              ELSE u.host || u.path = i.pattern OR starts_with(u.host || u.path, i.pattern || '/') END
        ), g AS (
          SELECT url, fetched_at, count(*) AS n_active, min(valid_from) AS listed_since,
            array_to_string(list_sort(list(DISTINCT list)), ',') AS lists FROM m GROUP BY ALL
        )
        SELECT c.page_id, c.url, c.fetched_at, g.n_active IS NOT NULL AS blocked, coalesce(g.n_active, 0) AS n_active,
          coalesce(g.lists, '') AS lists, g.listed_since
        FROM c LEFT JOIN g ON c.url = g.url AND c.fetched_at = g.fetched_at""",
    "op5_top_k": """
        WITH v AS (
          SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
          FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(
            list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), s AS (
          SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0
        ), k AS (
          SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 10""",
    "op12_fill_in_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
            regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
          FROM documents
        ), c AS (
          SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
          FROM d
        ), p AS (
          SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
            array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM c
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM p""",
    "op13_merkle": """
        WITH RECURSIVE field AS (
          SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS g,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
              || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars::HUGEINT AS told,
            list_reduce(string_split(doc_id::VARCHAR, ''), lambda crc, c: list_reduce(range(8),
              lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, ascii(c)::BIGINT)), 4294967295) AS crc
          FROM documents
        ), leaves AS (
          SELECT r, doc_id, g, sha256(head || coalesce(strlen(told::VARCHAR) || ':' || told, '-') || tail) AS leaf,
            sha256(head || coalesce(strlen(bent::VARCHAR) || ':' || bent, '-') || tail) AS claimed
          FROM (SELECT *, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN told + 1 ELSE told END AS bent FROM field)
        ), placed AS (
          SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves
        ), tree(g, level, i, h, n) AS (
          SELECT g, 0, i, leaf, n FROM placed
          UNION ALL SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, i // 2, n
        ), subroots AS (
          SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
        ), tops(level, i, h, n) AS (
          SELECT 0, i, subroot, n FROM subroots
          UNION ALL SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, i // 2, n
        ), walk(r, g, level, i, n, h, proof) AS (
          SELECT r, g, 0, i, n, claimed, '' FROM placed
          UNION ALL SELECT w.r, w.g, w.level + 1, w.i // 2, (w.n + 1) // 2,
            sha256(CASE WHEN w.i % 2 = 0 THEN w.h || coalesce(t.h, '') ELSE t.h || w.h END), w.proof || coalesce(t.h, '')
          FROM walk w LEFT JOIN tree t ON t.g = w.g AND t.level = w.level AND t.i = xor(w.i, 1) WHERE w.n > 1
        ), climb(r, level, i, n, h, proof) AS (
          SELECT w.r, 0, s.i, s.n, w.h, w.proof FROM walk w JOIN subroots s ON s.g = w.g WHERE w.n = 1
          UNION ALL SELECT w.r, w.level + 1, w.i // 2, (w.n + 1) // 2,
            sha256(CASE WHEN w.i % 2 = 0 THEN w.h || coalesce(t.h, '') ELSE t.h || w.h END), w.proof || coalesce(t.h, '')
          FROM climb w LEFT JOIN tops t ON t.level = w.level AND t.i = xor(w.i, 1) WHERE w.n > 1
        )
        SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
        FROM leaves l JOIN subroots s ON s.g = l.g JOIN climb c ON c.r = l.r AND c.n = 1 JOIN tops t ON t.n = 1""",
}
