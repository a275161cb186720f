"""One query for each operator of this subpackage, over its whole table.

The operators have general interfaces and real outputs; the queries name the
table and the production parameters and derive the columns that are compared.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, decontaminate, exact_dedup, langid, lexical, lm_score, merkle, mixing, quality_rules, secrets, simhash, token_counts, url_filter
from plumbline.llm.common import sha256, table


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"], decoded="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = lm_score.score_corpus(docs, keep=["doc_id"])
    return done.select("doc_id", "n_words", "log_likelihood", F.try_divide("log_likelihood", "n_words").alias("mean_log_likelihood"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1)).alias("first_slot"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = langid.identify(docs, langid.train(docs), keep=["doc_id"])
    return done.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality_rules.judge(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The listed entries: host, path prefix, verdict.
LISTED = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(LISTED, "host string, path string, verdict string"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.col("items")
    return done.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), sha256(F.array_join(items, ",")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    done = merkle.manifest(table(spark, sf_dir, "documents"), tampered={"n_chars": F.col("n_chars") + 1}, when=when)
    return done.select("doc_id", "leaf", "subroot", "root", sha256(F.array_join("proof.hash", "")).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_round_trip,
        op2_pseudo_likelihood,
        op3_secret_scan,
        op4_simhash_near_dedup,
        op5_source_mix,
        op6_language_id,
        op7_section_tokens,
        op8_exact_dedup,
        op9_quality_rules,
        op10_url_filter,
        op11_decontaminate,
        op12_lexical_search,
        op13_merkle_manifest,
    )
}
#: Patterns of secrets, as SQL: name, pattern, group of the value.
PATTERNS_SQL = [
    ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2),
    ("access", "AKIA[A-Z0-9]+", 0),
    ("hex", "[0-9a-f]+", 0),
    ("owned", "[A-Za-z0-9+/_=-]{20,}", 0),
]
#: One table for each pattern: id, kind, value, a, z. A match starts where the gaps and matches before it end.
MATCHES_SQL = ", ".join(
    f"""{name} AS (
            SELECT id, {kind} AS kind, value, (sum(length(gap) + length(w)) OVER (PARTITION BY id ORDER BY i) - length(w))::BIGINT AS a, (sum(length(gap) + length(w)) OVER (PARTITION BY id ORDER BY i))::BIGINT AS z
            FROM (SELECT id, unnest(range(len(ws))) AS i, unnest(ws) AS w, unnest(vs) AS value, unnest(gaps[:len(ws)]) AS gap
                  FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS ws, regexp_extract_all(text, '{pattern}', {group}) AS vs, string_split_regex(text, '{pattern}') AS gaps FROM t))
        )"""
    for kind, (name, pattern, group) in enumerate(PATTERNS_SQL)
)
ORACLE_SQL: dict[str, str] = {
    "op3_secret_scan": rf"""
        WITH t AS (
            SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents
        ), {MATCHES_SQL}, f AS (
            SELECT * FROM assign WHERE length(value) >= 6 UNION ALL SELECT * FROM access WHERE length(value) >= 20 UNION ALL SELECT * FROM hex WHERE length(value) >= 24
        ), o AS (
            SELECT * FROM owned ANTI JOIN f ON owned.id = f.id AND owned.a < f.z AND f.a < owned.z
            WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND list_aggregate(string_split(value, ''), 'entropy') >= 3.5e0
        ), e AS (
            SELECT x.*, source, sha256(text) AS repository FROM (SELECT * FROM f UNION ALL SELECT * FROM o) AS x JOIN t USING (id)
        ), n AS (
            SELECT value, count(DISTINCT coalesce('=' || source, '')) AS owners, count(*) AS repositories FROM (SELECT DISTINCT value, source, repository FROM e) GROUP BY value
        ), j AS (
            SELECT e.*, owners = 1 AND repositories <= 5 AS live, owners >= 3 AS copied, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || z AS shown FROM e JOIN n USING (value)
        ), g AS (
            SELECT id, string_agg(shown, ',' ORDER BY a, kind) FILTER (WHERE kind < 3) AS base, string_agg(shown, ',' ORDER BY a, kind) FILTER (WHERE kind < 3 OR live) AS spans,
                   count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
                   count(*) FILTER (WHERE kind < 3 AND live) AS n_live, count(*) FILTER (WHERE kind < 3 AND copied) AS n_copied, count(*) FILTER (WHERE kind < 3 AND NOT live AND NOT copied) AS n_shared
            FROM j GROUP BY id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(n_shared, 0) AS n_shared
        FROM t LEFT JOIN g USING (id)
    """,
    "op8_exact_dedup": """
        WITH t AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)
    """,
    "op5_source_mix": r"""
        WITH t AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                   md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS o
            FROM documents
        ), s AS (
            SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place
            FROM t GROUP BY source
        ), w AS (
            SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0e0 WHEN 1 THEN 2.0e0 ELSE 1.0e0 END AS weight, 2 * source_size AS lim,
                   1.5e0 * sum(source_size) OVER () AS total
            FROM s
        ), r AS (
            SELECT *, coalesce(sum(lim) OVER b, 0) AS full_before,
                   sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open_weight
            FROM w WINDOW b AS (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), l AS (
            SELECT *, max((total - full_before) / open_weight) OVER () AS level
            FROM r
        ), g AS (
            SELECT source, place, source_size, least(weight * level, lim) AS target, round(least(weight * level, lim))::BIGINT AS goal FROM l
        ), k AS (
            SELECT *, (goal + 1023) // 1024 AS blocks, coalesce(sum((goal + 1023) // 1024) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low,
                   sum((goal + 1023) // 1024) OVER ()::BIGINT AS n
            FROM g
        ), m AS (
            SELECT max(n) AS n, greatest(1, ceil(log2(max(n))))::INT AS bits FROM k
        ), c AS (
            SELECT point, ('0b' || reverse(lpad(bin(point), bits, '0')))::BIGINT AS slot, bits, n
            FROM m, generate_series(0, (2 ** bits)::BIGINT - 1) AS x(point)
        ), z AS (
            SELECT place, blocks, slot, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank
            FROM c JOIN k ON k.low * (2 ** bits)::BIGINT <= point * c.n AND point * c.n < (k.low + k.blocks) * (2 ** bits)::BIGINT
        ), p AS (
            SELECT t.*, g.place, g.source_size, g.target, g.goal,
                   sum(size) OVER (PARTITION BY t.source ORDER BY (size > 0), o, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
            FROM t JOIN g ON t.source IS NOT DISTINCT FROM g.source
        ), e AS (
            SELECT p.*, turn, (start + turn * source_size)::BIGINT AS a, least(start + turn * source_size + size, goal)::BIGINT AS b
            FROM p, (VALUES (0), (1)) AS v(turn)
        ), h AS (
            SELECT e.place, start, size, min(slot) AS first_slot
            FROM e JOIN (SELECT * FROM z WHERE rank < blocks) AS z ON b > a AND e.place = z.place AND rank BETWEEN a // 1024 AND (b - 1) // 1024
            GROUP BY ALL
        )
        SELECT doc_id, p.size::BIGINT AS size, source_size::BIGINT AS source_size, target, coalesce(h.first_slot, -1) AS first_slot,
               (greatest(0, least(start + p.size, goal) - start) + greatest(0, least(start + source_size + p.size, goal) - start - source_size))::BIGINT AS taken
        FROM p LEFT JOIN h USING (place, start, size)
    """,
    "op9_quality_rules": r"""
        WITH t AS (
            SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), l AS (
            SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
        ), v AS (
            SELECT id, i, array_to_string(w[i:i + 7], ' ') AS words FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) > 7)
        ), d AS (
            SELECT id, count(DISTINCT i + k) AS n_repeat_words
            FROM (SELECT id, i, count(*) OVER (PARTITION BY id, words) AS n FROM v), range(8) AS x(k) WHERE n > 1 GROUP BY id
        ), f AS (
            SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
            FROM t LEFT JOIN l USING (id) LEFT JOIN d USING (id)
        ), j AS (
            SELECT *, unnest(['short', 'repeated', 'symbols', 'lines']) AS rule,
                   unnest([n_words < 20, 100 * n_repeat_words > 30 * n_words, 10 * n_symbols > 3 * n_words, n_dup_lines > 0.3e0 * n_lines]) AS hit
            FROM f
        ), h AS (
            SELECT source, rule, count(*) AS n, count(*) FILTER (WHERE hit) AS bad FROM j GROUP BY ALL
        ), m AS (
            SELECT rule, count(*) AS hosts, sum(n) AS docs, sum(bad) / sum(n)::DOUBLE AS mean, sum(bad * bad / n::DOUBLE) / sum(n) AS square FROM h GROUP BY rule
        ), p AS (
            SELECT rule, mean, least(greatest(mean * (1 - mean) / greatest(square - mean * mean - mean * (1 - mean) * hosts / greatest(docs, 1), 1e-6) - 1, 1.0e0), 1e6) AS size FROM m
        ), g AS (
            SELECT source, max((bad + mean * size) / (n + size)) > 0.5e0 AS host_failed FROM h JOIN p USING (rule) GROUP BY source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
               NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT host_failed AS kept
        FROM f JOIN g ON f.source IS NOT DISTINCT FROM g.source
    """,
    "op11_decontaminate": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, doc_id,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), q AS (
            SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS words
            FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM b) WHERE k > 0)
        ), o AS (
            SELECT id, k, i, array_to_string(w[i:i + k - 1], ' ') AS words
            FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(w) >= k)
        ), h AS (
            SELECT id, item, i, k FROM o JOIN q USING (k, words)
        ), n AS (
            SELECT id, count(DISTINCT i + x) AS n_hit FROM h, range(10) AS r(x) WHERE x < k GROUP BY id
        ), s AS (
            SELECT id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT id, item FROM h) GROUP BY id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n USING (id) LEFT JOIN s USING (id)
    """,
    "op12_lexical_search": r"""
        WITH t AS (
            SELECT row_number() OVER () AS id, doc_id,
                   unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
            FROM documents
        ), c AS (
            SELECT *, (sum(tf) OVER (PARTITION BY id))::BIGINT AS n FROM (SELECT id, doc_id, term, count(*) AS tf FROM t GROUP BY id, doc_id, term)
        ), s AS (
            SELECT count(DISTINCT id) AS docs, count(*) AS terms FROM t
        ), f AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY term), s
        ), p AS (
            SELECT term, id, doc_id, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS impact FROM c JOIN f USING (term), s
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), r AS (
            SELECT item_id, id, doc_id, sum(impact)::BIGINT AS score FROM q JOIN p USING (term) GROUP BY item_id, id, doc_id
        )
        SELECT item_id, rank::INT AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
    """,
    "op13_merkle_manifest": r"""
        WITH RECURSIVE t AS (
            SELECT row_number() OVER () AS id, *,
                   list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
                       lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))) AS crc
            FROM documents
        ), p AS (
            SELECT id, doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                   coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n, coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS other,
                   coalesce(strlen(text) || ':' || text, '-') AS z, coalesce(xor(crc, 4294967295::BIGINT) % 7 = 0, false) AS hit
            FROM t
        ), l AS (
            SELECT id, doc_id, lang, sha256(a || n || z) AS leaf, sha256(a || CASE WHEN hit THEN other ELSE n END || z) AS seen FROM p
        ), i AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l
        ), nodes AS (
            SELECT lang, 0 AS level, idx, leaf AS h, count(*) OVER (PARTITION BY lang) AS c FROM i
            UNION ALL
            SELECT lang, level + 1, idx // 2, sha256(h || coalesce(nxt, '')), (c + 1) // 2
            FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY idx) AS nxt FROM nodes) WHERE idx % 2 = 0 AND c > 1
        ), subroots AS (
            SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS c FROM nodes WHERE c = 1
        ), tops AS (
            SELECT 0 AS level, idx, h, c FROM subroots
            UNION ALL
            SELECT level + 1, idx // 2, sha256(h || coalesce(nxt, '')), (c + 1) // 2 FROM (SELECT *, lead(h) OVER (ORDER BY idx) AS nxt FROM tops) WHERE idx % 2 = 0 AND c > 1
        ), steps AS (
            SELECT i.id, v.level AS k, s.h, CASE WHEN (i.idx >> v.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '') AS step
            FROM i JOIN (SELECT DISTINCT lang, level FROM nodes WHERE c > 1) AS v ON i.lang IS NOT DISTINCT FROM v.lang
            LEFT JOIN nodes AS s ON s.lang IS NOT DISTINCT FROM i.lang AND s.level = v.level AND s.idx = xor(i.idx >> v.level, 1)
            UNION ALL
            SELECT i.id, 1000 + v.level, s.h, CASE WHEN (r.idx >> v.level) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(s.h, '')
            FROM i JOIN subroots AS r ON i.lang IS NOT DISTINCT FROM r.lang, (SELECT DISTINCT level FROM tops WHERE c > 1) AS v
            LEFT JOIN tops AS s ON s.level = v.level AND s.idx = xor(r.idx >> v.level, 1)
        ), w AS (
            SELECT id, coalesce(string_agg(h, '' ORDER BY k), '') AS proof, list(step ORDER BY k) AS steps FROM steps GROUP BY id
        ), f AS (
            SELECT i.doc_id, i.leaf, r.h AS subroot, (SELECT h FROM tops WHERE c = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
                   list_reduce(list_concat([seen], coalesce(steps, [])), lambda x, y: CASE WHEN y[1] = 'L' THEN sha256(y[2:] || x) ELSE sha256(x || y[2:]) END) AS folded_root
            FROM i JOIN subroots AS r ON i.lang IS NOT DISTINCT FROM r.lang LEFT JOIN w USING (id)
        )
        SELECT *, folded_root = root AS verified FROM f
    """,
    "op10_url_filter": r"""
        WITH u AS (
            SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), p AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u
        ), r(rule_host, rule_path, listed) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), m AS (
            SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS nth
            FROM p LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(listed, 'allow') AS verdict FROM m WHERE nth = 1
    """,
}
