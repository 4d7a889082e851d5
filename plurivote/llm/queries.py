"""One registered query per operator: the operator over its whole table, as digest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from plurivote.llm import (
    conversations,
    decontaminate,
    language_id,
    mixing,
    near_duplicates,
    order_minhash,
    phrases,
    pii,
    pivot_codes,
    secret_ledger,
    token_counts,
    token_files,
    url_filter,
)
from plurivote.llm.registry import ORACLES, QUERIES, query, table
from plurivote.session import scratch_path, settle

__all__ = ["ORACLES", "QUERIES"]

_WORDS = """w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)"""


def tokenizer_text(name: str) -> str:
    """The text of a public tokenizer file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_text("byte_bpe_50k.json"))


@query("op3_mix_sources")
def op3_mix_sources(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_token_files")
def op6_token_files(spark, sf_dir):
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_text("word_bpe_49k.json"))
    return token_files.read_documents(files)


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
# The block list of the query: the addresses of hosts with one of these words in their name.
LISTED_HOST = "casino|bets|pills|spam|adult|ads-"

_OP2 = """
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named),
ruled AS (SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN regexp_matches(host, 'casino|bets|pills|spam|adult|ads-') THEN 'block' ELSE 'allow' END AS verdict,
    regexp_matches(host, 'casino|bets|pills|spam|adult|ads-') AS listed FROM ruled"""


@query("op2_url_filter", _OP2)
def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.url_parts(F.col("url"))
    listed = pages.select(host.alias("host"), F.concat(host, path).alias("key")).where(F.col("host").rlike(LISTED_HOST)).select("key")
    return url_filter.filter_urls(pages, RULES, listed)


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(documents, language_id.fit(documents))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "language.lang_pred", "language.score")


@query("op8_decontaminate")
def op8_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_order_minhash")
def op9_order_minhash(spark, sf_dir):
    paired = order_minhash.fingerprints(table(spark, sf_dir, "documents"))
    changed = paired.withColumn("edited", order_minhash.edited(F.col("text"), F.col("next_text")))
    changed = changed.withColumn("edited_fingerprint", order_minhash.fingerprint(F.col("edited")))
    return changed.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        order_minhash.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        order_minhash.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


_OP10 = f"""WITH {_WORDS},
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
first AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g),
hit AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (g), range(0, 13) r(k) WHERE f < doc_id),
word AS (SELECT doc_id, p, ws[p] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


@query("op10_repeated_phrases", _OP10)
def op10_repeated_phrases(spark, sf_dir):
    return phrases.remove_repeats(table(spark, sf_dir, "documents"))



# Copies and documents that share four fifths of their runs of five words; the class is the least id that can be reached.
_OP5 = f"""WITH RECURSIVE {_WORDS},
runs AS (SELECT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
    UNION ALL SELECT doc_id, chr(1) || array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
cells AS (SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id, g) AS o FROM runs),
sizes AS (SELECT doc_id, count(*) AS n FROM cells GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS s FROM cells a JOIN cells b ON a.g = b.g AND a.o = b.o AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 5 * s >= 4 * (x.n + y.n - s)
    UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON coalesce(a.text, '') = coalesce(b.text, '') AND a.doc_id < b.doc_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach r JOIN both_ways l ON l.a = r.node)
SELECT node AS doc_id, min(root) AS class_id FROM reach GROUP BY node"""


@query("op5_near_duplicates", _OP5)
def op5_near_duplicates(spark, sf_dir):
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_personal_data")
def op7_personal_data(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_data(documents, pii.fit(documents))
    digest = F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, "spans")


# Matches of every rule as spans: the pieces between matches and the matches themselves, summed up from the left.
_KIND11 = ", ".join(
    f"({i}, '{r.kind}', '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group}, {r.least}, {str(r.base).lower()})" for i, r in enumerate(secret_ledger.RULES)
)
_MATCH11 = " UNION ALL ".join(
    f"""SELECT doc_id, {i} AS rank, list_transform(regexp_extract_all(t, p{i}, 0), lambda x: length(x)) AS sizes,
    list_transform(regexp_extract_all(t, p{i}, {r.group}), lambda x: length(x)) AS judged, list_transform(string_split_regex(t, p{i}), lambda x: length(x)) AS gaps
    FROM (SELECT doc_id, t, '{r.pattern.replace(chr(39), chr(39) * 2)}' AS p{i} FROM d) WHERE regexp_matches(t, p{i})"""
    for i, r in enumerate(secret_ledger.RULES)
)
_OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(rank, kind, pattern, grp, least, base) AS (VALUES {_KIND11}),
hits AS ({_MATCH11}),
rows AS (SELECT doc_id, rank, i, sizes[i] AS size, judged[i] AS judged, gaps[i] + sizes[i] AS step FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS i FROM hits)),
placed AS (SELECT doc_id, rank, judged, size, sum(step) OVER (PARTITION BY doc_id, rank ORDER BY i) AS e FROM rows),
spans AS (SELECT doc_id, rank, kind, base, CAST(e - size AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed JOIN rules USING (rank) WHERE judged >= least),
whole AS (SELECT * FROM spans a WHERE base OR NOT EXISTS (SELECT 1 FROM spans b WHERE b.base AND b.doc_id = a.doc_id AND b.s < a.e AND a.s < b.e)),
said AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (base) AS base_spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans FROM whole GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN said USING (doc_id)"""


@query("op11_secret_ledger", _OP11)
def op11_secret_ledger(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = scratch_path(spark, "ledger")
    secret_ledger.scan(documents, ledger)
    found = secret_ledger.report(documents, ledger)
    base = F.filter("spans", lambda x: x["base"])

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(secret_ledger.span_text(base), "UTF-8"), 256).alias("base_sha256"),
        secret_ledger.span_text(F.col("spans")).alias("spans"),
    )


# CRC-32 of an ASCII text, bit by bit: the reversed polynomial is a fixed value.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ord(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, r: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""
# Every way over one row, after up to two insertions: phase, letters, cost, class the row must have (null: any, but
# sound or truncated), whether it stays, text put before it, role it gets (null: its own), next phase.
_OP12 = rf"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
coded AS (SELECT conv_id, turn, role, text, {_CRC.format("k")} % 20 AS f FROM named),
rows AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
    FROM coded, range(2) r(c) WHERE f <> 0 AND (c = 0 OR f = 3)),
told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM rows),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), again) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut FROM told),
turns AS (SELECT *, CASE WHEN cut = '' THEN 2 WHEN again > 1 THEN 3 WHEN right(cut, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS state, left(role, 1) AS c FROM seen),
paired AS (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS pair FROM turns),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (state = 2) AS blank,
    count(*) FILTER (state = 3) AS duplicate, count(*) FILTER (state = 1) AS truncated,
    count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM paired GROUP BY conv_id),
puts(p, letters, cost, text, q) AS (VALUES ('B', '', 0, '', 'B'), ('B', 'I', 2, chr(10) || 'user:', 'u'), ('s', '', 0, '', 's'), ('s', 'I', 2, chr(10) || 'user:', 'u'),
    ('s', 'II', 4, chr(10) || 'user:' || chr(10) || 'assistant:', 'a'), ('u', '', 0, '', 'u'), ('u', 'I', 2, chr(10) || 'assistant:', 'a'),
    ('a', '', 0, '', 'a'), ('a', 'I', 2, chr(10) || 'user:', 'u')),
takes(p, letter, cost, cls, role, q) AS (VALUES ('B', 'K', 0, 's', NULL, 's'), ('B', 'K', 0, 'u', NULL, 'u'), ('s', 'K', 0, 'u', NULL, 'u'), ('u', 'K', 0, 'a', NULL, 'a'),
    ('a', 'K', 0, 'u', NULL, 'u'), ('B', 'R', 2, '', 'user', 'u'), ('s', 'R', 2, '', 'user', 'u'), ('u', 'R', 2, '', 'assistant', 'a'), ('a', 'R', 2, '', 'user', 'u'),
    ('B', 'D', 3, '', NULL, 'B'), ('s', 'D', 3, '', NULL, 's'), ('u', 'D', 3, '', NULL, 'u'), ('a', 'D', 3, '', NULL, 'a')),
ways AS (SELECT puts.p, letters || letter AS letters, letter, puts.cost + takes.cost AS cost, cls, text, role, takes.q FROM puts JOIN takes ON takes.p = puts.q),
walk AS (SELECT conv_id, 0::BIGINT AS i, 'B' AS p, {{'c': 0, 'a': '', 'r': ''}} AS v FROM counts
    UNION ALL
    SELECT w.conv_id, t.i, x.q, min({{'c': CAST(w.v.c + x.cost + CASE WHEN x.letter <> 'D' AND t.state = 1 THEN 1 ELSE 0 END AS INTEGER), 'a': w.v.a || x.letters,
        'r': w.v.r || x.text || CASE WHEN x.letter = 'D' THEN '' ELSE chr(10) || coalesce(x.role, t.role) || ':' || t.text END}})
    FROM walk w JOIN turns t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.i = w.i + 1 JOIN ways x ON x.p = w.p
    WHERE x.letter = 'D' OR (t.state < 2 AND (x.cls = '' OR x.cls = t.c)) GROUP BY w.conv_id, t.i, x.q),
ended AS (SELECT w.conv_id, min({{'c': w.v.c + x.cost, 'a': w.v.a || x.letters, 'r': w.v.r || x.text}}) AS v
    FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN puts x ON x.p = w.p AND x.q IN ('B', 'a') GROUP BY w.conv_id),
everyone AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(d.v.c, 0) AS BIGINT) AS cost, coalesce(d.v.a, '') AS audit, sha256(coalesce(substr(d.v.r, 2), '')) AS repaired_sha256
FROM everyone e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM e.conv_id"""


@query("op12_conversation_repair", _OP12)
def op12_conversation_repair(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = conversations.damaged(given)
    audits = settle(conversations.judged(rows, given.select("conv_id")))
    digests = conversations.digests(rows, audits).withColumnRenamed("id", "_id")
    same = F.col("id").eqNullSafe(F.col("_id"))
    return audits.join(digests, same).drop("_id").withColumnRenamed("id", "conv_id")


def _round13(vectors: str, books: str) -> str:
    """Nearest entry of every part; ties to the lower index."""
    return f"""(SELECT vec_id, label, p, x, min({{'d': list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k]))), 'e': e}}) AS b
    FROM {vectors} JOIN {books} USING (p) GROUP BY vec_id, label, p, x)"""


_MOVE13 = """(SELECT p, e, coalesce(m, c) AS c FROM {0} LEFT JOIN (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS m
    FROM (SELECT p, b.e AS e, k, sum(x[k]) AS s, count(*) AS n FROM {1}, range(1, (SELECT max(len(x)) + 1 FROM parts)) r(k) GROUP BY ALL) GROUP BY p, e) USING (p, e))"""
_OP13 = f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, label, p, v[p * w + 1:p * w + w] AS x FROM (SELECT *, len(v) // 16 AS w FROM kept), range(16) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
a0 AS MATERIALIZED {_round13("parts", "b0")}, b1 AS MATERIALIZED {_MOVE13.format("b0", "a0")},
a1 AS MATERIALIZED {_round13("parts", "b1")}, b2 AS MATERIALIZED {_MOVE13.format("b1", "a1")},
a2 AS MATERIALIZED {_round13("parts", "b2")},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(b.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM coded"""


@query("op13_pivot_codes", _OP13)
def op13_pivot_codes(spark, sf_dir):
    codes = pivot_codes.train(table(spark, sf_dir, "embeddings"))
    found = pivot_codes.with_label_error(codes.rows)
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))
