"""Queries on the corpus: columns, filters, profiles, text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.operators import profile as P
from plurivote.operators import projection as PR
from plurivote.operators.sampling import assign_split
from plurivote.plans import inputs as I
from plurivote.plans.inputs import sql
from plurivote.plans.registry import query
from plurivote.session import settle, spread_small

WORD_COUNT = f"len({I.WORDS})::INT"


# ---- columns ---------------------------------------------------------------


@query("project_rename", "SELECT doc_id AS item_id, lang AS class_name, n_chars AS length FROM documents")
def project_rename(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents")
    return PR.rename_and_keep(docs, {"doc_id": "item_id", "lang": "class_name", "n_chars": "length"})


@query(
    "label_encode",
    """SELECT doc_id AS item_id, quality_name, CASE quality_name WHEN 'low' THEN 0 WHEN 'high' THEN 1 END AS label, lang,
    CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS lang_id
    FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'high' ELSE 'low' END AS quality_name FROM labels) JOIN documents USING (doc_id)""",
)
def label_encode(spark, sf_dir):
    named = I.table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "high").otherwise("low").alias("quality_name")
    )
    rows = named.join(I.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.select(
        F.col("doc_id").alias("item_id"),
        "quality_name",
        PR.map_values(F.col("quality_name"), {"low": 0, "high": 1}).alias("label"),
        "lang",
        PR.map_values(F.col("lang"), {"en": 0, "fr": 1, "de": 2}).alias("lang_id"),
    )


_FINE = {"click": 1, "view": 2, "signup": 3, "purchase": 5, "error": 7}
# Which fine classes make up each coarse one.
_COARSE = {1: 0, 3: 0, 4: 0, 6: 0, 2: 1, 5: 1, 7: 1, 8: 1}


@query(
    "label_coarsen",
    """SELECT event_id AS item_id, fine, CASE WHEN fine IN (1, 3, 4, 6) THEN 0 WHEN fine IN (2, 5, 7, 8) THEN 1 END AS coarse FROM (
    SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 5 WHEN 'error' THEN 7 END AS fine FROM events)""",
)
def label_coarsen(spark, sf_dir):
    fine = PR.map_values(F.col("event_type"), _FINE)
    rows = I.table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), fine.alias("fine"))
    return rows.withColumn("coarse", PR.map_values(F.col("fine"), _COARSE))


@query("label_cast", "SELECT conv_id, turn::BIGINT AS label FROM conversations")
def label_cast(spark, sf_dir):
    rows = I.table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("string").alias("label"))
    return PR.cast_label(rows, "label")


@query(
    "label_reindex",
    """SELECT doc_id, lang, dense_rank() OVER (ORDER BY lang) - 1 AS label FROM documents WHERE lang IS NOT NULL
    UNION ALL SELECT doc_id, lang, NULL FROM documents WHERE lang IS NULL""",
)
def label_reindex(spark, sf_dir):
    rows = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return PR.reindex_labels(rows, "lang", "label").select("doc_id", "lang", F.col("label").cast("bigint").alias("label"))


def _event_sets(spark, sf_dir) -> DataFrame:
    """Classes seen per user and day: a multi-label corpus (at most five labels a row)."""
    events = I.table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.sort_array(F.collect_set("event_type")).alias("labels")
    )


@query(
    "single_label_filter",
    """SELECT user_id, strftime(day, '%Y-%m-%d') AS day, label FROM (
    SELECT user_id, ts::DATE AS day, min(event_type) AS label, count(DISTINCT event_type) AS k FROM events GROUP BY ALL) WHERE k = 1""",
)
def single_label_filter(spark, sf_dir):
    single = PR.single_label_rows(_event_sets(spark, sf_dir), "labels", "label")
    return single.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "label")


@query(
    "array_to_columns",
    "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS ending{i}" for i in range(64)) + " FROM embeddings",
)
def array_to_columns(spark, sf_dir):
    rows = I.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("endings"))
    return PR.array_to_columns(rows, "endings", 64, "ending").drop("endings")


# ---- filters -----------------------------------------------------------------


@query("null_rows", sql("SELECT doc_id, lang FROM partly WHERE toxic IS NULL", "partly"))
def null_rows(spark, sf_dir):
    return PR.null_rows(I.partly_labelled(spark, sf_dir), "toxic").select("doc_id", "lang")


@query("drop_null_text", sql("SELECT doc_id, lang, toxic FROM partly WHERE toxic IS NOT NULL AND text IS NOT NULL", "partly"))
def drop_null_text(spark, sf_dir):
    return I.partly_labelled(spark, sf_dir).na.drop(subset=["text", "toxic"]).select("doc_id", "lang", "toxic")


@query(
    "length_outliers",
    f"""SELECT doc_id, words, CASE WHEN words > 400 THEN 'long' ELSE 'short' END AS reason
    FROM (SELECT doc_id, {WORD_COUNT} AS words FROM documents) WHERE words > 400 OR words = 1""",
)
def length_outliers(spark, sf_dir):
    docs = I.texts(spark, sf_dir, "doc_id", "text")
    found = P.length_outliers(docs, T.word_count(F.col("text")), above=400, exactly=1)
    return found.select("doc_id", F.col("length").alias("words"), "reason")


@query(
    "duplicate_rows",
    """SELECT doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS k FROM documents) WHERE k > 1""",
)
def duplicate_rows(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return P.duplicate_rows(docs, "doc_id")


# ---- profiles -----------------------------------------------------------------


_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint", "quality": "int", "toxic": "int"}


@query(
    "profile_nonnull",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) AS rows FROM partly" for c, t in _COLUMNS.items()
        ),
        "partly",
    ),
)
def profile_nonnull(spark, sf_dir):
    return P.profile_nonnull(I.partly_labelled(spark, sf_dir))


_DESCRIBE = """SELECT '{0}' AS column_name, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min,
    round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, max(v) AS max FROM ({1})"""


@query(
    "describe_numeric",
    _DESCRIBE.format("n_chars", "SELECT n_chars::DOUBLE AS v FROM documents")
    + " UNION ALL "
    + _DESCRIBE.format("words", f"SELECT {WORD_COUNT}::DOUBLE AS v FROM documents"),
)
def describe_numeric(spark, sf_dir):
    docs = I.texts(spark, sf_dir, "n_chars", "text").select("n_chars", T.word_count(F.col("text")).alias("words"))
    stats = P.describe_numeric(docs, ["n_chars", "words"])
    return stats.withColumns({c: F.round(c, 6) for c in ("mean", "std", "q25", "q50", "q75")})


@query(
    "label_distribution",
    sql(
        """SELECT split, lang, count(*) AS rows FROM (SELECT lang, CASE WHEN k <= floor(total * 0.1::DOUBLE) THEN 'test'
        WHEN k <= 2 * floor(total * 0.1::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM doc_rank) GROUP BY ALL""",
        "doc_rank",
    ),
)
def label_distribution(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return P.label_distribution(assign_split(docs, "doc_id", 0.1, 0.1), "split", "lang")


@query("distinct_labels", "SELECT DISTINCT lang FROM documents")
def distinct_labels(spark, sf_dir):
    return P.distinct_labels(I.table(spark, sf_dir, "documents"), "lang")


def _histogram(source: str, value: str, bins: int, by: str = "") -> str:
    """All bins of all groups, with zeros."""
    lead, using = (f"{by}, ", f"{by}, bin") if by else ("", "bin")
    groups = f"(SELECT DISTINCT {by} FROM {source}), " if by else ""
    return f"""SELECT {lead}bin, round(low + bin * ((high - low) / {bins}), 9) AS left_edge, coalesce(rows, 0) AS rows
        FROM (SELECT {lead}b::INT AS bin FROM {groups}range(0, {bins}) r(b)) LEFT JOIN (
            SELECT {lead}least({bins - 1}, floor(({value} - low) / (high - low) * {bins}))::INT AS bin, count(*) AS rows
            FROM {source}, (SELECT min({value})::DOUBLE AS low, max({value})::DOUBLE AS high FROM {source}) GROUP BY ALL) USING ({using}),
        (SELECT min({value})::DOUBLE AS low, max({value})::DOUBLE AS high FROM {source})"""


@query(
    "length_histogram",
    sql(f", lengths AS (SELECT label, {WORD_COUNT} AS words FROM corpus) " + _histogram("lengths", "words", 50, "label"), "corpus"),
)
def length_histogram(spark, sf_dir):
    # Words are counted once: the range and the bins both come from the settled narrow table.
    rows = settle(I.corpus(spark, sf_dir).select("label", T.word_count(F.col("text")).alias("words")))
    return P.equal_width_histogram(rows, "words", 50, ["label"]).withColumns(I.round9("left_edge"))


_AUTO = """, lengths AS (SELECT label, {words} AS words FROM corpus), ends AS (SELECT min(words)::DOUBLE AS low, max(words)::DOUBLE AS high, count(*) AS n,
        quantile_cont(words, 0.75) - quantile_cont(words, 0.25) AS iqr FROM lengths),
        chosen AS (SELECT low, high, ceil((high - low) / greatest(1, CASE WHEN iqr > 0 THEN least((high - low) / (log2(n) + 1), 2 * iqr / n ** (1.0::DOUBLE / 3)) ELSE (high - low) / (log2(n) + 1) END))::INT AS bins FROM ends)
        SELECT label, bin, bins, round(low + bin * ((high - low) / bins), 9) AS left_edge, coalesce(rows, 0) AS rows
        FROM (SELECT label, b::INT AS bin FROM (SELECT DISTINCT label FROM lengths), chosen, range(0, 100000) r(b) WHERE b < bins) LEFT JOIN (
            SELECT label, least(bins - 1, floor((words - low) / (high - low) * bins))::INT AS bin, count(*) AS rows FROM lengths, chosen GROUP BY ALL) USING (label, bin), chosen"""


@query("automatic_histogram", sql(_AUTO.format(words=WORD_COUNT), "corpus"))
def automatic_histogram(spark, sf_dir):
    """Word counts by class in as many bins as the usual rule gives."""
    rows = settle(I.corpus(spark, sf_dir).select("label", T.word_count(F.col("text")).alias("words")))
    bins = P.automatic_bins(rows, "words")
    return P.equal_width_histogram(rows, "words", bins, ["label"]).withColumns(I.round9("left_edge")).withColumn("bins", F.lit(bins))


@query("equal_width_histogram", _histogram("documents", "n_chars", 100))
def equal_width_histogram(spark, sf_dir):
    rows = I.table(spark, sf_dir, "documents").select("n_chars")
    return P.equal_width_histogram(rows, "n_chars", 100).withColumns(I.round9("left_edge"))


# ---- text ------------------------------------------------------------------------


@query("word_count", f"SELECT doc_id, {WORD_COUNT} AS words FROM documents")
def word_count(spark, sf_dir):
    return I.texts(spark, sf_dir, "doc_id", "text").select("doc_id", T.word_count(F.col("text")).alias("words"))


def _clean_sql(text: str) -> str:
    space = r"\s\p{Z}\x{1c}-\x{1f}\x{85}"
    out = f"lower({text})"
    for pattern in (
        r"\[[^\n]*?\]",
        rf"https?://[^{space}]+|www\.[^{space}]+",
        r"<[^\n]*?>+",
        r"[!-/:-@\[-`{-~]",
        r"\n",
        r"[\p{L}\p{N}_]*\p{Nd}[\p{L}\p{N}_]*",
    ):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    return out


_NOTE = " [note 1] x2y www.a.example/b?c"


@query(
    "clean_text",
    f"""SELECT 'document' AS kind, doc_id AS item_id, {_clean_sql("text")} AS cleaned FROM documents
    UNION ALL SELECT 'page', page_id, {_clean_sql(f"html || ' ' || url || '{_NOTE}'")} FROM pages""",
)
def clean_text(spark, sf_dir):
    docs = I.texts(spark, sf_dir, "doc_id", "text").select(F.lit("document").alias("kind"), F.col("doc_id").alias("item_id"), "text")
    noted = F.concat("html", F.lit(" "), "url", F.lit(_NOTE))
    pages = spread_small(I.table(spark, sf_dir, "pages")).select(F.lit("page").alias("kind"), F.col("page_id").alias("item_id"), noted.alias("text"))
    return docs.unionByName(pages).select("kind", "item_id", T.clean_text(F.col("text")).alias("cleaned"))


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.ENGLISH_STOPWORDS)
_CLEAN_WORDS = f"""list_filter(regexp_split_to_array({_clean_sql("text")}, '{I.SPACE}'), lambda w: w <> '' AND w NOT IN ({_STOP}))"""


@query("remove_stopwords", f"SELECT doc_id, len(w)::INT AS kept, array_to_string(w, ' ') AS words FROM (SELECT doc_id, {_CLEAN_WORDS} AS w FROM documents)")
def remove_stopwords(spark, sf_dir):
    words = P.cleaned_words(F.col("text"))
    rows = I.texts(spark, sf_dir, "doc_id", "text").select("doc_id", words.alias("w"))
    return rows.select("doc_id", F.size("w").alias("kept"), F.array_join("w", " ").alias("words"))


@query(
    "top_words_by_class",
    sql(
        f"""SELECT label, word, times, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY times DESC, word)::INT AS place FROM (
        SELECT label, word, count(*) AS times FROM (SELECT label, unnest({_CLEAN_WORDS}) AS word FROM corpus) GROUP BY ALL)) WHERE place <= 20""",
        "corpus",
    ),
)
def top_words_by_class(spark, sf_dir):
    return P.top_words_by_class(I.corpus(spark, sf_dir), "label", P.cleaned_words(F.col("text")))
