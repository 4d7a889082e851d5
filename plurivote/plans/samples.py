"""Queries for sampling, splitting, balancing, batches and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurivote.functions import text as T
from plurivote.operators import encode as ENC
from plurivote.operators import profile as P
from plurivote.operators import sampling as S
from plurivote.operators import vocabulary as VOC
from plurivote.plans import inputs as I
from plurivote.plans.inputs import sql
from plurivote.plans.registry import query
from plurivote.session import settle, small_side

_KEY = "md5(concat_ws(':', '1', {0})), {0}"


# ---- samples ------------------------------------------------------------------


@query("shuffle_order", f"SELECT doc_id, row_number() OVER (ORDER BY {_KEY.format('doc_id')}) - 1 AS position FROM documents")
def shuffle_order(spark, sf_dir):
    return S.shuffle_order(I.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("sample_n", f"SELECT doc_id, lang, text FROM documents ORDER BY {_KEY.format('doc_id')} LIMIT 150")
def sample_n(spark, sf_dir):
    return S.sample_n(I.table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", 150)


@query(
    "stratified_sample_n",
    f"SELECT event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY {_KEY.format('event_id')}) <= 150",
)
def stratified_sample_n(spark, sf_dir):
    events = I.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return S.stratified_sample_n(events, "event_id", "event_type", 150)


@query(
    "undersample_balance",
    f"""SELECT doc_id, lang, shuffled FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_KEY.format('doc_id')}) - 1 AS shuffled
    FROM documents) WHERE shuffled < (SELECT min(c) FROM (SELECT count(*) AS c FROM documents GROUP BY lang))""",
)
def undersample_balance(spark, sf_dir):
    docs = I.table(spark, sf_dir, "documents").select("doc_id", "lang")
    return S.shuffle_order(S.undersample_balance(docs, "doc_id", "lang"), "doc_id", by=["lang"], name="shuffled")


def _oversample(source: str) -> str:
    """Draws with replacement for all classes but the largest, then the largest as it is."""
    return f"""SELECT n.item_id, n.label, d.draw FROM (
        SELECT label, rows, draw, ('0x' || substring(md5(concat_ws(':', '1', label, draw)), 1, 8))::BIGINT % rows AS r
        FROM (SELECT label, count(*) AS rows FROM {source} GROUP BY label), range(1, (SELECT max(c) FROM (SELECT count(*) AS c FROM {source} GROUP BY label)) + 1) g(draw)) d
        JOIN (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format('item_id')}) - 1 AS r FROM {source}) n USING (label, r)
        WHERE label <> (SELECT label FROM {source} GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)
        UNION ALL SELECT item_id, label, NULL FROM {source} WHERE label = (SELECT label FROM {source} GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"""


@query("oversample_balance", sql(_oversample("truth"), "truth"))
def oversample_balance(spark, sf_dir):
    return S.oversample_balance(I.truth(spark, sf_dir), "item_id", "label")


@query(
    "oversampled_batches",
    sql(
        f""", drawn AS ({_oversample("truth")})
        SELECT item_id, label, draw, (row_number() OVER (ORDER BY md5(concat_ws(':', '1', item_id, draw)), item_id, draw NULLS FIRST) - 1) // 16 AS batch_id FROM drawn""",
        "truth",
    ),
)
def oversampled_batches(spark, sf_dir):
    """The balanced table, whose ids repeat, shuffled and cut into batches."""
    drawn = S.oversample_balance(I.truth(spark, sf_dir), "item_id", "label")
    return ENC.make_batches(drawn, ["item_id", "draw"], 16)


@query(
    "holdout_unlabelled_test",
    sql(
        f""", given AS (SELECT doc_id, toxic AS label, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'validation' ELSE 'train' END AS split FROM partly),
        seen AS (SELECT doc_id, CASE WHEN split <> 'test' THEN label END AS label, split FROM given),
        train AS (SELECT *, row_number() OVER (ORDER BY {_KEY.format('doc_id')}) AS k, count(*) OVER () AS total FROM seen WHERE split = 'train' AND label IS NOT NULL)
        SELECT doc_id, label, CASE WHEN k <= floor(total * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM train
        UNION ALL SELECT doc_id, label, split FROM seen WHERE split = 'validation' AND label IS NOT NULL""",
        "partly",
    ),
)
def holdout_unlabelled_test(spark, sf_dir):
    """A data set whose test split came without labels."""
    third = F.col("doc_id") % 5
    split = F.when(third == 0, "test").when(third == 1, "validation").otherwise("train")
    given = I.partly_labelled(spark, sf_dir).select("doc_id", split.alias("split"), "toxic")
    seen = given.select("doc_id", F.when(F.col("split") != "test", F.col("toxic")).alias("label"), "split")
    return S.hold_out_labelled(seen, "doc_id", "label", 0.2)


_SPLIT = """SELECT doc_id, lang, CASE WHEN k <= floor(total * 0.1::DOUBLE) THEN 'test' WHEN k <= 2 * floor(total * 0.1::DOUBLE) THEN 'validation'
    ELSE 'train' END AS split FROM doc_rank"""


@query("split_disjoint", sql(_SPLIT, "doc_rank"))
def split_disjoint(spark, sf_dir):
    return S.assign_split(I.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 0.1, 0.1)


_PARTS = f""", ranked AS (SELECT *, row_number() OVER (ORDER BY {_KEY.format('item_id')}) AS k, floor(count(*) OVER () * 0.1::DOUBLE) AS tenth FROM truth),
    classed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format('item_id')}) AS k, floor(count(*) OVER (PARTITION BY label) * 0.1::DOUBLE) AS tenth FROM truth),
    parts AS (SELECT item_id, label, CASE WHEN k <= tenth THEN 'test' WHEN k <= 2 * tenth THEN 'validation' ELSE 'train' END AS split FROM ranked),
    even AS (SELECT item_id, label, CASE WHEN k <= tenth THEN 'test' WHEN k <= 2 * tenth THEN 'validation' ELSE 'train' END AS split FROM classed),
    rest AS (SELECT item_id, label FROM parts WHERE split = 'train'), evenrest AS (SELECT item_id, label FROM even WHERE split = 'train')"""


@query(
    "three_way_split",
    sql(
        f"""{_PARTS}
        SELECT 'over' AS recipe, item_id, label, split, NULL::BIGINT AS draw FROM parts WHERE split <> 'train'
        UNION ALL SELECT 'over', item_id, label, 'train', draw FROM ({_oversample('rest')})
        UNION ALL SELECT 'under per class', item_id, label, split, NULL FROM even WHERE split <> 'train'
        UNION ALL SELECT 'under per class', item_id, label, 'train', NULL FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_KEY.format('item_id')}) AS k FROM evenrest)
            WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM evenrest GROUP BY label))""",
        "truth",
    ),
)
def three_way_split(spark, sf_dir):
    items = I.truth(spark, sf_dir)
    over = S.three_way_split(items, "item_id", "label", 0.1, 0.1, balance="over")
    under = S.three_way_split(items, "item_id", "label", 0.1, 0.1, per_class=True, balance="under")
    under = under.withColumn("draw", F.lit(None).cast("bigint"))
    return over.select(F.lit("over").alias("recipe"), "*").unionByName(
        under.select(F.lit("under per class").alias("recipe"), "*")
    )


# ---- multiple choice -----------------------------------------------------------


def _options(spark, sf_dir) -> DataFrame:
    """For every start k, the texts of the next four benchmark items."""
    items = I.table(spark, sf_dir, "benchmark")
    n = items.select(F.count(F.lit(1))).scalar()
    step = F.posexplode(F.array(*[F.lit(j) for j in range(1, 5)])).alias("_j", "_step")
    spread = items.select("item_id", "text", step).select(
        F.pmod(F.col("item_id") - F.col("_step"), n).alias("item_id"), "_j", "text"
    )
    return spread.groupBy("item_id").agg(*[F.max(F.when(F.col("_j") == j, F.col("text"))).alias(f"answer{j}") for j in range(4)])


def choice_table(spark, sf_dir) -> DataFrame:
    """Context, second header and four endings for each benchmark item."""
    items = I.table(spark, sf_dir, "benchmark")
    return items.join(_options(spark, sf_dir), "item_id").select(
        "item_id",
        F.col("text").alias("ctx_a"),
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("ctx_b"),
        F.array(*[F.col(f"answer{j}") for j in range(4)]).alias("endings"),
        (F.col("item_id") % 4).alias("label"),
    )


def question_table(spark, sf_dir) -> DataFrame:
    """Context, question and four answers for each conversation: the last turn asks, all before it are the context.

    The options are a table as short as the benchmark; it is measured, and broadcast while it is small.
    """
    turns = I.table(spark, sf_dir, "conversations")
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("_t"))
    said = F.col("_t.text")
    first = ordered.select(
        "conv_id",
        F.when(F.size(said) > 1, F.array_join(F.slice(said, F.lit(1), F.size(said) - 1), " ")).otherwise(F.get(said, 0)).alias("context"),
        F.when(F.size(said) > 1, F.element_at(said, -1)).alias("question"),
    )
    n = I.table(spark, sf_dir, "benchmark").select(F.count(F.lit(1))).scalar()
    keyed = first.withColumn("_slot", F.pmod("conv_id", n))
    answers = small_side(_options(spark, sf_dir).withColumnRenamed("item_id", "_slot"))
    return keyed.join(answers, "_slot").select(
        F.col("conv_id").alias("item_id"), "context", "question", *[f"answer{j}" for j in range(4)], (F.col("conv_id") % 4).alias("label")
    )


def _pairs_sql() -> str:
    opts = ", ".join(
        f"(SELECT text FROM benchmark b{j} WHERE b{j}.item_id = (x.k + {j}) % (SELECT count(*) FROM benchmark)) AS a{j}" for j in range(1, 5)
    )
    return f"""WITH opts AS (SELECT k, {opts} FROM (SELECT item_id AS k FROM benchmark) x),
        spoken AS (SELECT conv_id, list(text ORDER BY turn, text) AS t FROM conversations GROUP BY conv_id),
        first AS (SELECT conv_id, CASE WHEN len(t) > 1 THEN array_to_string(t[1:len(t) - 1], ' ') ELSE t[1] END AS context, CASE WHEN len(t) > 1 THEN t[len(t)] END AS question FROM spoken),
        long_a AS (SELECT 'endings' AS kind, b.item_id, b.text AS context, p.pos, 'q' || b.item_id || ' ' || [a1, a2, a3, a4][p.pos + 1] AS option, b.item_id % 4 AS label
            FROM benchmark b JOIN opts ON k = b.item_id, range(0, 4) p(pos)),
        long_b AS (SELECT 'answers', conv_id, context || coalesce('</s></s>' || question, ''), p.pos, [a1, a2, a3, a4][p.pos + 1], conv_id % 4
            FROM first JOIN opts ON k = conv_id % (SELECT count(*) FROM benchmark), range(0, 4) p(pos))
        SELECT kind, item_id, context, pos::INT AS pos, option, label FROM (SELECT * FROM long_a UNION ALL SELECT * FROM long_b)"""


@query("multiple_choice_pairs", _pairs_sql())
def multiple_choice_pairs(spark, sf_dir):
    def long(pairs, kind):
        context = ENC.joined_context(F.col("context"), F.col("question"))
        return pairs.select(
            F.lit(kind).alias("kind"), "item_id", context.alias("context"), F.posexplode("options").alias("pos", "option"), "label"
        )

    endings = ENC.multiple_choice_pairs(choice_table(spark, sf_dir))
    answers = ENC.multiple_choice_pairs(question_table(spark, sf_dir))
    return long(endings, "endings").unionByName(long(answers, "answers"))


# ---- tokens -----------------------------------------------------------------------


def _ids_sql(words: str) -> str:
    return f"""list_transform({words}, lambda w: ('0x' || substring(md5('word:' || w), 1, 8))::BIGINT % {ENC.WORD_IDS})"""


def _shown(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


def _words_of(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, '{I.SPACE}'), lambda w: w <> '')"


def _as_text(ids: str):
    return F.array_join(F.col(ids).cast("array<string>"), " ").alias(ids)


@query(
    "token_encode",
    sql(
        f"""SELECT item_id, label, {_shown("ids")} AS input_ids, {_shown("list_transform(ids, lambda i: 1)")} AS attention_mask FROM (
        SELECT item_id, label, list_concat(list_concat([{ENC.BEGIN_ID}], {_ids_sql(I.WORDS)}[1:254]), [{ENC.END_ID}]) AS ids FROM corpus)""",
        "corpus",
    ),
)
def token_encode(spark, sf_dir):
    encoded = ENC.token_encode(I.corpus(spark, sf_dir), max_length=256)
    return encoded.select("item_id", "label", _as_text("input_ids"), _as_text("attention_mask"))


@query(
    "token_length_profile",
    f"""SELECT lang, count(*) AS texts, max(n)::INT AS max_tokens, avg(n) AS mean_tokens, count(*) FILTER (n > 256) AS over_256, count(*) FILTER (n > 512) AS over_512
    FROM (SELECT lang, len({I.WORDS}) + 2 AS n FROM documents) GROUP BY lang""",
)
def token_length_profile(spark, sf_dir):
    docs = I.texts(spark, sf_dir, "lang", "text")
    return ENC.token_length_profile(ENC.token_lengths(docs, keep=["lang"]), (256, 512), ["lang"])


@query(
    "token_length_histogram",
    f"""WITH l AS (SELECT len({I.WORDS}) + 2 AS n FROM documents), e AS (SELECT min(n)::DOUBLE AS low, max(n)::DOUBLE AS high FROM l)
    SELECT bin, round(low + bin * ((high - low) / 100), 9) AS left_edge, coalesce(rows, 0) AS rows FROM e, (SELECT b::INT AS bin FROM range(0, 100) r(b))
    LEFT JOIN (SELECT least(99, floor((n - low) / (high - low) * 100))::INT AS bin, count(*) AS rows FROM l, e GROUP BY ALL) USING (bin)""",
)
def token_length_histogram(spark, sf_dir):
    docs = I.texts(spark, sf_dir, "doc_id", "text")
    # Words are counted once: the range and the counts both come from the settled narrow table.
    lengths = settle(ENC.token_lengths(docs, keep=["doc_id"]).select("n_tokens"))
    return P.equal_width_histogram(lengths, "n_tokens", 100).withColumns(I.round9("left_edge"))


def _choice_sql() -> str:
    """Every option's ids, fitted into 256 with the longer part cut first."""
    room = 252
    source = _pairs_sql().replace("SELECT kind, item_id, context, pos::INT AS pos, option, label FROM (SELECT * FROM long_a UNION ALL SELECT * FROM long_b)", "")
    heads = f"""h AS (SELECT 'endings' AS kind, b.item_id, {_ids_sql(_words_of("b.text"))} AS head FROM benchmark b
            UNION ALL SELECT 'answers', conv_id, list_concat({_ids_sql(_words_of("context"))}, CASE WHEN question IS NULL THEN [] ELSE
            list_concat([{ENC.END_ID}, {ENC.END_ID}], {_ids_sql(_words_of("question"))}) END) FROM first)"""
    return f"""{source.rstrip().rstrip(",")}, {heads},
        fits AS (SELECT kind, item_id, pos, label, head, {_ids_sql(_words_of("option"))} AS tail FROM (SELECT * FROM long_a UNION ALL SELECT * FROM long_b) JOIN h USING (kind, item_id)),
        cut AS (SELECT *, CASE WHEN len(head) + len(tail) <= {room} THEN len(head) ELSE least(len(head), greatest({(room + 1) // 2}, {room} - len(tail))) END AS a FROM fits)
        SELECT kind, item_id, pos::INT AS pos, label, {_shown(f"list_concat(list_concat(list_concat([{ENC.BEGIN_ID}], head[1:a]), list_concat([{ENC.END_ID}, {ENC.END_ID}], tail[1:least(len(tail), {room} - a)])), [{ENC.END_ID}])")} AS input_ids FROM cut"""


@query("multiple_choice_encode", _choice_sql())
def multiple_choice_encode(spark, sf_dir):
    def long(table, kind):
        encoded = ENC.multiple_choice_encode(ENC.multiple_choice_pairs(table))
        # The outer form: from the other one a filter on the array is inferred, which encodes everything once more.
        return encoded.select(F.lit(kind).alias("kind"), "item_id", F.posexplode_outer("input_ids").alias("pos", "input_ids"), "label").select(
            "kind", "item_id", "pos", "label", _as_text("input_ids")
        )

    return long(choice_table(spark, sf_dir), "endings").unionByName(long(question_table(spark, sf_dir), "answers"))


_BATCH = f"(row_number() OVER (ORDER BY {_KEY.format('doc_id')}) - 1) // 16 AS batch_id"


@query("make_batches", f"SELECT doc_id, {_BATCH} FROM documents")
def make_batches(spark, sf_dir):
    return ENC.make_batches(I.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 16)


def word_ids(text):
    """Stand-in ids that both engines can make: the letters of each word, and both marks."""
    return F.concat(F.array(F.lit(ENC.BEGIN_ID)), F.transform(T.words(text), F.length), F.array(F.lit(ENC.END_ID)))


@query(
    "pad_batches",
    f"""SELECT doc_id, batch_id, len(ids)::INT AS used, longest::INT AS padded_length,
    array_to_string(list_concat(ids, list_transform(range(0, longest - len(ids)), lambda i: {ENC.PAD_ID})), ' ') AS input_ids,
    array_to_string(list_concat(list_transform(ids, lambda i: 1), list_transform(range(0, longest - len(ids)), lambda i: 0)), '') AS attention_mask
    FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM (
        SELECT doc_id, {_BATCH}, list_concat([{ENC.BEGIN_ID}], list_concat(list_transform({I.WORDS}, lambda w: length(w)), [{ENC.END_ID}])) AS ids FROM documents))""",
)
def pad_batches(spark, sf_dir):
    docs = I.texts(spark, sf_dir, "doc_id", "text").select("doc_id", word_ids(F.col("text")).alias("input_ids"))
    padded = ENC.pad_batches(ENC.make_batches(docs, "doc_id", 16))
    used = F.aggregate("attention_mask", F.lit(0), lambda total, m: total + m)
    return padded.select(
        "doc_id",
        "batch_id",
        used.alias("used"),
        "padded_length",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.array_join(F.col("attention_mask").cast("array<string>"), "").alias("attention_mask"),
    )


@query(
    "padding_waste",
    f"""SELECT batch_id, count(*) AS rows, sum(cut)::BIGINT AS used_cells, (max(cut) * count(*))::BIGINT AS batch_cells, (256 * count(*))::BIGINT AS fixed_cells
    FROM (SELECT batch_id, least(n + 2, 256) AS cut FROM (SELECT {_BATCH}, len({I.WORDS}) AS n FROM documents)) GROUP BY batch_id""",
)
def padding_waste(spark, sf_dir):
    docs = I.texts(spark, sf_dir, "doc_id", "text").select("doc_id", (T.word_count(F.col("text")) + 2).alias("length"))
    return ENC.padding_waste(ENC.make_batches(docs, "doc_id", 16), F.col("length"), 256)


@query(
    "collected_batches",
    f"""SELECT batch_id, count(*)::INT AS rows, string_agg(label::VARCHAR, ' ' ORDER BY doc_id) AS labels,
    string_agg(array_to_string(list_concat(ids, list_transform(range(0, longest - len(ids)), lambda i: {ENC.PAD_ID})), ' '), '|' ORDER BY doc_id) AS input_ids
    FROM (SELECT *, max(len(ids)) OVER (PARTITION BY batch_id) AS longest FROM (
        SELECT doc_id, batch_id, toxic AS label, list_concat([{ENC.BEGIN_ID}], list_concat(list_transform({I.WORDS}, lambda w: length(w)), [{ENC.END_ID}])) AS ids
        FROM (SELECT doc_id, toxic, text, {_BATCH} FROM documents JOIN labels USING (doc_id)))) GROUP BY batch_id""",
)
def collected_batches(spark, sf_dir):
    """Padded batches as matrices, from a table that calls its class ``labels``."""
    rows = I.corpus(spark, sf_dir).select(F.col("item_id").alias("doc_id"), word_ids(F.col("text")).alias("input_ids"), F.col("label").alias("labels"))
    batches = ENC.collect_batches(ENC.pad_batches(ENC.make_batches(rows, "doc_id", 16)), id_col="doc_id")
    return batches.select(
        "batch_id",
        F.size("label").alias("rows"),
        F.array_join(F.col("label").cast("array<string>"), " ").alias("labels"),
        F.array_join(F.transform("input_ids", lambda ids: F.array_join(ids.cast("array<string>"), " ")), "|").alias("input_ids"),
    )


_VOCABULARY = f"""words AS (SELECT item_id, label, w AS word, k FROM (SELECT item_id, label, unnest({I.WORDS}) AS w, generate_subscripts({I.WORDS}, 1) AS k FROM corpus)),
    vocabulary AS (SELECT word, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS word_id FROM words GROUP BY word)"""


@query("vocabulary", sql(f", {_VOCABULARY} SELECT word, count, word_id FROM vocabulary", "corpus"))
def vocabulary(spark, sf_dir):
    return VOC.vocabulary(I.corpus(spark, sf_dir))


@query(
    "vocabulary_encode",
    sql(
        f""", {_VOCABULARY}, ids AS (SELECT item_id, list(word_id + {VOC.FIRST_WORD} ORDER BY k) AS ids FROM words JOIN vocabulary USING (word) GROUP BY item_id)
        SELECT item_id, label, {_shown(f"list_concat(list_concat([{ENC.BEGIN_ID}], coalesce(ids, [])[1:254]), [{ENC.END_ID}])")} AS input_ids
        FROM corpus LEFT JOIN ids USING (item_id)""",
        "corpus",
    ),
)
def vocabulary_encode(spark, sf_dir):
    corpus = settle(I.corpus(spark, sf_dir))
    encoded = VOC.encode(corpus, settle(VOC.vocabulary(corpus)))
    return encoded.select("item_id", "label", _as_text("input_ids"))
