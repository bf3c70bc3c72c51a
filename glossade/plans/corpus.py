"""Queries over lines, texts and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import basic_clean, cleaned, digit_dominated, fold_space, has_markup, punctuation_share, repetition, repetitive, words
from ..functions.tokens import parsed_sentence_id, rule_tokens, sentence_id
from ..operators import counts, generation, halves, selection, tagging
from ..operators import lines as ln
from . import sql
from .inputs import ASCII_SPACE, key_counts, lines, period, table
from .registry import query


@query(f"WITH {sql.LINES} SELECT doc_id, line_no, char_len, token_count, text FROM lines WHERE token_count <= 200 AND char_len <= 1500")
def filter_long_lines(spark, sf):
    return ln.kept(lines(spark, sf)).where("keep").select("doc_id", "line_no", "char_len", "token_count", "text")


@query(f"WITH {sql.LINES} SELECT doc_id, lang, source, line_no, char_len, token_count, replace(text, chr(9), '\\t') AS line_content FROM lines WHERE NOT (token_count <= 200 AND char_len <= 1500)")
def filter_log(spark, sf):
    return ln.log_form(ln.kept(lines(spark, sf)))


@query(f"WITH {sql.LINES} SELECT source, count(*) AS total, count(*) FILTER (token_count <= 200 AND char_len <= 1500) AS kept FROM lines GROUP BY source")
def filter_counts(spark, sf):
    return ln.kept(lines(spark, sf)).groupBy("source").agg(F.count("*").alias("total"), F.count_if("keep").alias("kept"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', '42', source, doc_id)), doc_id) AS n FROM documents) WHERE n <= 20")
def sample_cap_per_source(spark, sf):
    return selection.sample_per(table(spark, sf, "documents").select("doc_id", "source"), ["source"], 20, 42, "doc_id")


@query(f"WITH {sql.LINES} SELECT lang, count(*) AS n_lines, count(*) FILTER (token_count >= 24) AS n_long, count(*) FILTER (token_count >= 24) / count(*)::DOUBLE AS long_share, median(char_len) FILTER (token_count >= 24) AS median_long_chars FROM lines GROUP BY ROLLUP (lang)")
def line_window_profile(spark, sf):
    return ln.window_profile(lines(spark, sf), "lang")


@query(f"WITH {sql.LINES} SELECT lang, count(*) AS total, " + ", ".join(f"count(*) FILTER (token_count > {b}) * 100.0::DOUBLE / count(*) AS gt_{b}" for b in ln.BOUNDARIES) + " FROM lines GROUP BY lang")
def sentence_len_distribution(spark, sf):
    return ln.length_distribution(lines(spark, sf), ["lang"])


@query(f"WITH {sql.LINES} SELECT lang, count(*) AS total_sentences, sum(token_count)::BIGINT AS total_tokens, sum(token_count) / count(*)::DOUBLE AS avg_tokens FROM lines WHERE token_count > 0 GROUP BY lang")
def avg_sentence_len(spark, sf):
    return ln.average_length(lines(spark, sf).where("token_count > 0"), ["lang"])


@query(f"WITH {sql.LINES} SELECT source, sum(strlen(text) + 1)::BIGINT AS size_bytes, count(*) AS line_count FROM lines GROUP BY source")
def file_stats(spark, sf):
    return lines(spark, sf).groupBy("source").agg(F.sum(F.octet_length("text") + 1).alias("size_bytes"), F.count("*").alias("line_count"))


_CLEAN = f"""WITH base AS (SELECT conv_id, turn, coalesce(text, '') AS text, {sql.basic_clean("coalesce(text, '')")} AS b FROM conversations),
flags AS (SELECT conv_id, turn, text, b, {sql.digit_dominated('b')} AS blank, {sql.markup('text')} AS markup, {sql.repetition('b')}, {sql.punctuation_share('b')} AS punct FROM base)"""
_FLAGS = "markup::INT AS review_markup, (n >= 20 AND top > 0.4 AND ttr < 0.3)::INT AS review_repetition, (punct > 0.4)::INT AS review_punct_dominated, (markup OR (n >= 20 AND top > 0.4 AND ttr < 0.3) OR punct > 0.4)::INT AS review_any"


@query(f"{_CLEAN} SELECT conv_id, turn, (blank OR b <> text)::INT AS cleaned, {_FLAGS} FROM flags")
def clean_flags(spark, sf):
    own = cleaned(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", *(own[c].alias(c) for c in ("cleaned", "review_markup", "review_repetition", "review_punct_dominated", "review_any")))


@query(f"{_CLEAN} SELECT conv_id, turn, CASE WHEN blank THEN '' ELSE b END AS continuation, CASE WHEN blank OR b <> text THEN text ELSE '' END AS before_cleaning FROM flags")
def clean_text(spark, sf):
    own = cleaned(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", own["continuation"].alias("continuation"), own["before_cleaning"].alias("before_cleaning"))


@query(f"SELECT doc_id, {sql.digit_dominated('text')} AS digit_dominated FROM documents")
def digit_dominance(spark, sf):
    return table(spark, sf, "documents").select("doc_id", digit_dominated(F.col("text")).alias("digit_dominated"))


@query(f"WITH d AS (SELECT conv_id, turn, {sql.repetition('text')} FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, n, ttr, top, (n >= 20 AND top > 0.4 AND ttr < 0.3) AS repetitive FROM d")
def repetition_stats(spark, sf):
    own = table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", repetition(F.col("text"), ASCII_SPACE).alias("r"))
    return own.select("conv_id", "turn", "r.n", "r.ttr", "r.top", repetitive(F.col("r")).alias("repetitive"))


@query(f"SELECT doc_id, {sql.punctuation_share('text')} AS punct FROM documents")
def punct_fraction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", punctuation_share(F.col("text")).alias("punct"))


@query(f"SELECT page_id, {sql.markup('html')} AS markup, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))::INT AS n_links FROM pages")
def markup_flags(spark, sf):
    return table(spark, sf, "pages").select("page_id", has_markup(F.col("html")).alias("markup"), F.size(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("n_links"))


@query(f"WITH {sql.DOC_KEYS} SELECT lang, key, count(*) AS count FROM doc_keys GROUP BY lang, key")
def token_key_counts(spark, sf):
    return key_counts(spark, sf, lang=F.col("lang"))


@query(f"WITH {sql.DOC_KEYS} SELECT key, count(*) FILTER (period = 'pre') AS count_pre, count(*) FILTER (period = 'post') AS count_post FROM doc_keys GROUP BY key")
def period_counts(spark, sf):
    own = key_counts(spark, sf, period=period())
    return counts.pivoted(own, ["key"], "period", ["pre", "post"])


@query(f"WITH {sql.LINES} SELECT lang, count(*) AS lines, count(*) FILTER (char_len <= 20000) AS sentences, coalesce(sum(token_count) FILTER (char_len <= 20000), 0)::BIGINT AS tokens, count(*) FILTER (char_len > 20000) AS failed FROM (SELECT * REPLACE (length(trim(text, E' \\t\\r'))::INT AS char_len) FROM lines) WHERE token_count > 0 GROUP BY lang")
def tagging_progress(spark, sf):
    own = lines(spark, sf).select("lang", F.col("doc_id").alias("year"), "line_no", "text")
    done = tagging.progress(tagging.tag_lines(own, tagging.rule_tagger))
    return done.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("lines", "sentences", "tokens", "failed")))


@query(f"WITH {sql.LINES} SELECT doc_id, lang, line_no FROM (SELECT doc_id, lang, line_no, row_number() OVER (PARTITION BY lang ORDER BY doc_id, line_no) AS n FROM lines WHERE token_count >= 24) WHERE n <= 30")
def first_items_per_language(spark, sf):
    return selection.top(lines(spark, sf).where("token_count >= 24").select("doc_id", "lang", "line_no"), 30, [F.col("doc_id"), F.col("line_no")], ("lang",))


def _sentences(spark, sf):
    return lines(spark, sf).select(sentence_id(F.col("lang"), F.lit(2024), F.col("doc_id"), F.col("line_no")).alias("sent_id"), "lang", "text", rule_tokens(F.col("text")).alias("tokens"))


_SENT = f"""{sql.LINES}, sents AS (SELECT lang || '-2024-L' || doc_id || '-s' || line_no AS sent_id, lang, text, {sql.words('text')} AS w FROM lines),
items AS (SELECT *, len(w)::INT AS n, (len(w) // 2)::INT AS idx FROM sents WHERE len(w) >= 24)"""


@query(f"WITH {_SENT} SELECT sent_id, idx AS split_index, n AS n_full, idx AS n_first, n - idx AS n_second, length(array_to_string(w[1:idx], ' '))::INT AS char_first, length(text)::INT AS char_full, 'strict_alignment' AS method FROM items WHERE array_to_string(w, ' ') = text")
def split_halves_basic(spark, sf):
    plain = _sentences(spark, sf).where(F.array_join(F.col("tokens.form"), " ") == F.col("text"))
    m = halves.split_halves(plain)
    return m.select("id.sent_id", F.col("split_meta.index").alias("split_index"), F.col("metrics.n_tokens_full").alias("n_full"), F.col("metrics.n_tokens_first").alias("n_first"), F.col("metrics.n_tokens_second").alias("n_second"), F.col("metrics.char_len_first").alias("char_first"), F.col("metrics.char_len_full").alias("char_full"), F.col("split_meta.method").alias("method"))


@query()
def seam_split(spark, sf):
    """Tokens whose fifth form is not in the text: the seam decides."""
    own = _sentences(spark, sf).withColumn("tokens", F.transform("tokens", lambda t, i: F.when(i == 4, F.struct(F.lit("<gap>").alias("form"), t["lemma"], t["upos"])).otherwise(t)))
    m = halves.split_halves(own)
    return m.select("id.sent_id", "split_meta.method", "split_meta.shift", "text.first_half", "text.second_half")


@query()
def fallback_reconstruct(spark, sf):
    m = halves.split_halves(_sentences(spark, sf).withColumn("text", F.lit(None).cast("string")))
    return m.select("id.sent_id", "split_meta.method", "text.first_half", "text.second_half", "text.full_inferred")


@query(f"WITH {_SENT} SELECT sent_id, lang FROM (SELECT sent_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws('|', '42', lang, sent_id)), sent_id) AS k FROM items) WHERE k <= 50")
def halves_cap(spark, sf):
    own = _sentences(spark, sf).where(F.size("tokens") >= 24).select("sent_id", "lang")
    return selection.sample_per(own, ["lang"], 50, 42, "sent_id")


@query(f"WITH {_SENT} SELECT sent_id, split_part(sent_id, '-', 1) AS lang, try_cast(split_part(sent_id, '-', 2) AS INT) AS year, split_part(sent_id, '-', 3) AS doc_id, try_cast(substr(split_part(sent_id, '-', 4), 2) AS INT) AS sent_idx FROM sents")
def sentence_ids(spark, sf):
    return _sentences(spark, sf).select("sent_id", parsed_sentence_id(F.col("sent_id")).alias("p")).select("sent_id", "p.*")


_CONFIG = [("en", "Continue: {}", 1.1, 1), ("de", "Weiter: {}", 1.7, 1), ("fr", "Suite : {}", 1.5, 1), ("es", "Sigue: {}", 1.4, 1)]
_CONFIG_SQL = "config(lang, frame, r) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c, _ in _CONFIG) + ")"


def _items(spark, sf):
    own = _sentences(spark, sf).where(F.size("tokens") >= 24)
    n = F.size("tokens")
    first = F.array_join(F.slice(F.col("tokens.form"), F.lit(1), halves.split_index(n)), " ")
    config = spark.createDataFrame(_CONFIG, "lang_code string, prompt_frame string, token_ratio double, verified int")
    return generation.prompts(own.select(F.col("sent_id").alias("item_id"), "lang", first.alias("first_half"), (n - halves.split_index(n)).alias("n_second")), config)


@query(f"WITH {_SENT}, {_CONFIG_SQL} SELECT sent_id AS item_id, lang, ceil(least((n - idx) * r * 0.5::DOUBLE, r * 20))::INT AS min_tokens, greatest(ceil(least((n - idx) * r * 1.5::DOUBLE, r * 200)), ceil(least((n - idx) * r * 0.5::DOUBLE, r * 20)))::INT AS max_tokens FROM items JOIN config USING (lang)")
def token_budget(spark, sf):
    return _items(spark, sf).select("item_id", "lang", "min_tokens", "max_tokens")


@query(f"WITH {_SENT}, {_CONFIG_SQL} SELECT sent_id AS item_id, lang, replace(frame, '{{}}', trim(array_to_string(w[1:idx], ' '))) AS user_prompt FROM items JOIN config USING (lang)")
def prompt_render(spark, sf):
    return _items(spark, sf).select("item_id", "lang", "user_prompt")


@query("SELECT conv_id, turn FROM conversations c WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations d WHERE d.role = 'assistant' AND d.conv_id = c.conv_id AND d.turn = c.turn + 1)")
def resume_antijoin(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    done = turns.where("role = 'assistant'").select(F.struct("conv_id", (F.col("turn") - 1).alias("turn")).alias("item_id"))
    return generation.remaining(turns.where("role = 'user'").withColumn("item_id", F.struct("conv_id", "turn")), done).select("conv_id", "turn")


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS continuation FROM conversations WHERE role = 'assistant'")
def spotcheck(spark, sf):
    return table(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", fold_space(F.col("text")).alias("continuation"))


@query(f"WITH {sql.LINES}, r AS (SELECT lang, list_sum(list_transform({sql.words('text')}, lambda x_: ceil(length(x_) / 4.0::DOUBLE))) / token_count AS ratio FROM lines WHERE token_count > 0) SELECT lang, count(*) AS sentences, round(avg(ratio), 9) AS mean_ratio, round(coalesce(stddev_samp(ratio), 0.0), 9) AS std_ratio, min(ratio) AS min_ratio, max(ratio) AS max_ratio FROM r GROUP BY lang")
def bpe_ratio(spark, sf):
    """A stand-in tokenizer: four characters are a model token."""
    pieces = F.aggregate(words(F.col("text"), ASCII_SPACE), F.lit(0.0), lambda s, x: s + F.ceil(F.length(x) / 4.0))
    own = lines(spark, sf).where("token_count > 0").select("lang", (pieces / F.col("token_count")).alias("ratio"))
    return own.groupBy("lang").agg(F.count("*").alias("sentences"), F.round(F.avg("ratio"), 9).alias("mean_ratio"), F.round(F.coalesce(F.stddev_samp("ratio"), F.lit(0.0)), 9).alias("std_ratio"), F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"))


@query(f"SELECT doc_id, {sql.basic_clean('text')} AS text FROM documents")
def document_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", basic_clean(F.col("text")).alias("text"))


@query("SELECT event_type AS key, count(*) AS count FROM events GROUP BY event_type")
def incremental_counts(spark, sf):
    from ..streaming import incremental

    batch = table(spark, sf, "events")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return incremental.drained(spark, stream.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("count")), "incremental_counts", "complete")
