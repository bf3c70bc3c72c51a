"""Queries that write files of every kind under the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ASCII_SPACE, fold_space, words
from ..functions.tokens import rule_tokens, sentence_id
from ..operators import halves, pairing, prevalence
from ..operators import lines as ln
from ..session import scratch
from ..sources import columns, conll, layout, outputs
from ..sources import files as src
from . import sql
from .inputs import discovered, key_counts, lines, pairs, table
from .registry import query

#: Lines as files hold them: no carriage returns.
_LINES = f"{sql.LINES}, own AS (SELECT * REPLACE (replace(text, chr(13), ' ') AS text) FROM lines)"
_SENT = f"""{sql.LINES}, sents AS (SELECT doc_id, lang, line_no, lang || '-2024-L' || doc_id || '-s' || line_no AS sent_id, text, {sql.words('text')} AS w FROM lines),
full_ AS (SELECT * FROM sents WHERE len(w) > 0), items AS (SELECT *, len(w)::INT AS n, (len(w) // 2)::INT AS idx FROM sents WHERE len(w) >= 24 AND array_to_string(w, ' ') = text)"""
#: Bytes of a part of a file that is hashed part by part.
_PART = 32 << 20


def _lines(spark, sf):
    return lines(spark, sf).withColumn("text", F.replace("text", F.lit("\r"), F.lit(" ")))


def _sentences(spark, sf):
    """(file, sent_no, sent_id, lang, text, tokens) of lines with words."""
    own = lines(spark, sf).where("token_count > 0")
    forms = words(F.col("text"), ASCII_SPACE)
    sid = sentence_id(F.col("lang"), F.lit(2024), F.col("doc_id"), F.col("line_no"))
    tokens = rule_tokens(F.col("text"))
    return own.select(F.col("lang").alias("file"), (F.col("doc_id") * 1_000_000 + F.col("line_no")).alias("sent_no"), sid.alias("sent_id"), "lang", F.array_join(forms, " ").alias("text"), tokens.alias("tokens"))


@query(f"WITH {_LINES} SELECT lang, count(*) AS lines, sum(length(text))::BIGINT AS chars, count(*) AS numbered FROM own GROUP BY lang")
def io_numbered_lines(spark, sf):
    path = scratch(spark, "lines")
    _lines(spark, sf).select("lang", "text").write.partitionBy("lang").text(path)
    src.register(spark)
    got = spark.read.format("numbered_lines").load(path.removeprefix("file://"))
    by = got.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.max("line_no").alias("numbered"))
    return by.groupBy(F.regexp_extract("file", "lang=([^/]*)/", 1).alias("lang")).agg(*(F.sum(c).alias(c) for c in ("lines", "chars", "numbered")))


@query(f"WITH {_LINES}, f AS (SELECT lang, string_agg(text, chr(10) ORDER BY doc_id, line_no) || chr(10) AS body, count(*) AS lines FROM own GROUP BY lang) SELECT lang, strlen(body) AS bytes, lines, sha256(body) AS sha256 FROM f")
def io_manifest(spark, sf):
    """Each language's lines in order, as one file in parts of about _PART bytes; repeated numbers are put in order by text."""
    path = scratch(spark, "manifest")
    n_bytes = table(spark, sf, "documents").agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    order = ("lang", F.asc_nulls_last("doc_id"), "line_no")
    own = _lines(spark, sf).select("lang", "doc_id", "line_no", "text").repartitionByRange(n_bytes // _PART + 1, *order).sortWithinPartitions(*order, "text")
    own.select("lang", "text").write.partitionBy("lang").text(path)
    told = F.url_decode(F.replace(F.regexp_extract("lang", "lang=(.*)", 1), F.lit("+"), F.lit("%2B")))  # folders have odd characters escaped
    return layout.manifest_of_parts(spark, path).select(F.nullif(told, F.lit("__HIVE_DEFAULT_PARTITION__")).alias("lang"), "bytes", "lines", "sha256")


def _tagged_back(spark, sf, kind):
    path = scratch(spark, kind)
    conll.write(_sentences(spark, sf), path, kind)
    return conll.read_store(spark, path, kind).select("sent_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens.form", " ").alias("forms"), F.array_join("tokens.upos", " ").alias("tags"))


_TAGS_BACK = f"WITH {_SENT} SELECT sent_id, len(w)::INT AS n_tokens, array_to_string(w, ' ') AS forms, array_to_string(list_transform(w, lambda x_: {sql.upos('x_')}), ' ') AS tags FROM full_"


@query(_TAGS_BACK)
def io_basic_columns(spark, sf):
    return _tagged_back(spark, sf, "basic")


@query(_TAGS_BACK)
def io_conllu(spark, sf):
    return _tagged_back(spark, sf, "conllu")


@query(f"WITH {_SENT}, k AS (SELECT lang, unnest(w) AS x FROM full_) SELECT lang, translate(lower(x), 'ё', 'е') || '_' || {sql.upos('x')} AS key, count(*) AS count FROM k GROUP BY ALL")
def io_column_keys(spark, sf):
    path = scratch(spark, "columns")
    _sentences(spark, sf).select("lang", conll.basic_block(F.col("sent_id"), F.col("text"), F.col("tokens")).alias("value")).write.partitionBy("lang").text(path)
    got = columns.keys(columns.token_lines(spark, path, "*.txt"))
    return got.groupBy("lang", "key").agg(F.count("*").alias("count")).select(F.regexp_extract("lang", "lang=(.*)", 1).alias("lang"), "key", "count")


@query(f"WITH {_SENT} SELECT lang, count(*) AS sentences, sum(len(w))::BIGINT AS tokens FROM full_ GROUP BY lang")
def io_sentence_lengths(spark, sf):
    path = scratch(spark, "lengths")
    _sentences(spark, sf).select("lang", conll.basic_block(F.col("sent_id"), F.col("text"), F.col("tokens")).alias("value")).write.partitionBy("lang").text(path)
    got = columns.sentence_lengths(spark, path, True, "*.txt")
    return got.groupBy(F.regexp_extract("lang", "lang=(.*)", 1).alias("lang")).agg(F.count("*").alias("sentences"), F.sum("token_count").alias("tokens"))


@query(f"WITH {sql.DISCOVERED} SELECT key, n_pairs, c_H, c_M, LAS FROM t")
def io_discover_conllu(spark, sf):
    """Human and model texts as CoNLL-U documents, each side in the parts of one file, paired by place."""
    own = pairs(spark, sf).withColumn("turn", F.element_at(F.split("pair_id", "-"), -1).cast("long"))
    docs = []
    for side in ("h", "m"):
        path = scratch(spark, f"documents-{side}")
        block = F.concat(F.lit("# newdoc id = "), F.col("pair_id"), F.lit("\n"), conll.conllu_block(F.col("pair_id"), F.lit(""), F.col(side)))
        dealt = own.select("conv_id", "turn", block.alias("value")).repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn")
        dealt.select("value").write.option("maxRecordsPerFile", 1000).text(path)  # places are told by the parts in their order
        docs.append(pairing.parts_joined(pairing.documents(conll.read_store(spark, path, "conllu"))))
    met = pairing.by_place(*docs).select("pair_id", "h", "m")
    return prevalence.wlas(met).select("key", "n_pairs", "c_H", "c_M", "LAS")


@query(f"WITH {_SENT} SELECT sent_id, 'strict_alignment' AS method, idx AS split_index, n - idx AS n_second, array_to_string(w[1:idx], ' ') AS first_half FROM items")
def io_halves(spark, sf):
    path = scratch(spark, "halves")
    own = lines(spark, sf).select(sentence_id(F.col("lang"), F.lit(2024), F.col("doc_id"), F.col("line_no")).alias("sent_id"), "lang", "text", rule_tokens(F.col("text")).alias("tokens"))
    outputs.write_halves(halves.split_halves(own.where(F.array_join(F.col("tokens.form"), " ") == F.col("text"))), path)
    got = src.json_lines(spark, path, src.HALVES)
    return got.select("id.sent_id", "split_meta.method", F.col("split_meta.index").alias("split_index"), F.size("parse.second_half").alias("n_second"), "text.first_half")


@query("SELECT conv_id || '-' || turn AS item_id, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM conversations WHERE role = 'user'")
def io_resumed_generations(spark, sf):
    """A first run for half of the items, a second one for all: what is there is not asked for again."""
    path = scratch(spark, "generations")
    items = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("item_id"), "conv_id")
    outputs.append_generations(items.where("conv_id % 2 = 0"), path, lambda df: df.select("item_id", F.lit(1).alias("run")))
    return outputs.append_generations(items, path, lambda df: df.select("item_id", F.lit(2).alias("run")))


@query(f"WITH {sql.DOC_KEYS} SELECT key, count(*) AS count FROM doc_keys GROUP BY key")
def io_counts(spark, sf):
    path = scratch(spark, "counts")
    src.write_counts(key_counts(spark, sf, one=F.lit(1)).drop("one"), path)
    return src.counts(spark, path)


@query(f"WITH {sql.DISCOVERED} SELECT key, n_pairs, c_H, c_M, LAS, rank_LAS FROM ranked")
def io_word_table(spark, sf):
    path = scratch(spark, "table")
    own = discovered(spark, sf).select("key", "n_pairs", "c_H", "c_M", "LAS", "rank_LAS")
    src.write_table(own, path)
    return src.table(spark, path, "key string, n_pairs long, c_H double, c_M double, LAS double, rank_LAS int")


@query(f"WITH {_LINES}, k AS (SELECT *, char_len <= 1500 AND token_count <= 200 AS keep FROM own) SELECT lang, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS dropped, coalesce(sum(length(text)) FILTER (keep), 0)::BIGINT AS kept_chars, coalesce(sum(char_len) FILTER (NOT keep), 0)::BIGINT AS dropped_chars FROM k GROUP BY lang")
def io_filtered_lines(spark, sf):
    kept, log = scratch(spark, "kept"), scratch(spark, "dropped")
    outputs.write_filtered(ln.kept(_lines(spark, sf)).withColumn("file", F.col("source")), kept, log)
    a = spark.read.text(kept).select("lang", F.lit(1).alias("kept"), F.lit(0).alias("dropped"), F.length("value").alias("kept_chars"), F.lit(0).alias("dropped_chars"))
    told = spark.read.option("sep", "\t").option("header", True).option("quote", "").schema("language string, filename string, line_number long, char_len long, token_count long, line_content string").csv(log)
    b = told.select(F.col("language").alias("lang"), F.lit(0).alias("kept"), F.lit(1).alias("dropped"), F.lit(0).alias("kept_chars"), F.col("char_len").alias("dropped_chars"))
    return a.union(b).groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("kept", "dropped", "kept_chars", "dropped_chars")))


@query(f"WITH {sql.LINES} SELECT lang, (2020 + doc_id % 3)::INT AS year, count(*) AS lines, true AS fits FROM lines GROUP BY ALL")
def io_shards(spark, sf):
    path = scratch(spark, "shards")
    outputs.write_shards(lines(spark, sf).select("lang", (F.lit(2020) + F.col("doc_id") % 3).cast("int").alias("year"), "text"), path, 300)
    by = spark.read.parquet(path).groupBy("lang", "year", F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    return by.groupBy("lang", "year").agg(F.sum("n").alias("lines"), (F.max("n") <= 300).alias("fits"))


@query("SELECT 'l' || (conv_id % 3) AS lang, count(*) AS items, sum(turn)::BIGINT AS requests, sum(length(text))::BIGINT AS input_tokens, (2 * count(*))::BIGINT AS output_tokens, sha256('Go on: {}') AS prompt_sha256 FROM conversations GROUP BY ALL")
def io_run_summary(spark, sf):
    path = scratch(spark, "summary")
    records = table(spark, sf, "conversations").select(F.concat(F.lit("l"), (F.col("conv_id") % 3).cast("string")).alias("lang"), F.col("turn").alias("num_attempts"), F.length("text").alias("input_tokens"), F.lit(2).alias("output_tokens"))
    outputs.write_json_text(outputs.run_summary(records, {"seed": 42}, "Go on: {}"), path)
    of = "items: long, requests: long, input_tokens: long, output_tokens: long"
    got = spark.read.text(path).select(F.from_json("value", f"parameters struct<seed: int, prompt_sha256: string>, totals struct<{of}>, languages array<struct<lang: string, {of}>>").alias("j"))
    return got.select("j.parameters.prompt_sha256", F.explode("j.languages").alias("x")).select("x.*", "prompt_sha256")


@query(f"WITH {sql.DISCOVERED} SELECT (SELECT count(*) FROM pairs) AS n_pairs, (SELECT count(*) FROM pairs WHERE len(h) >= 12 AND len(m) >= 12) AS n_eligible, (SELECT count(*) FROM ranked) AS unique_keys, rank_LAS, key FROM ranked WHERE rank_LAS <= 20")
def io_table_summary(spark, sf):
    path = scratch(spark, "table-summary")
    own, found = pairs(spark, sf), discovered(spark, sf)
    outputs.write_json_text(outputs.table_summary(found, prevalence.quality(own, found), prevalence.corpus_score(found), {"k": 12}), path)
    got = spark.read.text(path).select(F.from_json("value", "qc struct<n_pairs: long, n_eligible: long, unique_keys: long>, top array<struct<rank_LAS: int, key: string>>").alias("j"))
    return got.select("j.qc.*", F.explode("j.top").alias("x")).select("n_pairs", "n_eligible", "unique_keys", "x.rank_LAS", "x.key")


@query(r"SELECT conv_id || '-' || turn AS item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS continuation FROM conversations WHERE role = 'assistant'")
def io_spot_check(spark, sf):
    path = scratch(spark, "spot-check")
    outputs.write_spot_check(table(spark, sf, "conversations").where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("item_id"), F.col("text").alias("continuation")), path)
    got = spark.read.option("sep", "\t").option("header", True).schema("item_id string, continuation string").csv(path)
    return got.select("item_id", fold_space(F.coalesce("continuation", F.lit(""))).alias("continuation"))


def _quarters(values):
    """A stand-in tokenizer: four characters are a model token."""
    return [-(-len(v) // 4) for v in values]


@query(f"WITH {_SENT}, r AS (SELECT lang, ceil(length(array_to_string(w, ' ')) / 4.0::DOUBLE) / len(w) AS ratio FROM full_) SELECT lang, count(*) AS sentences_analyzed, round(avg(ratio), 3) AS avg_bpe_per_pos_token, round(coalesce(stddev_samp(ratio), 0.0), 3) AS std_dev, round(min(ratio), 4) AS min_ratio, round(max(ratio), 4) AS max_ratio FROM r GROUP BY lang")
def io_token_ratios(spark, sf):
    path = scratch(spark, "ratios")
    _sentences(spark, sf).select("lang", conll.basic_block(F.col("sent_id"), F.col("text"), F.col("tokens")).alias("value")).write.partitionBy("lang").text(path)
    got = columns.token_ratios(columns.texts_with_counts(spark, path, "*.txt"), _quarters)
    return got.select(F.regexp_extract("lang", "lang=(.*)", 1).alias("lang"), "sentences_analyzed", *(F.round(c, 3).alias(c) for c in ("avg_bpe_per_pos_token", "std_dev")), "min_ratio", "max_ratio")
