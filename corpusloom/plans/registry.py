"""Registered queries over the driver's tables, and DuckDB SQL for the same rows.

The tables hold no Devanagari, so a third of the documents is transliterated
letter by letter; the default quality rules then keep those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import tensors
from ..functions import text as T
from ..functions.numbers import rounded
from ..operators import cleaning, dedup, evaluation, extract, metrics, quality, report, sampling, schedule, splits
from ..operators.ordering import range_bucket, ranked

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LETTERS, DEVANAGARI = "etaoinsrhldcu", "एतअओइनसरहलदचउ"
WS = T.WS

# --- SQL building blocks -------------------------------------------------------------------------------------------
SOURCE = f"(SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN translate(text, '{LETTERS}', '{DEVANAGARI}') ELSE text END AS text FROM documents)"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def sql_clean(x: str) -> str:
    urls = rf"regexp_replace(nfc_normalize({x}), '(?i)https?://[^{WS}]+|www\.[^{WS}]+', ' ', 'g')"
    tags = f"regexp_replace({urls}, '<[^>]+>', ' ', 'g')"
    noise = rf"regexp_replace({tags}, '[^\x{{0900}}-\x{{097F}}\x{{20}}-\x{{7E}}\x{{A0}}-\x{{FF}}\x{{2000}}-\x{{206F}}\n\r\t]', ' ', 'g')"
    return sql_strip(rf"regexp_replace({noise}, '[ \t]{{2,}}', ' ', 'g')")


def sql_without(x: str, kind: str) -> str:
    return f"length(regexp_replace({x}, '{kind}', '', 'g'))"


TARGET, LATIN = sql_without("clean", r"[^\x{0900}-\x{097F}]"), sql_without("clean", "[^A-Za-z]")
VISIBLE = sql_without("clean", f"[{WS}]")
REPEATED = "len(list_filter(range(1, len(l) - 3), lambda i: l[i] <> chr(10) AND l[i] = l[i + 1] AND l[i] = l[i + 2] AND l[i] = l[i + 3] AND l[i] = l[i + 4])) > 0"
JUDGED = f"""(SELECT *, CASE WHEN n < 20 THEN 'too_short' WHEN n > 50000 THEN 'too_long' WHEN t < 10 THEN 'few_target_chars'
        WHEN v > 0 AND a / v > 0.9 THEN 'high_latin_ratio' WHEN {REPEATED} THEN 'repeated_chars' END AS reject_reason
    FROM (SELECT doc_id, source, clean, length(clean) AS n, {TARGET} AS t, {LATIN} AS a, {VISIBLE} AS v, string_split(clean, '') AS l FROM (SELECT doc_id, source, {sql_clean('text')} AS clean FROM {SOURCE})))"""
WORDS = lambda x: f"list_filter(regexp_split_to_array({x}, '[{WS}]+'), lambda w: w <> '')"
PAIRS = f"""(SELECT conv_id, {sql_strip("arg_max(text, turn) FILTER (WHERE role = 'user')")} AS u, {sql_strip("arg_max(text, turn) FILTER (WHERE role = 'assistant')")} AS a FROM conversations GROUP BY conv_id)"""
NGRAMS = lambda w, n: f"list_transform(range(1, greatest(len({w}) - {n - 1}, 0) + 1), lambda i: {w}[i:i + {n - 1}])"
LOGITS = "(SELECT vec_id, unnest(range(0, len(embedding))) AS token_id, unnest(embedding)::DOUBLE * 10 AS logit FROM embeddings)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- tables --------------------------------------------------------------------------------------------------------
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return d.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.translate("text", LETTERS, DEVANAGARI)).otherwise(F.col("text")))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its messages in order of turn."""
    c = table(spark, sf_dir, "conversations")
    m = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return m


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = messages(spark, sf_dir)
    return m.select("conv_id", extract.last_message(F.col("messages"), "user").alias("u"), extract.last_message(F.col("messages"), "assistant").alias("a")).where("u != '' and a != ''")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.posexplode("embedding").alias("token_id", "x")).select("vec_id", F.col("token_id").cast("long").alias("token_id"), (F.col("x").cast("double") * 10).alias("logit"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value")


def micro(c: Column) -> Column:
    """A ratio as whole millionths, which compare alike in any engine."""
    return F.floor(c * 1e6 + 0.5).cast("long")


# --- text and quality ----------------------------------------------------------------------------------------------
@query(rf"""SELECT page_id, {sql_strip("regexp_replace(regexp_replace(regexp_replace(url || ' ' || html, '(?i)https?://[^" + WS + r"]+|www\.[^" + WS + r"]+', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t]{2,}', ' ', 'g')")} AS text FROM pages""")
def url_html_strip(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(T.without_markup(F.concat("url", F.lit(" "), "html")), T.MANY_SPACES, " ")
    return p.select("page_id", T.strip(bare).alias("text"))


@query(f"SELECT doc_id, {sql_clean('text')} AS clean FROM {SOURCE}")
def clean_text(spark, sf_dir):
    return T.spread(documents(spark, sf_dir)).select("doc_id", T.cleaned(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, nfc_normalize(text) AS text, sha256(nfc_normalize(text)) AS digest FROM {SOURCE}")
def nfc_digest(spark, sf_dir):
    return T.with_barrier(T.spread(documents(spark, sf_dir)), text=T.normalized(F.col("text"))).select("doc_id", "text", F.sha2("text", 256).alias("digest"))


@query(f"""SELECT doc_id, n_target, n_visible, CASE WHEN n_visible = 0 THEN 0 ELSE floor(n_target / n_visible * 1e6 + 0.5)::BIGINT END AS target_millionths, CASE WHEN n_visible = 0 THEN 0 ELSE floor(n_latin / n_visible * 1e6 + 0.5)::BIGINT END AS latin_millionths
    FROM (SELECT doc_id, {TARGET} AS n_target, {LATIN} AS n_latin, {VISIBLE} AS n_visible FROM (SELECT doc_id, text AS clean FROM {SOURCE}))""")
def script_ratio(spark, sf_dir):
    c = F.col("text")
    d = T.with_barrier(T.spread(documents(spark, sf_dir)), n_target=T.target_count(c), n_latin=T.latin_count(c), n_visible=T.visible_count(c))
    return d.select("doc_id", "n_target", "n_visible", micro(T.ratio(F.col("n_target"), F.col("n_visible"))).alias("target_millionths"), micro(T.ratio(F.col("n_latin"), F.col("n_visible"))).alias("latin_millionths"))


@query(f"SELECT doc_id, n AS n_length, t AS n_target FROM {JUDGED} WHERE reject_reason IS NULL")
def quality_filter(spark, sf_dir):
    return cleaning.judged(documents(spark, sf_dir), "text").where("reject_reason is null").select("doc_id", "n_length", "n_target")


@query(f"SELECT reject_reason, count(*) AS n FROM {JUDGED} GROUP BY reject_reason")
def reject_reasons(spark, sf_dir):
    return cleaning.judged(documents(spark, sf_dir), "text").groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, length(text) AS n_length FROM documents WHERE length(text) BETWEEN 20 AND 50000 AND length(regexp_replace(text, '[^A-Za-z\\x{C0}-\\x{FF}]', '', 'g')) >= 0
    AND length(regexp_replace(text, '[^A-Za-z\\x{C0}-\\x{FF}]', '', 'g')) >= 0.5 * length(regexp_replace(text, '[""" + WS + """]', '', 'g'))""".replace("\\\\", "\\"))
def quality_latin_profile(spark, sf_dir):
    config = quality.Quality(profile=T.LATIN).without("few_target_chars", "high_latin_ratio", "repeated_chars").also(quality.Rule("low_target_ratio", "target_ratio", least=0.5))
    return quality.with_reason(T.spread(table(spark, sf_dir, "documents")), "text", config).where("reject_reason is null").select("doc_id", "n_length")


@query(f"SELECT doc_id, clean AS text, n AS n_length, t AS n_target FROM {JUDGED} WHERE reject_reason IS NULL QUALIFY row_number() OVER (PARTITION BY clean ORDER BY doc_id) = 1")
def quality_dedup(spark, sf_dir):
    return cleaning.clean(documents(spark, sf_dir), "text", ["doc_id"]).rows.select("doc_id", F.col("clean").alias("text"), "n_length", "n_target")


@query("SELECT doc_id, sha256(text) AS digest FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def exact_dedup(spark, sf_dir):
    return dedup.first_by_digest(table(spark, sf_dir, "documents"), "text", ["doc_id"]).select("doc_id", F.sha2("text", 256).alias("digest"))


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY text, source ORDER BY doc_id) = 1")
def dedup_by_source(spark, sf_dir):
    return dedup.first_by_digest(table(spark, sf_dir, "documents"), "text", ["doc_id"], ["source"]).select("doc_id", "source")


@query("SELECT doc_id FROM documents d WHERE doc_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = d.text)")
def dedup_across_runs(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    earlier = d.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("digest"))
    return dedup.unseen(d.where("doc_id % 2 = 1"), "text", earlier).select("doc_id")


@query(f"""SELECT count(*) AS seen, count(DISTINCT CASE WHEN reject_reason IS NULL THEN clean END) AS passed, count(reject_reason) AS low_quality,
    count(*) FILTER (WHERE reject_reason IS NULL) - count(DISTINCT CASE WHEN reject_reason IS NULL THEN clean END) AS duplicate,
    floor(100.0 * count(DISTINCT CASE WHEN reject_reason IS NULL THEN clean END) / greatest(1, count(*)) * 1e6 + 0.5)::BIGINT AS retention_millionths FROM {JUDGED}""")
def corpus_stats(spark, sf_dir):
    stats = cleaning.clean(documents(spark, sf_dir), "text", ["doc_id"]).stats
    return stats.withColumn("retention_millionths", micro(metrics.ratio_percent(F.col("passed"), F.col("seen"))))


# --- records -------------------------------------------------------------------------------------------------------
@query(f"SELECT conv_id, '[INST] ' || u || ' [/INST] ' || a AS text FROM {PAIRS} WHERE u <> '' AND a <> ''")
def instruct_format(spark, sf_dir):
    return messages(spark, sf_dir).select("conv_id", extract.instruct(F.col("messages")).alias("text")).where("text is not null")


@query(f"""SELECT conv_id, {sql_strip("replace(CASE WHEN contains(c, '[/INST]') THEN substr(c, 1, strpos(c, '[/INST]') - 1) ELSE c END, '[INST]', '')")} AS instruction,
    CASE WHEN contains(c, '[/INST]') THEN {sql_strip("substr(c, strpos(c, '[/INST]') + 7)")} ELSE '' END AS output
    FROM (SELECT conv_id, {sql_clean("'[INST] ' || u || ' [/INST] ' || a")} AS c FROM {PAIRS} WHERE u <> '' AND a <> '')""")
def instruct_resplit(spark, sf_dir):
    made = T.with_barrier(messages(spark, sf_dir).select("conv_id", extract.instruct(F.col("messages")).alias("text")).where("text is not null"), clean=T.cleaned(F.col("text")))
    instruction, output = extract.instruct_parts(F.col("clean"))
    return made.select("conv_id", instruction.alias("instruction"), output.alias("output"))


@query(f"""SELECT p.conv_id, CASE WHEN coalesce(s, '') <> '' THEN '<|system|> ' || s || ' <|user|> ' || u || ' <|assistant|>' ELSE '[INST] ' || u || ' [/INST]' END AS prompt
    FROM {PAIRS} p LEFT JOIN (SELECT conv_id, {sql_strip("arg_max(text, turn)")} AS s FROM conversations WHERE role = 'system' GROUP BY conv_id) USING (conv_id) WHERE u <> ''""")
def prompt_format(spark, sf_dir):
    m = messages(spark, sf_dir)
    u, s = extract.last_message(F.col("messages"), "user"), extract.last_message(F.col("messages"), "system")
    return m.select("conv_id", u.alias("u"), s.alias("s")).where("u != ''").select("conv_id", T.instruct_prompt(F.col("u"), F.col("s")).alias("prompt"))


@query(f"SELECT conv_id, u || ' ' || a AS text, {sql_clean('u')} AS hi, a AS en FROM {PAIRS} WHERE u <> '' AND a <> ''")
def parallel_pairs(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("conv_id", extract.parallel(F.col("u"), F.col("a")).alias("text"), T.cleaned(F.col("u")).alias("hi"), T.strip(F.col("a")).alias("en"))


@query()
def parallel_clean(spark, sf_dir):
    """Two texts a row on one set of seen texts; order-dependent, so tests hold it against a sequential simulation."""
    from ..plans.checkpoints import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    p = pairs(spark, sf_dir).withColumn("value", F.to_json(F.struct(F.struct(F.translate("a", LETTERS, DEVANAGARI).alias("hi"), F.col("u").alias("en")).alias("translation"))))
    return cleaning.clean_json(p.select(F.col("conv_id").alias("line"), "value"), "parallel").rows


RECORDS = f"""(SELECT 'd' || doc_id AS id, 1 AS kind, text AS x, NULL AS y FROM documents UNION ALL
    SELECT 'p' || conv_id, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 3 END, u, a FROM {PAIRS} WHERE u <> '' AND a <> '')"""


def records(spark, sf_dir) -> DataFrame:
    """JSON records of three shapes: text; hi and en; instruction and output."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.to_json(F.struct("text")).alias("j"))
    two = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("u").alias("hi"), F.col("a").alias("en")))).otherwise(F.to_json(F.struct(F.col("u").alias("instruction"), F.col("a").alias("output"))))
    p = pairs(spark, sf_dir).select(F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("id"), two.alias("j"))
    return d.unionByName(p)


def extracted(spark, sf_dir, how) -> DataFrame:
    return T.with_barrier(T.spread(records(spark, sf_dir)), text=how(F.col("j"))).where("text is not null").select("id", "text")


@query(f"SELECT id, text FROM (SELECT id, {sql_strip('CASE kind WHEN 1 THEN x WHEN 2 THEN x ELSE x || chr(32) || y END')} AS text FROM {RECORDS}) WHERE length(text) > 10")
def tokenizer_corpus(spark, sf_dir):
    return extracted(spark, sf_dir, extract.tokenizer_text)


@query(f"SELECT id, text FROM (SELECT id, CASE kind WHEN 1 THEN x WHEN 2 THEN {sql_strip('x || chr(32) || y')} ELSE '[INST] ' || x || ' [/INST] ' || y END AS text FROM {RECORDS}) WHERE length(text) > 20")
def train_extract(spark, sf_dir):
    return extracted(spark, sf_dir, extract.training_text)


@query(f"SELECT id, text FROM (SELECT id, CASE kind WHEN 3 THEN '' ELSE x END AS text FROM {RECORDS}) WHERE length(text) > 20")
def eval_extract(spark, sf_dir):
    return extracted(spark, sf_dir, extract.evaluation_text)


@query(f"SELECT kind::BIGINT AS kind, count(*) AS n FROM {RECORDS} GROUP BY kind")
def union_corpora(spark, sf_dir):
    j = F.col("j")
    kind = F.when(extract.has_key(j, "text"), 1).when(extract.has_key(j, "hi"), 2).otherwise(3).cast("long")
    return records(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, ['text', 'lang'] AS keys, substr(text, 1, 300) AS head FROM documents ORDER BY doc_id LIMIT 3")
def schema_peek(spark, sf_dir):
    d = table(spark, sf_dir, "documents").orderBy("doc_id").limit(3).withColumn("j", F.to_json(F.struct("text", "lang")))
    return d.select("doc_id", F.json_object_keys("j").alias("keys"), F.substring("text", 1, 300).alias("head"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 500")
def first_rows(spark, sf_dir):
    """The operator is a cap: the first 500 in scan order."""
    return splits.first_rows(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 500)


# --- order ---------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS position FROM documents")
def seeded_shuffle(spark, sf_dir):
    return splits.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42)


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, floor(count(*) OVER () * 0.005)) THEN 'val' ELSE 'train' END AS split FROM documents")
def train_val_split(spark, sf_dir):
    return splits.train_val(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("SELECT doc_id, batch_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 8 AS batch_id, count(*) OVER () AS n FROM documents) WHERE batch_id < n // 8")
def batches(spark, sf_dir):
    return splits.batched(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8, drop_last=True)


@query("SELECT item_id, epoch::INT AS epoch, epoch * count(*) OVER (PARTITION BY epoch) + row_number() OVER (PARTITION BY epoch ORDER BY item_id) - 1 AS position FROM benchmark, range(3) t(epoch)")
def cycled_reader(spark, sf_dir):
    return splits.cycled(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 3)


# --- token sequences -----------------------------------------------------------------------------------------------
VOCAB = f"(SELECT w, row_number() OVER (ORDER BY n DESC, w)::INT AS id FROM (SELECT w, count(*) AS n FROM (SELECT unnest({WORDS('text')}) AS w FROM benchmark) GROUP BY w))"
IDS = f"(SELECT item_id, list(id ORDER BY i) AS ids FROM (SELECT item_id, unnest({WORDS('text')}) AS w, unnest(range(0, len({WORDS('text')}))) AS i FROM benchmark) JOIN {VOCAB} USING (w) GROUP BY item_id)"


def by_count(words: DataFrame, word: str) -> DataFrame:
    """The vocabulary of ``words``: each once, with its rank by count (id), ties in the order of bytes."""
    counts = words.groupBy(word).agg(F.count("*").alias("n"))
    # Few words are frequent, most are rare: counts up to 4 are parted by two bytes of the word, others by powers of two.
    head = F.hex(F.substring(F.encode(word, "utf-8"), 1, 2))
    rare = F.col("n") <= 4
    bucket = F.struct(F.when(rare, -F.col("n")).otherwise(-4 - F.floor(F.log2("n"))).alias("n"), F.when(rare, head).otherwise("").alias("head"))
    return ranked(counts, bucket, [F.desc("n"), word], "id").select(word, F.col("id").cast("int").alias("id"))


def word_ids(spark, sf_dir) -> DataFrame:
    """item_id and the ranks of its words in the table's vocabulary."""
    each = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.words(F.col("text"))).alias("i", "w"))
    return each.join(by_count(each, "w"), "w").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("ids"))


@query(f"SELECT item_id, (ids || list_resize([]::INT[], 32, 0))[1:32] AS ids FROM {IDS}")
def padded_ids(spark, sf_dir):
    return word_ids(spark, sf_dir).select("item_id", S.padded(F.col("ids"), 32, 0).alias("ids"))


@query(f"SELECT item_id, c[1:32] AS inputs, c[2:33] AS targets FROM (SELECT item_id, (ids || list_resize([]::INT[], 33, 0))[1:33] AS c FROM {IDS})")
def chunks_shift(spark, sf_dir):
    c = T.with_barrier(word_ids(spark, sf_dir), c=splits.exact_chunks(F.col("ids"), 32, 0))
    inputs, targets = S.shifted(F.col("c"))
    return c.select("item_id", inputs.alias("inputs"), targets.alias("targets"))


@query(f"SELECT item_id, list_filter([2] || ids || [3], lambda i: i NOT IN (1, 2, 3)) AS ids FROM {IDS}")
def special_ids_dropped(spark, sf_dir):
    return word_ids(spark, sf_dir).select("item_id", S.without_ids(S.framed(F.col("ids"), 2, 3), [1, 2, 3]).alias("ids"))


@query(f"""SELECT count(*) FILTER (WHERE r = p) AS correct, count(*) AS total, floor(count(*) FILTER (WHERE r = p) / greatest(1, count(*)) * 1e6 + 0.5)::BIGINT AS accuracy_millionths
    FROM (SELECT unnest(ids[2:]) AS r, unnest(ids[1:len(ids) - 1]) AS p FROM {IDS}) WHERE r <> 1""")
def token_accuracy(spark, sf_dir):
    p, r = S.shifted(F.col("ids"))
    out = metrics.token_accuracy(word_ids(spark, sf_dir).select(r.alias("r"), p.alias("p")), "r", "p", 1)
    return out.select("correct", "total", micro(F.col("accuracy")).alias("accuracy_millionths"))


@query(f"SELECT w AS piece, id FROM {VOCAB}")
def vocabulary_lookup(spark, sf_dir):
    """The piece of every id of the vocabulary."""
    from ..operators.tokenizing import looked_up

    each = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("piece"))
    vocab = by_count(each, "piece")
    return looked_up(vocab.select("id"), vocab, "id", "piece", "<unk>", bounded=False).select("piece", "id")


@query(f"SELECT w AS piece, id, w AS back FROM {VOCAB}")
def vocabulary_lookup_all(spark, sf_dir):
    """Every word of the table to its id in the whole vocabulary, and every id back to its piece, by plain joins."""
    from ..operators.tokenizing import looked_up

    words = table(spark, sf_dir, "benchmark").select(F.explode(T.words(F.col("text"))).alias("piece"))
    vocab = by_count(words, "piece")
    found = looked_up(words.distinct(), vocab, "piece", "id", 0, bounded=False)
    return looked_up(found, vocab.withColumnRenamed("piece", "back"), "id", "back", "<unk>", bounded=False).select("piece", "id", "back")


@query()
def sentencepiece_round_trip(spark, sf_dir):
    """Ids and decoded text under a public SentencePiece model; its length in pieces equals that of its ids."""
    import public_tokenizers

    from ..operators import tokenizing

    model = public_tokenizers.path("piece_bpe_32k.model")
    b = table(spark, sf_dir, "benchmark").withColumn("ids", tokenizing.encode(F.col("text"), model))
    return b.select("item_id", F.size("ids").alias("n_ids"), F.size(tokenizing.pieces(F.col("text"), model)).alias("n_pieces"), tokenizing.decode(F.col("ids"), model).alias("decoded"))


# --- metrics -------------------------------------------------------------------------------------------------------
SHARE = lambda w, n, top: f"CASE WHEN len({NGRAMS(w, n)}) = 0 THEN 0 ELSE floor({top} / len({NGRAMS(w, n)}) * 1e6 + 0.5)::BIGINT END"
QUALITY_SQL = f"""SELECT conv_id, len(w) AS n_tokens, {SHARE('w', 1, f'len(list_distinct({NGRAMS("w", 1)}))')} AS distinct_1, {SHARE('w', 2, f'len(list_distinct({NGRAMS("w", 2)}))')} AS distinct_2,
    {SHARE('w', 4, f'(len({NGRAMS("w", 4)}) - len(list_distinct({NGRAMS("w", 4)})))')} AS repetition_rate FROM (SELECT conv_id, {WORDS('a')} AS w FROM {PAIRS} WHERE u <> '' AND a <> '')"""


@query(QUALITY_SQL)
def generation_quality(spark, sf_dir):
    q = metrics.generation_quality(pairs(spark, sf_dir), "a")
    return q.select("conv_id", F.col("n_tokens").cast("long").alias("n_tokens"), *(micro(F.col(c)).alias(c) for c in ("distinct_1", "distinct_2", "repetition_rate")))


@query(f"SELECT count(*) AS n, floor(avg(distinct_1 / 1e6) * 1e4 + 0.5)::BIGINT AS avg_distinct_1, floor(avg(n_tokens) * 1e4 + 0.5)::BIGINT AS avg_tokens FROM ({QUALITY_SQL})")
def macro_averages(spark, sf_dir):
    a = metrics.macro_average(generation_quality(spark, sf_dir).withColumn("distinct_1", F.col("distinct_1") / 1e6), ["distinct_1", "n_tokens"])
    ten_thousandths = lambda c: F.floor(F.col(c) * 1e4 + 0.5).cast("long")
    return a.select("n", ten_thousandths("avg_distinct_1").alias("avg_distinct_1"), ten_thousandths("avg_n_tokens").alias("avg_tokens"))


def sql_matches(items: str, n: int) -> str:
    grams = lambda side: f"SELECT conv_id, g, count(*) AS c FROM (SELECT conv_id, unnest({NGRAMS(items.format(side), n)}) AS g FROM p) GROUP BY ALL"
    return f"""SELECT {n} AS n, coalesce((SELECT sum(least(h.c, r.c)) FROM ({grams('a')}) h JOIN ({grams('u')}) r USING (conv_id, g)), 0) AS hits,
        coalesce((SELECT sum(c) FROM ({grams('a')})), 0) AS hyp_total, coalesce((SELECT sum(c) FROM ({grams('u')})), 0) AS ref_total"""


@query(f"""WITH p AS (SELECT conv_id, {WORDS('u')} AS u, {WORDS('a')} AS a FROM {PAIRS} WHERE u <> '' AND a <> ''),
    o AS ({' UNION ALL '.join(sql_matches('{}', n) for n in range(1, 5))}),
    m AS (SELECT CASE WHEN min(CASE WHEN hyp_total = 0 THEN 0 ELSE (hits + 1.0) / (hyp_total + 1.0) END) > 0 THEN exp(sum(ln((hits + 1.0)::DOUBLE / (hyp_total + 1.0)::DOUBLE)) / 4) ELSE 0 END AS mean FROM o),
    l AS (SELECT sum(len(u))::BIGINT AS ref_len, sum(len(a))::BIGINT AS hyp_len FROM p)
    SELECT floor(mean * CASE WHEN hyp_len = 0 THEN 0 WHEN hyp_len >= ref_len THEN 1 ELSE exp(1 - ref_len / hyp_len) END * 1e6 + 0.5)::BIGINT AS bleu_millionths, ref_len, hyp_len FROM m, l""")
def bleu(spark, sf_dir):
    b = metrics.bleu(pairs(spark, sf_dir), "conv_id", "u", "a")
    return b.select(micro(F.col("bleu")).alias("bleu_millionths"), "ref_len", "hyp_len")


@query(f"""WITH p AS (SELECT conv_id, string_split(u, '') AS u, string_split(a, '') AS a FROM {PAIRS} WHERE u <> '' AND a <> ''),
    o AS ({' UNION ALL '.join(sql_matches('{}', n) for n in range(1, 7))}),
    m AS (SELECT sum(hits::DOUBLE / greatest(hyp_total, 1)) / 6 AS p, sum(hits::DOUBLE / greatest(ref_total, 1)) / 6 AS r FROM o)
    SELECT floor(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END * 1e6 + 0.5)::BIGINT AS chrf_millionths, floor(p * 1e6 + 0.5)::BIGINT AS precision_millionths, floor(r * 1e6 + 0.5)::BIGINT AS recall_millionths FROM m""")
def chrf(spark, sf_dir):
    c = metrics.chrf(pairs(spark, sf_dir), "conv_id", "u", "a")
    return c.select(micro(F.col("chrf")).alias("chrf_millionths"), micro(F.col("avg_precision")).alias("precision_millionths"), micro(F.col("avg_recall")).alias("recall_millionths"))


@query(f"""WITH p AS (SELECT conv_id, {WORDS('u')} AS u, {WORDS('a')} AS a FROM {PAIRS} WHERE u <> '' AND a <> ''), o AS ({' UNION ALL '.join(sql_matches('{}', n) for n in range(1, 5))})
    SELECT n, hits::BIGINT AS hits, hyp_total::BIGINT AS hyp_total, ref_total::BIGINT AS ref_total FROM o""")
def ngram_intersection(spark, sf_dir):
    return metrics.matched(pairs(spark, sf_dir), "conv_id", "u", "a", 4).select("n", "hits", "hyp_total", "ref_total")


@query("""SELECT floor(avg(l) * 1e4 + 0.5)::BIGINT AS loss_ten_thousandths, count(*) AS n_batches FROM
    (SELECT avg(value / 100) AS l FROM (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 8 AS b FROM events) GROUP BY b)""")
def perplexity(spark, sf_dir):
    e = splits.batched(events(spark, sf_dir).withColumn("loss", F.col("value") / 100), "event_id", 8)
    p = metrics.perplexity(e, "batch_id", "loss")
    return p.select(F.floor(F.col("avg_loss") * 1e4 + 0.5).cast("long").alias("loss_ten_thousandths"), "n_batches")


@query("SELECT (32000 * 512 + 8 * (512 * 1536 + 512))::BIGINT AS total, (8 * (512 * 1536 + 512))::BIGINT AS trainable")
def parameter_counts(spark, sf_dir):
    layers = [([32000, 512], False), *[x for _ in range(8) for x in (([512, 1536], True), ([512], True))]]
    return metrics.parameter_count(spark.createDataFrame(layers, "shape array<long>, trainable boolean"))


@query("SELECT event_id, format('{:.1f}', value)::DOUBLE AS tenths, format('{:.2f}', value / 8)::DOUBLE AS hundredths, format('{:.4f}', value / 3)::DOUBLE AS ten_thousandths FROM events")
def half_even_rounding(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", rounded(v, 1).alias("tenths"), rounded(v / 8, 2).alias("hundredths"), rounded(v / 3, 4).alias("ten_thousandths"))


@query("""SELECT floor(avg(l) * 1e4 + 0.5)::BIGINT AS loss_ten_thousandths, floor(exp(least(avg(l), 20)) * 1e4 + 0.5)::BIGINT AS perplexity_ten_thousandths, count(*) AS n_batches FROM
    (SELECT avg(value / 100) AS l FROM (SELECT value, (row_number() OVER (ORDER BY event_id) - 1) // 8 AS b FROM events) WHERE b < 50 GROUP BY b)""")
def validation_perplexity(spark, sf_dir):
    """Validation stops after 50 batches."""
    p = metrics.perplexity(losses(spark, sf_dir), "batch_id", "loss", 50)
    return p.select(*(F.floor(F.col(c) * 1e4 + 0.5).cast("long").alias(f"{to}_ten_thousandths") for c, to in (("avg_loss", "loss"), ("perplexity", "perplexity"))), "n_batches")


def losses(spark, sf_dir) -> DataFrame:
    return splits.batched(events(spark, sf_dir).withColumn("loss", F.col("value") / 100), "event_id", 8)


def answers(spark, sf_dir) -> DataFrame:
    """Each conversation's answer as the text generated for its question."""
    return pairs(spark, sf_dir).select(F.col("conv_id").alias("id"), F.col("u").alias("prompt"), F.col("a").alias("output"))


def shared_folder(spark: SparkSession, name: str) -> str:
    import uuid

    from ..plans.checkpoints import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


SAMPLED = f"""(SELECT u, a, w, CASE WHEN {VISIBLE} = 0 THEN 0 ELSE {TARGET}::DOUBLE / {VISIBLE} END AS target_ratio, CASE WHEN {VISIBLE} = 0 THEN 0 ELSE {LATIN}::DOUBLE / {VISIBLE} END AS latin_ratio,
    {', '.join(f"CASE WHEN len({NGRAMS('w', n)}) = 0 THEN 0 ELSE {top}::DOUBLE / len({NGRAMS('w', n)}) END AS {name}" for n, name, top in ((1, 'distinct_1', f"len(list_distinct({NGRAMS('w', 1)}))"), (2, 'distinct_2', f"len(list_distinct({NGRAMS('w', 2)}))"), (4, 'repetition_rate', f"(len({NGRAMS('w', 4)}) - len(list_distinct({NGRAMS('w', 4)})))")))}
    FROM (SELECT u, a, a AS clean, {WORDS('a')} AS w FROM {PAIRS} WHERE u <> '' AND a <> ''))"""
MEASURES = ("target_ratio", "latin_ratio", "distinct_1", "distinct_2", "repetition_rate")


@query(f"""SELECT u AS prompt, a AS generated, len(w)::BIGINT AS n_tokens, {', '.join(f"format('{{:.4f}}', {m}::DOUBLE)::DOUBLE AS {m}" for m in evaluation.SHARES)} FROM {SAMPLED}""")
def generation_samples(spark, sf_dir):
    return evaluation.samples(answers(spark, sf_dir))


@query(f"""SELECT 'answers' AS model, l.*, t.*, q.*, b.bleu_millionths, c.chrf_millionths FROM ({ORACLES['perplexity']}) l, ({ORACLES['token_accuracy']}) t, ({ORACLES['bleu']}) b, ({ORACLES['chrf']}) c,
    (SELECT count(*) AS n_prompts, count(*) AS n_samples, floor(avg(len(w)) * 1e6 + 0.5)::BIGINT AS n_tokens_millionths, {', '.join(f'floor(avg({m}) * 1e6 + 0.5)::BIGINT AS {m}_millionths' for m in MEASURES)} FROM {SAMPLED}) q""")
def full_evaluation(spark, sf_dir):
    """Report and samples are written to the shared folder; the row is what the files say."""
    folder = shared_folder(spark, "evaluation")
    p, r = S.shifted(F.col("ids"))
    predicted = word_ids(spark, sf_dir).select(r.alias("ref"), p.alias("pred"))
    evaluation.evaluate(losses(spark, sf_dir), predicted, answers(spark, sf_dir), folder, ignore_id=1, about={"model": "answers"})
    value = lambda path, kind="double": F.get_json_object("value", f"$.{path}").cast(kind)
    row = spark.read.text(f"{folder}/report", wholetext=True).select(
        value("run.model", "string").alias("model"),
        F.floor(value("perplexity.avg_loss") * 1e4 + 0.5).cast("long").alias("loss_ten_thousandths"),
        value("perplexity.n_batches", "long").alias("n_batches"),
        value("token_accuracy.correct", "long").alias("correct"),
        value("token_accuracy.total", "long").alias("total"),
        micro(value("token_accuracy.accuracy")).alias("accuracy_millionths"),
        value("generation_quality.n_prompts", "long").alias("n_prompts"),
        *(micro(value(f"generation_quality.avg_{m}")).alias(f"{m}_millionths") for m in ("n_tokens", *MEASURES)),
        micro(value("generation_quality.corpus_bleu")).alias("bleu_millionths"),
        micro(value("generation_quality.corpus_chrf")).alias("chrf_millionths"),
    )
    return row.crossJoin(spark.read.text(f"{folder}/samples").agg(F.count("*").alias("n_samples")))  # one row each


def backwards():
    """A stand-in for a model: the prompt's words from the last to the first, a tenth of a second for each letter of the first word but one."""
    import pandas as pd

    def run(prompts: pd.Series) -> pd.DataFrame:
        words = prompts.str.split()
        return pd.DataFrame({"output": words.map(lambda w: " ".join(reversed(w))), "n_tokens": words.map(len).astype("int64"), "seconds": words.map(lambda w: (len(w[0]) - 1) / 10 if w else 0.0).astype("float64")})

    return run


@query(f"""SELECT u AS prompt, array_to_string(list_reverse(w), ' ') AS output, format('{{:.2f}}', len(w) / greatest(coalesce(length(w[1]) - 1, 0)::DOUBLE / 10, 1e-6::DOUBLE))::DOUBLE AS tokens_per_sec
    FROM (SELECT u, {WORDS('u')} AS w FROM {PAIRS} WHERE u <> '' AND a <> '')""")
def batch_generation(spark, sf_dir):
    """Results are written as JSON lines to the shared folder and read again."""
    folder = shared_folder(spark, "generated")
    evaluation.write_batch(evaluation.generated(answers(spark, sf_dir).select("prompt"), backwards), folder)
    return spark.read.schema("prompt string, output string, tokens_per_sec double").json(folder)


@query(f"""WITH k AS (SELECT DISTINCT clean FROM {JUDGED} WHERE reject_reason IS NULL)
    SELECT sha256(clean) AS digest, (SELECT count(*) FROM documents) AS n_in, (SELECT count(*) FROM k) AS n_out FROM k""")
def json_lines_clean(spark, sf_dir):
    """Documents as JSON lines through the reader, cleaning and the writer; rows are those of the written files."""
    from ..sources import jsonl

    folder = shared_folder(spark, "lines")
    jsonl.write_json(documents(spark, sf_dir).select("text"), f"{folder}/raw")
    lines = jsonl.read_lines(spark, f"{folder}/raw", f"{folder}/numbered")
    jsonl.write_json(cleaning.clean_json(lines, "monolingual").rows.select("text"), f"{folder}/clean")
    out = spark.read.schema("text string").json(f"{folder}/clean")
    counts = lines.agg(F.count("*").alias("n_in")).crossJoin(out.agg(F.count("*").alias("n_out")))
    return out.select(F.sha2("text", 256).alias("digest")).crossJoin(F.broadcast(counts))  # counts are one row


@query("SELECT component, n::BIGINT AS n, floor(share * 1e6 + 0.5)::BIGINT AS share_millionths FROM (VALUES ('embedding', 16384000, 16384000 / (16384000 + 8 * (786432 + 512))::DOUBLE), ('layers', 8 * (786432 + 512), 8 * (786432 + 512) / (16384000 + 8 * (786432 + 512))::DOUBLE)) t(component, n, share)")
def model_summary(spark, sf_dir):
    layers = [("embedding", [32000, 512]), *[x for _ in range(8) for x in (("layers", [512, 1536]), ("layers", [512]))]]
    m = metrics.parameter_summary(spark.createDataFrame(layers, "component string, shape array<long>"))
    return m.select("component", "n", micro(F.col("share")).alias("share_millionths"))


# --- decoding filters ----------------------------------------------------------------------------------------------
@query(f"SELECT vec_id, token_id, floor(exp(x - m) / sum(exp(x - m)) OVER (PARTITION BY vec_id) * 1e6 + 0.5)::BIGINT AS p_millionths FROM (SELECT vec_id, token_id, logit / 0.7 AS x, max(logit / 0.7) OVER (PARTITION BY vec_id) AS m FROM {LOGITS})")
def softmax_temperature(spark, sf_dir):
    s = sampling.softmax(sampling.tempered(logits(spark, sf_dir), 0.7), "vec_id")
    return s.select("vec_id", "token_id", micro(F.col("p")).alias("p_millionths"))


@query(f"SELECT vec_id, token_id FROM {LOGITS} QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 10")
def top_k(spark, sf_dir):
    return sampling.top_k(logits(spark, sf_dir), "vec_id", 10).select("vec_id", "token_id")


@query(f"""SELECT vec_id, token_id FROM (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id ROWS UNBOUNDED PRECEDING) - p AS b
    FROM (SELECT *, exp(logit - m) / sum(exp(logit - m)) OVER (PARTITION BY vec_id) AS p FROM (SELECT *, max(logit) OVER (PARTITION BY vec_id) AS m FROM {LOGITS} QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 40))) WHERE b <= 0.9""")
def top_p(spark, sf_dir):
    """After top-k, as when decoding."""
    return sampling.top_p(sampling.top_k(logits(spark, sf_dir), "vec_id", 40), "vec_id", "token_id", 0.9).select("vec_id", "token_id")


@query(f"SELECT vec_id, token_id, floor(CASE WHEN token_id % 5 = 0 THEN CASE WHEN logit > 0 THEN logit / 1.2 ELSE logit * 1.2 END ELSE logit END * 1e6)::BIGINT AS logit_millionths FROM {LOGITS}")
def repetition_penalty(spark, sf_dir):
    x = logits(spark, sf_dir)
    history = x.where("token_id % 5 = 0").select("vec_id", "token_id")
    return sampling.penalised(x, history.unionByName(history), "vec_id", "token_id", 1.2).select("vec_id", "token_id", F.floor(F.col("logit") * 1e6).cast("long").alias("logit_millionths"))


@query(f"SELECT vec_id, arg_min(token_id, (-logit, token_id)) AS token_id FROM {LOGITS} GROUP BY vec_id")
def argmax_token(spark, sf_dir):
    return sampling.argmax(logits(spark, sf_dir), "vec_id", "token_id")


@query(f"""WITH k AS (SELECT * FROM {LOGITS} QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 40),
    e AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY vec_id)) AS e FROM k),
    c AS (SELECT *, sum(e / s) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT *, sum(e) OVER (PARTITION BY vec_id) AS s FROM e))
    SELECT vec_id, coalesce(arg_min(token_id, (upto, token_id)) FILTER (WHERE upto >= u), arg_min(token_id, (-logit, token_id))) AS token_id
    FROM (SELECT *, ('0x' || substr(md5('42:' || vec_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM c) GROUP BY vec_id""")
def multinomial_draw(spark, sf_dir):
    return sampling.drawn(sampling.top_k(logits(spark, sf_dir), "vec_id", 40), "vec_id", "token_id", 42)


@query("""SELECT vec_id, list_transform(embedding, lambda v: floor(v / sqrt(list_sum(list_transform(embedding, lambda w: w::DOUBLE * w::DOUBLE)) / len(embedding) + 1e-6::DOUBLE) * 1e6 + 0.5)::BIGINT) AS millionths FROM embeddings""")
def rms_norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return T.with_barrier(e, n=tensors.rms_norm(F.col("e"))).select("vec_id", F.transform("n", micro).alias("millionths"))


@query("""SELECT vec_id, list_transform(range(0, 64), lambda i: floor(CASE WHEN i % 2 = 0
    THEN embedding[i + 1]::DOUBLE * cos(vec_id / pow(10000.0::DOUBLE, i / 64)) - embedding[i + 2]::DOUBLE * sin(vec_id / pow(10000.0::DOUBLE, i / 64))
    ELSE embedding[i]::DOUBLE * sin(vec_id / pow(10000.0::DOUBLE, (i - 1) / 64)) + embedding[i + 1]::DOUBLE * cos(vec_id / pow(10000.0::DOUBLE, (i - 1) / 64)) END * 1e6 + 0.5)::BIGINT) AS millionths FROM embeddings""")
def rotary_embedding(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return T.with_barrier(e, r=tensors.rotary(F.col("e"), 64, F.col("vec_id"))).select("vec_id", F.transform("r", micro).alias("millionths"))


@query("""SELECT vec_id, list_transform(range(1, 33), lambda i: floor(embedding[i]::DOUBLE / (1 + exp(-embedding[i]::DOUBLE)) * embedding[i + 32]::DOUBLE * 1e6 + 0.5)::BIGINT) AS millionths FROM embeddings""")
def gated_unit(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return e.select("vec_id", F.transform(tensors.gated(F.slice("e", 1, 32), F.slice("e", 33, 32)), micro).alias("millionths"))


@query("SELECT i, j FROM range(0, 128) a(i), range(0, 128) b(j) WHERE j <= i AND i - j < 16")
def causal_window(spark, sf_dir):
    return tensors.visible_pairs(spark, 128, 16)


@query(f"""SELECT floor(avg(-0.9 * hit - 0.1 * mean) * 1e4 + 0.5)::BIGINT AS loss_ten_thousandths, count(*) AS "rows" FROM
    (SELECT vec_id, max(CASE WHEN token_id = label THEN lp END) AS hit, avg(lp) AS mean FROM (SELECT vec_id, token_id, logit - ln(sum(exp(logit)) OVER (PARTITION BY vec_id)) AS lp FROM {LOGITS}) JOIN embeddings USING (vec_id) WHERE label <> 0 GROUP BY vec_id)""")
def cross_entropy(spark, sf_dir):
    targets = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    c = tensors.cross_entropy(logits(spark, sf_dir), targets, "vec_id", "token_id", "logit", "label", 0, 0.1)
    return c.select(F.floor(F.col("loss") * 1e4 + 0.5).cast("long").alias("loss_ten_thousandths"), "rows")


@query(f"""SELECT (SELECT count(*) FROM documents) AS n_documents, (SELECT count(*) FROM {PAIRS} WHERE u <> '' AND a <> '') AS n_pairs""")
def evaluation_report(spark, sf_dir):
    """The nested report's counts, read back from its JSON."""
    parts = {"corpus": table(spark, sf_dir, "documents").agg(F.count("*").alias("n")), "pairs": pairs(spark, sf_dir).agg(F.count("*").alias("n")), "bleu": bleu(spark, sf_dir)}
    j = report.as_json(report.nested(parts))
    number = lambda path: F.get_json_object("value", path).cast("long")
    return j.select(number("$.corpus.n").alias("n_documents"), number("$.pairs.n").alias("n_pairs"))


# --- training log --------------------------------------------------------------------------------------------------
@query("""SELECT s AS step, floor((CASE WHEN s < 200 THEN 3e-4::DOUBLE * (s + 1) / 200 ELSE 3e-5::DOUBLE + 0.5 * (1 + cos(pi() * ((s - 200)::DOUBLE / 9800))) * (3e-4::DOUBLE - 3e-5::DOUBLE) END) * 1e9)::BIGINT AS lr_billionths FROM range(0, 10000, 7) t(s)""")
def lr_schedule(spark, sf_dir):
    lr = schedule.learning_rate(F.col("id"), 3e-4, 3e-5, 200, 10_000)
    return spark.range(0, 10_000, 7).select(F.col("id").alias("step"), F.floor(lr * 1e9).cast("long").alias("lr_billionths"))


@query("SELECT event_id AS step, value AS val_loss FROM events ORDER BY value, event_id LIMIT 3")
def best_checkpoints(spark, sf_dir):
    return schedule.best_checkpoints(events(spark, sf_dir).select(F.col("event_id").alias("step"), F.col("value").alias("val_loss")))


@query("""WITH l AS (SELECT 'ckpt-' || (event_id // 2) AS path, max(event_id) AS step, arg_max(value, event_id) AS val_loss FROM events GROUP BY 1)
    SELECT path, step, val_loss, row_number() OVER (ORDER BY val_loss, step, path) <= 3 AS kept FROM l""")
def checkpoint_retention(spark, sf_dir):
    """Two saves to each path, of which the second counts."""
    path = F.concat(F.lit("ckpt-"), F.floor(F.col("event_id") / 2).cast("string"))
    return schedule.retained(events(spark, sf_dir).select(F.col("event_id").alias("step"), F.col("value").alias("val_loss"), path.alias("path"))).select("path", "step", "val_loss", "kept")


@query("""SELECT step, floor(loss * 1e6 + 0.5)::BIGINT AS loss_millionths, floor(exp(least(loss, 20)) * 1e4 + 0.5)::BIGINT AS perplexity_ten_thousandths, grad_norm, floor(seen / (step / 4.0::DOUBLE) * 1e2 + 0.5)::BIGINT AS tokens_per_sec_hundredths,
        floor((CASE WHEN step <= 200 THEN 3e-4::DOUBLE * step / 200 ELSE 3e-5::DOUBLE + 0.5 * (1 + cos(pi() * ((step - 201)::DOUBLE / 9800))) * (3e-4::DOUBLE - 3e-5::DOUBLE) END) * 1e9 + 0.5)::BIGINT AS lr_billionths
    FROM (SELECT max(event_id) + 1 AS step, avg(value / 100) AS loss, arg_max(value, event_id) AS grad_norm, max(seen) AS seen FROM (SELECT *, sum(8 * 512 + user_id) OVER (ORDER BY event_id)::BIGINT AS seen FROM events) GROUP BY event_id // 50 HAVING count(*) = 50)""")
def metric_log(spark, sf_dir):
    """A log line every 50 steps, a quarter of a second each."""
    e = events(spark, sf_dir).select((F.col("event_id") + 1).alias("step"), (F.col("value") / 100).alias("loss"), F.col("value").alias("norm"), (F.lit(8 * 512) + F.col("user_id")).alias("tokens"), ((F.col("event_id") + 1) / 4.0).alias("seconds"))
    m = schedule.metric_log(e, 50, "step", "loss", "norm", "tokens", "seconds", lambda s: schedule.learning_rate(s, 3e-4, 3e-5, 200, 10_000))
    whole = lambda c, n: F.floor(F.col(c) * n + 0.5).cast("long")
    return m.select("step", whole("loss", 1e6).alias("loss_millionths"), whole("perplexity", 1e4).alias("perplexity_ten_thousandths"), "grad_norm", whole("tokens_per_sec", 1e2).alias("tokens_per_sec_hundredths"), whole("lr", 1e9).alias("lr_billionths"))


@query('SELECT event_id // 10 AS "window", floor(sum(value) / 10 * 1e4 + 0.5)::BIGINT AS mean_ten_thousandths FROM events GROUP BY event_id // 10 HAVING count(*) = 10')
def log_windows(spark, sf_dir):
    w = schedule.window_means(events(spark, sf_dir).withColumn("step", F.col("event_id") + 1), "step", "value", 10)
    return w.select("window", F.floor(F.col("mean") * 1e4 + 0.5).cast("long").alias("mean_ten_thousandths"))


@query("SELECT event_id, min(value) OVER (ORDER BY event_id) AS best FROM events")
def running_best(spark, sf_dir):
    return schedule.running_best(events(spark, sf_dir), "event_id", "value").select("event_id", "best")


@query("SELECT event_id, sum(8 * 512 + user_id) OVER (ORDER BY event_id)::BIGINT AS tokens_seen FROM events")
def tokens_seen(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("tokens", F.lit(8 * 512) + F.col("user_id"))
    return schedule.tokens_seen(e, "event_id", "tokens").select("event_id", "tokens_seen")


@query("SELECT event_id // 4 AS step, floor(sum(value / 4) * 1e4 + 0.5)::BIGINT AS loss_ten_thousandths FROM events GROUP BY event_id // 4")
def gradient_accumulation(spark, sf_dir):
    return schedule.accumulated(events(spark, sf_dir), 4, "event_id", "value").select("step", F.floor(F.col("loss") * 1e4 + 0.5).cast("long").alias("loss_ten_thousandths"))


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT user_id, event_id, k, 0.0::DOUBLE AS before, 0.02 * value AS ema, value FROM o WHERE k = 1
          UNION ALL SELECT o.user_id, o.event_id, o.k, r.ema, 0.98 * r.ema + 0.02 * o.value, o.value FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
    SELECT user_id, event_id, floor(ema * 1e4 + 0.5)::BIGINT AS ema_ten_thousandths, event_id > 200 AND before > 0 AND value > 2 * before AS spike,
        CASE WHEN event_id > 200 AND before > 0 AND value > 2 * before THEN floor(before / value * 1e6 + 0.5)::BIGINT ELSE 1000000 END AS lr_scale_millionths FROM r""")
def gradient_norm_ema(spark, sf_dir):
    s = schedule.smoothed_norms(events(spark, sf_dir), "user_id", "event_id", "value", 200)
    return s.select("user_id", "event_id", F.floor(F.col("ema") * 1e4 + 0.5).cast("long").alias("ema_ten_thousandths"), "spike", micro(F.col("lr_scale")).alias("lr_scale_millionths"))


# --- streaming -----------------------------------------------------------------------------------------------------
@query(f"SELECT DISTINCT sha256(clean) AS digest, n::INT AS n_length FROM {JUDGED} WHERE reject_reason IS NULL")
def streaming_clean(spark, sf_dir):
    """Documents as a file stream through cleaning and deduplication; the batch query gives the same texts."""
    import uuid

    from ..plans.checkpoints import ensure_checkpoint_dir
    from ..streaming.cleaning import clean_stream

    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*")
    stream = stream.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.translate("text", LETTERS, DEVANAGARI)).otherwise(F.col("text")))
    q = clean_stream(stream.select("text"), "text").select("digest", "n_length").writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("digest string, n_length int").parquet(f"{folder}/out")
