"""Corpus, chat and prompt-set queries."""

from pyspark.sql import functions as F

from evalweave import constants as C
from evalweave.functions import messages as MS
from evalweave.functions import metrics as M
from evalweave.functions import text as TX
from evalweave.operators import aggregates as A
from evalweave.operators import filters as FL
from evalweave.operators import joins as J
from evalweave.operators import ordering as O
from evalweave.plans import next_fit as NF
from evalweave.plans import prompt_sets as P
from evalweave.plans import warmup as WU
from evalweave.queries import fixtures as X
from evalweave.queries.registry import query
from evalweave.session import scratch_path
from evalweave.sinks import writers as WR
from evalweave.sources import files as S

TOKS = X.TOKENS_SQL.format


def tiled_sql(toks: str, length: int) -> str:
    """Tokens repeated or cut to exactly ``length``."""
    return (f"array_to_string(list_transform(range(0, {length}), "
            f"lambda i: {toks}[CAST(i % len({toks}) + 1 AS BIGINT)]), ' ')")


# ---- scalar functions over whole texts ----

@query("token_count", f"SELECT doc_id, len({TOKS('text')}) AS n_tokens FROM documents")
def token_count(t):
    return t.documents.select("doc_id", TX.token_count("text").alias("n_tokens"))


@query("truncate_tokens", f"SELECT doc_id, array_to_string(({TOKS('text')})[1:100], ' ') AS text FROM documents")
def truncate_tokens(t):
    return t.documents.select("doc_id", TX.truncate_tokens("text", 100).alias("text"))


@query("tile_tokens", f"SELECT doc_id, {tiled_sql('toks', 300)} AS text FROM ({X.CORPUS_SQL})")
def tile_tokens(t):
    return X.corpus(t).select("doc_id", TX.tile_tokens("text", 300).alias("text"))


@query("fit_length", f"""
SELECT d.doc_id, CASE WHEN c.doc_id IS NOT NULL THEN {tiled_sql('c.toks', 64)} END AS text, c.doc_id IS NOT NULL AS exact
FROM documents d LEFT JOIN ({X.CORPUS_SQL}) c ON d.doc_id = c.doc_id""")
def fit_length(t):
    text, exact = P.fit_length("text", 64)
    return t.documents.select("doc_id", text.alias("text"), exact.alias("exact"))


@query("approx_tokens", "SELECT doc_id, greatest(length(text) // 4, 1) AS n FROM documents")
def approx_tokens(t):
    return t.documents.select("doc_id", TX.approx_tokens("text").alias("n"))


@query("parse_number", r"""
SELECT doc_id, CASE WHEN abs(x) < 1e9 THEN round(x, 6) ELSE x END AS x FROM (
  SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '-?\d+\.?\d*'), '') AS DOUBLE) AS x FROM documents)""")
def parse_number(t):
    return t.documents.select("doc_id", TX.parse_number("text").alias("x"))


@query("clean_text", r"""
SELECT doc_id, md5(regexp_replace(text || chr(27) || '[0m' || chr(9), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS text_md5
FROM documents""")
def clean_text(t):
    marked = F.concat("text", F.lit("\x1b[0m\t"))
    return t.documents.select("doc_id", F.md5(TX.clean_text(marked)).alias("text_md5"))


@query("safe_name", r"""
SELECT page_id, left(regexp_replace(url, '[\[\]:*?/\\]', '_', 'g'), 31) AS name FROM pages""")
def safe_name(t):
    return t.pages.select("page_id", TX.safe_name("url").alias("name"))


@query("remove_until", """
SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text ELSE source END) AS answer_md5 FROM documents""")
def remove_until(t):
    reply = F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(
        F.concat("text", F.lit(C.THINK_END), "text", F.lit(C.THINK_END), "source"))
    return t.documents.select("doc_id", F.md5(TX.remove_until(reply)).alias("answer_md5"))


@query("extract_code", """
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'print(' || n_chars || ')' || chr(10) END AS code FROM documents""")
def extract_code(t):
    block = F.concat(F.lit("\n```python\nprint("), F.col("n_chars"), F.lit(")\n```\n"))
    first = F.lit("\n```\nx = 1\n```\n")
    plain = F.regexp_replace("text", "`", "'")
    reply = F.when(F.col("doc_id") % 4 == 0, plain).otherwise(F.concat(plain, first, plain, block, plain))
    return t.documents.select("doc_id", TX.extract_code(reply).alias("code"))


@query("flatten_messages", r"""
SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN source || chr(10) || chr(10) || text
       ELSE source || chr(10) || text END) AS text_md5 FROM documents""")
def flatten_messages(t):
    def message(content):
        return F.struct(F.lit("user").alias("role"), content.alias("content"))

    text = F.col("text")
    two = F.to_json(F.array(message(F.col("source")), message(text)))
    parts = F.to_json(F.array(message(F.array(
        F.struct(F.col("source").alias("text")), F.struct(text.alias("text"))))))
    raw = F.when(F.col("doc_id") % 3 == 0, text).when(F.col("doc_id") % 3 == 1, two).otherwise(parts)
    return t.documents.select("doc_id", F.md5(MS.flatten_messages(raw)).alias("text_md5"))


@query("score_value", """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN round(n_chars / 8.0, 6) WHEN 1 THEN n_chars::DOUBLE ELSE 0.0 END AS score
FROM documents""")
def score_value(t):
    n = F.col("n_chars")
    raw = F.when(F.col("doc_id") % 3 == 0, (n / 8).cast("string")).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit('{"z_acc": '), n, F.lit(', "acc": 1}')))
    return t.documents.select("doc_id", MS.score_value(raw).alias("score"))


@query("join_name_path", "SELECT doc_id, lang || '/' || source AS name FROM documents")
def join_name_path(t):
    return t.documents.select("doc_id", TX.join_name_path(F.array("lang", "source")).alias("name"))


# ---- filters and chats ----

@query("filter_nonblank", "SELECT doc_id FROM documents WHERE regexp_matches(text, '\\S')")
def filter_nonblank(t):
    return FL.filter_nonblank(t.documents, "text").select("doc_id")


@query("drop_empty_docs", f"""
SELECT doc_id FROM (SELECT doc_id, CASE WHEN lang = 'de' THEN ' ' ELSE text END AS text FROM documents)
WHERE len({TOKS('text')}) > 0""")
def drop_empty_docs(t):
    text = F.when(F.col("lang") == "de", " ").otherwise(F.col("text"))
    return FL.drop_empty_docs(t.documents.select("doc_id", text.alias("text")), "text").select("doc_id")


@query("filter_role", "SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def filter_role(t):
    return FL.filter_role(t.conversations, "human", X.HUMAN).select("conv_id", "turn")


def _chat_file(t, path: str) -> str:
    """The chats as JSON lines, turns in order."""
    turn = F.struct("turn", F.when(F.col("role") == X.HUMAN, C.HUMAN).otherwise(F.col("role")).alias("from"), F.col("text").alias("value"))
    nested = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    nested.select(F.col("conv_id").cast("string").alias("id"), F.transform(
        "turns", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations")).write.json(path)
    return path


@query("read_chats", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, i AS turn, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
WHERE role = 'user' AND regexp_matches(text, '\\S')""")
def read_chats(t):
    path = _chat_file(t, scratch_path(t.spark, "chats"))
    return S.read_chats(t.spark, path, multi_line=False).select("conv_id", "turn", "text")


VALID_SQL = """
SELECT conv_id FROM conversations GROUP BY conv_id
HAVING count(*) >= 2 AND count(*) % 2 = 0 AND arg_min(role, turn) = 'user'"""


@query("valid_multiturn", VALID_SQL)
def valid_multiturn(t):
    return FL.valid_multiturn(t.conversations, X.HUMAN)


@query("multiturn_subset", f"""
SELECT conv_id, turn, role, text FROM conversations
WHERE conv_id IN (SELECT conv_id FROM ({VALID_SQL}) ORDER BY conv_id LIMIT 30)""")
def multiturn_subset(t):
    return P.multiturn_subset(t.conversations, X.HUMAN, 30)


@query("first_user_turn", """
SELECT conv_id, turn, text FROM (
  SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)
WHERE text <> ''""")
def first_user_turn(t):
    return O.first_user_turn(t.conversations, X.HUMAN)


@query("prompts_of", """
SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY conv_id
HAVING prompt <> ''""")
def prompts_of(t):
    return S.prompts_of(t.conversations, X.HUMAN)


@query("read_prompts", """
SELECT prompt FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN text ELSE 'p' || text END AS prompt FROM benchmark
WHERE item_id % 5 <> 4) ORDER BY item_id LIMIT 20""")
def read_prompts(t):
    """The first twenty of a folder of files in which a question, a prompt or neither is set."""
    path, kind = scratch_path(t.spark, "prompts"), F.col("item_id") % 3
    rows = t.benchmark.repartitionByRange(4, "item_id").sortWithinPartitions("item_id").select(
        F.when(F.col("item_id") % 5 == 4, "").when(kind == 0, F.col("text")).otherwise("").alias("question"),
        F.when(F.col("item_id") % 5 == 4, "").when(kind != 0, F.concat(F.lit("p"), "text")).alias("prompt"))
    rows.write.json(path)
    return S.read_prompts(t.spark, path, 20).select("prompt")


def _requests_sql(mode: str) -> str:
    turns = "row_number()" if mode == "every_with_gt" else "count(*) FILTER (role = 'user')"
    chars = "length(text)" if mode == "every_with_gt" else "CASE WHEN role = 'user' THEN length(text) ELSE 0 END"
    return f"""
WITH t AS (SELECT *, {turns} OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS history_turns,
       CAST(coalesce(sum({chars}) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history_chars,
       lead(text) OVER w AS gold, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) AS last_turn
     FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS prompt, history_turns, history_chars{', gold' if mode == 'every_with_gt' else ''}
FROM t WHERE role = 'user'{' AND turn = last_turn' if mode == 'last' else ''}"""


@query("turn_requests_every", _requests_sql("every"))
def turn_requests_every(t):
    return O.turn_requests(t.conversations, X.HUMAN, "every")


@query("turn_requests_last", _requests_sql("last"))
def turn_requests_last(t):
    return O.turn_requests(t.conversations, X.HUMAN, "last")


@query("turn_requests_every_with_gt", _requests_sql("every_with_gt"))
def turn_requests_every_with_gt(t):
    return O.turn_requests(t.conversations, X.HUMAN, "every_with_gt")


def _history_sql(mode: str) -> str:
    carried = "true" if mode == "every_with_gt" else "role = 'user'"
    return f"""
SELECT conv_id, turn, role, coalesce(string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) FILTER ({carried}) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history FROM conversations"""


@query("history_text_every", f"SELECT conv_id, turn, md5(history) AS history_md5 FROM ({_history_sql('every')}) WHERE role = 'user'")
def history_text_every(t):
    return _history(t, "every")


@query("history_text_every_with_gt", f"""
SELECT conv_id, turn, md5(history) AS history_md5 FROM ({_history_sql('every_with_gt')}) WHERE role = 'user'""")
def history_text_every_with_gt(t):
    return _history(t, "every_with_gt")


def _history(t, mode):
    requests = O.turn_requests(t.conversations, X.HUMAN, mode)
    segments = O.history_segments(t.conversations, X.HUMAN, mode, 500)
    return O.history_text(requests, segments, 500).select("conv_id", "turn", F.md5("history").alias("history_md5"))


@query("history_segments", """
SELECT conv_id, s.range AS segment, substring(h, s.range * 500 + 1, 500) AS text FROM (
  SELECT conv_id, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS h FROM conversations GROUP BY conv_id),
  range(1000) s WHERE s.range * 500 < length(h)""")
def history_segments(t):
    return O.history_segments(t.conversations, X.HUMAN, "every_with_gt", 500)


# ---- numbering, cycling, warm-up ----

@query("number_rows", """
SELECT o_orderkey, 34602 + row_number() OVER (ORDER BY o_orderkey) - 1 AS question_id FROM orders""")
def number_rows(t):
    placed = O.running_total(t.orders.select("o_orderkey"), "o_orderkey")
    return placed.select("o_orderkey", (F.col("start") + C.FIRST_QUESTION_ID).alias("question_id"))


def counted(n: str) -> str:
    """0 to n - 1 as column ``range``."""
    return f"(SELECT unnest(range(CAST({n} AS BIGINT))) AS range)"


def cycle_sql(rows: str, key: str, n: str, extra: str = "") -> str:
    return f"""
SELECT s.range AS sample, c.{key}{extra} FROM {counted(n)} s
JOIN (SELECT *, row_number() OVER (ORDER BY {key}) - 1 AS i, count(*) OVER () AS size FROM ({rows})) c ON s.range % c.size = c.i"""


@query("cycle_assign", cycle_sql("SELECT item_id FROM benchmark", "item_id", X.ITEMS_SQL))
def cycle_assign(t):
    return J.cycle_assign(t.benchmark, "item_id", X.items_n(t))


@query("repeat_samples", """
SELECT item_id, text, r.range AS repeat FROM benchmark, range(3) r""")
def repeat_samples(t):
    return P.repeat_samples(t.benchmark, 3)


@query("warmup_plan", f"""
SELECT sample, sample // 16 + 1 AS wave, sample % 16 AS slot, item_id,
       text || chr(10) || chr(10) || '[warmup ' || (sample // 16 + 1) || ' ' || (sample % 16) || ']' AS prompt
FROM ({cycle_sql("SELECT * FROM benchmark WHERE text <> ''", "item_id", X.ITEMS_SQL, ", c.text")})""")
def warmup_plan(t):
    return WU.warmup_plan(t.benchmark, "item_id", "text", X.items_n(t), 16)


@query("warmup_prompt", """
SELECT item_id, text || chr(10) || chr(10) || '[warmup ' || (item_id // 8 + 1) || ' ' || (item_id % 8) || ']' AS prompt
FROM benchmark""")
def warmup_prompt(t):
    wave, slot = M.wave_of("item_id", F.lit(8)), M.slot_of("item_id", F.lit(8))
    return t.benchmark.select("item_id", M.warmup_prompt("text", wave, slot).alias("prompt"))


# ---- question files ----

def _samples(t):
    return P.build_tiled(t.benchmark, "item_id", "text", 32, X.items_n(t))


SAMPLES_SQL = f"""
SELECT sample, {tiled_sql('toks', 32)} AS question
FROM ({cycle_sql(f"SELECT item_id, {TOKS('text')} AS toks FROM benchmark WHERE len({TOKS('text')}) > 0", "item_id", X.ITEMS_SQL, ", c.toks")})"""


@query("write_prompt_set", f"SELECT question, 'none' AS answer FROM ({SAMPLES_SQL})")
def write_prompt_set(t):
    path = scratch_path(t.spark, "prompts")
    WR.write_prompt_set(_samples(t), "question", path)
    return t.spark.read.schema("question string, answer string").json(path)


@query("vqa_rows", f"""
SELECT '/img' AS image, question, sample + 34602 AS question_id, 'None' AS answer FROM ({SAMPLES_SQL})""")
def vqa_rows(t):
    return WR.vqa_rows(_samples(t), "/img")


@query("annotation_rows", f"""
SELECT sample + 34602 AS question_id, 0::BIGINT AS image_id, 'other' AS answer_type, 'other' AS question_type,
  '[{{"answer_id":1023,"answer":"None","answer_confidence":"yes"}}]' AS answers FROM ({SAMPLES_SQL})""")
def annotation_rows(t):
    return WR.annotation_rows(_samples(t)).withColumn("answers", F.to_json("answers"))


@query("choice_rows", f"""
SELECT sample AS idx, '/vid' AS vid_path, '1' AS video_id, question,
  '{{"A":"win","B":"or","C":"lose","D":"sss"}}' AS choices, 'A' AS answer FROM ({SAMPLES_SQL})""")
def choice_rows(t):
    questions, answers = WR.choice_rows(_samples(t), "/vid")
    return questions.join(answers, "idx").withColumn("choices", F.to_json("choices"))


# ---- prompt sets of an exact length ----

@query("build_tiled", f"""
SELECT sample, doc_id, {tiled_sql('toks', 128)} AS question FROM ({cycle_sql(X.CORPUS_SQL, "doc_id", X.DOCS_SQL, ", c.toks")})""")
def build_tiled(t):
    return P.build_tiled(t.documents, "doc_id", "text", 128, X.docs_n(t))


@query("build_single", f"""
SELECT sample, item_id, {tiled_sql('toks', 200)} AS question, true AS exact
FROM ({cycle_sql(f"SELECT item_id, {TOKS('text')} AS toks FROM benchmark WHERE len({TOKS('text')}) > 0", "item_id", X.ITEMS_SQL, ", c.toks")})""")
def build_single(t):
    return P.build_single(t.benchmark, "item_id", "text", 200, X.items_n(t))


def packed_sql(length: int, offsets: str) -> str:
    """Brute force: sample k starts at the first text in [kL, (k+1)L) and takes
    what starts within L tokens of it; the corpus repeats behind its end."""
    return f"""
o AS ({offsets}),
s AS (SELECT start // {length} AS k, min(start) AS s0 FROM o GROUP BY 1),
r AS (SELECT doc_id, n, toks, start + c.range * total AS pos, total FROM o, range(100) c WHERE start + c.range * total < total + {length}),
m AS (SELECT k, doc_id, pos, s0, least(n, s0 + {length} - pos) AS take, toks FROM s JOIN r ON pos >= s0 AND pos < s0 + {length})"""


def offsets_sql(corpus: str) -> str:
    return f"""SELECT doc_id, toks, n, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
  CAST(sum(n) OVER () AS BIGINT) AS total FROM ({corpus})"""


OFFSETS_SQL = offsets_sql(X.CORPUS_SQL)


@query("corpus_offsets", f"SELECT doc_id, n AS n_tokens, start, total FROM ({OFFSETS_SQL})")
def corpus_offsets(t):
    return P.corpus_offsets(t.documents, "doc_id", "text")


@query("pack_by_budget", f"WITH {packed_sql(256, OFFSETS_SQL)} SELECT k AS bucket, doc_id, pos AS at, take FROM m")
def pack_by_budget(t):
    return P.pack_by_budget(P.corpus_offsets(t.documents, "doc_id", "text"), "doc_id", 256)


BUILT = """
b AS (SELECT k, string_agg(array_to_string(toks[1:take], ' '), chr(10) || chr(10) ORDER BY pos) AS question,
        CAST(sum(take) AS BIGINT) AS n_tokens, count(*) AS draws FROM m GROUP BY k),
n AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS sample FROM b)"""


@query("build_concat", f"""
WITH {packed_sql(256, OFFSETS_SQL)}, {BUILT}
SELECT sample, question, n_tokens, draws FROM n""")
def build_concat(t):
    return P.build_concat(t.documents, "doc_id", "text", 256)


@query("build_concat_cycled", f"""
WITH {packed_sql(2048, OFFSETS_SQL)}, {BUILT}
SELECT i.range AS sample, question, n_tokens, draws FROM {counted("(SELECT count(*) // 4 FROM documents)")} i JOIN n ON i.range % (SELECT count(*) FROM n) = n.sample""")
def build_concat_cycled(t):
    return P.build_concat(t.documents, "doc_id", "text", 2048, t.documents.count() // 4)


@query("build_concat_first", f"""
WITH {packed_sql(256, OFFSETS_SQL)}, {BUILT}
SELECT sample, question, n_tokens, draws FROM n WHERE sample < (SELECT count(*) // 50 FROM documents)""")
def build_concat_first(t):
    """A sample for every fifty documents, read from the beginning of the corpus."""
    return P.build_concat(t.documents, "doc_id", "text", 256, t.documents.count() // 50)


@query("length_audit", f"""
WITH {packed_sql(256, OFFSETS_SQL)}, {BUILT}
SELECT count(*) AS samples, count(*) FILTER (n_tokens = 256) AS exact, CAST(sum(draws) AS BIGINT) AS draws,
       sum(draws) > (SELECT count(*) FROM o) AS reused FROM n""")
def length_audit(t):
    built = P.build_concat(t.documents, "doc_id", "text", 256)
    measured = built.select("draws", TX.token_count("question").alias("n_tokens"))
    return A.length_audit(measured, 256, X.corpus(t))


def walk_sql(texts: str, budget: int, laps: int = 1, samples: str = "") -> str:
    """Brute force: a sample begins at the first text behind the budget of the one before."""
    return f"""
o AS MATERIALIZED (SELECT doc_id, toks, w, CAST(sum(w) OVER (ORDER BY doc_id) - w AS BIGINT) AS start,
    CAST(sum(w) OVER () AS BIGINT) AS total FROM ({texts})),
r AS MATERIALIZED (SELECT doc_id, toks, w, start + c.range * total AS pos FROM o, range({laps}) c),
walk AS (SELECT 0::BIGINT AS sample, 0::BIGINT AS node, (SELECT min(pos) FROM r WHERE pos >= {budget}) AS next
    UNION ALL SELECT any_value(s.sample) + 1, any_value(s.next), min(r.pos) FILTER (r.pos >= s.next + {budget})
    FROM walk s JOIN r ON r.pos >= s.next {samples} GROUP BY s.sample),
m AS (SELECT sample, doc_id, pos - node AS "offset", w AS n_tokens, toks FROM walk JOIN r
    ON r.pos >= node AND (next IS NULL OR r.pos < next))"""


APPROX_SQL = "SELECT doc_id, toks, greatest(length(text) // 4, 1) AS w FROM ({0})".format(X.CORPUS_SQL)
WORDS_SQL = f"SELECT doc_id, toks, n AS w FROM ({X.CORPUS_SQL})"


@query("pack_next_fit", f"""
WITH RECURSIVE {walk_sql(APPROX_SQL, 512)} SELECT sample, doc_id, "offset", n_tokens FROM m""")
def pack_next_fit(t):
    offsets = P.corpus_offsets(t.documents, "doc_id", "text", TX.approx_tokens("text"))
    return NF.pack_next_fit(offsets, "doc_id", 512)


@query("pack_next_fit_cycled", f"""
WITH RECURSIVE {walk_sql(APPROX_SQL, 1024, 40, "AND s.sample + 1 < (SELECT count(*) FROM documents)")}
SELECT sample, doc_id, "offset", n_tokens FROM m""")
def pack_next_fit_cycled(t):
    """As many samples as documents, so that the corpus is used several times."""
    offsets = P.corpus_offsets(t.documents, "doc_id", "text", TX.approx_tokens("text"))
    return NF.pack_next_fit(offsets, "doc_id", 1024, t.documents.count())


@query("build_next_fit", f"""
WITH RECURSIVE {walk_sql(WORDS_SQL, 256)}
SELECT sample, string_agg(array_to_string(toks[1:256 - "offset"], ' '), chr(10) || chr(10) ORDER BY "offset") AS question,
    CAST(sum(least(n_tokens, 256 - "offset")) AS BIGINT) AS n_tokens, count(*) AS draws FROM m GROUP BY sample""")
def build_next_fit(t):
    return NF.build_next_fit(t.documents, "doc_id", "text", 256)


SHARED, REST = 217, 39
TURNED_SQL = f"""
SELECT doc_id, toks, n, total, ((start - coalesce((SELECT min(start) FROM base WHERE start >= {SHARED}), 0)) % total + total) % total AS start FROM base"""
PREFIX_SQL = f"""
base AS ({OFFSETS_SQL}),
px AS (SELECT string_agg(array_to_string(toks[1:least(n, {SHARED} - start)], ' '), chr(10) || chr(10) ORDER BY start) AS prefix
       FROM base WHERE start < {SHARED})"""


@query("build_prefix", f"""
WITH {PREFIX_SQL}, {packed_sql(REST, TURNED_SQL)}, {BUILT}
SELECT sample, prefix || chr(10) || chr(10) || question AS question, n_tokens + {SHARED} AS n_tokens, draws FROM n, px""")
def build_prefix(t):
    return P.build_prefix(t.documents, "doc_id", "text", 256, 85)


@query("build_prefix_first", f"""
WITH {PREFIX_SQL}, {packed_sql(REST, TURNED_SQL)}, {BUILT}
SELECT sample, prefix || chr(10) || chr(10) || question AS question, n_tokens + {SHARED} AS n_tokens, draws FROM n, px
WHERE sample < (SELECT count(*) // 50 FROM documents)""")
def build_prefix_first(t):
    return P.build_prefix(t.documents, "doc_id", "text", 256, 85, t.documents.count() // 50)


@query("prefix_audit", f"""
WITH {PREFIX_SQL}, {packed_sql(REST, TURNED_SQL)}, {BUILT},
w AS (SELECT {TOKS("prefix || ' ' || question")} AS toks FROM n, px),
p AS (SELECT i.range AS i, count(DISTINCT toks[i.range + 1]) AS d FROM w, range(256) i GROUP BY 1)
SELECT (SELECT count(*) FROM w) AS samples, (SELECT min(i) FROM p WHERE d > 1) AS shared""")
def prefix_audit(t):
    return P.prefix_audit(P.build_prefix(t.documents, "doc_id", "text", 256, 85), "question")
