"""The subpackage's queries, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    ann, chat_format, conversation_repair, decontaminate, jaccard_join, language_mix, near_dups, packing, page_template, token_codes, toxicity,
    url_rules, whitening,
)
from colloquy.runtime import materialize, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def packed_pieces(docs: DataFrame) -> DataFrame:
    """Pieces of documents with a digest of their ids and their places in sequences."""
    pieces = packing.cut_documents(docs).select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), F.monotonically_increasing_id().alias("key"),
    )
    pieces = materialize(pieces)  # fixes the keys
    return pieces.join(packing.pack(pieces, "key"), "key").drop("key")


@query
def op2_pack(spark, sf):
    return packed_pieces(table(spark, sf, "documents"))


@query
def op4_chat(spark, sf):
    said = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    ok = f"{chat_format.END}{chat_format.START}assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", ok), (-1, 1, "assistant", ok)], said.schema)
    out = chat_format.format_conversations(said.unionByName(extra).withColumn("parts", chat_format.text_parts(F.col("text"))))
    turns = chat_format.read_turns(F.col("formatted"))
    read = out.select("conv_id", "formatted", turns.alias("turns"), F.array_join(chat_format.read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL["op4_chat"] = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), t AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
         sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
             + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) AS formatted_chars
  FROM m GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM t"""


@query
def op5_token_file(spark, sf):
    path = f"{shared_dir(spark).rstrip('/')}/colloquy/{uuid.uuid4().hex}"
    token_codes.write_codes(table(spark, sf, "documents"), path)
    stored = token_codes.stored_documents(token_codes.read_codes(spark, path))
    return stored.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op8_url_rules(spark, sf):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL["op8_url_rules"] = r"""
WITH rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                        ('org', '/fr/', 'allow')) r(rule_host, rule_path, rule_verdict)
), p AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), m AS (
  SELECT n, arg_max({'rule': rule_host || rule_path, 'verdict': rule_verdict}, length(rule_host || rule_path)) AS best
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY n
)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (n)"""


@query
def op10_near_dups(spark, sf):
    return near_dups.near_duplicates(table(spark, sf, "documents"))


@query
def op6_decontaminate(spark, sf):
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op9_language(spark, sf):
    docs = table(spark, sf, "documents")
    model = language_mix.train(docs.where(crc_mod(3) != 1).select("text", "lang"))
    return language_mix.identify(docs.select("doc_id", "text"), model).select("doc_id", (crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")


def toxicity_grammar(docs, labels):
    """Fitted on labelled rows of ``docs`` that are not held out."""
    known = labels.select("doc_id", "toxic").where(crc_mod(4) != 2).where("toxic is not null")
    # the fit takes so many rows at most, of the same hash order
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(toxicity.FIT_ROWS)
    return toxicity.fit(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))


@query
def op3_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    grammar = toxicity_grammar(docs, table(spark, sf, "labels"))
    scored = toxicity.score_toxicity(docs.select("doc_id", "text"), grammar)
    return scored.select("doc_id", (crc_mod(4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_neighbours(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


@query
def op7_main_text(spark, sf):
    found = page_template.extract_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op11_jaccard_join(spark, sf):
    return jaccard_join.join_links(table(spark, sf, "documents"))


def components_sql(words: int, percent: int, kept: bool) -> str:
    """Classes of linked documents by comparing all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + {words - 1}], ' ') AS g
  FROM w, unnest(range(1, greatest(len(w) - {words - 2}, 2))) t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS c FROM documents
  UNION SELECT l.b, reach.c FROM reach JOIN l ON l.a = reach.doc_id
), c AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id{", d.doc_id = c.component_id AS kept" if kept else ""}
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""


SQL["op10_near_dups"] = components_sql(near_dups.WORDS, near_dups.PERCENT, True)
SQL["op11_jaccard_join"] = components_sql(jaccard_join.WORDS, jaccard_join.PERCENT, False)


@query
def op12_whitening(spark, sf):
    vectors = table(spark, sf, "embeddings")
    model = whitening.fit(vectors)
    shape = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return spark.createDataFrame([], shape)
    rows = whitening.apply(vectors, model)
    error = whitening.identity_error(rows, model.n, len(model.values))
    share = F.array(*[F.lit(float(v) / model.trace) for v in model.values])  # one for each component
    return rows.select("id", "deviation", F.posexplode("whitened").alias("p", "whitened")).select(
        F.col("id").cast("long").alias("vec_id"), (F.col("p") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        "whitened", F.get(share, F.col("p")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def damaged(said: DataFrame) -> DataFrame:
    """Conversations with faults by a hash of conversation and turn; nulls count as one space."""
    def plain(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(plain("text"), ".!?", "")).otherwise(plain("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return said.select("conv_id", "turn", "role", "text", fault.alias("fault")).where("fault <> 0").select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"), copies.alias("copy"),
    )


@query
def op13_conversation_repair(spark, sf):
    said = table(spark, sf, "conversations")
    return conversation_repair.repair_conversations(damaged(said), said)


# rows by place; each step takes the best (cost, audit) of every state, with 0 to 2 inserted rows in front of a row
SQL["op13_conversation_repair"] = r"""
WITH RECURSIVE h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT) % 20 AS f
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, (VALUES (0), (1)) c(n) WHERE f <> 0 AND (n = 0 OR f = 3)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i, substr(role, 1, 1) AS r,
    NOT regexp_matches(text, '[^ 	-
]') AS blank, regexp_matches(text, '[^ 	-
.!?][ 	-
]*$') AS cut
  FROM d
), e AS (
  SELECT *, CASE WHEN blank THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN cut THEN 't' ELSE '' END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair
  FROM o
), t AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
    count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last
  FROM e GROUP BY conv_id
), ins AS (
  SELECT * FROM (VALUES (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']),
    (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:'])) v(q, to_q, k, lines)
), moves AS (
  SELECT * FROM (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')) v(q, to_q, r)
), edits AS (
  SELECT e.conv_id, e.i, m.q, m.to_q, 'K' AS letter, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS price, [role || ':' || text] AS lines
  FROM e JOIN moves m ON m.r = e.r WHERE fault NOT IN ('b', 'd')
  UNION ALL
  SELECT e.conv_id, e.i, m.q, m.to_q, 'R', CASE WHEN fault = 't' THEN 6 ELSE 3 END, [CASE m.r WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
  FROM e JOIN moves m ON m.r <> 's' WHERE fault NOT IN ('b', 'd')
  UNION ALL
  SELECT e.conv_id, e.i, q, q, 'D', 4, [] FROM e, (VALUES (0), (1), (2), (3)) s(q)
), best AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {'cost': 0, 'audit': ''} AS b, []::VARCHAR[] AS lines FROM t
  UNION ALL
  SELECT conv_id, i, q, min(b), arg_min(lines, b) FROM (
    SELECT best.conv_id, x.i, x.to_q AS q, {'cost': best.b.cost + 3 * ins.k + x.price, 'audit': best.b.audit || repeat('I', ins.k) || x.letter} AS b,
      list_concat(best.lines, list_concat(ins.lines, x.lines)) AS lines
    FROM best JOIN ins ON ins.q = best.q JOIN edits x ON x.conv_id IS NOT DISTINCT FROM best.conv_id AND x.i = best.i + 1 AND x.q = ins.to_q
  ) GROUP BY conv_id, i, q
), ended AS (
  SELECT conv_id, min(b) AS b, arg_min(lines, b) AS lines FROM (
    SELECT t.conv_id, {'cost': best.b.cost + 3 * ins.k, 'audit': best.b.audit || repeat('I', ins.k)} AS b, list_concat(best.lines, ins.lines) AS lines
    FROM t JOIN best ON best.conv_id IS NOT DISTINCT FROM t.conv_id AND best.i = t.last JOIN ins ON ins.q = best.q AND ins.to_q IN (0, 3)
  ) GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id"""
