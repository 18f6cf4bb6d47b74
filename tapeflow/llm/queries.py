"""Registered queries of this folder and their DuckDB twins."""

from __future__ import annotations

import pathlib
import sys
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tapeflow.llm import chat, decontam, exact, lines, mixing, partenum, pieces, quality, repair, runs, urls, warc, wordpiece
from tapeflow.llm.shared import read
from tapeflow.sources.store import scratch_folder

#: A public vocabulary with word-final pieces; see the README of that folder.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
#: A public model of merged pieces with byte pieces.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_ROOT = str(pathlib.Path(__file__).resolve().parents[2])


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Python workers import this package from where the driver has it.
            env = spark.sparkContext.environment
            if _ROOT not in env.get("PYTHONPATH", "").split(":"):
                env["PYTHONPATH"] = ":".join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SAID = "</s>[INST] ok [/INST]"


@query("op1_chat", rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|<</SYS>>|<\|role|<<SYS>>|<\|end\|>|\[/INST\]|\[INST\]|</s>|<s>|\|>'))
    + CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 16 + length(role) END AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS is_last FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars,
  bool_and(CASE coalesce(prev, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END) AS valid,
  bool_and(CASE coalesce(prev, 'start') WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END)
    AND bool_or(is_last AND role = 'assistant') AS complete
FROM m GROUP BY conv_id""")
def op1_chat(spark, sf_dir):
    own = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = own.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAID).alias("text"))
    return chat.read_back(chat.format_chats(own.union(more)))


@query("op2_exact_dedup", r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = first(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id)""")
def op2_exact_dedup(spark, sf_dir):
    return exact.exact_groups(read(spark, sf_dir, "documents")).drop("level", "name")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op3_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id::VARCHAR AS item_id, unnest(CASE WHEN len(w) <= 10 THEN [w]
    ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS win FROM b WHERE len(w) > 0),
lens AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens)),
hits AS (SELECT doc_id, s, n, item_id FROM dw JOIN bw USING (win)),
spots AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op3_decontamination(spark, sf_dir):
    marked = decontam.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                         (F.col("n_hit") > 0).alias("contaminated"))


@query("op4_jaccard_join", rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), {_UPPER}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [w] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
twos AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM twos JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 90 * (p.n + q.n - k)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, sym.b FROM r JOIN sym ON sym.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) c ON c.doc_id = d.doc_id""")
def op4_jaccard_join(spark, sf_dir):
    return partenum.jaccard_groups(read(spark, sf_dir, "documents"), width=3, per_cent=90)


_RULES = sorted(urls.RULES, key=lambda r: -len(r.name))
_FITS = [f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))" for r in _RULES]


@query("op5_url_filter", rf"""
WITH p AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, translate(regexp_extract(rest, '(?s)^[^/?#]*'), {_UPPER}) AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
  regexp_extract(rest, '(?s)^[^?#]*\?([^#]*)', 1) AS qs FROM p),
c AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN qs <> '' THEN '?' || array_to_string(list_sort(string_split(qs, '&')), '&') ELSE '' END AS canon, instr(url, '://') > 0 AS ok FROM q),
r AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(_FITS, _RULES, strict=True))} END AS rule,
  CASE {" ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(_FITS, _RULES, strict=True))} END AS said FROM c)
SELECT page_id, host, path, rule, CASE WHEN said IS NOT NULL THEN said
  WHEN ok AND canon IN (SELECT canon FROM c WHERE page_id % 50 = 0 AND ok) THEN 'block' ELSE 'allow' END AS verdict FROM r""")
def op5_url_filter(spark, sf_dir):
    """Listed are the URLs of pages whose id is divisible by 50."""
    pages = read(spark, sf_dir, "pages")
    return urls.judge(pages.select("page_id", "url"), pages.where("page_id % 50 = 0").select("url")).drop("url")


@query("op6_source_mix", """
WITH d AS (SELECT *, length(coalesce(text, '')) + 1 AS size FROM documents),
z AS (SELECT source, sum(size)::DOUBLE AS chars, sqrt(sum(size)::DOUBLE) AS w FROM d GROUP BY 1),
s AS (SELECT source, (SELECT sum(chars) FROM z) * w / (SELECT sum(w) FROM z) / chars AS rate FROM z),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM s, range(0, 100) t(k)),
u AS (SELECT d.*, ('0x' || substr(md5('mix:1:' || coalesce(doc_id::VARCHAR, '?')), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM d),
n AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS n FROM u)
SELECT doc_id, text, lang, source, n_chars, unnest(range(1, n + 1))::INTEGER AS copy FROM n""")
def op6_source_mix(spark, sf_dir):
    return mixing.replicate(read(spark, sf_dir, "documents"))


_B32 = "array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s: " \
       "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * g + 1)::BIGINT, 5))::BIGINT >> s) & 31) + 1, 1)), '')), '')"


@query("op7_warc", f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, n AS payload_bytes, {_B32} AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to FROM q""")
def op7_warc(spark, sf_dir):
    folder = scratch_folder(spark) + "-" + uuid.uuid4().hex[:8]
    warc.write_archives(read(spark, sf_dir, "pages"), folder)
    found = warc.read_archives(spark, folder).where("kind = 'record'")
    page = lambda c: F.regexp_extract(c, "^<urn:page:(.*)>$", 1).try_cast("long")
    return found.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        page("refers_to").alias("refers_to"))


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs)


@query("op9_token_counts")
def op9_token_counts(spark, sf_dir):
    return wordpiece.token_counts(read(spark, sf_dir, "documents"), *wordpiece.load_vocabulary(VOCABULARY))


@query("op10_quality")
def op10_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, read(spark, sf_dir, "labels")))


@query("op11_sentencepiece")
def op11_sentencepiece(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return pieces.digest(pieces.encode_documents(docs, pieces.load_model(PIECES)))


def _plus(v: str, cost: str, edit: str, line: str = "''") -> str:
    """A state's value is its cost in six digits, its audit, a mark, its rows: least() compares costs, then audits."""
    return (f"lpad((left({v}, 6)::INT + {cost})::VARCHAR, 6, '0') || split_part(substr({v}, 7), chr(1), 1) || '{edit}' || chr(1) || "
            f"substr({v}, instr({v}, chr(1)) + 1) || {line}")


_BEFORE_USER = "least(s0, s1, s3)"
_SAYS = "|| ':' || text || chr(10)"


def _inserted(rows: str) -> str:
    """States after a row (s0 s1 k2 k3) with the insertions that may follow."""
    return f"""SELECT conv_id, i, s0, s1, s2, least(k3, {_plus('s2', '5', 'I', "'assistant:' || chr(10)")}) AS s3 FROM (
    SELECT *, least(k2, {_plus('least(s0, s1, k3)', '5', 'I', "'user:' || chr(10)")}) AS s2 FROM ({rows}))"""


@query("op12_conversation_repair", rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT src.*, xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda j: ascii(substr(k, j, 1))::BIGINT),
    lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8)), 4294967295) % 20 AS way FROM src, tab),
d AS (SELECT conv_id, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN
    regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE way WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE way <> 0),
o AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, left(role, 1) AS c,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again FROM d)),
a AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND prev || c NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv_id),
r AS ({_inserted("SELECT conv_id, 0::BIGINT AS i, '000000' || chr(1) AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS k2, NULL::VARCHAR AS k3 FROM a")}
  UNION ALL {_inserted(f'''SELECT r.conv_id, o.i, {_plus("s0", "2", "D")} AS s0,
    least({_plus("s1", "2", "D")}, CASE WHEN kept AND c = 's' THEN {_plus("s0", "m", "K", "role " + _SAYS)} END) AS s1,
    least({_plus("s2", "2", "D")}, CASE WHEN kept AND c = 'u' THEN {_plus(_BEFORE_USER, "m", "K", "role " + _SAYS)} END,
      CASE WHEN kept THEN {_plus(_BEFORE_USER, "(1 + m)", "R", "'user' " + _SAYS)} END) AS k2,
    least({_plus("s3", "2", "D")}, CASE WHEN kept AND c = 'a' THEN {_plus("s2", "m", "K", "role " + _SAYS)} END,
      CASE WHEN kept THEN {_plus("s2", "(1 + m)", "R", "'assistant' " + _SAYS)} END) AS k3
    FROM r JOIN (SELECT *, fault IN ('', 'truncated') AS kept, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS m FROM o) o
      ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND o.i = r.i + 1''')}),
g AS (SELECT a.*, least(s0, s3) AS v FROM a JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id AND r.i = a.n),
z AS (SELECT DISTINCT conv_id FROM conversations)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(v, 6)::BIGINT, 0) AS cost,
  coalesce(split_part(substr(v, 7), chr(1), 1), '') AS audit,
  sha256(coalesce(regexp_replace(substr(v, instr(v, chr(1)) + 1), '\n\z', ''), '')) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id""")
def op12_conversation_repair(spark, sf_dir):
    own = read(spark, sf_dir, "conversations")
    return repair.summary(repair.repair(repair.damage(own)), own)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    return runs.summary(runs.find_runs(runs.with_loops(read(spark, sf_dir, "documents"))))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
