"""The queries of these operators over the given tables, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.llm import alignment, bpe, chat, merkle, minhash, neighbours, packing, repeats, rules, secret_scan, substrings, tokens, toxicity
from roadsift.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# rows and bytes in one Arrow batch, so that a Python worker holds little text at a time
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20)}


def prepared(spark: SparkSession) -> SparkSession:
    tune(spark)
    for name, value in BATCHES.items():
        spark.conf.set(name, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepared(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_counts")
def op1(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


@query("op2_harmonic_packing")
def op2(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), closing_id=1, capacity=2048)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op3_hyperminhash_dedup", """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (max(na.n) + max(nb.n) - count(*))),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, p.y FROM r JOIN p ON r.reach = p.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.reach) AS component_id, d.doc_id = min(r.reach) AS kept
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
""")
def op3(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


@query("op4_ftrl_toxicity")
def op4(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TURNS: chat.Schemas = {"configure": {"instructions": ("STRING", True)},
                       "reply": {"chars": ("BIGINT", True), "prompt": ("STRING", True), "turn": ("BIGINT", True)}}


def turn_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User and system turns as calls, assistant turns as the results of the turn before."""
    def ref(shift: int) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + shift).cast("string"))

    reply = F.to_json(F.struct(F.length("text").alias("chars"), F.col("text").alias("prompt"), "turn"))
    setup = F.to_json(F.struct(F.col("text").alias("instructions")))
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", ref(0).alias("call_id"), F.when(F.col("role") == "user", "reply").otherwise("configure").alias("name"),
        F.when(F.col("role") == "user", reply).otherwise(setup).alias("arguments"), F.when(F.col("role") == "user", ref(-2)).alias("after"))
    results = turns.where(F.col("role") == "assistant").select(ref(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


@query("op5_tool_call_linking", """
WITH RECURSIVE calls AS MATERIALIZED (
  SELECT conv_id, turn, conv_id || ':' || turn AS call_id, CASE role WHEN 'user' THEN 'reply' ELSE 'configure' END AS name, text,
         CASE role WHEN 'user' THEN conv_id || ':' || (turn - 2) END AS after FROM conversations WHERE role IN ('user', 'system')),
results AS MATERIALIZED (
  SELECT conv_id || ':' || (turn - 1) AS call_id, count(*) AS n_results, min(text) AS result FROM conversations WHERE role = 'assistant' GROUP BY 1),
nodes AS MATERIALIZED (SELECT call_id, min(after) AS after FROM calls GROUP BY call_id),
ordered(call_id, level) AS (
  SELECT call_id, 0 FROM nodes WHERE after IS NULL OR after NOT IN (SELECT call_id FROM nodes)
  UNION ALL SELECT n.call_id, o.level + 1 FROM nodes n JOIN ordered o ON n.after = o.call_id)
SELECT c.conv_id, c.turn, c.call_id, c.name, CAST(o.level AS BIGINT) AS level, coalesce(r.n_results, 0) AS n_results, c.text IS NOT NULL AS valid,
       to_json(struct_pack(arguments := CASE c.name WHEN 'reply' THEN to_json(struct_pack(chars := length(c.text), prompt := c.text, turn := c.turn))
                                                    ELSE to_json(struct_pack(instructions := c.text)) END, id := c.call_id, name := c.name, result := r.result)) AS json
FROM calls c LEFT JOIN ordered o USING (call_id) LEFT JOIN results r USING (call_id)
UNION ALL
SELECT NULL, NULL, call_id, NULL, NULL, n_results, false, to_json(struct_pack(arguments := NULL, id := call_id, name := NULL, result := result))
FROM results WHERE call_id NOT IN (SELECT call_id FROM nodes)
""")
def op5(spark, sf_dir):
    calls, results = turn_calls(table(spark, sf_dir, "conversations"))
    return chat.link_calls(calls, results, TURNS, ("conv_id", "turn"))


@query("op6_bpe_round_trip")
def op6(spark, sf_dir):
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_line_frequency_rules", """
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
l AS MATERIALIZED (
  SELECT d.doc_id, d.source, line, translate(array_to_string(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
         len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS n
  FROM (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) d WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
hot AS (SELECT source, norm, min(doc_id) AS first FROM (SELECT DISTINCT source, norm, doc_id FROM l) GROUP BY source, norm HAVING count(*) > 100),
gone AS (SELECT l.doc_id, sum(l.n) AS n FROM l JOIN hot USING (source, norm) WHERE l.doc_id <> hot.first GROUP BY l.doc_id),
g AS MATERIALIZED (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT place) AS n FROM (
  SELECT g.doc_id, unnest([i, i + 1, i + 2]) AS place FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1) USING (doc_id, gram)) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS lost
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - lost) >= 30 * n_words AS kept, CAST(lost AS BIGINT) AS n_removed_words FROM m
""")
def op7(spark, sf_dir):
    out = rules.quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


@query("op8_vantage_point_neighbours")
def op8(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query("op9_substring_dedup", """
WITH w AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT g.doc_id, unnest(range(i, i + 13)) AS i FROM g JOIN low USING (gram) WHERE low.first < g.doc_id),
a AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.i) AS kept, count(*) AS n FROM a LEFT JOIN gone ON a.doc_id = gone.doc_id AND a.i = gone.i WHERE gone.i IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
""")
def op9(spark, sf_dir):
    out = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=13)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op10_secret_ledger")
def op10(spark, sf_dir):
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.Ledger(spark))
    base = [kind for kind, *_ in secret_scan.BASE_RULES]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    return found.select("doc_id", *counts, F.sha2(span_text(of(*base)), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


@query("op11_merkle_manifest", """
WITH RECURSIVE v AS (
  SELECT doc_id, lang, n_chars, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
         || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS head, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
         list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda a, c:
           list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents),
f AS MATERIALIZED (
  SELECT doc_id, lang, sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END || tail) AS leaf,
         sha256(head || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS VARCHAR)) || ':'
                || (n_chars + CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN 1 ELSE 0 END) END || tail) AS bent FROM v),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM f),
up(lvl, lang, i, h, n) AS (
  SELECT 0, lang, i, leaf, n FROM leaves
  UNION ALL SELECT lvl + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lvl, lang, i // 2, n),
subs AS MATERIALIZED (SELECT lang, h, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM up WHERE n = 1),
top(lvl, i, h, n) AS (
  SELECT 0, i, h, n FROM subs
  UNION ALL SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lvl, i // 2, n),
root AS MATERIALIZED (SELECT h, lvl AS height FROM top WHERE n = 1),
over AS MATERIALIZED (
  SELECT s.lang, s.h AS subroot, root.h AS root, s.height, coalesce(list(coalesce(CASE WHEN (s.i >> t.lvl) & 1 = 1 THEN 'L' ELSE 'R' END || t.h, '') ORDER BY s.l) FILTER (s.l IS NOT NULL), []) AS path
  FROM (SELECT *, unnest(CASE WHEN (SELECT height FROM root) > 0 THEN range((SELECT height FROM root)) ELSE [NULL] END) AS l FROM subs) s CROSS JOIN root
  LEFT JOIN top t ON t.lvl = s.l AND t.i = xor(s.i >> s.l, 1) GROUP BY s.lang, s.h, root.h, s.height),
below AS (
  SELECT d.lang, d.i, list(coalesce(CASE WHEN (d.i >> d.l) & 1 = 1 THEN 'L' ELSE 'R' END || u.h, '') ORDER BY d.l) FILTER (d.l IS NOT NULL) AS path
  FROM (SELECT x.lang, x.i, unnest(CASE WHEN o.height > 0 THEN range(o.height) ELSE [NULL] END) AS l FROM leaves x JOIN over o ON x.lang IS NOT DISTINCT FROM o.lang) d
  LEFT JOIN up u ON u.lvl = d.l AND u.lang IS NOT DISTINCT FROM d.lang AND u.i = xor(d.i >> d.l, 1) GROUP BY d.lang, d.i),
p AS (
  SELECT x.*, o.subroot, o.root, list_concat(coalesce(b.path, []), o.path) AS path
  FROM leaves x JOIN over o ON x.lang IS NOT DISTINCT FROM o.lang JOIN below b ON b.lang IS NOT DISTINCT FROM x.lang AND b.i = x.i),
r AS (
  SELECT *, sha256(array_to_string(list_transform(path, lambda s: substr(s, 2)), '')) AS proof_sha256,
         list_reduce(list_prepend(bent, path), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN substr(s, 2) || a ELSE a || substr(s, 2) END)) AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM r
""")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    out = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], group="lang", tampered={"n_chars": F.col("n_chars") + 1}, when=tampered)
    proof = F.sha2(F.array_join(F.col("path.sibling"), ""), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


@query("op12_tokenizer_alignment")
def op12(spark, sf_dir):
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = alignment.alignment(table(spark, sf_dir, "documents"), *files, digests=True)
    return out.withColumnRenamed("groups", "groups_sha256")


@query("op13_suffix_array_dedup")
def op13(spark, sf_dir):
    out = repeats.remove_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), size=400)
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def load() -> tuple[dict, dict]:
    return dict(QUERIES), dict(ORACLES)
