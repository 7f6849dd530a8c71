"""The queries of these operators, and the SQL that some of them can be stated in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import bpe, chat, exact_dedup, jaccard, licenses, lm, mixing, sharding, topk, toxicity

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir), keep="largest")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_documents(spark, sf_dir), tokenizer_path(), digests_only=True)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    mixed = mixing.mix(docs, max_passes=2.0)
    weight, tokens, nth, position = mixed.columns[-4:]
    return mixed.select("doc_id", "source", F.col(tokens).alias("n_tokens"), F.round(weight, 6).alias("weight"), F.col(nth).alias("pass"), F.col(position).alias("position"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score_held_out(_documents(spark, sf_dir), parts=7, held=2).drop("perplexity")
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), parts=5, held=0)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(_documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_documents(spark, sf_dir), n_shards=24)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir), least=0.8)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", topk.quantised(F.col("embedding"), 256).alias("v"))
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, k=5)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "place", "message", F.to_json("problems").alias("problems"), "valid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_mixing": op3_mixing,
    "op4_lm": op4_lm,
    "op5_jaccard": op5_jaccard,
    "op6_sharding": op6_sharding,
    "op7_toxicity": op7_toxicity,
    "op8_licenses": op8_licenses,
    "op9_topk": op9_topk,
    "op10_chat": op10_chat,
}


def _license_sql(least: float = 0.8) -> str:
    """Every unit of every text against every template whose size lets it reach ``least``."""
    rows = [(name, licenses.bigrams_of(t)) for name, ts in sorted(licenses.TEMPLATES.items()) for t in ts]
    values = ", ".join(f"('{name}', [{', '.join(repr(b) for b in bigrams)}])" for name, bigrams in rows)
    return f"""
        WITH t AS (SELECT id, tb, len(tb) AS tn FROM (VALUES {values}) x(id, tb)),
        n AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS norm FROM documents),
        u AS (SELECT r, unnest(list_concat(list_concat(string_split(norm, chr(10)), string_split_regex(norm, '\\n\\s*\\n')), [norm])) AS raw FROM n),
        v AS (SELECT r, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS unit FROM u),
        w AS (SELECT DISTINCT r, unit, string_split(unit, ' ') AS ws FROM v WHERE contains(unit, ' ')),
        b AS (SELECT r, unit, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS ub FROM w),
        f AS (SELECT unit, list_distinct(any_value(ub)) AS ub, len(any_value(ub)) AS un FROM b GROUP BY unit),
        m AS (SELECT unit, id, len(list_intersect(ub, tb)) AS shared, un + tn AS total FROM f JOIN t ON 2.0 * least(un, tn) / (un + tn) >= {least} - 1e-9),
        g AS (SELECT r, unit, id, shared, total FROM b JOIN m USING (unit) WHERE 2.0 * shared / total >= {least} - 1e-9),
        k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY shared DESC, total, id, unit) AS k FROM g)
        SELECT n.doc_id, k.id AS license_id, (2.0 * k.shared / k.total)::DOUBLE AS dice, k.unit, coalesce((SELECT count(DISTINCT g.id) FROM g WHERE g.r = n.r), 0) AS n_licenses
        FROM n LEFT JOIN k ON k.r = n.r AND k.k = 1"""


#: CRC-32 in SQL, byte by byte over the table of its polynomial. A view crc(key, crc) of a view bytes(key, hex).
_CRC_SQL = """
        crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(i))),
        crc AS (SELECT key, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex, '..'), lambda b: ('0x' || b)::BIGINT)), lambda c, v: xor(t[xor(c % 256, v) + 1], c // 256))) AS crc FROM bytes, crc_table)"""


def _held_out_sql(parts: int, held: int) -> str:
    """Views of the documents with their fold: d(doc_id, text, held_out)."""
    return f"""bytes AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS key, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS hex FROM documents),{_CRC_SQL},
        d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, crc % {parts} = {held} AS held_out FROM documents JOIN crc ON key = coalesce(doc_id::VARCHAR, ''))"""


def _discount_sql(view: str, column: str, name: str) -> str:
    """View of the three modified Kneser-Ney discounts of a view's counts."""
    n = ", ".join(f"count(*) FILTER ({column} = {k}) AS n{k}" for k in (1, 2, 3, 4))
    d = ", ".join(f"least(greatest(CASE WHEN n{k} > 0 AND n{k + 1} > 0 THEN {k} - {k + 1} * y * n{k + 1} / n{k} ELSE y END, 0.01), {k} - 0.01) AS d{k}" for k in (1, 2, 3))
    return f"{name} AS (SELECT {d} FROM (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END AS y FROM (SELECT {n} FROM {view})))"


def _cut_sql(count: str, discounts: str) -> str:
    return f"CASE WHEN {count} = 0 THEN 0.0 WHEN {count} = 1 THEN {discounts}.d1 WHEN {count} = 2 THEN {discounts}.d2 ELSE {discounts}.d3 END"


def _lm_sql() -> str:
    """Counts and probabilities of the bigram model, one row a token; the end of a text is the token ' '."""
    return f"""
        WITH {_held_out_sql(7, 2)},
        w AS (SELECT r, held_out, list_concat(list_filter(string_split_regex(translate(text, '{UPPER}', '{LOWER}'), '[\\x09-\\x0D ]+'), lambda w: w <> ''), [' ']) AS w FROM d),
        tok AS (SELECT r, held_out, unnest(list_concat([''], w[:-2])) AS v, unnest(w) AS w FROM w),
        uni AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
        tot AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS words FROM uni),
        bi AS (SELECT v, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY v, w),
        ends AS (SELECT w, count(*) AS e FROM bi GROUP BY w),
        {_discount_sql("bi", "c", "high")}, {_discount_sql("ends", "e", "deep")},
        ctx AS (SELECT v, sum(c) AS total, sum({_cut_sql("c", "high")}) AS cut FROM bi, high GROUP BY v),
        rest AS (SELECT sum({_cut_sql("e", "deep")}) / (SELECT count(*) FROM bi) / (SELECT words + 1 FROM tot) AS rest FROM ends, deep),
        kinds AS (SELECT DISTINCT v, w FROM tok),
        p AS (SELECT k.v, k.w, coalesce(uni.c, 0) AS c, coalesce(bi.c, 0) AS cc, ctx.total, ctx.cut,
                     (coalesce(e, 0) - {_cut_sql("coalesce(e, 0)", "deep")}) / (SELECT count(*) FROM bi) + rest AS low
              FROM kinds k LEFT JOIN uni ON uni.w = k.w LEFT JOIN bi ON bi.v = k.v AND bi.w = k.w LEFT JOIN ctx ON ctx.v = k.v LEFT JOIN ends ON ends.w = k.w, deep, rest),
        q AS (SELECT v, w, c, round(1e13 * log10((c + 1) / (n + 1 * (words + 1))))::HUGEINT AS base,
                     round(1e13 * log10(CASE WHEN total > 0 THEN (cc - {_cut_sql("cc", "high")} + cut * low) / total ELSE low END))::HUGEINT AS score FROM p, tot, high)
        SELECT d.doc_id, d.held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, (SELECT n FROM tot) AS train_tokens, round(sum(base)::DOUBLE / 1e13, 6) AS base_score, round(sum(score)::DOUBLE / 1e13, 6) AS score
        FROM tok JOIN q USING (v, w) JOIN d USING (r) GROUP BY d.r, d.doc_id, d.held_out"""


def _mixing_sql(most: float = 2.0, blocks: int = 4096) -> str:
    """The exponent at which the least source is passed over ``most`` times has a closed form; blocks and rows are sorted and added up."""
    order = lambda *x: f"('0x' || substr(md5({' || chr(124) || '.join(x)}), 1, 15))::BIGINT"
    return f"""
        WITH d AS (SELECT doc_id, source, coalesce(source, chr(0) || 'null') AS key, coalesce(doc_id::VARCHAR, '') AS id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
        r AS (SELECT *, ({order("'block'", "id")} % {blocks})::INTEGER AS block FROM d),
        t AS (SELECT key, sum(tokens) AS tokens FROM r GROUP BY key),
        e AS (SELECT max(tokens) AS high, sum(tokens) AS total, CASE WHEN max(tokens) > {most} * min(tokens) THEN 1 - ln({most}) / ln(max(tokens) / min(tokens)) ELSE 0 END AS e FROM t WHERE tokens > 0),
        x AS (SELECT key, tokens, CASE WHEN tokens > 0 THEN power(high / tokens, 1 - e) ELSE 1.0 END AS exact,
                     CASE WHEN tokens > 0 THEN power(tokens / total, e) / sum(CASE WHEN tokens > 0 THEN power(tokens / total, e) ELSE 0 END) OVER () ELSE 0.0 END AS weight FROM t, e),
        s AS (SELECT *, (CASE WHEN abs(exact - round(exact)) < 1e-6 THEN round(exact) ELSE floor(exact) END)::BIGINT AS passes FROM x),
        q AS (SELECT *, CASE WHEN exact - passes > 1e-6 THEN (exact - passes) * tokens ELSE 0.0 END AS rest FROM s),
        b AS (SELECT r.key, block, rest, passes, sum(r.tokens) AS tokens, {order("r.key", "passes::VARCHAR", "block::VARCHAR")} AS bo FROM r JOIN q USING (key) WHERE rest > 0 GROUP BY r.key, block, rest, passes),
        c AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY key ORDER BY bo, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b),
        f AS (SELECT * FROM c WHERE before < rest QUALIFY row_number() OVER (PARTITION BY key ORDER BY bo DESC, block DESC) = 1),
        i AS (SELECT f.key, f.bo, f.before, f.rest, {order("r.id", "f.passes::VARCHAR")} AS own, r.id, sum(r.tokens) AS tokens FROM r JOIN f ON f.key = r.key AND f.block = r.block GROUP BY ALL),
        h AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY key ORDER BY own, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM i),
        l AS (SELECT key, max(bo) AS last_block, max(own) AS last_row FROM h WHERE before + held < rest GROUP BY key),
        m AS (SELECT r.*, q.weight, q.passes, l.last_block, l.last_row,
                     q.passes + CASE WHEN last_block IS NULL THEN 0 WHEN {order("r.key", "q.passes::VARCHAR", "block::VARCHAR")} < last_block
                       OR ({order("r.key", "q.passes::VARCHAR", "block::VARCHAR")} = last_block AND {order("id", "q.passes::VARCHAR")} <= last_row) THEN 1 ELSE 0 END AS times
              FROM r JOIN q USING (key) LEFT JOIN l USING (key)),
        n AS (SELECT *, unnest(range(times)) AS pass FROM m)
        SELECT doc_id, source, tokens AS n_tokens, round(weight, 6) AS weight, pass,
               least(1.0, (pass + ({order("key", "pass::VARCHAR", "block::VARCHAR")} / power(2.0, 60) * (1 - power(2.0, -20)) + {order("id", "pass::VARCHAR")} / power(2.0, 60) * power(2.0, -20)))
                     / greatest(passes + CASE WHEN last_block IS NULL THEN 0.0 ELSE last_block / power(2.0, 60) END, 1e-9))::DOUBLE AS position
        FROM n"""


def _sharding_sql(shards: int = 24, slots: int = 4096) -> str:
    """The slots that a further shard takes are the highest of the fullest shards, one by one."""
    return f"""
        WITH bytes AS (SELECT row_number() OVER () AS key, doc_id, hex(encode(coalesce(text, ''))) AS hex FROM documents),{_CRC_SQL},
        x AS (SELECT doc_id, len(hex)::BIGINT // 2 + 8 AS size, crc AS text_crc32, (('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % {slots})::INTEGER AS virtual_slot FROM bytes JOIN crc USING (key)),
        moved AS (SELECT v, row_number() OVER (ORDER BY v // {shards} DESC, v % {shards}) <= {slots} // {shards + 1} AS moves FROM range({slots}) r(v))
        SELECT doc_id, size, text_crc32, 'key' AS law, (virtual_slot % {shards})::INTEGER AS shard,
               row_number() OVER (PARTITION BY virtual_slot % {shards} ORDER BY virtual_slot, text_crc32 % 64, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
               CASE WHEN moves THEN {shards} ELSE virtual_slot % {shards} END::INTEGER AS grown_shard, virtual_slot, 1 AS map_version,
               sum(size) OVER (PARTITION BY virtual_slot)::BIGINT AS virtual_slot_bytes
        FROM x JOIN moved ON v = virtual_slot"""


def _chat_sql() -> str:
    """Conversations without tool messages, as the test tables have them: by turn, each message as canonical JSON."""
    return """
        SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place,
               '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS message,
               '[]' AS problems, true AS valid
        FROM conversations"""


ORACLES: dict[str, str] = {
    "op3_mixing": _mixing_sql(),
    "op4_lm": _lm_sql(),
    "op6_sharding": _sharding_sql(),
    "op10_chat": _chat_sql(),
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_licenses": _license_sql(),
    "op9_topk": """
        WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
              FROM x q JOIN x c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5""",
    "op5_jaccard": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x09-\\x0D ]+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)),
        n AS (SELECT d.doc_id, count(s.sh) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.k >= 80 * (x.n + y.n - p.k)),
        r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
        SELECT n.doc_id, n.n AS n_shingles, min(r.reached) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n""",
}
