"""One query per operator over its whole table, with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tabeval.llm.common import table

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "op5_minhash_near_dedup",
    r"""WITH RECURSIVE texts AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS s FROM texts),
    flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
      FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
    ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT a, a FROM ways UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other),
    least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
    SELECT s.doc_id, len(s.s)::bigint AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id,
      coalesce(l.component_id, s.doc_id) = s.doc_id AS kept
    FROM sets s LEFT JOIN least l USING (doc_id)""",
)
def near_dedup(spark, d):
    from tabeval.llm import near

    return near.near_duplicates(table(spark, d, "documents")).drop("class")


@query(
    "op6_exact_dedup",
    r"""WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS n,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
    ranked AS (SELECT doc_id, h, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY h) AS c FROM rows)
    SELECT doc_id, keep_id, c::bigint AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM ranked""",
)
def exact_dedup(spark, d):
    from tabeval.llm import exact

    return exact.duplicate_groups(table(spark, d, "documents"))


@query(
    "op3_suffix_array_dedup",
    """WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
    w AS (SELECT doc_id, p, md5(x[p:p+199]) AS h FROM (SELECT doc_id, x, unnest(range(1, octet_length(x) - 198)) AS p FROM b)),
    rep AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
    hit AS (SELECT doc_id, p FROM w WHERE h IN (SELECT h FROM rep)),
    step AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200, true) AS fresh FROM hit),
    numbered AS (SELECT doc_id, p, sum(fresh::int) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM step),
    span AS (SELECT doc_id, i, min(p) AS s, max(p) + 199 AS e FROM numbered GROUP BY doc_id, i),
    piece AS (SELECT doc_id, i, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM span),
    cut AS (SELECT doc_id, count(*) AS n, sum(e - s + 1) AS removed, max(e) AS last,
      list({'a': before + 1, 'b': s - 1} ORDER BY i) AS parts FROM piece GROUP BY doc_id),
    kept AS (SELECT b.doc_id, b.x, c.n, c.removed, list_reduce(list_concat(
        [x[k.a:k.b] for k in coalesce(c.parts, [])], [x[coalesce(c.last, 0) + 1:octet_length(x)]]),
        lambda u, v: u || v) AS k FROM b LEFT JOIN cut c ON b.doc_id = c.doc_id)
    SELECT doc_id, octet_length(x)::bigint AS n_bytes, coalesce(removed, 0)::bigint AS n_removed,
      coalesce(n, 0)::bigint AS n_spans, sha256(k) AS kept_sha256 FROM kept""",
)
def suffix_array_dedup(spark, d):
    from tabeval.llm import suffix

    found = suffix.remove_repeats(table(spark, d, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


SHARDS = 40

#: Remainders of the byte values by the reflected polynomial 0xEDB88320.
_CRC_TABLE = """[list_reduce(list_concat([b::bigint], range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) for b in range(256)]"""


@query(
    "op10_jump_sharding",
    f"""WITH RECURSIVE walk AS (
      SELECT DISTINCT doc_id, n, 0::bigint AS k FROM documents, (VALUES ({SHARDS}), ({SHARDS + 1})) t(n)
      UNION ALL SELECT doc_id, n, floor((k + 1)::double * 4294967296.0::double
        / (('0x' || substr(md5(doc_id::varchar || ':' || k::varchar), 1, 8))::bigint::double + 1))::bigint FROM walk WHERE k < n),
    place AS (SELECT doc_id, max(k) FILTER (n = {SHARDS} AND k < n) AS shard,
      max(k) FILTER (n = {SHARDS + 1} AND k < n) AS grown FROM walk GROUP BY doc_id),
    crc AS (SELECT {_CRC_TABLE} AS t),
    sized AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
      xor(4294967295, list_reduce(list_concat([4294967295::bigint],
        [('0x' || substr(h, 2 * i - 1, 2))::bigint for i in range(1, length(h) // 2 + 1)]),
        lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]))) AS crc
      FROM (SELECT *, hex(encode(coalesce(text, ''))) AS h FROM documents), crc)
    SELECT doc_id, size::bigint AS size, crc::bigint AS text_crc32, 'key' AS law, shard::int AS shard,
      (row_number() OVER (PARTITION BY shard ORDER BY doc_id, crc, size) - 1)::bigint AS slot, grown::int AS grown_shard
    FROM sized JOIN place USING (doc_id)""",
)
def jump_sharding(spark, d):
    from tabeval.llm import sharding

    return sharding.assign(table(spark, d, "documents"), SHARDS)


def _fingerprint_sql() -> str:
    def hashes(w: str) -> str:
        return f"""CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < 5 THEN [substr(md5(array_to_string({w}, ' ')), 1, 10)]
          ELSE [substr(md5(array_to_string({w}[i:i+4], ' ')), 1, 10) for i in range(1, len({w}) - 3)] END"""

    def words(t: str) -> str:
        return f"list_filter(regexp_split_to_array({t}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

    def near(a: str, b: str) -> str:
        union = f"list_sort(list_distinct(list_concat({a}, {b})))[1:64]"
        return f"""CASE WHEN len({union}) = 0 THEN 1.0::double
          ELSE len(list_intersect({union}, list_intersect({a}, {b})))::double / len({union}) END"""

    return f"""WITH rows AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
        coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS u
      FROM documents),
    edited AS (SELECT *, substr(t, 1, n - n // 4) || substr(u, 1, n // 4) AS e FROM rows),
    split AS (SELECT *, {words('t')} AS tw, {words('u')} AS uw, {words('e')} AS ew FROM edited),
    s AS (SELECT *, list_sort(list_distinct({hashes('tw')}))[1:64] AS ts, list_sort(list_distinct({hashes('uw')}))[1:64] AS us,
      list_sort(list_distinct({hashes('ew')}))[1:64] AS es FROM split)
    SELECT doc_id, n::bigint AS n_chars, sha256(e) AS edited_sha256, array_to_string(ts, '') AS fingerprint,
      array_to_string(es, '') AS edited_fingerprint, {near('ts', 'es')} AS near_edited, {near('ts', 'us')} AS near_next FROM s"""


@query("op7_bottom_k_fingerprints", _fingerprint_sql())
def bottom_k_fingerprints(spark, d):
    from tabeval.llm import sketch
    from tabeval.llm.common import text_of

    docs = table(spark, d, "documents").select("doc_id", text_of("text").alias("text"))
    rows = sketch.with_next(docs, ["doc_id"], ["text"], {"sketch": sketch.sketch})
    n = F.length("text")
    moved = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - moved), F.substring("next.text", F.lit(1), moved))
    rows = rows.select("doc_id", "text", "sketch", F.col("next.sketch").alias("other"), edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch.sketch(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"), F.array_join("edited_sketch", "").alias("edited_fingerprint"),
        sketch.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        sketch.resemblance(F.col("sketch"), F.col("other")).alias("near_next"),
    )


def _secrets_sql() -> str:
    """Matches and the pieces between them add up to positions; the patterns are written out again here."""
    kinds = [
        ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", "AKIA[A-Z0-9]+", 0, 18),
        ("hex", "[0-9a-f]+", 0, 16),
        ("private_key", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
        ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
        ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
        ("google", "AIza[0-9A-Za-z_-]{35}", 0, 1),
        ("stripe", "sk_live_[0-9A-Za-z]{16,}", 0, 1),
        ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}", 0, 1),
    ]
    parts = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS no, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {g}) AS c,
          regexp_split_to_array(t, '{p}') AS b, {least} AS least FROM texts WHERE regexp_matches(t, '{p}')"""
        for k, (kind, p, g, least) in enumerate(kinds)
    )
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), parts AS ({parts}),
    flat AS (SELECT doc_id, no, kind, least, unnest(m) AS m, unnest(c) AS c, unnest(b[1:len(m)]) AS b, unnest(range(1, len(m) + 1)) AS i FROM parts),
    placed AS (SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id, no ORDER BY i) AS e FROM flat),
    good AS (SELECT doc_id, no, kind, e - length(m) AS s, e FROM placed WHERE length(c) >= least),
    told AS (SELECT doc_id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS k, count(*) FILTER (no = 2) AS h,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 3) AS base,
      string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans FROM good GROUP BY doc_id)
    SELECT t.doc_id, coalesce(a, 0)::bigint AS n_assign, coalesce(k, 0)::bigint AS n_access, coalesce(h, 0)::bigint AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts t LEFT JOIN told o ON t.doc_id = o.doc_id"""


@query("op2_secret_scan", _secrets_sql())
def secret_scan(spark, d):
    from tabeval.llm import secrets

    return secrets.digest(secrets.scan(table(spark, d, "documents")))


@query("op1_sentencepiece")
def sentencepiece(spark, d):
    from tabeval.llm import pieces

    return pieces.encode(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


@query("op4_source_mixing")
def source_mixing(spark, d):
    from tabeval.llm import mixing

    return mixing.taken(table(spark, d, "documents"))


@query("op8_html_extraction")
def html_extraction(spark, d):
    from tabeval.llm import html

    return html.extract(table(spark, d, "pages")).withColumnRenamed("id", "page_id")


@query("op9_toxicity")
def toxicity(spark, d):
    from tabeval.llm import toxicity as tx

    docs = table(spark, d, "documents")
    return tx.scores(docs, tx.fit(docs, table(spark, d, "labels")))


@query(
    "op11_lattice_dedup",
    """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::double[] AS x FROM embeddings),
    able AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
      AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND len(a.x) = len(b.x)
      AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
    reach(vec_id, other) AS (SELECT a, a FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    least AS (SELECT vec_id, min(other) AS c FROM reach GROUP BY vec_id),
    degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
    SELECT v.vec_id, coalesce(n, 0)::bigint AS n_links, coalesce(c, v.vec_id) AS component_id, coalesce(c, v.vec_id) = v.vec_id AS kept
    FROM v LEFT JOIN least USING (vec_id) LEFT JOIN degree USING (vec_id)""",
)
def lattice_dedup(spark, d):
    from tabeval.llm import lattice

    return lattice.near_embeddings(table(spark, d, "embeddings"))


def _crc_sql(binary: str) -> str:
    """CRC-32 of a binary value; the table is column t."""
    return f"""xor(4294967295, list_reduce(list_concat([4294967295::bigint],
        [('0x' || substr(hex({binary}), 2 * i - 1, 2))::bigint for i in range(1, octet_length({binary}) + 1)]),
        lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])))"""


@query(
    "op12_importance_resampling",
    rf"""WITH crc AS (SELECT {_CRC_TABLE} AS t),
    texts AS (SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
    found AS (SELECT doc_id, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
    hashed AS (SELECT w, {_crc_sql("encode(w)")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM found), crc),
    placed AS (SELECT doc_id, own, bucket FROM found JOIN hashed USING (w)),
    counts AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM placed GROUP BY bucket),
    sums AS (SELECT sum(s) AS bs, sum(t) AS bt FROM counts),
    gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::double * (bs + 10000)::double) / ((s + 1)::double * (bt + 10000)::double)))::bigint AS g
      FROM counts, sums),
    weighed AS (SELECT doc_id, count(*) AS n, floor(sum(g)::double / count(*))::bigint AS weight
      FROM placed JOIN gain USING (bucket) WHERE own GROUP BY doc_id),
    scored AS (SELECT d.doc_id, coalesce(n, 0)::bigint AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint AS score
      FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT s.doc_id, n_features, weight, score, r::bigint AS rank FROM scored s
    LEFT JOIN (SELECT * FROM ranked WHERE r <= 10 * n // 100) k ON s.doc_id = k.doc_id""",
)
def importance_resampling(spark, d):
    from tabeval.llm import resampling

    return resampling.resample(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query(
    "op13_conversation_repair",
    rf"""WITH RECURSIVE crc AS (SELECT {_CRC_TABLE} AS t),
    drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      {_crc_sql("encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 AS k FROM conversations, crc),
    bad AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
      CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN k = 0 THEN [] WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM drawn),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
      row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS r,
      regexp_replace(text, '[\x20\x09-\x0D]', '', 'g') AS solid FROM bad),
    y AS MATERIALIZED (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM placed),
    told AS (SELECT conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
      count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
      count(*) FILTER (fault = 'truncated') AS truncated,
      count(*) FILTER (prev IS NOT NULL AND prev || r NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM y GROUP BY conv_id),
    back(conv_id, i, c) AS (
      SELECT conv_id, n + 1, [0, 6, 3, 0]::bigint[] FROM told
      UNION ALL SELECT conv_id, i, [least(b[1], 3 + b[3], 6 + b[4]), least(b[2], 3 + b[3], 6 + b[4]), least(b[3], 3 + b[4], 6 + b[3]),
        least(b[4], 3 + b[3], 6 + b[4])] FROM (
        SELECT p.conv_id, y.i, CASE WHEN fault IN ('blank', 'duplicate') THEN [4 + c[1], 4 + c[2], 4 + c[3], 4 + c[4]] ELSE
          [least(4 + c[1], 3 + more + c[3], CASE r WHEN 's' THEN more + c[2] WHEN 'u' THEN more + c[3] ELSE 1000000000 END),
           least(4 + c[2], 3 + more + c[3], CASE r WHEN 'u' THEN more + c[3] ELSE 1000000000 END),
           least(4 + c[3], 3 + more + c[4], CASE r WHEN 'a' THEN more + c[4] ELSE 1000000000 END),
           least(4 + c[4], 3 + more + c[3], CASE r WHEN 'u' THEN more + c[3] ELSE 1000000000 END)] END AS b
        FROM back p JOIN (SELECT *, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM y) y ON y.conv_id = p.conv_id AND y.i = p.i - 1)),
    costs AS MATERIALIZED (SELECT * FROM back),
    steps AS MATERIALIZED (SELECT a.conv_id, a.i, a.c AS here, b.c AS behind, y.role, y.text, y.r, y.fault,
      CASE WHEN y.fault = 'truncated' THEN 3 ELSE 0 END AS more, y.i IS NULL AS ended
      FROM costs a LEFT JOIN costs b ON a.conv_id = b.conv_id AND b.i = a.i + 1 LEFT JOIN y ON y.conv_id = a.conv_id AND y.i = a.i),
    walk(conv_id, i, q, audit, lines) AS (
      SELECT conv_id, 1::bigint, 1, '', []::varchar[] FROM told
      UNION ALL SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kept ELSE onto END, audit || e,
        CASE e WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text]
          WHEN 'I' THEN lines || [CASE onto WHEN 3 THEN 'user:' ELSE 'assistant:' END]
          ELSE lines || [CASE onto WHEN 3 THEN 'user:' ELSE 'assistant:' END || text] END
      FROM (SELECT *, CASE WHEN ended THEN 'I' WHEN 4 + behind[q] = here[q] THEN 'D' WHEN 3 + here[onto] = here[q] THEN 'I'
          WHEN kept IS NOT NULL AND more + behind[kept] = here[q] THEN 'K' ELSE 'R' END AS e
        FROM (SELECT w.*, s.* EXCLUDE (conv_id, i), CASE WHEN q = 3 THEN 4 ELSE 3 END AS onto,
            CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN q = 1 AND r = 's' THEN 2 WHEN q <> 3 AND r = 'u' THEN 3
              WHEN q = 3 AND r = 'a' THEN 4 END AS kept
          FROM walk w JOIN steps s ON s.conv_id = w.conv_id AND s.i = w.i WHERE NOT ended OR here[q] > 0))),
    done AS (SELECT w.conv_id, w.audit, sha256(array_to_string(w.lines, chr(10))) AS h FROM walk w JOIN told t
      ON w.conv_id = t.conv_id AND w.i = t.n + 1 WHERE w.q IN (1, 4)
      QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY length(w.audit) DESC) = 1)
    SELECT k.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
      coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(o.c[1], 0)::bigint AS cost,
      coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN told t ON t.conv_id = k.conv_id
    LEFT JOIN costs o ON o.conv_id = k.conv_id AND o.i = 1 LEFT JOIN done f ON f.conv_id = k.conv_id""",
)
def conversation_repair(spark, d):
    from tabeval.llm import repair

    return repair.repair_report(repair.damaged(table(spark, d, "conversations")), present="present")
