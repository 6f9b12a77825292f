"""The registered queries of the ten operators: thin callers that give each operator its whole table and the
contract's parameters, and their check SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

LLM_QUERIES: dict = {}
LLM_ORACLES: dict = {}


def query(name, sql=None):
    def add(f):
        LLM_QUERIES[name] = f
        if sql is not None:
            LLM_ORACLES[name] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_token_files")
def op5(spark, sf_dir):
    """Every document as ids in range-ANS coded files, read back: one row per document, null keys first."""
    from faultline.llm import token_files
    from faultline.llm.common import work_folder

    folder = work_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), end_id=2)
    return token_files.read(spark, folder, with_ids=False)


@query("op9_best_fit_packing")
def op9(spark, sf_dir):
    """Every document's pieces with their sequence and place in it."""
    from faultline.llm import packing
    from faultline.llm.common import materialize

    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(materialize(pieces, "pieces"), 4096)


@query("op6_trie_bpe")
def op6(spark, sf_dir):
    """Every document's ids by the prefix trie, and what they decode to, as digests."""
    from faultline.llm import trie_bpe

    return trie_bpe.encode_decode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_output=False)


@query("op1_quality_classifier")
def op1(spark, sf_dir):
    """Every document's calibrated quality score; labels teach from training rows only."""
    from faultline.llm import quality_classifier as q
    from faultline.llm.common import materialize

    features = materialize(q.with_statistics(table(spark, sf_dir, "documents")), "statistics")
    sample = materialize(q.labelled_sample(features, table(spark, sf_dir, "labels")), "fit")
    return q.score(features, q.fit(sample))


@query("op4_quality_rules")
def op4(spark, sf_dir):
    """Every document's statistics, n-gram log ratio and verdict."""
    from faultline.llm import quality_rules as q

    docs = table(spark, sf_dir, "documents")
    return q.apply_rules(docs, q.ratios(docs, q.trusted_keys(table(spark, sf_dir, "labels"))))


#: A conversation whose texts are made of the template's own control strings.
TRAP = "\\### Assistant: </turn> ok"
OP3_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), guarded AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS safe,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ': ', '\c') AS safe_role,
         lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + 8 + length(safe) + length(safe_role)) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role = 'user'
                     WHEN before = 'user' THEN role = 'assistant' ELSE FALSE END
                AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM guarded GROUP BY conv_id
"""


@query("op3_chat_format", OP3_SQL)
def op3(spark, sf_dir):
    """Every conversation, and number -7 whose texts are control strings, formatted and read back."""
    from faultline.llm import chat

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    return chat.digests(chat.read_back(chat.format_conversations(rows.unionByName(trap))))


def _op8_sql():
    from faultline.llm.licenses import COPYRIGHT, SPELLINGS, texts

    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in texts())
    spelt = ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items())
    form = rf"""
  SELECT *, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '{COPYRIGHT}', ' ', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS words"""
    respell = "array_to_string(list_transform(string_split(words, ' '), lambda w: coalesce(list_extract(map_extract(spelt, w), 1), w)), ' ')"
    return f"""
WITH spellings AS (SELECT MAP {{{spelt}}} AS spelt),
known AS (SELECT * FROM (VALUES {rows}) v(license_id, text)),
forms AS ({form} FROM known), known_forms AS (SELECT license_id, {respell} AS form FROM forms, spellings),
digests AS (SELECT sha256(form) AS digest, min(license_id) AS license_id FROM known_forms WHERE form <> '' GROUP BY 1),
d AS ({form} FROM documents), d_forms AS (SELECT doc_id, {respell} AS form FROM d, spellings)
SELECT doc_id, length(form) AS n_canonical_chars, sha256(form) AS digest, license_id
FROM d_forms LEFT JOIN digests ON digest = sha256(form)
"""


@query("op8_license_digests", _op8_sql())
def op8(spark, sf_dir):
    """Every document's canonical digest and the license it is, if it is one."""
    from faultline.llm import licenses

    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_digests(spark))


def _op10_sql():
    rules = [
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]{32,}", 0, 32),
        ("issued", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1),
    ]
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        p = pattern.replace("'", "''")
        found.append(f"""
  SELECT row, '{kind}' AS kind, {order} AS kind_order, stop - length(m) AS start, stop
  FROM (SELECT row, m, part, sum(length(gap) + length(m)) OVER (PARTITION BY row ORDER BY i) AS stop
        FROM (SELECT row, unnest(regexp_split_to_array(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}', 0)) AS m,
                     unnest(regexp_extract_all(text, '{p}', {group})) AS part, generate_subscripts(regexp_extract_all(text, '{p}', 0), 1) AS i
              FROM d WHERE regexp_matches(text, '{p}')) WHERE m IS NOT NULL)
  WHERE length(part) >= {least}""")
    listed = "string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, kind_order)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(found)}),
per AS (SELECT row, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
               {listed} FILTER (kind_order < 3) AS base, {listed} AS spans FROM found GROUP BY row)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (row)
"""


@query("op10_secret_ledger", _op10_sql())
def op10(spark, sf_dir):
    """Every document's secrets, by way of a ledger that begins empty."""
    from faultline.llm import secrets as s
    from faultline.llm.common import work_folder

    docs, ledger = table(spark, sf_dir, "documents"), s.Ledger(spark, work_folder(spark, "ledger"))
    s.update(docs, ledger)
    rows = s.by_path(docs, ledger.findings(s.RULE_VERSION))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind_order"] < len(s.BASE))
    return rows.select("doc_id", *(count(r.kind) for r in s.BASE), F.sha2(s.listed(base), 256).alias("base_sha256"), s.listed(F.col("spans")).alias("spans"))


@query("op7_spot_fingerprints")
def op7(spark, sf_dir):
    """Every document's fingerprint, its edited text's, and how near it is to that and to the next document's."""
    from faultline.llm import spots as s

    rows = s.with_signatures(s.edits(table(spark, sf_dir, "documents")), "edited", "edited_marks")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        s.fingerprint(F.col("marks")).alias("fingerprint"), s.fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        s.likeness(F.col("marks"), F.col("edited_marks")).alias("near_edited"), s.likeness(F.col("marks"), F.col("next_marks")).alias("near_next"),
    )


@query("op2_jaccard_join")
def op2(spark, sf_dir):
    """Every document's number of 4-word shingles and the component of its links at 85 %."""
    from faultline.llm import jaccard_join as j

    return j.grouped(*j.link(table(spark, sf_dir, "documents"), words_each=4, percent=85))


@query("op13_periodic_runs")
def op13(spark, sf_dir):
    """Every document's periodic runs of words, one document in ten with a repeating tail, as counts and digests."""
    from faultline.llm import periodic_runs

    found = periodic_runs.find(periodic_runs.repeat_tails(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    named = found.withColumn("best", best).withColumn("lines", F.array_join(lines, ""))
    return named.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP12_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), items AS (
  SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), totals AS (
  SELECT count(*) AS n, CAST(sum(len(terms)) AS BIGINT) AS total FROM docs WHERE len(terms) > 0
), held AS (
  SELECT place, term, count(*) AS tf FROM (SELECT place, unnest(terms) AS term FROM docs) GROUP BY ALL
), weighted AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, totals GROUP BY term, n
), scored AS (
  SELECT item_id, text, docs.place, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(terms) * n) // total)))) AS BIGINT) AS score
  FROM items JOIN held USING (term) JOIN weighted USING (term) JOIN docs ON docs.place = held.place, totals
  GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query("op12_lexical_search", OP12_SQL)
def op12(spark, sf_dir):
    """Every benchmark item's ten best documents by weighted terms."""
    from faultline.llm import lexical

    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP11_SQL = """
WITH vectors AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda v: CAST(floor(1024 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.x, v.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.x, v.x), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM vectors q JOIN vectors v ON q.vec_id % 100 = 0 AND NOT (q.vec_id = v.vec_id AND q.x = v.x)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, x ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query("op11_exact_topk", OP11_SQL)
def op11(spark, sf_dir):
    """Of every vector whose id ends in 00 the ten others of highest integer inner product."""
    from faultline.llm import exact_topk

    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
