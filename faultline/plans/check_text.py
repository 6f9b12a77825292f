"""Check SQL pieces for commit scoring, generated from the same fixed lists."""

from faultline.functions import text as t


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def hits(column, patterns):
    return " + ".join(f"cast(regexp_matches({column}, {lit(p)}) AS int)" for p in patterns)


def any_hit(column, patterns):
    return "(" + " OR ".join(f"regexp_matches({column}, {lit(p)})" for p in patterns) + ")"


def any_word(column, words):
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in words) + ")"


def scored(source, threshold=0.40):
    """CTEs ending in `scored`: the rows of `source` with the score columns."""
    words = ", ".join(lit(w) for w in t.FIX_WORDS)
    return f"""counted AS (
  SELECT *, least(len(list_intersect(regexp_extract_all(msg_, '\\b\\w+\\b'), [{words}])), 3)::INT AS k,
         least({hits('msg_', t.ISSUE_PATTERNS)}, 2) AS i,
         least({hits('msg_', t.STRONG_PATTERNS)}, 3) AS s,
         least({hits('msg_', t.NOISE_PATTERNS)}, 2) AS n
  FROM (SELECT *, trim(lower(message)) AS msg_ FROM {source})),
weighed AS (
  SELECT * EXCLUDE (msg_), greatest(0e0, least(1e0, 0.20::DOUBLE * k + 0.15::DOUBLE * i + 0.25::DOUBLE * s - 0.15::DOUBLE * n)) AS raw_
  FROM counted),
scored AS (
  SELECT * EXCLUDE (raw_), round(raw_, 4) AS score, raw_ >= {threshold}::DOUBLE AND NOT (n >= 2 AND s = 0) AS is_bug_fix,
         n >= 2 AND s = 0 AS noise_dominated
  FROM weighed)"""
