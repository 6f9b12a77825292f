"""Column expressions over commit messages: bug-fix score, rule annotation, strata."""

import re

from pyspark.sql import functions as F

# Fixed values (weights, words and patterns that must be equal for equal scores).
KEYWORD_WEIGHT = 0.20
ISSUE_WEIGHT = 0.15
STRONG_WEIGHT = 0.25
NOISE_WEIGHT = 0.15
DEFAULT_THRESHOLD = 0.40

FIX_WORDS = [
    "fix", "fixed", "fixes", "fixing", "bug", "defect", "patch",
    "regression", "crash", "exception", "failure", "broken", "incorrect",
    "wrong", "error", "resolve", "resolved", "resolves", "resolving",
    "repair", "hotfix",
]
STRONG_PATTERNS = [
    r"\bfix(es|ed|ing)?\b", r"\bbug.?fix\b", r"\bregression\b", r"\bcrash\b", r"\bdefect\b",
    r"\bnull.?pointer\b", r"\bnpe\b", r"\bstack.?overflow\b", r"\bdeadlock\b", r"\bmemory.?leak\b",
]
ISSUE_PATTERNS = [r"#\d+", r"closes\s+#\d+", r"fixes\s+#\d+", r"resolves\s+#\d+", r"gh-\d+"]
ISSUE_KEY_PATTERN = r"\b[A-Z]{2,12}-\d{1,6}\b"
NOISE_PATTERNS = [
    r"\bmerge\b", r"\bformat\b", r"\btypo\b", r"\breadme\b", r"\bdocumentation\b", r"\bdocs\b",
    r"\brefactor\b", r"\bcleanup\b", r"\bstyle\b", r"\blint\b", r"patch\s+by\b", r"reviewed\s+by\b",
    r"git-svn-id\b", r"\bmove\b", r"\brename\b", r"\brevert\b", r"\bupgrade\b", r"\bupdate\s+version\b", r"\bbump\b",
]

# The ordered annotation rules.
CHORE_PATTERNS = [
    r"^bump version", r"^merge\b", r"^revert\b", r"^release\b", r"^ci\b", r"^build\b", r"^github actions",
    r"^pre-commit", r"^flake8", r"^isort", r"^black\b", r"^formatting",
]
DOC_PATTERNS = [r"^doc", r"readme", r"typo", r"license", r"changelog", r"release notes", r"documentation"]
FEATURE_PATTERNS = [
    r"^add\b", r"^feat", r"^support\b", r"^allow\b", r"^implement", r"^initial\b", r"^introduce\b", r"^bump\b", r"^version\b",
]
REFACTOR_PATTERNS = [r"^refactor", r"^cleanup", r"^clean up", r"^move\b", r"^rename", r"^simplify", r"^reorganize"]
RESCUE_PATTERNS = [r"\bfix", r"\bbug", r"\bcrash", r"\bregression"]
FIX_WORD_PATTERN = r"\bfix(es|ed|ing)?\b"
BUG_WORD_PATTERN = r"\b(bug|defect|crash|exception|regression|error|panic|fault|leak)\b"
ISSUE_CLOSE_PATTERN = r"(closes|fixes|resolves)\s+(#\d+|gh-\d+|issue\s*\d+)"
STYLE_WORDS = ["typo", "doc", "comment", "lint", "style", "format"]
REMEDY_WORDS = ["test", "debug", "prevent", "avoid", "handle", "correct", "repair"]

STRATA = ["high_conf_positive", "boundary", "near_miss", "high_conf_negative"]


def strip(text):
    """`text` without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _leading_word(pattern):
    """The literal text a pattern must start with, or '' when it has none."""
    found = re.match(r"\^?(?:\\b)?([a-z#-]+)(.?)", pattern)
    if not found or found.group(2) in ("?", "*", "{", "|"):
        return ""
    return found.group(1)


def _hits(text, pattern):
    """Whether the pattern occurs; a plain substring test goes first and spares most regex runs.

    (?U): word classes and boundaries follow Unicode, as in the original patterns.
    """
    found = text.rlike("(?U)" + pattern)
    word = _leading_word(pattern)
    return text.contains(word) & found if word else found


def _count_hits(text, patterns):
    total = F.lit(0)
    for p in patterns:
        total = total + _hits(text, p).cast("int")
    return total


def clean_text(message):
    return strip(F.lower(message))


def score_counts(text, message, match_issue_keys=False):
    """The four capped counts (k, i, s, n) of a message; text is clean_text(message), as a column of its own.

    match_issue_keys also counts tracker keys such as ABC-12 in the raw message.
    """
    any_word = F.lit(False)
    for w in FIX_WORDS:
        any_word = any_word | text.contains(w)
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b\w+\b"), F.lit(0))
    matched = F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in FIX_WORDS])))
    k = F.least(F.when(any_word, matched).otherwise(0), F.lit(3))
    issues = _count_hits(text, ISSUE_PATTERNS)
    if match_issue_keys:
        issues = issues + strip(message).rlike("(?U)" + ISSUE_KEY_PATTERN).cast("int")
    i = F.least(issues, F.lit(2))
    s = F.least(_count_hits(text, STRONG_PATTERNS), F.lit(3))
    n = F.least(_count_hits(text, NOISE_PATTERNS), F.lit(2))
    return k, i, s, n


def raw_score(k, i, s, n):
    """The clipped weighted score before rounding; thresholds are tested on this value."""
    value = (
        F.lit(KEYWORD_WEIGHT) * k + F.lit(ISSUE_WEIGHT) * i + F.lit(STRONG_WEIGHT) * s - F.lit(NOISE_WEIGHT) * n
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def stratum(score, k):
    return (
        F.when(score >= 0.70, "high_conf_positive")
        .when(score >= 0.40, "boundary")
        .when(k > 0, "near_miss")
        .otherwise("high_conf_negative")
    )


def rule_annotation(message):
    """Struct label, confidence, note from ordered rules."""
    text = strip(F.lower(message))

    def any_hit(patterns):
        found = F.lit(False)
        for p in patterns:
            found = found | _hits(text, p)
        return found

    def any_word(words):
        found = F.lit(False)
        for w in words:
            found = found | text.contains(w)
        return found

    rescued = any_hit(RESCUE_PATTERNS)
    fix_word = _hits(text, FIX_WORD_PATTERN)
    bug_word = _hits(text, BUG_WORD_PATTERN)

    def verdict(label, confidence, note):
        return F.struct(F.lit(label).alias("label"), F.lit(confidence).alias("confidence"), F.lit(note).alias("note"))

    rules = None
    for patterns, what in (
        (CHORE_PATTERNS + DOC_PATTERNS, "Non-bug chore/doc matching"),
        (FEATURE_PATTERNS, "New feature matching"),
        (REFACTOR_PATTERNS, "Refactoring matching"),
    ):
        for p in patterns:
            when = F.when if rules is None else rules.when
            rules = when(~rescued & _hits(text, p), verdict(False, "HIGH", f"{what} '{p}'"))
    return (
        rules.when(
            _hits(text, ISSUE_CLOSE_PATTERN) | (fix_word & bug_word),
            verdict(True, "HIGH", "Explicit bug fix with issue reference or defect keyword"),
        )
        .when(fix_word & any_word(STYLE_WORDS), verdict(False, "MEDIUM", "Typo/doc/style fix, not a code defect"))
        .when(fix_word, verdict(True, "MEDIUM", "Code fix keyword present without noise terms"))
        .when(bug_word & any_word(REMEDY_WORDS), verdict(True, "MEDIUM", "Defect remediation keyword present"))
        .otherwise(verdict(False, "MEDIUM", "No defect indicators found in commit message"))
    )
