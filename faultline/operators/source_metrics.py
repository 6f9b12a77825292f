"""Source metrics, computed row by row: no shuffle. Array functions do all but the matching of blocks, which is one Arrow function
that passes over a text once. Work grows with the length of a text; snapshots.cap_size drops large ones where that is wanted.
"""

from functools import reduce

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from faultline.functions import languages as lang
from faultline.functions.blocks import blocks
from faultline.functions.files import language_of


def lines_of(source):
    """The lines of a text; a final line break ends the last line and opens no new one."""
    parts = F.split(source, r"\R", -1)
    trimmed = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.when(F.length(source) == 0, F.array().cast("array<string>")).otherwise(trimmed)


def with_language(sources):
    return sources.withColumn("language", language_of(F.col("file_path")))


def line_table(sources):
    """Rows (repo, file_path, line_no, line), line_no from 1."""
    return sources.select("repo", "file_path", F.posexplode(lines_of(F.col("source"))).alias("pos", "line")).select(
        "repo", "file_path", (F.col("pos") + 1).alias("line_no"), "line"
    )


def _blank(line):
    return ~line.rlike(r"(?U)\S")


def _count(lines, test):
    return F.size(F.filter(lines, test))


def line_counts(sources):
    """loc, blank, #-comment lines, sloc and comment density per file."""
    counted = sources.withColumn("_lines", lines_of(F.col("source"))).select(
        "repo", "file_path",
        F.size("_lines").alias("loc"),
        _count(F.col("_lines"), _blank).alias("blank_lines"),
        _count(F.col("_lines"), lambda x: x.rlike(r"(?U)^\s*#")).alias("comment_lines"),
    )
    return counted.withColumn("sloc", F.col("loc") - F.col("comment_lines") - F.col("blank_lines")).withColumn(
        "comment_density", F.col("comment_lines") / F.greatest(F.col("loc"), F.lit(1))
    )


def _by_language(build):
    """A CASE over the language column with `build(rules)` for each known language and for the rest."""
    case = None
    for name, rules in lang.LANGUAGES.items():
        hit = F.col("language") == name
        case = F.when(hit, build(rules)) if case is None else case.when(hit, build(rules))
    return case.otherwise(build(lang.OTHER))


def _comment_walk(lines):
    """Per file, in line order: comment lines, blank lines, debt markers and branch keywords outside comments."""

    def build(rules):
        branch = "|".join(rules["branches"])

        def marks(line):
            # every pattern meets a line once; the walk over lines only combines what was found
            blank = _blank(line)
            return F.struct(
                blank.alias("blank"), line.rlike(rules["start"]).alias("start"), line.rlike(rules["line"]).alias("line"), line.rlike(rules["end"]).alias("end"),
                line.rlike("TODO|FIXME|HACK").alias("debt"), F.when(blank, 0).otherwise(F.regexp_count(line, F.lit("(?U)" + branch))).alias("branches"),
            )

        def step(a, m):
            blank = m["blank"]
            inside = ~blank & a["inside"]
            opens = ~blank & ~a["inside"] & m["start"]
            single = ~blank & ~a["inside"] & ~m["start"] & m["line"]
            code = ~blank & ~a["inside"] & ~m["start"] & ~m["line"]
            return F.struct(
                F.when(inside | opens, ~m["end"]).otherwise(a["inside"]).alias("inside"),
                (a["comment"] + (inside | opens | single).cast("int")).alias("comment"),
                (a["blank"] + blank.cast("int")).alias("blank"),
                (a["todo"] + ((single | code) & m["debt"]).cast("int")).alias("todo"),
                (a["branches"] + F.when(code, m["branches"]).otherwise(0)).alias("branches"),
            )

        zero = F.struct(
            F.lit(False).alias("inside"), F.lit(0).alias("comment"), F.lit(0).alias("blank"), F.lit(0).alias("todo"), F.lit(0).alias("branches")
        )
        return F.aggregate(F.transform(lines, marks), zero, step)

    return _by_language(build)


def comment_profile(sources):
    """loc, blank_lines, comment_lines, sloc, comment_density, todo_count, cyclomatic_complexity by language rules."""
    walked = with_language(sources).withColumn("_lines", lines_of(F.col("source"))).withColumn("_w", _comment_walk(F.col("_lines")))
    loc = F.size("_lines")
    sloc = F.greatest(F.lit(0), loc - F.col("_w.comment") - F.col("_w.blank"))
    return walked.select(
        *sources.columns, "language", loc.alias("loc"), F.col("_w.blank").alias("blank_lines"), F.col("_w.comment").alias("comment_lines"),
        sloc.alias("sloc"), F.round(F.col("_w.comment") / F.greatest(loc, F.lit(1)), 3).alias("comment_density"),
        F.col("_w.todo").alias("todo_count"), (F.col("_w.branches") + 1).alias("cyclomatic_complexity"),
    )


def _char_count(text, char):
    return F.length(text) - F.length(F.replace(text, F.lit(char)))


def brace_depth(lines):
    """Greatest running number of open braces over lines, never below 0."""

    def step(a, line):
        depth = F.greatest(F.lit(0), a["depth"] + _char_count(line, "{") - _char_count(line, "}"))
        return F.struct(depth.alias("depth"), F.greatest(a["top"], depth).alias("top"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top")), step, lambda a: a["top"])


def indent_width(line):
    return F.length(F.regexp_extract(line, r"(?U)^\s*", 0))


def indent_depth(lines):
    """Greatest indentation // 4 over non-blank lines without braces."""
    depths = F.transform(
        F.filter(lines, lambda x: ~_blank(x) & ~x.contains("{") & ~x.contains("}")), lambda x: F.floor(indent_width(x) / 4).cast("int")
    )
    return F.coalesce(F.array_max(depths), F.lit(0))


def strip_comments(source):
    """Block comments become a space, line comments vanish."""
    return F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"//.*", "")


def strip_by_language(source):
    """Comments taken out by the markers of the language column: # to the end of the line, or block and // comments."""
    return F.when(F.col("language").isin("python", "ruby"), F.regexp_replace(source, r"#.*", "")).otherwise(strip_comments(source))


def strip_strings(text):
    # possessive runs: a long literal must not recurse in the matcher
    return F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', '""')


def java_nesting(source):
    """Greatest character-level brace depth of the cleaned text, less one for the class body."""
    braces = F.regexp_extract_all(strip_strings(strip_comments(source)), F.lit(r"[{}]"), F.lit(0))

    def step(a, c):
        depth = F.when(c == "{", a["depth"] + 1).otherwise(F.greatest(F.lit(0), a["depth"] - 1))
        return F.struct(depth.alias("depth"), F.greatest(a["top"], depth).alias("top"))

    top = F.aggregate(braces, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("top")), step, lambda a: a["top"])
    return F.greatest(F.lit(0), top - 1)


def java_comment_lines(lines):
    """Comment lines under the Java order of tests: inside a block, then //, then a block start."""

    def step(a, line):
        text = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        single = ~a["inside"] & text.startswith("//")
        opens = ~a["inside"] & ~single & text.contains("/*")
        after = F.regexp_extract(text, r"/\*(.*)$", 1)
        inside = F.when(a["inside"], ~line.contains("*/")).when(opens, ~after.contains("*/")).otherwise(F.lit(False))
        return F.struct(inside.alias("inside"), (a["n"] + (a["inside"] | single | opens).cast("int")).alias("n"))

    return F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n")), step, lambda a: a["n"])


def _parameter_count(text):
    return F.size(F.filter(F.split(text, ","), lambda p: ~_blank(p)))


def _parameters():
    """Parameter counts of the functions a language's pattern finds, in order."""

    def build(rules):
        if rules["function"] is None:
            return F.array().cast("array<int>")
        groups = [
            F.regexp_extract_all(F.col("source"), F.lit("(?U)" + rules["function"]), F.lit(g)) for g in range(1, rules["groups"] + 1)
        ]
        names = [f"g{i}" for i in range(len(groups))]
        zipped = F.arrays_zip(*[g.alias(n) for g, n in zip(groups, names)])

        def count(match):
            # the first group that reads as a list and not as a plain name holds the parameters
            case = None
            for i in range(len(groups)):
                g = match.getField(names[i])
                listed = g.contains(",") | ((g != "") & ~g.rlike(r"(?U)^[^\W\d]\w*$"))
                case = F.when(listed, _parameter_count(g)) if case is None else case.when(listed, _parameter_count(g))
            return case.otherwise(0)

        return F.transform(zipped, count)

    return _by_language(build)


def function_profile(profiled):
    """function_count, average and maximum parameters and sizes; needs sloc and language."""
    params = F.when(F.col("language") == "python", F.col("_found.params")).otherwise(_parameters())
    counted = with_blocks(profiled).withColumn("_params", params).withColumn("function_count", F.size("_params"))
    n = F.col("function_count")
    average_size = F.when(n > 0, F.round(F.col("sloc") / n, 1)).otherwise(0.0)
    total = F.aggregate("_params", F.lit(0), lambda a, x: a + x)
    return counted.withColumn("avg_function_size", average_size).select(
        *profiled.columns, "function_count", F.coalesce(F.array_max("_params"), F.lit(0)).alias("max_param_count"),
        F.when(n > 0, F.round(total / n, 1)).otherwise(0.0).alias("avg_param_count"),
        "avg_function_size", F.floor(F.col("avg_function_size") * 1.6).cast("int").alias("max_function_size"),
    )


_FOUND = StructType([StructField(name, ArrayType(IntegerType())) for name in ("sizes", "complexity", "params", "class_sizes")])


@F.pandas_udf(_FOUND)
def _blocks(language: pd.Series, text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([blocks(*row) for row in zip(language, text)], columns=_FOUND.names)


def with_blocks(sources):
    """Add `_found`: sizes, complexities and parameters of the functions and sizes of the classes of Python and Java files, by
    indentation and by braces, in one pass over each text; needs language. Other languages have none."""
    java = F.when(F.col("language") == "java", strip_comments(F.col("source")))
    text = F.when(F.col("language") == "python", F.col("source")).otherwise(java)
    return sources.withColumn("_found", _blocks(F.col("language"), text))


def python_blocks(lines):
    """Struct nesting, cognitive of a Python text from its indentation.

    Depths follow a syntax tree: an elif lies inside the if before it, a handler
    inside its try, an else at the depth of what it belongs to. nesting is the
    greatest depth of control blocks. cognitive adds, for each if, loop and try,
    one more than the depth of blocks and functions around it; for an inner
    function that depth; and one per boolean operator.
    """
    zero = F.struct(
        F.array().cast("array<struct<indent:int,word:string,depth:int,load:int>>").alias("open"),
        F.lit(0).alias("nesting"), F.lit(0).alias("cognitive"),
    )

    def total(blocks, field):
        return F.aggregate(blocks, F.lit(0), lambda n, b: n + b[field])

    def step(a, line):
        indent = indent_width(line)
        word = F.regexp_extract(line, lang.PYTHON_HEADER, 1)
        kept = F.filter(a["open"], lambda b: b["indent"] < indent)
        beside = F.get(F.filter(a["open"], lambda b: b["indent"] == indent), F.lit(0))
        beside_depth, beside_load = F.coalesce(beside["depth"], F.lit(0)), F.coalesce(beside["load"], F.lit(0))
        plain = word.isin("if", "for", "while", "try")
        depth = (
            F.when(plain | word.isin("with", "finally"), 1).when(word == "elif", beside_depth + 1).when(word == "except", 2)
            .when(word == "else", F.when(beside["word"] == "except", 1).otherwise(beside_depth)).otherwise(0)
        )
        load = (
            F.when(plain | word.isin("def", "except", "finally"), 1).when(word == "elif", beside_load + 1)
            .when(word == "else", beside_load).otherwise(0)
        )
        around = total(kept, "load")
        gained = (
            F.when(plain, around + 1).when(word == "elif", around + beside_load + 1).when(word == "def", around).otherwise(0)
            + F.regexp_count(line, F.lit(lang.PYTHON_BOOLEAN))
        )
        block = F.struct(indent.alias("indent"), word.alias("word"), depth.alias("depth"), load.alias("load"))
        moved = F.struct(
            F.when(word != "", F.concat(kept, F.array(block))).otherwise(kept).alias("open"),
            F.greatest(a["nesting"], total(kept, "depth") + depth).alias("nesting"),
            (a["cognitive"] + gained).alias("cognitive"),
        )
        return F.when(_blank(line) | line.rlike(r"^\s*#"), a).otherwise(moved)

    return F.aggregate(lines, zero, step, lambda a: F.struct(a["nesting"].alias("nesting"), a["cognitive"].alias("cognitive")))


def function_spans(sources):
    """Rows (repo, file_path, ordinal, size): functions of Python files by indentation, of Java files by braces."""
    found = with_blocks(with_language(sources))
    return found.select("repo", "file_path", F.posexplode("_found.sizes").alias("ordinal", "size"))


def class_count():
    python = F.regexp_count(F.col("source"), F.lit("(?m)" + lang.PYTHON_CLASS))

    def build(rules):
        return F.lit(0) if rules["klass"] is None else F.regexp_count(F.col("source"), F.lit("(?U)" + rules["klass"]))

    return F.when(F.col("language") == "python", python).otherwise(_by_language(build))


def import_count():
    return F.when(F.col("language") == "python", F.regexp_count(F.col("source"), F.lit(lang.PYTHON_IMPORT))).otherwise(
        F.regexp_count(F.col("source"), F.lit(lang.JAVA_IMPORT))
    )


def declarations(sources):
    return with_language(sources).select("repo", "file_path", class_count().alias("class_count"), import_count().alias("import_count"))


def with_halstead(df):
    """Halstead volume, difficulty, effort and bugs of the text without comments and strings; operands are names that are no
    keywords, of Python in Python files and of Java in all others."""
    tagged = df if "language" in df.columns else with_language(df)
    clean = strip_strings(strip_by_language(F.col("source")))
    words = F.regexp_extract_all(clean, F.lit("(?U)" + lang.IDENTIFIERS), F.lit(0))
    names = F.when(F.col("language") == "python", F.filter(words, lambda w: ~w.isin(lang.PYTHON_KEYWORDS))).otherwise(F.filter(words, lambda w: ~w.isin(lang.JAVA_KEYWORDS)))
    counted = tagged.withColumn("_ops", F.regexp_extract_all(clean, F.lit(lang.OPERATORS), F.lit(0))).withColumn("_ids", names)
    sized = counted.select(
        *df.columns, F.size("_ops").alias("_operators"), F.size("_ids").alias("_operands"),
        F.size(F.array_distinct("_ops")).alias("_own_operators"), F.size(F.array_distinct("_ids")).alias("_own_operands"),
    )
    n, total = F.col("_own_operators") + F.col("_own_operands"), F.col("_operators") + F.col("_operands")
    usable = F.col("_own_operands") > 0
    volume = F.when(usable & (n > 1), total * F.log2(n.cast("double"))).otherwise(0.0)
    difficulty = F.when(
        usable, F.col("_own_operators") / 2.0 * F.try_divide(F.col("_operands"), F.col("_own_operands"))
    ).otherwise(0.0)
    return sized.withColumn("_v", volume).withColumn("_d", difficulty).select(
        *df.columns, F.round("_v", 3).alias("halstead_volume"), F.round("_d", 3).alias("halstead_difficulty"),
        F.round(F.col("_d") * F.col("_v"), 3).alias("halstead_effort"), F.round(F.col("_v") / 3000.0, 6).alias("halstead_bugs"),
    )


def maintainability_index(volume, cc, loc):
    """0 .. 100 from volume, complexity and size, each floored at 1."""
    raw = (
        171.0 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * F.greatest(cc.cast("double"), F.lit(1.0))
        - 16.2 * F.log(F.greatest(loc.cast("double"), F.lit(1.0)))
    ) * (100.0 / 171.0)
    return F.round(F.greatest(F.lit(0.0), raw), 2)


def cognitive_complexity(source):
    """Per line: nesting keywords count with the depth so far, jumps count one each."""
    lines = lines_of(strip_strings(strip_comments(source)))

    def step(a, line):
        hits = F.regexp_count(line, F.lit("(?U)" + lang.JAVA_NESTING))
        score = a["score"] + F.when(hits > 0, hits + a["depth"]).otherwise(0) + F.regexp_count(line, F.lit("(?U)" + lang.JAVA_JUMPS))
        depth = a["depth"] + hits + _char_count(line, "{") - _char_count(line, "}")
        return F.struct(score.alias("score"), F.greatest(F.lit(0), depth).alias("depth"))

    return F.aggregate(lines, F.struct(F.lit(0).alias("score"), F.lit(0).alias("depth")), step, lambda a: a["score"])


def code_metrics(sources):
    """The metric columns used by smell rules and scoring, for any language.

    Python and Java files carry sizes, complexities and parameters of every function, Python files also sizes of classes; other
    languages have the averages of function_profile only.
    """
    profiled = with_blocks(function_profile(comment_profile(sources)))
    lines = lines_of(F.col("source"))
    python, java = F.col("language") == "python", F.col("language") == "java"
    sizes, each = F.col("_found.sizes"), F.col("_found.complexity")
    exact = (python | java) & (F.size(sizes) > 0)
    mean = lambda a: F.round(F.aggregate(a, F.lit(0), lambda n, x: n + x) / F.size(a), 2)
    # Java's greatest complexity is the file's, as the text rules have it; its mean is shared out over the methods
    whole = 1 + F.regexp_count(strip_comments(F.col("source")), F.lit("(?U)" + lang.JAVA_DECISION))
    complexity = F.when(python, F.coalesce(F.array_max(each), F.lit(0))).when(java, whole).otherwise(F.col("cyclomatic_complexity"))
    average = (
        F.when(python, F.when(F.size(each) > 0, mean(each)).otherwise(0.0))
        .when(java, F.round(whole / F.greatest(F.size(sizes), F.lit(1)), 2))
        .otherwise(F.col("cyclomatic_complexity").cast("double"))
    )
    nesting = (
        F.when(python, F.col("_blocks.nesting"))
        .when(java, java_nesting(F.col("source")))
        .otherwise(F.greatest(brace_depth(lines), indent_depth(lines)))
    )
    profiled = profiled.withColumn("_blocks", F.when(python, python_blocks(lines)))
    wide = with_halstead(
        profiled.withColumn("function_sizes", sizes)
        .withColumn("class_sizes", F.col("_found.class_sizes"))
        .withColumn("param_counts", F.col("_found.params"))
        .withColumn("function_complexities", each)
        .withColumn("max_cyclomatic_complexity", complexity)
        .withColumn("avg_cyclomatic_complexity", average)
        .withColumn("max_function_size", F.when(exact, F.array_max(sizes)).otherwise(F.col("max_function_size")))
        .withColumn("avg_function_size", F.when(exact, mean(sizes)).otherwise(F.col("avg_function_size")))
        .withColumn("max_class_size", F.coalesce(F.array_max("_found.class_sizes"), F.lit(0)))
        .withColumn("max_nesting_depth", nesting)
        .withColumn("class_count", class_count())
        .withColumn("import_count", import_count())
        .withColumn("cognitive_complexity", F.when(python, F.col("_blocks.cognitive")).otherwise(cognitive_complexity(F.col("source"))))
        .drop("_blocks", "_found")
    )
    return wide.withColumn(
        "maintainability_index", maintainability_index(F.col("halstead_volume"), F.col("avg_cyclomatic_complexity"), F.col("loc"))
    )


# Default smell thresholds.
THRESHOLDS = {"long_method": 50, "long_param": 5, "large_class": 300, "deep_nesting": 4, "high_complexity": 10}
SMELL_FLAGS = ["has_long_method", "has_long_param_list", "has_large_class", "has_deep_nesting", "has_high_complexity"]
SMELL_COUNTS = ["long_method_count", "long_param_count", "large_class_count", "deep_nesting_count", "high_complexity_count"]


def _smell_counts(ruleset, t):
    """The five smell counts under a rule set, as columns."""

    def number(array, test):
        return F.size(F.filter(F.col(array), test))

    def one(condition):
        return condition.cast("int")

    if ruleset == "python":
        return [
            number("function_sizes", lambda s: s >= t["long_method"]),
            number("param_counts", lambda p: p >= t["long_param"]),
            number("class_sizes", lambda s: s >= t["large_class"]),
            one(F.col("max_nesting_depth") >= t["deep_nesting"]),
            one(F.col("max_cyclomatic_complexity") >= t["high_complexity"]),
        ]
    if ruleset == "java":
        per_class = F.col("loc") / F.greatest(F.col("class_count"), F.lit(1))
        return [
            number("function_sizes", lambda s: s > t["long_method"]),
            number("param_counts", lambda p: p > t["long_param"]),
            one(per_class > t["large_class"]),
            one(F.col("max_nesting_depth") > t["deep_nesting"]),
            one(F.col("max_cyclomatic_complexity") > t["high_complexity"]),
        ]
    return [
        one((F.col("avg_function_size") > 35) | (F.col("max_function_size") > 45)),
        one(F.col("max_param_count") >= 5),
        one(((F.col("class_count") <= 2) & (F.col("sloc") > 250)) | (F.col("sloc") > 400)),
        one(F.col("max_nesting_depth") >= 4),
        one(F.col("cyclomatic_complexity") >= 15),
    ]


def _flagged(metrics, counts, adds_counts):
    """Counts, flags and total; `adds_counts` says whether the total adds counts, else flags."""
    counted = metrics.select("*", *[c.alias(n) for c, n in zip(counts, SMELL_COUNTS)])
    flagged = counted.select("*", *[(F.col(c) > 0).cast("int").alias(f) for c, f in zip(SMELL_COUNTS, SMELL_FLAGS)])
    add = lambda names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return flagged.withColumn("total_smells", F.when(adds_counts, add(SMELL_COUNTS)).otherwise(add(SMELL_FLAGS)))


def smell_flags(metrics, ruleset="python", thresholds=None):
    """Add the five flags, five counts and the total under one of three rule sets.

    python: a threshold is reached (>=), the total adds counts.
    java: a threshold is passed (>), the total adds flags, class size is lines per class.
    polyglot: fixed mixed rules on averages, counts equal flags.
    """
    return _flagged(metrics, _smell_counts(ruleset, {**THRESHOLDS, **(thresholds or {})}), F.lit(ruleset == "python"))


def ruleset_of(language):
    """The rule set of a language: Python and Java have their own, all others share one."""
    return F.when(language == "python", "python").when(language == "java", "java").otherwise("polyglot")


def smell_flags_by_language(metrics, thresholds=None):
    """smell_flags with each row's own rule set, in one pass; adds `ruleset`."""
    t = {**THRESHOLDS, **(thresholds or {})}
    ruled = metrics.withColumn("ruleset", ruleset_of(F.col("language")))
    own = zip(*[_smell_counts(r, t) for r in ("python", "java", "polyglot")])
    counts = [F.when(F.col("ruleset") == "python", a).when(F.col("ruleset") == "java", b).otherwise(c) for a, b, c in own]
    return _flagged(ruled, counts, F.col("ruleset") == "python")
