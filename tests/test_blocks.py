"""Functions and classes of a text against Python's own parser and a search for each brace's match."""

import ast
import random
import time

import pytest
from pyspark.sql import functions as F

from faultline.functions import blocks
from faultline.functions import languages as lang
from faultline.operators import source_metrics

PARAMETERS = ["", "a", "a, b=1", "self, *args, key=2, **rest", "a, /, b", "a: dict[str, int] = {}, b=(1, 2)", "*, only", "x='a,b)', y=\"(\"", "a,\n        b,  # (c,\n        c"]


def made_python(seed):
    rng, out = random.Random(seed), []

    def body(depth, left):
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            pad = "    " * depth
            if kind < 0.3 and left:
                out.append(f"{pad}{rng.choice(['', 'async '])}def f{len(out)}({rng.choice(PARAMETERS)}):")
                body(depth + 1, left - 1)
            elif kind < 0.45 and left:
                out.append(f"{pad}class C{len(out)}:")
                body(depth + 1, left - 1)
            elif kind < 0.7 and left:
                out.append(f"{pad}if a and b:  # or not, for")
                body(depth + 1, left - 1)
            else:
                out.append(f"{pad}x = {len(out)}")
            if rng.random() < 0.2:
                out.append("")
        out.append(f"{'    ' * depth}y = 0")

    body(0, 5)
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("seed", range(30))
def test_python_functions_and_classes(seed):
    text = made_python(seed)
    found = [n for n in ast.walk(ast.parse(text)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    found.sort(key=lambda n: n.lineno)
    classes = sorted((n.lineno, n.end_lineno - n.lineno + 1) for n in ast.walk(ast.parse(text)) if isinstance(n, ast.ClassDef))
    sizes, complexity, parameters, class_sizes = blocks.python_blocks(text)
    assert sizes == [n.end_lineno - n.lineno + 1 for n in found] and class_sizes == [s for _, s in classes]
    assert parameters == [len(n.args.args) + len(n.args.posonlyargs) for n in found]
    assert complexity == [1 + sum(isinstance(x, (ast.If, ast.BoolOp)) for x in ast.walk(n)) for n in found]


def by_hand(text):
    out = []
    for m in blocks._JAVA_METHOD.finditer(text):
        depth, start = 0, m.end() - 1
        stop = start
        for i in range(start, len(text)):
            depth += (text[i] == "{") - (text[i] == "}")
            if depth == 0:
                stop = i
                break
        out.append((text[start : stop + 1].count("\n") + 1, 1 + len([d for d in blocks._JAVA_DECISION.finditer(text) if start <= d.start() < stop])))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_java_methods(seed):
    rng = random.Random(seed)
    pieces = ["void run(int a, int b) {", "int get() throws X {", "if (a && b) {", "}", "}", "\n", "\n", "x = 1;", "for (;;) {", "new int[] {1, 2}", " "]
    text = " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 80)))
    sizes, complexity, _, _ = blocks.java_blocks(text)
    assert list(zip(sizes, complexity)) == by_hand(text)


def test_time_grows_with_the_text():
    def seconds(text, find):
        best = min(timed(find, text) for _ in range(3))
        return best

    def timed(find, text):
        start = time.perf_counter()
        find(text)
        return time.perf_counter() - start

    java = lambda n: "class A {\n" + "".join(f"  int m{i}(int a) {{\n    if (a > {i}) {{ return a; }}\n    return {i};\n  }}\n" for i in range(n)) + "}\n"
    python = lambda n: "".join(f"def m{i}(a, b=1):\n    if a:\n        return b\n\n" for i in range(n))
    for make, find in ((java, blocks.java_blocks), (python, blocks.python_blocks)):
        assert seconds(make(16_000), find) < 4 * seconds(make(8_000), find)


def test_metrics_of_functions(spark):
    python = "def f(a, *rest, b):\n    if a:\n        return 1\n    return 2\n\nclass K:\n    def g(self):\n        return 3  # // no comment here\n"
    java = "class A {\n  int get(int a) {\n    if (a > 0 && a < 9) { return 1; }\n    return 0;\n  }\n  void go() {\n  }\n}\n"
    rows = [("r", "a.py", python), ("r", "A.java", java), ("r", "b.go", "func f(a int) {\n}\n"), ("r", "c.py", ""), ("r", "d.py", "x = 1 // 2\n")]
    got = {r.file_path: r for r in source_metrics.code_metrics(spark.createDataFrame(rows, "repo string, file_path string, source string")).collect()}
    a, j = got["a.py"], got["A.java"]
    assert (a.function_sizes, a.function_complexities, a.param_counts, a.class_sizes) == ([4, 2], [2, 1], [1, 1], [3])
    assert (a.max_cyclomatic_complexity, a.avg_cyclomatic_complexity, a.max_function_size, a.avg_function_size, a.max_class_size) == (2, 1.5, 4, 3.0, 3)
    assert (j.function_sizes, j.function_complexities, j.param_counts, j.max_cyclomatic_complexity, j.avg_cyclomatic_complexity) == ([4, 2], [3, 1], [1, 0], 3, 1.5)
    assert got["c.py"].max_cyclomatic_complexity == 0 and got["b.go"].function_sizes == []
    whole = source_metrics.with_halstead(spark.createDataFrame(rows, "repo string, file_path string, source string")).where("file_path = 'd.py'").first()
    assert whole.halstead_volume > 0 and whole.halstead_difficulty == 1.0


LANGUAGE_CASES = {
    "java": ("public static int run(int a, int b) throws X {", ["int a, int b"]), "kotlin": ("suspend fun <T> go(a: T) = 1", ["a: T"]),
    "go": ("func (s *T) Add(a int) int {", ["a int"]), "rust": ("pub async fn f<T>(a: T) -> T {", ["a: T"]),
    "cpp": ("std::vector<int> f(int a) const {", ["int a"]), "c": ("static char * f(int a) {", ["int a"]), "ruby": ("def ok?(a, b)", ["a, b"]),
}


@pytest.mark.parametrize("name", LANGUAGE_CASES)
def test_declaration_patterns(spark, name):
    """One declaration of each language: modifiers ahead of it do not change what is found."""
    text, want = LANGUAGE_CASES[name]
    rules = lang.LANGUAGES[name]
    found = F.regexp_extract_all(F.lit(text), F.lit("(?U)" + rules["function"]), F.lit(rules["groups"]))
    assert spark.range(1).select(found.alias("f")).first().f == want
